"""Part of the sensitivity engine."""
