"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from functools import partial

from . import catalog, classify, files, geometry, procedures, recursive, report, scene, sensitivity  # noqa: F401


def _run(name, spark, sf_dir):
    return catalog.build(spark, sf_dir, name)


QUERIES = {name: partial(_run, name) for name in catalog.QUERIES} | procedures.QUERIES | files.QUERIES
ORACLES = {name: catalog.sql(name) for name in catalog.QUERIES} | procedures.ORACLES | files.ORACLES | recursive.ORACLES
