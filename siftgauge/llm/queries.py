"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .op1_suffix_dedup import op1_suffix_dedup
from .op2_quality import op2_quality_rules
from .op3_warc_zip import op3_warc_zip
from .op4_token_store import op4_token_store
from .op5_language import op5_language_id
from .op6_jaccard_join import op6_jaccard_join
from .op7_sharding import op7_shard_rows
from .op8_html import op8_html_text
from .op9_packing import op9_packing
from .op10_decontaminate import op10_decontaminate
from .oracles import ORACLES  # noqa: F401

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_quality_rules, op3_warc_zip, op4_token_store, op5_language_id, op6_jaccard_join, op7_shard_rows, op8_html_text, op9_packing, op10_decontaminate)}
