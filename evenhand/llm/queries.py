"""Registered queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .conversation_repair import op11_conversation_repair
from .conversation_trie import op13_conversation_trie
from .decontaminate import op10_decontaminate
from .language_id import op2_language_id
from .license_scan import op4_license_scan
from .near_dedup import op5_near_dedup
from .oracles import ORACLES as ORACLES
from .packing import op7_packing
from .pieces import op12_pieces
from .quality_classifier import op8_quality_classifier
from .quality_rules import op6_quality_rules
from .substring_dedup import op1_substring_dedup
from .token_counts import op3_token_counts
from .token_files import op9_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    fn.__name__: fn for fn in (
        op1_substring_dedup, op2_language_id, op3_token_counts, op4_license_scan, op5_near_dedup, op6_quality_rules,
        op7_packing, op8_quality_classifier, op9_token_files, op10_decontaminate, op11_conversation_repair, op12_pieces,
        op13_conversation_trie)}
