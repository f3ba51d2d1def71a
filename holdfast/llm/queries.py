"""Queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm.chat_format import OP2_SQL, op2_chat_format
from holdfast.llm.decontaminate import op6_decontaminate
from holdfast.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from holdfast.llm.fill_middle import OP11_SQL, op11_fill_middle
from holdfast.llm.language_id import op4_language_id
from holdfast.llm.line_dedup import OP9_SQL, op9_line_dedup
from holdfast.llm.lm_scoring import op5_lm_scoring
from holdfast.llm.minhash_forest import op12_minhash_forest
from holdfast.llm.packing import op10_packing
from holdfast.llm.simhash import op8_simhash
from holdfast.llm.substring_dedup import OP3_SQL, op3_substring_dedup
from holdfast.llm.token_alignment import op13_token_alignment
from holdfast.llm.url_filter import OP1_SQL, op1_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_chat_format": op2_chat_format,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_language_id": op4_language_id,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_decontaminate": op6_decontaminate,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_simhash": op8_simhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_packing": op10_packing,
    "op11_fill_middle": op11_fill_middle,
    "op12_minhash_forest": op12_minhash_forest,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {
    "op1_url_filter": OP1_SQL,
    "op2_chat_format": OP2_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op9_line_dedup": OP9_SQL,
    "op11_fill_middle": OP11_SQL,
}
