"""The queries of this subpackage, and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from antigen.llm.ann import op1_ann
from antigen.llm.byte_bpe import op7_byte_bpe
from antigen.llm.exact_topk import OP8_SQL, op8_exact_topk
from antigen.llm.fingerprints import op11_fingerprints
from antigen.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from antigen.llm.language_id import op9_language_id
from antigen.llm.line_dedup import op5_line_dedup
from antigen.llm.mixing import op6_mixing
from antigen.llm.near_dedup import op10_near_dedup
from antigen.llm.toxicity import op2_toxicity
from antigen.llm.oracles import OP5_SQL, OP10_SQL
from antigen.llm.periodic_runs import op13_periodic_runs
from antigen.llm.span_dedup import op4_span_dedup
from antigen.llm.token_counts import op3_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_span_dedup": op4_span_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_mixing": op6_mixing,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_exact_topk": op8_exact_topk,
    "op9_language_id": op9_language_id,
    "op10_near_dedup": op10_near_dedup,
    "op11_fingerprints": op11_fingerprints,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {"op5_line_dedup": OP5_SQL, "op8_exact_topk": OP8_SQL, "op10_near_dedup": OP10_SQL, "op12_hard_negatives": OP12_SQL}
