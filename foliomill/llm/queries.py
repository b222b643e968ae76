"""Queries of the ten operators over their whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from .decontamination import op4_decontamination
from .licenses import op8_licenses
from .lm_scores import op10_lm_scores
from .mixing import OP7_SQL, op7_mixing
from .ngram_join import op3_ngram_join
from .quality import op6_quality
from .suffix_dedup import op5_suffix_dedup
from .token_counts import op1_token_counts
from .topk import OP9_SQL, op9_topk
from .toxicity import op2_toxicity

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_join": op3_ngram_join,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_licenses": op8_licenses,
    "op9_topk": op9_topk,
    "op10_lm_scores": op10_lm_scores,
}

ORACLES: dict[str, str] = {"op7_mixing": OP7_SQL, "op9_topk": OP9_SQL}
