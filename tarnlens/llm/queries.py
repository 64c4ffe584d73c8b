"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op7_decontamination
from .line_dedup import OP4_SQL, op4_line_dedup
from .ngram_join import op5_ngram_join
from .ogg import op10_ogg
from .oracles import OP5_SQL, OP7_SQL, OP9_SQL
from .pieces import op8_sentencepiece
from .repeated_bytes import op6_suffix_dedup
from .substring_dedup import op9_substring_dedup
from .token_counts import op1_token_counts
from .token_shards import op2_token_shards
from .toxicity import op3_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_token_shards": op2_token_shards,
        "op3_toxicity": op3_toxicity,
        "op4_line_dedup": op4_line_dedup,
        "op5_ngram_join": op5_ngram_join,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_decontamination": op7_decontamination,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_ogg": op10_ogg,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op5_ngram_join": OP5_SQL, "op7_decontamination": OP7_SQL, "op9_substring_dedup": OP9_SQL}
