"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op10_licenses import op10_licenses
from .op1_secrets import op1_secrets
from .op2_sentencepiece import op2_sentencepiece
from .op3_toxicity import op3_toxicity
from .op4_jaccard import OP4_SQL, op4_jaccard
from .op5_pii import op5_pii
from .op6_sharding import OP6_SQL, op6_sharding
from .op7_tokens import op7_tokens
from .op8_decontaminate import OP8_SQL, op8_decontaminate
from .op9_quality import OP9_SQL, op9_quality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_toxicity": op3_toxicity,
    "op4_jaccard": op4_jaccard,
    "op5_pii": op5_pii,
    "op6_sharding": op6_sharding,
    "op7_tokens": op7_tokens,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_licenses": op10_licenses,
}

ORACLE_SQL: dict[str, str] = {"op4_jaccard": OP4_SQL, "op6_sharding": OP6_SQL, "op8_decontaminate": OP8_SQL, "op9_quality": OP9_SQL}
