"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op2_decontamination
from .language_id import op3_language
from .packing import op6_packing
from .quality import OP10_SQL, op10_quality
from .secret_scan import op7_secrets
from .simhash import op4_simhash
from .substrings import op9_substrings
from .token_blocks import op1_token_blocks
from .token_counts import op8_token_counts
from .toxicity import op5_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_blocks,
        op2_decontamination,
        op3_language,
        op4_simhash,
        op5_toxicity,
        op6_packing,
        op7_secrets,
        op8_token_counts,
        op9_substrings,
        op10_quality,
    )
}
ORACLE: dict[str, str] = {"op10_quality": OP10_SQL}
