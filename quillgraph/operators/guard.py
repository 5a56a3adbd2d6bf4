"""Size guardrail: token estimates, the warning predicate and truncation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, trim_ws

TOKEN_LIMIT = 9000


def with_token_estimate(docs: DataFrame, *, column: str = "text", name: str = "token_estimate") -> DataFrame:
    return docs.withColumn(name, estimate_tokens(column))


def over_limit(docs: DataFrame, *, limit: int = TOKEN_LIMIT, forced: bool = False) -> DataFrame:
    """docs with `over_limit`: strictly more tokens than the limit, unless the run is forced."""
    return docs.withColumn("over_limit", F.lit(False) if forced else estimate_tokens("text") > limit)


def truncate(docs: DataFrame, *, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Texts cut to the characters of `limit` tokens."""
    return docs.withColumn("text", F.substring("text", 1, limit * 4))


def with_text(docs: DataFrame) -> DataFrame:
    """Documents whose text is not blank."""
    return docs.filter(trim_ws("text") != "")
