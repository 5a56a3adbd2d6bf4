"""Plan helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import saved, scratch, ship_package

__all__ = ["chunked", "components", "exchange_sizes", "saved", "scratch", "text_bytes"]

CHUNK_BYTES, MAX_CHUNK_BYTES = 2 << 20, 32 << 20
BUCKET_BYTES, MAX_BUCKET_BYTES = 4 << 20, 128 << 20


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of a text column over all rows."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()["b"])


def exchange_sizes(n_bytes: int, chunk_bytes: int | None, bucket_bytes: int | None) -> tuple[int, int]:
    """Bytes of text of a chunk, and of the text whose hashes one bucket gets.

    Every chunk sends a blob to every bucket, so with fixed sizes blobs would shrink as the
    input grows. Both sizes follow the root of the input instead, which keeps a blob at some
    60 hashes or more, up to bounds that a worker's memory sets: beyond a few TB blobs get
    shorter again and cost a few bytes more a hash.
    """
    grown = max(1.0, 6 * 64 * n_bytes / (CHUNK_BYTES * BUCKET_BYTES)) ** 0.5
    return chunk_bytes or min(MAX_CHUNK_BYTES, int(CHUNK_BYTES * grown)), bucket_bytes or min(MAX_BUCKET_BYTES, int(BUCKET_BYTES * grown))


def chunked(docs: DataFrame, n_bytes: int, *, chunk_bytes: int, by: str = "doc_id") -> DataFrame:
    """docs with a `chunk` number: about chunk_bytes of text each, dealt by a hash of the id.

    The number depends on the row alone, so a recomputed task deals its rows alike.
    """
    ship_package(docs.sparkSession)
    n = max(1, -(-n_bytes // chunk_bytes))
    return docs.withColumn("chunk", F.pmod(F.xxhash64(F.col(by), F.lit(11)), F.lit(n)).cast("int"))
