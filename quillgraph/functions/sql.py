"""Table functions for Spark SQL: chunks of a text and propositions of a reply, by lateral joins.

    register(spark)
    SELECT d.doc_id, c.* FROM documents d, LATERAL chunk_text(d.text, 900, 120) c
    SELECT r.doc_id, p.* FROM replies r, LATERAL parse_reply(r.reply) p
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..session import ship_package
from .taxonomy import MENTION

CHUNKS = "chunk_index int, text string, token_estimate int"
PARSED = f"pos int, local_id string, text string, subject {MENTION}, predicate string, object {MENTION}, confidence double"


class ChunkText:
    """chunk_text(text, target tokens, overlap tokens): the rows of chunk_documents for one text; none for a null or blank one."""

    def eval(self, text: str, target: int, overlap: int) -> Iterator[tuple]:
        from ..operators.chunking import chunk_text

        yield from chunk_text(text, target=target, overlap=overlap) if text else ()


class ParseReply:
    """parse_reply(reply): a row for each well-formed proposition, numbered from 0; for a usable reply without any one row of nulls, for others none."""

    def eval(self, reply: str) -> Iterator[tuple]:
        from ..plans.engines import parse_reply

        found = parse_reply(reply) if reply is not None else None
        if found == []:
            yield (None,) * 7
        for pos, p in enumerate(found or ()):
            yield (pos, p["local_id"], p["text"], p["subject"], p["predicate"], p["object"], p["confidence"])


def register(spark: SparkSession) -> None:
    """Make chunk_text and parse_reply known to the session's SQL."""
    ship_package(spark)
    for name, f, ddl in (("chunk_text", ChunkText, CHUNKS), ("parse_reply", ParseReply, PARSED)):
        spark.udtf.register(name, udtf(f, returnType=ddl, useArrow=False))
