"""Extraction of a stream of chunks with state carried from chunk to chunk of a document.

Each document keeps, in Spark's state store, the number of the chunk that is next, the chunks
that came before their turn, the names seen so far and whether a fatal failure ended it. So
chunks of a document may arrive in any micro-batch and any order, and more than once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.extraction import PRIOR_ENTITIES
from ..plans.engines import ChunkContext, ExtractionEngine, FatalEngineError
from ..plans.pipeline import _ITEM, NamesSeen
from ..session import found_by_the_driver, ship_package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CarriedExtraction(StatefulProcessor):
    """Takes the chunks of one document in the order of their numbers, as far as they have come."""

    def __init__(self, engine: ExtractionEngine, carry: int):
        self.engine, self.carry = engine, carry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "next int, early int, dead boolean")
        self.names = handle.getListState("names", "name string")
        self.early = handle.getMapState("early", "chunk_index int", "text string, title string, last boolean")
        self.engine.init()

    def close(self) -> None:
        self.engine.dispose()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at, waiting, dead = tuple(self.head.get()) if self.head.exists() else (0, 0, False)
        came: dict[int, tuple] = {}
        for row in rows:
            if row["chunk_index"] >= at:  # else it was dealt with before
                came.setdefault(row["chunk_index"], (row["text"], row["title"], row["last"]))
        seen: NamesSeen | None = None
        out = []
        while at in came or (waiting and self.early.containsKey((at,))):
            if waiting and self.early.containsKey((at,)):
                text, title, last = self.early.getValue((at,))
                self.early.removeKey((at,))
                waiting -= 1
                came.pop(at, None)
            else:
                text, title, last = came.pop(at)
            if seen is None:
                seen = NamesSeen(self.carry, (r[0] for r in self.names.get()) if self.names.exists() else ())
            state, error, found, prior = "skipped", None, None, None
            if not dead:
                prior = list(seen.last)
                try:
                    found = self.engine.extract(text, ChunkContext(at, title, prior, str(key[0])))
                    state = "ok"
                    seen.add_ends(found)
                except FatalEngineError as e:
                    state, error, dead = "dropped", str(e), True
                except Exception as e:  # noqa: BLE001  a chunk that fails is dropped and reported
                    state, error = "dropped", str(e)
            mention = lambda m: Row(name=m["name"], type=m["type"])
            items = None if found is None else [Row(pos=i, local_id=p["local_id"], text=p["text"], subject=mention(p["subject"]), predicate=p["predicate"], object=mention(p["object"]), confidence=p["confidence"]) for i, p in enumerate(found)]
            out.append(Row(doc_id=key[0], chunk_index=at, state=state, error=error, prior_entities=prior, propositions=items))
            at += 1
            if last:  # nothing follows: only the number stays, so that repeats are still known
                self.names.clear()
                seen = NamesSeen(self.carry)
        for number, chunk in came.items():
            if not (waiting and self.early.containsKey((number,))):
                self.early.updateValue((number,), chunk)
                waiting += 1
        if seen is not None and seen.new:
            self.names.appendList([(name,) for name in seen.new])
        self.head.update((at, waiting, dead))
        yield from out


def extract_stream(chunks: DataFrame, engine: ExtractionEngine, *, carry: int = PRIOR_ENTITIES) -> DataFrame:
    """(doc_id, chunk_index, state, error, prior_entities, propositions) of a stream of chunks(doc_id, chunk_index, text[, title, last]).

    A row comes out once all chunks of lower number have; it equals that of a batch run over
    the whole document: up to `carry` names seen last are told to the engine, a chunk that
    fails is `dropped`, those after a fatal failure are `skipped`. Chunks whose number came
    before are dropped, whatever they hold. Where `last` is true, the document's names are
    let go after that chunk. Rows without a doc_id or number are ignored.
    """
    ship_package(chunks.sparkSession)
    found_by_the_driver(chunks.sparkSession)
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # the only store with lists and maps
    given = {"title": F.lit(None).cast("string"), "last": F.lit(False)}
    rows = chunks.select("doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), F.coalesce("text", F.lit("")).alias("text"), *[(F.col(c) if c in chunks.columns else d).alias(c) for c, d in given.items()])
    rows = rows.withColumn("last", F.coalesce("last", F.lit(False))).filter("doc_id IS NOT NULL AND chunk_index >= 0")
    kind = chunks.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, chunk_index int, state string, error string, prior_entities array<string>, propositions array<{_ITEM}>"
    return rows.groupBy("doc_id").transformWithState(CarriedExtraction(engine, carry), schema, "Append", "None")


def start_extraction(spark: SparkSession, folder: str, out: str, checkpoint: str, engine: ExtractionEngine, *, schema: str, files_per_trigger: int = 4, carry: int = PRIOR_ENTITIES) -> StreamingQuery:
    """Extract the chunks of the Parquet files that folder holds and hasn't been read of, into Parquet files.

    Started again on its checkpoint, it goes on where it was, in the middle of documents too.
    """
    chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return extract_stream(chunks, engine, carry=carry).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
