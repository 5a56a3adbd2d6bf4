"""The whole run: documents to chunks, propositions, entities and graphs.

Chunks of a document are extracted in order in one worker, as each is told the entities
seen before it; documents run in parallel. Failed chunks are dropped and reported, a fatal
failure ends its document, and what was extracted still becomes a graph.
"""

from __future__ import annotations

import contextlib
import datetime
import threading
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import Accumulator, AccumulatorParam, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import PROPOSITIONS
from ..functions.text import estimate_tokens, sanitize_title
from ..operators.chunking import OVERLAP_TOKENS, TARGET_TOKENS, chunk_documents
from ..operators.extraction import PRIOR_ENTITIES, chunk_status, drop_report, first_valid_attempts, parse_replies, proposition_rows
from ..operators.graph import KnowledgeGraph, assemble_graph
from ..session import forget, saved, ship_package, spread
from .engines import ChunkContext, ExtractionEngine, FatalEngineError

TITLE_CHARS = 4000
_ITEM = "struct<pos:int,local_id:string,text:string,subject:struct<name:string,type:string>,predicate:string,object:struct<name:string,type:string>,confidence:double>"


class ChunksTried(AccumulatorParam):
    """Chunks tried by partition. A partition that runs again, after a failure or a lost executor, counts once."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, value1: dict, value2: dict) -> dict:
        for partition, n in value2.items():
            value1[partition] = max(n, value1.get(partition, 0))
        return value1


class NamesSeen:
    """Names of a document in the order they were first seen; told are the last few, at no cost of the others."""

    def __init__(self, carry: int, names: Iterable[str] = ()):
        self.known: set[str] = set()
        self.last: deque[str] = deque(maxlen=carry)
        self.new: list[str] = []
        for name in names:
            self.add(name)
        self.new.clear()  # since then

    def add(self, name: str) -> None:
        if name not in self.known:
            self.known.add(name)
            self.last.append(name)
            self.new.append(name)

    def add_ends(self, propositions: Iterable[dict]) -> None:
        for p in propositions:
            self.add(p["subject"]["name"])
            self.add(p["object"]["name"])


_tried: dict[tuple, int] = {}  # in a worker: of the task at hand


def _count_tried(tried: Accumulator) -> None:
    context = TaskContext.get()
    task = (context.stageId(), context.partitionId(), context.taskAttemptId())
    n = _tried.get(task, 0) + 1
    _tried.clear()
    _tried[task] = n
    tried.add({context.partitionId(): n})


def extract_chunks(chunks: DataFrame, engine: ExtractionEngine, *, titles: DataFrame | None = None, carry: int = PRIOR_ENTITIES, tried: Accumulator | None = None) -> DataFrame:
    """(doc_id, chunk_index, ok, error, fatal, propositions) of chunks(doc_id, chunk_index, text).

    titles(doc_id, title) are told to the engine. After a fatal failure the document's later
    chunks are not tried. The longest unit of work is one document. `tried`, of ChunksTried,
    counts chunks as tasks finish.
    """
    ship_package(chunks.sparkSession)
    told = chunks.select("doc_id", "chunk_index", "text")
    told = told.join(titles.select("doc_id", "title"), "doc_id", "left") if titles is not None else told.withColumn("title", F.lit(None).cast("string"))
    kind = told.schema["doc_id"].dataType.simpleString()
    told = spread(told, "doc_id")  # engines are slow, their rows few
    mention = pa.struct([("name", pa.string()), ("type", pa.string())])
    item = pa.struct([("pos", pa.int32()), ("local_id", pa.string()), ("text", pa.string()), ("subject", mention), ("predicate", pa.string()), ("object", mention), ("confidence", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["chunk_index", "text", "title"]).to_pylist(), key=lambda r: r["chunk_index"])
        seen = NamesSeen(carry)
        out: dict[str, list] = {"chunk_index": [], "ok": [], "error": [], "fatal": [], "propositions": []}
        dead = False
        document = str(table["doc_id"][0].as_py()) if table.num_rows else None
        engine.init()
        try:
            for row in rows:
                found, error, fatal = None, None, False
                if not dead:
                    if tried is not None:
                        _count_tried(tried)
                    try:
                        found = engine.extract(row["text"], ChunkContext(row["chunk_index"], row["title"], list(seen.last), document))
                        seen.add_ends(found)
                    except FatalEngineError as e:
                        error, fatal, dead = str(e), True, True
                    except Exception as e:  # noqa: BLE001  a chunk that fails is dropped and reported
                        error = str(e)
                for name, value in zip(out, (row["chunk_index"], found is not None, error, fatal, None if found is None else [{"pos": i, **p} for i, p in enumerate(found)]), strict=True):
                    out[name].append(value)
        finally:
            engine.dispose()
        n = len(rows)
        return pa.table({
            "doc_id": table["doc_id"].take(pa.array([0] * n, pa.int64())), "chunk_index": pa.array(out["chunk_index"], pa.int32()), "ok": pa.array(out["ok"], pa.bool_()),
            "error": pa.array(out["error"], pa.string()), "fatal": pa.array(out["fatal"], pa.bool_()), "propositions": pa.array(out["propositions"], pa.list_(item)),
        })

    return told.groupBy("doc_id").applyInArrow(run, f"doc_id {kind}, chunk_index int, ok boolean, error string, fatal boolean, propositions array<{_ITEM}>")


def outcomes_of_replies(replies: DataFrame) -> DataFrame:
    """The same relation from stored replies(doc_id, chunk_index, attempt, reply)."""
    chosen = first_valid_attempts(parse_replies(replies))
    ok = F.col("propositions").isNotNull()
    error = F.concat(F.lit("no usable reply in "), F.col("attempts").cast("string"), F.lit(" tries"))
    return chosen.select("doc_id", "chunk_index", ok.alias("ok"), F.when(~ok, error).alias("error"), F.lit(False).alias("fatal"), "propositions")


def suggest_titles(docs: DataFrame, engine: ExtractionEngine) -> DataFrame:
    """(doc_id, title): given titles, else the engine's for the first characters, cleaned; a failure leaves none."""
    has = F.coalesce(F.col("title"), F.lit("")) != ""
    if not hasattr(engine, "suggest_title"):
        return docs.select("doc_id", F.when(has, F.col("title")).alias("title"))
    ship_package(docs.sparkSession)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for text in batch["excerpt"].to_pylist():
                try:
                    raw.append(engine.suggest_title(text or ""))
                except Exception:  # noqa: BLE001  a title never blocks a run
                    raw.append(None)
            yield pa.record_batch([batch["doc_id"], pa.array(raw, pa.string())], names=["doc_id", "raw"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = docs.filter(~has).select("doc_id", F.substring("text", 1, TITLE_CHARS).alias("excerpt")).mapInArrow(ask, f"doc_id {kind}, raw string")
    return docs.filter(has).select("doc_id", "title").union(asked.select("doc_id", sanitize_title("raw")))


def graph_meta(docs: DataFrame, chunks: DataFrame, titles: DataFrame, *, engine: str, model: str, created_at: str | None = None) -> DataFrame:
    """One row a document; the chunk count includes chunks that were dropped."""
    now = created_at or datetime.datetime.now(datetime.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    counts = chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count"))
    base = docs.select("doc_id", estimate_tokens(F.coalesce("text", F.lit(""))).alias("token_estimate"))
    return base.join(counts, "doc_id", "left").join(titles, "doc_id", "left").select(
        "doc_id", "title", F.lit(now).alias("created_at"), F.lit(engine).alias("engine"), F.lit(model).alias("model"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "token_estimate"
    )


@contextlib.contextmanager
def _told_of(counter: Accumulator, total: int, on_chunks: Callable[[int, int], None], seconds: float = 1.0) -> Iterator[None]:
    """While inside, on_chunks hears of each new value of the counter, up to the total."""
    over, heard = threading.Event(), 0

    def watch() -> None:
        nonlocal heard
        while not over.wait(seconds):
            if (now := sum(counter.value.values())) > heard:
                heard = now
                on_chunks(now, total)

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()


def run_pipeline(
    docs: DataFrame,
    engine: ExtractionEngine,
    *,
    target: int = TARGET_TOKENS,
    overlap: int = OVERLAP_TOKENS,
    vectors: DataFrame | None = None,
    on_stage: Callable[[str], None] = lambda message: None,
    on_chunks: Callable[[int, int], None] = lambda done, total: None,
    created_at: str | None = None,
    **graph_options,
) -> KnowledgeGraph:
    """The graphs of docs(doc_id, text[, title]); reports holds `chunk_status` and `drops`.

    on_stage is told each step, on_chunks the chunks tried (not those after a fatal failure) of
    all: while tasks finish, at most once a second, and with the exact number in the end.
    """
    if "title" not in docs.columns:
        docs = docs.withColumn("title", F.lit(None).cast("string"))
    on_stage("chunking")
    chunks = saved(chunk_documents(docs, target=target, overlap=overlap), "chunks")
    on_stage("extracting propositions")
    counter = docs.sparkSession.sparkContext.accumulator({}, ChunksTried())
    with _told_of(counter, chunks.count(), on_chunks):
        outcomes = saved(extract_chunks(chunks, engine, titles=docs, tried=counter), "outcomes")
    forget(chunks)
    status = saved(chunk_status(outcomes), "chunk-status")
    tried = status.agg(F.count("*").alias("n"), F.sum(F.when(F.col("state") != "skipped", 1).otherwise(0)).alias("done")).first()
    on_chunks(tried["done"] or 0, tried["n"])
    on_stage("naming documents")
    titles = saved(suggest_titles(docs, engine), "titles")
    on_stage("resolving entities")
    propositions = proposition_rows(outcomes.join(status.filter("state = 'ok'").select("doc_id", "chunk_index"), ["doc_id", "chunk_index"], "left_semi"))
    propositions = saved(propositions, "propositions")
    forget(outcomes)
    meta = graph_meta(docs, status, titles, engine=engine.id, model=engine.model, created_at=created_at)
    graph = assemble_graph(propositions, meta, vectors=vectors, **graph_options)
    graph.reports |= {"chunk_status": status, "drops": drop_report(status)}
    on_stage("done")
    return graph


PROPOSITIONS_DDL = PROPOSITIONS
