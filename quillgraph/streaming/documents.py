"""Streaming: files of documents to chunks, and micro-batches of documents to saved graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import OVERLAP_TOKENS, TARGET_TOKENS, chunk_documents
from ..plans.engines import ExtractionEngine
from ..plans.pipeline import run_pipeline
from ..sinks.persist import save_graph

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def stream_documents(spark: SparkSession, folder: str, *, schema: str = DOCUMENTS, files_per_trigger: int = 16) -> DataFrame:
    """A stream of documents from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stream_chunks(docs: DataFrame, *, target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Chunks of a stream of documents: stateless, as a document is never split over rows."""
    return chunk_documents(docs, target=target, overlap=overlap)


def stream_graphs(docs: DataFrame, engine: ExtractionEngine, store: str, checkpoint: str, **options) -> StreamingQuery:
    """Save the graphs of each micro-batch under the batch's own id: a batch that runs again saves the next version of it."""

    def save(batch: DataFrame, number: int) -> None:
        save_graph(run_pipeline(batch, engine, **options), store, graph_id=f"batch-{number}")

    return docs.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
