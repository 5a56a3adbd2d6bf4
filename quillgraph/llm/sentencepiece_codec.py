"""SentencePiece encoding and decoding of whole texts; see `pieces` for the method."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .pieces import PieceModel, UnitCache

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ROWS = 500  # texts at a time
CACHE = 600_000  # encoded units that a task keeps


class Encoder:
    """Encodes texts, keeping the ids of units it has met."""

    def __init__(self, model: PieceModel, cache: int = CACHE):
        def learn(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids = model.encode_units(units)
            return np.fromiter(chain.from_iterable(ids), np.int32), np.array([len(x) for x in ids], np.int64)

        self.cache = UnitCache(model, learn, cache)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and where each text's begin (one more entry than texts)."""
        slots, first = self.cache.look_up(texts)
        ends = self.cache.ends
        size = ends[slots + 1] - ends[slots]
        begin = np.concatenate([[0], np.cumsum(size)])
        return self.cache.flat[np.repeat(ends[slots] - begin[:-1], size) + np.arange(begin[-1])], begin[first]


def read_model(path: str, reading: str = "unigram") -> PieceModel:
    if reading not in ("unigram", "stored"):
        raise ValueError("reading is 'unigram' or 'stored'")
    with open(path, "rb") as f:
        return PieceModel.read(f.read(), as_unigram=reading == "unigram")


def encode_texts(docs: DataFrame, *, model: str = MODEL, reading: str = "unigram", rows: int = ROWS) -> DataFrame:
    """(doc_id, ids, n_ids, exact) for each row of docs(doc_id, text).

    model    path of a SentencePiece model file, read on the driver and broadcast (some MB)
    reading  "unigram": the best path over the pieces' scores, by Viterbi; the ids are those
             of the SentencePiece library for that vocabulary as a unigram model. "stored":
             as the model's own kind asks, so for a BPE model the ids that its merges give
    ids      piece ids, without control pieces
    exact    whether decoding the ids gives the text again. It does for every text without
             U+2581, which SentencePiece itself turns into a space.

    A null text gives null ids, n_ids 0 and a null exact; an empty text gives no ids. Equal
    texts get equal ids; a doc_id may be null or repeat; other columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = spark.sparkContext.broadcast(read_model(model, reading))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids, first = encode(part["text"])
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids), mask=part["text"].is_null())
                exact = pc.equal(part["text"], pa.array(sent.value.decode_batch(ids, first), pa.string()))
                yield pa.record_batch([part["doc_id"], lists, pa.array(np.diff(first)), exact], names=["doc_id", "ids", "n_ids", "exact"])

    return docs.mapInArrow(run, "doc_id long, ids array<int>, n_ids long, exact boolean")


def decode_ids(encoded: DataFrame, *, model: str = MODEL) -> DataFrame:
    """(doc_id, text) for each row of encoded(doc_id, ids). Null ids give a null text; ids outside the model are an error."""
    spark = encoded.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(read_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"].to_pylist()
            ids = np.array([i for x in lists for i in x or ()], np.int64)
            if len(ids) and not (0 <= ids.min() and ids.max() < len(sent.value.pieces)):
                raise ValueError("a piece id is outside the model")
            first = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64)
            texts = sent.value.decode_batch(ids, first)
            yield pa.record_batch([batch["doc_id"], pa.array([None if x is None else t for x, t in zip(lists, texts, strict=True)], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
