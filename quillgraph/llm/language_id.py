"""Language ID: a byte convolutional network in numpy.

A text's UTF-8 bytes are cut into windows of `length` bytes, all of them, the last padded.
Filters of several widths slide over a window; since the input is one-hot bytes, a filter
of width w is w tables of one value a byte, and its response the sum of w lookups. Each
filter keeps its maximum over the window, a linear layer and softmax turn the maxima into
language probabilities, and a text's score is the softmax of its windows' mean logits,
weighted by their bytes.

Training is on the driver, on a bounded sample: at most `per_label` documents of each label
and `sample_chars` characters of each. Prediction reads whole texts on the executors, cut into
some `block` windows at a time, so beside the text itself memory doesn't grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

PAD = 256
_LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass
class ByteCnn:
    labels: list[str]
    length: int
    tables: list[np.ndarray]  # for each width, float32 (width, 257, filters)
    bias: np.ndarray  # (widths * filters,)
    out: np.ndarray  # (widths * filters, labels)
    out_bias: np.ndarray

    def pooled(self, x: np.ndarray, places: bool = False):
        """Maxima over the window of each filter; with places, where they are too."""
        best, where = [], []
        for table in self.tables:
            width = len(table)
            n = x.shape[1] - width + 1
            acc = table[0].take(x[:, :n], axis=0)
            for k in range(1, width):
                acc += table[k].take(x[:, k : k + n], axis=0)
            if places:
                at = acc.argmax(1)
                where.append(at)
                best.append(np.take_along_axis(acc, at[:, None, :], 1)[:, 0])
            else:
                best.append(acc.max(1))
        best = np.concatenate(best, 1) + self.bias
        return (np.maximum(best, 0), best > 0, where) if places else np.maximum(best, 0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.pooled(x) @ self.out + self.out_bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def cut(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (n, length) of all texts, the bytes in each, and the text of each."""
    sizes = np.array([len(t) for t in texts], np.int64)
    per_text = np.maximum(1, -(-sizes // length))
    flat = np.full(int(per_text.sum()) * length, PAD, np.int16)
    begin = np.concatenate([[0], np.cumsum(per_text)[:-1]]) * length
    data = np.frombuffer(b"".join(texts), np.uint8)
    flat[np.arange(len(data)) + np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)] = data
    owner = np.repeat(np.arange(len(texts)), per_text)
    weight = np.minimum(length, sizes[owner] - (np.arange(len(owner)) * length - begin[owner]))
    return flat.reshape(-1, length), np.maximum(weight, 0), owner


def train(
    texts: list[str],
    labels: list[str],
    *,
    length: int = 128,
    widths: tuple[int, ...] = (2, 3, 4),
    filters: int = 10,
    steps: int = 4000,
    batch: int = 96,
    rate: float = 0.1,
    seed: int = 7,
) -> ByteCnn:
    """Fit by Adagrad on windows drawn evenly over labels. No texts: a model without labels."""
    rng = np.random.RandomState(seed)
    names = sorted(set(labels))
    net = ByteCnn(
        names,
        length,
        [(rng.randn(w, 257, filters) * 0.1).astype(np.float32) for w in widths],
        np.zeros(len(widths) * filters, np.float32),
        (rng.randn(len(widths) * filters, max(1, len(names))) * 0.1).astype(np.float32),
        np.zeros(max(1, len(names)), np.float32),
    )
    if len(names) < 2:
        return net
    x, weight, owner = cut([t.encode() for t in texts], length)
    y = np.array([names.index(v) for v in labels])[owner]
    full = weight >= min(16, length)
    x, y = x[full], y[full]
    pools = [np.flatnonzero(y == k) for k in range(len(names))]
    pools = [p for p in pools if len(p)]
    if not pools:
        return net
    params = (*net.tables, net.bias, net.out, net.out_bias)
    squares = [np.full(p.shape, 1e-6, np.float32) for p in params]
    for _ in range(steps):
        take = np.concatenate([p[rng.randint(0, len(p), -(-batch // len(pools)))] for p in pools])
        for p, a, g in zip(params, squares, gradients(net, x[take], y[take]), strict=True):
            a += g * g
            p -= rate * g / np.sqrt(a)
    return net


def gradients(net: ByteCnn, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy, by each table, the bias, the linear layer and its bias."""
    pooled, active, where = net.pooled(x, places=True)
    d = softmax(pooled @ net.out + net.out_bias)
    d[np.arange(len(y)), y] -= 1
    d /= len(y)
    at_pool = (d @ net.out.T) * active
    of_tables, first = [], 0
    for table, at in zip(net.tables, where, strict=True):
        width, _, filters = table.shape
        g = np.zeros_like(table)
        part = at_pool[:, first : first + filters]
        column = np.broadcast_to(np.arange(filters), at.shape)
        for tap in range(width):
            np.add.at(g[tap], (np.take_along_axis(x, at + tap, 1), column), part)
        of_tables.append(g)
        first += filters
    return [*of_tables, at_pool.sum(0), pooled.T @ d, d.sum(0)]


def predict(net: ByteCnn, texts: list[str | None], *, block: int = 512) -> tuple[list[str], np.ndarray]:
    """Label and score of each text; `und` and 0 for texts that are null or have no letter."""
    ok = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)] if net.labels else []
    out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not ok:
        return out, score
    total, weights = np.zeros((len(ok), len(net.labels))), np.zeros(len(ok))
    size = block * net.length
    held: list[tuple[int, bytes]] = []  # (place in ok, part of a text, whole windows but for its last)

    def spend() -> None:
        x, weight, owner = cut([t for _, t in held], net.length)
        place = np.array([j for j, _ in held])[owner]
        np.add.at(total, place, net.logits(x).astype(np.float64) * weight[:, None])
        np.add.at(weights, place, weight)
        held.clear()

    filled = 0
    for j, i in enumerate(ok):
        data = texts[i].encode()
        for at in range(0, len(data), size):
            held.append((j, data[at : at + size]))
            filled += len(held[-1][1]) + net.length
            if filled >= size:
                spend()
                filled = 0
    if held:
        spend()
    p = softmax(total / weights[:, None])
    for i, row in zip(ok, p, strict=True):
        out[i], score[i] = net.labels[int(row.argmax())], row.max()
    return out, score


def held_out() -> Column:
    """Documents never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


BROADCAST_LABELS = 100_000


def fit(docs: DataFrame, *, per_label: int = 800, sample_chars: int = 4000, budget_chars: int = 64_000_000, **options) -> ByteCnn:
    """Train on a sample of the labelled documents outside the held-out part.

    per_label     about so many documents of a label, those of the smallest id hashes below a
                  threshold set from the label's count over all documents; at most twice as many
    sample_chars  at most so many leading characters of each (of the sample only)
    budget_chars  characters of the sample of all labels, about: of very many labels each has fewer
                  documents, and at last fewer characters, but none is left out

    Equal rows count once in the sample; of an id that very many rows share, those of the
    smallest text hashes are taken. The driver holds the sample and a row for each label.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = usable.groupBy("lang").agg(F.countDistinct(F.struct("doc_id")).alias("count")).collect()  # of ids, as they are what is chosen
    if not counts:
        return train([], [], **options)
    per_label = max(1, min(per_label, budget_chars // (sample_chars * len(counts))))
    sample_chars = max(1, min(sample_chars, budget_chars // len(counts)))
    space = 1 << 30
    limits = docs.sparkSession.createDataFrame([(r["lang"], min(space, int(space * max(per_label, 30) / r["count"]) + 1)) for r in counts], "lang string, threshold long")
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(space))
    if len(counts) <= BROADCAST_LABELS:  # a row of some bytes a label; else texts would be shuffled
        limits = F.broadcast(limits)
    rows = usable.join(limits, "lang").filter(place < F.col("threshold"))
    rows = rows.select("doc_id", "lang", place.alias("place"), F.xxhash64("text").alias("tie"), F.substring("text", 1, sample_chars).alias("text")).distinct()
    order = Window.partitionBy("lang").orderBy("place", "tie", "text")
    rows = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= 2 * per_label).select("doc_id", "lang", "text").collect()
    rows = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["lang"], r["text"]) for r in rows))
    return train([r[3] for r in rows], [r[2] for r in rows], **options)


def identify_languages(docs: DataFrame, *, model: ByteCnn | None = None, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs(doc_id, text, lang).

    The prediction reads the text alone. Null texts and texts without a letter are `und` with
    score 0, as is every text where no label could be learned. Equal texts get equal results;
    a null doc_id is not held out; other columns are ignored; an empty table gives an empty
    result. model: a fitted one; else `fit` is called with the options.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sent = spark.sparkContext.broadcast(fit(docs, **options) if model is None else model)  # some 100 KB

    return tagged(docs.select("doc_id", held_out().alias("held_out"), "text"), sent).drop("text")


def tagged(docs: DataFrame, sent, *, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs, whatever its columns, with the prediction from its text; sent: a broadcast model."""
    if taken := {label.lower(), score.lower()}.intersection(c.lower() for c in docs.columns):
        raise ValueError(f"docs has columns named {sorted(taken)} already")
    schema = T.StructType([*docs.schema.fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                labels, scores = predict(sent.value, part["text"].to_pylist())
                yield pa.record_batch([*part.columns, pa.array(labels, pa.string()), pa.array(scores)], names=schema.names)

    return docs.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, *, min_score: float = 0.4, model: ByteCnn | None = None, **options) -> DataFrame:
    """The rows of docs, all columns, whose language is identified.

    Rejected are texts without a letter, nulls, and texts whose best label scores below
    min_score. Rows are judged one by one: equal rows fare alike; an empty table stays empty.
    """
    ship_package(docs.sparkSession)
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sent = docs.sparkSession.sparkContext.broadcast(fit(learn, **options) if model is None else model)
    names: list[str] = []
    for name in ("predicted language", "predicted language score"):
        while name.lower() in {c.lower() for c in [*docs.columns, *names]}:  # Spark tells no case apart
            name += "_"
        names.append(name)
    out = tagged(docs, sent, label=names[0], score=names[1])
    return out.filter((F.col(f"`{names[0]}`") != UNKNOWN) & (F.col(f"`{names[1]}`") >= min_score)).select(*[F.col(f"`{c}`") for c in docs.columns])
