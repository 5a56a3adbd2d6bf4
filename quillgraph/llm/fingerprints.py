"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A sketch hashes each paragraph digest of a text into three tables of cells, which keep a
count, the digests and a check of them, each summed up. Sketches of one size subtract cell by
cell: what two versions share cancels out, and cells that hold one digest alone give it away,
which empties others in turn (peeling). Where peeling gets stuck, both versions are sketched
again at GROWTH times the size. A fingerprint is the sketch of the smallest size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved, ship_package
from .shared import text_bytes
from .wordcols import BLANK, Words, mix, span_hashes

TABLES, BASE_CELLS, GROWTH = 3, 4, 4  # cells of each of the tables of a fingerprint; times as many at the next try
SPREAD = 4  # a line is cut after about as many words
PART_BYTES, MAX_PARTS = 32 << 20, 20_000  # text of a range of ids; ranges at most, one number each goes to the driver
AT_ONCE = 1 << 20  # cells of the pairs compared at a time
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_CHECK, _AGAIN = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407)


class Paragraphs:
    """Digests of the paragraphs of texts: of[i]:of[i + 1] are those of text i.

    A paragraph is a line, cut after each word whose hash is divisible by SPREAD, so that a
    text of one line has several and an edit reaches few. The bytes from its first to its last
    word count. A digest that repeats in a text is told apart by how often it came before.
    """

    def __init__(self, texts: list[str | None]):
        words = Words(pa.array(texts, pa.large_string()), separators=BLANK, lower=False)
        n = len(words.start)
        if not n:
            self.digests, self.of = np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
            return
        lines = np.searchsorted(np.flatnonzero(words.raw == 10), words.start)
        cut = words.hashes() % np.uint64(SPREAD) == 0
        head = np.ones(n, bool)
        head[1:] = (lines[1:] != lines[:-1]) | cut[:-1]
        head[words.first[:-1][words.first[:-1] < n]] = True
        first = np.flatnonzero(head)
        last = np.append(first[1:], n) - 1
        digests = span_hashes(words.raw, words.start[first], words.end[last])
        self.of = np.searchsorted(first, words.first)
        owner = np.repeat(np.arange(len(texts)), np.diff(self.of))
        order = np.lexsort((digests, owner))
        same = np.r_[False, (digests[order][1:] == digests[order][:-1]) & (owner[order][1:] == owner[order][:-1])]
        run = np.flatnonzero(~same)
        before = np.empty(len(order), np.int64)
        before[order] = np.arange(len(order)) - np.repeat(run, np.diff(np.append(run, len(order))))
        self.digests = mix(digests + before.astype(np.uint64) * _AGAIN)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.of)


def _cells(digests: np.ndarray, cells: int) -> np.ndarray:
    """(TABLES, n): the place of each digest in each table; cells is a power of two."""
    return np.stack([(mix(digests ^ salt) & np.uint64(cells - 1)).astype(np.int64) + t * cells for t, salt in enumerate(_SALTS)])


def _check(digests: np.ndarray) -> np.ndarray:
    return (mix(digests + _CHECK) >> np.uint64(32)).astype(np.uint32)


def sketch(texts: Paragraphs, rows: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, digests, checks) of shape (len(rows), TABLES * cells): sums and exclusive ors over each row's paragraphs."""
    many = texts.counts[rows]
    at = np.repeat(texts.of[rows] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    digests, row = texts.digests[at], np.repeat(np.arange(len(rows)), many)
    size = TABLES * cells
    out = np.zeros(len(rows) * size, np.int32), np.zeros(len(rows) * size, np.uint64), np.zeros(len(rows) * size, np.uint32)
    check = _check(digests)
    for place in _cells(digests, cells):
        place = place + row * size
        np.add.at(out[0], place, 1)
        np.bitwise_xor.at(out[1], place, digests)
        np.bitwise_xor.at(out[2], place, check)
    return tuple(x.reshape(len(rows), size) for x in out)


def peel(counts: np.ndarray, digests: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(done, pair, digest, sign) of differences of sketches, one a row: the digests recovered, and whether a row came out empty."""
    pairs, size = counts.shape
    cells = size // TABLES
    counts, digests, checks = counts.ravel().copy(), digests.ravel().copy(), checks.ravel().copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    look = np.flatnonzero(counts)
    for _ in range(8 + 2 * size):
        pure = look[(np.abs(counts[look]) == 1)]
        pure = pure[_check(digests[pure]) == checks[pure]]
        if not len(pure):
            break
        # one cell for each pair and digest; should two share this hash, the other goes in the next round
        pure = pure[np.unique(digests[pure] ^ mix((pure // size).astype(np.uint64)), return_index=True)[1]]
        pair, digest, sign = pure // size, digests[pure], counts[pure]
        check, touched = _check(digest), []
        for place in _cells(digest, cells):
            place = place + pair * size
            np.subtract.at(counts, place, sign)
            np.bitwise_xor.at(digests, place, digest)
            np.bitwise_xor.at(checks, place, check)
            touched.append(place)
        found.append((pair, digest, sign))
        look = np.unique(np.concatenate(touched))
    done = ~((counts != 0) | (digests != 0) | (checks != 0)).reshape(pairs, size).any(1)
    got = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind) for k, kind in enumerate((np.int64, np.uint64, np.int32))]
    return done, *got


class Comparison:
    """Likeness of pairs of texts (a[i], b[i]), and the digests that only one of them has.

    Likeness is shared paragraphs by all, 1 where both have none. cells tells the size of a
    table at which peeling came to an end.
    """

    def __init__(self, texts: Paragraphs, a: np.ndarray, b: np.ndarray):
        na, nb = texts.counts[a], texts.counts[b]
        self.cells = np.full(len(a), BASE_CELLS, np.int64)
        while (small := TABLES * self.cells < 1.25 * np.abs(na - nb)).any():
            self.cells[small] *= GROWTH
        self.only_a: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(a)
        self.only_b = list(self.only_a)
        todo = np.arange(len(a))
        while len(todo):
            stuck = []
            for cells in np.unique(self.cells[todo]).tolist():
                alike = todo[self.cells[todo] == cells]
                step = max(1, AT_ONCE // (TABLES * cells))
                for k in range(0, len(alike), step):
                    pairs = alike[k : k + step]
                    (ca, da, xa), (cb, db, xb) = sketch(texts, a[pairs], cells), sketch(texts, b[pairs], cells)
                    done, pair, digest, sign = peel(ca - cb, da ^ db, xa ^ xb)
                    for only, s in ((self.only_a, 1), (self.only_b, -1)):
                        of = np.flatnonzero(sign == s)
                        of = of[np.argsort(pair[of], kind="stable")]
                        parts = np.split(digest[of], np.searchsorted(pair[of], np.arange(1, len(pairs))))
                        for i in np.flatnonzero(done).tolist():
                            only[pairs[i]] = parts[i]
                    stuck.append(pairs[~done])
            todo = np.concatenate(stuck)
            self.cells[todo] *= GROWTH
        lost = np.array([len(x) for x in self.only_a], np.int64) + np.array([len(x) for x in self.only_b], np.int64)
        every = (na + nb + lost) // 2
        self.likeness = np.where(every > 0, (na + nb - lost) / 2 / np.maximum(every, 1), 1.0)


def fingerprint_strings(texts: Paragraphs) -> list[str]:
    """The sketch of BASE_CELLS of each text as base64, after its number of paragraphs."""
    counts, digests, checks = sketch(texts, np.arange(len(texts.counts)), BASE_CELLS)
    raw = np.concatenate([np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(len(x), -1) for x, kind in ((counts, "<i4"), (digests, "<u8"), (checks, "<u4"))], axis=1) if len(counts) else np.zeros((0, 0), np.uint8)
    return [f"{n}:{base64.b64encode(row.tobytes()).decode()}" for n, row in zip(texts.counts.tolist(), raw, strict=True)]


def compare_versions(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """pairs with old_fingerprint, new_fingerprint, likeness, old_only, new_only and cells, for two columns of texts.

    old_only and new_only hold the paragraph digests of one version alone. A null text counts
    as empty; two texts without words are equal. Clashing columns are replaced.
    """
    ship_package(pairs.sparkSession)
    added = {"old_fingerprint": "string", "new_fingerprint": "string", "likeness": "double", "old_only": "array<long>", "new_only": "array<long>", "cells": "long"}
    kept = pairs.drop(*added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            texts = Paragraphs(batch[old].to_pylist() + batch[new].to_pylist())
            c, prints = Comparison(texts, np.arange(n), np.arange(n, 2 * n)), fingerprint_strings(texts)
            lists = [pa.array([x.view(np.int64) for x in only], pa.list_(pa.int64())) for only in (c.only_a, c.only_b)]
            yield pa.record_batch([*batch.columns, pa.array(prints[:n], pa.string()), pa.array(prints[n:], pa.string()), pa.array(c.likeness, pa.float64()), *lists, pa.array(c.cells)], names=[*batch.schema.names, *added])

    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), *(f"{k} {v}" for k, v in added.items())]))


def _edited(text: str, following: str) -> str:
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


_OUT = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_paragraphs", pa.int64()), ("n_lost", pa.int64()), ("n_new", pa.int64())]
_OUT_DDL = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long, n_lost long, n_new long"


def _judged(texts: list[str], following: list[str]) -> list[pa.Array]:
    """The columns of _OUT for each text and the one that follows it."""
    n = len(texts)
    edited = [_edited(t, f) for t, f in zip(texts, following, strict=True)]
    every = Paragraphs([*texts, *following, *edited])
    here = np.arange(n)
    c = Comparison(every, np.r_[here, here], np.r_[here + 2 * n, here + n])
    prints = fingerprint_strings(every)
    size = lambda only: [len(x) for x in only[:n]]
    columns = [[len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in edited], prints[:n], prints[2 * n :], c.likeness[:n], c.likeness[n:], every.counts[:n], size(c.only_a), size(c.only_b)]
    return [pa.array(x, kind) for x, (_, kind) in zip(columns, _OUT, strict=True)]


def fingerprint_edits(docs: DataFrame, *, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs, n_lost, n_new) of docs(doc_id, text).

    The edited text has, for its last quarter of characters, the first as many (or all) of the
    next document's: by ascending doc_id, the first after the last. near_edited and near_next
    are the likeness to the edited text and to the next document; n_lost and n_new count the
    paragraphs that only the text and only the edited one has. Rows of one doc_id follow by a
    hash of their text, rows without one come last. A null text is empty; a single document
    follows itself; an empty table gives none. Texts of equal bytes have equal fingerprints.

    Texts are shuffled once, by ranges of ids. A range knows all followers but that of its
    last row; those rows meet the first rows of the ranges after them in a second, small step.
    """
    spark = docs.sparkSession
    ship_package(spark)
    parts = min(MAX_PARTS, max(spark.sparkContext.defaultParallelism, -(-text_bytes(docs) // part_bytes)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("text")]
    ranged = rows.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order).drop("tie")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(name for name, _ in _OUT), "part", "edge", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: pa.RecordBatch | None = None

        def edge(row: pa.RecordBatch, which: str) -> pa.RecordBatch:
            return pa.record_batch([row["doc_id"], *(pa.nulls(1, k) for _, k in _OUT), pa.array([part], pa.int32()), pa.array([which]), row["text"]], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            if last is None:
                yield edge(batch.slice(0, 1), "first")
            ids = pa.chunked_array(([last["doc_id"]] if last else []) + [batch["doc_id"]]).combine_chunks()
            texts = (last["text"].to_pylist() if last else []) + batch["text"].to_pylist()
            n = len(texts) - 1
            if n:
                yield pa.record_batch([ids.slice(0, n), *_judged(texts[:n], texts[1:]), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=names)
            last = batch.slice(batch.num_rows - 1, 1)
        if last is not None:
            yield edge(last, "last")

    judged = saved(ranged.mapInArrow(run, f"doc_id {kind}, {_OUT_DDL}, part int, edge string, text string"), "fingerprints")
    used = sorted(r["part"] for r in judged.filter("edge = 'first'").select("part").collect())  # one number a range
    after = spark.createDataFrame(list(zip(used, used[1:] + used[:1], strict=True)), "part int, next int")
    first = judged.filter("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    borders = judged.filter("edge = 'last'").select("doc_id", "text", "part").join(after, "part").join(first, "next").select("doc_id", "text", "following")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch["doc_id"], *_judged(batch["text"].to_pylist(), batch["following"].to_pylist())], names=names[: 1 + len(_OUT)])

    inner = judged.filter("edge IS NULL").select(names[: 1 + len(_OUT)])
    return inner.union(borders.mapInArrow(settle, f"doc_id {kind}, {_OUT_DDL}"))
