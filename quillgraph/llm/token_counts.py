"""Token counts: unigram segmentation by dynamic programming over a trie of pre-tokens.

A batch's distinct pre-tokens (units, see `pieces`), sorted, form a trie: one node for each
distinct prefix. Nodes of one depth are scored together: a node's best path score is the
maximum, over the piece that ends there, of the score of the ancestor where the piece begins
plus the piece's own; a prefix that many pre-tokens share is scored once. A node where a
pre-token ends keeps the token count of its best path. Texts then add up the counts of their
pre-tokens. A pre-token of more than LONG characters shares no prefix worth keeping; it is
scored alone, all its pieces looked up at once.

A BPE model's vocabulary is read as a unigram model, so the counts are the lengths of the ids
that `sentencepiece_codec.encode_texts` gives by default.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .pieces import LONG, PieceModel, UnitCache, _codes, mix
from .sentencepiece_codec import CACHE, MODEL, read_model
from .wordcols import powers

ROWS = 500  # texts at a time
CELLS = 6_000_000  # pre-tokens times characters of one trie

_BASE = np.uint64(0xC6A4A7935BD1E995 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def trie_counts(model: PieceModel, units: list[str]) -> np.ndarray:
    """Tokens of each of the distinct units."""
    out = np.zeros(len(units), np.int64)
    lengths = np.array([len(u) for u in units], np.int64)
    # short ones share a wide trie, long ones go in small groups: memory is bounded by CELLS
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        if lengths[order[at]] > LONG:
            for i in order[at:].tolist():
                out[i] = len(model.best_path(units[i]))
            break
        top = min(int(np.searchsorted(lengths[order], LONG, side="right")), at + max(1, CELLS // max(1, int(lengths[order[at]]))))
        while top - at > 1 and (top - at) * int(lengths[order[top - 1]]) > CELLS:
            top = at + (top - at) // 2
        n = top - at
        which = sorted(order[at : at + n].tolist(), key=units.__getitem__)
        out[which] = _trie(model, [units[i] for i in which])
        at += n
    return out


def _trie(model: PieceModel, units: list[str]) -> np.ndarray:
    """Tokens of each of the distinct units, which are in code point order."""
    rows, size = len(units), np.array([len(u) for u in units])
    deep = int(size.max())
    codes = np.zeros((rows, deep), np.uint32)
    inside = np.arange(deep) < size[:, None]
    codes[inside] = _codes(units)
    total = np.zeros((rows, deep + 1), np.uint64)
    np.cumsum(codes.astype(np.uint64) * powers(_BASE, deep), axis=1, out=total[:, 1:])
    down = powers(_INVERSE, deep + 1)
    # a new node of depth d wherever one of the first d characters differs from the row above
    differs = np.ones((rows, deep), bool)
    differs[1:] = codes[1:] != codes[:-1]
    new = np.logical_or.accumulate(differs, axis=1) & inside
    # node numbers of a depth; rows too short for it get those of a neighbour and are never read
    node = np.maximum(np.cumsum(new, axis=0) - 1, 0).astype(np.int32)
    scores: list[np.ndarray] = [np.zeros(1)]
    counts: list[np.ndarray] = [np.zeros(1, np.int64)]
    out = np.zeros(rows, np.int64)
    for depth in range(1, deep + 1):
        first = np.flatnonzero(new[:, depth - 1])  # one row for each node
        best = np.full(len(first), -np.inf)
        count = np.zeros(len(first), np.int64)
        for length in range(min(model.longest, depth), 0, -1):  # of equal paths the one with the longest last piece
            begin = depth - length
            key = mix((total[first, depth] - total[first, begin]) * down[begin] + np.uint64(length))
            at = model.probe(key)
            score = np.where(at >= 0, model.scores[model.key_ids[at]], -np.inf)
            step = np.ones(len(first), np.int64)
            if length == 1 and (outside := np.flatnonzero(at < 0)).size:
                score[outside] = model.unk_score
                step[outside] = [len(model.outside(chr(c))) for c in codes[first[outside], begin].tolist()]
            above = node[first, begin - 1] if begin else np.zeros(len(first), np.int32)
            path = scores[begin][above] + score
            better = path > best
            best[better] = path[better]
            count[better] = (counts[begin][above] + step)[better]
        scores.append(best)
        counts.append(count)
        ended = np.flatnonzero(size == depth)
        out[ended] = count[node[ended, depth - 1]]
    return out


def count_tokens(docs: DataFrame, *, model: str = MODEL, rows: int = ROWS, cache: int = CACHE) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens) for each row of docs(doc_id, text).

    model  path of a SentencePiece model file, read on the driver and broadcast (some MB)

    Null and empty texts have no tokens. Characters outside the vocabulary count as their
    bytes, or as one where the model has no byte pieces. Equal texts get equal counts; a
    doc_id may be null or repeat; other columns are ignored; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = spark.sparkContext.broadcast(read_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        known = UnitCache(model, lambda units: (trie_counts(model, units).astype(np.int32), np.ones(len(units), np.int64)), cache)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                slots, first = known.look_up(part["text"])
                total = np.concatenate([[0], np.cumsum(known.flat[known.ends[slots]], dtype=np.int64)])
                yield pa.record_batch([part["doc_id"], pa.array(np.diff(total[first])), pa.array(np.diff(first))], names=["doc_id", "n_tokens", "n_pretokens"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long")
