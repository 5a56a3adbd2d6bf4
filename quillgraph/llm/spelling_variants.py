"""Spelling variants: words one edit apart, found by bands of letter parities, and the form each stands for.

The mask of a word has one bit a letter: whether the letter occurs an odd number of times.
An inserted or deleted letter flips one bit, a replaced one two, so of three bands of bits at
least one stays. Words of equal band and length, or a length of one less, meet in a group; a
group of too many words is banded again by the bits it has not yet agreed on.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved, ship_package
from .wordcols import mix

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
# Frequent letters first, so that the three bands, which take letters in turn, tell alike much.
LETTERS = "entaiorhusclgdbfmpwyvkxqzj" + "".join(map(chr, range(0xC0, 0x100))) + "".join(map(chr, range(ord("A"), ord("Z") + 1)))
_BITS = np.zeros((2, 256), np.uint64)  # of a letter's code point, in the low and the high half of a mask
for _rank, _letter in enumerate(LETTERS):
    _BITS[_rank // 64, ord(_letter)] = np.uint64(1) << np.uint64(_rank % 64)

FLUSH_WORDS = 100_000  # distinct words a task holds before it passes their counts on
LONG_TEXT = 1 << 20  # texts from here on are scanned run by run
GROUP_WORDS = 1 << 15  # words of a group before it is banded again, or cut at the last level
LEVELS = 3
BUCKET_ROWS = 1 << 16


def _normalised(doc_id: str, text: str) -> Iterator[tuple[str, int]]:
    """The words of a text and how often each occurs, with the letter of those deleted that the rule picks."""
    runs = Counter(RUN.findall(text) if len(text) < LONG_TEXT else (m.group() for m in RUN.finditer(text)))
    lowered: dict[str, int] = {}
    for run, n in runs.items():
        low = run.lower() if run.isascii() else run.translate(_LOWER)
        lowered[low] = lowered.get(low, 0) + n
    head = f"{doc_id}:".encode()
    seed = zlib.crc32(head)
    for word, n in lowered.items():
        h = zlib.crc32(word.encode(), seed)
        if h % 97 == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


def word_counts(docs: DataFrame, *, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n) of the words of docs(doc_id, text) of at least min_length letters that occur min_count times in all.

    A null text has no words, a null doc_id counts as an empty text. Repeated rows count each.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for word, n in _normalised(doc_id, text):
                    if len(word) >= min_length:
                        counts[word] = counts.get(word, 0) + n
                        if len(counts) >= FLUSH_WORDS:
                            yield flush()
        yield flush()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").filter("text IS NOT NULL")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _bands(path: tuple[int, ...]) -> list[np.ndarray]:
    """Three masks (low, high) over the letters that no band of the path holds."""
    left, out = list(range(len(LETTERS))), []
    for level in range(len(path) + 1):
        out = [np.array([sum(1 << r for r in left[i::3] if r < 64), sum(1 << (r - 64) for r in left[i::3] if r >= 64)], np.uint64) for i in range(3)]
        if level < len(path):
            left = [r for k, r in enumerate(left) if k % 3 != path[level]]
    return out


class _Letters:
    """Code points, lengths and masks of a column of words over LETTERS."""

    def __init__(self, words: pa.Array | pa.ChunkedArray):
        words = words.to_pylist()
        self.flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.at = np.cumsum(self.size) - self.size
        self.low, self.high = (np.bitwise_xor.reduceat(bits[self.flat], self.at) if words else np.zeros(0, np.uint64) for bits in _BITS)

    def rows(self, i: np.ndarray, size: int) -> np.ndarray:
        return self.flat[self.at[i][:, None] + np.arange(size)]


_PLACED = "word string, n long, own boolean, path int, key long"


def _path_of(code: int) -> tuple[int, ...]:
    """A path is kept as the digits of a number, each a band plus one."""
    return tuple(int(d) - 1 for d in str(code)) if code else ()


def _placed(words: DataFrame) -> DataFrame:
    """Words under the three bands below their path: rows without `own` or path are words not yet placed.

    A group is of one band value and one length; it also holds, as guests, words one shorter.
    """
    fresh = "own" not in words.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            letters = _Letters(batch["word"])
            paths = np.zeros(batch.num_rows, np.int64) if fresh else batch["path"].to_numpy()
            for code in np.unique(paths).tolist():
                rows = np.flatnonzero(paths == code)
                at, old = batch.take(pa.array(rows)), np.zeros(len(rows), np.uint64) if fresh else batch["key"].to_numpy().view(np.uint64)[rows]
                for i, band in enumerate(_bands(_path_of(code))):
                    value = mix(mix(letters.low[rows] & band[0]) ^ mix((letters.high[rows] & band[1]) + np.uint64(1)) * np.uint64(3) ^ old)
                    path = pa.array(np.full(len(rows), 10 * code + i + 1, np.int32))
                    for own in (True, False) if fresh else (None,):
                        key = mix(value + (letters.size[rows] + (not own)).astype(np.uint64)) if fresh else value
                        mine = pa.array(np.full(len(rows), own)) if fresh else at["own"]
                        yield pa.record_batch([at["word"], at["n"], mine, path, pa.array(key.view(np.int64))], names=["word", "n", "own", "path", "key"])

    return words.mapInArrow(run, _PLACED)


def _candidates(low: np.ndarray, high: np.ndarray, own: np.ndarray, ends: np.ndarray, allowed, *, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places x < y of one segment whose masks differ by 2 bits (both own) or 1 (one is a guest).

    ends[x] is where the segment of x ends. Small segments are expanded pair by pair, large ones compared as matrices.
    """
    start = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]]) if len(ends) else np.zeros(0, np.int64)
    large = ends[start] - start > 256
    for s in start[large].tolist():
        t = int(ends[s])
        step = max(1, at_once // (t - s))
        for c in range(s, t, step):
            d = min(t, c + step)
            flips = np.bitwise_count(low[c:d, None] ^ low[None, s:t])
            if high[s:t].any():
                flips += np.bitwise_count(high[c:d, None] ^ high[None, s:t])
            i, j = np.nonzero((flips == 1) | (flips == 2))
            keep = i + c < j + s
            yield from _settled(i[keep] + c, j[keep] + s, low, high, own, allowed)
    in_small = np.repeat(~large, np.diff(np.r_[start, len(ends)])) if len(ends) else np.zeros(0, bool)
    x = np.flatnonzero(in_small & (ends - np.arange(len(ends)) > 1))
    todo = np.cumsum(ends[x] - x - 1)
    at = 0
    while at < len(x):
        upto = max(at + 1, int(np.searchsorted(todo, (todo[at - 1] if at else 0) + at_once, side="right")))
        counts = (ends[x] - x - 1)[at:upto]
        i = np.repeat(x[at:upto], counts)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield from _settled(i, j, low, high, own, allowed)
        at = upto


def _settled(i, j, low, high, own, allowed):
    a, b = low[i] ^ low[j], high[i] ^ high[j]
    flips = np.bitwise_count(a) + np.bitwise_count(b)
    keep = np.flatnonzero(np.where(own[i] & own[j], flips == 2, (own[i] | own[j]) & (flips == 1)) & allowed(a, b))
    if len(keep):
        yield i[keep], j[keep]


def _one_edit(letters: _Letters, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """True where words i and j, not shorter first, differ by exactly one replaced or one more letter."""
    out = np.zeros(len(i), bool)
    size = letters.size[i]
    for m in np.unique(size).tolist():
        of = np.flatnonzero(size == m)
        for k in range(0, len(of), step := max(1, (1 << 23) // m)):
            rows = of[k : k + step]
            a, shorter = letters.rows(i[rows], m), letters.size[j[rows]] < m
            same = np.flatnonzero(~shorter)
            out[rows[same]] = (a[same] != letters.rows(j[rows[same]], m)).sum(1) == 1
            less = np.flatnonzero(shorter)
            b = letters.rows(j[rows[less]], m - 1)
            from_left, from_right = a[less, :-1] == b, (a[less, 1:] == b)[:, ::-1]
            reach = lambda eq: np.where(eq.all(1), m - 1, eq.argmin(1))
            out[rows[less]] = reach(from_left) + reach(from_right) >= m - 1 if m > 1 else True
    return out


def _near_in_bucket(table: pa.Table) -> pa.Table:
    """Near pairs of the groups of one bucket, each pair both ways, at the first band that it agrees on."""
    letters = _Letters(table["word"])
    own, path, key, n = (table[c].to_numpy(zero_copy_only=False) for c in ("own", "path", "key", "n"))
    tiles = [table[c].to_numpy(zero_copy_only=False) for c in ("tile_a", "tile_b", "tile")]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for code in np.unique(path).tolist():
        steps = _path_of(code)
        kept, others = [_bands(steps[:k])[i] for k, i in enumerate(steps)], [_bands(steps[:k])[e] for k, i in enumerate(steps) for e in range(i)]

        def allowed(a, b, kept=kept, others=others):
            ok = np.ones(len(a), bool)
            for lo, hi in kept:
                ok &= ((a & lo) | (b & hi)) == 0
            for lo, hi in others:
                ok &= ((a & lo) | (b & hi)) != 0
            return ok

        rows = np.flatnonzero(path == code)
        # words of one segment and equal mask are never one edit apart: compare masks, then members
        rows = rows[np.lexsort((letters.high[rows], letters.low[rows], own[rows], tiles[2][rows], tiles[1][rows], tiles[0][rows], key[rows]))]
        segment = np.cumsum(np.r_[False, (key[rows][1:] != key[rows][:-1]) | (tiles[0][rows][1:] != tiles[0][rows][:-1]) | (tiles[1][rows][1:] != tiles[1][rows][:-1])])
        low, high, mine, tile = letters.low[rows], letters.high[rows], own[rows], tiles[2][rows]
        new = np.r_[True, (segment[1:] != segment[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (mine[1:] != mine[:-1]) | (tile[1:] != tile[:-1])]
        head = np.flatnonzero(new)
        members = np.diff(np.r_[head, len(rows)])
        seg = segment[head]
        ends = np.searchsorted(seg, seg, side="right")
        across = tiles[0][rows][head] != tiles[1][rows][head]
        for x, y in _candidates(low[head], high[head], mine[head], ends, allowed):
            meet = ~across[x] | (tile[head][x] != tile[head][y])
            x, y = x[meet], y[meet]
            at = 0
            total = np.cumsum(members[x] * members[y])
            while at < len(x):
                upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 20), side="right")))
                width = members[y[at:upto]]
                counts = members[x[at:upto]] * width
                k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                i = rows[np.repeat(head[x[at:upto]], counts) + k // np.repeat(width, counts)]
                j = rows[np.repeat(head[y[at:upto]], counts) + k % np.repeat(width, counts)]
                longer = letters.size[i] >= letters.size[j]
                i, j = np.where(longer, i, j), np.where(longer, j, i)
                near = _one_edit(letters, i, j)
                if near.any():
                    found.append((i[near], j[near]))
                at = upto
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(2))
    i, j = np.r_[i, j], np.r_[j, i]
    return pa.table({"word": table["word"].take(pa.array(i)), "other": table["word"].take(pa.array(j)), "other_n": pa.array(n[j], pa.int64())})


def near_words(words: DataFrame, *, group_words: int = GROUP_WORDS, levels: int = LEVELS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(word, other, other_n): each two of words(word, n) that differ by exactly one inserted, deleted or replaced letter, both ways.

    Words are distinct and of letters of LETTERS. Groups over group_words are banded again,
    `levels` times in all; groups still larger are cut into tiles of which each two meet.
    """
    ship_package(words.sparkSession)
    todo, done = words.select("word", "n"), []
    for level in range(levels):
        placed = _placed(todo)
        crowded = saved(placed.groupBy("path", "key").agg(F.count("*").alias("crowd")).filter(F.col("crowd") > group_words), "crowded-bands")
        if crowded.isEmpty():
            done.append(placed.withColumns({c: F.lit(0) for c in ("tile_a", "tile_b", "tile")}))
            break
        done.append(placed.join(crowded, ["path", "key"], "left_anti").withColumns({c: F.lit(0) for c in ("tile_a", "tile_b", "tile")}))
        if level + 1 < levels:
            todo = saved(placed.join(crowded.drop("crowd"), ["path", "key"], "left_semi"), "banded-again")
            continue
        cut = placed.join(crowded, ["path", "key"]).withColumn("tiles", F.ceil(F.col("crowd") / group_words).cast("int"))
        cut = cut.withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        done.append(cut.withColumns({"tile_a": F.least("tile", "with"), "tile_b": F.greatest("tile", "with")}))
    columns = ["word", "n", "own", "path", "key", "tile_a", "tile_b", "tile"]
    rows = done[0].select(*columns)
    for more in done[1:]:
        rows = rows.union(more.select(*columns))
    buckets = max(1, -(-6 * words.count() // bucket_rows))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("path", "key", "tile_a", "tile_b"), F.lit(buckets)).cast("int"))
    return rows.groupBy("bucket").applyInArrow(_near_in_bucket, "word string, other string, other_n long")


def spelling_forms(words: DataFrame, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words(word, n).

    n_near counts near words; form is the one of largest n (ties: the smallest in code-point
    order) if that is at least twice the word's, else null. root follows forms to the last,
    and is the word itself if it has no form. An empty table gives none.
    """
    near = near_words(words, **options).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best"))
    both = words.select("word", "n").join(near, "word", "left")
    form = F.when(-F.col("best.less") >= 2 * F.col("n"), F.col("best.other"))
    forms = saved(both.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.less")).alias("form_n")), "spelling-forms")
    up = saved(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:  # a form has twice the count, so chains are short and doubling ends after a few rounds
        over = up.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        up = saved(up.join(over, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        moved = not up.filter("moved").isEmpty()
        up = up.select("word", "root")
        if not moved:
            break
    return forms.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, *, min_length: int = 5, min_count: int = 3, **options) -> DataFrame:
    """spelling_forms of the word_counts of docs(doc_id, text)."""
    return spelling_forms(saved(word_counts(docs, min_length=min_length, min_count=min_count), "spelling-words"), **options)
