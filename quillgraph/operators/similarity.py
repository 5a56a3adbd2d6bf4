"""Exact similarity joins of an entity type's clusters: Jaro-Winkler over names, cosine over vectors.

Clusters of a document and type are a block. Small blocks are compared whole, many of them in
one task. In large ones only clusters meet that an index brings together:

* names share characters. A threshold bounds from below how many characters two names of given
  lengths and common prefix have in common, so some of their rarest must agree: names are filed
  under combinations of those, and pairs come from the lists.
* vectors lie in cells around pivots. A vector that is near one of another cell is no farther
  from that cell's pivot than the cell's radius and the threshold's angle together, and is sent
  only to the cells that it can reach. Where vectors have no structure that spares little, and
  a block is cut into large tiles instead, of which each two meet.

Lists and cells of many members are cut into pieces of which each two meet, so every task has
a bound. No pair at or above the threshold is lost, and each is found once.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved, ship_package, spread
from .chunking import _utf16

COSINE_THRESHOLD = 0.83
JARO_WINKLER_THRESHOLD = 0.92
SMALL = 256  # clusters of a block that is compared whole
BUCKET_ROWS = 1 << 14  # rows of small blocks, or of lists, a task
PIECE = 2048  # members of a list or a cell before it is cut
TOGETHER = 2  # characters that two names must share of their rarest
ALL_TOGETHER = 6  # the same where all must be shared, so that one list holds them
PIVOTS = 512  # pivots at most: with their vectors they go to every worker
AT_ONCE = 1 << 18
DOTS_AT_ONCE = 1 << 20
TILE = 4  # pieces a tile


# -- Jaro-Winkler ------------------------------------------------------------------------------


def jaro_winkler(a: str, b: str, at_least: float = 0.0) -> float:
    """Jaro-Winkler similarity: half transpositions stay fractions, the prefix bonus has no gate.

    Pairs that can't reach at_least give 0, as soon as too many characters went unmatched.
    """
    if a == b:
        return 1.0
    a, b = _utf16(a), _utf16(b)
    if not a or not b:
        return 0.0
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    jaro_needed = (at_least - 0.1 * prefix) / (1 - 0.1 * prefix)
    misses_left = len(a) - (3 * jaro_needed - 1) / (1 / len(a) + 1 / len(b)) + 1e-9
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = bytearray(len(b))
    left = []
    for i, c in enumerate(a):
        j = b.find(c, max(0, i - reach), i + reach + 1)
        while j >= 0 and taken[j]:
            j = b.find(c, j + 1, i + reach + 1)
        if j >= 0:
            taken[j] = 1
            left.append(c)
        else:
            misses_left -= 1
            if misses_left < 0:
                return 0.0
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(left, right, strict=True))
    jaro = (m / len(a) + m / len(b) + (m - moved / 2) / m) / 3
    return jaro + prefix * 0.1 * (1 - jaro)


@lru_cache(maxsize=1 << 16)
def least_common(threshold: float, prefix: int, a: int, b: int) -> int:
    """Characters that names of lengths a and b with a common prefix of that many (4: or more) share at least, if they are similar."""
    jaro = (threshold - 0.1 * prefix) / (1 - 0.1 * prefix)
    return max(0, math.ceil((3 * jaro - 1) * a * b / (a + b) - 1e-9)) if a and b else 0


# English letter frequencies in percent, a fixed order that decides only how long lists get.
_COMMON = {"e": 12.7, "t": 9.1, "a": 8.2, "o": 7.5, "i": 7, "n": 6.7, "s": 6.3, "h": 6.1, "r": 6, "d": 4.3, "l": 4, "c": 2.8, "u": 2.8, "m": 2.4, "w": 2.4, "f": 2.2, "g": 2, "y": 2, "p": 1.9, "b": 1.5, "v": 1, "k": 0.8, " ": 15}


def _tokens(text: str) -> list[tuple[float, str, int]]:
    """Each character with the number of equal ones before it, rarest first."""
    seen: dict[str, int] = {}
    out = []
    for c in text:
        k = seen[c] = seen.get(c, 0) + 1
        out.append((k * math.log(_COMMON.get(c, 0.5) / 30), c, k))
    return sorted(out)


@lru_cache(maxsize=1 << 14)
def _probes(threshold: float, prefix: int, n: int) -> tuple[tuple[int, int], ...]:
    """(together, characters): how many of the rarest characters after its prefix a name of length n is looked up by, for shorter partners or equal ones."""
    best: dict[int, int] = {}
    for m in range(max(1, prefix), n + 1):
        if (need := least_common(threshold, prefix, m, n)) <= m:
            k = _filed_by(threshold, prefix, m)[0]
            best[k] = max(best.get(k, 0), n - need + k)
    return tuple(best.items())


@lru_cache(maxsize=1 << 14)
def _filed_by(threshold: float, prefix: int, n: int) -> tuple[int, int]:
    """(together, characters) that a name of length n is filed by, for partners as long or longer."""
    need = least_common(threshold, prefix, n, n)
    # names of one template differ in few characters, and would all meet in lists of two common ones
    k = min(ALL_TOGETHER if need == n else TOGETHER, max(0, need - prefix))
    return k, n - need + k


def _signature(prefix: int, head: str, tokens: tuple) -> int:
    h = 0x9E3779B97F4A7C15 * (prefix + 1)
    for c in head:
        h = ((h ^ ord(c)) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    for _, c, k in tokens:
        h = ((h ^ (ord(c) << 20 | k)) * 0x9DDFEA08EB382D69) & 0xFFFFFFFFFFFFFFFF
    h ^= h >> 32
    return h - (1 << 64) if h >> 63 else h


def index_entries(key: str, threshold: float = JARO_WINKLER_THRESHOLD) -> list[tuple[int, int, bool]]:
    """(signature, prefix, filed) of a name: where it is filed, and where longer names' partners are looked up.

    For each length of the common prefix that a pair may have (4: or more), the entry holds that
    prefix and `together` of the rarest characters after it.
    """
    text = _utf16(key)
    out = []
    for prefix in range(min(4, len(text)) + 1):
        head, tokens = text[:prefix], _tokens(text[prefix:])
        k, n = _filed_by(threshold, prefix, len(text))
        out += [(_signature(prefix, head, c), prefix, True) for c in itertools.combinations(tokens[:n], k)]
        for k, n in _probes(threshold, prefix, len(text)):
            out += [(_signature(prefix, head, c), prefix, False) for c in itertools.combinations(tokens[:n], k)]
    return out


def _first_shared(a: str, b: str, prefix: int, threshold: float) -> int:
    """The list of the two in which they count: that of the rarest characters that both have among those used."""
    a, b = _utf16(a), _utf16(b)
    k, n = _filed_by(threshold, prefix, len(a))
    used = set(_tokens(b[prefix:])[: dict(_probes(threshold, prefix, len(b)))[k]])
    return _signature(prefix, a[:prefix], tuple(t for t in _tokens(a[prefix:])[:n] if t in used)[:k])


class _Names:
    """What bounds the similarity of names, as arrays: lengths, first four characters, and counts of characters."""

    def __init__(self, keys: list[str], threshold: float):
        self.keys, self.threshold = keys, threshold
        texts = [_utf16(k) for k in keys]
        self.size = np.array([len(t) for t in texts], np.int64)
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.counts = np.zeros((len(keys), 64), np.uint16)  # characters that share a slot only raise the bound
        np.add.at(self.counts, (np.repeat(np.arange(len(keys)), self.size), flat % 64), 1)
        at = np.cumsum(self.size) - self.size
        self.first = -1 - np.repeat(np.arange(len(keys))[:, None], 4, 1)
        for c in range(4):
            has = np.flatnonzero(self.size > c)
            self.first[has, c] = flat[at[has] + c]

    def prefix(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.logical_and.accumulate(self.first[i] == self.first[j], axis=1).sum(1)

    def bound(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """A number that the similarity of names i and j doesn't exceed: no transpositions, and as many matches as equal characters allow."""
        m = np.minimum(self.counts[i], self.counts[j]).sum(1).astype(np.float64)
        jaro = np.where(m > 0, (m / np.maximum(self.size[i], 1) + m / np.maximum(self.size[j], 1) + 1) / 3, 0)
        return jaro + self.prefix(i, j) * 0.1 * (1 - jaro)

    def similar(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs at or above the threshold, and their similarity; few are compared one by one."""
        short, long = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        most = (short / np.maximum(long, 1) + 2) / 3
        near = np.flatnonzero(most + 0.4 * (1 - most) >= self.threshold - 1e-9)
        near = near[self.bound(i[near], j[near]) >= self.threshold - 1e-9]
        i, j = i[near], j[near]
        score = np.array([jaro_winkler(self.keys[x], self.keys[y], self.threshold) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.float64)
        ok = score >= self.threshold
        return i[ok], j[ok], score[ok]


# -- what both joins share -----------------------------------------------------------------------

_PAIRS = "doc_id {0}, type string, a long, b long, key_a string, key_b string, similarity double"


def _pairs(table: pa.Table, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> pa.Table:
    """Rows of pairs, the earlier cluster first."""
    seq = table["first_seq"].to_numpy()
    i, j = np.where(seq[i] <= seq[j], i, j), np.where(seq[i] <= seq[j], j, i)
    side = lambda c, at: table[c].take(pa.array(at, pa.int64()))
    return pa.table({"doc_id": side("doc_id", i), "type": side("type", i), "a": side("first_seq", i), "b": side("first_seq", j), "key_a": side("key", i), "key_b": side("key", j), "similarity": pa.array(score, pa.float64())})


def _blocks_of(table: pa.Table, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which rows of one document, type and whatever else stand together, and the place where each row's group ends."""
    code = lambda c: table[c].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.float64)
    columns = [code("doc_id"), code("type"), *more]
    order = np.lexsort(columns)
    new = np.zeros(max(0, len(order) - 1), bool)
    for c in columns:
        new |= ~((c[order][1:] == c[order][:-1]) | (np.isnan(c[order][1:].astype(np.float64)) & np.isnan(c[order][:-1].astype(np.float64))))
    starts = np.flatnonzero(np.r_[True, new]) if len(order) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(order)])
    return order, np.repeat(starts + sizes, sizes)


def expanded(at: np.ndarray, ends: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y) for each x of at and y from x + 1 up to its end, in bounded batches."""
    todo = np.cumsum(ends - at - 1)
    k = 0
    while k < len(at):
        upto = max(k + 1, int(np.searchsorted(todo, (todo[k - 1] if k else 0) + at_once, side="right")))
        n = (ends - at - 1)[k:upto]
        x = np.repeat(at[k:upto], n)
        yield x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        k = upto


def _concat(found: list[tuple[np.ndarray, ...]], n: int = 3) -> list[np.ndarray]:
    return [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.float64 if k == 2 else np.int64) for k in range(n)]


def _split_blocks(clusters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clusters of small blocks, those of large ones, and the sizes of large blocks."""
    sizes = saved(clusters.groupBy("doc_id", "type").agg(F.count("*").alias("block_size")).filter(F.col("block_size") > SMALL), "large-blocks")
    if sizes.isEmpty():
        return clusters, clusters.limit(0), sizes
    same = lambda a: (F.col("c.doc_id").eqNullSafe(F.col("s.doc_id"))) & (F.col("c.type").eqNullSafe(F.col("s.type")))
    marked = lambda how: clusters.alias("c").join(sizes.alias("s"), same("s"), how).select("c.*")
    return marked("left_anti"), marked("left_semi"), sizes


def _buckets(n: int, rows: int) -> int:
    return max(1, -(-n // rows))


def _in_small_blocks(small: DataFrame, columns: list[str], n: int, compare: Callable) -> DataFrame:
    kind = small.schema["doc_id"].dataType.simpleString()
    dealt = small.select(*columns, F.pmod(F.xxhash64("doc_id", "type"), F.lit(_buckets(n, BUCKET_ROWS))).cast("int").alias("bucket"))
    return spread(dealt, "bucket").groupBy("bucket").applyInArrow(compare, _PAIRS.format(kind))  # rows are short, what is done with them is not


def _cut(entries: DataFrame, by: list[str], member: str, tiles: int = 1) -> tuple[DataFrame, int]:
    """entries with pa, pb and piece, and how many rows more they are: groups of `by` with over tiles * PIECE rows are dealt over pieces, of which each two meet in a group of their own."""
    crowded = saved(entries.groupBy(*by).agg(F.count("*").alias("members")).withColumn("pieces", F.ceil(F.col("members") / (tiles * PIECE)).cast("int")).filter("pieces > 1"), "crowded")
    whole = {"pa": F.lit(0), "pb": F.lit(0), "piece": F.lit(0)}
    more = crowded.agg(F.sum(F.col("members") * (F.col("pieces") - 1))).first()[0]
    if more is None:
        return entries.withColumns(whole), 0
    crowded = crowded.drop("members")
    few = entries.join(crowded, by, "left_anti").withColumns(whole)
    many = entries.join(crowded, by).withColumn("piece", F.pmod(F.xxhash64(member), F.col("pieces")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    many = many.withColumns({"pa": F.least("piece", "o"), "pb": F.greatest("piece", "o")})
    return few.unionByName(many.select(*few.columns)), int(more)


def jaro_winkler_pairs(clusters: DataFrame, *, threshold: float = JARO_WINKLER_THRESHOLD) -> DataFrame:
    """(doc_id, type, a, b, key_a, key_b, similarity) of clusters(doc_id, type, first_seq, key) of one document and type at or above the threshold, the earlier first.

    Keys are distinct within a document and type. A name of a large block has as many entries
    as its length allows, whatever the other names; see index_entries.
    """
    ship_package(clusters.sparkSession)
    kind = clusters.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "type", "first_seq", "key"]
    clusters = clusters.select(*columns)
    small, large, sizes = _split_blocks(clusters)

    def whole(table: pa.Table) -> pa.Table:
        names = _Names(table["key"].to_pylist(), threshold)
        order, ends = _blocks_of(table)
        found = [names.similar(order[x], order[y]) for x, y in expanded(np.arange(len(order)), ends, AT_ONCE)]
        return _pairs(table, *_concat(found))

    pairs = _in_small_blocks(small, columns, clusters.count(), whole)
    if sizes.isEmpty():
        return pairs

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):  # a name has up to some hundred entries
                part = batch.slice(k, 200)
                rows = [(i, *e) for i, key in enumerate(part["key"].to_pylist()) for e in index_entries(key, threshold)]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.record_batch([*(part[c].take(at) for c in columns), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.bool_())], names=[*columns, "list", "prefix", "filed"])

    filed = spread(large, "first_seq").mapInArrow(entries, f"doc_id {kind}, type string, first_seq long, key string, list long, prefix int, filed boolean")
    dealt, more = _cut(filed.withColumn("place", F.xxhash64("doc_id", "type", "list")), ["place"], "first_seq")
    most = int(large.agg(F.count("*")).first()[0])
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("place", "pa", "pb"), F.lit(_buckets(64 * most + more, 4 * BUCKET_ROWS))).cast("int"))

    def in_lists(table: pa.Table) -> pa.Table:
        return _pairs(table, *listed_pairs(table, threshold))

    return pairs.union(spread(dealt, "bucket").groupBy("bucket").applyInArrow(in_lists, _PAIRS.format(kind)))


def listed_pairs(table: pa.Table, threshold: float, compared: list[int] | None = None) -> list[np.ndarray]:
    """(i, j, similarity) of the rows of many lists: filed names against those looked up. compared takes the number of pairs whose bound was computed."""
    names = _Names(table["key"].to_pylist(), threshold)
    seq, prefix, filed, lists, first, second, piece = (table[c].to_numpy(zero_copy_only=False) for c in ("first_seq", "prefix", "filed", "list", "pa", "pb", "piece"))
    order, ends = _blocks_of(table, second, first, lists)
    found = []
    for x, y in expanded(np.arange(len(order)), ends, AT_ONCE):
        x, y = order[x], order[y]
        keep = filed[x] != filed[y]  # one filed, one looked up
        keep &= (first[x] == second[x]) | (piece[x] != piece[y])
        x, y = x[keep], y[keep]
        i, j = np.where(filed[x], x, y), np.where(filed[x], y, x)
        keep = (names.size[i] < names.size[j]) | ((names.size[i] == names.size[j]) & (seq[i] < seq[j]))
        i, j = i[keep], j[keep]
        keep = names.prefix(i, j) == prefix[i]
        i, j = i[keep], j[keep]
        if compared is not None:
            compared.append(len(i))
        i, j, score = names.similar(i, j)
        here = np.array([_first_shared(names.keys[p], names.keys[q], c, threshold) == n for p, q, c, n in zip(i.tolist(), j.tolist(), prefix[i].tolist(), lists[i].tolist(), strict=True)], bool)
        found.append((i[here], j[here], score[here]))
    return _concat(found)


# -- cosine ------------------------------------------------------------------------------------


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1, 1))


def _far_apart(rows: np.ndarray, n: int) -> np.ndarray:
    """n of the rows, each the one farthest from those before it."""
    taken, nearest = [0], rows @ rows[0]
    while len(taken) < min(n, len(rows)):
        taken.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[taken[-1]])
    return rows[taken]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one size as rows, without a Python object for each number."""
    if column.null_count:
        raise ValueError("a vector is missing")
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _reached(angles: np.ndarray, own: np.ndarray, near: np.ndarray, far: np.ndarray, reach: float) -> np.ndarray:
    """Which cells, of lower number than their own, vectors may have a near one in; near and far bound the angles of a cell's members, infinite for empty cells."""
    lower = np.arange(angles.shape[1]) < own[:, None]
    # a member of that cell is nearer to its pivot than to ours
    return lower & (angles <= far + reach) & (angles >= near - reach) & (angles <= angles[np.arange(len(own)), own][:, None] + 2 * reach)


def _reach(threshold: float) -> float:
    return math.acos(max(-1.0, min(1.0, threshold))) + 1e-6


def _pivots(large: DataFrame, sizes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of smallest hash, and those of them that are pivots: far apart from each other, one in four."""
    n = int(sizes.agg(F.sum("block_size")).first()[0])
    most = min(PIVOTS, max(2, n // PIECE))
    chosen = large.orderBy(F.xxhash64("key", "first_seq"), "first_seq").limit(4 * most).select("embedding").collect()
    vectors = np.array([r["embedding"] for r in chosen], np.float64)
    return vectors, _far_apart(vectors, most)


def _cells_spare(vectors: np.ndarray, pivots: np.ndarray, threshold: float) -> bool:
    """Whether vectors like these would be sent to under half of the cells of lower number. Either way pairs are exact."""
    angles = _angles(vectors, pivots)
    own, mine = angles.argmin(1), angles.min(1)
    near, far = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    np.minimum.at(near, own, mine)
    np.maximum.at(far, own, mine)
    return 2 * _reached(angles, own, near, far, _reach(threshold)).sum() < own.sum()


def cosine_cells(large: DataFrame, sizes: DataFrame, threshold: float, pivots: np.ndarray | None = None) -> DataFrame:
    """large with `cell` and `home`: each vector in the cell of its nearest pivot, and in those of lower number that hold a vector it may be near.

    Pivots are at most PIVOTS vectors, far apart from each other, of four times as many, those
    of smallest hash, whatever the input: the driver and every worker hold no more. Cells are
    kept apart by document and type; their radii are exact.
    """
    pivots = _pivots(large, sizes)[1] if pivots is None else pivots
    kind = large.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, type string, first_seq long, key string, embedding array<double>"
    reach = _reach(threshold)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angles = _angles(_matrix(batch["embedding"]), pivots)
                yield pa.record_batch([*batch.columns, pa.array(angles.argmin(1).astype(np.int32)), pa.array(angles.min(1))], names=[*batch.schema.names, "home", "angle"])

    at_home = large.mapInArrow(home, f"{fields}, home int, angle double")
    rings = at_home.groupBy("doc_id", "type", "home").agg(F.min("angle").alias("near"), F.max("angle").alias("far"))
    rings = saved(rings.groupBy("doc_id", "type").agg(F.collect_list(F.struct("home", "near", "far")).alias("rings")), "cosine-rings")  # at most PIVOTS a block
    same = F.col("c.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("c.type").eqNullSafe(F.col("r.type"))
    met = at_home.alias("c").join(rings.alias("r"), same).select("c.*", "r.rings")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            angles, own = _angles(_matrix(batch["embedding"]), pivots), batch["home"].to_numpy()
            can = np.zeros(angles.shape, bool)
            order, ends = _blocks_of(pa.Table.from_batches([batch.select(["doc_id", "type"])]))
            for start in np.unique(ends, return_index=True)[1].tolist():  # rows of a block share its rings
                at = order[start : int(ends[start])]
                near, far = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
                for x in batch["rings"][int(at[0])].as_py():
                    near[x["home"]], far[x["home"]] = x["near"], x["far"]
                can[at] = _reached(angles[at], own[at], near, far, reach)
            can[np.arange(len(own)), own] = True
            i, cell = np.nonzero(can)
            at = pa.array(i)
            yield pa.record_batch([*(batch[c].take(at) for c in ("doc_id", "type", "first_seq", "key", "embedding")), pa.array(cell.astype(np.int32)), pa.array(cell == own[i])], names=["doc_id", "type", "first_seq", "key", "embedding", "cell", "member"])

    return met.mapInArrow(send, f"{fields}, cell int, member boolean")


def _near(rows: np.ndarray, others: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, dot product) at or above the threshold, in batches of bounded size; of one set, each pair once."""
    for k in range(0, len(rows), step := max(1, DOTS_AT_ONCE // max(1, len(others)))):
        first = k if same else 0
        dots = rows[k : k + step] @ others[first:].T
        i, j = np.nonzero(dots >= threshold)
        score, i, j = dots[i, j], i + k, j + first
        if same:
            i, j, score = (x[keep] for keep in (i < j,) for x in (i, j, score))
        yield i, j, score


class _Linked:
    """Which of n rows hang together, by pairs that come in batches: each has the label of the least."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up


def _cosine(clusters: DataFrame, threshold: float, linking: bool) -> DataFrame:
    ship_package(clusters.sparkSession)
    kind = clusters.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "type", "first_seq", "key", "embedding"]
    clusters = clusters.select(*columns[:4], F.col("embedding").cast("array<double>").alias("embedding"))
    small, large, sizes = _split_blocks(clusters)

    def told(table: pa.Table, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Pairs as they are found, or what links the same rows."""
        linked = _Linked(table.num_rows)
        for i, j, score in found:
            if linking:
                linked.add(i, j)
            elif len(i):
                yield from _pairs(table, i, j, score).combine_chunks().to_batches(1 << 16)
        i = np.flatnonzero(linked.label != np.arange(table.num_rows))
        yield from _pairs(table, linked.label[i], i, np.zeros(len(i))).combine_chunks().to_batches(1 << 16)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        order, ends = _blocks_of(table)
        vectors = _matrix(table["embedding"])

        def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for start in np.unique(ends, return_index=True)[1].tolist():
                at = order[start : int(ends[start])]
                for i, j, score in _near(vectors[at], vectors[at], threshold, True):
                    yield at[i], at[j], score

        yield from told(table, found())

    pairs = _in_small_blocks(small, columns, clusters.count(), whole)
    if sizes.isEmpty():
        return pairs
    vectors, pivots = _pivots(large, sizes)
    if _cells_spare(vectors, pivots, threshold):
        sent, _ = _cut(cosine_cells(large, sizes, threshold, pivots).withColumn("place", F.xxhash64("doc_id", "type", "cell")), ["place"], "first_seq")
    else:
        tiles = large.withColumns({"cell": F.lit(0), "member": F.lit(True), "place": F.xxhash64("doc_id", "type")})
        sent, _ = _cut(tiles, ["place"], "first_seq", TILE)

    def in_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        vectors = _matrix(table["embedding"])
        cell, member, piece, first, second = (table[c].to_numpy(zero_copy_only=False) for c in ("cell", "member", "piece", "pa", "pb"))
        order, ends = _blocks_of(table, cell)  # one group, but for places that share a hash

        def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for start in np.unique(ends, return_index=True)[1].tolist():
                at = order[start : int(ends[start])]
                same = first[at[0]] == second[at[0]]
                x, y = (at, at) if same else (at[piece[at] == first[at[0]]], at[piece[at] == second[at[0]]])
                for i, j, score in _near(vectors[x], vectors[y], threshold, same):
                    i, j = x[i], y[j]
                    keep = member[i] | member[j]
                    yield i[keep], j[keep], score[keep]

        yield from told(table, found())

    return pairs.union(spread(sent, "place", "pa", "pb").groupBy("place", "pa", "pb").applyInArrow(in_cell, _PAIRS.format(kind)))


def cosine_pairs(clusters: DataFrame, *, threshold: float = COSINE_THRESHOLD) -> DataFrame:
    """The same by the dot product of clusters' `embedding` column, whose vectors are of unit length and of one size.

    A vector of a large block is sent to the cells that it can reach: few where names' vectors
    gather in groups. Where a sample says that it would be sent to most, as vectors have no
    structure, each is sent once a tile of its block, and all pairs are compared.
    """
    return _cosine(clusters, threshold, False)


def cosine_links(clusters: DataFrame, *, threshold: float = COSINE_THRESHOLD) -> DataFrame:
    """(doc_id, type, a, b): fewer pairs, by which the same clusters hang together as by cosine_pairs; they need not be similar themselves.

    Each two tiles, or each cell, tell at most one link a member.
    """
    return _cosine(clusters, threshold, True).select("doc_id", "type", "a", "b")
