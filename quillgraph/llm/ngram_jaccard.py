"""N-gram Jaccard join: an exact similarity join by grouped prefixes.

A document's set holds the 64-bit hashes of its distinct word shingles. Two documents
link when |A & B| / |A | B| >= threshold. The join never meets all pairs:

1. df      Every chunk of documents sends its distinct shingles (48 bits, gap-coded) to
           hash buckets, once a chunk however many documents repeat them; buckets add up
           document counts and answer each chunk with the shingles of two or more documents.
2. prefix  Ordered rarest first, a set of n shingles shares one of its first
           n - ceil(threshold * n) + 1 with each partner. Shingles of one document lead that
           order and match nothing, so a document whose prefix holds only those has no partner
           and is done. Few documents pass.
3. groups  Equal sets become one, and sets of equal prefix and size one group. Groups are
           dealt to blocks by the smallest group of each prefix shingle's list; groups that
           share a prefix shingle meet in that shingle's block. A block of more than
           `block_sets` sets, or `block_bytes` of shingles, is cut into pieces and each two
           pieces meet in a task of their own.
4. verify  In a block, group pairs pass size and position filters, then expand to
           members, whose overlap is counted exactly. A link is counted in the first block
           that both members share. Blocks return a spanning forest and link counts, not pairs.
5. classes Components of the forest; the smallest doc_id names each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunked, components, exchange_sizes, saved, text_bytes
from .wordcols import BLANK, Words, mix, pack, unpack, whole_window, windows

BLOCK_SETS = 192  # sets of a piece of a block
BLOCK_BYTES = 4 << 20  # of its shingles
_SHIFT = np.uint64(16)  # document counts are kept by the top 48 bits


def shingle_sets(texts, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle) of each distinct shingle, ascending, and the set size of each text."""
    words = Words(texts, separators=BLANK, lower=True)
    hashes, counts = words.hashes(), words.counts
    shingles, whole = windows(hashes, width), whole_window(words.first, width)
    owner = [words.text_of_word()[: len(shingles)][whole]]
    values = [shingles[whole]]
    for k in range(1, width):  # fewer words: the whole sequence is the one shingle
        short = np.flatnonzero(counts == k)
        if len(short):
            owner.append(short)
            values.append(windows(hashes, k)[words.first[short]])
    owner, values = np.concatenate(owner), np.concatenate(values)
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    owner, values = owner[new], values[new]
    return owner, values, np.bincount(owner, minlength=words.n_texts).astype(np.int64)


def _bounds(n_buckets: int) -> np.ndarray:
    """First value of each bucket after the first, for values spread over 48 bits."""
    return np.array([(i << 48) // n_buckets for i in range(1, n_buckets)], np.uint64)


def _requests(width: int, n_buckets: int):
    bounds = _bounds(n_buckets)

    def run(table: pa.Table) -> pa.Table:
        _, values, _ = shingle_sets(table["text"], width)
        values, counts = np.unique(values >> _SHIFT, return_counts=True)
        cut = np.concatenate([[0], np.searchsorted(values, bounds), [len(values)]])
        full = np.flatnonzero(np.diff(cut))
        return pa.table({
            "bucket": pa.array(full, pa.int32()),
            "chunk": pa.array(np.full(len(full), table["chunk"][0].as_py()), pa.int32()),
            "blob": pa.array([pack(values[cut[b] : cut[b + 1]], np.minimum(counts[cut[b] : cut[b + 1]], 2**31).astype(np.uint32)) for b in full], pa.binary()),
        })

    return run


def _answers(table: pa.Table) -> pa.Table:
    """For each chunk that asked: those of its shingles that two documents or more have, with counts."""
    got = [unpack(b.as_py(), "u8", "u4") for b in table["blob"]]
    values = np.concatenate([g[0] for g in got])
    unique, inverse = np.unique(values, return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([g[1] for g in got])).astype(np.uint64)
    total = np.minimum(total, 2**31).astype(np.uint32)
    out, at = [], 0
    for v, _ in got:
        df = total[inverse[at : at + len(v)]]
        at += len(v)
        shared = df > 1
        out.append(pack(v[shared], df[shared]) if shared.any() else None)
    keep = pa.array([b is not None for b in out])
    return pa.table({"chunk": table["chunk"], "blob": pa.array(out, pa.binary())}).filter(keep)


def _prefixes(width: int, percent: int):
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("first_at", pa.int32()), ("prefix", pa.list_(pa.int64())), ("shared", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        owner, values, n = shingle_sets(left["text"], width)
        if right.num_rows:
            got = [unpack(b.as_py(), "u8", "u4") for b in right["blob"]]
            known, known_df = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            order = np.argsort(known)
            known, known_df = known[order], known_df[order]
            at = np.minimum(np.searchsorted(known, values >> _SHIFT), len(known) - 1)
            df = np.where(known[at] == values >> _SHIFT, known_df[at], 1)
        else:
            df = np.ones(len(values), np.uint32)
        rows = len(n)
        alone = np.bincount(owner, weights=df == 1, minlength=rows).astype(np.int64)
        length = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
        alive = alone < length
        # two independent sums name a set
        with np.errstate(over="ignore"):
            k1, k2 = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            np.add.at(k1, owner, mix(values))
            np.add.at(k2, owner, mix(values ^ np.uint64(0xD6E8FEB86659FD93)))
        use = alive[owner] & (df > 1)
        o, v, d = owner[use], values[use], df[use]
        ends = np.searchsorted(o, np.arange(rows + 1))
        by_df = v[np.lexsort((v, d, o))].view(np.int64)
        take = np.where(alive, np.minimum(length - alone, np.diff(ends)), 0)
        prefix = [by_df[ends[i] : ends[i] + take[i]] if alive[i] else None for i in range(rows)]
        shared = [v[ends[i] : ends[i + 1]].tobytes() if alive[i] else None for i in range(rows)]
        uid = pa.array(np.arange(rows) + (left["chunk"][0].as_py() << 32))
        return pa.table([uid, left["doc_id"], pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(alone, pa.int32()), pa.array(prefix, pa.list_(pa.int64())), pa.array(shared, pa.binary())], schema=schema)

    return run


def _linked(percent: int):
    """Links among the sets of one block task; see the module's step 4."""

    def run(table: pa.Table) -> pa.Table:
        rep = table["rep"].to_numpy()
        m = len(rep)
        n, first_at = table["n"].to_numpy().astype(np.int64), table["first_at"].to_numpy().astype(np.int64)
        mult = table["copies"].to_numpy().astype(np.int64)
        leader, piece_a, piece_b = (table[c][0].as_py() for c in ("leader", "pa", "pb"))
        piece = table["piece"].to_numpy()
        order_in = np.argsort(rep, kind="stable")

        def flat(arrays):
            sizes = np.array([len(a) for a in arrays], np.int64)
            return np.concatenate(arrays) if len(arrays) else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(sizes)])

        prefixes = [np.asarray(p, np.int64) for p in table["prefix"].to_pylist()]
        # groups: equal size and equal prefix
        seen: dict[tuple, int] = {}
        group = np.array([seen.setdefault((int(n[i]), int(first_at[i]), prefixes[i].tobytes()), len(seen)) for i in range(m)])
        n_groups = len(seen)
        head = np.full(n_groups, -1, np.int64)
        head[group[::-1]] = np.arange(m)[::-1]
        members_at = np.argsort(group, kind="stable")
        member_ends = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=n_groups))])
        g_n, g_first = n[head], first_at[head]
        p_flat, p_ends = flat([prefixes[h] for h in head])
        p_ids = np.unique(p_flat, return_inverse=True)[1]
        p_group = np.repeat(np.arange(n_groups), np.diff(p_ends))
        p_left = (g_n[p_group] - g_first[p_group] - (np.arange(len(p_flat)) - p_ends[:-1][p_group])).astype(np.int64)  # shingles from here to the end of the set
        s_flat, s_ends = flat([np.frombuffer(b, np.int64) for b in table["shared"].to_pylist()])
        s_vocab, s_ids = np.unique(s_flat, return_inverse=True)
        l_flat, l_ends = flat([np.asarray(x, np.int64) for x in table["leaders"].to_pylist()])
        s_mark = np.zeros(len(s_vocab), bool)
        p_mark = np.zeros(int(p_ids.max()) + 1 if len(p_ids) else 0, np.int64)

        def slices(ends, which):
            """Positions of the flat entries of `which`, and where each one's begin."""
            size = ends[which + 1] - ends[which]
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            return np.repeat(ends[which] - begin, size) + np.arange(int(size.sum())), begin

        links = np.zeros(m, np.int64)
        root = np.arange(m)

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        edges = []
        for g in range(n_groups):
            own = members_at[member_ends[g] : member_ends[g + 1]]
            # group filters: sizes, then the best overlap that the first shared prefix shingle leaves
            later = np.arange(g, n_groups)
            later = later[np.minimum(g_n[later], g_n[g]) * 100 >= percent * np.maximum(g_n[later], g_n[g])]
            lo, hi = p_ends[g], p_ends[g + 1]
            p_mark[p_ids[lo:hi]] = p_left[lo:hi]
            at, begin = slices(p_ends, later)
            mine = p_mark[p_ids[at]]
            room = np.where(mine > 0, np.minimum(mine, p_left[at]), 0)
            best = np.maximum.reduceat(room, begin) if len(at) else np.zeros(0, np.int64)
            p_mark[p_ids[lo:hi]] = 0
            need = (percent * (g_n[later] + g_n[g]) + 99 + percent) // (100 + percent)
            later = later[best >= need]
            if not len(later):
                continue
            others = np.concatenate([members_at[member_ends[x] : member_ends[x + 1]] for x in later])
            for i in own:
                rest = others[(group[others] > g) | (others > i)]
                if piece_a != piece_b:
                    rest = rest[piece[rest] != piece[i]]
                if not len(rest):
                    continue
                mine_ids = s_ids[s_ends[i] : s_ends[i + 1]]
                s_mark[mine_ids] = True
                at, begin = slices(s_ends, rest)
                both = np.add.reduceat(s_mark[s_ids[at]].astype(np.int64), begin)
                s_mark[mine_ids] = False
                union = n[i] + n[rest] - both
                rest = rest[100 * both >= percent * union]
                if not len(rest):
                    continue
                # the first common block counts the link
                at, begin = slices(l_ends, rest)
                common = np.where(np.isin(l_flat[at], l_flat[l_ends[i] : l_ends[i + 1]]), l_flat[at], np.iinfo(np.int64).max)
                rest = rest[np.minimum.reduceat(common, begin) == leader]
                links[i] += mult[rest].sum()
                np.add.at(links, rest, mult[i])
                for j in rest:
                    a, b = find(i), find(j)
                    if a != b:
                        a, b = (a, b) if rep[a] < rep[b] else (b, a)
                        root[b] = a
                        edges.append((rep[b], rep[a]))
        del order_in
        some = np.flatnonzero(links)
        return pa.table({
            "a": pa.array([int(e[0]) for e in edges] + rep[some].tolist(), pa.int64()),
            "b": pa.array([int(e[1]) for e in edges] + rep[some].tolist(), pa.int64()),
            "links": pa.array([0] * len(edges) + links[some].tolist(), pa.int64()),
        })

    return run


def jaccard_components(
    docs: DataFrame,
    *,
    width: int = 5,
    percent: int = 75,
    chunk_bytes: int | None = None,
    bucket_bytes: int | None = None,
    block_sets: int = BLOCK_SETS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of docs(doc_id, text).

    width    words of a shingle; a text of fewer words, but not none, is one shingle
    percent  documents link when 100 * |A & B| >= percent * |A | B|

    n_links counts the other rows that a row links with, copies included. Null and blank
    texts have no shingles, link with nothing and name their own class. Equal rows link like
    any two equal texts; rows of one doc_id with different texts share what their id's class is. Rows with a
    null doc_id link, count and bridge like others, but never name a class: without another id it is null. Other columns
    of docs are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_bytes = text_bytes(docs)
    chunk_bytes, bucket_bytes = exchange_sizes(n_bytes, chunk_bytes, bucket_bytes)
    n_buckets = max(24, -(-n_bytes // bucket_bytes))
    parts = chunked(docs, n_bytes, chunk_bytes=chunk_bytes)
    asked = parts.groupBy("chunk").applyInArrow(_requests(width, n_buckets), "bucket int, chunk int, blob binary")
    told = asked.groupBy("bucket").applyInArrow(_answers, "chunk int, blob binary")
    row = parts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(
        _prefixes(width, percent), "uid long, doc_id long, n long, k1 long, k2 long, first_at int, prefix array<long>, shared binary"
    )
    row = saved(row, "jaccard-rows")

    # one row a set, without its shingles: those are fetched once, by the row that stands for the set
    alive = row.filter("shared is not null")
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "uid"))
    sets = alive.withColumn("pk", F.xxhash64("prefix", "first_at")).groupBy("k1", "k2", "n").agg(F.min(named).alias("m"), F.min("uid").alias("uid"), F.count("*").alias("copies"), F.first("pk").alias("pk"))
    # rep stands for a set, whether its rows have ids or not; ids only name classes
    sets = saved(sets.select("k1", "k2", "n", "pk", "copies", F.col("m.doc_id").alias("name"), F.col("uid").alias("rep"), "uid"), "jaccard-sets")
    groups = sets.groupBy("n", "pk").agg(F.min(F.struct("rep", "uid")).alias("m"), F.count("*").alias("members"))
    groups = saved(groups.select("n", "pk", "members", F.col("m.rep").alias("gid"), F.col("m.uid").alias("uid")), "jaccard-groups")
    listed = alive.select("uid", "prefix").join(groups.select("uid", "gid"), "uid").select("gid", F.explode("prefix").alias("t"))
    leaders = listed.groupBy("t").agg(F.min("gid").alias("leader"), F.count("*").alias("c")).filter("c > 1").drop("c")
    seats = listed.join(leaders, "t").select("gid", "leader").union(groups.filter("members > 1").select("gid", F.col("gid").alias("leader"))).distinct()
    seats = saved(seats, "jaccard-seats")
    sizes = seats.join(groups.select("gid", "n", "members"), "gid").groupBy("leader").agg(F.sum("members").alias("size"), F.sum(8 * F.col("n") * F.col("members")).alias("bytes"))
    # no more pieces than sets: a single set may be larger than block_bytes
    pieces = F.least(F.col("size"), F.greatest(F.ceil(F.col("size") / block_sets), F.ceil(F.col("bytes") / block_bytes))).cast("int")
    placed = seats.join(sizes.select("leader", pieces.alias("pieces")), "leader")
    own_list = seats.groupBy("gid").agg(F.array_sort(F.collect_set("leader")).alias("leaders"))
    members = sets.join(groups.select("n", "pk", "gid"), ["n", "pk"]).join(own_list, "gid").join(placed, "gid")
    members = members.withColumn("piece", F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    dealt = members.withColumn("o", other).withColumn("pa", F.least("piece", "o")).withColumn("pb", F.greatest("piece", "o")).drop("n", "k1", "k2", "pk", "name")
    dealt = dealt.join(alive.select("uid", "n", "first_at", "prefix", "shared"), "uid")
    found = dealt.select("leader", "pa", "pb", "piece", "rep", "n", "first_at", "copies", "prefix", "shared", "leaders").groupBy("leader", "pa", "pb").applyInArrow(_linked(percent), "a long, b long, links long")
    found = saved(found, "jaccard-links")

    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    first = sets.groupBy("name").agg(F.min("rep").alias("b"), F.count("*").alias("c")).filter("c > 1 and name is not null")
    same = sets.join(first, "name").filter("rep <> b").select(F.col("rep").alias("a"), "b")
    classes = components(found.filter("a <> b").select("a", "b").union(same)).withColumnRenamed("node", "rep")
    names = classes.join(sets.select("rep", "name"), "rep").groupBy("component").agg(F.min("name").alias("class"))
    of_set = (
        sets.select("k1", "k2", "n", "rep", "name", "copies")
        .join(links, "rep", "left")
        .join(classes.join(names, "component").select("rep", "class"), "rep", "left")
        .select("k1", "k2", "n", F.coalesce("class", "name").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    return row.select("doc_id", "n", "k1", "k2").join(of_set, ["k1", "k2", "n"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("class", "doc_id").alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )
