"""Interval overlap join, spelling variants and document fingerprints against brute force."""

import datetime
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillgraph.llm import fingerprints as prints
from quillgraph.llm import queries
from quillgraph.llm.fingerprints import Comparison, Paragraphs, compare_versions, fingerprint_edits, fingerprint_strings
from quillgraph.llm.interval_join import RELATIONS, click_sessions, overlapping, relate_intervals, sale_intervals
from quillgraph.llm.spelling_variants import LETTERS, near_words, spelling_forms, spelling_variants, word_counts

EPOCH = datetime.datetime(1970, 1, 1)
SLOT = 6 * 3600 * 10**6
CLICKS = "client_id long, ts timestamp_ntz, kind string, lo long, hi long, quarter string, day long, err string, run long"
SALES = "sale_id long, client_id long, status string, sold_at timestamp_ntz, lo long, weight string, shipped string, times long, salt int"
LINES = "sale_id long, shipped_at timestamp_ntz, client_id string, first_us long"


def at(us):
    return None if us is None else EPOCH + datetime.timedelta(microseconds=us)


def brute_relations(sales, lines, clicks):
    by_client, shipped, out = defaultdict(list), {}, {}
    for client, us, kind in clicks:
        if client is not None and us is not None:
            by_client[client].append((us, kind))
    sessions = defaultdict(list)
    for client, rows in by_client.items():
        held = []
        for us, kind in sorted(rows, key=lambda r: r[0]):
            if held and us - held[-1][0] > 900_000_000:
                sessions[client].append(held)
                held = []
            held.append((us, kind))
        sessions[client].append(held)
    for sale, us in lines:
        if sale is not None and us is not None:
            shipped[sale] = max(us, shipped.get(sale, us))
    for sale, client, status, sold in sales:
        if client is None or sold is None:
            continue
        s, e = sold // SLOT, float("inf") if status == "open" else max(sold, shipped.get(sale, sold)) // SLOT
        for held in sessions[client]:
            a = held[0][0] // SLOT
            b = float("inf") if any(k == "error" and u == held[-1][0] for u, k in held) else held[-1][0] // SLOT
            if s <= b and e >= a:
                relation = RELATIONS[3 * (1 + (s > a) - (s < a)) + 1 + (e > b) - (e < b)]
                got = out.setdefault((sale, relation), [0, None, 0])
                got[0] += 1
                got[2] += zlib.crc32(str(held[0][0]).encode())
                if min(e, b) != float("inf"):
                    got[1] = (got[1] or 0) + int(min(e, b) - max(s, a) + 1)
    return {(*k, *v) for k, v in out.items()}


def made_shop(seed, n=300):
    r = random.Random(seed)
    start = 19_700 * 4 * SLOT
    client = lambda: r.choice([None, 7, 7, 7, 1, 2, 3])
    time = lambda: r.choice([None, start + r.randrange(40 * SLOT), start + 900_000_000 * r.randrange(500), -r.randrange(3 * SLOT)])
    clicks = []
    for _ in range(n):
        c, t = client(), time()
        for _ in range(r.randrange(1, 6)):  # chains over quarters and days, gaps of exactly 15 minutes
            clicks.append((c, t, r.choice([None, "view", "error", "click"])))
            t = None if t is None else t + r.choice([0, 1, 899_999_999, 900_000_000, 900_000_001])
    sales = [(r.choice([k, k, k, None, 5]), client(), r.choice([None, "open", "done"]), time()) for k in range(n)]
    lines = [(r.choice([None, *range(n)]), time()) for _ in range(2 * n)]
    return sales, lines, clicks + clicks[:40]


def related(spark, sales, lines, clicks, **sizes):
    c = spark.createDataFrame([(x, at(t), k, 1, 2, "q", 3, "e", 4) for x, t, k in clicks], CLICKS)
    s = spark.createDataFrame([(i, x, st, at(t), 1, "w", "s", 2, 3) for i, x, st, t in sales], SALES)
    m = spark.createDataFrame([(i, at(t), "c", 1) for i, t in lines], LINES)
    rows = relate_intervals(sale_intervals(s, m), click_sessions(c), **sizes).collect()
    got = {tuple(r) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("sizes", [{}, {"unit_sales": 3, "unit_sessions": 2, "block_rows": 50}])
def test_relations_against_loops(spark, sizes):
    shop = made_shop(1)
    assert related(spark, *shop, **sizes) == brute_relations(*shop)


def test_relations_of_edge_tables(spark):
    sales, lines, clicks = made_shop(2, 20)
    assert related(spark, [], lines, clicks) == related(spark, sales, lines, []) == set()
    assert related(spark, sales, [], clicks) == brute_relations(sales, [], clicks)
    one = [(1, 7, "done", 5), (1, 7, "done", 5), (1, 7, "open", 5)]  # repeated rows of a sale are summed
    assert related(spark, one, [], [(7, 5, None), (7, 5, None)]) == brute_relations(one, [], [(7, 5, None)])


def test_sessions_do_not_depend_on_the_session_time_zone(spark):
    shop = made_shop(3, 60)
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
        assert related(spark, *shop) == brute_relations(*shop)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("seed", range(6))
def test_overlapping_against_all_pairs(seed):
    r = np.random.RandomState(seed)
    n, m, units = r.randint(0, 300), r.randint(0, 500), r.randint(1, 5)
    s, a = r.randint(-5, 60, n), r.randint(-5, 60, m)
    e, b = s + r.randint(0, 30, n), a + r.choice([0, 1, 5, 1 << 40], m)
    ur, uq = r.randint(0, units, n), r.randint(0, units, m)
    want = {(i, j) for i in range(n) for j in range(m) if ur[i] == uq[j] and s[i] <= b[j] and e[i] >= a[j]}
    got = [(int(i), int(j)) for x, y in overlapping(ur, s, e, uq, a, b, at_once=7) for i, j in zip(x, y, strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def brute_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda x: x[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_forms(counts):
    forms, partners = {}, {}
    for w, n in counts.items():
        others = [o for o in counts if abs(len(o) - len(w)) < 2 and near(w, o)]
        partners[w] = len(others)
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        forms[w] = best if best and counts[best] >= 2 * n else None
    rows = set()
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, forms[w], root, n, partners[w], counts[forms[w]] if forms[w] else None))
    return rows


def made_words(seed, n=400):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeÀéÿß×") for _ in range(r.randrange(4, 9))) for _ in range(n // 4)]
    while len(words) < n:
        w = list(r.choice(words))
        k, kind = r.randrange(len(w)), r.randrange(3)
        w[k : k + (kind > 0)] = [] if kind == 2 else [r.choice("abcdeÀéÿß×")]
        words.append("".join(w))
    return {w: r.choice([3, 3, 4, 6, 12, 25, 100]) for w in words if w}


@pytest.mark.parametrize("sizes", [{}, {"group_words": 3, "levels": 3, "bucket_rows": 100}, {"group_words": 2, "levels": 1}])
def test_forms_against_all_pairs(spark, sizes):
    counts = made_words(4)
    rows = spelling_forms(spark.createDataFrame(list(counts.items()), "word string, n long"), **sizes).collect()
    assert {tuple(r) for r in rows} == brute_forms(counts) and len(rows) == len(counts)
    assert sum(x[4] for x in brute_forms(counts)) > 300


def test_one_large_band_is_a_matrix(spark):
    words = [(f"{a}{b}{c}zzzzzz", 3) for a in "abcdefgh" for b in "ijklmnopq" for c in "rstuvwxy"]
    got = {(r["word"], r["other"]) for r in near_words(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {(a, b) for a, _ in words for b, _ in words if a != b and near(a, b)}


def test_spelling_variants_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "Hello HELLO hello hellO hallo Hallo hallo ÀÉ×÷ÿ " * 3), (None, "hallo hallo hello jello"), (3, "x1y2 " * 9), (4, "λόγος hello" * 4), (5, "q" * 3000 + " "), (5, ("q" * 3000 + " ") * 2), (6, "wordy " * 300_000)]
    frame = spark.createDataFrame([(i, t, "en", 1, "f") for i, t in rows], "doc_id long, text string, word string, n long, form string")
    got = spelling_variants(frame).collect()
    assert {tuple(r) for r in got} == brute_forms(brute_words(rows))
    assert spelling_variants(frame.limit(0)).collect() == []
    assert len(LETTERS) == len(set(LETTERS)) == 116


def test_spelling_query(spark, sf_dir):
    docs = [tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert {tuple(r) for r in word_counts(queries.table(spark, sf_dir, "documents")).collect()} == set(brute_words(docs).items())


def brute_paragraphs(text):
    p = Paragraphs([text])
    return Counter(p.digests.tolist())


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def brute_edits(rows):
    order = sorted(((i is None, i, t or "") for i, t in rows), key=lambda r: (r[0], r[1] or 0))
    out = []
    for k, (_, i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][2]
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        mine = brute_paragraphs(text)
        one = lambda t: fingerprint_strings(Paragraphs([t]))[0]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), one(text), one(edited), jaccard(mine, brute_paragraphs(edited)), jaccard(mine, brute_paragraphs(following))))
    return out


def test_fingerprint_query(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    got = queries.op13_fingerprints(spark, sf_dir).drop("n_paragraphs", "n_lost", "n_new").collect()
    assert sorted(map(tuple, got)) == sorted(brute_edits([tuple(r) for r in docs.select("doc_id", "text").collect()]))
    assert np.mean([r["near_edited"] for r in got]) > 0.5 > 0.1 > np.mean([r["near_next"] for r in got])


@pytest.mark.parametrize("parts", [1, 1 << 20])
def test_edits_of_odd_texts(spark, parts):
    rows = [(5, None), (1, ""), (2, "ñandú ß 𝄞 𝄞 𝄞"), (3, "one line\n" * 50), (4, "one line\n" * 50), (9, " \n\t "), (8, "w " * 200_000), (12, "ab\ncd"), (-3, "last words of all here"), (None, "without an id")]
    frame = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, tie long, part string")
    got = fingerprint_edits(frame, part_bytes=parts).drop("n_paragraphs", "n_lost", "n_new").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_edits(rows)))
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[3]["fingerprint"] == by_id[4]["fingerprint"] and by_id[3]["near_next"] == 1.0
    alone = fingerprint_edits(frame.filter("doc_id = 12")).collect()
    assert [(r["doc_id"], r["near_next"]) for r in alone] == [(12, 1.0)]
    assert fingerprint_edits(frame.limit(0)).collect() == []
    same = fingerprint_edits(spark.createDataFrame([(1, "a b\nc")] * 5 + [(1, "d")], "doc_id long, text string")).collect()
    assert len(same) == 6 and sum(r["near_next"] == 1.0 for r in same) == 4


def test_versions_recover_what_differs(spark):
    r = random.Random(5)
    line = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(50)) for _ in range(6))
    pairs = [(None, None, 1), ("", "a b", 2), (None, "x", 3)]
    for _ in range(40):
        lines = [line() for _ in range(r.randrange(1, 200))]
        new = [x for x in lines if r.random() < r.choice([0.99, 0.9, 0.2])] + [line() for _ in range(r.randrange(4))]
        pairs.append(("\n".join(lines), "\n".join(new), len(pairs)))
    frame = spark.createDataFrame([(*p, "mine") for p in pairs], "old string, new string, n long, cells string")
    for row in compare_versions(frame).collect():
        a, b = brute_paragraphs(row["old"] or ""), brute_paragraphs(row["new"] or "")
        signed = lambda c: sorted(np.array(list(c), np.uint64).view(np.int64).tolist())
        assert sorted(row["old_only"]) == signed((a - b)) and sorted(row["new_only"]) == signed((b - a))
        assert row["likeness"] == jaccard(a, b) and (row["old_fingerprint"] == row["new_fingerprint"]) == (a == b)


def test_stuck_sketches_are_made_larger():
    texts = Paragraphs(["\n".join(f"line {k} of the first" for k in range(400)), "\n".join(f"line {k} of the second" for k in range(400))])
    c = Comparison(texts, np.array([0, 0]), np.array([1, 0]))
    assert c.cells[0] > prints.BASE_CELLS == c.cells[1] and c.likeness.tolist()[1] == 1.0
    first, second = (set(texts.digests[texts.of[i] : texts.of[i + 1]].tolist()) for i in range(2))
    assert set(c.only_a[0].tolist()) == first - second and set(c.only_b[0].tolist()) == second - first
