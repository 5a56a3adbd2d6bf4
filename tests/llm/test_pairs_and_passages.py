"""N-gram Jaccard join, substring dedup and benchmark decontamination against brute force."""

import hashlib
import pickle
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import queries
from quillgraph.llm import substring_dedup as dedup
from quillgraph.llm.ngram_jaccard import jaccard_components
from quillgraph.llm.positional_index import Phrases, build_index, contamination, phrase_matches, proximity_matches
from quillgraph.llm.substring_dedup import dedup_substrings
from quillgraph.llm.wordcols import BLANK, Words, unpack, windows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, chunk int, n long, rep string, segment long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def frame(spark, rows):
    """rows of (doc_id, text), with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", None, 1, 2, "r", 3) for i, t in rows], DOCS)


def blanks(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def made_up(seed, n=60, words=200):
    """Texts with copies, near copies, shared passages, short, blank, null and long ones."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)] + ["Été", "ñ,", "AB", "ab"]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, base = text(60), text(80)
    rows = []
    for i in range(n):
        kind = r.randrange(8)
        if kind == 0:
            t = base
        elif kind == 1:
            ws = base.split()
            for _ in range(r.randrange(3)):
                ws[r.randrange(len(ws))] = r.choice(vocabulary)
            t = " ".join(ws)
        elif kind == 2:
            t = f"{text(20)}\n{passage}  \t{text(r.randrange(40))}"
        elif kind == 3:
            t = r.choice([None, "", " \n", "a", "A", "a b", "a b c d", "A b c d", "a b c d e"])
        elif kind == 4:
            t = f"{passage} {passage}"
        elif kind == 5:
            t = "x " * r.randrange(50)
        else:
            t = text(r.randrange(300))
        rows.append((i * 3, t))
    rows.append((1, text(4000)))
    r.shuffle(rows)
    return rows


def brute_components(rows, width=5, percent=75):
    sets = {}
    for i, t in rows:
        w = blanks(lower(t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    links = Counter()
    ids = sorted(sets)
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if (s := len(sets[a] & sets[b])) and 100 * s >= percent * len(sets[a] | sets[b])]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (len(sets[i]), label[i], links[i]) for i in ids}


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"chunk_bytes": 3000, "bucket_bytes": 500}), (3, {"block_sets": 4}), (4, {"block_sets": 1, "percent": 60}), (4, {"block_bytes": 1500}), (5, {"width": 2, "percent": 90})])
def test_jaccard_join(spark, seed, options):
    rows = made_up(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_components(frame(spark, rows), **options).collect()}
    assert got == brute_components(rows, options.get("width", 5), options.get("percent", 75))


def test_jaccard_edges(spark):
    assert jaccard_components(frame(spark, [])).collect() == []
    twice = " ".join(map(str, range(30)))
    got = [tuple(r) for r in jaccard_components(frame(spark, [(5, twice), (5, twice), (None, twice), (7, None), (None, None)])).collect()]
    assert sorted(got, key=str) == sorted([(5, 26, 5, 2), (5, 26, 5, 2), (None, 26, 5, 2), (7, 0, 7, 0), (None, 0, None, 0)], key=str)


def test_jaccard_rows_without_an_id_link_and_bridge(spark):
    words = [f"b{k}" for k in range(80)]
    a, b, c = (" ".join(words[k : k + 60]) for k in (0, 6, 12))
    lone, near = " ".join(f"l{k}" for k in range(40)), " ".join(f"l{k}" for k in range(42))
    rows = [(4, a), (None, b), (3, c), (None, lone), (None, lone), (None, near), (8, "x y z"), (8, "p q r")]
    got = [(r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard_components(frame(spark, rows)).collect()]
    want = [(4, 3, 1), (None, 3, 2), (3, 3, 1), (None, None, 2), (None, None, 2), (None, None, 2), (8, 8, 0), (8, 8, 0)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_jaccard_threshold_is_inclusive(spark):
    base = [f"a{k}" for k in range(11)]  # 7 shingles
    near = base[:10] + ["z"]  # 6 of 8 shared: exactly 75 percent
    far = base[:9] + ["z", "y"]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(frame(spark, [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))])).collect()}
    assert got == {1: 1, 2: 1, 3: 3 if 100 * 5 < 75 * 9 else 1}


def test_jaccard_chain_of_links(spark):
    """Components follow chains whose ends don't link."""
    words = [f"c{k}" for k in range(140)]
    rows = [(k, " ".join(words[k * 4 : k * 4 + 60])) for k in range(20)]
    assert {r["component_id"] for r in jaccard_components(frame(spark, rows)).collect()} == {0}


def brute_dedup(rows, width=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = blanks(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if key in seen:
                gone[k : k + width] = [True] * width
            seen.add(key)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g), gone)
    return out


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"chunk_bytes": 2000, "bucket_bytes": 300}), (3, {"base_words": 5, "chunk_bytes": 900}), (4, {"min_words": 8, "base_words": 1}), (5, {"min_words": 40, "chunk_bytes": 3000})])
def test_substring_dedup(spark, seed, options):
    rows = [(i, t) for i, t in made_up(seed)]
    want = brute_dedup([(i, t or "") for i, t in rows], options.get("min_words", 20))
    for r in dedup_substrings(frame(spark, rows), **options).collect():
        n, removed, kept, gone = want[r["doc_id"]]
        cover = [False] * n
        for s in r["removed"]:
            assert s["start"] < s["end"]
            cover[s["start"] : s["end"]] = [True] * (s["end"] - s["start"])
        assert (r["n_words"], r["n_removed"], r["kept_text"], cover) == (n, removed, kept, gone)


def test_levels_go_on_while_candidates_survive():
    """5, 10, 20, 40, ... words: what survives a level equals the windows of that length that occur twice, until there are none."""
    rows = [(i, t or "") for i, t in made_up(3) if len(blanks(t)) < 500]
    chunks = [pa.table({"doc_id": [i for i, _ in part], "text": [t for _, t in part], "chunk": pa.array([k] * len(part), pa.int32())}) for k in range(3) if (part := rows[k::3])]
    asked, width, levels = [dedup._first_level(5, 4, 48)(t) for t in chunks], 5, []
    while any(t.num_rows for t in asked):
        whole = pa.concat_tables(asked)
        told = pa.concat_tables([dedup._repeated(whole.filter(pc.equal(whole["bucket"], b))) for b in pc.unique(whole["bucket"]).to_pylist()])
        told = [told.filter(pc.equal(told["chunk"], k)) for k in range(3)]
        kept = {int(v) for t in told for blob in t["blob"].to_pylist() for v in unpack(blob, "u8")[0]}
        seen = Counter(tuple(w[k : k + width]) for _, t in rows for w in [blanks(t)] for k in range(len(w) - width + 1))
        twice = [w for w, n in seen.items() if n > 1]
        hashes = {int(v) >> 16 for w in twice for v in windows(Words(pa.array([" ".join(w)]), separators=BLANK, lower=False).hashes(), width)}
        assert kept == hashes and len(hashes) == len(twice)
        levels.append(width)
        asked = [dedup._next_level(width, 4, 48, False)(c, t) for c, t in zip(chunks, told, strict=True)]
        width *= 2
    assert levels[:4] == [5, 10, 20, 40] and not any(n > 1 for n in Counter(tuple(w[k : k + width]) for _, t in rows for w in [blanks(t)] for k in range(len(w) - width + 1)).values())


def test_a_hash_of_few_bits_costs_no_word(spark, monkeypatch):
    monkeypatch.setattr(dedup, "level_bits", lambda n: 9)
    rows = [(i, t or "") for i, t in made_up(6)]
    want = brute_dedup(rows)
    assert all((r["n_removed"], r["kept_text"]) == want[r["doc_id"]][1:3] for r in dedup_substrings(frame(spark, rows)).collect())


def test_a_very_long_text(spark):
    r = random.Random(1)
    text = " ".join(f"w{r.randrange(300)}" for _ in range(60_000))
    rows = [(1, text), (2, f"head {text} tail"), (3, "w" * 400_000), (4, "x" + "w" * 400_000)]
    got = {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in dedup_substrings(frame(spark, rows)).collect()}
    assert got == {1: (60_000, 0), 2: (60_002, 60_000), 3: (1, 0), 4: (1, 0)}
    classes = {x["doc_id"]: x["component_id"] for x in jaccard_components(frame(spark, rows)).collect()}
    assert classes == {1: 1, 2: 1, 3: 3, 4: 4}
    items = spark.createDataFrame([(7, " ".join(text.split()[100:140])), (8, "w" * 400_000)], "item_id long, text string")
    hits = {x["doc_id"]: (x["n_hit"], x["items"]) for x in contamination(frame(spark, rows), items).collect()}
    assert hits == {1: (40, ["7"]), 2: (40, ["7"]), 3: (1, ["8"]), 4: (0, [])}


def test_substring_dedup_edges(spark):
    assert dedup_substrings(frame(spark, [])).collect() == []
    text = " ".join(f"v{k}" for k in range(25))
    got = dedup_substrings(frame(spark, [(4, text), (4, text), (None, text), (2, None)]), carry=True, keep_untouched=True).collect()
    assert sorted((r["n_removed"] for r in got if r["doc_id"] == 4)) == [0, 25]
    assert [r["n_removed"] for r in got if r["doc_id"] is None] == [25]
    assert [(r["n_words"], r["kept_text"], r["carried"]["rep"], r["carried"]["chunk"]) for r in got if r["doc_id"] == 2] == [(0, None, "r", 1)]
    with pytest.raises(ValueError, match="power of two"):
        dedup_substrings(frame(spark, []), min_words=20, base_words=3)


def test_overlapping_repeats_within_a_text(spark):
    text = " ".join(["q"] * 45)
    (r,) = dedup_substrings(frame(spark, [(1, text)])).collect()
    assert (r["n_removed"], r["kept_text"]) == (44, "q")


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_hits(rows, items, window=13):
    phrases = defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t or ""))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases[tuple(w[k : k + window])].add(i)
    out = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        hit, found = [False] * len(w), set()
        for size in {len(p) for p in phrases}:
            for k in range(len(w) - size + 1):
                if (p := tuple(w[k : k + size])) in phrases:
                    found |= phrases[p]
                    hit[k : k + size] = [True] * size
        out[i] = (len(w), sum(hit), sorted(str(x) for x in found if x is not None), hit)
    return out


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"segment_bytes": 700}), (3, {"query_bytes": 150, "segment_bytes": 2000}), (4, {"window": 4})])
def test_contamination(spark, seed, options):
    rows = made_up(seed, words=40)
    r = random.Random(seed)
    items = []
    for k in range(12):
        w = (rows[r.randrange(len(rows))][1] or "").split()
        at = r.randrange(len(w) + 1)
        items.append((k, " ".join(w[at : at + r.randrange(40)])))
    items += [(20, None), (21, "  !"), (22, "w1"), (None, " ".join((rows[0][1] or "w2 w3").split()[:20])), (9, items[0][1])]
    want = brute_hits(rows, items, options.get("window", 13))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(frame(spark, rows), table, **options).collect()
    assert len(got) == len(rows)
    for x in got:
        n, hits, found, hit = want[x["doc_id"]]
        cover = [False] * n
        for s in x["spans"]:
            cover[s["start"] : s["end"]] = [True] * (s["end"] - s["start"])
        assert (x["n_words"], x["n_hit"], x["items"], cover) == (n, hits, found, hit)


def test_a_query_block_stays_small():
    """What goes to the executors is less than five bytes a byte of benchmark text."""
    r = random.Random(2)
    texts = [" ".join(f"{r.randrange(10**6):x}" for _ in range(400)) for _ in range(500)]
    assert len(pickle.dumps(Phrases.of(texts, 13))) < 5 * sum(map(len, texts))


def test_contamination_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(frame(spark, []), none).collect() == []
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(frame(spark, []), one).collect() == []
    got = contamination(frame(spark, [(1, "a b"), (1, "a b"), (None, "x A-B y"), (2, None)]), one).collect()
    assert sorted(((r["doc_id"], r["n_hit"], r["items"]) for r in got), key=str) == sorted([(1, 2, ["1"]), (1, 2, ["1"]), (None, 2, ["1"]), (2, 0, [])], key=str)
    assert [r["n_hit"] for r in contamination(frame(spark, [(1, "a b")]), none).collect()] == [0]


def test_phrases_and_proximity(spark):
    index = build_index(frame(spark, [(1, "the cat sat on the mat"), (2, "On the mat, the cat sat."), (3, None), (4, "mat x x x cat")]), segment_bytes=30)
    found = lambda df: sorted(map(tuple, df.collect()))
    assert found(phrase_matches(index, "the CAT sat")) == [(1, 0), (2, 3)]
    assert found(phrase_matches(index, "")) == []
    assert found(phrase_matches(index, "no such")) == []
    assert found(proximity_matches(index, "mat cat", span=3)) == [(2, 2, 5)]
    assert found(proximity_matches(index, "cat mat", span=5)) == [(1, 1, 6), (2, 2, 5), (4, 0, 5)]


def test_queries_return_the_contract(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in queries.op5_ngram_jaccard(spark, sf_dir).collect()}
    assert got == brute_components(docs)
    want = brute_dedup(docs)
    got6 = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op6_substring_dedup(spark, sf_dir).collect()}
    assert got6 == {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t, _) in want.items()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = brute_hits(docs, items)
    for r in queries.op8_benchmark_decontamination(spark, sf_dir).collect():
        n, k, found, _ = hits[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, k, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), k > 0 and 20 * k >= n)


def test_a_hot_group_is_cut_into_pieces(spark):
    """Near copies of one text, more than a block holds: every link is found and counted once."""
    r = random.Random(9)
    base = [f"h{k}" for k in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        w[r.randrange(60)] = f"e{i % 7}"
        rows.append((i, " ".join(w)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["n_links"]) for x in jaccard_components(frame(spark, rows), block_sets=16).collect()}
    assert got == brute_components(rows)
    assert spark.conf.get("spark.checkpoint.dir") and F
