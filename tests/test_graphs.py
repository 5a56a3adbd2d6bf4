import itertools
import json
import math
import random
import xml.etree.ElementTree as ET
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.functions.taxonomy import PROPOSITIONS
from quillgraph.operators import graph as G
from quillgraph.operators import inspect as I
from quillgraph.operators import resolution as R
from quillgraph.operators import similarity as S
from quillgraph.operators.chunking import _utf16
from quillgraph.operators.components import components
from quillgraph.operators.numbering import numbered
from quillgraph.session import release, saved, saved_tables
from quillgraph.sinks import export as X
from quillgraph.sinks import persist as P

MENTIONS = "doc_id long, seq long, chunk_index int, name string, type string"


def mentions(spark, *items):
    return spark.createDataFrame([(1, i, c, n, t) for i, (n, t, c) in enumerate(items)], MENTIONS)


def entities(resolution):
    rows = resolution.entities.collect()
    return [(r["id"], r["label"], r["type"], r["aliases"], r["mentions"], r["source_chunks"]) for r in sorted(rows, key=lambda r: int(r["id"][1:]))]


def plain_jaro_winkler(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    w = max(0, max(len(a), len(b)) // 2 - 1)
    used, pairs = set(), []
    for i, c in enumerate(a):
        for j in range(max(0, i - w), min(len(b) - 1, i + w) + 1):
            if j not in used and b[j] == c:
                used.add(j)
                pairs.append(i)
                break
    m = len(pairs)
    if not m:
        return 0.0
    t = sum(a[i] != b[j] for i, j in zip(pairs, sorted(used), strict=True))
    jaro = (m / len(a) + m / len(b) + (m - t / 2) / m) / 3
    p = len(list(itertools.takewhile(lambda x: x[0] == x[1], zip(a[:4], b[:4], strict=False))))
    return jaro + p * 0.1 * (1 - jaro)


def test_jaro_winkler():
    assert R.jaro_winkler("same", "same") == 1 and R.jaro_winkler("abc", "xyz") < 0.5 and R.jaro_winkler("", "a") == 0
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randrange(14)))
    for _ in range(4000):
        a, b = word(), word()
        want = plain_jaro_winkler(a, b)
        assert R.jaro_winkler(a, b) == pytest.approx(want, abs=1e-12)
        for t in (0.5, 0.8, 0.92):
            got = R.jaro_winkler(a, b, at_least=t)
            assert got == pytest.approx(want, abs=1e-12) if want >= t else got < t


def test_length_filter_loses_no_pair(spark, monkeypatch):
    r = random.Random(2)
    keys = sorted({"".join(r.choice("ab") for _ in range(r.randrange(1, 9))) for _ in range(80)})
    clusters = spark.createDataFrame([(1, k, "other", i, 1) for i, k in enumerate(keys)], "doc_id long, key string, type string, first_seq long, mentions long")
    for small in (256, 1):
        monkeypatch.setattr(S, "SMALL", small)
        for t in (0.4, 0.7, 0.92):
            got = sorted((x["a"], x["b"]) for x in R.jaro_winkler_pairs(clusters, threshold=t).collect())
            assert got == [(i, j) for i, j in itertools.combinations(range(len(keys)), 2) if plain_jaro_winkler(keys[i], keys[j]) >= t]


def listed(keys, threshold, compared=None):
    """Pairs of keys that the lists of their index entries bring together."""
    rows = [(i, k, *e) for i, k in enumerate(keys) for e in S.index_entries(k, threshold)]
    columns = list(zip(*rows, strict=True))
    table = pa.table({"doc_id": [1] * len(rows), "type": ["x"] * len(rows), "first_seq": columns[0], "key": columns[1], "list": columns[2], "prefix": columns[3], "filed": columns[4], "pa": [0] * len(rows), "pb": [0] * len(rows), "piece": [0] * len(rows)})
    i, j, _ = S.listed_pairs(table, threshold, compared)
    seq = table["first_seq"].to_numpy()
    return [tuple(sorted(p)) for p in zip(seq[i].tolist(), seq[j].tolist(), strict=True)]


@pytest.mark.parametrize("threshold", [0.8, 0.92, 0.97])
def test_index_lists_hold_every_similar_pair_once(threshold):
    r = random.Random(int(threshold * 100))
    words = ["".join(r.choice("aeinorst") for _ in range(r.randrange(1, 6))) for _ in range(40)]
    keys = {" ".join(r.choice(words) for _ in range(r.randrange(1, 4))) for _ in range(150)}
    for k in list(keys):  # and each with an edit or two
        for _ in range(r.randrange(3)):
            at = r.randrange(len(k))
            k = k[:at] + r.choice(["", "e", "日", "😀", k[at:][::-1]]) + k[at + 1 :]
            keys.add(k or "e")
    keys = sorted(keys)
    got = listed(keys, threshold)
    want = {(i, j) for i, j in itertools.combinations(range(len(keys)), 2) if plain_jaro_winkler(_utf16(keys[i]), _utf16(keys[j])) >= threshold}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_entries_are_linear_and_few_pairs_are_compared():
    r = random.Random(3)
    names = lambda n: sorted({"".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(n)})
    few, many = names(500), names(4000)
    entries = lambda keys: sum(len(S.index_entries(k)) for k in keys) / len(keys)
    assert abs(entries(few) - entries(many)) < 2 and entries(many) < 150  # they depend on a name's length alone
    compared = []
    listed(many, 0.92, compared)
    assert sum(compared) < len(many) ** 2 / 2 / 5


def test_vectors_are_sent_to_few_cells(spark, monkeypatch):
    """Vectors in groups: most reach few cells but their own; the pairs are those of all pairs."""
    monkeypatch.setattr(S, "PIECE", 40)
    r = np.random.RandomState(4)
    centres = r.randn(24, 32)
    rows = np.array([centres[k % 24] + 0.05 * r.randn(32) * np.linalg.norm(centres[k % 24]) for k in range(960)])
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    clusters = spark.createDataFrame([(None, "x", i, str(i), v.tolist()) for i, v in enumerate(rows)], "doc_id long, type string, first_seq long, key string, embedding array<double>")
    got = sorted((x["a"], x["b"]) for x in R.cosine_pairs(clusters).collect())
    i, j = np.nonzero(np.triu(rows @ rows.T >= 0.83, 1))
    assert got == sorted(zip(i.tolist(), j.tolist(), strict=True)) and len(got) > 15_000
    _, large, sizes = S._split_blocks(clusters)
    sent = S.cosine_cells(large, sizes, 0.83)
    assert sent.filter("member").count() == 960 and sent.count() <= 2.5 * 960
    wild = r.randn(700, 32)  # no structure: all pairs, still none lost or twice
    wild /= np.linalg.norm(wild, axis=1)[:, None]
    frame = spark.createDataFrame([(1, "x", i, str(i), v.tolist()) for i, v in enumerate(wild)], "doc_id long, type string, first_seq long, key string, embedding array<double>")
    i, j = np.nonzero(np.triu(wild @ wild.T >= 0.35, 1))
    assert sorted((x["a"], x["b"]) for x in R.cosine_pairs(frame, threshold=0.35).collect()) == sorted(zip(i.tolist(), j.tolist(), strict=True))


def test_pairs_of_many_tiles(spark, monkeypatch):
    """Lists and cells in pieces of three find the pairs that one matrix finds, each once, and bounds hold."""
    r = random.Random(12)
    keys = sorted({"".join(r.choice("abcdé日😀") for _ in range(r.randrange(1, 8))) for _ in range(60)})
    every = np.array(list(itertools.combinations(range(len(keys)), 2)))
    bounds = S._Names(keys, 0.9).bound(every[:, 0], every[:, 1])
    assert all(R.jaro_winkler(keys[i], keys[j]) <= bound + 1e-12 for (i, j), bound in zip(every.tolist(), bounds.tolist(), strict=True))
    vectors = np.random.RandomState(1).randn(60, 3)
    rows = [(d, k, r.choice(["x", "y"]), i * 10 + d, (vectors[i] / np.linalg.norm(vectors[i])).tolist()) for d in (1, 2) for i, k in enumerate(keys)]
    clusters = spark.createDataFrame(rows, "doc_id long, key string, type string, first_seq long, embedding array<double>")
    found = lambda: [sorted((x["doc_id"], x["a"], x["b"], round(x["similarity"], 9)) for x in f(clusters, threshold=0.8).collect()) for f in (R.jaro_winkler_pairs, R.cosine_pairs)]
    whole = found()
    want = [[], []]
    for p, q in itertools.combinations(sorted(rows, key=lambda x: x[3]), 2):
        if p[0] == q[0] and p[2] == q[2]:
            for out, v in zip(want, (plain_jaro_winkler(_utf16(p[1]), _utf16(q[1])), float(np.dot(p[4], q[4]))), strict=True):
                if v >= 0.8:
                    out.append((p[0], p[3], q[3], round(v, 9)))
    assert whole == [sorted(x) for x in want]
    for name in ("SMALL", "PIECE", "PIVOTS"):
        monkeypatch.setattr(S, name, 3)
    assert found() == whole
    assert [f(clusters.limit(0)).collect() for f in (R.jaro_winkler_pairs, R.cosine_pairs)] == [[], []]


def test_exact_merge_types_and_order(spark):
    found = R.resolve_entities(mentions(spark, ("The Engine", "artifact", 0), ("Ada", "person", 0), ("engine", "artifact", 1), ("engine", "artifact", 2), ("Engine", "concept", 2), ("...", "other", 2)))
    assert entities(found) == [("n0", "engine", "artifact", ["The Engine"], 3, [0, 1, 2]), ("n1", "Ada", "person", [], 1, [0]), ("n2", "Engine", "concept", [], 1, [2])]
    asked = spark.createDataFrame([(1, "an ENGINE!", "artifact"), (1, "engine", "person"), (2, "Ada", "person")], "doc_id long, name string, type string")
    assert {(r["name"], r["id"]) for r in found.ids_for(asked).collect()} == {("an ENGINE!", "n0"), ("engine", None), ("Ada", None)}


def test_fuzzy_merge_is_transitive(spark):
    found = R.resolve_entities(mentions(spark, ("Acme Corporation", "organization", 0), ("Zed", "organization", 0), ("Acme Corporations", "organization", 3), ("Acme Corporations", "organization", 1)))
    assert entities(found) == [("n0", "Acme Corporations", "organization", ["Acme Corporation"], 3, [0, 1, 3]), ("n1", "Zed", "organization", [], 1, [0])]
    a, b, c = "abcdefghij", "abcdefghik", "abcdefghkk"
    chain = R.resolve_entities(mentions(spark, (a, "other", 0), (b, "other", 0), (c, "other", 0)), jaro_winkler_threshold=plain_jaro_winkler(a, b) - 1e-9)
    assert len(entities(chain)) == 1


def test_label_ties(spark):
    (e,) = entities(R.resolve_entities(mentions(spark, ("the cat", "other", 0), ("cat", "other", 0), ("THE cat", "other", 0), ("a  cat", "other", 0))))
    assert e[1] == "the cat" and e[3] == ["cat", "THE cat", "a  cat"]


def test_vectors_and_fallback(spark):
    data = mentions(spark, ("car", "other", 0), ("automobile", "other", 0), ("banana", "other", 0)).union(spark.createDataFrame([(2, 9, 0, "car", "other"), (2, 10, 0, "cars", "other")], MENTIONS))
    vectors = spark.createDataFrame([("car", [1.0, 0.0]), ("automobile", [0.9, 0.43589]), ("banana", [0.0, 1.0])], "key string, embedding array<double>")
    found = R.resolve_entities(data, vectors=vectors, jaro_winkler_threshold=0.9).entities
    assert {(r["doc_id"], r["label"]) for r in found.collect()} == {(1, "automobile"), (1, "banana"), (2, "cars")}  # doc 2 has no vector for cars


def test_embedders(spark):
    data = mentions(spark, ("cat", "other", 0), ("dog", "other", 0), ("dogs", "other", 0))
    labels = lambda make: {r["label"] for r in R.resolve_entities(data, make_embedder=make, jaro_winkler_threshold=0.9).entities.collect()}
    assert len(labels(lambda: lambda keys: [[1.0, 0.0, 0.0]] * len(keys))) == 1
    assert labels(lambda: None) == labels(lambda: lambda keys: 1 / 0) == {"cat", "dogs"}
    near = R.surface_clusters(data).withColumn("embedding", F.when(F.col("key") == "cat", F.array(F.lit(1.0), F.lit(0.0))).when(F.col("key") == "dog", F.array(F.lit(0.8), F.lit(0.6))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    assert [(r["key_a"], r["key_b"]) for r in R.borderline_pairs(near).collect()] == [("cat", "dog")]


def test_resolution_ignores_partitioning(spark):
    r = random.Random(5)
    rows = [(d, i, i % 7, r.choice(["The Cat", "cat", "Cats", "dog", "Dog.", "a dog", "bird"]), r.choice(["other", "concept"])) for d in range(4) for i in range(40)]
    first = sorted(map(str, R.resolve_entities(spark.createDataFrame(rows, MENTIONS)).entities.collect()))
    r.shuffle(rows)
    assert first == sorted(map(str, R.resolve_entities(spark.createDataFrame(rows, MENTIONS).repartition(9)).entities.collect()))


def test_components_and_numbers(spark):
    edges = [(1, i, i + 1) for i in range(30)] + [(1, 100, 101), (2, 5, 4), (2, 9, 9)]
    got = {(r["g"], r["node"]): r["component"] for r in components(spark.createDataFrame(edges, "g int, a long, b long"), by=["g"]).collect()}
    assert got == {(1, i): 0 for i in range(31)} | {(1, 100): 100, (1, 101): 100, (2, 4): 4, (2, 5): 4, (2, 9): 9}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    rows = [(g, (i * 37) % 101) for g in (1, 2) for i in range(101)]
    out = numbered(spark.createDataFrame(rows, "g int, v int").repartition(6), by=["g"], order=["v"], name="k").collect()
    assert all(r["k"] == r["v"] for r in out) and len(out) == 202


# -- graphs -----------------------------------------------------------------------------


def props(spark, *items):
    """(chunk, local id, subject, predicate, object) of document 1."""
    rows, place = [], {}
    for chunk, local, s, p, o in items:
        pos = place[chunk] = place.get(chunk, -1) + 1
        rows.append((1, chunk, pos, local, f"{s} {p} {o}.", (s, "concept"), p, (o, "concept"), None))
    return spark.createDataFrame(rows, PROPOSITIONS)


def test_support_adds_up_by_exact_predicate(spark):
    said = [(4, "a", "Lockkeeper", "opens", "Sluice"), (4, "b", "Lockkeeper", "Opens", "Sluice"), (6, "a", "Towpath", "runs along", "Sluice"), (9, "z", "Lockkeeper", "opens", "Sluice")]
    g = G.assemble_graph(props(spark, *said))
    rows = [(r["id"], r["label"], r["weight"], r["propositions"]) for r in g.edges.orderBy("id").collect()]
    assert rows == [("e0", "opens", 2, ["c4-a-0", "c9-z-0"]), ("e1", "Opens", 1, ["c4-b-1"]), ("e2", "runs along", 1, ["c6-a-0"])]
    assert sorted((r["id"], r["text"], r["source_chunk"]) for r in g.propositions.collect())[-1] == ("c9-z-0", "Lockkeeper opens Sluice.", 9)


def test_rank_of_a_chain_by_hand(spark):
    """Spring -> Brook -> Lake: solved on paper, with the lake's rank spread over all three."""
    g = G.assemble_graph(props(spark, (0, "a", "Spring", "feeds", "Brook"), (0, "b", "Brook", "feeds", "Lake")))
    d = 0.85
    base = 1 / (3 + 2 * d + d * d)  # (1 - d + d * lake) / 3, from the ranks' sum of 1
    want = {"Spring": base, "Brook": base * (1 + d), "Lake": base * (1 + d + d * d)}
    assert {r["label"]: r["rank"] for r in g.nodes.collect()} == pytest.approx(want, abs=1e-5)
    assert {r["label"]: r["degree"] for r in g.nodes.collect()} == {"Spring": 1, "Brook": 2, "Lake": 1}


def test_variants_loops_and_empty_input(spark):
    g = G.assemble_graph(props(spark, (2, "a", "The Tide Table", "lists", "ebb"), (5, "b", "tide  table", "quotes", "TIDE table!"), (5, "c", "--", "lists", "ebb")))
    node = g.nodes.filter("id = 'n0'").first()
    assert (node["mentions"], node["source_chunks"], node["degree"]) == (3, [2, 5], 3)  # the loop counts twice
    assert g.edges.count() == 2 and g.propositions.count() == 3
    nothing = G.assemble_graph(spark.createDataFrame([], PROPOSITIONS))
    assert [x.collect() for x in (nothing.nodes, nothing.edges, nothing.propositions)] == [[], [], []]


def test_ranks_stop_by_one_rule(spark):
    """Worker and distributed rounds stop alike, document by document, at the default tolerance."""
    r = random.Random(7)
    nodes, edges = [], []
    for d, (n, m) in enumerate(((3, 4), (40, 90), (300, 700))):
        nodes += [(d, f"n{k}") for k in range(n)]
        pairs = sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})
        edges += [(d, f"n{a}", f"n{b}", 1 + (a + b) % 3) for a, b in pairs]
    nodes, edges = spark.createDataFrame(nodes, "doc_id long, id string"), spark.createDataFrame(edges, "doc_id long, source string, target string, weight long")
    near = {(x["doc_id"], x["id"]): x["rank"] for x in G.pagerank(nodes, edges).collect()}
    far = {(x["doc_id"], x["id"]): x["rank"] for x in G.pagerank_rounds(nodes, edges).collect()}
    assert far == pytest.approx(near, abs=1e-9)
    alone = {(x["doc_id"], x["id"]): x["rank"] for x in G.pagerank(nodes.filter("doc_id = 1"), edges.filter("doc_id = 1")).collect()}
    assert alone == pytest.approx({k: v for k, v in near.items() if k[0] == 1}, abs=1e-12)


def test_large_graphs_settle_too():
    """The rule asks the same of 100 000 nodes: what is left to move is small beside the ranks' sum of 1."""
    r = np.random.RandomState(1)
    n, m = 100_000, 400_000
    graph_ = (n, r.randint(0, n, m), r.randint(0, n, m), r.rand(m) + 0.5)
    got = G.rank_arrays(*graph_, damping=0.85, tolerance=G.TOLERANCE, rounds=G.MAX_ROUNDS, exact_rounds=False)
    exact = G.rank_arrays(*graph_, damping=0.85, tolerance=0, rounds=150, exact_rounds=True)
    assert np.abs(got - exact).sum() < 1e-5 and np.abs(got / exact - 1).max() < 1e-4


def test_both_ranks_agree(spark):
    r = random.Random(3)
    rows = [(0, f"p{k}", f"n{r.randrange(12)}x{'y' * r.randrange(3)}", "to", f"m{r.randrange(9)}z") for k in range(80)]
    g = G.assemble_graph(props(spark, *rows), fuzzy=False)
    near = {x["id"]: x["rank"] for x in G.pagerank(g.nodes, g.edges, tolerance=1e-12).collect()}
    far = {x["id"]: x["rank"] for x in G.pagerank(g.nodes, g.edges, tolerance=1e-12, local_edges=1).collect()}
    assert far == pytest.approx(near, abs=1e-9) and sum(near.values()) == pytest.approx(1)
    flat = {x["id"]: x["rank"] for x in G.pagerank(g.nodes, g.edges, weighted=False).collect()}
    assert sum(flat.values()) == pytest.approx(1)


# -- inspection and export ---------------------------------------------------------------

NODES = "doc_id long, id string, label string, type string, aliases array<string>, mentions long, degree long, rank double, source_chunks array<int>"
EDGES = "doc_id long, id string, source string, target string, label string, weight long, propositions array<string>"
META = "doc_id long, title string, created_at string, engine string, model string, chunk_count int, token_estimate int"


def small(spark, nodes=None, edges=None):
    """A ferry trade in three nodes: names that need escaping, a node without edges, an edge one of whose claims is unknown."""
    nodes = nodes or [("n0", "Gull & Daughters", ["Gull's"], 7, 0.25), ("n1", 'Ferry "<Nord>"', [], 1, 0.5), ("n2", "Pier", [], 2, 0.25)]
    edges = [("e0", "n0", "n1", "charters", 3, ["c2-q-0", "unknown"])] if edges is None else edges
    return G.KnowledgeGraph(
        spark.createDataFrame([(1, i, label, "organization" if i != "n2" else "location", a, m, 1, r, [2, 3]) for i, label, a, m, r in nodes], NODES),
        spark.createDataFrame([(1, *e) for e in edges], EDGES),
        spark.createDataFrame([(1, "c2-q-0", "Gull & Daughters charters the ferry every June.", 2)], "doc_id long, id string, text string, source_chunk int"),
        spark.createDataFrame([(1, "harbour/ledger", "1999-05-04T03:02:01.000Z", "rule", "m", 4, 777)], META),
    )


def test_details(spark):
    g = small(spark)
    assert {(r["id"], r["relation"]) for r in I.node_detail(g).collect()} == {("n0", '→ charters Ferry "<Nord>"'), ("n1", "← Gull & Daughters charters")}
    d = I.edge_detail(g).first()
    assert (d["source_label"], d["target_label"], d["weight"], d["supporting"], d["claims"]) == ("Gull & Daughters", 'Ferry "<Nord>"', 3, 2, ["Gull & Daughters charters the ferry every June."])
    around, edges = I.ego_network(g, g.nodes.filter("id = 'n1'"))
    assert {r["id"] for r in around.collect()} == {"n0", "n1"} and [r["edge_id"] for r in edges.collect()] == ["e0"]
    s = I.run_summary(g).first()
    assert (s["nodes"], s["edges"], s["chunk_count"]) == (3, 1, 4)
    assert I.visual_nodes(g.nodes, max_label=5).filter("label = 'Gull…'").count() == 1
    assert I.type_color(F.lit("nothing")) is not None


def test_json_files(spark):
    g = small(spark)
    got = json.loads(X.portable_json_text(g, 1, tag="some.tag"))
    assert list(got) == ["format", "version", "nodes", "edges", "meta", "propositions"] and (got["format"], got["version"]) == ("some.tag", 1)
    assert got["nodes"][0] == {"id": "n0", "label": "Gull & Daughters", "type": "organization", "aliases": ["Gull's"], "mentions": 7, "degree": 1, "rank": 0.25, "sourceChunks": [2, 3]}
    assert got["edges"] == [{"id": "e0", "source": "n0", "target": "n1", "label": "charters", "weight": 3, "propositions": ["c2-q-0", "unknown"]}]
    assert got["propositions"][0]["sourceChunk"] == 2 and got["meta"] == {"title": "harbour/ledger", "createdAt": "1999-05-04T03:02:01.000Z", "engine": "rule", "model": "m", "chunkCount": 4, "tokenEstimate": 777}
    elements = json.loads(X.cytoscape_text(g, 1))["elements"]
    assert [x["data"]["id"] for x in elements["nodes"]] == ["n0", "n1", "n2"] and elements["edges"] == [{"data": {"id": "e0", "source": "n0", "target": "n1", "label": "charters", "weight": 3}}]
    g.meta = None
    assert json.loads(X.portable_json_text(g, 1))["meta"] == {} and json.loads(X.portable_json_text(g, 99))["nodes"] == []
    assert json.loads(X.cytoscape_text(small(spark, edges=[]), 1))["elements"]["edges"] == []


def test_canvas(spark):
    canvas = json.loads(X.canvas_text(small(spark), 1))
    first = canvas["nodes"][0]  # the highest rank
    assert (first["id"], first["x"], first["y"], first["width"], first["height"], first["text"]) == ("n1", 240, 0, 232, 60, '**Ferry "<Nord>"**\n_organization · 1 mention_')
    assert [n["id"] for n in canvas["nodes"]] == ["n1", "n0", "n2"] and canvas["nodes"][1]["text"].endswith("7 mentions_") and canvas["nodes"][1]["height"] == 96
    assert canvas["edges"] == [{"id": "e0", "fromNode": "n0", "toNode": "n1", "toEnd": "arrow", "label": "charters"}]
    at = spark.createDataFrame([(1, "n0", 1.5, 2.0), (1, "n1", 3.0, 4.0)], "doc_id long, id string, x double, y double")
    assert {n["id"]: n["x"] for n in json.loads(X.canvas_text(small(spark), 1, positions=at))["nodes"]} == {"n0": 1.5, "n1": 3}


def test_graphml_reads_back(spark):
    text = X.graphml_text(small(spark), 1)
    root = ET.fromstring(text)
    value = lambda x, key: next(d.text for d in x.findall("{*}data") if d.get("key") == key)
    assert [(n.get("id"), value(n, "label"), value(n, "mentions")) for n in root.findall(".//{*}node")] == [("n0", "Gull & Daughters", "7"), ("n1", 'Ferry "<Nord>"', "1"), ("n2", "Pier", "2")]
    assert [(e.get("source"), e.get("target"), value(e, "elabel"), value(e, "weight")) for e in root.findall(".//{*}edge")] == [("n0", "n1", "charters", "3")]
    assert {(k.get("id"), k.get("for"), k.get("attr.name"), k.get("attr.type")) for k in root.findall("{*}key")} >= {("elabel", "edge", "label", "string"), ("rank", "node", "rank", "double")} and root.find("{*}graph").get("edgedefault") == "directed"


def test_vault(spark, tmp_path):
    notes = {r["path"]: r["content"] for r in X.vault_notes(small(spark)).collect()}
    assert set(notes) == {"Gull & Daughters.md", "Ferry Nord.md", "Pier.md"}
    lines = notes["Gull & Daughters.md"].split("\n")
    assert lines[:7] == ["---", "aliases:", '  - "Gull\'s"', "type: organization", "mentions: 7", "degree: 1", "rank: 0.25"]
    assert lines[-8:] == ["## Relationships", "", '- charters [[Ferry Nord|Ferry "<Nord>"]]', "", "## Supporting claims", "", "- Gull & Daughters charters the ferry every June.", ""]
    assert '  - "Ferry \\"<Nord>\\""' in notes["Ferry Nord.md"]
    path = X.export_graph(small(spark), 1, "vault", str(tmp_path))
    assert path.endswith("harbour_ledger-vault.zip") and sorted(zipfile.ZipFile(path).namelist()) == ["Graph/Ferry Nord.md", "Graph/Gull & Daughters.md", "Graph/Pier.md", "Graph/_graph.canvas"]


def test_names_that_collide(spark):
    nodes = [(f"n{k}", label, [], 1, 0.1) for k, label in enumerate(["Buoy", "bUOY", "Buoy (2)", "?", "*"])]
    name = lambda **o: [r["name"] for r in X.unique_names(small(spark, nodes, []).nodes, **o).orderBy("id").collect()]
    assert name() == ["Buoy", "bUOY (2)", "Buoy (2)", "untitled", "untitled (2)"]
    assert len({n.lower() for n in name(distinct=True)}) == 5
    g = small(spark, [("n0", "Buoy", [], 1, 0.1), ("n1", "BUOY", [], 1, 0.1)], [("e0", "n0", "n1", "near", 1, [])])
    assert [r["line"] for r in X.vault_relations(g, X.unique_names(g.nodes)).collect()] == ["- near [[BUOY (2)|BUOY]]"]


def test_drawing(spark):
    at = lambda *rows: spark.createDataFrame([(1, *r) for r in rows], "doc_id long, id string, x double, y double")
    tags = lambda svg, name: ET.fromstring(svg).findall(f".//{{*}}{name}")
    both = X.svg_text(small(spark), 1, at(("n0", 0.0, 0.0), ("n1", 8.0, 6.0)))
    assert len(tags(both, "circle")) == 2 and len(tags(both, "polygon")) == 1
    (line,) = tags(both, "line")
    assert {x.text for x in tags(both, "text")} == {"Gull & Daughters", 'Ferry "<Nord>"', "charters", "organization"}
    # it ends an arrow's length short of the target's circle, of radius 8, at the upper right
    x1, y1, x2, y2 = (float(line.get(k)) for k in ("x1", "y1", "x2", "y2"))
    assert (x1, y1) == (60, 870) and math.dist((x2, y2), (1140, 60)) == pytest.approx(8 + X.HEAD_LENGTH, abs=0.02)
    one = X.svg_text(small(spark), 1, at(("n0", 0.0, 0.0)))
    assert len(tags(one, "circle")) == 1 and not tags(one, "line")
    loop = X.svg_text(small(spark, [("n0", "Eddy", [], 1, 1.0)], [("e0", "n0", "n0", "turns", 1, [])]), 1, at(("n0", 2.0, 2.0)))
    assert len(tags(loop, "line")) == 1 and not tags(loop, "polygon") and ET.fromstring(loop).get("viewBox") == "0 0 1200 1200"


def test_files_by_format(spark, tmp_path):
    for kind, suffix in (("portable-json", ".json"), ("json-canvas", ".canvas"), ("cytoscape", ".cyjs.json"), ("graphml", ".graphml")):
        path = X.export_graph(small(spark), 1, kind, str(tmp_path))
        assert path.endswith(f"harbour_ledger{suffix}") and open(path).read().startswith(("{", "<"))
    with pytest.raises(ValueError, match="no format"):
        X.export_graph(small(spark), 1, "png", str(tmp_path))


def test_saved_graphs(spark, tmp_path):
    store = str(tmp_path / "store")
    assert P.list_graphs(spark, store).collect() == [] and P.load_graph(spark, store, "g-x") is None
    first = P.save_graph(small(spark), store)
    second = P.save_graph(small(spark), store, graph_id="mine")
    listed = P.list_graphs(spark, store).collect()
    assert [r["graph_id"] for r in listed] == [second, first] and (listed[0]["title"], listed[0]["node_count"], listed[0]["edge_count"]) == ("harbour/ledger", 3, 1)
    assert P.load_graph(spark, store, first).nodes.count() == 3
    P.save_graph(small(spark, [("n0", "Mole", [], 1, 1.0)], []), store, graph_id="mine")
    assert P.load_graph(spark, store, "mine").nodes.count() == 1
    P.delete_graph(spark, store, first)
    P.delete_graph(spark, store, first)
    assert P.load_graph(spark, store, first) is None and [r["graph_id"] for r in P.list_graphs(spark, store).collect()] == ["mine"]


def test_saved_tables_go_when_released(spark):
    since = len(saved_tables(spark))
    kept, gone = saved(spark.range(3).toDF("a"), "kept"), saved(spark.range(4).toDF("a"), "gone")
    release(spark, since=since, keep=kept)
    assert kept.count() == 3 and len(saved_tables(spark)) == since + 1
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(gone._quillgraph_path).count()


def test_rounds_exchange_no_edges(spark):
    """Edges and ranks in buckets meet where they lie."""
    from quillgraph.session import saved_in_buckets

    edges = spark.createDataFrame([(k % 3, f"n{k % 7}", f"n{k % 5}", 0.5) for k in range(60)], "doc_id long, id string, target string, share double")
    ranks = spark.createDataFrame([(d, f"n{k}", 0.1) for d in range(3) for k in range(7)], "doc_id long, id string, rank double")
    met = G._sent(saved_in_buckets(ranks, "ranks", ["doc_id", "id"]), saved_in_buckets(edges, "edges", ["doc_id", "id"]))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and met.count() == 60
    assert "Exchange" in G._sent(ranks, edges)._jdf.queryExecution().executedPlan().toString()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("quillgraph_")]


def test_far_canvas_nodes_equal_sql(spark):
    import duckdb

    n = 300_000
    nodes = spark.range(n).selectExpr("1L AS doc_id", "concat('n', id) AS id", "'x' AS label", "'other' AS type", "1L AS mentions", "0.0D AS rank")
    got = X.canvas_nodes(nodes).select("ord", "x", "y").toArrow()  # noqa: F841
    at = "CAST(floor(340 * sqrt(ord + 0.5) * {}(ord * pi() * (3 - sqrt(5))) + 0.5) AS BIGINT)"
    sql = f"SELECT ord, {at.format('cos')}, {at.format('sin')} FROM (SELECT range AS ord FROM range({n}))"
    assert duckdb.sql(f"SELECT count(*) FROM ({sql} EXCEPT SELECT * FROM got)").fetchall() == [(0,)]


def test_forms_are_normalised_once(spark):
    counted = R.form_counts(mentions(spark, ("The A", "x", 0), ("the a", "x", 1), ("The A", "x", 1), ("The A", "x", 1), ("!", "x", 2)))
    assert sorted((r["key"], r["form"], r["n"], r["form_seq"], sorted(r["chunks"])) for r in counted.collect()) == [("a", "The A", 3, 0, [0, 1]), ("a", "the a", 1, 1, [1])]
    above, below = counted._jdf.queryExecution().optimizedPlan().toString().split("Aggregate", 1)
    assert "regexp_replace" in above and "regexp_replace" not in below and "collect_set" not in below.split("Aggregate", 1)[1]
