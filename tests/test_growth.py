"""Steps that took too long on large tables: what they must no longer do, with the same results."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quillgraph import catalog
from quillgraph.operators import graph as G
from quillgraph.operators import similarity as S
from quillgraph.operators.components import components
from quillgraph.operators.graph import KnowledgeGraph
from quillgraph.operators.resolution import mentions_of
from quillgraph.plans.engines import RuleEngine
from quillgraph.plans.pipeline import NamesSeen, run_pipeline
from quillgraph.session import CLEANUP, saved, saved_tables, shuffles_go
from quillgraph.sinks import export as X
from quillgraph.sinks import files


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_lists_of_notes_are_sorted_without_a_lambda(spark):
    """A proposition behind two edges of a node is one claim, where it came first; claims and relations stand in order."""
    nodes = spark.createDataFrame([(1, f"n{i}", f"N{i}", "person", [], 1, 2, 0.5, [0]) for i in range(3)], "doc_id long, id string, label string, type string, aliases array<string>, mentions long, degree long, rank double, source_chunks array<int>")
    edges = spark.createDataFrame([(1, f"e{k}", "n0", f"n{1 + k % 2}", f"r{k}", 1, [f"c{k}", "c2", "c0"]) for k in range(12)], "doc_id long, id string, source string, target string, label string, weight long, propositions array<string>")
    claims = spark.createDataFrame([(1, f"c{k}", f"claim {k}", 0) for k in range(12)], "doc_id long, id string, text string, source_chunk int")
    graph = KnowledgeGraph(nodes, edges, claims)
    got = {r["line"]: (r["ord"]["e"], r["ord"]["k"]) for r in X.vault_claims(graph).collect()}
    assert got == {"- claim 0": (0, 0), "- claim 2": (0, 1)} | {f"- claim {k}": (k, 0) for k in range(1, 12) if k != 2}
    notes = X.vault_notes(graph)
    text = {r["id"]: r["content"] for r in notes.collect()}["n0"]
    at = [text.index(f"- r{k} [[") for k in range(12)] + [text.index(f"- claim {k}\n") for k in (0, 2, 1, *range(3, 12))]
    assert at == sorted(at)
    assert "array_sort(" not in _plan(notes) and "SortAggregate" not in _plan(X.vault_claims(graph))


def test_lines_are_parsed_once_and_written_by_runs(spark, sf_dir):
    parts = catalog.portable_json_parts(spark, sf_dir)
    assert {r["part"] for r in parts.select("part").distinct().collect()} == {"node", "edge", "proposition", "file"}
    assert "from_json" not in _plan(parts)  # stored as parsed
    rows = [("a", 1, ",", "x"), ("a", 1, ",", "y"), ("a", 2, ";", "z"), ("b", 2, ";", "v"), ("b", 2, ";", "w")]
    batch = pa.RecordBatch.from_pydict(dict(zip(("name", "section", "glue", "text"), map(list, zip(*rows, strict=True)), strict=True)))
    assert list(files._runs(batch)) == [("a", 1, ",", ["x", "y"]), ("a", 2, ";", ["z"]), ("b", 2, ";", ["v", "w"])]
    assert list(files._runs(batch[:0])) == []


def test_vectors_without_structure_go_to_tiles(spark, monkeypatch):
    """Cells are left where they spare little; links join what pairs join, by fewer rows."""
    monkeypatch.setattr(S, "PIECE", 25)
    r = np.random.RandomState(7)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    frame = lambda x: spark.createDataFrame([(None, "x", i, str(i), v.tolist()) for i, v in enumerate(x)], "doc_id long, type string, first_seq long, key string, embedding array<double>")
    wild, near = unit(r.randn(600, 16)), unit(r.randn(6, 16)[np.arange(600) % 6] + 0.05 * r.randn(600, 16))
    for rows, threshold, spare in ((wild, 0.6, False), (near, 0.9, True)):
        clusters = frame(rows)
        _, large, sizes = S._split_blocks(clusters)
        assert S._cells_spare(*S._pivots(large, sizes), threshold) == spare
        i, j = np.nonzero(np.triu(rows @ rows.T >= threshold, 1))
        pairs = S.cosine_pairs(clusters, threshold=threshold)
        links = S.cosine_links(clusters, threshold=threshold)
        assert sorted((x["a"], x["b"]) for x in pairs.collect()) == sorted(zip(i.tolist(), j.tolist(), strict=True))
        assert all(x["a"] < x["b"] for x in links.collect()) and links.count() < len(i)
        both = [sorted((x["node"], x["component"]) for x in components(e.withColumn("doc_id", e["type"]), by=["doc_id"]).collect()) for e in (pairs, links)]
        assert both[0] == both[1] and both[0]


def test_vectors_are_read_without_objects():
    column = pa.chunked_array([pa.array([[9.0, 9.0], [1.0, 2.0]]).slice(1), pa.array([[3.0, 4.0]])])
    assert S._matrix(column).tolist() == [[1, 2], [3, 4]] and S._matrix(column.chunk(0)).tolist() == [[1, 2]] and len(S._matrix(column.slice(0, 0))) == 0
    linked = S._Linked(6)
    linked.add(np.array([4, 2, 1]), np.array([5, 4, 3]))
    linked.add(np.array([5]), np.array([0]))
    assert linked.label.tolist() == [0, 1, 0, 1, 0, 0]


def test_names_of_one_template_meet_in_short_lists():
    names = [f"vector {i}" for i in range(10_000, 13_000)]
    filed, looked_up = Counter(), Counter()
    for name in names:
        for signature, _, is_filed in S.index_entries(name, 0.97):
            (filed if is_filed else looked_up)[signature] += 1
    assert sum(n * looked_up[k] for k, n in filed.items()) < len(names) ** 2 / 10
    assert sum(filed.values()) + sum(looked_up.values()) < 80 * len(names)


def test_names_are_indexed_by_many_tasks(spark, monkeypatch):
    """Names are short, so Spark would merge all their partitions into one."""
    monkeypatch.setattr(S, "SMALL", 3)
    rows = [(1, f"{chr(97 + i % 26)}{i:04d}", "x", i) for i in range(400)] + [(2, "one", "x", 1), (2, "ones", "x", 2)]
    pairs = S.jaro_winkler_pairs(spark.createDataFrame(rows, "doc_id long, key string, type string, first_seq long"), threshold=0.93)
    found = {(r["doc_id"], r["a"], r["b"]) for r in pairs.collect()}
    assert (2, 1, 2) in found and len(found) == pairs.count()
    assert "REPARTITION_BY_NUM" in _plan(pairs)


def _rank_tables(spark) -> int:
    return sum("/ranks-" in path for path in saved_tables(spark))


def test_nodes_that_no_edge_enters_take_no_rounds(spark, monkeypatch):
    """A large graph of which edges enter a small part goes to a worker, with the ranks of the whole; lone nodes, loops and both tolerances too."""
    r = np.random.RandomState(5)
    pairs = sorted({(f"s{r.randint(300)}", f"t{r.randint(9)}") for _ in range(900)} | {("t0", "t1"), ("t1", "t2"), ("t2", "t0"), ("t3", "t3"), ("s1", "s1"), ("s2", "s3")})
    edges = spark.createDataFrame([(1, a, b, 1 + (len(a) + int(b[1:])) % 3) for a, b in pairs] + [(2, "a", "b", 1)], "doc_id long, source string, target string, weight long")
    nodes = spark.createDataFrame([(1, x) for x in sorted({x for p in pairs for x in p} | {"alone", "lone"})] + [(2, "a"), (2, "b")], "doc_id long, id string")
    ranks = lambda df: {(x["doc_id"], x["id"]): x["rank"] for x in df.collect()}
    for options in ({}, {"tolerance": 1e-12}, {"rounds": 3, "exact_rounds": True}, {"weighted": False}):
        whole = ranks(G.pagerank(nodes, edges, **options))
        with monkeypatch.context() as m:
            m.setattr(G, "pagerank_rounds", None)  # not needed
            assert ranks(G.pagerank(nodes, edges, local_edges=40, **options)) == pytest.approx(whole, abs=1e-12)
    far = {"rounds": 3, "exact_rounds": True}
    assert ranks(G.pagerank(nodes, edges, local_edges=4, **far)) == pytest.approx(ranks(G.pagerank(nodes, edges, **far)), abs=1e-12)


def test_rounds_over_pieces_and_blocks(spark, monkeypatch):
    """Ranks in many pieces and edges in many blocks; a round's table goes when the next is there."""
    monkeypatch.setattr(G, "BLOCK_EDGES", 40)
    r = np.random.RandomState(6)
    pairs = sorted({(int(a), int(b)) for a, b in r.randint(0, 300, (900, 2))})
    edges = spark.createDataFrame([(1, f"n{a}", f"n{b}", 1 + a % 3) for a, b in pairs], "doc_id long, source string, target string, weight long")
    nodes = spark.createDataFrame([(1, f"n{k}") for k in range(310)], "doc_id long, id string")
    before = _rank_tables(spark)
    got = {x["id"]: x["rank"] for x in G.pagerank_rounds(nodes, edges).collect()}
    assert got == pytest.approx({x["id"]: x["rank"] for x in G.pagerank(nodes, edges).collect()}, abs=1e-12)
    assert _rank_tables(spark) - before <= 1
    target = np.array([3, 1 << G.PIECE_BITS, 3, (1 << G.PIECE_BITS) + 5])
    block = G._packed(pa.table({"doc_id": [1] * 4, "id": [0] * 4, "source": [0, 1, 1, 1], "target": target, "share": [0.5, 0.25, 1.0, 0.75]})).append_column("rank", G._blob(np.array([2.0, 4.0])))
    found = [(b["id"][0].as_py(), *(G._of_blob(b, c, 0, k).tolist() for c, k in (("at", np.int32), ("given", float)))) for b in G._giving(block.to_batches())]
    assert found == [(0, [3], [5.0]), (1, [0, 5], [1.0, 3.0])]


def test_the_schema_is_broadcast_not_the_replies(spark, sf_dir):
    """Whatever side Spark takes for small by its table's size: the driver must not gather the objects of all replies."""
    counted = catalog.strict_objects(spark, sf_dir)
    assert counted.count() == 4
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, .*rightHint=\(strategy=broadcast\)", plan)


def test_places_of_large_tables(spark, sf_dir, tmp_path):
    """Orders whose keys pass 2^31 / 64 gave no graph at all; places of neighbouring chunks stay apart and in order."""
    for name in catalog._TABLES:
        given = catalog.table(spark, sf_dir, name)
        given = given.withColumn("l_orderkey", F.col("l_orderkey") + 900_000_000) if name == "lineitem" else given
        given.write.parquet(str(tmp_path / f"{name}.parquet"))
    count = lambda at: catalog.edge_detail(spark, at).agg(F.sum("weight"), F.sum("supporting"), F.sum(F.size(F.split("claims", r"\|"))), F.count("*")).first()
    assert count(str(tmp_path)) == count(sf_dir)
    mention = ("name", "other")
    rows = [(1, c, p, "p", "t", mention, "is", mention, None) for c in (0, 1, 2) for p in (0, (1 << 32) - 1, 1 << 32, 3 << 33)]
    given = spark.createDataFrame(rows, "doc_id long, chunk_index int, pos long, local_id string, text string, subject struct<name:string,type:string>, predicate string, object struct<name:string,type:string>, confidence double")
    seq = [(r["chunk_index"], r["seq"]) for r in mentions_of(given).orderBy("seq").collect()]
    assert len({s for _, s in seq}) == 2 * len(rows) and [c for c, _ in seq] == sorted(c for c, _ in seq)
    assert [r["gid"] for r in G.with_global_ids(given).orderBy("ord").collect()] == [f"c{c}-p-{p}" for _, c, p, *_ in rows]
    with pytest.raises(Exception, match="no place for chunk 0, proposition 68719476736"):
        mentions_of(given.withColumn("pos", F.lit(1 << 36))).filter("chunk_index = 0").collect()


def test_names_told_cost_no_copy_of_all():
    """The last names by first sight, as a slice of all would have them, kept as they come."""
    r = np.random.RandomState(2)
    for carry in (0, 1, 20):
        seen, plain = NamesSeen(carry, ["a", "b", "a"]), {"a": None, "b": None}
        assert seen.new == []
        for _ in range(50):
            found = [{"subject": {"name": f"n{r.randint(40)}"}, "object": {"name": f"n{r.randint(40)}"}} for _ in range(2)]
            seen.add_ends(found)
            for p in found:
                plain.setdefault(p["subject"]["name"])
                plain.setdefault(p["object"]["name"])
            assert list(seen.last) == (list(plain)[-carry:] if carry else [])
        assert seen.new == list(plain)[2:] and len(seen.last) <= carry


def test_a_run_keeps_no_tables_or_shuffles_that_are_used_up(spark):
    """Chunks and outcomes hold the texts again: they go once propositions are stored, and shuffles once a table is written."""
    docs = spark.createDataFrame([(d, f"Alpha {d} likes beta. Gamma knows delta {d}.", None) for d in range(20)] + [(20, None, "t")], "doc_id long, text string, title string")
    before = set(saved_tables(spark))
    graph = run_pipeline(docs, RuleEngine(), rank=False, fuzzy=False)
    left = {path.split("/")[-1].rsplit("-", 1)[0] for path in set(saved_tables(spark)) - before}
    assert {"propositions", "chunk-status", "edges"} <= left and not left & {"chunks", "outcomes", "edge-ends", "edge-places"}
    assert sorted((r["doc_id"], r["chunk_count"]) for r in graph.meta.collect()) == [*((d, 1) for d in range(20)), (20, 0)]
    assert graph.propositions.count() == 40 and graph.edges.count() == 40 and graph.reports["chunk_status"].count() == 20
    held = spark.conf.get(CLEANUP)
    with shuffles_go(spark):
        assert spark.conf.get(CLEANUP) == "true"
    assert spark.conf.get(CLEANUP) == held
    tracked = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    n = tracked()
    saved(docs.groupBy("doc_id").count(), "counts")
    assert tracked() <= n
