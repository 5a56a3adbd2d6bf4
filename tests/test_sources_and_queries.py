import dataclasses
import io
import os
import re
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row

import __spark_entry__ as entry
from quillgraph import catalog
from quillgraph.plans.engines import RuleEngine
from quillgraph.sinks.persist import list_graphs
from quillgraph.sources import ingest
from quillgraph.streaming import documents as streams

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    for name, content in (("a.txt", b"plain \xc3\xa9"), ("b.b.MD", b"# head"), ("c.docx", docx("one", "two")), ("d.pdf", b"p1|p2"), ("e.html", b"<p>"), ("f.docx", b"broken"), ("g.odt", b"x"), ("noext", b"x")):
        (tmp_path / name).write_bytes(content)
    docs, errors = ingest.read_files(spark, str(tmp_path), pdf=lambda b: [[p, " x "] for p in b.decode().split("|")] + [[" "]])
    got = {r["title"]: r["text"] for r in docs.collect()}
    assert got == {"a": "plain é", "b.b": "# head", "c": "one\n\ntwo\n\n", "d": "p1 x\n\np2 x", "e": "<p>"}
    assert {os.path.basename(r["path"]): r["error"].split(":")[0] for r in errors.collect()} == {"f.docx": "BadZipFile", "g.odt": "there is no reader for odt files", "noext": "there is no reader for noext files"}
    docs, errors = ingest.read_files(spark, str(tmp_path), text_extensions=("txt", "md", "odt"))
    assert "g" in {r["title"] for r in docs.collect()} and any("decoder" in r["error"] for r in errors.collect())
    assert any("decoder" in r["error"] for r in ingest.read_files(spark, str(tmp_path), pdf=None)[1].collect())
    with pytest.raises(Exception, match="no reader|zip|decoder"):
        ingest.read_files(spark, str(tmp_path), strict=True)[0].collect()
    assert {r["title"] for r in ingest.read_texts(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.b.MD")]).collect()} == {"a", "b.b"}


def test_simple_pdf_files(spark, sf_dir):
    made = catalog._pdf("one text", "", "né")
    assert ingest.simple_pdf_pages(made) == [["one text"], [""], ["né"]]
    for bad in (b"hello", made.replace(b"/FlateDecode", b"/LZWDecode"), made.replace(b"/Contents", b"/Content_"), catalog._pdf("a) Tj [(b) 3 (c)] TJ (d"), catalog._pdf(r"a\\050")):
        with pytest.raises(ValueError):
            ingest.simple_pdf_pages(bad)
    rows = catalog.ingested_files(spark, sf_dir).collect()
    assert len(rows) == 25 and not any("PDF" in (r["error"] or "") for r in rows)


def test_pasted_text(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "  "), (3, None)], "doc_id long, text string")
    docs, errors = ingest.pasted(rows)
    assert [r["doc_id"] for r in docs.collect()] == [1] and sorted(r["doc_id"] for r in errors.collect()) == [2, 3]
    with pytest.raises(Exception, match="blank"):
        ingest.pasted(rows, strict=True)[0].collect()
    assert ingest.sample_documents(spark).count() == 1


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Ada wrote note {i}. Bob read it.", "en", "s", 1) for i in range(6)], streams.DOCUMENTS)
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.stream_documents(spark, str(tmp_path / "in"), files_per_trigger=2)
    q = streams.stream_chunks(stream).writeStream.format("memory").queryName("chunks_seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert spark.table("chunks_seen").count() == 6
    q = streams.stream_graphs(stream, RuleEngine(), str(tmp_path / "store"), str(tmp_path / "c2"), fuzzy=False)
    q.awaitTermination()
    assert sum(r["node_count"] for r in list_graphs(spark, str(tmp_path / "store")).collect()) == 6 * 4


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).take(5)
    assert rows and rows[0]["weight"] >= rows[-1]["weight"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def one_graph():
    """The mapped graphs of a table folder are made once; each query gets its own handle."""
    made, make = {}, {name: getattr(catalog, name) for name in ("mapped_graph", "ranked_graph")}

    def once(name):
        def cached(spark, sf_dir):
            if (name, sf_dir) not in made:
                made[name, sf_dir] = make[name](spark, sf_dir)
            return dataclasses.replace(made[name, sf_dir])

        return cached

    for name in make:
        setattr(catalog, name, once(name))
    yield
    for name, f in make.items():
        setattr(catalog, name, f)


@pytest.mark.usefixtures("one_graph")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    key = lambda row: tuple(repr(v) for v in row)
    clean = lambda v: round(v, 7) if isinstance(v, float) else v
    got = sorted((tuple(clean(r[c]) for c in columns) for r in df.collect()), key=key)
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(clean(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=key)
    assert got == want


def test_native_and_batched_chunks_agree(spark, sf_dir):
    rows = lambda f: sorted(map(tuple, f(spark, sf_dir).select("doc_id", "chunk_index", "text", "token_estimate").collect()))
    assert rows(catalog.chunks_small) == rows(catalog.chunks_native)


def test_converged_ranks(spark, sf_dir):
    g = catalog.mapped_graph(spark, sf_dir)
    ids, links, want = {}, {}, {}
    for r in g.nodes.select("doc_id", "id").collect():
        ids.setdefault(r["doc_id"], []).append(r["id"])
    for r in g.edges.select("doc_id", "source", "target", "weight").collect():
        links.setdefault(r["doc_id"], []).append((r["source"], r["target"], r["weight"]))
    for d, names in ids.items():
        place = {v: i for i, v in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        for s, t, w in links.get(d, ()):
            m[place[t], place[s]] += w
        total = m.sum(0)
        m = np.where(total > 0, m / np.where(total > 0, total, 1), 1 / len(names))
        exact = np.linalg.solve(np.eye(len(names)) - 0.85 * m, np.full(len(names), 0.15 / len(names)))
        want |= {(d, v): x for v, x in zip(names, exact, strict=True)}
    got = {(r["doc_id"], r["id"]): r["rank"] for r in entry.queries()["pagerank_converged"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-4


def brute_edges(text):
    """Chunks, a proposition a sentence, clusters by key, fuzzy links, components in first-seen order, and edges, all in plain loops."""
    from test_graphs import plain_jaro_winkler

    from quillgraph.operators.chunking import chunk_text  # held against SQL by its own queries

    said = []
    for _, chunk, _ in chunk_text(text):
        for sentence in re.findall(r"[^.!?]+[.!?]?", chunk):
            words = [w for w in re.split(r"[\s,;:()\"“”]+", sentence.rstrip(".!?")) if w]
            if len(words) > 2:
                said.append((words[0], " ".join(words[1:-1]), words[-1]))
    key = lambda w: " ".join("".join(c if c.isalpha() or c.isnumeric() or c.isspace() else " " for c in re.sub(r"^(the|a|an)\s+", "", w.lower())).split())
    keys = list(dict.fromkeys(k for s, _, o in said for k in (key(s), key(o)) if k))
    entity = {k: i for i, k in enumerate(keys)}
    changed = True
    near = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if plain_jaro_winkler(a, b) >= 0.92]
    while changed:
        changed = False
        for a, b in near:
            low = min(entity[a], entity[b])
            changed |= entity[a] != low or entity[b] != low
            entity[a] = entity[b] = low
    number = {e: f"n{i}" for i, e in enumerate(sorted(set(entity.values())))}
    weight = {}
    for s, p, o in said:
        if key(s) and key(o):
            place = (number[entity[key(s)]], number[entity[key(o)]], p)
            weight[place] = weight.get(place, 0) + 1
    return {(f"e{i}", *place, n) for i, (place, n) in enumerate(weight.items())}


def test_rule_graph_by_brute_force(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) BETWEEN 200 AND 1500").orderBy("doc_id").limit(12).collect()
    rows += [Row(doc_id=9001, text="Lighthouse guards harbours. Lighthouses guards harbour! -- is -. Gull eats fish", lang="en", source="s", n_chars=1), Row(doc_id=9002, text=None, lang=None, source=None, n_chars=None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in catalog.laid_out(spark, str(tmp_path)).collect()}
    got = {}
    for r in catalog.rule_graph(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], set()).add((r["id"], r["source"], r["target"], r["label"], r["weight"]))
    assert got == {i: e for i, t in texts.items() if t and (e := brute_edges(t))}
    assert got[9001] == {("e0", "n0", "n1", "guards", 2), ("e1", "n2", "n3", "eats", 1)}
