import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import extraction as X
from quillgraph.plans import engines as E
from quillgraph.plans.pipeline import extract_chunks, outcomes_of_replies, run_pipeline, suggest_titles

GOOD = {"id": "p1", "text": "Ada wrote notes.", "subject": {"name": "Ada", "type": "person"}, "predicate": "wrote", "object": {"name": "notes", "type": "artifact"}}


def reply(*items, **more):
    return json.dumps({"propositions": list(items)} | more)


def parse(spark, replies):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    got = {r["i"]: r["propositions"] for r in X.parse_replies(rows).collect()}
    clean = lambda p: {k: (v.asDict() if hasattr(v, "asDict") else v) for k, v in p.asDict().items() if k != "pos"}
    return [None if got[i] is None else [clean(p) for p in got[i]] for i in range(len(replies))]


def strange_replies():
    variants = [
        GOOD,
        GOOD | {"id": ""},
        {k: v for k, v in GOOD.items() if k != "id"},
        GOOD | {"id": 3},
        GOOD | {"text": "  "},
        GOOD | {"text": " padded "},
        GOOD | {"predicate": 5},
        GOOD | {"subject": "Ada"},
        GOOD | {"subject": ["name"]},
        GOOD | {"subject": {"name": 42, "type": "person"}},
        GOOD | {"subject": {"name": " Ada ", "type": "wizard"}},
        GOOD | {"object": {"name": "x"}},
        GOOD | {"object": {"name": " ", "type": "other"}},
        *[GOOD | {"confidence": c} for c in (0, 1, 0.5, 1.5, -0.1, "0.5", None, True, 1e-3, [1])],
        None,
        3,
        "x",
        [],
        {},
    ]
    out = [reply(v) for v in variants] + [reply(*variants), reply(), ""]
    out += ["not json", "{", "}", "{}", "[]", "null", '{"propositions": {}}', '{"propositions": "x"}', '{"propositions": null}', '{"other": []}', " \n" + reply(GOOD) + "﻿"]
    out += [reply(GOOD) + x for x in (" done", "}", "{}", ",{}", "\n```", "]")] + ["Sure: " + reply(GOOD), "```json\n" + reply(GOOD) + "\n```", reply(GOOD)[:-3], "x{" + reply(GOOD), "{'propositions': []}", '{"propositions": [NaN]}', '{"propositions": [1,]}', '{"propositions": [01]}']
    r = random.Random(4)
    for _ in range(150):
        body = reply(*[r.choice(variants) for _ in range(r.randrange(4))])
        if r.random() < 0.4:
            at = r.randrange(len(body))
            body = body[:at] + r.choice(["", "}", '"', ",", "{", " "]) + body[at + r.randrange(2) :]
        out.append(r.choice(["", "", "Text ", "```"]) + body + r.choice(["", "", " end", "```"]))
    return out


def test_two_validators_agree(spark):
    """The Catalyst expressions and the worker's parser give the same propositions for every reply."""
    replies = strange_replies()
    assert parse(spark, replies) == [E.parse_reply(r) for r in replies]


def test_validation_cases(spark):
    clean, unknown, mixed, fenced, garbage, cut, empty, twice = parse(
        spark,
        [reply(GOOD), reply(GOOD | {"subject": {"name": "Ada", "type": "deity"}}), reply(GOOD, GOOD | {"text": ""}, {k: v for k, v in GOOD.items() if k != "id"}), "Here:\n```json\n" + reply(GOOD) + "\n```", "I can't.", '{"propositions": [', reply(), '{"propositions": [1], "propositions": []}'],
    )
    assert clean[0]["local_id"] == "p1" and clean[0]["confidence"] is None
    assert unknown[0]["subject"]["type"] == "other"
    assert [p["local_id"] for p in mixed] == ["p1", "p3"]
    assert len(fenced) == 1 and garbage is None and cut is None and empty == [] and twice == []


def test_first_valid_of_three(spark):
    rows = [(1, 0, 1, "no"), (1, 0, 2, reply(GOOD)), (1, 0, 3, reply()), (1, 1, 1, "no"), (1, 1, 2, "no"), (1, 1, 3, "no"), (1, 1, 4, reply(GOOD)), (2, 0, 1, reply())]
    got = outcomes_of_replies(spark.createDataFrame(rows, "doc_id int, chunk_index int, attempt int, reply string"))
    by = {(r["doc_id"], r["chunk_index"]): r for r in got.collect()}
    assert [(by[k]["ok"], by[k]["error"], None if by[k]["propositions"] is None else len(by[k]["propositions"])) for k in ((1, 0), (1, 1), (2, 0))] == [(True, None, 1), (False, "no usable reply in 3 tries", None), (True, None, 0)]


def test_prompt(spark):
    rows = spark.createDataFrame([(1, "T", ["A", "B"]), (2, "", []), (3, None, ["A"])], "i int, title string, prior array<string>")
    got = {r["i"]: r["p"] for r in rows.select("i", X.user_prompt(F.lit("chunk"), F.col("title"), F.col("prior")).alias("p")).collect()}
    assert got == {i: X.user_prompt_text("chunk", t, p) for i, t, p in ((1, "T", ["A", "B"]), (2, "", []), (3, None, ["A"]))}
    assert got[1].startswith("From the document: T\n\n") and "A, B" in got[1] and got[2].count("\n\n") == 1


def test_strict_schema():
    strict = X.strict_schema(X.EXTRACTION_SCHEMA)
    assert strict["additionalProperties"] is False and strict["properties"]["propositions"]["items"]["properties"]["subject"]["additionalProperties"] is False
    assert "additionalProperties" not in X.EXTRACTION_SCHEMA


def test_soft_then_fatal(spark):
    rows = [(1, k, k not in (1, 3), {1: "soft", 3: "over"}.get(k), k == 3) for k in range(6)] + [(2, 0, True, None, False)]
    status = X.chunk_status(spark.createDataFrame(rows, "doc_id int, chunk_index int, ok boolean, error string, fatal boolean"))
    assert [(r["state"], r["error"]) for r in status.filter("doc_id = 1").orderBy("chunk_index").collect()] == [("ok", None), ("dropped", "soft"), ("ok", None), ("dropped", "over"), ("skipped", None), ("skipped", None)]
    report = {r["doc_id"]: (r["chunks"], r["dropped_chunks"], r["drop_error"]) for r in X.drop_report(status).collect()}
    assert report == {1: (6, [1, 3, 4, 5], "over"), 2: (1, [], None)}


def test_prior_entities_are_the_last_twenty(spark):
    from quillgraph.functions.taxonomy import PROPOSITIONS

    rows = [(1, k // 5, k % 5, f"p{k}", "t", (f"s{k}", "other"), "is", (f"s{max(0, k - 7)}", "other"), None) for k in range(40)]
    props = spark.createDataFrame(rows, PROPOSITIONS)
    chunks = spark.createDataFrame([(1, k) for k in range(9)] + [(2, 0)], "doc_id long, chunk_index int")
    got = {(r["doc_id"], r["chunk_index"]): r["prior_entities"] for r in X.prior_entities(chunks, props).collect()}
    assert got == {(1, k): [f"s{j}" for j in range(k * 5)][-20:] for k in range(9)} | {(2, 0): []}


# -- engines --------------------------------------------------------------------------


def chat(replies, **options):
    sent, slept, queue = [], [], list(replies)

    def post(url, headers, payload):
        sent.append((url, headers, payload))
        return queue.pop(0)

    return E.ChatEngine("http://x", " key ", options.pop("models", "m"), post=post, sleep=slept.append), sent, slept


def answer(text):
    return E.HttpReply(200, json.dumps({"choices": [{"message": {"content": text}}]}))


def test_chat_retries_with_the_failed_reply():
    engine, sent, _ = chat([answer("nope"), answer(reply(GOOD))])
    assert len(engine.extract("text", E.ChunkContext(0, "T", ["Ada"]))) == 1
    roles = [m["role"] for m in sent[1][2]["messages"]]
    assert roles == ["system", "user", "assistant", "user"] and sent[1][2]["messages"][2]["content"] == "nope"
    assert sent[0][2]["temperature"] == 0 and sent[0][2]["model"] == "m" and sent[0][1]["Authorization"] == "Bearer key"
    engine, _, _ = chat([answer("a"), answer("b"), answer("c")])
    with pytest.raises(ValueError, match="in 3 tries; the last one begins 'c'"):
        engine.extract("text", E.ChunkContext(4))


def test_chat_waits_and_gives_up():
    engine, _, slept = chat([E.HttpReply(429, "", "2"), E.HttpReply(429, "", None), E.HttpReply(429, "", "900"), answer(reply())])
    assert engine.extract("t", E.ChunkContext(0)) == [] and slept == [2.0, 15, 65]
    for status in (401, 402):
        with pytest.raises(E.FatalEngineError):
            chat([E.HttpReply(status, "")])[0].extract("t", E.ChunkContext(0))
    with pytest.raises(E.FatalEngineError, match="429"):
        chat([E.HttpReply(429, "")] * 4)[0].extract("t", E.ChunkContext(0))
    with pytest.raises(RuntimeError, match="status 500"):
        chat([E.HttpReply(500, "down")])[0].extract("t", E.ChunkContext(0))


def test_chat_gives_up_the_schema_once():
    engine, sent, _ = chat([E.HttpReply(400, "response_format unsupported"), answer(reply()), answer(reply())], models=("a", "b"))
    engine.extract("t", E.ChunkContext(0))
    engine.extract("t", E.ChunkContext(1))
    assert ["response_format" in s[2] for s in sent] == [True, False, False] and sent[0][2]["models"] == ["a", "b"] and engine.model == "auto"
    with pytest.raises(RuntimeError, match="400"):
        chat([E.HttpReply(400, "bad model id")])[0].extract("t", E.ChunkContext(0))


def test_registry():
    assert E.create_engine("rule").id == "rule"
    with pytest.raises(ValueError, match="no engine"):
        E.create_engine("none")
    have = E.check_availability({"rule": {}, "chat": {"url": "u", "key": "", "models": "m"}})
    assert have == {"rule": "ready", "chat": "unavailable"}
    assert E.private_engine({"rule": "unavailable", "replay": "ready"}) == "replay" and E.private_engine({}) == "replay" and E.private_engine(have) == "rule"


class Recorder(E.RuleEngine):
    """Tells what it was told, as propositions."""

    def extract(self, chunk, context):
        if "SOFT" in chunk:
            raise ValueError("soft")
        if "FATAL" in chunk:
            raise E.FatalEngineError("fatal")
        return [{"local_id": "p1", "text": "|".join(context.prior_entities) or "none", "subject": {"name": f"s{context.index}", "type": "other"}, "predicate": context.title or "-", "object": {"name": "o", "type": "other"}, "confidence": 0.5}]


def test_extraction_is_in_order_and_stops_at_a_fatal_failure(spark):
    words = ["a", "b", "SOFT", "c", "FATAL", "d"]
    rows = [(1, k, w) for k, w in enumerate(words)] + [(2, 0, "e")]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_index int, text string").repartition(5)
    titles = spark.createDataFrame([(1, "One")], "doc_id long, title string")
    got = {(r["doc_id"], r["chunk_index"]): r for r in extract_chunks(chunks, Recorder(), titles=titles).collect()}
    assert [got[1, k]["ok"] for k in range(6)] == [True, True, False, True, False, False]
    assert [got[1, k]["error"] for k in range(6)] == [None, None, "soft", None, "fatal", None]
    assert got[1, 3]["propositions"][0]["text"] == "s0|o|s1" and got[1, 3]["propositions"][0]["predicate"] == "One" and got[2, 0]["propositions"][0]["predicate"] == "-"


def test_run(spark):
    stages, progress = [], []
    docs = spark.createDataFrame([(1, "Ada wrote the notes. Bob read the notes.\n\nFATAL"), (2, "Eve saw Bob."), (3, None), (4, "SOFT")], "doc_id long, text string")
    g = run_pipeline(docs, Recorder(), target=10, overlap=0, on_stage=stages.append, on_chunks=lambda *a: progress.append(a), created_at="2000-01-01T00:00:00.000Z")
    meta = {r["doc_id"]: r for r in g.meta.collect()}
    assert {i: r["chunk_count"] for i, r in meta.items()} == {1: 2, 2: 1, 3: 0, 4: 1} and meta[2]["title"] == "Eve saw Bob" and meta[3]["title"] is None
    assert {r["doc_id"]: r["dropped_chunks"] for r in g.reports["drops"].collect()} == {1: [1], 2: [], 4: [0]}
    assert {(r["doc_id"], r["label"]) for r in g.nodes.collect()} == {(1, "s0"), (1, "o"), (2, "s0"), (2, "o")}
    assert progress[-1] == (4, 4) and all(a < b for a, b in zip(progress, progress[1:], strict=False)) and stages[-1] == "done"


class Slow(E.RuleEngine):
    def extract(self, chunk, context):
        time.sleep(1.5)
        return super().extract(chunk, context)


def test_progress_while_chunks_are_tried(spark):
    progress = []
    docs = spark.createDataFrame([(k, f"Gulls follow boat {k}.") for k in range(6)], "doc_id long, text string")
    run_pipeline(docs, Slow(), rank=False, fuzzy=False, on_chunks=lambda *a: progress.append(a))
    assert progress[-1] == (6, 6) and len(progress) > 1 and 0 < progress[0][0] < 6


def test_titles(spark):
    docs = spark.createDataFrame([(1, "Given", "x"), (2, None, "some text"), (3, "", "y")], "doc_id long, title string, text string")
    assert {r["doc_id"]: r["title"] for r in suggest_titles(docs, E.ReplayEngine({}, title='"Named."\nmore')).collect()} == {1: "Given", 2: "Named", 3: "Named"}
    assert {r["doc_id"]: r["title"] for r in suggest_titles(docs, E.ReplayEngine({})).collect()} == {1: "Given", 2: None, 3: None}


def test_replay_and_rule_engines(spark):
    engine = E.ReplayEngine({0: ["bad", reply(GOOD)], 1: [ValueError("down")]})
    chunks = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 2, "z")], "doc_id long, chunk_index int, text string")
    got = {r["chunk_index"]: (r["ok"], r["error"]) for r in extract_chunks(chunks, engine).collect()}
    assert got[0] == (True, None) and got[1] == (False, "down") and got[2][1].startswith("no usable reply for chunk 2 in 3 tries")
    long = " ".join(f"w{k}" for k in range(40))
    every = E.RuleEngine().extract(f"{long}. One two three! Four five. And the last one", E.ChunkContext(0))
    assert [(p["text"], p["subject"]["name"], p["object"]["name"]) for p in every] == [(f"{long}.", "w0", "w39"), ("One two three!", "One", "three"), ("And the last one", "And", "one")]
    assert [p["local_id"] for p in E.RuleEngine(max_words=12).extract(f"{long}. One two three", E.ChunkContext(0))] == ["p1"]
    (p,) = E.RuleEngine().extract("Ada wrote the first notes. Yes.", E.ChunkContext(0))
    assert (p["subject"]["name"], p["predicate"], p["object"]["name"]) == ("Ada", "wrote the first", "notes")


def test_replies_are_parsed_once_on_all_cores(spark, sf_dir):
    from quillgraph import catalog

    rows = catalog.replies(spark, sf_dir)
    assert rows.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism  # the table is one split
    plan = X.parse_replies(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson(") == 1
    plan = catalog.strict_objects(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson(") == 1


def test_table_functions_make_no_arrow_batch_a_row(spark):
    from quillgraph.functions import sql

    sql.register(spark)
    plan = spark.sql("SELECT p.* FROM VALUES ('{\"propositions\":[]}') r(reply), LATERAL parse_reply(r.reply) p")
    assert "ArrowEval" not in plan._jdf.queryExecution().executedPlan().toString() and plan.count() == 1
