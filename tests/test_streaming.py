"""Extraction of streams: state carried over micro-batches, held against the batch run."""

import random

from quillgraph.catalog import FailingEngine
from quillgraph.operators.extraction import chunk_status
from quillgraph.plans.engines import RuleEngine
from quillgraph.plans.pipeline import ChunksTried, extract_chunks
from quillgraph.sources.ingest import stream_files
from quillgraph.streaming.carry import start_extraction

CHUNKS = "doc_id long, chunk_index int, text string, title string, last boolean"


def made_chunks(seed, docs=6, most=14):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 4)))
    sentence = lambda: " ".join(word() for _ in range(r.randrange(2, 8))) + "."
    return [(d, k, " ".join(sentence() for _ in range(r.randrange(0, 5))), r.choice([None, "t"]), False) for d in range(docs) for k in range(r.randrange(1, most))]


def streamed(spark, tmp_path, batches, engine, name="s"):
    """Outcomes after each list of files has come, each file a list of chunks."""
    out = []
    for files in batches:
        for rows in files:
            spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        start_extraction(spark, str(tmp_path / name / "in"), str(tmp_path / name / "out"), str(tmp_path / name / "checkpoint"), engine, schema=CHUNKS, files_per_trigger=2, carry=5).awaitTermination()
        out.append(spark.read.parquet(str(tmp_path / name / "out")).collect())
    return out


def test_shuffled_stream_equals_the_batch_run(spark, tmp_path):
    rows = made_chunks(1)
    shuffled = rows + rows[::5] + [(None, 0, "no id here.", None, False), (1, None, "no number here.", None, False)]
    random.Random(2).shuffle(shuffled)
    cut = len(shuffled) // 3
    halfway, got = streamed(spark, tmp_path, [[shuffled[:cut]], [shuffled[cut : 2 * cut], shuffled[2 * cut :]]], FailingEngine())
    frame = spark.createDataFrame(rows, CHUNKS)
    outcomes = extract_chunks(frame, FailingEngine(), titles=frame.filter("chunk_index = 0"), carry=5)
    states = {(r["doc_id"], r["chunk_index"]): (r["state"], r["error"]) for r in chunk_status(outcomes).collect()}
    assert {(r["doc_id"], r["chunk_index"]): (r["state"], r["error"]) for r in got} == states and len(got) == len(states)
    assert {"ok", "dropped", "skipped"} == {s for s, _ in states.values()}
    found = lambda rs: {(r["doc_id"], r["chunk_index"]): r["propositions"] for r in rs if r["propositions"] is not None}
    batch = {k: v for k, v in found(outcomes.collect()).items() if states[k][0] == "ok"}
    assert found(got) == batch
    assert 0 < len(halfway) < len(got) and {tuple(r)[:3] for r in halfway} < {tuple(r)[:3] for r in got}


def test_names_are_carried_over_a_restart(spark, tmp_path):
    told = lambda rows: {r["chunk_index"]: r["prior_entities"] for r in rows}
    chunk = lambda k, text, last=False: (7, k, text, None, last)
    steps = [[[chunk(2, "g has h."), chunk(0, "a is b. c was d.")]], [[chunk(0, "other text here.")]], [[chunk(1, "a met e. e met f.", False)]], [[chunk(3, "x to y.", True), chunk(4, None)]]]
    first, again, third, fourth = streamed(spark, tmp_path, steps, RuleEngine())
    assert told(first) == told(again) == {0: []}  # chunk 2 waits, a repeat is not taken again
    assert told(third) == {0: [], 1: ["a", "b", "c", "d"], 2: ["b", "c", "d", "e", "f"]}
    assert told(fourth) == {**told(third), 3: ["d", "e", "f", "g", "h"], 4: []}  # after the last chunk names are let go
    assert {r["chunk_index"]: len(r["propositions"]) for r in fourth} == {0: 2, 1: 2, 2: 1, 3: 1, 4: 0}


def test_files_arrive_once_and_errors_are_rows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def drain():
        stream_files(spark, str(folder), files_per_trigger=2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["title"], r["text"], r["error"] and r["error"].split(":")[0]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for name, content in (("a.txt", b"one"), ("b.md", b" "), ("c.docx", b"broken"), ("d.bin", b"x")):
        (folder / name).write_bytes(content)
    first = drain()
    assert first == [("a", "one", None), ("b", " ", None), ("c", None, "BadZipFile"), ("d", None, "there is no reader for bin files")]
    (folder / "sub").mkdir()
    (folder / "sub" / "e.txt").write_bytes("é".encode())
    assert drain() == sorted([*first, ("e", "é", None)])  # nothing is taken twice
    assert drain() == sorted([*first, ("e", "é", None)])


def test_chunks_tried_count_once_where_a_partition_runs_again():
    count = ChunksTried()
    seen = count.zero({})
    for told in ({0: 1}, {0: 2}, {1: 1}, {0: 1}, {0: 2}, {0: 3}):  # partition 0 runs twice
        seen = count.addInPlace(seen, told)
    assert seen == {0: 3, 1: 1}
