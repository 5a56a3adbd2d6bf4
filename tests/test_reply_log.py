"""The log of replies: tasks that run again ask only for what was not answered."""

import json
import os
from collections import Counter

import pytest

from quillgraph.plans.engines import ChunkContext, FatalEngineError
from quillgraph.plans.pipeline import extract_chunks
from quillgraph.plans.reply_log import LoggedEngine, ReplyLog, read_log

GOOD = json.dumps({"propositions": [{"id": "p1", "text": "t", "subject": {"name": "a", "type": "other"}, "predicate": "is", "object": {"name": "b", "type": "other"}}]})


class CountedModel:
    """Notes each question in a file; answers from the second try on; dies at one question, unless it did before."""

    id = model = "counted"

    def __init__(self, notes, dies_at=None, fails_at=None):
        self.notes, self.dies_at, self.fails_at = notes, dies_at, fails_at

    def availability(self):
        return "ready"

    def init(self): ...

    def dispose(self): ...

    def ask(self, talk):
        passage, attempt = talk[1]["content"].split("\n\n")[-1], (len(talk) - 2) // 2 + 1
        if passage == self.dies_at and not os.path.exists(f"{self.notes}.died"):
            open(f"{self.notes}.died", "w").close()
            os._exit(1)
        if passage == self.fails_at:
            raise FatalEngineError("no credit")
        with open(f"{self.notes}.{os.getpid()}", "a") as f:
            f.write(f"{passage} {attempt}\n")
        return GOOD if attempt == 2 else "hm"

    def asked(self):
        folder, name = os.path.split(self.notes)
        return Counter(line.strip() for n in os.listdir(folder) if n.startswith(f"{name}.") for line in open(f"{folder}/{n}"))


def test_each_attempt_is_asked_once_though_a_worker_dies(spark, tmp_path):
    chunks = spark.createDataFrame([(d, k, f"d{d}c{k}") for d in range(4) for k in range(5)], "doc_id long, chunk_index int, text string")
    model = CountedModel(str(tmp_path / "notes"), dies_at="d2c3")
    engine = LoggedEngine(model, str(tmp_path / "log"))
    with pytest.raises(Exception):  # noqa: B017  a local session gives a task one try
        extract_chunks(chunks, engine).collect()
    before = model.asked()
    assert before["d2c2 2"] == 1 and "d2c3 1" not in before
    got = extract_chunks(chunks, engine).collect()
    assert len(got) == 20 and all(r["ok"] and len(r["propositions"]) == 1 for r in got)
    assert model.asked() == Counter({f"d{d}c{k} {a}": 1 for d in range(4) for k in range(5) for a in (1, 2)})
    log = read_log(spark, str(tmp_path / "log"))
    assert sorted((r["document"], r["chunk_index"], r["attempt"], r["reply"] == GOOD) for r in log.collect()) == sorted((str(d), k, a, a == 2) for d in range(4) for k in range(5) for a in (1, 2))


def test_errors_are_asked_again_and_torn_lines_passed_over(spark, tmp_path):
    folder, notes = str(tmp_path / "log"), str(tmp_path / "notes")
    context = lambda k: ChunkContext(k, document="d")
    first = LoggedEngine(CountedModel(notes, fails_at="two"), folder)
    first.init()
    assert len(first.extract("one", context(0))) == 1
    with pytest.raises(FatalEngineError):
        first.extract("two", context(1))
    first.dispose()
    (path,) = [os.path.join(at, n) for at, _, names in os.walk(folder) for n in names]
    with open(path, "a") as f:
        f.write('{"document": "d", "asked": "x", "rep')
    second = LoggedEngine(CountedModel(notes), folder)
    second.init()
    assert len(second.extract("one", context(0))) == len(second.extract("two", context(1))) == 1
    second.dispose()
    assert CountedModel(notes).asked() == Counter({"one 1": 1, "one 2": 1, "two 1": 1, "two 2": 1})
    assert len(ReplyLog(folder, "d").known) == 4 and ReplyLog(folder, "other").known == {}
    assert read_log(spark, folder).count() == 4
    third = LoggedEngine(CountedModel(notes), folder)
    third.model = "another"  # another model is asked anew
    third.init()
    third.extract("one", context(0))
    third.dispose()
    assert CountedModel(notes).asked()["one 1"] == 2
