import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import chunking, guard


def values(spark, column, items):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    return [r["o"] for r in rows.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()]


def test_trim_and_lengths(spark):
    assert values(spark, T.trim_ws, ["  a b﻿\n", " x　", "", None]) == ["a b", "x", "", None]
    assert values(spark, T.utf16_length, ["", "abc", "a😀b", "é"]) == [0, 3, 4, 1]
    assert values(spark, T.estimate_tokens, ["", "abcd", "abcde", "a😀bcd"]) == [0, 1, 2, 2]


@pytest.mark.parametrize(("raw", "key"), [("The Knowledge  Graph", "knowledge graph"), ("a  Dog.", "dog"), ("An Apple", "apple"), ("  The X", "the x"), ("“The X”", "the x"), ("The", "the"), ("C++ & Rust!", "c rust"), ("Œuvre №7", "œuvre 7"), ("...", "")])
def test_norm_key(spark, raw, key):
    assert values(spark, T.norm_key, [raw]) == [key]


@pytest.mark.parametrize(
    ("raw", "title"),
    [('"A title"', "A title"), ("**Bold title**", "Bold title"), ("\n \nFirst line.\nSecond", "First line"), ("x" * 200, "x" * 80), ("", None), ('""', None), ('""\nreal', None), ("# Head!", "Head"), ("“Quoted” ", "Quoted")],
)
def test_sanitize_title(spark, raw, title):
    assert values(spark, T.sanitize_title, [raw]) == [title]


def test_escapes_numbers_and_names(spark):
    assert values(spark, T.xml_escape, ["a&b<c>\"d'"]) == ["a&amp;b&lt;c&gt;&quot;d&apos;"]
    assert values(spark, T.yaml_string, ['a"b\\c']) == ['"a\\"b\\\\c"']
    assert values(spark, T.slug_title, ["a/b:c", "", None, "  ", "*"]) == ["a_b_c", "graph", "graph", "graph", "_"]
    assert values(spark, lambda c: T.number_text(c.cast("double")), ["1", "0.0001", "0.25", "-2.5", "100"]) == ["1", "0.0001", "0.25", "-2.5", "100"]
    assert values(spark, lambda c: T.round_half_up(c.cast("double")), ["-2.5", "2.5", "-2.6", "0.49"]) == [-2, 3, -3, 0]
    assert values(spark, T.file_title, ["/x/report.final.PDF", "plain", "/y/.hidden"]) == ["report.final", "plain", ""]
    assert values(spark, T.file_extension, ["/x/report.final.PDF", "plain"]) == ["pdf", "plain"]


def test_guardrail(spark):
    docs = spark.createDataFrame([(1, "x" * 36_000), (2, "x" * 36_001), (3, " \n")], "doc_id int, text string")
    assert [r["over_limit"] for r in guard.over_limit(docs).orderBy("doc_id").collect()] == [False, True, False]
    assert not guard.over_limit(docs, forced=True).filter("over_limit").count()
    assert guard.truncate(docs).filter("length(text) > 36000").count() == 0
    assert [r["doc_id"] for r in guard.with_text(docs).orderBy("doc_id").collect()] == [1, 2]


# -- chunking ------------------------------------------------------------------------


def blocks(text):
    return [t[s:e] for t, s, e in chunking.block_spans(text.replace("\r\n", "\n"))]


def pieces_of(block, limit):
    return [t[s:e] for t, s, e in chunking.piece_spans((block, 0, len(block)), limit)]


def test_cuts_and_packing():
    assert chunking.greedy_cuts([3, 5, 9, 30, 31], 6) == [5, 9, 15, 21, 27, 31]
    assert chunking.packed([4, 4, 9, 0, 1, 0], 9) == [(0, 2), (2, 4), (4, 6)] and chunking.packed([], 5) == []
    assert chunking.overlap_start("One. Two. Three", 2) == 10 and chunking.overlap_start("short", 9) == 0


def test_one_short_text_is_one_chunk():
    assert chunking.chunk_text("One paragraph. Two sentences.") == [(0, "One paragraph. Two sentences.", 8)]


def test_packing_keeps_near_the_target():
    text = "\n\n".join(["A sentence about something or other, said at length. " * 6] * 20)
    chunks = chunking.chunk_text(text, target=300, overlap=40)
    assert len(chunks) > 1 and max(c[2] for c in chunks) <= 300 + 40 + 2
    assert [c[0] for c in chunks] == list(range(len(chunks)))


def test_overlap_starts_at_a_sentence():
    text = "\n\n".join(f"Paragraph {k} has a first sentence. It has a second one too." for k in range(60))
    chunks = [c[1] for c in chunking.chunk_text(text, target=300, overlap=60)]
    for before, after in zip(chunks, chunks[1:], strict=False):
        lead = after.split("\n\n")[0]
        assert lead and before.endswith(after[: after.index("\n\n" + after.split("\n\n")[-1])].split("\n\n")[0]) or lead in before


def test_a_block_without_breaks_is_cut_at_sentences():
    chunks = chunking.chunk_text("This is one of four hundred sentences. " * 400, target=200, overlap=0)
    assert len(chunks) > 10 and all(c[2] <= 200 and c[1].endswith(".") for c in chunks)


def test_raw_slices_and_lost_leading_stops():
    pieces = pieces_of("y" * 100 + ". tail", 10)
    assert [len(p) for p in pieces] == [40, 40, 21, 4] or "".join(pieces).replace(" ", "") == "y" * 100 + ".tail"
    assert pieces_of("...abc. def", 1) == ["abc.", "def"]
    assert pieces_of("!!!", 1) == ["!!!"]


def test_blocks():
    assert blocks("a\r\n\r\nb\n# H\ntext\n \n\n c\n#no\n###### six\n") == ["a", "b", "# H\ntext", "c\n#no", "###### six"]
    assert blocks("") == [] and chunking.chunk_text("  \n\n ") == []


def test_astral_characters_count_twice():
    assert chunking.chunk_text("😀😀😀")[0][2] == 2
    whole = "".join(c[1] for c in chunking.chunk_text("😀" * 100, target=9, overlap=0))
    assert whole == "😀" * 100


def made_up(seed):
    r = random.Random(seed)
    parts = ["word", "Longer-word", "\n", "\n\n", "\n \n", "\r\n", "# ", "\n## Head\n", ". ", "! ", "? ", '." ', ".", " ", " ", "é", "\n\n\n", ")", "...", "x" * 50]
    return "".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randrange(120)))


@pytest.mark.parametrize(("target", "overlap"), [(900, 120), (40, 10), (12, 0), (5, 3)])
def test_native_fold_equals_the_batches(spark, target, overlap):
    docs = spark.createDataFrame([(i, made_up(i)) for i in range(150)] + [(999, None)], "doc_id int, text string")
    fast = sorted(map(tuple, chunking.chunk_documents(docs, target=target, overlap=overlap).collect()))
    assert fast == sorted(map(tuple, chunking.chunk_documents(docs, target=target, overlap=overlap, native=True).collect()))
    assert fast == sorted((i, *c) for i in range(150) for c in chunking.chunk_text(made_up(i), target=target, overlap=overlap))
    again = chunking.chunk_documents(docs.repartition(7), target=target, overlap=overlap)
    assert fast == sorted(map(tuple, again.collect()))
