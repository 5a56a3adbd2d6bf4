"""License scans, SentencePiece, URL filters, token counts, top-k, HTML extraction, language ID and the pipeline."""

import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import hamming_topk, html_extraction, language_id, license_scan, queries, url_filters
from quillgraph.llm.pieces import BPE, UNIGRAM, PieceModel
from quillgraph.llm.sentencepiece_codec import MODEL, Encoder, decode_ids, encode_texts, read_model
from quillgraph.llm.token_counts import count_tokens, trie_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, host string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", None, "x", "y", "z") for i, t, g in rows], DOCS)


def texts(spark, values):
    return frame(spark, [(i, t, None) for i, t in enumerate(values)])


# -- licences ---------------------------------------------------------------------


def test_license_rules(spark):
    mit = " ".join(license_scan.SENTENCES[k][0] + "." for k in ("mit-grant", "mit-notice", "mit-as-is", "mit-liability"))
    apache = "/* Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n */"
    bsd = "\n".join(license_scan.SENTENCES[k][0].replace("*", "the Acme Org") + "." for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is"))
    values = [mit, apache, bsd, "Some words\nReleased under the MIT License.\nmore", "Licensed under CC BY-NC 4.0", None, "", " \n", f"{mit} {mit}", "x. " * 5000 + "Released under the MIT License. " + "y. " * 5000, "All rights reserved."]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(texts(spark, values)).collect()}
    assert [got[i]["licenses"] for i in range(len(values))] == [["MIT"], ["Apache-2.0"], ["BSD-3-Clause"], ["MIT"], ["CC-BY-NC-4.0"], [], [], [], ["MIT"], ["MIT"], []]
    assert len(got[8]["matches"]) == 2 and got[10]["sentence_ids"] == ["all-rights"]
    assert [got[i]["n_sentences"] for i in (5, 6, 7)] == [0, 0, 0]
    assert license_scan.scan_licenses(texts(spark, [])).collect() == []


def test_license_gap_and_order():
    names = {"a": ["one"], "b": ["two"]}
    seen = lambda text, gap: [m[0] for m in license_scan.Recogniser(names, [("AB", ("a", "b")), ("A", ("a",))], gap).scan(text)[2]]
    assert seen("One. x. Two.", 1) == ["AB"] and seen("One. x. Two.", 0) == ["A"]
    assert seen("Two. One.", 5) == ["A"] and seen("One. Two. One.", 0) == ["AB", "A"]


def test_every_licence_of_a_sentence_of_lines():
    scanner = license_scan.Recogniser(license_scan.SENTENCES, license_scan.RULES, 2)
    licences = lambda text: [m[0] for m in scanner.scan(text)[2]]
    assert licences("Released under the MIT License\nLicensed under CC BY 4.0\nsome text") == ["MIT", "CC-BY-4.0"]
    assert licences("// SPDX-License-Identifier: MIT\n// SPDX-License-Identifier: Apache-2.0\nint x") == ["MIT", "Apache-2.0"]
    assert licences("foo\nThis work is licensed under the GNU\nGeneral Public License,\nversion 3\nand text without a stop") == ["GPL-3.0-only"]
    names = license_scan.SENTENCES["bsd-names"][0].replace("*", "Acme\nand Sons").replace("be used", "be\nused")
    assert scanner.scan(f"x\n{names}\ny\nAll rights reserved\nz")[1] == [(0, "bsd-names"), (0, "all-rights")]
    header = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"
    for name in license_scan.SPDX:
        assert licences(f"# SPDX-License-Identifier: {name}\nimport x\n") == [name]
    zlib_text = "This software is provided 'as-is', without any express or implied warranty. In no event. " + license_scan.SENTENCES["zlib-grant"][0] + ":\n1. x"
    assert licences(zlib_text) == ["Zlib"]
    assert licences(header) == ["MPL-2.0"] and scanner.scan("See v. Then more.")[0] == 2


def test_license_query_against_lines(spark, sf_dir):
    """The documents hold one-line licences only: the scan finds those lines and no others."""
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op1_license_scan(spark, sf_dir).collect():
        assert r["licenses"] == sorted({v for k, v in lines.items() if k in docs[r["doc_id"]]}), r["doc_id"]


def brute_scan(text, sentences, rules, gap):
    """Sentences character by character, all runs of lines, longest first, and the rules one after another."""
    clean = lambda t: " ".join(re.sub("[^a-z0-9*]", " ", t.lower()).split())
    known = [(clean(t).split(), name) for name, ts in sentences.items() for t in ts]
    body = re.sub(r"(?i)\n[ \t]*(//+|/\*+|\*+/?|#+|;+|--+|%+|<!--|rem\b)[ \t]?", "\n", "\n" + text)
    parts, held, i = [], "", 0
    while i < len(body):
        rest = body[i:]
        blank = re.match(r"\n[ \t]*\n\s*", rest) or (re.match(r"[ \t]*\n", rest) if held.endswith(":") else None)
        stop = re.match(r"\s+", rest) if held[-1:] in (".", "!", "?") and held else None
        if stop and re.search(r"(?i)\b(v|ver|vers)\.$", held) and rest[stop.end() :][:1].isdigit():
            stop = None
        if got := stop or blank:
            parts.append(held)
            held, i = "", i + got.end()
        else:
            held, i = held + body[i], i + 1
    parts = [p for p in [*parts, held] if p.strip()]

    def fits(words, pattern):
        if not pattern:
            return not words
        if pattern[0] == "*":
            return any(fits(words[n:], pattern[1:]) for n in range(1, len(words) + 1))
        return bool(words) and words[0] == pattern[0] and fits(words[1:], pattern[1:])

    found = []
    for k, p in enumerate(parts):
        lines = [x for x in (clean(x.replace("*", " ")) for x in p.split("\n")) if x]
        whole = [name for pattern, name in known if fits(" ".join(lines).split(), pattern)]
        if whole:
            found.append((k, whole[0]))
            continue
        a = 0
        while a < len(lines) and len(lines) > 1:
            runs = [(len(" ".join(pattern)), -b, name) for b in range(a + 1, len(lines) + 1) for pattern, name in known if fits(" ".join(lines[a:b]).split(), pattern)]
            if runs:
                found.append((k, max(runs)[2]))
                a = -max(runs)[1]
            else:
                a += 1
    matches, free = [], [True] * len(found)
    for licence, ids in rules:
        for a in range(len(found) - len(ids) + 1):
            run = list(range(a, a + len(ids)))
            if [found[b][1] for b in run] == list(ids) and all(free[b] for b in run) and all(found[c][0] - found[b][0] <= gap + 1 for b, c in zip(run, run[1:], strict=False)):
                matches.append((a, licence))
                for b in run:
                    free[b] = False
    return len(parts), [n for _, n in found], [m for _, m in sorted(matches)]


def test_license_query_by_brute_force(spark, sf_dir, tmp_path):
    r = random.Random(8)
    lines = [t for ts in license_scan.SENTENCES.values() for t in ts]
    made = []
    for _ in range(60):
        parts = []
        for _ in range(r.randrange(1, 7)):
            t = r.choice(lines).replace("*", r.choice(["Acme", "the Foo\nand Bar Org", "x", " ".join(["holder"] * 60), "Acme nor the names\nof its", "\n".join(["of many"] * 30)]))
            if r.random() < 0.4:
                t = "\n".join(filter(None, (t[: t.find(" ", len(t) // 2)], t[t.find(" ", len(t) // 2) + 1 :]))) if " " in t else t
            parts.append(t + r.choice([". ", ".\n", "\n", "\n\n", ":\n", ".\n// ", " more\n", "\nother words\n"]))
        made.append("".join(parts))
    folder = str(tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.limit(150).unionByName(docs.limit(1).crossJoin(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(made)], "i long, t string")).drop("doc_id", "text").withColumnsRenamed({"i": "doc_id", "t": "text"})).write.parquet(f"{folder}/documents.parquet")
    texts_by = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for x in queries.op1_license_scan(spark, folder).collect():
        want = brute_scan(texts_by[x["doc_id"]], license_scan.SENTENCES, license_scan.RULES, 2)
        assert (x["n_sentences"], x["sentence_ids"], [m["license"] for m in x["matches"]]) == want, texts_by[x["doc_id"]][:500]


def test_license_wildcards_and_expressions():
    scanner = license_scan.Recogniser(license_scan.SENTENCES, license_scan.RULES, 2)
    licences = lambda text: [m[0] for m in scanner.scan(text)[2]]
    for n in (1, 40, 41, 5000):  # a holder of any length
        names = license_scan.SENTENCES["bsd-names"][0].replace("*", "word " * n)
        assert scanner.known(names) == scanner.known(f"x\n{names}") == scanner.known(f"{names}\ny") == ["bsd-names"]
    assert scanner.known(license_scan.SENTENCES["bsd-names"][0].replace(" *", "")) == []
    two = license_scan.Recogniser({"a": ["one * two * three"], "b": ["four *"]}, [], 0)
    assert [two.known(t) for t in ("one x two y z three", "one two three", "one x two three", "u\none x two\ny\nthree\nv", "four", "u\nfour x\ny", "one a two b three four")] == [["a"], [], [], ["a"], [], ["b"], []]
    spdx = "SPDX-License-Identifier: "
    assert licences(f"// {spdx}MIT OR Apache-2.0\nint x;") == licences(f"# {spdx}(MIT AND Apache-2.0)") == ["MIT", "Apache-2.0"]
    assert licences(f"/* {spdx}GPL-2.0 */") == ["GPL-2.0-only"] and licences(f"{spdx}GPL-2.0+ WITH Classpath-exception-2.0") == ["GPL-2.0-or-later"]
    assert licences(f"{spdx}MIT more") == licences(f"{spdx}Unheard-1.0") == licences(f"{spdx}MIT OR") == licences(spdx) == []


@pytest.mark.parametrize("unit", ["SPDX-License-Identifier: MIT OR\n", "neither the name of x nor the names of its\n", "word ", "released under this\n", "neither the name of the\n", "x", "// ", "\n", " ", " \n", "All rights reserved\n"])
def test_license_scan_of_a_long_text_without_stops(unit):
    scanner = license_scan.Recogniser(license_scan.SENTENCES, license_scan.RULES, 2)
    began = time.process_time()
    scanner.scan(unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 5


# -- SentencePiece ------------------------------------------------------------------


def strange_texts(seed=3, n=120):
    r = random.Random(seed)
    alphabet = " abcdefé\n日😀thein▁"
    made = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 300))) for _ in range(n)]
    return ["", " ", "  ", "a", "   b  c   ", "\n\n x", "hello  world\t!", "▁x▁", "a" * 500, "ab" * 300 + " " * 40, "x\x00y", "<0x0A></s><unk>", "\n" * 300, " " * 200, *made]


def test_encoding_equals_the_library(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    values = strange_texts() + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    rows = {r["doc_id"]: r for r in encode_texts(texts(spark, [*values, None]), reading="stored").collect()}
    assert [rows[i]["ids"] for i in range(len(values))] == [library.encode(t) for t in values]
    assert [rows[i]["exact"] for i in range(len(values))] == ["▁" not in t for t in values]
    last = rows[len(values)]
    assert (last["ids"], last["n_ids"], last["exact"]) == (None, 0, None)
    back = {r["doc_id"]: r["text"] for r in decode_ids(encode_texts(texts(spark, [*values, None]))).collect()}
    assert [back[i] for i in range(len(values) + 1)] == [t.replace("▁", " ") for t in values] + [None]
    assert encode_texts(texts(spark, [])).collect() == []


def test_encoder_forgets_and_stays_right():
    model = read_model(MODEL, "stored")
    small, large = Encoder(model, cache=20), Encoder(model)
    for t in strange_texts(4, 40):
        assert small(pa.array([t]))[0].tolist() == large(pa.array([t]))[0].tolist()


def as_unigram():
    model = read_model(MODEL)
    assert model.kind == UNIGRAM and read_model(MODEL, "stored").kind == BPE
    return model


def best_path(model, unit):
    known = model._vocabulary()
    best = [(0.0, [])]
    for end in range(1, len(unit) + 1):
        options = []
        for size in range(min(model.longest, end), 0, -1):
            piece = unit[end - size : end]
            if piece in known:
                options.append((best[end - size][0] + model.scores[known[piece][1]], best[end - size][1] + [known[piece][1]]))
            elif size == 1:
                options.append((best[end - 1][0] + model.unk_score, best[end - 1][1] + model.outside(piece)))
        top = max(o[0] for o in options)
        best.append(next(o for o in options if o[0] == top))
    return best[-1][1]


def units_of(model, values):
    raw, start, end, _ = model.spans(pa.array(values, pa.string()))
    return sorted({model.unit(raw, a, b) for a, b in zip(start, end, strict=True)})


def test_viterbi_and_trie_equal_brute_force():
    model = as_unigram()
    units = units_of(model, strange_texts(5, 60))
    want = [best_path(model, u) for u in units]
    assert model.encode_units(units) == want
    assert trie_counts(model, units).tolist() == [len(w) for w in want]


def test_a_unigram_model_in_a_file():
    """A hand-made model: pieces, scores and kinds are read, unknowns become one piece."""

    def field(number, value):
        return bytes([number << 3 | 2, len(value)]) + value

    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -1.0, 1), ("b", -1.5, 1), ("▁ab", -1.0, 1), ("ba", -5.0, 1)]
    data = b"".join(field(1, field(1, p.encode()) + b"\x15" + np.float32(s).tobytes() + bytes([0x18, k])) for p, s, k in pieces)
    data += field(2, b"\x18\x01") + field(3, b"\x20\x00")
    model = PieceModel.read(data)
    assert model.encode_units(["▁aba", "▁", "▁zb"]) == [[4, 2], [1], [1, 0, 3]]
    assert trie_counts(model, ["▁aba", "▁", "▁zb"]).tolist() == [2, 1, 3]
    assert model.decode_batch(np.array([4, 2]), np.array([0, 2])) == ["aba"]


def proto(pieces, kind):
    """A model file of (piece, score, kind) with the identity normaliser and byte fallback."""

    def size(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + size(n >> 7)

    def field(number, value):
        return bytes([number << 3 | 2]) + size(len(value)) + value

    data = b"".join(field(1, field(1, p.encode()) + b"\x15" + np.float32(s).tobytes() + bytes([0x18, int(k)])) for p, s, k in pieces)
    return data + field(2, bytes([0x18, kind]) + b"\x98\x02\x01") + field(3, field(1, b"identity") + b"\x18\x01\x20\x00")


def unigram_library():
    """The library on the same vocabulary as a unigram model. Its 15 space runs score -1e9, which swamps single-precision sums, so they get -40000."""
    model = read_model(MODEL, "stored")
    data = proto([(p, max(s, -40000.0), k) for p, s, k in zip(model.pieces, model.scores, model.kinds, strict=True)], UNIGRAM)
    return sentencepiece.SentencePieceProcessor(model_proto=data)


def test_viterbi_query_equals_the_library(spark, sf_dir):
    library = unigram_library()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op2_sentencepiece(spark, sf_dir).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == dict(zip(docs, library.encode(list(docs.values())), strict=True))
    assert all(r["exact"] == ("▁" not in docs[r["doc_id"]]) and r["n_ids"] == len(r["ids"]) for r in rows)
    counts = {r["doc_id"]: r["n_tokens"] for r in queries.op4_token_counts(spark, sf_dir).collect()}
    assert counts == {r["doc_id"]: r["n_ids"] for r in rows}


def test_long_units_equal_the_library(spark):
    r = random.Random(6)
    values = [*strange_texts(8, 100), "".join(r.choice("abcde thin日") for _ in range(3000)), "the" * 3000, "".join(r.choice("QWERTYabcdef0123456789+/") for _ in range(20_000)), " " * 700, "日" * 500]
    library = unigram_library()
    got = {r["doc_id"]: r["ids"] for r in encode_texts(texts(spark, values)).collect()}
    assert [got[i] for i in range(len(values))] == library.encode(values)
    counts = {r["doc_id"]: r["n_tokens"] for r in count_tokens(texts(spark, values)).collect()}
    assert [counts[i] for i in range(len(values))] == [len(got[i]) for i in range(len(values))]
    began = time.process_time()
    trie_counts(as_unigram(), ["".join(r.choice("QWERTYabcdef0123456789+/") for _ in range(300_000))])
    assert time.process_time() - began < 10  # linear: some microseconds a character


def test_token_counts(spark):
    model = as_unigram()
    values = [*strange_texts(6, 20), None]
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(texts(spark, values), cache=50).collect()}
    for i, t in enumerate(values):
        raw, start, end, _ = model.spans(pa.array([t], pa.string()))
        assert got[i] == sum(len(best_path(model, model.unit(raw, a, b))) for a, b in zip(start, end, strict=True))
    assert count_tokens(texts(spark, [])).collect() == []


# -- URLs -----------------------------------------------------------------------------

LONG_URL = "http://h.example.org/" + "a/" * 200_000 + "?casino=" + "x" * 100_000
URLS = [
    LONG_URL, "http://" + "a." * 100_000 + "net/es/",
    "http://www.example.com/en/1", "https://example.com/en/", "http://example.com/en", "http://a.www.EXAMPLE.com/en/x?y#z", "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/fr", "http://net/fr/",
    "http://x.org/", "http://cheap-pills.org/buy", "http://cheap-pills.edu/x", "http://ads.foo.org/", "http://foo.org/casino", "http://foo.org/casinos", "HTTP://FOO.ORG/POPUNDER/", "no scheme com/", "", None, "://", "http://", "http://h", "ftp://h?a/b", "http://h#f", "http://com/", "http://foo.com?x=/", "http://ünï.com/", "a://b://c.com/en/",
]


def pages(spark, values):
    return spark.createDataFrame([(i, u, "x", "h", "p") for i, u in enumerate(values)], "page_id long, url string, html string, host string, rule string")


def test_urls_against_all_rules(spark, sf_dir):
    rules = url_filters.rules_of(url_filters.PLACES, url_filters.PATTERNS)
    values = URLS + [r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").collect()]

    def plain(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (url_filters.lower(m[1]), m[2]) if m else ("", "")
        fits = [r for r in rules if r.place and (h := r.text.split("/")[0]) and (host == h or host.endswith("." + h)) and path.startswith(r.text[len(h) :])]
        if fits:
            best = max(fits, key=lambda r: len(r.text))
            return host, path, best.text, best.verdict
        hit = {r.verdict for r in rules if not r.place and re.search(r.regex, url_filters.lower(url or ""), re.ASCII | re.DOTALL)}
        return host, path, None, "block" if hit == {"block"} else "allow"

    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(pages(spark, values)).collect()}
    assert [got[i] for i in range(len(values))] == [plain(u) for u in values]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(values)))
    assert {r[0]: r[1:] for r in con.execute(url_filters.sql()).fetchall()} == got
    assert got[5][2:] == ("www.example.com/en/", "allow") and got[11][3] == "block" and got[12][3] == "allow" and got[15][3] == "allow"
    assert url_filters.filter_urls(pages(spark, [])).collect() == []


def test_few_rules_are_tried(spark):
    tried = [r["n_candidates"] for r in url_filters.filter_urls(pages(spark, ["http://foo.org/bar", "http://foo.com/"] * 20)).collect()]
    assert max(tried) <= 3


# -- top-k ----------------------------------------------------------------------------------


def vectors(spark, values):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "c", 1) for i, v in values], "vec_id long, embedding array<float>, label int, code string, part int")


@pytest.mark.parametrize(("dims", "segment_bits", "part_codes"), [(64, 16, 50_000), (64, 8, 20), (70, 16, 40), (64, 16, 3)])
def test_topk_equals_brute_force(spark, dims, segment_bits, part_codes):
    rng = np.random.RandomState(1)
    base = rng.randn(12, dims)
    values = [(i, base[i % 12] if i % 4 == 0 else base[i % 12] + rng.randn(dims) * (i % 5)) for i in range(400)]
    values += [(400, [float("nan")] * dims), (401, None), (402, [1.0] * (dims - 1)), (None, [1.0] * dims), (450, values[0][1]), (451, [None if j % 3 else 1.0 for j in range(dims)])]
    codes = {i: np.nan_to_num(np.array([x or 0 for x in v], np.float32)) > 0 for i, v in values if i is not None and v is not None and len(v) == dims}
    want = []
    for q in codes:
        if q % 50 == 0:
            near = sorted((int((codes[q] != codes[i]).sum()), i) for i in codes if i != q)[:10]
            want += [(q, k + 1, i, d) for k, (d, i) in enumerate(near)]
    got = hamming_topk.nearest_by_hamming(vectors(spark, values), dims=dims, segment_bits=segment_bits, part_codes=part_codes).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_topk_edges(spark):
    assert hamming_topk.nearest_by_hamming(vectors(spark, [])).collect() == []
    one = [1.0] * 64
    assert hamming_topk.nearest_by_hamming(vectors(spark, [(0, one)])).collect() == []
    same = [(i, one) for i in range(200)] + [(0, one)]
    got = sorted(map(tuple, hamming_topk.nearest_by_hamming(vectors(spark, same), k=3).collect()))
    assert got == [(q, k + 1, i, 0) for q in (0, 50, 100, 150) for k, i in enumerate([x for x in range(4) if x != q][:3])]


# -- HTML -----------------------------------------------------------------------------------


def html_pages(spark, values):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(values)], "page_id long, url string, html string, host string, text string")


def test_main_text_of_marked_pages(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>no</article>";</script></head><body class="page-with-sidebar">
<header><h1>Site</h1></header><nav><ul><li>Home</ul></nav><div class="cookie-notice">We use cookies</div><!-- <article>hidden</article> -->
<article><header>By someone</header><h1>T&eacute;st &amp;amp; more</h1><p>One   <b>bold<br>two</b>
three&#33;<p>Four<ul><li>a<li>b</ul><aside>Side</aside><form><p>Mail</form><p class=ad>Buy<p>5 &lt; 6 < 7<div id="comments"><p>First!</div></article>
<div class="related">Else</div><footer>Foot</footer></body></html>"""
    want = "Tést &amp; more\nOne bold two three!\nFour\na\nb\n5 < 6 < 7"
    got = html_extraction.extract_main_text(html_pages(spark, [("http://h/1", page), ("http://h/2", None), (None, ""), ("http://h/3", "<article>" + "w " * 50_000)])).collect()
    assert {r["page_id"]: (r["text"], r["n_chars"]) for r in got} == {0: (want, len(want)), 1: ("", 0), 2: ("", 0), 3: (("w " * 50_000).strip(), 99_999)}


def test_names_that_only_mention_a_listed_word():
    main = lambda page: [t for t, dropped, inside in html_extraction.page_blocks(page) if inside and not dropped]
    for page in ("<div class='content no-sidebar'><article><p>a</p></article></div>", "<main class='has-comments'>a</main>", "<article id='ad-free-guide'>a</article>", "<div class='layout-sidebar'><div>x</div><main class=sidebar>a</main></div>"):
        assert main(page) == ["a"]
    assert main("<article>a<div class='related'><article>b</article></div><article class='comment'>c</article><p class='ad-slot'>d<p id='page_footer'>e<p class='x sidebar-2'>f</article><div class='related'><article>g</article></div>") == ["a"]
    assert main("<noscript><div class=ad><article>a</article></div></noscript><template><article>b</article></template>") == []
    assert html_extraction.page_blocks("<div class='with-menu'>a</div><div class='top menu'>b</div>") == [("a", False, False), ("b", True, False)]
    for name in ("topic-social", "related-work", "notice-board", "content no-sidebar", "has-sticky-header", "header-image"):
        assert html_extraction.page_blocks(f"<div class='{name}' id='{name}'>a</div>") == [("a", False, False)], name


def test_repeated_runs_decide_for_unmarked_pages(spark):
    menu = "<p>home about news contact jobs press legal imprint help</p>"
    body = lambda k: f"<html><body>{menu}<p>own words of page number {k} with its text {k * k}</p><p>{' '.join(f'r{k}x{j}' for j in range(20))}</p></body></html>"
    values = [(f"http://one.example/{k}", body(k)) for k in range(6)] + [("http://two.example/", body(9))]
    got = {r["page_id"]: r["text"].split("\n") for r in html_extraction.extract_main_text(html_pages(spark, values)).collect()}
    assert all(len(got[k]) == 2 and got[k][0].startswith("own words") for k in range(6))
    assert len(got[6]) == 3  # nothing repeats on a host of one page
    assert html_extraction.extract_main_text(html_pages(spark, [])).collect() == []


def test_pages_of_one_content_keep_their_text(spark):
    menu = "<div>home about news contact jobs press legal imprint help</div>"
    own = lambda k: f"<p>{' '.join(f'own{k}x{j}' for j in range(30))}</p>"
    values = [(f"http://h.example/{k}?s={c}", menu + own(k)) for k in range(5) for c in range(1 + 4 * (k == 0))]
    for size in (1, 2, 256):
        got = html_extraction.extract_main_text(html_pages(spark, values), group_pages=size).collect()
        assert all(r["text"] == re.sub("<[^>]*>", "", own(0 if r["page_id"] < 5 else r["page_id"] - 4)) for r in got)


def test_dealing_a_hot_host_changes_no_row(spark):
    r = random.Random(5)
    words = lambda n: " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(40)) for _ in range(n))
    notices = [words(n) for n in (8, 9, 12, 20, 7)] + [words(30) for _ in range(20)]
    blocks = [[words(25), *r.sample(notices, 2), " ".join(notices[5].split()[k % 9 : k % 9 + 12])] for k in range(60)]
    blocks[11].append(twice := words(15))  # on two pages of the host
    blocks[47].append(twice)
    values = [("http://hot.example/", "".join(f"<p>{b}</p>" for b in page)) for page in blocks] + [("http://cold.example/", f"<p>{twice}</p>"), ("http://hot.example/", None)]
    values += values[:2]
    seen = lambda **how: {r["page_id"]: tuple(r) for r in html_extraction.extract_main_text(html_pages(spark, values), **how).collect()}
    whole, dealt = seen(), seen(group_pages=3, bucket_bytes=4000)
    assert len(whole) == len(values) and dealt == whole == seen(group_pages=7) == seen(group_pages=1, bucket_bytes=900)
    assert all(twice not in dealt[k][2] for k in (11, 47)) and dealt[60][2] == twice


def test_repeated_tokens_by_brute_force():
    r = random.Random(2)
    for _ in range(30):
        n, depth = r.randrange(1, 60), r.randrange(1, 6)
        tokens, page = [r.randrange(4) for _ in range(n)], sorted(r.randrange(4) for _ in range(n))
        content = [0 if p == 3 else p for p in page]  # the first and the last page are one content
        want = [False] * n
        runs = [(tuple(tokens[i : i + depth]), content[i], i) for i in range(n - depth + 1) if page[i] == page[i + depth - 1]]
        for t, p, i in runs:
            if any(t == u and p != q for u, q, _ in runs):
                want[i : i + depth] = [True] * depth
        assert html_extraction.repeated_tokens(np.array(tokens, np.uint64), np.array(page), np.array(content), depth).tolist() == want


NOT_TEXT = "comment-list post-comment commentlist comments-area CommentBox site-header siteHeader main-nav main-menu navbar-top share-buttons post-share social-links subscribe-form newsletter-box gdpr-notice cookieBanner breadcrumb_trail page-footer left-sidebar ad-slot adsbygoogle-ad advert_2 sponsored-links related-posts promo modal-popup pagination".split()
TEXT = "no-sidebar topic-social entry-header article-title post-content story-body commentary has-ads category-menu security-notice lead body-copy figure-caption market-share headline address readmore adapter shared-history".split()


def test_html_names_inside_an_article_and_outside():
    text = lambda page: [t for t, dropped, _ in html_extraction.page_blocks(page) if not dropped]
    for attribute in ("class", "id"):
        for name in NOT_TEXT:
            assert text(f"<article><h1>A</h1><div {attribute}='x {name}'><p>gone</p> too</div><p>b</p></article>") == ["A", "b"], name
            assert text(f"<div><div {attribute}='{name}'>gone</div><div>a</div></div>") == ["a"], name
        for name in TEXT:
            assert text(f"<article><h1>A</h1><div {attribute}='{name}'><p>stays</p></div></article>") == ["A", "stays"], name
    plain = "<div class='site-header'>My Site</div><div id='main-nav'><a>Home</a> <a>About</a></div><div class='text'>The text.</div><div class='comment-list'><div>Nice post!</div></div>"
    assert text(plain) == ["The text."]


def test_html_articles_of_comments():
    main = lambda page: [t for t, dropped, inside in html_extraction.page_blocks(page) if inside and not dropped]
    comment = "<article class='comment'><p>First!</p></article>"
    assert main(f"<article><p>a</p></article>{comment}{comment}") == main(f"{comment}<article><p>a</p></article>") == ["a"]
    assert main(f"<article><p>a</p><section class='post-comments'>{comment}</section></article>") == ["a"]
    assert main(f"<div>{comment}</div>") == ["First!"]  # the page has no other
    assert main("<article class='comment'><p>a</p></article><main><p>b</p></main>") == ["b"]


@pytest.mark.parametrize("piece", ["<!a", "<?a", "<a ", "<a '", '<a "x>', "<b>", "</i>", "<b></i>", "<p", "<div><b>", "<li><i>", "&amp", "<script>", "<!--", "<article class=comment>"])
def test_html_of_hostile_pages_takes_linear_time(piece):
    page = "<p>a</p>" + piece * (300_000 // len(piece))
    began = time.process_time()
    html_extraction.page_blocks(page)
    html_extraction.page_blocks("<b>" * 60_000 + "<p>a</p>" * 20_000 + "</i>" * 60_000)
    assert time.process_time() - began < 8


def test_html_marks_planted_in_the_given_pages(spark, sf_dir, tmp_path):
    """The given pages with comments, shares and headers put into their articles give the same text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    r = random.Random(9)
    extra = lambda: f"<div class='{r.choice(NOT_TEXT)}'><p>planted {r.random()}</p><ul><li>more</li></ul></div>"
    marked = [(p["page_id"], p["url"], re.sub("</p>(?=.*</article>)", lambda m: m[0] + (extra() if r.random() < 0.3 else ""), p["html"] or "").replace("</article>", f"</article><article class='comment'>{extra()}Hm.</article>")) for p in pages]
    spark.createDataFrame(marked, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    text = lambda folder: {x["page_id"]: x["text"] for x in queries.op9_html_extraction(spark, folder).collect()}
    assert "planted" in str(marked) and text(str(tmp_path)) == text(sf_dir)


def test_html_hosts_are_dealt_by_bytes(spark):
    menu = "<p>" + " ".join(f"m{k}" for k in range(12)) + "</p>"
    pages = html_pages(spark, [("http://h/x", f"{menu}<p>{' '.join(f'w{k}x{j}' for j in range(400))}</p>") for k in range(30)])
    one, many = (sorted(map(tuple, html_extraction.extract_main_text(pages, **how).collect())) for how in ({}, {"group_bytes": 4000}))
    assert one == many and all("m0" not in row[2] for row in one)


def test_html_query_by_brute_force_without_articles(spark, sf_dir, tmp_path):
    """The given pages with their article marks, menus and adverts as plain divisions: runs of 8 words of two contents of the host decide."""
    import html

    pages = {r["page_id"]: (r["url"], re.sub("<(/?)(?:article|nav|footer)>", r"<\1div>", r["html"]).replace(' class="ad"', "")) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    twin = min(pages)
    pages[10**6] = (pages[twin][0] + "&twin", pages[twin][1])
    spark.createDataFrame([(i, u, h) for i, (u, h) in pages.items()], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    blocks = {}
    for i, (_, h) in pages.items():
        body = re.sub("(?s)<head>.*?</head>|<script>.*?</script>|<style>.*?</style>|<!--.*?-->", "", h)
        cut = re.split("</?(?:p|h1|div|ul|li|body|html|!DOCTYPE)[^>]*>", body)
        blocks[i] = [t for t in (" ".join(html.unescape(re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in cut) if t]
    host = {i: re.search("://([^/?#]*)", u)[1].lower() for i, (u, _) in pages.items()}
    having = {}
    for i, bs in blocks.items():
        words = " ".join(bs).split()
        for k in range(len(words) - 7):
            having.setdefault((host[i], tuple(words[k : k + 8])), set()).add("\n".join(bs))
    for row in queries.op9_html_extraction(spark, str(tmp_path)).collect():
        i = row["page_id"]
        words, at, want = " ".join(blocks[i]).split(), 0, []
        covered = [False] * len(words)
        for k in range(len(words) - 7):
            if len(having[host[i], tuple(words[k : k + 8])]) > 1:
                covered[k : k + 8] = [True] * 8
        for b in blocks[i]:
            n = len(b.split())
            if not all(covered[at : at + n]):
                want.append(b)
            at += n
        assert (row["text"], row["n_chars"]) == ("\n".join(want), len("\n".join(want))), i


def test_html_query(spark, sf_dir):
    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    import html

    for r in queries.op9_html_extraction(spark, sf_dir).collect():
        inner = re.search("(?s)<article>(.*)</article>", rows[r["page_id"]])[1]
        want = "\n".join(t for t in (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)) if t)
        assert (r["text"], r["n_chars"]) == (want, len(want))


# -- languages ------------------------------------------------------------------------------


def test_language_query(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op10_language_id(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    learn = [(i, "der die das und ist nicht " * 5 if i % 2 else "the and of that with this " * 5, "de" if i % 2 else "en") for i in range(60)]
    asked = [(100, None, "en"), (101, "", None), (102, "123 !?", "en"), (103, "the and of " * 20_000, None), (104, "und nicht die das", None), (104, "und nicht die das", None), (None, "of that with the", None)]
    got = language_id.identify_languages(frame(spark, learn + asked)).collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert by[100] == by[101] == by[102] == ("und", 0.0)
    assert (by[103][0], by[104][0], by[None][0]) == ("en", "de", "en")
    assert len(got) == len(learn) + len(asked)
    assert language_id.identify_languages(frame(spark, [])).collect() == []
    assert [r["lang_pred"] for r in language_id.identify_languages(texts(spark, ["no labels here"])).collect()] == ["und"]
    kept = language_id.keep_identified(frame(spark, learn + asked))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert {r["doc_id"] for r in kept.filter("doc_id >= 100").collect()} == {103, 104}


def small_net(seed=1):
    net = language_id.train(["abab" * 8, "cdcd" * 8, "efgh" * 8] * 3, ["x", "y", "z"] * 3, steps=3, filters=3, widths=(2, 3), length=16, seed=seed)
    for p in (*net.tables, net.bias, net.out, net.out_bias):
        p += np.random.RandomState(seed).randn(*p.shape).astype(np.float32) * 0.3
    net.tables, net.bias, net.out, net.out_bias = [t.astype(np.float64) for t in net.tables], net.bias.astype(np.float64), net.out.astype(np.float64), net.out_bias.astype(np.float64)
    return net


def test_network_gradient():
    """Every gradient agrees with the numeric derivative of the loss."""
    net = small_net()
    x, _, _ = language_id.cut([b"abcd" * 4, b"cdcd" * 4, b"efga" * 3], 16)
    y = np.array([0, 1, 2])
    loss = lambda: -np.log(language_id.softmax(net.logits(x))[np.arange(3), y]).mean()
    r = np.random.RandomState(3)
    for p, g in zip((*net.tables, net.bias, net.out, net.out_bias), language_id.gradients(net, x, y), strict=True):
        used = np.flatnonzero(g.ravel())
        for at in {*r.choice(used, 8), *r.randint(0, p.size, 4)}:
            was = p.flat[at]
            p.flat[at] = was + 1e-6
            above = loss()
            p.flat[at] = was - 1e-6
            below = loss()
            p.flat[at] = was
            assert abs((above - below) / 2e-6 - g.flat[at]) < 1e-6


def plain_score(net, text):
    """The forward pass by loops: windows, filters, maxima, linear layer, softmax of the mean weighted by bytes."""
    data, sums, weight = text.encode(), [0.0] * len(net.labels), 0
    for at in range(0, len(data), net.length):
        window = [*data[at : at + net.length]]
        n = len(window)
        window += [language_id.PAD] * (net.length - n)
        pooled = []
        for table in net.tables:
            for f in range(table.shape[2]):
                pooled.append(max(sum(float(table[k][window[i + k]][f]) for k in range(len(table))) for i in range(net.length - len(table) + 1)))
        pooled = [max(0.0, v + float(b)) for v, b in zip(pooled, net.bias, strict=True)]
        for j in range(len(net.labels)):
            sums[j] += n * (float(net.out_bias[j]) + sum(v * float(w) for v, w in zip(pooled, net.out[:, j], strict=True)))
        weight += n
    z = np.array(sums) / weight
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return net.labels[int(p.argmax())], float(p.max())


def test_language_query_by_plain_loops(spark, sf_dir):
    """The query's predictions equal a forward pass by loops with the model that it fits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = language_id.fit(docs.select("doc_id", "text", "lang"))
    text = {r["doc_id"]: r["text"] for r in docs.filter("length(text) < 1500").collect()}
    rows = [r for r in queries.op10_language_id(spark, sf_dir).collect() if r["doc_id"] in text][:12]
    for r in rows:
        label, score = plain_score(net, text[r["doc_id"]])
        assert r["lang_pred"] == label and abs(r["score"] - score) < 1e-4
    net = small_net(2)
    values = ["abcé" * 50, "cd", "efgh" * 4, "x" * 17, "abab" * 100]
    for block in (1, 2, 512):
        labels, scores = language_id.predict(net, values, block=block)
        assert [(a, round(b, 6)) for a, b in zip(labels, scores, strict=True)] == [(a, round(b, 6)) for a, b in (plain_score(net, v) for v in values)]


def test_many_labels_and_ids_of_many_rows(spark):
    many = frame(spark, [(i, f"words of {i % 1203} and some more", f"l{i % 1203}") for i in range(3000)])
    want = {f"l{i % 1203}" for i in range(3000) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(language_id.fit(many, steps=1).labels) == want and len(want) > 1100  # none is left out, however many there are
    taught, ids = [], [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(language_id, "train", lambda texts, labels, **_: taught.append((texts, labels)))
        language_id.fit(many, budget_chars=1203 * 10)
        again = frame(spark, [(ids[0], f"text {i % 500}", "a") for i in range(3000)] + [(ids[1], "one", "b")] * 100)  # an id of very many rows
        for _ in range(2):
            language_id.fit(again.repartition(7), per_label=20)
    assert max(map(len, taught[0][0])) == 10 and set(taught[0][1]) == want
    assert taught[1] == taught[2] and taught[1][1].count("a") == 40 and taught[1][1].count("b") == 1


def test_language_stage_with_clashing_names(spark):
    rows = [(i, "the words of a text in plain English", "en", "a", "b") for i in range(60)] + [(99, None, "en", "a", "b")]
    names = ["Predicted Language", "PREDICTED language_"]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, `{names[0]}` string, `{names[1]}` string")
    kept = language_id.keep_identified(docs, steps=20)
    assert kept.columns == docs.columns and kept.count() == 60


# -- pipeline ---------------------------------------------------------------------------------


def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir):
    from test_pairs_and_passages import brute_components, brute_dedup, brute_hits

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert len(rows) >= docs.count() - 3
    labels = brute_components(list(rows.items()))
    rows = {i: t for i, t in rows.items() if labels[i][1] == i}
    cut = brute_dedup(list(rows.items()))
    rows = {i: cut[i][2] if cut[i][1] else t for i, t in rows.items()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = brute_hits(list(rows.items()), items)
    rows = {i: t for i, t in rows.items() if not (hits[i][1] > 0 and 20 * hits[i][1] >= hits[i][0])}
    library = unigram_library()
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {i: library.encode(t) for i, t in rows.items()}


def test_pipeline_on_odd_tables(spark, tmp_path):
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    bench = spark.createDataFrame([(1, "aa bb cc")], "item_id long, text string")
    for name, rows in (("empty", []), ("odd", [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "some english words of the text", "en", "s", 5), (3, "some english words of the text", "en", "s", 5), (4, "mots de la langue et du pays", "fr", "s", 5), (None, "a b", "en", None, 1)])):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, ddl).write.parquet(f"{folder}/documents.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.schema == docs.schema
            docs = spark.createDataFrame(out.collect(), docs.schema)
        got = corpus_pipeline.run(spark, folder).collect()
        assert len(got) <= len(rows) and (not rows or got)
    assert F is not None
