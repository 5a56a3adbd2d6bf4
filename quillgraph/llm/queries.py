"""One thin query for each training-data operator: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hamming_topk, url_filters
from .hamming_topk import nearest_by_hamming
from .fingerprints import fingerprint_edits
from .html_extraction import extract_main_text
from .interval_join import click_sessions, relate_intervals, sale_intervals
from .language_id import identify_languages
from .license_scan import scan_licenses
from .ngram_jaccard import jaccard_components
from .positional_index import contamination
from .sentencepiece_codec import encode_texts
from .spelling_variants import spelling_variants
from .substring_dedup import dedup_substrings
from .token_counts import count_tokens
from .url_filters import filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_ALNUM_WORDS = rf"regexp_extract_all(coalesce({_LOWER_SQL}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=5, percent=75)


ORACLE_SQL["op5_ngram_jaccard"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_BLANK_WORDS.format(_LOWER_SQL)} AS ws FROM documents),
f AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 4], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT w.doc_id, coalesce(x.n, 0) AS n FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id) x ON x.doc_id = w.doc_id),
k AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.h = b.h AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
e AS MATERIALIZED (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT node, min(other) AS component_id FROM r GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, component_id, coalesce(l, 0) AS n_links FROM n JOIN c ON c.node = n.doc_id LEFT JOIN (SELECT a, count(*) AS l FROM e GROUP BY a) x ON x.a = n.doc_id"""


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"), min_words=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL["op6_substring_dedup"] = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {_BLANK_WORDS.format("text")} AS ws FROM documents),
v AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS r FROM v) WHERE r > 1),
c AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM g),
a AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
k AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.i) AS kept FROM a ANTI JOIN c ON c.doc_id = a.doc_id AND c.i = a.i GROUP BY a.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id) m ON m.doc_id = w.doc_id"""


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


ORACLE_SQL["op8_benchmark_decontamination"] = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM_WORDS} AS ws FROM benchmark),
p AS MATERIALIZED (SELECT DISTINCT item, least(len(ws), 13) AS size, array_to_string(ws[i:i + 12], ' ') AS t FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
w AS MATERIALIZED (SELECT doc_id, {_ALNUM_WORDS} AS ws FROM documents),
v AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS t FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, (SELECT DISTINCT size FROM p) WHERE len(ws) >= size)),
h AS MATERIALIZED (SELECT v.doc_id, v.i, v.size, p.item FROM v JOIN p ON p.size = v.size AND p.t = v.t),
n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS i FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id"""


@query
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("n_candidates")


ORACLE_SQL["op3_url_filters"] = url_filters.sql()


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


@query
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query
def op7_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_by_hamming(table(spark, sf_dir, "embeddings"), k=10, every=50)


ORACLE_SQL["op7_hamming_topk"] = hamming_topk.sql()


@query
def op11_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = sale_intervals(table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines"))
    return relate_intervals(sales, click_sessions(table(spark, sf_dir, "clicks")))


# crc32 of the bytes of an ASCII text: the table of its polynomial, then a fold over the bytes
_CRC_TABLE = "crc_table AS MATERIALIZED (SELECT list(list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY x) AS t FROM range(256) r(x))"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({bytes}, lambda b: b::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"
_CRC_DIGITS = _CRC.format(bytes="list_transform(string_split({0}, ''), lambda ch: ascii(ch))")

ORACLE_SQL["op11_interval_join"] = f"""
WITH {_CRC_TABLE},
k AS (SELECT client_id, epoch_us(ts) AS us, coalesce(kind = 'error', false) AS err FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
g AS (SELECT *, us - lag(us) OVER (PARTITION BY client_id ORDER BY us) > 900000000 AS far FROM k),
m AS (SELECT *, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY us) AS run FROM g),
z AS (SELECT client_id, run, min(us) AS lo, max(us) AS hi FROM m GROUP BY client_id, run),
c AS MATERIALIZED (SELECT z.client_id, lo // 21600000000 AS a, CASE WHEN bool_or(err) THEN 1099511627776 ELSE hi // 21600000000 END AS b, {_CRC_DIGITS.format("lo::VARCHAR")} AS crc
  FROM z JOIN m ON m.client_id = z.client_id AND m.run = z.run AND m.us = z.hi, crc_table GROUP BY z.client_id, lo, hi, t),
h AS (SELECT sale_id, max(epoch_us(shipped_at)) AS shipped FROM sale_lines GROUP BY sale_id),
s AS (SELECT sales.sale_id, client_id, epoch_us(sold_at) // 21600000000 AS s, CASE WHEN status = 'open' THEN 1099511627776 ELSE greatest(epoch_us(sold_at), coalesce(shipped, epoch_us(sold_at))) // 21600000000 END AS e
  FROM sales LEFT JOIN h ON h.sale_id = sales.sale_id WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
p AS (SELECT sale_id, crc, CASE WHEN s < a THEN CASE WHEN e < b THEN 'overlaps' WHEN e = b THEN 'finished_by' ELSE 'contains' END
    WHEN s = a THEN CASE WHEN e < b THEN 'starts' WHEN e = b THEN 'equals' ELSE 'started_by' END
    ELSE CASE WHEN e < b THEN 'during' WHEN e = b THEN 'finishes' ELSE 'overlapped_by' END END AS relation,
  CASE WHEN e < 1099511627776 OR b < 1099511627776 THEN least(e, b) - greatest(s, a) + 1 END AS slots FROM s JOIN c ON c.client_id = s.client_id AND s <= b AND e >= a)
SELECT sale_id, relation, count(*) AS n_pairs, sum(slots)::BIGINT AS overlap_slots, sum(crc)::BIGINT AS sessions_crc FROM p GROUP BY sale_id, relation"""


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), min_length=5, min_count=3)


# bytes of a text without characters beyond U+00FF
_LATIN_BYTES = "flatten(list_transform(string_split({0}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE [192 + (unicode(ch) >> 6), 128 + (unicode(ch) & 63)] END))"

ORACLE_SQL["op12_spelling_variants"] = f"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
d AS MATERIALIZED (SELECT coalesce(doc_id::VARCHAR, '') AS id, {_LOWER_SQL.replace("text", "run")} AS run, count(*) AS n FROM r GROUP BY ALL),
h AS MATERIALIZED (SELECT run, n, {_CRC.format(bytes=_LATIN_BYTES.format("id || ':' || run"))} AS h FROM d, crc_table),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h) GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
x AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word AS a, b.word AS b FROM x a JOIN w b ON b.word = a.less UNION SELECT a.word, b.word FROM x a JOIN x b ON a.less = b.less AND a.i = b.i AND a.word < b.word),
q AS MATERIALIZED (SELECT a AS word, b AS other FROM p UNION SELECT b, a FROM p),
o AS (SELECT q.word, other, w.n AS other_n, row_number() OVER (PARTITION BY q.word ORDER BY w.n DESC, encode(other)) AS place, count(*) OVER (PARTITION BY q.word) AS n_near FROM q JOIN w ON w.word = q.other),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM w LEFT JOIN o ON o.word = w.word AND place = 1),
t AS (SELECT word, word AS root FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL),
e AS (SELECT t.word, root FROM t JOIN f ON f.word = t.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN e ON e.word = f.word"""


@query
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
