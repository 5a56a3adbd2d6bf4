"""Registered queries on the driver's tables, and the SQL that gives the same rows.

Inputs are derived from whole tables: propositions by relational mapping (customers are located
in nations, nations are part of regions, suppliers supply parts; a document a region),
engine replies from customers, texts from documents, surface variants from parts.
"""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sql
from .functions.taxonomy import TYPE_COLOR
from .functions.text import file_title, norm_key, sanitize_title, slug_title, xml_escape, yaml_string
from .operators import chunking, extraction, graph, guard, inspect, resolution
from .operators.components import components
from .plans.engines import ChunkContext, FatalEngineError, RuleEngine
from .plans.pipeline import extract_chunks, outcomes_of_replies, run_pipeline, suggest_titles
from .plans.reply_log import LoggedEngine, read_log
from .session import saved, scratch, spread
from .sinks import export, files, persist
from .sources.ingest import join_pages, pasted, read_files, simple_pdf_pages, stream_files
from .streaming.carry import start_extraction

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- texts ---------------------------------------------------------------------

_LAID_OUT = "CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), chr(10) || chr(10)) WHEN 1 THEN replace(text, chr(10), chr(10) || '# ') ELSE text END"


def laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with blank lines in every third text and headings in every third."""
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_LAID_OUT).alias("text"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS INTEGER) AS token_estimate FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.with_token_estimate(table(spark, sf_dir, "documents")).select("doc_id", "token_estimate")


@query("SELECT doc_id, ceil(length(text) / 4.0) > 9000 AS over_limit, ceil(length(text) / 4.0) > 900 AS over_chunk FROM documents")
def guardrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = guard.over_limit(table(spark, sf_dir, "documents"))
    return guard.over_limit(docs.withColumnRenamed("over_limit", "was"), limit=900).select("doc_id", F.col("was").alias("over_limit"), F.col("over_limit").alias("over_chunk"))


@query("SELECT doc_id, substr(text, 1, 3600) AS text FROM documents")
def truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.truncate(table(spark, sf_dir, "documents"), limit=900).select("doc_id", "text")


_BLOCKS = rf"""
t AS (SELECT doc_id, {_LAID_OUT} AS text FROM documents),
m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\n\s*\n', chr(1), 'g'), '(?m)^(#{{1,6}}\s)', chr(1) || '\1', 'g') AS text FROM t),
b AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS bs FROM m),
blocks AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS block_index, bs[i] AS block FROM (SELECT doc_id, bs, unnest(range(1, len(bs) + 1)) AS i FROM b))"""


@query(f"WITH {_BLOCKS} SELECT doc_id, block_index, block FROM blocks")
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_document_blocks(laid_out(spark, sf_dir))


@query(
    rf"""WITH {_BLOCKS}, s AS (SELECT doc_id, block_index, regexp_extract_all(block, '[^.!?]+[.!?]+["'')\]]*\s*|[^.!?]+$') AS ss FROM blocks)
SELECT doc_id, block_index, CAST(i - 1 AS INTEGER) AS sentence_index, ss[i] AS sentence FROM (SELECT doc_id, block_index, ss, unnest(range(1, len(ss) + 1)) AS i FROM s)"""
)
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_document_sentences(laid_out(spark, sf_dir))


def _chunk_parts(target: int, overlap: int) -> str:
    """From blocks: sentence folds of oversized ones, pieces, packing, and chunks with their overlap, as ck(doc_id, chunk_index, text)."""
    size, lead = target * 4, overlap * 4
    trim = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
    slices = f"list_transform(range(0, {{0}}), lambda k: {trim.format(f'substr({{1}}, CAST(k * {size} + 1 AS BIGINT), {size})')})"
    over = "ceil(length({0}) / 4.0) > " + str(target)
    return rf"""
big AS MATERIALIZED (SELECT doc_id, block_index, CASE WHEN len(ss) > 0 THEN ss ELSE [block] END AS ss FROM (SELECT doc_id, block_index, block, regexp_extract_all(block, '[^.!?]+[.!?]+["'')\]]*\s*|[^.!?]+$') AS ss FROM blocks WHERE {over.format("block")})),
fold AS (SELECT doc_id, block_index, 0 AS i, '' AS held, CAST([] AS VARCHAR[]) AS em FROM big
  UNION ALL SELECT doc_id, block_index, i, substr(h, CAST(n * {size} + 1 AS BIGINT)), list_concat(ended, {slices.format("n", "h")}) FROM
  (SELECT *, CASE WHEN length(h) > {size} THEN (length(h) - 1) // {size} ELSE 0 END AS n FROM
  (SELECT f.doc_id, f.block_index, f.i + 1 AS i, CASE WHEN held <> '' AND {over.format("held || ss[f.i + 1]")} THEN [{trim.format("held")}] ELSE CAST([] AS VARCHAR[]) END AS ended,
    CASE WHEN held <> '' AND {over.format("held || ss[f.i + 1]")} THEN ss[f.i + 1] ELSE held || ss[f.i + 1] END AS h FROM fold f JOIN big b ON b.doc_id = f.doc_id AND b.block_index = f.block_index WHERE f.i < len(ss)))),
raw AS (SELECT doc_id, block_index, i, unnest(range(1, len(em) + 1)) AS k, unnest(em) AS piece FROM fold
  UNION ALL SELECT f.doc_id, f.block_index, f.i + 1, 0, {trim.format("held")} FROM fold f JOIN big b ON b.doc_id = f.doc_id AND b.block_index = f.block_index WHERE f.i = len(ss) AND {trim.format("held")} <> ''
  UNION ALL SELECT doc_id, block_index, 0, 0, block FROM blocks WHERE NOT ({over.format("block")})),
pcs AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_index, i, k) AS p, piece, CAST(ceil(length(piece) / 4.0) AS BIGINT) AS t FROM raw),
pk AS (SELECT doc_id, p, t AS total, 0 AS c FROM pcs WHERE p = 1
  UNION ALL SELECT pk.doc_id, q.p, CASE WHEN total > 0 AND total + t > {target} THEN t ELSE total + t END, CASE WHEN total > 0 AND total + t > {target} THEN c + 1 ELSE c END FROM pk JOIN pcs q ON q.doc_id = pk.doc_id AND q.p = pk.p + 1),
body AS MATERIALIZED (SELECT pk.doc_id, c, string_agg(piece, chr(10) || chr(10) ORDER BY pk.p) AS body FROM pk JOIN pcs ON pcs.doc_id = pk.doc_id AND pcs.p = pk.p GROUP BY pk.doc_id, c),
ck AS (SELECT doc_id, CAST(c AS INTEGER) AS chunk_index, body AS text FROM body WHERE c = 0
  UNION ALL SELECT b.doc_id, CAST(b.c AS INTEGER), CASE WHEN {overlap} > 0 AND l <> '' THEN l || chr(10) || chr(10) || body ELSE body END FROM
  (SELECT doc_id, chunk_index, CASE WHEN length(text) <= {lead} THEN text ELSE regexp_replace(right(text, {lead}), '^(?s:.*?)[.!?]\s+', '') END AS l FROM ck) x JOIN body b ON b.doc_id = x.doc_id AND b.c = x.chunk_index + 1)"""


def _chunk_sql(target: int, overlap: int) -> str:
    return f"WITH RECURSIVE {_BLOCKS}, {_chunk_parts(target, overlap)} SELECT doc_id, chunk_index, text, CAST(ceil(length(text) / 4.0) AS INTEGER) AS token_estimate FROM ck"


@query(_chunk_sql(900, 120))
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(laid_out(spark, sf_dir))


@query(_chunk_sql(100, 20))
def chunks_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(laid_out(spark, sf_dir), target=100, overlap=20)


@query(_chunk_sql(100, 20))
def sql_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in Spark SQL, by a table function for each text."""
    sql.register(spark)
    return spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL chunk_text(d.text, 100, 20) c", docs=laid_out(spark, sf_dir))


@query(_chunk_sql(100, 20))
def chunks_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(laid_out(spark, sf_dir), target=100, overlap=20, native=True)


@query(
    r"""WITH t AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1] AS line FROM conversations),
u AS (SELECT conv_id, turn, regexp_replace(line, '^["''“”‘’#*\s]+|["''“”‘’.!*\s]+$', '', 'g') AS line FROM t)
SELECT conv_id, turn, nullif(regexp_replace(substr(line, 1, 80), '^\s+|\s+$', '', 'g'), '') AS title FROM u"""
)
def title_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sanitize_title("text").alias("title"))


@query(
    r"""SELECT conv_id AS doc_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE t <> ''), '') AS text
FROM (SELECT conv_id, turn, trim(regexp_replace(role || ' ' || text, '\s+', ' ', 'g')) AS t FROM conversations) GROUP BY conv_id"""
)
def page_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return join_pages(turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.array("role", "text").alias("items")))


_NATION_FILES = "CASE n_nationkey % 6 WHEN 0 THEN 'txt' WHEN 1 THEN 'MD' WHEN 2 THEN 'docx' WHEN 3 THEN 'html' WHEN 4 THEN 'pdf' ELSE 'bin' END"


def _docx(*paragraphs: str) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def _pdf(*pages: str) -> bytes:
    kids = " ".join(f"{3 + 2 * i} 0 R" for i in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Resources << /Font << /F << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> >> >> >>".encode()]
    for i, text in enumerate(pages):
        data = zlib.compress(f"BT /F 12 Tf 72 700 Td ({text}) Tj ET".encode("cp1252"))
        objects += [f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * i} 0 R >>".encode(), b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(data), data)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


def _files_sql(pdf_text: str, pdf_error: str) -> str:
    return f"""WITH f AS (SELECT n_nationkey, n_name, {_NATION_FILES} AS ext FROM nation) SELECT n_name || '.' || n_nationkey AS title, CASE lower(ext) WHEN 'docx' THEN n_name || chr(10) || chr(10) || 'né' || chr(10) || chr(10) WHEN 'pdf' THEN {pdf_text} WHEN 'bin' THEN NULL ELSE n_name || ' né' END AS text,
CASE ext WHEN 'bin' THEN 'there is no reader for bin files'{pdf_error} END AS error FROM f"""


def nation_files(spark: SparkSession, sf_dir: str, folder: str, half: int | None = None) -> None:
    """A file a nation, of six types, in the shared folder; half tells whether those of even or odd keys."""
    jvm = spark.sparkContext._jvm
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.expr(_NATION_FILES).alias("ext")).collect():  # 25
        if half is not None and r["n_nationkey"] % 2 != half:
            continue
        make = {"docx": _docx, "pdf": _pdf}.get(r["ext"], lambda *parts: " ".join(parts).encode())
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{r['n_name']}.{r['n_nationkey']}.{r['ext']}")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
        out.write(bytearray(make(r["n_name"], "né")))
        out.close()


@query(_files_sql("n_name || chr(10) || chr(10) || 'né'", ""))
def ingested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a nation, of six types, read from the shared folder; PDF by a decoder of simple files."""
    folder = f"{scratch(spark)}/files-{uuid.uuid4().hex}"
    nation_files(spark, sf_dir, folder)
    docs, errors = read_files(spark, folder, pdf=simple_pdf_pages)
    return docs.select("title", "text", F.lit(None).cast("string").alias("error")).union(errors.select(file_title("path"), F.lit(None), "error"))


@query(_files_sql("NULL", " WHEN 'pdf' THEN 'PDF needs a decoder'"))
def streamed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a stream, without a decoder of PDF: half of them before it starts, half before it is started again on its checkpoint."""
    at = f"{scratch(spark)}/files-{uuid.uuid4().hex}"
    for half in range(2):
        nation_files(spark, sf_dir, f"{at}/in", half)
        stream = stream_files(spark, f"{at}/in", files_per_trigger=5).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint")
        stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").select("title", "text", "error")


_PASTE = "CASE turn % 4 WHEN 0 THEN '  ' || chr(10) WHEN 1 THEN NULL ELSE text END"


@query(f"SELECT conv_id * 1000 + turn AS doc_id, CASE WHEN turn % 4 > 1 THEN {_PASTE} END AS text, CASE WHEN turn % 4 < 2 THEN 'the text is blank' END AS error FROM conversations")
def pasted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.expr(_PASTE).alias("text"))
    docs, errors = pasted(given)
    return docs.select("doc_id", "text", F.lit(None).cast("string").alias("error")).union(errors.select("doc_id", F.lit(None), "error"))


_TITLES = "CASE doc_id % 3 WHEN 0 THEN 'Given ' || doc_id WHEN 1 THEN '' END"


@query(
    rf"""WITH li AS (SELECT doc_id, {_TITLES} AS given, array_to_string(regexp_extract_all(substr(text, 1, 4000), '\S+')[1:8], ' ') AS line FROM documents)
SELECT doc_id, CASE WHEN given <> '' THEN given ELSE nullif(regexp_replace(substr(regexp_replace(line, '^["''“”‘’#*\s]+|["''“”‘’.!*\s]+$', '', 'g'), 1, 80), '^\s+|\s+$', '', 'g'), '') END AS title FROM li"""
)
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that were given, else the engine's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_TITLES).alias("title"), "text")
    return suggest_titles(docs, RuleEngine())


_PROMPTED = ("CASE turn % 3 WHEN 0 THEN role WHEN 1 THEN '' END AS title", "CASE WHEN turn % 2 = 0 THEN array(role, 'conversation ' || conv_id) ELSE array() END AS prior")


@query(
    """SELECT conv_id, turn, concat_ws(chr(10) || chr(10), CASE WHEN turn % 3 = 0 THEN 'From the document: ' || role END, CASE WHEN turn % 2 = 0 THEN 'Known from earlier passages: ' || role || ', conversation ' || conv_id END,
'The passage:', text) AS prompt FROM conversations"""
)
def user_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "text", *_PROMPTED)
    return rows.select("conv_id", "turn", extraction.user_prompt(F.col("text"), F.col("title"), F.col("prior")).alias("prompt"))


@query(r"SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]+$', '') AS title FROM pages")
def file_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", file_title("url").alias("title"))


_ESCAPED = "replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query(
    f"""SELECT page_id, {_ESCAPED} AS xml, '"' || replace(replace(url, '\\', '\\\\'), '"', '\\"') || '"' AS yaml,
coalesce(nullif(trim(regexp_replace(coalesce(nullif(url, ''), 'graph'), '[\\\\/:*?"<>|]', '_', 'g')), ''), 'graph') AS slug FROM pages"""
)
def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", xml_escape("url").alias("xml"), yaml_string("url").alias("yaml"), slug_title("url").alias("slug"))


# -- replies -------------------------------------------------------------------

# A reply of every kind, by the customer's key: the same text in Spark and DuckDB.
_ITEM = """'{"id":"q' || c_custkey || '","text":" ' || c_name || ' is in it. ","subject":{"name":"' || c_name || ' ","type":"person"},"predicate":" is in","object":{"name":"' || c_mktsegment || '","type":"' || (CASE c_custkey % 3 WHEN 0 THEN 'concept' WHEN 1 THEN 'planet' ELSE 'other' END) || '"}}'"""
_BAD = """'{"id":"","text":"x","subject":{"name":7,"type":"person"},"predicate":"is","object":{"name":"y","type":"other"}}'"""
_NO_ID = """'{"text":"t","subject":{"name":"' || c_name || '"},"predicate":"has","object":{"name":"account","type":"concept"},"confidence":' || (CASE c_custkey % 4 WHEN 0 THEN '0.5' WHEN 1 THEN '1.5' WHEN 2 THEN '"0.5"' ELSE '1' END) || '}'"""
_REPLY = f"""CASE (c_custkey + attempt) % 9
WHEN 0 THEN '{{"propositions":[' || {_ITEM} || ']}}'
WHEN 1 THEN 'Here it is: ```json {{"propositions":[' || {_ITEM} || ',' || {_NO_ID} || ']}} ``` as asked'
WHEN 2 THEN 'I cannot do that.'
WHEN 3 THEN '{{"propositions":[' || {_ITEM} || ']}} done'
WHEN 4 THEN '{{"propositions":[' || {_BAD} || ',' || {_NO_ID} || ']}}'
WHEN 5 THEN '{{"propositions":{{"a":1}}}}'
WHEN 6 THEN '{{"propositions":[]}}'
WHEN 7 THEN '{{"propositions":[' || {_ITEM}
ELSE '  {{"other":1,"propositions":[3,' || {_NO_ID} || ',null]}}  ' END"""
_REPLY_COLUMNS = ("CAST(c_nationkey AS BIGINT) AS doc_id", "CAST(c_custkey AS INTEGER) AS chunk_index", "attempt", f"{_REPLY} AS reply")
_REPLIES_SQL = f"replies AS (SELECT {', '.join(_REPLY_COLUMNS)} FROM customer CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS attempt))"


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four replies a customer. Reading them takes much longer than the few bytes of a customer suggest, so rows are dealt over all cores, however few splits the table has."""
    return spread(table(spark, sf_dir, "customer"), "c_custkey").withColumn("attempt", F.explode(F.array(*map(F.lit, (1, 2, 3, 4))))).selectExpr(*_REPLY_COLUMNS)


_VALID = rf"""c AS (SELECT *, regexp_replace(reply, '^\s+|\s+$', '', 'g') AS t FROM replies),
j AS (SELECT *, nullif(CASE WHEN starts_with(t, '{{') THEN t ELSE regexp_extract(t, '(?s)\{{.*\}}') END, '') AS cand FROM c),
v AS (SELECT *, CASE WHEN cand IS NOT NULL AND json_valid(cand) THEN CASE WHEN json_type(cand, '$.propositions') = 'ARRAY' THEN json_extract(cand, '$.propositions') END END AS ps FROM j),
e AS (SELECT doc_id, chunk_index, attempt, i - 1 AS i, json_extract(ps, '$[' || (i - 1) || ']') AS p FROM (SELECT *, unnest(range(1, CAST(json_array_length(ps) AS BIGINT) + 1)) AS i FROM v WHERE ps IS NOT NULL)),
f AS (SELECT doc_id, chunk_index, attempt, i,
  CASE WHEN json_type(p, '$.id') = 'VARCHAR' AND json_extract_string(p, '$.id') <> '' THEN json_extract_string(p, '$.id') ELSE 'p' || (i + 1) END AS local_id,
  CASE WHEN json_type(p, '$.text') = 'VARCHAR' THEN nullif(trim(json_extract_string(p, '$.text')), '') END AS text,
  CASE WHEN json_type(p, '$.predicate') = 'VARCHAR' THEN nullif(trim(json_extract_string(p, '$.predicate')), '') END AS predicate,
  CASE WHEN json_type(p, '$.subject.name') = 'VARCHAR' THEN nullif(trim(json_extract_string(p, '$.subject.name')), '') END AS s_name,
  CASE WHEN json_type(p, '$.object.name') = 'VARCHAR' THEN nullif(trim(json_extract_string(p, '$.object.name')), '') END AS o_name,
  CASE WHEN json_extract_string(p, '$.subject.type') IN {tuple(TYPE_COLOR)} THEN json_extract_string(p, '$.subject.type') ELSE 'other' END AS s_type,
  CASE WHEN json_extract_string(p, '$.object.type') IN {tuple(TYPE_COLOR)} THEN json_extract_string(p, '$.object.type') ELSE 'other' END AS o_type,
  CASE WHEN json_type(p, '$.confidence') NOT IN ('VARCHAR') AND CAST(json_extract_string(p, '$.confidence') AS DOUBLE) BETWEEN 0 AND 1 THEN CAST(json_extract_string(p, '$.confidence') AS DOUBLE) END AS confidence
  FROM e),
g AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, chunk_index, attempt ORDER BY i) - 1 AS INTEGER) AS pos FROM f WHERE text IS NOT NULL AND predicate IS NOT NULL AND s_name IS NOT NULL AND o_name IS NOT NULL)"""


@query(
    f"""WITH {_REPLIES_SQL}, {_VALID},
n AS (SELECT doc_id, chunk_index, attempt, count(*) AS n FROM g GROUP BY ALL)
SELECT doc_id, chunk_index, attempt, ps IS NOT NULL AS usable, CAST(CASE WHEN ps IS NOT NULL THEN coalesce(n, 0) END AS INTEGER) AS kept FROM v LEFT JOIN n USING (doc_id, chunk_index, attempt)"""
)
def parse_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = extraction.parse_replies(replies(spark, sf_dir))
    return parsed.select("doc_id", "chunk_index", "attempt", F.col("propositions").isNotNull().alias("usable"), F.when(F.col("propositions").isNotNull(), F.size("propositions")).alias("kept"))


def _schema_objects() -> list[tuple[str, list[str], list[str], bool]]:
    """(path, properties, required, whether others are allowed) of each object of the strict output schema."""
    rows, todo = [], [("", extraction.strict_schema(extraction.EXTRACTION_SCHEMA))]
    while todo:
        path, node = todo.pop()
        if node["type"] == "object":
            rows.append((path, sorted(node["properties"]), sorted(node["required"]), node["additionalProperties"]))
            todo += [(f"{path}.{name}", x) for name, x in node["properties"].items()]
        elif node["type"] == "array":
            todo.append((f"{path}[]", node["items"]))
    return rows


@query(
    f"""WITH {_REPLIES_SQL}, {_VALID},
ob AS (SELECT '' AS path, cand AS o FROM v WHERE cand IS NOT NULL AND json_valid(cand) AND json_type(cand) = 'OBJECT'
  UNION ALL SELECT '.propositions[]', p FROM e WHERE json_type(p) = 'OBJECT'
  UNION ALL SELECT '.propositions[].subject', json_extract(p, '$.subject') FROM e WHERE json_type(p, '$.subject') = 'OBJECT' UNION ALL SELECT '.propositions[].object', json_extract(p, '$.object') FROM e WHERE json_type(p, '$.object') = 'OBJECT'),
sc AS (SELECT * FROM (VALUES ('', ['propositions']), ('.propositions[]', ['id', 'object', 'predicate', 'subject', 'text']), ('.propositions[].subject', ['name', 'type']), ('.propositions[].object', ['name', 'type'])) AS t(path, names))
SELECT sc.path, array_to_string(names, ',') AS properties, array_to_string(names, ',') AS required, false AS further, count(*) AS objects,
count(*) FILTER (WHERE len(list_filter(names, lambda n: NOT list_contains(json_keys(o), n))) > 0) AS lacking, count(*) FILTER (WHERE len(list_filter(json_keys(o), lambda k: NOT list_contains(names, k))) > 0) AS exceeding
FROM sc JOIN ob ON ob.path = sc.path GROUP BY sc.path, names"""
)
def strict_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object of the strict output schema, and how many objects of the replies there are at its path, lack what it requires, or have more."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    whole = replies(spark, sf_dir).select(extraction.strict_json(extraction.candidate_json(F.col("reply"))).alias("whole"))
    items = whole.select("whole", F.posexplode_outer(F.try_variant_get("whole", "$.propositions", "array<variant>")).alias("i", "item"))
    at = lambda path, v: F.struct(F.lit(path).alias("path"), v.alias("v"))
    part = lambda name: at(f".propositions[].{name}", F.try_variant_get("item", f"$.{name}", "variant"))
    first = F.when(F.coalesce("i", F.lit(0)) == 0, F.col("whole"))  # a reply counts once, with its first item or none
    objects = items.select(F.inline(F.array(at("", first), at(".propositions[]", F.col("item")), part("subject"), part("object"))))
    keyed = objects.filter(F.schema_of_variant("v").startswith("OBJECT")).select("path", F.json_object_keys(F.to_json("v")).alias("k"))
    schema = spark.createDataFrame(_schema_objects(), "path string, properties array<string>, required array<string>, further boolean")
    # broadcast by name: by its table's size, Spark takes the side of the replies for the small one
    both = keyed.join(F.broadcast(schema), "path").groupBy("path", "properties", "required", "further")
    some = lambda a, b: F.sum((F.size(F.array_except(a, b)) > 0).cast("long"))
    counted = both.agg(F.count("*").alias("objects"), some("required", "k").alias("lacking"), some("k", "properties").alias("exceeding"))
    return counted.withColumns({c: F.array_join(c, ",") for c in ("properties", "required")})


_FIRST = """, a AS (SELECT doc_id, chunk_index, CAST(count(*) AS INTEGER) AS attempts, CAST(min(attempt) FILTER (WHERE ps IS NOT NULL) AS INTEGER) AS attempt FROM v WHERE attempt <= 3 GROUP BY ALL)"""


@query(f"WITH {_REPLIES_SQL}, {_VALID}{_FIRST} SELECT * FROM a")
def first_valid_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.first_valid_attempts(extraction.parse_replies(replies(spark, sf_dir))).select("doc_id", "chunk_index", "attempts", "attempt")


@query(
    f"""WITH {_REPLIES_SQL}, {_VALID}{_FIRST}
SELECT g.doc_id, g.chunk_index, pos, local_id, text, s_name, s_type, predicate, o_name, o_type, confidence FROM g JOIN a ON g.doc_id = a.doc_id AND g.chunk_index = a.chunk_index AND g.attempt = a.attempt"""
)
def propositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extraction.proposition_rows(outcomes_of_replies(replies(spark, sf_dir)))
    return rows.select(
        "doc_id", "chunk_index", "pos", "local_id", "text", F.col("subject.name").alias("s_name"), F.col("subject.type").alias("s_type"), "predicate", F.col("object.name").alias("o_name"), F.col("object.type").alias("o_type"), "confidence"
    )


@query(
    f"""WITH {_REPLIES_SQL}, {_VALID}{_FIRST}
SELECT g.doc_id, g.chunk_index, pos, local_id, text, s_name, s_type, predicate, o_name, o_type, confidence FROM g JOIN a ON g.doc_id = a.doc_id AND g.chunk_index = a.chunk_index AND g.attempt = a.attempt"""
)
def sql_propositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in Spark SQL, by a table function for each reply."""
    sql.register(spark)
    return spark.sql(
        """WITH p AS (SELECT r.doc_id, r.chunk_index, r.attempt, p.* FROM {replies} r, LATERAL parse_reply(r.reply) p WHERE r.attempt <= 3),
        f AS (SELECT doc_id, chunk_index, min(attempt) AS attempt FROM p GROUP BY doc_id, chunk_index)
        SELECT p.doc_id, p.chunk_index, pos, local_id, text, subject.name AS s_name, subject.type AS s_type, predicate, object.name AS o_name, object.type AS o_type, confidence
        FROM p JOIN f ON f.doc_id = p.doc_id AND f.chunk_index = p.chunk_index AND f.attempt = p.attempt WHERE pos IS NOT NULL""",
        replies=replies(spark, sf_dir),
    )


class StoredModel:
    """A model whose replies stand in the passage itself, one an attempt; offline, it answers nothing."""

    id = model = "stored"

    def __init__(self, offline: bool = False):
        self.offline = offline

    def availability(self) -> str:
        return "ready"

    def init(self) -> None: ...

    def dispose(self) -> None: ...

    def ask(self, talk: list[dict]) -> str:
        if self.offline:
            raise FatalEngineError("offline")
        return talk[1]["content"].split(extraction._TASK, 1)[1].split(chr(31))[(len(talk) - 2) // 2]


def logged_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Outcomes of all passages from a model that is offline, after a run that logged its replies; and the log."""
    folder = f"{scratch(spark)}/replies-{uuid.uuid4().hex}"
    by_attempt = F.array_sort(F.collect_list(F.struct("attempt", "reply")))
    passages = replies(spark, sf_dir).groupBy("doc_id", "chunk_index").agg(F.array_join(by_attempt["reply"], chr(31)).alias("text"))
    passages = saved(passages, "passages")
    saved(extract_chunks(passages, LoggedEngine(StoredModel(), folder)), "first-run")
    return saved(extract_chunks(passages, LoggedEngine(StoredModel(offline=True), folder)), "second-run"), folder


@query(
    f"""WITH {_REPLIES_SQL}, {_VALID}{_FIRST}
SELECT g.doc_id, g.chunk_index, pos, local_id, text, s_name, s_type, predicate, o_name, o_type, confidence FROM g JOIN a ON g.doc_id = a.doc_id AND g.chunk_index = a.chunk_index AND g.attempt = a.attempt"""
)
def logged_propositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Propositions of a run that asked no model, as all replies were logged by the run before."""
    rows = extraction.proposition_rows(logged_run(spark, sf_dir)[0])
    return rows.select(
        "doc_id", "chunk_index", "pos", "local_id", "text", F.col("subject.name").alias("s_name"), F.col("subject.type").alias("s_type"), "predicate", F.col("object.name").alias("o_name"), F.col("object.type").alias("o_type"), "confidence"
    )


@query(
    f"""WITH {_REPLIES_SQL}, {_VALID}{_FIRST}
SELECT v.doc_id, v.chunk_index, v.attempt, ps IS NOT NULL AS usable FROM v JOIN a ON a.doc_id = v.doc_id AND a.chunk_index = v.chunk_index AND v.attempt <= coalesce(a.attempt, 3)"""
)
def logged_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a log holds after two runs: each attempt that had to be made, once."""
    log = read_log(spark, logged_run(spark, sf_dir)[1])
    parsed = extraction.parse_replies(log.select(F.col("document").cast("long").alias("doc_id"), "chunk_index", "attempt", "reply"))
    return parsed.select("doc_id", "chunk_index", "attempt", F.col("propositions").isNotNull().alias("usable"))


# Chunk states with failures by key: the engine failed for good at every 29th customer.
_OUTCOMES = """SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CAST(c_custkey AS INTEGER) AS chunk_index, c_custkey % 7 <> 3 AND c_custkey % 29 <> 17 AS ok,
CASE WHEN c_custkey % 29 = 17 THEN 'fatal ' || c_custkey WHEN c_custkey % 7 = 3 THEN 'soft ' || c_custkey END AS error, c_custkey % 29 = 17 AS fatal"""
_STATUS_SQL = f"""o AS ({_OUTCOMES} FROM customer), x AS (SELECT *, min(chunk_index) FILTER (WHERE fatal) OVER (PARTITION BY doc_id) AS cut FROM o),
s AS (SELECT doc_id, chunk_index, CASE WHEN chunk_index > cut THEN 'skipped' WHEN ok THEN 'ok' ELSE 'dropped' END AS state, CASE WHEN coalesce(chunk_index <= cut, true) AND NOT ok THEN error END AS error FROM x)"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.chunk_status(spark.sql(f"{_OUTCOMES} FROM {{customer}}", customer=table(spark, sf_dir, "customer")))


@query(f"WITH {_STATUS_SQL} SELECT * FROM s")
def chunk_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir)


@query(
    f"""WITH {_STATUS_SQL} SELECT doc_id, count(*) AS chunks, coalesce(string_agg(chunk_index, ',' ORDER BY chunk_index) FILTER (WHERE state <> 'ok'), '') AS dropped_chunks,
arg_max(error, chunk_index) FILTER (WHERE error IS NOT NULL) AS drop_error FROM s GROUP BY doc_id"""
)
def drop_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.drop_report(_status(spark, sf_dir)).withColumn("dropped_chunks", F.array_join(F.col("dropped_chunks").cast("array<string>"), ","))


# -- mapped propositions -----------------------------------------------------------

_PROPS = """
SELECT CAST(n_regionkey AS BIGINT) AS doc_id, 0 AS chunk_index, CAST(c_custkey AS INTEGER) AS pos, 'p1' AS local_id, c_name AS s_name, 'person' AS s_type, 'is located in' AS predicate, n_name AS o_name, 'location' AS o_type
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL SELECT CAST(n_regionkey AS BIGINT), 1, n_nationkey, 'p2', n_name, 'location', 'is part of', r_name, 'location' FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT CAST(n_regionkey AS BIGINT), CAST(2 + k % 14 AS INTEGER), CAST(k * 64 + l AS INTEGER), 'p' || l, s_name, 'organization', 'supplies', p_name, 'artifact'
FROM (SELECT l_orderkey AS k, l_suppkey AS s, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS l FROM {lineitem}) t
JOIN {supplier} ON s_suppkey = s JOIN {part} ON p_partkey = p JOIN {nation} ON s_nationkey = n_nationkey"""
_TABLES = ("customer", "nation", "region", "lineitem", "supplier", "part")
_KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '^(the|a|an)\s+', ''), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def mapped_propositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # places of a large table's lines pass 2^31: they stay of the key's own type here
    wide = _PROPS.replace("CAST(k * 64 + l AS INTEGER)", "k * 64 + l")
    rows = spark.sql(wide, **{t: table(spark, sf_dir, t) for t in _TABLES})
    text = F.concat("s_name", F.lit(" "), "predicate", F.lit(" "), "o_name", F.lit("."))
    mention = lambda e: F.struct(F.col(f"{e}_name").alias("name"), F.col(f"{e}_type").alias("type"))
    return rows.select("doc_id", "chunk_index", "pos", "local_id", text.alias("text"), mention("s").alias("subject"), "predicate", mention("o").alias("object"), F.lit(None).cast("double").alias("confidence"))


def _graph_parts(props: str) -> str:
    """The graph of propositions by exact merge: props, ment, keyed, ents, sup, edg, deg and nod."""
    return f"""
props AS MATERIALIZED (SELECT *, (CAST(chunk_index AS BIGINT) << 32) + pos AS ord, 'c' || chunk_index || '-' || local_id || '-' || pos AS gid FROM ({props})),
ment AS (SELECT doc_id, (CAST(chunk_index AS BIGINT) << 32) + pos * 2 AS seq, chunk_index, s_name AS name, s_type AS type FROM props UNION ALL SELECT doc_id, (CAST(chunk_index AS BIGINT) << 32) + pos * 2 + 1, chunk_index, o_name, o_type FROM props),
keyed AS (SELECT *, {_KEY.format("name")} AS key FROM ment),
ents AS (SELECT *, 'n' || (row_number() OVER (PARTITION BY doc_id ORDER BY first_seq) - 1) AS id FROM (SELECT doc_id, key, type, min(seq) AS first_seq, arg_min(name, seq) AS label, count(*) AS mentions, list_sort(list(DISTINCT chunk_index)) AS source_chunks FROM keyed WHERE key <> '' GROUP BY doc_id, key, type)),
sup AS (SELECT p.*, s.id AS source, t.id AS target FROM props p JOIN ents s ON s.doc_id = p.doc_id AND s.key = {_KEY.format("s_name")} AND s.type = s_type JOIN ents t ON t.doc_id = p.doc_id AND t.key = {_KEY.format("o_name")} AND t.type = o_type),
edg AS MATERIALIZED (SELECT *, 'e' || (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1) AS id FROM (SELECT doc_id, source, target, predicate AS label, min(ord) AS first, count(*) AS weight, list(gid ORDER BY ord) AS propositions FROM sup GROUP BY doc_id, source, target, predicate)),
deg AS (SELECT doc_id, id, count(*) AS degree FROM (SELECT doc_id, source AS id FROM edg UNION ALL SELECT doc_id, target FROM edg) GROUP BY doc_id, id),
nod AS MATERIALIZED (SELECT e.*, coalesce(degree, 0) AS degree, 0.0 AS rank, CAST(substr(e.id, 2) AS BIGINT) AS num FROM ents e LEFT JOIN deg d ON d.doc_id = e.doc_id AND d.id = e.id)"""


_GRAPH = _graph_parts(f"SELECT *, s_name || ' ' || predicate || ' ' || o_name || '.' AS text FROM ({_PROPS.format(**{t: t for t in _TABLES})})")


def mapped_graph(spark: SparkSession, sf_dir: str) -> graph.KnowledgeGraph:
    """Exact merge only and ranks of 0, for queries that read none; ranked_graph has them."""
    return graph.assemble_graph(mapped_propositions(spark, sf_dir), fuzzy=False, rank=False)


def _joined(column: str) -> F.Column:
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


@query(f"WITH {_GRAPH} SELECT doc_id, id, label, type, mentions, degree, array_to_string(source_chunks, ',') AS source_chunks FROM nod")
def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped_graph(spark, sf_dir).nodes.select("doc_id", "id", "label", "type", "mentions", "degree", _joined("source_chunks"))


@query(f"WITH {_GRAPH} SELECT doc_id, id, source, target, label, weight FROM edg")
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped_graph(spark, sf_dir).edges.select("doc_id", "id", "source", "target", "label", "weight")


@query(f"WITH {_GRAPH} SELECT doc_id, id, array_to_string(propositions, ',') AS propositions FROM edg")
def edge_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped_graph(spark, sf_dir).edges.select("doc_id", "id", _joined("propositions"))


@query(f"WITH {_GRAPH} SELECT doc_id, id, degree FROM nod")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = mapped_graph(spark, sf_dir)
    return graph.degrees(g.nodes, g.edges)


@query(f"WITH {_GRAPH} SELECT doc_id, gid AS id, text, chunk_index AS source_chunk FROM props")
def proposition_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.proposition_records(mapped_propositions(spark, sf_dir))


def _rank_parts(rounds: int) -> str:
    """PageRank, unrolled, as r0, r1, ... over nod and edg."""
    parts = [
        "flat AS (SELECT doc_id, source, target, CAST(sum(weight) AS DOUBLE) AS w FROM edg GROUP BY ALL)",
        "tot AS (SELECT doc_id, source, sum(w) AS t FROM flat GROUP BY ALL)",
        "shr AS MATERIALIZED (SELECT f.doc_id, f.source, target, w / t AS share FROM flat f JOIN tot USING (doc_id, source))",
        "r0 AS (SELECT n.doc_id, n.id, count(*) OVER (PARTITION BY n.doc_id) AS n, t.source IS NULL AS loose, 1.0 / count(*) OVER (PARTITION BY n.doc_id) AS rank FROM nod n LEFT JOIN tot t ON t.doc_id = n.doc_id AND t.source = n.id)",
    ]
    for k in range(1, rounds + 1):
        parts.append(
            f"""r{k} AS MATERIALIZED (SELECT r.doc_id, r.id, r.n, r.loose, 0.15 / r.n + 0.85 * (coalesce(g.got, 0) + s.spread / r.n) AS rank FROM r{k - 1} r
LEFT JOIN (SELECT r.doc_id, target AS id, sum(rank * share) AS got FROM r{k - 1} r JOIN shr ON shr.doc_id = r.doc_id AND shr.source = r.id GROUP BY ALL) g ON g.doc_id = r.doc_id AND g.id = r.id
JOIN (SELECT doc_id, sum(CASE WHEN loose THEN rank ELSE 0 END) AS spread FROM r{k - 1} GROUP BY doc_id) s ON s.doc_id = r.doc_id)"""
        )
    return ", ".join(parts)


def _rank_sql(rounds: int) -> str:
    return f"WITH {_GRAPH}, {_rank_parts(rounds)} SELECT doc_id, id, round(rank, 8) AS rank FROM r{rounds}"


_RANKED = f"{_GRAPH}, {_rank_parts(8)}, rnod AS MATERIALIZED (SELECT nod.* EXCLUDE (rank), round(r8.rank, 8) AS rank FROM nod JOIN r8 ON r8.doc_id = nod.doc_id AND r8.id = nod.id)"


def ranked_graph(spark: SparkSession, sf_dir: str) -> graph.KnowledgeGraph:
    """The mapped graph with PageRank of 8 rounds, to 8 places."""
    g = mapped_graph(spark, sf_dir)
    ranks = graph.pagerank(g.nodes, g.edges, rounds=8, exact_rounds=True).withColumn("rank", F.round("rank", 8))
    g.nodes = saved(g.nodes.drop("rank").join(ranks, ["doc_id", "id"]), "ranked-nodes")
    return g


@query(_rank_sql(8))
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = mapped_graph(spark, sf_dir)
    return graph.pagerank(g.nodes, g.edges, rounds=8, exact_rounds=True).withColumn("rank", F.round("rank", 8))


@query(_rank_sql(6))
def pagerank_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = mapped_graph(spark, sf_dir)
    return graph.pagerank_rounds(g.nodes, g.edges, rounds=6, exact_rounds=True).withColumn("rank", F.round("rank", 8))


@query(_rank_sql(60))
def pagerank_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank by the stop rule, document by document, at a tolerance that leaves 8 places exact."""
    g = mapped_graph(spark, sf_dir)
    return graph.pagerank(g.nodes, g.edges, tolerance=1e-12).withColumn("rank", F.round("rank", 8))


@query(
    f"""WITH {_GRAPH}, {_rank_parts(graph.MAX_ROUNDS)}, every AS MATERIALIZED ({" UNION ALL ".join(f"SELECT {k} AS k, doc_id, id, rank FROM r{k}" for k in range(graph.MAX_ROUNDS + 1))}),
still AS (SELECT b.doc_id, b.k FROM every a JOIN every b ON b.doc_id = a.doc_id AND b.id = a.id AND b.k = a.k + 1 GROUP BY b.doc_id, b.k HAVING sum(abs(b.rank - a.rank)) < {graph.TOLERANCE}),
ended AS (SELECT doc_id, min(k) AS k FROM (SELECT * FROM still UNION ALL SELECT DISTINCT doc_id, {graph.MAX_ROUNDS} FROM r0) GROUP BY doc_id)
SELECT every.doc_id, id, round(rank, 8) AS rank FROM every JOIN ended ON ended.doc_id = every.doc_id AND ended.k = every.k"""
)
def pagerank_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank with the operator's own rounds and tolerance: each document as of the round in which it settled."""
    g = mapped_graph(spark, sf_dir)
    return graph.pagerank(g.nodes, g.edges).withColumn("rank", F.round("rank", 8))


@query(
    f"""WITH {_GRAPH}, seen AS (SELECT doc_id, name, min((chunk_index, pos, side)) AS f FROM (SELECT doc_id, chunk_index, pos, 0 AS side, s_name AS name FROM props UNION ALL SELECT doc_id, chunk_index, pos, 1, o_name FROM props) GROUP BY doc_id, name),
ch AS (SELECT DISTINCT doc_id, chunk_index FROM props),
cand AS (SELECT ch.doc_id, ch.chunk_index, name, f, row_number() OVER (PARTITION BY ch.doc_id, ch.chunk_index ORDER BY f DESC) AS back FROM ch JOIN seen ON seen.doc_id = ch.doc_id AND seen.f[1] < ch.chunk_index)
SELECT ch.doc_id, ch.chunk_index, coalesce(p, '') AS prior_entities FROM ch LEFT JOIN (SELECT doc_id, chunk_index, string_agg(name, ',' ORDER BY f) AS p FROM cand WHERE back <= 20 GROUP BY doc_id, chunk_index) q ON q.doc_id = ch.doc_id AND q.chunk_index = ch.chunk_index"""
)
def prior_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapped_propositions(spark, sf_dir)
    return extraction.prior_entities(rows.select("doc_id", "chunk_index"), rows).withColumn("prior_entities", F.array_join("prior_entities", ","))


# -- resolution ----------------------------------------------------------------------

_VARIANT = "CASE p_partkey % 4 WHEN 0 THEN 'The ' || p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, ' ', ' -  ') || '!' ELSE p_name END"
_MENTIONS = f"SELECT CAST(p_size % 5 AS BIGINT) AS doc_id, CAST(p_partkey AS BIGINT) AS seq, CAST(p_partkey % 16 AS INTEGER) AS chunk_index, {_VARIANT} AS name, CASE WHEN p_partkey % 10 < 7 THEN 'artifact' ELSE 'concept' END AS type"
_KEYED = f"mentions AS ({_MENTIONS} FROM part), keyed AS (SELECT *, {_KEY.format('name')} AS key FROM mentions)"


_NAMED_TWICE = f"""SELECT CAST(p_size % 5 AS BIGINT) AS doc_id, CAST(p_partkey * 2 + side AS BIGINT) AS seq, CAST(p_partkey % 16 AS INTEGER) AS chunk_index,
CASE WHEN side = 0 THEN {_VARIANT} ELSE replace(p_name, ' ', '') || 's' END AS name, CASE WHEN p_partkey % 10 < 7 THEN 'artifact' ELSE 'concept' END AS type FROM (SELECT *, 0 AS side FROM part UNION ALL SELECT *, 1 FROM part)"""


def variant_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"{_MENTIONS} FROM {{part}}", part=table(spark, sf_dir, "part"))


@query(f"WITH {_KEYED} SELECT seq, key FROM keyed")
def norm_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_mentions(spark, sf_dir).select("seq", norm_key("name").alias("key"))


@query(f"WITH {_KEYED} SELECT doc_id, key, type, min(seq) AS first_seq, count(*) AS mentions FROM keyed WHERE key <> '' GROUP BY ALL")
def exact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.surface_clusters(variant_mentions(spark, sf_dir))


@query(f"WITH {_KEYED} SELECT doc_id, key, type, name AS form, count(*) AS n, min(seq) AS form_seq FROM keyed WHERE key <> '' GROUP BY ALL")
def form_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.form_counts(variant_mentions(spark, sf_dir)).drop("chunks")


_ENTITIES = f"""{_KEYED}, cl AS (SELECT doc_id, key, type, min(seq) AS first_seq FROM keyed WHERE key <> '' GROUP BY ALL),
fo AS (SELECT k.doc_id, k.key, k.type, name AS form, count(*) AS n, min(seq) AS form_seq FROM keyed k WHERE key <> '' GROUP BY ALL)"""


@query(
    f"""WITH {_ENTITIES}, num AS (SELECT *, 'n' || (row_number() OVER (PARTITION BY doc_id ORDER BY first_seq) - 1) AS id FROM cl),
lab AS (SELECT f.*, row_number() OVER (PARTITION BY doc_id, key, type ORDER BY n DESC, length(form) DESC, form_seq) AS r FROM fo f),
ag AS (SELECT doc_id, key, type, max(form) FILTER (WHERE r = 1) AS label, coalesce(string_agg(form, '|' ORDER BY form_seq) FILTER (WHERE r > 1), '') AS aliases, CAST(sum(n) AS BIGINT) AS mentions FROM lab GROUP BY ALL),
so AS (SELECT doc_id, key, type, array_to_string(list_sort(list(DISTINCT chunk_index)), ',') AS source_chunks FROM keyed GROUP BY ALL)
SELECT doc_id, id, label, type, aliases, mentions, source_chunks FROM num JOIN ag USING (doc_id, key, type) JOIN so USING (doc_id, key, type)"""
)
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolution.resolve_entities(variant_mentions(spark, sf_dir), fuzzy=False).entities
    return found.select("doc_id", "id", "label", "type", F.array_join("aliases", "|").alias("aliases"), "mentions", _joined("source_chunks"))


def named_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of parts by a variant of their name, and after it by its plural in one word, in five documents."""
    return spark.sql(_NAMED_TWICE.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


def word_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names, and as plurals in one word, in one document."""
    rows = spark.sql("SELECT p_partkey, p_name AS w FROM {part} UNION ALL SELECT p_partkey, replace(p_name, ' ', '') || 's' FROM {part}", part=table(spark, sf_dir, "part"))
    # the plural forms come after all others
    return rows.groupBy("w").agg(F.min(F.col("p_partkey") * 2 + F.when(F.endswith("w", F.lit("s")), 1).otherwise(0)).alias("first_seq")).select(F.lit(0).cast("long").alias("doc_id"), "first_seq", F.col("w").alias("key"), F.lit("artifact").alias("type"))


# Similarities of the pairs prs(a, b, x, y, lx, ly, win), character by character, as sim.
_JARO_WINKLER = """
st AS (SELECT a, b, 0 AS i, CAST([] AS INTEGER[]) AS mi, CAST([] AS INTEGER[]) AS us FROM prs
  UNION ALL SELECT q.a, q.b, q.i, CASE WHEN q.j IS NULL THEN q.mi ELSE list_append(q.mi, q.i) END, CASE WHEN q.j IS NULL THEN q.us ELSE list_append(q.us, q.j) END FROM (
    SELECT s.a, s.b, s.i + 1 AS i, s.mi, s.us, list_filter(range(CAST(greatest(1, s.i + 1 - win) AS BIGINT), CAST(least(ly, s.i + 1 + win) + 1 AS BIGINT)), lambda j: substr(y, j, 1) = substr(x, s.i + 1, 1) AND NOT list_contains(s.us, CAST(j AS INTEGER)))[1] AS j
    FROM st s JOIN prs p ON p.a = s.a AND p.b = s.b WHERE s.i < lx) q),
fin AS (SELECT s.a, s.b, x, y, lx, ly, mi, list_sort(us) AS us, len(mi) AS m FROM st s JOIN prs p ON p.a = s.a AND p.b = s.b WHERE s.i = lx),
tra AS (SELECT *, len(list_filter(range(1, m + 1), lambda k: substr(x, mi[k], 1) <> substr(y, us[k], 1))) AS tr, CASE WHEN left(x, 1) <> left(y, 1) THEN 0 WHEN left(x, 2) <> left(y, 2) OR least(lx, ly) < 2 THEN 1 WHEN left(x, 3) <> left(y, 3) OR least(lx, ly) < 3 THEN 2 WHEN left(x, 4) <> left(y, 4) OR least(lx, ly) < 4 THEN 3 ELSE 4 END AS pre FROM fin),
jar AS (SELECT *, CASE WHEN m = 0 THEN 0 ELSE (m / lx + m / ly + (m - tr / 2) / m) / 3 END AS jaro FROM tra),
sim AS MATERIALIZED (SELECT a, b, x AS key_a, y AS key_b, jaro + pre * 0.1 * (1 - jaro) AS similarity FROM jar)"""

_JW = """
words AS MATERIALIZED (SELECT w AS key, min(p_partkey * 2 + CASE WHEN ends_with(w, 's') THEN 1 ELSE 0 END) AS seq FROM (SELECT p_partkey, p_name AS w FROM part UNION ALL SELECT p_partkey, replace(p_name, ' ', '') || 's' FROM part) GROUP BY w),
prs AS MATERIALIZED (SELECT a.seq AS a, b.seq AS b, a.key AS x, b.key AS y, length(a.key) AS lx, length(b.key) AS ly, greatest(0, greatest(length(a.key), length(b.key)) // 2 - 1) AS win FROM words a JOIN words b ON a.seq < b.seq),""" + _JARO_WINKLER


@query(f"WITH RECURSIVE {_JW} SELECT a, b, key_a, key_b, round(similarity, 8) AS similarity FROM sim WHERE similarity >= 0.92")
def jw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.jaro_winkler_pairs(word_clusters(spark, sf_dir)).select("a", "b", "key_a", "key_b", F.round("similarity", 8).alias("similarity"))


@query(
    f"""WITH RECURSIVE {_JW}, lk AS (SELECT a, b FROM sim WHERE similarity >= 0.92 UNION SELECT b, a FROM sim WHERE similarity >= 0.92),
re AS (SELECT a AS node, a AS other FROM lk UNION SELECT re.node, lk.b FROM re JOIN lk ON lk.a = re.other) SELECT node, min(other) AS component FROM re GROUP BY node"""
)
def jw_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = resolution.jaro_winkler_pairs(word_clusters(spark, sf_dir))
    return components(pairs, by=["doc_id"]).select("node", "component")


_FUZZY = f"""keyed AS (SELECT *, {_KEY.format('name')} AS key FROM ({_NAMED_TWICE})),
cl AS MATERIALIZED (SELECT doc_id, key, type, min(seq) AS first_seq FROM keyed WHERE key <> '' GROUP BY ALL),
fo AS MATERIALIZED (SELECT doc_id, key, type, name AS form, count(*) AS n, min(seq) AS form_seq FROM keyed WHERE key <> '' GROUP BY ALL),
near AS MATERIALIZED (SELECT a.doc_id, a.first_seq AS a, b.first_seq AS b, a.key AS x, b.key AS y FROM cl a JOIN cl b ON a.doc_id = b.doc_id AND a.type = b.type AND a.first_seq < b.first_seq),
prs AS MATERIALIZED (SELECT x AS a, y AS b, x, y, length(x) AS lx, length(y) AS ly, greatest(0, greatest(length(x), length(y)) // 2 - 1) AS win FROM (SELECT DISTINCT x, y FROM near)),{_JARO_WINKLER},
lk AS MATERIALIZED (SELECT near.doc_id, near.a, near.b FROM near JOIN sim ON sim.a = x AND sim.b = y WHERE similarity >= 0.92),
bo AS MATERIALIZED (SELECT * FROM lk UNION SELECT doc_id, b, a FROM lk),
re AS (SELECT doc_id, first_seq AS node, first_seq AS other FROM cl UNION SELECT re.doc_id, re.node, bo.b FROM re JOIN bo ON bo.doc_id = re.doc_id AND bo.a = re.other),
co AS MATERIALIZED (SELECT doc_id, node AS first_seq, min(other) AS entity_seq FROM re GROUP BY ALL),
num AS (SELECT doc_id, entity_seq, 'n' || (row_number() OVER (PARTITION BY doc_id ORDER BY entity_seq) - 1) AS id FROM (SELECT DISTINCT doc_id, entity_seq FROM co)),
all_forms AS (SELECT fo.*, cl.first_seq, co.entity_seq FROM fo JOIN cl USING (doc_id, key, type) JOIN co ON co.doc_id = cl.doc_id AND co.first_seq = cl.first_seq),
lab AS (SELECT *, first_value(form) OVER (PARTITION BY doc_id, entity_seq ORDER BY n DESC, length(form) DESC, first_seq, form_seq) AS label FROM all_forms),
ag AS (SELECT doc_id, entity_seq, type, label, coalesce(string_agg(form, '|' ORDER BY first_seq, form_seq, form) FILTER (WHERE form <> label), '') AS aliases, CAST(sum(n) AS BIGINT) AS mentions FROM lab GROUP BY ALL),
so AS (SELECT co.doc_id, entity_seq, array_to_string(list_sort(list(DISTINCT chunk_index)), ',') AS source_chunks FROM keyed JOIN cl USING (doc_id, key, type) JOIN co ON co.doc_id = cl.doc_id AND co.first_seq = cl.first_seq GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_FUZZY} SELECT doc_id, id, label, type, aliases, mentions, source_chunks FROM ag JOIN num USING (doc_id, entity_seq) JOIN so USING (doc_id, entity_seq)")
def entities_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities after the exact and the fuzzy merge, at the operator's own threshold."""
    found = resolution.resolve_entities(named_twice(spark, sf_dir)).entities
    return found.select("doc_id", "id", "label", "type", F.array_join("aliases", "|").alias("aliases"), "mentions", _joined("source_chunks"))


@query(f"WITH RECURSIVE {_FUZZY} SELECT seq, name, id FROM keyed JOIN cl USING (doc_id, key, type) JOIN co ON co.doc_id = cl.doc_id AND co.first_seq = cl.first_seq JOIN num ON num.doc_id = co.doc_id AND num.entity_seq = co.entity_seq")
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity that each mention resolves to."""
    named = named_twice(spark, sf_dir)
    return resolution.resolve_entities(named).ids_for(named).select("seq", "name", "id")


_COSINE = "prs AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)"


def _vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.lit(0).cast("long").alias("doc_id"), F.col("vec_id").alias("first_seq"), F.col("vec_id").cast("string").alias("key"), F.col("label").cast("string").alias("type"), "embedding")


@query(f"WITH {_COSINE} SELECT a, b, round(similarity, 6) AS similarity FROM prs WHERE similarity >= 0.35")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.cosine_pairs(_vector_clusters(spark, sf_dir), threshold=0.35).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH RECURSIVE {_COSINE}, lk AS (SELECT a, b FROM prs WHERE similarity >= 0.35 UNION SELECT b, a FROM prs WHERE similarity >= 0.35),
re AS (SELECT a AS node, a AS other FROM lk UNION SELECT re.node, lk.b FROM re JOIN lk ON lk.a = re.other) SELECT node, min(other) AS component FROM re GROUP BY node"""
)
def cosine_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(resolution.cosine_links(_vector_clusters(spark, sf_dir), threshold=0.35), by=["doc_id"]).select("node", "component")


@query(f"WITH {_COSINE} SELECT a, b, round(similarity, 6) AS similarity FROM prs WHERE similarity >= 0.25 AND similarity < 0.35")
def borderline_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that just miss a threshold, here one that the table's vectors reach."""
    return resolution.borderline_pairs(_vector_clusters(spark, sf_dir), low=0.25, threshold=0.35).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    """WITH RECURSIVE u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
m AS (SELECT label AS doc_id, vec_id AS seq, CAST(vec_id % 3 AS INTEGER) AS chunk_index, 'vector ' || vec_id // 2 AS key, e FROM u),
cl AS (SELECT doc_id, key, min(seq) AS first_seq, arg_min(e, seq) AS e, count(*) AS mentions FROM m GROUP BY doc_id, key),
v AS (SELECT key, arg_min(e, seq) AS e FROM m GROUP BY key),
c AS MATERIALIZED (SELECT doc_id, key, first_seq, mentions, v.e FROM cl JOIN v USING (key)),
lk AS MATERIALIZED (SELECT a.doc_id, a.first_seq AS a, b.first_seq AS b FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.first_seq <> b.first_seq AND list_dot_product(a.e, b.e) >= 0.35),
re AS (SELECT doc_id, first_seq AS node, first_seq AS other FROM c UNION SELECT re.doc_id, re.node, lk.b FROM re JOIN lk ON lk.doc_id = re.doc_id AND lk.a = re.other),
co AS (SELECT doc_id, node, min(other) AS entity FROM re GROUP BY doc_id, node)
SELECT co.doc_id, CAST(entity AS BIGINT) AS first_seq, CAST(sum(mentions) AS BIGINT) AS mentions FROM co JOIN c ON c.doc_id = co.doc_id AND c.first_seq = co.node GROUP BY co.doc_id, entity"""
)
def entities_by_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities merged by the cosine of their names' vectors: every two vectors share a name, each label is a document."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("seq"), (F.col("vec_id") % 3).cast("int").alias("chunk_index"), F.concat(F.lit("vector "), F.floor(F.col("vec_id") / 2).cast("string")).alias("name"), F.lit("other").alias("type"), "embedding")
    vectors = rows.groupBy(F.col("name").alias("key")).agg(F.min_by("embedding", "seq").cast("array<double>").alias("embedding"))
    return resolution.resolve_entities(rows.drop("embedding"), vectors=vectors, cosine_threshold=0.35).entities.select("doc_id", "first_seq", "mentions")


@query(
    f"""WITH RECURSIVE m AS (SELECT label AS doc_id, vec_id AS seq, 'vector ' || vec_id // 2 AS key, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
cl AS (SELECT doc_id, key, min(seq) AS first_seq, count(*) AS mentions FROM m GROUP BY doc_id, key),
v AS (SELECT key, arg_min(e, seq) AS e FROM m WHERE doc_id % 2 = 0 GROUP BY key),
c AS MATERIALIZED (SELECT cl.*, v.e, bool_and(v.e IS NOT NULL) OVER (PARTITION BY doc_id) AS vectors FROM cl LEFT JOIN v ON v.key = cl.key),
near AS MATERIALIZED (SELECT a.doc_id, a.first_seq AS a, b.first_seq AS b, a.key AS x, b.key AS y FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.first_seq < b.first_seq AND NOT a.vectors),
prs AS MATERIALIZED (SELECT x AS a, y AS b, x, y, length(x) AS lx, length(y) AS ly, greatest(0, greatest(length(x), length(y)) // 2 - 1) AS win FROM (SELECT DISTINCT x, y FROM near)),{_JARO_WINKLER},
hit AS (SELECT near.doc_id, near.a, near.b FROM near JOIN sim ON sim.a = x AND sim.b = y WHERE similarity >= 0.97
  UNION ALL SELECT a.doc_id, a.first_seq, b.first_seq FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.first_seq < b.first_seq AND a.vectors AND list_dot_product(a.e, b.e) >= 0.35),
lk AS MATERIALIZED (SELECT * FROM hit UNION SELECT doc_id, b, a FROM hit),
re AS (SELECT doc_id, first_seq AS node, first_seq AS other FROM c UNION SELECT re.doc_id, re.node, lk.b FROM re JOIN lk ON lk.doc_id = re.doc_id AND lk.a = re.other),
co AS (SELECT doc_id, node, min(other) AS entity FROM re GROUP BY doc_id, node)
SELECT co.doc_id, CAST(entity AS BIGINT) AS first_seq, CAST(sum(mentions) AS BIGINT) AS mentions FROM co JOIN c ON c.doc_id = co.doc_id AND c.first_seq = co.node GROUP BY co.doc_id, entity"""
)
def entities_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose names all have vectors merge by cosine, the others by their text."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("seq"), F.lit(0).alias("chunk_index"), F.concat(F.lit("vector "), F.floor(F.col("vec_id") / 2).cast("string")).alias("name"), F.lit("other").alias("type"), "embedding")
    vectors = rows.filter("doc_id % 2 = 0").groupBy(F.col("name").alias("key")).agg(F.min_by("embedding", "seq").cast("array<double>").alias("embedding"))
    found = resolution.resolve_entities(rows.drop("embedding"), vectors=vectors, cosine_threshold=0.35, jaro_winkler_threshold=0.97)
    return found.entities.select("doc_id", "first_seq", "mentions")


# Every customer lives in a nation, and knows itself: an edge from a node to itself.
_LOOPS = "SELECT CAST(n_regionkey AS BIGINT) AS doc_id, 0 AS chunk_index, CAST(c_custkey * 2 + k AS INTEGER) AS pos, 'p' || k AS local_id, c_name AS s_name, 'person' AS s_type, CASE WHEN k = 0 THEN 'knows' ELSE 'lives in' END AS predicate, CASE WHEN k = 0 THEN c_name ELSE n_name END AS o_name, CASE WHEN k = 0 THEN 'person' ELSE 'location' END AS o_type FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) t"
_LOOP_GRAPH = _graph_parts(f"SELECT *, s_name || ' ' || predicate || ' ' || o_name || '.' AS text FROM ({_LOOPS.format(customer='customer', nation='nation')})")


@query(f"WITH {_LOOP_GRAPH} SELECT n.doc_id, n.id, n.label, n.degree, coalesce(l, 0) AS loops FROM nod n LEFT JOIN (SELECT doc_id, source, count(*) AS l FROM edg WHERE source = target GROUP BY ALL) x ON x.doc_id = n.doc_id AND x.source = n.id")
def self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a graph in which every customer points at itself: such an edge counts twice in the degree."""
    rows = spark.sql(_LOOPS, **{t: table(spark, sf_dir, t) for t in ("customer", "nation")})
    mention = lambda e: F.struct(F.col(f"{e}_name").alias("name"), F.col(f"{e}_type").alias("type"))
    given = rows.select("doc_id", "chunk_index", "pos", "local_id", F.concat("s_name", F.lit(" "), "predicate", F.lit(" "), "o_name", F.lit(".")).alias("text"), mention("s").alias("subject"), "predicate", mention("o").alias("object"), F.lit(None).cast("double").alias("confidence"))
    g = graph.assemble_graph(given, fuzzy=False, rank=False)
    loops = g.edges.filter("source = target").groupBy("doc_id", F.col("source").alias("id")).agg(F.count("*").alias("loops"))
    return g.nodes.join(loops, ["doc_id", "id"], "left").select("doc_id", "id", "label", "degree", F.coalesce("loops", F.lit(0)).alias("loops"))


# -- graph queries -------------------------------------------------------------------

_SEEDS = "seeds AS (SELECT doc_id, id AS seed FROM nod WHERE type = 'location')"


@query(
    f"""WITH {_GRAPH}, {_SEEDS}, inc AS (SELECT e.doc_id, seed, e.source, e.target FROM edg e JOIN seeds s ON s.doc_id = e.doc_id AND (seed = source OR seed = target))
SELECT doc_id, seed, seed AS id FROM seeds UNION SELECT doc_id, seed, source FROM inc UNION SELECT doc_id, seed, target FROM inc"""
)
def ego_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = mapped_graph(spark, sf_dir)
    return inspect.ego_network(g, g.nodes.filter("type = 'location'"))[0]


@query(f"WITH {_GRAPH}, {_SEEDS} SELECT DISTINCT e.doc_id, seed, e.id AS edge_id FROM edg e JOIN seeds s ON s.doc_id = e.doc_id AND (seed = source OR seed = target)")
def ego_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = mapped_graph(spark, sf_dir)
    return inspect.ego_network(g, g.nodes.filter("type = 'location'"))[1]


@query(f"WITH {_GRAPH} SELECT doc_id, id AS edge_id, source AS id FROM edg WHERE label = 'supplies' UNION SELECT doc_id, id, target FROM edg WHERE label = 'supplies'")
def edge_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = mapped_graph(spark, sf_dir)
    return inspect.edge_neighbourhood(g, g.edges.filter("label = 'supplies'"))


@query(
    f"""WITH {_GRAPH} SELECT e.doc_id, e.source AS id, e.id AS edge_id, '→ ' || e.label || ' ' || t.label AS relation FROM edg e JOIN nod t ON t.doc_id = e.doc_id AND t.id = e.target
UNION ALL SELECT e.doc_id, e.target, e.id, '← ' || s.label || ' ' || e.label FROM edg e JOIN nod s ON s.doc_id = e.doc_id AND s.id = e.source WHERE e.source <> e.target"""
)
def node_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.node_detail(mapped_graph(spark, sf_dir))


@query(
    f"""WITH {_RANKED} SELECT doc_id, id, label, type || ' · ' || mentions || ' mention' || CASE WHEN mentions = 1 THEN '' ELSE 's' END || ' · degree ' || degree || ' · rank ' || printf('%.4f', CAST(rank AS DOUBLE)) AS header, '' AS also, array_to_string(source_chunks, ', ') AS chunks FROM rnod"""
)
def node_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.node_header(ranked_graph(spark, sf_dir))


@query(
    f"""WITH {_GRAPH}, cl AS (SELECT doc_id, source, target, predicate, string_agg(text, '|' ORDER BY ord) AS claims FROM sup GROUP BY ALL)
SELECT e.doc_id, e.id, s.label AS source_label, e.label, t.label AS target_label, weight, CAST(len(propositions) AS INTEGER) AS supporting, claims
FROM edg e JOIN nod s ON s.doc_id = e.doc_id AND s.id = e.source JOIN nod t ON t.doc_id = e.doc_id AND t.id = e.target JOIN cl c ON c.doc_id = e.doc_id AND c.source = e.source AND c.target = e.target AND c.predicate = e.label"""
)
def edge_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.edge_detail(mapped_graph(spark, sf_dir)).withColumn("claims", F.array_join("claims", "|"))


_COLOR = "CASE type " + " ".join(f"WHEN '{t}' THEN '{c}'" for t, c in TYPE_COLOR.items()) + f" ELSE '{TYPE_COLOR['other']}' END"
_LINES = "mentions || ' mention' || CASE WHEN mentions = 1 THEN '' ELSE 's' END"


@query(f"WITH {_GRAPH} SELECT doc_id, id, CASE WHEN length(label) > 12 THEN left(label, 11) || '…' ELSE label END AS label, round(5 + sqrt(mentions) * 3, 6) AS size, {_COLOR} AS color FROM nod")
def visual_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.visual_nodes(mapped_graph(spark, sf_dir).nodes, max_label=12).withColumn("size", F.round("size", 6))


@query(f"WITH {_GRAPH} SELECT doc_id, id, round(CAST(least(1 + weight * 0.7, 5.0) AS DOUBLE), 6) AS width FROM edg")
def visual_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.visual_edges(mapped_graph(spark, sf_dir).edges).withColumn("width", F.round(F.col("width").cast("double"), 6))


_CIRCLE = "pos AS MATERIALIZED (SELECT doc_id, id, cos(2 * pi() * num / count(*) OVER (PARTITION BY doc_id)) AS x, sin(2 * pi() * num / count(*) OVER (PARTITION BY doc_id)) AS y FROM nod)"


@query(f"WITH {_GRAPH}, {_CIRCLE} SELECT doc_id, id, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y FROM pos")
def circular_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.circular_layout(mapped_graph(spark, sf_dir).nodes).select("doc_id", "id", (F.round("x", 6) + 0).alias("x"), (F.round("y", 6) + 0).alias("y"))


@query(
    f"""WITH {_GRAPH} SELECT d.doc_id, 'region ' || d.doc_id AS title, nodes, edges, chunk_count FROM (SELECT doc_id, count(*) AS nodes FROM nod GROUP BY doc_id) d
JOIN (SELECT doc_id, count(*) AS edges FROM edg GROUP BY doc_id) e USING (doc_id) JOIN (SELECT doc_id, CAST(count(DISTINCT chunk_index) AS INTEGER) AS chunk_count FROM props GROUP BY doc_id) c USING (doc_id)"""
)
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = mapped_graph(spark, sf_dir)
    counted = g.propositions.groupBy("doc_id").agg(F.countDistinct("source_chunk").cast("int").alias("chunk_count"))
    g.meta = counted.select("doc_id", F.concat(F.lit("region "), F.col("doc_id").cast("string")).alias("title"), "chunk_count")
    return inspect.run_summary(g)


# -- exports -------------------------------------------------------------------------

_CANVAS = f"""WITH {_RANKED}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank DESC, num) - 1 AS ord FROM rnod)
SELECT doc_id, id, CAST(ord AS INTEGER) AS ord, '**' || label || '**' || chr(10) || '_' || type || ' · ' || {_LINES} || '_' AS text,
CAST(floor(340 * sqrt(ord + 0.5) * cos(ord * pi() * (3 - sqrt(5))) + 0.5) AS BIGINT) AS x, CAST(floor(340 * sqrt(ord + 0.5) * sin(ord * pi() * (3 - sqrt(5))) + 0.5) AS BIGINT) AS y,
CAST(least(360, greatest(200, 120 + length(label) * 8)) AS INTEGER) AS width, CAST(60 + least(60, greatest(0, (mentions - 1) * 6)) AS INTEGER) AS height, {_COLOR} AS color FROM o"""


@query(_CANVAS)
def canvas_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.canvas_nodes(ranked_graph(spark, sf_dir).nodes)


_NAMES = rf"""nm AS (SELECT *, CASE WHEN k > 1 THEN base || ' (' || k || ')' ELSE base END AS name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(base) ORDER BY num) AS k FROM
(SELECT doc_id, id, num, label, coalesce(nullif(trim(regexp_replace(regexp_replace(label, '[\\/:*?"<>|#^\[\]]', ' ', 'g'), '\s+', ' ', 'g')), ''), 'untitled') AS base FROM nod)))"""


@query(f"WITH {_GRAPH}, {_NAMES} SELECT doc_id, id, name FROM nm")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.unique_names(mapped_graph(spark, sf_dir).nodes)


@query(
    f"""WITH {_GRAPH}, {_NAMES} SELECT e.doc_id, e.source AS id, CAST(substr(e.id, 2) AS BIGINT) AS ord, '- ' || e.label || ' ' || CASE WHEN m.label = m.name THEN '[[' || m.name || ']]' ELSE '[[' || m.name || '|' || m.label || ']]' END AS line
FROM edg e JOIN nm m ON m.doc_id = e.doc_id AND m.id = e.target"""
)
def vault_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = mapped_graph(spark, sf_dir)
    return export.vault_relations(g, export.unique_names(g.nodes))


@query(f"WITH {_GRAPH} SELECT doc_id, source AS id, gid, '- ' || text AS line FROM sup")
def vault_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = mapped_graph(spark, sf_dir)
    by_place = g.edges.select("doc_id", F.col("source").alias("id"), F.substring("id", 2, 20).cast("long").alias("e"), F.posexplode("propositions").alias("k", "gid"))
    lines = export.vault_claims(g).select("doc_id", "id", F.col("ord.e").alias("e"), F.col("ord.k").alias("k"), "line")
    return lines.join(by_place, ["doc_id", "id", "e", "k"]).select("doc_id", "id", "gid", "line")


_NOTES = f"""WITH {_RANKED}, {_NAMES},
rel AS (SELECT e.doc_id, e.source AS id, string_agg('- ' || e.label || ' ' || CASE WHEN m.label = m.name THEN '[[' || m.name || ']]' ELSE '[[' || m.name || '|' || m.label || ']]' END, chr(10) ORDER BY CAST(substr(e.id, 2) AS BIGINT)) AS t FROM edg e JOIN nm m ON m.doc_id = e.doc_id AND m.id = e.target GROUP BY ALL),
cla AS (SELECT s.doc_id, s.source AS id, string_agg('- ' || text, chr(10) ORDER BY CAST(substr(e.id, 2) AS BIGINT), ord) AS t FROM sup s JOIN edg e ON e.doc_id = s.doc_id AND e.source = s.source AND e.target = s.target AND e.label = s.predicate GROUP BY ALL)
SELECT n.doc_id, n.id, m.name || '.md' AS path, '---' || chr(10) || CASE WHEN n.label <> m.name THEN 'aliases:' || chr(10) || '  - "' || n.label || '"' || chr(10) ELSE '' END || 'type: ' || type || chr(10) || 'mentions: ' || mentions || chr(10) || 'degree: ' || degree || chr(10) || 'rank: ' || regexp_replace(regexp_replace(printf('%.15f', CAST(rank AS DOUBLE)), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') || chr(10) || '---' || chr(10) || chr(10) || '# ' || n.label || chr(10) || chr(10) || '> Type: ' || type || ' · Mentions: ' || mentions || ' · Degree: ' || degree || chr(10)
|| coalesce(chr(10) || '## Relationships' || chr(10) || chr(10) || rel.t, '') || chr(10) || coalesce(chr(10) || '## Supporting claims' || chr(10) || chr(10) || cla.t, '') || chr(10) AS content
FROM rnod n JOIN nm m ON m.doc_id = n.doc_id AND m.id = n.id LEFT JOIN rel ON rel.doc_id = n.doc_id AND rel.id = n.id LEFT JOIN cla ON cla.doc_id = n.doc_id AND cla.id = n.id"""


@query(_NOTES)
def vault_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.vault_notes(ranked_graph(spark, sf_dir))


@query(
    f"""WITH {_RANKED} SELECT doc_id, num AS ord, '    <node id="' || id || '">' || chr(10) || '      <data key="label">' || label || '</data>' || chr(10) || '      <data key="type">' || type || '</data>' || chr(10) || '      <data key="mentions">' || mentions || '</data>' || chr(10) || '      <data key="rank">' || regexp_replace(regexp_replace(printf('%.15f', CAST(rank AS DOUBLE)), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') || '</data>' || chr(10) || '    </node>' AS xml FROM rnod"""
)
def graphml_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.graphml_nodes(ranked_graph(spark, sf_dir).nodes)


@query(
    f"""WITH {_GRAPH} SELECT doc_id, CAST(substr(id, 2) AS BIGINT) AS ord, '    <edge id="' || id || '" source="' || source || '" target="' || target || '">' || chr(10) || '      <data key="elabel">' || label || '</data>' || chr(10) || '      <data key="weight">' || weight || '</data>' || chr(10) || '    </edge>' AS xml FROM edg"""
)
def graphml_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.graphml_edges(mapped_graph(spark, sf_dir).edges)


_DRAWN = f"""{_GRAPH}, {_CIRCLE}, bx AS (SELECT doc_id, least(min(x), 0) AS lx, greatest(max(x), 1) AS hx, greatest(max(y), 1) AS hy FROM pos GROUP BY doc_id),
dr AS MATERIALIZED (SELECT n.doc_id, n.id, num, label, mentions, type, 60 + (x - lx) * 1080 / greatest(hx - lx, 1e-6) AS cx, 60 + (hy - y) * 1080 / greatest(hx - lx, 1e-6) AS cy FROM nod n JOIN pos p ON p.doc_id = n.doc_id AND p.id = n.id JOIN bx ON bx.doc_id = n.doc_id)"""


@query(f"WITH {_DRAWN} SELECT doc_id, id, num AS ord, round(cx, 4) AS cx, round(cy, 4) AS cy, round(5 + sqrt(greatest(mentions, 1)) * 3, 4) AS r, {_COLOR} AS fill, label FROM dr")
def svg_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = mapped_graph(spark, sf_dir).nodes
    drawn = export.svg_nodes(n, inspect.circular_layout(n))
    return drawn.select("doc_id", "id", "ord", *[F.round(c, 4).alias(c) for c in ("cx", "cy", "r")], "fill", "label")


@query(
    f"""WITH {_DRAWN} SELECT e.doc_id, CAST(substr(e.id, 2) AS BIGINT) AS ord, round(s.cx, 4) AS x1, round(s.cy, 4) AS y1, round(t.cx, 4) AS x2, round(t.cy, 4) AS y2, round(CAST(least(1 + weight * 0.7, 5.0) AS DOUBLE), 6) AS width, e.label
FROM edg e JOIN dr s ON s.doc_id = e.doc_id AND s.id = e.source JOIN dr t ON t.doc_id = e.doc_id AND t.id = e.target"""
)
def svg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = mapped_graph(spark, sf_dir)
    drawn = saved(export.svg_nodes(g.nodes, inspect.circular_layout(g.nodes)), "drawn-nodes")
    rows = export.svg_edges(g.edges, drawn)
    return rows.select("doc_id", "ord", *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")], F.round(F.col("width").cast("double"), 6).alias("width"), "label")


@query(
    f"""WITH {_GRAPH} SELECT doc_id, '→' || source || ' ' || label || ' ' || target AS edge, weight FROM edg"""
)
def saved_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a graph that was saved, listed and loaded again."""
    store = f"{scratch(spark)}/graphs-{uuid.uuid4().hex}"
    graph_id = persist.save_graph(mapped_graph(spark, sf_dir), store)
    assert persist.list_graphs(spark, store).filter(F.col("graph_id") == graph_id).count() == 1
    loaded = persist.load_graph(spark, store, graph_id)
    return loaded.edges.select("doc_id", F.concat(F.lit("→"), "source", F.lit(" "), "label", F.lit(" "), "target").alias("edge"), "weight")


@query(f"WITH {_GRAPH} SELECT 'kept' AS graph_id, 'untitled' AS title, (SELECT count(*) FROM nod) AS node_count, (SELECT count(*) FROM edg) AS edge_count")
def stored_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of a store in which one of two graphs was deleted."""
    g, store = mapped_graph(spark, sf_dir), f"{scratch(spark)}/graphs-{uuid.uuid4().hex}"
    for name in ("dropped", "kept"):
        persist.save_graph(g, store, graph_id=name)
    persist.delete_graph(spark, store, "dropped")
    return persist.list_graphs(spark, store).select("graph_id", "title", "node_count", "edge_count")


@query(
    f"""WITH {_GRAPH} SELECT 1 AS number, label, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM edg GROUP BY label UNION ALL SELECT 2, label, count(*), CAST(sum(weight) AS BIGINT) FROM edg WHERE label = 'supplies' GROUP BY label
UNION ALL SELECT 3, 'listed', count(*), NULL FROM edg UNION ALL SELECT 3, 'listed', count(*), NULL FROM edg WHERE label = 'supplies'"""
)
def graph_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a version that a reader holds while the next is saved over it, of the next, and what the store lists of both."""
    g, store = mapped_graph(spark, sf_dir), f"{scratch(spark)}/graphs-{uuid.uuid4().hex}"
    graph_id = persist.save_graph(g, store)
    held = persist.load_graph(spark, store, graph_id)
    persist.save_graph(graph.KnowledgeGraph(held.nodes, held.edges.filter("label = 'supplies'"), held.propositions, None), store, graph_id=graph_id)
    versions = persist.list_versions(spark, store, graph_id)
    now = persist.load_graph(spark, store, graph_id)
    rows = [x.edges.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).select(F.lit(k).alias("number"), "label", "n", "weight") for k, x in enumerate((held, now), 1)]
    return rows[0].union(rows[1]).union(versions.select(F.lit(3), F.lit("listed"), "edge_count", F.lit(None).cast("long")))


@query(f"WITH {_GRAPH} SELECT doc_id, 'vertex' AS part, id, label, type AS more, mentions AS n FROM nod UNION ALL SELECT doc_id, 'edge', id, label, source || ' ' || target, weight FROM edg")
def property_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, edges_ = graph.property_graph(mapped_graph(spark, sf_dir))
    rows = vertices.select("doc_id", F.lit("vertex").alias("part"), "id", "label", F.col("entity_type").alias("more"), F.col("mentions").alias("n"))
    return rows.union(edges_.select("doc_id", F.lit("edge"), "id", "label", F.concat("src", F.lit(" "), "dst"), "weight"))


@query(
    f"""WITH {_RANKED} SELECT doc_id, 'node' AS part, id, label, type || ' ' || mentions || ' ' || degree || ' ' || array_to_string(source_chunks, ',') AS more, rank FROM rnod
UNION ALL SELECT doc_id, 'edge', id, label, source || ' ' || target || ' ' || weight || ' ' || array_to_string(propositions, ','), NULL FROM edg
UNION ALL SELECT doc_id, 'proposition', gid, text, CAST(chunk_index AS VARCHAR), NULL FROM props UNION ALL SELECT DISTINCT doc_id, 'file', 'quillgraph.graph', '1', NULL, NULL FROM props"""
)
def portable_json_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the portable JSON file of each document says, read back a line at a time."""
    at = f"{scratch(spark)}/portable-{uuid.uuid4().hex}"
    files.write_graph_files(ranked_graph(spark, sf_dir), "portable-json", at)
    ddl = """format string, version int, id string, label string, type string, mentions long, degree long, rank double, sourceChunks array<string>,
        source string, target string, weight string, propositions array<string>, text string, sourceChunk string"""
    elements = files.read_elements(spark, at, "portable-json").select(F.substring("name", len("graph-") + 1, 20).cast("long").alias("doc_id"), "line")
    # stored as parsed: else Spark parses a line again for each field that is read of it
    parsed = F.when(F.col("line").startswith('{"id":'), F.from_json("line", ddl))
    lines = saved(elements.select("doc_id", parsed.alias("j"), F.when(F.col("line").startswith('{"format":'), F.col("line")).alias("line")), "portable-lines")
    j = lines.filter("j IS NOT NULL").select("doc_id", "j.*")
    none = F.lit(None).cast("double")
    node, edge, claim = (F.col(c).isNotNull() for c in ("type", "source", "text"))
    part = F.when(node, "node").when(edge, "edge").when(claim, "proposition")
    name = F.when(claim, F.col("text")).otherwise(F.col("label"))
    more = F.when(node, F.concat_ws(" ", "type", "mentions", "degree", F.array_join("sourceChunks", ","))).when(edge, F.concat_ws(" ", "source", "target", "weight", F.array_join("propositions", ","))).otherwise(F.col("sourceChunk"))
    rows = j.filter(node | edge | claim).select("doc_id", part.alias("part"), "id", name.alias("label"), more.alias("more"), F.when(node, F.col("rank")).alias("rank"))
    opening = r'"format":"([^"]*)","version":(\d+)'
    first = lines.filter("line IS NOT NULL")
    return rows.union(first.select("doc_id", F.lit("file"), F.regexp_extract("line", opening, 1), F.regexp_extract("line", opening, 2), F.lit(None).cast("string"), none))


@query(f"WITH {_RANKED} SELECT doc_id, 'node' AS part, id, label, type || ' ' || mentions AS more, rank FROM rnod UNION ALL SELECT doc_id, 'edge', id, label, source || ' ' || target || ' ' || weight, NULL FROM edg")
def cytoscape_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of each document's Cytoscape JSON file, read back a line at a time."""
    at = f"{scratch(spark)}/cytoscape-{uuid.uuid4().hex}"
    files.write_graph_files(ranked_graph(spark, sf_dir), "cytoscape", at)
    ddl = "data struct<id:string,label:string,type:string,mentions:string,rank:double,source:string,target:string,weight:string>"
    lines = files.read_elements(spark, at, "cytoscape").filter("line LIKE '{\"data\":%'")
    rows = lines.select(F.substring("name", len("graph-") + 1, 20).cast("long").alias("doc_id"), F.from_json("line", ddl).alias("j")).select("doc_id", "j.data.*")
    node, edge = F.col("source").isNull(), F.col("source").isNotNull()
    more = F.when(node, F.concat_ws(" ", "type", "mentions")).otherwise(F.concat_ws(" ", "source", "target", "weight"))
    return rows.select("doc_id", F.when(edge, "edge").otherwise("node").alias("part"), "id", "label", more.alias("more"), "rank")


@query(
    f"""WITH {_GRAPH} SELECT doc_id, count(*) FILTER (WHERE k = 1) AS n_nodes, count(*) FILTER (WHERE k = 2) AS n_edges, CAST(sum(m) AS BIGINT) AS mentions, CAST(sum(w) AS BIGINT) AS weight
FROM (SELECT doc_id, 1 AS k, mentions AS m, 0 AS w FROM nod UNION ALL SELECT doc_id, 2, 0, weight FROM edg) GROUP BY doc_id"""
)
def graphml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of each document's GraphML file, counted in the file."""
    at = f"{scratch(spark)}/graphml-{uuid.uuid4().hex}"
    files.write_graph_files(mapped_graph(spark, sf_dir), "graphml", at)
    lines = files.read_elements(spark, at, "graphml").withColumn("doc_id", F.substring("name", len("graph-") + 1, 20).cast("long"))
    number = lambda key: F.sum(F.regexp_extract("line", f'<data key="{key}">(\\d+)<', 1).try_cast("long"))
    count = lambda start: F.sum(F.col("line").startswith(start).cast("long"))
    return lines.groupBy("doc_id").agg(count("    <node ").alias("n_nodes"), count("    <edge ").alias("n_edges"), number("mentions").alias("mentions"), number("weight").alias("weight"))


# -- streams -----------------------------------------------------------------------------


class FailingEngine(RuleEngine):
    """The rule engine, which fails on some lengths of text, on some for good."""

    def extract(self, chunk: str, context: ChunkContext) -> list[dict]:
        if len(chunk) % 29 == 17:
            raise FatalEngineError(f"fatal {len(chunk)}")
        if len(chunk) % 7 == 3:
            raise ValueError(f"soft {len(chunk)}")
        return super().extract(chunk, context)


_TURN = "doc_id long, chunk_index int, text string"
_CARRIED = r"""c AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS chunk_index, text, length(text) AS l FROM conversations),
k AS (SELECT *, min(chunk_index) FILTER (WHERE l % 29 = 17) OVER (PARTITION BY doc_id) AS cut FROM c),
s AS (SELECT *, CASE WHEN chunk_index > cut THEN 'skipped' WHEN l % 29 = 17 OR l % 7 = 3 THEN 'dropped' ELSE 'ok' END AS state, CASE WHEN chunk_index > cut THEN NULL WHEN l % 29 = 17 THEN 'fatal ' || l WHEN l % 7 = 3 THEN 'soft ' || l END AS error FROM k),
se AS (SELECT doc_id, chunk_index, unnest(range(1, len(ss) + 1)) AS i, unnest(ss) AS s FROM (SELECT doc_id, chunk_index, regexp_extract_all(text, '[^.!?]+[.!?]?') AS ss FROM s WHERE state = 'ok')),
ru AS MATERIALIZED (SELECT doc_id, chunk_index, i, w FROM (SELECT *, regexp_extract_all(rtrim(s, '.!?'), '[^\s,;:()"“”]+') AS w FROM se) WHERE len(w) >= 3),
seen AS (SELECT doc_id, name, min((chunk_index, i, side)) AS f FROM (SELECT doc_id, chunk_index, i, 0 AS side, w[1] AS name FROM ru UNION ALL SELECT doc_id, chunk_index, i, 1, w[-1] FROM ru) GROUP BY doc_id, name),
cand AS (SELECT s.doc_id, s.chunk_index, name, f, row_number() OVER (PARTITION BY s.doc_id, s.chunk_index ORDER BY f DESC) AS back FROM s JOIN seen ON seen.doc_id = s.doc_id AND seen.f[1] < s.chunk_index)
SELECT s.doc_id, s.chunk_index, state, error, CASE WHEN state <> 'skipped' THEN coalesce(p, '') END AS prior, CAST(CASE WHEN state = 'ok' THEN coalesce(n, 0) END AS INTEGER) AS n_propositions FROM s
LEFT JOIN (SELECT doc_id, chunk_index, string_agg(name, ',' ORDER BY f) AS p FROM cand WHERE back <= 20 GROUP BY ALL) q ON q.doc_id = s.doc_id AND q.chunk_index = s.chunk_index
LEFT JOIN (SELECT doc_id, chunk_index, count(*) AS n FROM ru GROUP BY ALL) m ON m.doc_id = s.doc_id AND m.chunk_index = s.chunk_index"""


def arrive(turns: DataFrame, folder: str, half: int, *, files: int = 8) -> None:
    """Half of the turns, dealt over files by a hash; every tenth turn comes in both halves."""
    at = F.xxhash64("doc_id", "chunk_index")
    (turns.filter((F.pmod(at, F.lit(2)) == half) | (F.pmod(at, F.lit(10)) == 0)).repartition(files, F.xxhash64("chunk_index", "doc_id")).write.mode("append").parquet(folder))


@query(f"WITH {_CARRIED}")
def streamed_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents whose turns arrive shuffled, in two runs of a stream on one checkpoint: each turn's outcome, and the names it was told."""
    at = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("chunk_index"), "text")
    for half in range(2):
        arrive(turns, f"{at}/in", half)
        start_extraction(spark, f"{at}/in", f"{at}/out", f"{at}/checkpoint", FailingEngine(), schema=_TURN).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("doc_id", "chunk_index", "state", "error", F.array_join("prior_entities", ",").alias("prior"), F.when(F.col("state") == "ok", F.size("propositions")).alias("n_propositions"))


# -- the whole run -----------------------------------------------------------------------


@query()
def rule_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to graph with the rule engine: edges of every document."""
    g = run_pipeline(laid_out(spark, sf_dir), RuleEngine(), rank=False, created_at="2000-01-01T00:00:00.000Z")
    return g.edges.select("doc_id", "id", "source", "target", "label", "weight")


_RULE_PROPS = r"""SELECT doc_id, chunk_index, pos, 'p' || (pos + 1) AS local_id, w[1] AS s_name, 'concept' AS s_type, array_to_string(w[2:-2], ' ') AS predicate, w[-1] AS o_name, 'concept' AS o_type,
trim(regexp_replace(s, '\s+', ' ', 'g')) AS text FROM ru"""
_RULE_RUN = rf"""{_BLOCKS}, {_chunk_parts(900, 120)},
se AS (SELECT doc_id, chunk_index, unnest(range(1, len(ss) + 1)) AS i, unnest(ss) AS s FROM (SELECT doc_id, chunk_index, regexp_extract_all(text, '[^.!?]+[.!?]?') AS ss FROM ck)),
wo AS (SELECT *, regexp_extract_all(rtrim(s, '.!?'), '[^\s,;:()"“”]+') AS w FROM se),
ru AS MATERIALIZED (SELECT doc_id, chunk_index, CAST(row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY i) - 1 AS INTEGER) AS pos, s, w FROM wo WHERE len(w) >= 3),
{_graph_parts(_RULE_PROPS)}"""


@query(f"WITH RECURSIVE {_RULE_RUN} SELECT doc_id, id, source, target, label, weight FROM edg")
def rule_graph_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without fuzzy merges, which SQL can follow from the texts on."""
    g = run_pipeline(laid_out(spark, sf_dir), RuleEngine(), rank=False, fuzzy=False, created_at="2000-01-01T00:00:00.000Z")
    return g.edges.select("doc_id", "id", "source", "target", "label", "weight")


@query(
    rf"""WITH RECURSIVE {_BLOCKS}, {_chunk_parts(900, 120)},
li AS (SELECT doc_id, text, array_to_string(regexp_extract_all(substr(text, 1, 4000), '\S+')[1:8], ' ') AS line FROM t),
ti AS (SELECT doc_id, text, nullif(regexp_replace(substr(regexp_replace(line, '^["''“”‘’#*\s]+|["''“”‘’.!*\s]+$', '', 'g'), 1, 80), '^\s+|\s+$', '', 'g'), '') AS title FROM li)
SELECT ti.doc_id, title, '2000-01-01T00:00:00.000Z' AS created_at, 'rule' AS engine, 'first-last' AS model, CAST(coalesce(n, 0) AS INTEGER) AS chunk_count, CAST(ceil(length(text) / 4.0) AS INTEGER) AS token_estimate
FROM ti LEFT JOIN (SELECT doc_id, count(*) AS n FROM ck GROUP BY doc_id) x ON x.doc_id = ti.doc_id"""
)
def run_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, engine, chunk count and token estimate of each document of a run."""
    return run_pipeline(laid_out(spark, sf_dir), RuleEngine(), rank=False, fuzzy=False, created_at="2000-01-01T00:00:00.000Z").meta


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the documents' knowledge graphs, heaviest first."""
    return rule_graph(spark, sf_dir).orderBy(F.desc("weight"), "doc_id", F.substring("id", 2, 20).cast("long"))

