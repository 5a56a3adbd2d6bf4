"""Extraction: prompts, output schema, strict validation of engine replies, attempts and chunk states."""

from __future__ import annotations

import copy

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.taxonomy import ENTITY_TYPES
from ..functions.text import trim_ws

MAX_ATTEMPTS = 3
PRIOR_ENTITIES = 20

SYSTEM_PROMPT = f"""You are given one passage of a longer document. List the facts that it asserts, as data.

The reply is one JSON object, with no words or marks around it, under the key "propositions": a list with an entry for every fact. An entry has
  id         p1, p2 and so on
  text       the fact as a sentence of its own, which somebody who has not seen the passage understands
  subject    what the fact is about, and
  object     what it is said to have to do with, each as {{"name": ..., "type": ...}}
  predicate  a verb with few words, which leads from the subject to the object

A passage may assert nothing, as greetings and questions do; the list is empty then. Do not fill it from your own knowledge, and do not guess. A sentence that asserts several facts gives several entries.

The same thing keeps the same name in all entries: of the names in the passage, and of those listed as known from earlier passages, the most complete one, with no "the", "a" or "an" before it. "She", "this" or "the firm" stand for a name; find it, and write it instead.

As type, choose among {", ".join(ENTITY_TYPES)}; whatever fits none is other.

For instance, "The Severn Bridge, which opened in 1966, carries the M48." holds two facts:
{{"propositions": [{{"id": "p1", "text": "The Severn Bridge opened in 1966.", "subject": {{"name": "Severn Bridge", "type": "artifact"}}, "predicate": "opened in", "object": {{"name": "1966", "type": "time"}}}}, {{"id": "p2", "text": "The Severn Bridge carries the M48.", "subject": {{"name": "Severn Bridge", "type": "artifact"}}, "predicate": "carries", "object": {{"name": "M48", "type": "artifact"}}}}]}}"""
RETRY_PROMPT = "I could not read that as the JSON object described. Send the object again, complete, and nothing before or after it."
TITLE_PROMPT = "What would a librarian call the document that begins like this? Between three and eight words, on one line, and only those words."

# The shape of replies that engines and validation share.
_ENTITY = {"type": "object", "properties": {"name": {"type": "string"}, "type": {"type": "string", "enum": list(ENTITY_TYPES)}}, "required": ["name", "type"]}
_FIELDS = {"id": {"type": "string"}, "text": {"type": "string"}, "subject": _ENTITY, "predicate": {"type": "string"}, "object": _ENTITY}
EXTRACTION_SCHEMA = {
    "type": "object",
    "properties": {"propositions": {"type": "array", "items": {"type": "object", "properties": _FIELDS, "required": list(_FIELDS)}}},
    "required": ["propositions"],
}


def strict_schema(schema: dict) -> dict:
    """A copy in which every object forbids further properties."""
    out = copy.deepcopy(schema)
    todo = [out]
    while todo:
        node = todo.pop()
        if node.get("type") == "object":
            node["additionalProperties"] = False
            todo += node.get("properties", {}).values()
        elif node.get("type") == "array" and node.get("items"):
            todo.append(node["items"])
    return out


# -- prompts -----------------------------------------------------------------

_TITLE = "From the document: "
_PRIOR = "Known from earlier passages: "
_TASK = "The passage:\n\n"


def user_prompt(chunk: Column, title: Column, prior: Column) -> Column:
    """Optional title and earlier entities (array<string>), then the chunk, apart by blank lines."""
    return F.concat_ws(
        "\n\n",
        F.when(title != "", F.concat(F.lit(_TITLE), title)),
        F.when(F.size(prior) > 0, F.concat(F.lit(_PRIOR), F.array_join(prior, ", "))),
        F.concat(F.lit(_TASK), chunk),
    )


def user_prompt_text(chunk: str, title: str | None, prior: list[str]) -> str:
    """The same for one chunk, for engines in a worker."""
    parts = [_TITLE + title] if title else []
    if prior:
        parts.append(_PRIOR + ", ".join(prior))
    return "\n\n".join([*parts, _TASK + chunk])


# -- validation --------------------------------------------------------------


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once a row however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _filled(text: Column) -> Column:
    """The text, or null if it is empty."""
    return _once(text, lambda t: F.when(t != "", t))


def candidate_json(reply: Column) -> Column:
    """The reply from its first to its last brace, or all of it if it starts with one; null without."""
    return _filled(_once(trim_ws(reply), lambda t: F.when(F.startswith(t, F.lit("{")), t).otherwise(F.regexp_extract(t, r"\{[\s\S]*\}", 0))))


def strict_json(candidate: Column) -> Column:
    """The candidate as a variant, or null unless it is one JSON value and nothing more.

    try_parse_json passes over what follows a value, so the candidate goes into an array
    before a sentinel: only a single whole value leaves that array with two elements.
    """

    def single(wrapped: Column) -> Column:
        whole = (F.size(F.try_variant_get(wrapped, "$", "array<variant>")) == 2) & (F.try_variant_get(wrapped, "$[1].__end", "int") == 1)
        return F.when(whole, F.try_variant_get(wrapped, "$[0]", "variant"))

    return _once(F.try_parse_json(F.concat(F.lit("["), candidate, F.lit(',{"__end":1}]'))), single)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _string_at(v: Column, path: str) -> Column:
    """The string at a path; null if it's missing or of another type."""
    return _once(F.try_variant_get(v, path, "variant"), lambda got: F.when(_kind(got) == "STRING", F.try_variant_get(got, "$", "string")))


def _mention(v: Column, path: str) -> Column:
    kind = _once(_string_at(v, f"{path}.type"), lambda k: F.when(k.isin(*ENTITY_TYPES), k).otherwise("other"))
    return F.struct(_filled(trim_ws(_string_at(v, f"{path}.name"))).alias("name"), kind.alias("type"))


def _proposition(v: Column, i: Column) -> Column:
    number = _once(F.try_variant_get(v, "$.confidence", "variant"), lambda given: F.when(_kind(given).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(given, "$", "double")))
    return F.struct(
        i.cast("int").alias("pos"),
        F.coalesce(_filled(_string_at(v, "$.id")), F.concat(F.lit("p"), (i + 1).cast("string"))).alias("local_id"),
        _filled(trim_ws(_string_at(v, "$.text"))).alias("text"),
        _mention(v, "$.subject").alias("subject"),
        _filled(trim_ws(_string_at(v, "$.predicate"))).alias("predicate"),
        _mention(v, "$.object").alias("object"),
        _once(number, lambda n: F.when(n.between(0, 1), n)).alias("confidence"),
    )


def _well_formed(p: Column) -> Column:
    return p["text"].isNotNull() & p["predicate"].isNotNull() & p["subject"]["name"].isNotNull() & p["object"]["name"].isNotNull()


def parse_replies(replies: DataFrame) -> DataFrame:
    """replies(..., reply) with `propositions`: null for an unusable reply, else the well-formed propositions.

    Malformed propositions drop out of a usable reply; `pos` is the place in the reply as
    given, which also numbers propositions without an id. Of a key that repeats in a reply the
    last value counts, which Spark has only as a setting: it is set for the session, and stays so.
    """
    replies.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # the last one wins
    value = replies.withColumn("_v", strict_json(candidate_json(F.col("reply"))))
    items = _once(F.try_variant_get("_v", "$.propositions", "variant"), lambda listed: F.when(F.startswith(_kind(listed), F.lit("ARRAY")), F.try_variant_get(listed, "$", "array<variant>")))
    return value.withColumn("propositions", F.filter(F.transform(items, _proposition), _well_formed)).drop("_v")


def first_valid_attempts(parsed: DataFrame, *, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(doc_id, chunk_index, attempts, attempt, propositions): the first usable reply of each chunk, nulls if it has none.

    parsed has attempts numbered from 1; those beyond max_attempts were never made.
    """
    made = parsed.filter(F.col("attempt") <= max_attempts)
    usable = F.col("propositions").isNotNull()
    return made.groupBy("doc_id", "chunk_index").agg(
        F.count("*").cast("int").alias("attempts"),
        F.min(F.when(usable, F.col("attempt"))).cast("int").alias("attempt"),
        F.min_by("propositions", F.when(usable, F.col("attempt"))).alias("propositions"),
    )


def proposition_rows(chosen: DataFrame) -> DataFrame:
    """One row a proposition from (doc_id, chunk_index, propositions); pos becomes the place among those kept."""
    rows = chosen.select("doc_id", "chunk_index", F.posexplode("propositions").alias("pos", "p"))
    return rows.select("doc_id", "chunk_index", "pos", "p.local_id", "p.text", "p.subject", "p.predicate", "p.object", "p.confidence")


# -- chunk states ------------------------------------------------------------


def chunk_status(outcomes: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, state, error) from outcomes(doc_id, chunk_index, ok, error, fatal).

    ok       before any fatal failure, and extracted
    dropped  failed with its error; a fatal one included
    skipped  after the first fatal failure of the document, without an error
    """
    first_fatal = F.min(F.when(F.col("fatal") & ~F.col("ok"), F.col("chunk_index"))).over(Window.partitionBy("doc_id"))
    cut = outcomes.withColumn("_cut", first_fatal)
    after = F.col("chunk_index") > F.col("_cut")
    return cut.select(
        "doc_id",
        "chunk_index",
        F.when(F.coalesce(after, F.lit(False)), "skipped").when(F.col("ok"), "ok").otherwise("dropped").alias("state"),
        F.when(~F.coalesce(after, F.lit(False)) & ~F.col("ok"), F.col("error")).alias("error"),
    )


def drop_report(status: DataFrame) -> DataFrame:
    """(doc_id, chunks, dropped_chunks, drop_error): indexes not extracted, and the last error."""
    return status.groupBy("doc_id").agg(
        F.count("*").alias("chunks"),
        F.array_sort(F.collect_list(F.when(F.col("state") != "ok", F.col("chunk_index")))).alias("dropped_chunks"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.col("chunk_index"))).alias("drop_error"),
    )


def prior_entities(chunks: DataFrame, propositions: DataFrame, *, carry: int = PRIOR_ENTITIES) -> DataFrame:
    """(doc_id, chunk_index, prior_entities): the last `carry` distinct names first seen in earlier chunks, in that order.

    Names get ranks by first sight, so each chunk needs the `carry` ranks up to its count of
    earlier names: an equi-join of a few rows a chunk, not a range join of all its names.
    """
    order = F.struct(F.col("chunk_index"), F.col("pos"), F.col("side"))
    sides = propositions.select("doc_id", "chunk_index", "pos", F.posexplode(F.array("subject.name", "object.name")).alias("side", "name"))
    names = sides.groupBy("doc_id", "name").agg(F.min(order).alias("first"))
    ranked = names.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")))
    new = ranked.groupBy("doc_id", F.col("first.chunk_index").alias("chunk_index")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    known = chunks.select("doc_id", "chunk_index").distinct().join(new, ["doc_id", "chunk_index"], "full").withColumn("known", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    wanted = known.filter("known > 0").select("doc_id", "chunk_index", F.explode(F.sequence(F.greatest(F.lit(1), F.col("known") - carry + 1), "known")).alias("rank"))
    got = wanted.join(ranked.select("doc_id", F.col("rank").cast("long").alias("rank"), "name"), ["doc_id", "rank"]).groupBy("doc_id", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("got"))
    out = chunks.select("doc_id", "chunk_index").distinct().join(got, ["doc_id", "chunk_index"], "left")
    return out.select("doc_id", "chunk_index", F.coalesce(F.col("got.name"), F.array().cast("array<string>")).alias("prior_entities"))
