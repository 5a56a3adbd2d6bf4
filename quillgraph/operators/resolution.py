"""Entity resolution: exact merge by key and type, fuzzy merge, components, labels and ids.

Order is meaning here: `seq` gives the order of mentions in a document, clusters follow
their first mention, entities their first cluster, forms their cluster and then their own
first mention. All of it is carried in columns, so no result depends on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_key, utf16_length
from ..session import saved, ship_package
from .components import components
from .numbering import numbered
from .similarity import COSINE_THRESHOLD, JARO_WINKLER_THRESHOLD, cosine_links, cosine_pairs, jaro_winkler, jaro_winkler_pairs

__all__ = ["COSINE_THRESHOLD", "JARO_WINKLER_THRESHOLD", "cosine_links", "cosine_pairs", "jaro_winkler", "jaro_winkler_pairs"]


PLACE_BITS = 37  # of a place in a chunk: a proposition's number below 2^36, and the side


def place(chunk_index: str, pos: str, side: str | None = None) -> Column:
    """Chunk, proposition and side as one number in their order. Numbers that don't fit are an error, not another's place."""
    fits = F.col(chunk_index).between(-(1 << 26), (1 << 26) - 1) & F.col(pos).between(0, (1 << PLACE_BITS - 1) - 1)
    number = F.shiftleft(F.col(chunk_index).cast("long"), PLACE_BITS) + F.col(pos).cast("long") * 2 + (F.lit(0) if side is None else F.col(side))
    return F.when(fits, number).otherwise(F.raise_error(F.concat(F.lit("no place for chunk "), chunk_index, F.lit(", proposition "), pos)).cast("long"))


def mentions_of(propositions: DataFrame) -> DataFrame:
    """(doc_id, seq, chunk_index, name, type): subject, then object, of each proposition in order."""
    sides = propositions.select("doc_id", "chunk_index", "pos", F.posexplode(F.array("subject", "object")).alias("side", "m"))
    return sides.select("doc_id", place("chunk_index", "pos", "side").alias("seq"), "chunk_index", "m.name", "m.type")


def form_counts(mentions: DataFrame) -> DataFrame:
    """(doc_id, key, type, form, n, form_seq, chunks): occurrences, first place and chunks of each raw form; empty keys are left out."""
    # counted by chunk first, as sets of mentions one by one would have to be sorted; a form is normalised once, not at each mention
    by_chunk = mentions.groupBy("doc_id", "type", F.col("name").alias("form"), "chunk_index").agg(F.count("*").alias("n"), F.min("seq").alias("form_seq"))
    forms = by_chunk.groupBy("doc_id", "type", "form").agg(F.sum("n").alias("n"), F.min("form_seq").alias("form_seq"), F.collect_set("chunk_index").alias("chunks"))
    # a key that names a count: else Spark moves the filter by it, and the normalising, back under the counting
    return forms.withColumn("key", F.when(F.col("n") > 0, norm_key("form"))).filter("key <> ''").select("doc_id", "key", "type", "form", "n", "form_seq", "chunks")


def clusters_of_forms(forms: DataFrame) -> DataFrame:
    """(doc_id, key, type, first_seq, mentions): forms of equal key and type."""
    return forms.groupBy("doc_id", "key", "type").agg(F.min("form_seq").alias("first_seq"), F.sum("n").alias("mentions"))


def surface_clusters(mentions: DataFrame) -> DataFrame:
    return clusters_of_forms(form_counts(mentions))


def borderline_pairs(clusters: DataFrame, *, low: float = 0.78, threshold: float = COSINE_THRESHOLD) -> DataFrame:
    """Pairs that just miss the cosine threshold, for a closer look by other means; they are not merged."""
    return cosine_pairs(clusters, threshold=low).filter(F.col("similarity") < threshold)


Embedder = Callable[[list[str]], list[list[float]]]


def embed_keys(clusters: DataFrame, make_embedder: Callable[[], Embedder | None]) -> DataFrame:
    """(key, embedding) of the distinct keys of clusters, with an embedder made once a worker.

    It is given batches of keys and returns unit vectors. Where there is none, or it fails,
    keys get no vector, and their documents compare by text.
    """
    ship_package(clusters.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = make_embedder()
        for batch in batches:
            try:
                vectors = embedder(batch["key"].tolist()) if embedder else []
            except Exception:  # noqa: BLE001  text similarity takes over
                vectors = []
            if len(vectors) == len(batch):
                yield pd.DataFrame({"key": batch["key"], "embedding": [list(map(float, v)) for v in vectors]})

    return clusters.select("key").distinct().mapInPandas(run, "key string, embedding array<double>")


@dataclass
class Resolution:
    """entities(doc_id, id, label, type, aliases, mentions, source_chunks, first_seq), id_map(doc_id, key, type, id) and
    the same for the raw forms met, form_map(doc_id, form, type, id), which needs no normalising.
    """

    entities: DataFrame
    id_map: DataFrame
    form_map: DataFrame

    def ids_for(self, names: DataFrame, *, name: str = "name", type: str = "type", into: str = "id") -> DataFrame:
        """names with the id of the entity that each name and type resolves to, or null."""
        keys = self.id_map.select("doc_id", F.col("key").alias("_key"), F.col("type").alias("_type"), F.col("id").alias(into))
        keyed = names.withColumn("_key", norm_key(name)).withColumn("_type", F.col(type))
        return keyed.join(keys, ["doc_id", "_key", "_type"], "left").drop("_key", "_type")


def fuzzy_links(clusters: DataFrame, vectors: DataFrame | None, *, cosine_threshold: float, jaro_winkler_threshold: float) -> DataFrame:
    """(doc_id, a, b): pairs by which clusters hang together. With vectors(key, embedding), documents whose every cluster has one compare by cosine; the rest by Jaro-Winkler."""
    if vectors is None:
        return jaro_winkler_pairs(clusters, threshold=jaro_winkler_threshold).select("doc_id", "a", "b")
    have = saved(clusters.join(vectors.select("key", "embedding").dropDuplicates(["key"]), "key", "left"), "clusters-with-vectors")
    # documents by a join, as a window would hold all vectors of one in one task
    lacking = have.filter("embedding IS NULL").select("doc_id").distinct()
    of = lambda how: have.alias("h").join(lacking.alias("l"), F.col("h.doc_id").eqNullSafe(F.col("l.doc_id")), how)
    by_vector = cosine_links(of("left_anti"), threshold=cosine_threshold)
    by_text = jaro_winkler_pairs(of("left_semi"), threshold=jaro_winkler_threshold)
    return by_vector.select("doc_id", "a", "b").union(by_text.select("doc_id", "a", "b"))


def resolve_entities(
    mentions: DataFrame,
    *,
    vectors: DataFrame | None = None,
    make_embedder: Callable[[], Embedder | None] | None = None,
    cosine_threshold: float = COSINE_THRESHOLD,
    jaro_winkler_threshold: float = JARO_WINKLER_THRESHOLD,
    fuzzy: bool = True,
) -> Resolution:
    """Entities of mentions(doc_id, seq, chunk_index, name, type), document by document.

    vectors  (key, embedding): unit vectors of normalised names, from any embedder
    make_embedder  makes the embedder that gives vectors where none are passed; see embed_keys
    fuzzy    False stops after the exact merge
    """
    forms = saved(form_counts(mentions), "forms")  # one pass over the mentions; the rest works on distinct forms
    clusters = clusters_of_forms(forms)
    if fuzzy:
        if vectors is None and make_embedder is not None:
            vectors = saved(embed_keys(clusters, make_embedder), "vectors")
        links = fuzzy_links(clusters, vectors, cosine_threshold=cosine_threshold, jaro_winkler_threshold=jaro_winkler_threshold)
        merged = components(links, by=["doc_id"]).select("doc_id", F.col("node").alias("first_seq"), F.col("component"))
        placed = clusters.join(merged, ["doc_id", "first_seq"], "left").withColumn("entity_seq", F.coalesce("component", "first_seq")).drop("component")
    else:
        placed = clusters.withColumn("entity_seq", F.col("first_seq"))
    heads = numbered(placed.filter("entity_seq = first_seq").select("doc_id", "entity_seq"), by=["doc_id"], order=["entity_seq"], name="number")
    placed = placed.join(heads, ["doc_id", "entity_seq"]).withColumn("id", F.concat(F.lit("n"), F.col("number").cast("string"))).drop("number")
    id_map = saved(placed.select("doc_id", "key", "type", "id", "entity_seq", "first_seq"), "entity-ids")
    placed_forms = forms.join(id_map, ["doc_id", "key", "type"])
    # the label leads: most frequent, then longest, then first
    rank = F.struct(-F.col("n"), -utf16_length("form"), F.col("first_seq"), F.col("form_seq"))
    in_order = F.struct("first_seq", "form_seq", "form")
    by_entity = placed_forms.groupBy("doc_id", "id", "type", "entity_seq").agg(
        F.min_by("form", rank).alias("label"),
        F.sort_array(F.collect_list(in_order)).alias("forms"),
        F.sum("n").alias("mentions"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("chunks")))).alias("source_chunks"),
    )
    entities = by_entity.select(
        "doc_id",
        "id",
        "label",
        "type",
        F.filter(F.transform("forms", lambda f: f["form"]), lambda f: f != F.col("label")).alias("aliases"),
        "mentions",
        "source_chunks",
        F.col("entity_seq").alias("first_seq"),
    )
    return Resolution(entities, id_map.select("doc_id", "key", "type", "id"), placed_forms.select("doc_id", "form", "type", "id"))
