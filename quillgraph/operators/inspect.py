"""Queries on a graph: neighbourhoods, details, encodings and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.taxonomy import TYPE_COLOR
from .graph import KnowledgeGraph

_COLORS = {k: v for k, v in TYPE_COLOR.items() if k != "other"}


def type_color(kind: Column) -> Column:
    out = F
    for name, color in _COLORS.items():
        out = out.when(kind == name, color)
    return out.otherwise(TYPE_COLOR["other"])


def ego_network(graph: KnowledgeGraph, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each seed(doc_id, id): (doc_id, seed, id) of itself and its neighbours, either way, and (doc_id, seed, edge_id) of its edges."""
    seeds = seeds.select("doc_id", F.col("id").alias("seed"))
    # an edge meets a seed at either end: two equi-joins
    ends = graph.edges.select("doc_id", F.col("id").alias("edge_id"), "source", "target")
    both = ends.withColumn("seed", F.col("source")).union(ends.withColumn("seed", F.col("target")))
    hit = both.join(seeds, ["doc_id", "seed"], "left_semi")
    edges = hit.select("doc_id", "seed", "edge_id").distinct()
    around = hit.select("doc_id", "seed", F.explode(F.array("source", "target")).alias("id"))
    alone = seeds.join(graph.nodes.select("doc_id", F.col("id").alias("seed")), ["doc_id", "seed"], "left_semi").select("doc_id", "seed", F.col("seed").alias("id"))
    return around.union(alone).distinct(), edges


def edge_neighbourhood(graph: KnowledgeGraph, edges: DataFrame) -> DataFrame:
    """(doc_id, edge_id, id): the two ends of each edge(doc_id, id)."""
    wanted = graph.edges.join(edges.select("doc_id", "id"), ["doc_id", "id"], "left_semi")
    return wanted.select("doc_id", F.col("id").alias("edge_id"), F.explode(F.array_distinct(F.array("source", "target"))).alias("id"))


def node_detail(graph: KnowledgeGraph) -> DataFrame:
    """(doc_id, id, edge_id, relation): each incident edge of each node, with an arrow and the other end's label.

    A self-loop shows once, as outgoing. The other end's id stands in where its label is missing.
    """
    labels = graph.nodes.select("doc_id", F.col("id").alias("other"), F.col("label").alias("other_label"))
    e = graph.edges.select("doc_id", F.col("id").alias("edge_id"), "source", "target", "label")
    leaving = e.select("doc_id", F.col("source").alias("id"), "edge_id", F.col("target").alias("other"), "label", F.lit(True).alias("out"))
    coming = e.filter("source <> target").select("doc_id", F.col("target").alias("id"), "edge_id", F.col("source").alias("other"), "label", F.lit(False).alias("out"))
    seen = leaving.union(coming).join(labels, ["doc_id", "other"], "left")
    name = F.coalesce("other_label", "other")
    return seen.select("doc_id", "id", "edge_id", F.when(F.col("out"), F.concat(F.lit("→ "), "label", F.lit(" "), name)).otherwise(F.concat(F.lit("← "), name, F.lit(" "), "label")).alias("relation"))


def node_header(graph: KnowledgeGraph) -> DataFrame:
    """(doc_id, id, header, also, chunks): the lines above a node's relations."""
    mentions = F.concat(F.col("mentions").cast("string"), F.lit(" mention"), F.when(F.col("mentions") == 1, "").otherwise("s"))
    header = F.concat_ws(" · ", F.col("type"), mentions, F.concat(F.lit("degree "), F.col("degree").cast("string")), F.concat(F.lit("rank "), F.format_string("%.4f", "rank")))
    return graph.nodes.select("doc_id", "id", "label", header.alias("header"), F.array_join("aliases", ", ").alias("also"), F.array_join(F.col("source_chunks").cast("array<string>"), ", ").alias("chunks"))


def edge_detail(graph: KnowledgeGraph) -> DataFrame:
    """(doc_id, id, source_label, label, target_label, weight, supporting, claims): claims in order of support, unknown ones left out."""
    text = graph.propositions.select("doc_id", F.col("id").alias("pid"), F.col("text").alias("claim")).filter("claim <> ''")
    claims = (
        graph.edges.select("doc_id", "id", F.posexplode("propositions").alias("k", "pid"))
        .join(text, ["doc_id", "pid"])
        .groupBy("doc_id", "id")
        .agg(F.sort_array(F.collect_list(F.struct("k", "claim"))).alias("c"))
    )
    labels = graph.nodes.select("doc_id", F.col("id").alias("nid"), F.col("label").alias("nlabel"))
    source = labels.select("doc_id", F.col("nid").alias("source"), F.col("nlabel").alias("source_label"))
    target = labels.select("doc_id", F.col("nid").alias("target"), F.col("nlabel").alias("target_label"))
    out = graph.edges.join(claims, ["doc_id", "id"], "left").join(source, ["doc_id", "source"], "left").join(target, ["doc_id", "target"], "left")
    return out.select("doc_id", "id", "source_label", "label", "target_label", "weight", F.size("propositions").alias("supporting"), F.coalesce(F.col("c.claim"), F.array().cast("array<string>")).alias("claims"))


def visual_nodes(nodes: DataFrame, *, max_label: int = 50) -> DataFrame:
    """(doc_id, id, label, size, color): labels cut to max_label with an ellipsis, size by the root of mentions."""
    label = F.when(F.length("label") > max_label, F.concat(F.substring("label", 1, max_label - 1), F.lit("…"))).otherwise(F.col("label"))
    return nodes.select("doc_id", "id", label.alias("label"), (5 + F.sqrt("mentions") * 3).alias("size"), type_color(F.col("type")).alias("color"))


def visual_edges(edges: DataFrame) -> DataFrame:
    return edges.select("doc_id", "id", F.least(1 + F.col("weight") * 0.7, F.lit(5.0)).alias("width"))


def circular_layout(nodes: DataFrame) -> DataFrame:
    """(doc_id, id, x, y) on the unit circle, in the order of ids."""
    order = F.substring("id", 2, 20).cast("long")
    i = F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) - 1
    angle = 2 * F.pi() * i / F.count("*").over(Window.partitionBy("doc_id"))
    return nodes.select("doc_id", "id", F.cos(angle).alias("x"), F.sin(angle).alias("y"))


def run_summary(graph: KnowledgeGraph) -> DataFrame:
    """(doc_id, title, nodes, edges, chunk_count) of each graph in meta."""
    n = graph.nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"))
    e = graph.edges.groupBy("doc_id").agg(F.count("*").alias("edges"))
    out = graph.meta.join(n, "doc_id", "left").join(e, "doc_id", "left")
    return out.select("doc_id", "title", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"), "chunk_count")
