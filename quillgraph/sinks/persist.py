"""Saved graphs: Parquet snapshots by version, and one manifest a graph that names them.

A save writes a new snapshot beside those there are, and then swaps the graph's manifest in
one rename. So readers see a version whole or not at all, those that read an older one go on
doing so, and a save that was cut short is never seen. Old versions stay until `vacuum`.
"""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import KnowledgeGraph

PARTS = ("nodes", "edges", "propositions", "meta")
_VERSION = "version string, title string, saved_at string, node_count long, edge_count long, parts array<string>"
_MANIFEST = f"graph_id string, versions array<struct<{_VERSION.replace(' ', ':').replace(',:', ',')}>>"


class _Files:
    """The store's files by Hadoop, whatever file system they are on."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.jvm, self.conf = spark, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(store).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def read(self, name: str) -> dict | None:
        try:
            stream = self.fs.open(self.path(name))
        except Exception as e:  # noqa: BLE001  py4j wraps what Java throws
            if "FileNotFoundException" in str(e):
                return None
            raise
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def swap(self, name: str, content: dict) -> None:
        """Put content at name in one step."""
        draft = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self.path(draft))
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        overwrite = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        context.rename(self.path(draft), self.path(name), overwrite)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _manifest(store: str, graph_id: str) -> str:
    return f"{store}/graphs/{graph_id}/manifest.json"


def save_graph(graph: KnowledgeGraph, store: str, *, graph_id: str | None = None) -> str:
    """Save under a new id, or as the next version of a given one; the id.

    A graph may span many documents. The graph saved may itself be one that was loaded from
    the same id. Of two saves of one id at a time, the one that ends last is current.
    """
    spark = graph.nodes.sparkSession
    files = _Files(spark, store)
    graph_id = graph_id or f"g-{uuid.uuid4().hex}"
    now = datetime.datetime.now(datetime.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    version = f"{now.translate({ord(c): None for c in '-:.'})}-{uuid.uuid4().hex[:8]}"
    at = f"{store}/graphs/{graph_id}/{version}"
    parts = [p for p in PARTS if getattr(graph, p) is not None]
    for part in parts:
        getattr(graph, part).write.parquet(f"{at}/{part}")
    count = lambda part: spark.read.parquet(f"{at}/{part}").count()
    title = spark.read.parquet(f"{at}/meta").agg(F.max("title")).first()[0] if "meta" in parts else None
    entry = {"version": version, "title": title or "untitled", "saved_at": now, "node_count": count("nodes"), "edge_count": count("edges"), "parts": parts}
    old = files.read(_manifest(store, graph_id)) or {"versions": []}
    files.swap(_manifest(store, graph_id), {"graph_id": graph_id, "versions": [*old["versions"], entry]})
    return graph_id


def _manifests(spark: SparkSession, store: str) -> DataFrame:
    files = _Files(spark, store)
    found = files.fs.globStatus(files.path(f"{store}/graphs/*/manifest.json"))
    if not found:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).json(f"{store}/graphs/*/manifest.json")


def list_graphs(spark: SparkSession, store: str) -> DataFrame:
    """(graph_id, title, saved_at, node_count, edge_count) of current versions, latest first."""
    rows = _manifests(spark, store).select("graph_id", F.element_at("versions", -1).alias("v"))
    return rows.select("graph_id", "v.title", "v.saved_at", "v.node_count", "v.edge_count").orderBy(F.desc("saved_at"), "graph_id")


def list_versions(spark: SparkSession, store: str, graph_id: str | None = None) -> DataFrame:
    """(graph_id, number, version, title, saved_at, node_count, edge_count): all versions that are kept, the first is 1."""
    rows = _manifests(spark, store)
    rows = rows if graph_id is None else rows.filter(F.col("graph_id") == graph_id)
    return rows.select("graph_id", F.posexplode("versions").alias("number", "v")).select("graph_id", (F.col("number") + 1).alias("number"), "v.version", "v.title", "v.saved_at", "v.node_count", "v.edge_count")


def load_graph(spark: SparkSession, store: str, graph_id: str, *, version: str | None = None) -> KnowledgeGraph | None:
    """The graph's current or named version, or None if there is none. It stays readable while newer ones are saved."""
    manifest = _Files(spark, store).read(_manifest(store, graph_id))
    entries = [e for e in (manifest or {"versions": []})["versions"] if version in (None, e["version"])]
    if not entries:
        return None
    entry = entries[-1]
    read = lambda part: spark.read.parquet(f"{store}/graphs/{graph_id}/{entry['version']}/{part}") if part in entry["parts"] else None
    return KnowledgeGraph(*map(read, PARTS))


def vacuum(spark: SparkSession, store: str, graph_id: str, *, keep: int = 1) -> int:
    """Forget and then remove all but the latest `keep` versions, and what saves that were cut short left; how many folders went."""
    files = _Files(spark, store)
    manifest = files.read(_manifest(store, graph_id))
    if manifest is None:
        return 0
    kept = manifest["versions"][-max(1, keep) :]
    files.swap(_manifest(store, graph_id), manifest | {"versions": kept})
    gone = [s.getPath().toString() for s in files.fs.listStatus(files.path(f"{store}/graphs/{graph_id}")) if s.isDirectory() and s.getPath().getName() not in {e["version"] for e in kept}]
    for folder in gone:
        files.delete(folder)
    return len(gone)


def delete_graph(spark: SparkSession, store: str, graph_id: str) -> None:
    """Remove a graph; one that isn't there is no error. The manifest goes first."""
    files = _Files(spark, store)
    files.delete(_manifest(store, graph_id))
    files.delete(f"{store}/graphs/{graph_id}")
