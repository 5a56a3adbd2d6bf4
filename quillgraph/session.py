"""Session helpers."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


# Arrow batches between the JVM and Python, unless the application sets its own: rows here are
# whole documents, and batches of the default size take hundreds of MB outside the heap.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once a Spark context, and bound the Arrow batches of the session.

    Python workers then find it wherever the driver was started from.
    """
    context = spark.sparkContext
    for key, value in ARROW_BATCH.items():
        if not context.getConf().contains(key):
            spark.conf.set(key, value)
    if getattr(context, "_quillgraph_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quillgraph-src-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "quillgraph-src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for inside, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(inside, name)
                    z.write(path, os.path.join("quillgraph", os.path.relpath(path, root)))
    context.addPyFile(target)
    context._quillgraph_shipped = True


def found_by_the_driver(spark: SparkSession) -> None:
    """Let Python processes that Spark starts beside the driver (for stateful processors and data sources) find this package, as what is shipped doesn't reach those."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def scratch(spark: SparkSession) -> str:
    """Folder every executor can reach, from spark.checkpoint.dir.

    Where the setting is absent (tests, one machine) a temporary folder is made;
    on a cluster that would lose data, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quillgraph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by the columns over a number of partitions of our own, which Spark doesn't merge: for rows that take long by their bytes."""
    session = df.sparkSession
    return df.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * session.sparkContext.defaultParallelism), *by)


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is written inside removes its shuffle files when it ends, not when the driver's heap happens to be swept."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    saved_tables(spark).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillgraph_path = path
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """df itself if `saved` returned it, else saved."""
    return df if hasattr(df, "_quillgraph_path") else saved(df, name)


def saved_in_buckets(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    """The same, in sorted buckets of the columns: joins and aggregations by them read the table without an exchange.

    The table has a name in the catalog only while it is opened.
    """
    spark = df.sparkSession
    token = uuid.uuid4().hex
    path, table = f"{scratch(spark)}/{name}-{token}", f"quillgraph_{token}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a task a bucket, so that each bucket is one sorted file
    with shuffles_go(spark):
        df.repartition(buckets, *by).write.option("compression", "zstd").option("path", path).bucketBy(buckets, *by).sortBy(*by).saveAsTable(table)
    saved_tables(spark).append(path)
    out = spark.table(table)
    out.schema  # noqa: B018  resolves it
    spark.sql(f"DROP TABLE {table}")  # external: the files stay
    return out


def saved_tables(spark: SparkSession) -> list[str]:
    """Paths of the tables that `saved` wrote in this application and `release` hasn't removed, oldest first."""
    context = spark.sparkContext
    if not hasattr(context, "_quillgraph_saved"):
        context._quillgraph_saved = []
    return context._quillgraph_saved


def forget(df: DataFrame) -> None:
    """Remove the one table that `saved` returned as df; nothing may read it any more."""
    spark, path = df.sparkSession, getattr(df, "_quillgraph_path", None)
    paths = saved_tables(spark)
    if path in paths:
        paths.remove(path)
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession, *, since: int = 0, keep: DataFrame | None = None) -> None:
    """Remove the saved tables from place `since` on, but for the one that `keep` is.

    Results that read them must have been written or collected before.
    """
    paths = saved_tables(spark)
    kept = getattr(keep, "_quillgraph_path", None)
    for path in paths[since:]:
        if path != kept:
            _delete(spark, path)
    paths[since:] = [kept] if kept in paths[since:] else []
