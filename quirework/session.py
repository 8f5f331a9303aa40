"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "quirework", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and Arrow transfer on; `conf` adds settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, from spark.checkpoint.dir.

    Only where that setting is absent (a single machine, as in tests) a local folder is made.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    made = os.path.join(tempfile.gettempdir(), "quirework-checkpoints")
    os.makedirs(made, exist_ok=True)
    return "file://" + made


_CUTS: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes the tables that `cut` wrote in this process, once their results are no longer read; gives their number."""
    jvm = spark.sparkContext._jvm
    gone = 0
    while _CUTS:
        path = jvm.org.apache.hadoop.fs.Path(_CUTS.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def cut(df: DataFrame, label: str = "step", *partition_by: str) -> DataFrame:
    """Writes `df` once to the shared folder and reads it back.

    Unlike Dataset.checkpoint, which runs the plan a second time to write it, this runs it once;
    like it, the result outlives any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quirework-{label}-{uuid.uuid4().hex}"
    _CUTS.append(path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once per application, for the steps that run in Python workers."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="quirework-"), "quirework_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, files in os.walk(root):
                for name in sorted(files):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("quirework", os.path.relpath(full, root)))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)
    return spark


def spread(scan: DataFrame) -> DataFrame:
    """Gives every core a part of a scan that has fewer parts than half the cores (one small file, say).

    For plans without a shuffle that feed work in Python; larger inputs pass as they are. Only the partitioning
    differs, never the rows.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    parts = scan._jdf.queryExecution().toRdd().getNumPartitions()
    return scan.repartition(cores) if 0 < parts and 2 * parts <= cores else scan
