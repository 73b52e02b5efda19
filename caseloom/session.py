"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]
_local_root: str | None = None


def build_session(app: str = "caseloom", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the jobs are designed for; ``conf`` adds or overrides."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for ``name`` in the folder all executors share.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. A local
    session has no executors elsewhere, so it may fall back to a temporary folder.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        if _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="caseloom-")
        root = _local_root
    return f"{root.rstrip('/')}/caseloom-{_RUN}/{name}-{uuid.uuid4().hex[:8]}"


def plain_folder(spark: SparkSession, path: str) -> str | None:
    """``path`` as the operating system names it, or None where only Spark's file systems open it."""
    scheme, _, rest = path.partition(":")
    if not rest:
        scheme = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").partition(":")[0]
        return path if scheme == "file" else None
    return "/" + rest.lstrip("/") if scheme == "file" else None


def settle(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as a shared table and read it back.

    Used where several jobs read one expensive result: the lineage is cut, a lost
    executor re-reads files, and Catalyst sees real sizes for its join choices.
    """
    path = work_path(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give heavy per-row work at least a task per core.

    A table in a few files of one row group each is read by as many tasks, however many
    splits are planned; such input is repartitioned on its key. Input with more files than
    cores is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    planned = df.rdd.getNumPartitions()
    if planned >= 4 * cores or (planned >= cores and len(df.inputFiles()) >= cores):
        return df
    return df.repartition(cores, key)
