"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "strainspark", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume: UTC, ANSI, AQE with skew joins.

    On a cluster, leave ``master`` and ``shuffle_partitions`` unset: they come from spark-submit.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Only where the session names none and runs on one machine (tests) is a temporary folder made and set;
    on a cluster that is a ValueError.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strainspark-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


#: This driver's own part of the shared folder.
_OWN = uuid.uuid4().hex


def scratch(spark: SparkSession, name: str) -> str:
    """A new, not yet existing path in this driver's part of the shared folder; :func:`clean` deletes them all."""
    return f"{shared_dir(spark)}/strainspark-{_OWN}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back: lineage ends there, and a lost
    executor costs no recomputation of what came before."""
    path = scratch(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete all that this driver wrote into the shared folder; call it when no DataFrame made so far is needed."""
    remove(spark, f"{shared_dir(spark)}/strainspark-{_OWN}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`scratch`."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
