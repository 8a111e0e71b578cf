"""Spark session set-up and the shared folder of intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def local_session(cores: int = 8, app: str = "sedimark", **conf: str) -> SparkSession:
    """A session for one machine; on a cluster pass the cluster's own session to the operators instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    On one machine (a local master) a temporary folder stands in where it is unset; elsewhere that is an error, since a
    machine-local folder is not seen by other machines and does not survive the loss of an executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all machines share")
    own = _LOCAL.get(spark.sparkContext.applicationId)
    if own is None:
        own = _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="sedimark-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder: nothing before it is computed again, whatever executor is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sedimark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._sedimark_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table of :func:`cut_lineage` that nothing reads any more."""
    path = getattr(df, "_sedimark_path", None)
    if path:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_width(spark: SparkSession) -> int:
    """The session's shuffle width, for the few places that need a fixed number of partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
