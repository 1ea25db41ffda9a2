"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship as send_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; every executor sees it.

    Where the setting is absent in local mode (tests on one machine) a folder is
    made once per session and set as checkpoint folder; on a cluster that is an
    error, as no machine's own folder is seen by the others.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = spark.conf.get("spark.millrace.shared.dir", None)
    if not own:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.millrace.shared.dir", own)
        spark.sparkContext.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which a query's shuffle files are deleted as soon as it ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back; its shuffle files go when it is written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that ``written`` made and nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ascii_lower(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, UPPER.lower())


#: Rows of an Arrow batch: texts can be long, and a batch is held several times over.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors and keep Arrow batches of texts small."""
    send_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_path(uri: str) -> str | None:
    """The path that ``open`` takes, or None where the folder is in another kind of store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def store(uri: str):
    """(file system, path) through pyarrow, for stores that are not mounted."""
    from pyarrow import fs

    path = local_path(uri)
    if path is not None:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(uri)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it needs to say."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def fits(df: DataFrame, most: int, width: str) -> bool:
    """Whether the rows of ``df``, of ``width`` bytes each (SQL), take at most ``most`` bytes; a sum that combines before the shuffle."""
    return (df.agg(F.sum(F.expr(width)).alias("b")).first().b or 0) <= most
