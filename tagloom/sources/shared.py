"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir(app: str) -> str:
    return tempfile.mkdtemp(prefix="tagloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_dir(spark.sparkContext.applicationId)


def file_system(spark: SparkSession, path: str):
    """The file system that holds a path, and the path as it names it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


@functools.cache
def _folder(app: str, shared: str) -> str:
    """This application's folder, which goes when the application ends."""
    path, spark = f"{shared}/tagloom-{app}", SparkSession.active()
    fs, at = file_system(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_folder(spark.sparkContext.applicationId, shared_dir(spark))}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to the shared folder, in folders by some columns, and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove what stored() wrote, once nothing reads it any more."""
    for df in tables:
        fs, at = file_system(df.sparkSession, df.stored_at)
        fs.delete(at, True)
