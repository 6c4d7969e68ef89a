"""Tables as Parquet (nested types included) and CSV; schemas are stated, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

LONG = "track string, artist string, tag_name string, tag_count double"
LOOKUP = "intern string, print string"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, *, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | StructType, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, header=True, enforceSchema=False, nullValue="NA", quote='"', escape='"')


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Nulls are written as NA, as they are read."""
    df.write.mode("overwrite").csv(path, sep=sep, header=True, nullValue="NA", emptyValue='""', quote='"', escape='"')


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """intern;print pairs."""
    return read_csv(spark, path, LOOKUP, ";")


def write_states(tables: dict[str, DataFrame], path: str) -> None:
    """One table per component of a folding."""
    for name, df in tables.items():
        write_table(df, f"{path}/{name}")


def read_states(spark: SparkSession, path: str, names: tuple[str, ...] = ("order", "sizes", "ginis")) -> dict[str, DataFrame]:
    return {name: read_table(spark, f"{path}/{name}") for name in names}
