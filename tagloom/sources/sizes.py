"""How many partitions a shuffle needs, so that what a task holds doesn't grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that one task of a shuffle by key is to hold.
TASK_ROWS = 500_000
#: Rows of a lookup table that is broadcast; a larger one is shuffled.
MOST_LOOKUP = 1_000_000


def partitions_for(rows: int) -> int | None:
    """Partitions of a shuffle of so many rows; none if the session's own number will do, which Spark may then reduce."""
    spark = SparkSession.active()
    n = -(-rows // TASK_ROWS)
    own = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return None if n <= own else n


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """df in n partitions by keys, or in the session's own number."""
    return df.repartition(*keys) if n is None else df.repartition(n, *keys)


def looked_up(rows: DataFrame, key: str, lookup: DataFrame, lookup_key: str, n: int | None, size: int) -> DataFrame:
    """Inner join of rows with a lookup table of `size` rows: broadcast up to MOST_LOOKUP, else both dealt over n partitions and the lookup's share hashed."""
    on = F.col(key) == F.col(lookup_key)
    if size <= MOST_LOOKUP:
        return rows.join(F.broadcast(lookup), on)
    if n is None:
        return rows.join(lookup, on)
    return rows.repartition(n, key).join(lookup.repartition(n, lookup_key).hint("shuffle_hash"), on)
