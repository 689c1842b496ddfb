"""Places in an order over all rows, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atheneum.storage import written


def numbered(df: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """df with each row's place (from 1) in a total order.

    Rows are dealt by ranges of the order and stored; each range numbers its own, and the sizes of the ranges before
    it, as many numbers as there are ranges, are added."""
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    at = F.row_number().over(W.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return parts.join(F.broadcast(before), "_part").select(*df.columns, at.cast("long").alias(place))


def strided(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """At most `most` rows, evenly spread over the order: each step-th from the first, where step is rows // most."""
    step = max(1, df.count() // most)
    return numbered(df, order).where((F.col("place") - 1) % step == 0).where(F.col("place") <= step * most).drop("place")
