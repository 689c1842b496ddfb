"""Expressions on vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def mean_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Element-wise means by keys; partial sums are combined before the shuffle."""
    parts = df.select(*keys, F.posexplode(vector).alias("_at", "_x")).groupBy(*keys, "_at").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.count("*").alias("n"))
    back = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_m"))).alias("_v"), F.max("n").alias("n"))
    return back.select(*keys, "n", F.transform("_v", lambda x: x["_m"]).alias("mean"))
