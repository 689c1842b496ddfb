"""Helpers that the operators of this folder share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atheneum.storage import shared_dir, written  # noqa: F401, the operators of this folder take them from here

#: A group is heavy when it holds at least this share of all rows, so there are at most 1 / share heavy groups.
HEAVY_SHARE = 1 / 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apart(docs: DataFrame, *names: str) -> DataFrame:
    """docs with `_in` behind the columns whose names (in any case) an operator uses itself, as often as it takes."""
    taken = {n.lower() for n in names}
    given = [f.name for f in docs.schema]
    used = taken | {g.lower() for g in given}
    out = []
    for g in given:
        if g.lower() in taken:
            g += "_in"
            while g.lower() in used:
                g += "_in"
            used.add(g.lower())
        out.append(g)
    return docs if out == given else docs.toDF(*out)


def lookup(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """rows inner-joined to groups (one row a key) by key.

    Groups with at least HEAVY_SHARE of all rows, of which there are at most 1 / HEAVY_SHARE, are
    broadcast, so a hot key never meets in one task; the others are joined by a shuffle.
    """
    heavy = groups.where(F.col(size) >= max(1000, int(n_rows * HEAVY_SHARE)))
    hot = rows.join(F.broadcast(heavy), key)
    cold = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(groups, key)
    return hot.unionByName(cold.select(hot.columns))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label) of every node of edges (u, v, both long): label is the smallest node reachable.

    Large-star and small-star steps (Kiveris et al. 2014) alternate until the edges no longer change;
    each step's edges are a written table, and only two numbers a step reach the driver.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return roots.unionByName(edges.select(F.col("u").alias("node"), F.col("v").alias("label")))


def raw(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a text column, without decoding them."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


_WORD = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else ord(chr(c).lower()) if chr(c).isupper() else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD).split()
