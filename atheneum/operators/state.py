"""Registry and queue state: rows are merged by joins, or folded from events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of both by key: new fields win where they are not null; change is inserted, updated, unchanged or kept."""
    same = F.lit(True)
    for f in fields:
        same &= F.coalesce(F.col(f"n.{f}"), F.col(f"o.{f}")).eqNullSafe(F.col(f"o.{f}"))
    is_new, is_old = F.col("n._in").isNotNull(), F.col("o._in").isNotNull()
    change = F.when(~is_old, "inserted").when(~is_new, "kept").when(same, "unchanged").otherwise("updated")
    j = old.withColumn("_in", F.lit(1)).alias("o").join(new.withColumn("_in", F.lit(1)).alias("n"), key, "full_outer")
    return j.select(key, *(F.coalesce(F.col(f"n.{f}"), F.col(f"o.{f}")).alias(f) for f in fields), change.alias("change"))


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def with_latest(rows: DataFrame, history: DataFrame, key: str, history_key: str, order: list[str]) -> DataFrame:
    """rows with `latest`, the struct of the row of history that is last in the order for their key, or null.

    The order has to be total for a definite answer. Each task keeps one row a key, so a key of very many rows does not gather."""
    last = history.groupBy(F.col(history_key).alias(key)).agg(F.max_by(F.struct(*history.columns), F.struct(*order)).alias("latest"))
    return rows.join(last, key, "left")


def fold_queue(events: DataFrame, key: str, status: str, at: str, seq: str, failed: str, done: str) -> DataFrame:
    """The queue row of each key from its events: last status, attempts, first start, completion and time by status.

    One aggregation: partial states are combined before the shuffle, so hot keys do not gather."""
    when = F.struct(at, seq)
    return events.groupBy(key).agg(
        F.max_by(status, when).alias("status"), F.count_if(F.col(status) == failed).alias("attempts"), F.min(at).alias("started"),
        F.max(F.when(F.col(status) == done, F.col(at))).alias("completed"), F.count("*").alias("events"),
    )


def without_orphans(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that have evidence, then nodes with a mention or such an edge."""
    edges = edges.join(evidence.select("edge_id").distinct(), "edge_id", "left_semi")
    used = mentions.select("node_id").union(edges.select("source")).union(edges.select("target")).distinct()
    return nodes.join(used, "node_id", "left_semi"), edges
