"""Entity graphs: weights, communities, layout, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atheneum.functions.text import entity_key, entity_type
from atheneum.storage import written


def merge_entities(mentions: DataFrame) -> DataFrame:
    """Entities by (key, type) from mentions (name, type, alias): the first name, all aliases, mentions."""
    df = mentions.select(entity_key(F.col("name")).alias("key"), entity_type(F.col("type")).alias("type"), "name", "alias").where("key <> ''")
    return df.groupBy("key", "type").agg(F.min("name").alias("name"), F.array_sort(F.collect_set("alias")).alias("aliases"), F.count("*").alias("mentions"))


def node_weights(edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """Degree and weight of nodes; an edge counts at both ends, by two rows instead of an OR join."""
    ends = edges.select("edge_id", F.explode(F.array_distinct(F.array("source", "target"))).alias("node"))
    degree = ends.groupBy("node").agg(F.countDistinct("edge_id").alias("degree"))
    seen = mentions.groupBy("node").agg(F.count("*").alias("mentions"))
    zero = F.lit(0).cast("long")
    j = degree.join(seen, "node", "full_outer").select("node", F.coalesce("degree", zero).alias("degree"), F.coalesce("mentions", zero).alias("mentions"))
    return j.withColumn("weight", F.greatest(F.lit(1).cast("long"), F.col("degree") + F.col("mentions")))


def ring_layout(nodes: DataFrame, group: str, order: str, center: float = 18.0) -> DataFrame:
    """Nodes on a ring per group; the groups' centres lie on a circle."""
    n_groups = nodes.select(group).distinct()
    ranks = n_groups.withColumn("_g", F.row_number().over(W.orderBy(group)) - 1).withColumn("_groups", F.count("*").over(W.partitionBy(F.lit(1))))  # as many rows as groups
    sizes = nodes.groupBy(group).agg(F.count("*").alias("_n"))
    df = nodes.join(F.broadcast(ranks), group).join(F.broadcast(sizes), group)
    at = F.row_number().over(W.partitionBy(group).orderBy(order)) - 1
    turn, angle = 2 * F.pi() * F.col("_g") / F.col("_groups"), 2 * F.pi() * at / F.col("_n")
    radius = F.greatest(F.lit(3.0), F.sqrt("_n") * 2.5)
    return df.select(*nodes.columns, F.round(F.cos(turn) * center + F.cos(angle) * radius, 4).alias("x"), F.round(F.sin(turn) * center + F.sin(angle) * radius, 4).alias("y"))


def components(edges: DataFrame, source: str = "a", target: str = "b") -> DataFrame:
    """(node, component): the least node reachable from each node of edges, by star contraction (Kiveris et al. 2014).

    In turn each node links its larger neighbours to the least one about it, then itself and its smaller ones; paths
    shrink by halves. Each step is a written table, and only two numbers a step reach the driver. Nodes may be of any
    ordered kind; loops are components of one, rows without both ends are left out."""
    given = edges.select(F.col(source).alias("u"), F.col(target).alias("v")).where("u is not null and v is not null")

    def directed(e: DataFrame) -> DataFrame:
        return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    step = written(directed(given), "links")
    before = mark(step)
    while before[0]:
        both = step.unionByName(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = directed(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = written(directed(small.unionByName(least.select("u", F.col("m").alias("v")))), "links")
        after = mark(step)
        if after == before:
            break
        before = after
    alone = given.where("u = v").select("u").distinct().join(step.select("u").union(step.select("v")), "u", "left_anti")
    roots = step.select("v").distinct().union(alone)
    return step.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", "v"))
