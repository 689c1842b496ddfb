"""Counts that follow changes: signed deltas of the changed chunks instead of a recount.

A Counts table is a folder of segments, each with the sums of a change by key; reading adds them up, so a change costs
as much as what it touches. Graph keeps a node graph's degrees and mentions that way: the evidence of an edge is
counted first, and only edges that gain their first or lose their last evidence change the degrees of their ends.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def signed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): how the number of rows by keys changes from before to after; what stays the same has no row.

    Both hold the rows of the changed chunks only: what they had, and what they have now (nothing, if deleted)."""
    rows = before.select(*keys, F.lit(-1).alias("n")).unionByName(after.select(*keys, F.lit(1).alias("n")))
    return rows.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")


@dataclass(frozen=True)
class Counts:
    spark: SparkSession
    path: str
    keys: T.StructType
    segments: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return self.keys.fieldNames()

    def _raw(self) -> DataFrame:
        kinds = T.StructType([*self.keys.fields, T.StructField("n", T.LongType())])
        return self.spark.read.schema(kinds).parquet(*(f"{self.path}/{s}" for s in self.segments)) if self.segments else self.spark.createDataFrame([], kinds)

    def read(self) -> DataFrame:
        """(keys, n) with n other than 0."""
        return self._raw().groupBy(*self.names).agg(F.sum("n").alias("n")).where("n <> 0")

    def at(self, keys: DataFrame) -> DataFrame:
        """(keys, n) of the given keys alone, 0 where there is none. Segments are cut to the keys before they are added up."""
        of = keys.select(*self.names).distinct()
        sums = self._raw().join(of, self.names, "left_semi").groupBy(*self.names).agg(F.sum("n").alias("n"))
        return of.join(sums, self.names, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))

    def add(self, deltas: DataFrame, name: str) -> Counts:
        """The table with a further segment; one that is there under its name is written anew, so a step may run again."""
        deltas.select(*self.names, F.col("n").cast("long").alias("n")).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return replace(self, segments=(*(s for s in self.segments if s != name), name))

    def compacted(self, name: str) -> Counts:
        """One segment in the place of all."""
        self.read().write.mode("overwrite").parquet(f"{self.path}/{name}")
        return replace(self, segments=(name,))


@dataclass(frozen=True)
class Graph:
    """Evidence by edge (edge_id, source, target), degrees and mentions by node."""

    evidence: Counts
    degree: Counts
    mentions: Counts

    @classmethod
    def empty(cls, spark: SparkSession, path: str, edge: str = "edge_id long, source long, target long", node: str = "node long") -> Graph:
        kinds = [T._parse_datatype_string(k) for k in (edge, node, node)]
        return cls(*(Counts(spark, f"{path}/{name}", kind) for name, kind in zip(("evidence", "degree", "mentions"), kinds, strict=True)))

    def changed(self, name: str, evidence: tuple[DataFrame, DataFrame], mentions: tuple[DataFrame, DataFrame]) -> Graph:
        """The graph after a change, given as (before, after) of the changed chunks' evidence (edge_id, source, target) and mentions (node)."""
        deltas = signed(*evidence, self.evidence.names)
        old = self.evidence.at(deltas).withColumnRenamed("n", "old")
        turned = deltas.join(old, self.evidence.names).select("*", ((F.col("old") + F.col("n") > 0).cast("int") - (F.col("old") > 0).cast("int")).alias("sign")).where("sign <> 0")
        ends = turned.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("node"), "sign").groupBy("node").agg(F.sum("sign").alias("n")).where("n <> 0")
        degree = self.degree.add(ends, name)  # before the evidence that it is told by
        return Graph(self.evidence.add(deltas, name), degree, self.mentions.add(signed(*mentions, self.mentions.names), name))

    def weights(self) -> DataFrame:
        """(node, degree, mentions, weight) as graph.node_weights gives them for the whole tables."""
        j = self.degree.read().withColumnRenamed("n", "degree").join(self.mentions.read().withColumnRenamed("n", "mentions"), "node", "full_outer")
        zero = F.lit(0).cast("long")
        j = j.select("node", F.coalesce("degree", zero).alias("degree"), F.coalesce("mentions", zero).alias("mentions"))
        return j.withColumn("weight", F.greatest(F.lit(1).cast("long"), F.col("degree") + F.col("mentions")))
