"""Mixing sources to target weights, in DataFrame functions only.

A source's weight is its share of all tokens to the power of an exponent, normalised. The exponent is
bisected so that the weights reach a target entropy, or stay within a repetition limit. A weight times
the budget is a source's quota: whole passes over the source and a part of one more, which is a prefix
of a hashed permutation. Prefixes are found by blocks of the permutation: token sums by block, then a
running sum over blocks, then over the documents of the one block where the quota ends.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atheneum.llm.common import apart, table, written

MAX_REPEATS = 2.0
BLOCK_DOCS = 256
#: Blocks are found within runs of so many neighbours, so no task sums up more than these of a source.
RUN_BITS = 10
#: Up to so many sources the bisection runs on the driver; beyond, each of its steps is an aggregation.
DRIVER_SOURCES = 100_000
#: A table of one row a source is broadcast up to so many sources.
BROADCAST_SOURCES = 500_000


def _key(source: str) -> Column:
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source)))


def n_tokens(text: str) -> Column:
    """Words between ASCII blanks."""
    return F.coalesce(F.size(F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def bisect(under: Callable[[float], bool], steps: int = 50) -> float:
    """The smallest exponent in [0, 1] for which under holds; under must hold from some exponent on up to 1."""
    if under(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if under(middle) else (middle, high)
    return high


def temperature(sources: DataFrame, n_sources: int, total: int, budget: float | None, target_entropy: float | None, max_repeats: float) -> float:
    """The exponent: the largest that reaches target_entropy (nats) if given, and none below the one that keeps to max_repeats."""
    local = [r.tokens / total for r in sources.where("tokens > 0").select("tokens").collect()] if n_sources <= DRIVER_SOURCES else None

    def sums(a: float) -> tuple[float, float, float, float]:
        """Of share^a: the sum, the sum of its products with ln share, and the least and largest share^(a - 1)."""
        if local is not None:
            return sum(s**a for s in local), sum(s**a * math.log(s) for s in local), min(s ** (a - 1) for s in local), max(s ** (a - 1) for s in local)
        s = F.col("tokens") / total
        return tuple(sources.where("tokens > 0").agg(F.sum(s**a), F.sum(s**a * F.log(s)), F.min(s ** (a - 1)), F.max(s ** (a - 1))).first())

    def repeats(a: float) -> bool:
        z, _, least, most = sums(a)
        return (most / least if budget is None else budget * most / z / total) <= max_repeats * (1 + 1e-12)

    def entropy(a: float) -> bool:
        z, zl, _, _ = sums(a)
        return math.log(z) - a * zl / z <= target_entropy

    limit = bisect(repeats)
    return limit if target_entropy is None else max(limit, bisect(entropy))


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", budget: float | None = None, target_entropy: float | None = None, max_repeats: float = MAX_REPEATS, seed: int = 42, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """docs with n_tokens, weight (of its source), copies (how often the mixture takes it) and position.

    budget is in tokens; None takes the least budget at which every document is taken once or more.
    position, from 0 to 1, orders the mixture: sorted by it, sources interleave by weight. A null
    source is a source of its own. Sources without tokens weigh nothing and are taken once if budget
    is None, else never. Equal rows tie in the permutation and are taken together. A column of docs named
    n_tokens, weight, copies or position comes out with `_in` behind it; an empty table gives no rows.
    """
    own = ("n_tokens", "weight", "copies", "position", "_key", "_block", "_order")
    names = dict(zip(docs.columns, apart(docs, *own).columns, strict=True))
    docs, source_col, text_col = apart(docs, *own), names[source_col], names[text_col]
    n, alone = docs.count(), F.lit(int(budget is None))
    bits = min(24, max(0, math.ceil(math.log2(max(1, n / block_docs)))))
    order = F.xxhash64(F.lit(seed), *(F.col(c) for c, kind in docs.dtypes if not kind.startswith("map")))
    block = F.shiftright(F.col("_order"), 64 - bits) if bits else F.lit(0).cast("long")
    keyed = docs.withColumns({"n_tokens": n_tokens(text_col), "_key": _key(source_col), "_order": order}).withColumn("_block", block)
    narrow = written(keyed.select("_key", "_block", "_order", "n_tokens"), "mixing")
    blocks = written(narrow.groupBy("_key", "_block").agg(F.sum("n_tokens").alias("tokens")), "blocks")
    sources = written(blocks.groupBy("_key").agg(F.sum("tokens").alias("tokens")), "sources")
    n_sources, total = sources.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    side = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda df: df)
    a = temperature(sources, n_sources, total, budget, target_entropy, max_repeats) if total else 1.0
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(max(total, 1)), F.lit(a))).otherwise(0.0)
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    weighted = sources.withColumn("weight", power / z)
    if budget is None:
        budget = weighted.where("tokens > 0").agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    quota = F.when(F.col("tokens") > 0, F.col("weight") * budget).otherwise(0.0)
    whole = F.floor(F.col("quota") / F.greatest("tokens", F.lit(1)) + 1e-9)
    weighted = weighted.withColumn("quota", quota).withColumn("passes", whole).withColumn("rest", F.greatest(F.lit(0.0), F.col("quota") - F.col("passes") * F.col("tokens")))
    # The block where a quota ends: first the run of blocks, by running sums over runs, then the block in it.
    blocks = blocks.withColumn("_run", F.shiftright("_block", RUN_BITS))
    runs = blocks.groupBy("_key", "_run").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(W.partitionBy("_key").orderBy("_run"))
    runs = runs.withColumn("_to", upto).withColumn("_start", F.col("_to") - F.col("tokens")).join(side(weighted.select("_key", "rest")), "_key")
    runs = runs.where("_start <= rest and rest < _to").select("_key", "_run", "_start", "rest")
    upto = F.sum("tokens").over(W.partitionBy("_key", "_run").orderBy("_block"))
    ends = blocks.join(side(runs), ["_key", "_run"]).withColumn("_to", F.col("_start") + upto).withColumn("_from", F.col("_to") - F.col("tokens"))
    ends = ends.where("_from <= rest and rest < _to").select("_key", "_block", "_from", "rest")
    within = narrow.join(side(ends), ["_key", "_block"])
    taken = F.sum("n_tokens").over(W.partitionBy("_key", "_block").orderBy("_order"))  # equal orders are summed together
    last = within.withColumn("_taken", taken + F.col("_from")).where("_taken <= rest").groupBy("_key").agg(F.max("_order").alias("_last"))
    ends = ends.select("_key", F.col("_block").alias("_end"))
    plan = weighted.join(ends, "_key", "left").join(last, "_key", "left").select("_key", F.col("tokens").alias("_tokens"), "weight", "quota", "passes", "_end", "_last")
    plan = written(plan, "plan")
    once_more = (F.col("_block") < F.col("_end")) | ((F.col("_block") == F.col("_end")) & (F.col("_order") <= F.col("_last")))
    copies = F.when(F.col("_tokens") > 0, F.col("passes") + F.coalesce(once_more, F.lit(False)).cast("long")).otherwise(alone)
    place = (F.col("_order") / F.lit(2.0**64) + 0.5) * F.col("_tokens") / F.greatest("quota", F.lit(1e-300))
    position = F.when(F.col("_tokens") > 0, F.least(place, F.lit(1.0))).otherwise(F.col("_order") / F.lit(2.0**64) + 0.5)
    out = keyed.join(side(plan), "_key").withColumn("copies", copies.cast("long")).withColumn("position", position)
    return out.select(*docs.columns, "n_tokens", "weight", "copies", "position")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "n_tokens", "weight", "copies", "position")
