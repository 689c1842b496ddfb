"""Where a new file belongs: patterns of placed files, scores, predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atheneum.functions import paths as P
from atheneum.storage import written

CONTEXT = ["customer", "initiative", "stage", "kind"]
#: What a match of each part of the context adds to a score.
WEIGHTS = {"customer": 0.45, "initiative": 0.20, "stage": 0.15, "kind": 0.10, "signal": 0.10}


def patterns(placed: DataFrame) -> DataFrame:
    """Support and name signals of each (customer, initiative, stage, kind, destination)."""
    by = placed.groupBy(*CONTEXT, "destination")
    return by.agg(F.count("*").alias("support"), F.array_distinct(F.flatten(F.collect_set("signals"))).alias("pattern_signals"), F.min("path").alias("first_path"))


def held_out_patterns(placed: DataFrame, fold: str) -> DataFrame:
    """patterns of all folds but one, for each fold: one aggregate by pattern and fold, of which each fold leaves out its own part."""
    parts = placed.groupBy(*CONTEXT, "destination", fold).agg(F.count("*").alias("support"), F.array_distinct(F.flatten(F.collect_set("signals"))).alias("signals"), F.min("path").alias("first_path"))
    # A pattern has as many parts as there are folds.
    whole = parts.groupBy(*CONTEXT, "destination").agg(F.collect_list(F.struct(fold, "support", "signals", "first_path")).alias("parts"))
    folds = placed.select(fold).distinct()
    each = whole.crossJoin(F.broadcast(folds)).withColumn("parts", F.filter("parts", lambda p: p[fold] != F.col(fold))).where(F.size("parts") > 0)  # a handful of folds
    return each.select(
        *CONTEXT, "destination", fold, F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["support"]).alias("support"),
        F.array_distinct(F.flatten(F.transform("parts", lambda p: p["signals"]))).alias("pattern_signals"), F.array_min(F.transform("parts", lambda p: p["first_path"])).alias("first_path"),
    )


def _is(value: Column) -> Column:
    return F.concat(F.lit("="), value)


def predict(files: DataFrame, learned: DataFrame, *by: str) -> DataFrame:
    """The best destination of each file (path, customer, initiative, stage, kind, signals) and its confidence, within `by`.

    A pattern of another customer, or of another initiative or stage than a known one, never matches; each match adds
    its weight. A pattern is filed under each combination of its own values and of `any`, where one row is left, the best
    supported; a distinct context looks its few combinations up. So neither the patterns of a customer nor those without
    one meet all files. On equal confidence the better supported, then the first path counts."""
    known = lambda c: F.when(F.col(c).isNull(), F.array(F.lit("0"), F.lit("*"))).otherwise(F.array(_is(F.col(c)), F.lit("*")))
    signals = lambda c: F.array_append(F.transform(F.coalesce(c, F.array().cast("array<string>")), _is), F.lit("*"))
    filed = learned.select(*by, "destination", "support", "first_path", F.coalesce(_is(F.col("customer")), F.lit("0")).alias("customer"), known("initiative").alias("initiative"), known("stage").alias("stage"), F.array(F.coalesce(_is(F.col("kind")), F.lit("0")), F.lit("*")).alias("kind"), signals("pattern_signals").alias("signal"))
    for c in ("initiative", "stage", "kind", "signal"):
        filed = filed.withColumn(c, F.explode(c))
    keys = [*by, "customer", "initiative", "stage", "kind", "signal"]
    best = F.max_by(F.struct("destination", "support", "first_path"), F.struct("support", _last_first(F.col("first_path")), _last_first(F.col("destination"))))
    filed = filed.groupBy(*keys).agg(best.alias("best"))

    contexts = files.select(*by, *CONTEXT, "signals").distinct()
    # A known value asks for itself and for patterns without one; an unknown one for any pattern.
    asked = lambda c: F.when(F.col(c).isNull(), F.array(F.lit("*"))).otherwise(F.array(_is(F.col(c)), F.lit("0")))
    ask = contexts.select(*by, *(F.col(c).alias(f"_{c}") for c in CONTEXT), F.col("signals").alias("_signals"), F.when(F.col("customer").isNull(), F.array(F.lit("0"))).otherwise(F.array(_is(F.col("customer")), F.lit("0"))).alias("customer"), asked("initiative").alias("initiative"), asked("stage").alias("stage"), F.when(F.col("kind").isNull(), F.array(F.lit("*"))).otherwise(F.array(_is(F.col("kind")), F.lit("*"))).alias("kind"), signals("signals").alias("signal"))
    for c in ("customer", "initiative", "stage", "kind", "signal"):
        ask = ask.withColumn(c, F.explode(c))
    score = sum((F.when(F.col(c).startswith("="), w).otherwise(0.0) for c, w in WEIGHTS.items()), F.lit(0.0))
    found = ask.withColumn("score", score).where("score > 0").join(filed, keys)
    confidence = F.round(F.least(0.40 + 0.5 * F.col("score") + 0.1 * F.least(F.col("best.support") / 5, F.lit(1.0)), F.lit(0.99)), 4)
    own = [f"_{c}" for c in CONTEXT] + ["_signals"]
    first = F.struct("confidence", "best.support", _last_first(F.col("best.first_path")), _last_first(F.col("best.destination")))
    found = found.withColumn("confidence", confidence).groupBy(*by, *own).agg(F.max_by(F.struct("best.destination", "confidence", "best.support"), first).alias("x"))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"c._{c}")) for c in [*CONTEXT, "signals"]] + [F.col(f"f.{c}") == F.col(f"c.{c}") for c in by]
    on = same[0]
    for s in same[1:]:
        on &= s
    return files.alias("f").join(found.alias("c"), on).select(*(f"f.{c}" for c in by), "f.path", "c.x.*").distinct()


def _last_first(text: Column) -> Column:
    """A value that is larger the earlier a text comes in order of its bytes: each byte's complement, and a last one that no byte has."""
    return F.concat(F.translate(F.hex(F.encode(text, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def simulate(placed: DataFrame, fold: str) -> DataFrame:
    """Each placed file (path, destination, context, signals, fold) predicted from the other folds: predicted, confidence, level and band."""
    placed = written(placed.select("path", "destination", *CONTEXT, "signals", fold), "placed")  # read three times
    found = predict(placed, held_out_patterns(placed, fold), fold).withColumnRenamed("destination", "predicted")
    out = placed.select("path", "destination", fold).join(found, ["path", fold], "left")
    return out.select("path", "destination", "predicted", "confidence", P.match_level(F.col("destination"), F.col("predicted")).alias("match_level"), P.band(F.coalesce("confidence", F.lit(0.0))).alias("band"))


def chosen(learned: DataFrame, votes: DataFrame, suggest: float = 0.75) -> DataFrame:
    """The hybrid choice of predictions by pattern and by neighbours (path, destination, confidence): a pattern that is sure
    enough, else the more confident, the pattern on ties; method tells which."""
    j = learned.select("path", F.struct("destination", "confidence").alias("p")).join(votes.select("path", F.struct("destination", "confidence").alias("v")), "path", "full_outer")
    pattern = F.col("p").isNotNull() & ((F.col("p.confidence") >= suggest) | F.col("v").isNull() | (F.col("v.confidence") <= F.col("p.confidence")))
    one = F.when(pattern, F.col("p")).otherwise(F.col("v"))
    return j.select("path", one["destination"].alias("destination"), one["confidence"].alias("confidence"), F.when(pattern, "deterministic").otherwise("embedding").alias("method"))
