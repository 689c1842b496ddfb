"""Cleans a table of documents in five stages, each a Parquet table that the next one reads.

documents -> language_id -> near_dedup -> decontaminate -> mix -> shard
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atheneum.llm.common import table, written
from atheneum.llm.decontaminate import find_windows, verdict
from atheneum.llm.language_id import UND, identify, train
from atheneum.llm.mixing import mix
from atheneum.llm.sharding import shard
from atheneum.llm.simhash import simhash_groups


#: Near duplicates: five-word shingles; 384 bits find candidates (documents with a similarity of 0.8 differ in 58 on
#: average, seldom in over 80), whose exact similarity decides.
WORDS, LANES, MAX_BITS, SIMILARITY = 5, 6, 80, 0.8
#: Rows to drop are broadcast up to so many (two longs each); more are joined by a shuffle of the documents.
BROADCAST_ROWS = 1_000_000


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named col0, col1, .., names that no operator adds, and the new name of each."""
    new = {c: f"col{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*new.values()), new


def _own(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs out of an operator's result over plain names."""
    return found.select(*(F.col(f"col{k}").alias(c) for k, c in enumerate(docs.columns)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined: a null text or one without a letter. Clean short texts may score low and stay."""
    plain, new = _plain(docs)
    found = identify(plain, train(docs.select("doc_id", "text", "lang")), new["text"])
    return _own(found.where(F.col("lang_pred") != UND), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose shingle sets are similar, the row with the smallest (doc_id, hash of the row) stays.

    Null ids come last; null and blank texts have the empty set in common, and one of them stays. Of rows that repeat wholly one stays. What goes is decided on ids and hashes alone; texts are read
    once more and pass a broadcast of the dropped rows, or a single shuffle where those are many."""
    kinds = dict(docs.dtypes)
    hashed = [F.to_json(F.col(f"`{c}`")) if "map<" in kinds[c] else F.col(f"`{c}`") for c in docs.columns]
    row = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("i"), F.xxhash64(*hashed).alias("h")).alias("_row")
    groups = written(simhash_groups(docs.select(row, "text"), "_row", words=WORDS, lanes=LANES, max_bits=MAX_BITS, similarity=SIMILARITY), "groups")
    dropped = written(groups.where("_row <> component_id").select("_row.*").distinct(), "dropped")
    again = written(groups.where("_row = component_id").groupBy("_row").count().where("count > 1").select("_row.*"), "again")
    rows = docs.select(*(F.col(f"`{c}`").alias(f"col{k}") for k, c in enumerate(docs.columns)), row)

    def among(keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.struct("n", "i", "h").alias("_row"))
        return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, "_row", how)

    kept = among(dropped, "left_anti")
    if not again.isEmpty():
        kept = among(dropped.unionByName(again), "left_anti").unionByName(among(again, "left_semi").dropDuplicates(["_row"]))
    return _own(kept, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which at least a twentieth of the words are benchmark passages; null and empty texts stay."""
    plain, new = _plain(docs)
    found = verdict(find_windows(plain, table(spark, sf_dir, "benchmark"), plain.columns, new["text"]))
    return _own(found.where("not contaminated"), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources come nearer to each other; each document stays at least once, null sources too."""
    plain, new = _plain(docs)
    mixed = mix(plain, new["source"], new["text"])
    times = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return _own(mixed.withColumn("_copy", times), docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stores the documents in target-sized shards; adds shard, tier, shard_rows and manifest_version. A column of docs with such a name has `_in` behind it."""
    return shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing), ("sharding", sharding),
]

#: SQL cannot express a trained network, SimHash or a hashed permutation; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
