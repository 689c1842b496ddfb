"""Exact deduplication with a two-pass Bloom filter, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atheneum.llm.common import lookup, table, written

BITS_PER_ROW = 16
#: The filter is broadcast up to this size; a larger one is joined by a shuffle of its blocks.
BROADCAST_BYTES = 64 << 20


def _slots(digest: Column, bits: int) -> list[Column]:
    """One slot in either half of the filter, from 1 on."""
    half = bits // 2
    return [F.pmod(digest, F.lit(half)) + 1, F.pmod(F.xxhash64(digest), F.lit(half)) + half + 1]


def _bit(bitmap: Column, slot: Column) -> Column:
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0, F.lit(False))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = BITS_PER_ROW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Pass 1 counts the slots of all text hashes and keeps those hit twice or more as a Bloom filter of
    4 KB blocks. Pass 2 tests each row: rows whose slots were all hit twice may repeat and are grouped
    by SHA-256; the others pass straight through. False positives only cost a shuffle.

    Null text counts as empty. The row with the largest id stays; of several with that id (or only
    null ids) exactly one. An empty table gives no rows; further columns of docs are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.xxhash64(text)
    bits = max(65536, docs.count() * bits_per_row)
    twice = docs.select(F.explode(F.array(*_slots(digest, bits))).alias("slot")).groupBy("slot").count().where("count > 1")
    blocks = twice.groupBy(F.bitmap_bucket_number("slot").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))
    blocks = written(blocks, "bloom")
    side = F.broadcast if bits // 8 <= broadcast_bytes else (lambda df: df)
    rows = docs.select(F.col(id_col).alias("_id"), F.sha2(text, 256).alias("_sha"), digest.alias("_digest"))
    for k, slot in enumerate(_slots(F.col("_digest"), bits)):
        rows = rows.withColumn(f"_block{k}", F.bitmap_bucket_number(slot)).join(side(blocks.toDF(f"_block{k}", f"_bits{k}")), f"_block{k}", "left")
    maybe = [_bit(F.col(f"_bits{k}"), slot) for k, slot in enumerate(_slots(F.col("_digest"), bits))]
    rows = rows.select("_id", "_sha", (maybe[0] & maybe[1]).alias("_maybe"), F.monotonically_increasing_id().alias("_row"))
    rows = written(rows, "tested")

    again = rows.where("_maybe").select("_id", "_sha", "_row")
    groups = again.groupBy("_sha").agg(F.max(F.struct("_id", "_row")).alias("_keep"), F.count("*").alias("_size"))
    groups = written(groups, "groups")
    found = lookup(again, groups, "_sha", "_size", bits // bits_per_row)
    once = rows.where("not _maybe")
    return found.select(
        F.col("_id").alias(id_col), F.col("_keep._id").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("_keep._row") == F.col("_row")).alias("kept"), F.col("_sha").alias("text_sha256"),
    ).unionByName(once.select(
        F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"),
    ))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
