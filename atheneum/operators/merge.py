"""Upserts that merge: metadata as JSON objects (variants inside), aliases as sets, confidences as maxima.

Several new rows of one key count in their order. Each key's entries are reduced one by one, with partial results
before the shuffle, so a key of very many rows is never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUES = "map<string,variant>"


def fields(metadata: Column) -> Column:
    """The top-level fields of a JSON object; none of null, of broken JSON, and of what is no object."""
    parsed = F.try_parse_json(metadata)
    return F.coalesce(F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed.cast(VALUES)), F.create_map().cast(VALUES))


def as_json(values: Column) -> Column:
    """A map of variants as a JSON object with its keys in order."""
    return F.to_json(F.call_function("to_variant_object", values))


def merged_metadata(rows: DataFrame, keys: list[str], order: str, metadata: str = "metadata") -> DataFrame:
    """(keys, metadata): of each key all fields, each with the value that the last row (by order) gives it; null counts as a value."""
    entries = rows.select(*keys, F.col(order).alias("_at"), F.explode(F.map_entries(fields(F.col(metadata)))).alias("e")).select(*keys, "_at", F.col("e.key").alias("_k"), F.to_json("e.value").alias("_v"))
    last = entries.groupBy(*keys, "_k").agg(F.max_by("_v", "_at").alias("_v"))
    parts = last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("_m"))
    return parts.select(*keys, as_json(F.transform_values("_m", lambda _, v: F.parse_json(v))).alias(metadata))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str, sets: tuple[str, ...] = (), largest: tuple[str, ...] = (), stamp: Column | None = None) -> DataFrame:
    """old (id, keys, metadata, sets.., largest.., updated_at) after the rows of new (keys, order, metadata, sets.., largest..).

    Metadata is merged field by field, sets are united and sorted, of `largest` the greater value stays (null is 0). A
    new key has the hash of its values as its id; updated_at is set where a new row came. Old rows have unique keys."""
    stamp = F.current_timestamp() if stamp is None else stamp
    zero = F.lit(None).cast(new.schema[order].dataType)
    both = old.select("id", *keys, "updated_at", "metadata", *sets, *largest, zero.alias(order), F.lit(0).alias("_new"))
    more = new.select(F.lit(None).cast(old.schema["id"].dataType).alias("id"), *keys, F.lit(None).cast("timestamp").alias("updated_at"), "metadata", *sets, *largest, order, F.lit(1).alias("_new"))
    both = both.unionByName(more).withColumn("_at", F.struct("_new", order))
    by = both.groupBy(*keys).agg(F.max("id").alias("id"), F.max("_new").alias("_new"), F.max("updated_at").alias("updated_at"), *(F.coalesce(F.max(c), F.lit(0).cast(old.schema[c].dataType)).alias(c) for c in largest))
    by = by.join(merged_metadata(both, keys, "_at"), keys, "left").withColumn("metadata", F.coalesce("metadata", F.lit("{}")))
    for s in sets:
        each = both.select(*keys, F.explode(s).alias("_x")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("_x")).alias(s))
        by = by.join(each, keys, "left").withColumn(s, F.coalesce(s, F.array().cast("array<string>")))
    ident = F.coalesce("id", F.xxhash64(*keys).cast(old.schema["id"].dataType))
    return by.select(ident.alias("id"), *keys, "metadata", *sets, *largest, F.when(F.col("_new") == 1, stamp).otherwise(F.col("updated_at")).alias("updated_at"))


def upserted_entities(old: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """Entities (id, name, type, aliases, metadata, updated_at) after new ones (seq, name, type, aliases, metadata)."""
    return upserted(old, new, ["name", "type"], order, sets=("aliases",))


def upserted_relationships(old: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """Relationships (id, source, kind, target, confidence, metadata, updated_at) after new ones."""
    return upserted(old, new, ["source", "kind", "target"], order, largest=("confidence",))
