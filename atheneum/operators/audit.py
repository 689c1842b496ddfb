"""Folder audit: assets, duplicates, findings, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atheneum.functions import paths as P

# Fixed values.
PENALTY = {"high": 30, "medium": 18, "low": 8}
DIMENSIONS = {
    "naming": ["unclear_name", "naming_ambiguity", "naming_inconsistency"], "duplicate": ["duplicate_topic", "knowledge_duplication", "semantic_duplication"],
    "placement": ["resource_inside_project", "project_inside_resource", "resource_leakage", "reusable_asset"],
    "structure": ["too_deep", "missing_expected_structure", "orphan_folder", "template_drift", "project_completeness", "orphaned_knowledge", "mixed_purpose_folder"],
    "registry": ["unknown_customer", "unknown_initiative", "missing_initiative_metadata"],
}
#: Parts that the files of one asset are dealt to.
SPREAD = 64


def inventory(files: DataFrame) -> DataFrame:
    """Per folder of files (path, size_bytes): counts, bytes, extensions, 12 sample names, the largest file, a signature.

    No folder's names are gathered: the samples are cut by rank, and the signature is a digest of sums of
    two hashes of the names and sizes, which does not depend on their order."""
    df = files.withColumn("folder", P.parent(F.col("path"))).withColumn("name", P.name(F.col("path"))).withColumn("ext", P.extension(F.col("path")))
    exts = df.groupBy("folder", "ext").agg(F.count("*").alias("n")).groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("ext", "n"))).alias("exts"))
    part = lambda seed: F.sum(F.pmod(F.xxhash64(F.lit(seed), "name", "size_bytes"), F.lit(1 << 31)))
    names = df.groupBy("folder").agg(
        F.count("*").alias("file_count"), F.sum("size_bytes").alias("total_bytes"), F.max_by("name", F.struct("size_bytes", "name")).alias("largest"),
        F.sha2(F.concat_ws(":", F.count("*"), part(1), part(2), F.sum("size_bytes")), 256).alias("signature"),
    )
    first = df.select("folder", "name", F.row_number().over(W.partitionBy("folder").orderBy("name")).alias("_k")).where("_k <= 12")
    first = first.groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("samples"))
    shown = F.array_join(F.transform("exts", lambda x: F.concat_ws("=", x["ext"], x["n"])), ",")
    return names.join(exts, "folder").join(first, "folder").select("folder", "file_count", "total_bytes", "largest", "samples", "signature", shown.alias("extensions"))


def _counted(df: DataFrame, what: str) -> DataFrame:
    """(folder, what): how many files of each value a folder has, as a map."""
    by = df.groupBy("folder", what).agg(F.count("*").alias("n")).groupBy("folder")
    return by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(what, "n")))).alias(what))


def snapshots(files: DataFrame, samples: int = 12) -> DataFrame:
    """Every folder above files (path, size_bytes, modified_at): path, parent, depth, counts of files and of folders below it,
    bytes, latest change, sample names, maps of extensions and categories, largest file, has_ flags and a signature.

    Folders without files of their own count none. The signature follows from names, sizes and times of the files and
    from the names of the folders below, in any order. Only the first names of a folder are gathered."""
    path = F.col("path")
    df = files.select(path, F.when(P.parent(path) == "", ".").otherwise(P.parent(path)).alias("folder"), P.name(path).alias("name"), F.when(P.extension(path) == "", "[no_extension]").otherwise(P.extension(path)).alias("extensions"), P.file_category(path).alias("categories"), "size_bytes", "modified_at")
    # 48 bits of each entry's digest are added up: entries come in any order.
    mark = lambda *c: F.sum(F.conv(F.substring(F.md5(F.concat_ws(":", *c)), 1, 12), 16, 10).cast("decimal(20,0)"))
    own = df.groupBy("folder").agg(
        F.count("*").alias("file_count"), F.sum("size_bytes").alias("total_bytes"), F.max("modified_at").alias("latest_modified"),
        F.min_by(F.struct("path", "size_bytes", F.col("categories").alias("category")), F.struct(-F.col("size_bytes"), "name")).alias("largest"),
        mark(F.lit("f"), F.col("name"), F.col("size_bytes").cast("string"), F.date_format("modified_at", "yyyy-MM-dd HH:mm:ss")).alias("_files"),
    )
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    folders = df.select("folder").distinct().where("folder <> '.'").select(F.explode(above).alias("folder")).distinct()
    kids = folders.select(F.when(F.col("folder").contains("/"), P.parent(F.col("folder"))).otherwise(".").alias("folder"), P.name(F.col("folder")).alias("name"))
    kids = kids.groupBy("folder").agg(F.count("*").alias("child_count"), mark(F.lit("d"), F.col("name")).alias("_folders"))
    first = df.select("folder", "name", F.row_number().over(W.partitionBy("folder").orderBy("name")).alias("_k")).where(F.col("_k") <= samples)
    first = first.groupBy("folder").agg(F.array_sort(F.collect_list("name")).alias("samples"))
    out = folders.union(folders.sparkSession.createDataFrame([(".",)], "folder string"))
    for more in (own, kids, first, _counted(df, "extensions"), _counted(df, "categories")):
        out = out.join(more, "folder", "left")
    zero, none = F.lit(0).cast("long"), F.lit(0).cast("decimal(30,0)")
    out = out.withColumns({c: F.coalesce(c, zero) for c in ("file_count", "total_bytes", "child_count")} | {"samples": F.coalesce("samples", F.array().cast("array<string>"))})
    out = out.withColumns({c: F.coalesce(c, F.create_map().cast("map<string,bigint>")) for c in ("extensions", "categories")})
    signature = F.sha2(F.concat_ws(":", "folder", "file_count", "child_count", "total_bytes", F.coalesce("_files", none).cast("string"), F.coalesce("_folders", none).cast("string")), 256)
    has = {f"has_{c}s": F.map_contains_key("categories", c) for c in ("document", "presentation")} | {f"has_{c}": F.map_contains_key("categories", c) for c in ("media", "code")}
    parent = F.when(F.col("folder") == ".", None).when(F.col("folder").contains("/"), P.parent(F.col("folder"))).otherwise(".")
    return out.select(
        F.col("folder").alias("path"), parent.alias("parent"), F.when(F.col("folder") == ".", 0).otherwise(F.size(parts)).alias("depth"), "file_count", "child_count", "total_bytes", "latest_modified", "samples", "extensions", "categories", "largest",
        *(c.alias(k) for k, c in has.items()), signature.alias("signature"),
    )


def assets(files: DataFrame) -> DataFrame:
    """Assets from files (root, path, size_bytes, content_hash): by hash, else by extension and normalised name."""
    path, context = F.col("path"), P.project_context(F.col("path"))
    key = F.coalesce(F.concat(F.lit("hash:"), F.col("content_hash")), F.concat(F.lit("name:"), P.extension(path), F.lit(":"), P.asset_name(path)))
    df = files.select(key.alias("asset_key"), "root", "path", context["customer"].alias("customer"), context["project"].alias("project"), F.size(F.split(path, "/")).alias("depth"))
    # Paths in Parquet are small and many fall to one reading task, so they are dealt out before they are sorted by keys; and
    # distinct counts, which multiply their rows, are taken of the few rows of a key's customers, projects and roots.
    spread = df.repartition("asset_key", F.pmod(F.xxhash64("path"), F.lit(SPREAD)))
    few = spread.groupBy("asset_key", "customer", "project", "root").agg(F.count("*").alias("n"), F.min(F.struct("depth", "path")).alias("first"))
    out = few.groupBy("asset_key").agg(
        F.sum("n").alias("copy_count"), F.countDistinct("customer").alias("customer_count"), F.countDistinct("project").alias("project_count"), F.countDistinct("root").alias("root_count"),
        F.min("first")["path"].alias("canonical"),
    )
    return out.withColumn("reuse_score", P.reuse_score(F.col("copy_count"), F.col("project_count"), F.col("customer_count"), F.col("root_count")))


def duplicate_groups(df: DataFrame, content: Column, size: Column, key: str) -> DataFrame:
    """Groups of equal content, of a size over 0. Contents are hashed where they are read; keys, sizes and hashes are all that is shuffled."""
    hashed = df.where(size > 0).select(key, F.sha2(content, 256).alias("content_hash"))
    groups = hashed.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min(key).alias("first"), F.array_join(F.array_sort(F.collect_list(key)), ",").alias("members"))
    return groups.where("copies > 1")


def scores(folders: DataFrame, findings: DataFrame) -> DataFrame:
    """Five dimensions from 100 down by findings (folder, issue_type, severity, confidence), and their rounded mean."""
    severity = F.lit(8)
    for name, value in PENALTY.items():
        severity = F.when(F.col("severity") == name, value).otherwise(severity)
    df = findings.withColumn("p", F.floor(severity * F.col("confidence")).cast("int"))
    half, issue = F.floor(F.col("p") / 2).cast("int"), F.col("issue_type")
    is_in = lambda d: issue.isin(DIMENSIONS[d])
    known = F.lit(False)
    for d in DIMENSIONS:
        known |= is_in(d)
    known |= issue == "architecture_review"
    lost = {
        "naming": F.when(is_in("naming"), F.col("p")).when(issue == "mixed_purpose_folder", F.greatest(F.lit(4), half)),
        "duplicate": F.when(is_in("duplicate"), F.col("p")),
        "placement": F.when(is_in("placement"), F.col("p")),
        "structure": F.when(is_in("structure"), F.col("p")).when(issue == "architecture_review", F.greatest(F.lit(3), half)),
        "compliance": F.when(is_in("placement"), F.greatest(F.lit(4), half)).when(is_in("registry"), F.greatest(F.lit(3), half)).when(~known, F.col("p")),
    }
    summed = df.groupBy("folder").agg(*(F.sum(c).alias(d) for d, c in lost.items()), F.count("*").alias("n_findings"))
    clamp = lambda d: F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.coalesce(d, F.lit(0)))).cast("long").alias(d)
    out = folders.select("folder").join(summed, "folder", "left").select("folder", *(clamp(d) for d in lost), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))
    return out.withColumn("total", F.bround(sum((F.col(d) for d in lost), F.lit(0)) / 5, 0).cast("long"))
