"""Readers of folder trees and the registry of files found."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atheneum.functions.paths import extension, top_folder

DOCUMENTS = [".pdf", ".docx", ".pptx", ".xlsx", ".md", ".txt"]
AUDIO = [".mp3", ".m4a", ".wav"]


def discover(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """Files under root: path (relative), folder, extension, is_audio, size_bytes, modified_at, file_hash."""
    # Other files are not even opened.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _glob(extensions or DOCUMENTS + AUDIO)).load(root)
    start = F.lit(root.rstrip("/").removeprefix("file://") + "/")
    plain = F.regexp_replace("path", "^[a-z]+:/*", "/")
    files = files.select(F.substring(plain, F.instr(plain, start) + F.length(start), F.length(plain)).alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("file_hash"))
    kept = files.where(extension(F.col("path")).isin(extensions or DOCUMENTS + AUDIO) & ~F.col("path").rlike(r"(^|/)\."))
    return kept.select("path", top_folder(F.col("path")).alias("folder"), extension(F.col("path")).alias("extension"), extension(F.col("path")).isin(AUDIO).alias("is_audio"), "size_bytes", "modified_at", "file_hash")


def read_text(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of text files, decoded as UTF-8 with replacement."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _glob([".md", ".txt"])).load(root)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def _glob(extensions: list[str]) -> str:
    """A file pattern of extensions in any case: `*{.[mM][dD],..}`."""
    return "*{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"


def update_registry(registry: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """The registry (path, file_hash, ..) after a discovery, the paths to enqueue (new or changed), and four counters."""
    old = registry.select("path", F.col("file_hash").alias("_old"))
    j = found.join(old, "path", "left").withColumn("_change", F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("file_hash"), "unchanged").otherwise("changed"))
    gone = registry.join(found.select("path"), "path", "left_anti")
    counts = {r._change: r.n for r in j.groupBy("_change").agg(F.count("*").alias("n")).collect()}
    counters = {"new": counts.get("new", 0), "changed": counts.get("changed", 0), "unchanged": counts.get("unchanged", 0), "deleted": gone.count()}
    return j.drop("_old", "_change"), j.where("_change <> 'unchanged'").select("path"), counters


def converted(files: DataFrame, cache: DataFrame, convert, version: str) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """(path, text) of files (path, file_hash, extension, content), and the cache (path, version, file_hash, text) after it.

    Plain text is decoded; any other file is converted (convert maps a DataFrame of files to path, text) unless the cache has its version and hash."""
    plain = files.where(F.col("extension").isin(".md", ".txt")).select("path", F.decode("content", "UTF-8").alias("text"))
    rest = files.where(~F.col("extension").isin(".md", ".txt"))
    keyed = rest.withColumn("version", F.lit(version))
    hits = cache.join(keyed.select("path", "version", "file_hash"), ["path", "version", "file_hash"], "left_semi")
    misses = keyed.join(hits.select("path"), "path", "left_anti")
    made = convert(misses.select("path", "extension", "content")).join(misses.select("path", "version", "file_hash"), "path").select("path", "version", "file_hash", "text")
    kept = cache.join(made.select("path"), "path", "left_anti").select("path", "version", "file_hash", "text")
    return plain.unionByName(hits.select("path", "text")).unionByName(made.select("path", "text")), kept.unionByName(made)


def converter_version(name: str, model: str | None = None, ocr: bool = False) -> str:
    """The version that cached texts are kept under."""
    return "+".join([name, *([model] if model else []), *(["ocr"] if ocr else [])])


def transcript(segments: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, text): a line for each segment that is not blank, `[hh:mm:ss → hh:mm:ss] speaker: text`, in order (start_s, end_s, speaker, text)."""
    clock = lambda c: F.format_string("%02d:%02d:%02d", F.floor(F.col(c) / 3600), F.floor(F.col(c) / 60) % 60, F.floor(F.col(c)) % 60)
    line = F.concat(F.lit("["), clock("start_s"), F.lit(" → "), clock("end_s"), F.lit("] "), "speaker", F.lit(": "), F.trim("text"))
    df = segments.where(F.trim("text") != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_s", "end_s", line.alias("line")))).alias("l"))
    return df.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def expand(text: str, values: dict[str, str]) -> str:
    """`${NAME}` and `${NAME:-default}` of a configuration text, filled from values."""
    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: values.get(m[1]) or m[2] or "", text)
