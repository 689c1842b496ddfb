"""Expressions on file and folder paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds, signals, patterns.
KINDS = {
    "document": [".pdf", ".doc", ".docx", ".rtf"], "note": [".md", ".txt"], "presentation": [".ppt", ".pptx", ".key"],
    "spreadsheet": [".xls", ".xlsx", ".csv"], "image": [".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg"], "video": [".mp4", ".mov"], "diagram": [".drawio", ".vsdx"],
}
CATEGORIES = {
    "document": [".pdf", ".doc", ".docx", ".md", ".txt", ".rtf"], "presentation": [".ppt", ".pptx", ".key"], "spreadsheet": [".xls", ".xlsx", ".csv"],
    "image": [".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg"], "media": [".mp3", ".wav", ".m4a", ".mp4", ".mov", ".avi", ".mkv"],
    "code": [".py", ".js", ".ts", ".tsx", ".jsx", ".json", ".yaml", ".yml", ".sql", ".sh"], "archive": [".zip", ".tar", ".gz", ".7z", ".rar"],
}
SIGNALS = {
    "proposal": ["proposal", "rfp", "rfi", "sow", "quote", "quotation", "pricing"], "poc": ["poc"], "demo": ["demo"], "workshop": ["workshop"],
    "presentation": ["presentation", "deck", "slides"], "meeting": ["agenda", "minutes", "mom"], "notes": ["notes"], "report": ["report", "summary"],
    "architecture": ["architecture", "design", "diagram"], "legal": ["contract", "nda"], "finance": ["invoice"],
}
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec|january|february|march|april|june|july|august|september|october|november|december"
TEMPORAL = [
    "20[0-9]{2}", f"({MONTHS})", f"[0-9]{{1,2}}[._ -]({MONTHS})", f"20[0-9]{{4}}[._ -]({MONTHS})", "20[0-9]{2}[._ -](0[1-9]|1[0-2])",
    "(0[1-9]|1[0-2])", "sprint[ _-]?[0-9]+", "q[1-4]([ _-]?20[0-9]{2})?", "week[ _-]?[0-9]{1,2}", "[0-9]{2}[._ -]?w[0-9]{1,2}",
]
VERSION = [r"version[ _-]?[0-9]+(\.[0-9]+)*", r"v[0-9]+(\.[0-9]+)*"]
FRONT_AFFIXES = [r"page\s*\d+[ _-]?", r"v\d+(\.\d+)?[ _-]?"]
BACK_AFFIXES = [r"[ _-]v\d+(\.\d+)?", r"[ _-]?\(\d+\)", r"[ _-]?_?conflict.*", "[ _-]?copy", "[ _-]?final", "[ _-]?draft"]


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def top_folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.split_part(path, F.lit("/"), F.lit(1))).otherwise(".")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(name(path), r"(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"\.[^.]*$", "")


def file_kind(path: Column) -> Column:
    ext = extension(path)
    return reduce(lambda acc, k: F.when(ext.isin(k[1]), k[0]).otherwise(acc), KINDS.items(), F.lit("other"))


def file_category(path: Column) -> Column:
    ext = extension(path)
    return reduce(lambda acc, k: F.when(ext.isin(k[1]), k[0]).otherwise(acc), CATEGORIES.items(), F.lit("other"))


def name_signals(path: Column) -> Column:
    words = F.split(F.lower(stem(path)), r"[\s_\-.]+")
    of = lambda w: reduce(lambda acc, k: F.when(w.isin(k[1]), k[0]).otherwise(acc), SIGNALS.items(), F.lit(None).cast("string"))
    return F.array_distinct(F.array_compact(F.transform(words, of)))


def asset_name(path: Column) -> Column:
    """The name without extension, separators and one trailing version, date or copy number."""
    value = F.trim(F.regexp_replace(F.lower(stem(path)), r"[\s_\-.]+", " "))
    value = F.trim(F.regexp_replace(value, r"\(?(copy|final|draft|v[0-9]+(\.[0-9]+)*|[0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2})\)?$", ""))
    return F.trim(F.regexp_replace(value, r"\([0-9]+\)$", ""))


def working_stem(path: Column) -> Column:
    """The stem without any number of working affixes at either end, in lower case; what is nothing but affixes keeps its last."""
    edge = "[ _-]+"
    front = F.regexp_replace(stem(path), "(?is)^(?:" + "|".join([*FRONT_AFFIXES, edge]) + ")+(?=.)", "")
    return F.lower(F.trim(F.regexp_replace(front, "(?is)^(.+?)(?:" + "|".join([*BACK_AFFIXES, edge]) + ")+$", "$1")))


def project_context(path: Column) -> Column:
    """struct<customer, project> of a path under a projects folder, after an optional year; null fields elsewhere."""
    parts = F.split(path, "/")
    at = F.when(F.try_element_at(parts, F.lit(2)).rlike("^20[0-9]{2}$"), 3).otherwise(2)
    inside = F.element_at(parts, 1).rlike("(?i)^01[ _].*project")
    customer = F.when(inside & (F.size(parts) > at), F.try_element_at(parts, at))
    initiative = F.when(F.size(parts) > at + 1, F.try_element_at(parts, at + 1))
    return F.struct(customer.alias("customer"), F.when(customer.isNotNull() & initiative.isNotNull(), F.concat(customer, F.lit("/"), initiative)).alias("project"))


def temporal(folder: Column) -> Column:
    return folder.rlike("(?i)^(" + "|".join(TEMPORAL) + ")$")


def under_temporal(path: Column) -> Column:
    """Whether one of the folders above a file is named by a time."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: temporal(F.trim(x)))


def date_stamped(path: Column) -> Column:
    return name(path).rlike(rf"(?i)\d{{1,2}}\s*({MONTHS})\w*\s*\d{{2,4}}")


def version_container(folder: Column) -> Column:
    return folder.rlike("(?i)^(" + "|".join(VERSION) + ")$")


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.95, "auto_place").when(confidence >= 0.75, "suggest").otherwise("needs_review")


def match_level(actual: Column, predicted: Column) -> Column:
    a, p = F.split(actual, "/"), F.split(predicted, "/")
    same = lambda n: (F.size(a) >= n) & (F.size(p) >= n) & (F.slice(a, 1, n) == F.slice(p, 1, n))
    return F.when(predicted.isNull(), "wrong").when(actual == predicted, "exact").when(same(4), "initiative").when(same(3), "customer").otherwise("wrong")


def stage_parts(folder: Column) -> Column:
    """struct<letter, indices, label> of names such as `A.2.5. Contract`."""
    pattern = r"^([A-Z])((?:\.[0-9]+)*)\.?\s+(.+)$"
    digits = F.regexp_extract_all(F.regexp_extract(folder, pattern, 2), F.lit("[0-9]+"), F.lit(0))
    return F.when(folder.rlike(pattern), F.struct(F.regexp_extract(folder, pattern, 1).alias("letter"), F.transform(digits, lambda x: x.cast("int")).alias("indices"), F.regexp_extract(folder, pattern, 3).alias("label")))


def reuse_score(copies: Column, projects: Column, customers: Column, roots: Column) -> Column:
    zero = F.lit(0)
    score = F.least(copies - 1, F.lit(5)) * 6 + F.least(projects, F.lit(4)) * 10 + F.least(customers, F.lit(3)) * 8 + F.least(F.greatest(roots - 1, zero), F.lit(2)) * 3
    return F.least(score, F.lit(100))
