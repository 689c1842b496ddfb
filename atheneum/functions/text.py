"""Expressions on text: headings, chunk types, summaries, headers, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
BULLET = r"^\s*([-*+]|[0-9]+[.)])\s+"
ENTITY_TYPES = ["person", "team", "company", "project", "technology", "product", "meeting", "concept", "process", "role", "topic", "document", "organization"]
RELATION_TYPES = ["OWNS", "USES", "DEPENDS_ON", "MANAGES", "ATTENDED", "MENTIONED_IN", "RELATED_TO", "DISCUSSED_IN", "REFERENCES"]
HEADER_FIELDS = [
    ("File", "file_name"), ("Client", "client"), ("Product", "product"), ("Doc type", "doc_type"), ("Version", "version"), ("Doc IDs", "doc_ids"),
    ("Folder", "folder"), ("Speaker", "speaker"), ("Document", "document_title"), ("Section", "section_path"), ("Chunk type", "chunk_type"),
]


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(F.trim(line), HEADING, 1))


def heading_title(line: Column) -> Column:
    return F.regexp_extract(F.trim(line), HEADING, 2)


def chunk_type(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    least = F.greatest(F.lit(2), F.floor(F.size(lines) / 2))
    pipes = F.size(F.filter(lines, lambda x: x.contains("|")))
    bullets = F.size(F.filter(lines, lambda x: x.rlike(BULLET)))
    return F.when(pipes >= least, "table").when(bullets >= least, "list").otherwise("paragraph")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def summary(title: Column | None, text: Column) -> Column:
    """The first three sentences over 30 characters, else the first 700 characters; at most 1200."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    long = F.slice(F.filter(F.split(flat, r"(?<=[.!?])\s+"), lambda s: F.length(s) > 30), 1, 3)
    body = F.when(F.size(long) > 0, F.array_join(long, " ")).otherwise(F.substring(flat, 1, 700))
    return F.substring(body if title is None else F.concat(title, F.lit(": "), body), 1, 1200)


def context_header(fields: dict[str, Column]) -> Column:
    """Labelled lines in a fixed order; empty fields are left out."""
    return F.concat_ws("\n", *(F.when(F.coalesce(F.trim(fields[name]), F.lit("")) != "", F.concat(F.lit(f"{label}: "), fields[name])) for label, name in HEADER_FIELDS if name in fields))


def clean_name(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(" \t\n\r.,;:!?\"'()[]{}"))


def entity_key(name: Column) -> Column:
    return F.lower(clean_name(name))


def entity_type(name: Column) -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(slug.isin(ENTITY_TYPES), slug).otherwise("concept")


def relation_type(name: Column) -> Column:
    slug = F.btrim(F.regexp_replace(F.upper(name), "[^A-Z0-9]+", "_"), F.lit("_"))
    return F.when(slug.isin(RELATION_TYPES), slug).otherwise("RELATED_TO")


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
