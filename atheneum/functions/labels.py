"""Labels of folders, customers, stages and communities; JSON and vectors that models give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from atheneum.functions import paths as P

#: Prefixes of customer folders, as `03_ACME`, and stages without an index.
CODED = r"^[0-9]{2}[_ -]([A-Za-z0-9_-]+)$"
MONTH_FOLDER = r"(?i)^(20[0-9]{2})?[_ -]?(0?[1-9]|1[0-2])[_ -]?(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*$"


def folder_label(name: Column) -> Column:
    """The last part of a path, lower-case, underscores as blanks, blanks squeezed."""
    return F.trim(F.regexp_replace(F.lower(P.name(name)), r"[_\s]+", " "))


def code(value: Column) -> Column:
    return F.translate(F.upper(F.trim(value)), "-", "_")


def label_words(label: Column) -> Column:
    """Lower-case letters and digits, with single blanks for all else."""
    return F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", " "))


def customer_code(name: Column, known: list[str]) -> Column:
    """The code behind a two-digit prefix, or a name that is a known code; else null."""
    plain = code(name)
    return F.when(name.rlike(CODED), code(F.regexp_extract(name, CODED, 1))).when(plain.isin(list(known)), plain)


def loose_customer_code(name: Column) -> Column:
    """Any name as a code: no prefix, anything but letters and digits as one underscore; null if nothing is left."""
    bare = F.regexp_replace(F.trim(name), "^[0-9]{2}[_ -]", "")
    out = F.upper(F.regexp_replace(F.regexp_replace(bare, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(out != "", out)


def partition_name(name: Column) -> Column:
    """Whether a folder is a year or month, as `2026`, `01_Jan`, `202510_Oct`."""
    return name.rlike("^20[0-9]{2}$") | F.trim(name).rlike(MONTH_FOLDER)


def stage_prefix(parts: Column) -> Column:
    """`A.2.5` of a parsed stage name."""
    indices = F.array_join(F.transform(parts["indices"], lambda x: x.cast("string")), ".")
    return F.concat(parts["letter"], F.when(F.size(parts["indices"]) > 0, F.concat(F.lit("."), indices)).otherwise(""))


def stage_name(name: Column, aliases: dict[str, str]) -> Column:
    """The canonical stage of an alias (by folder label), any other stage-shaped name itself, else null."""
    out = F.when(P.stage_parts(name).isNotNull(), name)
    for alias, canonical in aliases.items():
        out = F.when(folder_label(name) == alias, canonical).otherwise(out)
    return out


def community_name(source_type: Column, target_type: Column, relation: Column) -> Column:
    """Both types in order and the relation, in title case: `Person and Tool Works With`."""
    title = lambda c, default: F.initcap(F.trim(F.regexp_replace(F.coalesce(c, F.lit(default)), r"\s+", " ")))
    types = F.array_join(F.array_sort(F.array_distinct(F.array(title(source_type, "topic"), title(target_type, "topic")))), " and ")
    return F.concat_ws(" ", types, title(F.translate(F.coalesce(relation, F.lit("RELATED_TO")), "_", " "), ""))


def initiative_key(path: Column, containers: list[str] = ()) -> Column:
    """The parent folder without trailing parts that are containers, versions or dates."""
    parts = F.split(P.parent(path), "/")
    holds = lambda x: P.version_container(x) | P.temporal(x) | F.coalesce(label_words(x).isin(list(containers)), F.lit(False))
    last = F.aggregate(F.sequence(F.lit(1), F.size(parts)), F.lit(0), lambda acc, k: F.when(holds(F.element_at(parts, k)), acc).otherwise(k))
    return F.array_join(F.slice(parts, F.lit(1), last), "/")


def working_folder(path: Column) -> Column:
    """The parent folder without trailing folders of resources, drafts, materials or versions."""
    parts = F.split(P.parent(path), "/")
    holds = lambda x: F.lower(F.trim(x)).rlike(r"resource|^(drafts?|final|materials)$|^v\d+([ _-].*)?$|^version")
    last = F.aggregate(F.sequence(F.lit(1), F.size(parts)), F.lit(0), lambda acc, k: F.when(holds(F.element_at(parts, k)), acc).otherwise(k))
    return F.array_join(F.slice(parts, F.lit(1), last), "/")


def rounded_vector(vector: Column, digits: int = 7) -> Column:
    """Elements as the text form of a stored vector keeps them."""
    return F.transform(vector, lambda x: F.round(x.cast("double"), digits))


def salvaged_json(answer: Column) -> Column:
    """The JSON object in a model's answer: the whole of it or from the first { to the last }; null if there is none."""
    inner = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    sound = lambda c: F.get_json_object(c, "$").isNotNull() & F.trim(c).startswith("{")
    return F.when(sound(answer), F.trim(answer)).when(sound(inner), inner)


def merged_maps(old: Column, new: Column) -> Column:
    """Both maps in one; the new one's values win."""
    old, new = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (old, new))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def relative(path: Column, base: str) -> Column:
    return F.when(path.startswith(base), F.regexp_replace(F.substring(path, F.lit(len(base) + 1), F.length(path)), "^/+", "")).otherwise(path)
