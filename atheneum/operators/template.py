"""Stage trees against a template: siblings that collide, stages under a wrong letter, drifted names, shifted indices, missing core stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atheneum.functions import labels
from atheneum.functions import paths as P
from atheneum.storage import written

NODES = "prefix string, label string, canonical string, core boolean, words string, by_prefix boolean, by_label boolean"


def flatten(spark: SparkSession, tree: list[dict]) -> DataFrame:
    """The nodes of a nested template, parents first; by_prefix and by_label mark the first node of each prefix and label."""
    rows, todo, prefixes, words_seen = [], list(reversed(tree)), set(), set()
    while todo:
        node = todo.pop()
        words = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in node["label"].lower()).split())
        rows.append((node["prefix"], node["label"], node["canonical"], bool(node.get("core")), words, node["prefix"] not in prefixes, words not in words_seen))
        prefixes.add(node["prefix"])
        words_seen.add(words)
        todo += reversed(node.get("children", []))
    return spark.createDataFrame(rows, NODES)


def stages(folders: DataFrame) -> DataFrame:
    """Stage-shaped folders (path, parent, name, letter, indices, label, prefix, words, above): above is the letter of the nearest stage over it."""
    path = F.col("path")
    parsed = P.stage_parts(P.name(path))
    over = F.filter(F.transform(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1), P.stage_parts), lambda s: s.isNotNull())
    df = folders.where(parsed.isNotNull()).select("path", P.parent(path).alias("parent"), P.name(path).alias("name"), parsed.alias("s"), F.try_element_at(over, F.lit(-1))["letter"].alias("above"))
    return df.select("path", "parent", "name", "s.*", labels.stage_prefix(F.col("s")).alias("prefix"), labels.label_words(F.col("s.label")).alias("words"), "above")


def _under(df: DataFrame, initiatives: DataFrame) -> DataFrame:
    """Rows at or below the initiatives (path), with the initiative: each path names its ancestors, joined by equality."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return df.withColumn("initiative", F.explode(above)).join(initiatives.select(F.col("path").alias("initiative")).distinct(), "initiative", "left_semi")


def outermost(paths: DataFrame) -> DataFrame:
    """Paths that have no other of them above."""
    own = paths.select("path").distinct()
    inner = _under(own, own).where("initiative <> path").select("path").distinct()
    return own.join(inner, "path", "left_anti")


def _finding(issue: str, severity: str, confidence: float, action: str, to: Column) -> Column:
    return F.struct(F.lit(issue).alias("issue_type"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.lit(action).alias("action"), to.cast("string").alias("destination"))


def drift(folders: DataFrame, initiatives: DataFrame, template: DataFrame) -> DataFrame:
    """Findings (path, issue_type, severity, confidence, action, destination) on stages below initiatives.

    Of siblings with one prefix the one with the template's label keeps it, else the first; the others
    get indices above all that siblings use. A stage whose letter is not that of the stage above it
    belongs elsewhere, and what is below it is not looked at. A template label under another spelling
    is standardised, one under another index of the same letter and depth renumbered, unless its own
    slot is held. Templates are small and broadcast."""
    parts = F.split("path", "/")
    inner = F.slice(parts, F.size(F.split("initiative", "/")) + 1, F.size(parts))
    # Every folder name below an initiative is parsed once, and the rows are stored: the rest looks at them often.
    # Paths in Parquet are small and many fall to one reading task, so they are dealt out before names are parsed.
    found = _under(folders.select("path").repartition("path"), initiatives).where("path <> initiative").select("path", P.parent(F.col("path")).alias("parent"), P.name(F.col("path")).alias("name"), F.transform(inner, P.stage_parts).alias("chain"))
    found = written(found.where(F.element_at("chain", -1).isNotNull()).distinct(), "stages")
    over = F.filter(F.slice("chain", F.lit(1), F.size("chain") - 1), lambda s: s.isNotNull())
    found = found.select("path", "parent", "name", F.element_at("chain", -1).alias("s"), F.transform(over, lambda s: s["letter"]).alias("letters"))
    found = found.select("path", "parent", "name", "s.*", "letters", labels.stage_prefix(F.col("s")).alias("prefix"), labels.label_words(F.col("s.label")).alias("words"))
    # What is below a stage under another letter is not looked at.
    found = found.where(F.size(F.array_distinct("letters")) <= 1)
    nodes = F.broadcast(template.where("by_prefix").select("prefix", F.col("words").alias("slot_words"), F.col("canonical").alias("slot")))
    named = F.broadcast(template.where("by_label").select("words", F.col("prefix").alias("home"), F.col("canonical").alias("home_name")))
    root = F.broadcast(template.where("by_prefix and not contains(prefix, '.')").select(F.col("prefix").alias("letter"), F.col("canonical").alias("letter_name")))
    found = found.join(nodes, "prefix", "left").join(named, "words", "left").join(root, "letter", "left")
    fits = F.coalesce(F.col("words") == F.col("slot_words"), F.lit(False))
    siblings = W.partitionBy("parent")
    twins = W.partitionBy("parent", "prefix")
    found = found.withColumns({
        "fits": fits, "n": F.count("*").over(twins), "nth": F.row_number().over(twins.orderBy(F.desc(fits.cast("int")), "path")),
        "used": F.coalesce(F.max(F.try_element_at("indices", F.lit(-1))).over(siblings), F.lit(0)),
        "held": F.collect_set(F.when(fits, F.col("prefix"))).over(siblings),
    })
    collides = (F.col("n") > 1) & (F.col("nth") > 1)
    astray = F.coalesce(F.try_element_at("letters", F.lit(1)) != F.col("letter"), F.lit(False))
    order = F.sum(collides.cast("int")).over(siblings.orderBy("prefix", "nth").rowsBetween(W.unboundedPreceding, 0))
    found = found.withColumns({"next": F.col("used") + order, "collides": collides, "astray": astray})
    renumbered = F.concat(F.col("letter"), F.lit("."), F.array_join(F.concat(F.transform(F.slice("indices", F.lit(1), F.greatest(F.size("indices") - 1, F.lit(0))), lambda x: x.cast("string")), F.array(F.col("next").cast("string"))), "."), F.lit(". "), F.col("label"))
    spelled = F.col("fits") & (F.col("name") != F.col("slot"))
    shifted = F.col("home").isNotNull() & ~F.col("collides") & (F.col("prefix") != F.col("home")) & (F.col("letter") == F.substring("home", 1, 1))
    shifted &= (F.size("indices") == F.size(F.split("home", r"\.")) - 1) & ~F.array_contains("held", F.col("home"))
    told = F.array_compact(F.array(
        F.when(F.col("collides"), _finding("template_drift", "medium", 0.9, "renumber", F.concat_ws("/", "parent", renumbered))),
        F.when(F.col("astray"), _finding("template_drift", "medium", 0.88, "move", F.concat(F.lit("under '"), F.col("letter_name"), F.lit("'"))))
        .when(spelled, _finding("naming_inconsistency", "low", 0.85, "standardize", F.col("slot")))
        .when(shifted, _finding("template_drift", "low", 0.8, "renumber", F.col("home_name"))),
    ))
    return found.select("path", F.explode(told).alias("x")).select("path", "x.*")


def missing_core(folders: DataFrame, initiatives: DataFrame, template: DataFrame) -> DataFrame:
    """Core stages that are absent, by prefix and by label, below an initiative (path) and below its stages without an index."""
    found = written(stages(folders.select("path").repartition("path")), "parsed")
    direct = found.select(F.col("parent").alias("initiative"), "prefix", "words")
    wrapped = found.join(found.where(F.size("indices") == 0).select(F.col("path").alias("parent"), F.col("parent").alias("initiative")), "parent").select("initiative", "prefix", "words")
    have = direct.unionByName(wrapped).join(initiatives.select(F.col("path").alias("initiative")), "initiative", "left_semi")
    core = template.where("core").select("prefix", "words", "canonical")
    # Each initiative meets the template's few core stages.
    listed = F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in ("prefix", "words", "canonical"))) for r in core.collect()))
    wanted = initiatives.select(F.col("path").alias("initiative"), F.explode(listed).alias("x")).select("initiative", "x.*")
    left = wanted.join(have.select("initiative", "prefix"), ["initiative", "prefix"], "left_anti").join(have.select("initiative", "words"), ["initiative", "words"], "left_anti")
    return left.select(F.col("initiative").alias("path"), _finding("project_completeness", "medium", 0.85, "review", F.concat_ws("/", "initiative", "canonical")).alias("x")).select("path", "x.*")


def validated(folders: DataFrame, classified: DataFrame, archetypes: DataFrame, lifecycles: DataFrame, template: DataFrame, with_stages: list[str]) -> DataFrame:
    """All template findings of a tree: folders (path), classified (path, folder_type), archetypes (path, archetype), lifecycles (path, lifecycle).

    Initiatives are folders classified so, and customers with a stage right below; of nested ones the outermost counts.
    Drift is looked for wherever there are stages; core stages are asked of archetypes with a stage tree (with_stages)
    that are in presales, delivery or otherwise active."""
    direct = folders.where(P.stage_parts(P.name(F.col("path"))).isNotNull()).select(P.parent(F.col("path")).alias("path")).distinct()
    own = classified.where("folder_type = 'initiative'").select("path").union(classified.where("folder_type = 'customer'").join(direct, "path", "left_semi").select("path"))
    initiatives = written(outermost(own).join(archetypes, "path", "left").join(lifecycles, "path", "left"), "initiatives")
    active = initiatives.where(F.col("archetype").isin(with_stages) & F.col("lifecycle").isin("active_presales", "delivery", "active"))
    return drift(folders, initiatives.select("path"), template).unionByName(missing_core(folders, active.select("path"), template))
