"""Folders by rules: one ordered expression gives each folder its type, and roles and archetypes follow from it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atheneum.functions import filters, labels
from atheneum.functions import paths as P

# The role of each folder type.
ROLES = {
    "root": "root", "inbox": "container", "temporal": "temporal", "customer": "customer", "initiative": "initiative", "stage": "stage",
    "project_artifact": "stage", "project": "project", "resource": "resource_library", "product": "resource_library",
    "administration": "administrative", "operations": "administrative", "template": "container", "knowledge_asset": "resource_library",
    "archive": "container", "code_repo": "container",
}
STRUCTURAL = ["root", "customer", "initiative", "stage", "project_artifact", "code_repo"]
ARCHIVES = ["archive", "archives", "old"]


@dataclass
class Rules:
    """What an organisation states about its folders; small, and kept by the driver."""

    top_level: dict[str, dict] = field(default_factory=dict)  # name -> type, category
    inboxes: list[str] = field(default_factory=list)  # paths or globs
    customers: dict[str, str] = field(default_factory=dict)  # code -> name
    projects: dict[str, dict] = field(default_factory=dict)  # path -> project_id, customer_code, initiative_type, lifecycle
    stages: dict[str, str] = field(default_factory=dict)  # folder label -> canonical name
    containers: list[str] = field(default_factory=list)  # folder labels
    archetypes: dict[str, list[str]] = field(default_factory=dict)  # type -> words of its names, in order
    sales: str = "sales_opportunity"
    training: str = "training_engagement"
    project_root: str = "01 Project"


def _of(values: dict[str, str | None], key: Column) -> Column:
    given = [F.lit(x) for k, v in values.items() if v is not None for x in (k, v)]
    return F.try_element_at(F.create_map(*given), key) if given else F.lit(None).cast("string")


def classify(folders: DataFrame, rules: Rules) -> DataFrame:
    """folders (path, is_code_repo) with folder_type, stage, customer_code, customer_name, matched_rule and confidence.

    The first rule that a folder meets decides; one that meets none has nulls. No shuffle: one expression a row."""
    path, name = F.col("path"), P.name(F.col("path"))
    parts = F.split(path, "/")
    first, depth = F.element_at(parts, 1), F.size(parts)
    strict, loose = labels.customer_code(name, list(rules.customers)), labels.loose_customer_code(name)
    known = lambda c: _of(rules.customers, c)
    stage = labels.stage_name(name, rules.stages)
    in_year = (first == rules.project_root) & labels.partition_name(F.try_element_at(parts, F.lit(2)))
    category = _of({k: v.get("category") for k, v in rules.top_level.items()}, first)
    none = F.lit(None).cast("string")

    def found(kind: Column | str, rule: Column | str, confidence: Column | float, stage_: Column = none, customer: Column = none, full: Column = none) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(lit(kind).alias("folder_type"), stage_.alias("stage"), customer.alias("customer_code"), full.alias("customer_name"), lit(rule).alias("matched_rule"), lit(confidence).cast("double").alias("confidence"))

    project = _of({k: v.get("project_id") for k, v in rules.projects.items()}, path)
    owner = _of({k: v.get("customer_code") for k, v in rules.projects.items()}, path)
    chain = [
        (path == ".", found("root", "workspace_root", 1.0)),
        (F.col("is_code_repo"), found("code_repo", "code_repo:markers", 1.0)),
        (filters.any_of(*((path == g) | path.rlike(filters.glob_pattern(g)) for g in rules.inboxes)), found("inbox", F.concat(F.lit("allowed_empty:"), path), 1.0)),
        (path.isin(list(rules.top_level)), found(_of({k: v.get("type", "root") for k, v in rules.top_level.items()}, path), F.concat(F.lit("top_level:"), name), 1.0)),
        (project.isNotNull(), found("initiative", F.concat(F.lit("project_registry:"), project), 1.0, none, owner, known(owner))),
        (labels.partition_name(name), found("temporal", "temporal:year", 1.0)),
        (F.lower(name).isin(ARCHIVES), found("archive", "archive:name", 0.95)),
        (stage.isNotNull(), found("stage", F.concat(F.lit("stage:"), stage), 0.98, stage)),
        (known(strict).isNotNull(), found("customer", F.concat(F.lit("known_customer:"), strict), 0.98, none, strict, known(strict))),
        (strict.isNotNull() & (depth >= 3) & (first == rules.project_root), found("customer", "customer_code:unknown", 0.7, none, strict)),
        ((depth == 3) & in_year, found("customer", "project_template:customer", F.when(known(loose).isNotNull(), 0.82).otherwise(0.72), none, loose, known(loose))),
        ((depth == 4) & in_year & labels.customer_code(F.try_element_at(parts, F.lit(3)), list(rules.customers)).isNotNull(), found("initiative", "project_template:initiative", 0.85)),
        (labels.folder_label(name).isin(list(rules.containers)), found("knowledge_asset", F.concat(F.lit("container:"), labels.folder_label(name)), 0.6)),
        (category.isNotNull() & (depth >= 2), found(category, F.concat(F.lit("category:"), first), 0.6)),
    ]
    out = F.when(F.coalesce(chain[0][0], F.lit(False)), chain[0][1])
    for test, result in chain[1:]:
        out = out.when(F.coalesce(test, F.lit(False)), result)
    return folders.withColumn("_found", out).select(*folders.columns, "_found.*")


def fallback(classified: DataFrame, model=None) -> DataFrame:  # noqa: ANN001
    """Folders that no rule decided get the model's type (a function of DataFrames with path to path, folder_type, confidence), or `unknown` at 0.2."""
    if model is not None:
        given = model(classified.where("folder_type is null").select("path")).select("path", F.col("folder_type").alias("_t"), F.col("confidence").alias("_c"))
        classified = classified.join(given, "path", "left").withColumns({
            "confidence": F.coalesce("confidence", F.when(F.col("_t").isNotNull(), F.col("_c"))), "matched_rule": F.coalesce("matched_rule", F.when(F.col("_t").isNotNull(), "model")),
            "folder_type": F.coalesce("folder_type", "_t"),
        }).drop("_t", "_c")
    unknown = F.col("folder_type").isNull()
    return classified.withColumns({"confidence": F.when(unknown, 0.2).otherwise(F.col("confidence")), "folder_type": F.coalesce("folder_type", F.lit("unknown"))})


def unclassified(folders: DataFrame, done: DataFrame, full: bool = False) -> DataFrame:
    """Active folders (path, content_signature, status) that were not classified with their present signature; with full, all active ones."""
    active = folders.where("status = 'active'")
    return active if full else active.join(done.select("path", "content_signature").distinct(), ["path", "content_signature"], "left_anti")


def role(folder_type: Column, name: Column, containers: list[str]) -> Column:
    """The role of a folder: its structural type, else what its name says, else its type, else a library."""
    bare = F.regexp_replace(F.trim(name), "^[0-9]{1,3}[._ -]+", "")
    container = P.version_container(F.trim(name)) | labels.label_words(bare).isin([c.lower() for c in containers])
    by_type = _of(ROLES, folder_type)
    return F.when(folder_type.isin(STRUCTURAL), by_type).when(P.temporal(F.trim(name)), "temporal").when(container, "container").otherwise(F.coalesce(by_type, F.lit("resource_library")))


def with_stages_below(folders: DataFrame) -> DataFrame:
    """(path) of folders with a stage-shaped folder anywhere below: each stage names its ancestors, one row each."""
    stages = folders.where(P.stage_parts(P.name(F.col("path"))).isNotNull())
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return stages.where(F.size(parts) > 1).select(F.explode(above).alias("path")).distinct()


def archetypes(initiatives: DataFrame, folders: DataFrame, rules: Rules) -> DataFrame:
    """initiatives (path, initiative_type) with archetype: registered, classified, by words of the name, by stages among the children, else the default."""
    stage_child = folders.select(P.parent(F.col("path")).alias("path"), P.stage_parts(P.name(F.col("path"))).isNotNull().alias("_stage"))
    stage_child = stage_child.groupBy("path").agg(F.max("_stage").alias("_stage"))
    name, staged = F.lower(P.name(F.col("path"))), F.coalesce("_stage", F.lit(False))
    by_name = F.lit(None).cast("string")
    for kind, words in reversed(list(rules.archetypes.items())):
        if kind != rules.sales:
            meant = F.when(staged, rules.sales).otherwise(kind) if kind == rules.training else F.lit(kind)
            by_name = F.when(filters.any_of(*(name.contains(w) for w in words)), meant).otherwise(by_name)
    registered = _of({k: v.get("initiative_type") for k, v in rules.projects.items()}, F.col("path"))
    out = initiatives.join(stage_child, "path", "left")
    return out.withColumn("archetype", F.coalesce(registered, "initiative_type", by_name, F.lit(rules.sales))).drop("_stage")


def lifecycles(initiatives: DataFrame, folders: DataFrame, rules: Rules) -> DataFrame:
    """initiatives (path) with lifecycle: registered, else active_presales if a stage with an index is reached through stages only, else lead."""
    parts = F.split("path", "/")
    stage = lambda k: P.stage_parts(F.element_at(parts, k))
    deep = folders.where(F.size(stage(-1)["indices"]) > 0)
    # From the folder up, the unbroken run of stages; its parents may be the initiative.
    run = F.aggregate(F.sequence(F.lit(1), F.size(parts)), F.lit(0), lambda acc, k: F.when(stage(k).isNotNull(), acc + 1).otherwise(0))
    above = F.transform(F.sequence(F.lit(1), run), lambda k: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/"))
    reached = deep.where(run > 0).select(F.explode(above).alias("path")).distinct().withColumn("_on", F.lit(True))
    registered = _of({k: v.get("lifecycle") for k, v in rules.projects.items()}, F.col("path"))
    return initiatives.join(reached, "path", "left").withColumn("lifecycle", F.coalesce(registered, F.when(F.col("_on"), "active_presales"), F.lit("lead"))).drop("_on")
