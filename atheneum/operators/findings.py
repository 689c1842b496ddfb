"""Findings on single folders, made in one scan: each row yields the findings whose rules it meets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atheneum.functions import names as N
from atheneum.functions import paths as P

# Roles that end the checks, generic names, rules of unknown customers.
SETTLED = ["root", "inbox", "temporal", "customer", "stage", "project_artifact", "archive", "code_repo"]
GENERIC = ["misc", "others", "general", "temp", "new folder", "untitled"]
UNKNOWN_RULES = ["customer_code:unknown", "project_template:customer"]
TEMPLATES = "04 Resources/02 Delivery/00 Templates"


def inside_project(path: Column) -> Column:
    """Whether a part of the path is `project`, or starts with 01 and mentions one."""
    return F.exists(F.split(F.lower(path), "/"), lambda x: (x == "project") | (x.startswith("01") & x.contains("project")))


def folder_findings(folders: DataFrame) -> DataFrame:
    """Findings (path, issue_type, severity, confidence, action, destination) of folders with their classification:
    path, file_count, folder_type, stage, confidence, customer_code, customer_name, matched_rule.

    Null fields meet no rule but that of the name; a folder may have several findings, or none."""
    c, name = F.col, P.name(F.col("path"))
    yes = lambda x: F.coalesce(x, F.lit(False))
    role = c("folder_type")
    customer = yes((role == "customer") & c("customer_code").isNotNull() & c("customer_name").isNull() & c("matched_rule").isin(UNKNOWN_RULES))
    settled = customer | yes(role.isin(SETTLED))
    none = F.lit(None).cast("string")
    rules = [
        (customer, "unknown_customer", "low", F.lit(0.74), "enrich_registry", F.lit("customer_registry")),
        (~customer & yes((role == "stage") & (c("stage") != "") & (c("stage") != name)), "naming_inconsistency", "low", F.lit(0.76), "standardize", c("stage")),
        (~settled & F.lower(name).isin(GENERIC), "naming_ambiguity", "low", F.lit(0.8), "review", none),
        (~settled & yes(role == "resource") & inside_project(c("path")), "resource_leakage", "medium", F.least(F.lit(0.9), c("confidence")), "review", F.lit("Resources")),
        (~settled & yes((role == "unknown") & (c("file_count") > 0)), "orphaned_knowledge", "medium", F.lit(0.66), "review", none),
        (name.startswith("<") & name.endswith(">"), "template_drift", "low", F.lit(0.9), "move", F.lit(TEMPLATES)),
        (N.corrected(name).isNotNull(), "naming_inconsistency", "low", F.lit(0.85), "rename", N.corrected(name)),
    ]
    found = [
        F.when(test, F.struct(F.lit(issue).alias("issue_type"), F.lit(severity).alias("severity"), sure.cast("double").alias("confidence"), F.lit(action).alias("action"), to.cast("string").alias("destination")))
        for test, issue, severity, sure, action, to in rules
    ]
    return folders.select("path", F.explode(F.array_compact(F.array(*found))).alias("f")).select("path", "f.*")


def without_rejected(findings: DataFrame, rejected: DataFrame) -> DataFrame:
    """Findings whose (issue_type, path) no reviewer rejected; one of each (path, issue_type, action, destination)."""
    left = findings.join(rejected.select("issue_type", "path").distinct(), ["issue_type", "path"], "left_anti")
    return left.dropDuplicates(["path", "issue_type", "action", "destination"]).select(findings.columns)


def children(folders: DataFrame) -> DataFrame:
    """(parent, children): the sorted paths below each parent folder; top folders have the parent ''."""
    return folders.select(P.parent(F.col("path")).alias("parent"), "path").distinct().groupBy("parent").agg(F.array_sort(F.collect_list("path")).alias("children"))
