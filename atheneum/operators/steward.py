"""Findings across folders, registry gaps, reports, and where a file belongs by its neighbours."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atheneum.functions import filters, labels
from atheneum.functions import names as N
from atheneum.functions import paths as P
from atheneum.functions.vectors import mean_vectors
from atheneum.operators import classify as C
from atheneum.operators import graph, ledger, vector_index
from atheneum.storage import written

# What each role may not be told, the sections of a report, extensions and folders of code.
SUPPRESSED = {role: ["duplicate_topic", "knowledge_duplication", "architecture_review", "naming_ambiguity", "orphaned_knowledge", "missing_initiative_metadata"] for role in ("root", "container", "temporal")}
SECTIONS = {
    "Template": ["template_drift", "project_completeness"], "Naming": ["naming_ambiguity", "naming_inconsistency", "unclear_name"], "Registry": ["unknown_customer", "missing_initiative_metadata", "unknown_initiative"],
    "Duplicates": ["semantic_duplication", "knowledge_duplication", "duplicate_topic"], "Placement": ["resource_leakage", "reusable_asset"], "Structure": ["architecture_review", "orphaned_knowledge"],
}
CODE = [".py", ".js", ".ts", ".java", ".go", ".rs", ".c", ".cpp", ".h", ".ipynb", ".sh", ".sql"]
MARKERS = [".git", "package.json", "pyproject.toml", "requirements.txt", "setup.py", "Cargo.toml", "go.mod", "pom.xml", "Makefile", "Dockerfile"]
CODE_DIRS = ["src", "lib", "tests", "test", "scripts", "notebooks"]


def topics_across_roots(folders: DataFrame, containers: list[str]) -> DataFrame:
    """(topic, roots, folders, first, members) of names under two roots or more.

    Folders (path, folder_type) with the role of a container, a partition or the root name no topic, nor
    do folders within another of their topic. At most 20 members are listed."""
    name = P.name(F.col("path"))
    df = folders.where(~C.role(F.col("folder_type"), name, containers).isin("root", "container", "temporal"))
    df = df.select("path", labels.label_words(N.without_number(name)).alias("topic"), P.top_folder(F.col("path")).alias("root")).where("topic <> ''")
    parts = F.split("path", "/")
    over = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: labels.label_words(N.without_number(x)))
    df = df.where(~F.array_contains(over, F.col("topic")))
    some = df.withColumn("_k", F.row_number().over(W.partitionBy("topic", "root").orderBy("path")))
    listed = some.where("_k <= 20").groupBy("topic").agg(F.slice(F.array_sort(F.collect_list("path")), 1, 20).alias("members"))
    out = df.groupBy("topic").agg(F.countDistinct("root").alias("roots"), F.count("*").alias("folders"), F.min("path").alias("first")).where("roots >= 2")
    return out.join(listed, "topic")


def missing_metadata(initiatives: DataFrame, registered: list[str]) -> DataFrame:
    """Initiatives (path, initiative_type, file_count) that hold files but are neither registered nor typed."""
    return initiatives.where((F.col("file_count") > 0) & F.col("initiative_type").isNull() & ~F.col("path").isin(list(registered)))


def reusable(assets: DataFrame, resources: str = "04 Resources", customers: int = 2, copies: int = 3, limit: int = 15) -> DataFrame:
    """The assets that several customers use and that are not among the resources, the best first."""
    df = assets.where((F.col("customer_count") >= customers) & (F.col("copy_count") >= copies) & ~F.col("canonical").startswith(resources))
    return df.orderBy(F.desc("reuse_score"), F.desc("copy_count"), "asset_key").limit(limit)


def meant_apart(a: Column, b: Column) -> Column:
    """Whether two like files are meant to be two: a working set (one stem begins the other, in one folder but for
    drafts and versions) or entries of a time series (both in folders named by times, other names, one with a date)."""
    one, two = P.working_stem(a), P.working_stem(b)
    working = (one != "") & (two != "") & (one.startswith(two) | two.startswith(one)) & (labels.working_folder(a) == labels.working_folder(b))
    series = P.under_temporal(a) & P.under_temporal(b) & (P.name(a) != P.name(b)) & (P.date_stamped(a) | P.date_stamped(b))
    return working | series


def _looks(path: Column) -> dict[str, Column]:
    """What meant_apart looks at of a file."""
    return {"_stem": P.working_stem(path), "_folder": labels.working_folder(path), "_name": P.name(path), "_timed": P.under_temporal(path), "_dated": P.date_stamped(path)}


def _meant_apart(rows: pa.Table) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """meant_apart of rows of looks by their places, for files of one `_within` only."""
    folder, name, within = (rows[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("_folder", "_name", "_within"))
    timed, dated = (rows[c].to_numpy() for c in ("_timed", "_dated"))
    texts = [t.encode() for t in rows["_stem"].to_pylist()]
    stems = sorted(set(texts))
    at = {t: k for k, t in enumerate(stems)}
    first = np.array([at[t] for t in texts])
    # In order, the stems that begin with one follow it; no UTF-8 text has the byte FF.
    past = np.array([bisect_left(stems, t + b"\xff") for t in stems])[first]
    named = np.array([t != b"" for t in texts])

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        begins = ((first[a] <= first[b]) & (first[b] < past[a])) | ((first[b] <= first[a]) & (first[a] < past[b]))
        series = timed[a] & timed[b] & (name[a] != name[b]) & (dated[a] | dated[b])
        return (within[a] == within[b]) & (series | named[a] & named[b] & begins & (folder[a] == folder[b]))

    return apart


def duplicate_clusters(pairs: DataFrame, apart: Callable[[Column, Column], Column] = meant_apart) -> DataFrame:
    """Clusters (component, members, folders, files, similarity, severity, confidence) of pairs (a, b, similarity) of paths.

    Pairs that are meant apart do not count; a caller that knows more of its files gives a condition of its own. A cluster within one folder, but for drafts and versions, is low, else
    medium. The first six files are listed."""
    return _clusters(written(pairs.where(~apart(F.col("a"), F.col("b"))), "pairs"))


def _clusters(kept: DataFrame) -> DataFrame:
    of = graph.components(kept)
    best = kept.join(of.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.max("similarity").alias("similarity"))
    by = of.groupBy("component").agg(F.count("*").alias("members"), F.countDistinct(labels.working_folder(F.col("node"))).alias("folders"))
    listed = of.withColumn("_n", F.row_number().over(W.partitionBy("component").orderBy("node"))).where("_n <= 6")
    listed = listed.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("files"))
    severity = F.when(F.col("folders") == 1, "low").otherwise("medium")
    return by.join(listed, "component").join(best, "component").withColumns({"severity": severity, "confidence": F.round(F.least("similarity", F.lit(0.99)), 2)})


def _file_vectors(files: DataFrame, chunks: DataFrame, least_chunks: int, looks: dict[str, Column]) -> DataFrame:
    """(id, vector, root, file_hash) and looks of files with enough chunks; the vector is the mean of theirs."""
    mean = mean_vectors(chunks.where(F.col("embedding").isNotNull()), ["path"], "embedding").where(F.col("n") >= least_chunks)
    rows = files.select("path", "root", "file_hash", *(c.alias(name) for name, c in looks.items())).join(mean, "path")
    return written(rows.select(F.col("path").alias("id"), F.col("mean").alias("vector"), "root", "file_hash", *looks), "vectors")


def similar_files(files: DataFrame, chunks: DataFrame, least_chunks: int = 2, threshold: float = 0.92, most: int = 200) -> DataFrame:
    """(root, a, b, similarity): of each root the `most` most similar pairs of files (path, root, file_hash) by the mean
    vectors of their chunks (path, embedding), by path on ties.

    Files with fewer chunks or equal hashes make no pair. None of these pairs is missed (vector_index.top_pairs)."""
    return vector_index.top_pairs(_file_vectors(files, chunks, least_chunks, {}), threshold, most, "root", "file_hash")


def semantic_duplicates(files: DataFrame, chunks: DataFrame, least_chunks: int = 2, threshold: float = 0.92, within: Column | None = None) -> DataFrame:
    """The clusters, as duplicate_clusters gives them, of all pairs of files of a root that are as similar as similar_files asks, however many.

    Files are meant apart as by meant_apart; where `within` is given, only those of one value of it. Of the pairs of two
    blocks, those are written that link what all of them would (vector_index.linking_pairs)."""
    looks = _looks(F.col("path")) | {"_within": F.lit("") if within is None else F.coalesce(within.cast("string"), F.lit(""))}
    rows = _file_vectors(files, chunks, least_chunks, looks)
    pairs = vector_index.linking_pairs(rows, threshold, "root", "file_hash", tuple(looks), _meant_apart)
    return _clusters(written(pairs.select("a", "b", "similarity"), "pairs"))


def unsuppressed(findings: DataFrame) -> DataFrame:
    """Findings (role, issue_type, ..) that their folder's role does not rule out."""
    ruled_out = filters.any_of(*((F.col("role") == role) & F.col("issue_type").isin(issues) for role, issues in SUPPRESSED.items()))
    return findings.where(~F.coalesce(ruled_out, F.lit(False)))


def registry_candidates(classified: DataFrame, known: list[str]) -> DataFrame:
    """(code, label, first) of customer folders whose code no registry has."""
    df = classified.where((F.col("folder_type") == "customer") & F.col("customer_code").isNotNull() & ~F.col("customer_code").isin(list(known)))
    return df.groupBy(F.col("customer_code").alias("code")).agg(F.min("path").alias("first")).withColumn("label", N.humanized(P.name(F.col("first"))))


def report_sections(findings: DataFrame) -> DataFrame:
    """(section, issue_type, findings) of a report; issues of no section are under Other."""
    section = F.lit("Other")
    for name, issues in SECTIONS.items():
        section = F.when(F.col("issue_type").isin(issues), name).otherwise(section)
    return findings.groupBy(section.alias("section"), "issue_type").agg(F.count("*").alias("findings"))


def code_folders(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """(folder, is_code_repo): a marker among its names, or three code files, half of all, and a folder of code."""
    path = F.col("path")
    own = files.groupBy(P.parent(path).alias("folder")).agg(F.count("*").alias("files"), F.count_if(P.extension(path).isin(CODE)).alias("code"), F.max(P.name(path).isin(MARKERS)).alias("marked"))
    sub = dirs.groupBy(P.parent(path).alias("folder")).agg(F.max(P.name(path).isin(CODE_DIRS)).alias("structured"), F.max(P.name(path).isin(MARKERS)).alias("marked_dir"))
    no = lambda c: F.coalesce(c, F.lit(False))
    by_files = (F.col("code") >= 3) & (2 * F.col("code") >= F.col("files")) & F.col("structured")
    return own.join(sub, "folder", "full_outer").select("folder", (no(F.col("marked")) | no(F.col("marked_dir")) | no(by_files)).alias("is_code_repo"))


def outside_code(rows: DataFrame, repos: DataFrame) -> DataFrame:
    """Rows (path) that are not below a code folder; the folder itself stays, as a leaf."""
    leaf = repos.where("is_code_repo").select(F.col("folder").alias("path"))
    below = ledger.at_or_below(rows.join(leaf, "path", "left_anti"), leaf, how="left_anti")
    return below.unionByName(rows.join(leaf, "path", "left_semi"))


def vote(pairs: DataFrame, k: int = 8, cap: float = 0.95) -> DataFrame:
    """(file, destination, confidence) by the k nearest neighbours (file, neighbour, similarity, destination): votes weigh by similarity."""
    near = pairs.withColumn("_n", F.row_number().over(W.partitionBy("file").orderBy(F.desc("similarity"), "neighbour"))).where(F.col("_n") <= k)
    votes = near.groupBy("file", "destination").agg(F.sum(F.greatest("similarity", F.lit(0.0))).alias("votes"), F.max("similarity").alias("top"))
    of = W.partitionBy("file")
    votes = votes.withColumns({"total": F.sum("votes").over(of), "best": F.max("top").over(of), "_n": F.row_number().over(of.orderBy(F.desc(F.round("votes", 9)), "destination"))})
    share = F.coalesce(F.try_divide("votes", "total"), F.lit(0.0))
    return votes.where("_n = 1").select("file", "destination", F.round(F.least(share * F.col("best"), F.lit(cap)), 4).alias("confidence"))


def choose(files: DataFrame, by_pattern: DataFrame, by_vector: DataFrame, sure: float = 0.75) -> DataFrame:
    """files (path) with destination, confidence, method: a sure pattern, else the vector's if it is better, else the pattern, else none."""
    p = by_pattern.select("path", F.col("destination").alias("_pd"), F.col("confidence").alias("_pc"))
    v = by_vector.select("path", F.col("destination").alias("_vd"), F.col("confidence").alias("_vc"))
    df = files.join(p, "path", "left").join(v, "path", "left")
    vector = F.coalesce(F.col("_vc") > F.coalesce("_pc", F.lit(-1.0)), F.lit(False)) & ~F.coalesce(F.col("_pc") >= sure, F.lit(False))
    method = F.when(vector, "embedding").when(F.col("_pc").isNotNull(), "pattern").otherwise("none")
    return df.withColumns({"destination": F.when(vector, F.col("_vd")).otherwise(F.col("_pd")), "confidence": F.when(vector, F.col("_vc")).otherwise(F.coalesce("_pc", F.lit(0.0))), "method": method}).select(*files.columns, "destination", "confidence", "method")


def inbox_plan(files: DataFrame, predicted: DataFrame, prefixes: tuple[str, ...] = ("00",)) -> DataFrame:
    """Files in an inbox (a top folder with such a prefix) with what is predicted of them and its band."""
    top = F.split_part("path", F.lit("/"), F.lit(1))
    inbox = files.where(filters.any_of(*(top.startswith(p) for p in prefixes)))
    out = inbox.join(predicted, "path", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    return out.withColumn("band", P.band(F.col("confidence")))


def accuracies(levels: DataFrame) -> DataFrame:
    """Counts of match levels and their cumulative shares, in one row."""
    count = lambda *names: F.count_if(F.col("match_level").isin(*names))
    total = F.greatest(F.count("*"), F.lit(1))
    share = lambda *names: F.round(count(*names) / total, 4)
    return levels.agg(F.count("*").alias("total"), *(count(n).alias(n) for n in ("exact", "initiative", "customer", "wrong")), share("exact").alias("exact_accuracy"), share("exact", "initiative").alias("initiative_accuracy"), share("exact", "initiative", "customer").alias("customer_accuracy"))


def training_rows(files: DataFrame, classified: DataFrame) -> DataFrame:
    """Active files (path, folder) with the last classification of their folder (path, created_at, ..)."""
    rest = [c for c in classified.columns if c not in ("path", "created_at")]
    last = classified.groupBy("path").agg(F.max_by(F.struct(*rest), "created_at").alias("_last")).select(F.col("path").alias("folder"), "_last.*")
    return files.join(last, "folder", "left")


def open_findings(findings: DataFrame, severity: Column | None = None) -> DataFrame:
    """Open findings, the surest first; severities order as text."""
    return findings.where(filters.all_of(F.col("status") == "open", severity)).orderBy(F.desc("confidence"), F.desc("severity"), "path")
