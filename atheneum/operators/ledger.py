"""Tables that change: replaced parts, appended rows with a latest view, runs, reviews and inventories.

A table is its rows; each operator gives the new rows, which the caller writes in place of the old ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atheneum.operators.state import latest


def delete_cascade(tables: dict[str, DataFrame], keys: DataFrame, key: str = "file_id") -> dict[str, DataFrame]:
    """Every table without the rows of the deleted keys."""
    gone = keys.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") if key in df.columns else df for name, df in tables.items()}


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key is not among the new rows, and the new rows: a key's rows are replaced as a whole."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def enqueued(queue: DataFrame, keys: DataFrame, key: str = "file_id") -> DataFrame:
    """The queue (key, status, attempts, error) with the keys pending anew: no attempts, no error."""
    rows = keys.select(key).distinct().select(key, F.lit("pending").alias("status"), F.lit(0).cast("long").alias("attempts"), F.lit(None).cast("string").alias("error"))
    return replace_by_key(queue.select(rows.columns), rows, key)


def retried(queue: DataFrame, scope: Column | None = None) -> DataFrame:
    """Failed rows (in scope) pending again; their attempts stay."""
    again = (F.col("status") == "failed") & (F.lit(True) if scope is None else scope)
    return queue.withColumns({"error": F.when(~again, F.col("error")), "status": F.when(again, "pending").otherwise(F.col("status"))})


def reindex_candidates(files: DataFrame, chunks: DataFrame, queue: DataFrame, kind: str = "gaps") -> DataFrame:
    """Files to index again, with their counts: `gaps` (documents with a chunk without section, or no chunk), `documents`, or `audio`; those in work are left out."""
    stats = chunks.groupBy("file_id").agg(F.count("*").alias("chunks"), F.count("section").alias("with_section"))
    df = files.join(stats, "file_id", "left").fillna(0, ["chunks", "with_section"]).join(queue.select("file_id", "status"), "file_id", "left")
    wanted = {"gaps": ~F.col("is_audio") & (F.col("with_section") < F.greatest("chunks", F.lit(1))), "documents": ~F.col("is_audio"), "audio": F.col("is_audio")}[kind]
    return df.where(wanted & (F.col("status").isin("done", "failed") | F.col("status").isNull())).select("file_id", "chunks", "with_section", "status")


def appended(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def rotated(snapshots: DataFrame) -> DataFrame:
    """Snapshots (scope, created_at, snapshot_id, ..) with `current` on the last one of each scope only."""
    last = snapshots.groupBy("scope").agg(F.max(F.struct("created_at", "snapshot_id")).alias("_last"))
    out = snapshots.drop("current").join(last, "scope")
    return out.withColumn("current", F.struct("created_at", "snapshot_id") == F.col("_last")).drop("_last")


def upsert_summaries(old: DataFrame, new: DataFrame) -> DataFrame:
    """One summary for each owner, model, prompt version and source hash; a new one wins."""
    key = ["owner", "model", "prompt_version", "source_hash"]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, key, [F.desc("_new"), F.desc("created_at")]).drop("_new")


def inventory_change(before: DataFrame, now: DataFrame) -> DataFrame:
    """(root, path, content_hash, status, change): rows of now are active, new, changed or same; those that are gone stay as removed.

    A hash that was not taken anew is kept."""
    o, n = before.alias("o"), now.alias("n")
    j = o.withColumn("_o", F.lit(1)).alias("o").join(n.withColumn("_n", F.lit(1)).alias("n"), ["root", "path"], "full_outer")
    same = F.col("o.signature").eqNullSafe(F.col("n.signature"))
    change = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), F.when(F.col("o.status") == "removed", "same").otherwise("removed")).when(same, "same").otherwise("changed")
    return j.select(
        "root", "path", F.coalesce("n.signature", "o.signature").alias("signature"), F.coalesce("n.content_hash", "o.content_hash").alias("content_hash"),
        F.when(F.col("_n").isNull(), "removed").otherwise("active").alias("status"), change.alias("change"),
    )


def reviewed(findings: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings with the status of their last decision (finding_id, status, decided_at), and the patterns `status:type:path` with how often each was decided."""
    last = latest(decisions, ["finding_id"], [F.desc("decided_at"), F.desc("status")]).select("finding_id", F.col("status").alias("_status"))
    out = findings.join(last, "finding_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")
    made = decisions.join(findings.select("finding_id", "issue_type", "path"), "finding_id")
    pattern = F.concat_ws(":", "status", "issue_type", "path")
    return out, made.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("times"), F.max("decided_at").alias("last_at"))


def replace_assets(old: DataFrame, new: DataFrame, run_at: Column) -> DataFrame:
    """The assets of a run; those seen before keep the time they were first seen."""
    first = old.select("asset_key", F.col("first_seen").alias("_first"))
    return new.join(first, "asset_key", "left").withColumn("first_seen", F.coalesce("_first", run_at)).drop("_first")


def runs(events: DataFrame) -> DataFrame:
    """The ledger of runs from events (run_id, event, at, counters map): start, finish, status, and the last counters given."""
    done = F.max_by("status", "at")
    out = events.groupBy("run_id").agg(
        F.min(F.when(F.col("event") == "start", F.col("at"))).alias("started"), F.max(F.when(F.col("event") == "finish", F.col("at"))).alias("finished"), done.alias("status"),
        F.max_by("folders", "at", ).alias("folders"), F.max_by("findings", "at").alias("findings"),
    )
    return out


def synced_aliases(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose missing document_id, raw_text, contextual_text and heading_path are filled from their document and content."""
    j = chunks.join(documents.select("file_id", F.col("document_id").alias("_doc")), "file_id", "left")
    return j.withColumns({
        "document_id": F.coalesce("document_id", "_doc"), "raw_text": F.coalesce("raw_text", "content"), "contextual_text": F.coalesce("contextual_text", "content"), "heading_path": F.coalesce("heading_path", "heading"),
    }).drop("_doc")


def at_or_below(rows: DataFrame, roots: DataFrame, path: str = "path", how: str = "left_semi") -> DataFrame:
    """Rows at or below a root path (or, with left_anti, those that are not): a row's ancestors are joined by equality."""
    own = rows.select(path).distinct()
    parts = F.split(path, "/")
    above = own.select(path, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("_root"))
    inside = above.join(roots.select(F.col("path").alias("_root")).distinct(), "_root", "left_semi").select(path).distinct()
    return rows.join(inside, path, how)


def first_wins(findings: DataFrame, order: str = "position") -> DataFrame:
    """One finding of each path, type and reasoning: the first."""
    return findings.withColumn("_n", F.row_number().over(W.partitionBy("path", "issue_type", "reasoning").orderBy(order))).where("_n = 1").drop("_n")
