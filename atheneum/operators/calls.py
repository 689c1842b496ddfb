"""Calls of a model over rows: in batches, with each failure kept to its own row, and a ledger of attempts.

A model is a function of a list of rows (dicts) that gives a dict from id to answer (text). It runs within tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 30


def answered(items: DataFrame, model: Callable[[list[dict]], dict], batch: int = BATCH, key: str = "id") -> DataFrame:
    """(id, answer, status, error) of items: done, missing (the model left the row out) or failed.

    A batch that fails is called again row by row, so one bad row costs the others nothing."""
    names = items.columns

    def one(rows: list[dict]) -> Iterator[tuple]:
        try:
            got = model(rows) or {}
        except Exception as e:  # noqa: BLE001, whatever a model may raise
            if len(rows) == 1:
                yield rows[0][key], None, "failed", f"{type(e).__name__}: {str(e)[:500]}"
                return
            for r in rows:
                yield from one([r])
            return
        for r in rows:
            a = got.get(r[key])
            yield r[key], None if a is None else str(a), "missing" if a is None else "done", None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Only the rows of one call are Python objects at a time; answers are small.
            out = [x for k in range(0, b.num_rows, batch) for x in one(b.slice(k, batch).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], b.column(names.index(key)).type), *(pa.array([x[k] for x in out], pa.string()) for k in (1, 2, 3))], names=[key, "answer", "status", "error"])

    return items.mapInArrow(run, f"{key} {items.schema[key].dataType.simpleString()}, answer string, status string, error string")


def open_items(items: DataFrame, ledger: DataFrame, version: str, content: Column, most: int = 3, key: str = "id") -> DataFrame:
    """Items that the ledger (id, version, content_hash, status, error, attempts) has no answer to, for this version and content, in under `most` attempts."""
    now = items.withColumn("_hash", F.sha2(content, 256))
    had = ledger.where(F.col("version") == version).select(key, F.col("content_hash").alias("_hash"), "status", "attempts")
    over = had.where((F.col("status") == "done") | (F.col("attempts") >= most))
    return now.join(over, [key, "_hash"], "left_anti").drop("_hash")


def noted(ledger: DataFrame, items: DataFrame, answers: DataFrame, version: str, content: Column, key: str = "id") -> DataFrame:
    """The ledger after answers to items: one more attempt where version and content are as before, else the first."""
    new = items.select(key, F.sha2(content, 256).alias("content_hash")).join(answers, key).withColumn("version", F.lit(version))
    j = ledger.alias("o").join(new.alias("n"), key, "full_outer")
    same = F.coalesce((F.col("o.version") == F.col("n.version")) & (F.col("o.content_hash") == F.col("n.content_hash")), F.lit(False))
    came = F.col("n.status").isNotNull()
    of = lambda c: F.when(came, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    attempts = F.when(came, F.when(same, F.col("o.attempts") + 1).otherwise(1)).otherwise(F.col("o.attempts")).alias("attempts")
    return j.select(key, of("version"), of("content_hash"), of("status"), of("error"), attempts)


def labelled(answers: DataFrame, known: list[str], confidence: float = 0.8, key: str = "id") -> DataFrame:
    """(id, label, confidence): the answer where it is one of the known labels, else `unknown` at 0.2."""
    fits = F.coalesce(F.col("answer").isin(known), F.lit(False))
    return answers.select(key, F.when(fits, F.col("answer")).otherwise("unknown").alias("label"), F.when(fits, confidence).otherwise(0.2).alias("confidence"))
