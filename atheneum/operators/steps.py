"""Derived tables as steps that are skipped while their inputs stay as they are.

A step names its inputs (sources or other steps) and makes one table of them. Its table is stored under a mark of its
version and of its inputs' contents; a later run takes a stored table with the same mark. A step that fails leaves its
error in the ledger and blocks what needs it, the others go on; the next run takes up what is missing.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "step string, mark string, content string, status string, error string, seconds double, finished double"


@dataclass(frozen=True)
class Step:
    name: str
    inputs: tuple[str, ...]
    make: Callable[..., DataFrame]
    version: str = "1"


def content(df: DataFrame) -> str:
    """A mark of a table's rows in any order and of its columns' names; one scan."""
    columns = [F.to_json(F.struct(c)) if any(k in kind for k in ("map<", "variant")) else F.col(c) for c, kind in df.dtypes]
    part = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")), F.lit(0))
    row = df.agg(F.count("*"), part(1), part(2)).first()
    return hashlib.sha256(repr((df.columns, *map(str, row))).encode()).hexdigest()[:24]


@dataclass
class Store:
    """Tables and the ledger of their steps in one folder."""

    spark: SparkSession
    root: str
    done: list[dict] = field(default_factory=list)

    def ledger(self) -> DataFrame:
        try:
            return self.spark.read.schema(LEDGER).parquet(f"{self.root}/ledger")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LEDGER)

    def _note(self, row: dict) -> None:
        self.done.append(row)
        self.spark.createDataFrame([tuple(row.values())], LEDGER).coalesce(1).write.mode("append").parquet(f"{self.root}/ledger")

    def run(self, steps: list[Step], sources: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, str]]:
        """The tables of all steps that could be made, and what became of each: made, skipped, failed or blocked."""
        of = {s.name: s for s in steps}
        known = {(r.step, r.mark): r.content for r in self.ledger().where("status = 'made'").collect()}  # a row for each change of a step
        tables, marks, told = dict(sources), {}, {}
        for name in TopologicalSorter({s.name: s.inputs for s in steps}).static_order():
            if name not in of:
                marks[name] = content(sources[name])
                continue
            step = of[name]
            if any(i not in marks for i in step.inputs):
                told[name] = "blocked"
                continue
            mark = hashlib.sha256("\n".join([name, step.version, *(marks[i] for i in step.inputs)]).encode()).hexdigest()[:24]
            path, began = f"{self.root}/{name}/{mark}", time.time()
            row = {"step": name, "mark": mark, "content": known.get((name, mark)), "status": "skipped", "error": None}
            if row["content"] is None:
                try:
                    step.make(*(tables[i] for i in step.inputs)).write.mode("overwrite").parquet(path)
                    row |= {"content": content(self.spark.read.parquet(path)), "status": "made"}
                except Exception as e:  # noqa: BLE001, a step of the caller's may fail in any way
                    row |= {"status": "failed", "error": f"{type(e).__name__}: {str(e)[:2000]}"}
                self._note(row | {"seconds": time.time() - began, "finished": time.time()})
            told[name] = row["status"]
            if row["status"] != "failed":
                tables[name], marks[name] = self.spark.read.parquet(path), row["content"]
        return {n: t for n, t in tables.items() if n in of and n in marks}, told
