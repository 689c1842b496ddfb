"""Mentions of known names in texts, without a model: automata over the names (Aho and Corasick 1975), leftmost and longest.

Names come in parts of bounded size, each an automaton that tasks hold while they read the texts; the matches of all
parts are settled in order afterwards, so the number of names is not bounded by memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atheneum.functions.text import terms

#: Names of one automaton: some hundred bytes each, in the driver and in every task.
PART_NAMES = 200_000


def spoken(names: DataFrame) -> DataFrame:
    """(id, words): each name and alias of names (id, name, aliases) as its lower-case words, joined by blanks; without words it has no row."""
    each = names.select("id", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    words = each.select("id", F.array_join(terms(F.coalesce("n", F.lit(""))), " ").alias("words"))
    return words.where("words <> ''").distinct()


def occurrences(docs: DataFrame, names: DataFrame, part_names: int = PART_NAMES) -> DataFrame:
    """(doc_id, words, at, size) of every place of docs (doc_id, text) where a name's words stand: at counts words."""
    distinct = spoken(names).select("words").distinct()
    parts = max(1, -(-distinct.count() // part_names))
    kind = docs.schema["doc_id"].dataType.simpleString()
    said = docs.select("doc_id", F.array_join(terms(F.coalesce("text", F.lit(""))), " ").alias("said")).where("said <> ''")
    out = None
    for k in range(parts):
        mine = [r.words for r in distinct.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == k).toLocalIterator()]
        sent = docs.sparkSession.sparkContext.broadcast(mine)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            automaton = ahocorasick.Automaton()
            for w in sent.value:
                automaton.add_word(f" {w} ", w)
            if len(automaton):
                automaton.make_automaton()
            for b in batches:
                rows, words, at, size = [], [], [], []
                for r, text in enumerate(b.column(1).to_pylist() if len(automaton) else []):
                    upto = 0, 0  # characters and words that have been counted
                    for end, w in sorted((e - len(w) - 1, w) for e, w in automaton.iter(f" {text} ")):
                        upto = end, upto[1] + text.count(" ", upto[0], end)
                        rows.append(r)
                        words.append(w)
                        at.append(upto[1])
                        size.append(w.count(" ") + 1)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(words, pa.string()), pa.array(at, pa.int32()), pa.array(size, pa.int32())], names=["doc_id", "words", "at", "size"])

        found = said.mapInArrow(run, f"doc_id {kind}, words string, at int, size int")
        out = found if out is None else out.unionByName(found)
    return out


def mentions(docs: DataFrame, names: DataFrame, part_names: int = PART_NAMES) -> DataFrame:
    """(doc_id, id, words, at): places that do not overlap, the leftmost first and of those the longest; a name that several ids share gives each.

    doc_id is unique. A document's matches are as many as its words at most times the longest name."""
    found = occurrences(docs, names, part_names)
    listed = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("size")).alias("less"), "words"))).alias("all"))
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<at:int,less:int,words:string>>").alias("kept"))
    take = lambda acc, m: F.when(m["at"] >= acc["free"], F.struct((m["at"] - m["less"]).alias("free"), F.array_append(acc["kept"], m).alias("kept"))).otherwise(acc)
    kept = listed.select("doc_id", F.explode(F.aggregate("all", start, take)["kept"]).alias("m")).select("doc_id", "m.words", "m.at")
    return kept.join(spoken(names), "words").select("doc_id", "id", "words", "at")
