"""A positional word index in Parquet, and ranked boolean queries that read their own words' postings only.

The index is a folder with three tables: `postings` (bucket, term, segment, id, tf, positions, n), `documents`
(segment, id, n and the columns that queries filter by) and `gone` (segment, id). Postings are dealt by bucket and by
one of PARTS parts of the ids, so a term of very many documents is split over files, files are sorted by term, and a query's
scan is cut by the folders of its words' buckets and by the files' own statistics. The documents of a later segment
take the place of those of the same id before; merged() writes the live rows anew.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atheneum.functions.text import terms
from atheneum.operators.retrieval import POOL, parse_query, ranked

_TERM = re.compile("[a-z0-9]+")
BUCKETS = 64
#: Files that the postings of a bucket are dealt to at most, by their ids.
PARTS = 32


def bucket_of(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode()) % buckets


@dataclass(frozen=True)
class WordIndex:
    spark: SparkSession
    path: str
    fields: T.StructType  # id and the columns to filter by
    buckets: int = BUCKETS
    segments: int = 0

    @property
    def _posting(self) -> T.StructType:
        return T.StructType([T.StructField("term", T.StringType()), self.fields["id"], *T._parse_datatype_string("tf int, positions array<int>, n int").fields])

    def _read(self, name: str, fields: T.StructType) -> DataFrame:
        kinds = T.StructType([*fields.fields, T.StructField("segment", T.IntegerType()), *([T.StructField("bucket", T.IntegerType())] if name == "postings" else [])])
        return self.spark.read.schema(kinds).option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/segment={k}" for k in range(self.segments)))

    def documents(self) -> DataFrame:
        """The live documents: of each id the row of the last segment that has it, if no later one gives it up."""
        docs = self._read("documents", T.StructType([*self.fields.fields, T.StructField("n", T.IntegerType())]))
        if self.segments == 1:
            return docs
        # A segment gives up all ids that it holds, so a row is live if no later segment names its id.
        ends = self._read("gone", T.StructType([self.fields["id"]])).groupBy("id").agg(F.max("segment").alias("_gone"))
        return docs.join(ends, "id", "left").where(F.col("_gone").isNull() | (F.col("segment") >= F.col("_gone"))).drop("_gone")

    def postings(self, words: list[str]) -> DataFrame:
        """The postings of words; only their buckets' folders are listed and only their row groups read."""
        found = sorted({bucket_of(w, self.buckets) for w in words})
        return self._read("postings", self._posting).where(F.col("bucket").isin(found) & F.col("term").isin(words))

    def match(self, text: str, where: Column | None = None, pool: int = POOL, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(id, bm25, rank_f) of the first `pool` documents that match the query, as retrieval.word_channel gives them; see matches()."""
        return ranked(self.matches(text, where, k1, b), [F.desc("bm25"), F.asc("id")], pool, "rank_f")

    def matches(self, text: str, where: Column | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(id, bm25) of all documents that match the query, in no order: no task sees them all.

        `where` looks at the columns of documents(); lengths and frequencies are those of the documents that pass it."""
        query = parse_query(text)
        words = sorted({w for g in query for w in g["all"]})
        absent = sorted({w for g in query for w in g["none"]})
        in_phrases = sorted({w for g in query for p in g["phrases"] + g["no_phrases"] for w in p.split()})
        live = self.documents() if where is None else self.documents().where(where)
        hits = self.postings(sorted({*words, *absent, *in_phrases}) or [""])
        if where is not None or self.segments > 1:
            hits = hits.join(live.select("segment", "id"), ["segment", "id"], "left_semi")
        of = lambda w, value: F.max(F.when(F.col("term") == w, value))
        rows = hits.groupBy("id").agg(
            F.max("n").alias("n"),
            *(F.coalesce(of(w, F.col("tf")), F.lit(0)).alias(f"tf{k}") for k, w in enumerate(words)),
            *(F.coalesce(of(w, F.lit(True)), F.lit(False)).alias(f"no{k}") for k, w in enumerate(absent)),
            *(of(w, F.col("positions")).alias(f"at{k}") for k, w in enumerate(in_phrases)),
        )
        stats = live.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
        stats = stats.crossJoin(F.broadcast(rows.agg(F.count("*").alias("_any"), *(F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(words))))))  # one row each
        if any(not g["all"] for g in query):  # an alternative that only excludes is met by documents without any of the words
            rows = live.select("id", F.col("n").alias("_n")).join(rows.drop("n"), "id", "left").withColumnRenamed("_n", "n")
            rows = rows.withColumns({f"tf{k}": F.coalesce(f"tf{k}", F.lit(0)) for k in range(len(words))} | {f"no{k}": F.coalesce(f"no{k}", F.lit(False)) for k in range(len(absent))})

        def said(phrase: str) -> Column:
            """Whether some place has the first word, and the places behind it the others."""
            first, *rest = phrase.split()
            both = F.col(f"at{in_phrases.index(first)}")
            for j, w in enumerate(rest, 1):
                both = F.array_intersect(both, _shifted(F.col(f"at{in_phrases.index(w)}"), j))
            return F.coalesce(F.size(both) > 0, F.lit(False))

        match = F.lit(False)
        for g in query:
            holds = F.lit(True)
            for w in g["all"]:
                holds &= F.col(f"tf{words.index(w)}") > 0
            for w in g["none"]:
                holds &= ~F.col(f"no{absent.index(w)}")
            for p in g["phrases"]:
                holds &= said(p)
            for p in g["no_phrases"]:
                holds &= ~said(p)
            match |= holds
        score = F.lit(0.0)
        for k in range(len(words)):
            idf = F.log(1 + (F.col("docs") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
            score += idf * F.col(f"tf{k}") * (k1 + 1) / (F.col(f"tf{k}") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
        return rows.where(match).crossJoin(F.broadcast(stats)).select("id", F.round(score, 6).alias("bm25"))

    def changed(self, docs: DataFrame, gone: DataFrame | None = None) -> WordIndex:
        """The index with a further segment: docs (id, text, ..) take the place of those of the same id, ids in gone (id) leave."""
        at, ids = f"segment={self.segments}", docs.select("id")
        self._store(_postings(docs, self.buckets), f"{self.path}/postings/{at}")
        keep = [f.name for f in self.fields if f.name != "id"]
        docs.select("id", *keep, F.size(terms(F.coalesce("text", F.lit("")))).alias("n")).write.parquet(f"{self.path}/documents/{at}")
        ids = ids if self.segments else ids.limit(0)
        (ids if gone is None else ids.unionByName(gone.select("id"))).write.parquet(f"{self.path}/gone/{at}")
        return replace(self, segments=self.segments + 1)

    def merged(self, path: str) -> WordIndex:
        """The live rows of all segments as an index of one segment in a new folder."""
        live = self.documents()
        hits = self._read("postings", self._posting).join(live.select("segment", "id"), ["segment", "id"], "left_semi").drop("segment")
        self._store(hits, f"{path}/postings/segment=0")
        live.drop("segment").write.parquet(f"{path}/documents/segment=0")
        live.select("id").limit(0).write.parquet(f"{path}/gone/segment=0")
        return replace(self, path=path, segments=1)

    def _store(self, postings: DataFrame, path: str) -> None:
        # By hashes, as ranges would read and parse all texts twice, the first time for their bounds.
        dealt = postings.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(PARTS))).sortWithinPartitions("bucket", "term", "id")
        dealt.write.partitionBy("bucket").option("compression", "zstd").parquet(path)


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def _postings(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, term, id, tf, positions, n) of docs (id, text), made in batches: no text is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = [_TERM.findall((t or "").lower()) for t in part.column(1).to_pylist()]
                sizes = np.array([len(f) for f in found])
                words = pa.array([w for f in found for w in f], pa.string()).dictionary_encode()
                rows = np.repeat(np.arange(len(found)), sizes)
                key = rows * max(1, len(words.dictionary)) + words.indices.to_numpy()
                order = np.argsort(key, kind="stable")  # a document's words, each with its places in order
                start = np.flatnonzero(np.diff(key[order], prepend=-1))
                of, said = rows[order[start]], words.indices.to_numpy()[order[start]]
                ends = np.append(start, len(order))
                places = (np.arange(len(rows)) - (np.cumsum(sizes) - sizes)[rows])[order]
                bucket = np.array([bucket_of(w, buckets) for w in words.dictionary.to_pylist()], np.int32)
                columns = [pa.array(bucket[said]), words.dictionary.take(pa.array(said)), part.column(0).take(pa.array(of)), pa.array(np.diff(ends).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(places.astype(np.int32))), pa.array(sizes[of].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "term", "id", "tf", "positions", "n"])

    return docs.select("id", "text").mapInArrow(run, f"bucket int, term string, id {docs.schema['id'].dataType.simpleString()}, tf int, positions array<int>, n int")


def build(docs: DataFrame, path: str, buckets: int = BUCKETS) -> WordIndex:
    """An index of docs (id, text, and the columns to filter by) in a new folder; ids are unique, null texts have no words."""
    fields = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema if f.name != "text"])
    return WordIndex(docs.sparkSession, path, fields, buckets).changed(docs)
