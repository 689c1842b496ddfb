"""Importance resampling towards a target text: hashed n-gram features, log ratios of bucket counts, and a
draw without replacement by Gumbel noise.

A streaming CRC ring makes the features: one scan of a document keeps the running zlib states of the last n
starts; each word extends every state by a space and the word and opens a start of its own, so a feature's
bytes are never put together. The scan is done once; its buckets are a written table, from which both the
corpus counts and the documents' weights come.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atheneum.llm.common import apart, raw, table, words_of, written

#: Features are runs of 1 to NGRAM words, hashed to BUCKETS buckets; a document needs LEAST_WORDS words to be drawn.
NGRAM, BUCKETS, LEAST_WORDS, SHARE, SEED = 2, 10_000, 20, 25, "7"
_SCANNED = ("n_words", "n_features", "_buckets")
_ADDED = (*_SCANNED, "weight", "score", "rank", "_place", "_part", "_more")


def ring_buckets(words: list[bytes], n: int = NGRAM, buckets: int = BUCKETS) -> list[int]:
    """The bucket of each run of 1 to n words, in the order in which the runs end."""
    states: list[int] = []
    out: list[int] = []
    for word in words:
        after = b" " + word
        states = [crc32(after, s) for s in states[1 - n :]] if n > 1 else []
        states.append(crc32(word))
        out += states
    return [s % buckets for s in out]


def scan(docs: DataFrame, text: str = "text", n: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """docs without its text, with n_words, n_features and _buckets (the features' buckets as 4-byte integers)."""
    names = docs.columns
    keep = [k for k, c in enumerate(names) if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n_words, found = [], []
                for t in raw(part.column(names.index(text))):
                    words = words_of(t)
                    n_words.append(len(words))
                    found.append(np.array(ring_buckets(words, n, buckets), dtype="<i4").tobytes())
                more = [pa.array(n_words, pa.int64()), pa.array([len(f) // 4 for f in found], pa.int64()), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *more], names=[*(names[k] for k in keep), *_SCANNED])

    zero = F.lit(0).cast("long")
    shape = docs.drop(text).select("*", zero.alias("n_words"), zero.alias("n_features"), F.lit(b"").alias("_buckets")).schema
    return docs.mapInArrow(run, shape)


def bucket_counts(scanned: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How many features each bucket has. Tasks add up before the shuffle; at most `buckets` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for value in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(value, dtype="<i4"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = [0] * buckets
    for r in scanned.select("_buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


@dataclass
class Gains:
    """What a feature of each bucket adds to a document: 1000 times the log ratio of its smoothed shares, floored."""

    values: np.ndarray

    @classmethod
    def of(cls, corpus: list[int], target: list[int]) -> Gains:
        b, s, t = float(len(corpus)), float(sum(corpus)), float(sum(target))
        return cls(np.array([math.floor(1000 * math.log((y + 1.0) * (s + b) / ((x + 1.0) * (t + b)))) for x, y in zip(corpus, target, strict=True)], dtype=np.int64))

    def add(self, scanned: DataFrame) -> DataFrame:
        """scanned with weight, the floored mean of the gains of a row's features (0 without any), in place of _buckets."""
        names = scanned.columns
        at = names.index("_buckets")
        keep = [k for k in range(len(names)) if k != at]
        values = self.values  # as many numbers as buckets

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = [np.frombuffer(v, dtype="<i4") for v in b.column(at).to_pylist()]
                weight = [int(values[i].sum()) // len(i) if len(i) else 0 for i in ids]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(weight, pa.int64())], names=[*(names[k] for k in keep), "weight"])

        return scanned.mapInArrow(run, scanned.drop("_buckets").select("*", F.lit(0).cast("long").alias("weight")).schema)


def gumbel(key: str, seed: str = SEED) -> F.Column:
    """Gumbel noise in thousandths, a function of seed and key alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(scored: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, key: str = "doc_id") -> DataFrame:
    """scored with rank: 1, 2, .. over the floor(share * rows / 100) best scores of rows with least_words words, else null.

    scored is a written table. A histogram of the scores (integers within some 10^5, whatever the rows) gives the
    score that the last drawn row has, so only rows from there up are ordered: they are dealt by ranges of the full
    order, numbered within each range, and the ranges' sizes add up to offsets. No task sees more than a range."""
    able = F.col("n_words") >= least_words
    rows = scored.where(able).count()
    n = share * rows // 100
    none = F.lit(None).cast("long")
    if not n:
        return scored.withColumn("rank", none)
    counts = scored.where(able).groupBy("score").agg(F.count("*").alias("n"))
    above = counts.withColumn("upto", F.sum("n").over(W.orderBy(F.desc("score"))))  # as many rows as scores differ
    last = above.where(F.col("upto") >= n).agg(F.max("score")).first()[0]
    order = [F.desc("score"), F.asc_nulls_last(key), F.desc("weight"), F.desc("n_features"), F.asc("_more")]
    more = F.xxhash64(*(F.to_json(c) if "map<" in kind else F.col(f"`{c}`") for c, kind in scored.dtypes))
    near = scored.where(able & (F.col("score") >= last)).withColumn("_more", more)
    near = written(near.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "drawn")
    sizes = near.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(W.orderBy("_part")) - F.col("n")).alias("_place"))  # as many rows as ranges
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order)) + F.col("_place")
    near = near.join(F.broadcast(before), "_part").withColumn("rank", place.cast("long"))
    near = near.select(*scored.columns, F.when(F.col("rank") <= n, F.col("rank")).alias("rank"))
    return near.unionByName(scored.where(~F.coalesce(able & (F.col("score") >= last), F.lit(False))).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", share: int = SHARE, n: int = NGRAM, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """docs without its text, with n_words, n_features, weight, score (weight and noise) and rank (null where not drawn).

    Null texts have no words; a null key is an empty string in the noise and comes last among ties. Rows that repeat
    wholly each count and take neighbouring ranks. A column with an added one's name has `_in` behind it; an empty
    table gives no rows, an empty target has no features."""
    new = apart(docs, *_ADDED).columns
    text, key = new[docs.columns.index(text)], new[docs.columns.index(key)]
    scanned = written(scan(apart(docs, *_ADDED), text, n, buckets), "scanned")
    gains = Gains.of(bucket_counts(scanned, buckets), bucket_counts(scan(target.select("text"), "text", n, buckets), buckets))
    scored = written(gains.add(scanned).withColumn("score", F.col("weight") + gumbel(key, seed)), "scored")
    return drawn(scored, share, least_words, key)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


#: The table of CRC-32 is made from its polynomial; each distinct feature is hashed byte by byte.
OP11_SQL = r"""
WITH RECURSIVE steps AS (SELECT i AS slot, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL SELECT slot, k + 1, CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY slot) AS t FROM steps WHERE k = 8),
texts AS (SELECT 0 AS side, doc_id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM benchmark),
d AS (SELECT side, doc_id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS (SELECT side, r, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) t(i) UNION ALL SELECT side, r, w[i] || ' ' || w[i + 1] FROM d, unnest(range(1, len(w))) t(i)),
u AS (SELECT x, hex(encode(x)) AS h FROM (SELECT DISTINCT x FROM f)),
b AS (SELECT x, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                    lambda c, v: xor(c >> 8, t[xor(c & 255, v) + 1])), 4294967295) % 10000 AS bucket FROM u, crc),
n AS (SELECT side, r, bucket, count(*) AS n FROM f JOIN b USING (x) GROUP BY ALL),
c AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM n GROUP BY 1),
sums AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM c),
g AS (SELECT c.bucket, floor(1000 * ln((c.t + 1)::DOUBLE * (sums.s + 10000)::DOUBLE / ((c.s + 1)::DOUBLE * (sums.t + 10000)::DOUBLE)))::BIGINT AS gain FROM c, sums),
wt AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM n JOIN g USING (bucket) WHERE side = 0 GROUP BY 1),
sc AS (SELECT doc_id, r, len(w)::BIGINT AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
       floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise FROM d LEFT JOIN wt USING (r) WHERE side = 0),
k AS (SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id, r) AS rank, count(*) OVER () AS able FROM sc WHERE n_words >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= 25 * able // 100 THEN rank END AS rank, n_words FROM sc LEFT JOIN k USING (r)
"""
