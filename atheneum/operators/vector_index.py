"""Vectors by cells: nearest neighbours that read few cells and are exact, and pairs above a similarity.

Cells are the classes of a k-means model with cosine distance, fitted to a bounded sample; every vector is stored in
the folder of its cell with its angle to the cell's centre. By the triangle inequality of angles, a vector at angle t
to a centre that is at angle a to the query has a similarity of at most cos(|a - t|), so after the nearest cells have
given a k-th similarity, the others are read only where that bound reaches it.

Pairs come from random hyperplanes: vectors that share all signs of one of several groups of planes are compared
exactly. The number of groups follows from the wanted recall at the least similarity.

Where only the most similar pairs of a group count, none may be missed: top_pairs compares all vectors of a group by
blocks, whose products are cheap, and gives out no more than these pairs of each two blocks. Where pairs only serve to
link, linking_pairs compares the same blocks and gives out as many pairs as link what all of them would.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atheneum.functions.vectors import cosine, dot
from atheneum.operators.retrieval import POOL, ranked

#: Vectors that the cells are fitted to, and the most cells: their centres are all that queries hold on the driver.
SAMPLE, MOST_CELLS, PROBES = 50_000, 4096, 4
#: Vectors of a cell that a file holds, about.
FILE_ROWS = 100_000
#: Signs of a group of planes, the wanted share of pairs at the least similarity, and when a group of equal signs is parted further.
SIGNS, RECALL, HOT, MORE_SIGNS = 14, 0.99, 2000, 10
#: Vectors of a block that is compared with others (some 40 MB at 64 dimensions), and of a product within a task.
BLOCK, TILE = 1 << 15, 1 << 10
#: Single precision and rounding to 6 places err by less.
SLACK = 1e-5


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    fields: T.StructType
    centres: np.ndarray  # unit vectors, a row a cell

    def _read(self) -> DataFrame:
        return self.spark.read.schema(self.fields).parquet(self.path)

    def _near(self, query: np.ndarray) -> np.ndarray:
        """The angle of each cell's centre to the query."""
        if not len(self.centres):
            return np.zeros(0)
        return np.arccos(np.clip(self.centres @ (query / np.linalg.norm(query)), -1, 1))

    def nearest(self, query: list[float], pool: int = POOL, probes: int = PROBES, where: Column | None = None, exact: bool = True) -> DataFrame:
        """(id, similarity, rank_v) of the nearest vectors that pass `where`, as retrieval.vector_channel gives them.

        With exact=False only the nearest `probes` cells are read."""
        angles = self._near(np.array(query, dtype=np.float64))
        order = np.argsort(angles, kind="stable")
        q = F.array(*(F.lit(float(x)) for x in query))
        rows = self._read() if where is None else self._read().where(where)
        rows = rows.withColumn("similarity", F.round(cosine(F.col("vector"), q), 6))
        first = rows.where(F.col("cell").isin([int(c) for c in order[:probes]]))
        if exact:
            kth = first.select("similarity").orderBy(F.desc("similarity")).limit(pool).agg(F.count("*").alias("n"), F.min("similarity").alias("s")).first()
            # Rounding moves a similarity by less than 1e-6.
            width = math.pi if kth.n < pool else math.acos(max(-1.0, min(1.0, kth.s - 2e-6)))
            # A vector at angle t in a cell at angle a is within reach if |a - t| <= width.
            ends = self.spark.createDataFrame([(k, float(a) - width - 1e-6, float(a) + width + 1e-6) for k, a in enumerate(angles)], "cell int, low double, high double")
            first = rows.join(F.broadcast(ends), "cell").where("angle between low and high") if width < math.pi else rows  # at most MOST_CELLS rows
        return ranked(first.select("id", "similarity"), [F.desc("similarity"), F.asc("id")], pool, "rank_v")


def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows with the cell of the nearest centre and the angle to it, by products of batches and centres."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CELLS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, small = sent.value, sent.value.T.astype(np.float32)
        for batch in batches:
            for start in range(0, batch.num_rows, TILE):
                part = batch.slice(start, TILE)
                x = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                cell = (x.astype(np.float32) @ small).argmax(axis=1).astype(np.int32)
                angle = np.arccos(np.clip((x * of[cell]).sum(axis=1), -1, 1))  # in double: searches rely on it
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(angle)], names=[*part.schema.names, "cell", "angle"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]))


def build(vectors: DataFrame, path: str, cells: int | None = None, seed: int = 7) -> VectorIndex:
    """An index of vectors (id, vector, and columns to filter by) in a new folder; null and zero vectors are left out."""
    rows = vectors.where(F.col("vector").isNotNull()).where(dot(F.col("vector"), F.col("vector")) > 0)
    n = rows.count()
    cells = cells or max(1, min(MOST_CELLS, int(math.sqrt(n) / 2)))
    if n <= cells or cells == 1:
        centres = np.array([r.vector for r in rows.orderBy("id").limit(1).collect()], dtype=np.float64)
    else:
        sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < (1 << 30) * min(1.0, SAMPLE / n)).select(array_to_vector(F.col("vector").cast("array<double>")).alias("_f"))
        centres = np.array(KMeans(k=cells, featuresCol="_f", predictionCol="cell", distanceMeasure="cosine", seed=seed, maxIter=10).fit(sample).clusterCenters())
    centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300) if len(centres) else np.zeros((0, 1))
    placed = _placed(rows, centres)
    # By hashes, as ranges would place all vectors twice, the first time for their bounds; a cell of many vectors is dealt to several files.
    dealt = placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(n / cells / FILE_ROWS))))).sortWithinPartitions("cell", "angle")
    dealt.write.partitionBy("cell").parquet(path)
    return VectorIndex(vectors.sparkSession, path, placed.schema, centres)


def groups_for(threshold: float, signs: int = SIGNS, recall: float = RECALL) -> int:
    """How many groups of planes meet a pair at the threshold with the wanted probability."""
    same = (1 - math.acos(threshold) / math.pi) ** signs
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _signs(vectors: DataFrame, groups: int, signs: int, more: int, seed: int) -> DataFrame:
    """(id, at, key, longer): for each group of planes the signs of a vector, and those of further planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, weights = None, 1 << np.arange(signs + more, dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(1).to_pylist(), dtype=np.float64)
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(x.shape[1], groups * (signs + more)))
            bits = ((x @ planes) > 0).reshape(len(x), groups, signs + more)
            short, rest = bits[:, :, :signs] @ weights[:signs], bits[:, :, signs:] @ weights[:more]
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(x)), groups)))
            at = np.tile(np.arange(groups, dtype=np.int32), len(x))
            yield pa.RecordBatch.from_arrays([ids, pa.array(at), pa.array(short.reshape(-1)), pa.array(rest.reshape(-1))], names=["id", "at", "key", "longer"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "vector").mapInArrow(run, f"id {kind}, at int, key long, longer long")


def similar_pairs(vectors: DataFrame, threshold: float, recall: float = RECALL, seed: int = 11) -> DataFrame:
    """(a, b, similarity) with a < b of vectors (id, vector) with a cosine of at least threshold, rounded to 6 places.

    Equal vectors meet as one and are paired with each other's partners afterwards. Groups of over HOT distinct
    vectors are parted by further planes, in this group of planes only. Null and zero vectors have no pair."""
    rows = vectors.where(F.col("vector").isNotNull()).where(dot(F.col("vector"), F.col("vector")) > 0).select("id", "vector")
    rows = rows.withColumn("_v", F.xxhash64("vector"))
    heads = rows.groupBy("_v").agg(F.min("id").alias("head"), F.min_by("vector", "id").alias("vector"), F.count("*").alias("copies"))
    keys = _signs(heads.select(F.col("_v").alias("id"), "vector"), groups_for(threshold, recall=recall), SIGNS, MORE_SIGNS, seed)
    hot = keys.groupBy("at", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("at", "key", F.lit(1).alias("_hot"))
    keys = keys.join(hot, ["at", "key"], "left").select("id", "at", "key", F.when(F.col("_hot") == 1, F.col("longer")).otherwise(F.lit(0)).alias("longer"))
    x, y = keys.withColumnRenamed("id", "u"), keys.withColumnRenamed("id", "w")
    met = x.join(y, ["at", "key", "longer"]).where("u < w").select("u", "w").distinct()
    of = heads.select("_v", "vector")
    met = met.join(of.toDF("u", "x"), "u").join(of.toDF("w", "y"), "w").withColumn("similarity", F.round(cosine(F.col("x"), F.col("y")), 6)).where(F.col("similarity") >= threshold)
    ids = rows.select("_v", "id")
    apart = met.select("u", "w", "similarity").join(ids.toDF("u", "a"), "u").join(ids.toDF("w", "b"), "w").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    again = rows.join(heads.where("copies > 1").select("_v", "head"), "_v").select("_v", "id", "head")
    same = again.select("_v", F.col("id").alias("a")).join(again.select("_v", F.col("id").alias("b")), "_v").where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    return apart.unionByName(same)


def _dealt(vectors: DataFrame, by: str, apart: str, block: int, more: tuple[str, ...] = ()) -> DataFrame:
    """(_by, lo, hi, second, _apart, id, vector, more) of vectors that are not null or zero: each two blocks lo <= hi of a
    group with their vectors, the second's marked."""
    rows = vectors.where(F.col("vector").isNotNull()).where(dot(F.col("vector"), F.col("vector")) > 0)
    rows = rows.select(F.col(by).alias("_by"), F.coalesce(F.xxhash64(apart), F.lit(0)).alias("_apart"), "id", F.col("vector").cast("array<double>").alias("vector"), *more)
    sizes = rows.groupBy("_by").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    own, other = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = rows.join(sizes.withColumnRenamed("_by", "_of"), F.col("_by").eqNullSafe(F.col("_of"))).withColumns({"own": own, "other": other})
    return dealt.select("_by", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("second"), "_apart", "id", "vector", *more)


def _blocks(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """The rows of two blocks in the order of ids, their unit vectors in that order, the places of either block, and whether they are two."""
    ids = table["id"].to_pylist()
    order = np.array(sorted(range(len(ids)), key=ids.__getitem__), dtype=np.int64)  # places stand for ids from here on
    vector = table["vector"].combine_chunks()
    x = vector.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order]
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    second = table["second"].to_numpy(zero_copy_only=False)[order]
    across = table["lo"][0].as_py() != table["hi"][0].as_py()
    left, right = (np.flatnonzero(~second), np.flatnonzero(second)) if across else (np.arange(len(ids)),) * 2
    return order, x, left, right, across


def _pairs_of(table: pa.Table, order: np.ndarray, by: str, a: np.ndarray, b: np.ndarray, similarity: np.ndarray) -> pa.Table:
    back = lambda k: table["id"].take(pa.array(order[k]))
    group = table["_by"].take(pa.array(np.zeros(len(a), np.int64)))
    return pa.table([group, back(a), back(b), pa.array(similarity)], names=[by, "a", "b", "similarity"])


def _compared(dealt: DataFrame, by: str, run: Callable[[pa.Table], pa.Table]) -> DataFrame:
    kinds = dict(dealt.dtypes)
    return dealt.groupBy("_by", "lo", "hi").applyInArrow(run, f"`{by}` {kinds['_by']}, a {kinds['id']}, b {kinds['id']}, similarity double")


def top_pairs(vectors: DataFrame, threshold: float, most: int, by: str, apart: str, block: int = BLOCK) -> DataFrame:
    """(by, a, b, similarity) with a < b: of each group the `most` most similar pairs, by ids on ties, with a cosine of at least threshold.

    Vectors: (id, vector, by, apart); rows with the same `apart`, null too, make no pair, nor do null and zero vectors. The
    result is exact: all pairs are compared, in single precision first, and those within its error of the least similarity
    that still counts in double. Each two blocks of a group are a task's work and give `most` pairs at most, so memory and
    output stay bounded whatever the vectors; products grow with the square of a group, a block is sent once for each other."""
    dealt = _dealt(vectors, by, apart, block)

    def compared(table: pa.Table) -> pa.Table:
        order, x, left, right, across = _blocks(table)
        small, of = x.astype(np.float32), table["_apart"].to_numpy()[order]
        least, held = threshold, (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for i in range(0, len(left), TILE):
            for j in range(0 if across else i, len(right), TILE):
                p, q = left[i : i + TILE], right[j : j + TILE]
                u, w = np.nonzero(small[p] @ small[q].T >= least - SLACK)
                u, w = p[u], q[w]
                a, b = np.minimum(u, w), np.maximum(u, w)
                keep = (of[a] != of[b]) if across else (u < w) & (of[a] != of[b])
                a, b = a[keep], b[keep]
                for k in range(0, len(a), 1 << 16):
                    c, d = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                    sim = np.round((x[c] * x[d]).sum(axis=1), 6)
                    c, d, sim = (np.concatenate([z, y[sim >= least]]) for z, y in zip((held[1], held[2], held[0]), (c, d, sim), strict=True))
                    first = np.lexsort((d, c, -sim))[:most]
                    held = sim[first], c[first], d[first]
                    if len(first) == most:
                        least = float(held[0][-1])
        return _pairs_of(table, order, by, held[1], held[2], held[0])

    return best_pairs(_compared(dealt, by, compared), by, most)


def linking_pairs(vectors: DataFrame, threshold: float, by: str, apart: str, more: tuple[str, ...] = (), excluding: Callable[[pa.Table], Callable] | None = None, block: int = BLOCK) -> DataFrame:
    """(by, a, b, similarity) with a < b: pairs of a group with a cosine of at least threshold that link just what all such
    pairs link, the most similar of each component among them.

    Vectors as for top_pairs, with columns `more`. `excluding` is given these columns of a task's rows and returns a
    function of two arrays of places in them: the pairs that do not count. The result is exact: all pairs are compared, in
    single precision first; those that could link two trees of the task's forest or raise the highest similarity of one, in
    double. A task gives this forest and the best pair of each tree, under 3 pairs for 2 vectors however many are alike."""
    dealt = _dealt(vectors, by, apart, block, more)

    def compared(table: pa.Table) -> pa.Table:
        order, x, left, right, across = _blocks(table)
        small, of, n = x.astype(np.float32), table["_apart"].to_numpy()[order], len(order)
        out = excluding(table.select(list(more)).take(pa.array(order))) if excluding else lambda a, b: np.zeros(len(a), bool)
        tree, top, best, links = np.arange(n), np.full(n, -np.inf), {}, {}  # by vector its tree; by tree the highest similarity and its pair
        mixed, step = np.random.default_rng(5), max(1, (1 << 22) // x.shape[1])

        def root(k: int) -> int:
            while tree[k] != k:
                tree[k] = k = int(tree[tree[k]])
            return k

        def link(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> None:
            nonlocal tree
            for c, d, s in zip(a.tolist(), b.tolist(), sim.tolist(), strict=True):
                u, w = root(c), root(d)
                if u != w:
                    tree[w], links[c, d] = u, s
                    if top[w] > top[u]:
                        top[u], best[u] = top[w], best[w]
                    best.pop(w, None)
                if s > top[u]:
                    top[u], best[u] = s, (c, d)
            while ((up := tree[tree]) != tree).any():
                tree = up

        for i in range(0, len(left), TILE):
            for j in range(0 if across else i, len(right), TILE):
                p, q = left[i : i + TILE], right[j : j + TILE]
                product = small[p] @ small[q].T
                met = product >= threshold - SLACK
                if not met.any():
                    continue
                # Nothing is above 1 after rounding.
                met &= (tree[p][:, None] != tree[q]) | (product > np.where(top < 1, top - SLACK, np.inf)[tree[p]][:, None])
                u, w = np.nonzero(met)
                u, w = p[u], q[w]
                a, b = np.minimum(u, w), np.maximum(u, w)
                keep = (of[a] != of[b]) if across else (u < w) & (of[a] != of[b])
                a, b = a[keep], b[keep]
                keep = ~out(a, b)
                a, b = a[keep], b[keep]
                if len(a) > step:  # mixed, so that the first part links most of what the rest would
                    at = mixed.permutation(len(a))
                    a, b = a[at], b[at]
                while len(a):
                    c, d, a, b = a[:step], b[:step], a[step:], b[step:]
                    sim = np.round((x[c] * x[d]).sum(axis=1), 6)
                    u, w = np.minimum(tree[c], tree[d]), np.maximum(tree[c], tree[d])
                    counts = np.flatnonzero((sim >= threshold) & ((u != w) | (sim > top[u])))
                    counts = counts[np.argsort(-sim[counts], kind="stable")]
                    counts = counts[np.sort(np.unique(u[counts] * n + w[counts], return_index=True)[1])]  # the best of each two trees
                    link(c[counts], d[counts], sim[counts])
                    keep = (tree[a] != tree[b]) | (top[tree[a]] < 1)
                    a, b = a[keep], b[keep]
        links.update({pair: float(top[k]) for k, pair in best.items()})
        a, b = np.array(list(links), dtype=np.int64).reshape(-1, 2).T
        return _pairs_of(table, order, by, a, b, np.array(list(links.values()), dtype=np.float64))

    return _compared(dealt, by, compared)


def best_pairs(pairs: DataFrame, by: str, most: int) -> DataFrame:
    """The `most` most similar pairs of each group."""
    order = W.partitionBy(by).orderBy(F.desc("similarity"), "a", "b")
    return pairs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
