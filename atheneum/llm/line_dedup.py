"""Fuzzy line deduplication by MinHash.

A line is stripped and lower-cased; its shingles are the SHINGLE characters from each character on (a
shorter line is one shingle). Signatures are least values of HASHES permutations of the shingles'
hashes, made in Arrow batches; BANDS bands of ROWS values are the buckets in which lines meet. At
Jaccard similarity 0.8 a pair of lines shares a band with a probability over 0.998. Pairs that meet
are verified by the exact Jaccard similarity of their shingles, and links are joined by distributed
union-find.

Buckets are combined within runs of lines before they are shuffled. Within a task, all pairs of a
bucket that no link joins yet are compared: first by signature (under AGREE equal values: not alike),
then exactly; a task leaves a spanning forest of links, never pairs. A bucket over BLOCK lines first
meets its lead, and only if that leaves several components its blocks meet, a pair of blocks a task.
So every pair that shares a bucket is decided or joined by other links.

Not native: with DataFrame functions alone, signatures of a sixth of the shingles took more CPU time
than the limit allows (README).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atheneum.llm.common import apart, components, lookup, raw, table, written

SHINGLE = 8
ROWS, BANDS = 4, 12
HASHES = ROWS * BANDS
SIMILARITY = 0.8
#: Equal values of two signatures below which lines are not compared exactly: at similarity 0.8 once in 500 pairs.
AGREE = 30
#: Buckets are split into blocks of about so many lines or characters, and each pair of blocks meets in one place.
BLOCK, BLOCK_CHARS = 2048, 4 << 20
#: Keys of lines are broadcast up to so many (8 bytes each), beyond they are joined by a shuffle.
BROADCAST_KEYS = 2_000_000
#: Characters of text that a run of lines holds, and that are hashed at once.
RUN_CHARS, CACHE_CHARS = 1 << 20, 1 << 15
_RANDOM = np.random.default_rng(5)
_TIMES = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_PLUS = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def lines_of(text: bytes | None) -> list[str]:
    """The stripped, lower-cased lines of a text; blank ones are empty."""
    return [x.strip().lower() for x in (text or b"").decode("utf-8", "replace").split("\n")]


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of non-empty lines in a row, and where each line's start."""
    codes = np.frombuffer("".join(x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = np.fromiter((max(len(x), SHINGLE) for x in lines), np.int64, len(lines))
    h, step = codes.astype(np.uint64) * _PRIME, 1
    while step < SHINGLE:
        h = (h[:-step] ^ (h[:-step] >> np.uint64(31))) * _PRIME + h[step:]
        step *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    inside = np.ones(len(codes), dtype=bool)
    ends = np.cumsum(sizes)
    for j in range(1, SHINGLE):
        inside[ends - j] = False
    return h[inside[: len(h)]], ends - sizes - (SHINGLE - 1) * np.arange(len(lines))


def signatures(lines: list[str]) -> np.ndarray:
    """A row of HASHES least values for each non-empty line."""
    out = np.empty((len(lines), HASHES), dtype=np.uint32)
    k = 0
    while k < len(lines):
        n, size = k, 0
        while n < len(lines) and (n == k or size + len(lines[n]) <= CACHE_CHARS):
            size += len(lines[n])
            n += 1
        h, starts = shingle_hashes(lines[k:n])
        x = (h >> np.uint64(32)).astype(np.uint32)
        for j in range(HASHES):
            out[k:n, j] = np.minimum.reduceat(x * _TIMES[j] + _PLUS[j], starts)
        k = n
    return out


def _bands(signed: np.ndarray) -> np.ndarray:
    """The buckets of each signature."""
    m = signed.reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x94D049BB133111EB) + np.uint64(1)
    for j in range(ROWS):
        h = (h ^ (h >> np.uint64(32)) ^ m[:, :, j]) * _PRIME
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _key(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)


def _runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
    """Runs of rows with about RUN_CHARS of text, and their lines."""
    for b in batches:
        texts, start, size, held = raw(b.column(column)), 0, 0, []
        for k, t in enumerate(texts):
            held.append(lines_of(t))
            size += len(t or b"")
            if size >= RUN_CHARS:
                yield b.slice(start, k + 1 - start), held
                start, size, held = k + 1, 0, []
        if held:
            yield b.slice(start), held


def _lines(rows: DataFrame) -> DataFrame:
    """(_id, _row, _no, _key, bands, leads) of all lines that are not blank.

    bands are null for a line that its run has signed before; leads, null where they are
    all the line itself, are the first lines of the run in each of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _runs(batches, 2):
            of, no, keys, new, place = [], [], [], [], []
            seen: dict[str, int] = {}
            for k, lines in enumerate(texts):
                for j, x in enumerate(lines):
                    if x:
                        if x not in seen:
                            seen[x] = _key(x)
                            new.append(x)
                            place.append(len(keys))
                        of.append(k)
                        no.append(j)
                        keys.append(seen[x])
            if not keys:
                continue
            key = np.array(keys, dtype=np.uint64).view(np.int64)
            bands, own = _bands(signatures(new)), key[place]
            _, first, which = np.unique(bands.reshape(-1), return_index=True, return_inverse=True)
            leads = own[first // BANDS][which.reshape(-1)].reshape(bands.shape)
            led = (leads != own[:, None]).any(axis=1)
            at = np.full(len(keys), -1)
            at[place] = np.arange(len(new))
            at = at.tolist()
            cols = [
                b.column(0).take(pa.array(of)), b.column(1).take(pa.array(of)), pa.array(np.array(no, np.int32)), pa.array(key),
                pa.array([None if x < 0 else bands[x] for x in at], pa.list_(pa.int64())), pa.array([None if x < 0 or not led[x] else leads[x] for x in at], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["_id", "_row", "_no", "_key", "bands", "leads"])

    fields = [rows.schema["_id"], *T._parse_datatype_string("_row long, _no int, _key long, bands array<long>, leads array<long>").fields]
    return rows.mapInArrow(run, T.StructType(fields))


def _texts(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, line) of each line of keys (key)."""
    n = keys.count()
    sent = None
    if n <= BROADCAST_KEYS:
        sent = rows.sparkSession.sparkContext.broadcast(np.sort(keys.toArrow().column("key").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _runs(batches, 2):
            new = list({x: None for lines in texts for x in lines if x})
            key = np.array([_key(x) for x in new], dtype=np.uint64).view(np.int64)
            if sent is not None:
                wanted = sent.value
                if not len(wanted) or not len(key):
                    continue
                at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key)
                key, new = key[at], [new[k] for k in at]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(new, pa.string())], names=["key", "line"])

    found = rows.mapInArrow(run, "key long, line string")
    return (found if sent is not None else found.join(keys, "key", "left_semi")).dropDuplicates(["key"])


def jaccard(ones: list[str], twos: list[str]) -> np.ndarray:
    """The Jaccard similarity of the shingle sets of ones[k] and twos[k]."""
    n, both = len(ones), []
    for lines in (ones, twos):
        h, starts = shingle_hashes(lines)
        of = np.repeat(np.arange(n), np.diff(np.append(starts, len(h))))
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        both.append((h[new], of[new]))
    h, of = (np.concatenate([x[k] for x in both]) for k in range(2))
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    shared = np.bincount(of[1:][(h[1:] == h[:-1]) & (of[1:] == of[:-1])], minlength=n)
    return shared / (np.bincount(of, minlength=n) - shared)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (u, v) of pairs (a, b) whose lines in texts (key, line) have Jaccard similarity SIMILARITY or more."""
    both = pairs.join(texts.toDF("a", "one"), "a").join(texts.toDF("b", "two"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ones, twos = b.column(2).to_pylist(), b.column(3).to_pylist()
            start = size = 0
            for k in range(len(ones)):
                size += len(ones[k]) + len(twos[k])
                if size >= RUN_CHARS or k == len(ones) - 1:
                    good = np.flatnonzero(jaccard(ones[start : k + 1], twos[start : k + 1]) >= SIMILARITY - 1e-9) + start
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(good)), b.column(1).take(pa.array(good))], names=["u", "v"])
                    start, size = k + 1, 0

    return both.select("a", "b", "one", "two").mapInArrow(run, "u long, v long")


def _sets(lines: list[str]) -> list[np.ndarray]:
    """The sorted shingle hashes of each line."""
    h, starts = shingle_hashes(lines)
    of = np.repeat(np.arange(len(lines)), np.diff(np.append(starts, len(h))))
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return np.split(h[new], np.flatnonzero(np.diff(of[new])) + 1)


def _forest(own: np.ndarray, label: np.ndarray, signed: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], band: int) -> list[tuple[int, int]]:
    """Links that join all similar lines of one bucket, or of two blocks (own) of it; a pair is left to the first bucket that it shares."""
    n, out = len(own), []
    comp = np.unique(label, return_inverse=True)[1]
    which = int(np.flatnonzero(bands[0] == band)[0])
    apart = len(set(own.tolist())) > 1
    for r in range(n - 1):
        rest = np.arange(r + 1, n)
        rest = rest[(comp[rest] != comp[r]) & ((own[rest] != own[r]) if apart else True)]
        if not len(rest):
            continue
        rest = rest[(signed[rest] == signed[r]).sum(axis=1) >= AGREE]
        for c in rest[~(bands[rest, :which] == bands[r, :which]).any(axis=1)].tolist():
            if comp[c] == comp[r]:
                continue
            a, b = sets[r], sets[c]
            shared = np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b)
            if shared >= SIMILARITY * (len(a) + len(b) - shared) - 1e-9:
                out.append((r, c))
                comp[comp == comp[c]] = comp[r]
    return out


def _linked(rows: DataFrame) -> DataFrame:
    """Links (u, v) among rows (band, i, j, own, label, key, line), whose groups (band, i, j) are a bucket or two blocks of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(b: pa.Table) -> pa.RecordBatch:
            lines = b.column("line").to_pylist()
            cols = [b.column(c).to_numpy() for c in ("band", "i", "j", "own", "label", "key")]
            signed, sets, u, v = signatures(lines), _sets(lines), [], []
            bands = _bands(signed)
            edge = np.flatnonzero(np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1]), [True]]))
            for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                for p, q in _forest(cols[3][x:y], cols[4][x:y], signed[x:y], bands[x:y], sets[x:y], cols[0][x]):
                    u.append(cols[5][x + p])
                    v.append(cols[5][x + q])
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        held, size = [], 0
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                held.append(part)
                size += part.column(6).nbytes
                if size < RUN_CHARS:
                    continue
                whole = pa.Table.from_batches(held).combine_chunks()
                cols = [whole.column(c).to_numpy() for c in ("band", "i", "j")]
                other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
                cut = int(other[-1]) + 1 if len(other) else 0
                if cut:
                    yield out(whole.slice(0, cut))
                rest = whole.slice(cut)
                held = rest.to_batches()
                size = int(rest.column("line").nbytes) if cut else 0
        if held and sum(h.num_rows for h in held):
            yield out(pa.Table.from_batches(held))

    rows = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "own")
    return rows.select("band", "i", "j", "own", "label", "key", "line").mapInArrow(run, "u long, v long")


def line_groups(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """(_key, label, n) of lines that occur twice or more or are linked to another; label names the component."""
    counts = written(lines.groupBy(F.col("_key").alias("key")).agg(F.count("*").alias("n")).where("n > 1"), "counts")
    each = lines.where("bands is not null").select(F.col("_key").alias("key"), F.explode(F.arrays_zip("bands", F.coalesce("leads", F.array_repeat("_key", BANDS)).alias("leads"))).alias("x"))
    each = each.select(F.col("x.bands").alias("band"), F.col("x.leads").alias("lead"), "key")
    # Lines that their run led, and the leads of all runs by the least of them.
    first = F.first("key").over(W.partitionBy("band").orderBy("key"))
    least = each.where("lead = key").select("band", first.alias("lead"), "key").where("lead <> key")
    met = written(least.unionByName(each.where("lead <> key").select(least.columns)).distinct(), "buckets")
    every = met.select("band", "key").unionByName(met.select("band", F.col("lead").alias("key"))).distinct()
    texts = written(_texts(rows, written(every.select("key").distinct(), "candidates")), "texts")
    sizes = every.join(texts.select("key", F.length("line").alias("chars")), "key").groupBy("band").agg(F.count("*").alias("size"), F.sum("chars").alias("chars"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("int")
    every = written(every.join(sizes.select("band", blocks.alias("blocks")), "band"), "members")
    small = every.where("blocks = 1").select("band", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), F.col("key").alias("label"), "key")
    large = every.where("blocks > 1")
    links = None
    if not large.isEmpty():
        star = met.join(large.select("band").distinct(), "band", "left_semi").select("lead", "key")
        star = star.unionByName(star.join(star.toDF("first", "lead"), "lead").select(F.col("first").alias("lead"), "key"))  # a run's lead's lead too
        star = star.where("lead <> key").select(F.least("lead", "key").alias("a"), F.greatest("lead", "key").alias("b")).distinct()
        links = written(_verified(star, texts), "links")
        labels = written(components(links, "lines"), "labels")
        of = large.join(labels, F.col("key") == F.col("node"), "left").select("band", "key", "blocks", F.coalesce("label", "key").alias("label"))
        several = of.groupBy("band").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p < q").select("band")
        own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
        of = of.join(several, "band").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        small = small.unionByName(of.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "label", "key"))
    found = _linked(small.join(texts, "key"))
    links = written(found if links is None else found.unionByName(links), "links")
    labels = written(components(links, "lines"), "labels")
    found = counts.join(labels, F.col("key") == F.col("node"), "full_outer")
    key = F.coalesce("key", "node")
    return found.select(key.alias("_key"), F.coalesce("label", key).alias("label"), F.coalesce("n", F.lit(1)).alias("n"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_lines, dropped_lines (numbers from 0, sorted) and text without those lines.

    Of each component of similar lines one occurrence stays: the least by id (null first), a hash of
    the row, and line number. Blank lines always stay. Null text has one (blank) line and stays null.
    Lines of any length are read whole. Lines are told apart by 64-bit hashes: of n different lines,
    n^2 / 2^65 pairs are expected to be taken for equal. Repeated rows keep or drop the same lines. An
    empty table gives no rows. A column of docs with an added column's name comes out with `_in` behind it.
    """
    docs = apart(docs, "n_lines", "dropped_lines", "_row")
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(id_col, text_col).alias("_row"), F.col(text_col).alias("_text"))
    lines = written(_lines(rows), "signed")
    groups = written(line_groups(lines, rows), "groups")
    sizes = groups.groupBy("label").agg(F.sum("n").alias("size"))
    n = groups.agg(F.sum("n")).first()[0] or 0
    occurrences = written(lookup(lines.select("_id", "_row", "_no", "_key"), groups, "_key", "n", n), "occurrences")
    first = occurrences.groupBy("label").agg(F.min(F.struct("_id", "_row", "_no")).alias("first")).join(sizes, "label")
    placed = lookup(occurrences, written(first, "first"), "label", "size", n)
    dropped = placed.where(~F.struct("_id", "_row", "_no").eqNullSafe(F.col("first")))
    dropped = dropped.groupBy("_row").agg(F.array_sort(F.collect_set("_no")).alias("dropped_lines"))
    out = docs.withColumn("_row", F.xxhash64(id_col, text_col)).join(dropped, "_row", "left")
    none = F.array().cast("array<int>")
    split = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("dropped_lines", i)), "\n")
    return out.select(
        *(c for c in docs.columns if c != text_col), F.coalesce(F.size(split), F.lit(1)).cast("long").alias("n_lines"),
        F.coalesce("dropped_lines", none).alias("dropped_lines"), F.when(F.col("dropped_lines").isNull(), F.col(text_col)).otherwise(kept).alias(text_col),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = F.transform("dropped_lines", lambda x: x.cast("string"))
    return out.select("doc_id", "n_lines", F.size("dropped_lines").cast("long").alias("n_dropped"), F.array_join(lines, ",").alias("dropped_lines"))
