"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a bounded run of documents within a task. Only stretches of words that benchmark windows
use, at least as long as the shortest window, can hold an occurrence, so a shard's FM-index is built
over those stretches: suffix array by prefix doubling, Burrows-Wheeler transform, a wavelet tree (in
the level-wise matrix layout) for ranks, and suffix positions sampled each SAMPLE symbols. All windows
are searched backward at once, located, mapped to items and merged to spans of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atheneum.llm.common import apart, raw, table, words_of, written

WINDOW = 13
#: A shard ends at so many bytes of text.
SHARD_BYTES = 16 << 20
#: Benchmark text that one pass over the documents searches; more is searched in further passes.
PASS_BYTES = 16 << 20
SAMPLE = 8

def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling: ranks of 1, 2, 4, ... symbols until all differ. text ends with a unique smallest symbol."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        after = np.full(n, -1, dtype=np.int64)
        after[: n - k] = rank[k:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = step
        k *= 2
        if step[-1] == n - 1 or k >= n:
            return order


class FMIndex:
    """Backward search over an array of integers from 1 up; 0 is the end mark that it adds."""

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        text = np.append(text, 0).astype(np.int64)
        self.n, order = len(text), suffix_array(text)
        bwt = text[order - 1]
        self.bwt = bwt
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        self.levels = []
        row = bwt
        for bit in range(max(1, int(sigma).bit_length()) - 1, -1, -1):
            b = (row >> bit) & 1
            ones = np.concatenate([[0], np.cumsum(b)]).astype(np.int32)
            zeros = self.n - int(ones[-1])
            self.levels.append((bit, ones, zeros))
            row = np.concatenate([row[b == 0], row[b == 1]])
        self.base = np.zeros(sigma + 1, dtype=np.int64)
        self.base = self.rank(np.arange(sigma + 1), np.zeros(sigma + 1, dtype=np.int64))  # where each symbol's run starts on the last level
        sampled = order % SAMPLE == 0
        self.sampled = sampled
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = order[sampled]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol stands in the first i of the transform."""
        for bit, ones, zeros in self.levels:
            r = ones[i]
            i = np.where((symbol >> bit) & 1, zeros + r, i - r)
        return i - self.base[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the patterns, which stand right-aligned in their rows."""
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        for step in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= step) & (lo < hi))
            if not len(live):
                break
            c = patterns[live, -step]
            lo[live] = self.before[c] + self.rank(c, lo[live])
            hi[live] = self.before[c] + self.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps back to a sampled one."""
        at, rows = np.zeros(len(rows), dtype=np.int64), rows.copy()
        live = np.arange(len(rows))
        while len(live):
            found = self.sampled[rows[live]]
            done = live[found]
            at[done] += self.samples[self.sample_rank[rows[done]]]
            live = live[~found]
            c = self.bwt[rows[live]]
            rows[live] = self.before[c] + self.rank(c, rows[live])
            at[live] += 1
        return at


class Windows:
    """The distinct windows of benchmark items, as rows of word numbers, and the items of each."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> None:
        self.vocab: dict[bytes, int] = {}
        self.window = window
        found: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 2) for w in words_of(text)]  # 1 separates stretches
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[k : k + window]), set()).add(item)
        self.lengths = np.array([len(k) for k in found], dtype=np.int64)
        self.patterns = np.zeros((len(found), window), dtype=np.int64)
        for row, k in enumerate(found):
            self.patterns[row, window - len(k) :] = k
        self.names = sorted({i for s in found.values() for i in s if i is not None})
        number = {i: k for k, i in enumerate(self.names)}
        self.items = [np.array([number[i] for i in s if i is not None], dtype=np.int64) for s in found.values()]
        self.shortest = int(self.lengths.min()) if found else 0

    def search(self, texts: list[bytes | None]) -> list[tuple[int, int, list[tuple[int, int]], list[str]]]:
        """For each text: words, hit words, merged spans [start, end) in words, and items that occur."""
        counts, stretches, starts = [], [], []
        get = self.vocab.get
        for k, text in enumerate(texts):
            ws = words_of(text)
            counts.append(len(ws))
            if not self.shortest or len(ws) < self.shortest:
                continue
            ids = np.array([get(w, 0) for w in ws], dtype=np.int64)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]]).astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a >= self.shortest:
                    starts.append((k, a, b - a))
                    stretches += [ids[a:b], np.ones(1, dtype=np.int64)]
        out: list = [(n, 0, [], []) for n in counts]
        if not starts:
            return out
        index = FMIndex(np.concatenate(stretches), len(self.vocab) + 1)
        lo, hi = index.search(self.patterns, self.lengths)
        which = np.flatnonzero(hi > lo)
        if not len(which):
            return out
        size = hi[which] - lo[which]
        window = np.repeat(which, size)
        rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[which], size)
        at = index.locate(rows)
        begin = np.concatenate([[0], np.cumsum([n + 1 for _, _, n in starts])])
        of = np.searchsorted(begin, at, side="right") - 1
        depth = np.zeros(index.n + 1, dtype=np.int64)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + self.lengths[window], -1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(depth) > 0, [0]]).astype(np.int8)))
        text_of = np.array([k for k, _, _ in starts])
        for k, w in set(zip(text_of[of].tolist(), window.tolist(), strict=True)):
            out[k][3].extend(self.items[w].tolist())
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            s = int(np.searchsorted(begin, a, side="right")) - 1
            k, first, _ = starts[s]
            out[k][2].append((first + a - int(begin[s]), first + b - int(begin[s])))
        return [(n, sum(b - a for a, b in spans), spans, [self.names[i] for i in sorted(set(items))]) for n, _, spans, items in out]


def _passes(benchmark: DataFrame) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The benchmark's items in lists of at most PASS_BYTES or one item, one list at least; the driver holds a list at a time."""
    held, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        data = (text or "").encode()
        if size and size + len(data) > PASS_BYTES:
            yield held
            held, size = [], 0
        held.append((item, data))
        size += len(data)
    yield held


FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def find_windows(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The columns `keep` of docs, with n_words, spans (merged spans of hit words) and items (names, sorted).

    benchmark: item_id, text. Null texts have no words; an item without words has no window. A null
    item_id hits words but is never named; equal items count once. Empty tables give no rows or no hits.
    A kept column named n_words, spans or items comes out with `_in` behind it. Texts of any length are read whole.
    Benchmarks over PASS_BYTES are searched in several passes, whose findings are stored and merged.
    """
    kept, old = T._parse_datatype_string(FOUND), keep
    given = apart(docs.select(*keep), "n_words", "spans", "items", "_searched", "_found")
    keep = given.columns
    if text_col in old:  # a kept text is not sent twice
        given, text = docs.select(*old).toDF(*keep), keep[old.index(text_col)]
    else:
        given, text = docs.select(*old, F.col(text_col)).toDF(*keep, "_searched"), "_searched"

    def searched(df: DataFrame, items: list) -> DataFrame:
        windows = Windows(items, window)
        sent = df.sparkSession.sparkContext.broadcast(windows)
        names = df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
                whole = pa.Table.from_batches(held).combine_chunks()
                found = sent.value.search(raw(whole.column(text).combine_chunks()))
                old = whole.column("_found").to_pylist() if "_found" in names else [None] * len(found)
                merged = []
                for (n, _, spans, got), was in zip(found, old, strict=True):
                    if was:
                        spans = _union(spans + [(s["start"], s["end"]) for s in was["spans"]])
                        got = sorted({*got, *was["items"]})
                    merged.append({"n_words": n, "spans": [{"start": a, "end": b} for a, b in spans], "items": got})
                cols = [whole.column(c).combine_chunks() for c in names if c != "_found"] + [pa.array(merged, type=ARROW)]
                return pa.RecordBatch.from_arrays(cols, names=[c for c in names if c != "_found"] + ["_found"])

            held, size = [], 0
            for b in batches:
                for k in range(0, b.num_rows, 256):
                    part = b.slice(k, 256)
                    held.append(part)
                    size += sum(len(t or b"") for t in raw(part.column(names.index(text))))
                    if size >= shard_bytes:
                        yield out(held)
                        held, size = [], 0
            if held:
                yield out(held)

        shape = T.StructType([f for f in df.schema.fields if f.name != "_found"] + [T.StructField("_found", kept)])
        return df.mapInArrow(run, shape)

    for k, items in enumerate(_passes(benchmark)):
        given = searched(written(given, "searched") if k else given, items)  # no task holds the windows of two passes
    return given.select(*keep, "_found.n_words", "_found.spans", "_found.items")


ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def verdict(found: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated: at least one word in twenty is hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdict(find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"]))
    names = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
       FROM b, unnest(range(1, len(w) - least(len(w), 13) + 2)) t(i) WHERE len(w) > 0),
s AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, s, unnest(range(1, len(w) - n + 2)) t(i) WHERE len(w) >= n),
hit AS (SELECT r, item_id, n, i FROM dw JOIN bw USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) t(p) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
