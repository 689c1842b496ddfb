"""Scoring documents with a Katz backoff model learnt from the corpus itself.

Order two: P(w | h) is the Good-Turing discounted share of (h, w) among what follows h, or, where the
pair was never seen, alpha(h) times P(w); P(w) backs off in the same way from seen words to unseen
ones. alpha(h) is the mass that discounting left at h over the unigram mass of what never followed h,
so every context sums to one. Counts of counts are smoothed by a log-linear fit (Gale and Sampson
1995), so the discounts are valid for every corpus.

The model has no classes or thresholds: only the way to it differs. Of at most FREQUENT words (the
most frequent ones) numbers and counts are broadcast, and their pairs take the packed way below. Pairs
with any other word are rows of (context, word, document) that are counted, given the counts of their
words and summed by joins on 64-bit hashes.

Tables: word counts by hash; pair counts by a hash of the context (of the pair for the HOT most
frequent contexts). Pair occurrences are shuffled once, as compressed blocks of (pair, document,
count) for a part of the pairs; a part's task counts, evaluates all that needs no global number and
leaves, for each document, how often each discount and each alpha applies. Until the sums of a run of
documents meet, a document is its run's number and its place there, which shrinks to about a byte;
its key, a hash that does not shrink, travels once for each run and not with each part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from atheneum.llm.common import raw, table, written

FREQUENT = 1 << 20
HOT = 1024
#: Good-Turing discounts apply to counts up to this.
K = 5
#: The flattest slope of counts of counts that is taken as it is.
FLATTEST = -1.2
#: Hashes that stand for the start and the end of a document; no word has a blank.
START, END = (np.uint64(xxhash.xxh64_intdigest(x)).astype(np.int64).item() for x in (b" start", b" end"))
PART_TOKENS = 2_000_000
BUCKET_DOCS = 8192
BATCH_BYTES = 3 << 20
_SHIFT = 22  # bits of a word number
_PLACE = 16  # bits of a document's place in its run; above are the run's number in its task and the task's


def tokens(text: bytes | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased; the end token is left to the caller."""
    return (text or b"").lower().split()


def discounts(n: list[int], k: int = K) -> np.ndarray:
    """Katz's discounts d_1 .. d_k, all within (0, 1), from the counts of counts n_1 .. n_(k+1).

    Good-Turing counts r* = (r + 1) N(r + 1) / N(r), where N is the line fitted to log n_r over log r.
    Its slope has to be under -1; FLATTEST stands for flatter ones, and for fewer than two points."""
    seen = [(math.log(r + 1), math.log(x)) for r, x in enumerate(n[: k + 1]) if x > 0]
    slope = FLATTEST
    if len(seen) > 1:
        x, y = np.array(seen).T
        slope = min(FLATTEST, float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()))
    r = np.arange(1, k + 1)
    a = (k + 1) ** (slope + 1)
    return ((1 + 1 / r) ** (slope + 1) - a) / (1 - a)


class Unigrams:
    """The frequent words (hash, count), a number for any other word, start and end, and P of each."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n: list[int], total: int, docs: int, types: int) -> None:
        order = np.lexsort((hashes, -counts))
        hashes, counts = hashes[order], counts[order]
        self.sort = np.argsort(hashes)
        self.hashes = hashes[self.sort]
        f = len(hashes)
        self.rare, self.start, self.end, self.size = f, f + 1, f + 2, f + 3
        #: Words in training, ends included, and their types.
        self.total, self.types, self.docs = total + docs, types + (docs > 0), docs
        n = list(n)
        if 0 < docs <= K + 1:
            n[docs - 1] += 1
        self.d = discounts(n)
        self.counts = np.concatenate([counts, [total - counts.sum(), docs, docs]]).astype(np.int64)
        seen = np.append(counts, docs).astype(np.float64)
        low = self.d[np.clip(seen.astype(np.int64), 1, K) - 1]
        #: What seen words, frequent and rare, have after discounts leaves the mass of unseen ones; where
        #: nothing is discounted, one unseen word more is counted.
        left = sum((1 - self.d[r - 1]) * r * n[r - 1] for r in range(1, K + 1))
        self.norm = max(1, self.total) if left > 0 else self.total + 1
        share = np.where(seen <= K, low, 1.0) * seen / self.norm
        self.unseen_mass = (left if left > 0 else 1.0) / self.norm
        self.unseen = self.unseen_mass / max(1, n[0])
        self.p = np.zeros(self.size)
        self.p[:f], self.p[self.end] = share[:-1], share[-1]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of hashed words, start and end."""
        out = np.full(len(hashes), self.rare)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == hashes, self.sort[at], out)
        out[hashes == START], out[hashes == END] = self.start, self.end
        return out

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and hashes of words; all but frequent ones have the number `rare`."""
        h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words)).view(np.int64)
        if not len(self.hashes):
            return np.full(len(h), self.rare), h
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.sort[at], self.rare), h


def pack(*arrays: np.ndarray) -> bytes:
    """Integer or float arrays by byte planes, compressed; sorted int64 arrays shrink best as differences."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(len(a).to_bytes(8, "little") + a.dtype.str.encode().ljust(4) + a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 8], "little"), np.dtype(data[at + 8 : at + 12].decode().strip())
        at += 12
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return out


def _chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Runs of rows with at most so many bytes of text, or one row."""
    for b in batches:
        texts = raw(b.column(b.schema.get_field_index(column)))
        start = size = 0
        for k, t in enumerate(texts):
            size += len(t or b"")
            if size > most and k > start:
                yield b.slice(start, k - start), texts[start:k]
                start, size = k, len(t or b"")
        if start < len(texts):
            yield b.slice(start), texts[start:]


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) of docs: the hash of each word and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts: Counter) -> pa.RecordBatch:
            h = np.fromiter((xxhash.xxh64_intdigest(w) for w in counts), dtype=np.uint64, count=len(counts)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], names=["word", "n"])

        counts: Counter = Counter()
        for _, texts in _chunks(batches, text_col, 1 << 20):
            for t in texts:
                counts.update(tokens(t))
            if len(counts) > 600_000:
                yield out(counts)
                counts = Counter()
        yield out(counts)

    return docs.select(text_col).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _number(texts: list[bytes | None], uni: Unigrams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers and hashes of all texts in a row, and the words of each text."""
    seen: dict[bytes, int] = {}
    flat: list[int] = []
    sizes = np.zeros(len(texts), dtype=np.int64)
    for k, t in enumerate(texts):
        ws = tokens(t)
        sizes[k] = len(ws)
        flat.extend([seen.setdefault(w, len(seen)) for w in ws])
    ids, hashes = uni.ids(list(seen))
    at = np.array(flat, dtype=np.int64)
    return ids[at], hashes[at], sizes


def _profile(docs: DataFrame, sent, threshold: int) -> DataFrame:  # noqa: ANN001
    """One row per document: base score of its frequent words and end, its rare words with counts, and its pairs with a rare word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni = sent.value
        base = np.log10((uni.counts + 1) / (uni.total + uni.types + 1))
        for b, texts in _chunks(batches, "_text"):
            ids, hashes, sizes = _number(texts, uni)
            ends = np.cumsum(sizes)
            of = np.repeat(np.arange(len(texts)), sizes)
            hot = ids != uni.rare
            known = np.bincount(of[hot], minlength=len(texts)) + (uni.docs > 0)
            score = np.bincount(of[hot], weights=base[ids[hot]], minlength=len(texts)) + base[uni.end]
            words, counts = [], []
            for k in range(len(texts)):
                cut = slice(ends[k] - sizes[k], ends[k])
                w, n = np.unique(hashes[cut][~hot[cut]], return_counts=True)
                words.append(w)
                counts.append(n.astype(np.int32))
            # A pair before each word and one before each end.
            at, first = np.arange(len(ids)) + of, ends + np.arange(len(texts))
            h, w, odd = np.full(len(ids) + len(texts), START), np.full(len(ids) + len(texts), END), np.zeros(len(ids) + len(texts), bool)
            w[at], odd[at] = hashes, ~hot
            inner = np.ones(len(h), bool)
            inner[first - sizes] = False
            h[inner] = w[np.flatnonzero(inner) - 1]
            odd[inner] |= odd_before(at, hot, len(h))[inner]
            which = np.repeat(np.arange(len(texts)), sizes + 1)[odd]
            h, w = h[odd], w[odd]
            order = np.lexsort((w, h, which))
            h, w, which = h[order], w[order], which[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1]) | (which[1:] != which[:-1])
            n = np.diff(np.append(np.flatnonzero(new), len(h))).astype(np.int32)
            edge = np.searchsorted(which[new], np.arange(len(texts) + 1))
            lists = [[x[edge[k] : edge[k + 1]] for k in range(len(texts))] for x in (h[new], w[new], n)]
            yield pa.RecordBatch.from_arrays([
                b.column("_key"), b.column("_id"), b.column("_held_out"), pa.array(sizes + 1), pa.array(known), pa.array(score),
                pa.array(words, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32())),
                *(pa.array(x, pa.list_(t)) for x, t in zip(lists, (pa.int64(), pa.int64(), pa.int32()), strict=True)),
            ], names=["_key", "_id", "_held_out", "n_tokens", "known", "base", "words", "counts", "before", "after", "times"])

    def odd_before(at: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
        """Of each pair's place, whether the word before it is rare."""
        out = np.zeros(n + 1, bool)
        out[at + 1] = ~hot
        return out[:n]

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"_key long, _id {kind}, _held_out boolean, n_tokens long, known long, base double, words array<long>, counts array<int>, before array<long>, after array<long>, times array<int>")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)


def _pairs(docs: DataFrame, sent, parts: int) -> DataFrame:  # noqa: ANN001
    """(part, block): for a part of the pairs of frequent words, start and end, their occurrences in a run of documents.

    In a run, documents to learn from have the first places. The first block of a run also has their keys by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni = sent.value
        run_no = TaskContext.get().partitionId() << 32
        for b, texts in _chunks(batches, "_text"):
            for k in range(0, len(texts), 1 << _PLACE):
                some = texts[k : k + (1 << _PLACE)]
                doc_keys = b.column("_key").slice(k, len(some)).to_numpy()
                learned = ~b.column("_held_out").slice(k, len(some)).to_numpy(zero_copy_only=False)
                places = np.argsort(~learned, kind="stable")
                place = np.empty(len(some), dtype=np.int64)
                place[places] = np.arange(len(some))
                ids, _, sizes = _number(some, uni)
                first = np.cumsum(sizes + 1) - sizes - 1
                h = np.full(len(ids) + len(some), uni.start, dtype=np.int64)
                w = np.full(len(h), uni.end, dtype=np.int64)
                inner = np.ones(len(h), dtype=bool)
                inner[first + sizes] = False
                w[inner] = ids
                inner[:] = True
                inner[first] = False
                h[inner] = ids
                key = ((h << _SHIFT | w) << _PLACE) | np.repeat(place, sizes + 1)
                key, n = np.unique(key[(h != uni.rare) & (w != uni.rare)], return_counts=True)
                h, pair = key >> (_SHIFT + _PLACE), key >> _PLACE
                part = (_mixed(np.where(h < HOT, pair, h << _SHIFT)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edge = np.searchsorted(part[order], np.arange(parts + 1))
                numbers, blocks = [], []
                head, once = np.array([run_no, learned.sum()], dtype=np.int64), [doc_keys[places]]
                run_no += 1 << _PLACE
                for p in np.flatnonzero(np.diff(edge)).tolist():
                    at = order[edge[p] : edge[p + 1]]
                    numbers.append(p)
                    blocks.append(pack(np.diff(pair[at], prepend=0), key[at].astype(np.uint16), n[at].astype(np.uint32), head, *once))
                    once = []
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blocks, pa.binary())], names=["part", "block"])

    return docs.select("_key", "_held_out", "_text").mapInArrow(run, "part int, block binary")


PAIRS, DOCS, CONTEXTS, BACKED, FULL, KEYS = 0, 1, 2, 3, 4, 5


def _counted(blocks: DataFrame, sent, buckets: int) -> DataFrame:  # noqa: ANN001
    """Rows (kind, at, block) of each part.

    PAIRS: the part's pair counts. CONTEXTS: of each context, its seen followers' counts over K, how
    many followers have count 1 .. K, and their unigram mass. DOCS, by bucket of documents: the sum of
    all terms that are known here and tokens of pairs seen 1 .. K times. BACKED, by
    bucket: documents, contexts that back off there and how often. FULL: the same for seen pairs of
    contexts without any count up to K in this part, whose probabilities may have to make room. KEYS,
    by bucket: a run of documents and their keys. All of a run's documents are in one bucket."""

    def bucket_of(docs: np.ndarray) -> np.ndarray:
        return (_mixed(docs >> _PLACE) % np.uint64(buckets)).astype(np.int64)

    def evaluate(held: list[bytes], part: int) -> list[tuple[int, int, bytes]]:
        uni = sent.value
        pair, doc, n, learned, out = [], [], [], [], []
        for data in held:
            d, at, c, (run_no, train), *once = unpack(data)
            pair.append(np.cumsum(d))
            doc.append(at.astype(np.int64) + run_no)
            n.append(c.astype(np.int64))
            learned.append(at < train)
            if once:
                out.append((KEYS, int(bucket_of(run_no[None])[0]), pack(run_no[None], *once)))
        pair, doc, n, learned = (np.concatenate(x) for x in (pair, doc, n, learned))
        docs, doc = np.unique(doc, return_inverse=True)
        order = np.argsort(pair, kind="stable")
        pair, doc, n, learned = pair[order], doc[order], n[order], learned[order]
        del order
        start = np.flatnonzero(np.diff(pair, prepend=-1))
        count = np.add.reduceat(n * learned, start)
        kinds = pair[start]
        h, w = kinds >> _SHIFT, kinds & ((1 << _SHIFT) - 1)
        seen = count > 0
        out.append((PAIRS, part, pack(np.diff(kinds[seen], prepend=0), count[seen])))

        contexts, ctx = np.unique(h, return_inverse=True)
        low = np.zeros((K, len(contexts)), dtype=np.int64)
        for r in range(1, K + 1):
            low[r - 1] = np.bincount(ctx[count == r], minlength=len(contexts))
        high = np.bincount(ctx, weights=np.where(count > K, count, 0), minlength=len(contexts)).astype(np.int64)
        mass = np.bincount(ctx[seen], weights=uni.p[w[seen]], minlength=len(contexts))
        next_count = int((count == K + 1).sum())
        out.append((CONTEXTS, next_count, pack(contexts, high, mass, *low)))

        of = np.repeat(np.arange(len(kinds)), np.diff(np.append(start, len(pair))))
        with np.errstate(divide="ignore"):
            known = np.where(seen, np.log10(np.maximum(count, 1) / np.maximum(1, uni.counts[h])), np.log10(np.maximum(uni.p[w], 1e-300)))
        size = len(docs)
        total = np.bincount(doc, weights=known[of] * n, minlength=size)
        uses = [np.bincount(doc, weights=n * (count[of] == r), minlength=size).astype(np.int64) for r in range(1, K + 1)]
        bucket = bucket_of(docs)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edge)).tolist():
            at = order[edge[k] : edge[k + 1]]
            out.append((DOCS, k, pack(np.diff(docs[at], prepend=0), total[at], *(u[at].astype(np.uint32) for u in uses))))
        full = low.sum(axis=0) == 0
        for kind, rows in ((BACKED, np.flatnonzero(~seen[of])), (FULL, np.flatnonzero((seen & full[ctx])[of]))):
            order = rows[np.lexsort((doc[rows], bucket[doc[rows]]))]
            edge = np.searchsorted(bucket[doc[order]], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edge)).tolist():
                at = order[edge[k] : edge[k + 1]]
                out.append((kind, k, pack(np.diff(docs[doc[at]], prepend=0), h[of[at]].astype(np.uint32), n[at].astype(np.uint32))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["kind", "at", "block"])

        part, held = None, []
        for b in batches:
            for p, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p != part and held:
                    yield out(evaluate(held, part))
                    held = []
                part = p
                held.append(block)
        if held:
            yield out(evaluate(held, part))

    return blocks.repartition("part").sortWithinPartitions("part").mapInArrow(run, "kind int, at int, block binary")


def _alphas(counted: DataFrame, uni: Unigrams, others: DataFrame, seen: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Discounts, log10 alpha of each context, and log10 of what divides seen pairs besides c(h).

    Sums over parts into arrays of at most FREQUENT + 3 contexts; blocks reach the driver one by one.
    others: blocks of what rare followers add to contexts; seen: counts of counts, 1 .. K + 1, of pairs with a rare word."""
    low, high, mass = np.zeros((K, uni.size), np.int64), np.zeros(uni.size, np.int64), np.zeros(uni.size)
    n = np.array(seen, dtype=np.int64)
    for blocks, own in ((counted, 1), (others, 0)):
        for r in blocks.where(F.col("kind") == CONTEXTS).select("at", "block").toLocalIterator():
            contexts, h, m, *ns = unpack(bytes(r.block))
            n[K] += r.at
            np.add.at(high, contexts, h)
            np.add.at(mass, contexts, m)
            for k in range(K):
                np.add.at(low[k], contexts, ns[k])
                n[k] += own * ns[k].sum()
    d = discounts(n.tolist())
    c = np.maximum(1, uni.counts).astype(np.float64)
    held = high + sum((r + 1) * d[r] * low[r] for r in range(K))
    left = 1 - held / c
    # Nothing discounted: the context counts one unseen follower more.
    full = (low.sum(axis=0) == 0) & (uni.counts > 0)
    left = np.where(uni.counts > 0, np.where(full, 1 / (c + 1), left), 1.0)
    return d, np.log10(left / np.maximum(1 - mass, 1e-12)), np.where(full, np.log10(c / (c + 1)), 0.0)


def _summed(counted: DataFrame, sent) -> DataFrame:  # noqa: ANN001
    """(_key, pairs): of each document, the log10 probability of its pairs of frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, alpha, scale = sent.value
        log_d = np.log10(d)

        def out(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
            docs, score, runs, keys = [], [], [], []
            for kind, data in held:
                if kind == KEYS:
                    run_no, k = unpack(data)
                    runs.append(run_no)
                    keys.append(k)
                    continue
                if kind == DOCS:
                    k, total, *uses = unpack(data)
                    score.append(total + sum(u * log_d[r] for r, u in enumerate(uses)))
                else:
                    k, h, n = unpack(data)
                    score.append((alpha if kind == BACKED else scale)[h] * n)
                docs.append(np.cumsum(k))
            if not docs:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.float64())], names=["_key", "pairs"])
            docs, at = np.unique(np.concatenate(docs), return_inverse=True)
            runs = np.concatenate(runs)
            order, first = np.argsort(runs), np.cumsum([0, *map(len, keys)])
            run = order[np.searchsorted(runs[order], docs >> _PLACE << _PLACE)]
            cols = [pa.array(np.concatenate(keys)[first[run] + (docs & ((1 << _PLACE) - 1))]), pa.array(np.bincount(at, weights=np.concatenate(score)))]
            return pa.RecordBatch.from_arrays(cols, names=["_key", "pairs"])

        bucket, held = None, []
        for b in batches:
            for kind, at, block in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if at != bucket and held:
                    yield out(held)
                    held = []
                bucket = at
                held.append((kind, block))
        if held:
            yield out(held)

    rows = counted.where(F.col("kind").isin(DOCS, BACKED, FULL, KEYS)).repartition("at").sortWithinPartitions("at")
    return rows.mapInArrow(run, "_key long, pairs double").groupBy("_key").agg(F.sum("pairs").alias("pairs"))


def _frequent(rows: DataFrame, sent, lookups: dict[str, str], arrays=None) -> DataFrame:  # noqa: ANN001
    """rows with, for each key column of lookups, `<key>_hot` (a frequent word, start or end) and values of those, else null.

    lookups name the values: p, or context for ch, alpha and scale, which come from arrays. No table is joined:
    frequent words are numbered by what `sent` holds, at most FREQUENT of them."""
    added = [x for key, kind in lookups.items() for x in ([f"{key}_hot boolean", "p double"] if kind == "p" else [f"{key}_hot boolean", "ch long", "alpha double", "scale double"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni = sent.value
        for b in batches:
            cols, names = list(b.columns), list(b.schema.names)
            for key, kind in lookups.items():
                number = uni.numbers(b.column(names.index(key)).to_numpy())
                hot = number != uni.rare
                values = {"p": uni.p} if kind == "p" else dict(zip(("ch", "alpha", "scale"), (uni.counts, *arrays.value[1:]), strict=True))
                cols += [pa.array(hot), *(pa.array(v[number], mask=~hot) for v in values.values())]
                names += [f"{key}_hot", *values]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    shape = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] + added)
    return rows.mapInArrow(run, shape)


def _context_blocks(contexts: DataFrame, sent) -> DataFrame:  # noqa: ANN001
    """Blocks (kind, at, block) of the frequent ones of contexts (h, low1 .., high, mass), as _counted makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni = sent.value
        for b in batches:
            number = uni.numbers(b.column(0).to_numpy())
            hot = np.flatnonzero(number != uni.rare)
            if not len(hot):
                continue
            h, high, mass, *low = (b.column(k).to_numpy()[hot] for k in range(3 + K))
            block = pack(number[hot].astype(np.int64), high, mass, *low)
            yield pa.RecordBatch.from_arrays([pa.array([CONTEXTS], pa.int32()), pa.array([0], pa.int32()), pa.array([block], pa.binary())], names=["kind", "at", "block"])

    return contexts.select("h", "high", "mass", *(f"low{r}" for r in range(1, K + 1))).mapInArrow(run, "kind int, at int, block binary")


def _p(c: Column, uni: Unigrams) -> Column:
    """P of a word that is not frequent and occurs c times."""
    p = F.when(c == 0, F.lit(float(uni.unseen)))
    for r in range(1, K + 1):
        p = p.when(c == r, F.lit(float(uni.d[r - 1] * r / uni.norm)))
    return p.otherwise(c / F.lit(uni.norm))


def katz_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, part_tokens: int = PART_TOKENS) -> DataFrame:
    """One row per row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows for which held_out is false (null counts as false) and scores all. Null and empty
    texts are one end token. Rows that repeat are learnt from and scored each; long texts are whole.
    Without any training row there is no model, and scores are zero as base_score is. An empty table
    gives no rows; further columns are not looked at. Words and pairs are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64(id_col, text_col).alias("_key"), F.col(id_col).alias("_id"), F.coalesce(held_out, F.lit(False)).alias("_held_out"), F.col(text_col).alias("_text"))
    train_docs = rows.where("not _held_out").count()
    if not train_docs:
        n = F.size(F.filter(F.split(F.coalesce(text_col, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")) + 1
        none = F.lit(0).cast("long")
        return docs.select(id_col, F.coalesce(held_out, F.lit(False)).alias("held_out"), n.cast("long").alias("n_tokens"), none.alias("n_known"), none.alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    words = written(word_counts(rows.where("not _held_out"), "_text"), "words")
    types, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    of_counts = {r.n: r.k for r in words.groupBy("n").agg(F.count("*").alias("k")).collect()}  # as many rows as there are different counts
    threshold, held = 1 + max(of_counts, default=0), 0
    for c in sorted(of_counts, reverse=True):
        if held + of_counts[c] > frequent:
            break
        threshold, held = c, held + of_counts[c]
    top = words.where(F.col("n") >= threshold).toArrow()
    uni = Unigrams(top.column("word").to_numpy(), top.column("n").to_numpy(), [of_counts.get(r, 0) for r in range(1, K + 2)], total, train_docs, types)
    del top
    sent = spark.sparkContext.broadcast(uni)
    profile = written(_profile(rows, sent, threshold), "profile")

    parts = max(4, -(-int(profile.agg(F.sum("n_tokens")).first()[0] or 0) // part_tokens))
    buckets = max(4, -(-profile.count() // BUCKET_DOCS))
    counted = written(_counted(_pairs(rows, sent, parts), sent, buckets), "pairs")

    # Pairs with a word that is not frequent.
    others = words.where(F.col("n") < threshold)
    odd = profile.where(F.size("before") > 0).select("_key", "_held_out", F.explode(F.arrays_zip("before", "after", "times")).alias("x"))
    odd = odd.select("_key", "_held_out", F.col("x.before").alias("h"), F.col("x.after").alias("w"), F.col("x.times").alias("times"))
    pairs = written(odd.where("not _held_out").groupBy("h", "w").agg(F.sum("times").alias("c")), "odd_pairs")
    low = [F.sum((F.col("c") == r).cast("long")).alias(f"low{r}") for r in range(1, K + 1)]
    placed = _frequent(pairs, sent, {"w": "p"})
    seldom = placed.where("not w_hot").drop("p").join(others, F.col("w") == F.col("word"), "left").withColumn("p", _p(F.coalesce("n", F.lit(0)), uni))
    placed = placed.where("w_hot").select("h", "c", "p").unionByName(seldom.select("h", "c", "p"))
    contexts = written(placed.groupBy("h").agg(*low, F.sum(F.when(F.col("c") > K, F.col("c")).otherwise(0)).alias("high"), F.sum("p").alias("mass")), "contexts")
    seen = pairs.agg(*(F.coalesce(F.sum((F.col("c") == r).cast("long")), F.lit(0)) for r in range(1, K + 2))).first()
    d, alpha, scale = _alphas(counted, uni, _context_blocks(contexts, sent), list(seen))
    arrays = spark.sparkContext.broadcast((d, alpha, scale))
    summed = _summed(counted, arrays)

    c, lows = F.coalesce("n", F.lit(0)), [F.coalesce(f"low{r}", F.lit(0)) for r in range(1, K + 1)]
    held = F.coalesce("high", F.lit(0)) + sum((float((r + 1) * d[r]) * lows[r] for r in range(K)), F.lit(0.0))
    full = sum(lows[1:], lows[0]) == 0
    left = F.when(c == 0, F.lit(1.0)).when(full, 1 / (c + 1)).otherwise(1 - held / c)
    room = F.greatest(1 - F.coalesce("mass", F.lit(0.0)), F.lit(1e-12))
    seldom = others.join(contexts, others.word == contexts.h, "left").select("word", c.alias("ch"), F.log10(left / room).alias("alpha"), F.when(full, F.log10(c / (c + 1))).otherwise(0.0).alias("scale"))
    odd = written(_frequent(odd.drop("_held_out").join(pairs, ["h", "w"], "left"), sent, {"h": "context", "w": "p"}, arrays), "odd")
    after = odd.where("not h_hot").drop("ch", "alpha", "scale").join(seldom, F.col("h") == F.col("word"), "left").drop("word")
    odd = odd.where("h_hot").unionByName(after.select(odd.columns))
    log_d = sum((F.when(F.col("c") == r + 1, F.lit(float(np.log10(d[r])))).otherwise(0.0) for r in range(K)), F.lit(0.0))
    known = odd.where("c is not null").select("_key", (F.col("times") * (F.log10(F.col("c") / F.col("ch")) + log_d + F.col("scale"))).alias("term"))
    backed = odd.where("c is null").select("_key", "w", "w_hot", "times", F.coalesce("alpha", F.lit(0.0)).alias("alpha"), "p")
    cold = backed.where("not w_hot").drop("p").join(others, F.col("w") == F.col("word"), "left").withColumn("p", _p(F.coalesce("n", F.lit(0)), uni))
    backed = backed.where("w_hot").unionByName(cold.select(backed.columns)).select("_key", (F.col("times") * (F.col("alpha") + F.log10("p"))).alias("term"))
    odd_scores = known.unionByName(backed).groupBy("_key").agg(F.sum("term").alias("odd_score"))

    rare = profile.where(F.size("words") > 0).select("_key", F.explode(F.arrays_zip("words", "counts")).alias("x"))
    rare = rare.select("_key", F.col("x.words").alias("word"), F.col("x.counts").alias("times"))
    rare = rare.join(others, "word", "left").groupBy("_key").agg(
        F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(uni.total + uni.types + 1)))).alias("rare_base"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )
    # Rows that repeat share a key: sums are theirs together.
    alike = profile.groupBy("_key").agg(F.count("*").alias("rows"))
    scores = alike.join(summed, "_key", "left").join(odd_scores, "_key", "left").join(rare, "_key", "left")
    zero = lambda name: F.coalesce(name, F.lit(0)) / F.col("rows")
    return profile.drop("words", "counts", "before", "after", "times").join(scores, "_key").select(
        F.col("_id").alias(id_col), F.col("_held_out").alias("held_out"), "n_tokens", (F.col("known") + zero("rare_known")).cast("long").alias("n_known"),
        F.lit(uni.total).cast("long").alias("train_tokens"), (F.col("base") + zero("rare_base")).alias("base_score"), (zero("pairs") + zero("odd_score")).alias("score"),
    )


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return katz_scores(docs, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2)
