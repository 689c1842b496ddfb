"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are made in Arrow batches. For linking, the 64 bits are a ring of four 16-bit segments.
By the pigeonring principle (Qin and Xiao 2018), two fingerprints within 3 bits have a segment from
which every chain of 1, 2, 3 and 4 segments differs in at most floor(chain * 3 / 4) = 0, 1, 2 and 3
bits. So a chain's first segment must be equal and its second within one bit: fingerprints are shuffled
by (start, first segment), and within a task they meet under the key (start, first segment, second
segment), under which each also probes with one set bit of the second segment cleared. What meets is
checked on the chain of three, then on all 64 bits.

Longer fingerprints (lanes of 64 bits, from further mixes of each shingle's hash) are one ring of all
their segments, and of the key's second segment only eight bits count. Links at up to (segments - 1) differing
bits are sure to be met; the full check may allow more, of which keys find a part that grows with the
number of starts. The chain of three is
always held to its share of the bits allowed.

Where a similarity is demanded, links are candidates only: the exact Jaccard similarity of the shingle
sets decides. Candidates are thinned to forests by levels of differing bits, so that any two that meet
within a level are joined by a path of candidates within that level. What bits miss is found by an exact join:
under any one order of all shingles, two sets with a similarity of s share one of their first n - ceil(s n) + 1
(n: the set's size). Sets of different components that do are compared, all of them; the order has shingles
that are common last, so few do, and of those most are told apart by sketches, which bound what two sets share.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atheneum.llm.common import components, lookup, raw, table, written

MAX_BITS = 3
#: Fingerprints under one key that a task compares at once; larger groups are split into pairs of blocks.
BLOCK = 1 << 14
#: Levels of differing bits that candidates are thinned by, as shares of the bits allowed.
LEVELS = (0.25, 0.5, 0.75, 1.0)
#: Nodes of a part when candidates are verified; the values of two parts are in a task at once.
PART = 2048
#: Shingles that come last in the order for prefixes, at most (8 bytes each), and the least count that makes one common.
COMMON, OFTEN = 1 << 19, 4
#: Shingles of a batch within which a task counts them. Counts only set the order, under which the join is exact whatever they are.
BATCH = 1 << 20
#: Sets under one shingle that a task pairs with each other at most; more are split into pairs of such blocks.
PREFIX_BLOCK = 1 << 10
#: Where sets under one shingle make over so many pairs a set, they are first compared with one of them only, in so many rounds at most.
PAIRS, ROUNDS = 8, 4
#: Ids whose texts are verified are broadcast up to so many; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingle_hashes(text: bytes | None, words: int = 3) -> np.ndarray:
    """XXH64 of a text's word shingles, repeats included."""
    ws = (text or b"").lower().split()
    if not ws:
        return np.zeros(0, "<u8")
    digest = xxhash.xxh64_intdigest
    if len(ws) < words:
        hashes = [digest(b" ".join(ws), 42)]
    elif words == 3:
        hashes = [digest(b"%b %b %b" % w, 42) for w in zip(ws, ws[1:], ws[2:], strict=False)]
    elif words == 5:
        hashes = [digest(b"%b %b %b %b %b" % w, 42) for w in zip(ws, ws[1:], ws[2:], ws[3:], ws[4:], strict=False)]
    else:
        hashes = [digest(b" ".join(ws[i : i + words]), 42) for i in range(len(ws) - words + 1)]
    return np.array(hashes, dtype="<u8")


def fingerprint(text: bytes | None, words: int = 3, lanes: int = 1) -> np.ndarray:
    """The SimHash of a text's word shingles, as lanes unsigned integers of 64 bits; 0 without words."""
    return _folded(shingle_hashes(text, words), lanes)


def _folded(h: np.ndarray, lanes: int) -> np.ndarray:
    out = np.zeros(lanes, dtype="<u8")
    if not len(h):
        return out
    for lane in range(lanes):
        if lane:  # another mix of the same hashes
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        ones = np.zeros(64, dtype=np.int64)
        for k in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
    return out


def _lanes(lanes: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, lanes))]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, lanes: int = 1) -> DataFrame:
    """id_col and fp, fp1, ..: the fingerprint's bits as signed longs; a null text has no words."""
    names = _lanes(lanes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words, lanes) for t in raw(b.column(1))], dtype=np.uint64).reshape(-1, lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(fps[:, k])) for k in range(lanes))], names=[id_col, *names])

    shape = T.StructType([docs.schema[id_col], *(T.StructField(n, T.LongType()) for n in names)])
    return docs.select(id_col, text_col).mapInArrow(run, shape)


def _node(distinct: np.ndarray) -> int:
    """A hash that names a set of shingles, given sorted."""
    return xxhash.xxh64_intdigest(distinct.tobytes(), 7)


def _sketch(distinct: np.ndarray) -> bytes:
    """How many of a set's shingles have each last byte; empty if one has over 255 of them."""
    n = np.bincount((distinct & np.uint64(255)).astype(np.int64), minlength=256)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else b""


def nodes(docs: DataFrame, id_col: str, text_col: str, words: int, lanes: int) -> DataFrame:
    """id_col, fp, fp1, .., node, the name of the text's set of shingles, and the set's sketch."""
    names = [*_lanes(lanes), "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, sketches = [], []
            for h in (shingle_hashes(t, words) for t in raw(b.column(1))):
                distinct = np.unique(h)
                out.append((*_folded(h, lanes), _node(distinct)))
                sketches.append(_sketch(distinct))
            out = np.array(out, dtype=np.uint64).reshape(-1, lanes + 1).view(np.int64)
            columns = [b.column(0), *(pa.array(np.ascontiguousarray(out[:, k])) for k in range(lanes + 1)), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *names, "sketch"])

    shape = T.StructType([docs.schema[id_col], *(T.StructField(n, T.LongType()) for n in names), T.StructField("sketch", T.BinaryType())])
    return docs.select(id_col, text_col).mapInArrow(run, shape)


def shingle_sets(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """(node, shingles), a row for each row of docs: the distinct hashes of its shingles, and their set's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = raw(b.column(0))
            for start in range(0, len(texts), 256):
                sets = [np.unique(shingle_hashes(t, words)) for t in texts[start : start + 256]]
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.array([_node(x) for x in sets], np.uint64).view(np.int64)), lists], names=["node", "shingles"])

    return docs.select(text_col).mapInArrow(run, "node long, shingles array<long>")


def _compared(pairs: DataFrame, of: DataFrame, keep: Callable[[pa.Array, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Those of pairs (u, v) of nodes that keep tells of their values, which of (node, value) has.

    Nodes are dealt into parts of about PART; two parts meet in a task with the values of the nodes that have pairs there, so a
    value is sent once for each part its node has pairs with, not for each pair. keep takes the values and the places of u and v in them."""
    parts = max(1, -(-pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().count() // PART))
    own, other = (F.pmod(F.xxhash64(c), F.lit(parts)) for c in "uv")
    dealt = pairs.select(F.least(own, other).alias("a"), F.greatest(own, other).alias("b"), "u", "v")
    sent = dealt.select("a", "b", F.explode(F.array("u", "v")).alias("node")).distinct().join(of.toDF("node", "value"), "node").select(F.col("a").alias("c"), F.col("b").alias("d"), "node", "value")

    def run(met: pa.Table, sent: pa.Table) -> pa.Table:
        met = met.select(["u", "v"])
        if not met.num_rows or not sent.num_rows:
            return met.slice(0, 0)
        nodes = sent["node"].to_numpy()
        order = np.argsort(nodes)
        at = [order[np.searchsorted(nodes, met[c].to_numpy(), sorter=order)] for c in "uv"]
        return met.take(pa.array(np.flatnonzero(keep(pa.concat_arrays(sent["value"].chunks), *at))))

    return dealt.groupBy("a", "b").cogroup(sent.groupBy("c", "d")).applyInArrow(run, "u long, v long")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (u, v) of nodes whose sets (node, shingles) have at least this Jaccard similarity."""

    def keep(values: pa.Array, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        shingles, ends = values.values.to_numpy(), values.offsets.to_numpy()
        sizes = np.diff(ends)
        shared = [len(np.intersect1d(shingles[ends[x] : ends[x + 1]], shingles[ends[y] : ends[y + 1]], assume_unique=True)) for x, y in zip(u.tolist(), v.tolist(), strict=True)]
        return np.array(shared) >= similarity * (sizes[u] + sizes[v] - np.array(shared))

    return _compared(pairs, sets.select("node", "shingles"), keep)


def possible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """pairs (u, v) without those whose sketches (node, sketch) show that fewer shingles are shared than the similarity asks for."""

    def keep(values: pa.Array, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        each = values.to_pylist()
        known = np.array([bool(x) for x in each])
        counts = np.frombuffer(b"".join(x or bytes(256) for x in each), np.uint8).reshape(-1, 256)
        sizes, out = counts.sum(axis=1, dtype=np.int64), ~(known[u] & known[v])
        for start in range(0, len(u), 4096):
            x, y = u[start : start + 4096], v[start : start + 4096]
            most = np.minimum(counts[x], counts[y]).sum(axis=1, dtype=np.int64)
            out[start : start + 4096] |= most >= similarity * (1 - 1e-12) * (sizes[x] + sizes[y] - most)
        return out

    return _compared(pairs, sketches.select("node", "sketch"), keep)


def common_shingles(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """Hashes of shingles that many sets have, the most common last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            shingles, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(shingles[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["shingle", "n"])

        size = 0
        for b in batches:
            for t in raw(b.column(0)):
                held.append(np.unique(shingle_hashes(t, words)))
                size += len(held[-1])
                if size >= BATCH:
                    yield out()
                    size = 0
        if held:
            yield out()

    counts = docs.select(text_col).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "shingle").limit(COMMON).select("shingle").toArrow()  # COMMON rows at most
    return found["shingle"].to_numpy().view(np.uint64)[::-1]


def prefixes(docs: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """(shingle, node, n, at): of each set of n shingles the first ones, of which similar sets share one, and their places; repeated sets may repeat."""
    common = common_shingles(docs, text_col, words)
    order = np.argsort(common)
    ranks = docs.sparkSession.sparkContext.broadcast((common[order], order + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank = ranks.value
        for b in batches:
            texts = raw(b.column(0))
            for start in range(0, len(texts), 256):
                first, of, sizes = [], [], []
                seen = set()
                for t in texts[start : start + 256]:
                    s = np.unique(shingle_hashes(t, words))
                    node = _node(s)
                    if not len(s) or node in seen:
                        continue
                    seen.add(node)
                    if len(often):
                        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        ordered = s[np.argsort(np.where(often[at] == s, rank[at], 0), kind="stable")]
                    else:
                        ordered = s
                    first.append(ordered[: len(s) - math.ceil(similarity * len(s) * (1 - 1e-12)) + 1])
                    of.append(node)
                    sizes.append(len(s))
                if not of:
                    continue
                lengths = [len(x) for x in first]
                cols = np.concatenate(first).view(np.int64), np.repeat(np.array(of, np.uint64).view(np.int64), lengths), np.repeat(np.array(sizes, np.int32), lengths)
                at = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*cols, at)], names=["shingle", "node", "n", "at"])

    return docs.select(text_col).mapInArrow(run, "shingle long, node long, n int, at int")


def _across(rows: DataFrame) -> DataFrame:
    """Those of rows (shingle, node, n, at, label) whose shingle is under several labels, and the pairs that they make (pairs, size)."""
    of = rows.groupBy("shingle", "label").agg(F.count("*").alias("k")).groupBy(F.col("shingle").alias("of"))
    of = of.agg(F.sum("k").alias("size"), ((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("pairs"), F.count("*").alias("labels")).where("labels > 1")
    return rows.join(of, F.col("shingle") == F.col("of")).select(*rows.columns, "size", "pairs")


def _pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of rows (shingle, node, n, at, label, size): nodes of one shingle and different labels whose sizes and places allow the similarity.

    Similar sets of x and y shingles share m, at least s (x + y) / (1 + s), so of the first x - m + 1 and y - m + 1 they share one."""
    blocks = F.ceil(F.col("size") / PREFIX_BLOCK).cast("int")
    own, other = F.pmod(F.xxhash64("node"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = rows.withColumn("own", own).withColumn("other", other).select("shingle", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node", "n", "at", "label")
    x, y = (dealt.toDF("shingle", "a", "b", *(f"{s}{c}" for c in ("own", "node", "n", "at", "label"))) for s in "xy")
    # Two of one block meet where both are dealt with it alone.
    met = x.join(y, ["shingle", "a", "b"]).where("xnode < ynode and xlabel <> ylabel and (a = b or xown <> yown)")
    share = similarity * (1 - 1e-12)
    both = F.ceil(F.lit(share / (1 + similarity)) * (F.col("xn") + F.col("yn")))
    alike = (F.least("xn", "yn") >= F.lit(share) * F.greatest("xn", "yn")) & (F.col("xat") + both <= F.col("xn")) & (F.col("yat") + both <= F.col("yn"))
    return met.where(alike).select(F.col("xnode").alias("u"), F.col("ynode").alias("v")).distinct()


def _stars(rows: DataFrame) -> DataFrame:
    """(u, v): of each shingle all nodes with the one whose set is the largest, for a start."""
    head = rows.groupBy(F.col("shingle").alias("of")).agg(F.max_by(F.struct("node", "label"), F.struct("n", "node")).alias("head"))
    met = rows.join(head, F.col("shingle") == F.col("of")).where("label <> head.label")
    return met.select(F.least("node", "head.node").alias("u"), F.greatest("node", "head.node").alias("v")).distinct()


def missed(first: DataFrame, found: DataFrame, verified: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """(u, v): as many links of sets as connect all that found, links of similar sets, and other similar sets connect.

    first has the sets' prefixes, verified gives those of pairs (u, v) that are similar. No pair of different
    components is left out that could be similar."""
    first = written(first, "prefixes")
    shared = written(first.groupBy("shingle").agg(F.count("*").alias("rows")).where("rows > 1").select("shingle"), "shared")  # repeated sets count, too, and leave below
    rows = written(first.join(F.broadcast(shared) if shared.count() <= BROADCAST_IDS else shared, "shingle", "left_semi").distinct(), "meeting")

    def stars(found: DataFrame) -> DataFrame:
        """Each node with the least one of its component, which connects what found does with fewer links."""
        return written(components(found, "rings").where("node <> label").select(F.col("label").alias("u"), F.col("node").alias("v")), "stars")

    found = stars(found)

    def labelled(rows: DataFrame) -> DataFrame:
        return written(_across(rows.select("shingle", "node", "n", "at").join(found, F.col("node") == F.col("v"), "left").withColumn("label", F.coalesce("u", "node")).drop("u", "v")), "across")

    for _ in range(ROUNDS):
        rows = labelled(rows)
        sums = rows.select("shingle", "size", "pairs").distinct().agg(F.sum("size").alias("size"), F.sum("pairs").alias("pairs")).first()
        if not sums.size:
            return found
        if sums.pairs <= PAIRS * sums.size:
            break
        more = written(verified(_stars(rows)), "more")
        if more.isEmpty():  # the same nodes would be compared again
            break
        found = stars(found.unionByName(more))
    else:
        rows = labelled(rows)
    return found.unionByName(verified(_pairs(rows, similarity)))


def _keyed(fps: DataFrame, lanes: int) -> DataFrame:
    """(key, fp .., further columns of fps): a row for each start; a key is the start and the segment there."""
    names = fps.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(4 * lanes):
                segment = b.column(k // 4).to_numpy() >> 16 * (k % 4) & 0xFFFF
                yield pa.RecordBatch.from_arrays([pa.array(k << 16 | segment), *b.columns], names=["key", *names])

    return fps.select(names).mapInArrow(run, ", ".join(f"{n} long" for n in ["key", *names]))


def _probing(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys with the next segment (of several lanes: eight bits of it), doubled, and the row of each.

    Every row has its own key and, doubled and one more, a probe for each set bit of the next segment, with that bit cleared."""
    lanes = fp.shape[1]
    wide = 16 if lanes == 1 else 8
    after = ((key >> 16) + 1) % (4 * lanes)
    second = (fp[np.arange(len(fp)), after // 4] >> (np.uint64(16) * (after % 4).astype(np.uint64))).astype(np.int64) & ((1 << wide) - 1)
    own = key << 16 | second
    at, bit = np.nonzero(second[:, None] >> np.arange(wide) & 1)
    return np.concatenate([own * 2, (own[at] ^ (1 << bit)) * 2 + 1]), np.concatenate([np.arange(len(fp)), at])


def _links(keys: list[np.ndarray], fp: np.ndarray, name: np.ndarray, levels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links within levels[-1] bits among rows that are next to each other with equal keys, as a spanning forest for each level.

    keys[0] is doubled, its last bit marks probes. fp has a row of lanes for each row; links give the rows' names."""
    n, lanes = fp.shape
    max_bits = levels[-1]
    probe, keys = keys[0] & 1, [keys[0] >> 1, *keys[1:]]
    roots = [np.arange(n) for _ in levels]

    def find(root: np.ndarray, x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    first = np.zeros(n, dtype=bool)
    first[0] = True
    for k in keys:
        first[1:] |= k[1:] != k[:-1]
    group = np.cumsum(first) - 1
    # The chain's third segment, which follows the two of the key.
    at = ((keys[0] >> 32) + 2) % (4 * lanes)
    third = (fp[np.arange(n), at // 4] >> (np.uint64(16) * (at % 4).astype(np.uint64))).astype(np.uint16)
    chain = ((keys[0] >> 32) + 1) % (4 * lanes)
    second = (fp[np.arange(n), chain // 4] >> (np.uint64(16) * (chain % 4).astype(np.uint64))).astype(np.uint16)
    kept_u, kept_v = [], []
    left = np.flatnonzero(probe == 0)  # a pair needs a row with its own key, and those come first
    for d in range(1, n):
        left = left[left + d < n]
        left = left[group[left] == group[left + d]]
        if not len(left):
            break
        near = np.bitwise_count(second[left] ^ second[left + d]) + np.bitwise_count(third[left] ^ third[left + d]) <= 3 * max_bits // (4 * lanes)
        u = left[near]
        bits = np.bitwise_count(fp[u] ^ fp[u + d]).sum(axis=1)
        level = np.searchsorted(levels, bits)
        for k, root in enumerate(roots):
            x = u[level == k]
            for x in x[root[x] != root[x + d]].tolist():
                if find(root, x) != find(root, x + d):
                    kept_u.append(x)
                    kept_v.append(x + d)
                    for wider in roots[k:]:
                        wider[find(wider, x + d)] = find(wider, x)
    return name[kept_u].view(np.int64), name[kept_v].view(np.int64)


def links(fps: DataFrame, max_bits: int = MAX_BITS, shares: tuple[float, ...] = (1.0,)) -> DataFrame:
    """(u, v): enough of the pairs of distinct fingerprints (fp, fp1, ..) within max_bits that meet to connect all that are linked.

    That holds at each level of bits, given as shares of max_bits. u and v are first lanes or, where fps has them, nodes."""
    names = fps.columns
    lanes = len(names) - ("node" in names)
    levels = sorted({int(max_bits * x) for x in shares})
    rows = _keyed(fps, lanes)
    # A start has 2^16 keys, so there are at most 2^18 a lane to count, and large ones can be broadcast.
    large = written(rows.groupBy(F.col("key").alias("of")).count().where(F.col("count") > BLOCK), "large")
    group = []
    if not large.isEmpty():
        group = ["a", "b"]
        own = F.pmod(F.xxhash64(*names), F.ceil(F.col("count") / BLOCK)).cast("int")
        other = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("count") / BLOCK) - 1).cast("int")))
        rows = rows.join(F.broadcast(large), F.col("key") == F.col("of"), "left").withColumn("count", F.coalesce("count", F.lit(1))).withColumn("own", own).withColumn("other", other)
        rows = rows.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), *names)
    width = 1 + len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: list) -> pa.RecordBatch:
            u = v = np.zeros(0, np.int64)
            if len(part[0]):
                key, of = _probing(part[0], part[width][:, :lanes])
                blocks = [c[of] for c in part[1:width]]
                order = np.lexsort([*blocks[::-1], key])
                of = of[order]
                u, v = _links([key[order], *(c[order] for c in blocks)], part[width][of, :lanes], part[width][of, -1 if len(names) > lanes else 0], levels)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        held: list[list[np.ndarray]] = []
        size = 0
        for b in batches:
            held.append([b.column(k).to_numpy() for k in range(width)] + [np.stack([b.column(width + k).to_numpy() for k in range(len(names))], axis=1).view(np.uint64)])
            size += b.num_rows
            if size < BLOCK:
                continue
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = cols[0] == cols[0][-1]
            for c in cols[1:width]:
                last &= c == c[-1]
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if cut:
                yield out([c[:cut] for c in cols])
            held = [[c[cut:] for c in cols]]
            size = len(held[0][0]) if cut else 0
        if held:
            yield out([np.concatenate(c) for c in zip(*held, strict=True)])

    rows = rows.repartition("key", *group).sortWithinPartitions("key", *group, *names[-1:])  # in one order under all starts, so that links repeat
    return rows.select("key", *group, *names).mapInArrow(run, "u long, v long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, lanes: int = 1, max_bits: int = MAX_BITS, similarity: float | None = None) -> DataFrame:
    """One row per row of docs: id_col, fingerprint, component_id (the smallest id reachable over links).

    Null and blank texts share fingerprint zero and are linked like any other. Equal fingerprints (with
    several lanes: equal first lanes) meet once, as a class; a class keeps all its rows. With a similarity,
    a class is a set of shingles, and of the links only those count whose sets have at least this Jaccard
    similarity. Null ids never name a component unless all are null. An empty table gives no rows; further
    columns of docs are not looked at.
    """
    names = _lanes(lanes)
    key = "fp" if similarity is None else "node"
    made = fingerprints(docs, id_col, text_col, words, lanes) if similarity is None else nodes(docs, id_col, text_col, words, lanes)
    rows = written(made, "fingerprints")
    classes = written(rows.groupBy(key).agg(F.min(id_col).alias("least"), F.count("*").alias("size")), "classes")
    if similarity is None:
        found = links(classes.select("fp") if lanes == 1 else written(rows.select(names).distinct(), "distinct"), max_bits)
    else:
        met = links(written(rows.select(*names, "node").distinct(), "distinct"), max_bits, LEVELS).where("u <> v")
        met = written(met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "met")

        def sets_of(met: DataFrame) -> DataFrame:
            needed = met.select(F.explode(F.array("u", "v")).alias("node")).distinct()
            # A row of every set that is needed: the one with the least id, or any if ids are null.
            ids = written(classes.join(needed, "node").select(F.col("least").alias(id_col)).distinct(), "ids")
            ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
            of = docs.select(id_col, text_col).alias("d").join(ids.alias("i"), F.col(f"d.{id_col}").eqNullSafe(F.col(f"i.{id_col}")), "left_semi")
            return written(shingle_sets(of, text_col, words).groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")

        def verified(met: DataFrame) -> DataFrame:
            met = written(met, "met")
            needed = met.select(F.explode(F.array("u", "v")).alias("node")).distinct()
            sketches = rows.join(needed, "node", "left_semi").groupBy("node").agg(F.first("sketch").alias("sketch"))
            met = written(possible(met, sketches, similarity), "possible")
            return similar(met, sets_of(met), similarity)

        found = written(similar(met, sets_of(met), similarity), "similar")
        found = missed(prefixes(docs, text_col, words, similarity), found, verified, similarity)
    of = written(components(found, "rings"), "rings")
    of = classes.join(of, classes[key] == of.node, "left").select(classes[key], "least", "size", F.coalesce("label", classes[key]).alias("label"))
    of = written(of, "labels")
    least = of.groupBy("label").agg(F.min("least").alias("component_id"))
    of = written(of.join(least, "label").select(key, "size", "component_id"), "members")
    out = lookup(rows, of, key, "size", rows.count())
    shown = F.concat(*(F.lpad(F.lower(F.hex(n)), 16, "0") for n in names))
    return out.select(id_col, shown.alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
