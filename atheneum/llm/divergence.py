"""Which terms set a source apart from its language, and how far sources are from each other.

Documents become an inverted index, one row for each language and term with the counts of its sources (its
postings). A group's smoothed term share p and its language's share q give the divergence f = (p - q)^2 / q,
in whole billionths throughout.

Top terms come from an upper-bound search: a group's terms lie in buckets of like counts, and a bucket's
largest p and the least q of its terms bound f. The buckets with the best bounds are evaluated first; those
whose bound is strictly below the k-th value found are never evaluated. Pairs of sources come from postings:
terms in both sources are met in the postings of a term, terms in one of them through the distinct counts of a
group, and terms in neither are all alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atheneum.llm.common import raw, table, written

UNIT, LEAST_DOCS, TOP = 1_000_000_000, 3, 200
#: A task hands on its counts when it holds so many, and the pairs of a block of so many postings.
HELD, BLOCK = 400_000, 1 << 16
#: Groups whose totals one pass over the index carries to the tasks; more take further passes.
PASS_GROUPS = 1_000_000

_LETTER = bytes(c if c >= 0x80 or chr(c).islower() else ord(chr(c).lower()) if chr(c).isupper() else 0x20 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LETTER).split()


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + kept)), without rounding at any size."""
    wide = "decimal(20,0)"
    return (F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast(wide), (total + kept).cast(wide))).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most UNIT + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of docs (lang, source, text), summed up within tasks as far as memory goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, seen) in counts.items():
                keys = list(n)
                for k in range(0, len(keys), 50_000):
                    part = keys[k : k + 50_000]
                    same = lambda value, size=len(part): pa.array([value]).take(pa.array(np.zeros(size, dtype=np.int32)))
                    columns = [same(lang), same(source), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([seen[t] for t in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2)), strict=True):
                found = terms_of(text)
                if not found:
                    continue
                n, seen = counts.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                n.update(found)
                seen.update(set(found))
                held += len(n)
                if held > HELD:
                    yield from out()
                    counts, held = {}, 0
        yield from out()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def term_index(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, n, postings) of terms in at least least_docs documents of a language; a posting is (source, n).

    Counts are dealt once, by language and term; a term then has one posting for each source, so its list grows with
    the sources and not with the documents."""
    dealt = term_counts(docs).repartition("lang", "term")
    by = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    lists = by.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("postings"))
    return lists.where(F.col("docs") >= least_docs).drop("docs")


def group_totals(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(lang, source, n, kept, lang_n): every group of docs, with its occurrences of kept terms, and its language's."""
    langs = index.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count("*").alias("kept"))
    sums = index.select("lang", F.explode("postings").alias("p")).groupBy("lang", "p.source").agg(F.sum("p.n").alias("n"))
    zero = F.lit(0).cast("long")
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    return groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("n", "kept", "lang_n")))


def top_terms(index: DataFrame, groups: DataFrame, k: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the k terms of a group, more frequent there than in its language, that diverge most."""
    flat = index.select("lang", "term", F.col("n").alias("lang_count"), F.explode("postings").alias("x")).select("lang", "x.source", "term", F.col("x.n").alias("count"), "lang_count")
    # Counts to 16 have a bucket each, then there are four for each doubling.
    flat = flat.withColumn("bucket", F.when(F.col("count") <= 16, F.col("count")).otherwise(F.floor(4 * F.log2("count")).cast("long")))
    buckets = flat.groupBy("lang", "source", "bucket").agg(F.count("*").alias("terms"), F.max("count").alias("count"), F.min("lang_count").alias("lang_count"))
    buckets = buckets.join(groups, ["lang", "source"])
    p, q = share(F.col("count"), F.col("n"), F.col("kept")), share(F.col("lang_count"), F.col("lang_n"), F.col("kept"))
    buckets = buckets.withColumns({"p": p, "q": q}).where("p > q")  # no term of another bucket diverges upwards
    buckets = buckets.withColumn("bound", divergence(F.col("p"), F.col("q")))
    # A group's buckets are some hundred rows whatever its size.
    best = W.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket")
    before = F.sum("terms").over(best.rowsBetween(W.unboundedPreceding, -1))
    buckets = written(buckets.withColumn("before", F.coalesce(before, F.lit(0))).select("lang", "source", "bucket", "bound", "before", "n", "kept", "lang_n"), "buckets")

    def evaluated(which: DataFrame) -> DataFrame:
        at = flat.join(F.broadcast(which) if which.count() <= PASS_GROUPS else which, ["lang", "source", "bucket"])
        at = at.withColumns({"p": share(F.col("count"), F.col("n"), F.col("kept")), "q": share(F.col("lang_count"), F.col("lang_n"), F.col("kept"))}).where("p > q")
        return at.select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = written(ranked(evaluated(buckets.where(F.col("before") < k))), "terms")
    kth = first.groupBy("lang", "source").agg(F.when(F.count("*") == k, F.min("value")).alias("kth"))
    rest = buckets.where(F.col("before") >= k).join(kth, ["lang", "source"], "left").where("kth is null or bound >= kth").drop("kth")
    rest = written(rest, "buckets")
    return ranked(first.drop("rank").unionByName(evaluated(rest)))


def _joint(index: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) summed over the terms that both sources have: what such a term adds to f(a, b) over
    f with the count of a alone, f with the count of b alone, and with the share of no count once too often."""
    known: dict[str, dict[str, tuple[int, int, int]]] = {}
    for r in groups.collect():  # at most PASS_GROUPS rows
        of = known.setdefault(r.lang, {})
        of[r.source] = (len(of), r.n, r.kept)
    sent = index.sparkSession.sparkContext.broadcast(known)

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def block(lists: list[list[dict]], of: dict[str, tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in lists])
        rows = [(*of[x["source"]], x["n"]) for one in lists for x in one]
        at = np.array([r[0] for r in rows], dtype=np.int64)
        p = np.array([1 + UNIT * (c + 1) // (n + kept) for _, n, kept, c in rows], dtype=np.int64)
        none = np.array([1 + UNIT // (n + kept) for _, n, kept, _ in rows], dtype=np.int64)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(rows))  # postings from here to the term's end
        codes, values = [], []
        for step in range(1, int(size.max())):
            i = np.flatnonzero(left > step)
            j = i + step
            for a, b in ((i, j), (j, i)):
                codes.append(at[a] * len(of) + at[b])
                values.append(f(p[a], p[b]) - f(p[a], none[b]) - f(none[a], p[b]) + f(none[a], none[b]))
        code, where = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.zeros(len(code), dtype=np.int64)
        np.add.at(total, where, np.concatenate(values))
        return code, total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], int] = {}
        names = {lang: list(of) for lang, of in sent.value.items()}

        def out() -> pa.RecordBatch:
            columns = [pa.array([x[0] for x in sums], pa.string()), *(pa.array([names[x[0]][x[k]] for x in sums], pa.string()) for k in (1, 2)), pa.array(list(sums.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])

        for batch in batches:
            by: dict[str, list] = {}
            for lang, postings in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang in sent.value:
                    by.setdefault(lang, []).append(postings)
            for lang, lists in by.items():
                of = sent.value[lang]
                while lists:
                    part, held = [], 0
                    while lists and (not part or held + len(lists[-1]) ** 2 <= 8 * BLOCK):
                        part.append(lists.pop())
                        held += len(part[-1]) ** 2
                    for code, value in zip(*(x.tolist() for x in block(part, of)), strict=True):
                        key = (lang, code // len(of), code % len(of))
                        sums[key] = sums.get(key, 0) + value
                    if len(sums) > HELD:
                        yield out()
                        sums = {}
        yield out()

    shared = index.where(F.size("postings") > 1).select("lang", "postings")
    return shared.mapInArrow(run, "lang string, a string, b string, value long")


def pair_values(index: DataFrame, groups: DataFrame, pass_groups: int = PASS_GROUPS) -> DataFrame:
    """(lang, source, item, value): f between a source and each other one of its language, summed over all kept terms.

    The result itself has a row for each pair of sources. A group's partial sums fit a long: shares add up to UNIT
    and the number of terms, so their squares to some 10^18."""
    zero = F.lit(0).cast("long")
    none = share(zero, F.col("n"), F.col("kept"))
    base = groups.where("kept > 0").select("lang", "source", "n", "kept", none.alias("none"))
    other = base.select("lang", F.col("source").alias("item"), F.col("none").alias("other"))
    # Terms of one source alone, by its distinct counts; both directions of a pair at once.
    counts = index.select("lang", F.explode("postings").alias("x")).groupBy("lang", "x.source", F.col("x.n").alias("count")).agg(F.count("*").alias("terms"))
    counts = counts.join(base, ["lang", "source"]).select("lang", "source", "none", "terms", share(F.col("count"), F.col("n"), F.col("kept")).alias("p"))
    alone = counts.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(
        F.sum(F.col("terms") * (divergence(F.col("p"), F.col("other")) - divergence(F.col("none"), F.col("other")))).alias("to"),
        F.sum(F.col("terms") * (divergence(F.col("other"), F.col("p")) - divergence(F.col("other"), F.col("none")))).alias("back"),
    )
    parts = alone.select("lang", "source", "item", F.col("to").alias("value")).unionByName(alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
    for pack in _passes(groups, pass_groups):
        parts = parts.unionByName(_joint(index, pack).select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value"))
    parts = parts.unionByName(base.join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("kept") * divergence(F.col("none"), F.col("other"))).alias("value")))
    sums = parts.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(20,0)")).cast("long").alias("value"))
    # Languages without kept terms have pairs too.
    bare = groups.where("kept = 0")
    return sums.unionByName(bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", zero))


def _passes(groups: DataFrame, most: int) -> Iterator[DataFrame]:
    """groups as parts by whole languages, of at most `most` rows where a language has no more."""
    part: list[str] = []
    held = 0
    for r in groups.groupBy("lang").count().orderBy("lang").collect():  # as many rows as languages
        if part and held + r["count"] > most:
            yield groups.where(F.col("lang").isin(part))
            part, held = [], 0
        part.append(r.lang)
        held += r["count"]
    if part:
        yield groups.where(F.col("lang").isin(part))


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs with lang, source and text: part `pair` and part `term`.

    Null lang, source and text are read as ''; rows that repeat count each time; other columns are not looked at; an
    empty table gives no rows. A group without a term has pairs, but no terms."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    index = written(term_index(docs, least_docs), "terms")
    groups = written(group_totals(docs, index), "groups")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))  # the pairs of a source
    pairs = pair_values(index, groups).withColumn("rank", F.row_number().over(order))
    found = pairs.withColumn("part", F.lit("pair")).unionByName(top_terms(index, groups, top).withColumn("part", F.lit("term")))
    return found.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT lang, source, r, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT o.lang, source, o.term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
full_counts AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n::HUGEINT AS ln FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER grp + count(*) OVER grp) AS p,
      1 + (1000000000::HUGEINT * (ln + 1)) // (sum(ln) OVER grp + count(*) OVER grp) AS q FROM full_counts WINDOW grp AS (PARTITION BY lang, source)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM every
 UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) FROM terms)
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
