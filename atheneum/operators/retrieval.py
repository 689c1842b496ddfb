"""Hybrid retrieval: a vector channel, a word channel, and weighted reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atheneum.functions import filters
from atheneum.functions.text import terms
from atheneum.functions.vectors import cosine

POOL, TOP_K, RRF_K, W_VECTOR, W_WORDS = 50, 20, 60, 1.0, 0.5


def ranked(df: DataFrame, order: list[Column], pool: int, rank: str) -> DataFrame:
    """The first `pool` rows in an order, numbered; the window without partition sees these alone."""
    return df.orderBy(*order).limit(pool).withColumn(rank, F.row_number().over(W.orderBy(*order)))


def vector_channel(vectors: DataFrame, query: Column, pool: int = POOL, key: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """(id, similarity, rank_v) of the nearest vectors; filters apply before the limit."""
    df = vectors.where(F.col(vector).isNotNull() if where is None else F.col(vector).isNotNull() & where)
    df = df.select(F.col(key).alias("id"), F.round(cosine(F.col(vector), query), 6).alias("similarity"))
    return ranked(df, [F.desc("similarity"), F.asc("id")], pool, "rank_v")


def parse_query(text: str) -> list[dict[str, list[str]]]:
    """The alternatives of a query, parted by `or`: words that must occur, words and phrases that must not (leading -), and quoted phrases."""
    import re

    out: list[dict[str, list[str]]] = [{"all": [], "none": [], "phrases": [], "no_phrases": []}]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text.lower()):
        if word == "or" and not minus:
            out.append({k: [] for k in out[0]})
            continue
        found = re.findall("[a-z0-9]+", phrase or word)
        if not found:
            continue
        group = out[-1]
        if len(found) > 1:
            group["no_phrases" if minus else "phrases"].append(" ".join(found))
        if not minus:
            group["all"] += found
        elif len(found) == 1:
            group["none"] += found
    return [g for g in out if g["all"] or g["none"] or g["no_phrases"]]


def word_channel(docs: DataFrame, text: str, pool: int = POOL, key: str = "doc_id", k1: float = 1.2, b: float = 0.75, where: Column | None = None) -> DataFrame:
    """(id, bm25, rank_f) of documents that match the query, by BM25 over the documents that pass `where`.

    A document matches if one alternative of the query holds; its score counts all words of the query
    that it has. Words are read once; the text of all words is only made where a phrase asks for it."""
    query = parse_query(text)
    words = sorted({w for g in query for w in g["all"]})
    absent = sorted({w for g in query for w in g["none"]})
    phrases = sorted({p for g in query for p in g["phrases"] + g["no_phrases"]})
    df = (docs if where is None else docs.where(where)).select(F.col(key).alias("id"), terms(F.coalesce("text", F.lit(""))).alias("t"))

    def times(w: str) -> Column:
        return F.size(F.filter("t", lambda x: x == F.lit(w)))

    joined = F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" "))
    df = df.select(
        "id", F.size("t").alias("n"), *(times(w).alias(f"tf{k}") for k, w in enumerate(words)), *(F.array_contains("t", w).alias(f"no{k}") for k, w in enumerate(absent)),
        *(joined.contains(f" {p} ").alias(f"ph{k}") for k, p in enumerate(phrases)),
    )
    stats = df.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(words))))
    match = F.lit(False)
    for g in query:
        holds = F.lit(True)
        for w in g["all"]:
            holds &= F.col(f"tf{words.index(w)}") > 0
        for w in g["none"]:
            holds &= ~F.col(f"no{absent.index(w)}")
        for p in g["phrases"]:
            holds &= F.col(f"ph{phrases.index(p)}")
        for p in g["no_phrases"]:
            holds &= ~F.col(f"ph{phrases.index(p)}")
        match |= holds
    score = F.lit(0.0)
    for k in range(len(words)):
        idf = F.log(1 + (F.col("docs") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        score += idf * F.col(f"tf{k}") * (k1 + 1) / (F.col(f"tf{k}") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    df = df.where(match).crossJoin(F.broadcast(stats)).select("id", F.round(score, 6).alias("bm25"))  # stats is one row
    return ranked(df, [F.desc("bm25"), F.asc("id")], pool, "rank_f")


def fuse(vector: DataFrame, words: DataFrame, top_k: int = TOP_K, k: int = RRF_K, w_vector: float = W_VECTOR, w_words: float = W_WORDS) -> DataFrame:
    """Weighted reciprocal ranks of both channels; a missing channel adds nothing."""
    part = lambda w, r: F.coalesce(F.lit(w) / (k + F.col(r)), F.lit(0.0))
    df = vector.join(words, "id", "full_outer").withColumn("score", F.round(part(w_vector, "rank_v") + part(w_words, "rank_f"), 6))
    return df.orderBy(F.desc("score"), F.desc_nulls_last("similarity"), "id").limit(top_k).select("id", "score", "similarity", "rank_v", "rank_f")


def neighbours(hits: DataFrame, chunks: DataFrame, window: int, file: str, at: str, text: str) -> DataFrame:
    """The chunks from window before to window after each hit, joined by blank lines, with their range."""
    near = hits.select(file, F.col(at).alias("hit"), F.explode(F.sequence(F.greatest(F.col(at) - window, F.lit(0).cast("long")), F.col(at) + window)).alias(at))
    found = near.join(chunks.select(file, at, text), [file, at])
    return found.groupBy(file, "hit").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, text))), lambda x: x[text]), "\n\n").alias("context"), F.min(at).alias("first"), F.max(at).alias("last"),
    )


def collapse_parents(hits: DataFrame, top_k: int) -> DataFrame:
    """hits (query, rank, chunk, parent) to results: the first hit of each parent; later ones are only listed.

    A hit without a parent is a result of its own. Walking stops at the top_k-th result, so later hits
    of earlier results are listed only if they rank before it."""
    group = F.coalesce(F.concat(F.lit("p"), F.col("parent").cast("string")), F.concat(F.lit("c"), F.col("chunk").cast("string")))
    df = hits.withColumn("group", group).withColumn("nth", F.row_number().over(W.partitionBy("query", "group").orderBy("rank")))
    order = W.partitionBy("query").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("results", F.sum((F.col("nth") == 1).cast("int")).over(order))
    last = W.partitionBy("query")
    stop = F.min(F.when((F.col("results") == top_k) & (F.col("nth") == 1), F.col("rank"))).over(last)
    df = df.withColumn("stop", stop).where("stop is null or rank <= stop")
    out = df.groupBy("query", "group").agg(F.min_by("chunk", "rank").alias("chunk"), F.min("results").alias("position"), F.array_sort(F.collect_list(F.when(F.col("nth") > 1, F.col("chunk")))).alias("also"))
    return out.select("query", "position", "chunk", "also")


def search(chunks: DataFrame, files: DataFrame, text: str, vector: Column, top_k: int = TOP_K, folder: str | None = None, kind: str | None = None, window: int = 3, pool: int = POOL) -> DataFrame:
    """Hybrid search over chunks (chunk_id, file_id, chunk_index, text, kind, embedding, parent_id, parent_text) of files (file_id, folder, file_name).

    Filters apply before both channels are cut to the pool; both read all chunks that pass (search.indexed_search does
    not). Columns: see results()."""
    cand = max(pool, top_k)
    of = chunks.join(files.select("file_id", "folder", "file_name"), "file_id").where(within(folder, kind))
    return results(fuse(vector_channel(of, vector, cand, "chunk_id"), word_channel(of, text, cand, "chunk_id"), min(cand, 3 * top_k)), chunks, files, top_k, window)


def within(folder: str | None, kind: str | None) -> Column:
    return filters.all_of(F.col("folder") == folder if folder else None, F.col("kind") == kind if kind else None)


def results(hits: DataFrame, chunks: DataFrame, files: DataFrame, top_k: int = TOP_K, window: int = 3) -> DataFrame:
    """The results of fused hits: position, chunk_id, file_name, folder, score, similarity, text, first, last, also.

    The first hit of a parent gives the parent's text and lists the later ones; a hit without a parent gives its
    neighbours within the window. Hits are as many as a pool, so they are broadcast and chunks are not shuffled."""
    of = chunks.select(F.col("chunk_id").alias("id"), "file_id", "chunk_index", "parent_id", "parent_text").join(F.broadcast(hits), "id").join(files.select("file_id", "folder", "file_name"), "file_id")
    order = W.orderBy(F.desc("score"), F.desc_nulls_last("similarity"), "id")  # over the pool only
    of = of.withColumns({"rank": F.row_number().over(order), "query": F.lit(1)})
    found = collapse_parents(of.select("query", "rank", F.col("id").alias("chunk"), F.col("parent_id").alias("parent")), top_k)
    near = neighbours(of.where("parent_id is null").select("file_id", "chunk_index"), chunks, window, "file_id", "chunk_index", "text")
    near = near.withColumnRenamed("hit", "chunk_index")
    out = found.join(of, F.col("chunk") == F.col("id")).join(near, ["file_id", "chunk_index"], "left")
    return out.select("position", F.col("chunk").alias("chunk_id"), "file_name", "folder", F.round("score", 6).alias("score"), F.round("similarity", 4).alias("similarity"), F.coalesce("parent_text", "context").alias("text"), "first", "last", "also")
