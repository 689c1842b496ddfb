"""Sections of marked-up text, and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atheneum.functions import text as T
from atheneum.functions.text import heading_level, heading_title


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text", stem: str | None = None) -> DataFrame:
    """One row per section: key, ordinal, level, title, parent (ordinal), start, end, content.

    Lines before the first heading are a section of level 1 titled by `stem` (the key if not given).
    A section's parent is the last one before it with a smaller level: the greatest of the running
    maxima of ordinals per level. It ends where the next section of its level or a smaller one starts."""
    lines = docs.select(key, (F.col(stem) if stem else F.col(key)).cast("string").alias("stem"), F.length(text).alias("size"), F.posexplode(F.split(text, "\n")).alias("no", "line"))
    by = W.partitionBy(key).orderBy("no")
    lines = lines.withColumn("level", heading_level(F.col("line"))).withColumn("offset", F.coalesce(F.sum(F.length("line") + 1).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    opens = (F.col("level") > 0) | (F.col("no") == 0)
    lines = lines.withColumn("ordinal", F.sum(opens.cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    found = lines.groupBy(key, "ordinal").agg(
        F.min_by(F.when(F.col("level") > 0, F.col("level")).otherwise(1), "no").alias("level"), F.min_by(F.when(F.col("level") > 0, heading_title(F.col("line"))).otherwise(F.col("stem")), "no").alias("title"),
        F.min("offset").alias("start"), F.max("size").alias("size"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("no", "line")))), lambda x: x["line"]), "\n").alias("content"),
    )
    order = W.partitionBy(key).orderBy("ordinal")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    parent = end = None
    for level in range(1, 7):
        last = F.max(F.when(F.col("level") == level, F.col("ordinal"))).over(before)
        following = F.min(F.when(F.col("level") == level, F.col("start"))).over(after)
        parent = F.when(F.col("level") > level, last) if parent is None else F.greatest(parent, F.when(F.col("level") > level, last))
        end = F.when(F.col("level") >= level, following) if end is None else F.least(end, F.when(F.col("level") >= level, following))
    return found.withColumn("parent", parent).withColumn("end", F.coalesce(end, F.col("size"))).select(key, "ordinal", "level", "title", "parent", "start", "end", "content")


SEPARATORS = ("\n\n", "\n", " ", "")


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most size characters: the text is cut at the first separator that it has, pieces
    that are still too long at the next ones, and short neighbours are joined again, with the trailing
    pieces of up to overlap characters repeated."""
    if len(text) <= size:
        return [text] if text.strip() else []
    at = next(k for k, s in enumerate(separators) if not s or s in text)
    sep, rest = separators[at], separators[at + 1 :]
    out: list[str] = []
    held: list[str] = []
    length = 0
    for piece in text.split(sep) if sep else list(text):
        if len(piece) > size:
            if held:
                out.append(sep.join(held))
                held, length = [], 0
            out += split_text(piece, size, overlap, rest)
            continue
        if held and length + len(sep) + len(piece) > size:
            out.append(sep.join(held))
            while held and (length > overlap or length + len(sep) + len(piece) > size):
                length -= len(held.pop(0)) + len(sep)
        held.append(piece)
        length = sum(map(len, held)) + len(sep) * (len(held) - 1)
    if held:
        out.append(sep.join(held))
    return [p.strip() for p in out if p.strip()]


def chunks(df: DataFrame, text: str, size: int = 1000, overlap: int = 200, prefix: str | None = None) -> DataFrame:
    """df's other columns with chunk_index and content; null and blank texts have no chunk. prefix names a
    column (a speaker) put before each piece; a text that fits with its prefix stays whole."""
    names = [c for c in df.columns if c != text]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            pieces = []
            for k, t in enumerate(f[text]):
                head = f"{f[prefix].iloc[k]}: " if prefix else ""
                got = [] if t is None else [t] if prefix and len(head) + len(t) <= size else split_text(t, max(1, size - len(head)), overlap)
                pieces.append([head + g for g in got])
            out = f[names].loc[f.index.repeat([len(p) for p in pieces])].reset_index(drop=True)
            out["chunk_index"] = [i for p in pieces for i in range(len(p))]
            out["content"] = [c for p in pieces for c in p]
            yield out

    shape = df.select(*names, F.lit(0).alias("chunk_index"), F.lit("").alias("content")).schema
    return df.mapInPandas(run, shape)


def titles(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, title): the first section of level 1, which is the file's stem where none has a heading of it."""
    return found.groupBy(key).agg(F.min_by("title", F.when(F.col("level") == 1, F.col("ordinal"))).alias("title"))


def section_paths(found: DataFrame, key: str = "doc_id", depth: int = 6) -> DataFrame:
    """Sections with path, the titles from the top down joined by ` > `.

    The last section before of each level is one above if it stands behind the last ones of all smaller levels: sections
    are read once in order, by the window that sections() has sorted them for, and no table of them is sent around."""
    before = W.partitionBy(key).orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    last = {level: f"_last{level}" for level in range(1, depth)}
    df = found.withColumns({n: F.max(F.when(F.col("level") == level, F.struct("ordinal", "title"))).over(before) for level, n in last.items()})
    above, least = [], F.lit(0)
    for level, n in last.items():
        at = F.coalesce(F.col(f"{n}.ordinal"), F.lit(0))
        above.append(F.when((F.col("level") > level) & (at > least), F.col(f"{n}.title")))
        least = F.greatest(least, at)
    return df.withColumn("path", F.concat_ws(" > ", *above, "title")).drop(*last.values())


def structured_chunks(docs: DataFrame, header: dict[str, Column], parent: tuple[int, int] = (2400, 200), child: tuple[int, int] = (600, 120), key: str = "doc_id") -> DataFrame:
    """Chunks of sections: parents of a section, children of a parent.

    Columns: key, ordinal, section_path, parent_index, chunk_index, content, contextual_text (the header's
    lines over the content), chunk_type, token_estimate, parent_text. docs: key, text, stem and what header names."""
    found = section_paths(sections(docs, key, "text", "stem"), key).where(F.trim("content") != "").select(key, "ordinal", F.col("path").alias("section_path"), "content")
    big = chunks(found, "content", *parent).withColumnsRenamed({"chunk_index": "parent_index", "content": "parent_text"})
    small = chunks(big.withColumn("_text", F.col("parent_text")), "_text", *child)
    fields = docs.select(key, *(c.alias(f"_{n}") for n, c in header.items()))
    df = small.join(fields, key)
    lines = T.context_header({**{n: F.col(f"_{n}") for n in header}, "section_path": F.col("section_path")})
    out = df.withColumns({"contextual_text": F.concat_ws("\n\n", F.when(lines != "", lines), "content"), "chunk_type": T.chunk_type(F.col("content")), "token_estimate": T.token_estimate(F.col("content"))})
    return out.drop(*(f"_{n}" for n in header))


def routed(items: DataFrame, structured: bool = True) -> DataFrame:
    """Items (doc_id, text, stem, is_audio, speaker) with route and their chunks: audio by speaker, documents by structure or flat; blank ones have none, under `done`."""
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    audio = chunks(items.where(F.col("is_audio") & ~blank).select("doc_id", "speaker", "text"), "text", prefix="speaker").select("doc_id", F.lit("audio").alias("route"), "chunk_index", "content")
    docs = items.where(~F.col("is_audio") & ~blank)
    flat = structured_chunks(docs, {}) if structured else chunks(docs.select("doc_id", "text"), "text")
    flat = flat.select("doc_id", F.lit("structured" if structured else "flat").alias("route"), "chunk_index", "content")
    none = items.where(blank).select("doc_id", F.lit("done").alias("route"), F.lit(None).cast("int").alias("chunk_index"), F.lit(None).cast("string").alias("content"))
    return audio.unionByName(flat).unionByName(none)


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """An embedding that needs no model: signed counts of hashed words, of unit length; zeros without words."""
    words = T.terms(text)
    at = lambda k: F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.when(F.pmod(F.xxhash64(w), F.lit(size)) == k, F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1.0).otherwise(-1.0)).otherwise(0.0))
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))
