"""Entities, relationships, communities and summaries of a collection, and the graph that is exported of them.

Tables, by their columns: files (file_id, folder, file_name), mentions (entity_id, file_id, confidence),
entities (entity_id, name, type, aliases), relationships (rel_id, source, target, kind, confidence),
evidence (rel_id, file_id, quote), communities (community_id, name, summary), members (community_id, entity_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atheneum.functions import labels
from atheneum.functions import text as T
from atheneum.operators import graph, linker, steps

# Bounds of node and edge sizes.
EDGE_SIZES, MENTION_SIZES, ENTITY_SIZES, FILE_SIZES, COMMUNITY_SIZES = (1, 8), (1, 6), (4, 22), (5, 18), (8, 26)


def pending_chunks(chunks: DataFrame, state: DataFrame, version: str) -> DataFrame:
    """Chunks (chunk_id, content) that no state (chunk_id, version, status, content_hash) covers: none, another version, failed, or other content."""
    seen = state.select("chunk_id", F.col("version").alias("_v"), F.col("status").alias("_s"), F.col("content_hash").alias("_h"))
    covered = (F.col("_v") == version) & (F.col("_s") != "failed") & (F.col("_h") == F.sha2("content", 256))
    return chunks.where(F.length(F.trim("content")) > 0).join(seen, "chunk_id", "left").where(~F.coalesce(covered, F.lit(False))).drop("_v", "_s", "_h")


def persist_relationships(found: DataFrame, entities: DataFrame, default: float = 0.65) -> DataFrame:
    """Relationships found in chunks (chunk_id, source, source_type, target, target_type, kind, confidence) whose ends are entities of the same chunk (chunk_id, key, type).

    Blank ends and ends that are equal are dropped."""
    key = lambda c: T.entity_key(F.col(c))
    df = found.withColumns({"s_key": key("source"), "t_key": key("target")}).where("s_key <> '' and t_key <> ''")
    df = df.where((F.col("s_key") != F.col("t_key")) | ~F.col("source_type").eqNullSafe(F.col("target_type")))
    for end, kind in (("s_key", "source_type"), ("t_key", "target_type")):
        df = df.join(entities.select("chunk_id", F.col("key").alias(end), F.col("type").alias(kind)).distinct(), ["chunk_id", end, kind], "left_semi")
    return df.select("chunk_id", "s_key", "source_type", "t_key", "target_type", "kind", F.coalesce("confidence", F.lit(default)).alias("confidence"))


def entity_rows(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities with mention_count, file_count and avg_confidence; those without a mention count zero."""
    stats = mentions.groupBy("entity_id").agg(F.count("*").alias("mention_count"), F.countDistinct("file_id").alias("file_count"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("avg_confidence"))
    return entities.join(stats, "entity_id", "left").fillna(0, ["mention_count", "file_count"]).fillna(0.0, ["avg_confidence"])


def file_rows(files: DataFrame, mentions: DataFrame) -> DataFrame:
    """Files with entity_count and mention_count."""
    stats = mentions.groupBy("file_id").agg(F.countDistinct("entity_id").alias("entity_count"), F.count("*").alias("mention_count"))
    return files.join(stats, "file_id", "left").fillna(0, ["entity_count", "mention_count"])


def mention_edges(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("entity_id", "file_id").agg(F.count("*").alias("mention_count"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("avg_confidence"))


def relationship_rows(relationships: DataFrame, evidence: DataFrame) -> DataFrame:
    """Relationships with evidence_count, file_count and edge_weight."""
    stats = evidence.groupBy("rel_id").agg(F.count("*").alias("evidence_count"), F.countDistinct("file_id").alias("file_count"))
    out = relationships.join(stats, "rel_id", "left").fillna(0, ["evidence_count", "file_count"])
    return out.withColumn("edge_weight", F.greatest(F.lit(1), "evidence_count") * F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.1)))


def communities(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Communities by the types of both ends and the relation: entity_count, kinds, evidence, summary, source_hash.

    relationships carry evidence_count. The summary names at most eight members, the least ones."""
    of = lambda end: entities.select(F.col("entity_id").alias(end), F.col("name").alias(f"{end}_name"), F.col("type").alias(f"{end}_type"))
    df = relationships.join(of("source"), "source").join(of("target"), "target")
    df = df.withColumn("name", labels.community_name(F.col("source_type"), F.col("target_type"), F.col("kind")))
    ends = df.select("name", F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("source_name").alias("of")), F.struct(F.col("target").alias("id"), F.col("target_name").alias("of")))).alias("x"))
    ends = ends.select("name", "x.*").distinct()
    # The least eight names of a community, found without gathering all of them in a list.
    least = ends.where("of <> ''").select("name", "of").distinct().withColumn("k", F.row_number().over(W.partitionBy("name").orderBy("of"))).where("k <= 8")
    shown = least.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("of")), ", ").alias("shown"))
    # A digest of all members that does not depend on their order.
    size = ends.groupBy("name").agg(F.countDistinct("id").alias("entity_count"), F.sum(F.pmod(F.xxhash64("id"), F.lit(1 << 40))).alias("digest"))
    stats = df.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"), F.sum("evidence_count").alias("evidence"))
    out = stats.join(size, "name").join(shown, "name", "left")
    text = F.format_string("%s connects %d entities through %s. Representative members: %s.", "name", "entity_count", "kinds", F.coalesce("shown", F.lit("")))
    return out.select("name", "entity_count", "kinds", "evidence", text.alias("summary"), F.sha2(F.concat_ws("|", "name", "digest", "kinds"), 256).alias("source_hash"))


def community_rows(communities: DataFrame, members: DataFrame) -> DataFrame:
    """Communities with member_count; those without members count zero."""
    stats = members.where("entity_id is not null").groupBy("community_id").agg(F.count("*").alias("member_count"))
    return communities.join(stats, "community_id", "left").fillna(0, ["member_count"])


def _bounded(value: Column, bounds: tuple[int, int]) -> Column:
    return F.greatest(F.lit(float(bounds[0])), F.least(F.lit(float(bounds[1])), value.cast("double")))


def snapshot_edges(entities: DataFrame, relationships: DataFrame, mentions: DataFrame) -> DataFrame:
    """Edges (key, source, target, label, size, weight, count) of the export; both ends of a relationship have to be in entities."""
    ids = entities.select("entity_id").distinct()
    rel = relationships.join(ids.withColumnRenamed("entity_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("entity_id", "target"), "target", "left_semi")
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    rel = rel.select(node("relationship", "rel_id").alias("key"), node("entity", "source").alias("source"), node("entity", "target").alias("target"), F.col("kind").alias("label"), _bounded(F.col("evidence_count"), EDGE_SIZES).alias("size"), F.col("edge_weight").alias("weight"), F.col("evidence_count").alias("count"))
    of = mentions.join(ids, "entity_id", "left_semi")
    of = of.select(
        F.concat_ws(":", F.lit("mention"), F.col("entity_id").cast("string"), F.col("file_id").cast("string")).alias("key"), node("entity", "entity_id").alias("source"), node("file", "file_id").alias("target"),
        F.lit("MENTIONED_IN").alias("label"), _bounded(F.col("mention_count"), MENTION_SIZES).alias("size"), F.greatest(F.lit(1), "mention_count").cast("double").alias("weight"), F.col("mention_count").alias("count"),
    )
    return rel.unionByName(of)


def snapshot_nodes(entities: DataFrame, files: DataFrame, communities: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (key, label, type, degree, weight, size) of the export; degrees sum the counts of a node's edges."""
    degree = edges.select(F.explode(F.array("source", "target")).alias("key"), "count").groupBy("key").agg(F.sum("count").alias("degree"))
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")).alias("key")
    own = entities.select(node("entity", "entity_id"), F.col("name").alias("label"), F.col("type"), F.lit("entity").alias("kind"), F.lit(None).cast("long").alias("members"))
    own = own.unionByName(files.select(node("file", "file_id"), F.col("file_name").alias("label"), F.lit("document").alias("type"), F.lit("file").alias("kind"), F.lit(None).cast("long").alias("members")))
    own = own.unionByName(communities.select(node("community", "community_id"), F.col("name").alias("label"), F.lit("community").alias("type"), F.lit("community").alias("kind"), F.col("member_count").alias("members")))
    df = own.join(degree, "key", "left").withColumn("degree", F.coalesce("members", "degree", F.lit(0)).cast("long"))
    df = df.withColumn("weight", F.greatest(F.lit(1), "degree").cast("double"))
    size = F.when(F.col("kind") == "entity", _bounded(4 + F.sqrt("weight") * 2, ENTITY_SIZES)).when(F.col("kind") == "file", _bounded(4 + F.sqrt("weight") * 1.6, FILE_SIZES)).otherwise(_bounded(5 + F.sqrt("weight") * 3, COMMUNITY_SIZES))
    return df.select("key", "label", "type", "degree", "weight", F.round(size, 4).alias("size"))


def ego(nodes: DataFrame, edges: DataFrame, center: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first `limit` edges (by position) at a node of a stored snapshot, and the nodes at their ends."""
    near = edges.where((F.col("source") == center) | (F.col("target") == center)).orderBy("position").limit(limit)
    ends = near.select(F.explode(F.array("source", "target")).alias("key")).unionByName(near.sparkSession.createDataFrame([(center,)], "key string")).distinct()
    return nodes.join(F.broadcast(ends), "key", "left_semi"), near


def search_communities(communities: DataFrame, members: DataFrame, entities: DataFrame, words: str, limit: int = 20) -> DataFrame:
    """Communities whose name, summary or a member's name holds the words; member_count counts the members on rows that do."""
    hit = lambda c: F.coalesce(F.lower(F.col(c)).contains(words.lower()), F.lit(False))
    own = hit("name") | hit("summary")
    df = communities.join(members, "community_id", "left").join(entities.select("entity_id", F.col("name").alias("member")), "entity_id", "left")
    df = df.where(own | hit("member")).groupBy("community_id", "name", "summary").agg(F.count("entity_id").alias("member_count"))
    return df.orderBy(F.desc("member_count"), "name", "community_id").limit(limit)


def latest_summary(summaries: DataFrame, key: str | None = None, fragment: str | None = None) -> DataFrame:
    """The latest summary of the document with this id, or whose name holds the fragment; no row if neither is given."""
    test = F.lit(False)
    if key is not None:
        test |= F.col("document_id") == key
    if fragment:
        test |= F.lower("file_name").contains(fragment.lower())
    return summaries.where(test).orderBy(F.desc("created_at"), F.desc("summary_id")).limit(1)


def document_summaries(sections: DataFrame, key: list[str], order: str, text: str, title: str | None = None) -> DataFrame:
    """The extractive summary of each document's (or section's) texts in order; empty ones are left out."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n\n")
    df = sections.groupBy(*key).agg(joined.alias("_text"), *([F.min_by(title, order).alias("_title")] if title else []))
    df = df.withColumn("summary", T.summary(F.col("_title") if title else None, F.col("_text"))).where("summary <> ''")
    return df.select(*key, "summary", F.sha2("_text", 256).alias("source_hash"))


def related_names(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships with the names of both ends: the same small-keyed table joined twice."""
    of = lambda end: entities.select(F.col("entity_id").alias(end), F.col("name").alias(f"{end}_name"))
    return relationships.join(of("source"), "source").join(of("target"), "target")


def readiness(counts: dict[str, DataFrame]) -> DataFrame:
    """(part, n, ready): how many rows each part of the collection has, and whether it has any."""
    out = None
    for part, df in counts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n", (F.col("n") > 0).alias("ready"))
        out = row if out is None else out.unionByName(row)
    return out


def structure_status(chunks: DataFrame, name: Column, wanted: str) -> DataFrame:
    """Of files whose name is, ends with or holds the wanted one: chunks, those with a section, sections, share with a section."""
    df = chunks.where(name.isNotNull() & F.lower(name).contains(wanted.lower())).groupBy(name.alias("file"))
    df = df.agg(F.count("*").alias("chunks"), F.count("section").alias("with_section"), F.countDistinct("section").alias("sections"))
    return df.withColumn("coverage", F.round(F.col("with_section") / F.col("chunks"), 4))


def packet(query: str, hits: DataFrame, entities: DataFrame, relationships: DataFrame, communities: DataFrame, summaries: DataFrame) -> dict[str, DataFrame | str]:
    """All that a search gives: hits, their side channels, one summary a hit, and where each hit is from."""
    of = hits.select("id", "file_id").join(summaries, "file_id")
    last = of.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("created_at"), F.desc("summary_id")))).where("_n = 1").drop("_n")
    return {"query": query, "chunks": hits, "entities": entities, "relationships": relationships, "communities": communities, "summaries": last, "provenance": hits.select("id", "file_id")}


def refresh_steps(extract=None) -> list[steps.Step]:  # noqa: ANN001
    """The refresh of documents (doc_id, text) and names (id, name, aliases) as steps for steps.Store: summaries, mentions,
    relationships with evidence, weights, communities.

    extract maps documents and mentions to relationships (doc_id, source, kind, target); without one, mentions next to
    each other in a document are related."""

    def near(_: DataFrame, found: DataFrame) -> DataFrame:
        after = F.lead("id").over(W.partitionBy("doc_id").orderBy("at", "id"))
        return found.select("doc_id", F.col("id").alias("source"), F.lit("RELATED_TO").alias("kind"), after.alias("target")).where("target <> source")

    def weights(related: DataFrame, found: DataFrame) -> DataFrame:
        edges = related.select(F.xxhash64("source", "kind", "target").alias("edge_id"), "source", "target").distinct()
        return graph.node_weights(edges, found.select(F.col("id").alias("node")))

    def grouped(related: DataFrame, names: DataFrame) -> DataFrame:
        rels = related.groupBy("source", "kind", "target").agg(F.count("*").alias("evidence_count")).withColumn("rel_id", F.xxhash64("source", "kind", "target"))
        return communities(rels, names.select(F.col("id").alias("entity_id"), "name", F.lit("concept").alias("type")))

    return [
        steps.Step("summaries", ("documents",), lambda d: document_summaries(d.withColumn("_n", F.lit(0)), ["doc_id"], "_n", "text")),
        steps.Step("mentions", ("documents", "names"), linker.mentions),
        steps.Step("relationships", ("documents", "mentions"), extract or near),
        steps.Step("weights", ("relationships", "mentions"), weights),
        steps.Step("communities", ("relationships", "names"), grouped),
    ]
