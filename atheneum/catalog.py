"""Queries over a collection: its graph, summaries and changing tables. Suppliers stand for entities, parts for relationships, customers for files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atheneum.functions import filters, labels
from atheneum.operators import knowledge as K
from atheneum.operators import ledger, state
from atheneum.registry import query
from atheneum.registry import table as _t

KIND = "CASE p_size % 3 WHEN 0 THEN 'USES' WHEN 1 THEN 'DEPENDS_ON' ELSE 'OWNS' END"
TYPE = "CASE s_suppkey % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'team' ELSE 'product' END"
VIEWS = f"""entities AS (SELECT s_suppkey AS entity_id, s_name AS name, {TYPE} AS type FROM supplier),
mentions AS (SELECT l_suppkey AS entity_id, l_orderkey % 97 + 1 AS file_id, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount END AS confidence FROM lineitem),
files AS (SELECT c_custkey AS file_id, c_mktsegment AS folder, c_name AS file_name FROM customer),
rels AS (SELECT p_partkey AS rel_id, p_partkey % 9 + 1 AS source, p_size % 11 + 1 AS target, {KIND} AS kind, p_size % 10 / 10.0::DOUBLE AS confidence FROM part),
evidence AS (SELECT l_partkey AS rel_id, l_orderkey % 97 + 1 AS file_id, l_returnflag AS quote FROM lineitem),
communities AS (SELECT n_nationkey::BIGINT AS community_id, n_name AS name, 'region ' || n_regionkey AS summary FROM nation),
members AS (SELECT s_nationkey::BIGINT AS community_id, s_suppkey AS entity_id FROM supplier)"""


def _graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = lambda n: _t(spark, sf_dir, n)
    file_id = (F.col("l_orderkey") % 97 + 1).alias("file_id")
    return {
        "entities": t("supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.expr(TYPE).alias("type")),
        "mentions": t("lineitem").select(F.col("l_suppkey").alias("entity_id"), file_id, F.when(F.col("l_linenumber") != 1, F.col("l_discount")).alias("confidence")),
        "files": t("customer").select(F.col("c_custkey").alias("file_id"), F.col("c_mktsegment").alias("folder"), F.col("c_name").alias("file_name")),
        "relationships": t("part").select(F.col("p_partkey").alias("rel_id"), (F.col("p_partkey") % 9 + 1).alias("source"), (F.col("p_size") % 11 + 1).cast("long").alias("target"), F.expr(KIND).alias("kind"), (F.col("p_size") % 10 / 10.0).alias("confidence")),
        "evidence": t("lineitem").select(F.col("l_partkey").alias("rel_id"), file_id, F.col("l_returnflag").alias("quote")),
        "communities": t("nation").select(F.col("n_nationkey").cast("long").alias("community_id"), F.col("n_name").alias("name"), F.concat(F.lit("region "), F.col("n_regionkey")).alias("summary")),
        "members": t("supplier").select(F.col("s_nationkey").cast("long").alias("community_id"), F.col("s_suppkey").alias("entity_id")),
    }


@query("SELECT coalesce(lang, 'unknown') AS kind, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, kind")
def a03_group_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


FILE_ROWS = """fr AS (SELECT f.*, count(DISTINCT m.entity_id) AS entity_count, count(m.entity_id) AS mention_count FROM files f LEFT JOIN mentions m USING (file_id) GROUP BY ALL)"""
ENTITY_ROWS = """er AS (SELECT e.*, count(m.file_id) AS mention_count, count(DISTINCT m.file_id) AS file_count, coalesce(round(avg(coalesce(m.confidence, 0)) FILTER (m.file_id IS NOT NULL), 8), 0) AS avg_confidence
FROM entities e LEFT JOIN mentions m USING (entity_id) GROUP BY ALL)"""
REL_ROWS = """rr AS (SELECT r.*, coalesce(n, 0) AS evidence_count, coalesce(f, 0) AS file_count, greatest(1, coalesce(n, 0)) * greatest(coalesce(confidence, 0), 0.1::DOUBLE) AS edge_weight
FROM rels r LEFT JOIN (SELECT rel_id, count(*) AS n, count(DISTINCT file_id) AS f FROM evidence GROUP BY 1) USING (rel_id))"""


@query(f"WITH {VIEWS}, {FILE_ROWS} SELECT * FROM fr")
def a05_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return K.file_rows(g["files"], g["mentions"])


@query(f"WITH {VIEWS} SELECT entity_id, file_id, count(*) AS mention_count, round(avg(coalesce(confidence, 0)), 8) AS avg_confidence FROM mentions GROUP BY 1, 2")
def a06_mention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.mention_edges(_graph(spark, sf_dir)["mentions"]).withColumn("avg_confidence", F.round("avg_confidence", 8))


@query(f"WITH {VIEWS}, {REL_ROWS} SELECT rel_id, source, target, kind, evidence_count, file_count, round(edge_weight, 6) AS edge_weight FROM rr")
def a07_relationship_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return K.relationship_rows(g["relationships"], g["evidence"]).drop("confidence").withColumn("edge_weight", F.round("edge_weight", 6))


@query(f"WITH {VIEWS} SELECT c.*, count(m.entity_id) AS member_count FROM communities c LEFT JOIN members m USING (community_id) GROUP BY ALL")
def a08_community_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return K.community_rows(g["communities"], g["members"])


@query("""SELECT l_suppkey AS entity_id, coalesce(array_to_string(list_sort(list(DISTINCT l_returnflag || l_linestatus) FILTER (l_discount > 0.05)), ','), '') AS evidence FROM lineitem GROUP BY 1""")
def a11_distinct_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity_id")).agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("l_discount") > 0.05, F.concat("l_returnflag", "l_linestatus")))), ",").alias("evidence")
    )


@query("""SELECT 'status:' || event_type AS key, count(*) AS n FROM events GROUP BY 1
UNION ALL SELECT 'open:' || o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'O' GROUP BY 1""")
def a16_flat_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _t(spark, sf_dir, "events").groupBy(F.concat(F.lit("status:"), "event_type").alias("key")).agg(F.count("*").alias("n"))
    two = _t(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy(F.concat(F.lit("open:"), "o_orderpriority").alias("key")).agg(F.count("*").alias("n"))
    return one.unionByName(two)


@query(f"""WITH {VIEWS} SELECT rel_id, kind, s.name AS source_name, t.name AS target_name, r.source, r.target, r.confidence
FROM rels r JOIN entities s ON s.entity_id = r.source JOIN entities t ON t.entity_id = r.target""")
def j06_related_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return K.related_names(g["relationships"], g["entities"])


@query("""SELECT o.o_orderkey, l.l_linenumber::BIGINT AS line, l.l_suppkey FROM orders o LEFT JOIN (SELECT l_orderkey, l_linenumber, l_suppkey,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS n FROM lineitem) l ON l.l_orderkey = o.o_orderkey AND l.n = 1""")
def j10_latest_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_partkey")
    return state.with_latest(_t(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", "l_orderkey", ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]).select("o_orderkey", F.col("latest.l_linenumber").cast("long").alias("line"), "latest.l_suppkey")


@query("""SELECT c_nationkey::BIGINT AS nation, c_mktsegment AS segment, count(*) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM customer JOIN
(SELECT s_nationkey, CASE s_suppkey % 2 WHEN 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS seg, s_suppkey FROM supplier) ON s_nationkey = c_nationkey AND seg = c_mktsegment GROUP BY ALL""")
def j11_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("c_mktsegment"), "s_suppkey")
    j = _t(spark, sf_dir, "customer").join(s, ["c_nationkey", "c_mktsegment"])
    return j.groupBy(F.col("c_nationkey").cast("long").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("customers"), F.countDistinct("s_suppkey").alias("suppliers"))


@query("""SELECT d.doc_id, coalesce(d.lang, l.quality::VARCHAR, 'none') AS label, coalesce(d.source, 'unknown') AS folder FROM documents d LEFT JOIN labels l USING (doc_id)""")
def j14_filled_from_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return j.select("doc_id", F.coalesce("lang", F.col("quality").cast("string"), F.lit("none")).alias("label"), F.coalesce("source", F.lit("unknown")).alias("folder"))


@query("SELECT o_custkey AS customer, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1")
def w04_last_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))


LEADERS = "SELECT p_brand AS name, count(*) AS copies, max(p_size)::BIGINT AS score FROM part GROUP BY 1"


@query(f"SELECT * FROM ({LEADERS}) ORDER BY score DESC, copies DESC, name LIMIT 10")
def k08_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("copies"), F.max("p_size").cast("long").alias("score"))
    return by.orderBy(F.desc("score"), F.desc("copies"), "name").limit(10)


@query("""SELECT o_orderkey, o_orderpriority AS severity, round(o_totalprice, 2) AS confidence FROM orders ORDER BY confidence DESC, severity DESC, o_orderkey LIMIT 50""")
def k06_text_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("severity"), F.round("o_totalprice", 2).alias("confidence"))
    return df.orderBy(F.desc("confidence"), F.desc("severity"), "o_orderkey").limit(50)


@query("""SELECT l_partkey AS pattern, count(*) AS support, min(l_orderkey) AS first_path FROM lineitem GROUP BY 1 ORDER BY support DESC, first_path, pattern LIMIT 100""")
def k07_by_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("pattern")).agg(F.count("*").alias("support"), F.min("l_orderkey").alias("first_path"))
    return by.orderBy(F.desc("support"), "first_path", "pattern").limit(100)


@query("""SELECT event_id FROM events WHERE true AND value > 10 AND event_type <> 'click' AND (user_id = 7 OR event_type ILIKE '%ur%')""")
def p01_filter_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = filters.all_of(F.col("value") > 10, None, F.col("event_type") != "click")
    either = filters.any_of(F.col("user_id") == 7, F.lower("event_type").contains("ur"))
    return _t(spark, sf_dir, "events").where(test & either).select("event_id")


@query("""SELECT event_id, event_type NOT IN ('purchase', 'view') AS pending, (event_type IN ('click') OR props IS NULL) AS selected,
length(trim(coalesce(props, ''))) > 0 AS filled FROM events""")
def p05_state_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("event_type")
    return _t(spark, sf_dir, "events").select("event_id", (~c.isin("purchase", "view")).alias("pending"), (c.isin("click") | F.col("props").isNull()).alias("selected"), filters.not_blank(F.coalesce("props", F.lit(""))).alias("filled"))


@query("""SELECT page_id FROM pages WHERE url LIKE 'http%' AND NOT (url LIKE '%.pdf') AND url NOT LIKE '%/tag/%' AND url NOT LIKE '%/private/%'""")
def p08_outside_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _t(spark, sf_dir, "pages").where(filters.under(url, "http") & ~url.endswith(".pdf") & filters.outside(url, ["%/tag/%", "%/private/%"])).select("page_id")


@query("SELECT c_custkey, c_nationkey % 3 = 0 AS is_audio, CASE WHEN c_nationkey % 3 = 0 THEN 'audio' ELSE 'documents' END AS run FROM customer")
def p12_run_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    audio = F.col("c_nationkey") % 3 == 0
    return _t(spark, sf_dir, "customer").select("c_custkey", audio.alias("is_audio"), F.when(filters.of_kind(audio, "audio"), "audio").when(filters.of_kind(audio, "documents"), "documents").alias("run"))


COMMUNITY = """cn AS (SELECT r.*, s.name AS sn, t.name AS tn, CASE WHEN s.type = t.type THEN s.t2 WHEN s.t2 < t.t2 THEN s.t2 || ' and ' || t.t2 ELSE t.t2 || ' and ' || s.t2 END
  || ' ' || CASE kind WHEN 'USES' THEN 'Uses' WHEN 'DEPENDS_ON' THEN 'Depends On' ELSE 'Owns' END AS cname
FROM rr r JOIN (SELECT *, upper(type[1]) || type[2:] AS t2 FROM entities) s ON s.entity_id = source JOIN (SELECT *, upper(type[1]) || type[2:] AS t2 FROM entities) t ON t.entity_id = target),
ce AS (SELECT DISTINCT cname, source AS id, sn AS n FROM cn UNION SELECT DISTINCT cname, target, tn FROM cn)"""


@query(f"""WITH {VIEWS}, {REL_ROWS}, {COMMUNITY},
a AS (SELECT cname AS name, array_to_string(list_sort(list(DISTINCT kind)), ', ') AS kinds, sum(evidence_count)::BIGINT AS evidence FROM cn GROUP BY 1),
b AS (SELECT cname AS name, count(DISTINCT id) AS entity_count, array_to_string(list_sort(list(DISTINCT n))[1:8], ', ') AS shown FROM ce GROUP BY 1)
SELECT name, entity_count, kinds, evidence, name || ' connects ' || entity_count || ' entities through ' || kinds || '. Representative members: ' || shown || '.' AS summary FROM a JOIN b USING (name)""")
def g06_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return K.communities(K.relationship_rows(g["relationships"], g["evidence"]), g["entities"]).drop("source_hash")


@query("""SELECT type, kind, replace(type || ' ' || kind, '_', ' ') AS raw, upper(type[1]) || type[2:] || ' Works With' AS name FROM
(SELECT DISTINCT CASE c_nationkey % 2 WHEN 0 THEN 'person' ELSE 'team' END AS type, 'works_with' AS kind FROM customer)""")
def f11_community_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") % 2 == 0, "person").otherwise("team").alias("type"), F.lit("works_with").alias("kind")).distinct()
    return df.select("type", "kind", F.translate(F.concat_ws(" ", "type", "kind"), "_", " ").alias("raw"), labels.community_name(F.col("type"), F.col("type"), F.col("kind")).alias("name"))


EDGES = """ed AS (SELECT 'relationship:' || rel_id AS key, 'entity:' || source AS source, 'entity:' || target AS target, kind AS label,
  greatest(1, least(8, evidence_count))::DOUBLE AS size, round(edge_weight, 6) AS weight, evidence_count AS count FROM rr WHERE source IN (SELECT entity_id FROM entities) AND target IN (SELECT entity_id FROM entities)
UNION ALL SELECT 'mention:' || entity_id || ':' || file_id, 'entity:' || entity_id, 'file:' || file_id, 'MENTIONED_IN', greatest(1, least(6, count(*)))::DOUBLE, greatest(1, count(*))::DOUBLE, count(*)
FROM mentions WHERE entity_id IN (SELECT entity_id FROM entities) GROUP BY entity_id, file_id)"""


def _edges(g: dict[str, DataFrame]) -> DataFrame:
    return K.snapshot_edges(g["entities"], K.relationship_rows(g["relationships"], g["evidence"]), K.mention_edges(g["mentions"])).withColumn("weight", F.round("weight", 6))


@query(f"WITH {VIEWS}, {REL_ROWS}, {EDGES} SELECT * FROM ed")
def g09_snapshot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(_graph(spark, sf_dir))


@query(f"""WITH {VIEWS}, {REL_ROWS}, {EDGES}, dg AS (SELECT key, sum(n)::BIGINT AS d FROM (SELECT source AS key, count AS n FROM ed UNION ALL SELECT target, count FROM ed) GROUP BY 1),
nd AS (SELECT 'entity:' || entity_id AS key, name AS label, type, 'entity' AS k, NULL AS m FROM entities UNION ALL SELECT 'file:' || file_id, file_name, 'document', 'file', NULL FROM files
  UNION ALL SELECT 'community:' || community_id, name, 'community', 'community', (SELECT count(*) FROM members m WHERE m.community_id = c.community_id) FROM communities c),
w AS (SELECT key, label, type, k, coalesce(m, d, 0)::BIGINT AS degree, greatest(1, coalesce(m, d, 0))::DOUBLE AS weight FROM nd LEFT JOIN dg USING (key))
SELECT key, label, type, degree, weight, round(CASE k WHEN 'entity' THEN greatest(4, least(22, 4 + sqrt(weight) * 2)) WHEN 'file' THEN greatest(5, least(18, 4 + sqrt(weight) * 1.6)) ELSE greatest(8, least(26, 5 + sqrt(weight) * 3)) END, 4) AS size FROM w""")
def g08_snapshot_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return K.snapshot_nodes(g["entities"], g["files"], K.community_rows(g["communities"], g["members"]), _edges(g))


@query(f"""WITH {VIEWS}, {REL_ROWS}, {EDGES}, p AS (SELECT *, row_number() OVER (ORDER BY key) AS position FROM ed),
n AS (SELECT * FROM p WHERE source = 'entity:3' OR target = 'entity:3' ORDER BY position LIMIT 40) SELECT key, source, target, label FROM n""")
def r13_ego_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(_graph(spark, sf_dir)).withColumn("position", F.col("key"))
    return K.ego(edges.select(F.col("source").alias("key")).distinct(), edges, "entity:3", 40)[1].select("key", "source", "target", "label")


@query(f"""WITH {VIEWS}, j AS (SELECT c.community_id, c.name, c.summary, e.entity_id, e.name AS member FROM communities c LEFT JOIN members m USING (community_id) LEFT JOIN entities e USING (entity_id))
SELECT community_id, name, summary, count(entity_id) AS member_count FROM j WHERE name ILIKE '%on%' OR summary ILIKE '%on%' OR member ILIKE '%on%' GROUP BY ALL ORDER BY member_count DESC, name, community_id LIMIT 20""")
def r10_community_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return K.search_communities(g["communities"], g["members"], g["entities"], "on")


SUMMARIES = "SELECT o_orderkey AS summary_id, (o_custkey % 50)::VARCHAR AS document_id, 'file ' || o_custkey % 50 AS file_name, o_orderdate AS created_at FROM orders"


@query(f"SELECT summary_id, document_id FROM ({SUMMARIES}) WHERE document_id = '7' OR file_name ILIKE '%le 12%' ORDER BY created_at DESC, summary_id DESC LIMIT 1")
def r11_latest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("o_custkey") % 50
    s = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("summary_id"), doc.cast("string").alias("document_id"), F.concat(F.lit("file "), doc).alias("file_name"), F.col("o_orderdate").alias("created_at"))
    return K.latest_summary(s, "7", "le 12").select("summary_id", "document_id")


@query("SELECT o_orderstatus AS scope, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS snapshot_id FROM orders GROUP BY 1")
def r14_current_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("scope"), F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("created_at"))
    return ledger.rotated(s).where("current").select("scope", "snapshot_id")


FLAT = r"trim(regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY turn, text), '\s+', ' ', 'g'))"


@query(f"""WITH s AS (SELECT conv_id, {FLAT} AS flat FROM conversations WHERE text IS NOT NULL GROUP BY 1),
p AS (SELECT conv_id, flat, list_filter(string_split_regex(regexp_replace(flat, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 30)[1:3] AS long FROM s WHERE flat <> '')
SELECT conv_id, CASE WHEN len(long) > 0 THEN array_to_string(long, ' ') ELSE flat[1:700] END[1:1200] AS summary FROM p""")
def g11_document_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.document_summaries(_t(spark, sf_dir, "conversations").where("text is not null"), ["conv_id"], "turn", "text").drop("source_hash")


@query(f"WITH {VIEWS} SELECT part, n, n > 0 AS ready FROM (SELECT 'entities' AS part, count(*) AS n FROM entities UNION ALL SELECT 'relationships', count(*) FROM rels UNION ALL SELECT 'evidence', count(*) FROM evidence UNION ALL SELECT 'communities', count(*) FROM communities)")
def g13_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return K.readiness({k: g[k] for k in ("entities", "relationships", "evidence", "communities")})


@query("""SELECT lang AS file, count(*) AS chunks, count(source) AS with_section, count(DISTINCT source) AS sections, round(count(source) / count(*)::DOUBLE, 4) AS coverage
FROM documents WHERE lang ILIKE '%e%' GROUP BY 1""")
def g14_structure_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.structure_status(_t(spark, sf_dir, "documents").withColumn("section", F.col("source")), F.col("lang"), "e")


CHUNK_STATE = "SELECT doc_id AS chunk_id, CASE doc_id % 3 WHEN 0 THEN 'v1' ELSE 'v2' END AS version, CASE doc_id % 5 WHEN 0 THEN 'failed' ELSE 'done' END AS status FROM documents WHERE doc_id % 4 > 0"


@query(f"WITH s AS ({CHUNK_STATE}) SELECT doc_id AS chunk_id FROM documents d LEFT JOIN s ON s.chunk_id = d.doc_id WHERE length(trim(text, ' ')) > 0 AND NOT coalesce(version = 'v2' AND status <> 'failed', false)")
def g01_pending_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = _t(spark, sf_dir, "documents"), F.col("doc_id")
    state = d.where("doc_id % 4 > 0").select(k.alias("chunk_id"), F.when(k % 3 == 0, "v1").otherwise("v2").alias("version"), F.when(k % 5 == 0, "failed").otherwise("done").alias("status"), F.sha2("text", 256).alias("content_hash"))
    return K.pending_chunks(d.select(k.alias("chunk_id"), F.col("text").alias("content")), state, "v2").select("chunk_id")


@query("""WITH f AS (SELECT l_orderkey AS chunk_id, 'e' || l_suppkey % 5 AS s, 'e' || l_partkey % 7 AS t FROM lineitem), e AS (SELECT DISTINCT l_orderkey AS chunk_id, 'e' || l_suppkey % 5 AS key FROM lineitem)
SELECT f.chunk_id, s AS s_key, t AS t_key, count(*) AS n FROM f JOIN e a ON a.chunk_id = f.chunk_id AND a.key = s JOIN e b ON b.chunk_id = f.chunk_id AND b.key = t WHERE s <> t GROUP BY ALL""")
def g04_persist_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, kind = _t(spark, sf_dir, "lineitem"), F.lit("concept")
    name = lambda c, n: F.concat(F.lit("E"), (F.col(c) % n).cast("string"))
    found = l.select(F.col("l_orderkey").alias("chunk_id"), name("l_suppkey", 5).alias("source"), kind.alias("source_type"), name("l_partkey", 7).alias("target"), kind.alias("target_type"), F.lit("USES").alias("kind"), F.lit(None).cast("double").alias("confidence"))
    entities = l.select(F.col("l_orderkey").alias("chunk_id"), F.lower(name("l_suppkey", 5)).alias("key"), kind.alias("type"))
    return K.persist_relationships(found, entities).groupBy("chunk_id", "s_key", "t_key").agg(F.count("*").alias("n"))


# ---- changing tables

QUEUE = "SELECT o_orderkey AS file_id, CASE o_orderkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'done' ELSE 'chunking' END AS status, o_orderkey % 3 AS attempts FROM orders"


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(k % 4 == 0, "failed").when(k % 4 == 1, "done").otherwise("chunking")
    return _t(spark, sf_dir, "orders").select(k.alias("file_id"), status.alias("status"), (k % 3).alias("attempts"), F.when(k % 4 == 0, "broken").alias("error"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS line FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def d02_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    left = ledger.delete_cascade({"lines": _t(spark, sf_dir, "lineitem"), "orders": _t(spark, sf_dir, "orders")}, gone, "l_orderkey")
    return left["lines"].select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"))


@query(f"SELECT file_id, CASE WHEN file_id % 7 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN file_id % 7 = 0 THEN 0 ELSE attempts END AS attempts FROM ({QUEUE})")
def d03_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _queue(spark, sf_dir)
    return ledger.enqueued(q, q.where("file_id % 7 = 0")).drop("error")


@query(f"SELECT file_id, CASE status WHEN 'failed' THEN 'pending' ELSE status END AS status, attempts FROM ({QUEUE})")
def d06_retry_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.retried(_queue(spark, sf_dir)).drop("error")


@query(f"""WITH q AS ({QUEUE}), c AS (SELECT l_orderkey AS file_id, count(*) AS chunks, count(CASE WHEN l_linenumber > 1 THEN 1 END) AS with_section FROM lineitem GROUP BY 1)
SELECT o_orderkey AS file_id, coalesce(chunks, 0) AS chunks, coalesce(with_section, 0) AS with_section, status FROM orders o LEFT JOIN c ON c.file_id = o_orderkey LEFT JOIN q ON q.file_id = o_orderkey
WHERE o_orderstatus <> 'P' AND coalesce(with_section, 0) < greatest(coalesce(chunks, 0), 1) AND status IN ('done', 'failed')""")
def d07_reindex_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), (F.col("o_orderstatus") == "P").alias("is_audio"))
    chunks = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.when(F.col("l_linenumber") > 1, F.lit("s")).alias("section"))
    return ledger.reindex_candidates(files, chunks, _queue(spark, sf_dir))


@query("""SELECT l_orderkey AS file_id, l_linenumber::BIGINT AS at, 'old' AS of FROM lineitem WHERE l_orderkey % 5 > 0
UNION ALL SELECT o_orderkey, 0, 'new' FROM orders WHERE o_orderkey % 5 = 0""")
def d08_replace_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").cast("long").alias("at"), F.lit("old").alias("of"))
    new = _t(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("file_id"), F.lit(0).cast("long").alias("at"), F.lit("new").alias("of"))
    return ledger.replace_by_key(old, new, "file_id")


@query("""SELECT o_orderkey AS snapshot_id, o_orderstatus AS scope, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS current FROM orders""")
def d14_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderstatus").alias("scope"), F.col("o_orderdate").alias("created_at"))
    return ledger.rotated(s).drop("created_at")


@query("""SELECT owner, source_hash, arg_max(v, (n, made)) AS text FROM (SELECT c_nationkey AS owner, c_mktsegment AS source_hash, 'old ' || c_custkey AS v, 0 AS n, c_custkey AS made FROM customer
UNION ALL SELECT c_nationkey, c_mktsegment, 'new ' || c_custkey, 1, c_custkey FROM customer WHERE c_custkey % 6 = 0) GROUP BY 1, 2""")
def d15_upsert_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    row = lambda tag: [F.col("c_nationkey").alias("owner"), F.lit("m").alias("model"), F.lit("1").alias("prompt_version"), F.col("c_mktsegment").alias("source_hash"), F.concat(F.lit(tag + " "), F.col("c_custkey").cast("string")).alias("text"), F.col("c_custkey").alias("created_at")]
    return ledger.upsert_summaries(c.select(*row("old")), c.where("c_custkey % 6 = 0").select(*row("new"))).select("owner", "source_hash", "text")


INVENTORY = """b AS (SELECT 'r' || p_size % 2 AS root, p_name AS path, min(p_size)::BIGINT AS signature, min(p_partkey) AS k FROM part WHERE p_partkey % 5 > 0 GROUP BY 1, 2),
n AS (SELECT 'r' || p_size % 2 AS root, p_name AS path, min(CASE WHEN p_partkey % 7 = 0 THEN 99 ELSE p_size END)::BIGINT AS signature, min(p_partkey) AS k FROM part WHERE p_partkey % 6 > 0 GROUP BY 1, 2)"""


@query(f"""WITH {INVENTORY} SELECT root, path, coalesce(n.signature, b.signature) AS signature, CASE WHEN n.path IS NULL THEN 'removed' ELSE 'active' END AS status,
CASE WHEN b.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'removed' WHEN n.signature = b.signature THEN 'same' ELSE 'changed' END AS change FROM b FULL JOIN n USING (root, path)""")
def d17_inventory_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, none = _t(spark, sf_dir, "part"), F.lit(None).cast("string").alias("content_hash")
    by = lambda df, size: df.groupBy(F.concat(F.lit("r"), F.col("p_size") % 2).alias("root"), F.col("p_name").alias("path")).agg(F.min(size).cast("long").alias("signature")).withColumn("status", F.lit("active"))
    before = by(p.where("p_partkey % 5 > 0"), F.col("p_size")).select("*", none)
    now = by(p.where("p_partkey % 6 > 0"), F.when(F.col("p_partkey") % 7 == 0, 99).otherwise(F.col("p_size"))).select("*", none)
    return ledger.inventory_change(before, now).drop("content_hash")


@query("""WITH f AS (SELECT p_partkey AS finding_id, p_type AS issue_type, p_name AS path FROM part), d AS (SELECT l_partkey AS finding_id, CASE l_returnflag WHEN 'A' THEN 'accepted' ELSE 'rejected' END AS status FROM lineitem)
SELECT d.status || ':' || issue_type || ':' || path AS pattern, count(*) AS times FROM d JOIN f USING (finding_id) GROUP BY 1""")
def d19_review_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("finding_id"), F.col("p_type").alias("issue_type"), F.col("p_name").alias("path"), F.lit("open").alias("status"))
    d = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("finding_id"), F.when(F.col("l_returnflag") == "A", "accepted").otherwise("rejected").alias("status"), F.col("l_shipdate").alias("decided_at"))
    return ledger.reviewed(f, d)[1].drop("last_at")


@query("""SELECT p_brand AS asset_key, count(*) AS copies, CASE WHEN p_brand LIKE '%1' THEN 'run 2' ELSE 'run 1' END AS first_seen FROM part GROUP BY ALL""")
def d20_replace_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("asset_key")).agg(F.count("*").alias("copies"))
    old = new.where("asset_key not like '%1'").withColumn("first_seen", F.lit("run 1"))
    return ledger.replace_assets(old, new, F.lit("run 2"))


@query("""SELECT user_id AS run_id, count(*) FILTER (event_type = 'view') > 0 AS begun, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1""")
def d22_run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.when(F.col("event_type") == "view", "start").otherwise("finish").alias("event"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("status"), F.lit(0).alias("folders"), F.lit(0).alias("findings"))
    return ledger.runs(e).select("run_id", F.col("started").isNotNull().alias("begun"), "status")


@query("""SELECT p_partkey, regexp_replace(lower(trim(p_name)), '[_ ]+', ' ', 'g') AS folder_label, replace(upper(trim(p_brand)), '-', '_') AS code, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS words,
CASE WHEN p_size % 2 = 0 THEN replace(upper(regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g')), '-', '_') END AS customer, round(p_retailprice::DOUBLE, 7) AS value FROM part""")
def f12_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_size") % 2 == 0, F.concat(F.lpad((F.col("p_size") % 100).cast("string"), 2, "0"), F.lit("_"), F.regexp_replace("p_brand", "[^A-Za-z0-9]+", "_"))).otherwise(F.lit("plain"))
    return _t(spark, sf_dir, "part").select("p_partkey", labels.folder_label(F.col("p_name")).alias("folder_label"), labels.code(F.col("p_brand")).alias("code"), labels.label_words(F.col("p_type")).alias("words"), labels.customer_code(name, ["ACME"]).alias("customer"), labels.rounded_vector(F.array("p_retailprice"))[0].alias("value"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE event_id::VARCHAR END AS n FROM events""")
def f30_salvaged_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id").cast("string")
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"n": '), k, F.lit("}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('Sure! {"n": '), k, F.lit(', "x": {"y": 1}} Hope it helps.'))).otherwise(F.concat(F.lit("no object "), k))
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object(labels.salvaged_json(answer), "$.n").alias("n"))


@query("""SELECT c_custkey, coalesce(b, a) AS region, 'x' AS kept FROM (SELECT c_custkey, c_mktsegment AS a, CASE WHEN c_nationkey % 2 = 0 THEN c_name END AS b FROM customer)""")
def f46_merged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.create_map(F.lit("region"), "c_mktsegment", F.lit("kept"), F.lit("x"))
    m = labels.merged_maps(old, F.when(F.col("c_nationkey") % 2 == 0, F.create_map(F.lit("region"), "c_name")))
    return _t(spark, sf_dir, "customer").select("c_custkey", m["region"].alias("region"), m["kept"].alias("kept"))
