"""Queries over streams, incremental refresh and metadata; registered like the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atheneum.functions.text import terms
from atheneum.operators import calls, knowledge, merge, steps
from atheneum.operators.refresh import Graph
from atheneum.registry import query
from atheneum.registry import table as _t
from atheneum.storage import fresh_path, written
from atheneum.streaming import machine

STATUS_SQL = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'converting' WHEN 'click' THEN 'chunking' WHEN 'purchase' THEN 'done' ELSE 'failed' END"


def _run_in_parts(rows: DataFrame, parts: list, changes) -> str:  # noqa: ANN001
    """Feeds rows to a stream part by part, each a run that goes on from the last one's checkpoint; gives the path of its changes."""
    spark = rows.sparkSession
    source, out, check = (fresh_path(spark, name) for name in ("arrivals", "changes", "progress"))
    for part in parts:
        rows.where(part).write.mode("append").parquet(source)
        machine.start(changes(spark.readStream.schema(rows.schema).parquet(source)), out, check).awaitTermination()
    return out


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, {STATUS_SQL} AS status, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::VARCHAR AS status, 0::BIGINT AS attempts, NULL::TIMESTAMP AS started, NULL::TIMESTAMP AS completed, NULL::VARCHAR AS error, 0::BIGINT AS refused FROM events
UNION ALL SELECT user_id, n, CASE WHEN ok THEN asked ELSE status END, attempts + CASE WHEN ok AND asked = 'failed' AND status <> 'failed' THEN 1 ELSE 0 END,
  CASE WHEN ok AND asked = 'pending' THEN NULL WHEN ok AND asked NOT IN ('done', 'failed') THEN coalesce(started, ts) ELSE started END,
  CASE WHEN ok AND asked = 'pending' THEN NULL WHEN ok AND asked IN ('done', 'failed') THEN ts ELSE completed END,
  CASE WHEN ok AND asked IN ('pending', 'done') THEN NULL WHEN ok AND asked = 'failed' THEN 'at ' || event_id ELSE error END, refused + CASE WHEN ok THEN 0 ELSE 1 END
  FROM (SELECT e.user_id, e.n, e.event_id, e.ts, e.status AS asked, s.status, attempts, started, completed, error, refused, coalesce(e.status = s.status, false) OR CASE coalesce(s.status, '') WHEN '' THEN e.status = 'pending'
    WHEN 'pending' THEN e.status IN ('converting', 'failed') WHEN 'converting' THEN e.status IN ('chunking', 'done', 'failed') WHEN 'chunking' THEN e.status IN ('done', 'failed') ELSE e.status = 'pending' END AS ok
    FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
SELECT user_id AS key, status, attempts, started, completed, error, refused FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS last FROM s) WHERE last = 1 AND status IS NOT NULL""")
def st01_queue_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue's state machine as a stream in two runs; moves that are not allowed are refused and counted."""
    e = _t(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.expr(STATUS_SQL).alias("status"))
    none = F.lit(None).cast("string")
    rows = rows.withColumns({"error": F.when(F.col("status") == "failed", F.concat(F.lit("at "), F.col("seq").cast("string"))), "stage": none, "seconds": none.cast("double")})
    half = e.agg(F.max("event_id")).first()[0] // 2
    out = _run_in_parts(rows, [F.col("seq") <= half, F.col("seq") > half], lambda s: machine.queue_changes(s, stuck_seconds=10**8))
    return machine.latest(spark, out).select("key", "status", "attempts", F.col("started").cast("timestamp_ntz").alias("started"), F.col("completed").cast("timestamp_ntz").alias("completed"), "error", "refused")


SCANS_SQL = """scans AS (SELECT doc_id::VARCHAR AS path, k, CASE doc_id % 4 WHEN 0 THEN 'v' || k ELSE 'v0' END || length(text) AS file_hash FROM documents, range(3) t(k) WHERE (doc_id * 7 + k * 3) % 5 <> 0)"""


@query(f"""WITH {SCANS_SQL}, before AS (SELECT s.*, p.file_hash AS old, p.path AS had, n.path AS has FROM scans s LEFT JOIN scans p ON p.path = s.path AND p.k = s.k - 1 LEFT JOIN scans n ON n.path = s.path AND n.k = s.k + 1)
SELECT path, k, file_hash, CASE WHEN had IS NULL THEN 'new' WHEN old = file_hash THEN 'unchanged' ELSE 'changed' END AS change FROM before UNION ALL SELECT path, k, file_hash, 'vanished' FROM before WHERE has IS NULL AND k < 2""")
def st02_file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scans of the documents as files: what is new, changed, unchanged and, by timers, vanished."""
    d = _t(spark, sf_dir, "documents").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).where((F.col("doc_id") * 7 + F.col("k") * 3) % 5 != 0)
    version = F.when(F.col("doc_id") % 4 == 0, F.col("k")).otherwise(0)
    hour = F.timestamp_seconds(F.lit(1_767_225_600) + F.col("k") * 3600)
    scans = d.select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("v"), version.cast("string"), F.length("text").cast("string")).alias("file_hash"), hour.alias("scan_at"))
    at = [F.col("scan_at") == F.timestamp_seconds(F.lit(1_767_225_600 + k * 3600)) for k in range(3)]
    out = _run_in_parts(written(scans, "scans"), at, lambda s: machine.file_changes(s, 1800))  # texts are read once
    k = ((F.unix_timestamp("scan_at") - 1_767_225_600) / 3600).cast("long")
    return spark.read.parquet(out).select("path", k.alias("k"), "file_hash", "change")


# Chunks are orders: each has evidence for an edge from its customer to a target, and mentions its customer. In the end
# the cancelled ones (status P) are gone, the open ones have another target, and the rest came in two parts.
CHUNK_SQL = """chunks AS (SELECT o_orderkey AS chunk, o_custkey AS node, CASE o_orderstatus WHEN 'O' THEN o_orderkey % 40 ELSE o_orderkey % 50 END AS target FROM orders WHERE o_orderstatus <> 'P')"""


@query(f"""WITH {CHUNK_SQL}, e AS (SELECT DISTINCT node * 1000 + target AS edge_id, node AS source, 1000000 + target AS target FROM chunks),
ends AS (SELECT source AS node FROM e UNION ALL SELECT target FROM e), d AS (SELECT node, count(*) AS degree FROM ends GROUP BY 1), m AS (SELECT node, count(*) AS mentions FROM chunks GROUP BY 1)
SELECT node, coalesce(degree, 0) AS degree, coalesce(mentions, 0) AS mentions, greatest(1, coalesce(degree, 0) + coalesce(mentions, 0)) AS weight FROM d FULL JOIN m USING (node)""")
def g12_incremental_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node weights kept by signed deltas over two inserts, an update and a delete, equal to a recount of what is left."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk"), F.col("o_custkey").alias("node"), F.col("o_orderstatus").alias("status"))

    def evidence(rows: DataFrame, targets: int) -> DataFrame:
        target = F.col("chunk") % targets
        return rows.select((F.col("node") * 1000 + target).alias("edge_id"), F.col("node").alias("source"), (1_000_000 + target).alias("target"))

    none, first, late = o.limit(0), o.where("chunk % 3 <> 0"), o.where("chunk % 3 = 0")
    opened, gone = o.where("status = 'O'"), o.where("status = 'P'")
    graph = Graph.empty(spark, fresh_path(spark, "graph"))
    for name, before, after in (("first", none, first), ("late", none, late), ("gone", gone, none)):
        graph = graph.changed(name, (evidence(before, 50), evidence(after, 50)), (before, after))
    graph = graph.changed("moved", (evidence(opened, 50), evidence(opened, 40)), (opened, opened))
    return graph.weights()


@query("""WITH old AS (SELECT c_nationkey AS n, c_mktsegment AS type, min(c_custkey) AS id, list(DISTINCT 'a' || c_custkey % 3) AS aliases, max(c_custkey) AS k FROM customer GROUP BY 1, 2),
new AS (SELECT s_nationkey AS n, CASE s_suppkey % 2 WHEN 0 THEN 'BUILDING' ELSE 'ROBOT' END AS type, s_suppkey AS seq, 'a' || s_suppkey % 5 AS alias FROM supplier),
names AS (SELECT n, type FROM old UNION SELECT n, type FROM new),
al AS (SELECT n, type, string_agg(DISTINCT x, ',' ORDER BY x) AS aliases FROM (SELECT n, type, unnest(aliases) AS x FROM old UNION ALL SELECT n, type, alias FROM new) GROUP BY ALL),
v AS (SELECT n, type, max(seq) AS last, max(seq) FILTER (seq % 4 = 0) AS odd FROM new GROUP BY ALL)
SELECT 'n' || n AS name, type, al.aliases, coalesce(last, k) AS seen, CASE WHEN k IS NOT NULL THEN 'old' END AS origin, odd, last IS NOT NULL AS touched, id FROM names LEFT JOIN old USING (n, type) LEFT JOIN al USING (n, type) LEFT JOIN v USING (n, type)""")
def d09_merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with metadata of their own after new ones: fields are replaced one by one, aliases united, ids kept."""
    c, s = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier")
    name = lambda k: F.concat(F.lit("n"), F.col(k).cast("string")).alias("name")
    alias = lambda k, n: F.concat(F.lit("a"), (F.col(k) % n).cast("string"))
    old = c.groupBy(name("c_nationkey"), F.col("c_mktsegment").alias("type")).agg(F.min("c_custkey").cast("long").alias("id"), F.collect_set(alias("c_custkey", 3)).alias("aliases"), F.to_json(F.struct(F.max("c_custkey").alias("seen"), F.lit("old").alias("origin"))).alias("metadata"), F.lit(None).cast("timestamp").alias("updated_at"))
    k = F.col("s_suppkey")
    new = s.select(k.alias("seq"), name("s_nationkey"), F.when(k % 2 == 0, "BUILDING").otherwise("ROBOT").alias("type"), F.array(alias("s_suppkey", 5)).alias("aliases"), F.to_json(F.struct(k.alias("seen"), F.when(k % 4 == 0, k).alias("odd"))).alias("metadata"))
    got = merge.upserted_entities(old, new)
    of = lambda path, kind: F.try_variant_get(F.parse_json("metadata"), f"$.{path}", kind).alias(path)
    return got.select("name", "type", F.array_join("aliases", ",").alias("aliases"), of("seen", "long"), of("origin", "string"), of("odd", "long"), F.col("updated_at").isNotNull().alias("touched"), F.when(of("origin", "string") == "old", F.col("id")).alias("id"))


@query("""WITH old AS (SELECT l_suppkey AS source, l_returnflag AS kind, l_partkey AS target, max(l_discount) AS c FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL), new AS (SELECT l_suppkey AS source, l_returnflag AS kind, l_partkey AS target, max(l_discount) AS c, count(*) AS n FROM lineitem WHERE l_linenumber > 1 GROUP BY ALL)
SELECT source, kind, target, round(greatest(coalesce(old.c, 0), coalesce(new.c, 0)), 4)::DOUBLE AS confidence, old.c IS NOT NULL AS was, new.c IS NOT NULL AS came FROM old FULL JOIN new USING (source, kind, target)""")
def d10_upsert_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships after new ones: the greater confidence stays, metadata keeps the fields of both."""
    line = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("target"), F.col("l_discount").cast("double").alias("confidence"), F.col("l_orderkey").alias("seq"), "l_linenumber")
    first = line.where("l_linenumber = 1").groupBy("source", "kind", "target").agg(F.max("confidence").alias("confidence"), F.min("seq").alias("id"))
    old = first.select("id", "source", "kind", "target", "confidence", F.lit('{"was": true}').alias("metadata"), F.lit(None).cast("timestamp").alias("updated_at"))
    got = merge.upserted_relationships(old, line.where("l_linenumber > 1").withColumn("metadata", F.lit('{"came": true}')))
    of = lambda path: F.coalesce(F.try_variant_get(F.parse_json("metadata"), f"$.{path}", "boolean"), F.lit(False)).alias(path)
    return got.select("source", "kind", "target", F.round("confidence", 4).alias("confidence"), of("was"), of("came"))


@query(r"""WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), names AS (SELECT min(doc_id) AS id, w FROM (SELECT doc_id, list_filter(t, lambda x: len(x) >= 8)[1] AS w FROM tok WHERE doc_id % 20 = 0) WHERE w IS NOT NULL GROUP BY w),
m AS (SELECT doc_id, i, id FROM (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM tok) JOIN names USING (w)),
e AS (SELECT DISTINCT id AS source, after AS target FROM (SELECT id, lead(id) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM m) WHERE after <> id),
d AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM e UNION ALL SELECT target FROM e) GROUP BY 1), n AS (SELECT id AS node, count(*) AS mentions FROM m GROUP BY 1)
SELECT node, coalesce(degree, 0) AS degree, mentions, greatest(1, coalesce(degree, 0) + mentions) AS weight FROM n LEFT JOIN d USING (node)""")
def g12_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The knowledge refresh as steps: summaries, mentions of names by the linker, relationships of neighbouring mentions, weights."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    first = F.try_element_at(F.filter(terms(F.col("text")), lambda w: F.length(w) >= 8), F.lit(1))
    names = docs.where("doc_id % 20 = 0").select("doc_id", first.alias("name")).where("name is not null").groupBy("name").agg(F.min("doc_id").alias("id"))
    store = steps.Store(spark, fresh_path(spark, "refresh"))
    tables, told = store.run(knowledge.refresh_steps(), {"documents": docs, "names": names.select("id", "name", F.lit(None).cast("array<string>").alias("aliases"))})
    if any(t != "made" for t in told.values()):
        raise RuntimeError(f"{told}: {store.done}")
    return tables["weights"]


def _sizes(rows: list[dict]) -> dict:
    """Stands in for a model: it cannot take some rows, leaves some out, and gives some an answer that is no label."""
    if any(r["id"] % 17 == 0 for r in rows):
        raise ValueError("too hard")
    return {r["id"]: "huge" if r["id"] % 13 == 0 else ("long" if len(r["text"]) > 1000 else "short") for r in rows if r["id"] % 19}


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 17 = 0 OR doc_id % 19 = 0 OR doc_id % 13 = 0 THEN 'unknown' WHEN length(text) > 1000 THEN 'long' ELSE 'short' END AS label, CASE WHEN doc_id % 17 = 0 OR doc_id % 19 = 0 OR doc_id % 13 = 0 THEN 0.2 ELSE 0.8 END::DOUBLE AS confidence,
CASE WHEN doc_id % 17 = 0 THEN 'failed' WHEN doc_id % 19 = 0 THEN 'missing' ELSE 'done' END AS status, CASE WHEN doc_id % 17 = 0 OR doc_id % 19 = 0 THEN 2 ELSE 1 END AS attempts FROM documents""")
def n05_model_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents by a model in batches of 30, and a second round for what failed or was left out."""
    items = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    ledger = spark.createDataFrame([], "id long, version string, content_hash string, status string, error string, attempts int")
    answers = None
    for _ in range(2):
        todo = calls.open_items(items, ledger, "v1", F.col("text"))
        got = written(calls.answered(todo, _sizes), "answers")
        ledger = written(calls.noted(ledger, items, got, "v1", F.col("text")), "ledger")
        answers = got if answers is None else got.unionByName(answers.join(got.select("id"), "id", "left_anti"))
    return calls.labelled(answers, ["long", "short"]).join(ledger.select("id", "status", "attempts"), "id")
