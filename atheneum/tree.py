"""Queries over a folder tree: types, roles, template checks, cross-root topics, registry gaps, placement. Paths are made from the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atheneum.functions import filters, labels
from atheneum.functions import paths as P
from atheneum.operators import classify as C
from atheneum.operators import ledger, steward, template
from atheneum.registry import query
from atheneum.registry import table as _t

RULES = C.Rules(
    top_level={"00 Agent Inbox": {"type": "inbox"}, "01 Project": {"type": "root"}, "02 Ops": {"type": "root", "category": "operations"}, "04 Resources": {"type": "root", "category": "resource"}},
    inboxes=["*/Incoming"], customers={"C1": "First", "C2": "Second", "C3": "Third"}, stages={"presales": "A. PreSales"}, containers=["data", "images"],
    projects={"01 Project/2021/03_C3/Alpha 5": {"project_id": "2021-C3", "customer_code": "C3", "initiative_type": "workshop", "lifecycle": "delivery"}},
    archetypes={"workshop": ["workshop"], "training_engagement": ["training"]},
)
#: A path for each part; several parts share some of them.
FOLDER = """CASE p_partkey % 14 WHEN 0 THEN '.' WHEN 1 THEN '00 Agent Inbox' WHEN 2 THEN '01 Project' WHEN 3 THEN concat('01 Project/20', 10 + p_size % 20)
WHEN 4 THEN concat('01 Project/2021/0', p_size % 7, '_C', p_size % 7) WHEN 5 THEN concat('01 Project/2021/03_C3/Alpha ', p_partkey) WHEN 6 THEN concat('01 Project/2021/03_C3/Alpha ', p_partkey, '/A.', p_size % 5, '. Proposal')
WHEN 7 THEN '04 Resources/Archive' WHEN 8 THEN concat('04 Resources/Topic ', p_partkey) WHEN 9 THEN concat('01 Project/2021/Acme.', p_partkey) WHEN 10 THEN concat('02 Ops/Beta ', p_size, '/data')
WHEN 11 THEN concat('Elsewhere/Thing ', p_partkey) WHEN 12 THEN concat('02 Ops/Repo ', p_partkey) ELSE concat('02 Ops/', p_size, '/Incoming') END"""
FOLDERS = f"WITH f AS (SELECT DISTINCT {FOLDER} AS path, p_partkey % 14 = 12 AS is_code_repo FROM part), x AS (SELECT *, split_part(path, '/', -1) AS name, split_part(path, '/', 1) AS top, len(string_split(path, '/')) AS depth FROM f)"
CLASSIFIED = f"""{FOLDERS}, c AS (SELECT path, name, CASE WHEN path = '.' THEN 'workspace_root' WHEN is_code_repo THEN 'code_repo:markers' WHEN path LIKE '%/Incoming' THEN 'allowed_empty:' || path
WHEN path IN ('00 Agent Inbox', '01 Project', '02 Ops', '04 Resources') THEN 'top_level:' || path WHEN path = '01 Project/2021/03_C3/Alpha 5' THEN 'project_registry:2021-C3' WHEN regexp_matches(name, '^20[0-9][0-9]$') THEN 'temporal:year'
WHEN name = 'Archive' THEN 'archive:name' WHEN name LIKE 'A._. Proposal' THEN 'stage:' || name WHEN name IN ('01_C1', '02_C2', '03_C3') THEN 'known_customer:' || name[4:] WHEN regexp_matches(name, '^[0-9][0-9]_C[0-9]$') THEN 'customer_code:unknown'
WHEN path LIKE '01 Project/2021/Acme%' THEN 'project_template:customer' WHEN path LIKE '01 Project/2021/03_C3/Alpha %' THEN 'project_template:initiative' WHEN name = 'data' THEN 'container:data' WHEN top IN ('02 Ops', '04 Resources') THEN 'category:' || top END AS matched_rule FROM x),
k AS (SELECT *, CASE split_part(matched_rule, ':', 1) WHEN 'workspace_root' THEN 'root' WHEN 'code_repo' THEN 'code_repo' WHEN 'allowed_empty' THEN 'inbox' WHEN 'top_level' THEN CASE path WHEN '00 Agent Inbox' THEN 'inbox' ELSE 'root' END WHEN 'project_registry' THEN 'initiative'
WHEN 'temporal' THEN 'temporal' WHEN 'archive' THEN 'archive' WHEN 'stage' THEN 'stage' WHEN 'known_customer' THEN 'customer' WHEN 'customer_code' THEN 'customer' WHEN 'container' THEN 'knowledge_asset'
WHEN 'project_template' THEN split_part(matched_rule, ':', 2) WHEN 'category' THEN CASE matched_rule WHEN 'category:02 Ops' THEN 'operations' ELSE 'resource' END END AS folder_type,
CASE split_part(matched_rule, ':', 1) WHEN 'archive' THEN 0.95 WHEN 'stage' THEN 0.98 WHEN 'known_customer' THEN 0.98 WHEN 'customer_code' THEN 0.7 WHEN 'container' THEN 0.6 WHEN 'category' THEN 0.6
WHEN 'project_template' THEN CASE WHEN matched_rule LIKE '%customer' THEN 0.72 ELSE 0.85 END WHEN NULL THEN NULL ELSE CASE WHEN matched_rule IS NULL THEN NULL ELSE 1.0 END END::DOUBLE AS confidence FROM c)"""


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select(F.expr(FOLDER).alias("path"), (F.col("p_partkey") % 14 == 12).alias("is_code_repo")).distinct()


@query(f"{CLASSIFIED} SELECT path, matched_rule, folder_type, confidence FROM k")
def n04_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classify(_folders(spark, sf_dir), RULES).select("path", "matched_rule", "folder_type", "confidence")


@query(f"{CLASSIFIED} SELECT path, coalesce(folder_type, 'unknown') AS folder_type, coalesce(confidence, 0.2::DOUBLE) AS confidence FROM k")
def n05_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fallback(C.classify(_folders(spark, sf_dir), RULES)).select("path", "folder_type", "confidence")


@query(f"""{CLASSIFIED} SELECT path, CASE WHEN folder_type IN ('root', 'customer', 'initiative', 'stage') THEN folder_type WHEN folder_type = 'code_repo' THEN 'container' WHEN regexp_matches(name, '^20[0-9][0-9]$') THEN 'temporal'
WHEN name IN ('data', 'Archive') THEN 'container' WHEN folder_type = 'inbox' THEN 'container' WHEN folder_type = 'operations' THEN 'administrative' ELSE 'resource_library' END AS role FROM k""")
def n06_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classify(_folders(spark, sf_dir), RULES).select("path", C.role(F.col("folder_type"), P.name(F.col("path")), RULES.containers).alias("role"))


@query(f"""{FOLDERS}, s AS (SELECT path, CASE path WHEN '.' THEN 'x' ELSE md5(path) END AS content_signature FROM f), d AS (SELECT path, content_signature FROM s WHERE length(path) % 2 = 0) SELECT path FROM s WHERE path NOT IN (SELECT path FROM d)""")
def n03_unclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _folders(spark, sf_dir).select("path", F.md5("path").alias("content_signature"), F.lit("active").alias("status"))
    return C.unclassified(f, f.where("length(path) % 2 = 0")).select("path")


INITIATIVES = "i AS (SELECT DISTINCT concat(split_part(path, '/', 1), '/', split_part(path, '/', 2), '/', split_part(path, '/', 3), '/', split_part(path, '/', 4)) AS path FROM f WHERE path LIKE '01 Project/2021/03_C3/Alpha %')"


def _initiatives(folders: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    return folders.where(F.col("path").startswith("01 Project/2021/03_C3/Alpha ")).select(F.array_join(F.slice(parts, 1, 4), "/").alias("path")).distinct()


@query(f"{FOLDERS}, {INITIATIVES} SELECT path, CASE WHEN path = '01 Project/2021/03_C3/Alpha 5' THEN 'workshop' ELSE 'sales_opportunity' END AS archetype FROM i")
def n07_archetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _folders(spark, sf_dir)
    return C.archetypes(_initiatives(f).withColumn("initiative_type", F.lit(None).cast("string")), f, RULES).select("path", "archetype")


@query(f"{FOLDERS}, {INITIATIVES} SELECT path, CASE WHEN path = '01 Project/2021/03_C3/Alpha 5' THEN 'delivery' WHEN EXISTS (SELECT 1 FROM f WHERE f.path LIKE i.path || '/A.%') THEN 'active_presales' ELSE 'lead' END AS lifecycle FROM i")
def n08_lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _folders(spark, sf_dir)
    return C.lifecycles(_initiatives(f), f, RULES).select("path", "lifecycle")


@query(f"{FOLDERS}, s AS (SELECT string_split(path, '/') AS p FROM f WHERE path LIKE '%/A._. Proposal') SELECT DISTINCT array_to_string(p[1:k], '/') AS path FROM s, unnest(range(1, len(p))) t(k)")
def n09_with_stages_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_stages_below(_folders(spark, sf_dir))


@query(f"{FOLDERS}, {INITIATIVES} SELECT path FROM f WHERE EXISTS (SELECT 1 FROM i WHERE f.path = i.path OR starts_with(f.path, i.path || '/'))")
def j16_at_or_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _folders(spark, sf_dir).select("path")
    return ledger.at_or_below(f, _initiatives(f))


TREE = [
    {"prefix": "A", "label": "PreSales", "canonical": "A. PreSales", "children": [
        {"prefix": "A.1", "label": "RFI_RFP", "canonical": "A.1. RFI_RFP", "core": True},
        {"prefix": "A.2", "label": "Proposal", "canonical": "A.2. Proposal", "core": True, "children": [{"prefix": "A.2.3", "label": "Timeline", "canonical": "A.2.3. Timeline"}]},
    ]},
    {"prefix": "B", "label": "Delivery", "canonical": "B. Delivery"},
]


@query(f"""{FOLDERS}, {INITIATIVES}, s AS (SELECT regexp_replace(path, '/[^/]*$', '') AS initiative, name[3:3] AS idx FROM x WHERE path LIKE '%/A._. Proposal')
SELECT path, path || '/A.1. RFI_RFP' AS destination FROM i WHERE NOT EXISTS (SELECT 1 FROM s WHERE initiative = path AND idx = '1')
UNION ALL SELECT path, path || '/A.2. Proposal' FROM i WHERE NOT EXISTS (SELECT 1 FROM s WHERE initiative = path)""")
def n19_missing_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _folders(spark, sf_dir)
    return template.missing_core(f, _initiatives(f), template.flatten(spark, TREE)).select("path", "destination")


@query(f"""{FOLDERS}, {INITIATIVES} SELECT path, 'renumber' AS action, 'A.2. Proposal' AS destination FROM x WHERE path LIKE '%/A._. Proposal' AND name <> 'A.2. Proposal'""")
def n15_template_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _folders(spark, sf_dir)
    return template.drift(f, _initiatives(f), template.flatten(spark, TREE)).select("path", "action", "destination")


# Stage folders of parts as initiatives: six kinds of drift, each with what is said of it.
STAGES = {0: ["A.1. RFI.RFP"], 1: ["A.2. Proposal", "A.2. Extras", "A.2. More"], 2: ["A.1. RFI_RFP", "A.1. RFI_RFP/B.1. Things", "A.1. RFI_RFP/B.1. Things/C.1. Deep"], 3: ["A.5. Proposal"], 4: ["A.2. Proposal", "A.2. Proposal/A.2.7. Timeline"], 5: ["notes", "notes/A.1. Rfi-Rfp", "A.2. Proposal", "A.3. Proposal"]}


def _staged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Folders and initiatives as STAGES has them, by p_size % 6."""
    p = _t(spark, sf_dir, "part").select(F.concat(F.lit("01 Project/2024/C"), (F.col("p_partkey") % 7).cast("string"), F.lit("/I"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") % 6).alias("v"), "p_partkey")
    below = F.lit(None).cast("array<string>")
    for v, names in STAGES.items():
        below = F.when(F.col("v") == v, F.array(*map(F.lit, names))).otherwise(below)
    folders = p.select("path").union(p.select("path", F.explode(below).alias("name")).select(F.concat_ws("/", "path", "name").alias("path")))
    return folders, p


STAGED_SQL = """WITH p AS (SELECT '01 Project/2024/C' || p_partkey % 7 || '/I' || p_partkey AS path, p_size % 6 AS v, p_partkey FROM part), said(v, name, action, destination) AS (VALUES (0, 'A.1. RFI.RFP', 'standardize', 'A.1. RFI_RFP'), (1, 'A.2. Extras', 'renumber', '/A.3. Extras'), (1, 'A.2. More', 'renumber', '/A.4. More'),
(2, 'A.1. RFI_RFP/B.1. Things', 'move', 'under ''B. Delivery'''), (3, 'A.5. Proposal', 'renumber', 'A.2. Proposal'), (4, 'A.2. Proposal/A.2.7. Timeline', 'renumber', 'A.2.3. Timeline'), (5, 'notes/A.1. Rfi-Rfp', 'standardize', 'A.1. RFI_RFP')),
f AS (SELECT p.path || '/' || name AS path, action, CASE WHEN starts_with(destination, '/') THEN p.path || destination ELSE destination END AS destination FROM p JOIN said USING (v))"""


@query(f"{STAGED_SQL} SELECT * FROM f")
def n15_template_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Siblings that collide, stages under a wrong letter (nothing is said of what is below), other spellings, shifted indices."""
    folders, p = _staged(spark, sf_dir)
    return template.drift(folders, p.select("path"), template.flatten(spark, TREE)).select("path", "action", "destination")


@query(f"""{STAGED_SQL} SELECT * FROM f UNION ALL SELECT path, 'review', path || '/' || name FROM p, (VALUES ('A.1. RFI_RFP', [0, 2]), ('A.2. Proposal', [1, 3, 4, 5])) c(name, have)
WHERE NOT list_contains(have, v) AND p_partkey % 3 = 0 AND p_partkey % 5 < 3""")
def n20_template_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole template run: initiatives and customers with stages, drift everywhere, core stages of active sales alone."""
    folders, p = _staged(spark, sf_dir)
    k = F.col("p_partkey")
    kinds = p.select("path", F.when(k % 7 == 0, "customer").otherwise("initiative").alias("folder_type"))
    inner = p.where(k % 2 == 0).select(F.concat_ws("/", "path", F.lit("inner")).alias("path"), F.lit("initiative").alias("folder_type"))  # within another: not looked at apart
    archetypes = p.select("path", F.when(k % 3 == 0, "sales").otherwise("workshop").alias("archetype"))
    lifecycles = p.select("path", F.when(k % 5 == 0, "delivery").when(k % 5 == 1, "active").when(k % 5 == 2, "active_presales").otherwise("done").alias("lifecycle"))
    return template.validated(folders, kinds.union(inner), archetypes, lifecycles, template.flatten(spark, TREE), ["sales"]).select("path", "action", "destination")


@query("SELECT * FROM (VALUES ('A', 'A. PreSales', false), ('A.1', 'A.1. RFI_RFP', true), ('A.2', 'A.2. Proposal', true), ('A.2.3', 'A.2.3. Timeline', false), ('B', 'B. Delivery', false)) t(prefix, canonical, core)")
def n36_template_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.flatten(spark, TREE).select("prefix", "canonical", "core")


TOPICS = """t AS (SELECT DISTINCT concat(CASE p_size % 3 WHEN 0 THEN '01 Project' WHEN 1 THEN '02 Ops' ELSE '04 Resources' END, '/', p_size, '/', p_type) AS path, p_type AS name FROM part)"""


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.when(F.col("p_size") % 3 == 0, "01 Project").when(F.col("p_size") % 3 == 1, "02 Ops").otherwise("04 Resources")
    return _t(spark, sf_dir, "part").select(F.concat_ws("/", root, F.col("p_size").cast("string"), "p_type").alias("path"), F.lit("resource").alias("folder_type")).distinct()


@query(f"""WITH {TOPICS} SELECT trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS topic, count(DISTINCT split_part(path, '/', 1)) AS roots, count(*) AS folders, min(path) AS first
FROM t GROUP BY 1 HAVING count(DISTINCT split_part(path, '/', 1)) >= 2""")
def n22_topics_across_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steward.topics_across_roots(_topics(spark, sf_dir), []).select("topic", "roots", "folders", "first")


@query(f"{FOLDERS}, {INITIATIVES} SELECT path FROM i WHERE path <> '01 Project/2021/03_C3/Alpha 5' AND EXISTS (SELECT 1 FROM f WHERE starts_with(f.path, i.path || '/'))")
def n23_missing_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _folders(spark, sf_dir)
    full = f.select(P.parent(F.col("path")).alias("path")).distinct()
    i = _initiatives(f).join(full.withColumn("file_count", F.lit(1)), "path", "left").withColumn("initiative_type", F.lit(None).cast("string"))
    return steward.missing_metadata(i, list(RULES.projects)).select("path")


@query("""SELECT p_brand AS asset_key, count(*) AS copy_count, count(DISTINCT p_size % 7) AS customer_count FROM part WHERE p_brand NOT LIKE '%3' GROUP BY 1
HAVING count(*) >= 3 AND count(DISTINCT p_size % 7) >= 2 ORDER BY copy_count DESC, asset_key LIMIT 15""")
def n25_reusable_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("asset_key")).agg(F.count("*").alias("copy_count"), F.countDistinct(F.col("p_size") % 7).alias("customer_count"))
    by = by.withColumn("canonical", F.when(F.col("asset_key").like("%3"), "04 Resources/x").otherwise("01 Project/x")).withColumn("reuse_score", F.col("copy_count"))
    return steward.reusable(by).select("asset_key", "copy_count", "customer_count")


@query(f"{FOLDERS}, known AS (SELECT unnest(['C1', 'C2', 'C3']) AS code) SELECT DISTINCT name[4:] AS code, name[4:] AS label FROM x WHERE depth = 3 AND regexp_matches(name, '^[0-9][0-9]_C[0-9]$') AND name[4:] NOT IN (SELECT code FROM known)")
def n31_registry_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steward.registry_candidates(C.classify(_folders(spark, sf_dir), RULES).where("matched_rule not like 'project_template%'"), list(RULES.customers)).select("code", "label")


@query("""WITH f AS (SELECT p_partkey AS k, CASE p_size % 3 WHEN 0 THEN 'template_drift' WHEN 1 THEN 'semantic_duplication' ELSE 'unknown_customer' END AS issue_type FROM part)
SELECT CASE issue_type WHEN 'template_drift' THEN 'Template' WHEN 'semantic_duplication' THEN 'Duplicates' ELSE 'Registry' END AS section, issue_type, count(*) AS findings FROM f GROUP BY ALL""")
def n32_report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    issue = F.when(F.col("p_size") % 3 == 0, "template_drift").when(F.col("p_size") % 3 == 1, "semantic_duplication").otherwise("unknown_customer")
    return steward.report_sections(_t(spark, sf_dir, "part").select(issue.alias("issue_type")))


@query("""WITH f AS (SELECT p_partkey AS path, CASE p_size % 4 WHEN 0 THEN 'container' WHEN 1 THEN 'temporal' ELSE 'customer' END AS role, CASE p_partkey % 3 WHEN 0 THEN 'duplicate_topic' WHEN 1 THEN 'naming_ambiguity' ELSE 'unknown_customer' END AS issue_type FROM part)
SELECT path, role, issue_type FROM f WHERE NOT (role IN ('container', 'temporal') AND issue_type IN ('duplicate_topic', 'naming_ambiguity'))""")
def n27_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("p_size") % 4 == 0, "container").when(F.col("p_size") % 4 == 1, "temporal").otherwise("customer")
    issue = F.when(F.col("p_partkey") % 3 == 0, "duplicate_topic").when(F.col("p_partkey") % 3 == 1, "naming_ambiguity").otherwise("unknown_customer")
    return steward.unsuppressed(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), role.alias("role"), issue.alias("issue_type")))


@query("SELECT p_partkey, p_name NOT IN ('Thumbs.db') AND p_name NOT LIKE '%.tmp' AND NOT starts_with(p_type, 'PROMO') AS kept FROM part")
def s05_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", (~filters.ignored(F.col("p_type"), F.col("p_name"), subtrees=["PROMO*"])).alias("kept"))


@query("""WITH f AS (SELECT concat('r/', p_size, '/', p_partkey, CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.js' ELSE '.md' END) AS path, p_size FROM part),
g AS (SELECT p_size, count(*) AS files, count(*) FILTER (path NOT LIKE '%.md') AS code FROM f GROUP BY 1) SELECT 'r/' || p_size AS folder, code >= 3 AND 2 * code >= files AS is_code_repo FROM g""")
def s06_code_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.when(F.col("p_partkey") % 3 == 0, ".py").when(F.col("p_partkey") % 3 == 1, ".js").otherwise(".md")
    files = _t(spark, sf_dir, "part").select(F.concat(F.lit("r/"), F.col("p_size"), F.lit("/"), F.col("p_partkey"), ext).alias("path"))
    dirs = files.select(F.concat(P.parent(F.col("path")), F.lit("/src")).alias("path")).distinct()
    return steward.code_folders(files, dirs).select("folder", "is_code_repo")


@query("""WITH f AS (SELECT DISTINCT o_custkey AS file, o_orderkey % 13 AS neighbour, 1 - (o_orderkey % 13) / 23.0::DOUBLE AS sim FROM orders), t AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY sim DESC, neighbour) AS n FROM f),
v AS (SELECT file, neighbour % 4 AS dest, sum(greatest(sim, 0)) AS votes, max(sim) AS top FROM t WHERE n <= 8 GROUP BY 1, 2),
s AS (SELECT file, dest, votes, sum(votes) OVER (PARTITION BY file) AS total, max(top) OVER (PARTITION BY file) AS best FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY round(votes, 9) DESC, dest) AS k FROM s)
SELECT file, 'd' || dest AS destination, round(least(votes / total * best, 0.95), 4) AS confidence FROM r WHERE k = 1""")
def l05_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") % 13
    pairs = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), n.alias("neighbour"), (1 - n / 23.0).alias("similarity"), F.concat(F.lit("d"), n % 4).alias("destination")).distinct()
    return steward.vote(pairs)


@query("""SELECT o_orderkey AS path, CASE WHEN d >= 0.75 THEN 'pattern' WHEN e > coalesce(d, -1) THEN 'embedding' WHEN d IS NOT NULL THEN 'pattern' ELSE 'none' END AS method,
CASE WHEN d >= 0.75 THEN d WHEN e > coalesce(d, -1) THEN e ELSE coalesce(d, 0) END AS confidence FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 10 / 10.0::DOUBLE END AS d, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 7 / 10.0::DOUBLE END AS e FROM orders)""")
def l06_hybrid_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = _t(spark, sf_dir, "orders").select(k.alias("path"))
    det = o.where("path % 5 > 0").select("path", F.lit("p").alias("destination"), (F.col("path") % 10 / 10.0).alias("confidence"))
    emb = o.where("path % 3 > 0").select("path", F.lit("e").alias("destination"), (F.col("path") % 7 / 10.0).alias("confidence"))
    return steward.choose(o, det, emb).select("path", "method", "confidence")


@query("""SELECT o_orderkey AS path, CASE WHEN c >= 0.95 THEN 'auto_place' WHEN c >= 0.75 THEN 'suggest' ELSE 'needs_review' END AS band FROM (SELECT o_orderkey, o_orderkey % 100 / 100.0 AS c FROM orders WHERE starts_with(o_orderpriority, '1') OR starts_with(o_orderpriority, '2'))""")
def l09_inbox_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    files = o.where(F.substring("o_orderpriority", 1, 1).isin("1", "2")).select(F.col("o_orderkey").alias("path"), (F.col("o_orderkey") % 100 / 100.0).alias("confidence"))
    return files.select("path", P.band(F.col("confidence")).alias("band"))


@query(f"""{CLASSIFIED}, files AS (SELECT {FOLDER} || '/' || p_partkey || '.pdf' AS path, {FOLDER} AS folder FROM part) SELECT files.path, folder, folder_type, matched_rule FROM files LEFT JOIN k ON k.path = folder""")
def l01_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _t(spark, sf_dir, "part").select(F.concat(F.expr(FOLDER), F.lit("/"), F.col("p_partkey"), F.lit(".pdf")).alias("path"), F.expr(FOLDER).alias("folder"))
    done = C.classify(_folders(spark, sf_dir), RULES).withColumn("created_at", F.lit(1))
    return steward.training_rows(files, done).select("path", "folder", "folder_type", "matched_rule")


@query("""SELECT p_partkey, p_size % 4 AS n, concat_ws('/', 'a', CASE WHEN p_size % 4 = 3 THEN 'b' END, CASE WHEN p_size % 4 = 3 THEN 'c' END) AS key FROM part""")
def f21_initiative_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("p_size") % 4 == 0, "a/data/x.pdf").when(F.col("p_size") % 4 == 1, "a/2021/v2/x.pdf").when(F.col("p_size") % 4 == 2, "a/x.pdf").otherwise("a/b/c/Q1/x.pdf")
    return _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4).cast("int").alias("n"), labels.initiative_key(path, ["data"]).alias("key"))
