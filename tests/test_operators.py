import random

from pyspark.sql import functions as F

from atheneum.functions import names as N
from atheneum.functions import paths as P
from atheneum.functions import text as T
from atheneum.operators import chunking, findings, graph, retrieval, state
from atheneum.sources.files import discover, read_text
from atheneum.streaming.queue import merged, queue_stream


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_names(spark):
    assert value(spark, P.asset_name(F.lit("AI_Governance-Deck.pptx"))) == "ai governance deck"
    assert value(spark, P.working_stem(F.lit("a/Page12_Plan_v2 (1).pdf"))) == "plan"
    assert value(spark, P.name_signals(F.lit("x/RFP_minutes-sow.pdf"))) == ["proposal", "meeting"]
    assert value(spark, P.file_kind(F.lit("x/a.DRAWIO"))) == "diagram"
    assert tuple(value(spark, P.project_context(F.lit("01 Project/2026/ACME/1 Training/d.pptx")))) == ("ACME", "ACME/1 Training")
    assert tuple(value(spark, P.project_context(F.lit("04 Resources/ACME/x/d.pptx")))) == (None, None)
    s = value(spark, P.stage_parts(F.lit("A.2.5. Contract")))
    assert (s.letter, s.indices, s.label) == ("A", [2, 5], "Contract")
    for name, want in (("2026", True), ("01_Jan", True), ("Q3 2026", True), ("26W12", True), ("January plans", False)):
        assert value(spark, P.temporal(F.lit(name))) is want
    assert value(spark, P.match_level(F.lit("a/b/c/d/e"), F.lit("a/b/c/d/f"))) == "initiative"
    assert value(spark, P.band(F.lit(0.95))) == "auto_place"
    assert value(spark, P.reuse_score(F.lit(1), F.lit(0), F.lit(0), F.lit(1))) == 0


def test_text(spark):
    assert value(spark, T.heading_title(F.lit("  ## A title ##"))) == "A title"
    assert value(spark, T.chunk_type(F.lit("|a|b|\n|c|d|"))) == "table"
    assert value(spark, T.chunk_type(F.lit("- a\n- b\nc"))) == "list"
    assert value(spark, T.entity_type(F.lit("Person"))) == "person"
    assert value(spark, T.relation_type(F.lit("depends on"))) == "DEPENDS_ON"
    assert value(spark, T.context_header({"file_name": F.lit("a"), "client": F.lit(""), "folder": F.lit("f")})) == "File: a\nFolder: f"


def test_sections_agree_with_a_stack(spark):
    rng = random.Random(1)
    texts = [(k, "\n".join(("#" * rng.randint(1, 6) + f" h{i}") if rng.random() < 0.5 else f"t{i}" for i in range(rng.randint(1, 25)))) for k in range(60)]
    got = chunking.sections(spark.createDataFrame([*texts, (99, "")], "doc_id long, text string")).collect()
    parents = {(r.doc_id, r.ordinal): (r.level, r.parent) for r in got}
    for k, text in texts:
        stack, n = [], 0
        for no, line in enumerate(text.split("\n")):
            if not line.startswith("#") and no:
                continue
            level, n = (len(line) - len(line.lstrip("#"))) or 1, n + 1
            while stack and stack[-1][0] >= level:
                stack.pop()
            assert parents[k, n] == (level, stack[-1][1] if stack else None)
            stack.append((level, n))
    assert parents[99, 1] == (1, None)


def test_split():
    text = "\n\n".join(" ".join(f"w{i}" for i in range(n)) for n in (5, 80, 300))
    pieces = chunking.split_text(text, 200, 40)
    assert all(len(p) <= 200 for p in pieces) and set(text.split()) == set(" ".join(pieces).split())
    assert chunking.split_text("x" * 1000, 300, 50)[0] == "x" * 300
    assert chunking.split_text(" \n", 10, 2) == []


def test_query_parts():
    q = retrieval.parse_query('alpha "beta gamma" -delta or')
    assert q == [{"all": ["alpha", "beta", "gamma"], "none": ["delta"], "phrases": ["beta gamma"], "no_phrases": []}]


def test_words_without_match(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "gamma beta"), (3, "alpha delta beta gamma")], "doc_id long, text string")
    assert [r.id for r in retrieval.word_channel(docs, 'alpha "beta gamma" -delta').collect()] == [1]
    assert retrieval.word_channel(docs, "").count() == 0


def test_components_are_an_equivalence(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]
    root = list(range(80))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges for n in e}


def test_orphans(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "node_id long")
    edges = spark.createDataFrame([(10, 1, 2), (11, 3, 4)], "edge_id long, source long, target long")
    evidence, mentions = spark.createDataFrame([(10,)], "edge_id long"), spark.createDataFrame([(4,)], "node_id long")
    n, e = state.without_orphans(nodes, edges, evidence, mentions)
    assert sorted(r.node_id for r in n.collect()) == [1, 2, 4] and [r.edge_id for r in e.collect()] == [10]


def test_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.md").write_text("# hi")
    (tmp_path / "y.mp3").write_bytes(b"1")
    (tmp_path / "z.bin").write_bytes(b"1")
    got = {r.path: (r.folder, r.is_audio) for r in discover(spark, str(tmp_path)).collect()}
    assert got == {"a/b/x.md": ("a", False), "y.mp3": (".", True)}
    assert [r.text for r in read_text(spark, str(tmp_path)).collect()] == ["# hi"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_type", "ts", "event_id")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).write.mode("append").parquet(source)
        queue_stream(spark, source, out, str(tmp_path / "c"), "view", "purchase", events.schema).awaitTermination()
    want = state.fold_queue(events, "user_id", "event_type", "ts", "event_id", "view", "purchase")
    columns = ["user_id", "status", "attempts", "started", "completed", "events"]
    assert sorted(map(str, merged(spark, out).select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_file_names(spark):
    rows = [("260003-250024 VTJ_Accrete_AIS_Voice Authentication_Proposal_v1.0.docx",), ("plain",), (None,), ("ABC.pdf",), ("V2_v3_deck_Plan.pptx",)]
    got = N.filename_fields(spark.createDataFrame(rows, "file_name string")).collect()
    r = got[0]
    assert (r.doc_ids, r.originator, r.client, r.product, r.topic, r.doc_type, r.version) == ("260003-250024", "VTJ", "Accrete", "AIS", "Voice Authentication", "Proposal", "v1.0")
    assert (got[1].client, got[1].originator, got[1].version) == ("plain", None, None) and got[2].tokens == [] and got[2].client is None
    assert (got[3].client, got[3].originator) == ("ABC", None)
    assert (got[4].version, got[4].doc_type, got[4].originator, got[4].terms) == ("v2", "Presentation", None, ["v3", "Plan"])


def test_name_functions(spark):
    assert value(spark, N.corrected(F.lit("01 CHALLANGES"))) == "01 Challenges" and value(spark, N.corrected(F.lit("fine"))) is None
    for glob, path, want in (("a/*/b?", "a/x/y/b1", True), ("a/[!x]", "a/x", False), ("a.b", "aXb", False), ("[ab]", "b", True), ("a", "a\n", False)):
        assert value(spark, N.glob_match(F.lit(path), glob)) is want
    assert value(spark, N.humanized(F.lit("01_A_B"))) == "A B" and value(spark, N.project_id(F.lit(None).cast("int"), F.lit("A_B"))) == "XXXX-A-B"
    assert value(spark, N.without_number(F.lit("01. X"))) == "X"
    assert value(spark, N.keyword_text({"client": F.lit("c"), "topic": F.lit("")}, F.lit("body"))) == "c\nbody"


def test_findings_can_be_rejected_and_nulls_meet_no_rule(spark):
    fields = "path string, file_count int, folder_type string, stage string, confidence double, customer_code string, customer_name string, matched_rule string"
    rows = [("a/misc", 3, "unknown", None, None, None, None, None), ("a/fine", None, None, None, None, None, None, None), (None,) + (None,) * 7]
    found = findings.folder_findings(spark.createDataFrame(rows, fields))
    assert sorted((r.path, r.issue_type) for r in found.collect()) == [("a/misc", "naming_ambiguity"), ("a/misc", "orphaned_knowledge")]
    left = findings.without_rejected(found.union(found), spark.createDataFrame([("naming_ambiguity", "a/misc")], "issue_type string, path string"))
    assert [r.issue_type for r in left.collect()] == ["orphaned_knowledge"]
    assert findings.folder_findings(spark.createDataFrame([], fields)).count() == 0


def test_template_drift(spark):
    from atheneum.operators import template

    tree = [{"prefix": "A", "label": "PreSales", "canonical": "A. PreSales", "children": [
        {"prefix": "A.1", "label": "RFI_RFP_RFQ", "canonical": "A.1. RFI_RFP_RFQ", "core": True},
        {"prefix": "A.2", "label": "Proposal", "canonical": "A.2. Proposal", "core": True, "children": [{"prefix": "A.2.3", "label": "Timeline", "canonical": "A.2.3. Timeline"}, {"prefix": "A.2.5", "label": "Contract", "canonical": "A.2.5. Contract"}]},
    ]}, {"prefix": "B", "label": "Delivery", "canonical": "B. Delivery"}]
    paths = ["p/one/A.2. Proposal/A.2.5. Contract", "p/one/A.2. Proposal/A.2.5. Proposal", "p/one/A.2. Proposal", "p/two/A.1. RFI.RFP.RFQ", "p/two/A.1. RFI.RFP.RFQ/B.1.1. Things", "p/two/A.1. RFI.RFP.RFQ/B.1.1. Things/C.1. Skipped", "p/one/A.2. Proposal/A.2.4. Timeline", "p/one/A.2. Proposal/A.2.9. Own"]
    folders = spark.createDataFrame([(p,) for p in paths], "path string")
    nodes = template.flatten(spark, tree)
    initiatives = spark.createDataFrame([("p/one",), ("p/two",), ("p/three",)], "path string")
    got = {(r.path, r.action, r.destination) for r in template.drift(folders, initiatives, nodes).collect()}
    assert got == {
        (paths[1], "renumber", "p/one/A.2. Proposal/A.2.10. Proposal"), (paths[3], "standardize", "A.1. RFI_RFP_RFQ"),
        (paths[4], "move", "under 'B. Delivery'"), (paths[6], "renumber", "A.2.3. Timeline"),
    }
    core = {(r.path, r.destination) for r in template.missing_core(folders, initiatives, nodes).collect()}
    assert core == {("p/one", "p/one/A.1. RFI_RFP_RFQ"), ("p/two", "p/two/A.2. Proposal"), ("p/three", "p/three/A.1. RFI_RFP_RFQ"), ("p/three", "p/three/A.2. Proposal")}
    assert {r.path for r in template.outermost(spark.createDataFrame([("a",), ("a/b",), ("c/d",), ("ab",)], "path string")).collect()} == {"a", "c/d", "ab"}


def test_word_queries_are_trees():
    from atheneum.operators.retrieval import parse_query

    group = lambda **k: {"all": [], "none": [], "phrases": [], "no_phrases": []} | k
    assert parse_query("alpha or beta") == [group(all=["alpha"]), group(all=["beta"])]
    assert parse_query('a "b c" -d -"e f" or -g') == [group(all=["a", "b", "c"], none=["d"], phrases=["b c"], no_phrases=["e f"]), group(none=["g"])]
    assert parse_query("!! or") == []


def test_search_with_parents_and_neighbours(spark):
    from atheneum.operators import retrieval

    vector = lambda x: [float(x), 1.0]
    rows = [(k, 1 if k < 6 else 2, k, f"alpha w{k}", "document", vector(k), 7 if k in (1, 2) else None, "the parent" if k in (1, 2) else None) for k in range(10)]
    chunks = spark.createDataFrame(rows, "chunk_id long, file_id long, chunk_index long, text string, kind string, embedding array<double>, parent_id long, parent_text string")
    files = spark.createDataFrame([(1, "f", "one"), (2, "g", "two")], "file_id long, folder string, file_name string")
    got = retrieval.search(chunks, files, "w2 or w4", F.array(F.lit(2.0), F.lit(1.0)), top_k=3, folder="f", window=1).orderBy("position").collect()
    assert [r.chunk_id for r in got][0] == 2 and got[0].text == "the parent" and all(r.folder == "f" for r in got) and len(got) == 3
    four = next(r for r in got if r.chunk_id == 4)
    assert four.text == "alpha w3\n\nalpha w4\n\nalpha w5" and (four.first, four.last) == (3, 5)


def test_registry_cache_and_transcript(spark):
    from atheneum.sources import files as S

    found = spark.createDataFrame([("a.md", "1"), ("b.md", "2"), ("c.md", "3")], "path string, file_hash string")
    old = spark.createDataFrame([("a.md", "1"), ("b.md", "x"), ("gone.md", "y")], "path string, file_hash string")
    now, queue, counters = S.update_registry(old, found)
    assert counters == {"new": 1, "changed": 1, "unchanged": 1, "deleted": 1} and {r.path for r in queue.collect()} == {"b.md", "c.md"} and now.count() == 3
    docs = spark.createDataFrame([("a.md", "1", ".md", bytearray(b"plain")), ("b.pdf", "2", ".pdf", bytearray(b"x")), ("c.pdf", "3", ".pdf", bytearray(b"y"))], "path string, file_hash string, extension string, content binary")
    version = S.converter_version("own", "m", True)
    cache = spark.createDataFrame([("b.pdf", version, "2", "kept"), ("c.pdf", version, "old", "stale")], "path string, version string, file_hash string, text string")
    texts, after = S.converted(docs, cache, lambda df: df.select("path", F.lit("made").alias("text")), version)
    assert {(r.path, r.text) for r in texts.collect()} == {("a.md", "plain"), ("b.pdf", "kept"), ("c.pdf", "made")}
    assert {(r.path, r.file_hash, r.text) for r in after.collect()} == {("b.pdf", "2", "kept"), ("c.pdf", "3", "made")}
    segments = spark.createDataFrame([(1, 61.5, 3723.0, "A", " hello "), (1, 0.0, 61.5, "B", "first"), (1, 5.0, 6.0, "A", " ")], "file_id long, start_s double, end_s double, speaker string, text string")
    assert S.transcript(segments).first().text == "[00:00:00 → 00:01:01] B: first\n[00:01:01 → 01:02:03] A: hello"
    assert S.expand("${A}-${B:-two}-${C}", {"A": "one"}) == "one-two-"


def test_chunks_by_structure(spark):
    from atheneum.operators import chunking

    docs = spark.createDataFrame([(1, "# Top\nintro words\n## Part\n- a\n- b\n- c", "stem", False, "x"), (2, "  ", "s", False, "x"), (3, "spoken words", "s", True, "Ann")], "doc_id long, text string, stem string, is_audio boolean, speaker string")
    got = {r.section_path: r for r in chunking.structured_chunks(docs, {"folder": F.lit("own")}).where("doc_id = 1").collect()}
    assert set(got) == {"Top", "Top > Part"} and got["Top > Part"].chunk_type == "list" and got["Top"].contextual_text.endswith("\n\nintro words") and got["Top"].parent_text == "intro words"
    routes = {(r.doc_id, r.route, r.content) for r in chunking.routed(docs).collect()}
    assert (2, "done", None) in routes and (3, "audio", "Ann: spoken words") in routes and len(routes) == 4
    vectors = docs.select(chunking.hashed_embedding(F.col("text")).alias("v")).collect()
    assert abs(sum(x * x for x in vectors[0].v) - 1) < 1e-5 and not any(vectors[1].v) and len(vectors[0].v) == 64


def test_code_folders_hide_what_is_below(spark):
    from atheneum.operators import steward

    repos = spark.createDataFrame([("a/repo", True), ("a/docs", False)], "folder string, is_code_repo boolean")
    rows = spark.createDataFrame([("a/repo",), ("a/repo/src/x",), ("a/docs/y",), ("a/repository",)], "path string")
    assert {r.path for r in steward.outside_code(rows, repos).collect()} == {"a/repo", "a/docs/y", "a/repository"}
    levels = spark.createDataFrame([("exact",), ("customer",), ("wrong",), ("exact",)], "match_level string")
    assert tuple(steward.accuracies(levels).first()) == (4, 2, 0, 1, 1, 0.5, 0.5, 0.75)
