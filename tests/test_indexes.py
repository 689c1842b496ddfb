"""The word index, the vector index, similar pairs and components against plain scans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from atheneum.functions import paths as P
from atheneum.operators import graph, retrieval, steward, vector_index, word_index

QUERIES = ["w1 w2", '"w1 w2" or w30', "-w1", 'w3 -"w4 w5" -w6', '"w2 w2"', "nowhere", "", 'w1 or "w7 w8 w9"']


def said(seed, n, words=40):
    rng = random.Random(seed)
    return [" ".join(f"w{min(int(rng.expovariate(0.15)), words)}" for _ in range(rng.randint(0, 60))) for _ in range(n)]


def plain(rows):
    return sorted((r.id, r.bm25) for r in rows.collect())


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(k, t, "ab"[k % 2]) for k, t in enumerate(said(1, 150))] + [(900, None, "a"), (901, "", "b"), (902, "W1, w2!", None)]
    return spark.createDataFrame(rows, "id long, text string, side string").cache()


def test_word_index_equals_a_scan(spark, texts, tmp_path):
    index = word_index.build(texts, str(tmp_path / "one"), buckets=8)
    for q in QUERIES:
        for where in (None, F.col("side") == "a"):
            assert plain(index.match(q, where, pool=999)) == plain(retrieval.word_channel(texts, q, 999, "id", where=where)), q
    files = index.postings(["w1"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in files and "In(term, [w1])" in files.replace("EqualTo(term,w1)", "In(term, [w1])")


def test_word_index_takes_changes(spark, texts, tmp_path):
    new = spark.createDataFrame([(3, "w1 w2 w1", "a"), (950, "w30 w30", "b")], texts.schema)
    gone = spark.createDataFrame([(5,), (6,), (12345,)], "id long")
    index = word_index.build(texts, str(tmp_path / "two"), buckets=8).changed(new, gone)
    index = index.changed(spark.createDataFrame([(6, "w2 w1 w2", "b")], texts.schema))
    now = texts.where("id not in (3, 5, 6)").union(new).union(spark.createDataFrame([(6, "w2 w1 w2", "b")], texts.schema))
    merged = index.merged(str(tmp_path / "three"))
    assert merged.segments == 1 and index.segments == 3
    for q in QUERIES:
        want = plain(retrieval.word_channel(now, q, 999, "id"))
        assert plain(index.match(q, pool=999)) == want and plain(merged.match(q, pool=999)) == want, q
    empty = word_index.build(texts.limit(0), str(tmp_path / "four"))
    assert empty.match("w1").count() == 0 and plain(empty.changed(texts).match("w1 w2", pool=999)) == plain(retrieval.word_channel(texts, "w1 w2", 999, "id"))


def vectors(n=600, d=24, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    rows = [(k, (centres[k % 12] + rng.normal(size=d) * 0.5).tolist(), k % 3) for k in range(n)]
    return rows + [(n, [0.0] * d, 0), (n + 1, None, 1), (n + 2, rows[0][1], 2), (n + 3, rows[0][1], 0)]


def test_nearest_vectors_are_exact(spark, tmp_path):
    rows = spark.createDataFrame(vectors(), "id long, vector array<double>, label int")
    index = vector_index.build(rows, str(tmp_path / "v"), cells=12)
    assert len(index.centres) == 12
    found = total = 0
    for k, q, _ in vectors()[:60:7]:
        query = F.array(*(F.lit(x) for x in q))
        want = retrieval.vector_channel(rows.where(F.size("vector") > 0).where("id <> 600"), query, 20, "id", "vector")
        assert sorted(map(tuple, index.nearest(q, 20).collect())) == sorted(map(tuple, want.collect())), k
        near = {r.id for r in index.nearest(q, 20, exact=False, probes=3).collect()}
        found, total = found + len(near & {r.id for r in want.collect()}), total + 20
    assert found >= 0.95 * total
    some = index.nearest(vectors()[5][1], 9, where=F.col("label") == 1)
    assert [r.id % 3 for r in some.collect()] == [1] * 9
    assert vector_index.build(rows.limit(0), str(tmp_path / "w")).nearest([1.0] * 24).count() == 0


def test_similar_pairs_are_found(spark):
    given = {k: v for k, v, _ in vectors(400) if v is not None and any(v)}
    rng = np.random.default_rng(9)
    for k in range(0, 400, 3):  # near ones, down to the least similarity
        given[1000 + k] = (np.array(given[k]) + rng.normal(size=24) * 0.07 * np.linalg.norm(given[k]) * rng.uniform(0.2, 1)).tolist()
    ids = sorted(given)
    x = np.array([given[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    want = {(a, b) for i, a in enumerate(ids) for j, b in enumerate(ids) if a < b and round(float(sims[i, j]), 6) >= 0.92}
    rows = spark.createDataFrame([*given.items(), (5000, None)], "id long, vector array<double>")
    got = {(r.a, r.b) for r in vector_index.similar_pairs(rows, 0.92).collect()}
    assert len(want) > 100 and got <= want and len(got) >= 0.98 * len(want)
    assert (0, 402) in got and (402, 403) in got  # equal vectors
    assert vector_index.groups_for(0.92) < vector_index.groups_for(0.8)


def test_hot_groups_of_signs_are_parted(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "HOT", 20)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    rows = [(k, (centre + rng.normal(size=16) * 0.05 * (1 + k % 4)).tolist()) for k in range(200)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = int((np.triu(x @ x.T, 1).round(6) >= 0.99).sum())
    got = vector_index.similar_pairs(spark.createDataFrame(rows, "id long, vector array<double>"), 0.99).count()
    assert 0.95 * want <= got <= want


def test_components_of_merged_chains(spark):
    rng = random.Random(8)
    edges = [(f"g{g}-{k:03}", f"g{g}-{k + 1:03}") for g in range(9) for k in range(60)]
    edges += [(f"g{g}-{rng.randrange(60):03}", f"g{g + 1}-{rng.randrange(60):03}") for g in (0, 1, 2, 5, 6)] + [("lone", "lone"), ("x", None)]
    root = {}
    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        if b is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: find(n) for n in root} and len(set(got.values())) == 5
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_files_that_are_meant_apart(spark):
    cases = [
        ("r/p/Deck/Plan.md", "r/p/Deck/Plan_v2 copy.md", True), ("r/p/Deck/Plan.md", "r/p/Deck/Resources/Page3_Plan.md", True), ("r/p/Deck/Plan.md", "r/q/Deck/Plan.md", False),
        ("r/2024/03 Mar/3 mar 24.md", "r/2024/03 Mar/4 mar 24.md", True), ("r/2024/a/notes.md", "r/2024/b/notes.md", False), ("r/2024/x.md", "r/y/3 mar 24.md", False), ("r/p/ab.md", "r/p/cd.md", False),
    ]
    rows = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert [r.want == r.got for r in rows.withColumn("got", steward.meant_apart(F.col("a"), F.col("b"))).collect()] == [True] * len(cases)
    stems = ["Page1_Page2 v3 Plan_v2_final copy (3)", "final", "v2 copy", "Plan_conflict of Ann (1)", "draft draft"]
    got = spark.createDataFrame([(f"x/{s}.pdf",) for s in stems], "p string").select(P.working_stem(F.col("p")).alias("s"))
    assert [r.s for r in got.collect()] == ["plan", "final", "copy", "plan", "draft"]


def test_vectors_are_placed_once(spark, tmp_path):
    """Building reads the vectors to count them, for the centre and to place them; each row has the nearest centre and its angle."""
    rng = np.random.default_rng(3)
    given = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=8)]) for k in range(400)], "id long, vector array<double>")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    vector_index.build(given.mapInArrow(counted, given.schema), f"{tmp_path}/one", cells=1)
    assert read.value <= 3 * 400
    index = vector_index.build(given, f"{tmp_path}/ten", cells=10)
    stored = index._read().collect()
    assert sorted(r.id for r in stored) == list(range(400))
    for r in stored:
        similarity = index.centres @ (np.array(r.vector) / np.linalg.norm(r.vector))
        assert similarity[r.cell] >= similarity.max() - 1e-5 and abs(np.arccos(similarity[r.cell]) - r.angle) < 1e-9
