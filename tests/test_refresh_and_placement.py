"""Deltas against a recount, and predictions against a loop over all patterns."""

import random

from pyspark.sql import functions as F

from atheneum.operators import graph, placement
from atheneum.operators.refresh import Counts, Graph, signed

EDGE, NODE = "edge_id long, source long, target long", "node long"


def test_graph_by_deltas_equals_a_recount(spark, tmp_path):
    rng = random.Random(4)
    chunks, kept = {}, Graph.empty(spark, str(tmp_path / "g"))
    edges = lambda ids, of: [(e, e % 7, e % 5) for c in ids for e in of.get(c, ([], []))[0]]
    nodes = lambda ids, of: [(n,) for c in ids for n in of.get(c, ([], []))[1]]
    for step in range(5):
        old = dict(chunks)
        touched = rng.sample(range(30), 12)
        for c in touched:
            if c in chunks and rng.random() < 0.4:
                del chunks[c]
            else:
                chunks[c] = ([rng.randrange(20) for _ in range(rng.randint(0, 3))], [rng.randrange(9) for _ in range(rng.randint(0, 4))])
        frames = lambda make, kind: tuple(spark.createDataFrame(make(touched, of), kind) for of in (old, chunks))  # noqa: E731, B023
        for _ in range(2 if step == 2 else 1):  # a step that runs again changes nothing more
            after = kept.changed(f"s{step}", frames(edges, EDGE), frames(nodes, NODE))
        kept = after
        if step == 3:
            kept = Graph(kept.evidence.compacted("whole"), kept.degree.compacted("whole"), kept.mentions.compacted("whole"))
        whole = graph.node_weights(spark.createDataFrame(edges(chunks, chunks), EDGE), spark.createDataFrame(nodes(chunks, chunks), NODE))
        assert sorted(map(tuple, kept.weights().collect())) == sorted(map(tuple, whole.collect())), step
    assert len(kept.evidence.segments) == 2


def test_signed_and_lookups(spark, tmp_path):
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], "k string")
    deltas = signed(rows("a", "b", None), rows("b", "c", "c"), ["k"])
    assert {r.k: r.n for r in deltas.collect()} == {"a": -1, "c": 2, None: -1}
    counts = Counts(spark, str(tmp_path / "c"), rows("x").schema).add(rows("a", "a").groupBy("k").agg(F.count("*").alias("n")), "one")
    assert {r.k: r.n for r in counts.at(rows("a", "z")).collect()} == {"a": 2, "z": 0} and counts.read().count() == 1


def predicted(f, patterns):
    best = None
    for p in patterns:
        if p["customer"] is not None and p["customer"] != f["customer"]:
            continue
        if any(p[c] is not None and f[c] is not None and p[c] != f[c] for c in ("initiative", "stage")):
            continue
        score = sum(w for c, w in placement.WEIGHTS.items() if c != "signal" and p[c] is not None and p[c] == f[c])
        score += 0.10 if set(p["signals"]) & set(f["signals"]) else 0
        if score > 0:
            c = round(min(0.40 + 0.5 * score + 0.1 * min(p["support"] / 5, 1), 0.99), 4)
            rank = (-c, -p["support"], p["first"], p["destination"])
            if best is None or rank < best[0]:
                best = (rank, p["destination"], c)
    return best and best[1:]


def test_predictions_equal_a_loop(spark):
    rng = random.Random(7)
    some = lambda xs: rng.choice([None, *xs])
    def files(n, prefix):
        return [{"path": f"{prefix}{k}", "customer": some("AB"), "initiative": some("xy"), "stage": some("pq"), "kind": some("de"), "signals": sorted(rng.sample(["s", "t", "u"], rng.randint(0, 2)))} for k in range(n)]
    placed = [f | {"destination": rng.choice(["A/x", "A/y", "B/x", "C"]), "fold": k % 3} for k, f in enumerate(files(60, "f"))]
    kind = "path string, customer string, initiative string, stage string, kind string, signals array<string>"
    def learn(rows):
        out = {}
        for f in rows:
            p = out.setdefault((*(f[c] for c in placement.CONTEXT), f["destination"]), {c: f[c] for c in [*placement.CONTEXT, "destination"]} | {"support": 0, "signals": set(), "first": f["path"]})
            p["support"] += 1
            p["signals"] |= set(f["signals"])
            p["first"] = min(p["first"], f["path"])
        return out.values()
    new = files(80, "n")
    order = lambda rows, more=(): [tuple(r[c.split()[0]] for c in [*kind.split(", "), *more]) for r in rows]
    table = spark.createDataFrame(order(placed, ["destination s", "fold l"]), kind + ", destination string, fold long")
    got = {r.path: (r.destination, r.confidence) for r in placement.predict(spark.createDataFrame(order(new), kind), placement.patterns(table)).collect()}
    patterns = learn(placed)
    assert got == {f["path"]: p for f in new if (p := predicted(f, patterns))}
    sim = {r.path: (r.predicted, r.confidence) for r in placement.simulate(table, "fold").collect()}
    assert sim == {f["path"]: predicted(f, learn([g for g in placed if g["fold"] != f["fold"]])) or (None, None) for f in placed}


def test_hybrid_choice(spark):
    kind = "path string, destination string, confidence double"
    one = spark.createDataFrame([("a", "x", 0.8), ("b", "x", 0.6), ("c", "x", 0.6), ("d", "x", 0.5)], kind)
    two = spark.createDataFrame([("a", "y", 0.95), ("b", "y", 0.7), ("c", "y", 0.6), ("e", "y", 0.2)], kind)
    got = {r.path: (r.destination, r.method) for r in placement.chosen(one, two).collect()}
    assert got == {"a": ("x", "deterministic"), "b": ("y", "embedding"), "c": ("x", "deterministic"), "d": ("x", "deterministic"), "e": ("y", "embedding")}
