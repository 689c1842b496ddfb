"""Mentions against a scan of all places, merges against a loop, and steps that are skipped, fail and go on."""

import json
import random

import pytest
from pyspark.sql import functions as F

from atheneum.operators import linker, merge, steps


def test_mentions_equal_a_scan(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefg")
    texts = [(k, " ".join(word() for _ in range(rng.randint(0, 60)))) for k in range(40)] + [(90, None), (91, "A-b, C!"), (92, "")]
    names = [(k, " ".join(word() for _ in range(rng.randint(1, 4))), [f"{word()} {word()}"] if k % 3 == 0 else None) for k in range(25)] + [(50, "!!", []), (51, names_of := "a b", ["A  B"])]
    assert names_of == "a b"
    docs, table = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(names, "id long, name string, aliases array<string>")
    by = {}
    for i, n, aliases in names:
        for x in [n, *(aliases or [])]:
            ws = tuple("".join(c if c.isalnum() else " " for c in x.lower()).split())
            if ws:
                by.setdefault(ws, set()).add(i)
    want = []
    for k, t in texts:
        said = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        at = 0
        while at < len(said):
            size = max((n for n in range(1, 6) if tuple(said[at : at + n]) in by and at + n <= len(said)), default=0)
            want += [(k, i, " ".join(said[at : at + size]), at) for i in by.get(tuple(said[at : at + size]), ())] if size else []
            at += size or 1
    for part_names in (10**6, 4):
        assert sorted(map(tuple, linker.mentions(docs, table, part_names).collect())) == sorted(want)
    assert linker.mentions(docs, table.limit(0)).count() == 0


def test_merges(spark):
    old = spark.createDataFrame([(7, "a", "t", ["x"], '{"p": 1, "q": {"r": [1]}}', None), (8, "b", "t", None, "broken {", None)], "id long, name string, type string, aliases array<string>, metadata string, updated_at timestamp")
    new = spark.createDataFrame([(1, "a", "t", ["y", "x"], '{"q": null, "s": "é"}'), (2, "a", "t", None, '{"s": 2}'), (3, "c", "t", ["z"], "[1]"), (4, "c", None, ["z"], None)], "seq long, name string, type string, aliases array<string>, metadata string")
    got = {(r.name, r.type): r for r in merge.upserted_entities(old, new.where("type is not null")).collect()}
    assert json.loads(got["a", "t"].metadata) == {"p": 1, "q": None, "s": 2} and got["a", "t"].aliases == ["x", "y"] and got["a", "t"].id == 7
    assert got["b", "t"].metadata == "{}" and got["b", "t"].updated_at is None and got["b", "t"].aliases == []
    assert got["c", "t"].metadata == "{}" and got["c", "t"].updated_at is not None and len(got) == 3
    rel = spark.createDataFrame([(1, 1, "K", 2, None, "{}", None)], "id long, source long, kind string, target long, confidence double, metadata string, updated_at timestamp")
    more = spark.createDataFrame([(1, 1, "K", 2, 0.4, '{"v": 1.5}'), (2, 1, "K", 2, 0.3, None)], "seq long, source long, kind string, target long, confidence double, metadata string")
    r = merge.upserted_relationships(rel, more).first()
    assert (r.id, r.confidence, json.loads(r.metadata)) == (1, 0.4, {"v": 1.5})


def test_steps(spark, tmp_path):
    calls = []

    def made(name, f):
        def make(*inputs):
            calls.append(name)
            return f(*inputs)
        return make

    broken = [True]

    def fragile(df):
        if broken[0]:
            raise ValueError("not now")
        return df.select("k")

    plan = [
        steps.Step("last", ("even", "fragile"), made("last", lambda a, b: a.join(b, "k"))), steps.Step("even", ("rows",), made("even", lambda d: d.where("k % 2 = 0"))),
        steps.Step("fragile", ("even",), made("fragile", fragile)), steps.Step("sum", ("even",), made("sum", lambda d: d.agg(F.sum("k").alias("n")))),
    ]
    store = steps.Store(spark, str(tmp_path / "s"))
    rows = spark.range(10).withColumnRenamed("id", "k")
    tables, told = store.run(plan, {"rows": rows})
    assert told == {"even": "made", "fragile": "failed", "sum": "made", "last": "blocked"} and set(tables) == {"even", "sum"}
    assert "not now" in store.ledger().where("status = 'failed'").first().error
    broken[0] = False
    calls.clear()
    tables, told = steps.Store(spark, str(tmp_path / "s")).run(plan, {"rows": rows.repartition(3)})
    assert calls == ["fragile", "last"] and told["even"] == told["sum"] == "skipped" and tables["last"].count() == 5
    calls.clear()
    tables, told = store.run(plan, {"rows": rows.union(spark.range(11, 12))})  # an odd row: what comes of it is the same
    assert calls == ["even"] and told == {"even": "made", "fragile": "skipped", "sum": "skipped", "last": "skipped"}
    calls.clear()
    assert store.run(plan, {"rows": spark.range(4).withColumnRenamed("id", "k")})[0]["sum"].first().n == 2 and len(calls) == 4
    with pytest.raises(Exception, match="cycle"):
        store.run([steps.Step("a", ("b",), lambda d: d), steps.Step("b", ("a",), lambda d: d)], {})
