"""Calls of a model: failures stay with their rows, and the ledger says what is tried again."""

from pyspark.sql import functions as F

from atheneum.operators import calls


def test_failures_stay_alone_and_attempts_are_counted(spark):
    def model(rows):
        if len(rows) > 4 or any(r["id"] == 3 for r in rows):
            raise RuntimeError("no")
        return {r["id"]: r["t"].upper() for r in rows if r["id"] != 5}

    items = spark.createDataFrame([(k, f"t{k}") for k in range(10)], "id long, t string").coalesce(1)
    got = {r.id: r for r in calls.answered(items, model, batch=4).collect()}
    assert {i for i in got if got[i].status == "done"} == set(range(10)) - {3, 5} and got[3].error == "RuntimeError: no" and got[5].status == "missing" and got[0].answer == "T0"
    ledger = spark.createDataFrame([], "id long, version string, content_hash string, status string, error string, attempts int")
    text = F.col("t")
    for round in range(4):
        todo = calls.open_items(items, ledger, "v", text, most=3)
        assert {r.id for r in todo.collect()} == (set(range(10)) if round == 0 else {3, 5} if round < 3 else set())
        ledger = calls.noted(ledger, items, calls.answered(todo, model, 4), "v", text).cache()
        ledger.count()
    assert {r.id: r.attempts for r in ledger.where("attempts > 1").collect()} == {3: 3, 5: 3}
    # Other content, or another version, is open again.
    other = items.withColumn("t", F.when(F.col("id") == 3, "new").otherwise(F.col("t")))
    assert [r.id for r in calls.open_items(other, ledger, "v", text).collect()] == [3] and calls.open_items(items, ledger, "w", text).count() == 10
    labels = {r.id: (r.label, r.confidence) for r in calls.labelled(calls.answered(items, model, 4), ["T0", "T1"]).collect()}
    assert labels[0] == ("T0", 0.8) and labels[2] == labels[3] == labels[5] == ("unknown", 0.2)
    assert calls.answered(items.limit(0), model).count() == 0
