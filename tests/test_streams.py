"""Streams with state by key, restarted between batches, against plain folds."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from atheneum.streaming import machine as M

T0 = datetime(2026, 1, 1)
EVENT = "key long, seq long, at timestamp, status string, error string, stage string, seconds double"


def events(seed=3):
    rng = random.Random(seed)
    statuses = [s for s in M.MOVES if s]
    rows, seq = [], 0
    for k in range(25):
        status = None
        for _ in range(rng.randint(1, 14)):
            seq += 1
            wanted = rng.choice(M.MOVES[status]) if rng.random() < 0.75 else rng.choice(statuses)
            rows.append((k, seq, T0 + timedelta(seconds=seq), wanted, "boom" if wanted == "failed" else None, wanted if rng.random() < 0.5 else None, float(seq % 7)))
            if wanted in M.MOVES[status]:
                status = wanted
    return rows


def folded(rows):
    """The rows and the refused ones by a plain loop."""
    out, refused = {}, {}
    for k, seq, at, status, error, stage, seconds in sorted(rows, key=lambda r: r[1]):
        r = out.get(k) or {"status": None, "attempts": 0, "started": None, "completed": None, "error": None, "timings": {}}
        if status != r["status"] and status not in M.MOVES[r["status"]]:
            refused[k] = refused.get(k, 0) + 1
            continue
        if status == "pending":
            r |= {"started": None, "completed": None, "error": None, "timings": {}}
        elif status in ("done", "failed"):
            r["attempts"] += status == "failed" and r["status"] != "failed"
            r |= {"completed": at, "error": error if status == "failed" else None}
        else:
            r["started"] = r["started"] or at
        if stage:
            r["timings"] = r["timings"] | {stage: seconds}
        out[k] = r | {"status": status, "seq": seq, "at": at}
    return {k: (r, refused.get(k, 0)) for k, r in out.items()}


def table(rows):
    return {r.key: ({c: r[c] for c in ("status", "attempts", "started", "completed", "error", "timings", "seq", "at")}, r.refused) for r in rows.collect()}


def test_queue_stream_restarts_and_equals_a_fold(spark, tmp_path):
    rows = events()
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for part in range(3):  # each part is a run of its own, which goes on from the checkpoint
        mine = [r for r in rows if r[1] * 3 // (rows[-1][1] + 1) == part]
        spark.createDataFrame(mine, EVENT).repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENT).parquet(source)
        M.start(M.queue_changes(stream, stuck_seconds=10**6), out, check).awaitTermination()
    got = M.latest(spark, out)
    assert table(got) == folded(rows) and got.agg(F.sum("late")).first()[0] == 0
    # The same processor over the events as a table.
    M.queue_changes(spark.createDataFrame(rows, EVENT)).write.parquet(str(tmp_path / "batch"))
    assert table(M.latest(spark, str(tmp_path / "batch"))) == folded(rows)


def test_late_events_and_stuck_rows(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    e = lambda k, seq, s, status: (k, seq, at(s), status, None, None, None)
    batches = [[e(1, 1, 0, "pending"), e(1, 2, 1, "converting"), e(2, 3, 1, "pending")], [e(2, 9, 100, "failed"), e(3, 10, 100, "pending"), e(1, 1, 100, "pending")], [e(3, 20, 130, "converting"), e(4, 21, 400, "pending")]]
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for rows in batches:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(source)
        M.start(M.queue_changes(spark.readStream.schema(EVENT).parquet(source), stuck_seconds=60), out, check).awaitTermination()
    got = {r.key: (r.status, r.late, r.stuck > 0) for r in M.latest(spark, out).collect()}
    assert got == {1: ("converting", 1, True), 2: ("failed", 0, False), 3: ("converting", 0, True), 4: ("pending", 0, False)}


def test_file_changes_over_three_scans(spark, tmp_path):
    scans = [{"a": "1", "b": "2", "c": "3"}, {"a": "1", "b": "9", "d": "4"}, {"a": "1", "c": "3", "d": "5"}, {"a": "1", "d": "5"}]
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for k, files in enumerate(scans):
        rows = [(p, h, T0 + timedelta(hours=k)) for p, h in files.items()]
        spark.createDataFrame(rows + rows[:1], "path string, file_hash string, scan_at timestamp").coalesce(1).write.mode("append").parquet(source)
        M.start(M.file_changes(spark.readStream.schema("path string, file_hash string, scan_at timestamp").parquet(source), 1800), out, check).awaitTermination()
    got = {}
    for r in spark.read.parquet(out).collect():
        got.setdefault(r.path, []).append((round((r.scan_at - T0).total_seconds() / 3600), r.change))
    assert {p: sorted(x) for p, x in got.items()} == {
        "a": [(0, "new"), (1, "unchanged"), (2, "unchanged"), (3, "unchanged")], "b": [(0, "new"), (1, "changed"), (1, "vanished")],
        "c": [(0, "new"), (0, "vanished"), (2, "new"), (2, "vanished")], "d": [(1, "new"), (2, "changed"), (3, "unchanged")],
    }
