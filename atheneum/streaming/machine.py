"""State by key as streams: the queue's stages with refused moves and timers for stuck rows, and changes of files.

Both keep one small row a key in the state store (RocksDB, so that it may outgrow memory) and give out changes, which
a table keeps; latest() folds those to rows. A run that starts again goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

#: From each status, those that may follow. Any working status may fail or end; an ended row may be queued again.
MOVES = {
    None: ["pending"], "pending": ["transcribing", "converting", "failed"], "transcribing": ["chunking", "done", "failed"], "converting": ["chunking", "done", "failed"],
    "chunking": ["embedding", "done", "failed"], "embedding": ["done", "failed"], "done": ["pending"], "failed": ["pending"],
}
ENDED = ("done", "failed")
#: The stored row; times are microseconds, so that no time zone has a say.
ROW = "seq long, at long, status string, attempts long, started long, completed long, error string, timings map<string,double>"
TIMES = ("at", "started", "completed")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class QueueMachine(StatefulProcessor):
    """Moves the row of a key by its events in order of seq. Verdicts: moved, repeated (same status again), refused, late, stuck."""

    def __init__(self, stuck_seconds: float) -> None:
        self.stuck_us = int(stuck_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", ROW)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803, Spark's names
        now = self._now()
        for e in sorted(rows, key=lambda e: e.seq):
            verdict = _verdict(now, e)
            if verdict in ("moved", "repeated"):
                now = _moved(now, e)
            yield Row(key=key[0], event_seq=e.seq, asked=e.status, verdict=verdict, **now)
        if now["seq"] is not None:
            self.row.update(tuple(now.values()))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            if now["status"] not in ENDED:
                self.handle.registerTimer((now["at"] + self.stuck_us) // 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        now = self._now()
        yield Row(key=key[0], event_seq=now["seq"], asked=None, verdict="stuck", **now)

    def close(self) -> None:
        pass

    def _now(self) -> dict[str, Any]:
        names = [f.split()[0] for f in ROW.replace("<string,double>", "").split(", ")]
        if not self.row.exists():
            return dict.fromkeys(names) | {"attempts": 0, "timings": {}}
        return dict(zip(names, self.row.get(), strict=True))


def _verdict(now: dict[str, Any], e: Row) -> str:
    if now["seq"] is not None and e.seq <= now["seq"]:
        return "late"
    if e.status == now["status"]:
        return "repeated"
    return "moved" if e.status in MOVES.get(now["status"], ()) else "refused"


def _moved(now: dict[str, Any], e: Row) -> dict[str, Any]:
    """The row after an event: the first start stays, a failure counts and keeps its text, an end has its time, a stage its seconds."""
    out = now | {"seq": e.seq, "at": e.us, "status": e.status}
    if e.status in ENDED:
        again = now["status"] == e.status
        out |= {"completed": e.us, "error": e.error if e.status == "failed" else None, "attempts": now["attempts"] + (e.status == "failed" and not again)}
    elif e.status == "pending":
        out |= {"started": None, "completed": None, "error": None, "timings": {}}
    else:
        out |= {"started": now["started"] if now["started"] is not None else e.us}
    if e.stage is not None and e.seconds is not None:
        out["timings"] = dict(out["timings"]) | {e.stage: e.seconds}
    return out


CHANGE = f"key {{kind}}, event_seq long, asked string, verdict string, {ROW}"


def queue_changes(events: DataFrame, stuck_seconds: float = 3600, delay: str = "0 seconds") -> DataFrame:
    """Changes of a stream of events (key, seq, at, status, error, stage, seconds), or of a table of them.

    A working row without an event for stuck_seconds, as the events' times pass, is told once as stuck; it stays as it is."""
    kind = events.schema["key"].dataType.simpleString()
    given = events.withWatermark("at", delay) if events.isStreaming else events
    moved = given.withColumn("us", F.unix_micros("at")).groupBy("key").transformWithState(QueueMachine(stuck_seconds), CHANGE.format(kind=kind), "Append", "EventTime")
    return moved.withColumns({c: F.timestamp_micros(c) for c in TIMES})


class FileWatch(StatefulProcessor):
    """Compares each path's hash with the one that was last seen: new, changed, unchanged, and vanished where a later scan lacks it."""

    def __init__(self, grace_seconds: float) -> None:
        self.grace_us = int(grace_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "file_hash string, us long, gone boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        before = last = self.seen.get()
        for e in sorted(rows, key=lambda e: (e.us, e.file_hash or "")):
            if last and e.us <= last[1]:
                continue  # a scan that lists a path again, or comes late
            change = "new" if not last or last[2] else "unchanged" if last[0] == e.file_hash else "changed"
            last = (e.file_hash, e.us, False)
            yield Row(path=key[0], us=e.us, file_hash=e.file_hash, change=change)
        if last == before:
            return
        # Each call of the state is a round trip: a path that is not gone has one timer, at a time that its row tells.
        self.seen.update(last)
        if before and not before[2]:
            self.handle.deleteTimer((before[1] + self.grace_us) // 1000)
        self.handle.registerTimer((last[1] + self.grace_us) // 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        file_hash, us, _ = self.seen.get()
        self.seen.update((file_hash, us, True))
        yield Row(path=key[0], us=us, file_hash=file_hash, change="vanished")

    def close(self) -> None:
        pass


def file_changes(scans: DataFrame, grace_seconds: float) -> DataFrame:
    """(path, scan_at, file_hash, change) of a stream of scans (path, file_hash, scan_at), all rows of a scan with its time.

    A path is told as vanished, with the scan that last had it, once a scan over grace_seconds later has come; scans have
    to be further apart than that. A path that comes back is new."""
    given = scans.withWatermark("scan_at", "0 seconds") if scans.isStreaming else scans
    told = given.withColumn("us", F.unix_micros("scan_at")).groupBy("path").transformWithState(FileWatch(grace_seconds), "path string, us long, file_hash string, change string", "Append", "EventTime")
    return told.select("path", F.timestamp_micros("us").alias("scan_at"), "file_hash", "change")


def start(changes: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends changes to the Parquet table `out`: all that is there now, or on and on at an interval (`10 seconds`)."""
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    writer = changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The queue's rows: of each key the state after its last accepted event, and how many events were refused or late."""
    changes = spark.read.parquet(out)
    ok = F.col("verdict").isin("moved", "repeated")
    state = ("seq", "at", "status", "attempts", "started", "completed", "error", "timings")
    by = changes.groupBy("key").agg(
        F.max_by(F.struct(*state), F.when(ok, F.col("event_seq"))).alias("s"),
        F.count_if(F.col("verdict") == "refused").alias("refused"), F.count_if(F.col("verdict") == "late").alias("late"), F.count_if(F.col("verdict") == "stuck").alias("stuck"),
    )
    return by.where("s is not null").select("key", "s.*", "refused", "late", "stuck")
