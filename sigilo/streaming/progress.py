"""Progress events: sampling, throttling, and running estimates, in batch and as a stream.

Events are (doc_id, ts, type, percent, idx, total). Throttling depends on what
was emitted last, and an estimate on the one before, so both are folds over
each document's events. In batch a document's events follow each other within
a partition; as a stream the same folds keep their state between micro-batches
until the watermark says that a document has been idle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SAMPLED, FREQUENT, INTERVAL_MS = ("page", "event", "ocr"), ("scan", "ocr"), 250


def is_logged(kind: Column, idx: Column, total: Column) -> Column:
    """First, last and every tenth of the sampled kinds; all others, and those without numbers."""
    plain = ~kind.isin(*SAMPLED) | idx.isNull() | total.isNull() | (total <= 0)
    return F.coalesce(plain | (idx == 0) | (idx + 1 == total) | ((idx + 1) % 10 == 0), F.lit(True))


def sampled(events: DataFrame) -> DataFrame:
    return events.filter(is_logged(F.col("type"), F.col("idx"), F.col("total")))


def millis(ts: Any) -> int:
    return pd.Timestamp(ts).value // 1_000_000


class Throttle:
    """Shows events of frequent kinds INTERVAL_MS apart, unless the kind changes or work is done."""

    STATE = "kind string, at long"

    def __init__(self, kind: str | None = None, at: int | None = None) -> None:
        self.state = kind, at

    def step(self, row: Any) -> tuple | None:
        (kind, at), ms = self.state, millis(row.ts)
        if row.type in FREQUENT and kind == row.type and at is not None and ms - at < INTERVAL_MS:
            return None
        self.state = row.type, ms
        return ()


class Estimate:
    """The highest progress so far, 99 at most, and the smoothed estimate of the total time.

    No estimate is made before 30 seconds and 12 percent; a new one moves the
    old one by three tenths. A missing percentage changes nothing.
    """

    STATE = "start long, top double, estimate long"

    def __init__(self, start: int | None = None, top: float = 0.0, estimate: int = 0) -> None:
        self.state = start, top, estimate

    def step(self, row: Any) -> tuple | None:
        (start, top, estimate), ms = self.state, millis(row.ts)
        start = ms if start is None else start
        if row.percent is not None and row.percent == row.percent:
            top = max(top, min(99.0, row.percent))
        if ms - start >= 30_000 and top >= 12:
            new = math.floor((ms - start) * (100.0 / top) + 0.5)
            if new:
                estimate = math.floor(estimate * 0.7 + new * 0.3 + 0.5) if estimate else new
        self.state = start, top, estimate
        return top, estimate or None


def folded(events: DataFrame, fold: Callable[[], Any], order: list[str], passed: list[str], added: str = "") -> DataFrame:
    """The rows of ``events`` that the fold shows, with what it adds; each document's events in order, one pass, nothing held."""
    kept = ["doc_id", *passed]
    schema = ", ".join([f"`{c}` {events.schema[c].dataType.simpleString()}" for c in kept] + ([added] if added else []))
    names = kept + [x.split()[0] for x in added.split(", ") if x]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, own = object(), None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.doc_id != doc or own is None:
                    doc, own = row.doc_id, fold()
                if (more := own.step(row)) is not None:
                    out.append((*[getattr(row, c) for c in kept], *more))
            yield pd.DataFrame(out, columns=names).astype({x.split()[0]: "Int64" for x in added.split(", ") if x.endswith(" long")})

    return events.repartition("doc_id").sortWithinPartitions("doc_id", *order).mapInPandas(run, schema)


def throttled(events: DataFrame) -> DataFrame:
    """(doc_id, ts, idx, type) of the events that are shown, by ``Throttle``."""
    own = events.select("doc_id", F.col("ts").cast("timestamp").alias("ts"), F.col("idx").cast("int").alias("idx"), "type")
    return folded(own, Throttle, ["ts", "idx", "type"], ["ts", "idx", "type"])


def estimates(events: DataFrame) -> DataFrame:
    """(doc_id, seq, ts, top, estimate) of every event, by ``Estimate``; the estimate is null while unknown."""
    own = events.select("doc_id", F.col("seq").cast("bigint").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("percent").cast("double").alias("percent"))
    return folded(own, Estimate, ["ts", "seq"], ["seq", "ts"], "top double, estimate long")


#: Documents without an event for so long, by the watermark, are done with; their state goes. Events may come so much later than others.
IDLE_MS, LATE = 3_600_000, "1 minute"
SHOWN = "doc_id string, ts timestamp, type string, percent double"
ESTIMATED = "doc_id string, ts timestamp, top double, estimate long"
PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold(StatefulProcessor):
    """A fold whose state lives between micro-batches, until ``idle_ms`` after a document's last event."""

    def __init__(self, fold: type, passed: list[str], columns: list[str], idle_ms: int) -> None:
        self.fold, self.passed, self.columns, self.idle_ms = fold, passed, columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", f"{self.fold.STATE}, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = self.last.get()
        own, timer = (self.fold(*found[:-1]), found[-1]) if found is not None else (self.fold(), None)
        out, latest = [], timer - self.idle_ms if timer is not None else 0
        for row in pd.concat(list(rows)).sort_values(["ts"], kind="stable").itertuples(index=False):
            latest = max(latest, millis(row.ts))
            if (more := own.step(row)) is not None:
                out.append((key[0], *[getattr(row, c) for c in self.passed], *more))
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest + self.idle_ms)
        self.last.update((*own.state, latest + self.idle_ms))
        frame = pd.DataFrame(out, columns=self.columns)
        yield frame.astype({"estimate": "Int64"}) if "estimate" in frame else frame

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, fold: type, passed: list[str], schema: str, idle_ms: int, late: str) -> DataFrame:
    """The fold over a stream. Timers are of event time, so an idle stream plans no batch and one that has read all it may ends.

    Arbitrary state of this kind needs Spark's RocksDB store, which is set where the session names no other.
    """
    spark = events.sparkSession
    if "HDFSBackedStateStoreProvider" in spark.conf.get(PROVIDER):
        spark.conf.set(PROVIDER, ROCKSDB)
    columns = [x.split()[0] for x in schema.split(", ")]
    timed = events.withWatermark("ts", late).groupBy("doc_id")
    return timed.transformWithStateInPandas(Fold(fold, passed, columns, idle_ms), schema, "append", "EventTime")


def throttle_stream(events: DataFrame, idle_ms: int = IDLE_MS, late: str = LATE) -> DataFrame:
    """``throttled`` over a stream of (doc_id, ts, type, percent): the events that are shown."""
    return fold_stream(events, Throttle, ["ts", "type", "percent"], SHOWN, idle_ms, late)


def estimate_stream(events: DataFrame, idle_ms: int = IDLE_MS, late: str = LATE) -> DataFrame:
    """``estimates`` over a stream of (doc_id, ts, percent): (doc_id, ts, top, estimate) per event."""
    return fold_stream(events, Estimate, ["ts"], ESTIMATED, idle_ms, late)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of progress events from Parquet files that arrive below a path."""
    schema = "doc_id string, ts timestamp, type string, percent double, idx int, total int"
    return spark.readStream.schema(schema).parquet(path)
