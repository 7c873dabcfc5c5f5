"""Keyed state: what each note was last, when it changed, and when it went stale.

Versions of a note arrive late, repeated and out of order. They wait in the state until
the watermark has passed them and are then taken in order of time, so the rows that come
out do not depend on how the versions were dealt into batches: ``history`` over the same
versions as a table gives the same rows. Versions behind the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillmark.operators.projection import Options, project

_OUT = "key string, event string, at timestamp, version string, level int"
#: A version: microseconds of its time, what it was, its level.
_KEPT = "at long, version string, level int"
_LAST = "at long, version string, level int, stale boolean, seen long"


def _micros(at: datetime) -> int:
    at = at if at.tzinfo else at.astimezone()
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def _event(version: str | None, level: int | None, last: tuple | None) -> str | None:
    """What a version is after the last one: first, raised, lowered, edited, or deleted (no version); None for a repetition."""
    if version is None:
        return None if last is not None and last[1] is None else "deleted"
    if last is None or last[1] is None:
        return "first"
    if (level or 0) != (last[2] or 0):
        return "raised" if (level or 0) > (last[2] or 0) else "lowered"
    return "edited" if version != last[1] else None


def note_versions(feed: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008  frozen
    """A change feed (relative_path, content, content_sha256, noticed_at, ...) as versions for ``track`` and ``history``: the hash, and the rank of the effective sensitivity under the options; a deleted note has neither."""
    p = project(feed, options)
    gone = F.col("content_sha256").isNull()
    return p.select(F.col("relative_path").alias("key"), F.col("noticed_at").alias("at"), F.col("content_sha256").alias("version"), F.when(~gone, F.col("effective.sensitivity_rank")).alias("level"))


def _lives(last: tuple) -> bool:
    """Whether a last version may go stale: it is there, and has not been reported."""
    return last[1] is not None and not last[3]


class NoteState(StatefulProcessor):
    """One key's versions: those that wait, and the last one taken. State of a key that was not seen for ``forget`` is dropped."""

    def __init__(self, stale_ms: int, forget_ms: int):
        self.stale, self.forget = stale_ms * 1000, forget_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _KEPT)
        self.last = handle.getValueState("last", _LAST)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            at = _micros(r.at)
            self.waiting.appendValue((at, r.version, r.level))
            self.handle.registerTimer(at // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() * 1000  # nothing before it is to come
        due, later = [], []
        for v in self.waiting.get():
            (due if v[0] < until else later).append(tuple(v))
        self.waiting.clear()
        if later:
            self.waiting.put(later)
        last = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for at, version, level in sorted(due, key=lambda v: (v[0], v[1] or "", v[2] or 0)):
            if last is not None and _lives(last) and at >= last[0] + self.stale:
                out.append(self._row(key, "stale", last[0] + self.stale, last))
                last = (*last[:3], True, last[4])
            if last is not None and at >= last[4] + self.forget:
                last = None
            event = _event(version, level, last)
            if event is None:
                last = (*last[:4], at)
            else:
                last = (at, version, level, False, at)
                out.append(self._row(key, event, at, last))
        if last is not None and _lives(last) and until >= last[0] + self.stale:
            out.append(self._row(key, "stale", last[0] + self.stale, last))
            last = (*last[:3], True, last[4])
        if last is None or (until >= last[4] + self.forget and not later):
            self.last.clear()
        else:
            self.last.update(last)
            if _lives(last):
                self.handle.registerTimer((last[0] + self.stale) // 1000 + 1)
            self.handle.registerTimer((last[4] + self.forget) // 1000 + 1)
        return iter(out)

    def _row(self, key, event: str, at: int, last: tuple) -> Row:
        return Row(key=key[0], event=event, at=datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=at), version=last[1], level=last[2])

    def close(self) -> None:
        pass


def _typed(versions: DataFrame) -> DataFrame:
    rows = versions.select(F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at"), F.col("version").cast("string").alias("version"), F.col("level").cast("int").alias("level"))
    return rows.where("key IS NOT NULL AND at IS NOT NULL")


def track(versions: DataFrame, late: str = "10 minutes", stale_ms: int = 3_600_000, forget_ms: int = 30 * 86_400_000) -> DataFrame:
    """``key, event, at, version, level`` of a stream of ``key, at, version, level``: first, edited, raised, lowered, deleted, and stale once nothing changed for ``stale_ms``.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``), which
    keeps state outside the heap and checkpoints its changes only. A key's state is its
    last version and those behind the watermark's delay; ``forget_ms`` has to be longer than ``stale_ms``.
    """
    if forget_ms <= stale_ms:
        raise ValueError("forget_ms must be longer than stale_ms")
    keyed = _typed(versions).withWatermark("at", late).groupBy("key")
    return keyed.transformWithState(NoteState(stale_ms, forget_ms), outputStructType=_OUT, outputMode="append", timeMode="eventTime")


def history(versions: DataFrame, until: datetime | Column | None = None, stale_ms: int = 3_600_000, forget_ms: int = 30 * 86_400_000) -> DataFrame:
    """The rows of ``track`` from a table: changes by looking back, stale ones by looking ahead, those after the last change up to ``until``. A key's versions are sorted, never gathered."""
    rows = _typed(versions)
    order = Window.partitionBy("key").orderBy("at", F.coalesce("version", F.lit("")), F.coalesce("level", F.lit(0)))
    before = F.lag(F.struct("at", "version", "level")).over(order)
    rows = rows.withColumn("b", before)
    micros = F.unix_micros("at")
    fresh = F.col("b").isNull() | (micros >= F.unix_micros("b.at") + forget_ms * 1000)
    was, now = F.coalesce("b.level", F.lit(0)), F.coalesce("level", F.lit(0))
    none, gone = F.col("version").isNull(), fresh | F.col("b.version").isNull()
    event = F.when(none & ~fresh & F.col("b.version").isNull(), None).when(none, "deleted").when(gone, "first").when(now > was, "raised").when(now < was, "lowered").when(~F.col("version").eqNullSafe(F.col("b.version")), "edited")
    changed = rows.withColumn("event", event).where("event IS NOT NULL").drop("b")
    end = F.timestamp_micros(F.unix_micros("at") + stale_ms * 1000)
    following = F.lead("at").over(order)
    ahead = changed.withColumn("next", following).withColumn("end", end)
    seen = F.coalesce("next", (until if isinstance(until, Column) else F.lit(until)).cast("timestamp"))
    stale = ahead.where((F.col("end") <= seen) & F.col("version").isNotNull()).select("key", F.lit("stale").alias("event"), F.col("end").alias("at"), "version", "level")
    return changed.select("key", "event", "at", "version", "level").unionByName(stale)
