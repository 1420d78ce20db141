"""The correlator as a running query: tool events in, rows of what was asked and used out, with state for each session.

calls(session_id string, event_id long, ts timestamp, turn long, kind string, path string, opens string, closes string,
results array<string>, cochange array<string>, referrers array<string>, confidence string, result_count int)

``kind`` is locate, read, slice, search or other; null for events that only open a call or move the clock of turns. A row of
any kind takes the next number of its session; ``other`` ones are counted and not given out. ``opens`` and ``closes`` name
the call that starts or ends with the event. State of a session, kept by Spark between batches and restarts: its numbers and
clock, the last ``ring`` locates with what they showed, the newest locate, and the calls that are open. Timers on event
time drop calls open for longer than ``longest`` and sessions without events for ``idle``, so state does not grow with
the time that the query runs.

Defined results: rows of one session are taken in order of (ts, event_id) within a batch, batches as they come, so the
split into batches does not matter as long as no row comes in a later batch than one of its session with a later time; a
row whose time lies ``delay`` behind the latest of all is late, and Spark drops it and counts it in the query's progress
(``late_rows``). A call that is opened twice counts from the last opening, an end closes it, so a second end has no
latency; nor has one without an opening or longer than ``longest``. Where paths are shown by several locates of the
ring the newest counts; within one ranked results go before co-changed files, those before referrers. Rows with a null
session share one session of that name; null arrays show nothing; rows without a time or an id have no place and are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from larkfield.operators.sessions import FULL_TURNS, RING

HOUR = 3_600_000
#: Keyed state of this kind needs the RocksDB store; progress is kept for so many batches, as late rows are counted there.
NEEDED = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.numRecentProgressUpdates": "10000",
}
OUTPUT = (
    "session_id string, event_id long, ts timestamp, seq long, turn long, kind string, path string, locate_rank int, cluster_kind string, "
    "latency_ms long, locate_id long, locate_turn long, locate_ts timestamp, confidence string, result_count int, n_shown int"
)
LISTS = ("results", "cochange", "referrers")


def place(ring: list, path: str | None) -> tuple[int | None, str | None]:
    """(rank, cluster kind) of a path in the newest locate that shows it."""
    if path is not None:
        for shown in reversed(ring):
            if path in shown[0]:
                return shown[0].index(path) + 1, None
            if path in shown[1]:
                return None, "cochange"
            if path in shown[2]:
                return None, "referrer"
    return None, None


class Correlator(StatefulProcessor):
    """Numbers, attributes and times the calls of a session. ``own_turns``: every row is a turn, as where none are given."""

    def __init__(self, ring: int = RING, turns: int = FULL_TURNS, longest_ms: int = 24 * HOUR, idle_ms: int = 30 * 24 * HOUR, own_turns: bool = False):
        self.size, self.turns, self.longest, self.idle, self.own_turns = ring, turns, longest_ms, idle_ms, own_turns

    def init(self, handle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "seq long, turn long, last long")
        self.ring = handle.getListState("ring", "results array<string>, cochange array<string>, referrers array<string>")
        self.newest = handle.getValueState("newest", "locate_id long, seq long, turn long, ts timestamp")
        self.open = handle.getMapState("open", "call string", "ms long")

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        """State is read once and what differs is written once: each access is a call to the JVM."""
        seq, turn, last = self.clock.get() or (0, 0, 0)
        ring = [tuple(shown) for shown in self.ring.get()] if seq else []
        newest = self.newest.get() if seq else None
        kept = {call[0]: ms[0] for call, ms in self.open.iterator()} if last else {}
        open_ = dict(kept)
        before = newest
        for r in sorted(rows, key=lambda r: (r.us, r.event_id)):
            last = max(last, r.ms)
            latency = None
            if r.closes is not None and r.closes in open_:
                took = r.ms - open_.pop(r.closes)
                latency = took if took <= self.longest else None
            if r.opens is not None:
                open_[r.opens] = r.ms
            if r.turn is not None:
                turn = r.turn
            if r.kind is None:
                continue
            seq += 1
            turn = seq if self.own_turns else turn
            if r.kind == "other":
                continue
            rank, cluster = place(ring, r.path) if r.kind != "locate" else (None, None)
            inside = newest is not None and r.kind != "locate" and turn <= newest[2] + self.turns
            owner = tuple(newest) if inside else (None, None, None, None)
            if r.kind == "locate":
                ring = [*ring, tuple(list(r[name] or []) for name in LISTS)][-self.size :]
                newest = owner = (r.event_id, seq, turn, r.ts)
            yield Row(
                session_id=key[0], event_id=r.event_id, ts=r.ts, seq=seq, turn=turn, kind=r.kind, path=r.path, locate_rank=rank, cluster_kind=cluster, latency_ms=latency,
                locate_id=owner[0], locate_turn=owner[2], locate_ts=owner[3], confidence=r.confidence, result_count=r.result_count, n_shown=len(r.results or []),
            )
        self.clock.update((seq, turn, last))
        if newest is not before:
            self.ring.put(ring)
            self.newest.update(tuple(newest))
        # Calls open for longer than ``longest`` have no latency any more, and timers are needed for those that stay open only.
        open_ = {call: ms for call, ms in open_.items() if ms + self.longest >= last}
        for call in kept.keys() - open_.keys():
            self.open.removeKey((call,))
        wake = {self._hour(last + self.idle)}
        for call, ms in open_.items():
            if kept.get(call) != ms:
                self.open.updateValue((call,), (ms,))
                wake.add(self._hour(ms + self.longest))
        for at in wake:
            self.handle.registerTimer(at)

    @staticmethod
    def _hour(ms: int) -> int:
        """Timers at whole hours, so that calls of one hour share one."""
        return -(-ms // HOUR) * HOUR

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for call, opened in list(self.open.iterator()) if self.open.exists() else []:
            if opened[0] + self.longest <= now:
                self.open.removeKey(tuple(call))
        if self.clock.exists() and self.clock.get()[2] + self.idle <= now:
            for state in (self.clock, self.ring, self.newest, self.open):
                state.clear()
        return iter(())

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession):
    """Sets what the query needs; the session's own settings are put back afterwards."""
    before = {key: spark.conf.get(key, None) for key in NEEDED}
    for key, value in NEEDED.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def correlate(calls: DataFrame, delay: str = "1 day", **options) -> DataFrame:
    """Rows of a stream of ``calls``; ``options`` are those of ``Correlator``. Start it inside ``state_store``."""
    named = calls.where("ts is not null and event_id is not null").withColumn("session_id", F.coalesce("session_id", F.lit("null")))
    timed = named.withColumns({"ms": F.unix_millis("ts"), "us": F.unix_micros("ts")}).withWatermark("ts", delay)
    return timed.groupBy("session_id").transformWithState(Correlator(**options), OUTPUT, "Append", "EventTime")


def late_rows(query) -> int:
    """How many rows a query has dropped since its start because they were later than its delay."""
    return sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in progress["stateOperators"])
