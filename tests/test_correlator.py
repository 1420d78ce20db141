"""The stateful correlator against the batch operators, for several splits into batches, restarts and expiring state."""

import random

import pytest
from pyspark.sql import functions as F

from larkfield.operators import sessions
from larkfield.streaming import correlator

SCHEMA = (
    "session_id string, event_id long, ts timestamp, turn long, kind string, path string, opens string, closes string, results array<string>, "
    "cochange array<string>, referrers array<string>, confidence string, result_count int"
)
START = 1_704_067_200


def made(seed, n=300, sessions_=4):
    """Random events of a few sessions in order of time; some share their time."""
    rng, rows, at, open_ = random.Random(seed), [], START, {}
    files = [f"f{i}" for i in range(12)]
    for i in range(n):
        at += rng.choice([0, 1, 5, 60])
        s = f"s{rng.randrange(sessions_)}"
        kind = rng.choice(["locate", "read", "slice", "search", "other", None])
        shown = (rng.sample(files, 3), rng.sample(files, 1), rng.sample(files, 2)) if kind == "locate" else (None, None, None)
        opens = closes = None
        if kind is None:
            opens = f"c{i}"
            open_.setdefault(s, []).append(opens)
        elif open_.get(s) and rng.random() < 0.5:
            closes = open_[s].pop()
        rows.append((s, i, at, None, kind, rng.choice(files) if kind in ("read", "slice") else None, opens, closes, *shown, "low" if i % 3 else "high", 3 if kind == "locate" else None))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r[:2], None, *r[3:]) for r in rows], SCHEMA).drop("ts").join(spark.createDataFrame([(r[1], r[2]) for r in rows], "event_id long, s long"), "event_id").withColumn("ts", F.timestamp_seconds("s")).drop("s").select(*[c.split()[0] for c in SCHEMA.split(", ")])


def streamed(spark, tmp, parts, per_run=None, **options):
    """Feeds ``parts`` as files, all in one run or in several runs of one checkpoint; gives the rows."""
    for i, part in enumerate(parts):
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp}/in")
        if per_run or i == len(parts) - 1:
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in")
            with correlator.state_store(spark):
                out = correlator.correlate(stream, **options)
                query = out.writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/ck").trigger(availableNow=True).start()
                query.awaitTermination()
                assert correlator.late_rows(query) == 0
    return spark.read.parquet(f"{tmp}/out")


def cut(rows, n):
    step = -(-len(rows) // n)
    return [rows[i : i + step] for i in range(0, len(rows), step)]


def batch(spark, rows):
    """The same by the batch operators."""
    all_rows = frame(spark, rows)
    counted = sessions.numbered(all_rows.where("kind is not null"), "session_id", "ts", "event_id").withColumn("turn", F.col("seq"))
    locates = counted.where("kind = 'locate'").withColumn("locate_id", F.col("event_id"))
    used = counted.where("kind in ('read', 'slice', 'search')").select("session_id", "seq", "turn", "event_id", "kind", "path")
    ranked = sessions.attribute_ring(locates, used)
    inside = sessions.windows(locates, ranked).select("event_id", F.col("locate_id").alias("owner"))
    ms = all_rows.withColumn("ts", F.unix_millis("ts"))
    starts = ms.where("opens is not null").select("session_id", F.col("opens").alias("call_id"), "ts", F.lit(0).alias("args"))
    ends = ms.where("closes is not null").select("session_id", F.col("closes").alias("call_id"), "ts", "event_id")
    took = {r.event_id: r.latency_ms for r in sessions.pair_calls(starts, ends).collect()}
    owner = {r.event_id: r.owner for r in inside.collect()}
    rows_ = {(r.session_id, r.seq, r.event_id, r.path, r.locate_rank, r.cluster_kind, took.get(r.event_id), owner.get(r.event_id)) for r in ranked.collect()}
    return rows_, {(r.session_id, r.seq, r.event_id, took.get(r.event_id)) for r in locates.collect()}


@pytest.mark.parametrize("parts, per_run", [(1, False), (3, False), (4, True)])
def test_any_split_gives_the_rows_of_the_batch_operators(spark, tmp_path, parts, per_run):
    rows = made(parts)
    out = streamed(spark, tmp_path, cut(rows, parts), per_run, own_turns=True).collect()
    expected, locates = batch(spark, rows)
    assert {(r.session_id, r.seq, r.event_id, r.path, r.locate_rank, r.cluster_kind, r.latency_ms, r.locate_id) for r in out if r.kind != "locate"} == expected
    assert {(r.session_id, r.seq, r.event_id, r.latency_ms) for r in out if r.kind == "locate"} == locates
    assert len(out) == len(expected) + len(locates) and any(r.locate_rank for r in out) and any(r.cluster_kind for r in out) and any(r.latency_ms is not None for r in out)


def test_calls_and_sessions_expire(spark, tmp_path):
    day = 86_400

    def row(i, at, kind, opens=None, closes=None, path=None, shown=None, session="a", turn=None):
        return (session, i, START + at, turn, kind, path, opens, closes, shown, None, None, None, None)

    parts = [
        [row(1, 0, "locate", shown=["x", "y"], turn=4), row(2, 1, None, opens="p"), row(3, 2, None, opens="p"), row(4, 5, "read", closes="p", path="y"), row(5, 6, "read", closes="p", path="z"), row(6, 7, None, opens="old")],
        [row(7, 2 * day, "search", session="b"), row(8, 2 * day + 1, "read", path="x", turn=20)],
        [row(9, 2 * day + 2, "read", closes="old", path="x"), row(10, 9 * day, "search", session="b")],
        [row(11, 20 * day, "search", session="b")],
        [row(12, 30 * day, "read", path="x")],
    ]
    out = {r.event_id: r for r in streamed(spark, tmp_path, parts, per_run=True, longest_ms=day * 1_000, idle_ms=10 * day * 1_000).collect()}
    assert (out[4].latency_ms, out[4].locate_rank, out[4].locate_id, out[4].turn) == (3_000, 2, 1, 4)  # the last opening counts
    assert out[5].latency_ms is None and out[5].locate_rank is None and out[5].seq == 3
    assert (out[8].locate_rank, out[8].locate_id, out[8].seq) == (1, None, 4)  # in the ring, beyond the turns of the window
    assert out[9].latency_ms is None  # open for longer than a call may take
    assert (out[12].seq, out[12].locate_rank) == (1, None)  # the session was dropped, another begins


def test_rows_with_nulls(spark, tmp_path):
    none = (None,) * 9
    rows = [(None, 1, START, None, "locate", *none[:6], None, None), (None, 2, START, None, "read", *none[:6], None, None), ("s", 3, START, None, None, *none[:6], None, None)]
    out = sorted((r.event_id, r.session_id, r.seq, r.locate_rank, r.locate_id) for r in streamed(spark, tmp_path, [rows]).collect())
    assert out == [(1, "null", 1, None, 1), (2, "null", 2, None, 1)]


class _State:
    """One state of a session that counts how often it is asked."""

    def __init__(self, asked):
        self.asked, self.value, self.calls = asked, None, {}

    def __getattr__(self, name):
        self.asked.append(name)
        return getattr(self, f"_{name}")

    def _exists(self):
        return self.value is not None or bool(self.calls)

    def _get(self):
        return self.value

    def _put(self, value):
        self.value = value

    _update = _put

    def _iterator(self):
        return iter(list(self.calls.items()))

    def _containsKey(self, key):
        return key in self.calls

    def _getValue(self, key):
        return self.calls[key]

    def _updateValue(self, key, value):
        self.calls[key] = value

    def _removeKey(self, key):
        self.calls.pop(key, None)


def test_state_is_asked_a_few_times_a_batch():
    """Each access to state goes to the JVM and back: calls that open and close within a batch must not need any."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    asked = []
    handle = SimpleNamespace(**{f"get{kind}State": (lambda *_: _State(asked)) for kind in ("Value", "List", "Map")}, registerTimer=lambda at: asked.append("timer"))
    worker = correlator.Correlator(own_turns=True)
    worker.init(handle)
    none = dict(turn=None, path=None, results=["a"], cochange=None, referrers=None, confidence=None, result_count=None)
    hour = correlator.HOUR
    rows = [Row(us=i * hour * 1000, ms=i * hour, ts=None, event_id=i, kind="locate" if i % 2 == 0 else "slice", opens=f"c{i}" if i % 2 == 0 else None, closes=f"c{i - 1}" if i % 2 else None, **none) for i in range(400)]
    for part in (rows[:200], rows[200:]):
        asked.clear()
        out = list(worker.handleInputRows(("s",), part, None))
        assert [r.latency_ms for r in out] == [None, hour] * 100 and len(asked) <= 10
    assert [r.seq for r in out] == list(range(201, 401))
