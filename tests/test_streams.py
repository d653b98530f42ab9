"""Keyed state over several batches: guards, replays, and state that goes when time has passed."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row

from shoebox.streaming import rollup as R
from shoebox.streaming import state as W

START = datetime(2024, 1, 1)
EVENTS = "run string, sequence bigint, stage string, ts timestamp"
EFFECTS = "effect_key string, sequence bigint, outcome string"


class Feed:
    """A table as a stream of files, one a batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        folder.mkdir()

    def put(self, *rows):
        full = [(*r[:3], START + timedelta(minutes=r[3])) if len(r) == 4 and not isinstance(r[3], datetime) else r for r in rows]
        self.spark.createDataFrame(full, self.schema).coalesce(1).write.parquet(str(self.folder / f"{self.n}.parquet"))
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("recursiveFileLookup", True).parquet(str(self.folder))


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def held(spark, at, variable):
    return spark.read.format("statestore").option("path", f"{at}/state").option("stateVarName", variable).load().collect()


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path / "in", EVENTS)


def test_an_end_is_reported_once_ever(spark, feed, tmp_path):
    at = str(tmp_path / "at")
    feed.put(("r", 1, "run", 0), ("s", 1, "run", 0))
    out = R.deliveries(W.terminal_runs(feed.stream(), ("done", "failed"), "event", 600_000), at)
    assert got(out, "run") == [] and len(held(spark, at, "open")) == 2
    feed.put(("r", 3, "done", 1), ("r", 2, "failed", 1), ("s", 2, "run", 1))
    out = R.deliveries(W.terminal_runs(feed.stream(), ("done", "failed"), "event", 600_000), at)
    assert got(out, "run", "stage", "sequence") == [("r", "failed", 2)]
    assert [r.key.run for r in held(spark, at, "open")] == ["s"]
    feed.put(("r", 2, "failed", 500), ("r", 9, "done", 500), ("t", 1, "run", 500))  # a day later, after the clock
    out = R.deliveries(W.terminal_runs(feed.stream(), ("done", "failed"), "event", 600_000), at)
    feed.put(("r", 4, "done", 2000), ("t", 2, "run", 2000))
    out = R.deliveries(W.terminal_runs(feed.stream(), ("done", "failed"), "event", 600_000), at)
    assert got(out, "run", "stage", "sequence") == [("r", "failed", 2)]
    assert "s" not in [r.key.run for r in held(spark, at, "open")] and [r.key.run for r in held(spark, at, "ended")] == ["r"]


def test_a_buffer_goes_when_time_has_passed(spark, feed, tmp_path):
    at, clock = str(tmp_path / "at"), ("event", 600_000)
    feed.put(*[("r", i, "x", i) for i in (3, 1, 2, 5, 4)], ("s", 1, "x", 0))
    out = R.deliveries(W.replay_buffer(feed.stream(), 3, *clock), at)
    assert got(out, "run", "sequences") == [("r", [3, 4, 5]), ("s", [1])]
    feed.put(("r", 2, "x", 6), ("r", 5, "x", 6))  # late and repeated
    out = R.deliveries(W.replay_buffer(feed.stream(), 3, *clock), at)
    assert len(got(out, "run")) == 2 and {r.key.run for r in held(spark, at, "newest")} == {"r", "s"}
    feed.put(("t", 1, "x", 60))
    out = R.deliveries(W.replay_buffer(feed.stream(), 3, *clock), at)
    feed.put(("t", 2, "x", 61))
    out = R.deliveries(W.replay_buffer(feed.stream(), 3, *clock), at)
    assert {r.key.run for r in held(spark, at, "newest")} == {"t"}


def test_a_time_to_live_clears_state(spark, feed, tmp_path):
    seen = []
    feed.put(("r", 1, "x", 0), ("r", 2, "x", 0))
    q = W.replay_buffer(feed.stream(), 3, "processing", 3000).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        wait = time.time() + 90
        while not seen and time.time() < wait:
            time.sleep(0.5)
        assert seen == [("r", [1, 2])]
        time.sleep(6)
        feed.put(("r", 7, "x", 0))
        while len(seen) < 2 and time.time() < wait:
            time.sleep(0.5)
        assert seen[1] == ("r", [7])  # what was before is forgotten
    finally:
        q.stop()


def test_fold_is_guarded_by_sequence(spark, tmp_path):
    feed, at = Feed(spark, tmp_path / "in", EFFECTS), str(tmp_path / "at")
    feed.put(("k", 5, "created"), ("k", 4, "failed"), ("l", 1, "failed"))
    out = R.deliveries(W.journal_fold(feed.stream()), at)
    feed.put(("k", 3, "failed"), ("k", 5, "failed"), ("l", 2, "created"))
    out = R.deliveries(W.journal_fold(feed.stream()), at)
    assert got(out, "_batch", "effect_key", "sequence", "outcome") == [(0, "k", 5, "created"), (0, "l", 1, "failed"), (1, "l", 2, "created")]
    with pytest.raises(ValueError, match="clock"):
        W.journal_fold(feed.stream(), "event")
    with pytest.raises(ValueError, match="ts"):
        W.journal_fold(feed.stream(), "event", 5)


def test_subscribers_follow_a_run(spark, feed, tmp_path):
    cursors, at = Feed(spark, tmp_path / "cursors", "run string, subscriber string, after bigint"), str(tmp_path / "at")
    stream = lambda: W.subscriptions(feed.stream(), cursors.stream(), 3, ("done",))
    feed.put(*[("r", i, f"e{i}", 0) for i in range(1, 6)])
    cursors.put(("r", "all", None), ("r", "after4", 4), ("r", "gone", 1), ("r", "ahead", 6), ("q", "early", 0), ("r", "edge", 2))
    out = R.deliveries(stream(), at)
    got_ = lambda b: got(R.read_deliveries(stream(), at).where(f"_batch = {b}").fillna(-1).fillna(""), "subscriber", "delivery", "sequence", "stage")
    assert got_(0) == [("after4", "event", 5, "e5"), ("ahead", "invalid", -1, ""), ("all", "event", 3, "e3"), ("all", "event", 4, "e4"), ("all", "event", 5, "e5"), ("early", "unknown", -1, ""), *[("edge", "event", i, f"e{i}") for i in (3, 4, 5)], ("gone", "exhausted", -1, "")]
    feed.put(("r", 6, "e6", 1), ("r", 5, "again", 1), ("r", 8, "done", 1), ("r", 9, "beyond", 1))
    cursors.put(("r", "new", 6))
    out = R.deliveries(stream(), at)
    assert got_(1) == sorted([(s, "event", i, e) for s in ("after4", "all", "edge") for i, e in ((6, "e6"), (8, "done"))] + [("new", "event", 8, "done")])
    assert held(spark, at, "live") == []
    feed.put(("r", 10, "late", 2))
    cursors.put(("r", "last", 7))
    out = R.deliveries(stream(), at)
    assert got_(2) == [("last", "event", 8, "done")]


def test_what_a_key_costs_does_not_include_a_table():
    """A processor gets plain rows and asks for its state once."""
    asked = []

    class Held:
        def get(self):
            asked.append("get")

        def update(self, value):
            asked.append(value)

    p = W.Fold(None, None)
    p.latest = Held()
    rows = [Row(effect_key=1, sequence=5, outcome="a"), Row(effect_key=1, sequence=9, outcome="b"), Row(effect_key=1, sequence=7, outcome="c")]
    assert list(p.handleInputRows((1,), iter(rows), None)) == [Row(effect_key=1, sequence=9, outcome="b")]
    assert asked == ["get", (9, "b")]
