"""Keyed state on streams: journal fold, replay buffer, ends of runs, subscriptions.

Each is a stateful processor over state variables in RocksDB, so that keys need not fit into memory. Rows are guarded by their sequence: late and
repeated ones change nothing. State that has to go does so by a clock of the caller's choice: ``event``, timers against the watermark of the column ``ts``; or
``processing``, a time to live. The sequence is the only order that the data have, so a watermark is for clearing state alone.
Most keys have few rows in a batch, so what a key costs counts: processors take plain rows (no table a key), and what a key holds is one value, asked for once and written if it changed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MODES = {None: "None", "event": "EventTime", "processing": "ProcessingTime"}


def use_rocks(spark: SparkSession) -> None:
    """State variables, timers and times to live need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Forgetful(StatefulProcessor):
    """What processors share: a time after which a key's state goes, by either clock."""

    def __init__(self, clock: str | None, forget_ms: int | None):
        if (clock is None) != (forget_ms is None) or clock not in MODES:
            raise ValueError("a clock (event or processing) needs forget_ms, and forget_ms a clock")
        self.clock, self.forget_ms = clock, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.variables(handle, self.forget_ms if self.clock == "processing" else None)

    def touch(self, newest_ms: int) -> None:
        """The key has news of this time: its state stays for another while."""
        if self.clock == "event":
            due = [t for (t,) in map(_one, self.handle.listTimers())]
            if not due or newest_ms + self.forget_ms > max(due):
                for t in due:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(newest_ms + self.forget_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.forget()
        yield from ()

    def close(self) -> None:
        pass


def _one(x) -> tuple:
    return x if isinstance(x, tuple) else (x,)


def _ms(row: Row) -> int:
    """The time of a row, 0 if it has none."""
    return int(row["ts"].timestamp() * 1000) if "ts" in row and row["ts"] is not None else 0


class Fold(Forgetful):
    """T-3: the newest effect of a key."""

    def variables(self, handle, ttl) -> None:
        self.latest = handle.getValueState("latest", "sequence bigint, outcome string", ttl)

    def forget(self) -> None:
        self.latest.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.latest.get()
        best, newest = before, 0
        for row in rows:
            newest = max(newest, _ms(row))
            if row["sequence"] is not None and (best is None or row["sequence"] > best[0]):
                best = (row["sequence"], row["outcome"])
        if best != before:
            self.latest.update(best)
            self.touch(newest)
            yield Row(effect_key=key[0], sequence=best[0], outcome=best[1])


class Buffer(Forgetful):
    """T-4: the newest n sequences of a run."""

    def __init__(self, n: int, clock, forget_ms):
        super().__init__(clock, forget_ms)
        self.n = n

    def variables(self, handle, ttl) -> None:
        self.newest = handle.getValueState("newest", "sequences array<bigint>", ttl)

    def forget(self) -> None:
        self.newest.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (before,) = self.newest.get() or ([],)
        before = list(before)
        known, newest = set(before), 0
        for row in rows:
            newest = max(newest, _ms(row))
            known.add(row["sequence"])
            if len(known) > 2 * self.n + 1000:
                known = set(heapq.nlargest(self.n, known))
        after = sorted(heapq.nlargest(self.n, known))
        self.touch(newest)
        if after != before:
            self.newest.update((after,))
            yield Row(run=key[0], sequences=after)


class Ends(Forgetful):
    """T-5: the end of a run. What is held of an open run goes with its end or by the clock; the mark of an ended one, a byte, stays."""

    def __init__(self, terminal: tuple[str, ...], clock, forget_ms):
        super().__init__(clock, forget_ms)
        self.terminal = terminal

    def variables(self, handle, ttl) -> None:
        self.ended = handle.getValueState("ended", "ended boolean")
        self.open = handle.getValueState("open", "events bigint, sequence bigint", ttl)

    def forget(self) -> None:
        self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.ended.exists():
            return
        events, sequence = self.open.get() or (0, -1)
        end, newest = None, 0
        for row in rows:
            newest = max(newest, _ms(row))
            if row["stage"] in self.terminal:
                end = min(end or (row["sequence"], row["stage"]), (row["sequence"], row["stage"]))
            events, sequence = events + 1, max(sequence, row["sequence"])
        if end is None:
            self.open.update((events, sequence))
            self.touch(newest)
            return
        self.ended.update((True,))
        self.open.clear()
        if self.clock == "event":
            for (t,) in map(_one, list(self.handle.listTimers())):
                self.handle.deleteTimer(t)
        yield Row(run=key[0], stage=end[1], sequence=end[0])


class Subscriptions(Forgetful):
    """T-2: the newest n events of a run, and who follows it. Events of a batch are taken first, in order of their sequence; then its cursors, in order of
    subscriber. A cursor is rejected (invalid, unknown), told that events are gone (exhausted), or answered by what follows it, and live from then on until the run ends."""

    def __init__(self, n: int, terminal: tuple[str, ...], clock, forget_ms):
        super().__init__(clock, forget_ms)
        self.n, self.terminal = n, terminal

    def variables(self, handle, ttl) -> None:
        self.kept = handle.getValueState("kept", "sequences array<bigint>, stages array<string>, followed boolean", ttl)
        self.live = handle.getMapState("live", "subscriber string", "since bigint", ttl)

    def forget(self) -> None:
        self.kept.clear()
        self.live.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.kept.get()
        kept = list(zip(held[0], held[1], strict=True)) if held else []
        # followers of a run are looked for where some are known, or where the times to live of both may differ
        known = {k[0]: v[0] for k, v in self.live.iterator()} if (held[2] if held else self.clock == "processing") else {}
        followers = dict(known)
        before, newest, events, cursors = kept[-1:], 0, {}, {}
        for row in rows:
            newest = max(newest, _ms(row))
            if row["subscriber"] is None:
                events.setdefault(row["sequence"], row["stage"])
            else:
                cursors[row["subscriber"]] = row["sequence"]
        out = []
        ended = bool(kept) and kept[-1][1] in self.terminal
        for sequence in sorted(events):
            if ended or kept and sequence <= kept[-1][0]:
                continue
            kept = [*kept, (sequence, events[sequence])][-self.n :]
            ended = events[sequence] in self.terminal
            out += [(s, "event", sequence, events[sequence]) for s in sorted(followers)]
        if ended:
            followers = {}
        for subscriber, after in sorted(cursors.items()):
            if not kept:
                out.append((subscriber, "unknown", None, None))
            elif after is not None and after > kept[-1][0]:
                out.append((subscriber, "invalid", None, None))
            elif after is not None and after + 1 < kept[0][0]:
                out.append((subscriber, "exhausted", None, None))
            else:
                out += [(subscriber, "event", *e) for e in kept if after is None or e[0] > after]
                if not ended:
                    followers[subscriber] = kept[-1][0]
        if kept[-1:] != before or kept and bool(followers) != held[2]:
            self.kept.update(([e[0] for e in kept], [e[1] for e in kept], bool(followers)))
        for subscriber in known.keys() - followers.keys():
            self.live.removeKey((subscriber,))
        for subscriber in followers.keys() - known.keys():
            self.live.updateValue((subscriber,), (followers[subscriber],))
        if kept or followers:
            self.touch(newest)
        for subscriber, delivery, sequence, stage in out:
            yield Row(run=key[0], subscriber=subscriber, delivery=delivery, sequence=sequence, stage=stage)


def _keyed(rows: DataFrame, key: str, columns: list[str], processor: Forgetful, schema: str) -> DataFrame:
    """The processor over rows by key; with an event clock rows need ``ts``."""
    use_rocks(rows.sparkSession)
    if processor.clock == "event":
        if "ts" not in rows.columns:
            raise ValueError("an event clock needs a column ts")
        columns = [*columns, "ts"]
        rows = rows.withWatermark("ts", "0 seconds")
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *columns).groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=f"{key} {kind}, {schema}", outputMode="Update", timeMode=MODES[processor.clock])


def journal_fold(effects: DataFrame, clock: str | None = None, forget_ms: int | None = None) -> DataFrame:
    """T-3: (effect_key, sequence, outcome) -> the newest effect of a key, whenever it changes."""
    return _keyed(effects, "effect_key", ["sequence", "outcome"], Fold(clock, forget_ms), "sequence bigint, outcome string")


def replay_buffer(events: DataFrame, n: int = 128, clock: str | None = None, forget_ms: int | None = None) -> DataFrame:
    """T-4: (run, sequence) -> the newest n sequences of a run, oldest first, whenever they change; state goes when a run has had no event for forget_ms."""
    return _keyed(events, "run", ["sequence"], Buffer(n, clock, forget_ms), "sequences array<bigint>")


def terminal_runs(events: DataFrame, terminal: tuple[str, ...], clock: str | None = None, forget_ms: int | None = None) -> DataFrame:
    """T-5: (run, sequence, stage) -> the first terminal event of each run, once, ever."""
    return _keyed(events, "run", ["sequence", "stage"], Ends(terminal, clock, forget_ms), "stage string, sequence bigint")


def subscriptions(events: DataFrame, cursors: DataFrame, n: int = 128, terminal: tuple[str, ...] = (), clock: str | None = None, forget_ms: int | None = None) -> DataFrame:
    """T-2: events (run, sequence, stage) and cursors (run, subscriber, after: null for all) -> (run, subscriber, delivery: event, unknown, invalid or
    exhausted, sequence, stage). Two streams meet in one state. A subscriber has one cursor a batch."""
    ts = ["ts"] if clock == "event" else []
    kind = events.schema["run"].dataType
    one = events.select("run", F.lit(None).cast("string").alias("subscriber"), F.col("sequence").cast("bigint").alias("sequence"), "stage", *ts)
    other = cursors.select(F.col("run").cast(kind).alias("run"), F.col("subscriber").cast("string").alias("subscriber"), F.col("after").cast("bigint").alias("sequence"), F.lit(None).cast("string").alias("stage"), *ts)
    return _keyed(one.unionByName(other), "run", ["subscriber", "sequence", "stage"], Subscriptions(n, terminal, clock, forget_ms), "subscriber string, delivery string, sequence bigint, stage string")
