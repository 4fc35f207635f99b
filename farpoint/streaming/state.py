"""Trailing counts per cell as keyed state with event-time timers.

A cell's state is its count, the arrivals it counts now (``held``, one entry for each instant, by
the tick in which they leave) and the arrivals whose turn has not come (``pending``, by their
tick). Time is cut into ticks of a 64th of the stay; a tick reads and writes its own rows only. A
timer at the end of a tick fires once the watermark has passed it, so every arrival of the
tick is there whatever the order they came in: the tick's arrivals and departures are then
gone through in order of time. An arrival sets the timer of its own tick and that of its
departure; a cell that holds nothing more has no state and no timer.

The answers are those of ``running_counts`` and ``cell_updates`` on a table, for all ticks that
the watermark has passed. The state lives in the RocksDB store, below the checkpoint of the
query: it is not bounded by memory, and a lost executor takes it up from there. Each cell has
one task at a time, as in any keyed state; arrivals of one instant fold to an entry.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from farpoint.functions import timing
from farpoint.operators.cells import assign_cells
from farpoint.params import GridParams

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TICKS = 64  # ticks in the time a point stays
ROWS_AT_ONCE = 10_000  # rows handed to the state together
_PARTITIONS = "spark.sql.shuffle.partitions"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a commit uploads what has changed, not a snapshot of the store
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",  # one store for a join's partition, not four
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, as timers need.

    Every partition of every stateful step is a store that each micro-batch opens and commits,
    whatever it holds. So there are no more partitions than tasks that run at a time; a
    store is on disk and may be of any size. A checkpoint that is there keeps its own settings.
    """
    partitions = min(int(spark.conf.get(_PARTITIONS)), max(1, spark.sparkContext.defaultParallelism))
    wanted = {**_STATE, _PARTITIONS: str(partitions)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def tick_us(window: timedelta) -> int:
    """Width of a tick in microseconds: whole milliseconds, which is what timers have."""
    return max(1, round(window.total_seconds() * 1000) // TICKS) * 1000


class _Turns:
    """Rows that wait for the end of a tick, in a map state: adding some or taking those of one
    tick touches no others. No value holds more than ``ROWS_AT_ONCE`` rows."""

    def __init__(self, handle: StatefulProcessorHandle, name: str) -> None:
        self.rows = handle.getMapState(name, "tick bigint, part bigint", "us array<bigint>, x array<bigint>")
        self.parts = handle.getMapState(f"{name}_parts", "tick bigint", "n bigint")

    def add(self, tick: int, us: list[int], x: list[int]) -> None:
        known = self.parts.getValue((tick,))
        part = known[0] if known else 0
        for i in range(0, len(us), ROWS_AT_ONCE):
            self.rows.updateValue((tick, part), (us[i : i + ROWS_AT_ONCE], x[i : i + ROWS_AT_ONCE]))
            part += 1
        self.parts.updateValue((tick,), (part,))

    def take(self, tick: int) -> Iterator[tuple[int, int]]:
        known = self.parts.getValue((tick,))
        if not known:
            return
        for part in range(known[0]):
            us, x = self.rows.getValue((tick, part))
            self.rows.removeKey((tick, part))
            yield from zip(us, x)
        self.parts.removeKey((tick,))


class TrailingCounts(StatefulProcessor):
    """``changes``: one row for each instant at which a cell's count changes; otherwise one row
    for each point with the count after its instant."""

    def __init__(self, stay: int, tick: int, changes: bool) -> None:
        self.stay, self.tick, self.changes = stay, tick, changes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = _Turns(handle, "pending")
        self.held = _Turns(handle, "held")
        self.count = handle.getValueState("count", "n bigint")

    def _tick(self, us: int) -> int:
        """End of the tick that holds an instant, in milliseconds."""
        return -(-us // self.tick) * self.tick // 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        timers: set[int] = set()
        new: dict[int, tuple[list[int], list[int]]] = {}
        for n, row in enumerate(rows, 1):
            tick = self._tick(row.us)
            us, points = new.setdefault(tick, ([], []))
            us.append(row.us)
            points.append(row.point_id)
            timers |= {tick, self._tick(row.us + self.stay)}
            if n % ROWS_AT_ONCE == 0:
                self._wait(new)
                new = {}
        self._wait(new)
        for tick in timers:
            self.handle.registerTimer(tick)
        return iter(())

    def _wait(self, new: dict[int, tuple[list[int], list[int]]]) -> None:
        for tick, (us, points) in new.items():
            self.pending.add(tick, us, points)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        due: dict[int, list[int]] = {}
        for us, point in self.pending.take(end):
            due.setdefault(us, []).append(point)
        leaving = {us + self.stay: n for us, n in self.held.take(end)}
        later: dict[int, tuple[list[int], list[int]]] = {}
        for us in sorted(due):
            out = self._tick(us + self.stay)
            if out <= end:
                leaving[us + self.stay] = len(due[us])
                continue
            instants, sizes = later.setdefault(out, ([], []))
            instants.append(us)
            sizes.append(len(due[us]))
        for out, (instants, sizes) in later.items():
            self.held.add(out, instants, sizes)
        before = self.count.get() if self.count.exists() else None
        count = before[0] if before else 0
        rows = []
        for us in sorted(due.keys() | leaving.keys()):
            change = len(due.get(us, ())) - leaving.get(us, 0)
            count += change
            if self.changes and change:
                rows.append(Row(cell=key[0], at=us, count=count))
            elif not self.changes:
                rows += [Row(point_id=p, cell=key[0], count=count) for p in due.get(us, ())]
        if count:
            self.count.update((count,))
        elif before:
            self.count.clear()
        return iter(rows)

    def close(self) -> None:
        pass


def _counted(points: DataFrame, params: GridParams, window: timedelta, delay: timedelta, changes: bool, schema: str) -> DataFrame:
    # a point is counted up to and with the instant ``arrival + window``
    stay = round(window.total_seconds() * 1_000_000) + 1
    placed = assign_cells(points, params).select("arrival", timing.arrival_us(points, "arrival").alias("us"), "point_id", "cell")
    return (
        placed.withWatermark("arrival", f"{round(delay.total_seconds() * 1000)} milliseconds")
        .groupBy("cell")
        .transformWithState(TrailingCounts(stay, tick_us(window), changes), schema, "Append", "eventTime")
    )


def stream_running_counts(points: DataFrame, params: GridParams, window: timedelta, delay: timedelta = timedelta(milliseconds=500)) -> DataFrame:
    """Each point of a stream with the points of its cell in the trailing window, itself and
    points of the same instant included: ``(point_id, cell, count)``.

    Start the query inside ``state_on_disk``. A point that comes after the watermark has
    passed it is not counted.
    """
    return _counted(points, params, window, delay, False, "point_id bigint, cell array<bigint>, count bigint")


def stream_cell_updates(points: DataFrame, params: GridParams, window: timedelta, delay: timedelta = timedelta(milliseconds=500)) -> DataFrame:
    """Change log of the trailing counts of a stream: ``(cell, at, count)``, departures and the
    fall to zero included. Start the query inside ``state_on_disk``."""
    return _counted(points, params, window, delay, True, "cell array<bigint>, at bigint, count bigint")
