"""Keyed stream state in RocksDB: ticks that wait for the watermark are appended to the state, and timers take them out again.

The same results as jobs.keyed_state, which rewrites a key's whole backlog in each batch. Here a batch's ticks of a key become entries
of their own (ENTRY ticks at most), and an index holds the earliest time of each entry. A timer fires when the watermark has passed an entry's first
tick: what has passed goes through the step in the order of (ts, id), entries that are used up are removed, and only those that the
watermark cuts through are written again. So the bytes written in a batch follow the batch, not the backlog.

A batch is put in order RUN ticks at a time, and entries are merged by their first ticks when they are taken out, so a worker holds a run,
or the entries that overlap at one time, and never a key's whole batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Ticks of an entry, and of a frame that is given out.
ENTRY = 10_000
#: Ticks of a batch that are put in order at once.
RUN = 200_000


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; other streams of the session keep their own store."""
    name, value = PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def doubles(values: list[float]) -> pd.Series:
    """A column in which an undefined number stays one and does not become null on its way to Spark."""
    return pd.Series(pd.arrays.ArrowExtensionArray(pa.array([float(v) for v in values], pa.float64())))


class InOrder(StatefulProcessor):
    """Gives step(numbers, x) for each tick of a key once the watermark has passed it, in the order of (at, id)."""

    def __init__(self, step: Callable[[list, float], tuple[float, ...]], start: list[float], names: list[str]):
        self.step, self.start, self.names = step, start, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getValueState("numbers", "s array<double>, next long")
        self.first = handle.getMapState("first", "n long", "at long")
        self.ticks = handle.getMapState("ticks", "n long", "at array<long>, id array<long>, x array<double>")

    def put(self, n: int, rows: pd.DataFrame) -> None:
        at = int(rows["at"].iloc[0])
        self.ticks.updateValue((n,), (rows["at"].tolist(), rows["id"].tolist(), rows["x"].tolist()))
        self.first.updateValue((n,), (at,))
        self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, n = self.numbers.get() if self.numbers.exists() else (list(self.start), 0)
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        parts, many = [], 0

        def flush() -> int:
            new = pd.concat(parts, ignore_index=True).sort_values(["at", "id"], kind="stable")
            parts.clear()
            for k in range(0, len(new), ENTRY):
                self.put(n + k // ENTRY, new.iloc[k : k + ENTRY])
            return n + -(-len(new) // ENTRY)

        for r in rows:
            part = r[["at", "id", "x"]]
            part = part[part["at"] >= passed]  # later ones are left out
            if len(part):
                parts.append(part)
                many += len(part)
            if many >= RUN:
                n, many = flush(), 0
        if parts:
            n = flush()
        self.numbers.update((list(held), n))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted((at, n) for (n,), (at,) in self.first.iterator() if at < passed)
        if not due:
            return
        held, following = self.numbers.get()
        held, parts = list(held), []
        for place, (_, n) in enumerate(due):
            at, ids, x = self.ticks.getValue((n,))
            part = pd.DataFrame({"at": list(at), "id": list(ids), "x": list(x)})
            rest = part[part["at"] >= passed]
            parts.append(part[part["at"] < passed])
            if len(rest):
                self.put(n, rest)
            else:
                self.ticks.removeKey((n,))
                self.first.removeKey((n,))
            # what comes before all entries that follow is whole; the rest of these entries is kept
            rows = pd.concat(parts, ignore_index=True).sort_values(["at", "id"], kind="stable")
            whole = len(rows) if place + 1 == len(due) else int((rows["at"] < due[place + 1][0]).sum())
            parts = [rows.iloc[whole:]]
            for k in range(0, whole, ENTRY):
                some = rows.iloc[k : min(k + ENTRY, whole)]
                made = [self.step(held, v) for v in some["x"].tolist()]
                yield pd.DataFrame({"symbol": key[0], "id": some["id"].to_numpy()} | {name: doubles([m[i] for m in made]) for i, name in enumerate(self.names)})
        self.numbers.update((held, following))

    def close(self) -> None:
        pass


def keyed_state(ticks: DataFrame, step: Callable[[list, float], tuple[float, ...]], start: list[float], names: list[str], value: Column | None = None, late: str = "30 seconds") -> DataFrame:
    """As jobs.keyed_state, with its state in RocksDB: to be started inside rocksdb(spark) (ST5, ST6, ST7, ST8, ST12)."""
    out = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("id", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]])
    x = F.col("mid") if value is None else value
    rows = ticks.withWatermark("ts", late).select("symbol", "id", "ts", F.unix_micros("ts").alias("at"), x.cast("double").alias("x"))
    return rows.groupBy("symbol").transformWithStateInPandas(InOrder(step, start, names), out, "Append", "EventTime")
