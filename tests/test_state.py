"""Stream state in RocksDB: the same results as rewritten state, and writes that follow the batch."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidemark.streaming import jobs, state

TICK = "symbol string, ts timestamp, id long, mid double"


def folder_of(spark, path, n=24_000, files=6, late_s=600):
    rng = np.random.default_rng(3)
    at = np.sort(rng.integers(0, 100_000, n))
    t = pd.DataFrame({"symbol": rng.choice(["a", "b"], n, p=[0.9, 0.1]), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(at, "s"), "id": np.arange(n), "mid": rng.normal(100, 5, n).round(3)})
    came = np.argsort(at + rng.integers(0, late_s, n), kind="stable")
    for part in np.array_split(came, files):
        spark.createDataFrame(t.iloc[rng.permutation(part)], TICK).coalesce(1).write.mode("append").parquet(str(path))
    return t


@pytest.mark.parametrize("per_batch", [1, 6])
def test_ticks_go_through_in_event_order(spark, tmp_path, per_batch):
    t = folder_of(spark, tmp_path / "in").sort_values(["symbol", "ts", "id"])
    stream = spark.readStream.schema(TICK).option("maxFilesPerTrigger", per_batch).load(str(tmp_path / "in"))
    with state.rocksdb(spark):
        got = jobs.to_files(state.keyed_state(stream, jobs.sma_step(20), [], ["sma", "warm"], late="700 seconds"), str(tmp_path / "out")).toPandas()
    t["sma"] = t.groupby("symbol").mid.transform(lambda x: x.rolling(20, min_periods=1).mean())
    want = t[t.ts < t.ts.max() - pd.Timedelta("700s")]
    both = want.merge(got, on=["symbol", "id"])
    assert len(got) == len(want) == len(both) > 20_000
    assert np.abs(both.sma_x - both.sma_y).max() < 1e-9
    assert spark.conf.get(state.PROVIDER[0], None) != state.PROVIDER[1]


def test_writes_follow_the_batch_and_not_the_backlog(spark, tmp_path):
    """One tick a second in files of 50, and an hour's wait: the backlog grows, what a batch writes doesn't."""
    start = dt.datetime(2024, 1, 1)
    for f in range(10):
        rows = [("a", start + dt.timedelta(seconds=50 * f + i), 50 * f + i, 1.0) for i in range(50)]
        spark.createDataFrame(rows, TICK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).load(str(tmp_path / "in"))
    with state.rocksdb(spark):
        out = state.keyed_state(stream, jobs.ema_step(5), [0.0] * 4, ["ema", "mean", "std"], late="1 hour")
        query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"] and p["numInputRows"]]
    total = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"] and p["numInputRows"]]
    assert len(updated) == 10 and max(updated[1:]) <= max(updated[:2]) and total[-1] > total[0]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 0  # all of it still waits


def test_a_batch_is_ordered_in_runs_and_taken_out_by_entries(monkeypatch):
    """A worker never holds a key's whole batch, neither when it comes nor when it goes."""

    class Held(dict):
        def updateValue(self, k, v): self[k] = v
        def removeKey(self, k): del self[k]
        def getValue(self, k): return self[k]
        def iterator(self): return iter(list(self.items()))
        def exists(self): return "v" in self
        def get(self): return self["v"]
        def update(self, v): self["v"] = v

    class Handle:
        def getValueState(self, *_): return Held()
        def getMapState(self, *_): return Held()
        def registerTimer(self, _): pass

    class Clock:
        def __init__(self, ms): self.ms = ms
        def getCurrentWatermarkInMs(self): return self.ms

    monkeypatch.setattr(state, "ENTRY", 100)
    monkeypatch.setattr(state, "RUN", 1_000, raising=False)
    most, concat = [], pd.concat
    monkeypatch.setattr(state.pd, "concat", lambda x, **k: (lambda y: most.append(len(y)) or y)(concat(x, **k)))
    step = lambda s, x: (s.__setitem__(0, s[0] + x) or s[0],)
    runner = state.InOrder(step, [0.0], ["total"])
    runner.init(Handle())
    at = np.sort(np.random.default_rng(2).integers(0, 10**9, 20_000)) * 1000
    came = np.argsort(np.arange(20_000) + np.random.default_rng(6).integers(0, 500, 20_000))
    t = pd.DataFrame({"at": at, "id": np.arange(20_000), "x": np.arange(20_000, dtype=float)})
    list(runner.handleInputRows(("a",), iter(t.iloc[p] for p in np.array_split(came, 100)), Clock(0)))
    got = [f for f in (5 * 10**8, 10**9 + 1) for f in runner.handleExpiredTimer(("a",), Clock(f), None)]
    out = concat(got, ignore_index=True)
    assert out["id"].tolist() == list(range(20_000)) and out["total"].tolist() == np.cumsum(t.x).tolist()
    assert max(most) <= 1_500
