"""Snapshot tables: what readers see beside writers that win, lose or die; feature stores whose symbols lag; depth scales."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalogue
from tidemark.sources import store
from tidemark.sources.snapshots import Conflict, Table, sink

DAY = dt.datetime(2024, 1, 1)
KIND = "symbol string, ts timestamp_ntz, id long"


def rows(spark, symbols, n=40, first=0):
    return spark.createDataFrame([(s, DAY + dt.timedelta(hours=i), first + i) for s in symbols for i in range(n)], KIND)


def held(df):
    return sorted((r.symbol or "", r.id) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, str(tmp_path / "t"))


def test_a_pinned_reader_keeps_its_version(spark, table):
    one = table.append(rows(spark, ["a", "b"]))
    two = table.append(rows(spark, ["c"], first=100))
    assert table.versions() == [1, 2] and table.snapshot() == two and table.snapshot(1) == one
    assert held(table.read(one)) == held(rows(spark, ["a", "b"])) and table.read().count() == 120
    assert table.read().columns == ["symbol", "ts", "id"]


def test_a_range_read_opens_only_touched_files(spark, table):
    table.per_file = 300
    s = table.append(rows(spark, ["hot"], 2000).unionByName(rows(spark, ["b"], 5)))
    every, some = table.chosen(s), table.chosen(s, ["hot"], "2024-01-03", "2024-01-04")
    assert 0 < len(some) < len(every) and len({f for f in every if "symbol=hot" in f}) > 1
    got = table.read(s, ["hot"], "2024-01-03", "2024-01-04")
    assert sorted(r.id for r in got.collect()) == list(range(48, 72))
    assert {f.rsplit("/", 1)[1] for f in got.inputFiles()} == {f.rsplit("/", 1)[1] for f in some}
    assert table.read(s, ["nothing"]).count() == 0 and table.read(s, start="2030-01-01").columns == ["symbol", "ts", "id"]


def test_odd_keys_come_back(spark, table):
    odd = ["a b", "c/d", "e%f", "g=h", "i+j", None]
    table.append(rows(spark, odd, 2))
    assert held(table.read()) == held(rows(spark, odd, 2)) and held(table.read(keys=["i+j", "c/d"])) == held(rows(spark, ["i+j", "c/d"], 2))


def test_a_writer_that_dies_leaves_the_old_snapshot(spark, table, monkeypatch):
    """Killed after its files, after its list, and in the midst of the log file."""
    table.append(rows(spark, ["a"]))
    before = held(table.read())

    def die(*a, **k):
        raise KeyboardInterrupt

    table.add_files(rows(spark, ["b"]))
    assert held(table.read()) == before
    with monkeypatch.context() as m:
        m.setattr("tidemark.sources.snapshots.json.dumps", die)
        with pytest.raises(KeyboardInterrupt):
            table.append(rows(spark, ["b"]))
    assert held(table.read()) == before and table.versions() == [1]
    with open(f"{table.path}/log/{2:020d}.json", "w") as f:
        f.write('{"list": "half')
    assert held(table.read()) == before and table.versions() == [1]
    table.append(rows(spark, ["c"]))
    assert table.versions() == [1, 3] and table.read().count() == 80
    assert table.vacuum() > 0 and table.read().count() == 80 and table.versions() == [3]


def test_two_writers_one_wins(spark, table):
    base = table.append(rows(spark, ["a", "b"]))
    gone = spark.createDataFrame([("a",)], "key string")
    table.replace(rows(spark, ["a"], 3, 500), gone, base)
    with pytest.raises(Conflict):
        table.replace(rows(spark, ["a"], 4, 900), gone, base)
    assert sorted(r.id for r in table.read(keys=["a"]).collect()) == [500, 501, 502] and table.read(keys=["b"]).count() == 40


def test_an_append_holds_beside_another_commit(spark, table):
    table.append(rows(spark, ["a"]))
    commit, tried = table.commit, []

    def late(base, *a, **k):
        if not tried:
            tried.append(1)
            Table(spark, table.path).append(rows(spark, ["b"]))
        return commit(base, *a, **k)

    table.commit = late
    table.append(rows(spark, ["c"]))
    assert {r.symbol for r in table.read().select("symbol").distinct().collect()} == {"a", "b", "c"} and table.versions() == [1, 2, 3]


def test_a_refresh_touches_changed_keys_only(spark, table):
    source = rows(spark, ["a", "b", "c", None])
    table.refresh(source)
    files = set(table.chosen(table.snapshot()))
    assert table.refresh(source).version == 1
    changed = source.filter("symbol is null or symbol <> 'c'").unionByName(source.filter("symbol = 'b'").limit(1))  # b repeats a row, c is gone
    s = table.refresh(changed)
    assert held(table.read()) == held(changed) and s.version == 2
    assert {f for f in files if "symbol=a" in f} <= set(table.chosen(s)) and not {f for f in files if "symbol=b" in f} & set(table.chosen(s))


def test_a_batch_delivered_again_counts_once(spark, table):
    put = sink(table, "job")
    for batch in (0, 1, 1, 0, 2):
        put(rows(spark, ["a"], 5, 100 * batch), batch)
    assert table.read().count() == 15 and table.versions() == [1, 2, 3]


# feature stores


def test_lagging_symbols_and_new_features_are_caught_up(spark, tmp_path):
    at = [(s, DAY + dt.timedelta(hours=6 * i), 100.0 + (i * 7 + ord(s)) % 11) for s in "ab" for i in range(80)]
    bars = spark.createDataFrame(at, "symbol string, ts timestamp_ntz, close double")
    bars = bars.withColumns({"open": F.col("close") - 0.5, "high": F.col("close") + 1, "low": F.col("close") - 1, "volume": F.lit(1.0)})
    path = str(tmp_path / "f")
    early = bars.filter((F.col("symbol") == "a") | (F.col("ts") < DAY + dt.timedelta(days=9)))
    same = lambda names: sorted(map(str, spark.read.parquet(path).select("symbol", "ts", *names).collect())) == sorted(map(str, catalogue.materialise(bars, names).collect()))
    catalogue.extend(early, path, ["vol_20"], "14 DAYS")
    assert spark.read.parquet(path).filter("symbol = 'b'").count() == 36
    catalogue.extend(bars, path, ["vol_20"], "14 DAYS")
    assert same(["vol_20"])
    catalogue.extend(bars, path, ["atr_6"], "14 DAYS")  # not in the store yet: made for all bars, beside what is there
    assert same(["vol_20", "atr_6"])
    catalogue.extend(bars, path, ["atr_6"], "14 DAYS", overlap="2 DAYS")
    assert same(["vol_20", "atr_6"])


# depth


def test_small_and_negative_prices_are_scaled_with_the_rest(spark):
    prices = [-0.005, 0.000001, 1.1, 1.2, 1.3]
    wide = spark.createDataFrame([(i, DAY, int(p * 1e9), int(p * 1e9) + 10**7, 1, 2) for i, p in enumerate(prices)], "id int, t timestamp_ntz, bid_px_00 long, ask_px_00 long, bid_sz_00 int, ask_sz_00 int")
    got = {r.id: r.bid for r in store.depth(wide, "t", keep=("id",)).collect()}
    assert all(abs(got[i] - p) < 1e-9 for i, p in enumerate(prices))
    plain = wide.withColumns({x: F.col(x) / 1e9 for x in ("bid_px_00", "ask_px_00")})
    assert all(abs(r.bid - prices[r.id]) < 1e-9 for r in store.depth(plain, "t", keep=("id",)).collect())
    assert {r.id: r.bid for r in store.depth(wide, "t", scale=1.0, keep=("id",)).collect()}[2] == 1.1e9


# exports


def test_a_folder_of_exports_in_three_forms(spark, tmp_path):
    put = {
        "a [1].csv": "Gmt time,Bid,Ask,Volume\n2024-01-02T10:00:00.123Z,1.1,1.2,5\n2024-01-02T10:00:01.000Z,1.3,1.4,6\nbroken,x,y,z\n",
        "b.csv": "2024.01.02;10:00:02;1.5;1.6;7\n2024.01.02;10:00:03;1.7;1.8;8\n",
        "c+d.txt": "Date\tTime\tOpen\tHigh\tLow\tClose\tVolume\n2024.01.02\t10:00\t1\t3\t0.5\t2\t9\n",
        "empty.csv": "",
    }
    for name, text in put.items():
        (tmp_path / name).write_text(text)
    got = store.read_export(spark, str(tmp_path), F.regexp_extract("_file", "([^/]*)$", 1), half_spread=0.25)
    found = sorted((r.ts.strftime("%H:%M:%S"), r.bid, r.ask, r.volume) for r in got.collect())
    assert found == [("10:00:00", 1.1, 1.2, 5.0), ("10:00:00", 1.75, 2.25, 9.0), ("10:00:01", 1.3, 1.4, 6.0), ("10:00:02", 1.5, 1.6, 7.0), ("10:00:03", 1.7, 1.8, 8.0)]
    assert got.select("symbol").distinct().count() == 3
