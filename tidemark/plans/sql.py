"""Builders for the SQL that queries are compared with."""

from __future__ import annotations

TICKS = """ticks AS (
    SELECT event_type AS symbol, ts, event_id AS id, value AS mid, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume,
           0.01 * (1 + event_id % 5) AS spread, value - 0.01 * (1 + event_id % 5) / 2 AS bid, value + 0.01 * (1 + event_id % 5) / 2 AS ask
    FROM events)"""

BARS = f"""{TICKS},
bars AS (
    SELECT symbol, time_bucket(INTERVAL '6 hours', ts) AS ts, first(mid ORDER BY ts, id) AS open, max(mid) AS high, min(mid) AS low,
           last(mid ORDER BY ts, id) AS close, sum(volume) AS volume, avg(spread) AS spread,
           last(bid ORDER BY ts, id) AS bid_close, last(ask ORDER BY ts, id) AS ask_close, count(*) AS n
    FROM ticks GROUP BY ALL)"""


def over(n: int, skip: int = 0, key: str = "symbol") -> str:
    return f"OVER (PARTITION BY {key} ORDER BY ts ROWS BETWEEN {n - 1 + skip} PRECEDING AND {f'{skip} PRECEDING' if skip else 'CURRENT ROW'})"


def roll(f: str, x: str, n: int, least: int | None = None, skip: int = 0) -> str:
    """A trailing aggregate, null below least non-null values."""
    w = over(n, skip)
    call = f"quantile_cont({x}, {f[1:]})" if f[0] == "q" else f"{f}({x})"
    return f"(CASE WHEN count({x}) {w} >= {n if least is None else least} THEN {call} {w} END)"


def nearest(x: str, q: float, n: int) -> str:
    return f"(CASE WHEN count({x}) {over(n)} >= {n} THEN list_sort(list({x}) {over(n)})[{int((n - 1) * q + 0.5) + 1}] END)"


def corr(x: str, y: str, n: int) -> str:
    a, b = (f"(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {z} END)" for z in (x, y))
    return f"({cov(x, y, n)} / ({roll('stddev_samp', a, n)} * {roll('stddev_samp', b, n)} + 1e-12))"


def cov(x: str, y: str, n: int) -> str:
    a, b = (f"(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {z} END)" for z in (x, y))
    w = over(n)
    return f"(CASE WHEN count({a}) {w} >= {n} THEN (sum({a} * {b}) {w} - sum({a}) {w} * sum({b}) {w} / count({a}) {w}) / (count({a}) {w} - 1) END)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY symbol ORDER BY ts)"


def ret(x: str = "close", n: int = 1) -> str:
    return f"(ln({x}) - ln({lag(x, n)}))"


def clip(x: str, low: float, high: float) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {low}), {high}) END)"


def query(steps: list[dict[str, str]], numbers: list[str], keys: tuple[str, ...] = ("symbol", "ts"), base: str = "bars", ctes: str = BARS, where: str = "", plain: tuple[str, ...] = ()) -> str:
    """SELECT keys, plain columns and rounded numbers, after adding the columns of each step in turn."""
    source = base
    for step in steps:
        source = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM {source})"
    out = [*keys, *plain, *(f"round({c}, 6) + 0.0 AS {c}" for c in numbers)]
    return f"WITH {ctes} SELECT {', '.join(out)} FROM {source} {where}"
