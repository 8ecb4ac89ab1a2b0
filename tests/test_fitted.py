"""Fitted and resampled operators, which SQL can't say, against recomputation by loops or on planted data."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalogue, evaluation, models
from tidemark.plans import catalog

START = dt.datetime(2024, 1, 1)


def hours(n, step=6):
    return [START + dt.timedelta(hours=step * i) for i in range(n)]


def test_common_factors_equal_numpy(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(0, 1, 130)
    t = pd.DataFrame({n: base * (0.5 + 0.3 * i) + rng.normal(0, 0.3, 130) for i, n in enumerate("abc")})
    t.insert(0, "ts", hours(130))
    got = models.common_factors(spark.createDataFrame(t, "ts timestamp_ntz, a double, b double, c double"), list("abc"), 60, 20).toPandas().sort_values("ts").reset_index(drop=True)
    assert len(got) == 4  # rows 60, 80, 100, 120
    for k, end in enumerate((60, 80, 100, 120)):
        values, vectors = np.linalg.eigh(np.cov(t[list("abc")].iloc[end - 60 : end].to_numpy().T))
        v = vectors[:, -1] * np.sign(vectors[np.abs(vectors[:, -1]).argmax(), -1])
        assert got.ts[k] == t.ts[end - 1] and got.share_1[k] == pytest.approx(values[-1] / values.sum()) and np.allclose(got.loadings[k], v)


@pytest.mark.parametrize("kind", ["block", "stationary", "trade"])
def test_bootstraps_equal_loops(spark, kind):
    n, reps, block, seed = 23, 6, 5, 3
    values = np.random.default_rng(1).normal(0, 1, n)
    rows = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "symbol string, i long, r double")
    at = spark.range(n).select(F.lit("s").alias("symbol"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"), F.col("id").alias("at"))
    hashed = at.select("rep", "at", F.xxhash64("symbol", "rep", "at", F.lit(seed)).alias("h"), F.xxhash64("symbol", "rep", "at", F.lit(seed + 1)).alias("g")).collect()
    draw, fresh = {(r.rep, r.at): r.h % n for r in hashed}, {(r.rep, r.at): r.g % block == 0 for r in hashed}
    means = []
    for rep in range(reps):
        picked = []
        for k in range(n):
            if kind == "trade":
                picked.append(draw[rep, k])
            elif kind == "block":
                picked.append((draw[rep, k // block] + k % block) % n)
            else:
                picked.append(draw[rep, k] if k == 0 or fresh[rep, k] else (picked[-1] + 1) % n)
        means.append(values[picked].mean())
    got = evaluation.bootstrap(rows, "symbol", "i", "r", kind, reps, block, seed).first()
    assert [got.low, got.mid, got.high] == pytest.approx(np.quantile(means, [0.05, 0.5, 0.95]).tolist())


def test_mixture_sees_the_past_only_and_tells_regimes_apart(spark):
    rng = np.random.default_rng(2)
    calm = np.arange(300) // 50 % 2 == 0
    t = pd.DataFrame({"symbol": "s", "ts": hours(300), "r": np.where(calm, rng.normal(0, 0.1, 300), rng.normal(5, 0.1, 300)), "v": np.where(calm, 1.0, 3.0) + rng.normal(0, 0.05, 300)})
    until = F.col("ts") < F.lit(t.ts[200]).cast("timestamp_ntz")
    schema = "symbol string, ts timestamp_ntz, r double, v double"
    one = models.mixture_regime(spark.createDataFrame(t, schema), ["r", "v"], until, 2).toPandas().sort_values("ts").reset_index(drop=True)
    other = t.assign(r=t.r.where(t.index < 250, 99.0))
    two = models.mixture_regime(spark.createDataFrame(other, schema), ["r", "v"], until, 2).toPandas().sort_values("ts").reset_index(drop=True)
    probs = ["regime_0_prob", "regime_1_prob"]
    assert np.isnan(one[probs].iloc[0]).all() and np.allclose(one[probs].iloc[1:].sum(axis=1), 1)
    assert np.allclose(one[probs].iloc[1:251], two[probs].iloc[1:251])  # a row has the state of the one before
    side = one.regime_0_prob.iloc[1:].round().to_numpy() == 1
    assert (side == calm[:-1]).all() or (side != calm[:-1]).all()


def test_gate_learns_from_earlier_blocks_only(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, 400)
    t = pd.DataFrame({"symbol": "s", "ts": hours(400), "x": x, "up": (x + rng.normal(0, 0.3, 400) > 0).astype(float), "block": np.arange(400) // 100})
    schema = "symbol string, ts timestamp_ntz, x double, up double, block int"
    one = models.expanding_gate(spark.createDataFrame(t, schema), ["x"], "up").toPandas().sort_values("ts").reset_index(drop=True)
    two = models.expanding_gate(spark.createDataFrame(t.assign(up=t.up.where(t.block < 2, 1 - t.up)), schema), ["x"], "up").toPandas().sort_values("ts").reset_index(drop=True)
    assert len(one) == 300 and np.allclose(one.gate[:200], two.gate[:200]) and not np.allclose(one.gate[200:], two.gate[200:])
    assert ((one.gate > 0.5) == (one.up > 0.5)).mean() > 0.85 and np.corrcoef(one.x, one.gate)[0, 1] > 0.8


def test_separability_of_equal_and_of_moved_samples(spark):
    rng = np.random.default_rng(5)
    same, moved = rng.normal(0, 1, (1000, 2)), np.vstack([rng.normal(0, 1, (500, 2)), rng.normal(3, 1, (500, 2))])
    auc = [models.separability(spark.createDataFrame(pd.DataFrame({"a": m[:, 0], "b": m[:, 1], "i": range(1000)})), ["a", "b"], F.col("i") >= 500).first().auc for m in (same, moved)]
    assert 0.4 < auc[0] < 0.6 and auc[1] > 0.97


def test_topics_part_two_vocabularies(spark):
    rng = np.random.default_rng(6)
    words = [["rate", "bank", "hike", "cut"], ["crop", "wheat", "corn", "rain"]]
    texts = spark.createDataFrame([(i, " ".join(rng.choice(words[i % 2], 12))) for i in range(60)], "doc_id long, text string")
    got = models.topics(texts, 2, 50).toPandas().sort_values("doc_id")
    assert np.allclose(got[["topic_0", "topic_1"]].sum(axis=1), 1)
    side = (got.topic_0 > 0.5).to_numpy()
    assert (side[::2] == side[0]).mean() > 0.9 and (side[1::2] != side[0]).mean() > 0.9


def test_catalogue_makes_every_feature_after_what_it_needs(spark, sf_dir):
    names = list(catalogue.FEATURES)
    assert len(names) >= 88 and len(set(names)) == len(names)
    order = catalogue.ordered(names)
    assert len(order) == len(set(order)) == len(catalogue.MAKERS)
    for f in catalogue.FEATURES.values():
        for n in f.needs:
            assert n in catalogue.BARS or order.index(catalogue.FEATURES[n].source) < order.index(f.source)
    assert catalogue.chosen(["momentum"], mask={"cci": False}) == [n for n in names if catalogue.FEATURES[n].group == "momentum" and n != "cci"]
    assert catalogue.chosen(names=["cci"]) == ["cci"] and "cci" not in catalogue.chosen(without=["momentum"])
    assert all(g not in {catalogue.FEATURES[n].group for n in left} for g, left in catalogue.ablations(names).items())
    with pytest.raises(KeyError):
        catalogue.chosen(names=["nothing"])
    from tidemark.operators.bars import time_bars
    from tidemark.sources.tables import ticks

    one = time_bars(ticks(spark, sf_dir))
    for group in ("flow", "candles", "bands", "regime"):
        chosen = catalogue.chosen([group])
        assert catalogue.materialise(one, chosen).columns == ["symbol", "ts", *chosen]
    assert catalogue.as_table(spark).count() == len(names)


def test_look_ahead_is_seen_in_part_of_a_series(spark):
    rng = np.random.default_rng(8)
    nxt = rng.normal(0, 1, 900)
    late = np.where(np.arange(900) >= 600, nxt, rng.normal(0, 1, 900))  # leaks in its last third only
    rows = [(f, i, float(x), float(r)) for f, xs in (("late", late), ("honest", rng.normal(0, 1, 900)), ("flat", np.zeros(900))) for i, (x, r) in enumerate(zip(xs, nxt))]
    got = {r.feature: r for r in evaluation.lookahead_scan(spark.createDataFrame(rows, "feature string, i long, x double, nxt double"), ["feature"], 200, 50).collect()}
    assert got["late"].suspicious and got["late"].leaking_windows >= 2 and got["late"].corr < got["late"].threshold and got["late"].z > 5
    assert not got["honest"].suspicious and not got["flat"].suspicious and got["flat"].corr is None


def test_every_query_without_sql_is_checked_here_or_by_hand():
    without = set(catalog.queries()) - set(catalog.oracle_sql())
    assert without == {"W67_mixture", "W69_factors", "W74_gate", "T11_separability", "T22_block_bootstrap", "T22_stationary_bootstrap", "T22_trade_bootstrap", "F12_topics", "G18_fingerprint", "ST7_adwin_vote"}
