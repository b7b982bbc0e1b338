"""Outlier reports, folds, bootstraps, strength search, native categories, background draws: against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from countloom.operators import anomalies, intervals, models, ranks, resampling


def test_outliers_of_the_fixture(spark):
    """A constant column turns both rules off; one test value lies outside the reference's range."""
    train = spark.createDataFrame([(i, v, 1.0) for i, v in enumerate([0.0, 1.0, 2.0, 3.0, 4.0, 100.0])], "k int, value double, stable double")
    test = spark.createDataFrame([(0, 2.0, 1.0), (1, 200.0, 2.0), (2, None, float("nan"))], "k int, value double, stable double")
    limits = anomalies.bounds(train, ["value", "stable"])
    by = {r.feature: r for r in limits.collect()}
    assert (by["value"].q1, by["value"].median, by["value"].q3, by["value"].mad) == (1.25, 2.5, 3.75, 1.5)
    assert by["stable"].lower is None and by["stable"].mad is None
    got = {(r.k, r.feature): r for r in anomalies.scored(test, ["k"], ["value", "stable"], limits).collect()}
    far = got[1, "value"]
    assert far.iqr_outlier and far.mad_outlier and far.outside and far.iqr_distance == (200 - 7.5) / 2.5
    assert far.severity == pytest.approx(max(77.0, anomalies.NORMAL_QUARTILE * 197.5 / 1.5 / 3.5))
    assert got[1, "stable"].outside and not got[1, "stable"].iqr_outlier and got[1, "stable"].severity == 0
    assert not any(got[2, c].iqr_outlier or got[2, c].outside for c in ("value", "stable"))
    rolled = anomalies.row_rollup(anomalies.scored(test, ["k"], ["value", "stable"], limits), ["k"]).collect()
    assert [(r.k, r.n_features, r.features) for r in rolled] == [(1, 1, "value")]


def test_lightest_folds_against_a_loop(spark):
    """Many groups of few sizes, as well as sizes that differ."""
    draw = random.Random(3)
    for sizes, k in (([draw.choice([1, 2, 7, 50]) for _ in range(300)], 4), ([draw.randint(1, 99) for _ in range(80)], 3), ([5] * 7 + [1] * 40, 5), ([3], 4)):
        df = spark.createDataFrame([(f"g{i:04d}",) for i, n in enumerate(sizes) for _ in range(n)], "g string")
        held, want = [0] * k, {}
        for i, n in sorted(enumerate(sizes), key=lambda x: (-x[1], f"g{x[0]:04d}")):
            want[f"g{i:04d}"] = held.index(min(held))
            held[want[f"g{i:04d}"]] += n
        assert {r.g: r.fold for r in models.lightest_folds(df, "g", k).collect()} == want


def test_bootstrap_of_real_values(spark):
    rng = np.random.default_rng(5)
    rows = [(f"g{g}", float(v), g * 1000 + i) for g in range(30) for i, v in enumerate(rng.lognormal(8, 0.4, 200))]
    df = spark.createDataFrame(rows, "g string, y double, k int")
    true = math.exp(8 + 0.4**2 / 2)
    got = resampling.group_intervals(df, "g", "y", ["k"]).collect()
    assert 0.8 <= np.mean([r.low <= true <= r.high for r in got]) <= 1.0 and all(r.low < r.estimate < r.high and r.kind == "mean" for r in got)
    width = np.mean([(r.high - r.low) / r.estimate for r in got])
    assert width == pytest.approx(2 * 1.96 * math.sqrt(math.exp(0.16) - 1) / 200**0.5, rel=0.15)
    weights = resampling.poisson_weights(np.arange(20_000), 50, 1)
    assert weights.mean() == pytest.approx(1, abs=0.01) and weights.var() == pytest.approx(1, abs=0.02) and abs(np.corrcoef(weights[:, 0], weights[:, 1])[0, 1]) < 0.03


def test_strength_search_against_a_plain_one(spark):
    rng = np.random.default_rng(2)
    rows = [(int(n), int(rng.binomial(n, rng.beta(12 * 0.3, 12 * 0.7)))) for n in rng.integers(5, 200, 400)] + [(0, 0)]
    p = sum(k for _, k in rows) / sum(n for n, _ in rows)

    def likelihood(x):
        a, b = math.exp(x) * p, math.exp(x) * (1 - p)
        beta = lambda u, v: math.lgamma(u) + math.lgamma(v) - math.lgamma(u + v)
        return sum(beta(k + a, n - k + b) - beta(a, b) for n, k in rows)

    low, high = math.log(1e-3), math.log(1e6)
    while high - low > 1e-7:  # golden section
        x, y = high - (high - low) * 0.6180339887, low + (high - low) * 0.6180339887
        low, high = (x, high) if likelihood(x) < likelihood(y) else (low, y)
    s, best = models.best_strength(spark.createDataFrame(rows, "total long, positive long"), tolerance=1e-5)
    assert math.log(s) == pytest.approx(low, abs=1e-4) and best == pytest.approx(likelihood(low), rel=1e-9) and 6 < s < 24


def test_trees_split_native_levels_by_sets(spark):
    """Odd and even levels of twenty: one split of level sets tells them apart, one split of one-hot slots can't."""
    rows = spark.createDataFrame([(f"v{i % 20:02d}", 0.0, float(i % 2)) for i in range(400)] + [("rare", 0.0, 0.0), (None, 0.0, 1.0)], "c string, x double, label double")
    fit = lambda head: models.auc_of(models.probability(Pipeline(stages=[head, models.estimator("tree").setMaxDepth(1).setMaxBins(64)]).fit(rows).transform(rows)))
    assert fit(models.native_categories(["c"], ["x"], 2)) > 0.99
    assert fit(models.preprocessor([], ["c"])) < 0.7
    head = models.native_categories(["c"], [], 2).fit(rows)
    new = spark.createDataFrame([("unseen", 0.0), ("rare", 0.0), (None, 0.0), ("v00", 0.0)], "c string, x double")
    assert [r.c_level for r in head.transform(new).collect()] == [20.0, 20.0, 20.0, 0.0]


def test_constant_imputation(spark):
    rows = models.with_flags(spark.createDataFrame([(1.0, 1.0), (None, 0.0), (float("nan"), 1.0)], "x double, label double"), ["x"])
    out = models.preprocessor(["x"], [], impute="-9", scale=None).fit(rows).transform(rows).collect()
    assert [r.x_filled for r in out] == [1.0, -9.0, -9.0]


def test_stage_gaps_and_feature_profile(spark):
    rows = models.with_flags(spark.createDataFrame([(1.0, "a", 1.0), (None, "b", 0.0), (5.0, None, 1.0)], "x double, c string, label double"), ["x"])
    head = models.preprocessor(["x"], ["c"], scale=None)
    gaps = {(r.name, r.column): r.nulls for r in models.stage_gaps(head.fit(rows), rows).collect()}
    assert gaps["input", "x"] == 1 and gaps["input", "c"] == 1 and all(n == 0 for (name, _), n in gaps.items() if name != "input")
    profile = models.feature_profile(Pipeline(stages=[*head.getStages(), models.estimator("logistic").setMaxIter(1)]).fit(rows), rows).collect()
    assert [r.n for r in profile] == [3] * len(profile) and profile[0].mean == pytest.approx(1 / 3) and profile[1].non_zero == 3


def test_background_is_a_permutation(spark):
    got = sorted(r.p for r in spark.range(4**4).select(intervals.permuted(F.col("id"), 4, 7).alias("p")).collect())
    assert got == list(range(4**4))
    wide = spark.createDataFrame([("a", 0, 3_000_000_000), ("b", 10, 3_000_000_010)], "contig string, start long, end long")
    rows = intervals.background(wide, 2000, 3).collect()  # six thousand million bases, none of them a row
    assert len({(r.contig, r.pos) for r in rows}) == 2000 and [r.draw for r in sorted(rows)] == list(range(2000))
    shares = np.histogram([(r.pos - (10 if r.contig == "b" else 0)) / 3e9 for r in rows], 10, (0, 1))[0]
    assert ((shares - 200) ** 2 / 200).sum() < 27.9 and 850 < sum(r.contig == "a" for r in rows) < 1150  # chi-square with nine degrees at 0.1 %


def test_quantiles_of_many_groups(spark, monkeypatch):
    rows = [(i % 7 if i % 7 else None, float(i * i % 101)) for i in range(300)] + [(99, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    monkeypatch.setattr(ranks, "MOST_SENT", 2)
    got = {(r.g, r.q): r.value for r in ranks.quantiles(df, "v", [0.0, 0.1, 0.5, 1.0], ["g"]).collect()}
    for g in {r[0] for r in rows} - {99}:
        values = [v for k, v in rows if k == g]
        assert all(got[g, q] == pytest.approx(np.quantile(values, q)) for q in (0.0, 0.1, 0.5, 1.0))
    assert (99, 0.5) not in got and [r.value for r in ranks.quantiles(df, "v", [0.5]).collect()] == [np.median([v for _, v in rows if v is not None])]


def test_weighted_draws_follow_the_shares(spark):
    shares = [0.5, 0.0, 0.2, 0.299, 0.001]
    rows = spark.createDataFrame([(i, p, sum(shares[: i + 1])) for i, p in enumerate(shares)], "i int, p double, hi double")
    draws = spark.createDataFrame([(k, (k + 0.5) / 1000) for k in range(1000)], "draw int, u double")
    got = intervals.weighted_draws(rows, draws, "p", "hi", 16).groupBy("i").count().collect()
    assert {r.i: r["count"] for r in got} == {0: 500, 2: 200, 3: 299, 4: 1}


def test_queries_without_sql(spark):
    from countloom import catalog

    small = "/root/testdata/sf0.001"
    run = lambda name: catalog.QUERIES[name](spark, small).collect()
    rows = run("h7_staged_losses")
    assert [r.trees for r in rows] == list(range(1, 11)) and all(0 < r.loss < 3 for r in rows)
    rows = run("h7_permutation_importance")
    assert len(rows) == 8 and max(rows, key=lambda r: r["drop"]).feature in ("part", "month", "l_quantity", "l_linestatus")
    (row,) = run("h4_native_categories")
    assert 0.4 < row.auc <= 1 and 0 <= row.accuracy <= 1
    (row,) = run("h1_strength_search")
    assert 1e-3 < row.strength < 1e9
