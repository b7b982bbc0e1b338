"""Operators that have no SQL, and what they reject."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from countloom import catalog
from countloom.operators import intervals, models, ranks, resampling, selection
from countloom.sources import lines, tables

DATA = "/root/testdata/sf0.001"


def test_scan_carries_values_over_partitions(spark):
    draw = random.Random(3)
    rows = [(draw.randrange(3) if i % 9 else None, i, draw.choice([None, draw.randrange(50)])) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, at int, v int").repartition(5)
    for exclusive in (False, True):
        got = ranks.scan(df, ["at"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "x": ("last", F.col("v"))}, ["g"], 7, exclusive).collect()
        assert len(got) == len(rows)
        for r in got:
            seen = [v for g, at, v in rows if g == r.g and v is not None and (at < r["at"] if exclusive else at <= r["at"])]
            assert (r.s, r.m, r.x) == (sum(seen), max(seen, default=None), seen[-1] if seen else None)


def test_quantiles_equal_numpy(spark):
    x = np.random.default_rng(1).integers(0, 40, 500)
    rows = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(x)] + [(1, None)], "g int, v double")
    got = {(r.g, r.q): r.value for r in ranks.quantiles(rows, "v", [0.0, 0.3, 0.5, 1.0], ["g"]).collect()}
    assert all(got[g, q] == pytest.approx(np.quantile(x[g::3], q)) for g in range(3) for q in (0.0, 0.3, 0.5, 1.0))
    weighted = ranks.weighted_quantiles(spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (None, 5.0)], "v double, w double"), "v", "w", [0.0, 0.375, 0.5, 1.0])
    assert {r.q: r.value for r in weighted.collect()} == pytest.approx({0.0: 1.0, 0.375: 1.5, 0.5: 1.75, 1.0: 2.0})


def test_checks_reject_bad_input(spark):
    spans = lambda *r: spark.createDataFrame(r, "contig string, start long, end long")
    sizes = spark.createDataFrame([("a", 10), ("b", 5)], "contig string, length long")
    good = spans(("a", 0, 4), ("a", 4, 10), ("b", 1, 5))
    assert intervals.checked_intervals(good, sizes) is good
    for bad in (spans(("a", 0, 11)), spans(("a", 3, 3)), spans(("a", -1, 3)), spans(("c", 0, 1)), spans(("a", 0, 5), ("a", 4, 6))):
        with pytest.raises(ValueError):
            intervals.checked_intervals(bad, sizes)
    for bad in (sizes.limit(0), sizes.union(sizes), spark.createDataFrame([("a", 0)], sizes.schema), spark.createDataFrame([(None, 3)], sizes.schema)):
        with pytest.raises(ValueError):
            intervals.checked_lengths(bad)
    total = spark.createDataFrame([(1, 5), (2, 3)], "k int, total long")
    hits = lambda *r: spark.createDataFrame(r, "k int, positive long")
    assert {tuple(r) for r in intervals.population_join(total, hits((1, 2)), ["k"]).collect()} == {(1, 5, 2), (2, 3, 0)}
    for bad in (hits((1, 6)), hits((3, 1)), hits((1, 1), (1, 1))):
        with pytest.raises(ValueError):
            intervals.population_join(total, bad, ["k"])
    with pytest.raises(ValueError, match="without a score"):
        intervals.category_scores(total, spark.createDataFrame([(1, 0.5)], "k int, score double"), ["k"])
    template = spark.createDataFrame([("a", "+", 5, 0, 3), ("a", "-", 5, 3, 6)], "contig string, strand string, start long, template_start long, template_stop long")
    index = lambda *r: spark.createDataFrame([(x,) for x in r], "template_index long")
    assert {tuple(r) for r in intervals.linear_positions(index(0, 2, 4), template, 2).collect()} == {(0, "a", "+", 5), (2, "a", "+", 7), (4, "a", "-", 6)}
    for outside in (6, -1):
        with pytest.raises(ValueError):
            intervals.linear_positions(index(outside), template, 2)


def test_splits_and_rows_that_are_rejected(spark):
    rows = spark.range(12).select("id", (F.col("id") % 4).alias("g"), (F.col("id") % 2).alias("y"))
    tables.checked_split(rows, {"a": rows.where("g < 2"), "b": rows.where("g >= 2")}, "g")
    for parts in ({"a": rows.where("g < 2")}, {"a": rows, "b": rows.where("g = 1")}, {"a": rows.where("id < 6"), "b": rows.where("id >= 6")}):
        with pytest.raises(ValueError, match="not a split"):
            tables.checked_split(rows, parts, "g")
    assert [r.row for r in tables.prepare_rows(rows, "y", 3, ["g", "id"], "g").orderBy("g", "id").collect()] == list(range(1, 13))
    null = F.lit(None).cast("long")
    for bad, why in ((rows.withColumn("y", F.when(F.col("id") > 0, F.col("y"))), "without a target"), (rows.where("y = 0 or id = 1"), "a target value of 1"), (rows.withColumn("g", F.lit(1)), "only 1 groups"), (rows.withColumn("g", F.when(F.col("id") > 0, F.col("g")).otherwise(null)), "without a group")):
        with pytest.raises(ValueError, match=why):
            tables.prepare_rows(bad, "y", 3, ["id"], "g")


def test_index_file_is_checked(spark, tmp_path):
    path = f"{tmp_path}/x.fai"
    (tmp_path / "x.fai").write_text("a\t10\t3\t60\t61\nb\t70\t17\t60\t61\n")
    assert {tuple(r) for r in lines.read_index(spark, path).collect()} == {("a", 10, 3, 60, 61), ("b", 70, 17, 60, 61)}
    (tmp_path / "y.fai").write_text("a\t10\t3\t60\t61\na\t70\t17\t60\t61\n")
    with pytest.raises(ValueError):
        lines.read_index(spark, f"{tmp_path}/y.fai")


def test_large_files_are_digested_in_pieces(spark, tmp_path):
    import hashlib

    (tmp_path / "d").mkdir()
    for name, n in (("a.bin", 10), ("b.bin", 5000)):
        (tmp_path / "d" / name).write_bytes(b"x" * n)
    got = {r.length: r.digest for r in tables.file_digests(spark, f"{tmp_path}/d", 100).collect()}
    assert got == {n: hashlib.sha256(b"x" * n).hexdigest() for n in (10, 5000)}


def test_nearest_by_strand_against_loops(spark):
    draw = random.Random(5)
    ask = [(draw.choice("ab"), draw.randrange(200), draw.choice("+-"), i) for i in range(80)]
    offer = [(draw.choice("abc"), draw.randrange(200), draw.choice("+-")) for _ in range(25)] + [("a", 50, "+")] * 2
    got = intervals.nearest_by_strand(spark.createDataFrame(ask, "contig string, pos long, strand string, i int"), spark.createDataFrame(offer, "contig string, pos long, strand string")).collect()
    assert len(got) == 240
    for r in got:
        near = [p for c, p, s in offer if c == r.contig and (r.mode == "any" or (s == r.strand) == (r.mode == "same"))]
        best = min(near, key=lambda p: (abs(p - r.pos), p), default=None)
        assert r.near == best and (best is None or r.oriented == (best - r.pos) * (1 if r.strand == "+" else -1))


def test_bootstrap_intervals_cover_and_repeat(spark):
    draw = np.random.default_rng(2)
    rows = [(f"g{g}", float(draw.random() < 0.3), g * 150 + i) for g in range(40) for i in range(150)] + [("none", None, -1)]
    df = spark.createDataFrame(rows, "g string, y double, k int")
    got = {r.g: r for r in resampling.group_intervals(df, "g", "y", ["k"], 0.95, 200).collect()}
    again = {r.g: r for r in resampling.group_intervals(df.repartition(3), "g", "y", ["k"], 0.95, 200).collect()}
    assert all(a == pytest.approx(b) if isinstance(a, float) else a == b for k in got for a, b in zip(got[k], again[k], strict=True)) and got["none"].low is None and got["none"].missing == 1
    inside = [r for k, r in got.items() if k != "none"]
    assert all(r.kind == "rate" and r.low <= r.estimate <= r.high for r in inside)
    assert 0.85 <= np.mean([r.low <= 0.3 <= r.high for r in inside]) <= 1.0
    width = np.mean([r.high - r.low for r in inside])
    assert width == pytest.approx(2 * 1.96 * (0.3 * 0.7 / 150) ** 0.5, rel=0.15)
    assert resampling.group_means(df.withColumn("y", F.col("y") * 2), "g", "y").head().kind == "mean"


def test_matched_negatives_repeat_and_stand_in(spark):
    targets = spark.createDataFrame([(i, float(i)) for i in range(40)], "k int, s double")
    negatives = spark.createDataFrame([(100 + i, float(i % 10)) for i in range(12)] + [(200 + i, 35.0 + i / 10) for i in range(3)], "k int, s double")
    got = selection.matched_negatives(targets, negatives, "s", "k", 2, 4, "x").collect()
    per = {b: [(r.k, r.copy) for r in got if r.bin == b] for b in range(4)}
    assert [len(per[b]) for b in range(4)] == [20, 15, 15, 20]  # bins 1 and 2 hold no negative: the nearest stand in, as many as there are
    assert {k for k, _ in per[0]} == set(range(100, 112)) and {k for k, _ in per[3]} == {200, 201, 202}
    assert max(c for _, c in per[3]) == 7


def test_budget_of_ties(spark):
    levels = spark.createDataFrame([(0.9, 2, 1), (0.5, 10, 4), (0.1, 8, 0)], "score double, total long, positive long")
    got = {r.budget: r.recall for r in selection.recall_at_budgets(levels, [0, 1, 2, 7, 12, 99]).collect()}
    assert got == pytest.approx({0: 0.0, 1: 0.1, 2: 0.2, 7: 0.6, 12: 1.0, 99: 1.0})
    at = {r.fraction: r for r in selection.budget_statistics(levels, [0.1, 0.2, 1.0]).collect()}
    assert (at[0.1].threshold, at[0.1].selected, at[0.2].threshold, at[0.2].tp, at[0.2].fp, at[1.0].recall) == (0.9, 2, 0.5, 5, 7, 1.0)


def test_choices(spark):
    rows = [(0.1, 0.97, 0.5, True, 0.05), (1.0, 0.995, 0.6, True, 0.01), (10.0, 1.0, 0.6, True, 0.02), (100.0, 2.0, 0.9, False, 0.1)]
    summary = spark.createDataFrame(rows, "c double, ap double, guard double, ok boolean, se double")
    assert selection.strongest_within(summary, "c", "ap", "guard", "ok", 0.01).head().c == 1.0
    assert selection.within_one_error(summary.where("ok"), "c", "ap", "se").where("chosen").head().c == 1.0
    folds = spark.createDataFrame([(m, f, v) for m, vs in {1: [3, 3, 3], 2: [2, 3, 4], 3: [1, 1, 1], 4: [2, 2, 2.5]}.items() for f, v in enumerate(map(float, vs))], "candidate int, fold int, m double")
    board = {r.candidate: r for r in selection.leaderboard(folds, 1, 2, minimize=True).collect()}
    assert [board[c]["rank"] for c in (3, 4, 1, 2)] == [1, 2, 3, 4] and [board[c].shortlisted for c in (1, 2, 3, 4)] == [False, False, True, True]
    assert (board[2].wins, board[2].ties, board[2].losses, board[3].improvement, board[1].wins) == (1, 1, 1, 2.0, 0)


def test_one_pair_of_replicates(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for name in ("a.rep1.bed", "a.rep2.bed", "b.rep1.bed", "notes.txt"):
        (tmp_path / "x" / name).write_text("x")
    one, two = tables.replicate_pair(spark, f"{tmp_path}/x", r"\.rep[0-9]+\.")
    assert one.endswith("a.rep1.bed") and two.endswith("a.rep2.bed")
    (tmp_path / "x" / "b.rep2.bed").write_text("x")
    with pytest.raises(ValueError):
        tables.replicate_pair(spark, f"{tmp_path}/x", r"\.rep[0-9]+\.")


def test_fit_report_importance_and_stages(spark):
    draw = random.Random(6)
    rows = spark.createDataFrame([(draw.gauss(0, 1), draw.choice("ab"), None) for _ in range(200)], "x double, g string, label double")
    rows = models.with_flags(rows.withColumn("label", (F.col("x") > 0).cast("double")), ["x"])
    head = lambda: models.preprocessor(["x"], ["g"])
    tree = Pipeline(stages=[head(), models.estimator("tree")]).fit(rows)
    weights = {r.feature: r.importance for r in models.native_importance(tree, rows, ["x", "g"]).collect()}
    assert weights["x"] == pytest.approx(1.0) and weights["g"] == pytest.approx(0.0)
    losses = [r.loss for r in models.staged_losses(Pipeline(stages=[head(), models.estimator("boosting")]).fit(rows), rows).orderBy("trees").collect()]
    assert len(losses) == 10 and losses == sorted(losses, reverse=True)
    levels = rows.select(F.floor(F.col("x")).cast("string").alias("a"), "label")
    report = models.fit_report(models.fit_levels(levels, ["a"], "label")[0], models.compacted(levels, ["a"], "label")).head()
    assert report.weight == 200 and report.converged and 0 < report.log_loss < 0.7


def test_lightest_folds_against_a_loop(spark, monkeypatch):
    sizes = {f"g{i}": n for i, n in enumerate([50, 30, 30, 20, 10, 9, 8, 7, 1])}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)] + [(None,)], "g string")
    held, want = [0, 0, 0], {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        want[g] = held.index(min(held))
        held[want[g]] += sizes[g]
    assert {r.g: r.fold for r in models.lightest_folds(df, "g", 3).collect()} == want


def test_merge_and_precision_recall(spark):
    from countloom.operators import metrics

    spans = spark.createDataFrame([("a", 0, 10), ("a", 2, 3), ("a", 9, 12), ("a", 12, 13), ("a", 20, 21), ("b", 0, 1)], "contig string, start long, end long")
    assert {tuple(r) for r in intervals.merged(spans.repartition(4)).collect()} == {("a", 0, 13), ("a", 20, 21), ("b", 0, 1)}
    levels = spark.createDataFrame([(0.9, 2, 1), (0.5, 2, 2)], "score double, total long, positive long")
    assert {r.score: (r.precision, r.recall) for r in metrics.precision_recall(levels).collect()} == {0.9: (0.5, 1 / 3), 0.5: (0.75, 1.0)}


def test_cross_validation_against_its_own_folds(spark):
    """The AUC of a fold is that of a model fitted on the other folds by hand."""
    from countloom.operators import metrics

    draw = random.Random(4)
    rows = spark.createDataFrame([(i, float(draw.gauss(i % 2, 1)), float(i % 2), i % 3) for i in range(300)], "k int, x double, label double, fold int")
    pipe = lambda: Pipeline(stages=[models.preprocessor(["x"], []), models.estimator("logistic")])
    flagged = models.with_flags(rows, ["x"])
    got = models.cross_validated(flagged, "fold", {"logistic": pipe()}).collect()
    assert len(got) >= 3
    fold = {r["fold"]: r for r in got}
    test = models.probability(pipe().fit(flagged.where("fold <> 1")).transform(flagged.where("fold = 1")))
    auc = models.auc_of(test)
    assert any(v == pytest.approx(auc, abs=1e-6) for v in fold[1].asDict().values() if isinstance(v, float))
    levels = metrics.score_levels(rows.withColumn("y", F.col("label").cast("int")), "x", "y")
    assert metrics.auc(levels).head().auc == pytest.approx(auc, abs=0.08)


def test_constant_models_predict_the_mean(spark):
    rows = models.with_flags(spark.createDataFrame([(float(i), float(i % 4 == 0)) for i in range(80)], "x double, label double"), ["x"])
    for name in ("prior", "mean"):
        model = Pipeline(stages=[models.preprocessor(["x"], []), models.estimator(name)]).fit(rows)
        assert [r.score for r in models.probability(model.transform(rows)).collect()] == pytest.approx([0.25] * 80, abs=1e-6)


def test_probe_on_letter_bags_tells_texts_apart(spark):
    rows = spark.createDataFrame([(i, "aaab bba" if i % 2 else "zzyy yz", float(i % 2)) for i in range(60)], "k int, text string, label double")
    probe = Pipeline(stages=[models.letter_bags("text"), models.estimator("logistic").setMaxIter(10)])
    test = models.probability(probe.fit(rows.where("k < 40")).transform(rows.where("k >= 40")))
    assert models.auc_of(test) == 1.0


def check_of(name, rows, t):
    """What must hold of a query without SQL, besides that it has rows."""
    first = rows[0].asDict()
    if name in ("h6_cross_validation", "h6_strength_grid"):
        assert len(rows) == 9 and {r.fold for r in rows} == {0, 1, 2} and all(0 <= r.auc <= 1 and r.log_loss > 0 for r in rows)
    elif name == "h9_final_predictions":
        keys = [r[0] for r in t("lineitem").where("l_orderkey % 2 = 0").select("l_orderkey").distinct().collect()]
        assert sorted(r.l_orderkey for r in rows) == sorted(keys) and all(0 <= r.score <= 1 for r in rows)
    elif name == "h2_level_logistic":
        by = {r.feature: r for r in rows}
        levels = t("lineitem").selectExpr("floor(l_quantity / 10) as q").distinct().count() + t("lineitem").selectExpr("round(l_discount, 2) as d").distinct().count()
        assert "(intercept)" in by and len(by) == levels + 3 and all(r.odds_ratio == pytest.approx(np.exp(r.coefficient)) for r in rows)
    elif name == "h2_fit_report":
        whole = t("lineitem").count()
        assert first["weight"] == whole and first["n_rows"] < whole and first["converged"] and 0 < first["log_loss"] < 1
    elif name == "h7_native_importance":
        assert {r.feature for r in rows} == {"l_quantity", "l_extendedprice", "l_linestatus"} and sum(r.importance for r in rows) == pytest.approx(1)
    elif name == "h8_pipeline_trace":
        assert len({r.n_rows for r in rows}) == 1 and [r.stage for r in rows] == list(range(len(rows))) and rows[-1].n_columns > rows[0].n_columns
    elif name == "h5_estimators":
        assert {r.model for r in rows} == {"logistic", "ridge", "tree", "forest", "boosting"} and all(0.3 < r.auc <= 1 and 0.3 < r.accuracy <= 1 for r in rows)
    elif name == "h13_probe_splits":
        assert {r.split for r in rows} == {"random", "source"} and all(0 <= r.auc <= 1 for r in rows)
    elif name == "e17_group_intervals":
        assert all(r.low < r.estimate < r.high for r in rows) and sum(r.n for r in rows) == t("orders").count()
    elif name == "g2_lightest_folds":
        held = Counter()
        for r in rows:
            held[r.fold] += r.n
        assert sum(held.values()) == t("lineitem").count() and max(held.values()) - min(held.values()) <= max(r.n for r in rows)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_queries_without_sql(spark, name):
    from pathlib import Path

    if not Path(DATA).is_dir():
        pytest.skip("no test tables here")
    rows = catalog.QUERIES[name](spark, DATA).collect()
    assert rows
    check_of(name, rows, lambda table: spark.read.parquet(f"{DATA}/{table}.parquet"))
