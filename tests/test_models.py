import math
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from countloom.functions.scalars import log_gamma
from countloom.operators import intervals, models


def test_log_gamma(spark):
    xs = [1e-6, 0.1, 0.5, 1.0, 2.5, 10.0, 1e3, 1e7]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(log_gamma(F.col("x")).alias("g")).collect()
    assert [r.g for r in got] == pytest.approx([math.lgamma(x) for x in xs], abs=1e-9, rel=1e-12)


def test_logistic_meets_the_gradient(spark):
    draw = random.Random(1)
    data = [(a, float(draw.random() < (0.7 if a == "x" else 0.2))) for a in draw.choices("xyz", k=600)]
    _, coefficients = models.fit_levels(spark.createDataFrame(data, "a string, label double"), ["a"], "label", c=1.0)
    b = {r.feature: r.coefficient for r in coefficients.collect()}
    for level in "xyz":  # at the optimum the penalty's slope equals the sum of residuals
        w = b[f"a={level}"]
        residual = sum(y - 1 / (1 + math.exp(-b["(intercept)"] - w)) for a, y in data if a == level)
        assert w == pytest.approx(residual, abs=1e-3)


def rows(spark):
    data = [(i, float(i % 10) if i % 7 else None, "a" if i % 3 else None, float(i % 10 > 4)) for i in range(300)]
    return models.with_flags(spark.createDataFrame(data, "id long, x double, c string, label double"), ["x"])


def test_preprocessing_trace_importance_and_alignment(spark):
    df = rows(spark)
    model = Pipeline(stages=[models.preprocessor(["x"], ["c"]), models.estimator("logistic")]).fit(df)
    assert models.auc_of(models.probability(model.transform(df))) > 0.9
    drops = {r.feature: r.drop for r in models.permutation_importance(model, df, ["x", "c"], "id", 1).collect()}
    assert drops["x"] > 0.2 and abs(drops["c"]) < 0.1
    assert models.pipeline_trace(model.stages[0], df).where("n_rows <> 300").isEmpty()
    got = models.aligned_predictions(model, df, df.select("id"), "id")
    assert got.count() == 300
    with pytest.raises(ValueError):
        models.aligned_predictions(model, df.where("id < 5"), df.select("id"), "id")
    unseen = df.withColumn("c", F.lit("new")).limit(3)
    assert model.transform(unseen).count() == 3


def test_shuffled_column_keeps_its_values(spark):
    df = rows(spark)
    again = models.shuffled_column(df, "x", "id", 3)
    assert sorted(r.x or -1 for r in again.select("x").collect()) == sorted(r.x or -1 for r in df.select("x").collect())
    assert again.join(df, "id").where(~again.x.eqNullSafe(df.x)).count() > 100


def test_frequency_limit(spark):
    df = spark.createDataFrame([(x,) for x in "aaabbc"] + [(None,)], "c string")
    assert sorted(str(r.c) for r in models.frequent(df, "c", 2).collect()) == ["(rare)", "None", "a", "a", "a", "b", "b"]


def test_background_positions(spark):
    iv = spark.createDataFrame([("a", 2, 40), ("b", 1, 30)], "contig string, start long, end long")
    got = {tuple(r) for r in intervals.background(iv, 20, 7).select("contig", "pos").collect()}
    assert len(got) == 20 and got == {tuple(r) for r in intervals.background(iv, 20, 7).select("contig", "pos").collect()}
    assert all(2 <= p < 40 if c == "a" else 1 <= p < 30 for c, p in got)
    assert intervals.background(iv, 1000, 7).count() == 67
