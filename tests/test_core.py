import pytest
from pyspark.sql import functions as F

from countloom.functions import scalars as sc
from countloom.operators import counts, intervals, metrics, ranks


def test_cumulative_equals_one_window(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 1009).alias("k"), (F.col("id") % 5).alias("v"))
    got = ranks.cumulative(rows, [F.asc("k")], {"s": F.col("v")}).orderBy("k").collect()
    total = 0
    for r in got:
        total += r.v
        assert r.s == total


def test_average_precision_of_repeated_rows(spark):
    rows = spark.createDataFrame([(0.8, 1)] * 2 + [(0.7, 0)] * 20 + [(0.4, 1)] * 3 + [(0.1, 0)] * 40, "score double, y int")
    assert metrics.average_precision(metrics.score_levels(rows, "score", "y")).head().ap == pytest.approx(2 / 5 * 1 + 3 / 5 * 5 / 25)
    constant = rows.withColumn("score", F.lit(1.0))
    assert metrics.average_precision(metrics.score_levels(constant, "score", "y")).head().ap == pytest.approx(5 / 65)


def test_interval_fixture(spark):
    iv = spark.createDataFrame([("a", 2, 4), ("a", 7, 8), ("b", 1, 3)], "contig string, start long, end long")
    got = intervals.template(iv, ["contig", "start"]).orderBy("template_start").select("strand", "contig", "template_start", "template_stop").collect()
    assert [tuple(r) for r in got] == [("+", "a", 0, 2), ("+", "a", 2, 3), ("+", "b", 3, 5), ("-", "a", 5, 7), ("-", "a", 7, 8), ("-", "b", 8, 10)]
    points = spark.createDataFrame([("a", 3), ("a", 5), ("b", 2)], "contig string, pos long")
    assert intervals.contained(points, iv, 4).count() == 2
    assert intervals.contained(points, iv, 4, "left_anti").collect() == [("a", 5)]
    plan = intervals.contained(points, iv, 4)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_checked_join_rejects_repeated_keys(spark):
    one = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError):
        intervals.checked_join(one, one, ["k"])


def test_kmer_codes(spark):
    rows = spark.createDataFrame([("x", "ACGTN"), ("x", "A"), ("y", None), ("y", "ACé\U0001f600AC")], "g string, s string")
    got = {(r.g, r.code): r.n for r in counts.kmer_counts(rows, "s", 2, ["g"]).collect()}
    assert got == {("x", 1): 1, ("x", 6): 1, ("x", 11): 1, ("x", 16): 1, ("y", 1): 2, ("y", 16): 3}
    words = {(r.g, r.word): r.n for r in counts.word_counts(rows, "s", 3, ["g"]).collect()}
    assert words == {("x", "ACG"): 1, ("x", "CGT"): 1, ("x", "GTN"): 1, ("y", "ACé"): 1, ("y", "Cé\U0001f600"): 1, ("y", "é\U0001f600A"): 1, ("y", "\U0001f600AC"): 1}
    assert spark.range(1).select(sc.kmer_label(F.lit(6), 2), sc.reverse_complement(F.lit("AACG"))).head()[:] == ("CG", "CGTT")
