"""Exact ranking metrics on grouped counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import cumulative, row_numbers, value_ranks


def score_levels(df: DataFrame, score: str, y: str, by: list[str] | None = None) -> DataFrame:
    """One row a score (and group): score, total, positive. All metrics below start from it."""
    return df.groupBy(*(by or []), F.col(score).alias("score")).agg(F.count("*").cast("long").alias("total"), F.sum(y).cast("long").alias("positive"))


def average_precision(levels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AP with ties as one threshold: sum over levels of share of positives times precision so far; 0 without positives."""
    by = by or []
    c = cumulative(levels, [F.desc("score")], {"ct": F.col("total"), "cp": F.col("positive")}, by)
    return c.groupBy(*by).agg(F.coalesce(F.sum(F.col("positive") * F.col("cp") / F.col("ct")) / F.nullif(F.sum("positive"), F.lit(0)), F.lit(0.0)).alias("ap"), F.sum("total").alias("total"), F.sum("positive").alias("positive"))


def precision_recall(levels: DataFrame) -> DataFrame:
    """The curve: score, precision, recall."""
    c = cumulative(levels, [F.desc("score")], {"ct": F.col("total"), "cp": F.col("positive")})
    p = levels.agg(F.sum("positive").alias("p"))
    return c.crossJoin(F.broadcast(p)).select("score", (F.col("cp") / F.col("ct")).alias("precision"), F.try_divide("cp", "p").alias("recall"))


def average_precision_by_rows(df: DataFrame, score: str, y: str, key: str) -> DataFrame:
    """AP with row order instead of ties: rows by falling score, then key; null without positives."""
    rows = row_numbers(df.select(F.col(score).alias("score"), F.col(y).cast("long").alias("y"), F.col(key).alias("key")), [F.desc("score"), F.asc("key")], "r")
    hits = row_numbers(rows.where("y = 1"), [F.asc("r")], "h")
    return hits.agg(F.avg(F.col("h") / F.col("r")).alias("ap"))


def rank_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation of dense ranks; 0 when one is constant or there are no rows."""
    ra, rb = (value_ranks(df, c).select(c, F.col("dense").alias(f"rank_{c}")) for c in (a, b))
    return df.join(ra, a).join(rb, b).agg(F.coalesce(F.nullif(F.corr(F.col(f"rank_{a}").cast("double"), F.col(f"rank_{b}").cast("double")), F.lit(float("nan"))), F.lit(0.0)).alias("corr"))


def auc(levels: DataFrame) -> DataFrame:
    """Mann-Whitney AUC with half credit for ties; weights work as counts."""
    c = cumulative(levels.withColumn("negative", F.col("total") - F.col("positive")), [F.asc("score")], {"cn": F.col("negative")})
    return c.agg((F.sum(F.col("positive") * (F.col("cn") - F.col("negative") / 2)) / F.nullif(F.sum("positive") * F.sum("negative"), F.lit(0))).alias("auc"))
