"""Outliers by quartile and median rules that are fitted on one table and applied to others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import quantiles

#: Fixed value: the normal quartile, which makes the median deviation comparable to a standard deviation.
NORMAL_QUARTILE = 0.6744897501960817


def long_form(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, feature, value: a row for each column; NaN counts as missing."""
    each = F.array(*(F.struct(F.lit(c).alias("feature"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("value")) for c in columns))
    return df.select(*keys, F.explode(each).alias("_f")).select(*keys, "_f.feature", "_f.value")


def bounds(reference: DataFrame, columns: list[str], multiplier: float = 1.5) -> DataFrame:
    """A row a feature: least, q1, median, q3, most, mad, lower, upper over the finite values of the reference. A rule is off (null bounds, null mad) where its spread is 0."""
    rows = long_form(reference, [], columns)
    finite = rows.where(F.col("value").isNotNull() & (F.abs("value") < float("inf")))
    found = quantiles(finite, "value", [0.0, 0.25, 0.5, 0.75, 1.0], ["feature"])
    at = lambda q, name: F.max(F.when(F.col("q") == q, F.col("value"))).alias(name)
    wide = found.groupBy("feature").agg(at(0.0, "least"), at(0.25, "q1"), at(0.5, "median"), at(0.75, "q3"), at(1.0, "most"))
    away = finite.join(F.broadcast(wide.select("feature", "median")), "feature").select("feature", F.abs(F.col("value") - F.col("median")).alias("value"))  # a row a feature
    mad = quantiles(away, "value", [0.5], ["feature"]).select("feature", F.when(F.col("value") > 0, F.col("value")).alias("mad"))
    far = F.when(F.col("q3") > F.col("q1"), (F.col("q3") - F.col("q1")) * multiplier)
    names = reference.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return names.join(wide, "feature", "left").join(mad, "feature", "left").withColumns({"lower": F.col("q1") - far, "upper": F.col("q3") + far})


def scored(df: DataFrame, keys: list[str], columns: list[str], limits: DataFrame, threshold: float = 3.5) -> DataFrame:
    """keys, feature, value with iqr_outlier, mad_outlier, iqr_distance (beyond the bound, in quartile ranges), robust_z, outside (of the reference's range) and severity: the larger of
    the distance and of |z| over its threshold, 0 for values that no rule flags. Missing values are not flagged."""
    rows = long_form(df, keys, columns).join(F.broadcast(limits), "feature")  # a row a feature
    v, spread = F.col("value"), F.col("q3") - F.col("q1")
    over = F.when(v < F.col("lower"), (F.col("lower") - v) / spread).when(v > F.col("upper"), (v - F.col("upper")) / spread).when(v.isNotNull() & F.col("lower").isNotNull(), 0.0)
    rows = rows.withColumns({"iqr_distance": over, "robust_z": F.lit(NORMAL_QUARTILE) * (v - F.col("median")) / F.col("mad")})
    rows = rows.withColumns({
        "iqr_outlier": F.coalesce((v < F.col("lower")) | (v > F.col("upper")), F.lit(False)), "mad_outlier": F.coalesce(F.abs("robust_z") > threshold, F.lit(False)),
        "outside": F.coalesce((v < F.col("least")) | (v > F.col("most")), F.lit(False)),
    })
    size = F.greatest(F.col("iqr_distance"), F.abs("robust_z") / threshold)
    return rows.select(*keys, "feature", "value", "iqr_outlier", "mad_outlier", "iqr_distance", "robust_z", "outside", F.when(F.col("iqr_outlier") | F.col("mad_outlier"), size).otherwise(0.0).alias("severity"))


def flagged(scores: DataFrame) -> DataFrame:
    """The rows of scored() that a rule flags."""
    return scores.where("iqr_outlier or mad_outlier").drop("outside")


def summary(scores: DataFrame, dataset: str) -> DataFrame:
    """dataset, feature, non_missing, iqr_outliers, mad_outliers, any_outliers, outlier_share, outside_reference_range."""
    either = F.count_if(F.col("iqr_outlier") | F.col("mad_outlier"))
    return scores.groupBy(dataset, "feature").agg(
        F.count("value").alias("non_missing"), F.count_if("iqr_outlier").alias("iqr_outliers"), F.count_if("mad_outlier").alias("mad_outliers"), either.alias("any_outliers"),
        F.coalesce(F.try_divide(either, F.count("value")), F.lit(0.0)).alias("outlier_share"), F.count_if("outside").alias("outside_reference_range"),
    )


def row_rollup(scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_features, features (flagged ones by name, joined by commas), worst (the largest severity): a row for each row with a flagged value."""
    names = F.array_join(F.array_sort(F.collect_list("feature")), ",")  # at most a name a column
    return flagged(scores).groupBy(*keys).agg(F.count("*").alias("n_features"), names.alias("features"), F.max("severity").alias("worst"))
