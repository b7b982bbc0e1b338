"""Outlier reports, strength search, native categories and model diagnostics."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import anomalies, models
from ..operators.pins import pinned
from .registry import query

FEATURES = ["l_extendedprice", "l_quantity", "l_tax", "constant"]
MULTIPLIER, THRESHOLD = 0.3, 1.2
SCORES = f"""with v as (select l_returnflag as dataset, l_linestatus, l_orderkey, l_linenumber, f.feature, case f.feature {" ".join(f"when '{c}' then {c}" for c in FEATURES)} end as value
  from (select *, 1.0::double as constant from lineitem), (select unnest({FEATURES}) as feature) f),
b as (select feature, min(value) as least, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as med, quantile_cont(value, 0.75) as q3, max(value) as most from v where l_linestatus = 'F' group by 1),
m as (select feature, nullif(quantile_cont(abs(value - med), 0.5), 0) as mad from v join b using (feature) where l_linestatus = 'F' group by 1),
l as (select *, case when q3 > q1 then q1 - {MULTIPLIER} * (q3 - q1) end as lo, case when q3 > q1 then q3 + {MULTIPLIER} * (q3 - q1) end as hi from b join m using (feature)),
z as (select *, coalesce(value < lo or value > hi, false) as iqr_outlier, {anomalies.NORMAL_QUARTILE} * (value - med) / mad as robust_z,
  case when value < lo then (lo - value) / (q3 - q1) when value > hi then (value - hi) / (q3 - q1) when lo is not null then 0.0 end as iqr_distance from v join l using (feature)),
s as (select *, coalesce(abs(robust_z) > {THRESHOLD}, false) as mad_outlier from z),
r as (select *, case when iqr_outlier or mad_outlier then greatest(iqr_distance, abs(robust_z) / {THRESHOLD}) else 0.0 end as severity from s)
"""


def scores(t):
    rows = t("lineitem").withColumn("constant", F.lit(1.0)).withColumnRenamed("l_returnflag", "dataset")
    limits = pinned(anomalies.bounds(rows.where("l_linestatus = 'F'"), FEATURES, MULTIPLIER))
    return anomalies.scored(rows, ["dataset", "l_orderkey", "l_linenumber"], FEATURES, limits, THRESHOLD)


@query(SCORES + "select dataset, l_orderkey, l_linenumber, feature, value, iqr_outlier, mad_outlier, round(iqr_distance, 8) as iqr_distance, round(robust_z, 8) as robust_z, round(severity, 8) as severity from r where iqr_outlier or mad_outlier")
def e20_flagged_values(t):
    """Every value that a rule flags, with its distance, robust z and severity; the rules are fitted on one status."""
    return anomalies.flagged(scores(t)).withColumns({c: F.round(c, 8) for c in ("iqr_distance", "robust_z", "severity")})


@query(SCORES + """select dataset, feature, count(value) as non_missing, count(*) filter (where iqr_outlier) as iqr_outliers, count(*) filter (where mad_outlier) as mad_outliers,
  count(*) filter (where iqr_outlier or mad_outlier) as any_outliers, round(count(*) filter (where iqr_outlier or mad_outlier) / count(value), 10) as outlier_share,
  count(*) filter (where value < least or value > most) as outside_reference_range from r group by 1, 2""")
def e20_summary(t):
    """Flags of each class and column; both rules are off for a constant column."""
    return anomalies.summary(scores(t), "dataset").withColumn("outlier_share", F.round("outlier_share", 10))


@query(SCORES + """select dataset, l_orderkey, l_linenumber, count(*) as n_features, string_agg(feature, ',' order by feature) as features, round(max(severity), 8) as worst
  from r where iqr_outlier or mad_outlier group by 1, 2, 3""")
def e20_row_rollup(t):
    """The columns of each row that are flagged, and its largest severity."""
    return anomalies.row_rollup(scores(t), ["dataset", "l_orderkey", "l_linenumber"]).withColumn("worst", F.round("worst", 8))


@query()
def h1_strength_search(t):
    """How strongly the texts' shares of the letter e are drawn to the share in all: the strength of the largest likelihood by a search; compared with a plain one in the tests."""
    table = t("documents").where(F.length("text") > 0).select(F.length("text").cast("long").alias("total"), sc.letter_count(F.col("text"), "e").cast("long").alias("positive"))
    s, likelihood = models.best_strength(table)
    return t.spark.createDataFrame([(s, likelihood)], "strength double, log_likelihood double").select(F.round("strength", 2).alias("strength"), F.round("log_likelihood", 4).alias("log_likelihood"))


CATEGORIES = ["l_linestatus", "month", "part"]


def category_lines(t):
    rows = t("lineitem").select("l_orderkey", "l_quantity", "l_linestatus", F.month("l_shipdate").cast("string").alias("month"), (F.col("l_partkey") % 40).cast("string").alias("part"), (F.col("l_returnflag") == "R").cast("double").alias("label"))
    return models.with_flags(rows, ["l_quantity"])


@query()
def h4_native_categories(t):
    """Metrics of a tree on native levels (odd orders train, even ones test); levels of fewer than 20 rows and unseen ones share a slot."""
    rows = category_lines(t)
    tree = models.estimator("tree").setMaxBins(64)
    model = Pipeline(stages=[models.native_categories(CATEGORIES, ["l_quantity"], 20), tree]).fit(rows.where("l_orderkey % 2 = 1"))
    found = models.metrics_of(models.probability(model.transform(rows.where("l_orderkey % 2 = 0"))))
    return t.spark.createDataFrame([found], "auc double, average_precision double, log_loss double, accuracy double")


@query()
def h7_permutation_importance(t):
    """How much the AUC of a tree falls when a column is permuted, twice each; the same on each run."""
    rows = category_lines(t).withColumn("k", F.xxhash64("l_orderkey", "l_quantity", "part", "month")).drop("l_orderkey")
    model = models.fit_counted(models.native_categories(CATEGORIES, ["l_quantity"], 20), models.estimator("tree").setMaxBins(64), rows.drop("k"))
    return models.permutation_importance(model, rows, ["l_quantity", *CATEGORIES], "k").withColumn("drop", F.round("drop", 8))


@query()
def h7_staged_losses(t):
    """The loss on even orders of a boosted model of odd ones after each of its trees."""
    rows = category_lines(t)
    model = Pipeline(stages=[models.native_categories(CATEGORIES, ["l_quantity"], 20), models.estimator("boosting").setMaxBins(64)]).fit(rows.where("l_orderkey % 2 = 1"))
    return models.staged_losses(model, rows.where("l_orderkey % 2 = 0"))


PROFILED = ["case when q is null then 1.0 else 0.0 end", "coalesce(q, med)", "l_extendedprice", "case when l_linestatus = 'F' then 1.0 else 0.0 end", "case when l_linestatus = 'O' then 1.0 else 0.0 end", "0.0", "0.0"]


@query(f"""with v as (select *, nullif(l_quantity, 7) as q from lineitem), m as (select quantile_disc(q, 0.5) as med from v), r as (select * from v, m)
{" union all ".join(f"select {i} as slot, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, count(*) filter (where {c} <> 0) as non_zero, count(*) as n from r" for i, c in enumerate(PROFILED))}""")
def h8_feature_profile(t):
    """Mean, deviation and non-zero rows of each slot that the preprocessing of two numbers (gaps filled by the median) and a category leaves."""
    rows = t("lineitem").select(F.nullif("l_quantity", F.lit(7.0)).alias("l_quantity"), "l_extendedprice", "l_linestatus", (F.col("l_returnflag") == "R").cast("double").alias("label"))
    rows = models.with_flags(rows, ["l_quantity"]).withColumn("l_extendedprice", F.col("l_extendedprice").cast("double"))
    model = Pipeline(stages=[models.preprocessor(["l_quantity"], ["l_linestatus"], scale=None)]).fit(rows)
    order = VectorAssembler(inputCols=["l_quantity_missing", "numbers", "l_extendedprice", "l_linestatus_hot"], outputCol="features", handleInvalid="keep")
    plain = Pipeline(stages=[*model.stages[0].stages[:-1], order, models.estimator("logistic").setMaxIter(1)]).fit(rows)
    out = models.feature_profile(plain, rows)
    return out.select(F.col("slot").cast("int").alias("slot"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "non_zero", "n")


@query("""select -1 as stage, 'label' as column_name, 0 as nulls union all select -1, 'l_quantity', count(*) filter (where l_quantity = 7) from lineitem
union all select -1, 'l_linestatus', 0 union all select -1, 'l_quantity_missing', 0 union all select 0, 'l_quantity_filled', 0 union all select 1, 'numbers', 0 union all select 2, 'features', 0""")
def h8_stage_gaps(t):
    """Null values of the columns that each stage of a preprocessing adds."""
    rows = t("lineitem").select(F.nullif("l_quantity", F.lit(7.0)).alias("l_quantity"), "l_linestatus", (F.col("l_returnflag") == "R").cast("double").alias("label"))
    rows = models.with_flags(rows, ["l_quantity"])
    model = models.preprocessor(["l_quantity"], [], scale=None).fit(rows)
    return models.stage_gaps(model, rows).select(F.col("stage").cast("int").alias("stage"), F.col("column").alias("column_name"), "nulls")
