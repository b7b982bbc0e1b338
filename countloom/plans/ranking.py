"""Metric, profile and sampling queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import counts, metrics, ranks
from ..operators.pins import pinned
from .registry import query

LEVELS = "select round(l_extendedprice) as score, count(*) as total, cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as bigint) as positive from lineitem group by 1"


def scored(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", F.round("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


def levels(t):
    return metrics.score_levels(scored(t), "score", "y")


@query(f"""with l as ({LEVELS}), c as (select *, sum(total) over (order by score desc) as ct, sum(positive) over (order by score desc) as cp from l)
select round(sum(positive * cp / ct) / sum(positive), 10) as ap, cast(sum(total) as bigint) as total, cast(sum(positive) as bigint) as positive from c""")
def f1_average_precision(t):
    return metrics.average_precision(levels(t)).select(F.round("ap", 10).alias("ap"), "total", "positive")


@query(f"""with l as (select l_suppkey, round(l_extendedprice) as score, count(*) as total, sum(case when l_returnflag = 'R' then 1 else 0 end) as positive from lineitem group by 1, 2),
c as (select *, sum(total) over (partition by l_suppkey order by score desc) as ct, sum(positive) over (partition by l_suppkey order by score desc) as cp from l)
select l_suppkey, round(coalesce(sum(positive * cp / ct) / nullif(sum(positive), 0), 0), 10) as ap from c group by 1""")
def f2_average_precision_by_group(t):
    return metrics.average_precision(metrics.score_levels(scored(t), "score", "y", ["l_suppkey"]), ["l_suppkey"]).select("l_suppkey", F.round("ap", 10).alias("ap"))


@query("""with r as (select case when l_returnflag = 'R' then 1 else 0 end as y, row_number() over (order by round(l_extendedprice) desc, l_orderkey * 10 + l_linenumber) as r from lineitem),
h as (select r, row_number() over (order by r) as h from r where y = 1) select round(avg(h / r), 10) as ap from h""")
def f3_average_precision_by_rows(t):
    rows = scored(t).withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return metrics.average_precision_by_rows(rows, "score", "y", "key").select(F.round("ap", 10).alias("ap"))


@query("""with d as (select l_quantity, round(l_extendedprice) as score from lineitem where l_returnflag = 'R'),
r as (select dense_rank() over (order by l_quantity) as a, dense_rank() over (order by score) as b from d) select round(corr(a, b), 10) as corr from r""")
def f4_rank_correlation(t):
    return metrics.rank_correlation(scored(t).where("y = 1").select("l_quantity", "score"), "l_quantity", "score").select(F.round("corr", 10).alias("corr"))


@query("""with r as (select l_orderkey, l_linenumber, row_number() over (order by l_extendedprice desc, l_orderkey, l_linenumber) as r, count(*) over () as n from lineitem where l_returnflag <> 'R')
select case when r <= ceil(0.01 * n) then 0 when r <= ceil(0.05 * n) then 1 when r <= ceil(0.15 * n) then 2 else 3 end as band, count(*) as n_rows, cast(sum(l_orderkey)
  as bigint) as keys from r group by 1""")
def f6_rank_bands(t):
    rows = t("lineitem").where("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber", "l_extendedprice")
    rows = ranks.row_numbers(rows, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], "r").crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))
    at = lambda f: F.col("r") <= F.ceil(F.lit(f) * F.col("n"))
    return rows.groupBy(F.when(at(0.01), 0).when(at(0.05), 1).when(at(0.15), 2).otherwise(3).alias("band")).agg(F.count("*").alias("n_rows"), F.sum("l_orderkey").alias("keys"))


@query("""(select 'top' as cohort, l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' order by l_extendedprice desc, l_orderkey, l_linenumber limit 100)
union all (select 'bottom', l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' order by l_extendedprice, l_orderkey, l_linenumber limit 100)""")
def f8_extreme_cohorts(t):
    rows = t("lineitem").where("l_returnflag = 'R'")
    cut = lambda name, c: rows.orderBy(c, "l_orderkey", "l_linenumber").limit(100).select(F.lit(name).alias("cohort"), "l_orderkey", "l_linenumber")
    return cut("top", F.desc("l_extendedprice")).unionByName(cut("bottom", F.asc("l_extendedprice")))


@query(f"""with l as ({LEVELS}), c as (select positive, total - positive as n, sum(total - positive) over (order by score) as cn from l)
select round(sum(positive * (cn - n / 2)) / (sum(positive) * sum(n)), 10) as auc from c""")
def f10_auc(t):
    return metrics.auc(levels(t)).select(F.round("auc", 10).alias("auc"))


@query("select l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) as p10, round(quantile_cont(l_extendedprice, 0.5), 6) as p50, round(quantile_cont(l_extendedprice, 0.9), 6) as p90, round(avg(case when l_extendedprice > 50000 then 1.0 else 0.0 end), 10) as above from lineitem group by 1")
def f13_score_distribution(t):
    by, names = ["l_returnflag"], {0.1: "p10", 0.5: "p50", 0.9: "p90"}
    q = ranks.quantiles(t("lineitem"), "l_extendedprice", list(names), by).groupBy(*by)
    q = q.agg(*(F.round(F.max(F.when(F.col("q") == p, F.col("value"))), 6).alias(n) for p, n in names.items()))
    above = t("lineitem").groupBy(*by).agg(F.round(F.avg((F.col("l_extendedprice") > 50000).cast("double")), 10).alias("above"))
    return q.join(above, by)


@query("""select count(*) filter (where quality = 1 and toxic = 0) as only_reference, count(*) filter (where quality = 0 and toxic = 1) as only_candidate, count(*) filter (where quality = 1 and toxic = 1) as both_one, round(avg(case when quality = toxic then 1.0 else 0.0 end), 10) as agreement from labels""")
def f16_prediction_agreement(t):
    q, x = F.col("quality"), F.col("toxic")
    return t("labels").agg(F.count_if((q == 1) & (x == 0)).alias("only_reference"), F.count_if((q == 0) & (x == 1)).alias("only_candidate"), F.count_if((q == 1) & (x == 1)).alias("both_one"), F.round(F.avg((q == x).cast("double")), 10).alias("agreement"))


@query("""with t as (select l_suppkey, count(*) as total, cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as bigint) as positive from lineitem group by 1), g as
  (select sum(positive) / sum(total) as p from t)
select l_suppkey, total, positive, total - positive as negative, round(positive / total, 10) as rate, round(positive / total / p, 10) as enrichment from t, g""")
def e4_category_table(t):
    return counts.category_table(scored(t), "l_suppkey", "y").select("l_suppkey", "total", "positive", "negative", F.round("rate", 10).alias("rate"), F.round("enrichment", 10).alias("enrichment"))


@query("""select l_returnflag, l_linestatus, grouping(l_returnflag) * 2 + grouping(l_linestatus) as level, count(*) as n from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus))""")
def e3_key_marginals(t):
    rows = t("lineitem").groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], ["l_linestatus"]], "l_returnflag", "l_linestatus")
    return rows.agg((F.grouping("l_returnflag") * 2 + F.grouping("l_linestatus")).cast("long").alias("level"), F.count("*").alias("n"))


@query("""with k as (select l_suppkey, case when l_returnflag = 'R' then 1 else 0 end as y, count(*) as n from lineitem group by 1, 2), c as (select *, sum(n) over
  (partition by y) as nc, sum(n) over () as total from k)
select l_suppkey, y, n, round(n * total / (2.0 * nc), 8) as weight from c""")
def e6_likelihood_compaction(t):
    k = scored(t).groupBy("l_suppkey", "y").agg(F.count("*").alias("n"))
    c = k.groupBy("y").agg(F.sum("n").alias("nc"))
    return k.join(c, "y").crossJoin(F.broadcast(k.agg(F.sum("n").alias("total")))).select("l_suppkey", "y", "n", F.round(F.col("n") * F.col("total") / (2.0 * F.col("nc")), 8).alias("weight"))


@query("""select count(*) as n, count(distinct o_orderpriority) as priorities, count(*) filter (where o_totalprice is null) as missing, round(avg(o_totalprice), 6) as mean, round(stddev_samp(o_totalprice), 6) as std, round(quantile_cont(o_totalprice, 0.25), 6) as q1, round(quantile_cont(o_totalprice, 0.75), 6) as q3 from orders""")
def e16_profile(t):
    c = F.col("o_totalprice")
    q = ranks.quantiles(t("orders"), "o_totalprice", [0.25, 0.75]).agg(*(F.round(F.max(F.when(F.col("q") == p, F.col("value"))), 6).alias(n) for p, n in ((0.25, "q1"), (0.75, "q3"))))
    facts = t("orders").agg(
        F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("priorities"), F.count_if(c.isNull()).alias("missing"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("std")
    )
    return facts.crossJoin(F.broadcast(q))


@query("""select round(corr(l_quantity, l_extendedprice), 10) as pearson, round(regr_slope(l_extendedprice, l_quantity), 8) as slope, round(regr_intercept(l_extendedprice, l_quantity), 6) as intercept from lineitem""")
def e18_correlation(t):
    return t("lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 10).alias("pearson"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 8).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 6).alias("intercept"))


@query("""with b as (select quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.75) as q3, quantile_cont(o_totalprice, 0.5) as m from orders),
d as (select quantile_cont(abs(o_totalprice - m), 0.5) as mad from orders, b)
select count(*) filter (where o_totalprice < q1 - 1.5 * (q3 - q1) or o_totalprice > q3 + 1.5 * (q3 - q1)) as iqr_outliers, count(*) filter (where mad > 0 and 0.6745 *
  abs(o_totalprice - m) / mad > 3.5) as mad_outliers from orders, b, d""")
def e20_outliers(t):
    x = F.col("o_totalprice")
    q1, m, q3 = (r["value"] for r in ranks.quantiles(t("orders"), "o_totalprice", [0.25, 0.5, 0.75]).orderBy("q").collect())
    mad = ranks.quantiles(t("orders").select(F.abs(x - m).alias("d")), "d", [0.5]).head()["value"]
    far = 1.5 * (q3 - q1)
    score = F.try_divide(0.6745 * F.abs(x - m), F.nullif(F.lit(mad), F.lit(0.0)))
    return t("orders").agg(F.count_if((x < q1 - far) | (x > q3 + far)).alias("iqr_outliers"), F.count_if(score > 3.5).alias("mad_outliers"))


@query("""with n as (select l_suppkey, count(*) as rows from lineitem group by 1), r as (select *, row_number() over (order by md5(cast(l_suppkey as varchar) || ':groups'), l_suppkey) as r, count(*) over () as k from n)
select l_suppkey, rows, case when r <= ceil(0.25 * k) then 'validation' else 'train' end as split from r""")
def g1_group_holdout(t):
    """Whole suppliers with their rows, a quarter of them to validation in a seeded order."""
    n = t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("rows")).withColumn("h", F.md5(F.concat(F.col("l_suppkey").cast("string"), F.lit(":groups")).cast("binary")))
    n = pinned(n)
    rows = ranks.row_numbers(n, [F.asc("h"), F.asc("l_suppkey")], "r").crossJoin(F.broadcast(n.agg(F.count("*").alias("k"))))
    return rows.select("l_suppkey", "rows", F.when(F.col("r") <= F.ceil(F.lit(0.25) * F.col("k")), "validation").otherwise("train").alias("split"))


@query("""with h as (select *, md5(cast(l_orderkey as varchar) || ':' || cast(l_linenumber as varchar) || ':strata') as h from lineitem),
r as (select l_orderkey, l_linenumber, row_number() over (partition by l_suppkey, l_linestatus order by h, l_orderkey, l_linenumber) as r, count(*) over (partition by l_suppkey, l_linestatus) as n from h)
select l_orderkey, l_linenumber, round(n / least(n, 20), 10) as weight from r where r <= 20""")
def g4_stratified_sample(t):
    """20 rows of each supplier and status by least seeded hash, with the weights that undo it (sampling is the feature)."""
    w = W.partitionBy("l_suppkey", "l_linestatus")
    h = F.md5(F.concat_ws(":", "l_orderkey", "l_linenumber", F.lit("strata")).cast("binary"))
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_linestatus").withColumn("r", F.row_number().over(w.orderBy(h, "l_orderkey", "l_linenumber"))).where("r <= 20")
    n = t("lineitem").groupBy("l_suppkey", "l_linestatus").agg(F.count("*").alias("n"))
    return rows.join(n, ["l_suppkey", "l_linestatus"]).select("l_orderkey", "l_linenumber", F.round(F.col("n") / F.least("n", F.lit(20)), 10).alias("weight"))


@query("""with n as (select distinct c_nationkey from customer), r as (select c_nationkey, row_number() over (order by md5(cast(c_nationkey as varchar) || ':holdout'),
  c_nationkey) as r, count(*) over () as k from n)
select c_nationkey, case when r <= ceil(0.25 * k) then 'validation' else 'train' end as split from r""")
def g1_seeded_holdout(t):
    """Whole groups in a seeded order, the first quarter to validation."""
    n = t("customer").select("c_nationkey").distinct().withColumn("h", F.md5(F.concat(F.col("c_nationkey").cast("string"), F.lit(":holdout")).cast("binary")))
    rows = ranks.row_numbers(n, [F.asc("h"), F.asc("c_nationkey")], "r").crossJoin(F.broadcast(n.agg(F.count("*").alias("k"))))
    return rows.select("c_nationkey", F.when(F.col("r") <= F.ceil(F.lit(0.25) * F.col("k")), "validation").otherwise("train").alias("split"))


@query("""with h as (select *, md5(cast(l_orderkey as varchar) || ':' || cast(l_linenumber as varchar) || ':sample') as h from lineitem),
r as (select l_orderkey, l_linenumber, row_number() over (partition by l_suppkey, l_returnflag order by h, l_orderkey, l_linenumber) as r, count(*) over (partition by
  l_suppkey, l_returnflag) as n from h)
select l_orderkey, l_linenumber, round(n / least(n, 20), 10) as weight from r where r <= 20""")
def g4_seeded_sample(t):
    """20 rows of each supplier and class by least seeded hash, so that each row of a group is as likely."""
    by = ["l_suppkey", "l_returnflag"]
    h = F.md5(F.concat_ws(":", "l_orderkey", "l_linenumber", F.lit("sample")).cast("binary"))
    rows = t("lineitem").select("l_orderkey", "l_linenumber", *by).withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(h, "l_orderkey", "l_linenumber"))).where("r <= 20")
    n = t("lineitem").groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.count("*").alias("n"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return rows.join(n, same).select("l_orderkey", "l_linenumber", F.round(F.col("n") / F.least("n", F.lit(20)), 10).alias("weight"))
