"""Summary, distribution, agreement, fold and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranks
from .registry import query

QUANTILES = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)
FRACTIONS = (0.001, 0.01, 0.05, 0.1, 0.25)
BLOCKS = 6


def returned():
    return F.sum((F.col("l_returnflag") == "R").cast("long"))


@query("""with n as (select count(*) as n from lineitem)
select l_linestatus as split, count(distinct l_suppkey) as n_groups, count(*) as n_rows, cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as bigint) as positive,
round(100.0 * count(*) / (select n from n), 10) as percent from lineitem group by 1""")
def e7_split_summary(t):
    rows = t("lineitem").groupBy(F.col("l_linestatus").alias("split"), "l_suppkey").agg(F.count("*").alias("n"), returned().alias("p"))
    parts = rows.groupBy("split").agg(F.count("l_suppkey").alias("n_groups"), F.sum("n").alias("n_rows"), F.sum("p").alias("positive"))
    whole = parts.agg(F.sum("n_rows").alias("whole"))
    return parts.crossJoin(F.broadcast(whole)).select("split", "n_groups", "n_rows", "positive", F.round(100.0 * F.col("n_rows") / F.col("whole"), 10).alias("percent"))


@query("with q as (select unnest([" + ", ".join(map(str, QUANTILES)) + """]) as q), v as (select list(o_totalprice order by o_totalprice) as v, count(o_totalprice) as n from orders),
p as (select q, q * (n - 1) as p, v from q, v)
select cast(q as double) as q, round(v[cast(floor(p) as bigint) + 1] + (v[cast(ceil(p) as bigint) + 1] - v[cast(floor(p) as bigint) + 1]) * (p - floor(p)), 6) as value from p""")
def e9_count_quantiles(t):
    """Exact linear quantiles from two-level ranks, so that no task holds all values."""
    rows = t("orders").where("o_totalprice is not null").select("o_totalprice", "o_orderkey")
    ranked = ranks.row_numbers(rows, [F.asc("o_totalprice"), F.asc("o_orderkey")], "r")
    at = rows.agg(F.count("*").alias("n")).select(F.explode(F.array(*map(F.lit, QUANTILES))).alias("q"), (F.col("q") * (F.col("n") - 1)).alias("p"))
    ends = at.select("q", "p", F.explode(F.array((F.floor("p") + 1), (F.ceil("p") + 1))).alias("r")).distinct()
    found = ranked.join(F.broadcast(ends), "r").groupBy("q", "p").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    return found.select("q", F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("p") - F.floor("p")), 6).alias("value"))


@query("""select case when l_quantity <= 1 then 0 when l_quantity <= 5 then 1 when l_quantity <= 10 then 2 when l_quantity <= 25 then 3 else 4 end as range_id,
count(*) as n_rows, cast(sum(l_quantity) as bigint) as total, cast(sum(case when l_quantity = 1 then 1 else 0 end) as bigint) as singletons from lineitem where l_quantity is not null group by 1""")
def e9_count_ranges(t):
    x = F.col("l_quantity")
    rows = t("lineitem").where(x.isNotNull())
    found = rows.groupBy(F.when(x <= 1, 0).when(x <= 5, 1).when(x <= 10, 2).when(x <= 25, 3).otherwise(4).alias("range_id"))
    return found.agg(F.count("*").alias("n_rows"), F.sum(x).cast("long").alias("total"), F.sum((x == 1).cast("long")).alias("singletons"))


@query("""with c as (select user_id, cast(ts as date) as d, count(*) filter (where event_type = 'click') as a, count(*) filter (where event_type = 'purchase') as b from
  events where event_type in ('click', 'purchase') group by 1, 2)
select cast(sum(case when a > 0 and b > 0 then 1 else 0 end) as bigint) as n_both, cast(sum(case when b = 0 then 1 else 0 end) as bigint) as only_a, cast(sum(case when a
  = 0 then 1 else 0 end) as bigint) as only_b, count(*) as n_union,
round(sum(case when a > 0 and b > 0 then 1 else 0 end) / count(*), 10) as jaccard, round(corr(ln(1 + a), ln(1 + b)), 8) as corr_union,
round(corr(ln(1 + a), ln(1 + b)) filter (where a > 0 and b > 0), 8) as corr_shared from c""")
def e10_replicate_agreement(t):
    kind, a, b = F.col("event_type"), F.col("a"), F.col("b")
    rows = t("events").where(kind.isin("click", "purchase")).groupBy("user_id", F.to_date("ts").alias("d"))
    rows = rows.agg(F.count_if(kind == "click").alias("a"), F.count_if(kind == "purchase").alias("b"))
    both = (a > 0) & (b > 0)
    pair = lambda keep: F.round(F.corr(F.when(keep, F.log1p("a")), F.when(keep, F.log1p("b"))), 8)
    return rows.agg(
        F.count_if(both).alias("n_both"), F.count_if(b == 0).alias("only_a"), F.count_if(a == 0).alias("only_b"), F.count("*").alias("n_union"),
        F.round(F.count_if(both) / F.count("*"), 10).alias("jaccard"), pair(F.lit(True)).alias("corr_union"), pair(both).alias("corr_shared"),
    )


@query("""with c as (select cast(floor(l_quantity / 5) as bigint) as bin, count(*) as total, sum(case when l_returnflag = 'R' then 1 else 0 end) as positive from
  lineitem where l_quantity is not null group by 1),
g as (select unnest(range(0, 13)) as bin), s as (select sum(positive) / sum(total) as base from c)
select g.bin as bin, cast(coalesce(total, 0) as bigint) as total, cast(coalesce(positive, 0) as bigint) as positive, round(positive / total, 10) as rate, round(positive
  / total / base, 10) as enrichment from g left join c using (bin), s""")
def e5_bin_enrichment(t):
    """Fixed bins, empty ones too: their rate is null."""
    spark = t("lineitem").sparkSession
    seen = t("lineitem").where("l_quantity is not null").groupBy(F.floor(F.col("l_quantity") / 5).alias("bin")).agg(F.count("*").alias("total"), returned().alias("positive"))
    base = seen.agg((F.sum("positive") / F.sum("total")).alias("base"))
    rate = F.col("positive") / F.col("total")
    rows = spark.range(13).toDF("bin").join(F.broadcast(seen.where("bin between 0 and 12")), "bin", "left").crossJoin(F.broadcast(base))
    return rows.select("bin", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("positive", F.lit(0)).alias("positive"), F.round(rate, 10).alias("rate"), F.round(rate / F.col("base"), 10).alias("enrichment"))


@query("""select event_type, cast(ts as date) as day, cast(hour(ts) as bigint) as region, count(*) as n_rows, bool_or(value > 50) as any_positive, bool_and(value is not null) as all_valid,
cast(sum(case when value > 50 then 1 else 0 end) as bigint) as n_positive, round(sum(case when value > 50 then value else 0 end), 6) as sum_positive, arg_max(event_id,
  value * 1e9 - event_id) as dominant from events group by 1, 2, 3""")
def e15_region_rollup(t):
    v = F.col("value")
    rows = t("events").groupBy("event_type", F.to_date("ts").alias("day"), F.hour("ts").cast("long").alias("region"))
    return rows.agg(
        F.count("*").alias("n_rows"), F.bool_or(v > 50).alias("any_positive"), F.bool_and(v.isNotNull()).alias("all_valid"), F.count_if(v > 50).alias("n_positive"),
        F.round(F.sum(F.when(v > 50, v).otherwise(0.0)), 6).alias("sum_positive"), F.max_by("event_id", v * 1e9 - F.col("event_id")).alias("dominant"),
    )


@query("with q as (select unnest([" + ", ".join(map(str, FRACTIONS)) + """]) as f), r as (select case when l_returnflag = 'R' then 1 else 0 end as y, row_number() over
  (order by l_extendedprice desc, l_orderkey, l_linenumber) as r, count(*) over () as n from lineitem)
select cast(f as double) as fraction, cast(max(ceil(f * n)) as bigint) as n_top, cast(sum(case when r <= ceil(f * n) then y else 0 end) as bigint) as captured,
  round(sum(case when r <= ceil(f * n) then y else 0 end) / sum(y), 10) as recall from r, q group by 1""")
def f9_top_fractions(t):
    """One pass over the ranked rows: a conditional sum for each fraction."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_returnflag") == "R").cast("long").alias("y"))
    ranked = ranks.row_numbers(rows, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], "r").crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))
    top = [F.ceil(F.lit(f) * F.col("n")) for f in FRACTIONS]
    sums = ranked.agg(F.sum("y").alias("all"), F.array(*[F.struct(F.lit(f).alias("fraction"), F.max(k).alias("n_top"), F.sum(F.when(F.col("r") <= k, F.col("y")).otherwise(0)).alias("captured")) for f, k in zip(FRACTIONS, top, strict=True)]).alias("at"))
    return sums.select("all", F.inline("at")).select("fraction", "n_top", "captured", F.round(F.col("captured") / F.col("all"), 10).alias("recall"))


FOLDS = "select l_linenumber as candidate, cast(l_suppkey % 5 as bigint) as fold, avg(l_discount) as m from lineitem group by 1, 2"


def folds(t):
    return t("lineitem").groupBy(F.col("l_linenumber").alias("candidate"), (F.col("l_suppkey") % 5).alias("fold")).agg(F.avg("l_discount").alias("m"))


@query(f"""select candidate, count(*) as n_folds, round(avg(m), 10) as mean, round(stddev_samp(m), 10) as std, round(min(m), 10) as low, round(max(m), 10) as high from ({FOLDS}) group by 1""")
def f14_cv_rollup(t):
    at = lambda f: F.round(f("m"), 10)
    return folds(t).groupBy("candidate").agg(F.count("*").alias("n_folds"), at(F.avg).alias("mean"), at(F.stddev_samp).alias("std"), at(F.min).alias("low"), at(F.max).alias("high"))


@query(f"""with f as ({FOLDS}), d as (select a.candidate, round(a.m - b.m, 10) as d from f a join f b on a.fold = b.fold and b.candidate = 1 where a.candidate <> 1)
select candidate, cast(sum(case when d > 0 then 1 else 0 end) as bigint) as wins, cast(sum(case when d = 0 then 1 else 0 end) as bigint) as ties, cast(sum(case when d <
  0 then 1 else 0 end) as bigint) as losses, round(avg(d), 8) as improvement from d group by 1""")
def f15_reference_compare(t):
    """Fold by fold against candidate 1."""
    f = folds(t)
    d = f.where("candidate <> 1").join(f.where("candidate = 1").select("fold", F.col("m").alias("reference")), "fold").withColumn("d", F.round(F.col("m") - F.col("reference"), 10))
    return d.groupBy("candidate").agg(F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") == 0).alias("ties"), F.count_if(F.col("d") < 0).alias("losses"), F.round(F.avg("d"), 8).alias("improvement"))


@query(f"""with r as (select event_id, row_number() over (order by ts, event_id) as r, count(*) over () as n from events)
select event_id, cast((r - 1) * {BLOCKS} // n as bigint) as block from r""")
def g3_time_folds(t):
    """Time blocks of equal size: fold i trains on the blocks before block i."""
    rows = t("events").select("event_id", "ts")
    ranked = ranks.row_numbers(rows, [F.asc("ts"), F.asc("event_id")], "r").crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))
    return ranked.select("event_id", F.floor((F.col("r") - 1) * BLOCKS / F.col("n")).cast("long").alias("block"))


@query("""with r as (select l_suppkey, l_orderkey, l_linenumber, count(*) over (partition by l_suppkey) as n, row_number() over (partition by l_suppkey order by
  l_extendedprice, l_orderkey, l_linenumber) as r from lineitem)
select l_suppkey, l_orderkey, l_linenumber, case when r <= floor(0.25 * n) then 'bottom' else 'top' end as tail from r where r <= floor(0.25 * n) or r > n - floor(0.25 * n)""")
def c12_exact_cell_tails(t):
    """The bottom and top quarter of each cell; ranks are two-level, so a hot cell is not one task."""
    rows = t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    ranked = ranks.row_numbers(rows, [F.asc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], "r", ["l_suppkey"])
    size = rows.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    quarter = F.floor(0.25 * F.col("n"))
    low, high = F.col("r") <= quarter, F.col("r") > F.col("n") - quarter
    return ranked.join(size, "l_suppkey").where(low | high).select("l_suppkey", "l_orderkey", "l_linenumber", F.when(low, "bottom").otherwise("top").alias("tail"))


@query("""with c as (select text, count(*) as n from documents group by 1)
select cast(sum(n) as bigint) as n_rows, cast(sum(case when text is null then n else 0 end) as bigint) as n_null, cast(sum(case when trim(text, ' ') = '' then n else 0 end) as bigint) as n_blank,
count(text) as n_unique, cast(sum(case when text is not null then n - 1 else 0 end) as bigint) as n_repeats, cast(max(n) as bigint) as most_repeats from c""")
def e19_text_report(t):
    """Counts per distinct text first, then one row of totals."""
    c = t("documents").groupBy("text").agg(F.count("*").alias("n"))
    n, known = F.col("n"), F.col("text").isNotNull()
    part = lambda keep, v=n: F.sum(F.when(keep, v).otherwise(0))
    return c.agg(
        F.sum("n").alias("n_rows"), part(~known).alias("n_null"), part(F.trim("text") == "").alias("n_blank"),
        F.count("text").alias("n_unique"), part(known, n - 1).alias("n_repeats"), F.max("n").alias("most_repeats"),
    )


@query("""with c as (select source, count(*) as n from documents where source is not null group by 1)
select source, n, round(sum(n) over (order by n desc, source) / sum(n) over (), 10) as cumulative_share from c""")
def e19_value_shares(t):
    """Levels by count with their cumulative share."""
    c = t("documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    out = ranks.cumulative(c, [F.desc("n"), F.asc("source")], {"upto": F.col("n")}).crossJoin(F.broadcast(c.agg(F.sum("n").alias("whole"))))
    return out.select("source", "n", F.round(F.col("upto") / F.col("whole"), 10).alias("cumulative_share"))


@query("""with v as (select l_returnflag, l_discount, sum(l_quantity) as w from lineitem where l_discount is not null and l_quantity is not null group by 1, 2)
select l_returnflag, round(sum(w * l_discount) / sum(w), 10) as weighted_mean, cast(sum(w) as bigint) as weight from v group by 1""")
def e12_weighted_mean(t):
    rows = t("lineitem").where("l_discount is not null and l_quantity is not null")
    return rows.groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity"), 10).alias("weighted_mean"), F.sum("l_quantity").cast("long").alias("weight"))
