"""Checks of tables against each other, and closed-form score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import metrics, ranks
from .intervals import SPANS, customer_spans
from .registry import query

RETURNED = "case when l_returnflag = 'R' then 1 else 0 end"


@query("""with d as (select l_orderkey as k, round(sum(l_extendedprice), 2) as v from lineitem group by 1), j as (select o_totalprice as a, v as b from orders full outer join d on o_orderkey = k)
select count(*) as n_lines, cast(sum(case when a <> 0 then 1 else 0 end) as bigint) as nonzero, cast(sum(case when a is distinct from b then 1 else 0 end) as bigint) as
  mismatches, round(sum(a), 2) as total, round(sum(b), 2) as expected from j""")
def a7_dense_against_sparse(t):
    """Value by value on the index; a side without the index counts as a mismatch."""
    sparse = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_extendedprice"), 2).alias("b"))
    j = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("a")).join(sparse, "k", "full_outer")
    return j.agg(F.count("*").alias("n_lines"), F.count_if(F.col("a") != 0).alias("nonzero"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("mismatches"), F.round(F.sum("a"), 2).alias("total"), F.round(F.sum("b"), 2).alias("expected"))


@query("""with n as (select p_brand || '_r' || cast(p_size % 2 + 1 as varchar) || '_' || p_type as name from part), k as (select regexp_replace(name, '_r[12]_', '_') as
  key, regexp_extract(name, '_r([12])_', 1) as rep from n group by 1, 2)
select key, count(*) as replicates, count(*) = 2 as matched from k group by 1""")
def a11_replicate_pairs(t):
    """Names without their replicate token meet; exactly two different tokens are a matched pair."""
    name = F.concat("p_brand", F.lit("_r"), (F.col("p_size") % 2 + 1).cast("string"), F.lit("_"), "p_type")
    keys = t("part").select(F.regexp_replace(name, "_r[12]_", "_").alias("key"), F.regexp_extract(name, "_r([12])_", 1).alias("rep")).distinct()
    return keys.groupBy("key").agg(F.count("*").alias("replicates"), (F.count("*") == 2).alias("matched"))


@query("""with l as (select l_orderkey as k, count(*) as n from lineitem group by 1)
select o_orderstatus as assembly, count(*) as n_rows, count(distinct o_custkey) as contigs, round(sum(o_totalprice), 2) as total, cast(sum(case when o_totalprice <= 0
  then 1 else 0 end) as bigint) as bad_values,
cast(sum(case when k is null then 1 else 0 end) as bigint) as unmatched, sum(case when o_totalprice <= 0 or k is null then 1 else 0 end) = 0 as passed from orders left
  join l on o_orderkey = k group by 1""")
def a14_assembly_audit(t):
    """A row of counts, sums and a verdict per assembly; the failure of one stops no other."""
    lines = t("lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    j = t("orders").join(lines, F.col("o_orderkey") == F.col("k"), "left")
    bad, none = F.coalesce(F.col("o_totalprice") <= 0, F.lit(False)), F.col("k").isNull()
    return j.groupBy(F.col("o_orderstatus").alias("assembly")).agg(
        F.count("*").alias("n_rows"), F.countDistinct("o_custkey").alias("contigs"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_if(bad).alias("bad_values"), F.count_if(none).alias("unmatched"), (F.count_if(bad | none) == 0).alias("passed")
    )


@query(f"""with s as ({SPANS}), b as (select s.*, k.strand from s, (values ('+'), ('-')) k(strand)), w as (select contig, strand, start, "end", sum("end" - start) over
  (order by strand, contig) as stop from b),
p as (select *, stop - ("end" - start) as a, lag(stop) over (order by strand, contig) as before from w)
select strand, count(*) as n_rows, cast(sum(case when a <> coalesce(before, 0) then 1 else 0 end) as bigint) as gaps, cast(sum("end" - start) as bigint) as bases,
cast((select count(*) from (select contig, start, "end" from b where strand = '+' except all select contig, start, "end" from b where strand = '-')) as bigint) as unlike from p group by 1""")
def b2_template_checks(t):
    """Gaps are starts that no stop meets (an equi-join, not a window over all); both strands must hold the same intervals."""
    p = iv.template(customer_spans(t), ["contig"])
    stops = p.select(F.col("template_stop").alias("template_start")).distinct().withColumn("met", F.lit(1))
    rows = p.join(stops, "template_start", "left").withColumn("gap", (F.col("met").isNull() & (F.col("template_start") != 0)))
    side = lambda s: p.where(F.col("strand") == s).select("contig", "start", "end")
    unlike = side("+").exceptAll(side("-")).agg(F.count("*").alias("unlike"))
    return rows.groupBy("strand").agg(F.count("*").alias("n_rows"), F.count_if("gap").alias("gaps"), F.sum(F.col("end") - F.col("start")).alias("bases")).crossJoin(F.broadcast(unlike))


def subset_changes(rows, key, features, derive, parts=(2, 3)):
    """How many rows change a feature when it is derived from every m-th part of the rows alone: such a feature depends on other rows.

    rows has column part_no; derive adds the features. A null against a value is a change."""
    full = derive(rows).select(*key, *(F.col(f).alias(f"_{f}") for f in features))
    out = None
    for m in parts:
        for r in range(m):
            again = derive(rows.where(F.col("part_no") % m == r)).join(full, key)
            changed = lambda f: F.coalesce(F.abs(F.col(f) - F.col(f"_{f}")) > 1e-9, ~F.col(f).eqNullSafe(F.col(f"_{f}")))
            one = again.select(F.lit(m).alias("parts"), *(changed(f).cast("long").alias(f) for f in features))
            out = one if out is None else out.unionByName(one)
    long = out.groupBy("parts").agg(*(F.sum(f).alias(f) for f in features))
    return long.unpivot("parts", features, "feature", "changed")


@query("""with m as (select unnest([2, 3]) as parts), f as (select o_orderkey, o_totalprice / sum(o_totalprice) over (partition by o_custkey) as share from orders),
g as (select parts, o_orderkey, o_totalprice / sum(o_totalprice) over (partition by parts, o_custkey, o_orderkey % parts) as share from orders, m)
select parts, 'share' as feature, cast(sum(case when abs(g.share - f.share) > 1e-9 then 1 else 0 end) as bigint) as changed from g join f using (o_orderkey) group by 1
union all select parts, 'size', 0 from m""")
def b7_subset_audit(t):
    """Of two features of an order, its share of the customer's orders changes with the rows at hand, its logarithm does not."""
    rows = t("orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderkey").alias("part_no"))

    def derive(x):
        whole = x.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("whole"))
        return x.join(whole, "o_custkey").select("o_orderkey", F.log1p("o_totalprice").alias("size"), (F.col("o_totalprice") / F.col("whole")).alias("share"))

    return subset_changes(rows, ["o_orderkey"], ["size", "share"], derive)


@query("select source, count(*) as n, cast(sum(quality) as bigint) as good from documents join labels using (doc_id) group by 1")
def c10_contracted_join(t):
    """Many documents to one label row at most, checked before the join."""
    joined = iv.checked_join(t("documents").select("doc_id", "source"), t("labels"), ["doc_id"])
    return joined.groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("good"))


@query(f"""with g as (select l_quantity, count(*) as w, sum({RETURNED}) as p from lineitem where l_orderkey % 4 <> 0 and l_quantity is not null group by 1),
m as (select sum(w * l_quantity) / sum(w) as mean from g), s as (select mean, sqrt(sum(w * (l_quantity - mean) * (l_quantity - mean)) / sum(w)) as std from g, m group by 1)
select l_orderkey, l_linenumber, round((coalesce(l_quantity, mean) - mean) / std, 8) as scaled from lineitem, s where l_orderkey % 4 = 0""")
def h3_weighted_scaling(t):
    """Mean and deviation from the training rows' counts alone; a missing value becomes the mean."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    g = rows.where("l_orderkey % 4 <> 0 and l_quantity is not null").groupBy("l_quantity").agg(F.count("*").alias("w"))
    m = g.agg((F.sum(F.col("w") * F.col("l_quantity")) / F.sum("w")).alias("mean"))
    d = F.col("l_quantity") - F.col("mean")
    s = g.crossJoin(F.broadcast(m)).groupBy("mean").agg(F.sqrt(F.sum(F.col("w") * d * d) / F.sum("w")).alias("std"))
    x = F.coalesce("l_quantity", "mean")
    return rows.where("l_orderkey % 4 = 0").crossJoin(F.broadcast(s)).select("l_orderkey", "l_linenumber", F.round((x - F.col("mean")) / F.col("std"), 8).alias("scaled"))


#: Levels of two features in long form; log odds of each level over the base rate are its coefficients.
LEVELS_SQL = f"""select l_orderkey, l_linenumber, l_suppkey, {RETURNED} as y, unnest(['quantity=' || cast(cast(floor(l_quantity / 10) as bigint) as varchar), 'discount=' || cast(cast(round(l_discount * 100) as bigint) as varchar)]) as level from lineitem"""


def feature_levels(t):
    level = lambda name, x: F.concat(F.lit(name), x.cast("long").cast("string"))
    both = F.array(level("quantity=", F.floor(F.col("l_quantity") / 10)), level("discount=", F.round(F.col("l_discount") * 100)))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_returnflag") == "R").cast("long").alias("y"), F.explode(both).alias("level"))


@query(f"""with l as ({LEVELS_SQL}), c as (select level, ln((sum(y) + 1.0) / (count(*) - sum(y) + 1.0)) as b from l where l_orderkey % 4 <> 0 group by 1),
s as (select l_orderkey, l_linenumber, max(y) as y, round(coalesce(sum(b), 0), 8) as score from l left join c using (level) where l_orderkey % 4 = 0 group by 1, 2),
v as (select score, count(*) as total, sum(y) as positive from s group by 1), k as (select *, sum(total) over (order by score desc) as ct, sum(positive) over (order by score desc) as cp from v)
select count(*) as n_levels, cast(sum(total) as bigint) as total, round(sum(positive * cp / ct) / sum(positive), 8) as ap from k""")
def h10_coefficient_scorer(t):
    """A linear scorer from a coefficient table: levels meet coefficients (as many as levels), sums per row, ranking metrics only."""
    rows = feature_levels(t)
    fit = rows.where("l_orderkey % 4 <> 0").groupBy("level").agg(F.ln((F.sum("y") + 1.0) / (F.count("*") - F.sum("y") + 1.0)).alias("b"))
    scored = rows.where("l_orderkey % 4 = 0").join(fit, "level", "left").groupBy("l_orderkey", "l_linenumber").agg(F.max("y").alias("y"), F.round(F.coalesce(F.sum("b"), F.lit(0.0)), 8).alias("score"))
    levels = metrics.score_levels(scored, "score", "y")
    return metrics.average_precision(levels).crossJoin(F.broadcast(levels.agg(F.count("*").alias("n_levels")))).select("n_levels", "total", F.round("ap", 8).alias("ap"))


@query(f"""with f as (select level, l_suppkey % 5 as fold, ln((sum(y) + 1.0) / (count(*) - sum(y) + 1.0)) as b from ({LEVELS_SQL}) group by 1, 2)
select level, count(*) as n_folds, round(avg(b), 8) as mean, round(stddev_samp(b), 8) as std, round(greatest(sum(case when b > 0 then 1 else 0 end), sum(case when b < 0
  then 1 else 0 end)) / count(*), 10) as sign_agreement, round(exp(avg(b)), 8) as odds_ratio from f group by 1""")
def h11_coefficient_stability(t):
    f = feature_levels(t).groupBy("level", (F.col("l_suppkey") % 5).alias("fold")).agg(F.ln((F.sum("y") + 1.0) / (F.count("*") - F.sum("y") + 1.0)).alias("b"))
    b = F.col("b")
    return f.groupBy("level").agg(
        F.count("*").alias("n_folds"), F.round(F.avg(b), 8).alias("mean"), F.round(F.stddev_samp(b), 8).alias("std"),
        F.round(F.greatest(F.count_if(b > 0), F.count_if(b < 0)) / F.count("*"), 10).alias("sign_agreement"), F.round(F.exp(F.avg(b)), 8).alias("odds_ratio"),
    )


@query(f"""with h as (select case when l_suppkey % 2 = 0 then 'public' else 'private' end as half, round(l_extendedprice) as score, count(*) as total, sum({RETURNED}) as
  positive from lineitem group by 1, 2),
c as (select *, sum(total) over (partition by half order by score desc) as ct, sum(positive) over (partition by half order by score desc) as cp from h)
select half, cast(sum(total) as bigint) as total, cast(sum(positive) as bigint) as positive, round(sum(positive * cp / ct) / sum(positive), 10) as ap, (select sum(total)
  from h) = (select count(*) from lineitem) as whole from c group by 1""")
def h12_two_halves(t):
    """Metrics of each half, and whether the halves together are the population."""
    rows = t("lineitem").select(F.when(F.col("l_suppkey") % 2 == 0, "public").otherwise("private").alias("half"), F.round("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    levels = metrics.score_levels(rows, "score", "y", ["half"])
    whole = levels.agg(F.sum("total").alias("s")).crossJoin(t("lineitem").agg(F.count("*").alias("n"))).select((F.col("s") == F.col("n")).alias("whole"))
    return metrics.average_precision(levels, ["half"]).select("half", "total", "positive", F.round("ap", 10).alias("ap")).crossJoin(F.broadcast(whole))


@query("""with p as (select l_orderkey as k, max(l_discount) as p, count(*) as n from lineitem where l_linenumber = 1 group by 1)
select count(*) as positions, cast(sum(case when n > 1 then 1 else 0 end) as bigint) as repeated, cast(sum(case when n is null then 1 else 0 end) as bigint) as missing,
  cast(sum(case when p < 0 or p > 1 or isnan(p) then 1 else 0 end) as bigint) as outside, min(p) as low, max(p) as high
from orders left join p on o_orderkey = k""")
def h14_prediction_checks(t):
    """Every position once, finite, in 0..1: predictions counted per key, then held against the template."""
    p = t("lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_discount").alias("p"), F.count("*").alias("n"))
    j = t("orders").select("o_orderkey").join(p, "o_orderkey", "left")
    v = F.col("p")
    return j.agg(F.count("*").alias("positions"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if((v < 0) | (v > 1) | F.isnan(v)).alias("outside"), F.min(v).alias("low"), F.max(v).alias("high"))


@query(f"""with g as (select l_suppkey, count(*) as n, sum({RETURNED}) as y from lineitem group by 1), r as (select *, row_number() over (order by n desc, l_suppkey) as r from g)
select l_suppkey, n, cast((r - 1) % 5 as bigint) as fold from r""")
def g2_round_robin_folds(t):
    """Groups by falling size, dealt round the folds."""
    g = t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return ranks.row_numbers(g, [F.desc("n"), F.asc("l_suppkey")], "r").select("l_suppkey", "n", ((F.col("r") - 1) % 5).alias("fold"))


@query("""with e as (select cast(floor(epoch(ts) / 86400) as bigint) as tile, event_type as contig, sum(case when value > 50 then 1 else 0 end) as p, sum(case when value
  > 50 then 0 else 1 end) as q from events group by 1, 2),
s as (select sum(p) as sp, sum(q) as sq from e) select contig, tile, round(0.5 * p / sp + 0.5 * q / sq, 12) as probability, round(1.0 / ((0.5 * p / sp + 0.5 * q / sq) *
  (select count(*) from e)), 8) as weight from e, s where p + q > 0""")
def g5_tile_probabilities(t):
    """Half of the draws from positives and half from negatives; a loss weight undoes the mixture."""
    v = F.coalesce(F.col("value") > 50, F.lit(False))
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    e = t("events").groupBy(F.col("event_type").alias("contig"), day.alias("tile")).agg(F.count_if(v).alias("p"), F.count_if(~v).alias("q"))
    s = e.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"), F.count("*").alias("n"))
    mix = F.lit(0.5) * F.col("p") / F.col("sp") + F.lit(0.5) * F.col("q") / F.col("sq")
    return e.crossJoin(F.broadcast(s)).select("contig", "tile", F.round(mix, 12).alias("probability"), F.round(1.0 / (mix * F.col("n")), 8).alias("weight"))
