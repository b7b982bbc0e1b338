"""Budget, stratum, matching, choice and diagnostic queries; returned lines are the positives, rounded prices the scores."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import metrics, ranks, resampling, selection
from ..operators.pins import pinned
from .profiles import FOLDS, folds
from .ranking import LEVELS, levels, scored
from .registry import query

FRACTIONS = [0.01, 0.05, 0.1, 0.25]
BUDGETS = [0, 10, 100, 1000, 100000000]
RECALLS = [0.1, 0.5, 0.9, 1.0]
R = "case when l_returnflag = 'R' then 1 else 0 end"
C = f"l as ({LEVELS}), c as (select *, sum(total) over (order by score desc) as ct, sum(positive) over (order by score desc) as cp from l), s as (select sum(total) as n, sum(positive) as p from l)"


def u(values):
    return "unnest([" + ", ".join(map(str, values)) + "])"


def md5(key, salt):
    return f"md5(cast({key} as varchar) || ':{salt}')"


def uniform(key, salt):
    return f"(cast('0x' || substr({md5(key, salt)}, 1, 8) as bigint) / 4294967296.0)"


@query(f"""with {C}, b as (select cast({u(BUDGETS)} as bigint) as budget)
select budget, round(sum(greatest(0, least(total, least(budget, n) - (ct - total))) / total * positive) / max(p), 10) as recall from c, s, b group by 1""")
def f18_recall_at_budgets(t):
    """Expected recall when the level in which a budget ends comes in random order."""
    return selection.recall_at_budgets(levels(t), BUDGETS).select("budget", F.round("recall", 10).alias("recall"))


STRATA = """case when active then 'ACTIVE' when r <= ceil(0.01 * n) then '0_1' when r <= ceil(0.05 * n) then '1_5' when r <= ceil(0.15 * n) then '5_15' else '15_100' end"""
USERS = "select user_id, cast(floor(epoch(ts) / 86400) as bigint) as day, bool_or(event_type = 'purchase') as active, avg(value) as mean, max(value) as top, stddev_pop(value) as spread from events group by 1, 2"


@query(f"""with g as ({USERS}), k as (select *, user_id * 100000 + day as key from g),
r as (select *, row_number() over (partition by active order by round(mean, 6) desc, key) as r, count(*) over (partition by active) as n from k)
select user_id, day, {STRATA} as stratum, round(mean, 6) as mean, round(top, 6) as top, round(spread, 6) as spread, round(top - mean, 6) as peak from r""")
def f19_risk_strata(t):
    """User days as regions: statistics of each, and strata by falling mean of those without a purchase."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("day")
    v = F.col("value")
    g = t("events").groupBy("user_id", day).agg(F.bool_or(F.col("event_type") == "purchase").alias("active"), F.avg(v).alias("mean"), F.max(v).alias("top"), F.stddev_pop(v).alias("spread"))
    g = g.withColumn("key", F.col("user_id") * 100000 + F.col("day")).withColumn("risk", F.round("mean", 6))
    out = selection.risk_strata(pinned(g), "risk", "key", "active")
    at = lambda c, n: F.round(c, 6).alias(n)
    return out.select("user_id", "day", "stratum", at("mean", "mean"), at("top", "top"), at("spread", "spread"), at(F.col("top") - F.col("mean"), "peak"))


@query(f"""with {C}, f as (select {u(FRACTIONS)} as fraction), k as (select fraction, max(score) as threshold from c, s, f where ct >= ceil(fraction * n) group by 1)
select cast(fraction as double) as fraction, threshold, cast(ct as bigint) as selected, cast(cp as bigint) as tp, cast(ct - cp as bigint) as fp, round(cp / ct, 10) as
  precision, round(cp / p, 10) as recall from k join c on c.score = k.threshold, s""")
def f20_budget_statistics(t):
    """The threshold that selects at least a fraction, whole ties included."""
    out = selection.budget_statistics(levels(t), FRACTIONS)
    return out.withColumn("precision", F.round("precision", 10)).withColumn("recall", F.round("recall", 10))


RANKED = f"select l_orderkey, l_linenumber, {R} as y, row_number() over (order by l_extendedprice desc, l_orderkey, l_linenumber) as r, count(*) over () as n from lineitem"


@query(f"""with r as ({RANKED}), h as (select r, n, row_number() over (order by r) as h, sum(y) over () as p from r where y = 1), q as (select {u(RECALLS)} as recall)
select cast(recall as double) as recall, min(r) as n_rows, round(min(r) / max(n), 10) as share from h, q where h >= ceil(recall * p) group by 1""")
def f9_target_recalls(t):
    """How many of the dearest lines hold each share of the returned ones."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    ranked = ranks.row_numbers(rows, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], "r")
    return selection.rows_at_recalls(pinned(ranked), "r", "y", RECALLS).withColumn("share", F.round("share", 10))


@query("""with a as (select round(l_extendedprice) as s, count(*) filter (where l_returnflag = 'R') as p, count(*) filter (where l_returnflag <> 'R') as n,
  sum(l_quantity) filter (where l_returnflag = 'R') as wp, sum(l_quantity) filter (where l_returnflag <> 'R') as wn from lineitem group by 1),
b as (select s, p, n, coalesce(wp, 0) as wp, coalesce(wn, 0) as wn from a), c as (select *, sum(n) over (order by s) - n / 2 as below, sum(wn) over (order by s) - wn / 2 as wbelow from b)
select round(1 - sum(p * below) / (sum(p) * sum(n)), 10) as inversion_rate, round(sum(wp * wbelow) / (sum(wp) * sum(wn)), 10) as weighted_auc from c""")
def f10_inversions(t):
    """How often a positive ranks below a negative (ties half), and the AUC of rows weighted by quantity."""
    rows = t("lineitem").select(F.round("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").alias("y"), F.col("l_quantity").alias("w"))
    of = lambda total, positive: rows.groupBy("score").agg(total.alias("total"), positive.alias("positive"))
    plain = metrics.auc(of(F.count("*"), F.count_if("y")))
    weighted = metrics.auc(of(F.sum("w"), F.sum(F.when(F.col("y"), F.col("w")).otherwise(0.0)))).toDF("weighted_auc")
    return plain.crossJoin(F.broadcast(weighted)).select(F.round(1 - F.col("auc"), 10).alias("inversion_rate"), F.round("weighted_auc", 10).alias("weighted_auc"))


@query(f"""with l as (select l_suppkey % 4 as g, floor(l_extendedprice / 1000) / 100 as score, count(*) as total, sum({R}) as positive from lineitem group by 1, 2), m as
  (select score, sum(total) as total, sum(positive) as positive from l group by 1),
c as (select *, sum(total) over (order by score desc) as ct, sum(positive) over (order by score desc) as cp from m)
select round(sum(positive * cp / ct) / sum(positive), 10) as ap, round(sum(positive * cp / ct) / sum(positive) / (sum(positive) / sum(total)), 8) as lift from c""")
def f2_quantised_lift(t):
    """Score histograms of two decimals by group, merged over the groups; AP and its lift over the prevalence."""
    rows = t("lineitem").select((F.col("l_suppkey") % 4).alias("g"), (F.floor(F.col("l_extendedprice") / 1000) / 100).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    parts = metrics.score_levels(rows, "score", "y", ["g"])
    ap = metrics.average_precision(parts.groupBy("score").agg(F.sum("total").alias("total"), F.sum("positive").alias("positive")))
    return ap.select(F.round("ap", 10).alias("ap"), F.round(F.col("ap") / (F.col("positive") / F.col("total")), 8).alias("lift"))


@query(f"""with x as (select l_orderkey * 10 + l_linenumber as key, l_extendedprice as p, l_returnflag = 'R' as y from lineitem),
a as (select y, key, row_number() over (partition by y order by p desc, key) as t, row_number() over (partition by y order by p, key) as b from x),
r as (select y, key, row_number() over (partition by y order by {md5("key", "rest")}, key) as r from a where key not in (select key from a where t <= 50 or b <= 50))
select 'top' as cohort, y, key from a where t <= 50 union all select 'bottom', y, key from a where b <= 50 union all select 'random rest', y, key from r where r <= 50""")
def f8_class_cohorts(t):
    """The 50 dearest and cheapest lines of each class, and 50 of the rest by least seeded hash (top and random draws are the feature)."""
    rows = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.col("l_extendedprice").alias("p"), (F.col("l_returnflag") == "R").alias("y"))
    cut = lambda frame, name, *order: frame.withColumn("n", F.row_number().over(W.partitionBy("y").orderBy(*order))).where("n <= 50").select(F.lit(name).alias("cohort"), "y", "key")
    ends = pinned(cut(rows, "top", F.desc("p"), "key").unionByName(cut(rows, "bottom", F.asc("p"), "key")))
    return ends.unionByName(cut(rows.join(F.broadcast(ends.select("key")), "key", "left_anti"), "random rest", sc.keyed_hash("key", "rest"), "key"))


@query("""with q as (select l_returnflag, avg(l_extendedprice) as m, quantile_cont(l_extendedprice, 0.5) as p50, quantile_cont(l_extendedprice, 0.9) as p90, avg(case
  when l_extendedprice > 50000 then 1.0 else 0 end) as above,
 sum(l_quantity * l_extendedprice) / sum(l_quantity) as w from lineitem group by 1)
select q.l_returnflag, round(q.m, 6) as mean, round(q.p50, 6) as median, round(q.p90, 6) as p90, round(q.above, 10) as above, round(q.w, 6) as weighted, round(q.m - r.m,
  6) as mean_delta, round(q.p90 - r.p90, 6) as p90_delta from q, q r where r.l_returnflag = 'R'""")
def f13_tail_table(t):
    """Mean, median, p90, share above a cut and weighted mean of each class, and how far they are from class R."""
    rows, x = t("lineitem"), F.col("l_extendedprice")
    by = ["l_returnflag"]
    q = ranks.quantiles(rows, "l_extendedprice", [0.5, 0.9], by).groupBy(*by).agg(F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("median"), F.max(F.when(F.col("q") == 0.9, F.col("value"))).alias("p90"))
    m = rows.groupBy(*by).agg(F.avg(x).alias("mean"), F.avg((x > 50000).cast("double")).alias("above"), (F.sum(F.col("l_quantity") * x) / F.sum("l_quantity")).alias("weighted"))
    j = pinned(m.join(F.broadcast(q), by))
    ref = j.where("l_returnflag = 'R'").select(F.col("mean").alias("rm"), F.col("p90").alias("rp"))
    at = lambda c, n, k=6: F.round(c, k).alias(n)
    return j.crossJoin(F.broadcast(ref)).select(*by, at("mean", "mean"), at("median", "median"), at("p90", "p90"), at("above", "above", 10), at("weighted", "weighted"), at(F.col("mean") - F.col("rm"), "mean_delta"), at(F.col("p90") - F.col("rp"), "p90_delta"))


CANDIDATES = f"select candidate, round(avg(m), 10) as mean, round(stddev_samp(m) / sqrt(count(*)), 10) as error, round(max(m), 10) as guard, bool_and(m > 0) as converged from ({FOLDS}) group by 1"


def candidate_summary(t):
    at = lambda c, n: F.round(c, 10).alias(n)
    return folds(t).groupBy("candidate").agg(at(F.avg("m"), "mean"), at(F.stddev_samp("m") / F.sqrt(F.count("*")), "error"), at(F.max("m"), "guard"), F.bool_and(F.col("m") > 0).alias("converged"))


@query(f"""with s as ({CANDIDATES}), f as (select * from s where converged), b as (select max(mean) as bm, arg_max(guard, mean) as bg, max(mean) - arg_max(error, mean) as least from f)
select candidate, mean, mean >= 0.99 * bm and guard >= bg as within_tolerance, candidate = (select min(candidate) from f, b where mean >= 0.99 * bm and guard >= bg) as strongest,
 mean >= least as within_error, candidate = (select min(candidate) from f, b where mean >= least) as simplest from f, b""")
def f14_choices(t):
    """Which candidate two rules choose: the least one within 1 % of the best mean whose guard is no worse, and the least one within one standard error."""
    s = pinned(candidate_summary(t).where("converged"))
    chosen = selection.strongest_within(s, "candidate", "mean", "guard", "converged", 0.01).select(F.col("candidate").alias("strong"))
    best = s.agg(F.max("mean").alias("bm"), F.max_by("guard", "mean").alias("bg"))
    rows = selection.within_one_error(s, "candidate", "mean", "error").crossJoin(F.broadcast(best)).crossJoin(F.broadcast(chosen))
    close = (F.col("mean") >= 0.99 * F.col("bm")) & (F.col("guard") >= F.col("bg"))
    return rows.select("candidate", "mean", close.alias("within_tolerance"), (F.col("candidate") == F.col("strong")).alias("strongest"), F.col("eligible").alias("within_error"), F.col("chosen").alias("simplest"))


@query(f"""with f as ({FOLDS}), m as (select candidate, avg(m) as mean, stddev_samp(m) as std from f group by 1), d as (select a.candidate, a.m - b.m as d from f a join
  f b on a.fold = b.fold and b.candidate = 1),
w as (select candidate, count(*) filter (where d > 1e-12) as wins, count(*) filter (where abs(d) <= 1e-12) as ties, count(*) filter (where d < -1e-12) as losses,
  stddev_samp(d) as sd from d group by 1),
r as (select m.*, row_number() over (order by mean desc, m.candidate) as r from m)
select r.candidate, r as rank, round(mean, 10) as mean, round(std, 10) as std, round(mean - (select mean from m where candidate = 1), 10) as improvement, case when
  r.candidate = 1 then 0 else wins end as wins,
 case when r.candidate = 1 then 0 else ties end as ties, case when r.candidate = 1 then 0 else losses end as losses, round(case when r.candidate = 1 then 0 else sd end, 10) as paired_std,
 r.candidate <> 1 and (select count(*) from r k where k.r <= r.r and k.candidate <> 1) <= 3 as shortlisted from r join w using (candidate)""")
def f15_leaderboard(t):
    """Candidates by mean against candidate 1: paired fold results, and a shortlist of three."""
    at = lambda c: F.round(c, 10).alias(c)
    board = selection.leaderboard(folds(t), 1, 3)
    return board.select("candidate", F.col("rank").cast("long").alias("rank"), at("mean"), at("std"), at("improvement"), *(F.col(c).cast("long").alias(c) for c in ("wins", "ties", "losses")), at("paired_std"), "shortlisted")


SWEEP = [round(0.05 * i, 2) for i in range(1, 20)]


@query(f"""with p as (select l_discount * 10 as p, {R} as y from lineitem), s as (select {u(SWEEP)} as threshold),
c as (select threshold, count(*) filter (where p >= threshold and y = 1) as tp, count(*) filter (where p >= threshold and y = 0) as fp, count(*) filter (where p <
  threshold and y = 1) as fn, count(*) filter (where p < threshold and y = 0) as tn from p, s group by 1)
select cast(threshold as double) as threshold, round((tp + tn) / (tp + fp + fn + tn), 10) as accuracy, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn /
  nullif(tn + fp, 0), 0)) / 2, 10) as balanced_accuracy,
 round(coalesce(tp / nullif(tp + fp, 0), 0), 10) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 10) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 10) as f1 from c""")
def f16_threshold_sweep(t):
    """Accuracy, balanced accuracy, precision, recall and F1 at thresholds from 0.05 to 0.95."""
    rows = t("lineitem").select("l_discount", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    out = selection.threshold_sweep(rows, F.col("l_discount") * 10, "y", SWEEP)
    return out.select("threshold", *(F.round(c, 10).alias(c) for c in out.columns[1:]))


@query(f"""with q as (select quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) as q from lineitem),
p as (select l_linestatus, case when l_extendedprice <= q[1] then 0 when l_extendedprice <= q[2] then 1 when l_extendedprice <= q[3] then 2 when l_extendedprice <= q[4]
  then 3 else 4 end as fifth, (l_discount >= 0.05) = ({R} = 1) as a, (l_tax >= 0.04) = ({R} = 1) as b from lineitem, q),
s as (select 'price' as feature, cast(fifth as varchar) as slice, a, b from p union all select 'status', l_linestatus, a, b from p)
select feature, slice, count(*) as n_rows, round(avg(a::int), 10) as reference_accuracy, round(avg(b::int), 10) as candidate_accuracy, round(avg(b::int) - avg(a::int), 10) as delta,
 count(*) filter (where b and not a) as fixed, count(*) filter (where a and not b) as broken from s group by 1, 2 having count(*) >= 10""")
def f16_slices(t):
    """Two predictors compared on fifths of the price and on each status: accuracy, its change, fixed and broken rows; slices of ten rows or more."""
    rows = t("lineitem")
    cuts = [r["value"] for r in ranks.quantiles(rows, "l_extendedprice", [0.2, 0.4, 0.6, 0.8]).orderBy("q").collect()]
    y = F.col("l_returnflag") == "R"
    fifth = sc.bin_code_closed(F.col("l_extendedprice"), cuts).cast("string")
    pair = F.array(F.struct(F.lit("price").alias("feature"), fifth.alias("slice")), F.struct(F.lit("status").alias("feature"), F.col("l_linestatus").alias("slice")))
    s = rows.select(((F.col("l_discount") >= 0.05) == y).alias("a"), ((F.col("l_tax") >= 0.04) == y).alias("b"), F.explode(pair).alias("s"))
    share = lambda c: F.avg(F.col(c).cast("int"))
    return s.groupBy("s.feature", "s.slice").agg(
        F.count("*").alias("n_rows"), F.round(share("a"), 10).alias("reference_accuracy"), F.round(share("b"), 10).alias("candidate_accuracy"), F.round(share("b") - share("a"), 10).alias("delta"),
        F.count_if(F.col("b") & ~F.col("a")).alias("fixed"), F.count_if(F.col("a") & ~F.col("b")).alias("broken"),
    ).where("n_rows >= 10")


PAIRS = "select l_orderkey * 10 + l_linenumber as key, l_extendedprice as score, l_linenumber = 1 and l_returnflag = 'R' as target, l_returnflag <> 'R' as negative from lineitem"
BIN = "case when score >= e[1] and score < e[2] then 0 when score >= e[2] and score < e[3] then 1 when score >= e[3] and score < e[4] then 2 when score >= e[4] and score <= e[5] then 3 end"


@query(f"""with x as ({PAIRS}), q as (select quantile_cont(score, [0, 0.25, 0.5, 0.75, 1.0]) as e from x where target),
need as (select {BIN} as bin, count(*) * 3 as need from x, q where target group by 1), h as (select key, {BIN} as bin from x, q where negative and {BIN} is not null),
r as (select bin, key, row_number() over (partition by bin order by {md5("key", "match")}, key) as r, count(*) over (partition by bin) as have from h)
select cast(bin as int) as bin, key, cast(unnest(range(1, cast(greatest(1, ceil((need - r + 1) / have)) as bigint) + 1)) as int) as copy from r join need using (bin) where r <= need""")
def g7_matched_negatives(t):
    """Three negatives a target in each quarter of the targets' scores; too few repeat."""
    x = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.col("l_extendedprice").alias("score"), "l_linenumber", "l_returnflag")
    return selection.matched_negatives(x.where("l_linenumber = 1 and l_returnflag = 'R'"), x.where("l_returnflag <> 'R'"), "score", "key", 3, 4, "match")


@query("""select o_orderpriority, count(o_totalprice) as n, count(*) - count(o_totalprice) as missing, round(avg(case when o_orderstatus = 'F' then 1.0 else 0 end), 10) as estimate, 'rate' as kind from orders group by 1""")
def e17_group_rates(t):
    """The rate of finished orders by priority; e17_group_intervals adds bootstrap intervals, which are random and have no SQL."""
    rows = t("orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return resampling.group_means(rows, "o_orderpriority", "y").withColumn("estimate", F.round("estimate", 10))


@query()
def e17_group_intervals(t):
    """Mean price by priority with percentile intervals of 200 bootstrap replicates, whose weights follow from the order's key."""
    return resampling.group_intervals(t("orders"), "o_orderpriority", "o_totalprice", ["o_orderkey"])


SUPPLIER_AP = """with l as (select l_suppkey, m, case when m = 'a' then round(l_extendedprice) else l_quantity end as score, count(*) as total, sum(case when
  l_returnflag = 'R' then 1 else 0 end) as positive from lineitem, (values ('a'), ('b')) k(m) group by 1, 2, 3),
c as (select *, sum(total) over (partition by l_suppkey, m order by score desc) as ct, sum(positive) over (partition by l_suppkey, m order by score desc) as cp from l),
ap as (select l_suppkey, m, round(coalesce(sum(positive * cp / ct) / nullif(sum(positive), 0), 0), 10) as ap from c group by 1, 2), d as (select l_suppkey, max(ap)
  filter (where m = 'a') - max(ap) filter (where m = 'b') as d from ap group by 1)"""
POISSON = "case " + " ".join(f"when u < {c!r} then {k}" for k, c in enumerate(resampling.poisson_cuts(12))) + " else 12 end"


@query(f"""{SUPPLIER_AP}, w as (select r, d, {uniform("l_suppkey || ':' || r", "pairs")} as u from d, range(0, 200) k(r)), m as (select r, sum({POISSON} * d) /
  nullif(sum({POISSON}), 0) as m from w group by 1)
select (select count(*) from d) as n_groups, (select count(*) from d where d > 0) as improved, round((select avg(d) from d), 8) as mean_difference,
  round(quantile_cont(m, 0.025), 8) as low, round(quantile_cont(m, 0.975), 8) as high from m where m is not null""")
def e23_paired_bootstrap(t):
    """AP by price less AP by quantity of each supplier, and the interval of its mean over 200 draws of suppliers."""
    rows = scored(t)
    of = lambda c, name: metrics.average_precision(metrics.score_levels(rows, c, "y", ["l_suppkey"]), ["l_suppkey"]).select("l_suppkey", F.round("ap", 10).alias(name))
    table = pinned(of("score", "a").join(of("l_quantity", "b"), "l_suppkey"))
    out = resampling.paired_differences(table, "l_suppkey", "a", "b")
    return out.select("n_groups", "improved", *(F.round(c, 8).alias(c) for c in ("mean_difference", "low", "high")))


GATED = "select l_linenumber as candidate, cast(l_suppkey % 5 as bigint) as fold, avg(l_discount) as m, avg(l_tax) as guard from lineitem group by 1, 2"


@query(f"""with f as ({GATED}), k as (select candidate, avg(m) as m, avg(guard) as g from f group by 1), b as (select * from k where candidate in (2, 3) order by m desc, candidate limit 1),
w as (select count(*) filter (where x.m > y.m) as won from f x join f y using (fold) where x.candidate = 4 and y.candidate = (select candidate from b)), c as (select * from k where candidate = 4), r as (select * from k where candidate = 1)
select 'gain' as check_name, c.m / b.m - 1 >= 0.01 as passed from c, b union all select 'wins', won >= 2 from w union all select 'guard against single', c.g >= b.g from c, b
union all select 'guard against reference', c.g >= r.g from c, r union all select 'converged', true""")
def f14_gate(t):
    """Whether candidate 4 passes a gate against the better of candidates 2 and 3 and against candidate 1."""
    f = t("lineitem").groupBy(F.col("l_linenumber").alias("candidate"), (F.col("l_suppkey") % 5).alias("fold"))
    f = pinned(f.agg(F.avg("l_discount").alias("m"), F.avg("l_tax").alias("guard")).withColumn("converged", F.lit(True)))
    return selection.gate(f, 1, [2, 3], 4)
