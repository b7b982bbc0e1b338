"""Matching quality, seeded suppression, thresholds by stratum, localisation of captured regions, replicate files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import matching, metrics, ranks, selection
from ..operators.pins import pinned
from .regions import AP, EVENTS, PAIRS, RECALLS, REGION, REGIONS, REMOVED, listed, positions, regions, running
from .registry import query
from .selections import uniform

WIDTHS = [0.1, 0.25, 0.5, 1.0]


@query(f"""with b as (select w as width, key, cohort, p, cast(floor(ln(p / (1 - p)) / w) as bigint) as bin from ({PAIRS}), {listed([f"{w}::double" for w in WIDTHS], "w")}),
n as (select width, bin, least(count(*) filter (where cohort = 'R'), count(*) filter (where cohort = 'N')) as n from b group by 1, 2),
d as (select b.*, n, row_number() over (partition by width, bin, cohort order by md5(cast(key as varchar)), key) as r from b join n using (width, bin)),
s as (select width, bin, cohort, key, p, row_number() over (partition by width, bin, cohort order by p, key) as pair from d where r <= n),
m as (select a.width, a.bin, a.p as p1, b.p as p2, abs(a.p - b.p) as d from s a join s b on a.width = b.width and a.bin = b.bin and a.pair = b.pair and a.cohort = 'R' and b.cohort = 'N'),
z as (select count(*) filter (where cohort = 'R') as n1, count(*) filter (where cohort = 'N') as n2 from ({PAIRS}))
select width, count(distinct bin) as bins, count(*) as pairs, round(count(*) / max(n1), 10) as share_first, round(count(*) / max(n2), 10) as share_second, round(avg(d), 10) as mean_distance,
  round(quantile_cont(d, 0.5), 10) as median_distance, round(max(d), 10) as largest_distance, round((avg(p1) - avg(p2)) / sqrt((var_samp(p1) + var_samp(p2)) / 2), 8) as standardised_difference from m, z group by 1""")
def c11_match_quality(t):
    """How many pairs four bin widths leave, and how like they are."""
    p = ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 997 + 0.5) / 998.0
    rows = t("lineitem").where("l_returnflag in ('R', 'N')").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.col("l_returnflag").alias("cohort"), p.alias("p"))
    sizes = rows.agg(F.count_if(F.col("cohort") == "R").alias("n_first"), F.count_if(F.col("cohort") == "N").alias("n_second"))
    out = matching.pair_quality(matching.logit_pair_counts(rows, "key", "cohort", "p", "R", "N", WIDTHS), sizes)
    return out.select("width", "bins", "pairs", *(F.round(c, 8 if c.startswith("standard") else 10).alias(c) for c in out.columns[3:]))


LOST = (0.0, 0.25, 0.5)
SEEDED = uniform("contig || ':' || region", "lost")


@query(f"""with g as (select * from ({REGIONS})), e as (select contig, region, row_number() over (order by risk, contig, region) as r, count(*) over () as n from g where active = 0),
a as (select contig, region, {SEEDED} as u from g where active = 1),
x as (select f, lost, case when e.r <= floor(f * n) or a.u < lost then 0 else score end as score, y from ({EVENTS}) p left join e on e.contig = p.contig and e.region = floor(p.pos / {REGION})
  left join a on a.contig = p.contig and a.region = floor(p.pos / {REGION}), {listed(REMOVED, "f")}, {listed(LOST, "lost")}),
l as (select f, lost, score, count(*) as total, sum(y) as positive from x group by 1, 2, 3), c as (select *, {running("f, lost")} from l)
select cast(f as double) as fraction, cast(lost as double) as lost, {AP} from c group by 1, 2""")
def f12_seeded_frontier(t):
    """The suppression frontier where a seeded share of the active regions loses its scores, too: the precision of each mix."""
    g = pinned(regions(t))
    empty = g.where("active = 0").select("contig", "region", "risk")
    ranked = ranks.row_numbers(empty, [F.asc("risk"), F.asc("contig"), F.asc("region")], "r").drop("risk").crossJoin(F.broadcast(empty.agg(F.count("*").alias("n"))))
    active = g.where("active = 1").select("contig", "region", sc.keyed_uniform(F.concat_ws(":", "contig", "region"), "lost").alias("u"))
    p = positions(t).withColumn("region", F.floor(F.col("pos") / REGION)).join(ranked, ["contig", "region"], "left").join(active, ["contig", "region"], "left")
    p = p.groupBy("score", "r", "n", "u").agg(F.count("*").alias("total"), F.sum("y").alias("positive"))
    p = selection.listed(selection.listed(p, list(REMOVED), "fraction"), list(LOST), "lost")
    gone = (F.col("r") <= F.floor(F.col("fraction") * F.col("n"))) | (F.col("u") < F.col("lost"))
    levels = p.groupBy("fraction", "lost", F.when(gone, 0).otherwise(F.col("score")).alias("score")).agg(F.sum("total").alias("total"), F.sum("positive").alias("positive"))
    return metrics.average_precision(levels, ["fraction", "lost"]).select("fraction", "lost", F.round("ap", 10).alias("ap"))


@query(f"""with g as (select *, contig || ':' || region as key from (select contig, cast(floor(pos / {REGION}) as bigint) as region, max(score) as risk, max(y) as active, sum(score) as danger from ({EVENTS}) group by 1, 2)),
e as (select *, row_number() over (order by danger desc, key) as r, count(*) over () as n from g where active = 0),
s as (select key, case when r <= ceil(0.01 * n) then '0_1' when r <= ceil(0.05 * n) then '1_5' when r <= ceil(0.15 * n) then '5_15' else '15_100' end as stratum from e union all select key, 'ACTIVE' from g where active = 1),
o as (select risk, row_number() over (order by risk, key) - 1 as i, count(*) over () as n from g where active = 1),
h as (select q, risk as threshold from o, {listed(RECALLS, "q")} where i = floor(round((1 - q) * n, 6)))
select cast(q as double) as target, stratum, threshold, count(*) as n_regions, round(avg(case when risk >= threshold then 1 else 0 end), 10) as kept, round(avg(case when risk < threshold then 1 else 0 end), 10) as suppressed
from g join s using (key), h group by 1, 2, 3""")
def f17_stratum_thresholds(t):
    """What the thresholds that keep target recalls of the active regions keep and suppress in each stratum of danger among the empty ones."""
    g = positions(t).groupBy("contig", F.floor(F.col("pos") / REGION).alias("region")).agg(F.max("score").alias("risk"), F.max("y").alias("active"), F.sum("score").alias("danger"))
    g = pinned(g.withColumn("key", F.concat_ws(":", "contig", "region")).withColumn("on", F.col("active") == 1))
    strata = selection.risk_strata(g, "danger", "key", "on")
    active = g.where("on")
    o = ranks.row_numbers(active.select("risk", "key"), [F.asc("risk"), F.asc("key")], "i")
    at = selection.listed(active.agg(F.count("*").alias("n")), list(RECALLS), "target").select("target", (F.floor(F.round((1 - F.col("target")) * F.col("n"), 6)) + 1).alias("i"))
    thresholds = o.join(F.broadcast(at), "i").select("target", F.col("risk").alias("threshold"))  # a row a target
    rows = strata.groupBy("stratum", "risk").agg(F.count("*").alias("n")).crossJoin(F.broadcast(thresholds))
    share = lambda keep: F.round(F.sum(F.when(keep, F.col("n")).otherwise(0)) / F.sum("n"), 10)
    return rows.groupBy("target", "stratum", "threshold").agg(F.sum("n").alias("n_regions"), share(F.col("risk") >= F.col("threshold")).alias("kept"), share(F.col("risk") < F.col("threshold")).alias("suppressed"))


@query(f"""with p as (select contig, cast(floor(pos / {REGION}) as bigint) as region, pos % {REGION} as place, event_id, score, y from ({EVENTS})),
g as (select contig, region, max(score) as score, sum(y) as n_positive, min(abs(place - {REGION // 2})) filter (where y = 1) as closest,
  arg_max(place, score * 1000000000 - event_id) filter (where y = 1) as dominant from p group by 1, 2 having sum(y) > 0),
r as (select *, row_number() over (order by score desc, contig, region) <= ceil(0.1 * count(*) over ()) as captured from g)
select captured, count(*) as n_regions, cast(quantile_cont(score, 0.5) as double) as median_score, cast(quantile_cont(n_positive, 0.5) as double) as median_positives, cast(quantile_cont(closest, 0.5) as double) as median_closest,
  cast(quantile_cont(least(dominant, {REGION} - 1 - dominant), 0.5) as double) as median_edge_distance, cast(quantile_cont(dominant - {REGION // 2}, 0.5) as double) as median_offset from r group by 1""")
def e21_localisation(t):
    """Regions with positives, the best tenth by score against the others: medians of the score, of the number of positives, of the distance of the one closest to the centre,
    and of where the dominant one (the highest score, then the smallest number) stands."""
    p = positions(t).withColumn("region", F.floor(F.col("pos") / REGION)).withColumn("at", F.col("pos") % REGION)
    one = F.col("y") == 1
    g = p.groupBy("contig", "region").agg(
        F.max("score").alias("score"), F.sum("y").alias("n_positive"), F.min(F.when(one, F.abs(F.col("at") - REGION // 2))).alias("closest"),
        F.max_by(F.col("at"), F.when(one, F.col("score") * 1000000000 - F.col("event_id"))).alias("dominant"),
    ).where("n_positive > 0")
    g = pinned(g.withColumns({"edge": F.least("dominant", REGION - 1 - F.col("dominant")), "offset": F.col("dominant") - REGION // 2}))
    n = g.agg(F.count("*").alias("n"))
    rows = ranks.row_numbers(g, [F.desc("score"), F.asc("contig"), F.asc("region")], "r").crossJoin(F.broadcast(n)).withColumn("captured", F.col("r") <= F.ceil(F.lit(0.1) * F.col("n")))
    rows = pinned(rows)
    out = rows.groupBy("captured").agg(F.count("*").alias("n_regions"))
    for c, name in {"score": "median_score", "n_positive": "median_positives", "closest": "median_closest", "edge": "median_edge_distance", "offset": "median_offset"}.items():
        out = out.join(ranks.quantiles(rows, c, [0.5], ["captured"]).select("captured", F.col("value").cast("double").alias(name)), "captured")
    return out
