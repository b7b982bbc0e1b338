"""Region, segment and matching queries; events are the positions, event types the contigs, hours the coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, ranks
from .registry import query

WIDTHS = (1, 2, 4, 8, 16, 32, 64, 128)
REMOVED = (0.0, 0.25, 0.5, 0.75, 1.0)
RECALLS = (0.5, 0.8, 0.9, 0.95)
REGION = 32

EVENTS = "select event_type as contig, event_id, cast(floor(epoch(ts) / 3600) as bigint) as pos, cast(event_id * 7919 % 1009 as bigint) as score, case when value > 50 then 1 else 0 end as y from events"
REGIONS = f"select contig, cast(floor(pos / {REGION}) as bigint) as region, max(score) as risk, max(y) as active from ({EVENTS}) group by 1, 2"


def listed(values, name):
    return f"(select unnest([{', '.join(map(str, values))}]) as {name})"


def positions(t):
    hour = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour("ts")
    return t("events").select(F.col("event_type").alias("contig"), "event_id", hour.alias("pos"), (F.col("event_id") * 7919 % 1009).alias("score"), F.when(F.col("value") > 50, 1).otherwise(0).alias("y"))


def regions(t):
    return positions(t).groupBy("contig", F.floor(F.col("pos") / REGION).alias("region")).agg(F.max("score").alias("risk"), F.max("y").alias("active"))


AP = "round(coalesce(sum(positive * cp / ct) / nullif(sum(positive), 0), 0), 10) as ap"


def running(by):
    return f"sum(total) over (partition by {by} order by score desc) as ct, sum(positive) over (partition by {by} order by score desc) as cp"


@query(f"""with x as (select w as width, contig, floor(pos / w) as r, score, y from ({EVENTS}), {listed(WIDTHS, "w")}), a as (select width, contig, r, max(y) as act from x group by 1, 2, 3),
g as (select width, case when act = 1 then score else 0 end as score, y, act from x join a using (width, contig, r)), l as (select width, score, count(*) as total,
  sum(y) as positive, sum(case when act = 1 then 1 - y else 0 end) as kept from g group by 1, 2),
c as (select *, {running("width")} from l) select cast(width as bigint) as width, {AP}, cast(sum(kept) as bigint) as kept_negatives from c group by 1""")
def f11_oracle_gate(t):
    """Scores outside regions with a positive become 0, for each region width. Positions are counted per region and score before the widths multiply them."""
    base = positions(t).groupBy("contig", "pos", "score").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    x = base.withColumn("width", F.explode(F.array(*[F.lit(w).cast("long") for w in WIDTHS]))).withColumn("r", F.floor(F.col("pos") / F.col("width")))
    active = x.groupBy("width", "contig", "r").agg((F.max("p") > 0).alias("act"))
    g = x.join(active, ["width", "contig", "r"]).withColumn("score", F.when(F.col("act"), F.col("score")).otherwise(0))
    levels = g.groupBy("width", "score").agg(F.sum("n").alias("total"), F.sum("p").alias("positive"), F.sum(F.when(F.col("act"), F.col("n") - F.col("p")).otherwise(0)).alias("kept"))
    kept = levels.groupBy("width").agg(F.sum("kept").alias("kept_negatives"))
    return metrics.average_precision(levels.drop("kept"), ["width"]).join(kept, "width").select("width", F.round("ap", 10).alias("ap"), "kept_negatives")


@query(f"""with e as (select contig, region, row_number() over (order by risk, contig, region) as r, count(*) over () as n from ({REGIONS}) where active = 0),
x as (select f, case when e.r <= floor(f * n) then 0 else score end as score, y from ({EVENTS}) p left join e on e.contig = p.contig and e.region = floor(p.pos / {REGION}), {listed(REMOVED, "f")}),
l as (select f, score, count(*) as total, sum(y) as positive from x group by 1, 2), c as (select *, {running("f")} from l), a as (select cast(f as double) as fraction, {AP} from c group by 1),
b as (select ap as base from a where fraction = 0)
select fraction, ap, coalesce(fraction = (select min(fraction) from a, b where ap >= 1.2 * base), false) as first_crossing from a""")
def f12_suppression_frontier(t):
    """Empty regions lose their scores from the lowest risk on, in growing shares; the first share whose precision is 1.2 times the start is marked."""
    empty = regions(t).where("active = 0").select("contig", "region", "risk")
    ranked = ranks.row_numbers(empty, [F.asc("risk"), F.asc("contig"), F.asc("region")], "r").drop("risk").crossJoin(F.broadcast(empty.agg(F.count("*").alias("n"))))
    p = positions(t).withColumn("region", F.floor(F.col("pos") / REGION)).join(ranked, ["contig", "region"], "left")
    p = p.groupBy("score", "r", "n").agg(F.count("*").alias("total"), F.sum("y").alias("positive")).withColumn("fraction", F.explode(F.array(*map(F.lit, REMOVED))))
    score = F.when(F.col("r") <= F.floor(F.col("fraction") * F.col("n")), 0).otherwise(F.col("score"))
    levels = p.groupBy("fraction", score.alias("score")).agg(F.sum("total").alias("total"), F.sum("positive").alias("positive"))
    a = metrics.average_precision(levels, ["fraction"]).select("fraction", F.round("ap", 10).alias("ap"))
    marks = a.agg(F.collect_list(F.struct("fraction", "ap")).alias("m"))  # one element a listed share
    base = F.filter("m", lambda x: x["fraction"] == 0)[0]["ap"]
    first = F.array_min(F.transform(F.filter("m", lambda x: x["ap"] >= 1.2 * base), lambda x: x["fraction"]))
    return a.crossJoin(F.broadcast(marks)).select("fraction", "ap", F.coalesce(F.col("fraction") == first, F.lit(False)).alias("first_crossing"))


@query(f"""with g as ({REGIONS}), o as (select risk, row_number() over (order by risk, contig, region) - 1 as i, count(*) over () as n from g where active = 1),
h as (select q, risk as threshold from o, {listed(RECALLS, "q")} where i = floor(round((1 - q) * n, 6)))
select cast(q as double) as target, contig, threshold, round(avg(case when active = 1 then cast(risk >= threshold as int) end), 10) as recall, round(avg(case when active
  = 0 then cast(risk < threshold as int) end), 10) as suppressed from g, h group by 1, 2, 3""")
def f17_recall_thresholds(t):
    """The order statistic of active regions that keeps a target recall, and what it suppresses among empty ones, per contig."""
    g = regions(t)
    active = g.where("active = 1")
    o = ranks.row_numbers(active, [F.asc("risk"), F.asc("contig"), F.asc("region")], "i")
    at = active.agg(F.count("*").alias("n")).withColumn("target", F.explode(F.array(*map(F.lit, RECALLS)))).select("target", (F.floor(F.round((1 - F.col("target")) * F.col("n"), 6)) + 1).alias("i"))
    thresholds = o.join(F.broadcast(at), "i").select("target", F.col("risk").alias("threshold"))
    x = g.groupBy("contig", "risk", "active").agg(F.count("*").alias("n")).crossJoin(F.broadcast(thresholds))
    share = lambda kind, keep: F.round(F.sum(F.when((F.col("active") == kind) & keep, F.col("n")).otherwise(0)) / F.nullif(F.sum(F.when(F.col("active") == kind, F.col("n")).otherwise(0)), F.lit(0)), 10)
    return x.groupBy("target", "contig", "threshold").agg(share(1, F.col("risk") >= F.col("threshold")).alias("recall"), share(0, F.col("risk") < F.col("threshold")).alias("suppressed"))


@query("""with r as (select l_linestatus as segment, l_quantity as k, count(*) as total, sum(case when l_returnflag = 'R' then 1 else 0 end) as positive from lineitem group by 1, 2),
s as (select k, (sum(positive) + 1.0) / (sum(total) + 2.0) as score from r group by 1), j as (select segment, score, total, positive from r join s using (k)), l as
  (select segment, score, sum(total) as total, sum(positive) as positive from j group by 1, 2),
c as (select *, sum(total) over (partition by segment order by score desc) as ct, sum(positive) over (partition by segment order by score desc) as cp from l)
select segment, count(*) as n_levels, cast(sum(total) as bigint) as total, cast(sum(positive) as bigint) as positive, round(sum(positive) / sum(total), 10) as
  constant_ap, round(sum(positive * cp / ct) / sum(positive), 10) as ap,
round(-sum(positive * ln(score) + (total - positive) * ln(1 - score)) / sum(total), 10) as log_loss,
round((-sum(positive * ln(score)) / sum(positive) - sum((total - positive) * ln(1 - score)) / sum(total - positive)) / 2, 10) as balanced_log_loss from c group by 1""")
def f5_segment_metrics(t):
    rows = t("lineitem").groupBy(F.col("l_linestatus").alias("segment"), F.col("l_quantity").alias("k")).agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("positive"))
    scores = rows.groupBy("k").agg(((F.sum("positive") + 1.0) / (F.sum("total") + 2.0)).alias("score"))
    levels = rows.join(scores, "k").groupBy("segment", "score").agg(F.sum("total").alias("total"), F.sum("positive").alias("positive"))
    c = ranks.cumulative(levels, [F.desc("score")], {"ct": F.col("total"), "cp": F.col("positive")}, ["segment"])
    p, q, n = F.col("positive"), F.col("total") - F.col("positive"), F.sum("total")
    one, zero = -F.sum(p * F.ln("score")), -F.sum(q * F.ln(1 - F.col("score")))
    return c.groupBy("segment").agg(
        F.count("*").alias("n_levels"), n.alias("total"), F.sum(p).alias("positive"), F.round(F.sum(p) / n, 10).alias("constant_ap"), F.round(F.sum(p * F.col("cp") / F.col("ct")) / F.sum(p), 10).alias("ap"),
        F.round((one + zero) / n, 10).alias("log_loss"), F.round((one / F.sum(p) + zero / F.sum(q)) / 2, 10).alias("balanced_log_loss"),
    )


@query("""with r as (select event_type as stratum, event_id, row_number() over (partition by event_type order by md5(concat(cast(event_id as varchar), ':countloom')), event_id) as r from events)
select stratum, event_id from r where r <= 20""")
def f7_smallest_hashes(t):
    """A repeatable sample: the 20 smallest keyed hashes of each stratum; Spark cuts each task to 20 before the shuffle."""
    from pyspark.sql import Window as W

    order = W.partitionBy("stratum").orderBy(F.md5(F.concat(F.col("event_id").cast("string"), F.lit(":countloom")).cast("binary")), "event_id")
    rows = t("events").select(F.col("event_type").alias("stratum"), "event_id").withColumn("r", F.row_number().over(order))
    return rows.where("r <= 20").select("stratum", "event_id")


@query("""with r as (select case when l_quantity > 40 then 4 when l_quantity > 25 then 3 when l_quantity > 10 then 2 when l_quantity > 5 then 1 else 0 end as bin,
  l_extendedprice as x from lineitem where l_quantity is not null and l_extendedprice is not null)
select bin, count(*) as n, round(avg(case when x > 30000 then 1 else 0 end), 10) as capture_rate, round(median(x), 6) as median_price, round(count(*) / (select count(*)
  from r), 10) as share from r group by 1""")
def e21_binned_capture(t):
    """Right-closed bins; medians from two-level ranks, so no task holds a bin."""
    q, x = F.col("l_quantity"), F.col("l_extendedprice")
    rows = t("lineitem").where(q.isNotNull() & x.isNotNull()).select(F.when(q > 40, 4).when(q > 25, 3).when(q > 10, 2).when(q > 5, 1).otherwise(0).alias("bin"), x.alias("x"), "l_orderkey", "l_linenumber")
    size = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg((F.col("x") > 30000).cast("int")).alias("capture_rate"))
    whole = rows.agg(F.count("*").alias("whole"))
    ranked = ranks.row_numbers(rows, [F.asc("x"), F.asc("l_orderkey"), F.asc("l_linenumber")], "r", ["bin"]).join(F.broadcast(size), "bin")
    middle = ranked.where((F.col("r") == F.floor((F.col("n") + 1) / 2)) | (F.col("r") == F.ceil((F.col("n") + 1) / 2))).groupBy("bin").agg(F.avg("x").alias("median"))
    return size.join(middle, "bin").crossJoin(F.broadcast(whole)).select("bin", "n", F.round("capture_rate", 10).alias("capture_rate"), F.round("median", 6).alias("median_price"), F.round(F.col("n") / F.col("whole"), 10).alias("share"))


@query(f"""with p as (select user_id, cast(floor(epoch(ts) / 3600) as bigint) as pos, case when event_type = 'click' then 0::bigint else 1::bigint end as strand from events)
select (user_id << 33) + (strand << 32) + pos // {REGION} as region_key, cast(bit_or(1::bigint << (pos % {REGION})) as bigint) as mask, cast(bit_count(bit_or(1::bigint
  << (pos % {REGION}))) as bigint) as n_positions from p group by 1""")
def d15_region_masks(t):
    """Packed region keys and a bit for each position of the region that is seen."""
    pos = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour("ts")
    p = t("events").select("user_id", pos.alias("pos"), F.when(F.col("event_type") == "click", 0).otherwise(1).cast("long").alias("strand"))
    key = F.shiftleft("user_id", 33) + F.shiftleft("strand", 32) + F.floor(F.col("pos") / REGION)
    bits = p.groupBy(key.alias("region_key")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pos % {REGION} as int))")).alias("mask"))
    return bits.select("region_key", "mask", F.bit_count("mask").cast("long").alias("n_positions"))


PAIRS = "select l_orderkey * 10 + l_linenumber as key, l_returnflag as cohort, ((l_orderkey * 7919 + l_linenumber * 104729) % 997 + 0.5) / 998.0 as p from lineitem where l_returnflag in ('R', 'N')"


@query(f"""with b as (select key, cohort, p, cast(floor(ln(p / (1 - p)) / 0.25) as bigint) as bin from ({PAIRS})), n as (select bin, least(count(*) filter (where cohort
  = 'R'), count(*) filter (where cohort = 'N')) as n from b group by 1),
d as (select b.*, n, row_number() over (partition by bin, cohort order by md5(cast(key as varchar)), key) as r from b join n using (bin)),
s as (select bin, cohort, key, p, row_number() over (partition by bin, cohort order by p, key) as pair from d where r <= n)
select a.bin as bin, a.pair as pair, a.key as first_key, b.key as second_key, round(abs(a.p - b.p), 10) as distance from s a join s b on a.bin = b.bin and a.pair =
  b.pair and a.cohort = 'R' and b.cohort = 'N'""")
def c11_logit_matches(t):
    """Equal draws from both cohorts in each logit bin by smallest hash, paired by score rank. Ranks are two-level, so a hot bin is not one task."""
    p = ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 997 + 0.5) / 998.0
    rows = t("lineitem").where("l_returnflag in ('R', 'N')").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.col("l_returnflag").alias("cohort"), p.alias("p"))
    b = rows.withColumn("bin", F.floor(F.ln(F.col("p") / (1 - F.col("p"))) / 0.25)).withColumn("hash", F.md5(F.col("key").cast("string").cast("binary")))
    n = b.groupBy("bin").agg(F.least(F.count_if(F.col("cohort") == "R"), F.count_if(F.col("cohort") == "N")).alias("n"))
    drawn = ranks.row_numbers(b, [F.asc("hash"), F.asc("key")], "r", ["bin", "cohort"]).join(n, "bin").where("r <= n").select("bin", "cohort", "key", "p")
    s = ranks.row_numbers(drawn, [F.asc("p"), F.asc("key")], "pair", ["bin", "cohort"])
    side = lambda c, k, q: s.where(F.col("cohort") == c).select("bin", "pair", F.col("key").alias(k), F.col("p").alias(q))
    both = side("R", "first_key", "p1").join(side("N", "second_key", "p2"), ["bin", "pair"])
    return both.select("bin", "pair", "first_key", "second_key", F.round(F.abs(F.col("p1") - F.col("p2")), 10).alias("distance"))


@query("""with g as (select source, lang, regexp_replace(text, '[^A-Z]', '', 'g') as u, regexp_replace(text, '[^a-z]', '', 'g') as l, text from documents)
select source, lang, cast(sum(length(u)) as bigint) as upper_letters, cast(sum(length(l)) as bigint) as lower_letters, cast(sum(length(text) - length(u) - length(l)) as
  bigint) as others from g group by grouping sets ((source), (lang), ())""")
def e8_segment_letters(t):
    """Letter case by source, by language and in all, from one pass."""
    n = lambda pattern: F.length(F.regexp_replace("text", pattern, ""))
    rows = t("documents").select("source", "lang", n("[^A-Z]").alias("u"), n("[^a-z]").alias("l"), F.length("text").alias("n"))
    sets = rows.groupingSets([["source"], ["lang"], []], "source", "lang")
    return sets.agg(F.sum("u").alias("upper_letters"), F.sum("l").alias("lower_letters"), F.sum(F.col("n") - F.col("u") - F.col("l")).alias("others"))
