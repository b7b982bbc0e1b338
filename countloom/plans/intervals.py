"""Interval, join and check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from .registry import query

DAY = "date_diff('day', date '1970-01-01', cast(o_orderdate as date))"


def order_days(t):
    return t("orders").select(F.col("o_custkey").alias("contig"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("pos"), "o_orderkey", "o_totalprice")


def customer_spans(t):
    return order_days(t).groupBy("contig").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))


SPANS = f"select o_custkey as contig, cast(min({DAY}) as bigint) as start, cast(max({DAY}) + 1 as bigint) as \"end\" from orders group by 1"
POINTS = f"select o_custkey as contig, cast({DAY} as bigint) as pos, o_orderkey, o_totalprice from orders"


@query("select doc_id as contig, cast(coalesce(length(text), 0) as bigint) as length from documents")
def a2_contig_lengths(t):
    """Lengths of the texts as contigs; an id that occurs twice is an error."""
    return iv.checked_lengths(t("documents").select(F.col("doc_id").alias("contig"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("length")), least=0)


@query(f'with s as ({SPANS}) select contig, start, "end" - start as length, cast(sum("end" - start) over (order by contig) - ("end" - start) as bigint) as whitelist_offset from s')
def a3_interval_offsets(t):
    return iv.with_offsets(customer_spans(t), [F.col("contig")]).select("contig", "start", "length", F.col("offset").alias("whitelist_offset"))


@query(f"""with s as ({SPANS}), b as (select s.*, k.strand from s, (values ('+'), ('-')) k(strand))
select contig, strand, start, cast(sum("end" - start) over (order by strand, contig) - ("end" - start) as bigint) as template_start,
  cast(sum("end" - start) over (order by strand, contig) as bigint) as template_stop from b""")
def a4_template(t):
    return iv.template(customer_spans(t), ["contig"]).select("contig", "strand", "start", "template_start", "template_stop")


@query(f"""with p as ({POINTS}), i as (select contig, pos as start, pos + 20 as "end" from p),
l as (select *, lag("end") over (partition by contig order by start, "end") as b from i)
select contig, count(*) filter (where start < 0 or "end" <= start) as bad_bounds, count(*) filter (where b > start) as overlaps from l group by contig""")
def b1_interval_checks(t):
    return iv.violations(order_days(t).select("contig", F.col("pos").alias("start"), (F.col("pos") + 20).alias("end")))


@query("""with g as (select o_custkey % 2 as split, o_custkey, count(*) as n from orders group by 1, 2)
select split, count(*) as groups, cast(sum(n) as bigint) as n_rows, (select count(*) from (select o_custkey from g group by 1 having count(distinct split) > 1)) as in_both from g group by split""")
def b3_split_checks(t):
    g = t("orders").groupBy((F.col("o_custkey") % 2).alias("split"), "o_custkey").agg(F.count("*").alias("n"))
    both = g.groupBy("o_custkey").agg(F.countDistinct("split").alias("s")).agg(F.count_if(F.col("s") > 1).alias("in_both"))
    return g.groupBy("split").agg(F.count("*").alias("groups"), F.sum("n").alias("n_rows")).crossJoin(F.broadcast(both))


@query("select count(*) as n, count(*) filter (where quality is null) as null_target, count(*) filter (where quality = 1) as ones, count(*) filter (where quality = 0) as zeros, count(distinct doc_id) as ids from labels")
def b6_prepare_rows(t):
    return t("labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull()).alias("null_target"), F.count_if(F.col("quality") == 1).alias("ones"), F.count_if(F.col("quality") == 0).alias("zeros"), F.countDistinct("doc_id").alias("ids"))


def _events(t, kind):
    return t("events").where(F.col("event_type") == kind)


@query("""with a as (select user_id, count(*) as n from events where event_type = 'purchase' group by 1), b as (select user_id, count(*) as n from events where event_type = 'view' group by 1)
select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.n, 0) as r1, coalesce(b.n, 0) as r2, coalesce(a.n, 0) + coalesce(b.n, 0) as count,
  cast(coalesce(a.n, 0) + coalesce(b.n, 0) > 0 as int) as target from a full join b on a.user_id = b.user_id""")
def c1_pool_replicates(t):
    one, two = (_events(t, k).groupBy("user_id").count() for k in ("purchase", "view"))
    return iv.pooled(one, two, ["user_id"])


MONTHS = "select distinct contig, pos // 60 * 60 as start, pos // 60 * 60 + 30 as \"end\" from p"


@query(f'with p as ({POINTS}), i as ({MONTHS}) select o_orderkey, p.contig, pos, start from p join i on p.contig = i.contig and start <= pos and pos < "end"')
def c2_containment(t):
    p = order_days(t)
    slots = p.select("contig", (F.floor(F.col("pos") / 60) * 60).alias("start")).distinct().withColumn("end", F.col("start") + 30)
    return iv.contained(p, slots, 30).select("o_orderkey", "contig", "pos", "start")


@query(f"""with s as ({SPANS}), o as (select *, sum("end" - start) over (order by contig) - ("end" - start) as off from s), p as ({POINTS})
select o_orderkey, cast(off + pos - start as bigint) as template_index from p join o using (contig)""")
def c3_linear_index(t):
    spans = iv.with_offsets(customer_spans(t), [F.col("contig")])
    return iv.contained(order_days(t), spans, 512).select("o_orderkey", (F.col("offset") + F.col("pos") - F.col("start")).alias("template_index"))


@query("""select l_suppkey, count(*) as total, cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as bigint) as positive from lineitem group by 1""")
def c4_population_join(t):
    rows = t("lineitem")
    total = rows.groupBy("l_suppkey").agg(F.count("*").alias("total"))
    hits = rows.where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count("*").alias("positive"))
    return iv.population_join(total, hits, ["l_suppkey"])


@query("""with s as (select l_suppkey, round(avg(l_discount), 8) as score from lineitem group by 1) select l_orderkey, l_linenumber, score from lineitem join s using (l_suppkey)""")
def c5_category_lookup(t):
    scores = t("lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_discount"), 8).alias("score"))
    return iv.category_scores(t("lineitem"), scores, ["l_suppkey"]).select("l_orderkey", "l_linenumber", "score")


MINUTE = "cast(floor(epoch(ts) / 60) as bigint)"


def event_minutes(t, kind):
    e = _events(t, kind)
    return e.select(F.col("user_id").alias("contig"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60).alias("pos"), "event_id")


@query(f"""with q as (select user_id as contig, {MINUTE} as pos, event_id from events where event_type = 'purchase'),
e as (select distinct user_id as contig, {MINUTE} as pos from events where event_type = 'view'),
j as (select q.event_id, min_by(e.pos, abs(q.pos - e.pos) * 2 + case when e.pos > q.pos then 1 else 0 end) as near, min(abs(q.pos - e.pos)) as distance from q left join e using (contig) group by 1)
select event_id, near, distance from j""")
def c6_nearest_event(t):
    return iv.nearest(event_minutes(t, "purchase"), event_minutes(t, "view")).select("event_id", "near", "distance")


@query(f"""with s as ({SPANS}), x as (select contig, unnest(range(start // 128, ("end" - 1) // 128 + 1)) as tile, start, "end" from s)
select contig, tile, cast(sum(least("end", (tile + 1) * 128) - greatest(start, tile * 128)) as bigint) as bases from x group by 1, 2""")
def c7_tiles(t):
    return iv.tiles(customer_spans(t), 128)


@query(f"""with p as ({POINTS}), i as (select contig, pos as start, pos + 30 as "end" from p),
a as (select *, max("end") over (partition by contig order by start, "end" rows between unbounded preceding and 1 preceding) as b from i),
k as (select *, sum(case when b >= start then 0 else 1 end) over (partition by contig order by start, "end" rows unbounded preceding) as g from a)
select contig, min(start) as start, max("end") as "end" from k group by contig, g""")
def c8_merge_intervals(t):
    return iv.merged(order_days(t).select("contig", F.col("pos").alias("start"), (F.col("pos") + 30).alias("end")))


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def c9_anti_membership(t):
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query(f"""with s as ({SPANS}), x as (select contig, unnest(range(start, "end")) as pos from s), n as (select contig, pos, count(*) as c from ({POINTS}) group by 1, 2)
select contig, count(*) as positions, cast(sum(coalesce(c, 0)) as bigint) as counts, count(c) as positive from x left join n using (contig, pos) group by contig""")
def c13_expansion(t):
    hits = order_days(t).groupBy("contig", "pos").agg(F.count("*").alias("c"))
    rows = iv.expanded_with(customer_spans(t), hits, "c")
    return rows.groupBy("contig").agg(F.count("*").alias("positions"), F.sum(F.coalesce("c", F.lit(0))).alias("counts"), F.count("c").alias("positive"))
