"""Feature, interval, profile and fold queries that take an operator further than its first query does."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import chunks, counts, models, ranks
from ..operators import intervals as iv
from ..operators.pins import pinned, pinned_path
from ..sources import lines, tables
from .files import LINE
from .intervals import MINUTE, POINTS, SPANS, customer_spans, event_minutes, order_days
from .registry import query
from .selections import md5, u, uniform
from .sequences import FOLDED, UP, _code, _contexts, _windows, folded, sequences

R = "case when l_returnflag = 'R' then 1 else 0 end"
LETTERS = "regexp_replace(text, '[^A-Za-z]', '', 'g')"


@query(f"""with s as (select doc_id, length({LETTERS}) as n from documents where length({LETTERS}) > 0), r as (select doc_id, n, 2 + length(cast(doc_id as varchar)) as
  head, n + (n + {LINE - 1}) // {LINE} as body from s)
select cast(doc_id as varchar) as contig, cast(n as bigint) as length, cast(sum(head + body) over (order by doc_id) - body as bigint) as byte_offset, cast({LINE} as
  bigint) as line_bases, cast({LINE + 1} as bigint) as line_bytes from r""")
def a2_sequence_index(t):
    """The index of the letters as a file of records in key order, written as text and read back with its checks."""
    s = t("documents").select("doc_id", F.length(F.regexp_replace("text", "[^A-Za-z]", "")).cast("long").alias("length")).where("length > 0")
    path = pinned_path(s.sparkSession, "index")
    lines.sequence_index(s, "doc_id", "length", LINE).write.option("sep", "\t").csv(path)
    return lines.read_index(s.sparkSession, path)


@query(f"""with p as ({POINTS}), i as (select contig, pos as start, pos + 20 as "end" from p), k as (select distinct contig, 10500 as length from p where contig % 2 = 0),
l as (select i.*, length, lag("end") over (partition by i.contig order by start, "end") as b from i left join k using (contig))
select contig, count(*) filter (where start < 0 or "end" <= start or "end" > coalesce(length, "end")) as bad_bounds, count(*) filter (where b > start) as overlaps,
  count(*) filter (where length is null) as unknown from l group by contig""")
def b1_known_contigs(t):
    """Intervals against contig lengths; contigs of odd number are unknown."""
    p = order_days(t).select("contig", F.col("pos").alias("start"), (F.col("pos") + 20).alias("end"))
    return iv.violations(p, p.where("contig % 2 = 0").select("contig", F.lit(10500).alias("length")).distinct())


@query("""select count(*) filter (where o_custkey % 2 <> 0 and o_custkey % 3 <> 0) as missing, count(*) filter (where o_custkey % 6 = 0) as extra, count(distinct case when o_custkey % 6 = 0 then o_custkey end) as shared from orders""")
def b3_split_cover(t):
    """What is wrong with two overlapping parts as a split of the orders."""
    rows = t("orders")
    return tables.split_report(rows, {"two": rows.where("o_custkey % 2 = 0"), "three": rows.where("o_custkey % 3 = 0")}, "o_custkey")


@query("select event_id, cast(event_type = 'purchase' as int) as y, row_number() over (order by ts, event_id) as row from events")
def b6_prepared_rows(t):
    """Events in stable time order after the checks of target, classes and groups."""
    rows = t("events").select("event_id", "ts", "user_id", (F.col("event_type") == "purchase").cast("int").alias("y"))
    return tables.prepare_rows(rows, "y", 10, ["ts", "event_id"], "user_id").select("event_id", "y", "row")


@query(f"""with s as ({SPANS}), b as (select s.*, k.strand from s, (values ('+'), ('-')) k(strand)), o as (select *, sum("end" - start) over (order by strand, contig) as stop from b),
i as (select o_orderkey, (o_orderkey * 7919) % cast((select max(stop) from o) as bigint) as ix from orders)
select o_orderkey, contig, strand, cast(start + ix - (stop - ("end" - start)) as bigint) as pos from i join o on ix >= stop - ("end" - start) and ix < stop""")
def c3_linear_decode(t):
    """Linear indices back to contig, strand and position."""
    spans = pinned(iv.template(customer_spans(t), ["contig"]))
    whole = spans.agg(F.max("template_stop").alias("n"))
    index = t("orders").crossJoin(F.broadcast(whole)).select("o_orderkey", (F.col("o_orderkey") * 7919 % F.col("n")).alias("template_index"))
    return iv.linear_positions(index, spans, 4096).select("o_orderkey", "contig", "strand", "pos")


STRAND = "case when event_id % 2 = 0 then '+' else '-' end"
NEAR = f"""q as (select user_id as contig, {MINUTE} as pos, event_id, {STRAND} as strand from events where event_type = 'purchase'), e as (select distinct user_id as
  contig, {MINUTE} as pos, {STRAND} as strand from events where event_type = 'view'),
m as (select unnest(['same', 'opposite', 'any']) as mode), j as (select q.event_id, q.pos, q.strand, mode, min_by(e.pos, abs(q.pos - e.pos) * 2 + case when e.pos > q.pos
  then 1 else 0 end) as near, min(abs(q.pos - e.pos)) as distance
 from q cross join m left join e on e.contig = q.contig and (mode = 'any' or (mode = 'same') = (e.strand = q.strand)) group by 1, 2, 3, 4),
n as (select event_id, mode, near, distance, (near - pos) * case when strand = '+' then 1 else -1 end as oriented from j)"""


def nearest_views(t):
    strand = F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("strand")
    ask, offer = (event_minutes(t, k).select("contig", "pos", "event_id", strand) for k in ("purchase", "view"))
    return iv.nearest_by_strand(ask, offer).select("event_id", "mode", "near", "distance", "oriented")


@query(f"with {NEAR} select * from n")
def c6_nearest_by_strand(t):
    """The nearest view of each purchase of the user on the same, the opposite and any strand, with its signed oriented distance."""
    return nearest_views(t)


WITHIN = [16, 64, 256, 1024, 4096]


@query(f"""with {NEAR}, k as (select {u(WITHIN)} as threshold) select event_id % 3 as grp, mode, cast(threshold as bigint) as threshold, count(*) as n, round(avg(case
  when distance <= threshold then 1.0 else 0 end), 10) as within,
round(avg(case when distance <= threshold and oriented < 0 then 1.0 else 0 end), 10) as upstream, round(avg(case when distance <= threshold and oriented > 0 then 1.0
  else 0 end), 10) as downstream from n, k group by 1, 2, 3""")
def e22_within_distance(t):
    """Shares of purchases with a view within a distance, by group and strand mode, before and behind; none counts as not within."""
    rows = nearest_views(t).withColumn("threshold", F.explode(F.array(*(F.lit(x).cast("long") for x in WITHIN))))
    near = F.coalesce(F.col("distance") <= F.col("threshold"), F.lit(False))
    share = lambda c, n: F.round(F.avg(c.cast("double")), 10).alias(n)
    found = rows.groupBy((F.col("event_id") % 3).alias("grp"), "mode", "threshold")
    return found.agg(F.count("*").alias("n"), share(near, "within"), share(near & F.coalesce(F.col("oriented") < 0, F.lit(False)), "upstream"), share(near & F.coalesce(F.col("oriented") > 0, F.lit(False)), "downstream"))


TILES = f"""s as ({SPANS}), x as (select contig, unnest(range(start // 128, ("end" - 1) // 128 + 1)) as tile, start, "end" from s), b as (select contig, tile,
  sum(least("end", (tile + 1) * 128) - greatest(start, tile * 128)) as bases from x group by 1, 2),
h as (select contig, pos // 128 as tile, count(distinct pos) as positives, count(*) as total from ({POINTS}) group by 1, 2),
k as (select contig, tile, cast(bases as bigint) as bases, coalesce(positives, 0) as positives, coalesce(total, 0) as total, cast(bases - coalesce(positives, 0) as
  bigint) as negatives from b left join h using (contig, tile))"""


def tile_rows(t):
    return iv.tile_table(customer_spans(t), order_days(t).groupBy("contig", "pos").agg(F.count("*").alias("count")), 128)


@query(f"""with {TILES} select *, round(positives / sum(positives) over (), 12) as p_positive, round(negatives / sum(negatives) over (), 12) as p_negative from k""")
def c7_tile_table(t):
    """Tiles with bases, positive days, orders, empty days and both sampling probabilities."""
    return tile_rows(t).withColumns({c: F.round(c, 12) for c in ("p_positive", "p_negative")})


DRAWS = 500


@query(f"""with {TILES}, p as (select contig, tile, 0.5 * positives / sum(positives) over () + 0.5 * negatives / sum(negatives) over () as p from k), c as (select *,
  sum(p) over (order by contig, tile) as hi from p),
d as (select i as draw, {uniform("i", "draws")} as u from range(0, {DRAWS}) r(i)) select draw, contig, tile, round(1 / (p * (select count(*) from k)), 8) as weight from
  d join c on u >= hi - p and u < hi""")
def g5_tile_draws(t):
    """Tiles drawn with replacement, half by positives and half by empty days, with the weights that undo it (sampling is the feature)."""
    mix = F.lit(0.5) * F.col("p_positive") + F.lit(0.5) * F.col("p_negative")
    rows = pinned(tile_rows(t).select("contig", "tile", mix.alias("p")))
    c = ranks.cumulative(rows, [F.asc("contig"), F.asc("tile")], {"hi": F.col("p")}).crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))
    draws = rows.sparkSession.range(DRAWS).select(F.col("id").alias("draw"), sc.keyed_uniform("id", "draws").alias("u"))
    return iv.weighted_draws(c, draws, "p", "hi", DRAWS).select("draw", "contig", "tile", F.round(1 / (F.col("p") * F.col("n")), 8).alias("weight"))


@query(f"""select case when x is null then 5 when x >= 0.08 then 4 when x >= 0.06 then 3 when x >= 0.03 then 2 when x >= 0.01 then 1 else 0 end as code, count(*) as n from (select nullif(l_discount, 0.05) as x from lineitem) group by 1""")
def d7_bins_with_missing(t):
    """Right-open bins in which missing values have a code of their own."""
    x = F.nullif("l_discount", F.lit(0.05))
    return t("lineitem").select(sc.bin_code(x, [0.01, 0.03, 0.06, 0.08]).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query(f"""with b as (select source, c, count(*) as n from (select source, unnest(string_split({UP}, '')) as c from documents) where c in ('A', 'C', 'G', 'T') group by
  1, 2), v as (select source, sum(n) as v from b group by 1),
p as (select source, w, count(*) as n from ({_windows(2)}) where regexp_matches(w, '^[ACGT][ACGT]$') group by 1, 2)
select p.source, w as pair, round(p.n * v / (l.n * r.n), 8) as observed_expected from p join v on v.source is not distinct from p.source join b l on l.source is not
  distinct from p.source and l.c = left(w, 1) join b r on r.source is not distinct from p.source and r.c = right(w, 1)""")
def d8_all_pairs(t):
    """Observed over expected of all 16 pairs by source."""
    both = pinned(counts.kmer_counts(t("documents"), "text", (1, 2), ["source"]))
    one, two = (both.where((F.col("k") == k) & (F.col("code") < 4**k)).drop("k") for k in (1, 2))
    size = one.groupBy(F.col("source").alias("vs")).agg(F.sum("n").alias("v"))
    left, right = (one.select(F.col("source").alias(f"{x}s"), F.col("code").alias(f"{x}c"), F.col("n").alias(f"{x}n")) for x in "lr")
    same = lambda x: F.col("source").eqNullSafe(F.col(f"{x}s"))
    j = two.join(size, same("v")).join(left, same("l") & (F.floor(F.col("code") / 4) == F.col("lc"))).join(right, same("r") & (F.col("code") % 4 == F.col("rc")))
    oe = sc.observed_expected(F.col("ln").cast("double"), F.col("rn").cast("double"), F.col("n").cast("double"), F.col("v").cast("double"))
    return j.select("source", sc.kmer_label(F.col("code"), 2).alias("pair"), F.round(oe, 8).alias("observed_expected"))


@query("""with x as (select l_orderkey % 7 as contig, l_linenumber % 2 as strand, l_partkey // 32 as region, round((l_discount * 3 + l_tax) * 100000) as b from lineitem)
select cast((contig * 2 + strand) * 1000000 + region as bigint) as region_key, cast(b as bigint) as score_bin, count(*) as n from x group by 1, 2""")
def d15_score_bins(t):
    """Packed region keys and five-decimal score bins."""
    key = (F.col("l_orderkey") % 7 * 2 + F.col("l_linenumber") % 2) * 1000000 + F.floor(F.col("l_partkey") / 32)
    score = F.round((F.col("l_discount") * 3 + F.col("l_tax")) * 100000).cast("long")
    return t("lineitem").groupBy(key.cast("long").alias("region_key"), score.alias("score_bin")).agg(F.count("*").alias("n"))


@query(f"""with l as (select doc_id, c, i, case when c in ('C', 'G') then 1 else 0 end as g, case when c in ('A', 'C', 'G', 'T') then 1 else 0 end as v from (select
  doc_id, unnest(string_split({UP}, '')) as c, unnest(range(1, length(text) + 1)) as i from documents where length(text) > 0)),
w as (select sum(g) over k as gc, sum(v) over k as valid, lag(c, 5) over o || lag(c, 4) over o || lag(c, 3) over o || lag(c, 2) over o || lag(c, 1) over o || c as w from l
 window k as (partition by doc_id order by i rows between 50 preceding and 50 following), o as (partition by doc_id order by i))
select cast(coalesce({_code(6)}, 4096) as bigint) as code, cast(gc as bigint) as gc, cast(valid as bigint) as valid, count(*) as n from w group by 1, 2, 3""")
def e2_window_composition(t):
    """6-mers that end at each position by the G and C letters and the bases in the window of 50 letters each way."""
    return chunks.joint_counts(chunks.of_texts(t("documents"), "text", [], 50), 6, 50, [])


@query(f"""with c as (select {_code(4)} as code, quality as y from ({_windows(4)}) join labels using (doc_id)), n as (select code, count(*) as total, count(*) filter
  (where y = 1) as positive from c group by 1), g as (select sum(positive) / sum(total) as p from n)
select cast(r.code as bigint) as code, coalesce(total, 0) as total, coalesce(positive, 0) as positive, coalesce(total, 0) - coalesce(positive, 0) as negative,
  round(positive / total, 10) as rate, round(positive / total / p, 10) as enrichment from range(0, 257) r(code) left join n using (code), g""")
def e4_kmer_categories(t):
    """Every 4-mer, those that do not occur too: their rate is null."""
    rows = sequences(t).join(t("labels"), "doc_id").select("seq", F.col("quality").alias("y"))
    n = counts.kmer_counts(rows, "seq", 4, ["y"]).groupBy("code").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("positive"))
    n = pinned(n)
    g = n.agg((F.sum("positive") / F.sum("total")).alias("p"))
    rate = F.col("positive") / F.col("total")
    rows = n.sparkSession.range(257).toDF("code").join(F.broadcast(n), "code", "left").crossJoin(F.broadcast(g))
    total, positive = (F.coalesce(c, F.lit(0)) for c in ("total", "positive"))
    return rows.select("code", total.alias("total"), positive.alias("positive"), (total - positive).alias("negative"), F.round(rate, 10).alias("rate"), F.round(rate / F.col("p"), 10).alias("enrichment"))


@query(f"""select source, 1 as k, cast({_code(1)} as bigint) as code, count(*) as n from ({_windows(1)}) group by 1, 3 union all select source, 2, cast({_code(2)} as bigint), count(*) from ({_windows(2)}) group by 1, 3""")
def e8_base_pairs(t):
    """Base and pair histograms of each source; other letters count as one."""
    return counts.kmer_counts(t("documents"), "text", (1, 2), ["source"]).select("source", "code", "n", "k")


@query("""with r as (select o_totalprice as x, row_number() over (order by o_totalprice desc, o_orderkey) as r, count(*) over () as n from orders where o_totalprice is not null)
select max(n) as n, cast(max(ceil(0.01 * n)) as bigint) as n_top, round(sum(case when r <= ceil(0.01 * n) then x else 0 end) / sum(x), 10) as top_share from r""")
def e9_top_share(t):
    """The share of the total that the top 1 % of the orders hold."""
    rows = t("orders").where("o_totalprice is not null").select("o_totalprice", "o_orderkey")
    r = ranks.row_numbers(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], "r").crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))
    top = F.ceil(F.lit(0.01) * F.col("n"))
    share = F.sum(F.when(F.col("r") <= top, F.col("o_totalprice")).otherwise(0.0)) / F.sum("o_totalprice")
    return r.agg(F.max("n").alias("n"), F.max(top).alias("n_top"), F.round(share, 10).alias("top_share"))


@query(f"""with v as (select l_returnflag as g, l_extendedprice as v, sum(l_quantity) as w from lineitem where l_extendedprice is not null and l_quantity > 0 group by 1, 2),
c as (select *, (sum(w) over (partition by g order by v) - w / 2) / sum(w) over (partition by g) as pos from v), q as (select {u([0.0, 0.1, 0.5, 0.9, 1.0])} as q),
e as (select g, q, max(pos) filter (where pos <= q) as a, min(pos) filter (where pos >= q) as b, arg_max(v, pos) filter (where pos <= q) as x, arg_min(v, pos) filter
  (where pos >= q) as y from c, q group by 1, 2)
select g as l_returnflag, cast(q as double) as q, round(case when a is null then y when b is null or a = b then x else x + (y - x) * (q - a) / (b - a) end, 6) as value from e""")
def e12_weighted_quantiles(t):
    """Quantiles of the price by mid-point quantity weights."""
    rows = t("lineitem").where("l_quantity > 0")
    out = ranks.weighted_quantiles(rows, "l_extendedprice", "l_quantity", [0.0, 0.1, 0.5, 0.9, 1.0], ["l_returnflag"])
    return out.withColumn("value", F.round("value", 6))


@query(f"""select lang, w as word, cast((i - 1) // 100 as bigint) as bin, count(*) as n from ({_windows(3, "text", "doc_id, lang")}) where w in ('the', 'ion', 'ere') group by 1, 2, 3""")
def e14_position_profile(t):
    """Where three 3-mers begin in the texts of each language, in bins of 100 letters."""
    return counts.word_places(t("documents"), "text", ["the", "ion", "ere"], 100, ["lang"])


COLUMNS = ("o_orderstatus", "o_orderpriority", "o_custkey")


@query("with " + ", ".join(f"x{i} as (select '{c}' as name, cast({c} as varchar) as v, count(*) as n from orders group by 2)" for i, c in enumerate(COLUMNS)) + ", x as (" + " union all ".join(f"select * from x{i}" for i in range(len(COLUMNS))) + """)
select name as "column", cast(sum(n) as bigint) as n_rows, cast(coalesce(sum(n) filter (where v is null), 0) as bigint) as missing, count(v) as levels, cast(max(n)
  filter (where v is not null) as bigint) as mode_rows,
max(v) filter (where n = (select max(n) from x k where k.name = x.name and k.v is not null)) as mode from x group by 1""")
def e16_columns(t):
    """Missing values, levels and the commonest level (the last by name in ties) of each column, from counts of (column, value)."""
    pair = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in COLUMNS)))
    x = t("orders").select(pair.alias("p")).groupBy("p.column", "p.v").agg(F.count("*").alias("n"))
    top = F.max(F.when(F.col("v").isNotNull(), F.struct("n", "v")))
    out = x.groupBy("column").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.count("v").alias("levels"), top.alias("top"))
    return out.select("column", "n_rows", "missing", "levels", F.col("top.n").alias("mode_rows"), F.col("top.v").alias("mode"))


@query("""select (select count(*) from (select o_custkey, o_orderstatus, o_orderpriority from orders)) - (select count(*) from (select distinct o_custkey, o_orderstatus, o_orderpriority from orders)) as row_repeats, count(*) - count(distinct o_custkey) as key_repeats from orders""")
def e16_duplicates(t):
    """Rows beyond the first of equal ones, over three columns and over a key."""
    rows = t("orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    parts = n(rows, "n").crossJoin(F.broadcast(n(rows.distinct(), "d"))).crossJoin(F.broadcast(n(rows.select("o_custkey").distinct(), "k")))
    return parts.select((F.col("n") - F.col("d")).alias("row_repeats"), (F.col("n") - F.col("k")).alias("key_repeats"))


NUMBERS = ("l_quantity", "l_discount", "l_tax")


@query("with r as (select *, " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as r_{c}" for c in NUMBERS) + " from lineitem) " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 10) as pearson, round(corr(r_{a}, r_{b}), 10) as spearman from r" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]))
def e18_correlations(t):
    """Pearson and Spearman correlations of each pair of columns; ranks are joined from one row a value."""
    rows = t("lineitem").select(*NUMBERS)
    for c in NUMBERS:
        rows = rows.join(ranks.value_ranks(t("lineitem"), c).select(c, F.col("average").alias(f"r_{c}")), c)
    pairs = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]
    each = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 10).alias("pearson"), F.round(F.corr(f"r_{a}", f"r_{b}"), 10).alias("spearman")) for a, b in pairs))
    return rows.agg(each.alias("x")).select(F.inline("x"))


@query("""select l_returnflag, count(*) filter (where l_linestatus = 'F') as n_f, count(*) filter (where l_linestatus = 'O') as n_o, round(avg(l_discount) filter (where l_linestatus = 'F'), 10) as mean_f, round(avg(l_discount) filter (where l_linestatus = 'O'), 10) as mean_o from lineitem group by 1""")
def e18_pivot(t):
    """Cross-table of class and status: counts and means of the discount."""
    p = t("lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 10).alias("mean"))
    return p.select("l_returnflag", *(F.coalesce(f"{s}_n", F.lit(0)).alias(f"n_{s.lower()}") for s in "FO"), *(F.col(f"{s}_mean").alias(f"mean_{s.lower()}") for s in "FO"))


@query("""with f as (select l_extendedprice as x from lineitem where l_linestatus = 'F'), b as (select quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.75) as q3,
  quantile_cont(x, 0.5) as m from f), d as (select quantile_cont(abs(x - m), 0.5) as mad from f, b),
v as (select l_returnflag as dataset, l_suppkey % 50 as grp, case when x < q1 - 0.5 * (q3 - q1) or x > q3 + 0.5 * (q3 - q1) then 2 when x < q1 - 0.3 * (q3 - q1) or x >
  q3 + 0.3 * (q3 - q1) then 1 else 0 end as severity, abs(x - m) * 0.6745 / nullif(mad, 0) as z from (select *, l_extendedprice as x from lineitem), b, d)
select dataset, count(*) as n, count(*) filter (where severity = 1) as mild, count(*) filter (where severity = 2) as extreme, count(*) filter (where z > 1.2) as far,
  round(max(z), 8) as most, count(distinct case when severity > 0 then grp end) as groups_flagged from v group by 1""")
def e20_reference_bounds(t):
    """Quartile and median bounds fitted on one status and applied to each class: mild and extreme values, robust z, groups with a flagged value."""
    x, f = F.col("l_extendedprice"), t("lineitem").where("l_linestatus = 'F'")
    q1, m, q3 = (r["value"] for r in ranks.quantiles(f, "l_extendedprice", [0.25, 0.5, 0.75]).orderBy("q").collect())
    mad = ranks.quantiles(f.select(F.abs(x - m).alias("d")), "d", [0.5]).head()["value"]
    out = lambda k: (x < q1 - k * (q3 - q1)) | (x > q3 + k * (q3 - q1))
    z = F.try_divide(F.abs(x - m) * 0.6745, F.nullif(F.lit(mad), F.lit(0.0)))
    v = t("lineitem").select(F.col("l_returnflag").alias("dataset"), (F.col("l_suppkey") % 50).alias("grp"), F.when(out(0.5), 2).when(out(0.3), 1).otherwise(0).alias("severity"), z.alias("z"))
    s = F.col("severity")
    return v.groupBy("dataset").agg(F.count("*").alias("n"), F.count_if(s == 1).alias("mild"), F.count_if(s == 2).alias("extreme"), F.count_if(F.col("z") > 1.2).alias("far"), F.round(F.max("z"), 8).alias("most"), F.countDistinct(F.when(s > 0, F.col("grp"))).alias("groups_flagged"))


@query()
def g2_lightest_folds(t):
    """Suppliers by falling size, each to the lightest fold so far; compared with a plain loop in the tests."""
    return models.lightest_folds(t("lineitem"), "l_suppkey", 5)


@query(f"""with g as (select l_suppkey, row_number() over (order by {md5("l_suppkey", "groups")}, l_suppkey) as r from (select distinct l_suppkey from lineitem))
select l_orderkey, l_linenumber, cast((r - 1) % 5 as bigint) as fold from lineitem join g using (l_suppkey)""")
def g3_group_folds(t):
    """Whole suppliers dealt round five folds in a seeded order."""
    g = t("lineitem").select("l_suppkey").distinct().withColumn("h", sc.keyed_hash("l_suppkey", "groups"))
    g = ranks.row_numbers(g, [F.asc("h"), F.asc("l_suppkey")], "r").select("l_suppkey", ((F.col("r") - 1) % 5).alias("fold"))
    return t("lineitem").join(g, "l_suppkey").select("l_orderkey", "l_linenumber", "fold")


@query(f"""with r as (select event_id, row_number() over (order by {md5("event_id", "plain")}, event_id) as r from events) select event_id, cast((r - 1) % 5 as bigint) as fold from r""")
def g3_plain_folds(t):
    """Rows dealt round five folds in a seeded order."""
    rows = t("events").select("event_id", sc.keyed_hash("event_id", "plain").alias("h"))
    return ranks.row_numbers(rows, [F.asc("h"), F.asc("event_id")], "r").select("event_id", ((F.col("r") - 1) % 5).alias("fold"))


@query(f"""with c as (select {_code(4)} as code, quality as y from ({_windows(4)}) join labels using (doc_id)), n4 as (select code, count(*) as total, count(*) filter
  (where y = 1) as positive from c group by 1),
g as (select sum(positive) / sum(total) as p from n4), n2 as (select case when code = 256 then 16 else code % 16 end as code, sum(total) as total, sum(positive) as positive from n4 group by 1),
s2 as (select code, (positive + 1.0) / (total + 1 / p) as s from n2, g)
select cast(n4.code as bigint) as code, total, positive, round((positive + s / p) / (total + 1 / p), 10) as score from n4 join s2 on s2.code = case when n4.code = 256
  then 16 else n4.code % 16 end, g""")
def h1_backoff_scores(t):
    """4-mer scores drawn to those of their suffix pairs, and those to the prevalence."""
    rows = sequences(t).join(t("labels"), "doc_id").select("seq", F.col("quality").alias("y"))
    n = counts.kmer_counts(rows, "seq", 4, ["y"]).groupBy("code").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("positive"))
    return counts.backoff_scores(pinned(n), (2, 4)).withColumn("score", F.round("score", 10))


@query(f"""with c as (select cast(floor(l_quantity / 10) as bigint) as bin, l_linestatus as status, count(*) as total, sum({R}) as positive, sum(l_quantity) as w from
  lineitem group by 1, 2), g as (select sum(positive) / sum(total) as p from c)
select bin, status, total, cast(positive as bigint) as positive, round(positive / total, 10) as rate, round(positive / total / p, 10) as enrichment, round(w / total, 8) as mean from c, g""")
def e5_interaction_cells(t):
    """Rate, enrichment and mean quantity of each cell of quantity bin and status."""
    hit = F.col("l_returnflag") == "R"
    c = t("lineitem").groupBy(F.floor(F.col("l_quantity") / 10).alias("bin"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("total"), F.count_if(hit).alias("positive"), F.sum("l_quantity").alias("w"))
    g = c.agg((F.sum("positive") / F.sum("total")).alias("p"))
    rate = F.col("positive") / F.col("total")
    return c.crossJoin(F.broadcast(g)).select("bin", "status", "total", "positive", F.round(rate, 10).alias("rate"), F.round(rate / F.col("p"), 10).alias("enrichment"), F.round(F.col("w") / F.col("total"), 8).alias("mean"))


@query(f"""with p as ({POINTS}), i as (select distinct contig, pos // 60 * 60 as start, pos // 60 * 60 + 30 as "end" from p), c as (select contig, pos, count(*) as n from p group by 1, 2),
k as (select c.*, i.start is not null as allowed from c left join i on i.contig = c.contig and c.pos >= i.start and c.pos < i."end")
select contig, pos // 32 as region, count(*) as positions, bool_and(allowed) as all_allowed, count(*) filter (where allowed) as n_positive, cast(coalesce(sum(n) filter
  (where allowed), 0) as bigint) as total,
 arg_max(pos, n * 1000000 - pos) filter (where allowed) as dominant from k group by 1, 2""")
def e15_allowed_regions(t):
    """Regions of 32 days: positions, whether all are in the allow-list, and positives, orders and the dominant day (the first in ties) of those that are."""
    p = order_days(t)
    slots = p.select("contig", (F.floor(F.col("pos") / 60) * 60).alias("start")).distinct().withColumn("end", F.col("start") + 30)
    c = pinned(p.groupBy("contig", "pos").agg(F.count("*").alias("n")))
    inside = iv.contained(c, slots, 30).select("contig", "pos", F.lit(True).alias("in"))
    k = c.join(inside, ["contig", "pos"], "left").withColumn("in", F.coalesce("in", F.lit(False)))
    found = k.groupBy("contig", F.floor(F.col("pos") / 32).alias("region"))
    return found.agg(
        F.count("*").alias("positions"), F.bool_and("in").alias("all_allowed"), F.count_if("in").alias("n_positive"), F.coalesce(F.sum(F.when(F.col("in"), F.col("n"))), F.lit(0)).alias("total"),
        F.max_by("pos", F.when(F.col("in"), F.col("n") * 1000000 - F.col("pos"))).alias("dominant"),
    )


@query("""select lang, c as symbol, count(*) as n from (select lang, unnest(string_split(text, '')) as c from documents where length(text) > 0) where regexp_matches(c, '^[!-/:-@\\[-`{-~]$') group by 1, 2""")
def e19_special_characters(t):
    """ASCII signs in the texts of each language, counted in arrays."""
    return counts.word_counts(t("documents"), "text", 1, ["lang"]).where(F.col("word").rlike(r"^[!-/:-@\[-`{-~]$")).select("lang", F.col("word").alias("symbol"), "n")


@query("""with h as (select event_type, hour(ts) as hour, count(*) as n, avg(value) as mean, quantile_cont(value, 0.5) as median from events group by 1, 2)
select event_type, cast(hour as bigint) as hour, n, round(n / sum(n) over (partition by event_type), 10) as share, round(mean, 8) as mean, round(median, 8) as median,
  rank() over (partition by event_type order by n desc) as place from h""")
def e21_position_histogram(t):
    """Where events of a type fall in the day: share within the type, mean, median and place by number."""
    from pyspark.sql import Window as W

    rows = t("events").select("event_type", F.hour("ts").cast("long").alias("hour"), "value")
    h = rows.groupBy("event_type", "hour").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    q = ranks.quantiles(rows, "value", [0.5], ["event_type", "hour"]).select("event_type", "hour", F.col("value").alias("median"))
    by = W.partitionBy("event_type")  # 24 rows each
    share = F.col("n") / F.sum("n").over(by)
    return h.join(q, ["event_type", "hour"], "left").select("event_type", "hour", "n", F.round(share, 10).alias("share"), F.round("mean", 8).alias("mean"), F.round("median", 8).alias("median"), F.rank().over(by.orderBy(F.desc("n"))).cast("long").alias("place"))


@query(f"""with x as (select l_orderkey * 10 + l_linenumber as key, l_extendedprice as p from lineitem where l_returnflag = 'R'), q as (select quantile_cont(p, [0.25, 0.5, 0.75]) as q from x),
s as (select key, case when p > q[3] then 3 when p > q[2] then 2 when p > q[1] then 1 else 0 end as quartile from x, q), r as (select *, row_number() over (partition by
  quartile order by {md5("key", "strata")}, key) as r from s)
select quartile, key from r where r <= 25""")
def f7_quartile_strata(t):
    """The 25 least keyed hashes of each price quartile of the positives (a repeatable sample is the feature)."""
    from pyspark.sql import Window as W

    x = t("lineitem").where("l_returnflag = 'R'").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.col("l_extendedprice").alias("p"))
    cuts = [r["value"] for r in ranks.quantiles(x, "p", [0.25, 0.5, 0.75]).orderBy("q").collect()]
    s = x.withColumn("quartile", sc.bin_code_closed(F.col("p"), cuts))
    return s.withColumn("r", F.row_number().over(W.partitionBy("quartile").orderBy(sc.keyed_hash("key", "strata"), "key"))).where("r <= 25").select("quartile", "key")


@query(f"""with {NEAR}, k as (select event_id, distance, case when distance is null then 'isolated' when distance > 1024 then 'far' else 'near' end as cohort from n where mode = 'any'),
r as (select *, row_number() over (partition by cohort order by coalesce(distance, 0) desc, event_id) as r from k) select cohort, event_id, distance from r where r <= 50""")
def f8_distance_cohorts(t):
    """Of purchases without a view, far from and near to one, the 50 farthest (a top report)."""
    from pyspark.sql import Window as W

    d = F.col("distance")
    k = nearest_views(t).where("mode = 'any'").withColumn("cohort", F.when(d.isNull(), "isolated").when(d > 1024, "far").otherwise("near"))
    return k.withColumn("r", F.row_number().over(W.partitionBy("cohort").orderBy(F.desc(F.coalesce(d, F.lit(0))), "event_id"))).where("r <= 50").select("cohort", "event_id", "distance")


@query(f"""with e as (select l_linestatus as status, abs({R} - l_discount * 5) as a, abs({R} - l_tax * 6) as b from lineitem)
select status, round(avg(a), 10) as reference_error, round(avg(b), 10) as candidate_error, round(avg(b) - avg(a), 10) as change, count(*) filter (where b < a) as nearer,
  count(*) filter (where b > a) as farther from e group by 1""")
def f16_absolute_errors(t):
    """Mean absolute errors of two predictors by status, their change, and the rows that come nearer or go farther."""
    y = (F.col("l_returnflag") == "R").cast("double")
    e = t("lineitem").select(F.col("l_linestatus").alias("status"), F.abs(y - F.col("l_discount") * 5).alias("a"), F.abs(y - F.col("l_tax") * 6).alias("b"))
    at = lambda c, n: F.round(c, 10).alias(n)
    return e.groupBy("status").agg(at(F.avg("a"), "reference_error"), at(F.avg("b"), "candidate_error"), at(F.avg("b") - F.avg("a"), "change"), F.count_if(F.col("b") < F.col("a")).alias("nearer"), F.count_if(F.col("b") > F.col("a")).alias("farther"))


@query(f"""with w as (select doc_id, i, w from ({_windows(7, f"('NNN' || {UP} || 'NNN')", "doc_id")}) where (i - 1 >= 10 and i - 1 < 60) or (i - 1 >= 100 and i - 1 < 400)),
c as (select w, count(*) as n from w group by 1), k as (select unnest([2, 4]) as k, w, n from c),
o as (select '+' as strand, k, substr(w, 5 - k, k) as s, n from k union all select '-', k, reverse(translate(substr(w, 4, k), 'ACGTacgt', 'TGCAtgca')), n from k)
select strand, k, cast(case when regexp_matches(s, '^[ACGT]+$') then list_sum([(strpos('ACGT', substr(s, i, 1)) - 1) * power(4, k - i) for i in range(1, k + 1)]) else power(4, k) end as bigint) as code,
  cast(sum(n) as bigint) as n from o group by 1, 2, 3""")
def e1_allowed_kmers(t):
    """2- and 4-mers on both strands at the positions of two allowed intervals of each text; words may reach out of them, so each allowed position counts once."""
    spans = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((10, 60), (100, 400))))
    return chunks.oriented_kmers(chunks.of_texts(t("documents").withColumn("spans", spans), "text", ["spans"], 3), (2, 4), [], "spans")


@query(f"""with c as (select w, count(*) as n from ({_windows(7, f"('NNN' || {FOLDED} || 'NNN')", "doc_id")}) group by 1)
select cast(o - 3 as bigint) as at, substr(w, o + 1, 2) as bases, cast(sum(n) as bigint) as n from c, range(0, 6) r(o) where not contains(substr(w, o + 1, 2), 'A') group by 1, 2""")
def d10_adjacent_products(t):
    """Products of the one-hot codes of adjacent offsets around every position, summed: pairs of bases at offset and next offset; A is the reference and has no column."""
    rows = t("documents").where(F.length("text") > 0).select(folded(F.col("text")).alias("seq"))
    c = rows.mapInArrow(_contexts(3), "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    letter = lambda k: F.substring(F.lit("ACGTN"), (F.floor(F.col("code") / 5**k) % 5 + 1).cast("int"), F.lit(1))
    pairs = F.array(*(F.struct(F.lit(2 - k).cast("long").alias("at"), F.concat(letter(k + 1), letter(k)).alias("bases")) for k in range(5, -1, -1)))
    return c.select(F.explode(pairs).alias("x"), "n").where(~F.col("x.bases").contains("A")).groupBy("x.at", "x.bases").agg(F.sum("n").alias("n"))


MIX = "18446744073709551616"


def _mul(x, constant):
    return f"cast((cast({x} as uhugeint) * {constant}) % {MIX} as ubigint)"


@query(f"""with a as (select event_id, cast((cast(event_id as uhugeint) + 7 + 11400714819323198485) % {MIX} as ubigint) as x from events), b as (select event_id, {_mul("xor(x, x >> 30)", "13787848793156543929")} as x from a),
c as (select event_id, {_mul("xor(x, x >> 27)", "10723151780598845931")} as x from b) select event_id, cast(xor(x, x >> 31) as varchar) as mixed from c""")
def d15_mixed_keys(t):
    """A 64-bit mixing hash of keys and a salt."""
    return sc.mixed_keys(t("events").select("event_id"), "event_id", 7)


@query(f"""select 'pair=' || case when code = 16 then 'N/edge' else substr('ACGT', code // 4 + 1, 1) || substr('ACGT', code % 4 + 1, 1) end as name, sum(n)::bigint as n
from (select {_code(2)} as code, count(*) as n from ({_windows(2)}) group by 1) where code <> 0 group by 1""")
def d2_reference_columns(t):
    """Ones of the reference-coded pair columns: a fixed vocabulary, no column for the reference AA, N/edge separate."""
    c = counts.kmer_counts(t("documents"), "text", 2, []).where("code <> 0")
    return c.select(F.concat(F.lit("pair="), sc.kmer_label(F.col("code"), 2)).alias("name"), "n")


@query("""select l_returnflag, count(l_extendedprice) as n, round(avg(l_extendedprice), 6) as mean, round(stddev_samp(l_extendedprice), 6) as std, min(l_extendedprice) as low,
 round(quantile_cont(l_extendedprice, 0.25), 6) as q1, round(quantile_cont(l_extendedprice, 0.5), 6) as median, round(quantile_cont(l_extendedprice, 0.75), 6) as q3, max(l_extendedprice) as high from lineitem group by 1""")
def e18_group_describe(t):
    """Count, mean, deviation and five-number summary of the price of each class."""
    x, by = F.col("l_extendedprice"), ["l_returnflag"]
    q = ranks.quantiles(t("lineitem"), "l_extendedprice", [0.25, 0.5, 0.75], by).groupBy(*by)
    q = q.agg(*(F.round(F.max(F.when(F.col("q") == p, F.col("value"))), 6).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))))
    m = t("lineitem").groupBy(*by).agg(F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"))
    return m.join(q, by)


@query("""with n as (select o_custkey, count(*) as n from orders group by 1) select case when n >= 14 then cast(o_custkey as varchar) else '(rare)' end as level, cast(sum(n) as bigint) as n from n group by 1""")
def e19_frequent_levels(t):
    """Customers of at least 14 orders by name, all others as one level."""
    return models.frequent(t("orders"), "o_custkey", 14).groupBy(F.col("o_custkey").alias("level")).agg(F.count("*").alias("n"))


GAPS = {"l_discount": 0.05, "l_tax": 0.02, "l_quantity": 7}


@query("with x as (select l_linestatus as s, " + ", ".join(f"nullif({c}, {v}) as {c}" for c, v in GAPS.items()) + " from lineitem) " + " union all ".join(
    f"""select '{c}' as "column", round(avg(case when {c} is null then 1.0 else 0 end) filter (where s = 'F'), 10) as first_share, round(avg(case when {c} is null then 1.0 else 0 end) filter (where s = 'O'), 10) as second_share,
 round(avg(case when {c} is null then 1.0 else 0 end) filter (where s = 'O') - avg(case when {c} is null then 1.0 else 0 end) filter (where s = 'F'), 10) as change from x""" for c in GAPS))  # fmt: skip
def e16_missing_compared(t):
    """Shares of missing values of each column in two tables, and their difference; one value of each column stands for a gap."""
    rows = t("lineitem").select("l_linestatus", *(F.nullif(c, F.lit(v)).alias(c) for c, v in GAPS.items()))
    share = lambda c, s: F.avg(F.when(F.col("l_linestatus") == s, F.col(c).isNull().cast("double")))
    at = lambda x, name: F.round(x, 10).alias(name)
    each = (F.struct(F.lit(c).alias("column"), at(share(c, "F"), "first_share"), at(share(c, "O"), "second_share"), at(share(c, "O") - share(c, "F"), "change")) for c in GAPS)
    return rows.agg(F.array(*each).alias("x")).select(F.inline("x"))
