"""Joint keys of words and window compositions, over chunks of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks
from .registry import query
from .sequences import UP, _code

#: Bin edges of the GC share and of observed over expected pair counts.
SHARE_EDGES = (0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60)
RATIO_EDGES = (0.25, 0.50, 0.75, 1.00, 1.25, 1.50)
HALF = 100
PAIRS = [a + b for a in "ACGT" for b in "ACGT"]


def _edges(value: str, edges) -> str:
    return f"case when {value} is null then {len(edges) + 1} else " + " + ".join(f"case when {value} >= {e} then 1 else 0 end" for e in edges) + " end"


def _near(pairs, columns: str) -> str:
    """Each letter c at i, with counts na, nc, ng, nt of its window, v of the bases there and p<xy> of the pairs, and the words of six letters that end (w) and begin (x) there."""
    letters = ", ".join(f"sum(case when c = '{b}' then 1 else 0 end) over k as n{b.lower()}" for b in "ACGT")
    counts = ", ".join(f"coalesce(sum(case when c = '{p[0]}' and d = '{p[1]}' then 1 else 0 end) over h, 0) as p{p.lower()}" for p in pairs)
    return f"""(select {columns}, {letters}, sum(case when c in ('A', 'C', 'G', 'T') then 1 else 0 end) over k as v, {counts},
  {" || ".join([*(f"lag(c, {j}) over o" for j in range(5, 0, -1)), "c"])} as w, {" || ".join(["c", *(f"lead(c, {j}) over o" for j in range(1, 6))])} as x
 from (select *, lead(c) over (partition by doc_id order by i) as d from (select doc_id, source, unnest(string_split({UP}, '')) as c,
  unnest(range(1, length(text) + 1)) as i from documents where length(text) > 0))
 window k as (partition by doc_id order by i rows between {HALF} preceding and {HALF} following),
  h as (partition by doc_id order by i rows between {HALF} preceding and {HALF - 1} following), o as (partition by doc_id order by i))"""


def _ratio(pair: str) -> str:
    left, right = f"n{pair[0].lower()}", f"n{pair[1].lower()}"
    return f"(case when {left} * {right} > 0 then cast(p{pair.lower()} * v as double) / ({left} * {right}) end)"


def _joint(pairs) -> str:
    both = sorted({q for p in pairs for q in (p, chunks.opposite(p))})
    bins = {strand: ", ".join(f"cast({_edges(_ratio(p if strand == '+' else chunks.opposite(p)), RATIO_EDGES)} as bigint) as {p.lower()}_bin" for p in pairs) for strand in "+-"}
    share = f"cast({_edges('(case when v > 0 then cast(ng + nc as double) / v end)', SHARE_EDGES)} as bigint) as gc_bin"
    return f"""with l as {_near(both, "doc_id, source")},
s as (select '+' as strand, w, {share}, {bins["+"]} from l union all select '-', reverse(translate(x, 'ACGT', 'TGCA')) as w, {share}, {bins["-"]} from l)
select strand, cast(coalesce({_code(6)}, 4096) as bigint) as code, gc_bin, {", ".join(f"{p.lower()}_bin" for p in pairs)}, count(*) as n from s group by all"""


def _chunks(t, keys):
    return chunks.of_texts(t("documents"), "text", keys, HALF)


@query(_joint(["CG"]))
def e2_gc_cpg_bins(t):
    """6-mer, GC share bin and CG ratio bin of every position on both strands."""
    return chunks.joint_bins(_chunks(t, []), 6, HALF, ("CG",), SHARE_EDGES, RATIO_EDGES, [])


@query(_joint(["CG", "GG", "TA"]))
def e2_all_pair_bins(t):
    """The same with the bins of GG and TA, read along the strand."""
    return chunks.joint_bins(_chunks(t, []), 6, HALF, ("CG", "GG", "TA"), SHARE_EDGES, RATIO_EDGES, [])


@query(f"""with l as {_near(PAIRS, "source")}
select source, pair, bin, count(*) as n from ({" union all ".join(f"select source, '{p}' as pair, cast({_edges(_ratio(p), RATIO_EDGES)} as bigint) as bin from l" for p in PAIRS)}) group by all""")
def d8_window_bins(t):
    """How many positions of each source have which observed over expected count of each of the 16 pairs in their window."""
    return chunks.pair_bins(_chunks(t, ["source"]), HALF, PAIRS, RATIO_EDGES, ["source"])


@query(f"""select strand, cast(sum(n) as bigint) as positions, count(*) as keys, max(n) as largest from ({_joint(["CG", "GG", "TA"])}) group by strand""")
def e2_key_totals(t):
    """Positions, distinct joint keys and the largest count of each strand: every position counts once."""
    return e2_all_pair_bins(t).groupBy("strand").agg(F.sum("n").alias("positions"), F.count("*").alias("keys"), F.max("n").alias("largest"))


ALLOWED = ((10, 60), (100, 400))


@query(f"""with l as (select doc_id, source, c, i - 1 as p, lag(c) over (partition by doc_id order by i) as b from (select doc_id, source, unnest(string_split({UP}, '')) as c, unnest(range(1, length(text) + 1)) as i from documents where length(text) > 0)),
a as (select * from l where {" or ".join(f"p >= {x} and p < {y}" for x, y in ALLOWED)}),
k as (select source, 1 as k, c as w from a union all select source, 2, coalesce(b || c, 'N') from a)
select source, k, cast(case when regexp_matches(w, '^[ACGT]+$') and length(w) = k then list_sum([(strpos('ACGT', substr(w, j, 1)) - 1) * power(4, k - j) for j in range(1, k + 1)]) else power(4, k) end as bigint) as code, count(*) as n from k group by all""")
def e8_allowed_pairs(t):
    """Bases and pairs of each source at the positions of two allowed intervals of each text; other letters count as one."""
    spans = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ALLOWED))
    rows = chunks.of_texts(t("documents").withColumn("spans", spans), "text", ["source", "spans"], 1)
    return chunks.oriented_kmers(rows, (1, 2), ["source"], "spans").where("strand = '+'").drop("strand")
