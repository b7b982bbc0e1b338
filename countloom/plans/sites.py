"""Queries on the letters around sites: events stand at places of the text that their user number names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks, duplicates, segments, sites
from ..operators.pins import pinned_path
from ..sources import indexed
from .registry import query
from .sequences import FOLDED, UP

SITES = f"""(select event_id, event_type, doc_id, event_id % length(text) as pos, case when event_type in ('click', 'purchase') then '-' else '+' end as strand, text, {UP} as up,
  {FOLDED} as seq from events join documents on user_id = doc_id where length(text) > 0)"""


def event_sites(t):
    """A site for each event: contig (its user number as doc_id), pos, strand."""
    lengths = t("documents").where(F.length("text") > 0).select("doc_id", F.length("text").alias("_n"))
    rows = t("events").join(lengths, F.col("user_id") == F.col("doc_id"))
    strand = F.when(F.col("event_type").isin("click", "purchase"), "-").otherwise("+")
    return rows.select("event_id", "event_type", "doc_id", (F.col("event_id") % F.col("_n")).alias("pos"), strand.alias("strand"))


def site_contexts(t, half):
    return sites.contexts(t("documents"), event_sites(t), "doc_id", "text", half)


def context(half: int) -> str:
    whole = f"substr(repeat('N', {half}) || seq || repeat('N', {half}), cast(pos as bigint) + 1, {2 * half + 1})"
    return f"case when strand = '-' then reverse(translate({whole}, 'ACGT', 'TGCA')) else {whole} end"


@query(f"select event_id, strand, {context(5)} as context from {SITES}")
def d1_oriented_context(t):
    """The letters around each event's place, along its strand, N outside of the text."""
    return site_contexts(t, 5).select("event_id", "strand", "context")


def folded_sequences(t) -> str:
    """The path of sequence files of the texts, every letter but A, C, G and T in either case as N."""
    path = pinned_path(t.spark, "sequences")
    fold = indexed.letters_as("ACGT", "N")
    fold[[ord(c) for c in "acgt"]] = [ord(c) for c in "ACGT"]
    indexed.write_sequences(t("documents").where(F.length("text") > 0), "doc_id", "text", path, letters=fold)
    return path


@query(f"select event_id, strand, {context(20)} as context from {SITES}")
def d1_indexed_contexts(t):
    """The same with 20 letters each way, read by byte ranges from sequence files through their index."""
    path = folded_sequences(t)
    asked = event_sites(t).select("event_id", "strand", "pos", F.col("doc_id").cast("string").alias("contig"))
    return indexed.indexed_contexts(indexed.build_index(t.spark, path), asked, 20).select("event_id", "strand", "context")


@query(f"""with d as (select doc_id, length(text) as n from documents where length(text) > 0)
select cast(doc_id as varchar) as contig, cast(n as bigint) as length, cast(least(n, 60) as bigint) as line_bases, cast(least(n, 60) + 1 as bigint) as line_bytes from d""")
def a2_built_index(t):
    """The index of sequence files, built from the files; where a record stands in its file depends on how the files were written, so offsets are tested by reading."""
    path = folded_sequences(t)
    return indexed.build_index(t.spark, path).select("contig", "length", "line_bases", "line_bytes")


@query(f"""with c as (select event_id, {context(3)} as context from {SITES})
select event_id, cast(i - 4 as bigint) as at, substr(context, i, 1) as base from c, (select unnest(range(1, 8)) as i) where substr(context, i, 1) <> 'A'""")
def d3_positional_bases(t):
    """The ones of the one-hot code around each event's place in long form: A is the reference and has no row, N is every other letter."""
    return sites.offset_letters(site_contexts(t, 3), 3, ["event_id"]).where("base <> 'A'")


@query(f"""with c as (select event_type = 'purchase' as y, {context(20)} as context from {SITES})
select cast(i - 21 as bigint) as at, substr(context, i, 1) as base, count(*) filter (where y) as ones, count(*) filter (where not y) as zeros
from c, (select unnest(range(1, 42)) as i) group by 1, 2""")
def e13_base_frequency(t):
    """Bases at offsets -20 to 20 of the places of purchases and of other events."""
    rows = site_contexts(t, 20).select((F.col("event_type") == "purchase").alias("y"), "context")
    rows = rows.groupBy("y", "context").agg(F.count("*").alias("n"))
    rows = sites.offset_letters(rows, 20, ["y", "n"])
    of = lambda keep: F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0))
    return rows.groupBy("at", "base").agg(of(F.col("y")).alias("ones"), of(~F.col("y")).alias("zeros"))


@query(f"""with w as (select event_id, cast(w as bigint) as width, pos - w // 2 < 0 or pos + w // 2 >= length(text) as edge,
  substr(text, cast(greatest(pos - w // 2, 0) as bigint) + 1, cast(least(pos + w // 2 + 1, length(text)) - greatest(pos - w // 2, 0) as bigint)) as s from {SITES}, (select unnest([51, 201, 1001]) as w)),
c as (select event_id, width, edge, length(s) as n, length(regexp_replace(s, '[^CGcg]', '', 'g')) as gc, length(regexp_replace(s, '[^ACGTacgt]', '', 'g')) as v, length(regexp_replace(s, '[^acgt]', '', 'g')) as low from w)
select event_id, width, edge, round(gc / nullif(v, 0), 10) as gc_share, cast(n - v as bigint) as other_letters, round(low / nullif(v, 0), 10) as lower_share, v = 0 as missing from c""")
def d9_composition_widths(t):
    """The composition around each event's place at three widths, whether the window meets an edge, and whether it holds no base."""
    rows = sites.windows_at(t("documents"), event_sites(t), "doc_id", "text", 500)
    rows = sites.composition(rows, [51, 201, 1001], 500)
    share = lambda c: F.round(F.try_divide(c, "valid"), 10)
    return rows.select("event_id", "width", "edge", share("gc").alias("gc_share"), (F.col("n") - F.col("valid")).alias("other_letters"), share("lower").alias("lower_share"), (F.col("valid") == 0).alias("missing"))


RUNS = """(select doc_id, kind, min(i) as start, max(i) + 1 as "end" from (select doc_id, kind, i, i - row_number() over (partition by doc_id, kind order by i) as run from (
  select doc_id, i - 1 as i, case when c in ('A', 'C', 'G', 'T') then 'upper' when c in ('a', 'c', 'g', 't') then 'lower' else 'other' end as kind
  from (select doc_id, unnest(string_split(text, '')) as c, unnest(range(1, length(text) + 1)) as i from documents where length(text) > 0))) group by doc_id, kind, run)"""


def runs(t):
    return segments.segments(chunks.of_texts(t("documents"), "text", ["doc_id"], 0), "doc_id")


@query(f"""with r as {RUNS} select doc_id, kind, count(*) as n_runs, cast(sum("end" - start) as bigint) as letters, cast(max("end" - start) as bigint) as longest,
  cast(sum(start) as bigint) as starts, cast(sum(start * ("end" - start)) as bigint) as weighted_starts from r group by 1, 2""")
def e8_segments(t):
    """Runs of upper-case bases, of lower-case ones and of other letters of each text: how many, how long, and sums of where they start."""
    size = F.col("end") - F.col("start")
    return runs(t).groupBy("doc_id", "kind").agg(F.count("*").alias("n_runs"), F.sum(size).alias("letters"), F.max(size).alias("longest"), F.sum("start").alias("starts"), F.sum(F.col("start") * size).alias("weighted_starts"))


@query(f"""with r as {RUNS} select doc_id, kind, cast(start as bigint) as start, cast("end" as bigint) as "end" from r where kind <> 'other' and "end" - start >= 5""")
def e8_long_segments(t):
    """Every run of at least five bases of one case, with its coordinates."""
    return runs(t).where("kind <> 'other' and end - start >= 5").select("doc_id", "kind", "start", "end")


@query("""with d as (select text, count(*) as n, count(distinct coalesce(source, '')) as s from documents group by 1)
select count(*) as distinct_texts, cast(sum(n - 1) as bigint) as excess, max(n) as largest, count(*) filter (where n > 1 and s > 1) as spanning from d""")
def e11_duplicate_texts(t):
    """Equal texts, by digest; sources are numbered as folds, of which at most 63 are told apart."""
    names = t("documents").select(F.coalesce("source", F.lit("")).alias("s")).distinct().orderBy("s").limit(64).collect()  # a row a source
    if len(names) > 63:
        raise ValueError("more than 63 sources")
    number = F.coalesce(*(F.when(F.coalesce("source", F.lit("")) == r.s, i) for i, r in enumerate(names)), F.lit(0))
    return duplicates.summary(duplicates.text_groups(t("documents"), "text", number)).select("distinct_texts", "excess", "largest", "spanning")


@query(f"""with w as (select {context(4)} as context, event_id % 3 as fold from {SITES}), g as (select context, count(*) as n, count(distinct fold) as folds from w group by 1)
select cast(sum(n) as bigint) as rows, count(*) as distinct_windows, cast(sum(n - 1) as bigint) as excess, max(n) as largest, count(*) filter (where folds > 1) as spanning,
  cast(coalesce(sum(n) filter (where folds > 1), 0) as bigint) as rows_spanning from g""")
def e11_duplicate_windows(t):
    """Windows of nine letters around the events' places: distinct, excess, the largest group, groups over several of three folds and their rows."""
    rows = site_contexts(t, 4).withColumn("fold", F.col("event_id") % 3)
    return duplicates.summary(duplicates.text_groups(rows, "context", F.col("fold"))).withColumnRenamed("distinct_texts", "distinct_windows")
