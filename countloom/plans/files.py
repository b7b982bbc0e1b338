"""Queries that write tables as files in the shared folder and read them back."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from ..functions.scalars import keyed_hash
from ..operators import intervals
from ..operators.pins import pinned_path
from ..sources import indexed, lines, tables
from .registry import query

WIDTH, HALO, LINE = 1000, 50, 60


@query(f"""with s as (select cast(doc_id as varchar) as contig, regexp_replace(text, '[^A-Za-z]', '', 'g') as s from documents),
c as (select contig, s, length(s) as n, unnest(range(0, (length(s) + {WIDTH - 1}) // {WIDTH})) as k from s where length(s) > 0)
select contig, k as chunk_id, k * {WIDTH} as core_start, least((k + 1) * {WIDTH}, n) as core_end, least(k * {WIDTH}, {HALO}) as pad_left,
md5(substr(s, greatest(k * {WIDTH} - {HALO}, 0) + 1, least((k + 1) * {WIDTH} + {HALO}, n) - greatest(k * {WIDTH} - {HALO}, 0))) as bases_md5 from c""")
def a1_sequence_chunks(t):
    """The texts' letters as headed records of 60-letter lines, written and read back as chunks with halos."""
    path = pinned_path(t.spark, "records")
    indexed.write_sequences(t("documents").where(F.col("text").rlike("[A-Za-z]")), "doc_id", "text", path, LINE, indexed.letters_as(string.ascii_letters))
    found = lines.chunks(lines.records(t.spark, path), WIDTH, HALO)
    return found.select("contig", "chunk_id", "core_start", "core_end", "pad_left", F.md5(F.col("bases").cast("binary")).alias("bases_md5"))


@query("""with s as (select user_id, cast(floor(epoch(ts) / 3600) as bigint) as pos, event_type, count(*) as n from events group by 1, 2, 3)
select user_id as contig, event_type as strand, count(*) as positions, cast(sum(n) as bigint) as total from s group by 1, 2""")
def a5_sparse_signal(t):
    """Hour counts as one-base intervals with text counts through the checked reader."""
    pos = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour("ts")
    s = t("events").groupBy(F.col("user_id").alias("contig"), pos.alias("start"), F.col("event_type").alias("strand")).agg(F.count("*").alias("n"))
    bed = s.select("contig", "start", (F.col("start") + 1).alias("end"), "strand", F.col("n").cast("string").alias("count"))
    spans = bed.groupBy("contig").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    found = tables.sparse_signal(bed, spans)
    return found.groupBy("contig", "strand").agg(F.count("*").alias("positions"), F.sum("count").alias("total"))


PRICES = "select row_number() over (order by o_orderkey) - 1 as line_no, case when o_orderkey % 3 = 0 then 0 else o_totalprice end as v from orders"


@query(f"select cast(line_no as bigint) as line_no, v as value from ({PRICES}) where v > 0")
def a6_dense_values(t):
    """A value a line in key order, written as one ordered set of parts and joined back by line number."""
    rows = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("v"))
    path = pinned_path(rows.sparkSession, "dense")
    lines.write_ordered(rows, [F.asc("o_orderkey")], F.col("v").cast("string"), path)
    found = lines.read_ordered(rows.sparkSession, path).select("line_no", F.col("value").cast("double").alias("value"))
    return found.where("value > 0")


@query("""with b as (select o_orderkey, k.strand, (o_totalprice % 100) / 100 as p from orders, (values ('+'), ('-')) k(strand))
select cast(row_number() over (order by strand, o_orderkey) - 1 as bigint) as line_no, round(p, 5) as prediction from b""")
def a13_prediction_file(t):
    """All + then all -, template order, five decimals, gzip; read back."""
    both = t("orders").select("o_orderkey", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand"), (F.col("o_totalprice") % 100 / 100).alias("p"))
    path = pinned_path(both.sparkSession, "predictions")
    lines.write_ordered(both, [F.asc("strand"), F.asc("o_orderkey")], F.format_string("%.5f", "p"), path)
    return lines.read_ordered(both.sparkSession, path).select("line_no", F.round(F.col("value").cast("double"), 5).alias("prediction"))


ALL = ["customer", "orders", "lineitem", "events", "documents", "labels"]


@query(" union all ".join(f"select '{n}' as name, count(*) as n_rows, cast((select count(*) from (describe {n})) as integer) as n_columns, true as has_files from {n}" for n in ALL))
def a9_file_inventory(t):
    """Rows, columns and digests of the files behind the tables."""
    root = t("labels").inputFiles()[0].rsplit("/labels.parquet", 1)[0]
    report = tables.Catalog(t("labels").sparkSession, root, ALL, ["absent"]).file_report()
    return report.select(F.col("table").alias("name"), "n_rows", "n_columns", ((F.col("bytes") > 0) & (F.length("sha256") == 64)).alias("has_files"))


@query(" union all ".join(f"select '{c}' as column_name, '{r}' as role, {a} as at_inference, count(*) - count({c}) as n_null, count({c}) as n_values from lineitem" for c, r, a in (
    ("l_orderkey", "id", "true"), ("l_quantity", "feature", "true"), ("l_discount", "feature", "true"), ("l_tax", "output", "false"), ("l_returnflag", "target", "false"))))
def a10_schema_catalog(t):
    rows = t("lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    report = tables.schema_report(rows, "l_orderkey", "l_returnflag", rows.drop("l_tax", "l_returnflag"))
    return report.select(F.col("column").alias("column_name"), "role", "at_inference", "n_null", "n_values")


@query("select case when o_custkey % 5 = 0 then 'test' else 'train' end as name, count(*) as n_rows, cast(sum(o_orderkey) as bigint) as keys from orders group by 1")
def a12_saved_split(t):
    """Two tables saved with digests, saved again (the same result is kept), loaded and verified."""
    o = t("orders")
    parts = {"train": o.where("o_custkey % 5 <> 0"), "test": o.where("o_custkey % 5 = 0")}
    path = pinned_path(o.sparkSession, "split")
    tables.save_split(parts, path)
    tables.save_split(parts, path)
    found = tables.load_split(o.sparkSession, path)
    one = lambda n: found[n].agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("keys")).select(F.lit(n).alias("name"), "n_rows", "keys")
    return one("train").unionByName(one("test"))


@query("""with s as (select o_custkey as contig, count(*) as n, min(cast(o_orderdate as date)) as d from orders group by 1), r as (select *, row_number() over (order by
  md5(cast(contig as varchar) || ':file'), contig) - 1 as r from s)
select cast(r as bigint) as line_no, contig, n as length, cast(sum(n) over (order by r) - n as bigint) as whitelist_offset from r""")
def a3_file_order(t):
    """Half-open intervals written in no key order and read back with their lengths and running offsets in the order of the file."""
    s = t("orders").groupBy(F.col("o_custkey").alias("contig")).agg(F.count("*").alias("n")).withColumn("h", keyed_hash("contig", "file"))
    path = pinned_path(s.sparkSession, "intervals")
    lines.write_ordered(s, [F.asc("h"), F.asc("contig")], F.concat_ws("\t", "contig", F.lit(0), "n"), path)
    parts = F.split("value", "\t")
    rows = lines.read_ordered(s.sparkSession, path).select("line_no", parts[0].cast("long").alias("contig"), parts[1].cast("long").alias("start"), parts[2].cast("long").alias("end"))
    return intervals.with_offsets(rows, [F.asc("line_no")]).select("line_no", "contig", "length", F.col("offset").alias("whitelist_offset"))


NAMED = ("customer", "labels", "lineitem", "orders")


@query(" union all ".join(f"select '{n}' as name, count(*) as n_rows from {n}" for n in NAMED))
def a8_catalog(t):
    """Rows of each table of a catalog of required and optional tables; an optional one that is not there is left out."""
    found = tables.Catalog(t.spark, t.root, ["orders", "lineitem"], ["customer", "labels", "no_such_table"]).load_all()
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows")) for name, df in sorted(found.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
