"""Texts to 2-mer counts to scores to exact ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import counts, metrics
from .registry import query


@query("""
with c as (select doc_id, unnest(string_split(text, '')) as c, unnest(range(1, length(text) + 1)) as i from documents where length(text) > 0 and doc_id in (select doc_id from labels)),
v as (select doc_id, c || lead(c) over (partition by doc_id order by i) as word from c),
w as (select word, quality as y from v join labels using (doc_id) where word is not null),
t as (select word, count(*) as total, sum(y) as positive from w group by word),
g as (select sum(positive) / sum(total) as p from t),
s as (select word, total, positive, (positive + 1.0) / (total + 1.0 / p) as score from t, g),
l as (select score, sum(total) as total, sum(positive) as positive from s group by score),
k as (select *, sum(total) over (order by score desc) as ct, sum(positive) over (order by score desc) as cp from l)
select cast(sum(total) as bigint) as windows, cast(sum(positive) as bigint) as positive, count(*) as levels,
  round(sum(positive * cp / ct) / sum(positive), 10) as average_precision from k
""")
def flagship_kmer_score(t):
    rows = t("documents").join(t("labels"), "doc_id").select("text", F.col("quality").alias("y"))
    found = counts.word_counts(rows, "text", 2, ["y"])
    table = found.groupBy("word").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("y")).alias("positive"))
    levels = counts.smoothed_scores(table).groupBy("score").agg(F.sum("total").alias("total"), F.sum("positive").alias("positive"))
    ap = metrics.average_precision(levels)
    return ap.crossJoin(F.broadcast(levels.agg(F.count("*").alias("levels")))).select(F.col("total").alias("windows"), "positive", "levels", rounded(F.col("ap")).alias("average_precision"))
