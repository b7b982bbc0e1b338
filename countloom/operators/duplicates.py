"""Equal texts without shipping them: rows are grouped by digests, and letters are compared only where a digest has two kinds of check value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pins import pinned


def text_groups(df: DataFrame, text: str, fold: Column | None = None) -> DataFrame:
    """digest, length, n, folds: a row for each distinct text (null is one): how often it stands in df, and the numbers 0 to 62 of `fold` that its rows have, as bits.

    Texts are grouped by a 128-bit digest and their length. Each group carries the least and the largest of a 64-bit check of another kind; where these
    differ, the texts themselves are grouped. Partial counts are made before the shuffle, so a text that a third of the rows have is no hot key."""
    number = F.coalesce(fold, F.lit(0)).cast("int") if fold is not None else F.lit(0)
    rows = df.select(F.unhex(F.md5(F.col(text).cast("binary"))).alias("digest"), F.length(text).alias("length"), F.xxhash64(text).alias("_check"), F.call_function("shiftleft", F.lit(1).cast("long"), number).alias("_fold"), F.col(text).alias("_text"))
    groups = pinned(rows.groupBy("digest", "length").agg(F.count("*").alias("n"), F.bit_or("_fold").alias("folds"), F.min("_check").alias("_low"), F.max("_check").alias("_high")))
    mixed = groups.where("_low <> _high").select("digest", "length")
    good = groups.where("_low = _high").select("digest", "length", "n", "folds")
    if mixed.isEmpty():
        return good
    apart = rows.join(mixed, ["digest", "length"]).groupBy("digest", "length", "_text").agg(F.count("*").alias("n"), F.bit_or("_fold").alias("folds"))
    return good.unionByName(apart.drop("_text"))


def summary(groups: DataFrame) -> DataFrame:
    """One row: rows, distinct texts, excess rows, the largest group, groups that span folds and the rows in them."""
    spans = F.bit_count("folds") > 1
    n = F.col("n")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return groups.agg(zero(F.sum(n)).alias("rows"), F.count("*").alias("distinct_texts"), zero(F.sum(n - 1)).alias("excess"), zero(F.max(n)).alias("largest"), F.count_if(spans & (n > 1)).alias("spanning"), zero(F.sum(F.when(spans & (n > 1), n))).alias("rows_spanning"))
