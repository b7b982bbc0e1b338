"""Two-level cumulative sums and ranks: no window ever sees the whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .pins import pinned, tasks_for


def _spread(df: DataFrame, order: list[Column], parts: int | None) -> DataFrame:
    """df dealt by range of the order, with the partition each row went to. Range bounds are drawn from a
    sample, and two plans over the same rows may draw them apart, so the rows are pinned with their partition."""
    n = parts or tasks_for(df)
    return pinned(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def cumulative(df: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """df with running totals (inclusive) of `sums` in `order`, overall or in each group `by`.

    order must tell all rows apart (group ties first). Rows are dealt by range; totals of each partition
    (one row a partition and group) are accumulated in a small window and added to windows inside the partitions."""
    by = by or []
    rows = _spread(df, [*(F.col(c) for c in by), *order], parts)
    inside = W.partitionBy("_part", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    total = rows.groupBy("_part", *by).agg(*(F.sum(c).alias(f"_t_{k}") for k, c in sums.items()))
    shift = total.select("_part", *(F.col(c).alias(f"_by_{c}") for c in by), *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in sums))
    part = rows.withColumns({f"_r_{k}": F.sum(c).over(inside) for k, c in sums.items()})
    shift = shift.withColumnRenamed("_part", "_p2")
    same = [F.col("_part") == F.col("_p2"), *(F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by)]
    out = part.join(shift, same)
    return out.select(*df.columns, *((F.col(f"_r_{k}") + F.col(f"_s_{k}")).alias(k) for k in sums))


def row_numbers(df: DataFrame, order: list[Column], name: str = "row", by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """df with 1-based positions in a total order."""
    return cumulative(df, order, {name: F.lit(1).cast("long")}, by, parts)


def value_ranks(df: DataFrame, value: str, descending: bool = False, parts: int | None = None) -> DataFrame:
    """One row a distinct value: value, n, dense (1-based), below (rows before it), average (mean rank of its ties)."""
    counts = df.groupBy(value).agg(F.count("*").cast("long").alias("n"))
    order = [F.desc(value) if descending else F.asc(value)]
    out = cumulative(counts, order, {"upto": F.col("n"), "dense": F.lit(1).cast("long")}, parts=parts)
    return out.select(value, "n", "dense", (F.col("upto") - F.col("n")).alias("below"), (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias("average"))


def scan(df: DataFrame, order: list[str], found: dict[str, tuple[str, Column]], by: list[str] | None = None, parts: int | None = None, exclusive: bool = False) -> DataFrame:
    """df with running values in ascending `order`, overall or in each group `by`, the row itself included unless exclusive.

    found: name -> (kind, column) with kind sum, max or last (the last value that is not null). As in cumulative(), order must tell
    rows apart, rows are dealt by range, and one row a partition and group carries values over, so a hot group is many tasks."""
    by = by or []
    rows = _spread(df, [*(F.col(c) for c in by), *(F.col(c) for c in order)], parts)
    inside = W.partitionBy("_part", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    over = {"sum": lambda c, w: F.sum(c).over(w), "max": lambda c, w: F.max(c).over(w), "last": lambda c, w: F.last(c, True).over(w)}
    whole = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.struct(*order)))}
    total = rows.groupBy("_part", *by).agg(*(whole[kind](c).alias(f"_t_{k}") for k, (kind, c) in found.items()))
    shift = total.select(F.col("_part").alias("_p2"), *(F.col(c).alias(f"_by_{c}") for c in by), *(over[kind](F.col(f"_t_{k}"), before).alias(f"_s_{k}") for k, (kind, _) in found.items()))
    part = rows.withColumns({f"_r_{k}": over[kind](c, inside) for k, (kind, c) in found.items()})
    same = [F.col("_part") == F.col("_p2"), *(F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by)]
    r, s = (lambda k: F.col(f"_r_{k}")), (lambda k: F.col(f"_s_{k}"))
    join = {"sum": lambda k: F.coalesce(r(k), F.lit(0)) + F.coalesce(s(k), F.lit(0)), "max": lambda k: F.greatest(r(k), s(k)), "last": lambda k: F.coalesce(r(k), s(k))}
    return part.join(shift, same).select(*df.columns, *(join[kind](k).alias(k) for k, (kind, _) in found.items()))


#: Groups whose rows may be sent to every task.
MOST_SENT = 1_000_000


def _per_group(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """rows joined to groups (by as _by_*, a row each), null-safe: by broadcast where they are counted to be few, else by a shuffle; one row where there is no `by`."""
    if not by:
        return rows.crossJoin(F.broadcast(groups))
    groups = pinned(groups)
    same = [F.col(x).eqNullSafe(F.col(f"_by_{x}")) for x in by]
    return rows.join(F.broadcast(groups) if groups.count() <= MOST_SENT else groups, same)


def quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """by, q, value: exact linear quantiles of the values that are not null, from two-level ranks of distinct values, so that no task
    holds all values. weight: how often a row counts. A group's ranks that are asked for travel as one row; each level picks those that fall on it."""
    by = by or []
    n = F.sum(weight) if weight else F.count("*")
    levels = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(n.cast("long").alias("_n"))
    c = pinned(cumulative(levels, [F.asc("_v")], {"_upto": F.col("_n")}, by))
    at = c.groupBy(*(F.col(x).alias(f"_by_{x}") for x in by)).agg(F.max("_upto").alias("_all")).where("_all is not null")
    place = lambda q: F.lit(float(q)) * (F.col("_all") - 1)
    asked = F.flatten(F.array(*(F.array_distinct(F.array(*(F.struct(F.lit(float(q)).alias("q"), place(q).alias("p"), (f(place(q)) + 1).alias("r")) for f in (F.floor, F.ceil)))) for q in probs)))
    at = at.select(*(f"_by_{x}" for x in by), asked.alias("_asked"))
    here = F.filter("_asked", lambda x: (F.col("_upto") - F.col("_n") < x["r"]) & (x["r"] <= F.col("_upto")))
    found = _per_group(c, at, by).select(*by, "_v", F.explode(here).alias("_a")).groupBy(*by, F.col("_a.q").alias("q"), F.col("_a.p").alias("_p")).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    return found.select(*by, "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_p") - F.floor("_p"))).alias("value"))


def weighted_quantiles(df: DataFrame, value: str, weight: str, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """by, q, value: quantiles by mid-point weights: a distinct value stands at (weight so far - own weight / 2) / all weight; linear between
    two of them, the end values beyond."""
    by = by or []
    levels = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.sum(weight).cast("double").alias("_w")).where("_w > 0")
    c = pinned(cumulative(levels, [F.asc("_v")], {"_upto": F.col("_w")}, by))
    whole = c.groupBy(*(F.col(x).alias(f"_by_{x}") for x in by)).agg(F.max("_upto").alias("_all"))
    c = _per_group(c, whole, by).withColumn("_at", (F.col("_upto") - F.col("_w") / 2) / F.col("_all"))
    c = c.select(*by, "_at", "_v", F.explode(F.array(*(F.lit(float(p)) for p in probs))).alias("q"))
    low, high = F.col("_at") <= F.col("q"), F.col("_at") >= F.col("q")
    end = F.struct("_at", "_v")
    out = c.groupBy(*by, "q").agg(F.max(F.when(low, end)).alias("l"), F.min(F.when(high, end)).alias("h"))
    a, b, x, y = F.col("l._at"), F.col("h._at"), F.col("l._v"), F.col("h._v")
    inside = F.when(a == b, x).otherwise(x + (y - x) * (F.col("q") - a) / (b - a))
    return out.select(*by, "q", F.when(F.col("l").isNull(), y).when(F.col("h").isNull(), x).otherwise(inside).alias("value"))
