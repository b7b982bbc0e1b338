"""Half-open intervals (contig, start, end): offsets, checks, containment by bins, tiles, merging, expansion, nearest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import keyed_hash
from .pins import pinned
from .ranks import cumulative, row_numbers, scan


def with_offsets(intervals: DataFrame, order: list[Column]) -> DataFrame:
    """intervals with length and the running offset before each, in a total order."""
    rows = intervals.withColumn("length", F.col("end") - F.col("start"))
    return cumulative(rows, order, {"stop": F.col("length")}).withColumn("offset", F.col("stop") - F.col("length"))


def template(intervals: DataFrame, order: list[str]) -> DataFrame:
    """All + intervals in order, then the same on -: template_start and template_stop."""
    both = intervals.withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-"))))
    rows = with_offsets(both, [F.col("strand"), *map(F.col, order)])
    return rows.withColumnsRenamed({"offset": "template_start", "stop": "template_stop"})


def violations(intervals: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Per contig: empty or negative intervals, or such as end beyond the contig; those that overlap the one before; with lengths (contig,
    length) also those of unknown contigs. The end before is carried over ranges, so a hot contig is many tasks."""
    rows = intervals.select("contig", "start", "end").withColumn("_id", F.monotonically_increasing_id())
    rows = scan(rows, ["start", "end", "_id"], {"_before": ("last", F.col("end"))}, ["contig"], exclusive=True)
    bad, found = (F.col("start") < 0) | (F.col("end") <= F.col("start")), [F.count_if(F.coalesce(F.col("_before") > F.col("start"), F.lit(False))).alias("overlaps")]
    if lengths is not None:
        known = lengths.select("contig", F.col("length").alias("_length"))
        rows = rows.join(known, "contig", "left")
        bad = bad | F.coalesce(F.col("end") > F.col("_length"), F.lit(False))
        found.append(F.count_if(F.col("_length").isNull()).alias("unknown"))
    return rows.groupBy("contig").agg(F.count_if(bad).alias("bad_bounds"), *found)


def checked_intervals(intervals: DataFrame, lengths: DataFrame) -> DataFrame:
    """intervals, if they are in bounds of known contigs and do not overlap; else ValueError."""
    wrong = violations(intervals, lengths).where("bad_bounds > 0 or overlaps > 0 or unknown > 0").limit(5).collect()
    if wrong:
        raise ValueError(f"bad intervals, of each contig: {[r.asDict() for r in wrong]}")
    return intervals


def checked_lengths(index: DataFrame, least: int = 1) -> DataFrame:
    """index (contig, length, ...), if it has rows, contigs are unique and not null and lengths are at least `least`; else ValueError."""
    facts = index.groupBy("contig").agg(F.count("*").alias("n"), F.min("length").alias("length")).agg(F.count("*").alias("n"), F.count_if(F.expr(f"n > 1 or contig is null or length is null or length < {least}")).alias("bad"))
    n, bad = facts.head()
    if not n or bad:
        raise ValueError("a contig index needs rows, unique names and lengths that are large enough")
    return index


def contained(points: DataFrame, intervals: DataFrame, bin_width: int, how: str = "inner") -> DataFrame:
    """points (contig, pos) with the interval that holds each: an equi-join on (contig, bin), no nested loop."""
    side = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_width), F.floor((F.col("end") - 1) / bin_width))))
    keyed = points.withColumn("_bin", F.floor(F.col("pos") / bin_width))
    if how in ("left_semi", "left_anti"):
        k, s = keyed.alias("k"), side.alias("s")
        on = (F.col("k.contig") == F.col("s.contig")) & (F.col("k._bin") == F.col("s._bin")) & (F.col("s.start") <= F.col("k.pos")) & (F.col("k.pos") < F.col("s.end"))
        return k.join(s, on, how).drop("_bin")
    return keyed.join(side, ["contig", "_bin"], how).where("start <= pos and pos < end").drop("_bin")


def tiles(intervals: DataFrame, width: int) -> DataFrame:
    """(contig, tile, bases): how many bases of the intervals each tile of a fixed grid holds."""
    rows = intervals.withColumn("tile", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    inside = F.least("end", (F.col("tile") + 1) * width) - F.greatest("start", F.col("tile") * width)
    return rows.groupBy("contig", "tile").agg(F.sum(inside).alias("bases"))


def tile_table(intervals: DataFrame, positives: DataFrame, width: int) -> DataFrame:
    """tiles() with positives, their total count, negatives, and both sampling probabilities: a tile's share of positives and of negatives.

    positives: (contig, pos, count), a row a position."""
    hits = positives.groupBy("contig", F.floor(F.col("pos") / width).alias("tile")).agg(F.count("*").alias("positives"), F.sum("count").alias("total"))
    rows = tiles(intervals, width).join(hits, ["contig", "tile"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("positives", "total")}).withColumn("negatives", F.col("bases") - F.col("positives"))
    whole = rows.agg(F.sum("positives").alias("_p"), F.sum("negatives").alias("_n"))
    rows = rows.crossJoin(F.broadcast(whole))
    return rows.withColumn("p_positive", F.try_divide("positives", "_p")).withColumn("p_negative", F.try_divide("negatives", "_n")).drop("_p", "_n")


def merged(intervals: DataFrame) -> DataFrame:
    """Touching and overlapping intervals of a contig as one. The largest end so far is carried over ranges, so a hot contig is many tasks."""
    rows = intervals.select("contig", "start", "end").withColumn("_id", F.monotonically_increasing_id())
    rows = scan(rows, ["start", "end", "_id"], {"_before": ("max", F.col("end"))}, ["contig"], exclusive=True)
    rows = rows.withColumn("_new", F.when(F.col("_before") >= F.col("start"), 0).otherwise(1))
    rows = scan(rows, ["start", "end", "_id"], {"island": ("sum", F.col("_new"))}, ["contig"])
    return rows.groupBy("contig", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def expanded(intervals: DataFrame) -> DataFrame:
    """A row for each position."""
    return intervals.withColumn("pos", F.explode(F.sequence(F.col("start"), F.col("end") - 1)))


def expanded_with(intervals: DataFrame, values: DataFrame, value: str, width: int = 128) -> DataFrame:
    """contig, pos, value: a row for each position of the intervals, with its value of values (contig, pos, value; a row a position), null where there is none.

    Intervals and values meet by tile; a tile's positions become rows behind the join, so they are never shuffled."""
    side = intervals.withColumn("_tile", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    side = side.select("contig", "_tile", F.greatest("start", F.col("_tile") * width).alias("_lo"), F.least("end", (F.col("_tile") + 1) * width).alias("_hi"))
    held = values.groupBy("contig", F.floor(F.col("pos") / width).alias("_tile")).agg(F.map_from_entries(F.collect_list(F.struct("pos", value))).alias("_held"))
    rows = side.join(held, ["contig", "_tile"], "left").withColumn("pos", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)))
    return rows.select("contig", "pos", F.try_element_at("_held", F.col("pos")).alias(value))


def pooled(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Two sparse replicates (keys, count) by full outer join: r1, r2, count, target."""
    rows = first.withColumnRenamed("count", "r1").join(second.withColumnRenamed("count", "r2"), keys, "full_outer")
    r1, r2 = F.coalesce("r1", F.lit(0)), F.coalesce("r2", F.lit(0))
    return rows.select(*keys, r1.alias("r1"), r2.alias("r2"), (r1 + r2).alias("count"), ((r1 + r2) > 0).cast("int").alias("target"))


def nearest(queries: DataFrame, events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of queries (contig, pos, ...) the nearest event (contig, pos) of the contig, or of equal `by` columns: near, distance; the left one wins ties.

    The last event on each side is carried over ranges of positions, so a hot contig is many tasks."""
    by = by or ["contig"]
    rows = queries.withColumn("_id", F.monotonically_increasing_id()).withColumn("_e", F.lit(None).cast("long"))
    rows = rows.unionByName(events.select(*by, "pos").distinct().withColumn("_e", F.col("pos")), allowMissingColumns=True)
    rows = rows.withColumn("_q", F.col("_e").isNull().cast("int")).withColumn("_back", -F.col("pos")).withColumn("_id", F.coalesce("_id", F.lit(-1)))
    rows = scan(rows, ["pos", "_q", "_id"], {"_l": ("last", F.col("_e"))}, by)
    rows = scan(rows, ["_back", "_q", "_id"], {"_r": ("last", F.col("_e"))}, by)
    near = F.when(F.col("_r").isNull() | (F.col("pos") - F.col("_l") <= F.col("_r") - F.col("pos")), F.col("_l")).otherwise(F.col("_r"))
    return rows.where("_q = 1").select(*queries.columns, near.alias("near"), F.abs(F.col("pos") - near).alias("distance"))


def nearest_by_strand(queries: DataFrame, events: DataFrame) -> DataFrame:
    """queries (contig, pos, strand, ...) with mode (same, opposite, any strand), near, distance, and oriented: near less pos along the query's strand."""
    other = F.when(F.col("strand") == "+", "-").otherwise("+")
    asked = queries.withColumn("mode", F.explode(F.array(*map(F.lit, ("same", "opposite", "any")))))
    asked = asked.withColumn("_want", F.when(F.col("mode") == "same", F.col("strand")).when(F.col("mode") == "opposite", other).otherwise("any"))
    offered = events.select("contig", "pos", F.explode(F.array("strand", F.lit("any"))).alias("_want"))
    out = nearest(asked, offered, ["contig", "_want"]).drop("_want")
    return out.withColumn("oriented", (F.col("near") - F.col("pos")) * F.when(F.col("strand") == "+", 1).otherwise(-1))


def population_join(population: DataFrame, positives: DataFrame, on: list[str]) -> DataFrame:
    """population (on, total) with positive, 0 where positives (on, positive) has no row; ValueError where positives exceed the population or fall outside it."""
    rows = pinned(checked_join(population, positives, on, "full_outer", "one_to_one"))
    if not rows.where("total is null or positive > total").isEmpty():
        raise ValueError("more positives than population")
    return rows.withColumn("positive", F.coalesce("positive", F.lit(0)).cast("long"))


def category_scores(rows: DataFrame, scores: DataFrame, on: list[str], score: str = "score") -> DataFrame:
    """rows with the score of their category; ValueError where a category that occurs has none."""
    missing = rows.select(*on).distinct().join(scores.where(F.col(score).isNotNull()), on, "left_anti")
    if not missing.isEmpty():
        raise ValueError(f"categories without a score, such as {missing.limit(3).collect()}")
    return checked_join(rows, scores, on, "left")


def linear_positions(index: DataFrame, spans: DataFrame, bin_width: int, column: str = "template_index") -> DataFrame:
    """index rows (column, ...) with contig, strand and pos, through spans (contig, strand, start, template_start, template_stop); ValueError out of range."""
    side = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("template_start") / bin_width), F.floor((F.col("template_stop") - 1) / bin_width))))
    rows = index.withColumn("_bin", F.floor(F.col(column) / bin_width))
    inside = (F.col(f"r.{column}") >= F.col("s.template_start")) & (F.col(f"r.{column}") < F.col("s.template_stop"))
    out = rows.alias("r").join(side.alias("s"), (F.col("r._bin") == F.col("s._bin")) & inside, "left")
    out = pinned(out.select("r.*", "s.contig", "s.strand", (F.col("s.start") + F.col(f"r.{column}") - F.col("s.template_start")).alias("pos")).drop("_bin"))
    if not out.where("contig is null").isEmpty():
        raise ValueError("an index lies outside the template")
    return out


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """A join whose right side (for one_to_one both) must have unique keys; raises before joining."""
    for side, name in ((right, "right"), *(((left, "left"),) if validate == "one_to_one" else ())):
        if not side.groupBy(*on).count().where("count > 1").isEmpty():
            raise ValueError(f"keys {on} of the {name} side are not unique")
    return left.join(right, on, how)


def weighted_draws(rows: DataFrame, draws: DataFrame, p: str, hi: str, buckets: int) -> DataFrame:
    """draws (u from 0 to 1, ...) with the row in whose part of the running sum of shares (p, and hi with the row itself) u falls: rows and draws meet by the bucket of
    the sum, so the work goes with both and not with their product."""
    most = F.lit(buckets - 1)
    bucket = lambda x: F.least(F.greatest(F.floor(x * buckets), F.lit(0)), most)
    low = F.col(hi) - F.col(p)
    parts = rows.where(F.col(p) > 0).withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(F.col(hi)))))
    return draws.withColumn("_bucket", bucket(F.col("u"))).join(parts, "_bucket").where((F.col("u") >= low) & (F.col("u") < F.col(hi))).drop("_bucket")


ROUNDS = 4


def permuted(index: Column, half: int, seed: int) -> Column:
    """A keyed permutation of the numbers below 4^half: rounds that add a hash of one half of the bits to the other."""
    mask = F.lit((1 << half) - 1).cast("long")
    left, right = F.shiftright(index, half), index.bitwiseAND(mask)
    for r in range(ROUNDS):
        mixed = F.conv(F.substring(keyed_hash(right, f"{seed}:{r}"), 1, 8), 16, 10).cast("long").bitwiseAND(mask)
        left, right = right, left.bitwiseXOR(mixed)
    return F.shiftleft(left, half) + right


def background(intervals: DataFrame, n: int, seed: int) -> DataFrame:
    """(draw, contig, pos) of n different positions, uniform over all bases of disjoint intervals (all of them when there are fewer).

    The numbers 0, 1, 2 and so on go through a keyed permutation of the powers of four above the number of bases; those that fall below it are linear
    indices, all different, and are decoded to positions. So work goes with n and with the number of intervals, never with the number of bases."""
    spans = pinned(with_offsets(intervals.select("contig", "start", "end"), [F.col("contig"), F.col("start")]))
    total, count = spans.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)), F.count("*")).head()
    spark, half = intervals.sparkSession, max(1, -(-max(int(total) - 1, 1).bit_length() // 2))
    most = min(4**half, int(1.1 * n * 4**half / max(total, 1)) + 64)
    while True:
        found = pinned(spark.range(most).select(F.col("id"), permuted(F.col("id"), half, seed).alias("template_index")).where(F.col("template_index") < total))
        if most == 4**half or found.count() >= n:
            break
        most = min(4**half, 2 * most)
    found = row_numbers(found, [F.asc("id")], "draw").where(F.col("draw") <= n).select((F.col("draw") - 1).alias("draw"), "template_index")
    place = spans.select("contig", F.lit("+").alias("strand"), "start", F.col("offset").alias("template_start"), (F.col("offset") + F.col("end") - F.col("start")).alias("template_stop"))
    return linear_positions(found, place, max(1, int(total) // max(1, 4 * count))).select("draw", "contig", "pos")
