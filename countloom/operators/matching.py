"""Pairs of two cohorts with like scores, and how well they match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .pins import pinned
from .ranks import MOST_SENT, cumulative, quantiles, row_numbers, scan

#: Leading hexadecimal digits of a hash that rows are counted by.
DIGITS = 2


def _drawn(rows: DataFrame, key: str, cohort: str, p: str, first: str, second: str, widths: list[float]) -> DataFrame:
    """width, bin, cohort, key, p: at each bin width, equal numbers of both cohorts from each bin of logits by smallest hash of the key.

    Rows are counted by the first digits of their hash; only those of the digits in which a bin's last drawn row lies are ranked."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    base = rows.where(F.col(cohort).isin(first, second) & F.col(p).isNotNull()).select(F.col(key).alias("key"), F.col(cohort).alias("cohort"), F.col(p).alias("p"), F.ln(q / (1 - q)).alias("x"), F.md5(F.col(key).cast("string").cast("binary")).alias("hash"))
    b = base.withColumn("width", F.explode(F.array(*map(F.lit, widths)))).withColumn("bin", F.floor(F.col("x") / F.col("width"))).withColumn("digits", F.conv(F.substring("hash", 1, DIGITS), 16, 10).cast("int")).drop("x")
    by = ["width", "bin", "cohort"]
    sizes = pinned(b.groupBy(*by, "digits").agg(F.count("*").alias("m")))
    whole = sizes.groupBy("width", "bin").agg(*(F.coalesce(F.sum(F.when(F.col("cohort") == c, F.col("m"))), F.lit(0)).alias(n) for c, n in ((first, "n1"), (second, "n2"))))
    upto = F.sum("m").over(W.partitionBy(*by).orderBy("digits")) - F.col("m")  # 16 ** DIGITS rows at most
    cuts = sizes.join(whole.select("width", "bin", F.least("n1", "n2").alias("n")), ["width", "bin"]).withColumn("before", upto)
    cuts = cuts.where("before < n and n <= before + m").select(*by, F.col("digits").alias("cut"), (F.col("n") - F.col("before")).alias("rest"), (F.col("n") == F.col("before") + F.col("m")).alias("all"))
    cuts = pinned(cuts)  # a row a width, bin and cohort; bins without a pair have none
    at = b.join(F.broadcast(cuts) if cuts.count() <= MOST_SENT else cuts, by)
    sure = at.where("digits < cut or digits = cut and all").select(*by, "key", "p")
    last = row_numbers(at.where("digits = cut and not all").select(*by, "key", "p", "hash", "rest"), [F.asc("hash"), F.asc("key")], "r", by)
    return sure.unionByName(last.where("r <= rest").select(*by, "key", "p"))


def logit_pairs(rows: DataFrame, key: str, cohort: str, p: str, first: str, second: str, widths: list[float]) -> DataFrame:
    """width, bin, pair, first_key, second_key, p1, p2: at each bin width, equal numbers of both cohorts are drawn from each bin of logits by smallest hash of the key, and paired by the
    order of their scores. Ranks are two-level, so a hot bin is many tasks."""
    drawn = _drawn(rows, key, cohort, p, first, second, widths)
    s = pinned(row_numbers(drawn, [F.asc("p"), F.asc("key")], "pair", ["width", "bin", "cohort"]))
    side = lambda c, k, v: s.where(F.col("cohort") == c).select("width", "bin", "pair", F.col("key").alias(k), F.col("p").alias(v))
    return side(first, "first_key", "p1").join(side(second, "second_key", "p2"), ["width", "bin", "pair"])


def logit_pair_counts(rows: DataFrame, key: str, cohort: str, p: str, first: str, second: str, widths: list[float]) -> DataFrame:
    """width, bin, p1, p2, n: the pairs of logit_pairs() without their keys, those next to each other with equal scores as one row. Rows are counted by score before anything is ordered."""
    by = ["width", "bin"]
    levels = _drawn(rows, key, cohort, p, first, second, widths).groupBy(*by, "cohort", "p").agg(F.count("*").alias("m"))
    s = cumulative(levels, [F.asc("p")], {"upto": F.col("m")}, [*by, "cohort"])
    score = lambda c: F.max(F.when(F.col("cohort") == c, F.col("p")))
    ends = s.groupBy(*by, "upto").agg(score(first).alias("e1"), score(second).alias("e2"))  # places where a score of either cohort ends
    back = scan(ends.withColumn("at", -F.col("upto")), ["at"], {"p1": ("last", F.col("e1")), "p2": ("last", F.col("e2"))}, by)
    runs = scan(back, ["upto"], {"before": ("max", F.col("upto"))}, by, exclusive=True)
    return runs.select(*by, "p1", "p2", (F.col("upto") - F.coalesce("before", F.lit(0))).alias("n"))


def pair_quality(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row a width: bins, pairs, share of either cohort that is matched, mean, median and largest distance of a pair, and the standardised difference of means. pairs: as logit_pair_counts()
    gives them. sizes: one row with n_first and n_second."""
    pairs = pinned(pairs.withColumn("d", F.abs(F.col("p1") - F.col("p2"))))
    middle = quantiles(pairs, "d", [0.5], ["width"], "n").select("width", F.col("value").alias("median_distance"))
    n = F.col("n")
    mean = lambda c: F.sum(n * F.col(c)) / F.sum(n)
    means = pairs.groupBy("width").agg(mean("p1").alias("m1"), mean("p2").alias("m2"))
    around = lambda i: F.sum(n * (F.col(f"p{i}") - F.col(f"m{i}")) ** 2) / F.nullif(F.sum(n) - 1, F.lit(0))
    spread = F.sqrt((around(1) + around(2)) / 2)
    found = pairs.join(F.broadcast(means), "width").groupBy("width").agg(
        F.countDistinct("bin").alias("bins"), F.sum(n).alias("pairs"), mean("d").alias("mean_distance"), F.max("d").alias("largest_distance"),
        F.try_divide(F.max("m1") - F.max("m2"), spread).alias("standardised_difference"),
    )
    found = found.join(middle, "width").crossJoin(F.broadcast(sizes))
    return found.select("width", "bins", "pairs", (F.col("pairs") / F.col("n_first")).alias("share_first"), (F.col("pairs") / F.col("n_second")).alias("share_second"), "mean_distance", "median_distance", "largest_distance", "standardised_difference")
