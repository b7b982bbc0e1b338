"""Bootstrap intervals from grouped counts."""

from __future__ import annotations

from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import keyed_uniform
from .pins import pinned
from .ranks import quantiles


def poisson_cuts(most: int) -> list[float]:
    """Shares of Poisson(1) draws of at most 0, 1, ... most - 1."""
    out = [0.0]
    for k in range(most):
        out.append(out[-1] + exp(-1) / factorial(k))
    return out[1:]


def poisson_one(uniform: Column, most: int = 12) -> Column:
    """A Poisson(1) count, at most `most`, from a uniform number."""
    out = F.lit(most)
    for k, cut in reversed(list(enumerate(poisson_cuts(most)))):
        out = F.when(uniform < cut, k).otherwise(out)
    return out


def group_means(df: DataFrame, group: str, target: str) -> DataFrame:
    """group, n, missing, estimate (mean of the target) and kind: rate where all its values are 0 or 1, else mean."""
    y = F.col(target)
    two = df.agg(F.coalesce(F.bool_and(y.isin(0, 1)), F.lit(False)).alias("_two"))
    rows = df.groupBy(group).agg(F.count(target).alias("n"), F.count_if(y.isNull()).alias("missing"), F.avg(y).alias("estimate"))
    return rows.crossJoin(F.broadcast(two)).withColumn("kind", F.when(F.col("_two"), "rate").otherwise("mean")).drop("_two")


STEP, ONE, TWO = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def poisson_weights(key: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Poisson(1) weights, a row for each key and a column for each replicate, from the keys, replicate and seed alone."""
    with np.errstate(over="ignore"):
        x = key.view(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64) * STEP + np.uint64(seed) * TWO
        x = (x ^ (x >> np.uint64(30))) * ONE
        x = (x ^ (x >> np.uint64(27))) * TWO
        x ^= x >> np.uint64(31)
    return np.searchsorted(np.array(poisson_cuts(12)), (x >> np.uint64(11)) * 2.0**-53, side="right")


def _replicate_sums(replicates: int, seed: int, rows: int = 4096):
    """Of (group number, row key, value): for each group of the task its weighted sums and weights in each replicate. Rows are weighted `rows` at a time; groups are sent on when a task holds many."""

    def run(batches):
        held: dict = {}

        def flush():
            names = list(held)
            sums = np.stack([held[g] for g in names])
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(sums[:, 0]), pa.list_(pa.float64())), pa.array(list(sums[:, 1]), pa.list_(pa.float64()))], ["_g", "_s", "_w"])

        for b in batches:
            groups, keys, values = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
            for at in range(0, len(groups), rows):
                weight = poisson_weights(keys[at : at + rows], replicates, seed).astype(float)
                names = groups[at : at + rows]
                distinct = list(dict.fromkeys(names))
                number = {g: i for i, g in enumerate(distinct)}
                one = np.zeros((len(distinct), len(names)))
                one[[number[g] for g in names], np.arange(len(names))] = 1.0
                both = np.stack([one @ (weight * values[at : at + rows, None]), one @ weight], 1)
                for g, x in zip(distinct, both, strict=True):
                    held[g] = held[g] + x if g in held else x
                if len(held) > 10_000:
                    yield flush()
                    held = {}
        if held:
            yield flush()

    return run


def group_intervals(df: DataFrame, group: str, target: str, key: list[str], level: float = 0.95, replicates: int = 200, seed: int = 7) -> DataFrame:
    """group_means() with low and high: percentile intervals of a Poisson bootstrap of the rows.

    A row's weights follow from `key`, which tells rows apart, so reruns agree whatever the partitions. Each task adds up its rows' weighted values into one row a
    group; nothing is multiplied by the replicates before that."""
    rows = df.where(F.col(target).isNotNull()).select(F.col(group).cast("string").alias("_g"), F.xxhash64(*key).alias("_k"), F.col(target).cast("double").alias("_v"))
    part = rows.mapInArrow(_replicate_sums(replicates, seed), "_g string, _s array<double>, _w array<double>")
    each = part.select("_g", F.posexplode(F.arrays_zip("_s", "_w")).alias("replicate", "x")).groupBy("_g", "replicate")
    means = pinned(each.agg(F.try_divide(F.sum("x._s"), F.sum("x._w")).alias("mean")).where("mean is not null"))
    ends = quantiles(means, "mean", [(1 - level) / 2, (1 + level) / 2], ["_g"])
    ends = ends.groupBy("_g").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    own = group_means(df, group, target)
    return own.join(ends, own[group].cast("string").eqNullSafe(ends["_g"]), "left").drop("_g")


def paired_differences(table: DataFrame, key: str, a: str, b: str, replicates: int = 200, level: float = 0.95, seed: str = "pairs") -> DataFrame:
    """n_groups, improved, mean_difference, low, high of a - b over a small table of groups, whose groups are drawn with Poisson weights."""
    rows = table.select(F.col(key).cast("string").alias("_k"), (F.col(a) - F.col(b)).alias("d"))
    drawn = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = drawn.withColumn("w", poisson_one(keyed_uniform(F.concat_ws(":", "_k", "replicate"), seed)))
    means = drawn.groupBy("replicate").agg(F.try_divide(F.sum(F.col("w") * F.col("d")), F.sum("w")).alias("m")).where("m is not null")
    ends = quantiles(pinned(means), "m", [(1 - level) / 2, (1 + level) / 2]).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    point = rows.agg(F.count("*").alias("n_groups"), F.count_if(F.col("d") > 0).alias("improved"), F.avg("d").alias("mean_difference"))
    return point.crossJoin(F.broadcast(ends))
