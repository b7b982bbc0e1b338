"""Selections by score: budgets, target recalls, strata, matched negatives, and choices among cross-validated candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import keyed_hash
from .ranks import cumulative, quantiles, row_numbers

#: Shares of ranked rows at which risk strata end.
STRATA = {"0_1": 0.01, "1_5": 0.05, "5_15": 0.15}


def listed(df: DataFrame, values: list, name: str, kind: str = "double") -> DataFrame:
    """df with a row for each of a few listed values."""
    return df.withColumn(name, F.explode(F.array(*(F.lit(v).cast(kind) for v in values))))


def falling(levels: DataFrame) -> DataFrame:
    """Score levels with counts down to each and the totals of all."""
    c = cumulative(levels, [F.desc("score")], {"ct": F.col("total"), "cp": F.col("positive")})
    return c.crossJoin(F.broadcast(levels.agg(F.sum("total").alias("all_total"), F.sum("positive").alias("all_positive"))))


def budget_statistics(levels: DataFrame, fractions: list[float]) -> DataFrame:
    """fraction, threshold, selected, tp, fp, precision, recall: of the highest score level down to which at least that fraction lies, its whole tie included."""
    reach = listed(falling(levels), fractions, "fraction").where(F.col("ct") >= F.ceil(F.col("fraction") * F.col("all_total")))
    at = reach.groupBy("fraction").agg(F.max(F.struct("score", "ct", "cp", "all_positive")).alias("x"))
    out = at.select("fraction", F.col("x.score").alias("threshold"), F.col("x.ct").alias("selected"), F.col("x.cp").alias("tp"), (F.col("x.ct") - F.col("x.cp")).alias("fp"), "x.all_positive")
    return out.select("fraction", "threshold", "selected", "tp", "fp", (F.col("tp") / F.greatest("selected", F.lit(1))).alias("precision"), (F.col("tp") / F.greatest("all_positive", F.lit(1))).alias("recall"))


def recall_at_budgets(levels: DataFrame, budgets: list[int]) -> DataFrame:
    """budget, recall: the expected share of positives among the best `budget` rows when rows of the level where it ends come in random order."""
    rows = listed(falling(levels), budgets, "budget", "long").withColumn("taken", F.least("budget", "all_total"))
    part = F.greatest(F.lit(0), F.least("total", F.col("taken") - (F.col("ct") - F.col("total")))) / F.col("total")
    return rows.groupBy("budget").agg(F.try_divide(F.sum(part * F.col("positive")), F.max("all_positive")).alias("recall"))


def rows_at_recalls(ranked: DataFrame, rank: str, y: str, recalls: list[float]) -> DataFrame:
    """recall, n_rows, share: how many of the best rows reach each share of the positives. ranked has 1-based ranks."""
    whole = ranked.agg(F.count("*").alias("all_rows"), F.sum(y).alias("all_positive"))
    hits = row_numbers(ranked.where(F.col(y) == 1).select(rank), [F.asc(rank)], "hit").crossJoin(F.broadcast(whole))
    first = listed(hits, recalls, "recall").where(F.col("hit") >= F.ceil(F.col("recall") * F.col("all_positive"))).groupBy("recall")
    return first.agg(F.min(rank).alias("n_rows"), F.max("all_rows").alias("all_rows")).select("recall", "n_rows", (F.col("n_rows") / F.col("all_rows")).alias("share"))


def risk_strata(rows: DataFrame, risk: str, key: str, active: str) -> DataFrame:
    """rows with stratum: ACTIVE, or by falling risk, then key, among the others the first 1, 5, 15 and 100 %."""
    rest = row_numbers(rows.where(~F.col(active)), [F.desc(risk), F.asc(key)], "_r")
    n = rest.agg(F.count("*").alias("_n"))
    ladder = F.lit("15_100")
    for name, share in reversed(STRATA.items()):
        ladder = F.when(F.col("_r") <= F.ceil(F.lit(share) * F.col("_n")), name).otherwise(ladder)
    rest = rest.crossJoin(F.broadcast(n)).withColumn("stratum", ladder).drop("_r", "_n")
    return rest.unionByName(rows.where(F.col(active)).withColumn("stratum", F.lit("ACTIVE")))


def matched_negatives(targets: DataFrame, negatives: DataFrame, score: str, key: str, multiplier: int, bins: int, seed: str) -> DataFrame:
    """bin, key, copy: of each quantile bin of the targets' scores, `multiplier` negatives a target by least seeded hash. Where a bin
    has too few they repeat; where it has none, the nearest to its centre stand in (at least 32)."""
    cuts = sorted({r["value"] for r in quantiles(targets, score, [i / bins for i in range(bins + 1)]).collect()})
    if len(cuts) < 3:
        low, high = cuts[0], max(cuts[-1], cuts[0] + 1e-6)
        cuts = [low, (low + high) / 2, high]
    last = len(cuts) - 2
    inside = lambda i: (F.col(score) >= cuts[i]) & ((F.col(score) <= cuts[i + 1]) if i == last else (F.col(score) < cuts[i + 1]))
    ladder = F.coalesce(*(F.when(inside(i), F.lit(i)) for i in range(last + 1)))
    need = targets.groupBy(ladder.alias("bin")).agg((F.count("*") * multiplier).alias("need")).where("bin is not null")
    have = negatives.select(key, score, ladder.alias("bin")).where("bin is not null")
    size = have.groupBy("bin").agg(F.count("*").alias("have"))
    plan = need.join(size, "bin", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    full = have.withColumn("_h", keyed_hash(key, seed))  # ranks over range partitions: a hot bin is many tasks
    full = row_numbers(full, [F.asc("_h"), F.asc(key)], "r", ["bin"]).join(F.broadcast(plan.where("have > 0")), "bin").where("r <= need")
    centre = F.element_at(F.array(*(F.lit((a + b) / 2) for a, b in zip(cuts, cuts[1:], strict=False))), F.col("bin") + 1)
    far = negatives.select(key, score).crossJoin(F.broadcast(plan.where("have = 0").withColumn("have", F.greatest("need", F.lit(32)))))
    near = far.withColumn("_d", F.abs(F.col(score) - centre))
    near = row_numbers(near, [F.asc("_d"), F.asc(key)], "r", ["bin"]).where("r <= have and r <= need")
    both = full.select("bin", key, "r", "need", "have").unionByName(near.select("bin", key, "r", "need", "have"))
    times = F.greatest(F.lit(1), F.ceil((F.col("need") - F.col("r") + 1) / F.col("have"))).cast("int")
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select("bin", key, "copy")


def strongest_within(summary: DataFrame, strength: str, score: str, guard: str, converged: str, tolerance: float) -> DataFrame:
    """The one candidate of the least `strength` whose score is within a relative tolerance of the best and whose guard is no worse than
    the best one's; only converged ones count. summary has a row a candidate."""
    fine = summary.where(converged)
    best = fine.agg(F.max_by(F.struct(F.col(score).alias("s"), F.col(guard).alias("g")), score).alias("best"))
    ok = fine.crossJoin(F.broadcast(best)).where((F.col(score) >= (1 - tolerance) * F.col("best.s")) & (F.col(guard) >= F.col("best.g")))
    return ok.drop("best").orderBy(strength).limit(1)


def within_one_error(summary: DataFrame, simplicity: str, mean: str, error: str) -> DataFrame:
    """summary with eligible (mean at least the best mean less its standard error) and chosen (the simplest eligible one)."""
    best = summary.agg(F.max_by(F.col(mean) - F.col(error), mean).alias("_least"))
    rows = summary.crossJoin(F.broadcast(best)).withColumn("eligible", F.col(mean) >= F.col("_least")).drop("_least")
    first = rows.where("eligible").agg(F.min(simplicity).alias("_first"))
    return rows.crossJoin(F.broadcast(first)).withColumn("chosen", F.col(simplicity) == F.col("_first")).drop("_first")


def leaderboard(folds: DataFrame, reference, shortlist: int, minimize: bool = False) -> DataFrame:
    """Of folds (candidate, fold, m): rank, mean, std, improvement over the reference, wins, ties and losses of folds, paired_std, shortlisted.

    One row a candidate, so the small windows see candidates only."""
    sign = -1 if minimize else 1
    mean = folds.groupBy("candidate").agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"))
    d = folds.join(folds.where(F.col("candidate") == reference).select("fold", F.col("m").alias("_r")), "fold").withColumn("d", sign * (F.col("m") - F.col("_r")))
    tie = F.abs("d") <= 1e-12
    won = d.groupBy("candidate").agg(F.count_if((F.col("d") > 0) & ~tie).alias("wins"), F.count_if(tie).alias("ties"), F.count_if((F.col("d") < 0) & ~tie).alias("losses"), F.stddev_samp("d").alias("paired_std"))
    own = F.col("candidate") == reference
    won = won.select("candidate", *(F.when(own, 0).otherwise(F.col(c)).alias(c) for c in ("wins", "ties", "losses", "paired_std")))
    at = mean.where(own).select(F.col("mean").alias("_m"))
    order = [sign * F.col("mean") * -1, F.col("candidate")]
    rows = mean.join(won, "candidate").crossJoin(F.broadcast(at)).withColumn("improvement", sign * (F.col("mean") - F.col("_m"))).drop("_m")
    rows = rows.withColumn("rank", F.row_number().over(W.orderBy(*order)))
    return rows.withColumn("shortlisted", ~own & (F.sum((~own).cast("int")).over(W.orderBy("rank")) <= shortlist))


def threshold_sweep(rows: DataFrame, probability: Column, y: str, thresholds: list[float]) -> DataFrame:
    """threshold, accuracy, balanced_accuracy, precision, recall, f1 of predicting 1 at and above each threshold; 0 where a share has no base."""
    p = listed(rows.select(probability.alias("_p"), F.col(y).alias("_y")), thresholds, "threshold").withColumn("_h", F.col("_p") >= F.col("threshold"))
    n = lambda hit, label: F.count_if((F.col("_h") == hit) & (F.col("_y") == label))
    c = p.groupBy("threshold").agg(n(True, 1).alias("tp"), n(True, 0).alias("fp"), n(False, 1).alias("fn"), n(False, 0).alias("tn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    recall = share(tp, tp + fn)
    return c.select(
        "threshold", share(tp + tn, tp + fp + fn + tn).alias("accuracy"), ((recall + share(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        share(tp, tp + fp).alias("precision"), recall.alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def gate(folds: DataFrame, reference, singles: list, combined, gain: float = 0.01, wins: int = 2) -> DataFrame:
    """(check_name, passed) of a gate that is set before a run. folds: candidate, fold, m (the metric), guard, converged. The combined candidate must
    beat the better single one by a relative gain of the mean and in `wins` folds; its mean guard must be no worse than that one's and the
    reference's; all its folds must have converged."""
    means = folds.groupBy("candidate").agg(F.avg("m").alias("m"), F.avg("guard").alias("g"), F.bool_and("converged").alias("ok"))
    best = means.where(F.col("candidate").isin(singles)).agg(F.max(F.struct(F.col("m"), (-F.col("candidate")).alias("k"), F.col("g"))).alias("b"))
    of = lambda who, name: means.where(F.col("candidate") == who).select(F.struct("m", "g", "ok").alias(name))
    one = folds.where(F.col("candidate") == combined).select("fold", F.col("m").alias("a"))
    pairs = one.join(folds.crossJoin(F.broadcast(best)).where(F.col("candidate") == -F.col("b.k")).select("fold", F.col("m").alias("s")), "fold")
    won = pairs.agg(F.count_if(F.col("a") > F.col("s")).alias("won"))
    row = best.crossJoin(F.broadcast(of(combined, "c"))).crossJoin(F.broadcast(of(reference, "r"))).crossJoin(F.broadcast(won))
    checks = {
        "gain": F.col("c.m") / F.col("b.m") - 1 >= gain, "wins": F.col("won") >= wins, "guard against single": F.col("c.g") >= F.col("b.g"),
        "guard against reference": F.col("c.g") >= F.col("r.g"), "converged": F.col("c.ok"),
    }
    return row.select(F.inline(F.array(*(F.struct(F.lit(k).alias("check_name"), v.alias("passed")) for k, v in checks.items()))))
