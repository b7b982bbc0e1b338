"""Learned decision lists over text statistics, with DataFrame operations only.

Statistics of each text are built-in expressions. Labelled rows are cut at percentiles of each
statistic; sequential covering grows a conjunction of thresholds by information gain on two thirds of
them, prunes it on the rest, accepts it if it is precise there, takes away what it covers and goes on.
Each step is one grouped count over all labelled rows (at most statistics x cuts x 4 rows come back). The list
becomes one ordered CASE expression that Spark evaluates anywhere.

Nulls and odd rows: null text counts as empty; labels other than 0 or 1 and null ids teach nothing; a
document labelled twice counts as good if one label says so; without labels the list is empty and
nothing is rejected beyond the base rule; other columns pass.
"""

from __future__ import annotations

from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_SENT, cut

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Statistics that rules may test; each is a rate, so that texts of any length compare.
RATES = {
    "word_length": "word_chars / n_words",
    "symbol_rate": "n_symbols / n_words",
    "dup_line_rate": "n_dup_lines / n_lines",
    "repeat_rate": "n_repeat_words / n_words",
    "upper_rate": "n_upper / word_chars",
    "exclaim_rate": "n_exclaim / n_words",
    "words": "double(n_words)",
}


def _without(c: Column, chars: str) -> Column:
    return F.length(F.translate(c, chars, ""))


def text_statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_exclaim.

    Three-word windows of one text are compared by 64-bit hashes; a text whose hashes are all
    different, as most are, ends there, and only others sort them with their places."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.withColumn("k_text", text)
    t = F.col("k_text")
    d = d.withColumn("k_words", F.regexp_extract_all(t, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    d = d.withColumn("n_words", F.size("k_words").cast("long"))
    words = F.col("k_words")
    gram = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    d = d.withColumn("k_grams", F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), gram)).otherwise(F.array().cast("array<bigint>")))
    grams = F.col("k_grams")
    placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda a: F.filter(a, lambda x, i: (F.get(a, i - 1)["h"] == x["h"]) | (F.get(a, i + 1)["h"] == x["h"]))
    places = F.element_at(F.transform(F.array(placed), lambda a: F.sort_array(F.transform(twice(a), lambda x: x["i"]))), 1)
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at"))
    repeated = F.aggregate(places, start, lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["at"])).alias("n"), p.alias("at")), lambda s: s["n"])
    d = d.withColumn("k_distinct", F.size(F.array_distinct(grams)))
    d = d.withColumn("n_repeat_words", F.when(F.col("k_distinct") == F.size(grams), 0).otherwise(repeated).cast("long"))
    d = d.withColumn("k_lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = lambda c: c.cast("long")
    d = d.withColumns({
        "word_chars": n(_without(t, " \t\n\x0b\f\r")), "n_symbols": n(F.length(t) - _without(t, "#*$%&|<>")), "n_lines": n(F.size("k_lines")),
        "n_dup_lines": n(F.size("k_lines") - F.size(F.array_distinct("k_lines"))), "n_upper": n(F.length(t) - _without(t, UPPER)), "n_exclaim": n(F.length(t) - _without(t, "!")),
    })
    return d.drop("k_text", "k_words", "k_grams", "k_distinct", "k_lines")


def rates(stats: DataFrame) -> dict[str, Column]:
    return {f"r_{k}": F.coalesce(F.try_divide(*(F.expr(x) for x in e.split(" / "))) if " / " in e else F.expr(e), F.lit(0.0)) for k, e in RATES.items()}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


Condition = tuple[str, str, float]


def learn(stats: DataFrame, labels: DataFrame, cuts: int = 32, most_rules: int = 10, most_conditions: int = 3, precision: float = 0.97, least: int = 5) -> list[list[Condition]]:
    """Rules, each a list of (rate, '>=' or '<', threshold), that mark low quality; in order.

    Bounds: thresholds at `cuts` percentiles of each rate; at most most_rules rules of at most most_conditions conditions; a condition leaves at least
    `least` bad rows, and a rule is taken if the share `precision` of the held-out rows that it marks is bad."""
    label = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    rows = stats.join(label, "doc_id").withColumns(rates(stats))
    names = [f"r_{k}" for k in RATES]
    rows = cut(rows.select("good", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)).alias("fold"), *names), "labelled")
    marks = [(i + 0.5) / cuts for i in range(cuts)]
    found = rows.agg(*(F.percentile_approx(c, marks, 10000).alias(c) for c in names)).head()
    edges = {c: sorted(set(found[c] or [])) for c in names}
    above = lambda c: F.filter(F.array(*map(F.lit, edges[c])), lambda e: F.col(c) >= e)
    binned = {c: F.size(above(c)) if edges[c] else F.lit(0) for c in names}
    rows = cut(rows.groupBy("good", (F.col("fold") == 0).alias("prune"), *(b.alias(c) for c, b in binned.items())).agg(F.count("*").alias("n")), "binned")

    test = lambda c: F.col(c[0]) >= c[2] if c[1] == ">=" else F.col(c[0]) < c[2]
    holds = lambda rule: reduce(lambda a, b: a & b, map(test, rule), F.lit(True))
    low, high = F.sum(F.when(F.col("good") == 0, F.col("n"))), F.sum(F.when(F.col("good") == 1, F.col("n")))

    def counts(frame: DataFrame) -> list:
        long = frame.select("good", "n", F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("b")) for c in names))).alias("x"))
        return long.groupBy("x.c", "x.b").agg(F.coalesce(low, F.lit(0)).alias("p"), F.coalesce(high, F.lit(0)).alias("q")).collect()

    rules, left = [], rows
    for _ in range(most_rules):
        rule: list = []
        while len(rule) < most_conditions:
            seen = counts(left.where(~F.col("prune")).where(holds(rule)))
            by = {c: {r["b"]: (r["p"], r["q"]) for r in seen if r["c"] == c} for c in names}
            p0, q0 = (sum(v[i] for v in by[names[0]].values()) for i in (0, 1))
            if p0 < least or q0 == 0:
                break
            best = (0.0, None)
            for c in names:
                for b in range(1, len(edges[c]) + 1):
                    high_side = [sum(v[i] for k, v in by[c].items() if k >= b) for i in (0, 1)]
                    for op, (p, q) in ((">=", high_side), ("<", (p0 - high_side[0], q0 - high_side[1]))):
                        if p >= least and p + q < p0 + q0:
                            best = max(best, (p * (log2(p / (p + q)) - log2(p0 / (p0 + q0))), (c, op, b)), key=lambda x: x[0])
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        held = left.where("prune").agg(*(F.coalesce(F.sum(F.when(holds(rule[:k]) & (F.col("good") == g), F.col("n"))), F.lit(0)) for k in range(1, len(rule) + 1) for g in (0, 1))).head()
        worth = [((held[2 * k] - held[2 * k + 1]) / max(1, held[2 * k] + held[2 * k + 1]), held[2 * k], k + 1) for k in range(len(rule))]
        top = max(w[0] for w in worth)
        value, hits, size = max((w for w in worth if w[0] >= top - 0.005), key=lambda w: w[1])
        if hits < max(1, least // 2) or (value + 1) / 2 < precision:
            break
        rules.append(rule[:size])
        left = left.where(~holds(rule[:size]))
    return [[(c, op, float(edges[c][b - 1])) for c, op, b in rule] for rule in rules]


def verdict(rules: list[list[Condition]], frame: DataFrame) -> Column:
    """True where no rule of the list marks the row; the ordered conditional expression."""
    value = rates(frame)
    test = lambda c: value[c[0]] >= c[2] if c[1] == ">=" else value[c[0]] < c[2]
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(reduce(lambda a, b: a & b, map(test, rule)), False).otherwise(out)
    return out


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, kept."""
    stats = cut(text_statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    rules = learn(stats, labels)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & verdict(rules, stats))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that neither the base rule nor the list rejects, with docs' own columns."""
    key = F.xxhash64(F.col("text").cast("string"))
    stats = cut(text_statistics(docs.select("doc_id", "text")).withColumn("k_key", key).drop("text"), "statistics")
    bad = base_failed() | ~verdict(learn(stats, labels), stats)
    lost = cut(stats.where(bad).select("doc_id", F.col("k_key").alias("tk")).distinct(), "rejected")
    lost = F.broadcast(lost) if lost.count() <= MOST_SENT // 2 else lost
    same = F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.xxhash64(F.col("d.text").cast("string")) == F.col("l.tk"))
    return docs.alias("d").join(lost.alias("l"), same, "left_anti").select(*(F.col(f"d.`{c}`") for c in docs.columns))
