"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, with DataFrame operations only.

Documents of a source fall into hash blocks of about BLOCK_WORDS words. A source that must give t words
takes each block floor(t / size) times and, for the rest, blocks in permuted order and documents of the
last block as they fit, half of its share in permuted order. Every taken (source, pass, block) is one unit. A
node of the tree splits the units of its output shards among at most FAN children by source counts drawn without
replacement (consecutive parts of a keyed random order of interchangeable tokens, which is the multivariate
hypergeometric law), down to single shards; a source's permuted units then fill its quotas, so shards
are disjoint. Each copy of a document has its shard and its slot, a keyed order inside the shard, which is
the local shuffle; the mixed documents come partitioned by shard and sorted by slot.

Random orders are ranked in two steps, by the high bits of the key and inside those, so neither a node nor
a source is ever one task's work.

Nulls and odd rows: null text has size 0; null sources form one source, ordered last; rows equal in
doc_id, source and size share one decision; documents of size 0 are taken 0 words; an empty table gives
an empty mix; other columns pass. All draws are keyed hashes, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, tasks_for

BLOCK_WORDS = 1 << 16
MOST_REPEATS = 3
#: Words of an output shard (about 12 MB of text); shards grow where there would be more than tasks_for() allows.
SHARD_WORDS = 1 << 21
FAN = 16
#: How often the gap that is left in a source's last block is filled with documents that still fit.
FILLS = 6


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """One row a source: source, rank, source_size, target. Weights 1, 2, 3 repeat by rank and share all
    words; a target stops at MOST_REPEATS times its source, and the level is raised for the rest.

    The level is the first, by rising cap over weight, at which nothing below it is left over. The
    unpartitioned windows see one row a source."""
    table = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    table = table.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    table = table.withColumn("weight", (F.col("rank") - 1) % 3 + 1).withColumn("cap", F.col("source_size") * MOST_REPEATS)
    by = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    capped = F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy())
    table = table.withColumn("level", (total - capped) / weights).withColumn("turn", F.row_number().over(by))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("turn", "level"))
    level = F.min(fits).over(W.partitionBy())["level"]
    return table.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))).select("source", "rank", "source_size", "target")


def ranked(rows: DataFrame, by: list[str], key: Column, ties: list[str], value: str | None = None) -> DataFrame:
    """rows with at: their place (from 1) by key among rows of equal `by`, or with a value its running sum; and n: how many there are.

    Places are counted in 1,024 parts of the key's range, then inside each part. rows must be a written table."""
    rows = rows.withColumn("k_key", key).withColumn("k_part", F.shiftright("k_key", 54))
    amount = F.col(value) if value else F.lit(1)
    per = rows.groupBy(*by, "k_part").agg(F.sum(amount).alias("k_sum"), F.count("*").alias("k_n"))
    order = W.partitionBy(*by).orderBy("k_part")
    per = per.select(*by, "k_part", (F.sum("k_sum").over(order) - F.col("k_sum")).alias("k_before"), F.sum("k_n").over(W.partitionBy(*by)).alias("n"))
    inside = W.partitionBy(*by, "k_part").orderBy("k_key", *ties).rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(per, [*by, "k_part"]).withColumn("at", F.col("k_before") + F.sum(amount).over(inside))
    return out.drop("k_key", "k_part", "k_before")


def split_tree(units: DataFrame, shards: int, seed: int) -> DataFrame:
    """units (rank, pass, block), a written table, with a shard: quotas by the tree, then permuted units into them."""
    unit = ranked(units, ["rank"], F.xxhash64(F.lit(seed), F.lit("unit"), "rank", "pass", "block"), ["pass", "block"]).withColumnRenamed("at", "turn")
    unit = cut(unit.select("rank", "pass", "block", "turn"), "units")
    token = unit.select("rank", F.col("turn").alias("k"), F.lit(0).cast("long").alias("node"), F.lit(shards).cast("long").alias("wide"))
    level, most = 0, shards
    while most > 1:
        seen = ranked(token, ["node"], F.xxhash64(F.lit(seed), F.lit(level), "rank", "k"), ["rank", "k"])
        parts = F.least(F.col("wide"), F.lit(FAN))
        shard = F.expr("(at * wide + n - 1) div n - 1")  # of the node's shards, that in which a place falls
        seen = seen.withColumn("parts", parts).withColumn("shard", shard).withColumn("part", F.expr("((shard + 1) * parts + wide - 1) div wide - 1"))
        lo, hi = F.expr("wide * part div parts"), F.expr("wide * (part + 1) div parts")
        token = cut(seen.select("rank", "k", (F.col("node") + lo).alias("node"), (hi - lo).alias("wide")), "tree")
        level, most = level + 1, -(-most // FAN)
    quota = token.groupBy("rank", F.col("node").cast("int").alias("shard")).agg(F.count("*").alias("n"))
    quota = quota.withColumn("hi", F.sum("n").over(W.partitionBy("rank").orderBy("shard"))).withColumn("turn", F.explode(F.sequence(F.col("hi") - F.col("n") + 1, F.col("hi"))))
    return unit.join(quota.select("rank", "turn", "shard"), ["rank", "turn"]).select("rank", "pass", "block", "shard")


def mixture(docs: DataFrame, shards: int | None = None, seed: int = 17) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, copies, and takes: for each copy its shard and slot (the local order).

    shards: the number of output shards; by default one for each SHARD_WORDS words."""
    sized = cut(docs.select("doc_id", F.col("source").cast("string"), word_count().alias("size")), "sizes")
    table = cut(source_targets(sized), "targets")
    if shards is None:
        shards = tasks_for(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).head()[0], SHARD_WORDS)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / BLOCK_WORDS))
    table = table.withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_REPEATS))).otherwise(0).cast("int"))
    table = table.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("blocks", blocks)
    rows = sized.join(table.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("blocks")))  # by size, too: many rows may lack an id

    per = rows.groupBy("rank", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    per = ranked(cut(per, "blocks"), ["rank"], F.xxhash64(F.lit(seed), F.lit("block"), "rank", "block"), ["block"], "words")
    per = per.withColumn("left", F.col("rest") - (F.col("at") - F.col("words")))
    per = cut(per.select("rank", "block", "passes", "left", (F.col("left") > 0).alias("last"), ((F.col("left") > 0) & (F.col("words") > F.col("left"))).alias("edge")), "blocks")
    units = per.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MOST_REPEATS)))).where((F.col("pass") < F.col("passes")) | ((F.col("pass") == F.col("passes")) & F.col("last"))).select("rank", "pass", "block")
    dealt = split_tree(cut(units, "units"), shards, seed).groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("units"))

    rows = rows.select("doc_id", "source", "size", "source_size", "target", "rank", "block").join(per, ["rank", "block"]).join(dealt, ["rank", "block"], "left")
    whole = rows.where(~F.col("edge")).withColumn("in_last", F.col("last"))
    order = W.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed), F.lit("doc"), "doc_id", "size"), "doc_id", "size").rangeBetween(W.unboundedPreceding, 0)
    cutoff = rows.where("edge").withColumn("in_last", F.lit(False)).withColumn("gap", F.col("left"))
    largest = W.partitionBy("rank").orderBy(F.desc("size"), "doc_id").rangeBetween(W.unboundedPreceding, 0)
    for turn in range(FILLS):
        most = F.col("gap") / 2 if turn == 0 else F.col("gap")  # half by permuted order, the rest by falling size, so that small ones close the gap
        fits = ~F.col("in_last") & (F.col("size") <= most)
        cutoff = cutoff.withColumn("takes", fits & (F.sum(F.when(fits, F.col("size")).otherwise(0)).over(order if turn == 0 else largest) <= most))
        cutoff = cutoff.withColumn("gap", F.col("gap") - F.coalesce(F.sum(F.when(F.col("takes"), F.col("size"))).over(W.partitionBy("rank")), F.lit(0)))
        cutoff = cutoff.withColumn("in_last", F.col("in_last") | F.col("takes")).drop("takes")
    cutoff = cutoff.drop("gap")
    out = whole.unionByName(cutoff)
    took = F.filter(F.coalesce("units", F.array()), lambda u: (u["pass"] < F.col("passes")) | F.col("in_last"))
    slot = lambda u: F.struct(u["shard"].alias("shard"), F.xxhash64(F.lit(seed), u["shard"], u["pass"], F.col("doc_id")).alias("slot"))
    out = out.withColumn("takes", F.when(F.col("size") > 0, F.transform(took, slot)).otherwise(F.array().cast("array<struct<shard:int,slot:bigint>>")))
    return out.select("doc_id", "source", "size", "source_size", "target", F.size("takes").alias("copies"), "takes")


def mixed_documents(docs: DataFrame, shards: int | None = None, seed: int = 17) -> DataFrame:
    """docs as the mix has them, partitioned by shard and in the local order: a document taken n times has n rows, one taken 0 times none."""
    takes = mixture(docs, shards, seed).where("copies > 0").groupBy("doc_id", "source", "size").agg(F.first("takes").alias("takes"))
    takes = cut(takes, "takes")
    last = takes.agg(F.max(F.array_max(F.col("takes.shard")))).head()[0] or 0
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", F.col("source").cast("string"), word_count().alias("size"))
    same = F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r.size") == F.col("t.size"))
    rows = rows.alias("r").join(takes.alias("t"), same).select("r.row", "r.doc_id", F.explode("t.takes").alias("take"))
    rows = rows.repartitionById(last + 1, "take.shard").sortWithinPartitions("take.shard", "take.slot", "doc_id")
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
