"""The prefix trie of conversations, by ROLLUP over positional turn-id columns.

A turn's id is 128 bits of hashes of its role and text (texts are never compared by letters, nor shuffled); a conversation is cut into blocks of BLOCK turns, and a
block is a row with one column for each of its turns and the node at which the block before it ended, named by the exclusive-or of hashes of all earlier
(place, turn id). One GROUP BY of (block, that node) with ROLLUP over the turn columns then gives all nodes of all depths at once; grouping_id tells
the depth. Long conversations are so continued in further blocks, in the same job, and no conversation is ever one row.

Two rollups are run. The first gives members and the smallest member of each node, which names it at its depth. From those follow children, and
for each conversation the depth from which it is its nodes' smallest member. The second adds up over members what the whole subtree needs: a leaf
counts at its smallest member, and the words that a conversation saves are those of its turns before that depth; so no tree is walked.

Conversations of more than LONG turns are numbered and accumulated in parts, then over parts, and joins deal keys of many rows to several tasks.
Digests of members are made of sorted runs of ids: a task sees a node's runs as a stream, never its members as rows.

Nulls and odd rows: rows with a null conv_id belong to no conversation and are left out; null turns come first; equal turns come by role, then by the hash of
their text, and repeated rows count each; null role and text are empty; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranks import row_numbers
from .common import cut, skewed_join, tasks_for
from .mixing import word_count

#: Turns in a block, and in a part of a long conversation.
BLOCK, LONG = 4, 1 << 12
LENDER, MOST_BORROWED = 20, 3


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, a and b (the turn's id), words."""
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), clean("role").alias("role"), clean("text").alias("text")).where("conv_id is not null")
    return rows.select("conv_id", "turn", "role", F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"), word_count().alias("words"))


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, a, b, words) of each turn, places from 1, and (conv_id, n) of each conversation; both written."""
    rows = turn_rows(conversations)
    convs = cut(rows.groupBy("conv_id").agg(F.count("*").alias("n")), "conversations")
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("a"), F.asc("b")]
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(*order)).cast("long")
    long = convs.where(F.col("n") > LONG).select("conv_id")
    if long.isEmpty():
        out = rows.withColumn("place", place)
    else:
        parts = tasks_for(64 * convs.agg(F.sum("n")).head()[0])
        out = rows.join(long, "conv_id", "left_anti").withColumn("place", place)
        out = out.unionByName(row_numbers(rows.join(long, "conv_id", "left_semi"), order, "place", ["conv_id"], parts))
    return cut(out.select("conv_id", "place", "a", "b", "words"), "turns"), convs


def rebuilt(turns: DataFrame, convs: DataFrame, lender: int = LENDER, most: int = MOST_BORROWED) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations where each conversation begins with the first h turns of conversation c - c % lender and goes on with its own turns after
    its first h; h is the CRC of its decimal id modulo most + 1. A conversation may be left without turns."""
    base = F.col("conv_id") - F.col("conv_id") % lender
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).alias("h")
    lent = convs.where(F.col("conv_id") % lender == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.select("conv_id", "n", h, base.alias("base")).join(lent, "base", "left")
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = convs.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    convs = cut(convs, "rebuilt")
    heads = turns.where((F.col("conv_id") % lender == 0) & (F.col("place") <= most)).withColumnRenamed("conv_id", "base")
    borrowed = heads.join(convs.select("conv_id", "base", "h"), "base").where("place <= h").select("conv_id", "place", "a", "b", "words")
    own = skewed_join(turns, convs.select("conv_id", "h", "taken"), "conv_id", "place").where("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "a", "b", "words")
    return own.unionByName(borrowed), convs.select("conv_id", "length")


def _tag(seed: int, place: Column, a: Column, b: Column) -> Column:
    return F.xxhash64(F.lit(seed), place, a, b)


def path_blocks(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each conversation and block, written: p1, p2 and before (node and words before the block), y1, y2 and words (the block's own), t1, t2, ...
    (a, b and words of its turns, null where there are none). A conversation without turns has one row."""
    slot, at = (F.col("place") - 1) % block, F.expr(f"(place - 1) div {block}")
    rows = turns.withColumns({"slot": slot, "block": at, "x1": _tag(1, F.col("place"), F.col("a"), F.col("b")), "x2": _tag(2, F.col("place"), F.col("a"), F.col("b"))})
    none = convs.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("block"))
    rows = rows.unionByName(none, allowMissingColumns=True).withColumn("part", F.expr(f"block div {LONG // block}"))
    rows = rows.repartition(tasks_for(48 * convs.agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]), "conv_id", "part")
    columns = [F.max(F.when(F.col("slot") == i, F.col(c))).alias(f"{c}{i}") for i in range(block) for c in ("a", "b", "words")]
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    rows = rows.groupBy("conv_id", "part", "block").agg(*columns, zero(F.bit_xor("x1")).alias("y1"), zero(F.bit_xor("x2")).alias("y2"), zero(F.sum("words")).alias("own"))
    before = W.partitionBy("conv_id", "part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    turn = lambda i: F.when(F.col(f"a{i}").isNotNull(), F.struct(F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"), F.col(f"words{i}").alias("words"))).alias(f"t{i + 1}")
    rows = rows.select(
        "conv_id", "part", "block", "y1", "y2", F.col("own").alias("words"), zero(F.bit_xor("y1").over(before)).alias("p1"), zero(F.bit_xor("y2").over(before)).alias("p2"),
        zero(F.sum("own").over(before)).alias("before"), *(turn(i) for i in range(block)),
    )
    rows = cut(rows, "blocks")
    later = rows.where("part > 0")
    if later.isEmpty():
        return rows.drop("part")
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    whole = rows.join(later.select("conv_id").distinct(), "conv_id", "left_semi").groupBy("conv_id", "part").agg(F.bit_xor("y1").alias("z1"), F.bit_xor("y2").alias("z2"), F.sum("words").alias("zw"))
    whole = whole.select("conv_id", "part", F.bit_xor("z1").over(earlier).alias("z1"), F.bit_xor("z2").over(earlier).alias("z2"), F.sum("zw").over(earlier).alias("zw"))
    later = later.join(whole, ["conv_id", "part"]).withColumns({"p1": F.col("p1").bitwiseXOR(F.col("z1")), "p2": F.col("p2").bitwiseXOR(F.col("z2")), "before": F.col("before") + F.col("zw")})
    return cut(rows.where("part = 0").unionByName(later.drop("z1", "z2", "zw")).drop("part"), "blocks")


def rolled_up(blocks: DataFrame, block: int, what: str) -> DataFrame:
    """All nodes at once: depth, key, parent (its key), before (words of the turns before the node's own), and the aggregates `what`."""
    names = [f"t{i + 1}" for i in range(block)]
    said = f"""select block, p1, p2, before, {", ".join(names)}, {block} - bit_count(grouping_id()) as level, {what}
        from {{blocks}} group by block, p1, p2, before, rollup({", ".join(names)})"""
    rows = blocks.sparkSession.sql(said, blocks=blocks)
    last = F.coalesce(*(F.when(F.col("level") == i + 1, F.col(n).isNotNull()) for i, n in enumerate(names)), F.col("block") == 0)
    rows = rows.where(last)  # a level stands for a node if its last turn is there; level 0 is the node of the block before
    own = lambda seed, i: F.coalesce(_tag(seed, F.col("block") * block + (i + 1), F.col(f"t{i + 1}.a"), F.col(f"t{i + 1}.b")), F.lit(0))

    def key(below: int) -> Column:
        out = []
        for seed in (1, 2):
            k = F.col(f"p{seed}")
            for i in range(block):
                k = k.bitwiseXOR(F.when(F.col("level") - below > i, own(seed, i)).otherwise(F.lit(0).cast("long")))
            out.append(k.alias(f"k{seed}"))
        return F.struct(*out)

    before = F.col("before")
    for i in range(block - 1):
        before = before + F.when(F.col("level") > i + 1, F.col(f"t{i + 1}.words")).otherwise(0)
    aggregates = [c for c in rows.columns if c not in {"block", "p1", "p2", "before", "level", *names}]
    return rows.select((F.col("block") * block + F.col("level")).alias("depth"), key(0).alias("key"), F.when(F.col("block") * block + F.col("level") > 0, key(1)).alias("parent"), before.alias("before"), *aggregates)


def _runs(batches):
    """Of (k1, k2, conv_id), sorted: a row for each run of one key in a batch: k1, k2, first, ids (decimal, joined by commas)."""
    for b in batches:
        k1, k2, ids = (c.to_pylist() for c in b.columns)
        out, at = [], 0
        for k in range(1, len(ids) + 1):
            if k == len(ids) or k1[k] != k1[at] or k2[k] != k2[at]:
                out.append((k1[at], k2[at], ids[at], ",".join(map(str, ids[at:k]))))
                at = k
        one, two, first, text = zip(*out, strict=True) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(first, pa.int64()), pa.array(text, pa.string())], ["k1", "k2", "first", "ids"])


def _digests(batches):
    """Of runs in order of key and first id: k1, k2 and the digest of all ids of the key."""
    now, digest = None, None
    for b in batches:
        out = []
        for k1, k2, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if (k1, k2) == now:
                digest.update(b",")
            else:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = (k1, k2), hashlib.sha256()
            digest.update(ids.as_buffer())
        yield _rows(out)
    if now is not None:
        yield _rows([(*now, digest.hexdigest())])


def _rows(out: list) -> pa.RecordBatch:
    one, two, text = zip(*out, strict=True) if out else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(text, pa.string())], ["k1", "k2", "ends_sha256"])


def member_digests(ends: DataFrame, tasks: int) -> DataFrame:
    """key, ends_sha256: of the decimal ids of the conversations (key, conv_id) that end at a node, in order and joined by commas."""
    rows = ends.select("key.k1", "key.k2", "conv_id").repartitionByRange(tasks, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    runs = rows.mapInArrow(_runs, "k1 long, k2 long, first long, ids string")
    runs = runs.repartition(tasks, "k1", "k2").sortWithinPartitions("k1", "k2", "first").select("k1", "k2", "ids")
    return runs.mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string").select(F.struct("k1", "k2").alias("key"), "ends_sha256")


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, place (from 1, without gaps), a, b (the turn's id) and words; convs: conv_id and length of every conversation."""
    blocks = path_blocks(turns, convs, block)
    nodes = cut(rolled_up(blocks, block, "min(conv_id) as conv_id, count(*) as n_convs"), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    # a conversation's own nodes: those whose smallest member it is, from its depth `top` on; `shared` are the words of its turns before
    own = cut(nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.min("before").alias("shared"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")), "own")
    ends = cut(blocks.groupBy("conv_id").agg(F.bit_xor("y1").alias("k1"), F.bit_xor("y2").alias("k2"), F.sum("words").alias("words")).select(F.struct("k1", "k2").alias("key"), "conv_id", "words"), "ends")
    value = ends.join(own, "conv_id", "left").select("conv_id", F.coalesce("shared", "words").alias("shared"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf"))
    sums = rolled_up(skewed_join(blocks, value, "conv_id", "block"), block, "sum(shared) as shared_sum, sum(leaf) as n_leaves").select("key", "shared_sum", "n_leaves")
    nodes = cut(skewed_join(nodes, own.select("conv_id", "top", "shared"), "conv_id", "depth"), "nodes")
    tops = cut(nodes.where("depth = top and depth > 0").select(F.col("parent").alias("key"), "conv_id"), "tops")
    parents = skewed_join(tops, nodes.select("key", F.col("conv_id").alias("above")), "key", "conv_id").select("conv_id", "above")
    tasks = tasks_for(48 * ends.count())
    out = nodes.join(member_digests(ends, tasks), "key", "left").join(sums, "key").join(parents.withColumnRenamed("conv_id", "c"), (F.col("depth") == F.col("top")) & (F.col("conv_id") == F.col("c")), "left")
    parent = F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("above"))
    saved = F.col("shared_sum") - F.col("shared") - (F.col("n_convs") - 1) * F.col("before")
    empty = hashlib.sha256().hexdigest()
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
