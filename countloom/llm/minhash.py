"""b-bit MinHash near-duplicates over word shingles.

128 minima a document; 32 bands of 4 whole minima give candidates (at similarity 0.8 a pair meets in
no band with probability 5e-8). The low 4 bits of each minimum, packed to 64 bytes, estimate the
similarity by counting equal nibbles and taking out chance collisions; pairs that pass a slack
threshold are confirmed on their full shingle sets, and links give connected components.

Hot groups: equal word sequences become one node first, by an aggregation that combines before it
shuffles. A band bucket links each member to the bucket's smallest member only (one row a member); joins on
buckets and on their smallest members deal such keys as many rows share to several tasks. What that star misses, members of one bucket
that are still in different components, is compared in blocks of bounded size in a second pass, on
whole sets, which returns a spanning forest of the links and never pairs.

Nulls and odd rows: a null or wordless text has an empty set and links with nothing; a null doc_id
never links and is its own row with component null; a text with fewer words than the shingle is one
shingle; rows that repeat a doc_id are one vertex, linked by each of their texts, and each gets its own row; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M1, MOST_SENT, Words, connected_components, cut, mix, skewed_join, spread_join, tasks_for, text_runs

HASHES, BITS, ROWS = 128, 4, 4
BANDS = HASHES // ROWS
BLOCK = 512
#: Shingles whose sets a task remembers.
MOST_KNOWN = 1 << 21
#: Rows of blocks that one task compares.
BLOCK_ROWS = 4096
_rng = np.random.Generator(np.random.PCG64(20240229))
MULT = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Of each text, its sorted distinct shingle hashes; the whole sequence counts as one where it is shorter than k."""
    grams, at = words.grams(k)
    edges = np.searchsorted(words.doc[at], np.arange(len(words.first)))
    out = []
    for i in range(len(words.first) - 1):
        got = np.unique(grams[edges[i] : edges[i + 1]])
        if not len(got) and words.first[i] < words.first[i + 1]:
            got = mix(np.array([np.bitwise_xor.reduce(mix(words.h[words.first[i] : words.first[i + 1]] + np.arange(1, 1 + words.first[i + 1] - words.first[i], dtype=np.uint64)))], np.uint64))
        out.append(got)
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, HASHES) of 32-bit minima; sets must not be empty."""
    out = np.empty((len(sets), HASHES), np.uint32)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= 1 << 14):
            n += len(sets[j])
            j += 1
        flat, cuts = np.concatenate(sets[i:j]), np.cumsum([0, *map(len, sets[i : j - 1])])
        for p in range(HASHES):
            out[i:j, p] = np.minimum.reduceat(flat * MULT[p] + ADD[p], cuts) >> np.uint64(32)
        i = j
    return out


def pack(least: np.ndarray) -> np.ndarray:
    low = (least & 15).astype(np.uint8)
    return low[:, ::2] | (low[:, 1::2] << 4)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (…, 64 bytes): share of equal nibbles less the share that meets by chance."""
    x = a ^ b
    equal = ((x & 15) == 0).sum(-1) + ((x >> 4) == 0).sum(-1)
    chance = 1 / (1 << BITS)
    return (equal / HASHES - chance) / (1 - chance)


def _sketch(k: int):
    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for row, data, offsets in text_runs(column):
                words = Words(data, offsets, lower=True)
                sets = shingle_sets(words, k)
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                least = minima([sets[i] for i in full])
                bands = np.zeros((len(full), BANDS), np.uint64)
                for r in range(ROWS):
                    bands = mix(bands * M1 + least[:, r::ROWS] + np.arange(1, BANDS + 1, dtype=np.uint64))
                signed, packed = list(bands.view(np.int64)), pack(least)
                at = np.full(len(n), -1)
                at[full] = np.arange(len(full))
                same = [hashlib.blake2b(words.h[words.first[i] : words.first[i + 1]].tobytes(), digest_size=16).digest() if n[i] else None for i in range(len(n))]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(n)), batch.column(2).slice(row, len(n)), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array([signed[j] if j >= 0 else None for j in at], pa.list_(pa.int64())), pa.array([packed[j].tobytes() if j >= 0 else None for j in at], pa.binary())],
                    ["doc_id", "tk", "n_shingles", "same", "bands", "sig"],
                )

    return run


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("tk"))


def sketch(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, tk (hash of the text), n_shingles, same (digest of the word sequence), bands (32 keys), sig (64 bytes)."""
    return keyed(docs).mapInArrow(_sketch(shingle), "doc_id long, tk long, n_shingles long, same binary, bands array<long>, sig binary")


def _similar(floor: float):
    def run(batches):
        for b in batches:
            both = [np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, HASHES * BITS // 8) for c in (b.column(2), b.column(3))]
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(estimate(*both) >= floor))

    return run


def _confirm(k: int, percent: int):
    def run(batches):
        known: dict = {}  # sets of the texts met last

        def sets(ids, texts):
            new = {i: t for i, t in zip(ids, texts, strict=True) if i not in known}
            if sum(map(len, known.values())) > MOST_KNOWN:
                known.clear()
                new = dict(zip(ids, texts, strict=True))
            for row, data, offsets in text_runs(pa.array(list(new.values()), pa.string())):
                for i, s in zip(list(new)[row:], shingle_sets(Words(data, offsets, lower=True), k), strict=False):
                    known[i] = s

        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                a, c, ta, tc = (x.to_pylist() for x in part.columns)
                sets(a + c, ta + tc)
                hit = []
                for x, y in zip(a, c, strict=True):
                    both = len(np.intersect1d(known[x], known[y], assume_unique=True))
                    hit.append(both > 0 and 100 * both >= percent * (len(known[x]) + len(known[y]) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(hit))

    return run


def texts_of(nodes: DataFrame, wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes: of the row that the node was made from. Their ids are sent to all tasks where they are counted few."""
    wanted = cut(nodes.select("node", "rep", "tk").join(wanted, "node", "left_semi"), "wanted")
    rows = keyed(docs).withColumnRenamed("doc_id", "rep")
    found = rows.join(F.broadcast(wanted) if wanted.count() <= MOST_SENT // 2 else wanted, ["rep", "tk"])
    return cut(found.select("node", F.coalesce("text", F.lit("")).alias("text")), "texts")


def confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes, a written table, whose whole sets have 100 * intersection >= percent * union."""
    texts = texts_of(nodes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), docs).dropDuplicates(["node"])
    joined = skewed_join(pairs, texts.toDF("a", "ta"), "a", "b").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(_confirm(shingle, percent), "a long, b long")


def _open_pairs(table, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of a bucket: its rows to the left and right, and which pairs are of different components and not ruled out by their signatures."""
    comp, side = (table.column(c).to_numpy() for c in ("component", "side"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(comp), -1)
    left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    if not len(left) or not len(right):
        return left, right, np.zeros((len(left), len(right)), bool)
    may = np.stack([estimate(sig[i], sig[right]) >= floor for i in left])
    return left, right, may & (comp[left][:, None] != comp[right][None, :])


def _flag(floor: float):
    """The rows of a block that have such a pair."""

    def run(table):
        left, right, may = _open_pairs(table, floor)
        return table.take(pa.array(np.union1d(left[may.any(1)], right[may.any(0)])))

    return run


def _settle(floor: float, percent: int):
    """Links of such pairs, on their whole sets: each row with the least rep that it reaches in the block."""

    def run(table):
        left, right, may = _open_pairs(table, floor)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        size = np.array([len(x) for x in sets], np.int64)
        code = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True)[1]
        row = np.repeat(np.arange(len(sets)), size)
        common = np.zeros(may.shape)
        for at in range(0, int(code.max(initial=-1)) + 1, 4096):
            ok = (code >= at) & (code < at + 4096)
            has = np.zeros((len(sets), 4096), np.float32)
            has[row[ok], code[ok] - at] = 1
            common += has[left] @ has[right].T
        link = may & (100 * common >= percent * (size[left][:, None] + size[right][None, :] - common))
        rep = table.column("rep").to_numpy()
        a, b, big = rep[left].copy(), rep[right].copy(), np.iinfo(np.int64).max
        while link.any():
            a2 = np.minimum(a, np.where(link, b, big).min(1))
            b2 = np.minimum(b, np.where(link, a2[:, None], big).min(0))
            if (a2 == a).all() and (b2 == b).all():
                break
            a, b = a2, b2
        out = np.stack([np.concatenate([rep[left], rep[right]]), np.concatenate([a, b])])
        out = out[:, out[0] != out[1]]
        return pa.table({"a": out[0], "b": out[1]})

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for row, data, offsets in text_runs(batch.column(1)):
                sets = shingle_sets(Words(data, offsets, lower=True), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), pa.array([x.tobytes() for x in sets], pa.binary())], ["rep", "set"])

    return run


def linked_nodes(docs: DataFrame, shingle: int, percent: int, slack: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Written tables: rows (the sketch of each document), nodes (one a different word sequence, with rep and tk of its least row),
    links (a, b: nodes), copies (doc_id, tk, rep, rep_tk of rows that share a node).

    percent: nodes link when 100 * intersection >= percent * union of their shingle sets.
    slack: pairs whose estimate is below percent / 100 - slack are not confirmed; 0.18 is five
    standard errors of the estimate."""
    floor = percent / 100 - slack
    rows = cut(sketch(docs, shingle), "sketch")
    full = rows.where("doc_id is not null and n_shingles > 0")
    nodes = full.groupBy("same").agg(F.min(F.struct("doc_id", "tk")).alias("r"), F.count("*").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = nodes.select("same", F.col("r.doc_id").alias("rep"), F.col("r.tk").alias("tk"), "n", "sig", "bands", F.monotonically_increasing_id().alias("node"))
    nodes = cut(nodes, "nodes")  # from here on node ids are fixed
    several = cut(nodes.where("n > 1").select("same", "rep", F.col("tk").alias("rep_tk")), "several")
    copies = cut(spread_join(full.select("doc_id", "tk", "same"), several, "same", "doc_id").select("doc_id", "tk", "rep", "rep_tk"), "copies")

    keys = cut(nodes.select("node", F.explode("bands").alias("key")), "keys")
    shared = keys.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("m")).where("m > 1")
    bucket = cut(skewed_join(keys, shared.select("key", "first"), "key", "node"), "buckets")
    star = cut(bucket.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "star")
    sig = nodes.select("node", "sig")
    near = skewed_join(star, sig.toDF("a", "sa"), "a", "b").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(_similar(floor), "a long, b long")
    links = cut(confirm(cut(near, "near"), nodes, docs, shingle, percent), "links")

    named = bucket.join(connected_components(links).toDF("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = cut(named.select("key", "node", "component"), "named")
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("key", "m", F.ceil(F.col("m") / BLOCK).alias("nb"))
    mixed = cut(mixed, "mixed")
    tasks = tasks_for(mixed.agg(F.coalesce(F.sum(F.col("m") * F.col("nb")), F.lit(0))).head()[0], BLOCK_ROWS)
    rest = skewed_join(named, mixed, "key", "node").join(sig, "node").select("key", F.col("node").alias("rep"), "component", "sig", "nb")
    own = F.pmod(F.xxhash64("rep"), F.col("nb"))
    rest = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    rest = rest.select("key", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), "rep", "component", "sig", F.when(lo == hi, 0).when(F.col("own") == lo, 1).otherwise(2).alias("side"))
    kind = "key long, lo long, hi long, rep long, component long, sig binary, side int"
    rest = cut(rest.repartition(tasks, "key", "lo", "hi").groupBy("key", "lo", "hi").applyInArrow(_flag(floor), kind), "rest")
    if not rest.isEmpty():
        texts = texts_of(nodes, rest.select(F.col("rep").alias("node")).distinct(), docs)
        sets = texts.mapInArrow(_sets(shingle), "rep long, set binary").dropDuplicates(["rep"])
        more = rest.join(sets, "rep").groupBy("key", "lo", "hi").applyInArrow(_settle(floor, percent), "a long, b long").distinct()
        links = links.unionByName(cut(more, "more"))
    return rows, nodes, links, copies


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, slack: float = 0.18) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id). Parameters as in linked_nodes()."""
    rows, nodes, links, copies = linked_nodes(docs, shingle, percent, slack)
    name = nodes.select("node", "rep")
    ends = links.join(name.toDF("a", "ra"), "a").join(name.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    found = connected_components(ends.unionByName(copies.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    out = rows.select("doc_id", "n_shingles").join(found.toDF("doc_id", "component_id"), "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def unique_documents(docs: DataFrame, shingle: int = 5, percent: int = 80, slack: float = 0.18) -> DataFrame:
    """docs with one document of each group of linked texts: that of the least id, then least text hash. An id that has several
    texts is judged text by text; rows equal in id and text are one document; rows that link with nothing all stay."""
    _, nodes, links, copies = linked_nodes(docs, shingle, percent, slack)
    group = nodes.select("node", "rep", "tk").join(connected_components(links).toDF("node", "component"), "node")
    first = group.groupBy("component").agg(F.min(F.struct("rep", "tk")).alias("first"))
    lost = skewed_join(cut(group, "groups"), first, "component", "node").where("rep <> first.rep or tk <> first.tk").select(F.col("rep").alias("id"), "tk")
    lost = lost.unionByName(copies.where("doc_id <> rep or tk <> rep_tk").select(F.col("doc_id").alias("id"), "tk"))
    lost = cut(lost.distinct(), "lost")
    lost = F.broadcast(lost) if lost.count() <= MOST_SENT // 2 else lost
    same = (F.col("d.doc_id").cast("long") == F.col("l.id")) & (F.xxhash64(F.col("d.text").cast("string")) == F.col("l.tk"))
    return docs.alias("d").join(lost.alias("l"), same, "left_anti").select(*(F.col(f"d.`{c}`") for c in docs.columns))
