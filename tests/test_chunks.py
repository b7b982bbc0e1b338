"""Windows over chunks against loops over whole texts, with cores of a few letters and of many."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.operators import chunks

DRAW = random.Random(4)
TEXTS = ["".join(DRAW.choice("ACGTACGTNacgt") for _ in range(n)) for n in (0, 1, 5, 40, 163)] + ["CGCGCG" * 9, "GGGGG", None]
ROWS = [(i % 3, t) for i, t in enumerate(TEXTS)]
OTHER = str.maketrans("ACGT", "TGCA")


def code(word, k):
    return sum("ACGT".index(c) * 4**i for i, c in enumerate(reversed(word))) if len(word) == k and set(word) <= set("ACGT") else 4**k


def each():
    """group, text in upper case, position."""
    for g, t in ROWS:
        up = (t or "").upper()
        for p in range(len(up)):
            yield g, up, p


def words(up, p, k):
    return code(up[p - k + 1 : p + 1] if p >= k - 1 else "", k), code(up[p : p + k][::-1].translate(OTHER), k)


@pytest.fixture(params=[7, 64, 1 << 17])
def pieces(spark, request, monkeypatch):
    monkeypatch.setattr(chunks, "RUN", request.param * 4)
    df = spark.createDataFrame(ROWS, "g int, text string").coalesce(2)
    return lambda halo: chunks.of_texts(df, "text", ["g"], halo, request.param)


def test_cores_cover_texts(pieces):
    got = Counter()
    for r in pieces(3).collect():
        core = r.bases[r.pad_left : r.pad_left + r.size]
        assert r.size > 0 and r.pad_left == min(3, r.core_start) and len(core) == r.size
        got[r.g] += r.size
    assert got == Counter(g for g, _, _ in each())


def test_oriented_kmers(pieces):
    want = Counter()
    for g, up, p in each():
        for k in (1, 2, 4):
            plus, minus = words(up, p, k)
            want.update([(g, "+", k, plus), (g, "-", k, minus)])
    assert {(r.g, r.strand, r.k, r.code): r.n for r in chunks.oriented_kmers(pieces(3), (1, 2, 4), ["g"]).collect()} == want


def test_joint_counts(pieces):
    want = Counter()
    for _, up, p in each():
        near = up[max(0, p - 5) : p + 6]
        want[words(up, p, 2)[0], sum(c in "GC" for c in near), sum(c in "ACGT" for c in near)] += 1
    assert {(r.code, r.gc, r.valid): r.n for r in chunks.joint_counts(pieces(5), 2, 5, []).collect()} == want


def ratio_bin(near, pair, edges):
    v, x, y = sum(c in "ACGT" for c in near), near.count(pair[0]), near.count(pair[1])
    both = sum(near[i : i + 2] == pair for i in range(len(near)))
    return sum(both * v / (x * y) >= e for e in edges) if x * y else len(edges) + 1


def test_joint_bins(pieces):
    share, ratio, pairs, want = (0.3, 0.5), (0.5, 1.0, 1.5), ("CG", "GG", "TA"), Counter()
    for g, up, p in each():
        plus = up[max(0, p - 6) : p + 7]
        v = sum(c in "ACGT" for c in plus)
        gc = sum(sum(c in "GC" for c in plus) / v >= e for e in share) if v else 3
        for strand, near, word in (("+", plus, words(up, p, 3)[0]), ("-", plus[::-1].translate(OTHER), words(up, p, 3)[1])):
            want[(g, strand, word, gc, *(ratio_bin(near, q, ratio) for q in pairs))] += 1
    got = chunks.joint_bins(pieces(6), 3, 6, pairs, share, ratio, ["g"]).collect()
    assert {(r.g, r.strand, r.code, r.gc_bin, r.cg_bin, r.gg_bin, r.ta_bin): r.n for r in got} == want
    with pytest.raises(ValueError, match="64 bits"):
        chunks.joint_bins(pieces(6), 8, 6, pairs * 9, share, ratio, ["g"])


def test_window_sums_and_pair_bins(pieces):
    sums, bins = {}, Counter()
    for g, up, p in each():
        near = up[max(0, p - 4) : p + 5]
        gc, v = sum(c in "GC" for c in near), sum(c in "ACGT" for c in near)
        n, a, b, most = sums.get(g, (0, 0, 0, 0))
        sums[g] = (n + 1, a + gc, b + v, max(most, gc))
        bins.update((g, q, ratio_bin(near, q, (1.0,))) for q in ("CG", "AA"))
    assert {r.g: tuple(r)[1:] for r in chunks.window_sums(pieces(4), 4, ["g"]).collect()} == sums
    assert {(r.g, r.pair, r.bin): r.n for r in chunks.pair_bins(pieces(4), 4, ["CG", "AA"], (1.0,), ["g"]).collect()} == bins


def test_lines_of_a_record_are_many_chunks(spark):
    whole = "".join(DRAW.choice("ACGTN") for _ in range(500))
    lines = spark.createDataFrame([("c", i, whole[i : i + 30]) for i in range(0, 500, 30)], "contig string, start long, bases string")
    text = spark.createDataFrame([("c", whole)], "contig string, text string")
    for f in (lambda c: chunks.oriented_kmers(c, (2, 4), ["contig"]), lambda c: chunks.joint_bins(c, 2, 9, ("CG",), (0.5,), (1.0,), ["contig"])):
        one, many = (sorted(map(tuple, f(c).collect())) for c in (chunks.of_texts(text, "text", ["contig"], 9), chunks.of_lines(lines, 9, 64)))
        assert one == many
    assert chunks.of_lines(lines, 9, 64).count() == 8


def test_a_long_record_in_bounded_memory(spark):
    """Forty million letters in one text: a task lays side by side about RUN letters at a time."""
    text = spark.range(1).select(F.repeat(F.lit("ACGTTGCANN"), 4_000_000).alias("text"))
    seen = []

    def watched(batches):
        import pyarrow as pa

        for s in chunks.sides(batches, 100):
            yield pa.RecordBatch.from_arrays([pa.array([len(s.digits)]), pa.array([len(s.at)])], ["laid", "core"])

    seen = chunks.of_texts(text, "text", [], 100).mapInArrow(watched, "laid long, core long").agg(F.max("laid").alias("laid"), F.sum("core").alias("core")).head()
    assert seen.core == 40_000_000 and seen.laid < chunks.RUN + chunks.WIDTH + 10_000
    got = {r.code: r.n for r in chunks.joint_counts(chunks.of_texts(text, "text", [], 100), 1, 100, []).groupBy("code").agg(F.sum("n").alias("n")).collect()}
    assert got == dict(zip(range(5), np.array([2, 2, 2, 2, 2]) * 4_000_000, strict=True))
