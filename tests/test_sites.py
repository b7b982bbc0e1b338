"""Contexts, byte ranges, segments and duplicates against loops over whole texts."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from countloom.operators import chunks, duplicates, segments, sites
from countloom.sources import indexed

DRAW = random.Random(8)
TEXTS = {f"c{i}": "".join(DRAW.choice("ACGTacgtN") for _ in range(n)) for i, n in enumerate((1, 2, 59, 60, 61, 120, 333))} | {"odd": "aé日本CG" * 9, "empty": ""}
OTHER = str.maketrans("ACGT", "TGCA")


def context(text, p, half, strand):
    up = "".join(c if c in "ACGT" else "N" for c in text.translate(str.maketrans("acgt", "ACGT")))
    s = ("N" * half + up + "N" * half)[p : p + 2 * half + 1]
    return s[::-1].translate(OTHER) if strand == "-" else s


def asked(more=()):
    rows = [(c, p, s) for c, t in TEXTS.items() for p in sorted({0, len(t) // 3, len(t) // 2, max(0, len(t) - 1)}) if p < len(t) for s in "+-"]
    return [*rows, *more]


@pytest.mark.parametrize("width", [5, 1 << 17])
def test_contexts(spark, width):
    texts = spark.createDataFrame([*TEXTS.items(), (None, "ACGT")], "contig string, text string")
    rows = asked()
    odd = [("none", 3, "+"), ("c3", 60, "+"), ("c3", -1, "-"), (None, 0, "+"), ("c3", None, "+")]
    got = sites.contexts(texts, spark.createDataFrame([*rows, *odd, rows[0]], "contig string, pos long, strand string"), "contig", "text", 6, width).collect()
    assert sorted(map(tuple, got)) == sorted((*r, context(TEXTS[r[0]], r[1], 6, r[2])) for r in [*rows, rows[0]])


def test_composition(spark):
    texts = spark.createDataFrame(list(TEXTS.items()), "contig string, text string")
    rows = spark.createDataFrame(asked(), "contig string, pos long, strand string")
    for r in sites.composition(sites.windows_at(texts, rows, "contig", "text", 20, 16), [5, 41], 20).collect():
        h = r.width // 2
        s = TEXTS[r.contig][max(0, r.pos - h) : r.pos + h + 1]
        assert (r.n, r.edge, r.gc, r.valid, r.lower) == (len(s), len(s) < r.width, sum(c in "GCgc" for c in s), sum(c in "ACGTacgt" for c in s), sum(c in "acgt" for c in s))


def test_indexed_contexts_read_only_their_regions(spark, tmp_path):
    plain = {c: t for c, t in TEXTS.items() if t and t.isascii()} | {"long": "".join(DRAW.choice("ACGT") for _ in range(400_000))}
    df = spark.createDataFrame(list(plain.items()), "contig string, bases string").repartition(2)
    indexed.write_sequences(df, "contig", "bases", f"{tmp_path}/fasta")
    index = indexed.build_index(spark, f"{tmp_path}/fasta")
    assert {r.contig: r.length for r in index.collect()} == {c: len(t) for c, t in plain.items()}
    rows = [(c, p, s) for c, t in plain.items() for p in (0, len(t) // 2, len(t) - 1) for s in "+-"] + [("long", 5_000 * i, "+") for i in range(20)]
    odd = [("none", 0, "+"), ("c2", 59, "+"), ("c2", -1, "+"), (None, 0, "+")]
    got = indexed.indexed_contexts(index, spark.createDataFrame([*rows, *odd], "contig string, pos long, strand string"), 25, gap=64).collect()
    assert sorted((r.contig, r.pos, r.strand, r.context) for r in got) == sorted((*r, context(plain[r[0]], r[1], 25, r[2])) for r in rows)
    assert 0 < sum(r.bytes_read for r in got) < len(rows) * 60


def test_ranges_that_lie_near_are_one_read():
    assert list(indexed.merged_ranges([(0, 10), (5, 8), (12, 20), (100, 110), (111, 200)], 2, 50)) == [(0, 20, 3), (100, 110, 1), (111, 200, 1)]


@pytest.mark.parametrize(("lines", "said"), [(["ACGT", ">a", "A"], "before a header"), ([">a", "ACG", "AC", "ACG"], "differ in length"), ([">a", "A", ">a", "C"], "repeated"), ([">", "A"], "repeated or empty")])
def test_bad_sequence_files(spark, tmp_path, lines, said):
    (tmp_path / "bad.txt").write_text("\n".join(lines) + "\n")
    with pytest.raises(ValueError, match=said):
        indexed.build_index(spark, str(tmp_path / "bad.txt"))


def plain_runs(text):
    out, at = [], 0
    for kind, letters in groupby(text, lambda c: "upper" if c in "ACGT" else "lower" if c in "acgt" else "other"):
        n = len(list(letters))
        out.append((at, at + n, kind))
        at += n
    return out


@pytest.mark.parametrize("width", [1, 3, 16, 1 << 17])
def test_segments_join_over_chunks(spark, width):
    texts = TEXTS | {"n": "N" * 50 + "acgt" * 9 + "A", "one": "G" * 77}
    df = spark.createDataFrame(list(texts.items()), "contig string, text string")
    got = segments.segments(chunks.of_texts(df, "text", ["contig"], 0, width), "contig").collect()
    assert sorted(map(tuple, got)) == sorted((c, *r) for c, t in texts.items() for r in plain_runs(t))


def test_text_groups(spark, monkeypatch):
    rows = [("a", 0), ("a", 1), ("b", 1), ("b", 1), (None, 0), (None, 2), ("", 0), ("c" * 5000, 2)]
    df = spark.createDataFrame(rows, "text string, fold int")
    want = (8, 5, 3, 2, 2, 4)
    assert tuple(duplicates.summary(duplicates.text_groups(df, "text", F.col("fold"))).head()) == want
    assert tuple(duplicates.summary(duplicates.text_groups(df.limit(0), "text")).head()) == (0, 0, 0, 0, 0, 0)
    monkeypatch.setattr(F, "unhex", lambda c: F.lit(b"same"))  # digests that tell nothing apart: letters are compared
    assert tuple(duplicates.summary(duplicates.text_groups(df, "text", F.col("fold"))).head()) == want
