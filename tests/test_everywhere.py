"""Windows around every position of each text, short texts and both ends included, against plain loops."""

from collections import Counter

from countloom import catalog

TEXTS = [(1, "acGTxAC"), (2, "g"), (3, ""), (4, None), (5, "TTé CA" * 40)]


def fold(t):
    return "".join(c if c in "ACGT" else "N" for c in (t or "").translate(str.maketrans("acgt", "ACGT")))


def around(half):
    for i, t in TEXTS:
        s = "N" * half + fold(t) + "N" * half
        for p in range(len(t or "")):
            yield i, s[p : p + 2 * half + 1]


def run(spark, tmp_path, name):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i, _ in TEXTS], "doc_id long, quality int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    return catalog.QUERIES[name](spark, str(tmp_path)).collect()


def test_contexts(spark, tmp_path):
    want = Counter()
    for _, w in around(5):
        want["+", w] += 1
        want["-", w.translate(str.maketrans("ACGT", "TGCA"))[::-1]] += 1
    assert {(r.strand, r.context): r.n for r in run(spark, tmp_path, "d1_contexts_everywhere")} == want


def test_positional_bases(spark, tmp_path):
    want = Counter((i, o - 3, b) for i, w in around(3) for o, b in enumerate(w) if b != "A")
    assert {(r.doc_id, r.at, r.base): r.n for r in run(spark, tmp_path, "d3_bases_everywhere")} == want


def test_base_frequency_by_class(spark, tmp_path):
    want = Counter((i % 2, o - 20, b) for i, w in around(20) for o, b in enumerate(w))
    got = run(spark, tmp_path, "e13_bases_everywhere")
    assert {(r["at"], r.base) for r in got} == {k[1:] for k in want}
    assert all((r.ones, r.zeros) == (want[1, r["at"], r.base], want[0, r["at"], r.base]) for r in got)
