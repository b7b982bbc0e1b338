"""Work and memory of steps that once grew too fast."""

import collections
import hashlib
import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from countloom import catalog  # noqa: F401
from countloom.operators import chunks, counts, intervals, matching, merges, models, segments, sites
from countloom.plans import registry
from countloom.sources import indexed, lines


def moved(spark, f):
    """MB that f writes to shuffles and files."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() + stages.apply(i).outputBytes() for i in range(stages.size()))

    before = total()
    out = f()
    return (total() - before) / 1e6, out


def peak_of(f) -> float:
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def chunk_batch(n: int, size: int) -> pa.RecordBatch:
    text = "acgtN GC" * (size // 8)
    return pa.RecordBatch.from_arrays([pa.array([0] * n), pa.array([size] * n), pa.array([0] * n), pa.array([text] * n)], chunks.NAMES)


def test_window_bins_hold_little():
    """Two million letters in one batch: the bins of all sixteen pairs take bounded memory."""
    batch, pairs = chunk_batch(100, 20_000), [a + b for a in "ACGT" for b in "ACGT"]

    def run():
        for s in chunks.sides([batch], 100):
            for p in pairs:
                s.ratio_bins(p, 100, (0.25, 0.5, 1.0))

    assert peak_of(run) < 60


def test_ratio_bins_are_those_of_a_plain_count():
    text, half, edges = "aCGtNNgcgCGATta cgcg" * 3, 4, (0.25, 0.5, 1.0, 1.5)
    row = (0, len(text), 0, text)
    batch = pa.RecordBatch.from_arrays([pa.array([x]) for x in row], chunks.NAMES)
    (side,) = chunks.sides([batch], half)
    up = text.upper()
    for pair in ("CG", "TA", "GG"):
        want = []
        for i in range(len(up)):
            w = up[max(0, i - half) : i + half + 1]
            under = w.count(pair[0]) * w.count(pair[1])
            over = sum(w[j : j + 2] == pair for j in range(len(w) - 1)) * sum(c in "ACGT" for c in w)
            want.append(sum(over / under >= e for e in edges) if under else len(edges) + 1)
        assert side.ratio_bins(pair, half, edges).tolist() == want


def test_counts_by_place_and_by_order_agree(monkeypatch):
    key = np.random.default_rng(1).integers(0, 5000, 20_000)
    one = chunks._tally(key, 5000)
    monkeypatch.setattr(chunks, "PLACES", 10)
    for a, b in zip(one, chunks._tally(key, 5000), strict=True):
        assert a.tolist() == b.tolist()


def test_a_run_without_counts_keeps_its_types():
    none = np.empty(0, np.int64)
    (batch,) = chunks._counted(pa.schema([]), [()], none, [(("+",), none)], ["strand"])
    assert batch.num_rows == 0 and batch.schema.field("strand").type == pa.string()


def test_joint_keys_are_counted_in_small_runs():
    """Two million letters: word, share bin and three ratio bins of each position."""

    def run():
        for s in chunks.sides([chunk_batch(100, 20_000)], 100):
            code = s.words(6) * 9 + s.share_bins(100, (0.3, 0.5))
            for p in ("CG", "GG", "TA"):
                code = code * 8 + s.ratio_bins(p, 100, (0.5, 1.0))
            chunks._tally(code, 4097 * 9 * 512)

    assert peak_of(run) < 60


def held_function(spark, monkeypatch, call, columns):
    """What an operator gives to mapInArrow."""
    held, df = {}, spark.createDataFrame([], columns)
    with monkeypatch.context() as m:
        m.setattr(type(df), "mapInArrow", lambda self, f, schema: held.setdefault("f", f) and df.sparkSession.createDataFrame([], schema))
        call(df)
    return held["f"]


def test_both_strands_share_ratio_bins(spark, monkeypatch):
    """CG and TA are their own reverse complements: four of six bins are worked out, each once a run."""
    f = held_function(spark, monkeypatch, lambda df: chunks.joint_bins(df, 6, 100, ("CG", "GG", "TA"), (0.3, 0.5), (0.5, 1.0), []), "core_start long, size long, pad_left long, bases string")
    calls, bins = [], chunks._bins
    monkeypatch.setattr(chunks, "_bins", lambda *a: calls.append(1) or bins(*a))
    out = list(f([chunk_batch(4, 20_000)]))
    assert len(calls) == 5 and sum(sum(b.column("n").to_pylist()) for b in out) == 2 * 4 * 20_000


@pytest.mark.parametrize("k", [1, 2, 4])
def test_kmer_runs_hold_little(k):
    """A batch of eight million letters: neither its strings nor the windows of a run take much."""
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 400), pa.array(["ACGT N" * 3333] * 400)], ["key", "text"])

    def run():
        for points, lengths, owners in counts._runs([batch], k - 1):
            at, _ = counts._windows_of(points, lengths, k)
            counts.rolling_codes(counts.DIGIT[np.minimum(points, 127)], k)[at]

    assert peak_of(run) < 40


@pytest.mark.parametrize("k", [2, 4])
def test_kmer_counts_hold_bytes(spark, monkeypatch, k):
    """Eight million letters: a run takes a few bytes a letter, from the text's bytes to its counts."""
    f = held_function(spark, monkeypatch, lambda df: counts.kmer_counts(df, "text", k, ["key"]), "key long, text string")
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 400), pa.array(["ACGT N" * 3333] * 400)], ["key", "text"])
    out = []
    assert peak_of(lambda: out.extend(f([batch]))) < 10
    assert sum(sum(b.column("n").to_pylist()) for b in out) == 400 * (19_998 - k + 1)


@pytest.mark.parametrize("run", [1, 2, 3, 7, 1 << 18])
def test_kmer_counts_of_any_piece(spark, monkeypatch, run):
    """Sizes 1 to 3 in one pass, in either case, by pieces of few bytes: no window twice, none across texts."""
    texts = [("a", "acGTéA漢CGcgNNta"), ("a", "g"), ("b", "TTé"), ("b", None), ("b", ""), ("c", "é"), (None, "AC"), ("a", "😀aC")]
    f = held_function(spark, monkeypatch, lambda df: counts.kmer_counts(df, "text", (1, 2, 3), ["key"]), "key string, text string")
    monkeypatch.setattr(counts, "RUN", run)
    want = collections.Counter()
    for key, t in texts:
        up = (t or "").upper()
        for k in (1, 2, 3):
            for i in range(len(up) - k + 1):
                w = up[i : i + k]
                want[key, k, sum("ACGT".index(c) * 4 ** (k - 1 - j) for j, c in enumerate(w)) if set(w) <= set("ACGT") else 4**k] += 1
    got = collections.Counter()
    for b in f([pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*texts, strict=True)], ["key", "text"])]):
        for r in b.to_pylist():
            got[r["key"], r["k"], r["code"]] += r["n"]
    assert got == want


def test_pairs_and_bases_are_one_pass(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "x", "acgtCG"), (2, "y", "CGé"), (3, None, "AC")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    calls, of = [], counts.kmer_counts
    monkeypatch.setattr(counts, "kmer_counts", lambda *a: calls.append(1) or of(*a))
    got = {(r.source, r.pair): r.observed_expected for r in registry.QUERIES["d8_all_pairs"](spark, str(tmp_path)).collect()}
    assert len(calls) == 1 and got[("x", "CG")] == 2 * 6 / 4 and got[("y", "CG")] == 2 and got[(None, "AC")] == 2 and len(got) == 6


def test_letter_counts_hold_bytes(spark, monkeypatch):
    f = held_function(spark, monkeypatch, lambda df: counts.letter_counts(df, "text", ["id"]), "id long, text string")
    batch = pa.RecordBatch.from_arrays([pa.array(range(403)), pa.array([None, "", "é漢a", *["ACGT N" * 3333] * 400])], ["id", "text"])
    out = []
    assert peak_of(lambda: out.extend(f([batch]))) < 4
    assert out[0].column("length").to_pylist()[:4] == [None, 0, 3, 19998] and out[0].column("a").to_pylist()[:4] == [0, 0, 1, 3333]


def test_letter_counts_hold_little(spark, monkeypatch):
    """The letters of a batch are read one text at a time."""
    held = {}
    df = spark.createDataFrame([(1, "Aa")], "id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: held.setdefault("f", f))
    counts.letter_counts(df, "text", ["id"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([None, "", *["ACGT N" * 3333] * 398])], ["id", "text"])
    out = []
    assert peak_of(lambda: out.extend(held["f"]([batch]))) < 15
    assert out[0].column("length").to_pylist()[:3] == [None, 0, 19998] and out[0].column("t").to_pylist()[1:3] == [0, 3333]


def test_token_runs_hold_little():
    """A batch of eight million letters is merged in small runs."""

    def run():
        for rows in merges._runs([chunk_batch(400, 20_000)]):
            merges._Merger([("A", "C"), ("G", "T")])([r[-1] for r in rows])

    assert peak_of(run) < 40


def test_segments_write_edges_only(spark, tmp_path):
    """Final runs are neither written nor shuffled, whatever their number, and none is lost."""
    rows = spark.range(200).select("id", F.expr("repeat('aC .', 2500)").alias("text"))
    mb, n = moved(spark, lambda: segments.segments(chunks.of_texts(rows, "text", ["id"], 0), "id").agg(F.count("*"), F.sum(F.expr("end - start"))).first())
    assert tuple(n) == (200 * 3 * 2500, 200 * 10_000) and mb < 1


def test_positions_are_never_shuffled(spark):
    """Spans of half a million positions: what moves goes with tiles and values."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spans = spark.range(100).select(F.col("id").alias("contig"), F.lit(3).cast("long").alias("start"), F.lit(5003).cast("long").alias("end"))
        values = spark.range(100).select(F.col("id").alias("contig"), F.explode(F.expr("array(3L, 127L, 128L, 5002L, 6000L)")).alias("pos"), F.lit(2).alias("c"))
        mb, n = moved(spark, lambda: intervals.expanded_with(spans, values, "c").agg(F.count("*"), F.sum("pos"), F.sum("c"), F.sum(F.expr("case when c = 2 then pos end"))).first())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert tuple(n) == (500_000, 100 * sum(range(3, 5003)), 800, 100 * (3 + 127 + 128 + 5002)) and mb < 0.5


def test_permutations_move_numbers_of_rows(spark):
    """Two columns, twice: what moves is a number for each row and repeat, and the drops are those of shuffled_column()."""
    x, c = F.col("id") % 10, F.when(F.col("id") % 7 > 0, (F.col("id") % 3).cast("string"))
    df = models.with_flags(spark.range(60_000).select("id", x.alias("x"), c.alias("c"), ((F.col("id") * 7919 % 10 + x) > 9).cast("double").alias("label")), ["x"])
    model = models.fit_counted(models.native_categories(["c"], ["x"]), models.estimator("tree"), df.drop("id"))
    plain = Pipeline(stages=[models.native_categories(["c"], ["x"]), models.estimator("tree")]).fit(df)
    assert model.stages[-1].toDebugString.split("\n")[1:] == plain.stages[-1].toDebugString.split("\n")[1:]
    mb, got = moved(spark, lambda: {(r.feature, r.repeat): r.drop for r in models.permutation_importance(plain, df, ["x", "c"], "id").collect()})
    area = lambda d: models.auc_of(models.probability(plain.transform(d)))
    whole = area(df)
    assert all(got[k, r] == whole - area(models.shuffled_column(df, k, "id", 42 + 2 * r)) for k, r in (("x", 1), ("c", 0)))
    assert mb < 10


def test_matched_pairs_are_counted_by_score(spark, monkeypatch):
    """The counts are those of the pairs, the draw is that of a plain sort, and what moves goes with scores and not with rows."""
    monkeypatch.setattr(matching, "DIGITS", 1)
    score = lambda n: ((F.col("id") * 7919 % n) + 0.5) / n
    rows = spark.range(3_000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"), score(37).alias("p"))
    names = ("width", "bin", "pair", "first_key", "second_key", "p1", "p2")
    pairs = [tuple(r) for r in matching.logit_pairs(rows, "id", "c", "p", "a", "b", [0.5, 2.0]).select(*names).collect()]
    counted = matching.logit_pair_counts(rows, "id", "c", "p", "a", "b", [0.5, 2.0]).groupBy("width", "bin", "p1", "p2").agg(F.sum("n")).collect()
    assert {tuple(r[:4]): r[4] for r in counted} == collections.Counter((w, b, p1, p2) for w, b, _, _, _, p1, p2 in pairs)
    held: dict = {}
    for i, c, p in rows.collect():
        for w in (0.5, 2.0):
            held.setdefault((w, math.floor(math.log(p / (1 - p)) / w)), {}).setdefault(c, []).append((hashlib.md5(str(i).encode()).hexdigest(), i, p))
    want = set()
    for (w, b), of in held.items():
        n = min(len(of.get("a", [])), len(of.get("b", [])))
        a, z = (sorted((p, i) for _, i, p in sorted(of.get(c, []))[:n]) for c in "ab")
        want |= {(w, b, k + 1, x[1], y[1], x[0], y[0]) for k, (x, y) in enumerate(zip(a, z, strict=True))}
    assert set(pairs) == want and len(pairs) == len(want) > 1000
    many = spark.range(200_000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"), score(37).alias("p"))
    monkeypatch.undo()
    sizes = spark.range(1).select(F.lit(1).alias("n_first"), F.lit(1).alias("n_second"))
    mb, _ = moved(spark, lambda: matching.pair_quality(matching.logit_pair_counts(many, "id", "c", "p", "a", "b", [0.5]), sizes).collect())
    assert mb < 2


def test_held_out_scores_are_those_of_whole_rows(spark):
    """Preprocessing is fitted once for all pipelines that share it, last stages on counted rows, forests on all; the metrics are those of plain fits."""
    x = F.col("id") % 10
    df = spark.range(4_000).select(x.cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("c"), ((F.col("id") * 7919 % 10 + x) > 9).cast("double").alias("label"), (F.col("id") % 4).alias("fold"))
    df = models.with_flags(df, ["x"])
    head, fits = models.preprocessor(["x"], ["c"]), []
    counts = models.counted(df)
    assert counts.count() < 200
    pipelines = {n: Pipeline(stages=[head, models.estimator(n)]) for n in ("logistic", "ridge", "tree", "forest")}
    fit, Pipeline.fit = Pipeline.fit, lambda self, rows, *a: fits.append(self) or fit(self, rows, *a)
    try:
        got = models.held_out(df, counts, F.col("fold") == 0, pipelines)
    finally:
        Pipeline.fit = fit
    assert len([p for p in fits if p.getStages() == [head]]) == 1
    for name, *found in got:
        plain = models.probability(pipelines[name].fit(df.where("fold <> 0")).transform(df.where("fold = 0")))
        rows = [(r.score, r.label) for r in plain.select(F.round("score", 12).alias("score"), "label").collect()]
        good, bad = ([s for s, y in rows if y == k] for k in (1, 0))
        auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad)
        loss = -sum(math.log(min(max(s if y else 1 - s, 1e-15), 1)) for s, y in rows) / len(rows)
        right = sum((s >= 0.5) == (y == 1) for s, y in rows) / len(rows)
        assert (found[0], found[3]) == (pytest.approx(auc, abs=1e-9), pytest.approx(right))
        assert name == "ridge" or found[2] == pytest.approx(loss, abs=1e-5)
        assert found[1] == pytest.approx(models.metrics_of(plain)[1], abs=1e-9)


def test_strength_search_counts_single_numbers(spark, monkeypatch):
    """What each step of the search reads are distinct positives, negatives and totals, not their pairs."""
    held, pin = [], models.pinned
    monkeypatch.setattr(models, "pinned", lambda df: held.append(pin(df)) or held[-1])
    rows = spark.range(1550).select((50 + F.col("id") % 50).alias("total"), (F.col("id") % 31).alias("positive"))
    models.best_strength(rows, tolerance=0.1)
    assert held[0].count() < 200 and held[0].where("sign = -1").agg(F.sum("n")).first()[0] == 1550


def test_probe_reads_texts_once(spark, monkeypatch):
    from countloom.plans import learning

    held, pin = [], learning.pinned
    monkeypatch.setattr(learning, "pinned", lambda df: held.append(pin(df)) or held[-1])
    got = learning.h13_probe_splits(lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")).collect()
    assert len(got) == 2 and len(held) == 1 and held[0].columns == ["doc_id", "source", "label", "features"]


@pytest.mark.parametrize("of", ["records", "index"])
def test_lines_of_records_travel_together(spark, tmp_path, of):
    """Records of a hundred thousand lines: what moves are pieces of many lines, each written once, and for the index a few numbers."""
    rows = spark.range(100).select("id", F.expr("repeat('ACGTNACGTGACCATTNGCA', 3000)").alias("s"))
    indexed.write_sequences(rows, "id", "s", f"file://{tmp_path}/s")
    if of == "records":
        mb, found = moved(spark, lambda: lines.records(spark, f"file://{tmp_path}/s").agg(F.count("*"), F.sum(F.length("bases")), F.sum("start")).first())
        assert found[0] < 100 * 1000 / 50 and found[1] == 6_000_000
    else:
        mb, found = moved(spark, lambda: indexed.build_index(spark, f"file://{tmp_path}/s").agg(F.count("*"), F.sum("length")).first())
        assert tuple(found) == (100, 6_000_000)
    assert mb < 1


def test_compositions_hold_little(spark, monkeypatch):
    """Ten million letters in a batch of windows: their three widths are read off running sums over a few windows at a time, and no letters come out."""
    held, text = {}, "acGé日tN CGTT" * 91
    df = spark.createDataFrame([(1, text, 0, 0)], "id long, raw string, left int, right int")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: held.setdefault("f", f))
    sites.composition(df, [51, 201, 1001], 500)
    n, out = 10_000, []
    left = [i % 501 for i in range(n)]
    raw = [text[: 1001 - x] for x in left]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(raw), pa.array(left, pa.int32())], ["id", "raw", "left"])
    assert peak_of(lambda: out.extend(held["f"]([batch]))) < 60
    assert out[0].schema.names == ["id", "width", "edge", "n", "gc", "valid", "lower"] and sum(b.num_rows for b in out) == 3 * n
    for r in (r for b in out[:1] + out[-1:] for r in b.to_pylist()[::7]):
        c, h = 500 - left[r["id"]], r["width"] // 2
        s = raw[r["id"]][max(0, c - h) : c + h + 1]
        assert (r["n"], r["edge"]) == (len(s), len(s) < r["width"])
        assert (r["gc"], r["valid"], r["lower"]) == tuple(sum(x in of for x in s) for of in ("CGcg", "ACGTacgt", "acgt"))
