"""The pipeline, stage by stage and as a whole, against plain Python; and rows that are odd in many ways at once."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from countloom.llm import chat, common, minhash, mixing, multiindex, nbsvm, packing, queries, rules, substrings, toxicity, warc

RNG = np.random.Generator(np.random.PCG64(9))
VOCAB = [f"w{i}" for i in range(900)]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the code uses for its own columns somewhere.
CLASHES = ("tk", "late", "size", "score", "block", "row", "id", "same", "key", "node", "rep", "take", "takes", "copies", "kept", "n", "d", "l", "bucket", "salt", "rank", "pass", "shard", "n_words")


def prose(n):
    return " ".join(RNG.choice(VOCAB, n))


@pytest.fixture(scope="module")
def corpus():
    base, passage = prose(200), prose(40)
    near = base.split()
    near[50] = "zz"
    texts = [base, base, " ".join(near), None, "", prose(30), "$ # " * 60, *(f"{prose(60)} {passage} {prose(60)}" for _ in range(8)), *(prose(80) for _ in range(20))]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None) for i, t in enumerate(texts)]
    twin = prose(90)
    return [*rows, (1, twin, "en", "s1", None), (9, prose(70), "en", "s0", None), (None, prose(75), None, None, None), (None, base, None, "s2", None)]


@pytest.fixture
def tables(spark, corpus, tmp_path):
    spark.createDataFrame(corpus, KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def base_kept(text):
    w = WORD.findall(text or "")
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    cover = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)}
    return len(w) >= 50 and 100 * len(cover) <= 50 * len(w)


def unique(rows):
    """Of linked texts the row of the least id stays; null ids link with nothing."""
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in (WORD.findall((r[1] or "").lower()) for r in rows)]
    name = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if rows[a][0] is not None and rows[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    name[a] = name[b] = min(name[a], name[b])
    least = {}
    for i, k in enumerate(name):
        if rows[i][0] is not None:
            least[k] = min(least.get(k, rows[i][0]), rows[i][0])
    return [r for i, r in enumerate(rows) if r[0] is None or r[0] == least[name[i]]]


def stripped(rows):
    words, least = [WORD.findall(r[1] or "") for r in rows], {}
    for r, w in zip(rows, words, strict=True):
        for j in range(len(w) - 12) if r[0] is not None else ():
            key = tuple(w[j : j + 13])
            least[key] = min(least.get(key, r[0]), r[0])
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = {j + k for j in range(len(w) - 12) if r[0] is not None and least[tuple(w[j : j + 13])] < r[0] for k in range(13)}
        out.append((r[0], [x for j, x in enumerate(w) if j not in gone]))
    return out


def test_stages_against_plain_python(spark, corpus, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, got = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, tables), "test")
        assert docs.columns == columns, name
        got.append([tuple(r) for r in docs.collect()])
    want = [r for r in corpus if base_kept(r[1])]
    assert Counter(got[0]) == Counter(want)
    want = unique(want)
    assert Counter(got[1]) == Counter(want) and (1, "twin") not in got[1]
    assert sum(r[0] == 1 for r in got[1]) == 1  # of id 1 the copy went, its other text stayed
    want = stripped(want)
    assert Counter((r[0], tuple(WORD.findall(r[1] or ""))) for r in got[2]) == Counter((i, tuple(w)) for i, w in want)
    times = Counter((r[0], r[1]) for r in got[3])
    assert set(times) <= {(r[0], r[1]) for r in got[2]} and max(times.values()) <= 3
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    held = Counter()
    for r in pieces:
        held[r.doc_id] += r.length
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(queries.tokenizer_path()), Counter()
    for r in got[3]:
        want[r[0]] += len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1
    assert held == want


def test_run_gives_every_piece_of_the_mix(spark, tables):
    got = corpus_pipeline.run(spark, tables).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 2048 or at & (at - 1) == 0
    assert sum(r.length for r in got) > 0


def test_mix_is_sharded_and_sorted(spark):
    rows = [(i, prose(int(RNG.integers(20, 200))), f"s{i % 4}", i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, at int")
    takes = {r.doc_id: [tuple(t) for t in r.takes] for r in mixing.mixture(docs, 40).collect()}
    assert {s for t in takes.values() for s, _ in t} <= set(range(40))
    spans = mixing.mixed_documents(docs, 40).withColumn("part", F.spark_partition_id()).collect()
    left = {i: list(t) for i, t in takes.items()}
    shards, seen = {}, []
    for r in spans:
        seen.append((r.part, r.doc_id))
    assert Counter(i for _, i in seen) == Counter({i: len(t) for i, t in left.items() if t})
    order = {}
    for part, i in seen:
        order.setdefault(part, []).append(i)
    for part, ids in order.items():  # ids of a partition, in order, can be read as rising (shard, slot)
        at = (-1, -(2**63))
        for i in ids:
            fit = min(t for t in left[i] if t >= at)
            left[i].remove(fit)
            assert shards.setdefault(fit[0], part) == part
            at = fit


def test_split_tree_draws_without_replacement(spark):
    """Quotas of two sources over 40 shards: shard sizes are even, and counts spread as the hypergeometric law says."""
    units = spark.range(2000).select((F.col("id") % 4 == 0).cast("int").alias("rank"), F.lit(0).alias("pass"), F.col("id").alias("block"))
    got = mixing.split_tree(common.cut(units, "test"), 40, 5).groupBy("shard").agg(F.count("*").alias("n"), F.sum("rank").alias("k")).collect()
    assert {r.n for r in got} == {50} and sum(r.k for r in got) == 500
    variance = 50 * 0.25 * 0.75 * (2000 - 50) / (2000 - 1)
    assert 0.5 * variance < np.var([r.k for r in got]) < 1.8 * variance
    assert mixing.split_tree(common.cut(units, "test"), 40, 5).exceptAll(mixing.split_tree(common.cut(units.repartition(3), "test"), 40, 5)).count() == 0


def test_base_columns_and_targets_against_sql(spark):
    import duckdb
    from pathlib import Path

    sf = "/root/testdata/sf0.001"
    if not Path(sf).is_dir():
        pytest.skip("no test tables here")
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    con = duckdb.connect()
    con.execute(f"create view documents as from '{sf}/documents.parquet'")
    base = con.sql(rf"""
    with d as (select doc_id, coalesce(text, '') as t, {words} as w from documents),
    g as (select doc_id, i, list_slice(w, i, i + 2) as x from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
    r as (select doc_id, i from g qualify count(*) over (partition by doc_id, x) > 1),
    c as (select doc_id, count(distinct i + k) as n from r, range(0, 3) u(k) group by 1),
    l as (select doc_id, x from (select doc_id, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '[^\x20\x09-\x0D]')),
    m as (select doc_id, count(*) - count(distinct x) as n from l group by 1)
    select doc_id, len(w), coalesce(list_sum([length(x) for x in w]), 0), length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')), coalesce(m.n, 0), coalesce(c.n, 0),
      len(w) < 50 or 100 * coalesce(c.n, 0) > 50 * len(w) from d left join c using (doc_id) left join m using (doc_id)""").fetchall()
    got = queries.op4_rules(spark, sf).drop("kept")
    assert sorted(tuple(int(x) for x in r) for r in got.collect()) == sorted(tuple(int(x) for x in r) for r in base)

    sizes = dict(con.sql(f"select source, sum(len({words})) from documents group by 1").fetchall())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, left = {s: i % 3 + 1 for i, s in enumerate(order)}, {}, float(sum(sizes.values()))
    open_ = set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        for s in full or open_:
            target[s] = 3.0 * sizes[s] if full else level * weight[s]
            left -= target[s]
        open_ -= full or open_
    rows = queries.op10_mixing(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    taken = Counter()
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and r.taken == len(r.shards) * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(r.size for r in rows if r.source == s) for s in order)


@pytest.fixture(params=["nulls", "empty table", "clashing names"])
def odd(request, spark):
    """documents with labels: all null; without rows; with extra columns whose names the code uses."""
    if request.param == "nulls":
        docs = spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, None, None, None, None), (1, None, None, None, None)], KIND)
    elif request.param == "empty table":
        docs = spark.createDataFrame([], KIND)
    else:
        text = prose(70)
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate([text, text, prose(60), f"{prose(20)} {text}"])], KIND)
        docs = docs.select("*", *(F.lit(c).alias(c) for c in CLASHES))
    labels = docs.select(F.col("doc_id"), F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    return docs, labels


def test_odd_tables(odd):
    docs, labels = odd
    n = docs.count()
    assert minhash.near_duplicates(docs).count() == n and minhash.unique_documents(docs).columns == docs.columns
    assert substrings.removed_passages(docs).count() == n
    without = substrings.without_repeats(docs)
    assert without.columns == docs.columns and without.count() == n
    assert mixing.mixture(docs).count() == n and mixing.mixed_documents(docs).columns == docs.columns
    assert rules.judged(docs, labels).count() == n and rules.good_documents(docs, labels).columns == docs.columns
    assert toxicity.score(docs, toxicity.train(docs, labels)).where("score = 0").count() == n
    assert nbsvm.score(docs, nbsvm.train(docs, labels)).where("score = 0.5").count() == n
    pieces = packing.pack(docs, queries.tokenizer_path())
    assert pieces.where("start = 0").count() == n
    if n == 4:
        kept = {r.doc_id: r for r in without.collect()}
        assert kept[1].text.split() == [] and all(getattr(kept[1], c) == c for c in CLASHES)
        assert sorted(r.doc_id for r in minhash.unique_documents(docs).collect()) == [0, 2, 3]
        assert all(getattr(r, c) == c for r in mixing.mixed_documents(docs).collect() for c in CLASHES)


def test_rows_that_repeat_an_id(spark, corpus):
    """Each row has its own result where an operator returns one a row; components are by id."""
    docs = spark.createDataFrame(corpus, KIND)
    n, one = len(corpus), hashlib.sha256
    got = Counter((r.doc_id, r.n_words, r.kept_sha256) for r in substrings.removed_passages(docs).collect())
    assert got == Counter((i, len(WORD.findall(r[1] or "")), one(" ".join(w).encode()).hexdigest()) for r, (i, w) in zip(corpus, stripped(corpus), strict=True))
    found = minhash.near_duplicates(docs, 5, 80).collect()
    assert len(found) == n and {r.component_id for r in found if r.doc_id == 1} == {0}
    ids = Counter((r.doc_id, r.doc_tokens) for r in packing.pack(docs, queries.tokenizer_path()).where("start = 0").collect())
    assert sum(ids.values()) == n and len([k for k in ids if k[0] == 1]) == 2
    assert Counter(r.doc_id for r in nbsvm.score(docs, None).collect()) == Counter(r[0] for r in corpus)


def test_conversations_and_pages_with_odd_rows(spark):
    rows = [(None, 1, "user", "a", 1), (None, None, None, None, 2), (7, 1, "assistant", "x", 3), (7, 1, "assistant", "x", 4), (7, None, "user", "<|im_start|>", 5), (8, 1, None, None, 6)]
    out = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, k int")).collect()}
    assert [(t.role, t.text) for t in out[None].turns] == [("", ""), ("user", "a")]
    assert [(t.role, t.text) for t in out[7].turns] == [("user", "<|im_start|>"), ("assistant", "x"), ("assistant", "x")]
    for r in out.values():
        assert len(r.spans) == sum(t.role == "assistant" for t in r.turns)
        assert all(r.formatted[s.start : s.start + s.length] == "x" for s in r.spans)
    many = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"t{i}" + "<|" * (i == 3)) for i in range(3000)], "conv_id long, turn long, role string, text string")
    whole = chat.format_conversations(many).withColumn("loss", chat.loss_texts(F.col("formatted"), F.col("spans"))).head()
    assert whole.loss == [f"t{i}" + "<|" * (i == 3) for i in range(1, 3000, 2)]
    page = "y" * 1200
    pages = [(None, "u", page, 1), (None, "u", page, 2), (4, "u", page, 3), (4, "v", page, 4), (2, None, None, 5), (2, "w", "s", 6), (9, "\x01 bad", page, 7)]
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(spark.createDataFrame(pages, "page_id long, url string, html string, digest int")).collect())
    assert got == Counter([(None, 1200, "revisit", 9)] * 2 + [(4, 1200, "revisit", 9)] * 2 + [(2, 0, "response", None), (2, 1, "response", None), (9, 1200, "response", None)])


def test_skewed_joins_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_OF_A_KEY", 10)
    many = common.cut(spark.range(500).select(F.when(F.col("id") < 300, 1).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("v")), "test")
    one = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    want = many.join(one, "k")
    for got in (common.skewed_join(many, one, "k", "v"), common.salted(many, one, "k", "v"), common.spread_join(many, one, "k", "v")):
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_digest_of_long_text(spark):
    """One text of a million words goes through the operators on texts."""
    text = " ".join(RNG.choice(VOCAB, 1_000_000))
    docs = spark.createDataFrame([(1, text), (2, prose(50))], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.removed_passages(docs).collect()}
    assert (got[1].n_words, got[1].n_removed) == (1_000_000, 0)
    pieces = packing.pack(docs.where("doc_id = 1"), queries.tokenizer_path()).collect()
    assert sum(p.length for p in pieces) == pieces[0].doc_tokens and zlib.crc32(b"") == 0
    assert {r.doc_id: r.n_shingles for r in minhash.near_duplicates(docs).collect()}[1] == 999_996
    assert multiindex.near_vectors(spark.createDataFrame([(1, [1.0] * 4096)], "vec_id long, embedding array<double>")).head().kept
