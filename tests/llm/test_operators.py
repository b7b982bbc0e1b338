"""Small fixtures: edge rows and brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.llm import chat, minhash, mixing, multiindex, nbsvm, packing, queries, rules, substrings, toxicity, warc

RNG = np.random.Generator(np.random.PCG64(3))
VOCAB = [f"w{i}" for i in range(400)]
DOC = "doc_id long, text string, source string, key string, rank int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n):
    return " ".join(RNG.choice(VOCAB, n))


@pytest.fixture(scope="module")
def corpus():
    base, passage = prose(120), prose(30)
    rows = [base, base, base.replace(base.split()[5], "zz"), None, "", "   ", "one", "one", prose(20000)]
    rows += [f"{prose(40)} {passage} {prose(40)}" for _ in range(12)] + [prose(60) for _ in range(20)]
    texts = [(i, t, f"s{i % 3}" if i % 7 else None, "k", 1) for i, t in enumerate(rows)]
    return [*texts, (None, base, None, None, None), (5, prose(30), "s1", "k", 2)]


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC)


def test_packing_covers_each_id_once(docs, spark, corpus):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == 2048 or at & (at - 1) == 0
    for i, text, *_ in corpus:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        if i not in (None, 5):
            pieces = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i)
            assert sum(p[1] for p in pieces) == len(ids)
            assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in pieces)
    assert packing.pack(docs.limit(0), path).count() == 0


def test_packing_takes_added_tokens(spark):
    from tokenizers import Tokenizer

    path, end = queries.tokenizer_path(), "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end} x  {end}\n\n{end}", f"  {end}  word<|endof {end[:-1]}", f"{prose(3000)} {end} {prose(20)}", "plain"]
    tok = Tokenizer.from_file(path)
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    for i, text in enumerate(texts):
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [1], "<u4")
        assert (50256 in ids) == (end in text)
        pieces = [r for r in got if r.doc_id == i]
        assert all(r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)
        assert sum(r.length for r in pieces) == len(ids)


def test_packing_follows_bm25():
    """The seed's unused neighbours by falling BM25 score, until its window is full; then the cut document is the seed."""
    docs = [RNG.choice(40, int(n), p=np.arange(40, 0, -1) / 820) + 1 for n in RNG.integers(5, 60, 30)]
    n, mean = len(docs), np.mean([len(d) for d in docs])

    def bm25(q, d):
        out = 0.0
        for t in set(docs[q].tolist()):
            df, tf = sum(t in x for x in docs), (docs[d] == t).sum()
            if tf:
                out += np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))
        return out

    got = packing.order_of(docs, 100)
    assert sorted(got) == list(range(n))
    at, seed = 0, None
    for k, i in enumerate(got):
        left = got[k:]
        if at % 100 == 0:
            assert i == min(left)
            seed = i
        else:
            assert bm25(seed, i) == pytest.approx(max(bm25(seed, j) for j in left))
        end = at + len(docs[i])
        if end // 100 > at // 100:
            seed = i
        at = end


def test_like_documents_share_a_key():
    base = RNG.integers(0, 50000, 400)
    near = [np.where(RNG.random(400) < 0.02, RNG.integers(0, 50000, 400), base) for _ in range(50)]
    key = packing.lexical_key(base, 50000)
    assert np.mean([packing.lexical_key(x, 50000) == key for x in near]) > 0.8
    assert len({packing.lexical_key(RNG.integers(0, 50000, 400), 50000) for _ in range(50)}) > 40


def test_warc_round_trip(spark):
    big = "x" * 1500
    rows = [(1, "http://a.b/c", big), (2, None, big), (3, "http://[bad", None), (4, "u", "s"), (None, "u", big), (6, "http://A.b:80/C?q#f", "é" * 600)]
    got = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got} == {(1, 1500, "revisit", 2), (2, 1500, "response", None), (3, 0, "response", None), (4, 1, "response", None), (None, 1500, "revisit", 2), (6, 1200, "response", None)}
    assert {r.payload_digest for r in got if r.page_id == 6} == {hashlib.sha1(("é" * 600).encode()).hexdigest()}
    assert warc.url_key("http://www.A.b:8080/X?q#f") == "b,a,www:8080)/x?q"
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (1, 1, "assistant", "<\\|a<|b\n<|im_end|>\n"), (2, 0, "a\n\\n<|im_start|>", None), (3, None, None, "plain"), (3, 1, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_conversations(turns).withColumn("loss", chat.loss_texts(F.col("formatted"), F.col("spans"))).collect()}
    for k in (1, 2, 3):
        assert [(t.role, t.text) for t in out[k].turns] == [(r[2] or "", r[3] or "") for r in rows if r[0] == k]
    assert out[1].loss == [rows[1][3]] and out[1].escaped and not out[3].escaped
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_rules_statistics_and_learning(docs, spark, corpus):
    got = rules.text_statistics(docs.where("doc_id is not null")).collect()
    for r in got:
        w = WORD.findall(r.text or "")
        seen = {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        cover = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(cover))
    many = [(i, prose(80) if i % 4 else " ".join(x + "###" for x in prose(80).split()), None, None, None) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)] + [(None, 1), (7, None)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in rules.judged(spark.createDataFrame(many, DOC), labels).collect()}
    assert all(kept[i] == (i % 4 != 0) for i in kept)
    good = rules.good_documents(docs, labels.limit(0))
    assert good.columns == docs.columns and good.count() == sum(len(WORD.findall(t or "")) >= 50 for _, t, *_ in corpus)


def test_classifiers(spark):
    rows = [(i, prose(30) + ". " + ("you vile scab. " if i % 5 == 0 else "") + prose(30) + (" $$$" * 9 if i % 3 == 0 else ""), None, None, None) for i in range(400)]
    rows += [(1000, None, None, None, None), (1001, "", None, None, None)]
    docs = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, int(i % 5 == 0), int(i % 3 != 0)) for i in range(300)], "doc_id long, toxic int, quality int")
    tox = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all((tox[i].score >= 0.5) == (i % 5 == 0) for i in range(300, 400))
    for i in range(300, 400):  # the offending sentence of each toxic document, and no other
        assert ["scab" in rows[i][1][s.start : s.end] for s in tox[i].sentences] == [True] * (i % 5 == 0)
    assert tox[1000].score == tox[1001].score == 0 and not tox[1000].sentences
    good = {r.doc_id: r.score for r in nbsvm.score(docs, nbsvm.train(docs, labels)).collect()}
    assert all((good[i] >= 0.7) == (i % 3 != 0) for i in range(300, 400)) and 0 <= good[1000] <= 1
    assert toxicity.train(docs, labels.limit(0)) is None and nbsvm.train(docs, labels.limit(0)) is None


def links_by_force(x):
    """Links and component names of the rows of x."""
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    name = np.arange(len(x))
    while True:
        new = np.minimum(name, np.where(link, name[None, :], 10**6).min(1))
        if (new == name).all():
            return link.sum(1), name
        name = new


def vectors(spark, x, more=(), kind="double"):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + list(more)
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


@pytest.mark.parametrize(("blocks", "kind"), [((1 << 15, 1 << 16), "double"), ((16, 8), "double"), ((1 << 15, 16), "float")])
def test_vectors_against_brute_force(spark, monkeypatch, blocks, kind):
    """Also with groups split into small parts."""
    monkeypatch.setattr(multiindex, "INDEX_BLOCK", blocks[0])
    monkeypatch.setattr(multiindex, "QUERY_BLOCK", blocks[1])
    x = RNG.normal(size=(300, 16)).astype(np.float32).astype(float)
    x[1:40] = (x[0] + 0.02 * RNG.normal(size=(39, 16))).astype(np.float32)
    x[100:110] = x[50]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0]), (904, [None] + [1.0] * 15), (905, []), (None, [1.0] * 16), (7, [float(v) for v in x[7]])]
    got = {r.vec_id: r for r in multiindex.near_vectors(vectors(spark, x, odd, kind).withColumn("same", F.lit(1))).collect()}
    links, name = links_by_force(x)
    assert all((got[i].n_links, got[i].component_id) == (links[i], name[i]) for i in range(300))
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904, 905)) and not got[None].kept
    assert multiindex.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    assert [tuple(r) for r in multiindex.near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()] == [(1, 0, 1, True)]


def test_vectors_of_each_length(spark):
    """Each length is compared in itself, beside null and repeated ids; against brute force."""
    sets = {n: RNG.normal(size=(40, n)) for n in (1, 2, 3, 16)}
    rows, want = [], {}
    for k, (n, x) in enumerate(sets.items()):
        x[1:6] = x[0] * 2 + 0.001
        links, name = links_by_force(x)
        rows += [(1000 * k + i, [float(v) for v in r]) for i, r in enumerate(x)]
        want |= {1000 * k + i: (links[i], 1000 * k + name[i]) for i in range(40)}
    rows += [(9000, [1.0] * 7), (None, rows[0][1]), (None, [1.0, 2.0]), rows[50], (9001, [0.0, 0.0]), (9002, [0.0, 0.0])]
    want |= {9000: (0, 9000), 9001: (0, 9001), 9002: (0, 9002)}
    got = [r for r in multiindex.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() if r.vec_id is not None]
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and len(got) == len(rows) - 2


def test_an_id_with_two_vectors(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(1, a), (2, b), (5, a), (5, b), (9, [0.0, 0.0, 1.0, 0.0])]
    got = {r.vec_id: r.component_id for r in multiindex.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 9: 9}


def test_vectors_far_out_in_the_traversal(spark, monkeypatch):
    """A wide hot group is split over most of 1,225 cells: its links lie beyond the 512th cell."""
    monkeypatch.setattr(multiindex, "CELL", 1)
    rng = np.random.Generator(np.random.PCG64(5))
    x = rng.normal(size=(1200, 64))
    x[:900] = x[0] + 0.17 * rng.normal(size=(900, 64))
    got = {r.vec_id: r.n_links for r in multiindex.near_vectors(vectors(spark, x)).collect()}
    want = links_by_force(x)[0]
    assert want[:900].min() > 800
    assert np.mean([got[i] >= 0.999 * want[i] for i in range(1200)]) > 0.99


def test_probes_without_links_take_turned_copies():
    x = RNG.normal(size=(50, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert (x * multiindex.turned(x, 0.95)).sum(1) == pytest.approx(0.95)


def test_minhash_against_brute_force(docs, corpus):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs.where("not (doc_id <=> 5)"), 4, 80).collect()}
    sets = {}
    for i, t, *_ in corpus:
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} or ({tuple(w)} if w else set())
    ids = [i for i in sets if i not in (None, 5)]
    name = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    name[a] = name[b] = min(name[a], name[b])
    assert all((got[i].component_id, got[i].n_shingles) == (name[i], len(sets[i])) for i in ids)
    assert got[None].component_id is None and not got[None].kept
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_substrings_against_brute_force(docs, corpus):
    rows = [r for r in corpus if r[0] != 5]
    one = docs.where("not (doc_id <=> 5)")
    got = {r.doc_id: r for r in substrings.removed_passages(one).collect()}
    texts = {r.doc_id: r.text for r in substrings.without_repeats(one).collect()}
    words = {i: WORD.findall(t or "") for i, t, *_ in rows}
    least = {}
    for i, w in words.items():
        for j in range(len(w) - 12) if i is not None else ():
            least.setdefault(tuple(w[j : j + 13]), i)
    for i, w in words.items():
        gone = {j + k for j in range(len(w) - 12) if i is not None and least[tuple(w[j : j + 13])] < i for k in range(13)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
        assert WORD.findall(texts[i] or "") == kept
    assert substrings.without_repeats(docs).columns == docs.columns and substrings.removed_passages(docs.limit(0)).count() == 0


@pytest.mark.parametrize("ratio", [1, 17, 300])
def test_hot_anchors_give_the_same(docs, monkeypatch, ratio):
    """Anchors that count as shared by too many go by prefixes of 9, 11 and 13 words of each suffix."""
    one = docs.where("not (doc_id <=> 5)")
    want = sorted((r.doc_id or -1, r.kept_sha256) for r in substrings.removed_passages(one).collect())
    monkeypatch.setattr(substrings, "_meet", lambda hot, meet=substrings._meet: meet(0))
    monkeypatch.setattr(substrings, "_send_suffixes", lambda g, w, p, limit, hot, send=substrings._send_suffixes: send(g, w, p, 0.5 / ratio, hot))
    assert sorted((r.doc_id or -1, r.kept_sha256) for r in substrings.removed_passages(one).collect()) == want


def test_subtrees_give_maximal_repeats():
    """A 16-word repeat around an anchor is one repeat of 16 words, not four windows."""
    words = RNG.integers(1, 2**62, (2, 40), dtype=np.uint64)
    words[1, 8:24] = words[0, 10:26]  # the repeat: from 3 words before the anchor to 6 behind it
    pos = np.array([13, 11])
    record = {"h": np.array([5, 5], np.uint64), "left": np.stack([[words[i, p - j] for j in range(1, 7)] for i, p in enumerate(pos)]), "right": np.stack([words[i, p + 7 : p + 13] for i, p in enumerate(pos)]), "lo": np.array([6, 6]), "hi": np.array([6, 6])}
    assert [x.tolist() for x in substrings.subtrees(record, np.array([1, 2]), 13, 7)] == [[1], [3], [16]]


def test_mixing(docs, corpus):
    got = mixing.mixture(docs).collect()
    again = mixing.mixture(docs.repartition(3)).collect()
    assert len(got) == len(corpus) and sorted(map(str, got)) == sorted(map(str, again))
    total = sum(r.size for r in got)
    by = {r.source: r for r in got}
    assert sum(r.target for r in by.values()) == pytest.approx(total)
    for s, r in by.items():
        mine = [x for x in got if x.source == s]
        assert abs(sum(x.size * x.copies for x in mine) - r.target) <= max(x.size for x in mine) and max(x.copies for x in mine) <= 3
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mixture(docs.limit(0)).count() == 0
