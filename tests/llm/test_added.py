"""Operators 11 to 13 and odd texts of the first: against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from countloom.llm import alignment, nbsvm, packing, pii, prefixes, queries, rules, toxicity


def test_packing_of_long_white_space(spark):
    """Texts on which the fast library's pattern search gives up."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    texts = ["a" + " " * 1_500_000 + "b", "\n" * 1_200_000, "x " + " \n" * 800_000 + "<|endoftext|>"]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    for i, text in enumerate(texts):
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [1], "<u4")
        pieces = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i)
        assert sum(p[1] for p in pieces) == len(ids)
        assert all(packing.zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in pieces)


def plain_alignment(texts):
    """op12's rows by loops over tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.pieces_path())
    value, token = packing.byte_values(), {i: k for k, i in tok.get_vocab().items()}
    a_bytes = lambda i: bytes(value[c] for c in token[i])
    b_bytes = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    counts, found = collections.Counter(), []
    for text in texts:
        a, b = tok.encode(" " + (text or ""), add_special_tokens=False).ids, sp.encode(text or "")
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            found.append(None)
            continue
        a_end, b_end = (np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((a_bytes, a), (b_bytes, b)))
        links = [(p, q) for k, p in enumerate(a) for n, q in enumerate(b) if max(a_end[k] - len(a_bytes(p)), b_end[n] - len(b_bytes(q))) < min(a_end[k], b_end[n])] if len(a) < 3000 else None
        groups, edge = [], 0
        for stop in sorted(set(a_end) & set(b_end)):
            part = lambda ids, end: ",".join(str(i) for i, e in zip(ids, end, strict=True) if edge < e <= stop)  # noqa: B023, E731
            groups.append(f"{part(a, a_end)}|{part(b, b_end)}")
            edge = stop
        counts.update(links)
        found.append((len(a), len(b), links, groups))
    top = collections.Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    zero = (0, 0, 0, 0, 0, 0, "")
    return [zero if f is None else (f[0], f[1], len(f[3]), len(f[2]), sum(counts[k] == top[k[1]] for k in f[2]), sum(counts[k] for k in f[2]), hashlib.sha256(";".join(f[3]).encode()).hexdigest()) for f in found]


@pytest.mark.parametrize(("most", "lane"), [(1 << 20, 512), (40, 8), (0, 64)])
def test_alignment_against_loops(spark, monkeypatch, most, lane):
    """Also with few pairs sent to all tasks and with documents in many stretches."""
    rng = random.Random(5)
    words = ["the", "Straße", "naïve", "日本語", "über", "don't", "12345", "x_y", "<|endoftext|>", "<s>", "𝒳", "\t", "\n\n", "  ", "ﬁ", "zzzzzzzz"]
    texts = [" ".join(rng.choices(words, k=n)) for n in (1, 3, 20, 60, 300)] + [None, "", " ", "  a ", "a▁b", "\x00\x01", "é" * 400, "the the", "the the"]
    rows = [(i if i != 3 else None, t, 1) for i, t in enumerate(texts)] + [(4, texts[4], 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int")
    monkeypatch.setattr(alignment.lockstep, "__defaults__", (lane,))
    got = alignment.aligned(docs, queries.tokenizer_path(), queries.pieces_path(), most).collect()
    want = plain_alignment([r[1] for r in rows])
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((r[0], *w)) for r, w in zip(rows, want, strict=True))
    assert alignment.aligned(docs.limit(0), queries.tokenizer_path(), queries.pieces_path()).count() == 0


def test_alignment_in_stretches_is_the_same():
    rng = np.random.Generator(np.random.PCG64(1))
    total = 4000
    ends = [[np.unique(np.append(rng.integers(1, total, n), total)) for n in (900, 1100)] for _ in range(5)]
    side = [alignment.Tokens(np.concatenate([np.zeros(len(e[k]), int) for e in ends]), np.concatenate([e[k] for e in ends]), np.cumsum([0] + [len(e[k]) for e in ends])) for k in (0, 1)]
    whole, parts = alignment.lockstep(*side, 10**9), alignment.lockstep(*side, 16)
    assert len(alignment.stretches(*side, 16)) > 100 and all((x == y).all() for x, y in zip(whole, parts, strict=True))


def plain_spans(text):
    out = []
    for kind, pattern in pii.BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1])) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]
            out += [(m.start(), kind, m.end())] * ok
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[1])))


def test_base_spans_against_patterns():
    rng = random.Random(2)
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 70))) for alphabet in ("ab@@..--+12 ()é\n", "0123456789.. -", "a@.-+9 ", "45 -+.()@x://") for _ in range(4000)]
    texts += ["4111 1111 1111 1111", "4111111111111112", "1.2.3.256.5.6.7.8.9", "001.002.003.0004", "+1 (555) 555-7713 -", "a@b.c@d.e", "é@a.b", "x@" * 5 + "y.z", "@" * 2000, "1." * 2000, "1 " * 2000, "+1" * 2000, "://" * 1000]
    assert all([s for s in pii.find(t) if s[1] in pii.BASE] == plain_spans(t) for t in texts)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("to josé@exämple.de now", "address", "josé@exämple.de"),
        ("see https://bob:pw@host.example:80/x", "address", "https://bob:pw@host.example:80"),
        ("see https://host.example/x@y", "address", None),
        ("IBAN: DE89 3704 0044 0532 0130 00, and", "account", "DE89 3704 0044 0532 0130 00"),
        ("IBAN: DE88 3704 0044 0532 0130 00, and", "account", None),
        ("SSN 123-45-6789", "account", "123-45-6789"),
        ("SSN 900-45-6789", "account", None),
        ('token = "269b1cea0846965f2d3ecb5c"', "account", "269b1cea0846965f2d3ecb5c"),
        ("a token of appreciation, internationally", "account", None),
        ("Account no. 12345678", "account", "12345678"),
        ("accounts of 12345678", "account", None),
    ],
)
def test_added_spans(text, kind, found):
    assert [text[s:e] for s, k, e in pii.find(text) if k == kind] == ([found] if found else [])


def test_personal_data_rows(spark):
    rows = [(1, "mail a@b.c or d@e.f, 1.2.3.4", 5), (1, None, None), (None, "", 1), (2, "日本 a@b.c", 2), (3, "a" * 5_000 + "@b.c " + "1" * 5_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = pii.personal_data(docs).collect()
    assert [(r.doc_id, [(s.kind, s.start, s.stop) for s in r.spans]) for r in got] == [(r[0], [(k, s, e) for s, k, e in plain_spans(r[1] or "")]) for r in rows]
    hidden = pii.masked(docs)
    assert hidden.columns == docs.columns and [r.text for r in hidden.limit(4).collect()] == ["mail <email> or <email>, <ip>", None, "", "日本 <email>"]
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_personal_data_digest(spark, tmp_path):
    texts = ["mail a@b.c or +1 (555) 555-7713", None, "token = abcdef0123456789abcdef"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op13_personal_data(spark, str(tmp_path)).collect():
        base = plain_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, x, _ in base) for k in pii.BASE]
        assert r.spans == ",".join(f"{k}:{s}:{e}" for s, k, e in pii.find(texts[r.doc_id] or ""))


def plain_trie(rows):
    """op11's rows by dictionaries of whole prefixes. rows: conv_id, turn, role, text, without ties."""
    own = collections.defaultdict(list)
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((r or "", x or ""))
    paths = {c: tuple(own.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + turns[h:]) for c, turns in own.items()}
    members = collections.defaultdict(list)
    for c, path in sorted(paths.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = []
    for node, convs in members.items():
        below = [p for p in members if p[: len(node)] == node]
        children = [p for p in below if len(p) == len(node) + 1]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * words(p) for p in below)
        ends = ",".join(str(c) for c in convs if paths[c] == node)
        out.append((convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("long", "hot", "block"), [(1 << 12, 512, 4), (8, 2, 4), (4, 10**6, 2)])
def test_trie_against_dictionaries(spark, monkeypatch, long, hot, block):
    """Also with parts of long conversations, hot keys and narrow blocks."""
    from countloom.llm import common

    rng = random.Random(9)
    monkeypatch.setattr(prefixes, "LONG", long)
    monkeypatch.setattr(common, "MOST_OF_A_KEY", hot)
    rows = []
    for c in range(60):
        first = [("user", "hello there you"), ("assistant", "good day")] if c % 3 else [("user", rng.choice("abc"))]
        more = [(rng.choice(["user", None]), rng.choice([None, "", "x y", "z"])) for _ in range(rng.choice([0, 0, 1, 2, 7, 9]))]
        rows += [(c * 7 if c % 2 else c, t if t else None, *turn) for t, turn in enumerate(first + more)]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    rows += [(5000, t, "user", "same") for t in range(50)] + [(5001, t, "user", "same") for t in range(49)] + [(None, 0, "user", "nobody")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    got = prefixes.prefix_trie(*prefixes.rebuilt(*prefixes.numbered(turns)), block).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows)


def test_trie_of_odd_rows(spark):
    """Repeated rows count each; a conversation may be left without turns; an empty table has no nodes."""
    schema = "conv_id long, turn long, role string, text string"
    trie = lambda rows: prefixes.prefix_trie(*prefixes.rebuilt(*prefixes.numbered(spark.createDataFrame(rows, schema))))
    assert trie([]).count() == 0
    alone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    got = [tuple(r)[:7] for r in trie([(alone, 0, "user", "gone")]).collect()]
    assert got == [(alone, 0, None, 1, 0, 1, 0)]
    twice = sorted(tuple(r)[:7] for r in trie([(20, 1, "user", "a b"), (20, 1, "user", "a b")]).collect())
    assert twice == [(20, 0, None, 1, 1, 1, 0), (20, 1, 20, 1, 1, 1, 0), (20, 2, 20, 1, 0, 1, 0)]


def test_noisy_or_fit_is_stationary():
    """The fitted weights against the likelihood written out by documents: its differences vanish there, and other weights are no likelier."""
    rng = np.random.default_rng(4)
    n = rng.integers(1, 5, 60)
    hits = [[sorted(set(rng.integers(0, 4, rng.integers(1, 3)).tolist())) for _ in range(rng.integers(0, k + 1))] for k in n]
    y = np.array([int(any(0 in s for s in h) if rng.random() < 0.85 else rng.random() < 0.3) for h in hits])
    l2 = 1e-2

    def likelihood(theta):
        total = 0.0
        for label, k, h in zip(y, n, hits, strict=True):
            none = 1.0
            for s in [*h, *[[]] * (k - len(h))]:
                none *= 1 - 1 / (1 + np.exp(-(theta[0] + sum(theta[1 + w] for w in s))))
            total += np.log(1 - none if label else none)
        return total / len(y) - l2 / 2 * (theta[1:] ** 2).sum()

    bias, weights = toxicity.noisy_or_fit(y, n.astype(float), hits, 4, steps=4000, rate=0.02, l2=l2)
    best = np.concatenate([[bias], weights])
    for i in range(5):
        step = np.eye(5)[i] * 1e-4
        assert abs(likelihood(best + step) - likelihood(best - step)) / 2e-4 < 2e-3
    assert all(likelihood(best) >= likelihood(best + rng.normal(0, 0.5, 5)) for _ in range(100))


def test_dual_descent_reaches_the_optimum():
    """The hinge objective of its weights against that of a plain solver of the dual, which the duality gap proves optimal."""
    rng = np.random.default_rng(6)
    rows = [np.unique(rng.integers(0, 12, 5)) for _ in range(40)]
    y = np.array([int(3 in r) if rng.random() < 0.8 else int(rng.random() < 0.5) for r in rows])
    ratio = np.zeros(nbsvm.BINS)
    ratio[:12] = rng.normal(0, 1, 12)
    x = np.zeros((40, 13))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
    x[:, 12], sign = 1, np.where(y == 1, 1.0, -1.0)
    bound = np.where(y == 1, 40 / (2 * (y == 1).sum()), 40 / (2 * (y == 0).sum()))
    gram, alpha = (x * sign[:, None]) @ (x * sign[:, None]).T, np.zeros(40)
    for _ in range(20_000):  # projected gradient
        alpha = np.clip(alpha - (gram @ alpha - 1) / np.linalg.norm(gram, 2), 0, bound)
    primal = lambda w: w @ w / 2 + (bound * np.maximum(0, 1 - sign * (x @ w))).sum()
    plain = (alpha * sign) @ x
    assert primal(plain) - (alpha.sum() - plain @ plain / 2) < 1e-6
    w = nbsvm.dual_descent(rows, y, ratio, rounds=400)
    assert primal(np.append(w[:12], w[-1])) == pytest.approx(primal(plain), rel=1e-4)


def test_quality_learns_from_a_bounded_number_of_ngrams(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=30)) + (" zap!!" * 5 if i % 2 else ""), i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    whole, part = nbsvm.train(docs, labels), nbsvm.train(docs, labels, grams=2000)
    again = nbsvm.train(docs.repartition(3), labels, grams=2000)
    assert (part[0] == again[0]).all() and (whole[0] != part[0]).any()
    for model in (whole, part):
        assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in nbsvm.score(docs, model).collect())


def plain_list(rows, most_rules=10, most_conditions=3, precision=0.97, least=5):
    """Sequential covering over rows (good, whether to prune with it, rates) by trying every threshold that a row has."""
    names, out = list(rows[0][2]), []
    holds = lambda rule, v: all(v[c] >= t if op == ">=" else v[c] < t for c, op, t in rule)
    left = list(rows)
    for _ in range(most_rules):
        rule = []
        while len(rule) < most_conditions:
            grow = [r for r in left if not r[1] and holds(rule, r[2])]
            p0, q0 = sum(not r[0] for r in grow), sum(r[0] for r in grow)
            if p0 < least or not q0:
                break
            best = (0.0, None)
            for c in names:
                for t in sorted({r[2][c] for r in rows}):
                    for op in (">=", "<"):
                        part = [r for r in grow if holds([(c, op, t)], r[2])]
                        p = sum(not r[0] for r in part)
                        if p >= least and len(part) < len(grow):
                            gain = p * (np.log2(p / len(part)) - np.log2(p0 / len(grow)))
                            best = (gain, (c, op, t)) if gain > best[0] + 1e-12 else best
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        worth = []
        for k in range(1, len(rule) + 1):
            part = [r for r in left if r[1] and holds(rule[:k], r[2])]
            bad, good = sum(not r[0] for r in part), sum(r[0] for r in part)
            worth.append(((bad - good) / max(1, bad + good), bad, k))
        top = max(w[0] for w in worth)
        value, hits, size = max((w for w in worth if w[0] >= top - 0.005), key=lambda w: w[1])
        if hits < max(1, least // 2) or (value + 1) / 2 < precision:
            break
        out.append(rule[:size])
        left = [r for r in left if not holds(rule[:size], r[2])]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_decision_list_against_exhaustive_search(spark, seed):
    rng = random.Random(seed)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaim"]
    stats, labels, rows = [], [], []
    for i in range(600):
        symbols, exclaim, upper, dup = rng.choice([0, 0, 10, 30, 50]), rng.choice([0, 0, 20, 40]), rng.choice([0, 50, 100]), rng.choice([0, 0, 3])
        bad = symbols >= 30 and exclaim >= 20 or upper == 100 and dup == 3 or rng.random() < 0.01
        stats.append((i, 100, 500, symbols, 10, dup, 0, upper, exclaim))
        labels.append((i, int(not bad)))
        rates = {"r_word_length": 5.0, "r_symbol_rate": symbols / 100, "r_dup_line_rate": dup / 10, "r_repeat_rate": 0.0, "r_upper_rate": upper / 500, "r_exclaim_rate": exclaim / 100, "r_words": 100.0}
        rows.append((int(not bad), zlib.crc32(str(i).encode()) % 3 == 0, rates))
    frame = spark.createDataFrame(stats, ", ".join(f"{c} long" for c in columns))
    got = rules.learn(frame, spark.createDataFrame(labels, "doc_id long, quality int"))
    want = plain_list(rows)
    assert len(want) >= 2 and [[(c, op, pytest.approx(t)) for c, op, t in r] for r in want] == got
    kept = {r.doc_id: r.k for r in frame.select("doc_id", rules.verdict(got, frame).alias("k")).collect()}
    assert all(kept[i] != any(all(v[c] >= t if op == ">=" else v[c] < t for c, op, t in r) for r in want) for i, (_, _, v) in enumerate(rows))
