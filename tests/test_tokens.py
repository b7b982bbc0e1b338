"""Merging by ranks against the plain loop that merges the pair of least rank again and again."""

import random
from collections import Counter

import pytest

from countloom.operators import chunks, counts, merges
from countloom.plans.tokens import MERGES

DRAW = random.Random(6)
TEXTS = {f"c{i}": "".join(DRAW.choice(letters) for _ in range(n)) for i, (n, letters) in enumerate([(1, "A"), (2, "TA"), (50, "ACGTN"), (333, "ACGT"), (97, "A"), (120, "acgtN日"), (64, "TA"), (40, "NNNA")])}


def plain(text, listed):
    tokens = [c if c in "ACGT" else "N" for c in text.translate(str.maketrans("acgt", "ACGT"))]
    rank = {pair: k for k, pair in enumerate(listed)}
    while True:
        best = min((rank[p] for p in zip(tokens, tokens[1:], strict=False) if p in rank), default=None)
        if best is None:
            return tokens
        out, i = [], 0
        while i < len(tokens):
            if tuple(tokens[i : i + 2]) == listed[best]:
                out.append(tokens[i] + tokens[i + 1])
                i += 2
            else:
                out.append(tokens[i])
                i += 1
        tokens = out


@pytest.mark.parametrize("listed", [MERGES, [("A", "A"), ("AA", "AA"), ("AAAA", "A")], [("T", "A"), ("TA", "T"), ("A", "T")], []])
@pytest.mark.parametrize("width", [7, 100, 1 << 17])
def test_tokens_and_their_places(spark, listed, width):
    df = spark.createDataFrame([*TEXTS.items(), ("none", None), ("empty", "")], "contig string, text string")
    pieces = chunks.of_texts(df, "text", ["contig"], 0, width)
    want, pairs, place = Counter(), Counter(), {}
    for c, text in TEXTS.items():
        for core in range(0, len(text), width):
            at, tokens = core, plain(text[core : core + width], listed)
            pairs.update((c, *p) for p in zip(tokens, tokens[1:], strict=False))
            for token in tokens:
                want[c, token] += 1
                place |= {(c, p): (token, at, at + len(token)) for p in range(at, at + len(token))}
                at += len(token)
    assert {(r.contig, r.token): r.n for r in merges.token_counts(pieces, listed, ["contig"]).collect()} == want
    assert {(r.contig, r.first, r.second): r.n for r in merges.pair_counts(pieces, listed, ["contig"]).collect()} == pairs
    sites = [(c, p, i) for i, (c, p) in enumerate(sorted(place)[::3])]
    odd = [("c2", 50, -1), ("c2", -1, -1), ("none", 0, -1), (None, 1, -1), ("c2", None, -1), sites[0]]
    got = merges.tokens_at(pieces, spark.createDataFrame([*sites, *odd], "contig string, pos long, k int"), "contig", listed, width).collect()
    assert sorted((r.contig, r.pos, r.k, r.token, r.token_start, r.token_end) for r in got) == sorted((c, p, k, *place[c, p]) for c, p, k in [*sites, sites[0]])


def test_bad_merges():
    for listed in ([("A", "X")], [("AC", "G")], [("A", "C"), ("A", "C")]):
        with pytest.raises(ValueError, match="merge of"):
            merges.vocabulary(listed)


@pytest.mark.parametrize("run", [5, 1 << 20])
def test_letter_counts(spark, monkeypatch, run):
    monkeypatch.setattr(counts, "RUN", run)
    texts = [*TEXTS.values(), None, "", "é日"]
    got = counts.letter_counts(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "text", ["k"]).collect()
    for r in got:
        t = texts[r.k]
        assert (r.length, [r.a, r.c, r.g, r.t]) == (None if t is None else len(t), [(t or "").upper().count(x) for x in "ACGT"])
    assert len(got) == len(texts)
