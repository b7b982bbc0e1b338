"""Toxicity by multiple-instance learning: only documents have labels, sentences get scores.

A sentence scores sigmoid(bias + weights of its words); a document scores the noisy-or of its sentences,
1 - prod(1 - score). Weights are fitted to the documents' labels by gradient steps on that likelihood,
over at most MOST_ROWS labelled documents (a documented bound). Words with a weight are all those that at least LEAST_DOCS of
them have and that stand out in toxic documents by more standard errors than the largest of as many chance values would;
where none does, a warning says so. Scoring reads every whole text; sentences that score at least 0.5
are located.

Nulls and odd rows: null and empty texts have no sentence and get the empty score, which is 0; without
labels of both kinds every score is 0; rows that repeat a doc_id each get their row; other columns
are ignored.
"""

from __future__ import annotations

import re
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .labelled import labelled_sample

MOST_ROWS, LEAST_DOCS = 20000, 5
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
Weights = tuple[float, dict[str, float]]


def sentence_words(text: str) -> list[set[str]]:
    return [set(WORD.findall(s)) for s in SENTENCE.findall(text.lower())]


def _words(batches):
    for b in batches:
        words, labels = [], []
        for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = sorted(set(WORD.findall(text.lower())))
            words += found
            labels += [y] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(labels, pa.int32())], ["word", "y"])


def _bags(index: dict[str, int]):
    def run(batches):
        for b in batches:
            bags = []
            for text in b.column(1).to_pylist():
                sentences = sentence_words(text)
                bags.append((len(sentences), [sorted(index[w] for w in known) for s in sentences if (known := s & index.keys())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in bags], pa.int64()), pa.array([h for _, h in bags], pa.list_(pa.list_(pa.int32())))], ["y", "n", "hits"])

    return run


def noisy_or_fit(y: np.ndarray, n: np.ndarray, hits: list[list[list[int]]], words: int, steps: int = 600, rate: float = 0.1, l2: float = 1e-5) -> tuple[float, np.ndarray]:
    """Bias and weights that maximise the noisy-or likelihood; sentences without known words share one score."""
    doc = np.repeat(np.arange(len(y)), [len(h) for h in hits])
    sentence = np.repeat(np.arange(len(doc)), [len(s) for h in hits for s in h])
    word = np.array([w for h in hits for s in h for w in s], np.int64)
    rest = n - np.bincount(doc, minlength=len(y))
    theta = np.concatenate([[-5.0], np.zeros(words)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = theta[0] + np.bincount(sentence, theta[1:][word], len(doc))
        log_none = -np.bincount(doc, np.logaddexp(0, z), len(y)) - rest * np.logaddexp(0, theta[0])
        none = np.exp(np.minimum(log_none, -1e-12))
        pull = np.where(y == 1, none / (1 - none), -1.0)  # d log-likelihood / d sum of log-odds, before the sentence's own share
        share, base = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-theta[0]))
        g_sentence = pull[doc] * share
        grad = np.concatenate([[g_sentence.sum() + (pull * rest).sum() * base], np.bincount(word, g_sentence[sentence], words)]) / max(1, len(y))
        grad[1:] -= l2 * theta[1:]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return float(theta[0]), theta[1:]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_ROWS) -> Weights | None:
    sample = labelled_sample(docs, labels, label, most).select("y", "text").repartition("text")
    sample = sample.persist()
    try:
        sizes = dict(sample.groupBy("y").count().collect())
        if not sizes.get(0) or not sizes.get(1):
            return None
        a, b = sizes[1], sizes[0]
        seen = sample.mapInArrow(_words, "word string, y int").groupBy("word").agg(F.sum("y").alias("p"), F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS)
        rate = F.col("n") / (a + b)
        seen = cut(seen.withColumn("z", (F.col("p") / a - (F.col("n") - F.col("p")) / b) / F.sqrt(rate * (1 - rate) * (1 / a + 1 / b) + 1e-12)), "words")
        least = (2 * np.log(max(2, seen.count()))) ** 0.5  # about the largest of so many standard normal values
        top = [r["word"] for r in seen.where(F.col("z") >= least).orderBy("word").select("word").collect()]
        if not top:
            warnings.warn("no word sets toxic documents apart: every sentence gets the same score", stacklevel=2)
        rows = sample.mapInArrow(_bags({w: i for i, w in enumerate(top)}), "y int, n long, hits array<array<int>>").collect()
    finally:
        sample.unpersist()
    bias, weights = noisy_or_fit(np.array([r["y"] for r in rows]), np.array([r["n"] for r in rows], float), [r["hits"] for r in rows], len(top))
    return bias, {w: float(x) for w, x in zip(top, weights, strict=True)}


def _score(model: Weights | None):
    bias, weights = model or (-np.inf, {})

    def run(batches):
        known, base = weights.keys(), float(np.logaddexp(0, bias))
        for b in batches:
            scores, spans = [], []
            for text in b.column(1).to_pylist():
                total, found = base * len(SENTENCE.findall(text or "")), []
                if text and (bias >= 0 or known & set(WORD.findall(text.lower()))):
                    for part in SENTENCE.finditer(text):
                        z = bias + sum(weights[w] for w in known & set(WORD.findall(part[0].lower())))
                        total += float(np.logaddexp(0, z)) - base
                        if z >= 0:
                            found.append({"start": part.start(), "end": part.end(), "score": float(1 / (1 + np.exp(-z)))})
                scores.append(float(-np.expm1(-total)))
                spans.append(found)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "sentences"])

    return run


def score(docs: DataFrame, model: Weights | None) -> DataFrame:
    """doc_id, score, and sentences: start, end (characters of the text) and score of those that score at least 0.5."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_score(model), "doc_id long, score double, sentences array<struct<start:int,end:int,score:double>>")
