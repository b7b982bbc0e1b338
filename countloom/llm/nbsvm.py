"""Quality classifier: naive Bayes support vectors.

A document's n-grams (words and signs, pairs of them, shapes of words and signs, and pairs of shapes), hashed to BINS
indicators, are scaled by the log ratio of their shares in the two classes; a linear hinge-loss model
is fitted by dual coordinate descent; a logistic curve fitted on rows held out from it turns margins
into scores. All on at most MOST_ROWS labelled documents with at most MOST_GRAMS n-grams together (documented bounds); an n-gram counts that
LEAST_ROWS of them have. Every whole text is scored.

Nulls and odd rows: null and empty texts have no n-gram and get the score of the bare bias; without labels
of both kinds every score is 0.5; rows that repeat a doc_id each get their row; other columns are ignored.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M2, cut, mix
from .labelled import labelled_sample

#: Documents, and their n-grams in all, to learn from; bins; rows that an n-gram must have to count.
MOST_ROWS, MOST_GRAMS, BINS, LEAST_ROWS = 12000, 1 << 25, 1 << 20, 5
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|\n")
#: Characters of text whose n-grams are made at once, and tokens that are remembered.
RUN, REMEMBERED = 1 << 20, 400_000


class Hashes(dict):
    """Of tokens met before: the hash of the token (numbers are one) and, above it, that of its shape: letter case and length class of
    words, the kinds of signs and their number."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        if token[0].isalpha():
            case = "A" if token.isupper() and len(token) > 1 else "Aa" if token[0].isupper() else "a"
            name, shape = token.lower(), case + "1234567"[min(len(token), 25) // 4]
        elif token[0].isdigit():
            name = shape = "9"
        else:
            name, shape = token, "".join(sorted(set(token))) + str(min(len(token), 4))
        out = crc32(name.encode()) | crc32(shape.encode()) << 32
        self[token] = out
        return out


def features(texts: list[str], seen: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(text, bin) of the distinct n-grams of whole texts, sorted."""
    tokens = [TOKEN.findall(t) for t in texts]
    n = np.array([len(t) for t in tokens])
    both = np.fromiter((seen[x] for t in tokens for x in t), np.uint64, int(n.sum()))
    doc = np.repeat(np.arange(len(texts)), n)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    keys = []
    for kind, h in enumerate((both & np.uint64(0xFFFFFFFF), both >> np.uint64(32))):
        salt = np.uint64(2 * kind + 1)
        for at, code in ((doc, mix(h + (salt << np.uint64(33)))), (doc[pair], mix(h[pair] * M2 + h[pair + 1] + (salt << np.uint64(34))))):
            keys.append(at * BINS + (code % np.uint64(BINS)).astype(np.int64))
    found = np.unique(np.concatenate(keys))
    return found // BINS, found % BINS


def runs(texts: list):
    """Consecutive parts of texts of about RUN characters; null texts are empty."""
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= RUN:
            yield part
            part, size = [], 0
    if part:
        yield part


def _rows(batches):
    seen = Hashes()
    for b in batches:
        out = []
        for part in runs(b.column(2).to_pylist()):
            doc, bins = features(part, seen)
            edges = np.searchsorted(doc, np.arange(len(part) + 1))
            out += [bins[lo:hi].astype(np.int32).tobytes() for lo, hi in zip(edges, edges[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())], ["k", "y", "n", "x"])


def log_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    p, q = (np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t == k] or [np.empty(0, np.int64)]), minlength=BINS) for k in (1, 0))
    seen = p + q >= LEAST_ROWS
    a, b = (p + 1) / ((y == 1).sum() + 2), (q + 1) / ((y == 0).sum() + 2)
    return np.where(seen, np.log(a / b), 0.0)


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights (the last is the bias) of min |w|^2 / 2 + cost * sum of hinge losses, classes weighed equally, one dual variable at a time."""
    w, alpha = np.zeros(BINS + 1), np.zeros(len(y))
    x = [ratio[r] / max(1e-9, np.sqrt((ratio[r] ** 2).sum())) for r in rows]
    bound = np.where(y == 1, cost * len(y) / (2 * max(1, (y == 1).sum())), cost * len(y) / (2 * max(1, (y == 0).sum())))
    square = np.array([(v * v).sum() + 1 for v in x])
    sign, turn = np.where(y == 1, 1.0, -1.0), np.random.Generator(np.random.PCG64(5))
    for _ in range(rounds):
        for i in turn.permutation(len(y)):
            g = sign[i] * (w[rows[i]] @ x[i] + w[-1]) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), bound[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[rows[i]] += step * x[i]
                w[-1] += step
                alpha[i] = new
    return w


def margins(rows: list[np.ndarray], ratio: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.array([(w[r] @ ratio[r]) / max(1e-9, np.sqrt((ratio[r] ** 2).sum())) + w[-1] for r in rows])


def calibrate(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to labels, by Newton steps with a little shrinkage."""
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * m + c)))
        h, r = p * (1 - p), y - p
        grad = np.array([(r * m).sum() - 1e-2 * a, r.sum()])
        hess = np.array([[(h * m * m).sum() + 1e-2, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, c = a + step[0], c + step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(c)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_ROWS, grams: int = MOST_GRAMS):
    """(scaled weights as one array with the bias last, ratio, slope, shift), or None. Of the sample's documents, by the hash of their ids, those are learned from whose n-grams
    together are at most `grams`; the driver holds these and no more."""
    rows = labelled_sample(docs, labels, label, most).select("y", "text", F.xxhash64("doc_id").alias("k")).repartition("k").select("k", "y", "text").mapInArrow(_rows, "k long, y int, n long, x binary")
    rows = cut(rows, "grams")
    sizes = rows.select("k", "n").orderBy("k").toArrow()  # a row a document of the sample
    whole = np.cumsum(sizes["n"].to_numpy())
    fits = int(np.searchsorted(whole, grams, "right")) - 1
    if fits < len(whole) - 1:
        rows = rows.where(F.col("k") <= sizes["k"][max(fits, 0)].as_py())
    found = rows.select("y", "x").toArrow()
    found = sorted(zip(found["y"].to_pylist(), found["x"].to_pylist(), strict=True))
    y, rows = np.array([r[0] for r in found]), [np.frombuffer(r[1], np.int32) for r in found]
    if len(set(y.tolist())) < 2:
        return None
    held = np.arange(len(y)) % 4 == 3
    part = [[r for r, h in zip(rows, held, strict=True) if h == k] for k in (False, True)]
    ratio = log_ratio(part[0], y[~held])
    w = dual_descent(part[0], y[~held], ratio)
    slope, shift = calibrate(margins(part[1], ratio, w), y[held])
    return w.astype(np.float32), ratio.astype(np.float32), slope, shift


def _score(sent):
    def run(batches):
        seen = Hashes()
        if sent is not None:
            product, square, bias, slope, shift = sent.value
        for b in batches:
            out = [np.full(b.num_rows, 0.5)] if sent is None else []
            for part in runs(b.column(1).to_pylist()) if sent is not None else ():
                doc, bins = features(part, seen)
                dot, size = (np.bincount(doc, x[bins], len(part)) for x in (product, square))
                z = slope * (dot / np.maximum(1e-9, np.sqrt(size)) + bias) + shift
                out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id and score (near 1: good)."""
    sent = None
    if model is not None:
        w, ratio, slope, shift = model
        sent = docs.sparkSession.sparkContext.broadcast((w[:-1] * ratio, ratio * ratio, float(w[-1]), slope, shift))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_score(sent), "doc_id long, score double")
