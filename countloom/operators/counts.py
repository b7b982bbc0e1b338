"""Population counts of sequence features and what is derived from them.

Windows are never rows: a task counts them in arrays and sends partial counts, at most one a key and word for
each RUN letters, to the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters counted at once; a longer text goes in pieces that overlap by a window less a letter.
RUN = 1 << 18
#: Rows of a batch that are Python objects at once.
ROWS = 64
#: Code of a character among A, C, G and T; 4 for any other.
DIGIT = np.full(128, 4, np.int64)
DIGIT[[ord(c) for c in "ACGT"]] = range(4)
#: For bytes.translate on UTF-8: the digit of a letter in either case, 4 for any other character; bytes inside a character, which go.
LETTERS, MIDDLE = bytes("ACGT".find(chr(x).upper()) if chr(x) in "ACGTacgt" else 4 for x in range(256)), bytes(range(0x80, 0xC0))
#: Places of a table of counts, up to which codes are counted by place; more are sorted.
PLACES = 1 << 21


def _rows(batches):
    """The rows of batches as tuples, a few at a time: a batch of long texts is never a list of strings beside itself."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield from zip(*(c.to_pylist() for c in b.slice(at, ROWS).columns), strict=True)


def _runs(batches, overlap: int):
    """Of batches whose last column is text: (points, owner, starts) of runs of texts: code points, the row in a list of keys
    that each text belongs to, and where each begins; and the keys. Null texts are empty."""
    texts, keys, size = [], [], 0

    def run():
        data = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        return data, np.array([len(x) for x in texts]), list(keys)

    for row in _rows(batches):
        text, at = row[-1] or "", 0
        while at == 0 or at + overlap < len(text):
            texts.append(text[at : at + RUN])
            keys.append(row[:-1])
            size += len(texts[-1])
            at += RUN - overlap
            if size >= RUN:
                yield run()
                texts, keys, size = [], [], 0
    if texts:
        yield run()


def _windows_of(points: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of k letters that lie in one text start, and the number of that text."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    if len(points) < k:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(owner[: len(points) - k + 1] == owner[k - 1 :])
    return at, owner[at]


def _distinct(keys: list) -> tuple[list, np.ndarray]:
    names = list(dict.fromkeys(keys))
    number = {x: i for i, x in enumerate(names)}
    return names, np.array([number[x] for x in keys], np.int64)


def _counted(key: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, code) and their counts; codes are below size."""
    both, n = np.unique(key * size + code, return_counts=True)
    return both // size, both % size, n


def _raw(batches):
    """Batches whose last column is text, with that text as bytes of UTF-8."""
    for b in batches:
        text = b.column(b.num_columns - 1)
        kind = pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary()
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], text.cast(kind)], b.schema.names)


def _digit_runs(batches, overlap: int):
    """The same runs as digits: (digits, lengths, held, owners). held: how many letters a piece repeats of the one before, at most `overlap`."""
    parts, before, keys, size = [], [], [], 0

    def run():
        return np.frombuffer(b"".join(parts), np.int8), np.array([len(x) for x in parts]), list(before), list(keys)

    for row in _rows(_raw(batches)):
        text, held = row[-1] or b"", b""
        for at in range(0, len(text), RUN):
            parts.append(held + text[at : at + RUN].translate(LETTERS, MIDDLE))
            before.append(len(held))
            keys.append(row[:-1])
            held = parts[-1][-overlap:] if overlap else b""
            size += len(parts[-1])
            if size >= RUN:
                yield run()
                parts, before, keys, size = [], [], [], 0
    if parts:
        yield run()


def rolling_codes(digits: np.ndarray, k: int) -> np.ndarray:
    """Base-4 codes of all windows of k letters; 4^k where one of them is no base."""
    m = max(len(digits) - k + 1, 0)
    code, fine = np.zeros(m, np.int32 if k < 16 else np.int64), np.ones(m, bool)
    for j in range(k if m else 0):
        code <<= 2
        code |= digits[j : j + m].astype(np.int8, copy=False) & 3
        fine &= digits[j : j + m] < 4
    code[~fine] = 4**k
    return code


def tally(key: np.ndarray, places: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below `places`, rising, and how often each stands; by place up to `most` places."""
    if places <= most:
        n = np.bincount(key, minlength=1)
        found = np.flatnonzero(n)
        return found, n[found]
    found, n = np.unique(key.astype(np.int32) if places < 1 << 31 else key, return_counts=True)
    return found.astype(np.int64), n


def _window_counts(digits: np.ndarray, lengths: np.ndarray, held: list[int], number: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, code and count of the windows of k letters that lie in one piece and are not all held from the one before."""
    code, size, owners = rolling_codes(digits, k), 4**k + 1, int(number.max(initial=0)) + 1
    places, ends = owners * size, np.cumsum(lengths)
    key = code.astype(np.int32 if places < (1 << 31) - 1 else np.int64, copy=False)
    if owners > 1:
        key += (number * size).astype(key.dtype).repeat(lengths)[: len(key)]
    for j in range(1, k):
        key[(across := ends - j)[(across >= 0) & (across < len(key))]] = places
    for i in np.flatnonzero(held):
        first = ends[i] - lengths[i]
        key[first : first + max(held[i] - k + 1, 0)] = places
    found, n = tally(key, places + 1, PLACES)
    found, n = (x[: len(found) - int(len(found) > 0 and found[-1] == places)] for x in (found, n))
    return found // size, found % size, n


def _schema(df: DataFrame, keys: list[str], more: str) -> str:
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys), more])


def _arrow(df: DataFrame, keys: list[str]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.select(*keys).schema)


def kmer_counts(df: DataFrame, text: str, k: int | tuple[int, ...], keys: list[str]) -> DataFrame:
    """keys, code, n: how often each k-letter window stands in the texts of each key. A, C, G and T in either case give base-4 codes, windows with
    any other letter 4^k. For several sizes in one pass: keys, k, code, n."""
    kinds, sizes = _arrow(df, keys), (k,) if isinstance(k, int) else tuple(k)
    more = [] if isinstance(k, int) else ["k"]

    def run(batches):
        for digits, lengths, held, owners in _digit_runs(batches, max(sizes) - 1):
            names, number = _distinct(owners)
            columns = [pa.array([o[c] for o in names], f.type) for c, f in enumerate(kinds)]
            for size in sizes:
                key, code, n = _window_counts(digits, lengths, held, number, size)
                further = [pa.array([size] * len(key), pa.int32()) for _ in more]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(key)) for c in columns), *further, pa.array(code), pa.array(n)], [*kinds.names, *more, "code", "n"])

    part = df.select(*keys, text).mapInArrow(run, _schema(df, keys, ", ".join([*(f"{x} int" for x in more), "code long, n long"])))
    return part.groupBy(*keys, *more, "code").agg(F.sum("n").alias("n"))


def letter_counts(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, length, a, c, g, t of each text, in either letter case; one pass over the letters. Null texts have a null length."""
    kinds = _arrow(df, keys)

    def run(batches):
        for b in _raw(batches):
            counts, length = np.zeros((b.num_rows, 5), np.int64), []
            for i, (x,) in enumerate(_rows([b.select([b.num_columns - 1])])):
                length.append(None if x is None else 0)
                for at in range(0, len(x or b""), RUN):
                    digits = np.frombuffer(x[at : at + RUN].translate(LETTERS, MIDDLE), np.int8)
                    counts[i] += np.bincount(digits, minlength=5)
                    length[i] += len(digits)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(length, pa.int64()), *(pa.array(counts[:, c]) for c in range(4))], [*kinds.names, "length", "a", "c", "g", "t"])

    return df.select(*keys, text).mapInArrow(run, _schema(df, keys, "length long, a long, c long, g long, t long"))


def word_counts(df: DataFrame, text: str, k: int, keys: list[str]) -> DataFrame:
    """keys, word, n: the same for windows of any characters, as words; k is at most 3."""
    kinds = _arrow(df, keys)

    def run(batches):
        for points, lengths, owners in _runs(batches, k - 1):
            names, number = _distinct(owners)
            at, owner = _windows_of(points, lengths, k)
            code = np.zeros(len(at), np.int64)
            for j in range(k):
                code = (code << 21) | points[at + j]
            words, which = np.unique(code, return_inverse=True)
            key, which, n = _counted(number[owner], which.reshape(-1), max(1, len(words)))
            letters = np.stack([words >> 21 * j & (1 << 21) - 1 for j in range(k - 1, -1, -1)], 1).astype("<u4")
            spelt = [x.tobytes().decode("utf-32-le") for x in letters]
            yield pa.RecordBatch.from_arrays([*(pa.array([names[i][c] for i in key], f.type) for c, f in enumerate(kinds)), pa.array([spelt[i] for i in which], pa.string()), pa.array(n)], [*kinds.names, "word", "n"])

    part = df.select(*keys, text).mapInArrow(run, _schema(df, keys, "word string, n long"))
    return part.groupBy(*keys, "word").agg(F.sum("n").alias("n"))


def reverse_codes(code: np.ndarray, k: int) -> np.ndarray:
    """Codes of the reverse complements; 4^k stays."""
    out, rest = np.zeros_like(code), code.copy()
    for _ in range(k):
        out = out * 4 + (3 - rest % 4)
        rest //= 4
    return np.where(code == 4**k, code, out)


def allowed(spans: list | None, lo: int, hi: int) -> np.ndarray:
    """Which positions from lo to hi lie in one of the half-open spans; all where spans is None."""
    if spans is None:
        return np.ones(hi - lo, bool)
    step = np.zeros(hi - lo + 1, np.int64)
    for x in spans:
        a, b = (min(max(v, lo), hi) - lo for v in (x["start"], x["end"]))
        step[a] += 1
        step[max(a, b)] -= 1
    return step[:-1].cumsum() > 0


def word_places(df: DataFrame, text: str, words: list[str], width: int, keys: list[str]) -> DataFrame:
    """keys, word, bin, n: where the words begin (overlapping ones too), in bins of `width` letters."""
    kinds = _arrow(df, keys)

    def run(batches):
        for b in batches:
            seen: dict = {}
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for w in words:
                    at = (row[-1] or "").find(w)
                    while at >= 0:
                        name = (*row[:-1], w, at // width)
                        seen[name] = seen.get(name, 0) + 1
                        at = row[-1].find(w, at + 1)
            rows = [(*k, n) for k, n in seen.items()]
            types = [*(f.type for f in kinds), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], x) for i, x in enumerate(types)], [*kinds.names, "word", "bin", "n"])

    part = df.select(*keys, text).mapInArrow(run, _schema(df, keys, "word string, bin long, n long"))
    return part.groupBy(*keys, "word", "bin").agg(F.sum("n").alias("n"))


def backoff_scores(table: DataFrame, sizes: tuple[int, ...], strength: float | None = None) -> DataFrame:
    """table (code, total, positive) of words of the largest size with score (positive + s * parent) / (total + s); the parent is the score of
    the word's suffix of the next smaller size, the prevalence for the smallest, and N/edge of N/edge. s = 1 / prevalence unless given."""
    g = table.agg((F.sum("positive") / F.sum("total")).alias("prevalence"))
    s = F.lit(strength) if strength is not None else F.try_divide(F.lit(1.0), F.col("prevalence"))
    most = max(sizes)
    parent = lambda code, k: F.when(code == 4**most, F.lit(4**k)).otherwise(code % 4**k)
    score = None
    for k in sorted(sizes):
        rows = table.groupBy(parent(F.col("code"), k).cast("long").alias("_code")).agg(F.sum("total").alias("total"), F.sum("positive").alias("positive")).crossJoin(F.broadcast(g))
        if score is None:
            rows = rows.withColumn("_parent", F.col("prevalence"))
        else:
            shorter, size = score
            up = F.when(F.col("_code") == 4**k, F.lit(4**size)).otherwise(F.col("_code") % 4**size)
            rows = rows.withColumn("_up", up.cast("long")).join(shorter.select(F.col("_code").alias("_up"), F.col("score").alias("_parent")), "_up")
        score = rows.withColumn("score", (F.col("positive") + s * F.col("_parent")) / (F.col("total") + s)).select("_code", "total", "positive", "score"), k
    return score[0].withColumnRenamed("_code", "code")


def category_table(rows: DataFrame, key: str, y: str) -> DataFrame:
    """key, total, positive, negative, rate, enrichment over the prevalence."""
    t = rows.groupBy(key).agg(F.count("*").cast("long").alias("total"), F.sum(y).cast("long").alias("positive"))
    g = t.agg(F.sum("total").alias("gt"), F.sum("positive").alias("gp"))
    rate = F.col("positive") / F.col("total")
    return t.crossJoin(F.broadcast(g)).select(key, "total", "positive", (F.col("total") - F.col("positive")).alias("negative"), rate.alias("rate"), F.try_divide(rate, F.col("gp") / F.col("gt")).alias("enrichment"))


def smoothed_scores(table: DataFrame, strength: float | None = None) -> DataFrame:
    """table (total, positive) with score (positive + s * prevalence) / (total + s), s = 1 / prevalence unless given."""
    g = table.agg((F.sum("positive") / F.sum("total")).alias("prevalence"))
    s = F.lit(strength) if strength is not None else F.try_divide(F.lit(1.0), F.col("prevalence"))
    return table.crossJoin(F.broadcast(g)).withColumn("score", F.try_divide(F.col("positive") + s * F.col("prevalence"), F.col("total") + s)).drop("prevalence")
