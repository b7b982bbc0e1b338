"""Scalar expressions shared by the jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def rounded(c: Column, places: int = 10) -> Column:
    return F.round(c, places)


def fold_bases(c: Column) -> Column:
    """Upper-case a, c, g, t; every other character stays, and counts as N in codes."""
    return F.translate(c, "acgt", "ACGT")


def base_code(c: Column) -> Column:
    """0..3 for A, C, G, T (one character), null otherwise."""
    return F.when(c.rlike("^[ACGT]$"), F.translate(c, BASES, "0123").cast("int"))


def kmer_code(word: Column, k: int) -> Column:
    """Base-4 code of a k-letter word, 4^k when it is shorter or has a letter other than A, C, G, T."""
    digits = F.translate(word, BASES, "0123")
    return F.when(word.rlike(f"^[ACGT]{{{k}}}$"), F.conv(digits, 4, 10).cast("long")).otherwise(F.lit(4**k).cast("long"))


def kmer_label(code: Column, k: int) -> Column:
    """The word of a code; 'N/edge' for 4^k."""
    return F.when(code == 4**k, "N/edge").otherwise(F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", BASES))


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGTacgt", "TGCAtgca"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def log_loss(score: Column, y: Column) -> Column:
    """Of a log-odds score."""
    return softplus(score) - y * score


def log2_ratio(a: Column, b: Column, pseudo: float = 1.0) -> Column:
    return F.log2((a + pseudo) / (b + pseudo))


def bin_code(x: Column, edges: list[float], missing: int | None = None) -> Column:
    """Right-open bins: how many edges are <= x; a code of its own for null and NaN."""
    inside = reduce(lambda a, b: a + b, (F.when(x >= e, 1).otherwise(0) for e in edges))
    return F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(len(edges) + 1 if missing is None else missing)).otherwise(inside)


def bin_code_closed(x: Column, edges: list[float]) -> Column:
    """Right-closed bins: how many edges are < x; null stays null."""
    inside = reduce(lambda a, b: a + b, (F.when(x > e, 1).otherwise(0) for e in edges))
    return F.when(x.isNotNull(), inside)


def observed_expected(left: Column, right: Column, pair: Column, valid: Column) -> Column:
    """pair * valid / (left * right), null when the product is 0."""
    return F.when(left * right > 0, pair * valid / (left * right))


def entropy(counts: list[Column]) -> Column:
    """Shannon entropy in bits of counts; null when all are 0."""
    total = reduce(lambda a, b: a + b, counts)
    part = lambda c: F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0)
    return F.when(total > 0, reduce(lambda a, b: a + b, map(part, counts)))


def letter_count(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def log_gamma(x: Column, shift: int = 10) -> Column:
    """ln of the gamma function for x > 0: Stirling's series at x + shift, less the logarithm of the factors between."""
    z = x + shift
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    factors = reduce(lambda a, b: a + b, (F.ln(x + i) for i in range(shift)))
    return (z - 0.5) * F.ln(z) - z + 0.91893853320467274178 + series - factors


def keyed_hash(key: Column | str, salt: str) -> Column:
    """32 hexadecimal digits that a key and a salt give on any engine."""
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", c.cast("string"), F.lit(salt)).cast("binary"))


def keyed_uniform(key: Column | str, salt: str) -> Column:
    """A number in [0, 1) of 32 bits from keyed_hash()."""
    return F.conv(F.substring(keyed_hash(key, salt), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def mixed_keys(df, key: str, salt: int, name: str = "mixed"):
    """df with name: the key (a whole number) plus a salt through a 64-bit finalizer of multiplications and shifts, as an unsigned decimal string."""
    import numpy as np
    import pyarrow as pa

    step, one, two = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))

    def run(batches):
        for b in batches:
            x = b.column(b.schema.names.index(key)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(salt) + step
            x = (x ^ (x >> np.uint64(30))) * one
            x = (x ^ (x >> np.uint64(27))) * two
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(str, x ^ (x >> np.uint64(31))), pa.string())], [*b.schema.names, name])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kind}, {name} string")
