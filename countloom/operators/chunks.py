"""Windows of sequences in chunks: a core and a halo of letters on both sides. A long contig is many rows, no task holds one whole, and counts
over cores are those over the contig. Windows are never rows: a task lays chunks side by side, N between them, and counts in arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import lines
from .counts import LETTERS, MIDDLE, _arrow, _distinct, _rows, _schema, allowed, reverse_codes, tally

#: Letters in the core of a chunk.
WIDTH = 1 << 17
#: Letters that a task lays side by side: arrays of so many numbers stay near the processor.
RUN = 1 << 18
#: Places of a table of counts, up to which codes are counted by place; more are sorted.
PLACES = 1 << 21
#: Quotients that are binned at once.
BLOCK = 1 << 14
NAMES = ["core_start", "size", "pad_left", "bases"]


def of_texts(df: DataFrame, text: str, keys: list[str], halo: int, width: int | None = None) -> DataFrame:
    """keys, core_start, size, pad_left, bases: chunks of the texts of df; null and empty texts have none."""
    width = width or WIDTH
    n = F.length(text)
    rows = df.select(*keys, F.col(text).alias("_text"), n.cast("long").alias("_n")).where("_n > 0")
    rows = rows.withColumn("core_start", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {width} * {width}"), F.lit(width).cast("long"))))
    pad = F.least("core_start", F.lit(halo))
    piece = F.substring("_text", (F.col("core_start") - pad + 1).cast("int"), (pad + width + halo).cast("int"))
    bases = F.when(F.col("_n") <= width, F.col("_text")).otherwise(piece)
    return rows.select(*keys, "core_start", F.least(F.lit(width), F.col("_n") - F.col("core_start")).alias("size"), pad.alias("pad_left"), bases.alias("bases"))


def of_lines(rows: DataFrame, halo: int, width: int | None = None) -> DataFrame:
    """The same for sequence lines (contig, start, bases), by contig."""
    out = lines.chunks(rows, width or WIDTH, halo)
    return out.select("contig", "core_start", (F.col("core_end") - F.col("core_start")).alias("size"), "pad_left", "bases")


class Side:
    """Chunks side by side: digits; at (where their core letters are); chunk (whose each of them is); owners (the leading columns of each chunk); starts (each core's first place in its contig).

    Methods with a leading underscore answer for all places but the halo at both ends, by slices; core() takes the core letters out of that."""

    def __init__(self, rows: list, halo: int):
        gap = "N" * halo
        self.digits = np.frombuffer((gap + gap.join(r[-1] for r in rows) + gap).encode().translate(LETTERS, MIDDLE), np.int8)
        length = np.array([len(r[-1]) for r in rows], np.int64)
        size, pad = (np.array([r[c] for r in rows], np.int64) for c in (-3, -2))
        first = halo + np.concatenate([[0], np.cumsum(length + halo)[:-1]]) + pad
        self.edges = np.concatenate([[0], np.cumsum(size)])
        self.chunk = np.repeat(np.arange(len(rows)), size)
        self.at = np.arange(self.edges[-1]) + np.repeat(first - self.edges[:-1], size)
        self.owners, self.starts = [r[:-4] for r in rows], [r[-4] for r in rows]
        self.halo, self.n, self.inner = halo, len(self.digits) - 2 * halo, self.at - halo
        self.sums: dict = {}
        self.found: dict = {}

    def core(self, found: np.ndarray) -> np.ndarray:
        return found[self.inner]

    def words(self, k: int, minus: bool = False) -> np.ndarray:
        """Base-4 codes at the core letters: of the words that end there, or of the reverse complements of those that begin there; 4^k where one holds N or leaves the contig."""
        return self.core(self._words(k, minus)).astype(np.int64)

    def _words(self, k: int, minus: bool = False) -> np.ndarray:
        code, fine = np.zeros(self.n, np.int32 if k < 16 else np.int64), np.ones(self.n, bool)
        for j in range(k - 1, -1, -1):
            first = self.halo + (j if minus else -j)
            d = self.digits[first : first + self.n]
            code <<= 2
            code |= d & 3 ^ 3 if minus else d & 3
            fine &= d < 4
        code[~fine] = 4**k
        return code

    def near(self, what: str, half: int) -> np.ndarray:
        """How often a letter, a pair of letters or any base ("") stands inside the window of `half` letters each way, clipped at the ends."""
        return self.core(self._near(what, half))

    def _near(self, what: str, half: int) -> np.ndarray:
        if (what, half) not in self.found:
            if what not in self.sums:
                d = self.digits
                hit = d < 4 if not what else d == "ACGT".index(what[0])
                if len(what) == 2:
                    hit = hit[:-1] & (d[1:] == "ACGT".index(what[1]))
                self.sums[what] = np.zeros(len(hit) + 1, np.int32)
                np.cumsum(hit, dtype=np.int32, out=self.sums[what][1:])
            total, low, wide = self.sums[what], self.halo - half, 2 * half + (1 if len(what) < 2 else 0)
            found = total[low + wide : low + wide + self.n] - total[low : low + self.n]
            if len(what) == 2:
                del self.sums[what]
                return found
            self.found[what, half] = found
        return self.found[what, half]

    def share_bins(self, half: int, edges) -> np.ndarray:
        """Bins of the share of G and C among bases; one more than there are bins without bases."""
        return self.core(self._share_bins(half, edges))

    def _share_bins(self, half: int, edges) -> np.ndarray:
        return _bins(self._near("G", half) + self._near("C", half), self._near("", half), edges)

    def ratio_bins(self, pair: str, half: int, edges) -> np.ndarray:
        """Bins of pair * bases / (left * right); one more than there are bins where that is undefined."""
        return self.core(self._ratio_bins(pair, half, edges))

    def _ratio_bins(self, pair: str, half: int, edges) -> np.ndarray:
        left, right, both, n = (self._near(x, half) for x in (*pair, pair, ""))
        if (2 * half + 1) ** 2 >= 1 << 31:
            left, both = left.astype(np.int64), both.astype(np.int64)
        return _bins(both * n, left * right, edges)


def _bins(over: np.ndarray, under: np.ndarray, edges) -> np.ndarray:
    out = np.zeros(len(over), np.int8 if len(edges) < 100 else np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        for at in range(0, len(over), BLOCK):
            part, low = out[at : at + BLOCK], under[at : at + BLOCK]
            value = over[at : at + BLOCK] / low
            for e in edges:
                part += value >= e
            part[low <= 0] = len(edges) + 1
    return out


def sides(batches, halo: int):
    rows, size = [], 0
    for row in _rows(batches):
        rows.append(row)
        size += len(row[-1])
        if size >= RUN:
            yield Side(rows, halo)
            rows, size = [], 0
    if rows:
        yield Side(rows, halo)


def _tally(key: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below `places`, rising, and how often each stands."""
    return tally(key, places, PLACES)


def _counted(kinds: pa.Schema, owners: list, owner: np.ndarray, codes: dict, more: list[str]):
    """Partial counts of codes by owner: codes gives (values of the further columns, an array) pair by pair."""
    who, values, code, n = [], [], [], []
    for value, part in codes:
        base = int(part.max(initial=0)) + 1
        key = owner * base + part if len(owners) > 1 else part
        found, times = _tally(key, len(owners) * base)
        who.append(found // base)
        code.append(found % base)
        n.append(times)
        values += [value] * len(found)
    who = np.concatenate(who)
    columns = [pa.array([o[c] for o in owners], f.type).take(pa.array(who)) for c, f in enumerate(kinds)]
    further = [pa.array([v[i] for v in values], pa.string()) for i in range(len(more))]
    yield pa.RecordBatch.from_arrays([*columns, *further, pa.array(np.concatenate(code)), pa.array(np.concatenate(n))], [*kinds.names, *more, "code", "n"])


def oriented_kmers(chunks: DataFrame, sizes: tuple[int, ...], keys: list[str], spans: str | None = None) -> DataFrame:
    """keys, strand, k, code, n: each position once a strand and k. On + the word ends at the position; on - it is the reverse complement of the word
    that begins there; 4^k where it leaves the contig or holds another letter. The chunks' halo must hold the longest word less a letter.

    A task counts only the longest windows, in base 5 with N as a digit; shorter words and the other strand are read off the counted ones.
    spans: a column of chunks with half-open intervals of the contig (an array of start and end) outside of which no position counts; words may reach out of them."""
    kinds, most = _arrow(chunks, keys), max(sizes)

    def windows(batches):
        for s in sides(batches, most - 1):
            names, number = _distinct([o[: len(keys)] for o in s.owners])
            owner, at = number[s.chunk], s.at
            if spans:
                here = np.concatenate([allowed(o[-1] or [], lo, lo + n) for o, lo, n in zip(s.owners, s.starts, np.diff(s.edges).tolist(), strict=True)])
                owner, at = owner[here], at[here]
            whole = np.zeros(len(s.digits) - most + 1, np.int32)
            for j in range(most):
                whole = whole * 5 + s.digits[j : j + len(whole)]
            yield from _counted(kinds, names, owner, [(("+",), whole[at - most + 1].astype(np.int64)), (("-",), whole[at].astype(np.int64))], ["strand"])

    def read_off(batches):
        for b in batches:
            code, place = b.column(len(kinds) + 1).to_numpy(), b.schema.names.index("strand")
            digit = [code // 5 ** (most - 1 - j) % 5 for j in range(most)]
            minus = np.array(b.column(place).to_pylist()) == "-"
            for k in sizes:
                ends, begins, fine = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64), np.ones(len(code), bool)
                for j in range(k):
                    ends, begins = ends * 4 + (digit[most - k + j] & 3), begins * 4 + (digit[j] & 3)
                    fine &= np.where(minus, digit[j], digit[most - k + j]) < 4
                out = np.where(fine, np.where(minus, reverse_codes(begins, k), ends), 4**k)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kinds) + 1], pa.array([k] * len(out), pa.int32()), pa.array(out), b.column(len(kinds) + 2)], [*kinds.names, "strand", "k", "code", "n"])

    wide = [spans] if spans else []
    part = chunks.select(*keys, *wide, *NAMES).mapInArrow(windows, _schema(chunks, keys, "strand string, code long, n long"))
    whole = part.groupBy(*keys, "strand", "code").agg(F.sum("n").alias("n"))
    words = whole.select(*keys, "strand", "code", "n").mapInArrow(read_off, _schema(chunks, keys, "strand string, k int, code long, n long"))
    return words.groupBy(*keys, "strand", "k", "code").agg(F.sum("n").alias("n"))


def joint_counts(chunks: DataFrame, k: int, half: int, keys: list[str]) -> DataFrame:
    """keys, code, gc, valid, n: how often a k-mer ends at a position whose window of `half` letters each way, clipped at the ends, has so many G and C letters and so
    many bases. Each position once; 4^k where the word leaves the contig or holds another letter."""
    kinds, wide = _arrow(chunks, keys), 2 * half + 2

    def run(batches):
        for s in sides(batches, max(half, k - 1)):
            names, number = _distinct(s.owners)
            code = (s.words(k) * wide + s.near("G", half) + s.near("C", half)) * wide + s.near("", half)
            yield from _counted(kinds, names, number[s.chunk], [((), code)], [])

    part = chunks.select(*keys, *NAMES).mapInArrow(run, _schema(chunks, keys, "code long, n long")).groupBy(*keys, "code").agg(F.sum("n").alias("n"))
    return part.select(*keys, F.expr(f"code div {wide * wide}").alias("code"), F.expr(f"code div {wide} % {wide}").alias("gc"), (F.col("code") % wide).alias("valid"), "n")


def opposite(pair: str) -> str:
    """The pair that stands on the other strand."""
    return pair[::-1].translate(str.maketrans("ACGT", "TGCA"))


def joint_bins(chunks: DataFrame, k: int, half: int, pairs: tuple[str, ...], share_edges: tuple[float, ...], ratio_edges: tuple[float, ...], keys: list[str]) -> DataFrame:
    """keys, strand, code, gc_bin, one <pair>_bin for each pair, n: each position once a strand, by its k-mer (as in oriented_kmers), the bin of the GC share and the bins of the pairs'
    observed over expected counts in the window of `half` letters each way, read along the strand. Bins are right-open; a value that is undefined has the number after the last bin.

    All sums of a window are differences of running sums over the chunk; the whole key is one 64-bit number until it is counted."""
    kinds, wide, ratio = _arrow(chunks, keys), len(share_edges) + 2, len(ratio_edges) + 2
    if (4**k + 1) * wide * ratio ** len(pairs) >= 1 << 62:
        raise ValueError("the joint key does not fit 64 bits")
    kind = np.int32 if (4**k + 1) * wide * ratio ** len(pairs) < 1 << 31 else np.int64

    def run(batches):
        for s in sides(batches, max(half, k - 1)):
            names, number = _distinct(s.owners)
            share, codes = s._share_bins(half, share_edges), []
            bins = {p: s._ratio_bins(p, half, ratio_edges) for p in {q for p in pairs for q in (p, opposite(p))}}
            for strand in "+-":
                code = s._words(k, strand == "-").astype(kind)
                for size, part in ((wide, share), *((ratio, bins[p if strand == "+" else opposite(p)]) for p in pairs)):
                    code *= size
                    code += part
                codes.append(((strand,), s.core(code)))
            yield from _counted(kinds, names, number[s.chunk], codes, ["strand"])

    part = chunks.select(*keys, *NAMES).mapInArrow(run, _schema(chunks, keys, "strand string, code long, n long")).groupBy(*keys, "strand", "code").agg(F.sum("n").alias("n"))
    size, out = ratio ** len(pairs), []
    for i, pair in enumerate(pairs):
        out.append(F.expr(f"code div {ratio ** (len(pairs) - 1 - i)} % {ratio}").alias(f"{pair.lower()}_bin"))
    return part.select(*keys, "strand", F.expr(f"code div {size * wide}").alias("code"), F.expr(f"code div {size} % {wide}").alias("gc_bin"), *out, "n")


def pair_bins(chunks: DataFrame, half: int, pairs: list[str], edges: tuple[float, ...], keys: list[str]) -> DataFrame:
    """keys, pair, bin, n: each position once a pair, by the bin of the pair's observed over expected count in its window."""
    kinds = _arrow(chunks, keys)

    def run(batches):
        for s in sides(batches, half):
            names, number = _distinct(s.owners)
            yield from _counted(kinds, names, number[s.chunk], (((p,), s.ratio_bins(p, half, edges)) for p in pairs), ["pair"])

    part = chunks.select(*keys, *NAMES).mapInArrow(run, _schema(chunks, keys, "pair string, code long, n long"))
    return part.groupBy(*keys, "pair", F.col("code").alias("bin")).agg(F.sum("n").alias("n"))


def window_sums(chunks: DataFrame, half: int, keys: list[str]) -> DataFrame:
    """keys, positions, gc, valid, most_gc: over all positions, the sums of the G and C letters and of the bases in the window of `half` letters each way, clipped at the
    ends, and the largest G and C count."""
    kinds = _arrow(chunks, keys)

    def run(batches):
        for s in sides(batches, half):
            gc, valid = s.near("G", half) + s.near("C", half), s.near("", half)
            first = s.edges[:-1]
            values = (np.diff(s.edges), np.add.reduceat(gc, first, dtype=np.int64), np.add.reduceat(valid, first, dtype=np.int64), np.maximum.reduceat(gc, first).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(pa.array([o[c] for o in s.owners], f.type) for c, f in enumerate(kinds)), *map(pa.array, values)], [*kinds.names, "positions", "gc", "valid", "most_gc"])

    part = chunks.select(*keys, *NAMES).mapInArrow(run, _schema(chunks, keys, "positions long, gc long, valid long, most_gc long"))
    return part.groupBy(*keys).agg(F.sum("positions").alias("positions"), F.sum("gc").alias("gc"), F.sum("valid").alias("valid"), F.max("most_gc").alias("most_gc"))
