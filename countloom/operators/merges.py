"""Tokens of sequences by a given, ranked list of merges: how often each stands, where each ends, and which one holds a coordinate.

Merges are applied in the order of their ranks to all sequences of a run at once, as arrays: a merge can only make pairs of later rank, so one pass a merge gives what merging the
pair of least rank again and again gives. Sequences go in chunks of a fixed width, and no token crosses a chunk's edge, so a long contig is many rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import NAMES
from .counts import RUN, _arrow, _distinct, _rows, _schema

LETTERS = "ACGTN"


def vocabulary(merges: list[tuple[str, str]]) -> list[str]:
    """The single letters, then the token of each merge; ValueError where a merge joins what isn't a token yet or makes one that is."""
    out = list(LETTERS)
    for a, b in merges:
        if a not in out or b not in out or a + b in out:
            raise ValueError(f"merge of {a!r} and {b!r}")
        out.append(a + b)
    return out


def _alternate(hit: np.ndarray) -> np.ndarray:
    """Of runs of neighbouring hits every other one, from the left: a pair of equal tokens takes the first two of a run."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at
    new = np.concatenate([[True], np.diff(at) > 1])
    first = np.maximum.accumulate(np.where(new, at, 0))
    return at[(at - first) % 2 == 0]


def merged(letters: np.ndarray, edges: np.ndarray, merges: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of sequences side by side, and where each begins. letters: numbers below 5; edges: where sequences begin; the k-th merge makes token 5 + k."""
    token, start = letters.astype(np.int32), np.arange(len(letters))
    opens = np.zeros(len(letters), bool)
    opens[edges[edges < len(letters)]] = True
    present = set(np.unique(token).tolist())
    for k, (a, b) in enumerate(merges):
        if a not in present or b not in present:
            continue
        hit = (token[:-1] == a) & (token[1:] == b) & ~opens[1:]
        at = _alternate(hit) if a == b else np.flatnonzero(hit)
        if len(at):
            token[at] = 5 + k
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            token, start, opens = token[keep], start[keep], opens[keep]
            present.add(5 + k)
    return token, start


class _Merger:
    def __init__(self, merges: list[tuple[str, str]]):
        self.names = vocabulary(merges)
        number = {t: i for i, t in enumerate(self.names)}
        self.merges = [(number[a], number[b]) for a, b in merges]
        self.letter = np.full(128, 4, np.int8)
        for i, c in enumerate("ACGT"):
            self.letter[[ord(c), ord(c.lower())]] = i

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """token, start and end in its text, and the number of its text."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        token, start = merged(self.letter[np.minimum(points, 127)], edges, self.merges)
        end = np.append(start[1:], edges[-1])
        owner = np.searchsorted(edges, start, side="right") - 1
        return token, start - edges[owner], end - edges[owner], owner


def _runs(batches):
    rows, size = [], 0
    for row in _rows(batches):
        rows.append(row)
        size += len(row[-1])
        if size >= RUN:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def token_counts(chunks: DataFrame, merges: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    """keys, token, n over chunks with halo 0: letters but A, C, G and T are N, and N is never merged unless a merge says so."""
    kinds = _arrow(chunks, keys)

    def run(batches):
        merger = _Merger(merges)
        for rows in _runs(batches):
            token, _, _, owner = merger([r[-1] for r in rows])
            names, number = _distinct([r[:-4] for r in rows])
            both, n = np.unique(number[owner] * len(merger.names) + token, return_counts=True)
            who, token = both // len(merger.names), both % len(merger.names)
            columns = [pa.array([names[i][c] for i in who.tolist()], f.type) for c, f in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([merger.names[i] for i in token.tolist()], pa.string()), pa.array(n)], [*kinds.names, "token", "n"])

    part = chunks.select(*keys, *NAMES).mapInArrow(run, _schema(chunks, keys, "token string, n long"))
    return part.groupBy(*keys, "token").agg(F.sum("n").alias("n"))


def pair_counts(chunks: DataFrame, merges: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    """keys, first, second, n: how often two tokens stand side by side in a chunk; without merges these are pairs of letters. Equal tokens in a row count for each neighbouring two."""
    kinds = _arrow(chunks, keys)

    def run(batches):
        merger = _Merger(merges)
        size = len(merger.names)
        for rows in _runs(batches):
            token, _, _, owner = merger([r[-1] for r in rows])
            names, number = _distinct([r[:-4] for r in rows])
            at = np.flatnonzero(owner[:-1] == owner[1:])
            both, n = np.unique((number[owner[at]] * size + token[at]) * size + token[at + 1], return_counts=True)
            who, first, second = both // size // size, both // size % size, both % size
            columns = [pa.array([names[i][c] for i in who.tolist()], f.type) for c, f in enumerate(kinds)]
            spelt = [pa.array([merger.names[i] for i in side.tolist()], pa.string()) for side in (first, second)]
            yield pa.RecordBatch.from_arrays([*columns, *spelt, pa.array(n)], [*kinds.names, "first", "second", "n"])

    part = chunks.select(*keys, *NAMES).mapInArrow(run, _schema(chunks, keys, "first string, second string, n long"))
    return part.groupBy(*keys, "first", "second").agg(F.sum("n").alias("n"))


def tokens_at(chunks: DataFrame, sites: DataFrame, contig: str, merges: list[tuple[str, str]], width: int) -> DataFrame:
    """sites (contig, pos from 0, ...) with token, token_start and token_end of the token that holds the position. chunks: by contig, halo 0, of that width. A chunk that is asked for
    is merged once for all its positions, of which it has at most `width` different ones; a hot contig is many chunks."""
    asked = sites.where("pos >= 0").select(contig, "pos").distinct().withColumn("core_start", F.col("pos") - F.col("pos") % width)
    asked = asked.groupBy(contig, "core_start").agg(F.sort_array(F.collect_list("pos")).alias("_at"))
    rows = chunks.join(asked, [contig, "core_start"]).select(contig, "core_start", "_at", "bases")
    kinds = _arrow(rows, [contig])

    def run(batches):
        merger = _Merger(merges)
        for part in _runs(batches):
            token, start, end, owner = merger([r[-1] for r in part])
            first = np.searchsorted(owner, np.arange(len(part) + 1))
            out = []
            for k, (name, core, places, text) in enumerate(part):
                at = np.array([p - core for p in places if p - core < len(text)], np.int64)
                which = first[k] + np.searchsorted(start[first[k] : first[k + 1]], at, side="right") - 1
                out += [(name, core + p, merger.names[t], core + s, core + e) for p, t, s, e in zip(at.tolist(), token[which].tolist(), start[which].tolist(), end[which].tolist(), strict=True)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [kinds.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [contig, "pos", "token", "token_start", "token_end"])

    found = rows.mapInArrow(run, _schema(rows, [contig], "pos long, token string, token_start long, token_end long"))
    return sites.join(found, [contig, "pos"])
