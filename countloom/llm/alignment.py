"""Cross-tokenizer alignment by lockstep vectorised merging.

A text is encoded by two tokenizers, A and B, whose tokens cut the same bytes. One NumPy state vector holds a pair of pointers, into A's and B's
tokens, for each document of a batch. In each step every pair of pointed-at tokens is emitted as a link; where both tokens end at one byte that is a
cut and both pointers go on, else that whose token ends first does. Documents that are through leave the vector. So a batch takes as many steps as its
longest document has links; documents of more than LANE tokens therefore enter it as several stretches, each from one cut to another.

Links are counted by pair of ids over the corpus. Each document keeps its distinct pairs and how often it has them; counts of pairs are added up in
tasks, then by a shuffle. The pairs counted most often, MOST_SENT at most, are sent to all tasks; documents ask for the others by a
join, in which no key is hot, as a pair beyond the sent ones holds at most 1 / MOST_SENT of all links.

Nulls and odd rows: null and empty texts, and texts that either tokenizer does not give back byte for byte (B takes U+2581 for a space), have no
tokens: all their numbers are 0 and groups_sha256 is ''. Rows with a null doc_id, and each row of a repeated one, are aligned too; an empty table gives
no rows; other columns are ignored. Whole texts are encoded.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_SENT, cut, fresh_path, tasks_for
from .packing import Encoder

#: Tokens of A in one stretch of a document, and bytes of text in one batch of the state vector.
LANE, BATCH_BYTES = 512, 1 << 21
#: Distinct pairs that a task holds before it sends their counts on.
HELD = 1 << 22


class Pieces:
    """Ids and token bytes of a sentencepiece model: U+2581 stands for a space, <0xHH> for the byte HH."""

    def __init__(self, model: str):
        import sentencepiece

        self.coding = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = self.coding.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.coding.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.coding.id_to_piece(i)) for i in range(self.size))]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.coding.encode(texts, num_threads=1)


@dataclass
class Tokens:
    """Tokens of several texts: ids, end (byte offset in its text), first (index of each text's first token, and the end)."""

    ids: np.ndarray
    end: np.ndarray
    first: np.ndarray


def tokens(ids: list[np.ndarray], width: np.ndarray) -> Tokens:
    first = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    flat = np.concatenate(ids).astype(np.int64) if ids else np.empty(0, np.int64)
    total = np.concatenate([[0], np.cumsum(width[flat])])
    return Tokens(flat, total[1:] - np.repeat(total[first[:-1]], np.diff(first)), first)


def stretches(a: Tokens, b: Tokens, lane: int) -> list[tuple[int, int, int, int]]:
    """(i, i's end, j, j's end) of the stretches in which the state vector takes the texts: whole texts, or parts of about `lane` tokens of A
    that begin and end where tokens of both end."""
    out = []
    for k in range(len(a.first) - 1):
        i, stop, j, last = (int(x) for x in (a.first[k], a.first[k + 1], b.first[k], b.first[k + 1]))
        at, wide = i + lane, 64
        while at + lane // 2 < stop:
            ends = a.end[at : min(at + wide, stop)]
            place = np.searchsorted(b.end[j:last], ends)
            both = np.flatnonzero(b.end[j:last][np.minimum(place, last - j - 1)] == ends)
            if len(both):
                ni, nj = at + int(both[0]) + 1, j + int(place[both[0]]) + 1
                out.append((i, ni, j, nj))
                i, j, at, wide = ni, nj, ni + lane, 64
            else:
                at, wide = at + wide, wide * 2
        if i < stop:
            out.append((i, stop, j, last))
    return out


def lockstep(a: Tokens, b: Tokens, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j (indices of A's and B's tokens) of all links in the order of the texts, and whether the two tokens end together."""
    lanes = stretches(a, b, lane)
    if not lanes:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    i, i_stop, j, _ = (np.array(x) for x in zip(*lanes, strict=True))
    left, right, both = [], [], []
    while len(i):
        x, y = a.end[i], b.end[j]
        left.append(i)
        right.append(j)
        both.append(x == y)
        i, j = i + (x <= y), j + (y <= x)
        on = i < i_stop
        if not on.all():
            i, j, i_stop = i[on], j[on], i_stop[on]
    left, right, both = np.concatenate(left), np.concatenate(right), np.concatenate(both)
    at = left + right  # grows from link to link
    place = np.full(int(at.max()) + 1, -1)
    place[at] = np.arange(len(at))
    order = place[place >= 0]
    return left[order], right[order], both[order]


class Digits:
    """Decimal ids as bytes: a table with a row for each id."""

    def __init__(self, n: int):
        text = [str(k).encode() for k in range(n)]
        wide = max(map(len, text))
        self.table = np.frombuffer(b"".join(t.ljust(wide, b"\0") for t in text), np.uint8).reshape(n, wide)
        self.size = np.array([len(t) for t in text])


def group_texts(a: Tokens, b: Tokens, a_cut: np.ndarray, b_cut: np.ndarray, digits: Digits) -> list[memoryview]:
    """For each text its groups: a1,a2|b1;a3|b2,b3. a_cut and b_cut tell which tokens end a group."""
    ids, cuts = np.concatenate([a.ids, b.ids]), np.concatenate([a_cut, b_cut])
    side = np.repeat([0, 1], [len(a.ids), len(b.ids)])
    group = np.concatenate([np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut])
    order = np.argsort(group * 2 + side, kind="stable")
    ids, cuts, side = ids[order], cuts[order], side[order]
    width = digits.table.shape[1]
    cells = np.empty((len(ids), width + 1), np.uint8)
    cells[:, :width] = digits.table[ids]
    size = digits.size[ids]
    cells[np.arange(len(ids)), size] = np.where(cuts, np.where(side == 1, ord(";"), ord("|")), ord(","))
    text = memoryview(cells[np.arange(width + 1) <= size[:, None]].tobytes())
    edge = np.concatenate([[0], np.cumsum(size + 1)])[a.first + b.first]
    return [text[s : max(s, e - 1)] for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def packed(values: np.ndarray) -> bytes:
    """Rising numbers below 2^32 as differences."""
    return np.diff(values, prepend=np.zeros(1, values.dtype)).astype("<u4").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "<u4"), dtype=np.int64)


SCHEMA = "k_row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _aligner(tokenizer: str, model: str):
    """Of (doc_id, text): SCHEMA. pairs: the distinct pairs a * (B's ids) + b of a document, rising; times: how often it has each."""
    held: list = []

    def encoders():
        if not held:
            one, two = Encoder(tokenizer), Pieces(model)
            held.extend([one, two, np.array([len(x) for x in one.token_bytes()]), np.array([len(x) for x in two.bytes]), Digits(max(one.size, two.size))])
        return held

    def encode(texts: list[str | None]):
        one, two, *_ = encoders()
        some = [t or "" for t in texts]
        b = two(some)
        whole = [" " + t for t in some]
        same = [t != "" and b"".join(map(two.bytes.__getitem__, ids)) == w.encode() for t, w, ids in zip(some, whole, b, strict=True)]
        none = np.empty(0, np.int64)
        return [one.plain(w) if s else none for w, s in zip(whole, same, strict=True)], [np.array(ids) if s else none for ids, s in zip(b, same, strict=True)]

    def align(doc_ids: pa.Array, texts: list[str | None], number: int) -> pa.RecordBatch:
        a_ids, b_ids = encode(texts)
        _, two, a_width, b_width, digits = encoders()
        a, b = tokens(a_ids, a_width), tokens(b_ids, b_width)
        i, j, both = lockstep(a, b)
        a_cut, b_cut = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
        a_cut[i[both]] = b_cut[j[both]] = True
        n_a, n_b = np.diff(a.first), np.diff(b.first)
        if (a_cut[a.first[1:][n_a > 0] - 1] & b_cut[b.first[1:][n_b > 0] - 1]).sum() != (n_a > 0).sum():
            raise ValueError("a text's tokens of A and of B do not end together")
        digest = [hashlib.sha256(t).hexdigest() if n else "" for t, n in zip(group_texts(a, b, a_cut, b_cut, digits), n_a.tolist(), strict=True)]
        doc = np.repeat(np.arange(len(texts)), n_a)[i]
        pair, times = np.unique((doc * a_width.size + a.ids[i]) * two.size + b.ids[j], return_counts=True)
        doc_of, pair = np.divmod(pair, a_width.size * two.size)
        edge = np.searchsorted(doc_of, np.arange(len(texts) + 1)).tolist()
        span = list(zip(edge[:-1], edge[1:], strict=True))
        cols = [
            pa.array(np.arange(number, number + len(texts))), doc_ids, pa.array(n_a), pa.array(n_b), pa.array(np.bincount(doc[both], minlength=len(texts))), pa.array(np.bincount(doc, minlength=len(texts))),
            pa.array(digest, pa.string()), pa.array([packed(pair[s:e]) for s, e in span], pa.binary()), pa.array([times[s:e].astype("<u4").tobytes() for s, e in span], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SCHEMA.split(", ")])

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        for b in batches:
            texts, at, size = [], 0, 0
            for k, text in enumerate(b.column(1)):
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= BATCH_BYTES or k == len(b) - 1:
                    yield align(b.column(0).slice(at, len(texts)), texts, number)
                    number, at, texts, size = number + len(texts), at + len(texts), [], 0

    return run


def _summed(batches):
    """(pair, n) of many documents, added up in parts of HELD pairs."""
    codes, counts, held = [], [], 0

    def flush():
        code, at = np.unique(np.concatenate(codes), return_inverse=True)
        n = np.bincount(at, np.concatenate(counts)).astype(np.int64)
        return [pa.RecordBatch.from_arrays([pa.array(code[k : k + 50_000]), pa.array(n[k : k + 50_000])], ["pair", "n"]) for k in range(0, len(code), 50_000)]

    for b in batches:
        for raw, times in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            codes.append(unpacked(raw))
            counts.append(np.frombuffer(times, "<u4"))
            held += len(codes[-1])
            if held >= HELD:
                yield from flush()
                codes, counts, held = [], [], 0
    if codes:
        yield from flush()


def _looked_up(sent):
    """Of (k_row, pairs, times): k_row, n_best, count_sum from the pairs sent; rest and rest_times: the pairs not among them."""

    def run(batches):
        pairs, n, best = sent.value
        for b in batches:
            rows, good, total, rest, rest_times = b.column(0), [], [], [], []
            for raw, times in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                code, many = unpacked(raw), np.frombuffer(times, "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)
                here = pairs[at] == code
                good.append(int((many * (best[at] & here)).sum()))
                total.append(int((many * np.where(here, n[at], 0)).sum()))
                rest.append(code[~here])
                rest_times.append(many[~here])
            yield pa.RecordBatch.from_arrays([rows, pa.array(good, pa.int64()), pa.array(total, pa.int64()), pa.array(rest, pa.list_(pa.int64())), pa.array(rest_times, pa.list_(pa.int64()))], ["k_row", "n_best", "count_sum", "rest", "rest_times"])

    return run


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """pair, n and best (whether no pair of the same id of B is counted more often) of the documents' pairs."""
    n = rows.select("pairs", "times").mapInArrow(_summed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    n = cut(n, "pairs").withColumn("b", F.col("pair") % b_size)
    top = n.groupBy("b").agg(F.max("n").alias("top"))  # a row for each id of B
    return cut(n.join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pairs")


def most_counted(pairs: DataFrame, most: int) -> int:
    """The least power of two such that at most `most` pairs are counted so often."""
    by = {r.k: r["count"] for r in pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()}
    k, held = max(by, default=0) + 1, 0
    while k > 0 and held + by.get(k - 1, 0) <= most:
        k, held = k - 1, held + by.get(k - 1, 0)
    return 1 << k


def aligned(docs: DataFrame, tokenizer: str, model: str, most_sent: int = MOST_SENT) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    tokenizer: a byte-level file for A; model: a sentencepiece model for B. most_sent: how many pairs' counts are sent to all tasks."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_aligner(tokenizer, model), SCHEMA)
    path = fresh_path(spark, "aligned")
    rows.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(SCHEMA).parquet(path)
    pairs = pair_counts(rows, Pieces(model).size)
    least = most_counted(pairs, most_sent)
    sent = pairs.where(F.col("n") >= least).orderBy("pair").toArrow()
    value = tuple(sent[c].to_numpy() for c in ("pair", "n", "best")) if len(sent) else (np.array([-1]), np.array([0]), np.array([False]))
    looked = rows.select("k_row", "pairs", "times").mapInArrow(_looked_up(spark.sparkContext.broadcast(value)), "k_row long, n_best long, count_sum long, rest array<long>, rest_times array<long>")
    rows = rows.drop("pairs", "times")
    if least > 1:  # there are others: documents ask for them
        looked = cut(looked, "looked")
        asked = looked.select("k_row", F.explode(F.arrays_zip("rest", "rest_times")).alias("r")).select("k_row", F.col("r.rest").alias("pair"), F.col("r.rest_times").alias("times"))
        tasks = tasks_for(24 * asked.count())
        found = asked.repartition(tasks, "pair").join(pairs.where(F.col("n") < least), "pair").select("k_row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
        looked = looked.select("k_row", "n_best", "count_sum").unionByName(found).groupBy("k_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.join(looked.select("k_row", "n_best", "count_sum"), "k_row").drop("k_row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
