"""Lexical retrieval packing.

Texts become token ids once. A weighted min-hash of a document's distinct ids (rare ids count more) names its
lexical key, the two ids that win; documents in key order, so that like lies beside like, are cut into shards of
bounded size, and a key that many documents share simply fills several shards. A shard keeps a BM25 inverted
index over its documents' token ids. A seed document opens a window; its best-scoring unused neighbours
follow, the last one is cut where the window is full, and its rest opens the next window with it as the
seed. So every window but a shard's last is full; the last is cut into powers of two, which need no padding.

Nulls and odd rows: null text is empty (its only id is the end id); rows with a null doc_id are packed too;
rows that repeat a doc_id are packed each; ties in score go to the document that is first in key order;
other columns are ignored. Whole texts are encoded.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, tasks_for

WINDOW, END_ID = 2048, 1
#: Ids of a shard: about 2 MB of text.
SHARD_IDS = 1 << 19
K1, B = 1.2, 0.75
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_values() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 as itself, the other bytes in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Ids of texts as little-endian 32-bit bytes. The vocabulary is read from a tokenizers file whose ids
    are its merge ranks; tests compare the ids with that library's. Strings of the file's added tokens get those tokens' ids, as there."""

    def __init__(self, tokenizer: str):
        import public_tokenizers
        import tiktoken

        file = json.loads(Path(tokenizer).read_text())
        model, added = file["model"], {t["content"]: t for t in file.get("added_tokens") or []}
        if any(t.get(k) for t in added.values() for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in or ask for their surroundings are not supported")
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
            raise ValueError("the ids of this vocabulary are not its merge ranks")
        value = byte_values()
        ranks = {bytes(value[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        self.coding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={c: t["id"] for c, t in added.items()})
        self.kind = "<u2" if self.coding.max_token_value < 1 << 16 else "<u4"
        self.size, self.file, self.slow = self.coding.max_token_value + 1, tokenizer, {}

    def _slowly(self, text: str, plain: bool) -> np.ndarray:
        """By the library that the file is written for: for the texts, such as a million blanks in a row, that the fast one's pattern search gives up on."""
        from tokenizers import Tokenizer

        if plain not in self.slow:
            self.slow[plain] = Tokenizer.from_file(self.file)
            self.slow[plain].encode_special_tokens = plain
        return np.array(self.slow[plain].encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.coding.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return self._slowly(text, False)

    def plain(self, text: str) -> np.ndarray:
        """Ids where strings of added tokens are ordinary text."""
        try:
            return self.coding.encode_to_numpy(text, disallowed_special=())
        except ValueError:
            return self._slowly(text, True)

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id, by id."""
        return [self.coding.decode_single_token_bytes(i) for i in range(self.size)]


@lru_cache(maxsize=2)
def _draws(n: int) -> np.ndarray:
    """A fixed exponential draw for each id, divided by its weight: ids weigh by their rank, common ones little."""
    ids = np.arange(n)
    uniform = (mix(ids.astype(np.uint64) + np.uint64(1)) >> np.uint64(11)) * 2.0**-53 + 2.0**-54
    return -np.log(uniform) / np.log2(ids + 2.0) ** 4


def lexical_key(ids: np.ndarray, vocabulary: int) -> int:
    """The two distinct ids with the least draws: those that win a weighted min-hash."""
    draw = _draws(vocabulary)[ids]
    first = ids[draw.argmin()]
    second = ids[np.where(ids == first, np.inf, draw).argmin()]
    return (int(first) << 32) + int(second)


def _encode(tokenizer: str, end_id: int):
    held: list[Encoder] = []

    def run(batches):
        if not held:
            held.append(Encoder(tokenizer))
        end, task = np.array([end_id], np.uint32), TaskContext.get().partitionId()
        number, most = 0, max(held[0].coding.max_token_value, end_id) + 1
        for b in batches:
            keys, raw, n = [], [], []
            for text in b.column(1).to_pylist():
                ids = np.concatenate([held[0](text or ""), end])
                keys.append(lexical_key(ids, most))
                raw.append(ids.astype(held[0].kind if end_id < 1 << 16 else "<u4").tobytes())
                n.append(len(ids))
            salt = mix(np.arange(number, number + len(n), dtype=np.uint64) + np.uint64(task << 32)).view(np.int64)
            number += len(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(salt), pa.array(raw, pa.binary())], ["doc_id", "n", "key", "salt", "ids"])

    return run


class Index:
    """BM25 over the token ids of a shard's documents."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        terms, counts, owner = [], [], []
        for i, ids in enumerate(docs):
            t, c = np.unique(ids, return_counts=True)
            terms.append(t)
            counts.append(c)
            owner.append(np.full(len(t), i, np.int32))
        self.terms = terms
        length = np.array([len(d) for d in docs], float)
        t, c, d = (np.concatenate(x) if n else np.empty(0, np.int64) for x in (terms, counts, owner))
        order = np.argsort(t, kind="stable")
        t, c, self.doc = t[order], c[order], d[order]
        self.vocabulary, self.start, df = np.unique(t, return_index=True, return_counts=True)
        self.stop = self.start + df
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(1.0, length.mean() if n else 1.0))
        self.weight = np.repeat(idf, df) * c * (K1 + 1) / (c + norm[self.doc])
        self.n = n

    def scores(self, i: int) -> np.ndarray:
        """Of all documents for document i as the query: each of its terms once."""
        at = np.searchsorted(self.vocabulary, self.terms[i])
        lo, hi = self.start[at], self.stop[at]
        lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]  # a term of one document scores no other
        size = hi - lo
        if not len(size):
            return np.zeros(self.n)
        index = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
        return np.bincount(self.doc[index], self.weight[index], self.n)


def order_of(docs: list[np.ndarray], window: int) -> list[int]:
    """Seeds and their neighbours, in the order in which they fill windows."""
    index, unused, out = Index(docs), np.ones(len(docs), bool), []
    free, room, ahead = 0, window, []
    while len(out) < len(docs):
        while ahead and not unused[ahead[-1]]:
            ahead.pop()
        if not ahead:  # a window opens with a new seed
            while not unused[free]:
                free += 1
            ahead = [free]
        pick, opens = ahead.pop(), room == window
        unused[pick] = False
        out.append(pick)
        over = len(docs[pick]) - room
        if over >= 0:
            room = window - over % window
            ahead = []
        else:
            room = -over
        if room < window and (opens or over > 0):  # it opened this window: its neighbours follow
            score = np.where(unused, index.scores(pick), -1.0)
            ahead = np.argsort(-score, kind="stable")[: len(docs) - len(out)][::-1].tolist()
    return out


def windows(lengths: list[int], window: int) -> list[int]:
    """Sizes of the sequences that hold sum(lengths) ids: full windows, then powers of two."""
    full, rest = divmod(sum(lengths), window)
    return [window] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pack(window: int, shard_ids: int, kind: str):
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def shard(ids: list, docs: list[np.ndarray], number: int) -> tuple[pa.RecordBatch, int]:
        out, sizes, at_size, offset = [], windows([len(d) for d in docs], window), 0, 0
        for i in order_of(docs, window):
            whole, at = docs[i].astype("<u4"), 0
            while at < len(whole):
                n = min(len(whole) - at, sizes[at_size] - offset)
                out.append((ids[i], at, n, zlib.crc32(whole[at : at + n]), len(whole), number + at_size, offset))
                at, offset = at + n, offset + n
                if offset == sizes[at_size]:
                    at_size, offset = at_size + 1, 0
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], names), number + at_size

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        ids, docs, held = [], [], 0
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                docs.append(np.frombuffer(raw, kind))
                held += len(docs[-1])
                if held >= shard_ids:
                    batch, number = shard(ids, docs, number)
                    yield batch
                    ids, docs, held = [], [], 0
        if docs:
            yield shard(ids, docs, number)[0]

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """A row for each piece: its document, start and length there, CRC of its ids, sequence and offset."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = cut(rows.mapInArrow(_encode(tokenizer, end_id), "doc_id long, n long, key long, salt long, ids binary"), "ids")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    kind = Encoder(tokenizer).kind if end_id < 1 << 16 else "<u4"
    tasks = max(1, min(tasks_for(2 * total), total // shard_ids))
    rows = rows.repartitionByRange(tasks, "key", "salt").sortWithinPartitions("key", "salt", "doc_id")
    return rows.select("doc_id", "ids").mapInArrow(_pack(window, shard_ids, kind), SCHEMA)
