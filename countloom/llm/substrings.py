"""Repeated passages by prefix-partitioned suffix trees.

A suffix is a place in a text from which `window` words follow. Its window selects the `prefix`-word
sequence with the least hash in it (the anchor), so equal windows have equal anchors.

1. Anchors of every text are dealt by hash to memory-sized groups; those met in two documents stay.
2. A suffix is split off by a prefix of variable length. Mostly the prefix ends with the anchor (7 to 13
   words), and suffixes around one anchor travel as one record: the anchor and the words on both sides. An
   anchor that more than HOT records share is too much for one subtree: each of its suffixes goes by
   a prefix of 9, 11 or 13 words of its own, longer the more there are.
3. A subtree is built by sorting its suffixes by words; common prefixes of neighbours delimit its
   internal nodes. A deep node (at least `window` words) is a repeat. A suffix takes the deepest node that
   a smaller doc_id shares, and repeats that continue one that begins a word earlier are dropped: what is left are the
   maximal repeats, as far as the record's words reach; a longer one continues in the next anchor's
   record. Words under them are removed.

A batch of documents settles copies inside it before anything is dealt and sends one record of each
kind, so a passage that a third of all documents share costs a group one row a batch. Groups and
tasks follow from the total text size; no text, window or group is cut short.

Nulls and odd rows: null text has no words; rows with a null doc_id lose nothing and take nothing from
others; rows that repeat a doc_id are one document for comparison and each gets its row; texts
shorter than the window keep everything; other columns pass or are ignored, whatever their names. Words
are compared by hashes: 64 bits for the anchor's seven words or a longer prefix, 48 bits for each other word.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GRAM_BASE, Words, by_bucket, cut, groups_for, mix, tasks_for, text_bytes, text_runs

WINDOW, PREFIX = 13, 7
#: Bytes of text whose anchors make one group, and how many groups there are at least (results come as a row a document and group, so few more of them for small inputs).
GROUP_BYTES, LEAST_GROUPS = 24 << 20, 24
#: Records that may share an anchor: 6 MB of them. At most MOST_HOT anchors (16 MB) can be listed as shared by more.
HOT, MOST_HOT = 1 << 16, 1 << 21
#: Records of a group whose subtrees are built at once.
SUBTREES = 1 << 15
#: Bytes of text whose copies are settled before anything is dealt.
PART_BYTES = 8 << 20
BLOB = "bucket int, blob binary"


def anchors(words: Words, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word index of the anchors of all windows."""
    grams, at = words.grams(prefix)
    span = window - prefix + 1
    m = len(grams) - span + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    best, pick = grams[:m].copy(), np.arange(m)
    for k in range(1, span):
        less = grams[k : k + m] < best
        best[less], pick[less] = grams[k : k + m][less], np.flatnonzero(less) + k
    pick = np.unique(pick[at[:m] + span - 1 == at[span - 1 :]])
    return grams[pick], at[pick]


def runs_of(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)


def ends(starts: np.ndarray, n: int) -> np.ndarray:
    return np.append(starts[1:], n)[: len(starts)]


def dealt(bucket: np.ndarray, columns: dict[str, np.ndarray], docs: np.ndarray, kind: str):
    """Batches (bucket, blob): rows of each bucket, with the part of docs that they name by index."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = runs_of(bucket)
    names, blobs = [], []
    for s, e in zip(starts, ends(starts, len(bucket)), strict=True):
        part = {c: v[order[s:e]] for c, v in columns.items()}
        used, part["doc"] = np.unique(part["doc"], return_inverse=True)
        part = {c: (v.dtype.str if c != "doc" else "<u4", v.shape[1:], v.tobytes() if c != "doc" else v.astype("<u4").tobytes()) for c, v in part.items()}
        names.append(int(bucket[s]))
        blobs.append(pickle.dumps((kind, part, docs[used].tobytes())))
    if names:
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def gathered(table: pa.Table, kind: str, width: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """What dealt() sent to a bucket: columns, and the docs array of shape (n, width)."""
    columns, docs, n = {}, [np.empty((0, width), np.int64)], 0
    for blob in table.column("blob").to_pylist():
        got, part, ids = pickle.loads(blob)
        if got != kind:
            continue
        ids = np.frombuffer(ids, np.int64).reshape(-1, width)
        for c, (dtype, shape, raw) in part.items():
            v = np.frombuffer(raw, dtype).reshape(-1, *shape)
            columns.setdefault(c, []).append(v.astype(np.int64) + n if c == "doc" else v)
        docs.append(ids)
        n += len(ids)
    return {c: np.concatenate(v) for c, v in columns.items()}, np.concatenate(docs)


def in_parts(batches, text: int):
    """Batches cut to about PART_BYTES of the text column each; a longer text is a part of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def _send_anchors(groups: int, window: int, prefix: int):
    def run(batches):
        for batch in in_parts(batches, 1):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            h, doc, pos = [], [], []
            for row, data, offsets in text_runs(batch.column(1)):
                words = Words(data, offsets)
                got, at = anchors(words, window, prefix)
                h.append(got)
                doc.append((words.doc[at] + row).astype(np.int32))
                pos.append((at - words.first[words.doc[at]]).astype(np.uint32))
            if not h or not sum(map(len, h)):
                continue
            h, doc, pos = map(np.concatenate, (h, doc, pos))
            order = np.argsort(h, kind="stable")
            h, doc, pos, owner = h[order], doc[order], pos[order], ids[doc[order]]
            starts = runs_of(h)
            sizes = np.diff([*starts, len(h)])
            several = np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts)
            here = np.repeat(several, sizes)
            lead = np.zeros(len(h), bool)
            lead[starts] = True
            send = ~here | lead
            bits = np.ceil(np.log2(np.where(here, np.repeat(sizes, sizes), 1) + 1)).astype(np.uint8)  # 2 ** bits - 1 records at most
            docs = ids.reshape(-1, 1).astype(np.int64)
            yield from dealt((h[send] % np.uint64(groups)).astype(np.int64), {"h": h[send], "doc": doc[send], "pos": pos[send], "count": bits[send] | (here[send].astype(np.uint8) << 7)}, docs, "ask")
            yield from dealt((mix(owner[here].astype(np.uint64)) % np.uint64(groups)).astype(np.int64), {"doc": doc[here], "pos": pos[here]}, docs, "known")

    return run


def _positions(owner: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    order = np.argsort(owner, kind="stable")
    owner, pos = owner[order], pos[order]
    starts = runs_of(owner)
    return owner[starts], [pos[s:e].tobytes() for s, e in zip(starts, ends(starts, len(pos)), strict=True)]


def _meet(hot: int):
    """doc_id and positions of the anchors that more than one document has; with doc_id null, hashes and counts of anchors with more than `hot` records."""

    def run(table):
        ask, docs = gathered(table, "ask", 1)
        known, more = gathered(table, "known", 1)
        owner, pos, often = [np.empty(0, np.int64)], [np.empty(0, np.uint32)], np.empty((0, 2), np.uint64)
        if ask:
            order = np.argsort(ask["h"], kind="stable")
            a = {c: v[order] for c, v in ask.items()}
            several, count = a["count"] >> 7, (1 << (a["count"] & 127).astype(np.int64)) - 1
            who, starts = docs[a["doc"], 0], runs_of(a["h"])
            sizes = np.diff([*starts, len(order)])
            met = (np.minimum.reduceat(who, starts) != np.maximum.reduceat(who, starts)) | (np.maximum.reduceat(several, starts) > 0)
            total = np.add.reduceat(count, starts)
            often = np.stack([a["h"][starts], total.astype(np.uint64)], 1)[met & (total > hot)]
            take = np.repeat(met, sizes) & (several == 0)
            owner.append(who[take])
            pos.append(a["pos"][take])
        if known:
            owner.append(more[known["doc"], 0])
            pos.append(known["pos"])
        ids, packed = _positions(np.concatenate(owner), np.concatenate(pos))
        return pa.table({"doc_id": pa.array([*ids.tolist(), None], pa.int64()), "at": pa.array([*packed, often.tobytes()], pa.binary())})

    return run


def narrow(words: np.ndarray) -> np.ndarray:
    """The upper 48 bits of word hashes, as six bytes each."""
    return (words >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(*words.shape, 8)[..., :6]


def wide(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((*raw.shape[:-1], 8), np.uint8)
    out[..., :6] = raw
    return out.view("<u8")[..., 0]


def _locally_late(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Of rows with a key: whether a smaller owner here has the key too, or an earlier row of the owner itself."""
    order = np.lexsort((owner, key))
    starts = runs_of(key[order])
    least = np.repeat(owner[order][starts], np.diff([*starts, len(order)]))
    late = np.empty(len(order), bool)
    late[order] = owner[order] > least
    return late


def _records(words: Words, doc: np.ndarray, pos: np.ndarray, prefix: int, side: int) -> dict[str, np.ndarray]:
    """Anchors at word `pos` of text `doc`, with `side` words on both sides (0 beyond the text), left ones outwards, how many there are, and a key of it all."""
    n = np.diff(words.first)[doc]
    at = words.first[doc] + pos
    acc = np.zeros(len(at), np.uint64)
    for k in range(prefix):
        acc = acc * GRAM_BASE + words.h[at + k]
    last = max(len(words.h) - 1, 0)
    left = [np.where(pos >= j, words.h[np.maximum(at - j, 0)], 0) for j in range(1, side + 1)]
    right = [np.where(pos + prefix + j < n, words.h[np.minimum(at + prefix + j, last)], 0) for j in range(side)]
    key = mix(acc)
    for words_at in (*left, *right):
        key = key * GRAM_BASE + words_at
    return {
        "h": mix(acc), "key": mix(key), "left": narrow(np.stack(left, 1).astype(np.uint64)), "right": narrow(np.stack(right, 1).astype(np.uint64)),
        "lo": np.minimum(pos, side).astype(np.uint8), "hi": np.minimum(n - pos - prefix, side).astype(np.uint8), "pos": pos.astype(np.uint32),
    }


def _packed(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (start.astype(np.uint64) << np.uint64(8)) | length.astype(np.uint64)


def _send_suffixes(groups: int, window: int, prefix: int, limit: int, hot):
    side = window - prefix
    most = np.uint64(groups)

    def run(batches):
        names, counts = hot.value
        for batch in in_parts(batches, 2):
            docs = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1).astype(np.int64)
            lists = batch.column(3).to_pylist()
            got: dict[str, list] = {}
            for row, data, offsets in text_runs(batch.column(2)):
                words = Words(data, offsets)
                packed = [np.unique(np.frombuffer(b"".join(x), "<u4")) for x in lists[row : row + len(offsets) - 1]]
                doc = np.repeat(np.arange(len(packed)), [len(x) for x in packed])
                pos = np.concatenate(packed).astype(np.int64)
                fits = pos + prefix <= np.diff(words.first)[doc]
                doc, pos = doc[fits], pos[fits]
                for c, v in (_records(words, doc, pos, prefix, side) | {"doc": doc + row}).items():
                    got.setdefault(c, []).append(v)
            if not got:
                continue
            a = {c: np.concatenate(v) for c, v in got.items()}
            level = np.zeros(len(a["h"]), int)  # how many words a prefix goes beyond the anchor's length
            if len(names):
                at = np.minimum(np.searchsorted(names, a["h"]), len(names) - 1)
                ratio = np.where(names[at] == a["h"], counts[at] / limit, 0)
                level = np.where(ratio > 256, side, np.where(ratio > 16, (2 * side + 2) // 3, np.where(ratio > 1, (side + 2) // 3, 0)))
            late = []

            cold = a if not level.any() else {c: v[level == 0] for c, v in a.items()}
            done = _locally_late(cold.pop("key"), docs[cold["doc"], 0])
            ok = done & (cold["lo"] + cold["hi"] >= side)
            late.append((cold["doc"][ok], _packed(cold["pos"][ok] - cold["lo"][ok], cold["lo"][ok] + cold["hi"][ok] + prefix)))
            cold = {c: v[~done] for c, v in cold.items()}
            yield from dealt((mix(cold["h"]) % most).astype(np.int64), cold, docs, "record")

            warm = {c: wide(v[level > 0]) if v.ndim > 1 else v[level > 0] for c, v in a.items()} if level.any() else {}
            more = level[level > 0]
            for i in range(side + 1) if len(more) else ():
                fit = (warm["lo"] >= i) & (warm["hi"] >= side - i)
                w, depth = {c: v[fit] for c, v in warm.items()}, np.maximum(more[fit], i)  # the prefix has prefix + depth words: i before the anchor, the rest behind
                key = mix(w["h"] + np.uint64(i))
                for j in range(i):
                    key = mix(key * GRAM_BASE + w["left"][:, j])
                whole = key
                for j in range(side - i):
                    key = np.where(i + j < depth, mix(key * GRAM_BASE + w["right"][:, j]), key)
                    whole = mix(whole * GRAM_BASE + w["right"][:, j])
                done = _locally_late(whole, docs[w["doc"], 0])
                late.append((w["doc"][done], _packed(w["pos"][done] - np.uint32(i), np.full(done.sum(), window))))
                take = ~done
                part = {"h": key[take], "depth": (prefix + depth[take]).astype(np.uint8), "behind": np.full(take.sum(), i, np.uint8), "right": narrow(w["right"][take]), "hi": w["hi"][take], "doc": w["doc"][take], "pos": w["pos"][take] - np.uint32(i)}
                yield from dealt((mix(part["h"]) % most).astype(np.int64), part, docs, "suffix")
            doc, span = (np.concatenate(x) for x in zip(*late, strict=True))
            yield from dealt((mix(docs[doc, 0].astype(np.uint64)) % most).astype(np.int64), {"doc": doc, "span": span}, docs, "late")

    return run


def deepest(same: np.ndarray, owner: np.ndarray, least: int, most: int) -> np.ndarray:
    """Of suffixes in sorted order, of which neighbours share same[k] words: the depth, from least to most, of the deepest node
    above each that a smaller owner shares; 0 if there is none."""
    out = np.zeros(len(owner), np.int64)
    for depth in range(least, most + 1):
        starts = np.flatnonzero(np.concatenate([[True], same < depth]))  # the nodes of this depth
        first = np.repeat(np.minimum.reduceat(owner, starts), np.diff([*starts, len(owner)]))
        late = owner > first
        if not late.any():
            break
        out[late] = depth
    return out


def shared_words(rows: np.ndarray, have: np.ndarray) -> np.ndarray:
    """How many words neighbours share from their first word on."""
    if len(rows) < 2:
        return np.empty(0, np.int64)
    return np.minimum(np.cumprod(rows[1:] == rows[:-1], 1).sum(1), np.minimum(have[1:], have[:-1]))


def subtrees(r: dict[str, np.ndarray], owner: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal repeats around anchors: record, first word relative to the anchor (backwards) and length.

    Suffixes that begin i words before their anchors are sorted by anchor and words."""
    side = window - prefix
    right = np.lexsort(r["right"].T[::-1])
    rank = np.empty(len(right), np.int64)
    rank[right] = np.cumsum(np.concatenate([[0], (r["right"][right][1:] != r["right"][right][:-1]).any(1)]))
    reach = np.zeros((side + 2, len(owner)), np.int64)
    for i in range(side + 1):
        ok = np.flatnonzero((r["lo"] >= i) & (r["hi"] >= side - i))
        if len(ok) < 2:
            continue
        order = ok[np.lexsort((rank[ok], *(r["left"][ok, j] for j in range(i)), r["h"][ok]))]
        before = (r["h"][order][1:] == r["h"][order][:-1]) & (r["left"][order][1:, :i] == r["left"][order][:-1, :i]).all(1)
        same = np.where(before, i + prefix + shared_words(r["right"][order], r["hi"][order]), 0)
        reach[i, order] = deepest(same, owner[order], window, window + i)
    new = (reach[:-1] > 0) & (reach[1:] < reach[:-1] + 1)  # not the rest of a repeat that begins a word earlier
    i, record = np.nonzero(new)
    return record, i, reach[i, record]


def _trees(window: int, prefix: int):
    side = window - prefix

    def run(table):
        r, docs = gathered(table, "record", 2)
        s, others = gathered(table, "suffix", 2)
        known, more = gathered(table, "late", 2)
        doc, span = [np.empty((0, 2), np.int64)], [np.empty(0, np.uint64)]
        if r:
            order = np.argsort(r["h"], kind="stable")
            edges, at = np.append(runs_of(r["h"][order]), len(order)), 0
            while at < len(order):
                stop = edges[max(np.searchsorted(edges, at + SUBTREES, "right") - 1, np.searchsorted(edges, at, "right"))]
                part = {c: wide(v[order[at:stop]]) if v.ndim > 1 else v[order[at:stop]] for c, v in r.items()}
                who = docs[part["doc"]]
                record, back, length = subtrees(part, who[:, 0], window, prefix)
                doc.append(who[record])
                span.append(_packed(part["pos"][record] - back, length))
                at = stop
        if s:
            words = wide(s["right"])
            step = np.arange(side)[None, :] + (s["depth"].astype(int) - prefix - s["behind"])[:, None]  # the words behind the prefix
            words = np.where(step < side, np.take_along_axis(words, np.minimum(step, side - 1), 1), 0)
            have = s["hi"].astype(int) - (s["depth"].astype(int) - prefix - s["behind"])
            order = np.lexsort((*words.T[::-1], s["depth"], s["h"]))
            here = (s["h"][order][1:] == s["h"][order][:-1]) & (s["depth"][order][1:] == s["depth"][order][:-1])
            same = np.where(here, s["depth"][order][1:] + shared_words(words[order], have[order]), 0)
            who = others[s["doc"][order]]
            length = deepest(same, who[:, 0], window, window + side)
            doc.append(who[length > 0])
            span.append(_packed(s["pos"][order][length > 0], length[length > 0]))
        if known:
            doc.append(more[known["doc"]])
            span.append(known["span"])
        doc, span = np.concatenate(doc), np.concatenate(span)
        rows, which = np.unique(doc, axis=0, return_inverse=True) if len(doc) else (doc, np.empty(0, np.int64))
        index, packed = _positions(which.reshape(-1), span)
        return pa.table({"doc_id": rows[index, 0], "tk": rows[index, 1], "at": pa.array(packed, pa.binary())})

    return run


def covered(words: Words, doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which words lie in the spans of `length` words from word `start` of text `doc` on."""
    step = np.zeros(len(words.h) + 1, np.int64)
    at = words.first[doc] + start
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    return np.cumsum(step)[:-1] > 0


def _spans(tk: list, late: list) -> list[np.ndarray]:
    none = np.empty(0, np.uint64)
    return [np.unique(np.frombuffer(b"".join(x["at"] for x in found if x["tk"] == k), "<u8")) if found else none for k, found in zip(tk, late, strict=True)]


def _finish(keep_text: bool):
    """Of row, text, tk, late: with keep_text the row and the text without the removed words, separators before them included;
    else the row, counts, the digest and the removed spans."""

    def run(batches):
        for batch in batches:
            repeats = _spans(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for row, data, offsets in text_runs(batch.column(1)):
                words, part = Words(data, offsets), repeats[row : row + len(offsets) - 1]
                flat = np.concatenate(part)
                gone = covered(words, np.repeat(np.arange(len(part)), [len(x) for x in part]), (flat >> np.uint64(8)).astype(np.int64), (flat & np.uint64(255)).astype(np.int64))
                n, lost, digest, spans, texts = [], [], [], [], []
                for i in range(len(part)):
                    lo, hi = words.first[i], words.first[i + 1]
                    out, s, e = gone[lo:hi], words.start[lo:hi], words.end[lo:hi]
                    n.append(hi - lo)
                    lost.append(int(out.sum()))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
                    if keep_text:
                        texts.append(_without(data[offsets[i] : offsets[i + 1]].tobytes(), s - offsets[i], e - offsets[i], edge) if len(edge) else None)
                        continue
                    kept = b" ".join(data[a:b].tobytes() for a, b in zip(s[~out], e[~out], strict=True)) if lost[-1] or hi - lo < 2 else _joined(data, s, e)
                    digest.append(hashlib.sha256(kept).hexdigest())
                    spans.append(edge.tolist())
                own = batch.column(0).slice(row, len(part))
                if keep_text:
                    old = batch.column(1).slice(row, len(part)).to_pylist()
                    yield pa.RecordBatch.from_arrays([own, pa.array([w if t is None else t.decode() for w, t in zip(old, texts, strict=True)], pa.string())], ["row", "text"])
                else:
                    yield pa.RecordBatch.from_arrays([own, pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(digest), pa.array(spans, pa.list_(pa.int64()))], ["row", "n_words", "n_removed", "kept_sha256", "spans"])

    return run


def _joined(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> bytes:
    """All words by one space."""
    return b" ".join(data[s[0] : e[-1]].tobytes().split())  # bytes.split() knows the same six separators


def _without(text: bytes, s: np.ndarray, e: np.ndarray, edge: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        out.append(text[at : e[a - 1] if a else s[0]])
        at = e[b - 1]
    return b"".join([*out, text[at:]])


def repeats(docs: DataFrame, others: list[str], window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """row (a struct of the columns `others`), text, tk (text key) and late: the maximal repeats of each text that a smaller doc_id has too, as a list of tk and packed spans."""
    spark = docs.sparkSession
    size = text_bytes(docs)
    groups, tasks = groups_for(size, GROUP_BYTES, LEAST_GROUPS), tasks_for(size)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    limit = max(HOT, size // 8 // MOST_HOT)  # a record needs a word, its separator and, on average, as much again
    met = cut(by_bucket(rows.mapInArrow(_send_anchors(groups, window, prefix), BLOB), groups).applyInArrow(_meet(limit), "doc_id long, at binary"), "anchors")
    found = b"".join(r["at"] for r in met.where("doc_id is null and length(at) > 0").select("at").toLocalIterator())
    often = np.frombuffer(found, np.uint64).reshape(-1, 2)
    often = often[np.argsort(often[:, 0])]
    hot = spark.sparkContext.broadcast((often[:, 0].copy(), often[:, 1].astype(float)))
    kept = [F.col(f"`{c}`") for c in others]
    whole = docs.select(F.struct(*kept).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    whole = whole.withColumn("tk", F.coalesce(F.xxhash64("text"), F.lit(0)))
    named = whole.where("id is not null").repartition(tasks, "id")
    lists = met.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("at").alias("at"))
    joined = named.join(lists, "id").select("id", "tk", F.coalesce("text", F.lit("")).alias("text"), "at")
    late = by_bucket(joined.mapInArrow(_send_suffixes(groups, window, prefix, limit, hot), BLOB), groups).applyInArrow(_trees(window, prefix), "doc_id long, tk long, at binary")
    late = late.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("tk", "at")).alias("late"))
    out = named.join(late, "id", "left").select("row", "text", "tk", "late")
    return out.unionByName(whole.where("id is null").select("row", "text", "tk", F.lit(None).cast(out.schema["late"].dataType).alias("late")))


def removed_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and spans: the removed words as positions start, end, start, end, ..."""
    found = repeats(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"], window)
    out = found.mapInArrow(_finish(False), "row struct<doc_id:bigint>, n_words long, n_removed long, kept_sha256 string, spans array<long>")
    return out.select("row.doc_id", "n_words", "n_removed", "kept_sha256", "spans")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, in which each text has lost the words of windows that a smaller doc_id has too."""
    others = [c for c in docs.columns if c != "text"]
    found = repeats(docs, others, window)
    kind = found.select("row", "text").schema
    out = found.mapInArrow(_finish(True), kind)
    return out.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
