"""Sequence files with an index: an index built from the files, and contexts read by byte ranges.

Ranges are planned in Spark: sites meet the index by contig, get the bytes of their letters, and are dealt to tasks in the order of file and first byte. A task joins
ranges that lie near each other and reads those bytes only, so what is read goes with the regions asked for, not with the files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import checked_lengths
from ..operators.pins import pinned
from ..operators.sites import oriented
from .lines import PART, PART_NAMES, carried, in_blocks, parts_of

#: Bytes between two ranges that are read with them, and of one read.
GAP, MOST_READ = 1 << 12, 1 << 24


#: Records that a task writes out at once.
ROWS = 64


def _written(line: int, letters: np.ndarray | None):
    def one(name: str, text: str) -> bytes:
        if letters is None:
            data = np.frombuffer(text.encode("ascii"), np.uint8)
        else:
            data = letters[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 127)]
            data = data[data > 0]
        whole = len(data) // line * line
        rows = np.full((whole // line, line + 1), 10, np.uint8)
        rows[:, :line] = data[:whole].reshape(-1, line)
        out = rows.tobytes() + data[whole:].tobytes()
        return b">" + name.encode() + b"\n" + (out if whole < len(data) else out[:-1])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                names, texts = (c.to_pylist() for c in b.slice(at, ROWS).columns)
                yield pa.RecordBatch.from_arrays([pa.array([one(*x) for x in zip(names, texts, strict=True)], pa.binary()).cast(pa.string())], ["value"])

    return run


def letters_as(kept: str, other: str = "") -> np.ndarray:
    """Letters for write_sequences(): `kept` stay, every other character is `other`, or left out."""
    out = np.full(128, ord(other) if other else 0, np.uint8)
    out[[ord(c) for c in kept]] = [ord(c) for c in kept]
    return out


def write_sequences(df: DataFrame, name: str, bases: str, path: str, line: int = 60, letters: np.ndarray | None = None) -> None:
    """Records of df as text files: '>name', then lines of `line` letters. letters: what is written for each character below 127, and at 127 for all others; 0 leaves it out.
    Without it, letters must be ASCII without line breaks. Rows without a name or letters (null) have no record."""
    rows = df.select(F.col(name).cast("string").alias("name"), F.col(bases).alias("bases")).where("name is not null and bases is not null")
    rows.mapInArrow(_written(line, letters), "value string").write.text(path)


def _parts(batches):
    def size(lines, head):
        return pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) + 1

    most, before = np.iinfo(np.int64).max, None
    for columns, lines, weights, first in parts_of(batches, size):
        head, last = columns[2].to_numpy(zero_copy_only=False), np.append(first[1:], len(lines)) - 1
        whole, longest = np.add.reduceat(weights, first), np.maximum.reduceat(weights, first)
        inner = weights.copy()
        inner[last] = most
        inner = np.minimum.reduceat(inner, first)
        if before is not None and columns[3][0].as_py() > 0:
            inner[0] = min(inner[0], before)
        before = None if head[-1] else int(weights[-1])
        body = lambda x, none=False, head=head: pa.array(x, mask=head | none)
        columns += [pa.array(whole), body(whole - (last - first + 1)), body(longest), body(inner, inner == most), body(weights[last])]
        yield pa.RecordBatch.from_arrays(columns, [*PART_NAMES, "bytes", "letters", "longest", "inner", "final"])


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """file, contig, length, byte_offset (of the first letter), line_bases, line_bytes of every record of plain sequence files. ValueError where the lines of a record, but for its
    last, differ in length, where there is sequence before a header, and where a name is empty or repeated."""
    parts = pinned(in_blocks(spark, path).mapInArrow(_parts, f"{PART}, bytes long, letters long, longest long, inner long, final long"))
    rows = carried(parts, F.col("place") + F.col("bytes"), {"_final": F.col("final")})
    before = F.when(~F.col("head") & (F.col("place") == 0), F.col("_final"))  # a line that another block's line follows
    rows = rows.select("file", F.coalesce(F.col("before") + F.col("origin"), "_origin").alias("byte_offset"), F.coalesce("contig", "_contig").alias("contig"), "letters", "longest", F.least("inner", before).alias("inner"))
    index = pinned(rows.groupBy("file", "byte_offset").agg(
        F.max("contig").alias("contig"), F.coalesce(F.sum("letters"), F.lit(0)).alias("length"), F.coalesce(F.max("longest"), F.lit(1)).alias("line_bytes"), F.min("inner").alias("inner"),
    ))
    facts = index.agg(F.count_if(F.col("byte_offset").isNull()).alias("loose"), F.count_if(F.col("inner") < F.col("line_bytes")).alias("ragged")).head()
    if facts.loose:
        raise ValueError("sequence before a header")
    if facts.ragged:
        raise ValueError("lines of a record differ in length")
    if not index.groupBy("contig").count().where("count > 1 or contig = ''").isEmpty():
        raise ValueError("repeated or empty name")
    return checked_lengths(index.where("length > 0").select("file", "contig", "length", "byte_offset", (F.col("line_bytes") - 1).alias("line_bases"), "line_bytes"))


def merged_ranges(ranges: list[tuple[int, int]], gap: int, most: int):
    """(first, stop, how many) of reads that cover ranges, which come by their first byte: near ones together, up to `most` bytes."""
    at = 0
    while at < len(ranges):
        first, stop = ranges[at]
        n = at + 1
        while n < len(ranges) and ranges[n][0] <= stop + gap and max(stop, ranges[n][1]) - first <= most:
            stop = max(stop, ranges[n][1])
            n += 1
        yield first, stop, n - at
        at = n


def _reader(columns: int, gap: int, most: int):
    """Of batches whose columns at `columns` and after are file, first and stop: the leading columns, raw (the letters of the range) and bytes_read (of the whole read, at its first range; else 0)."""

    def run(batches):
        from pyarrow import fs

        opened: dict = {}
        for b in batches:
            files, first, stop = (b.column(columns + i).to_pylist() for i in range(3))
            raw, read, at = [], [], 0
            while at < len(files):
                same = at
                while same < len(files) and files[same] == files[at]:
                    same += 1
                if files[at] not in opened:
                    opened.clear()
                    where, path = fs.FileSystem.from_uri(files[at])
                    opened[files[at]] = where.open_input_file(path)
                ranges = list(zip(first[at:same], stop[at:same], strict=True))
                for lo, hi, n in merged_ranges(ranges, gap, most):
                    data = opened[files[at]].read_at(hi - lo, lo)
                    for k in range(at, at + n):
                        raw.append(data[first[k] - lo : stop[k] - lo].replace(b"\n", b"").decode("ascii"))
                        read.append(hi - lo if k == at else 0)
                    at += n
            yield pa.RecordBatch.from_arrays([*b.columns[:columns], pa.array(raw, pa.string()), pa.array(read, pa.int64())], [*b.schema.names[:columns], "raw", "bytes_read"])

    return run


def indexed_contexts(index: DataFrame, sites: DataFrame, half: int, gap: int = GAP, most: int = MOST_READ) -> DataFrame:
    """sites (contig, pos from 0, strand, ...) with context (half letters each way along the strand, N outside of the contig) and bytes_read. Sites outside of their contig, or of a contig
    that the index doesn't have, have no row."""
    rows = sites.join(index, "contig").where("pos >= 0 and pos < length")
    lo, hi = F.greatest(F.col("pos") - half, F.lit(0)), F.least(F.col("pos") + half, F.col("length") - 1)
    byte = lambda p: F.col("byte_offset") + F.floor(p / F.col("line_bases")) * F.col("line_bytes") + p % F.col("line_bases")
    left, right = (lo - F.col("pos") + half).cast("int"), (F.col("pos") + half - hi).cast("int")
    rows = rows.select(*sites.columns, left.alias("left"), right.alias("right"), "file", byte(lo).alias("first"), (byte(hi) + 1).alias("stop"))
    rows = rows.repartitionByRange("file", "first").sortWithinPartitions("file", "first")
    names = [*sites.columns, "left", "right"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    rows = rows.mapInArrow(_reader(len(names), gap, most), f"{kind}, raw string, bytes_read long")
    return rows.select(*sites.columns, oriented(F.col("raw"), F.col("left"), F.col("right"), F.col("strand")).alias("context"), "bytes_read")
