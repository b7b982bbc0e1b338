"""Text files whose line numbers matter: numbered lines, sequence records, dense values, ordered output."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ranks
from ..operators.intervals import checked_lengths
from ..operators.pins import pinned, tasks_for


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value), line_no from 0 in each file, for plain files (dealt by byte ranges) and gzip files (one task each).

    Spark numbers the rows of a task one by one, so a line's place in its byte range is its number less the
    range's smallest; ranges of a file are then added up in the order of their first byte. No window sees lines."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    rows = pinned(read)
    blocks = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    starts = ranks.cumulative(blocks, [F.asc("block")], {"upto": F.col("n")}, ["file"]).select("file", "block", "first", (F.col("upto") - F.col("n")).alias("before"))
    return rows.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first")).alias("line_no"), "value")


def dense_values(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """(line_no, value) of the non-zero lines of one file with a number a line; raises when a line is no number or the length is not the expected one."""
    rows = numbered(spark, path).select("line_no", "value", F.expr("try_cast(trim(value) as double)").alias("number"))
    facts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("number").isNull()).alias("bad")).head()
    if facts.bad or (expected is not None and facts.n != expected):
        raise ValueError(f"{facts.n} lines, {facts.bad} of them no number; expected {expected}")
    return rows.where("number > 0").select("line_no", F.col("number").alias("value"))


def in_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the lines of plain or gzip files with the first byte of the byte range that they were read in; a task reads each range in order."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


#: Lines of a record that travel as one row.
TOGETHER = 128
NAME = re.compile(r"^>\s*(\S*)", re.ASCII)


def parts_of(batches, weigh, together: int | None = None):
    """Of batches of in_blocks(): the columns file, block, head (whether the part is a header line; else it is successive lines of one record, at most `together`), place (weight of the
    block's lines before the part), origin (that before the record's first line) and contig, both null where the record began in a block before; then the lines, their weights, and the
    number of each part's first line. Lines are cut into parts at headers, blocks and ends of batches; weigh gives their weights."""
    here, total, base, origin, name = None, 0, 0, None, None
    for b in batches:
        if not b.num_rows:
            continue
        lines, head = b.column(2).cast(pa.large_string()), pc.starts_with(b.column(2), ">").to_numpy(zero_copy_only=False)
        weights = weigh(lines, head)
        new = np.ones(len(lines), bool)
        new[1:] = pc.not_equal(b.column(0)[1:], b.column(0)[:-1]).to_numpy(zero_copy_only=False) | np.diff(b.column(1).to_numpy()).astype(bool)
        new[0] = here != (b.column(0)[0], b.column(1)[0])
        here = b.column(0)[-1], b.column(1)[-1]
        cut = new | head
        cut[1:] |= head[:-1]
        cut[:: together or len(lines)] = True
        first = np.flatnonzero(cut)
        head, new, number = head[first], new[first], np.arange(len(first))
        upto = total + np.cumsum(np.add.reduceat(weights, first))
        at = np.concatenate([[total], upto[:-1]])
        block, record = (np.maximum.accumulate(np.where(x, number, -1)) for x in (new, head))
        bases = np.where(block >= 0, at[block], base)
        known = np.where(record >= 0, record >= block, (block < 0) & (origin is not None))
        origins = np.where(record >= 0, upto[record], origin or 0)
        names = pa.array([name, *(NAME.match(x).group(1) for x in lines.take(pa.array(first[head])).to_pylist())], pa.string())
        contig = names.take(pa.array(np.cumsum(head), mask=~known))
        columns = [b.column(0).take(pa.array(first)), b.column(1).take(pa.array(first)), pa.array(head), pa.array(at - bases), pa.array(origins - bases, mask=~known), contig]
        total, base, origin, name = int(upto[-1]), int(bases[-1]), int(origins[-1]) if known[-1] else None, contig[-1].as_py()
        yield columns, lines, weights, first


PART = "file string, block long, head boolean, place long, origin long, contig string"
PART_NAMES = ["file", "block", "head", "place", "origin", "contig"]


def carried(parts: DataFrame, end: Column, last: dict[str, Column]) -> DataFrame:
    """parts with before (weight of the file before the block), _origin and _contig (of the record that the block begins in, null for none), and the values `last` of the
    last part of the block before. end: the weight of the block up to the end of the part."""
    found = [F.max_by(c, "place").alias(k) for k, c in last.items()]
    blocks = parts.groupBy("file", "block").agg(F.max(end).alias("_n"), F.max("origin").alias("_last"), F.max_by("contig", "origin").alias("_name"), *found)
    ahead = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # one row a block
    blocks = blocks.withColumn("before", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    origin, contig = F.last(F.col("before") + F.col("_last"), True).over(ahead), F.last("_name", True).over(ahead)
    step = W.partitionBy("file").orderBy("block")
    blocks = pinned(blocks.select("file", "block", "before", origin.alias("_origin"), contig.alias("_contig"), *(F.lag(k).over(step).alias(k) for k in last)))
    return parts.join(F.broadcast(blocks) if blocks.count() <= ranks.MOST_SENT else blocks, ["file", "block"])


def _pieces(batches):
    def letters(lines, head):
        return np.where(head, 0, pc.utf8_length(lines).to_numpy(zero_copy_only=False))

    for columns, lines, weights, first in parts_of(batches, letters, TOGETHER):
        ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
        bases = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends[np.append(first, len(lines))]), lines.buffers()[2])
        size = np.add.reduceat(weights, first)
        columns += [pa.array(size), pc.if_else(columns[2], pa.scalar("", pa.large_string()), bases).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*PART_NAMES, "size", "bases"]).filter(pc.or_(columns[2], pa.array(size > 0)))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, bases): the sequence of '>'-headed records in pieces of at most TOGETHER lines, with their place in the record. Letter case is kept.

    Raises for sequence before a header, empty records and repeated names."""
    lines = in_blocks(spark, path).withColumn("value", F.trim("value"))
    parts = pinned(lines.mapInArrow(_pieces, f"{PART}, size long, bases string"))
    rows = carried(parts, F.col("place") + F.col("size"), {})
    rows = rows.withColumn("start", F.col("place") - F.coalesce("origin", F.col("_origin") - F.col("before"))).withColumn("contig", F.coalesce("contig", "_contig"))
    sizes = rows.groupBy("contig").agg(F.count_if("head").alias("heads"), F.sum("size").alias("size"))
    bad = {"sequence before a header": F.col("contig").isNull(), "empty record": F.col("size") == 0, "repeated or empty name": (F.col("heads") > 1) | (F.col("contig") == "")}
    for what, n in zip(bad, sizes.agg(*map(F.count_if, bad.values())).head(), strict=True):
        if n:
            raise ValueError(what)
    return rows.where(~F.col("head")).select("contig", "start", "bases")


def chunks(lines: DataFrame, width: int, halo: int) -> DataFrame:
    """(contig, chunk_id, core_start, core_end, pad_left, bases) from (contig, start, bases).

    bases covers the core and up to halo letters on both sides. A group is one chunk, so a long contig is many groups; it ends within its core or halo where the contig does."""
    end = F.col("start") + F.length("bases")
    first, last = F.greatest(F.lit(0), F.floor((F.col("start") - halo) / width)), F.floor((end - 1 + halo) / width)
    dealt = lines.withColumn("chunk_id", F.explode(F.sequence(first, last)))
    low, high = F.col("chunk_id") * width - halo, (F.col("chunk_id") + 1) * width + halo
    skip = F.greatest(F.lit(0), low - F.col("start"))
    piece = F.col("bases").substr((skip + 1).cast("int"), (F.least(end, high) - F.col("start") - skip).cast("int"))
    pieces = dealt.select("contig", "chunk_id", F.greatest("start", low).alias("at"), F.least(end, high).alias("stop"), piece.alias("piece"))
    rows = pieces.groupBy("contig", "chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("bases"), F.min("at").alias("low"), F.max("stop").alias("stop"))
    start = F.col("chunk_id") * width
    return rows.where(start < F.col("stop")).select("contig", "chunk_id", start.alias("core_start"), F.least(start + width, F.col("stop")).alias("core_end"), (start - F.col("low")).alias("pad_left"), "bases")


def alphabet(chunked: DataFrame) -> DataFrame:
    """(letter, n) over the cores of chunks."""
    core = F.col("bases").substr((F.col("pad_left") + 1).cast("int"), (F.col("core_end") - F.col("core_start")).cast("int"))
    return chunked.select(F.explode(F.split(core, "")).alias("letter")).where("letter <> ''").groupBy("letter").agg(F.count("*").alias("n"))


def write_ordered(rows: DataFrame, order: list[Column], value: Column, path: str, compression: str = "gzip") -> None:
    """One line a row, in order over the part files by name; gzip members of such parts may be concatenated."""
    rows.repartitionByRange(tasks_for(rows), *order).sortWithinPartitions(*order).select(value.alias("value")).write.text(path, compression=compression)


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) over all part files of write_ordered, by file name."""
    rows = pinned(numbered(spark, path))
    files = rows.groupBy("file").agg(F.count("*").alias("n"))
    before = ranks.cumulative(files, [F.asc("file")], {"upto": F.col("n")}).select("file", (F.col("upto") - F.col("n")).alias("before"))
    return rows.join(before, "file").select((F.col("before") + F.col("line_no")).alias("line_no"), "value")


def sequence_index(records: DataFrame, order: str, length: str, line: int) -> DataFrame:
    """contig, length, byte_offset (of the first base), line_bases, line_bytes of records `>name`, then lines of `line` bases, in the order of a key that is also the name."""
    name = F.col(order).cast("string")
    body = F.col(length) + F.ceil(F.col(length) / line)
    rows = records.select(F.col(order).alias("_key"), name.alias("contig"), F.col(length).cast("long").alias("length"), body.alias("_body"), (F.length(name) + 2 + body).alias("_bytes"))
    out = ranks.cumulative(rows, [F.asc("_key")], {"_end": F.col("_bytes")})
    return out.select("contig", "length", (F.col("_end") - F.col("_body")).cast("long").alias("byte_offset"), F.lit(line).cast("long").alias("line_bases"), F.lit(line + 1).cast("long").alias("line_bytes"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated sequence index; ValueError if it is empty, repeats a contig or has a length that is not positive."""
    return checked_lengths(spark.read.schema("contig string, length long, byte_offset long, line_bases long, line_bytes long").option("sep", "\t").csv(path))
