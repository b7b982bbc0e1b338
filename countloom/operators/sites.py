"""Contexts of sites: the letters around positions, by an equi-join of sites to the chunk that holds them; and what follows from contexts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from . import chunks

#: Contigs that may be sent to every task to leave the others unread.
MOST_SENT = 1_000_000


def windows_at(texts: DataFrame, sites: DataFrame, contig: str, text: str, half: int, width: int | None = None) -> DataFrame:
    """sites (contig, pos from 0, ...) with raw (the letters from pos - half to pos + half that lie in the contig), left and right (how many lie outside). Sites outside
    of their contig, or of a contig that texts don't have, have no row. A contig's sites are dealt by chunk, so a hot contig is many tasks."""
    width = width or chunks.WIDTH
    asked = sites.select(contig).distinct()
    texts = texts.join(F.broadcast(asked) if asked.count() <= MOST_SENT else asked, contig, "left_semi")
    whole = chunks.of_texts(texts, text, [contig], half, width)
    rows = sites.where("pos >= 0").withColumn("core_start", F.col("pos") - F.col("pos") % width).join(whole, [contig, "core_start"])
    start = F.greatest(F.col("pos") - half, F.lit(0))
    at = F.col("pad_left") - F.col("core_start") + start + 1
    raw = F.substring("bases", at.cast("int"), (F.col("pos") + half + 1 - start).cast("int"))
    rows = rows.where(F.col("pos") < F.col("core_start") + F.col("size")).withColumn("raw", raw).withColumn("left", (half - F.col("pos") + start).cast("int"))
    return rows.withColumn("right", (2 * half + 1 - F.col("left") - F.length("raw")).cast("int")).select(*sites.columns, "raw", "left", "right")


def folded(c: Column) -> Column:
    """A, C, G and T in upper case; every other letter is N."""
    return F.regexp_replace(sc.fold_bases(c), "[^ACGT]", "N")


def oriented(raw: Column, left: Column, right: Column, strand: Column) -> Column:
    """The context along the strand, N outside of the contig."""
    whole = F.concat(F.repeat(F.lit("N"), left), folded(raw), F.repeat(F.lit("N"), right))
    return F.when(strand == "-", sc.reverse_complement(whole)).otherwise(whole)


def contexts(texts: DataFrame, sites: DataFrame, contig: str, text: str, half: int, width: int | None = None) -> DataFrame:
    """sites (contig, pos, strand, ...) with context: half letters each way, read along the strand, N outside of the contig."""
    rows = windows_at(texts, sites, contig, text, half, width)
    return rows.select(*sites.columns, oriented(F.col("raw"), F.col("left"), F.col("right"), F.col("strand")).alias("context"))


def offset_letters(rows: DataFrame, half: int, keys: list[str]) -> DataFrame:
    """keys, at, base: a row for each offset of each context."""
    letters = F.filter(F.split("context", ""), lambda c: c != "")
    return rows.select(*keys, F.posexplode(letters).alias("_i", "base")).select(*keys, (F.col("_i") - half).cast("long").alias("at"), "base")


#: Rows whose letters a task lays side by side.
ROWS = 512
#: Marks of a byte of UTF-8 in one number: G and C, bases, lower-case bases; no window holds more letters than a field.
FIELD = 21
MARKS = np.zeros(256, np.int64)
for _place, _letters in enumerate((b"CGcg", b"ACGTacgt", b"acgt")):
    MARKS[list(_letters)] += 1 << FIELD * _place


def composition(rows: DataFrame, widths: list[int], most: int) -> DataFrame:
    """Of windows_at(half=most): the sites' columns and a row for each width: edge (whether the window leaves the contig), n, gc, valid and lower letters of it. All windows of a
    site are differences of the same running sums over its letters."""
    if most >= 1 << FIELD - 1:
        raise ValueError(f"windows of {2 * most + 1} letters are too long")
    kept = [c for c in rows.columns if c not in ("raw", "left", "right")]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                raw = part.column(len(kept)).cast(pa.large_string())
                ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
                data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
                ends, begins = ends - ends[0], data & 0xC0 != 0x80  # bytes that begin a character
                if not begins.all():
                    ends, data = np.concatenate([[0], np.cumsum(begins)])[ends], data[begins]
                total = np.concatenate([[0], np.cumsum(MARKS[data])])
                centre = ends[:-1] + most - part.column(len(kept) + 1).to_numpy()
                low, high = (np.concatenate(x) for x in zip(*((np.maximum(centre - w // 2, ends[:-1]), np.minimum(centre + w // 2 + 1, ends[1:])) for w in widths), strict=True))
                found, n, width = total[high] - total[low], high - low, np.repeat(widths, len(raw))
                fields = [found >> FIELD * i & (1 << FIELD) - 1 for i in range(3)]
                again = np.tile(np.arange(len(raw)), len(widths))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(again)) for c in part.columns[: len(kept)]), *map(pa.array, (width, n < width, n, *fields))], [*kept, "width", "edge", "n", "gc", "valid", "lower"])

    kind = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in kept)
    return rows.select(*kept, "raw", "left").mapInArrow(run, f"{kind}width long, edge boolean, n long, gc long, valid long, lower long")
