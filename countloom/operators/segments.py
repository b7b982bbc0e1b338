"""Runs of letters of one kind over chunks of sequences. Runs that meet the edge of a chunk are joined to their neighbours by a two-level scan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks
from .chunks import NAMES
from .counts import RUN, _arrow, _rows, _schema
from .pins import pinned

KINDS = ["upper", "lower", "other"]
KIND = np.full(128, 2, np.int8)
KIND[[ord(c) for c in "ACGT"]] = 0
KIND[[ord(c) for c in "acgt"]] = 1


def segments(chunked: DataFrame, contig: str) -> DataFrame:
    """contig, start, end, kind of every run of upper-case bases, of lower-case ones, and of other letters, from chunks (keys contig, halo 0) of whole contigs."""
    kinds = _arrow(chunked, [contig])

    def found(rows, edges):
        points = np.frombuffer("".join(r[-1] for r in rows).encode("utf-32-le"), np.uint32)
        kind = KIND[np.minimum(points, 127)]
        size, start = np.array([len(r[-1]) for r in rows]), np.array([r[1] for r in rows], np.int64)
        edge = np.concatenate([[0], np.cumsum(size)])
        new = np.concatenate([[True], kind[1:] != kind[:-1]])
        new[edge[:-1]] = True
        first = np.flatnonzero(new)
        stop = np.append(first[1:], len(kind))
        owner = np.repeat(np.arange(len(rows)), np.add.reduceat(new, edge[:-1], dtype=np.int64))
        touches = (stop == edge[owner + 1]) | (first == edge[owner]) & (start[owner] > 0)  # the neighbour may go on; before the first letter there is none
        kept = np.flatnonzero(touches == edges)
        first, stop, owner = first[kept], stop[kept], owner[kept]
        shift = (start - edge[:-1])[owner]
        who = pa.array([r[0] for r in rows], kinds.field(0).type).take(pa.array(owner))
        return pa.RecordBatch.from_arrays([who, pa.array(first + shift), pa.array(stop + shift), pa.array(kind[first].astype(np.int32))], [contig, "start", "end", "code"])

    def run(edges):
        """Runs that touch an edge, or the others, which are final. The texts are read for each: the final ones are many and are not written in between."""

        def each(batches):
            rows, size = [], 0
            for row in _rows(batches):
                rows.append(row)
                size += len(row[-1])
                if size >= RUN:
                    yield found(rows, edges)
                    rows, size = [], 0
            if rows:
                yield found(rows, edges)

        return chunked.select(contig, *NAMES).mapInArrow(each, _schema(chunked, [contig], "start long, end long, code int"))

    inner, edges = run(False), pinned(run(True))
    before = edges.select(F.col(contig).alias("_c"), F.col("end").alias("_e"), F.col("code").alias("_k"))
    edges = edges.join(before, (F.col(contig) == F.col("_c")) & (F.col("start") == F.col("_e")) & (F.col("code") == F.col("_k")), "left")
    edges = edges.select(contig, "start", "end", "code", F.col("_c").isNull().cast("long").alias("_new"))
    edges = ranks.cumulative(edges, [F.asc("start")], {"_run": F.col("_new")}, [contig])
    joined = edges.groupBy(contig, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("code").alias("code")).drop("_run")
    out = inner.unionByName(joined)
    return out.select(contig, "start", "end", F.element_at(F.array(*map(F.lit, KINDS)), F.col("code") + 1).alias("kind"))
