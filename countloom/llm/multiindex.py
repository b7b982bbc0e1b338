"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, are fitted on at most SAMPLE vectors, or POINTS for each code where that is more (those with
the least hashes of their contents); pairs of their entries form a grid of cells, and every vector is filed
in one cell. A vector visits cells by rising sum of the two half distances. How many is set by brute force: of
at most PROBES vectors, outside the fitted sample where there are others, against all vectors, each must find
the share `target` of its own true links, if need be in all cells; where few probes have links, copies of
probes turned to just that cosine stand in for them. At least LEAST_CELLS are visited. Visited
vectors are compared in double precision.

A pair in two cells is the business of the vector in the cell with the smaller number, so it is compared
once and a vector is sent only to later cells, once for each group of cells of one left code. Vectors travel
in the precision that they came in. Equal vectors are one entry with a count. Groups are split into blocks of
bounded size, and a block returns counts and a spanning forest, not pairs. Exact counts of links inside a
dense cell take work with the square of its different vectors; that work is spread over blocks.

Nulls and odd rows: vectors link only with others of their length; those that are null, empty, zero, or hold null or
non-finite components link with nothing; so do rows with a null vec_id, whose component is null; rows
that repeat id and vector are one vector, rows that repeat an id with other vectors share a component;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MOST_SENT, by_bucket, connected_components, cut, mix, spread_join

#: Vectors to fit on at least, and for each code; probes; cells to visit at least; linked probes to go by at least.
SAMPLE, POINTS, PROBES, LEAST_CELLS, LEAST_LINKED = 8192, 16, 1024, 8, 32
#: Vectors of a cell. Codes of a half: beyond 64 million vectors cells grow instead.
CELL, MOST_CODES = 64, 1024
#: Vectors of a block, and of a matrix product in it.
INDEX_BLOCK, QUERY_BLOCK, TILE = 1 << 15, 1 << 16, 2048
VISITS = 1 << 16  # made at once
KEYED, MET = "vec_id long, same binary", "rep long, links long, to long"


def _valid(dim: int, vectors: bool):
    """vec_id, same (a digest of the vector) and, if asked for, its bytes."""

    def run(batches):
        for b in batches:
            column = b.column(1)
            at = np.flatnonzero((pc.fill_null(pc.list_value_length(column), -1).to_numpy() == dim) & b.column(0).is_valid().to_numpy(zero_copy_only=False))
            raw = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            fine = np.isfinite(raw).all(1) & (raw != 0).any(1)
            at, raw = at[fine], raw[fine]
            keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in raw.astype(float) + 0.0]
            out = [b.column(0).take(pa.array(at)), pa.array(keys, pa.binary())]
            if vectors:
                out.append(pa.array([x.tobytes() for x in raw], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, ["vec_id", "same", "raw"][: len(out)])

    return run


def units(column, kind: str) -> np.ndarray:
    """Unit vectors, in double precision, of a column of vectors' bytes."""
    x = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


def fit_codebook(points: np.ndarray, codes: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly spaced starts; empty codes keep their place."""
    book = points[np.linspace(0, len(points) - 1, codes).astype(int)].copy()
    for _ in range(rounds):
        near = distances(points, book).argmin(1)
        n = np.bincount(near, minlength=codes)
        total = np.zeros_like(book)
        np.add.at(total, near, points)
        book[n > 0] = total[n > 0] / n[n > 0, None]
    return book


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1), 0)


def nearest_cells(x: np.ndarray, books: tuple, cells: int) -> np.ndarray:
    """The multi-sequence: of each row, cells (left code * codes + right code) by rising sum of half distances.

    A cell that is i-th by its left half and j-th by its right half has i * j cells that are no farther, so only
    those with i * j <= cells are ordered."""
    codes = len(books[0])
    order, value = zip(*((d.argsort(1, kind="stable"), np.sort(d, 1)) for d in (distances(h, b) for h, b in zip(halves(x), books, strict=True))), strict=True)
    i, j = np.nonzero(np.outer(np.arange(1, codes + 1), np.arange(1, codes + 1)) <= cells)
    total = value[0][:, i] + value[1][:, j]
    best = total.argsort(1, kind="stable")[:, :cells]
    return np.take_along_axis(order[0], i[best], 1) * codes + np.take_along_axis(order[1], j[best], 1)


def _hits(probes: np.ndarray, keys: list[bytes], homes: np.ndarray, books, least: float, kind: str):
    """True links of the probes that are theirs to find, without a probe's own copies: how many lie in each cell."""
    names = np.array(keys, "S16")

    def run(batches):
        for b in filter(len, batches):
            y, same = units(b.column(2), kind), np.array(b.column(1).to_pylist(), "S16")
            near = (probes @ y.T >= least) & (names[:, None] != same[None, :])
            some = np.flatnonzero(near.any(0))
            if len(some):
                cell = np.concatenate([nearest_cells(y[part], books, 1)[:, 0] for part in np.array_split(some, -(-len(some) // TILE))])
                q, at = np.nonzero(near[:, some] & (homes[:, None] <= cell[None, :]))
                pairs, n = np.unique(np.stack([q, cell[at]], 1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int32()), pa.array(pairs[:, 1], pa.int32()), pa.array(n, pa.int64())], ["probe", "cell", "n"])

    return run


def cells_needed(probe: np.ndarray, home: int, cell: np.ndarray, n: np.ndarray, books, target: float) -> int:
    """How many cells a probe must visit to reach the share `target` of its links, of which n lie in each cell; its own cell takes no visit."""
    codes = len(books[0])
    rank = np.empty(codes * codes, int)
    rank[nearest_cells(probe[None, :], books, codes * codes)[0]] = np.arange(1, codes * codes + 1)
    rank[home] = 0
    order = rank[cell].argsort()
    reached = n[order].cumsum()
    return int(rank[cell][order][(reached >= target * reached[-1]).argmax()])


def _needed(probes: np.ndarray, homes: np.ndarray, books, target: float):
    def run(table):
        q = table.column("probe")[0].as_py()
        return pa.table({"cells": pa.array([cells_needed(probes[q], homes[q], table.column("cell").to_numpy(), table.column("n").to_numpy(), books, target)], pa.int32())})

    return run


def turned(x: np.ndarray, cosine: float) -> np.ndarray:
    """Unit vectors at just that cosine to those of x, in random directions."""
    noise = np.random.Generator(np.random.PCG64(11)).normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    return cosine * x + (1 - cosine * cosine) ** 0.5 * noise / np.sqrt((noise * noise).sum(1, keepdims=True))


def _file(books, cells: int, kind: str):
    """Each vector with its cell and the later cells that it visits."""

    def run(batches):
        for b in batches:
            step = max(1, min(TILE, VISITS // cells))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                near = nearest_cells(units(part.column(2), kind), books, cells)
                home = near[:, 0]
                later = near > home[:, None]
                visits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], later.sum(1).cumsum()]), pa.int32()), pa.array(near[later], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(home, pa.int32()), visits], ["rep", "n", "raw", "cell", "visits"])

    return run


def grouped(cells: dict[int, int], codes: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """group of each cell (-1 where it is empty): runs of cells of one left code with at most `block` vectors, or one larger cell; and the blocks of each group."""
    group, blocks, left, held = np.full(codes * codes, -1, np.int32), [], -1, 0
    for cell in sorted(cells):
        if cell // codes != left or held + cells[cell] > block:
            blocks.append(max(1, -(-cells[cell] // block)))
            left, held = cell // codes, 0
        group[cell] = len(blocks) - 1
        held += cells[cell]
    return group, np.array(blocks, np.int64)


def _asked(visits, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, group and cell of each visit to a cell that is not empty, by row and group."""
    row = np.repeat(np.arange(len(visits)), pc.list_value_length(visits).to_numpy())
    cell = visits.flatten().to_numpy()
    order = np.lexsort((cell, group[cell], row))
    row, cell = row[order], cell[order]
    full = group[cell] >= 0
    return row[full], group[cell[full]], cell[full]


def _ask(plan):
    """How many vectors visit each group from outside."""

    def run(batches):
        group, _ = plan.value
        for b in batches:
            row, g, _ = _asked(b.column(1), group)
            outside = g != group[b.column(0).to_numpy()][row]
            asked, n = np.unique(np.unique(np.stack([row, g])[:, outside], axis=1)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int32()), pa.array(n, pa.int64())], ["g", "n"])

    return run


BLOCKS = "bucket int, side int, rep long, n long, raw binary, cell int, visits array<int>"


def _deal(plan):
    """Rows of each block (index part i and query part q of a group): side 0 vectors of the group, which are also queries; 2 vectors for other queries only; 1 queries."""

    def run(batches):
        group, ib, qb = plan.value
        base = np.cumsum(ib * qb) - ib * qb
        for b in batches:
            cell, visits = b.column(3).to_numpy(), b.column(4)
            home, h = group[cell], mix(b.column(0).to_numpy().astype(np.uint64))
            i_own, q_own = (h % ib[home].astype(np.uint64)).astype(int), lambda g, rows: (h[rows] % qb[g].astype(np.uint64)).astype(int)
            row, g, to = _asked(visits, group)
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (g[1:] != g[:-1])])) if len(row) else np.empty(0, int)
            first, last = new, np.append(new[1:], len(row))[: len(new)]
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(to, pa.int32()))
            inside = g[first] == home[row[first]]
            none = pa.array([[]], pa.list_(pa.int32()))
            lists = pa.concat_arrays([lists, none])
            own_list = np.full(b.num_rows, len(first))
            own_list[row[first][inside]] = np.flatnonzero(inside)

            def rows(at, g, i, q, side, which, lists=lists, b=b):
                at = pa.array(at)
                columns = [pa.array(base[g] + i * qb[g] + q, pa.int32()), pa.array(side, pa.int32())]
                return pa.RecordBatch.from_arrays([*columns, *(b.column(c).take(at) for c in range(4)), lists.take(pa.array(which))], [x.split()[0] for x in BLOCKS.split(", ")])

            times = qb[home]
            at = np.repeat(np.arange(b.num_rows), times)
            q = np.arange(len(at)) - np.repeat(times.cumsum() - times, times)
            yield rows(at, home[at], i_own[at], q, np.where(q == 0, 0, 2), np.where(q == 0, own_list[at], len(first)))
            out = np.flatnonzero(~inside)
            times = ib[g[first[out]]]
            which = np.repeat(out, times)
            i = np.arange(len(which)) - np.repeat(times.cumsum() - times, times)
            at = row[first[which]]
            yield rows(at, g[first[which]], i, q_own(g[first[which]], at), np.ones(len(at), int), which)
            times = ib[home] - 1 - i_own  # one large cell: its vectors are queries of its later parts too
            at = np.repeat(np.arange(b.num_rows), times)
            i = i_own[at] + 1 + np.arange(len(at)) - np.repeat(times.cumsum() - times, times)
            alone = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1), pa.int32()), pa.array(cell, pa.int32()))
            yield rows(at, home[at], i, q_own(home[at], at), np.ones(len(at), int), at, alone)

    return run


def forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least vertex that each of `size` vertices reaches by the links a, b."""
    name = np.arange(size)
    while True:
        low = np.minimum(name[a], name[b])
        new = name.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == name).all():
            return name
        name = new


def _links(x, rep, xi, yi, n, links, pairs, least: float, within: bool = False) -> None:
    """Compare vectors xi with yi (rows of the block) in tiles; add to links and to pairs (a spanning forest of each tile)."""
    for lo in range(0, len(xi), TILE):
        for hi in range(lo if within else 0, len(yi), TILE):
            a, b = xi[lo : lo + TILE], yi[hi : hi + TILE]
            hit = (x[a] @ x[b].T >= least) & (rep[a][:, None] != rep[b][None, :])
            if within and lo == hi:
                hit = np.triu(hit, 1)
            if not hit.any():
                continue
            np.add.at(links, a, hit @ n[b])
            np.add.at(links, b, n[a] @ hit)
            rows = np.flatnonzero(hit.any(1))
            first = hit[rows].argmax(1)
            pairs.append(np.stack([a[rows], b[first]]))
            # a column's first row that links it joins the column; rows are joined by the columns that they share
            columns = np.flatnonzero(hit.any(0))
            name = np.arange(len(a))
            while True:
                label = np.where(hit[:, columns], name[:, None], len(a)).min(0)
                new = name.copy()
                new[rows] = np.minimum(name[rows], np.where(hit[rows][:, columns], label, len(a)).min(1))
                if (new == name).all():
                    break
                name = new
            pairs.append(np.stack([a[label], b[columns]]))


def _block(least: float, kind: str):
    def run(table):
        side, cell, rep, n = (table.column(c).to_numpy() for c in ("side", "cell", "rep", "n"))
        x = units(table.column("raw"), kind)
        links, pairs = np.zeros(len(side), np.int64), []
        index = np.flatnonzero(side != 1)
        index = index[cell[index].argsort(kind="stable")]
        visits = table.column("visits").combine_chunks()
        who = np.repeat(np.arange(len(side)), pc.list_value_length(visits).to_numpy())
        to = visits.flatten().to_numpy()
        order = to.argsort(kind="stable")
        who, to = who[order], to[order]
        for c in np.unique(cell[index]):
            mine = index[np.searchsorted(cell[index], c) : np.searchsorted(cell[index], c, "right")]
            if side[mine[0]] == 0:
                _links(x, rep, mine, mine, n, links, pairs, least, within=True)
            asked = who[np.searchsorted(to, c) : np.searchsorted(to, c, "right")]
            _links(x, rep, asked, mine, n, links, pairs, least)
        if not pairs:
            return pa.table({c: pa.array([], pa.int64()) for c in ("rep", "links", "to")})
        name = forest(len(side), *np.concatenate(pairs, 1))
        some = np.flatnonzero((links > 0) | (name != np.arange(len(side))))
        return pa.table({"rep": rep[some], "links": links[some], "to": rep[name[some]]})

    return run


def _met(filed: DataFrame, codes: int, least: float, kind: str) -> DataFrame:
    """rep, links, to: links found in blocks, and a spanning forest of them."""
    sc = filed.sparkSession.sparkContext
    found = filed.groupBy("cell").count().toArrow()  # at most codes * codes rows
    sizes = dict(zip(found["cell"].to_pylist(), found["count"].to_pylist(), strict=True))
    group, ib = grouped(sizes, codes, INDEX_BLOCK)
    asked = np.zeros(len(ib), np.int64)
    for r in filed.select("cell", "visits").mapInArrow(_ask(sc.broadcast((group, ib))), "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
        asked[r["g"]] = r["n"]
    for cell, n in sizes.items():
        asked[group[cell]] += n if ib[group[cell]] > 1 else 0  # parts of a large cell ask its later parts
    qb = np.maximum(1, -(-asked // QUERY_BLOCK))
    dealt = filed.mapInArrow(_deal(sc.broadcast((group, ib, qb))), BLOCKS)
    return cut(by_bucket(dealt, int((ib * qb).sum())).applyInArrow(_block(least, kind), MET), "met")


def _linked(rows: DataFrame, dim: int, kind: str, least: float, target: float) -> tuple[DataFrame, DataFrame]:
    """Of the vectors of one length: owner (vec_id, same, rep, n, copies: the least id of equal vectors and how many ids have them), and met (rep, links, to)."""
    spark = rows.sparkSession
    keys = cut(rows.mapInArrow(_valid(dim, False), KEYED).groupBy("same", "vec_id").agg(F.count("*").alias("copies")), "keys")
    several = cut(keys.groupBy("same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "several")
    owner = spread_join(keys, several, "same", "vec_id", "left").select("vec_id", "same", F.coalesce("rep", "vec_id").alias("rep"), F.coalesce("n", F.lit(1)).alias("n"), "copies")
    owner = cut(owner, "owners")
    total = owner.where("vec_id = rep").count()
    if total <= 1:
        return owner, spark.createDataFrame([], MET)
    whole = rows.mapInArrow(_valid(dim, True), f"{KEYED}, raw binary")
    codes = int(min(MOST_CODES, max(2, round((total / CELL) ** 0.5))))
    fit = max(SAMPLE, POINTS * codes)
    part = max(1, total // (4 * (fit + PROBES)))
    hashed = F.xxhash64("same")
    sample = whole.where(F.pmod(hashed, F.lit(part)) == 0).groupBy("same").agg(F.first("raw").alias("raw")).orderBy(hashed, "same").limit(fit + PROBES).collect()
    points = units(pa.array([bytes(r["raw"]) for r in sample]), kind)
    fitted = min(len(points), fit)
    chosen = slice(max(0, len(points) - PROBES), None) if len(points) > fit else slice(0, PROBES)
    codes = min(codes, fitted)
    books = tuple(fit_codebook(h, codes) for h in halves(points[:fitted]))
    probes, homes = points[chosen], nearest_cells(points[chosen], books, 1)[:, 0]
    seen = whole.mapInArrow(_hits(probes, [bytes(r["same"]) for r in sample[chosen]], homes, books, least, kind), "probe int, cell int, n long").groupBy("probe", "cell").agg(F.sum("n").alias("n"))
    needed = [r["cells"] for r in seen.groupBy("probe").applyInArrow(_needed(probes, homes, books, target), "cells int").collect()]  # at most PROBES rows
    if len(needed) < LEAST_LINKED:
        other = nearest_cells(turned(probes, (1 + least) / 2), books, 1)[:, 0]
        needed += [cells_needed(p, h, np.array([c]), np.array([1]), books, target) for p, h, c in zip(probes, homes, other, strict=True) if h <= c]
    cells = min(codes * codes, max(LEAST_CELLS, *needed, 0))
    lost = owner.where("vec_id <> rep").select("vec_id", "same")
    few = lambda d: F.broadcast(d) if d.count() <= MOST_SENT // 8 else d
    one = whole.join(few(lost), ["vec_id", "same"], "left_anti").join(few(several.select("same", "n")), "same", "left")
    if not owner.where("copies > 1").isEmpty():
        one = one.dropDuplicates(["vec_id", "same"])
    one = one.select("vec_id", F.coalesce("n", F.lit(1)).alias("n"), "raw")
    filed = cut(one.mapInArrow(_file(books, cells, kind), "rep long, n long, raw binary, cell int, visits array<int>"), "cells")
    return owner, _met(filed, codes, least, kind)


def near_vectors(vectors: DataFrame, least: float = 0.95, target: float = 0.999) -> DataFrame:
    """vec_id, n_links, component_id, kept for vectors (vec_id, embedding): links are cosines of at least `least`. Vectors of each length that at least two have are
    indexed apart, one length after the other; a vector alone in its length has no links."""
    single = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull)
    kind, array = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(array).alias("v"))
    lengths = rows.where("size(v) > 0 and vec_id is not null").groupBy(F.size("v").alias("d")).count().where("count > 1").orderBy("d").collect()
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    parts = [_linked(rows.where(F.size("v") == r["d"]) if len(lengths) > 1 else rows, r["d"], kind, least, target) for r in lengths]
    owner, met = (reduce(DataFrame.unionByName, side) for side in zip(*parts, strict=True))
    ends = met.select(F.col("rep").alias("a"), F.col("to").alias("b")).unionByName(owner.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    component = connected_components(ends).toDF("vec_id", "component_id")
    own = reduce(DataFrame.unionByName, (spread_join(o, m.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "vec_id", "left") for o, m in parts))
    own = own.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")).groupBy("vec_id").agg(F.max("links").alias("links"))
    out = rows.select("vec_id").join(own, "vec_id", "left").join(component, "vec_id", "left")
    named = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), named.alias("component_id"), F.coalesce(F.col("vec_id") == named, F.lit(False)).alias("kept"))
