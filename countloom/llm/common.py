"""Shared helpers: the shared folder, written cut points, word hashing in numpy, connected components."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

#: Word separators of every operator here: space and the five controls from tab to carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BYTE_BASE = 0x9E3779B97F4A7C15
GRAM_BASE = np.uint64(0xD6E8FEB86659FD93)


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines see: spark.checkpoint.dir. Where that is unset, a temporary one in local mode; on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        found = tempfile.mkdtemp(prefix="countloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it back: the plan ends there, and lost executors cost nothing."""
    return cut_at(df, what)[0]


def cut_at(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """cut(), and where the table is."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that cut() wrote, once nothing reads it any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """Total bytes of a text column: one scan, one number."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(col)), F.lit(0))).head()[0])


def groups_for(total: float, each: float, least: int = 8) -> int:
    """How many groups of about `each` hold `total`."""
    return max(least, int(-(-total // each)))


#: Bytes that a task should read of a shuffle, and how many tasks a shuffle has at most (more would be too many blocks).
TASK_BYTES, MOST_TASKS = 8 << 20, 50_000


def tasks_for(total: float, each: float = TASK_BYTES) -> int:
    """How many shuffle tasks read `total` in parts of about `each`; parts grow where there would be too many tasks."""
    return min(MOST_TASKS, groups_for(total, each))


def by_bucket(df: DataFrame, buckets: int) -> GroupedData:
    """df grouped by its column bucket (0 to buckets - 1): a task for each bucket, or where those would be too many, tasks of several."""
    spread = df.repartitionById(buckets, "bucket") if buckets <= MOST_TASKS else df.repartition(MOST_TASKS, "bucket")
    return spread.groupBy("bucket")


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.uint64(BYTE_BASE), np.uint64(pow(BYTE_BASE, -1, 1 << 64))
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; h is unsigned."""
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of a run of texts: start, end (byte positions), h (64-bit hashes), doc (index of the text), first (index of each text's first word, and the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n = len(data)
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        if n:
            edges = offsets[:-1][offsets[:-1] < n]
            before[edges] = False
            after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.data = data
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data)
        size = max(1 << 16, 1 << int(n).bit_length())
        up, down = _powers(size)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        self.h = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64) * M2)
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-word windows that lie in one text, and the index of their first words."""
        m = len(self.h) - n + 1
        if m <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        acc = np.zeros(m, np.uint64)
        for k in range(n):
            acc = acc * GRAM_BASE + self.h[k : k + m]
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 : n - 1 + m])
        return mix(acc[at]), at


def text_runs(column, most: int = 1 << 20):
    """Of an Arrow string column, (first row, data, offsets) of runs of about `most` bytes. Null texts count as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        stop = min(stop, len(column))
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Ids that may be sent to every task: 16 MB.
MOST_SENT = 2_000_000


def spread_join(many: DataFrame, one: DataFrame, on: str, by: str, how: str = "inner", salts: int = 8) -> DataFrame:
    """many joined to one, which has a row for each `on`, where a few values of `on` may hold most rows of many:
    by broadcast if one is counted to have at most MOST_SENT rows, else each value is dealt to `salts` tasks by a hash of `by`."""
    if one.count() <= MOST_SENT // 8:
        return many.join(F.broadcast(one), on, how)
    return salted(many, one, on, by, how, salts)


def salted(many: DataFrame, one: DataFrame, on: str, by: str, how: str = "inner", salts: int = 8) -> DataFrame:
    left = many.withColumn("k_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    right = one.withColumn("k_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [on, "k_salt"], how).drop("k_salt")


#: Rows of a join key that one task may read.
MOST_OF_A_KEY = 512


def skewed_join(many: DataFrame, one: DataFrame, on: str, by: str, salts: int = 32) -> DataFrame:
    """The inner join of many, a written table, to one, which has a row for each `on`. Values of `on` with more than MOST_OF_A_KEY rows of
    many are dealt to `salts` tasks by a hash of `by`, with a copy of their row of one for each task; the others join plainly."""
    hot = cut(many.groupBy(on).count().where(F.col("count") > MOST_OF_A_KEY).select(on), "hot")
    n = hot.count()
    if not n:
        return many.join(one, on)
    if n > MOST_SENT // 8:  # too many to list: all are dealt so
        return salted(many, one, on, by, salts=salts)
    hot = F.broadcast(hot)
    few = salted(many.join(hot, on, "left_semi"), one.join(hot, on, "left_semi"), on, by, salts=salts)
    return few.unionByName(many.join(hot, on, "left_anti").join(one, on))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, component) for each vertex of the edges (a, b): the smallest vertex that it reaches.

    Each round takes the least label among a vertex and its neighbours and then follows labels one
    step (pointer jumping), so the number of rounds grows with the logarithm of a chain's length.
    Hubs and the label of a giant component are dealt over several tasks. Labels are written between rounds;
    only whether one changed comes to the driver. Null ends and loops are ignored; repeated edges are counted once."""
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    spark = edges.sparkSession
    both, edges_at = cut_at(edges.union(edges.select("b", "a")).distinct().toDF("v", "w"), "edges")
    labels, at = cut_at(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("component")), "labels")
    for _ in range(most_rounds):
        seen = salted(both, labels.withColumnsRenamed({"v": "w", "component": "c"}), "w", "v").groupBy("v").agg(F.min("c").alias("c"))
        step = labels.join(seen, "v").select("v", F.col("component").alias("was"), F.least("component", "c").alias("c"))
        jump = labels.where("v <> component").select(F.col("v").alias("c"), F.col("component").alias("cc"))
        step, next_at = cut_at(salted(step, jump, "c", "v", "left").select("v", "was", F.least("c", "cc").alias("component")), "labels")
        discard(spark, at)
        labels, at = step.select("v", "component"), next_at
        if step.where("was <> component").isEmpty():
            discard(spark, edges_at)
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
