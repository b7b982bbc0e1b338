"""Named tables: a catalog of required and optional ones, inventories, and saved splits with digests."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ranks


@dataclass
class Catalog:
    """Tables by name under a root; format and options are those of spark.read. Reads are lazy."""

    spark: SparkSession
    root: str
    required: list[str]
    optional: list[str] = field(default_factory=list)
    suffix: str = ".parquet"
    format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)

    def path(self, name: str) -> str:
        if name not in [*self.required, *self.optional]:
            raise KeyError(name)
        return f"{self.root}/{name}{self.suffix}"

    def load(self, name: str) -> DataFrame:
        return self.spark.read.format(self.format).options(**self.options).load(self.path(name))

    def available_names(self) -> list[str]:
        """Names whose file or folder is there, asked of the store that Spark itself reads."""
        jvm = self.spark._jvm
        at = lambda name: jvm.org.apache.hadoop.fs.Path(self.path(name))
        conf = self.spark._jsc.hadoopConfiguration()
        return [n for n in [*self.required, *self.optional] if at(n).getFileSystem(conf).exists(at(n))]

    def validate(self) -> None:
        lost = sorted(set(self.required) - set(self.available_names()))
        if lost:
            raise FileNotFoundError(f"required tables not found: {lost}")

    def load_all(self) -> dict[str, DataFrame]:
        self.validate()
        return {n: self.load(n) for n in self.available_names()}

    def file_report(self) -> DataFrame:
        """table, n_rows, n_columns, n_files, bytes, sha256 (of the files' digests in order of their paths). Large files are digested in pieces."""
        out = None
        for name, df in self.load_all().items():
            files = file_digests(self.spark, self.path(name))
            sums = files.agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), lambda x: x["digest"]), ""), 256).alias("sha256"))
            one = df.agg(F.count("*").alias("n_rows")).crossJoin(sums).select(F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), "n_files", "bytes", "sha256")
            out = one if out is None else out.unionByName(one)
        return out


#: Bytes up to which a file may be one row, and of a piece of a larger one.
WHOLE_FILE, PIECE = 1 << 28, 1 << 24


def _streamed(batches):
    import hashlib

    import pyarrow as pa
    import pyarrow.fs as pafs

    for b in batches:
        digests = []
        for path in b.column(0).to_pylist():
            fs, name = pafs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with fs.open_input_stream(name, compression=None) as stream:
                while piece := stream.read(PIECE):
                    digest.update(piece)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests)], ["path", "length", "digest"])


def file_digests(spark: SparkSession, path: str, whole: int = WHOLE_FILE) -> DataFrame:
    """path, length, digest (SHA-256) of all files under a path. Files of more than `whole` bytes are read in pieces, a file a task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("digest"))
    large = files.where(F.col("length") > whole).select("path", "length").repartition("path")
    return small.unionByName(large.mapInArrow(_streamed, "path string, length long, digest string"))


def schema_report(df: DataFrame, key: str | None = None, target: str | None = None, inference: DataFrame | None = None, descriptions: dict[str, str] | None = None) -> DataFrame:
    """column, type, role (id, target, feature; output when inference lacks it), at_inference, description, n_null, n_values."""
    seen = set(inference.columns) if inference is not None else set(df.columns) - {target}
    role = lambda c: "id" if c == key else "target" if c == target else "feature" if c in seen else "output"
    facts = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(role(f.name)).alias("role"), F.lit(f.name in seen).alias("at_inference"),
                      F.lit((descriptions or {}).get(f.name)).cast("string").alias("description"), F.count_if(F.col(f"`{f.name}`").isNull()).alias("n_null"), F.count(F.col(f"`{f.name}`")).alias("n_values")) for f in df.schema]
    return df.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


def feature_groups(df: DataFrame, groups: dict[str, list[str]], target: str | None = None, numeric: tuple[str, ...] = ("continuous", "count", "ordinal")) -> list[str]:
    """Every problem of a grouping at once: unknown, missing or repeated columns, numeric groups that are not, a target among the features."""
    types = {f.name: f.dataType for f in df.schema}
    listed = [c for g in groups.values() for c in g]
    out = [f"unknown column {c}" for c in sorted(set(listed) - set(types))]
    out += [f"column in no group: {c}" for c in types if c not in listed and c != target]
    out += [f"column in several groups: {c}" for c in sorted({c for c in listed if listed.count(c) > 1})]
    out += [f"not numeric: {c}" for g in numeric for c in groups.get(g, []) if c in types and not isinstance(types[c], T.NumericType)]
    return out + ([f"target {target} is a feature"] if target in listed else [])


def feature_plan(df: DataFrame, groups: dict[str, list[str]], include: list[str] | None = None, exclude: list[str] = (), use: list[str] | None = None, inference: DataFrame | None = None) -> tuple[list[str], dict[str, str]]:
    """The columns a model takes, and for each other one the reason. Raises when inference lacks a taken column."""
    taken, why = [], {}
    for group, columns in groups.items():
        for c in columns:
            reason = "group not used" if use is not None and group not in use else "not included" if include is not None and c not in include else "excluded" if c in exclude else None
            if reason:
                why[c] = reason
            else:
                taken.append(c)
    lost = [c for c in taken if inference is not None and c not in inference.columns]
    if lost:
        raise ValueError(f"inference has no columns {lost}")
    return taken, why


def digest(df: DataFrame) -> DataFrame:
    """n_rows and a checksum that no order of rows changes."""
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("checksum"))


def save_split(tables: dict[str, DataFrame], folder: str) -> None:
    """Tables and their manifest; refuses a folder that holds another result, keeps one that holds the same."""
    spark = next(iter(tables.values())).sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        old = {r.table: (r.n_rows, r.checksum) for r in spark.read.parquet(f"{folder}/manifest").collect()}  # one row a table
        new = {n: tuple(digest(df).head()) for n, df in tables.items()}
        if old != new:
            raise FileExistsError(f"{folder} holds another split")
        return
    manifest = None
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
        one = digest(spark.read.parquet(f"{folder}/{name}")).select(F.lit(name).alias("table"), "n_rows", "checksum")
        manifest = one if manifest is None else manifest.unionByName(one)
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")


def load_split(spark: SparkSession, folder: str, verify: bool = True) -> dict[str, DataFrame]:
    """The saved tables; raises when one no longer has its rows or checksum."""
    out = {}
    for r in spark.read.parquet(f"{folder}/manifest").collect():  # one row a table
        out[r.table] = spark.read.parquet(f"{folder}/{r.table}")
        if verify and tuple(digest(out[r.table]).head()) != (r.n_rows, r.checksum):
            raise ValueError(f"table {r.table} was changed")
    return out


def sparse_signal(bed: DataFrame, allowed: DataFrame | None = None, bin_width: int = 1024) -> DataFrame:
    """(contig, pos, strand, count) from (contig, start, end, strand, count as text): a row a base.

    Raises for a count that is not finite, positive and whole, a repeated position-strand, or a base outside allowed (contig, start, end)."""
    from ..operators import intervals as iv

    number = F.expr("try_cast(count as decimal(38,9))")
    bad = bed.where(number.isNull() | (number <= 0) | (number != F.floor(number)))
    rows = iv.expanded(bed.select("contig", "start", "end", "strand", number.cast("long").alias("count"))).select("contig", "pos", "strand", "count")
    checks = {"count not positive and whole": bad, "repeated position-strand": rows.groupBy("contig", "pos", "strand").count().where("count > 1")}
    if allowed is not None:
        checks["base outside the allow-list"] = iv.contained(rows, allowed, bin_width, "left_anti")
    for what, found in checks.items():
        if not found.isEmpty():
            raise ValueError(what)
    return rows


def split_report(source: DataFrame, parts: dict[str, DataFrame], group: str) -> DataFrame:
    """One row: rows of the source that no part has (missing), rows that the parts have beyond the source (extra), groups in several parts (shared)."""
    whole = None
    for name, df in parts.items():
        one = df.select(*source.columns).withColumn("_split", F.lit(name))
        whole = one if whole is None else whole.unionByName(one)
    rows = whole.drop("_split")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    shared = whole.groupBy(group).agg(F.countDistinct("_split").alias("_n")).where("_n > 1")
    return n(source.exceptAll(rows), "missing").crossJoin(F.broadcast(n(rows.exceptAll(source), "extra"))).crossJoin(F.broadcast(n(shared, "shared")))


def checked_split(source: DataFrame, parts: dict[str, DataFrame], group: str) -> None:
    """ValueError unless the parts hold each source row once and no group is in two of them."""
    found = split_report(source, parts, group).head().asDict()
    if any(found.values()):
        raise ValueError(f"not a split of the source: {found}")


def prepare_rows(df: DataFrame, target: str, least: int = 1, time: list[str] | None = None, group: str | None = None, least_groups: int = 2) -> DataFrame:
    """df with row (its place in the order of the `time` columns), after checks in one pass: the target is never null, each of its values has
    `least` rows, groups are not null and there are enough. ValueError names all that is wrong."""
    facts = df.groupBy(target).agg(F.count("*").alias("n"))
    few = facts.agg(F.coalesce(F.sum(F.when(F.col(target).isNull(), F.col("n"))), F.lit(0)).alias("null"), F.coalesce(F.min(F.when(F.col(target).isNotNull(), F.col("n"))), F.lit(0)).alias("least")).head()
    wrong = [f"{few['null']} rows without a target"] * bool(few["null"]) + [f"a target value of {few['least']} rows"] * (few["least"] < least)
    if group:
        n, null = df.agg(F.countDistinct(group), F.count_if(F.col(group).isNull())).head()
        wrong += [f"{null} rows without a group"] * bool(null) + [f"only {n} groups"] * (n < least_groups)
    if wrong:
        raise ValueError("; ".join(wrong))
    return ranks.row_numbers(df, [F.asc(c) for c in time], "row") if time else df


def replicate_pair(spark: SparkSession, path: str, token: str) -> tuple[str, str]:
    """The paths of the two files under a path whose names differ in a replicate token only (a pattern for the whole token); ValueError
    unless exactly one name has two files and no name more. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").where(F.col("path").rlike(token))
    pairs = files.groupBy(F.regexp_replace("path", token, "*").alias("name")).agg(F.sort_array(F.collect_list("path")).alias("paths"))
    found = pairs.where(F.size("paths") > 1).limit(2).collect()
    if len(found) != 1 or len(found[0]["paths"]) != 2:
        raise ValueError(f"not one pair of replicates: {[r['paths'] for r in found]}")
    return tuple(found[0]["paths"])
