import gzip
import random
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from countloom.sources import indexed, lines, tables


def test_lines_are_numbered_over_byte_ranges_and_gzip(spark, tmp_path):
    text = [f"line {i}" for i in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(text) + "\n")
    with gzip.open(tmp_path / "b.txt.gz", "wt") as f:
        f.write("\n".join(text) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = lines.numbered(spark, f"file://{tmp_path}/*.txt*").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 10000 and all(r.value == f"line {r.line_no}" for r in got)


def test_records_and_chunks(spark, tmp_path):
    path = tmp_path / "x.fa"
    path.write_text(">one first\nACGTac\nGTN\n\n>two\nTT\n")
    chunked = lines.chunks(lines.records(spark, f"file://{path}"), 4, 2)
    got = sorted(tuple(r) for r in chunked.collect())
    assert got == [("one", 0, 0, 4, 0, "ACGTac"), ("one", 1, 4, 8, 2, "GTacGTN"), ("one", 2, 8, 9, 2, "GTN"), ("two", 0, 0, 2, 0, "TT")]
    assert {r.letter: r.n for r in lines.alphabet(chunked).collect()} == {"A": 1, "C": 1, "G": 2, "T": 4, "a": 1, "c": 1, "N": 1}


@pytest.mark.parametrize("text", ["ACGT\n>one\nAC\n", ">one\n>two\nAC\n", ">one\nAC\n>one\nAC\n"])
def test_bad_records(spark, tmp_path, text):
    (tmp_path / "x.fa").write_text(text)
    with pytest.raises(ValueError):
        lines.records(spark, f"file://{tmp_path}/x.fa")


def test_dense_values(spark, tmp_path):
    (tmp_path / "v.txt").write_text("0\n2\n0\n1.5\n")
    assert sorted(tuple(r) for r in lines.dense_values(spark, f"file://{tmp_path}/v.txt", 4).collect()) == [(1, 2.0), (3, 1.5)]
    with pytest.raises(ValueError):
        lines.dense_values(spark, f"file://{tmp_path}/v.txt", 5)


def test_sparse_signal_checks(spark):
    bed = lambda *rows: spark.createDataFrame(rows, "contig string, start long, end long, strand string, count string")
    assert tables.sparse_signal(bed(("a", 2, 4, "+", "2"))).count() == 2
    allowed = spark.createDataFrame([("a", 0, 4)], "contig string, start long, end long")
    for bad in (bed(("a", 2, 4, "+", "1.5")), bed(("a", 2, 4, "+", "inf")), bed(("a", 2, 4, "+", "1"), ("a", 3, 5, "+", "1"))):
        with pytest.raises(ValueError):
            tables.sparse_signal(bad)
    with pytest.raises(ValueError):
        tables.sparse_signal(bed(("a", 3, 5, "+", "1")), allowed)


def test_saved_split(spark, tmp_path):
    df, folder = spark.range(10), f"file://{tmp_path}/s"
    tables.save_split({"t": df}, folder)
    tables.save_split({"t": df.orderBy(F.desc("id"))}, folder)
    assert tables.load_split(spark, folder)["t"].count() == 10
    with pytest.raises(FileExistsError):
        tables.save_split({"t": df.where("id > 3")}, folder)


def test_catalog_and_plans(spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/a.parquet")
    found = tables.Catalog(spark, f"file://{tmp_path}", ["a"], ["b"])
    assert found.available_names() == ["a"] and found.load_all()["a"].count() == 3
    with pytest.raises(FileNotFoundError):
        tables.Catalog(spark, f"file://{tmp_path}", ["b"]).validate()
    df = spark.createDataFrame([(1, "x", 0)], "n int, s string, y int")
    assert tables.feature_groups(df, {"continuous": ["n"], "nominal": ["s"]}, "y") == []
    assert len(tables.feature_groups(df, {"continuous": ["s", "y", "z"]}, "y")) == 4
    assert tables.feature_plan(df, {"continuous": ["n"], "nominal": ["s"]}, exclude=["s"]) == (["n"], {"s": "excluded"})


@pytest.mark.parametrize(("split", "batch"), [("211", "7"), ("4000", "3")])
def test_records_over_byte_ranges_and_batches(spark, tmp_path, split, batch):
    """Records that run over many byte ranges and batches: pieces and index are those of the whole files, and a short line is found wherever ranges end."""
    draw = random.Random(5)
    texts = {f"c{i}": "".join(draw.choice("ACGTn") for _ in range(n)) for i, n in enumerate((1, 10, 11, 999, 40, 0, 305, 10, 2000)) if n}
    names, folder = list(texts), tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        body = "".join(f">{n} more\n" + "".join(texts[n][i : i + 10] + "\n" for i in range(0, len(texts[n]), 10)) for n in names[k::2])
        (folder / f"{k}.txt").write_text(body)
    bad = []
    for at in (50, 98):
        cut = [texts["c3"][i : i + 10] for i in range(0, 990, 10)]
        cut[at] = cut[at][:9] if at < 98 else cut[at] + "ACGT"
        bad.append(tmp_path / f"bad{at}.txt")
        bad[-1].write_text(">x\n" + "\n".join(cut) + "\n")
    loose = tmp_path / "loose.txt"
    loose.write_text("ACGTACGTAC\n" * 40 + ">a\nAC\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in zip(old, (split, batch), strict=True):
            spark.conf.set(k, v)
        got: dict = {}
        for r in sorted(lines.records(spark, f"file://{folder}").collect(), key=lambda r: (r.contig, r.start)):
            assert r.start == len(got.get(r.contig, "")) and r.bases
            got[r.contig] = got.get(r.contig, "") + r.bases
        index = indexed.build_index(spark, f"file://{folder}").collect()
        for f in bad:
            with pytest.raises(ValueError, match="differ in length"):
                indexed.build_index(spark, f"file://{f}")
        for read in (lines.records, indexed.build_index):
            with pytest.raises(ValueError, match="before a header"):
                read(spark, f"file://{loose}")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == texts and {r.contig: r.length for r in index} == {n: len(x) for n, x in texts.items()}
    for r in index:
        raw = open(urlparse(r.file).path).read()
        assert raw[: r.byte_offset].endswith(f">{r.contig} more\n") and raw[r.byte_offset :][:10].split("\n")[0] == texts[r.contig][:10]
        assert r.line_bytes == r.line_bases + 1 == min(10, r.length) + 1


def test_written_sequences(spark, tmp_path):
    rows = [(1, "aCG-é日T" * 2), (2, "ACGTAC"), (None, "AC"), (3, None), (4, "A")]
    df = spark.createDataFrame(rows, "id long, s string")
    fold = indexed.letters_as("ACGT", "N")
    for name, letters, want in (("a", indexed.letters_as("ACGTa"), {"1": ["aCG", "TaC", "GT"], "2": ["ACG", "TAC"], "4": ["A"]}), ("b", fold, {"1": ["NCG", "NNN", "TNC", "GNN", "NT"], "2": ["ACG", "TAC"], "4": ["A"]})):
        indexed.write_sequences(df, "id", "s", f"file://{tmp_path}/{name}", 3, letters)
        found = "\n".join(f.read_text() for f in sorted((tmp_path / name).glob("part-*"))).split(">")
        assert {x.split()[0]: x.split()[1:] for x in found if x.strip()} == want
