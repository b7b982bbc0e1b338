"""Samples and holdouts are drawn by seeded hashes, not taken from the front of the key order."""

from countloom import catalog


def test_stratified_sample_reaches_all_keys(spark, tmp_path):
    rows = [(k, 1, s, "R") for s in range(10) for k in range(400 * s, 400 * s + 400)] + [(9000 + k, 1, None, "N") for k in range(30)] + [(9900, 1, 99, "N")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_orderkey: r.weight for r in catalog.QUERIES["g4_seeded_sample"](spark, str(tmp_path)).collect()}
    for s in range(10):
        own = [k - 400 * s for k in got if 400 * s <= k < 400 * s + 400]
        assert len(own) == 20 and max(own) > 200 and min(own) < 200
        assert all(got[k + 400 * s] == 20 for k in own)
    keys = [k % 400 for k in got if k < 4000]
    assert 150 < sum(keys) / len(keys) < 250
    assert sum(9000 <= k < 9030 for k in got) == 20 and got[9900] == 1


def test_holdout_is_no_key_prefix(spark, tmp_path):
    spark.createDataFrame([(k % 100,) for k in range(300)], "c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = catalog.QUERIES["g1_seeded_holdout"](spark, str(tmp_path)).collect()
    held = [r.c_nationkey for r in got if r.split == "validation"]
    assert len(got) == 100 and len(held) == 25 and 35 < sum(held) / 25 < 65
