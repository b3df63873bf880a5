"""Every named query against its SQL counterpart on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


def test_names():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 4


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    line, ok = check.compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert ok, line


@pytest.mark.parametrize("name", ["a01_metric_summary", "a22_match_instances", "j13_box_join", "w06_ecdf", "t03_seeded_sample", "p30_row_index"])
def test_partitioning_does_not_show(spark, name):
    def rows():
        return sorted(map(repr, QUERIES[name](spark, SF).collect()))

    want = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("name", ["a49_foreground", "a49_otsu_threshold"])
def test_otsu_of_equally_good_splits(spark, tmp_path, name):
    # Luminances lie in mirror image, so the first and the third split are equally good; the SQL's sums of centres take the third.
    shapes = [(20, 9, 13), (21, 9, 5), (22, 10, 17), (25, 11, 8), (28, 13, 11), (33, 15, 5)]
    images = [[0] * n + [a] * (32 - n) + [top - a] * (32 - n) + [top] * n for top, a, n in shapes]
    rows = [(i, [k / 256 for k in image], 0) for i, image in enumerate(images)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    line, ok = check.compare(spark, con, name, QUERIES[name], ORACLES[name], str(tmp_path))
    assert ok, line
