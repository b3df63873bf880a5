"""Ranks, joins, splits, spatial joins and incremental runs on small fixtures."""

import os
import random
import re
import shutil
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import keys as K, scalars as X
from tesserae.operators import dedupe as D, joins as J, learn as L, manifests as N, metrics as M, ranks as R, reports as P, spatial as B
from tesserae.sources import documents as O, tables as T
from tesserae.streaming import incremental as I


def values(n=3000, seed=1):
    rng = random.Random(seed)
    # One value holds a third of the rows.
    return [("a" if i % 3 else None, 0.5 if i % 3 == 1 else round(rng.gauss(0, 5), 2)) for i in range(n)]


@pytest.mark.parametrize("split_above", [0, 500_000])
def test_ranks_and_quantiles_are_exact_with_and_without_ranges(spark, split_above):
    rows = values()
    df = spark.createDataFrame(rows, "g string, v double")
    for g in ("a", None):
        mine = sorted(v for k, v in rows if k == g)
        cond = F.col("g").eqNullSafe(F.lit(g))
        got = R.value_ranks(df, ["g"], "v", split_above=split_above).where(cond).collect()
        assert sum(r.n for r in got) == len(mine)
        for r in got:
            assert r.before == int(np.searchsorted(mine, r.v)) and r.n == mine.count(r.v) and r.total == len(mine)
        q = R.exact_quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.975}, split_above=split_above).where(cond).first()
        assert (q.a, q.b, q.c) == pytest.approx(tuple(np.quantile(mine, [0.1, 0.5, 0.975])))


def test_bucket_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 2, 3, 4, 5, 8)], "v double")
    b = R.global_edges(df, "v", 4)
    assert [r[0] for r in df.orderBy("v").select(R.bucket_by("v", b)).collect()] == [1, 1, 1, 1, 3, 3, 4, 4]
    with pytest.raises(ValueError):
        R.global_edges(df, "v", 20)
    assert len(R.global_edges(df, "v", 20, duplicates="drop")) < 21


def test_attach_by_value_with_a_hot_value(spark):
    df = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(values(900))], "i int, v double").withColumn("g", F.lit(0))
    ranks = R.value_ranks(df, ["g"], "v")
    got = R.attach_by_value(df, ranks.withColumn("rank", R.average_rank()), ["g"], "v", ["rank"], heavy_share=10).collect()
    assert len(got) == 900
    order = sorted(r.v for r in got)
    for r in got:
        assert r.rank == np.searchsorted(order, r.v) + (order.count(r.v) + 1) / 2


def test_dense_row_index_is_dense_and_ordered(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    rows = N.dense_row_index(df, ["k"], "i").collect()
    assert all(r.k == r.i for r in rows) and len(rows) == 5000


def test_ecdf_expands_ties_in_chunks(spark):
    df = spark.createDataFrame([("m", 1.0)] * 7 + [("m", 2.0)] * 3, "m string, v double")
    got = sorted((r.v, round(r.ecdf, 6)) for r in P.ecdf(df, ["m"], "v", chunk=2).collect())
    assert got == [(1.0, round(i / 10, 6)) for i in range(1, 8)] + [(2.0, round(i / 10, 6)) for i in range(8, 11)]


def test_ranking_scores_treat_ties_as_one_step(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.1)]
    r = M.ranking_scores(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()
    assert r.roc_auc == pytest.approx((2 + 1.5 + 0) / 6)
    assert r.average_precision == pytest.approx((1 / 1 + 2 / 3 + 3 / 5) / 3)
    one = M.ranking_scores(spark.createDataFrame([(1, 0.5)], "y int, s double"), "y", "s").first()
    assert one.roc_auc is None and one.average_precision is None


def test_regression_of_a_constant(spark):
    r = M.regression_summary(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "t double, p double"), "t", "p").first()
    assert r.pearson is None and r.spearman is None and r.r2 is None and r.mae == 1.5


def test_join_keys_are_spelled_once_per_value(spark):
    """20 columns (80 spellings, more than a number has bits); 400 rows repeat 10 values, so few rows are spelled."""
    names = [f"c{i}" for i in range(20)]
    facts = spark.range(400).select(*[F.concat(F.lit(f"d{i}/"), F.when(F.col("id") % 10 > 0, (F.col("id") % 10).cast("string")), F.lit("_mask.png")).alias(c) for i, c in enumerate(names)])
    scores = J.score_join_keys(facts.withColumn("c3", F.lit(" ")), spark.range(5).withColumnRenamed("id", "k"), "k", names)
    rows = scores.collect()
    want = [(4 * i + j, f"c{i}", v, 4 * (j == 3), 9) for i in range(20) if i != 3 for j, v in enumerate(("raw", "basename", "basename_stem", "basename_strip_role"))]
    assert [tuple(r) for r in rows] == sorted(want, key=lambda r: (-r[3], -r[4], r[0]))
    assert dict(scores.dtypes)["n_keys"] == "bigint" and dict(scores.dtypes)["position"] == "int"
    nodes, spelt = [scores._jdf.queryExecution().executedPlan()], []
    while nodes:
        n = nodes.pop()
        name = n.nodeName()
        nodes += [n.executedPlan()] if name == "AdaptiveSparkPlan" else [n.plan()] if name.endswith("QueryStage") else [n.children().apply(i) for i in range(n.children().size())]
        if name == "Generate":
            spelt.append(n.metrics().apply("numOutputRows").value())
    assert sum(spelt) < 400 * 80 / 2


def test_box_join_against_brute_force(spark):
    rng = random.Random(4)
    tiles = [(i, x, y, x + 10.0, y + 10.0) for i, (x, y) in enumerate((x * 8.0, y * 8.0) for x in range(6) for y in range(6))]
    boxes = [(i, x := rng.choice([8.0, rng.uniform(-5, 60)]), y := rng.uniform(-5, 60), x + rng.choice([2.0, 20.0]), y + 3.0) for i in range(300)]
    t = spark.createDataFrame(tiles, "tile int, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame(boxes, "box int, xmin double, ymin double, xmax double, ymax double")
    got = [(r.tile, r.box) for r in B.box_join(t, b, [], 9.0, salts=3).collect()]
    want = {(t[0], b[0]) for t in tiles for b in boxes if b[3] > t[1] and b[1] < t[3] and b[4] > t[2] and b[2] < t[4]}
    assert len(got) == len(set(got)) and set(got) == want


def test_folds_and_split_keep_groups_whole(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 == 0 else f"s{rng.randint(0, 4000)}", i % 2) for i in range(9000)]
    df = spark.createDataFrame(rows, "i int, g string, y int")
    for label in (None, "y"):
        f = L.grouped_folds(df, "g", 3, 7, label)
        assert f.groupBy("g").agg(F.count_distinct("fold").alias("k")).where("k > 1").count() == 0
        sizes = [r[1] for r in f.groupBy("fold").count().collect()]
        assert len(sizes) == 3 and sum(sizes) == 9000 and max(sizes) < 1.1 * min(sizes)
    s = L.grouped_split(df, "g", 0.2, 3)
    assert L.shared_groups(s, "g") == 0
    n = df.select("g").distinct().count()
    assert s.where("split = 'test'").select("g").distinct().count() == -(-n // 5)


def test_light_groups_are_stratified(spark):
    # 3000 light groups, class 2 in 40 of them and never their largest, class 1 in a tenth.
    rows = [(f"g{g}", 2 if g < 40 and i == 0 else int(g % 10 == 3)) for g in range(3000) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, y int")
    f = L.grouped_folds(df, "g", 4, 7, "y")
    assert f.count() == len(rows) and f.groupBy("g").agg(F.count_distinct("fold").alias("k")).where("k > 1").count() == 0
    for y in range(3):
        sizes = [r[1] for r in f.where(F.col("y") == y).groupBy("fold").count().collect()]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 0.02 * sum(sizes) + 3


def test_join_contracts(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, v string")
    with pytest.raises(J.JoinError):
        J.require_unique(left, ["k"], "left")
    with pytest.raises(J.JoinError):
        J.require_present(left, ["v"], "left")
    facts = spark.createDataFrame([(1, "m", 0.5)], "k int, model string, pq double")
    manifest = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    joined = J.attach_targets(manifest, facts, "k", "model", ["pq"])
    cov = J.target_coverage(joined, facts, manifest, "k", "model")
    assert cov.first().coverage == pytest.approx(1 / 3)
    with pytest.raises(J.JoinError):
        J.require_coverage(cov, "model", 0.5)
    with pytest.raises(J.JoinError):
        J.discover_join_key(spark.createDataFrame([("zzz",)], "image_id string"), manifest, "k", ["image_id"])
    with pytest.raises(ValueError):
        N.require_case(left, "k > 9", [F.asc("k")])


def test_matched_rows_both_ways(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "b"), (3, "a"), (4, "a"), (4, "a"), (5, None), (5, "b")], "k int, m string")
    for unique in (True, False):
        assert {r.k for r in J.matched_rows(df, "k", "m", 2, unique).collect()} == {1, 3}


def test_row_rules(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.5), (None, 2.0, 3.0), (None, None, None)], "a double, b double, c double")
    r = df.select(
        X.row_median(["a", "b", "c"]).alias("m"), X.unique_winner(["a", "b", "c"]).alias("w"), X.first_at_max(["a", "b", "c"]).alias("f"), X.row_std(["a", "b", "c"]).alias("s")
    ).collect()
    assert [x.m for x in r] == [1.0, 2.5, None] and [x.w for x in r] == ["tie", "c", None] and [x.f for x in r] == ["a", "c", None]
    assert r[1].s == pytest.approx(np.std([2, 3], ddof=1)) and r[2].s is None
    sizes = spark.createDataFrame([(5, 0.5), (7, 0.5), (1, 0.1)], "n int, f double").select(X.target_size("n", "f").alias("t")).collect()
    assert [x.t for x in sizes] == [2, 4, 1]  # half to even, at least one


def test_key_rules(spark):
    df = spark.createDataFrame([("samples/a/x_image.png",), ("w\\z_mask.png",), (".hidden",), ("a/b.c.tif",), (None,)], "p string")
    r = df.select(K.sample_id_from_image("p").alias("s"), K.stem("p").alias("t"), K.patch_id_from_image("p").alias("i")).collect()
    assert [x.s for x in r] == ["a", "z", ".hidden", "b.c", ""]
    assert [x.i for x in r][0] == "x" and [x.t for x in r][2:4] == [".hidden", "b.c"]


def test_first_and_last_ignore_partitioning(spark):
    df = spark.createDataFrame([(i % 5, i, f"v{i}") for i in range(100)], "k int, o int, v string")
    for n in (1, 7):
        d = df.repartition(n)
        assert {(r.k, r.v) for r in D.first_per_key(d, ["k"], ["o"]).collect()} == {(k, f"v{k}") for k in range(5)}
        assert {(r.k, r.v) for r in D.last_per_key(d, ["k"], ["o"]).collect()} == {(k, f"v{95 + k}") for k in range(5)}


def test_samples_ignore_partitioning(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 7)
    a = {r.id for r in N.seeded_sample(df, ["id"], 50, 3).collect()}
    assert a == {r.id for r in N.seeded_sample(df.repartition(13), ["id"], 50, 3).collect()} and len(a) == 50
    b = {r.id for r in N.seeded_sample_per_group(df, ["g"], ["id"], 4, 3).collect()}
    assert b == {r.id for r in N.seeded_sample_per_group(df.repartition(13, "id"), ["g"], ["id"], 4, 3).collect()} and len(b) == 28


def test_incremental_run_goes_on_where_it_stopped(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    schema = "k int, ts timestamp, v int"

    def put(name, rows):
        spark.createDataFrame(rows, "k int, v int").select("k", F.timestamp_seconds(F.col("k") + 1_700_000_000).alias("ts"), "v").coalesce(1).write.parquet(os.path.join(root, "in", name))

    def run():
        source = I.arriving(spark, f"{root}/in/*", schema)
        I.run_incremental(source, ["k"], ["ts", "v"], [("negative", F.col("v") < 0, "negative")], f"{root}/ok", f"{root}/bad", f"{root}/cp")
        return sorted(r.k for r in spark.read.parquet(f"{root}/ok").collect()), sorted(r.k for r in spark.read.parquet(f"{root}/bad").collect())

    put("a", [(1, 1), (2, -1), (1, 1)])
    assert run() == ([1], [2])
    put("b", [(1, 1), (3, 1), (4, -2)])
    assert run() == ([1, 3], [2, 4])
    assert run() == ([1, 3], [2, 4])


def test_incremental_run_keeps_late_rows_and_knows_old_keys(spark):
    root = tempfile.mkdtemp(prefix="spark-")

    def run(name, rows):
        day = F.timestamp_seconds(F.col("day") * 86400 + 1_700_000_000)
        spark.createDataFrame(rows, "k int, day int, v int").select("k", day.alias("ts"), "v").coalesce(1).write.parquet(os.path.join(root, "in", name))
        source = I.arriving(spark, f"{root}/in/*", "k int, ts timestamp, v int")
        I.run_incremental(source, ["k"], ["ts", "v"], [("negative", F.col("v") < 0, "negative")], f"{root}/ok", f"{root}/bad", f"{root}/cp")
        return [sorted((r.k or 0, r.v) for r in spark.read.parquet(f"{root}/{t}").collect()) for t in ("ok", "bad")]

    assert run("a", [(1, 0, 1), (2, 100, 1), (None, 100, 7)]) == [[(0, 7), (1, 1), (2, 1)], []]
    # Rows long before the latest, then keys that come back long after.
    assert run("b", [(3, 5, 1), (4, 6, -1), (5, 300, 1)]) == [[(0, 7), (1, 1), (2, 1), (3, 1), (5, 1)], [(4, -1)]]
    assert run("c", [(1, 400, 9), (4, 400, 9), (None, 400, 9), (6, 400, 2)]) == [[(0, 7), (1, 1), (2, 1), (3, 1), (5, 1), (6, 2)], [(4, -1)]]


def test_incremental_run_keeps_the_first_by_batch_and_order_after_a_crash(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="spark-")

    def put(name, rows):
        spark.createDataFrame(rows, "k int, t int, v int").coalesce(1).write.parquet(os.path.join(root, "in", name))

    def run():
        source = I.arriving(spark, f"{root}/in/*", "k int, t int, v int", files_per_trigger=1)
        I.run_incremental(source, ["k"], ["t", "v"], [("negative", F.col("v") < 0, "negative")], f"{root}/ok", f"{root}/bad", f"{root}/cp")

    put("a", [(1, 5, 50), (1, 3, 30), (1, 3, 31), (2, 9, -9)] + [(7, i, i) for i in range(1, 500)])
    put("b", [(1, 1, 10), (3, 2, 20), (3, 1, 10), (2, 0, 1), (7, 0, 0)])
    put("c", [(3, 0, 1), (4, 0, 4)])
    whole, calls = I.first_per_key, []

    def breaks_on_third(*args):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return whole(*args)

    monkeypatch.setattr(I, "first_per_key", breaks_on_third)
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    rows = lambda t: sorted((r.k, r.t, r.v) for r in spark.read.parquet(f"{root}/{t}").collect())
    assert rows("ok") == [(1, 3, 30), (3, 1, 10), (4, 0, 4), (7, 1, 1)] and rows("bad") == [(2, 9, -9)]
    # Keys are remembered by the state store: a later batch reads its own files only.
    for part in ("0", "1"):
        shutil.move(f"{root}/cp/reduced/{part}", f"{root}/away{part}")
    put("d", [(1, 0, 1), (5, 0, 5)])
    run()
    assert rows("ok") == [(1, 3, 30), (3, 1, 10), (4, 0, 4), (5, 0, 5), (7, 1, 1)]


def test_vector_parts_round_trip_by_address(spark):
    folder = tempfile.mkdtemp(prefix="spark-") + "/parts"

    def put(ids, first):
        df = spark.createDataFrame([(i, "x", [float(i), i / 2]) for i in ids], "id long, note string, embedding array<float>")
        return O.write_vector_parts(df.repartition(5), ["id"], 10, folder, first)

    ids = random.Random(2).sample(range(1000), 37)
    book = put(ids, 0)
    assert book.columns == ["id", "note", "embedding_path", "embedding_row_offset", "embedding_dim", "embedding_format"]
    assert O.next_part(spark, folder) == 4
    more = put([5000, 5001], 4)
    put([5000, 5001], 4)
    assert len([f for f in os.listdir(folder + "/part=4") if f.endswith(".parquet")]) == 1
    both = book.unionByName(more)
    got = {r.id: (r.embedding, r.stage) for r in O.fetch_written_vectors(both, folder, 2).collect()}
    assert got == {i: ([float(i), i / 2], None) for i in [*ids, 5000, 5001]}
    at = [(r.id, r.embedding_row_offset) for r in book.where(f"embedding_path = '{folder}/part=1'").collect()]
    assert sorted(at) == [(i, k) for k, i in enumerate(sorted(ids)[10:20])]

    bad = [(1, f"{folder}/part=1", None), (2, f"{folder}/part=1", -1), (3, f"{folder}/part=3", 7), (4, f"{folder}/part=9", 0), (5, "elsewhere/part=1", 0), (6, None, 0), (7, f"{folder}/part=3", 6), (8, f"{folder}/part=3", 6)]
    asked = spark.createDataFrame(bad, "id long, embedding_path string, embedding_row_offset int")
    found = O.fetch_written_vectors(asked, folder, 2)
    last = max(ids)
    assert {r.id: (r.embedding, r.stage) for r in found.collect()} == {
        1: (None, "bad_offset"), 2: (None, "bad_offset"), 3: (None, "offset_out_of_range"), 4: (None, "missing_part"), 5: (None, "missing_part"), 6: (None, "missing_part"),
        7: ([float(last), last / 2], None), 8: ([float(last), last / 2], None),
    }
    assert {r.stage for r in O.fetch_written_vectors(asked.where("id > 6"), folder, 3).collect()} == {"dimension_mismatch"}
    # Only the named parts are read.
    scans = re.findall(r"PartitionFilters: \[(.*?)\]", found._jdf.queryExecution().executedPlan().toString())
    assert scans and all(re.search(r"part#\d+L? (IN|INSET) ", f) for f in scans), scans
    assert O.fetch_written_vectors(asked.limit(0), folder, 2).count() == 0


def test_tables_by_suffix(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    df = spark.createDataFrame([(1, 'a "quoted", text'), (2, None)], "k int, t string")
    for suffix in (".csv", ".csv.gz", ".parquet"):
        T.write_table(df, f"{root}/t{suffix}")
        assert sorted(map(tuple, T.read_table(spark, f"{root}/t{suffix}", "k int, t string").collect())) == [(1, 'a "quoted", text'), (2, None)]
    with pytest.raises(ValueError):
        T.read_table(spark, f"{root}/t.xlsx")


def test_failed_rows_keep_their_inputs(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 0.0)], "k int, v double")
    got = {r.k: (r.value, r.stage) for r in I.apply_rows(df, lambda r: 1.0 / r["v"], ["v"], "double").collect()}
    assert got[1] == (0.25, None) and got[2][1] == "row_function"
    routed = T.route(df, [("zero", F.col("v") == 0, "zero value")])
    with pytest.raises(RuntimeError):
        T.require_all_passed(routed)
    assert T.run_summary(routed).first().rows_failed == 1


def test_balanced_weights_of_many_classes(spark):
    rows = [(c, i) for c in range(1500) for i in range(1 + c % 3)]
    df = spark.createDataFrame(rows, "target int, i int")
    got = {r.target: r.weight for r in L.balanced_weights(df, df).select("target", "weight").distinct().collect()}
    assert len(got) == 1500 and all(abs(got[c] - len(rows) / (1500 * (1 + c % 3))) < 1e-9 for c in got)


def test_missing_metric_never_wins(spark):
    facts = spark.createDataFrame([("k", "a", None), ("k", "b", 0.9), ("l", "a", float("nan")), ("l", "b", 0.1)], "key string, model string, m double")
    order = spark.createDataFrame([("a", 1), ("b", 2)], "model string, place int")
    assert {r.model: r.win_count for r in P.win_counts(facts, "key", "model", "m", order).collect()} == {"a": 0, "b": 2}
    runs = spark.createDataFrame([("g", 1, None), ("g", 2, 0.9)], "g string, trial int, s double")
    assert L.compare_runs(runs, ["g"], "s").first()["best_trial"] == 2


def test_nan_is_no_value(spark):
    facts = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, float("nan"), None)], "m string, v double")
    row = P.metric_summary(facts, "m", ["v"]).first()
    assert (row.v_mean, row.v_std, row.v_median) == (2.0, 1.0, 2.0)


def test_tables_of_files_and_of_folders(spark, tmp_path):
    (tmp_path / "f.parquet" / "sub").mkdir(parents=True)
    for name, n in {"one.parquet": 3, "f.parquet/part-0000.parquet": 4, "f.parquet/sub/part-0001.parquet": 5, "f.parquet/_SUCCESS": 1, "bench.parquet": 6, "two.PARQUET": 7, "other.csv": 8}.items():
        (tmp_path / name).write_bytes(b"x" * n)
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        got = {tuple(r) for r in T.list_tables(spark, folder, [".Parquet"], ["BENCH"]).select("stem", "path", "length").collect()}
        assert got == {("one", f"{tmp_path}/one.parquet", 3), ("f", f"{tmp_path}/f.parquet", 9), ("two", f"{tmp_path}/two.PARQUET", 7)}


def test_tile_key_is_one_search(spark):
    names = ["1_2.png", "-1_-2", "12x-3y", "X5_y6.tif", "row3-col4.png", "c3_r4.x", "tile7.png", "123", "5,6", "1_2_3", "99999999999999999999_3.png", "", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", K.tile_key("n").alias("k"))
    none = (None, None)
    assert [tuple(r["k"]) for r in df.orderBy("i").collect()] == [(1, 2), (-1, -2), (12, 3), (5, 6), (3, 4), (3, 4), none, none, none, none, (None, 3), none, none]
    assert df.select("k.a", "k.b")._jdf.queryExecution().optimizedPlan().toString().count("regexp_") <= 8
