"""Distributed ranking equals the built-in single-partition window functions."""

import random
from decimal import Decimal as D

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from assetlens.plans import ranking


def _data(spark, n, seed, heavy=True):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        r = rnd.random()
        if r < 0.1:
            v = None
        elif heavy and r < 0.45:          # one value holds about a third of the rows
            v = 7
        else:
            v = rnd.randint(0, 50)
        c = None if rnd.random() < 0.05 else D(rnd.randint(0, 10_000)) / 100
        rows.append((f"A{i:05d}", v, c))
    return spark.createDataFrame(rows, "asset_id string, v long, c decimal(14,2)")


@pytest.mark.parametrize("buckets", [1, 3, 8])
def test_positions_match_row_number_and_running_sum(spark, buckets):
    df = _data(spark, 400, buckets)
    order = [F.col("v").desc_nulls_first(), F.col("asset_id").asc()]
    got = ranking.positions(df, order, sums={"c": F.col("c")}, buckets=buckets)
    w = Window.orderBy(*order)
    want = df.select(
        "asset_id", F.row_number().over(w).alias("pos"),
        F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("cum"),
        F.sum("c").over(Window.partitionBy()).alias("tot"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    g = {r.asset_id: (r._pos, r._cum_c, r._tot_c, r._n) for r in got.collect()}
    e = {r.asset_id: (r.pos, r.cum, r.tot, r.n) for r in want.collect()}
    assert g == e


@pytest.mark.parametrize("buckets", [1, 5])
def test_ntiles_match_builtin(spark, buckets):
    df = _data(spark, 203, 11 + buckets)
    got = ranking.with_ntiles(df, [("q_v", "v", True, True), ("q_c", "c", False, False)], 4,
                              buckets=buckets)
    want = df.select(
        "asset_id",
        F.ntile(4).over(Window.orderBy(F.col("v").desc_nulls_first(), "asset_id")).alias("q_v"),
        F.ntile(4).over(Window.orderBy(F.col("c").asc_nulls_last(), "asset_id")).alias("q_c"))
    assert ({r.asset_id: (r.q_v, r.q_c) for r in got.collect()}
            == {r.asset_id: (r.q_v, r.q_c) for r in want.collect()})
    single = ranking.with_ntile(df, [F.col("v").desc_nulls_first(), F.col("asset_id")], 4, "q",
                                buckets=buckets)
    assert {r.asset_id: r.q for r in single.collect()} == {r.asset_id: r.q_v for r in want.collect()}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17])
def test_ntile_small_fleets(spark, n):
    df = spark.createDataFrame([(f"A{i}", i) for i in range(n)], "asset_id string, v long")
    got = ranking.with_ntile(df, [F.col("v").desc(), F.col("asset_id")], 4, "q", buckets=2)
    want = df.select("asset_id", F.ntile(4).over(Window.orderBy(F.col("v").desc(), "asset_id")).alias("q"))
    assert {r.asset_id: r.q for r in got.collect()} == {r.asset_id: r.q for r in want.collect()}
    if n == 5:
        sizes = sorted(r["count"] for r in got.groupBy("q").count().collect())
        assert sizes == [1, 1, 1, 2]


@pytest.mark.parametrize("buckets", [1, 4])
def test_ranks_match_builtin_rank(spark, buckets):
    df = _data(spark, 300, 40 + buckets)
    got = ranking.with_ranks(df, {"v": "rv", "c": "rc"}, buckets=buckets)
    want = df.select(
        "asset_id",
        F.rank().over(Window.orderBy(F.col("v").asc_nulls_last())).alias("rv"),
        F.rank().over(Window.orderBy(F.col("c").asc_nulls_last())).alias("rc"))
    g = {r.asset_id: (r.rv, r.rc, r._n) for r in got.collect()}
    assert g == {r.asset_id: (r.rv, r.rc, 300) for r in want.collect()}


def test_percentile_cont_matches_exact_percentile(spark):
    df = _data(spark, 250, 99)
    got = ranking.percentile_conts(df, ["v", "c"], 0.9, buckets=3)
    vals_v = sorted(r.v for r in df.collect() if r.v is not None)
    vals_c = sorted(float(r.c) for r in df.collect() if r.c is not None)

    def pg(vals, p):
        pos = p * float(len(vals) - 1)
        lo, hi = int(pos // 1), -int(-pos // 1)
        return vals[lo] if lo == hi else vals[lo] + (vals[hi] - vals[lo]) * (pos - lo)
    assert got[0] == pg([float(x) for x in vals_v], 0.9)
    assert got[1] == pg(vals_c, 0.9)
    assert ranking.percentile_conts(df.where("false"), ["v"], 0.9) == [None]


def test_surrogate_key_is_dense_and_stable(spark):
    from assetlens.sources.contract import with_surrogate_key
    df = _data(spark, 120, 5)
    a = {(r.asset_id): r.maintenance_id for r in with_surrogate_key(df).collect()}
    b = {(r.asset_id): r.maintenance_id for r in with_surrogate_key(df.repartition(7)).collect()}
    assert sorted(a.values()) == list(range(1, 121))
    assert a == b


def test_stacking_refuses_lossy_types(spark):
    df = spark.createDataFrame([("A", 1.5)], "asset_id string, x double")
    with pytest.raises(TypeError):
        ranking.rank_tables(df, ["x"])
    df = spark.createDataFrame([("A", D("1.1234567"))], "asset_id string, x decimal(20,7)")
    with pytest.raises(TypeError):
        ranking.with_ntiles(df, [("q", "x", True, True)], 4)


def test_surrogate_key_splits_identical_rows(spark):
    from assetlens.sources.contract import with_surrogate_key
    # a third of the rows are one identical record
    rows = [("HOT", 1)] * 300 + [(f"A{i:04d}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "asset_id string, v long").repartition(6)
    keyed = with_surrogate_key(df)
    ids = sorted(r.maintenance_id for r in keyed.collect())
    assert ids == list(range(1, 901))
    hot = sorted(r.maintenance_id for r in keyed.where("asset_id = 'HOT'").collect())
    assert hot == list(range(601, 901))     # 'HOT' sorts after every 'A....'


def test_ranks_one_plan_on_ties_nulls_and_distinct_values(spark):
    rows = [(f"A{i:03d}", 5 if i % 3 else i, None if i % 4 else i, i * 7 % 151) for i in range(150)]
    df = spark.createDataFrame(rows, "asset_id string, v long, c long, d long")
    metrics = {"v": "rv", "c": "rc", "d": "rd"}
    for buckets in (None, 3):
        got = ranking.with_ranks(df, metrics, buckets=buckets)
        want = df.select("asset_id", *[F.rank().over(Window.orderBy(F.col(c).asc_nulls_last())).alias(r)
                                       for c, r in metrics.items()])
        assert ({r.asset_id: (r.rv, r.rc, r.rd, r._n) for r in got.collect()}
                == {r.asset_id: (r.rv, r.rc, r.rd, 150) for r in want.collect()})


def test_owned_tables_go_after_an_error(spark):
    import os
    with pytest.raises(RuntimeError):
        with ranking.owned(spark) as scratch:
            ranking.materialize(spark.range(3))
            folder = scratch.path.removeprefix("file:")
            assert os.path.isdir(folder)
            raise RuntimeError
    assert not os.path.exists(folder)
