"""Versioned marts, event ids over several loads, the stored asset view and rejects with reasons."""

import os
from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from assetlens.operators.risk import asset_reliability
from assetlens.sources import contract, files, schemas
from assetlens.sources.asset_mart import AssetMart, in_period
from assetlens.sources.marts import Mart

from fixtures import tables


@pytest.fixture()
def mart(spark, tmp_path):
    return Mart(spark, f"file://{tmp_path}/mart")


def test_versions_parts_and_vacuum(spark, mart):
    assert mart.version() == 0 and mart.parts() == {}
    with pytest.raises(ValueError):
        mart.read()
    mart.publish({"a": spark.range(3), "b": spark.range(10, 12)})
    mart.publish({"b": spark.range(20, 21)})
    ids = lambda **kw: sorted(r.id for r in mart.read(**kw).collect())
    assert ids() == [0, 1, 2, 20] and ids(version=1) == [0, 1, 2, 10, 11]
    assert sorted(r.id for r in mart.read("b").collect()) == [20]
    with pytest.raises(ValueError):
        mart.publish({"c": spark.range(1).withColumn("x", F.lit(1))})
    mart.publish({"whole": spark.range(5, 6)}, replace=True)
    assert ids() == [5]
    gone = mart.vacuum(keep=1)
    assert len([g for g in gone if g.startswith("data")]) == 3 and ids() == [5] and mart.version() == 3
    mart.publish({}, replace=True)
    assert mart.version() == 4


def test_failed_rebuild_leaves_the_old_rows(spark, mart):
    mart.publish({"all": spark.range(100)})
    # the write ends in the middle: some tasks have written files by then
    broken = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") > 900, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        mart.publish({"first": spark.range(7), "second": broken}, replace=True)
    assert mart.version() == 1 and mart.read().count() == 100
    mart.publish({"all": spark.range(3)}, replace=True)
    assert mart.read().count() == 3
    mart.vacuum()
    assert len(os.listdir(mart.path.removeprefix("file://") + "/data")) == 1


def test_two_writers_cannot_publish_one_version(spark, mart):
    mart.publish({"a": spark.range(1)})
    with pytest.raises(Exception, match="exist"):
        mart._commit(1, {"schema": "id bigint", "parts": {}})
    assert mart.read().count() == 1


def events(spark, rows):
    return spark.createDataFrame([(a, date(2024, 1, d), D(c), "Leak", h) for a, d, c, h in rows], schemas.MAINTENANCE)


def test_ids_stay_over_loads(spark, mart, monkeypatch):
    sorted_rows = []
    whole = contract.positions
    monkeypatch.setattr(contract, "positions", lambda df, *a, **k: sorted_rows.append(df.count()) or whole(df, *a, **k))
    first = [("B", 1, 5, 1), ("A", 2, 5, 1), ("A", 2, 5, 1), ("HOT", 3, 1, None)] + [("HOT", 4, 1, 1)] * 40
    one = {r.maintenance_id: tuple(r)[1:] for r in contract.append_keyed(mart, events(spark, first)).collect()}
    assert sorted(one) == list(range(1, 45))
    # one more of an equal row, a new asset that sorts before all, the old rows again
    later = first[::-1] + [("A", 2, 5, 1), ("0", 9, 5, 1), ("HOT", 4, 1, 1)]
    two = {r.maintenance_id: tuple(r)[1:] for r in contract.append_keyed(mart, events(spark, later)).collect()}
    assert sorted(two) == list(range(1, 48)) and all(two[i] == row for i, row in one.items())
    assert sorted_rows == [44, 3] and two[45][0] == "0"
    # the same load again adds nothing; a part of new rows only is taken as it is
    assert contract.append_keyed(mart, events(spark, later)).count() == 47
    assert contract.append_keyed(mart, events(spark, [("A", 2, 5, 1)]), whole=False).count() == 48
    assert mart.version() == 4 and len(mart.parts()) == 4


def more(spark):
    m, p, e = tables(spark)
    extra = [("HOT", date(2022, k % 12 + 1, 1 + k % 28), D(k), "Leak" if k % 3 else "Valve", k % 7) for k in range(200)]
    m = m.union(spark.createDataFrame(extra + [("WEL001", date(2022, 5, 5), D(9), "Corrosion", 7)], schemas.MAINTENANCE))
    e = e.union(spark.createDataFrame([("HOT", D(3), None, D(1), None), ("HOT", D(4), D(1), None, date(2022, 5, 9))], schemas.EMISSIONS))
    p = p.union(spark.createDataFrame([("WEL001", date(2022, 5, 1), 70, None, D("1.5"), None, 3)], schemas.PRODUCTION))
    return m, p, e


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange")


def test_view_from_states_needs_no_exchange(spark, tmp_path):
    m, p, e = more(spark)
    want = sorted(asset_reliability(m, p, e).collect())
    mart = AssetMart(spark, f"file://{tmp_path}/states", buckets=4, grain="year").build(m, p, e)
    view = mart.view()
    assert view.columns == asset_reliability(m, p, e).columns and sorted(view.collect()) == want
    assert exchanges(mart.view()) == 0 and exchanges(asset_reliability(m, p, e)) > 0
    assert mart.periods() == ["2020", "2021", "2022", "2023"]
    with pytest.raises(ValueError):
        mart.build(m, p, e)
    mart.close()
    # another session's empty catalog: the partitions are found again
    again = AssetMart(spark, f"file://{tmp_path}/states", buckets=4, grain="year")
    again.put("2022", m, p, e)
    assert sorted(again.view().collect()) == want and exchanges(again.view()) == 0
    again.close()


def files_of(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_adding_a_period_reads_and_writes_that_period_only(spark, tmp_path):
    m, p, e = more(spark)
    dates = ("maintenance_date", "production_date", "reading_date")
    mart = AssetMart(spark, f"file://{tmp_path}/states", buckets=4, grain="month")
    mart.build(*[t.where(~F.coalesce(in_period(d, "2022-05"), F.lit(False))) for t, d in zip((m, p, e), dates)])
    before = files_of(tmp_path / "states")
    # rows of any other period would end the job
    poisoned = [t.withColumn(t.columns[0], F.when(F.coalesce(in_period(d, "2022-05"), F.lit(False)), F.col(t.columns[0]))
                             .otherwise(F.raise_error(F.lit("row of another period")))) for t, d in zip((m, p, e), dates)]
    mart.put("2022-05", *poisoned)
    assert before < files_of(tmp_path / "states") and "2022-05" in mart.periods() and "none" not in mart.periods()
    assert sorted(mart.view().collect()) == sorted(asset_reliability(m, p, e).collect())
    # a corrected period replaces its states
    fixed = m.where("not (asset_id = 'HOT' and maintenance_date >= '2022-05-01' and maintenance_date < '2022-06-01')")
    mart.put("2022-05", fixed, p, e)
    assert sorted(mart.view().collect()) == sorted(asset_reliability(fixed, p, e).collect())
    mart.close()


def test_period_filter_reaches_the_scan(spark, tmp_path):
    m, _, _ = more(spark)
    m.write.parquet(f"{tmp_path}/m")
    plan = spark.read.parquet(f"{tmp_path}/m").where(in_period("maintenance_date", "2022-05"))._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters")[1]
    assert "GreaterThanOrEqual(maintenance_date,2022-05-01)" in pushed and "LessThan(maintenan" in pushed


def test_rejects_name_every_broken_rule(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("asset_id,maintenance_date,cost_usd,failure_type,downtime_hours\n"
                    "WEL001,2020-01-01,1.5,Leak,3\n"
                    ",2020-01-01,abc,Leak,x\n"
                    "WEL002,01/02/2020,1,Leak,1\n"
                    "WEL003,,2,,\n"
                    "WEL004,2020-01-01,5\n"
                    "WEL005,2020-01-01,5,\"a, b\",1\n"
                    "WEL006,2020-01-01,5,a,1,more\n")
    loaded = files.read_maintenance_csv(spark, str(path), "PERMISSIVE")
    good, bad = contract.split_rejects(loaded, schemas.MAINTENANCE)
    assert good.columns == [f.name for f in schemas.MAINTENANCE.fields]
    assert [r.asset_id for r in good.orderBy("asset_id").collect()] == ["WEL001", "WEL005"]
    found = {r.asset_id: r._reasons for r in bad.collect()}
    assert found == {
        None: ["unreadable cost_usd", "unreadable downtime_hours", "missing asset_id"],
        "WEL002": ["unreadable maintenance_date"],
        "WEL003": ["missing maintenance_date"],
        "WEL004": ["wrong number of fields"],
        "WEL006": ["wrong number of fields"]}
    counts = {r.reason: r.row_count for r in contract.reason_counts(bad).collect()}
    assert counts == {"wrong number of fields": 2, "unreadable cost_usd": 1, "unreadable downtime_hours": 1, "missing asset_id": 1,
                      "unreadable maintenance_date": 1, "missing maintenance_date": 1}
    # frames that no reader judged
    plain = spark.createDataFrame([(None, date(2020, 1, 1), None, None, None), ("A", None, None, None, None)], "asset_id string, maintenance_date date, "
                                  "cost_usd decimal(14,2), failure_type string, downtime_hours int")
    assert sorted(r._reasons for r in contract.split_rejects(plain, schemas.MAINTENANCE)[1].collect()) == [["missing asset_id"], ["missing maintenance_date"]]
    assert contract.split_rejects(loaded.where("false"), schemas.MAINTENANCE)[1].count() == 0
