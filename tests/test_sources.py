"""CSV load contract, schema contract and the test-data projection."""

import os
import tempfile
from datetime import date
from decimal import Decimal as D

import pytest

from assetlens.sources import contract, files, projection, schemas


def _write(text):
    d = tempfile.mkdtemp(prefix="assetlens-csv-")
    path = os.path.join(d, "data.csv")
    with open(path, "w") as fh:
        fh.write(text)
    return path


def test_maintenance_csv_empty_vs_quoted_empty(spark):
    path = _write("asset_id,maintenance_date,cost_usd,failure_type,downtime_hours\n"
                  "WEL001,2020-01-01,1.005,,4\n"
                  'PIP001,2020-01-02,,"",\n')
    rows = files.read_maintenance_csv(spark, path).orderBy("asset_id").collect()
    assert rows[0].asset_id == "PIP001"
    assert rows[0].cost_usd is None and rows[0].failure_type == "" and rows[0].downtime_hours is None
    assert rows[1].cost_usd == D("1.01") and rows[1].failure_type is None
    assert rows[1].maintenance_date == date(2020, 1, 1)


def test_production_csv_is_positional(spark):
    path = _write("well_id,date,oil,gas,water,pressure,temp\n"
                  "WEL001,2021-03-04,10,20,12.5,900,40\n")
    df = files.read_production_csv(spark, path)
    assert df.columns == [f.name for f in schemas.PRODUCTION.fields]
    r = df.first()
    assert r.production_date == date(2021, 3, 4) and r.water_cut_pct == D("12.50")


def test_emissions_csv_bad_value_fails(spark):
    path = _write("asset_id,co2,ch4,mwh,reading_date\nREF1,abc,1,1,2020-01-01\n")
    with pytest.raises(Exception):
        files.read_emissions_csv(spark, path).collect()


def test_not_null_contract(spark):
    good = spark.createDataFrame([("WEL1", date(2020, 1, 1), None, None, None)],
                                 "asset_id string, maintenance_date date, cost_usd decimal(14,2), "
                                 "failure_type string, downtime_hours int")
    bad = spark.createDataFrame([(None, date(2020, 1, 1), None, None, None)], good.schema)
    assert contract.enforce(good, schemas.MAINTENANCE).count() == 1
    with pytest.raises(ValueError):
        contract.enforce(bad, schemas.MAINTENANCE)
    ok, quarantined = contract.split_valid(good.unionByName(bad), schemas.MAINTENANCE)
    assert (ok.count(), quarantined.count()) == (1, 1)


def test_parquet_roundtrip(spark):
    from fixtures import tables
    m, _, _ = tables(spark)
    out = os.path.join(tempfile.mkdtemp(prefix="assetlens-pq-"), "maintenance")
    files.write_table(m, out)
    back = files.read_table(spark, out, "maintenance")
    assert [f.dataType for f in back.schema.fields] == [f.dataType for f in m.schema.fields]
    assert back.count() == 11


def test_projection_shapes(spark):
    d = "/root/testdata/sf0.001"
    m, p, e = projection.tables(spark, d)
    assert m.columns == [f.name for f in schemas.MAINTENANCE.fields]
    assert p.columns == [f.name for f in schemas.PRODUCTION.fields]
    assert e.columns == [f.name for f in schemas.EMISSIONS.fields]
    lineitem = spark.read.parquet(f"{d}/lineitem.parquet").count()
    assert m.count() == lineitem                       # every event row is used
    assert p.where("left(well_id, 3) <> 'WEL'").count() == 0
    assert p.count() == spark.read.parquet(f"{d}/orders.parquet").count()
    assert e.count() == spark.read.parquet(f"{d}/events.parquet").count()
    assert dict(zip(m.schema.names, [f.dataType.simpleString() for f in m.schema.fields]))["cost_usd"] == "decimal(14,2)"


def test_reliability_mart_partitioned_by_class(spark):
    from fixtures import tables
    from assetlens.operators import risk
    view = risk.asset_reliability(*tables(spark))
    out = os.path.join(tempfile.mkdtemp(prefix="assetlens-mart-"), "v_asset_reliability")
    files.write_table(view, out, partition_by=["asset_type"])
    files.write_table(view, out, partition_by=["asset_type"])      # rebuild is idempotent
    wells = spark.read.parquet(out).where("asset_type = 'Well'")
    plan = wells._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(asset_type" in plan and "Well" in plan
    assert wells.count() == 3


def _csv(text):
    path = os.path.join(tempfile.mkdtemp(prefix="assetlens-csv-"), "m.csv")
    with open(path, "w") as f:
        f.write("asset_id,maintenance_date,cost_usd,failure_type,downtime_hours\n" + text)
    return path


def test_csv_quotes_backslashes_and_null_marker(spark):
    path = _csv('A,2024-01-01,1.00,"seal ""B"" leak, minor",1\n'
                'B,2024-01-01,1.00,"path C:\\",2\n'
                'C,2024-01-01,1.00,\\N,3\nD,2024-01-01,,"",\nE,2024-01-01,2,,4\n')
    rows = {r.asset_id: r for r in files.read_maintenance_csv(spark, path).collect()}
    assert [rows[k].failure_type for k in "ABCDE"] == ['seal "B" leak, minor', "path C:\\", "\\N", "", None]
    assert rows["D"].cost_usd is None and rows["D"].downtime_hours is None


def test_csv_line_end_in_a_field(spark):
    path = _csv('A,2024-01-01,1.00,"two\nlines",1\n')
    assert files.read_maintenance_csv(spark, path, multiline=True).first().failure_type == "two\nlines"
    with pytest.raises(Exception):
        contract.enforce(files.read_maintenance_csv(spark, path), schemas.MAINTENANCE)


@pytest.mark.parametrize("bad", ["B,2024-01-01,abc,x,1\n", "B,2024-01-01,1.00,x\n", ",2024-01-01,1.00,x,1\n"])
def test_contract_sees_every_cell(spark, bad):
    path = _csv("A,2024-01-01,1.00,x,1\n" + bad)
    with pytest.raises(Exception):
        contract.enforce(files.read_maintenance_csv(spark, path), schemas.MAINTENANCE)
    good, out = contract.split_valid(files.read_maintenance_csv(spark, path, "PERMISSIVE"), schemas.MAINTENANCE)
    assert (good.count(), out.count()) == (1, 1)
    assert good.columns == [f.name for f in schemas.MAINTENANCE.fields]
