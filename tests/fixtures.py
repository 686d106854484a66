"""Hand-made rows (FIXTURES.md section 3) as DataFrames with the declared schemas."""

from datetime import date
from decimal import Decimal as D

from assetlens.sources import schemas

MAINTENANCE_ROWS = [
    ("WEL001", date(2020, 1, 1), D("100.00"), "Leak", 1),
    ("WEL001", date(2020, 1, 11), D("200.00"), "Corrosion", 2),
    ("WEL001", date(2020, 1, 31), D("300.00"), "Leak", 3),
    ("WEL001", date(2021, 1, 1), None, "Corrosion", 4),
    ("PIP001", date(2020, 5, 5), D("50.00"), None, None),
    ("REF001", date(2020, 3, 1), D("400.00"), "Valve", 600),
    ("REF001", date(2023, 3, 1), D("100.00"), "Valve", 0),
    ("REF001", date(2023, 3, 2), D("1.00"), "Leak", 0),
    ("WEL002", date(2021, 6, 1), D("75.25"), "Leak", 10),
    ("WEL003", date(2021, 7, 1), D("80.00"), "Leak", 12),
    ("XYZ001", date(2023, 1, 1), D("5.00"), "Sensor", 20),
]

PRODUCTION_ROWS = [
    ("WEL001", date(2020, 1, 1), 10, 100, D("10.00"), 1000, 50),
    ("WEL001", date(2020, 1, 2), 20, 100, D("20.00"), 1100, 50),
    ("WEL001", date(2020, 1, 3), 30, 100, D("30.00"), 1200, 50),
    ("WEL003", date(2020, 1, 1), 0, 10, D("5.00"), 900, 40),
    ("WEL003", date(2020, 1, 2), 0, 10, D("5.00"), 900, 40),
]

EMISSIONS_ROWS = [
    ("WEL001", D("1.00"), D("0.10"), D("5.00"), date(2020, 1, 1)),
    ("WEL001", D("1.01"), D("0.10"), D("5.00"), date(2020, 2, 1)),
    ("REF001", D("9.00"), D("0.50"), D("50.00"), date(2020, 1, 1)),
]


def tables(spark):
    m = spark.createDataFrame(MAINTENANCE_ROWS, schemas.MAINTENANCE)
    p = spark.createDataFrame(PRODUCTION_ROWS, schemas.PRODUCTION)
    e = spark.createDataFrame(EMISSIONS_ROWS, schemas.EMISSIONS)
    return m, p, e


def by(rows, key="asset_id"):
    return {r[key]: r for r in rows}
