"""Map the driver's test tables onto the three domain tables.

The test data ships TPC-H-like tables, not maintenance records. These
definitions (ours) turn ``lineitem`` into maintenance events, ``orders`` into
well production readings and ``events`` into emissions readings. The same
SQL text feeds both Spark (``selectExpr``) and the DuckDB oracle, so the two
engines see identical inputs. Every row of each source table is used. Only
wells produce, so every customer key maps to a well id (keys ending in 6-9
share the well of the key ending in 0-3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def prefixed_id(k: str) -> str:
    """Asset id from an integer key: class prefix + 7-digit zero-padded key."""
    return (f"concat(case when {k} % 40 = 39 then 'XXX' when {k} % 10 < 6 then 'WEL' "
            f"when {k} % 10 < 8 then 'PIP' else 'REF' end, "
            f"lpad(cast({k} as string), 7, '0'))")


MAINTENANCE_SELECT = [
    f"{prefixed_id('l_partkey')} as asset_id",
    "cast(l_shipdate as date) as maintenance_date",
    "case when (l_orderkey * 7 + l_linenumber) % 97 = 0 then null "
    "else cast(l_extendedprice as decimal(14,2)) end as cost_usd",
    "case when l_linenumber = 7 and l_orderkey % 5 = 0 then null "
    "when l_returnflag = 'A' and l_linestatus = 'F' then 'Corrosion' "
    "when l_returnflag = 'A' then 'Leak' "
    "when l_returnflag = 'N' and l_linestatus = 'F' then 'Electrical' "
    "when l_returnflag = 'N' then 'Mechanical' "
    "when l_linestatus = 'F' then 'Sensor' else 'Valve' end as failure_type",
    "case when l_partkey % 211 = 7 or (l_orderkey + l_partkey) % 101 = 0 then null "
    "else cast(l_quantity as int) * cast(1 + l_partkey % 5 as int) end as downtime_hours",
]

PRODUCTION_SELECT = [
    f"{prefixed_id('(o_custkey - o_custkey % 10 + o_custkey % 10 % 6)')} as well_id",
    "cast(o_orderdate as date) as production_date",
    "case when o_custkey % 30 = 0 then 0 "
    "else cast(floor(o_totalprice / 100) as int) end as oil_production_barrels",
    "cast(floor(o_totalprice / 40) as int) as gas_production_mcf",
    "cast(cast(o_orderkey % 10000 as double) / 100 as decimal(6,2)) as water_cut_pct",
    "cast(500 + o_orderkey % 4000 as int) as pressure_psi",
    "cast(20 + o_orderkey % 100 as int) as temperature_c",
]

EMISSIONS_SELECT = [
    f"{prefixed_id('(user_id * 10 + event_id % 10)')} as asset_id",
    "cast(value as decimal(12,2)) as co2_tons",
    "cast(cast(event_id % 500 as double) / 100 as decimal(12,2)) as methane_leakage_tons",
    "cast(cast((event_id * 37) % 100000 as double) / 100 as decimal(14,2)) "
    "as energy_consumption_mwh",
    "cast(ts as date) as reading_date",
]


# Cells of a maintenance CSV file as text, with the defects that real files have:
# blank and unreadable cells, and lines that end after three cells.
RAW_CELLS = [
    f"case when l_orderkey % 61 = 0 then '' else {prefixed_id('l_partkey')} end",
    "case when l_orderkey % 59 = 0 then '' when l_orderkey % 67 = 0 then '1995-13-40' "
    "else cast(cast(l_shipdate as date) as string) end",
    "case when l_orderkey % 71 = 0 then 'n/a' when l_orderkey % 13 = 0 then '' "
    "else cast(cast(l_extendedprice as decimal(14,2)) as string) end",
    "case when l_returnflag = 'A' then 'Leak' when l_returnflag = 'N' then 'Valve' else '' end",
    "case when (l_orderkey + l_linenumber) % 73 = 0 then '12h' else cast(cast(l_quantity as int) as string) end",
]
RAW_SHORT = "(l_orderkey + l_linenumber) % 83 = 0"


def raw_maintenance_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV line per row of ``lineitem``, defects included (column ``value``)."""
    cells = [f"{c}" for c in RAW_CELLS]
    return _read(spark, sf_dir, "lineitem").selectExpr(
        f"case when {RAW_SHORT} then concat_ws(',', {', '.join(cells[:3])}) else concat_ws(',', {', '.join(cells)}) end as value")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr(*MAINTENANCE_SELECT)


def production(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr(*PRODUCTION_SELECT)


def emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr(*EMISSIONS_SELECT)


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return maintenance(spark, sf_dir), production(spark, sf_dir), emissions(spark, sf_dir)


def duckdb_ctes() -> str:
    """The same projection as DuckDB CTEs named maintenance/production/emissions."""
    m = ",\n  ".join(MAINTENANCE_SELECT)
    p = ",\n  ".join(PRODUCTION_SELECT)
    e = ",\n  ".join(EMISSIONS_SELECT)
    return (f"maintenance AS (SELECT\n  {m}\nFROM lineitem),\n"
            f"production AS (SELECT\n  {p}\nFROM orders),\n"
            f"emissions AS (SELECT\n  {e}\nFROM events)")
