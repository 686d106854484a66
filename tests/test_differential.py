"""Random domain tables: every named query against its DuckDB text.

The generated data has what the projected test tables lack: negative costs
and hours, many NULLs, zero and NULL oil, wells without production,
emissions for assets never maintained, lower-case and unknown prefixes,
single-event assets and heavy ties.
"""

import random
from datetime import date, timedelta
from decimal import Decimal as D

import duckdb
import pytest

from assetlens.catalog import OPERATORS, conform
from assetlens.oracle import domain_sql
from assetlens.sources import schemas

from oracle_check import rows_of

DDL = {
    "maintenance": "asset_id VARCHAR, maintenance_date DATE, cost_usd DECIMAL(14,2), "
                   "failure_type VARCHAR, downtime_hours INTEGER",
    "production": "well_id VARCHAR, production_date DATE, oil_production_barrels INTEGER, "
                  "gas_production_mcf INTEGER, water_cut_pct DECIMAL(6,2), pressure_psi INTEGER, "
                  "temperature_c INTEGER",
    "emissions": "asset_id VARCHAR, co2_tons DECIMAL(12,2), methane_leakage_tons DECIMAL(12,2), "
                 "energy_consumption_mwh DECIMAL(14,2), reading_date DATE",
}


def _maybe(rnd, p, v):
    return None if rnd.random() < p else v


def generate(seed: int):
    rnd = random.Random(seed)
    prefixes = ["WEL", "WEL", "WEL", "PIP", "REF", "XYZ", "wel"]
    assets = [f"{rnd.choice(prefixes)}{i:03d}" for i in range(rnd.randint(1, 40))]
    types = ["Corrosion", "Leak", "Valve", "Sensor"]
    d0 = date(2019, 1, 1)
    m = []
    for a in assets:
        for _ in range(rnd.choice([1, 1, 2, 3, 5, 8, 13])):
            m.append((a, d0 + timedelta(days=rnd.randint(0, 2000)),
                      _maybe(rnd, 0.15, D(rnd.randint(-5000, 500000)) / 100),
                      _maybe(rnd, 0.15, rnd.choice(types)),
                      _maybe(rnd, 0.2, rnd.choice([0, 1, 2, 5, 10, 24, 100, -3]))))
    wells = [a for a in assets if a.startswith("WEL")] + ["WEL999"]
    p = []
    for w in rnd.sample(wells, k=max(1, len(wells) * 2 // 3)):
        for _ in range(rnd.randint(1, 6)):
            p.append((w, d0 + timedelta(days=rnd.randint(0, 2000)),
                      _maybe(rnd, 0.1, rnd.choice([0, 0, 10, 250, 1000])),
                      _maybe(rnd, 0.1, rnd.randint(0, 9000)),
                      _maybe(rnd, 0.1, D(rnd.randint(0, 9999)) / 100),
                      _maybe(rnd, 0.1, rnd.randint(200, 5000)),
                      _maybe(rnd, 0.1, rnd.randint(0, 120))))
    e = []
    for a in rnd.sample(assets, k=len(assets) // 2) + ["REF998"]:
        for _ in range(rnd.randint(1, 4)):
            e.append((a, _maybe(rnd, 0.1, D(rnd.randint(0, 100000)) / 100),
                      _maybe(rnd, 0.1, D(rnd.randint(0, 500)) / 100),
                      _maybe(rnd, 0.1, D(rnd.randint(0, 99999)) / 100),
                      _maybe(rnd, 0.2, d0 + timedelta(days=rnd.randint(0, 2000)))))
    return m, p, e


@pytest.mark.parametrize("seed", [1, 2])
def test_every_query_matches_duckdb_on_random_tables(spark, seed):
    m_rows, p_rows, e_rows = generate(seed)
    frames = [spark.createDataFrame(rows, schema) for rows, schema in
              ((m_rows, schemas.MAINTENANCE), (p_rows, schemas.PRODUCTION),
               (e_rows, schemas.EMISSIONS))]
    con = duckdb.connect()
    for (name, ddl), rows in zip(DDL.items(), (m_rows, p_rows, e_rows)):
        con.execute(f"CREATE TABLE {name} ({ddl})")
        if rows:
            marks = ", ".join("?" * len(rows[0]))
            con.executemany(f"INSERT INTO {name} VALUES ({marks})", rows)
    sql = domain_sql()
    bad = []
    for key, op in OPERATORS.items():
        sdf = conform(op(*frames), key)
        cols = sorted(sdf.columns)
        got = rows_of([r.asDict() for r in sdf.collect()], cols)
        rel = con.sql(sql[key])
        want = rows_of([dict(zip(rel.columns, r)) for r in rel.fetchall()], cols)
        if got != want:
            bad.append((key, [r for r in got if r not in want][:2], [r for r in want if r not in got][:2]))
    assert not bad, bad
