"""Properties over whole test tables (sf0.001) and the CSV load path."""

import os
import tempfile
from collections import Counter
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from assetlens.operators import cost, legacy, reliability, risk
from assetlens.sources import files, projection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def mpe(spark):
    return projection.tables(spark, SF)


@pytest.fixture(scope="module")
def view(mpe):
    return risk.asset_reliability(*mpe)


def test_one_row_per_asset(mpe, view):
    m = mpe[0]
    assert view.count() == view.select("asset_id").distinct().count() == \
        m.select("asset_id").distinct().count()


def test_pareto_shares(mpe):
    rows = cost.cost_concentration(mpe[0]).collect()
    assert [r.cost_rank for r in rows] == list(range(1, len(rows) + 1))
    cums = [r.cumulative_pct_of_spend for r in rows if r.cumulative_pct_of_spend is not None]
    assert cums == sorted(cums) and cums[-1] == D("100.00")
    assert abs(sum(r.pct_of_total_spend for r in rows if r.pct_of_total_spend is not None) - 100) < D("0.5")
    hours = reliability.downtime_concentration(mpe[0]).collect()
    # assets whose downtime is all NULL come first (PostgreSQL DESC order) with NULL shares
    nulls = [r for r in hours if r.total_downtime is None]
    assert all(r.downtime_rank <= len(nulls) for r in nulls)
    assert all(r.cumulative_pct_of_downtime is None for r in nulls)


def test_quartile_sizes(mpe):
    rows = cost.cost_efficiency_bands(*mpe[:2]).collect()
    sizes = Counter(r.efficiency_band for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sizes["Worst quarter, review first"] >= sizes["Best quarter, leave alone"]


def test_scores_and_bands(view):
    scored = risk.risk_scores(view)
    rows = scored.collect()
    assert all(D("0") <= r.risk_score <= D("100") for r in rows)
    bands = risk.action_bands(scored).collect()
    assert sum(b.assets for b in bands) == len(rows)
    assert sum(b.cost_covered for b in bands) == sum(r.total_maintenance_cost or 0 for r in rows)
    top = risk.worklist(scored).collect()
    assert [r.priority for r in top] == list(range(1, len(top) + 1))
    assert len(top) == sum(1 for r in rows if r.risk_score >= 95)


def test_fanout_true_totals_match_base(mpe):
    m = mpe[0]
    audit = legacy.fanout_audit(*mpe)
    got = audit.agg(F.sum("maintenance_events").alias("n"), F.sum("true_downtime_hours").alias("h"),
                    F.sum("true_maintenance_cost").alias("c")).first()
    want = m.agg(F.count(F.lit(1)).alias("n"), F.sum("downtime_hours").alias("h"),
                 F.sum("cost_usd").alias("c")).first()
    assert (got.n, got.h, got.c) == (want.n, want.h, want.c)
    assert audit.where("joined_rows < maintenance_events").count() == 0


def test_csv_route_equals_parquet_route(spark, mpe):
    out = tempfile.mkdtemp(prefix="assetlens-csvroute-")
    paths = {}
    for name, df in zip(("maintenance", "production", "emissions"), mpe):
        paths[name] = os.path.join(out, name)
        # unquoted empty fields for NULL, as a PostgreSQL CSV export writes them
        df.write.option("header", True).option("nullValue", "").option("emptyValue", '""') \
            .csv(paths[name])
    m = files.read_maintenance_csv(spark, paths["maintenance"])
    p = files.read_production_csv(spark, paths["production"])
    e = files.read_emissions_csv(spark, paths["emissions"])
    a = risk.risk_scores(risk.asset_reliability(m, p, e)).collect()
    b = risk.risk_scores(risk.asset_reliability(*mpe)).collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_hot_asset_holding_a_third_of_events(spark, mpe):
    m, p, e = mpe
    n = m.count()
    # copy one asset's events until it holds about a third of the table
    first = m.select("asset_id").orderBy("asset_id").first().asset_id
    base = m.where(F.col("asset_id") == first)
    k = max(1, (n // 2) // base.count())
    copies = base.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(k)))).drop("_c")
    skewed = m.where(F.col("asset_id") != first).unionByName(copies)
    share = skewed.where(F.col("asset_id") == first).count() / skewed.count()
    assert share > 0.3
    rows = {r.asset_id: r for r in cost.cost_by_asset(skewed).collect()}
    want = copies.agg(F.count(F.lit(1)).alias("n"), F.sum("cost_usd").alias("c")).first()
    assert (rows[first].maintenance_events, rows[first].total_maintenance_cost) == (want.n, want.c)
    plan = cost.cost_by_asset(skewed)._jdf.queryExecution().executedPlan().toString()
    # partial aggregation runs before the shuffle on asset_id (map-side combine)
    assert plan.index("partial_count") > plan.index("Exchange hashpartitioning(asset_id")
    scored = risk.risk_scores(risk.asset_reliability(skewed, p, e)).collect()
    assert len(scored) == len(rows)


def test_command_line_runner(spark, mpe):
    from assetlens.cli import main
    src = tempfile.mkdtemp(prefix="assetlens-cli-in-")
    paths = []
    for name, df in zip(("maintenance", "production", "emissions"), mpe):
        paths.append(os.path.join(src, name))
        df.write.option("header", True).option("nullValue", "").option("emptyValue", '""') \
            .csv(paths[-1])
    out = os.path.join(tempfile.mkdtemp(prefix="assetlens-cli-out-"), "results")
    assert main(["--maintenance", paths[0], "--production", paths[1], "--emissions", paths[2],
                 "--query", "worklist", "--query", "dq_row_counts", "--validate",
                 "--out", out]) == 0
    got = spark.read.parquet(os.path.join(out, "worklist")).orderBy("priority").collect()
    want = risk.worklist(risk.risk_scores(risk.asset_reliability(*mpe))).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    counts = {r.table_name: r.row_count for r in spark.read.parquet(os.path.join(out, "dq_row_counts")).collect()}
    assert counts["maintenance"] == mpe[0].count()
