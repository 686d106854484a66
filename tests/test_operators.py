"""Golden cases from the reference's worked examples (FIXTURES.md section 3)."""

from decimal import Decimal as D

import pytest

from assetlens.functions.exprs import asset_class
from assetlens.operators import cost, legacy, quality, reliability, risk

from fixtures import by, tables


@pytest.fixture(scope="module")
def mpe(spark):
    return tables(spark)


def test_asset_class_labels(spark):
    df = spark.createDataFrame([("WEL1",), ("PIP9",), ("REF0",), ("wel1",), ("XYZ",), (None,), ("WE",)],
                               "id string")
    got = [r[0] for r in df.select(asset_class("id")).collect()]
    assert got == ["Well", "Pipeline", "Refinery", "Unknown", "Unknown", "Unknown", "Unknown"]
    assert spark.sql("select asset_class('REF12') c").first()["c"] == "Refinery"


def test_cost_by_asset_skips_null_cost_in_average(mpe):
    m, _, _ = mpe
    rows = by(cost.cost_by_asset(m).collect())
    w = rows["WEL001"]
    assert (w.maintenance_events, w.total_maintenance_cost, w.avg_cost_per_event) == (4, D("600.00"), D("200.00"))
    assert w.asset_type == "Well" and rows["XYZ001"].asset_type == "Unknown"
    ordered = [r.asset_id for r in cost.cost_by_asset(m).collect()]
    assert ordered[0] == "WEL001" and ordered[1] == "REF001"


def test_cost_vs_production_wells_only(mpe):
    m, p, _ = mpe
    rows = by(cost.cost_vs_production(m, p).collect())
    assert set(rows) == {"WEL001", "WEL002", "WEL003"}
    assert rows["WEL001"].maintenance_cost_per_barrel == D("10.00")
    assert rows["WEL002"].production_readings is None
    assert rows["WEL003"].total_oil_barrels == 0
    assert rows["WEL003"].maintenance_cost_per_barrel is None


def test_wells_without_production(mpe):
    m, p, _ = mpe
    rows = cost.wells_without_production(m, p).collect()
    assert [(r.asset_id, r.total_maintenance_cost, r.total_downtime_hours) for r in rows] == [
        ("WEL002", D("75.25"), 10)]


def test_cost_yearly_lag_spans_missing_year(mpe):
    m, _, _ = mpe
    rows = [(r.year, r.total_cost, r.pct_change_vs_prior_year) for r in cost.cost_yearly(m).collect()]
    assert rows == [(2020, D("1050.00"), None), (2021, D("155.25"), D("-85.21")),
                    (2023, D("106.00"), D("-31.72"))]


def test_cost_concentration_pareto(mpe):
    m, _, _ = mpe
    rows = cost.cost_concentration(m, buckets=3).collect()
    assert [r.cost_rank for r in rows] == list(range(1, 7))
    assert rows[0].asset_id == "WEL001"
    assert rows[-1].cumulative_pct_of_spend == D("100.00")
    cums = [r.cumulative_pct_of_spend for r in rows]
    assert cums == sorted(cums)


def test_pareto_leading_null(spark):
    per_asset = spark.createDataFrame(
        [("A", None), ("B", D("10.00")), ("C", D("30.00"))], "asset_id string, v decimal(14,2)")
    rows = cost.pareto(per_asset, "v", "rk", "total", "share", "cum", 2, buckets=2).orderBy("rk").collect()
    assert [(r.asset_id, r.share, r.cum) for r in rows] == [
        ("A", None, None), ("C", D("75.000"), D("75.00")), ("B", D("25.000"), D("100.00"))]


def test_failure_cadence(mpe):
    m, _, _ = mpe
    rows = by(reliability.failure_cadence(m).collect())
    assert (rows["WEL001"].days_covered, rows["WEL001"].avg_days_between_failures) == (366, D("122.0"))
    assert (rows["REF001"].days_covered, rows["REF001"].avg_days_between_failures) == (1096, D("548.0"))
    assert (rows["PIP001"].days_covered, rows["PIP001"].avg_days_between_failures) == (0, None)


def test_failure_modes_ranked_by_hours(mpe):
    m, _, _ = mpe
    rows = reliability.failure_modes(m).collect()
    assert [(r.failure_type, r.total_downtime_hours) for r in rows] == [
        (None, None), ("Valve", 600), ("Leak", 26), ("Sensor", 20), ("Corrosion", 6)]
    assert sum(r.pct_of_all_failures for r in rows) == pytest.approx(100, abs=0.05)


def test_view_mode_and_rounding(mpe):
    view = by(risk.asset_reliability(*mpe).collect())
    assert len(view) == 6
    assert view["WEL001"].most_common_failure_type == "Corrosion"
    assert view["PIP001"].most_common_failure_type is None
    assert view["WEL001"].avg_co2_tons == D("1.01")
    assert view["WEL001"].total_oil_barrels == 60
    assert view["REF001"].production_readings is None


def test_dual_p90_thresholds(mpe):
    view = risk.asset_reliability(*mpe)
    rows = risk.dual_p90(view, buckets=2).collect()
    assert rows == []
    # the thresholds themselves
    from assetlens.plans import ranking
    f90, d90 = ranking.percentile_conts(view, ["failure_count", "total_downtime_hours"], 0.9)
    assert f90 == pytest.approx(3.5) and d90 == pytest.approx(368.0)


def test_risk_scores_golden(mpe):
    scored = risk.risk_scores(risk.asset_reliability(*mpe), buckets=3).collect()
    got = [(r.asset_id, r.risk_score) for r in scored]
    assert got == [("REF001", D("80.0")), ("PIP001", D("54.0")), ("WEL001", D("50.0")),
                   ("WEL003", D("32.0")), ("XYZ001", D("30.0")), ("WEL002", D("8.0"))]
    bands = {r.asset_id: r.recommended_action for r in scored}
    assert bands["REF001"] == "3. Monitor" and bands["WEL002"] == "4. No action"


def test_single_asset_scores_zero(spark):
    m = spark.createDataFrame([("WEL9", __import__("datetime").date(2020, 1, 1), D("1.00"), "Leak", 3)],
                              "asset_id string, maintenance_date date, cost_usd decimal(14,2), "
                              "failure_type string, downtime_hours int")
    p = spark.createDataFrame([], "well_id string, production_date date, oil_production_barrels int, "
                                  "gas_production_mcf int, water_cut_pct decimal(6,2), "
                                  "pressure_psi int, temperature_c int")
    e = spark.createDataFrame([], "asset_id string, co2_tons decimal(12,2), "
                                  "methane_leakage_tons decimal(12,2), "
                                  "energy_consumption_mwh decimal(14,2), reading_date date")
    rows = risk.risk_scores(risk.asset_reliability(m, p, e)).collect()
    assert [(r.asset_id, r.risk_score, r.recommended_action) for r in rows] == [
        ("WEL9", D("0.0"), "4. No action")]


def test_action_bands_and_worklist(mpe):
    scored = risk.risk_scores(risk.asset_reliability(*mpe))
    bands = by(risk.action_bands(scored).collect(), "recommended_action")
    assert sum(b.assets for b in bands.values()) == 6
    assert bands["3. Monitor"].assets == 1
    assert risk.worklist(scored).collect() == []
    top = risk.worklist(scored, cutoff=50).collect()
    assert [(r.priority, r.asset_id) for r in top] == [(1, "REF001"), (2, "PIP001"), (3, "WEL001")]


def test_fanout_audit_counts(mpe):
    rows = by(legacy.fanout_audit(*mpe).collect())
    w = rows["WEL001"]
    assert (w.maintenance_events, w.production_readings, w.emissions_readings, w.joined_rows) == (4, 3, 2, 24)
    assert w.joined_downtime_hours == 10 * 3 and w.joined_oil_barrels == 60 * 4
    assert w.joined_maintenance_cost == D("1800.00")
    assert rows["REF001"].joined_rows == 3 and rows["REF001"].joined_oil_barrels is None


def test_rule_ladder_priority_inversion(mpe):
    m, _, _ = mpe
    rows = by(legacy.rule_ladder(m).collect())
    assert rows["WEL001"].maintenance_action == "Immediate Maintenance Required"
    assert rows["REF001"].maintenance_action == "High Risk"
    assert rows["PIP001"].maintenance_action == "Low Risk"
    flags = legacy.fixed_threshold_flags(m, min_events=2, min_hours=5).collect()
    assert [r.asset_id for r in flags] == ["REF001", "WEL001"]


def test_quality_checks(mpe):
    m, p, e = mpe
    counts = {r.table_name: r.row_count for r in quality.row_counts(m, p, e).collect()}
    assert counts == {"maintenance": 11, "production": 5, "emissions": 3}
    cov = by(quality.join_coverage(m, p).collect(), "asset_type")
    assert (cov["Well"].assets_in_maintenance, cov["Well"].assets_found_in_production) == (3, 2)
    nr = quality.nulls_and_ranges(m).first()
    assert (nr.null_cost, nr.null_downtime, nr.null_failure_type) == (1, 1, 1)
    rpk = by(quality.rows_per_key(p, e).collect(), "check_name")
    assert rpk["production rows per well"].average_rows == D("2.50")
    assert rpk["emissions rows per asset"].worst_case == 2


def test_capacity_worklist_and_assets_to_reach(mpe):
    scored = risk.risk_scores(risk.asset_reliability(*mpe))
    top2 = risk.worklist(scored, cutoff=0, capacity=2).collect()
    assert [(r.priority, r.asset_id) for r in top2] == [(1, "REF001"), (2, "PIP001")]
    conc = cost.cost_concentration(mpe[0])
    # WEL001 600 + REF001 501 = 1101 of 1311.25 -> 83.97 %
    assert cost.assets_to_reach(conc, 50).first().assets_needed == 2
    assert cost.assets_to_reach(conc, 100).first().assets_needed == 6


def test_sql_views(spark, mpe):
    from assetlens.sources.files import register_views
    register_views(spark, *mpe)
    r = spark.sql("select count(*) n, count(distinct asset_class(asset_id)) k from v_asset_reliability").first()
    assert (r.n, r.k) == (6, 4)
    assert spark.sql("select count(*) c from maintenance where failure_type is null").first().c == 1


def test_main_driver(mpe):
    scored = risk.with_main_driver(risk.risk_scores(risk.asset_reliability(*mpe)))
    drivers = {r.asset_id: r.main_driver for r in scored.collect()}
    # REF001: 40.0 downtime, 24.0 frequency, 16.0 cost; WEL001: 0, 30.0, 20.0
    assert drivers["REF001"] == "downtime" and drivers["WEL001"] == "frequency"


def test_priority_inversions(mpe):
    rows = by(legacy.priority_inversions(risk.risk_scores(risk.asset_reliability(*mpe))).collect())
    # the ladder puts WEL001 first (4 events) while the score ranks REF001 (600 h) higher
    assert (rows["WEL001"].maintenance_action, rows["WEL001"].recommended_action) == (
        "Immediate Maintenance Required", "4. No action")
    assert (rows["REF001"].maintenance_action, rows["REF001"].recommended_action) == (
        "High Risk", "3. Monitor")
    assert rows["REF001"].risk_score > rows["WEL001"].risk_score
