"""Registry of the named queries: Spark builders and their output contract.

Each key maps to a callable ``(spark, sf_dir) -> DataFrame`` that reads the
test tables, projects them onto the domain and runs one operator over the
whole input. ``CONTRACT`` fixes the output columns and a plain type per
column; :func:`conform` applies it at the edge so Spark and the DuckDB oracle
hand over identical schemas (exact decimals become doubles, dates ISO text).
The library functions themselves keep decimal and date types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cost, legacy, quality, reliability, risk
from .plans.ranking import materialize, workspace
from .sources import contract, files, schemas
from .sources import projection as proj
from .sources.asset_mart import AssetMart, in_period
from .sources.marts import Mart

# s = string, i = bigint, f = double, d = date as ISO text
CONTRACT: dict[str, list[tuple[str, str]]] = {
    "dq_row_counts": [("table_name", "s"), ("row_count", "i")],
    "dq_asset_types": [("asset_type", "s"), ("maintenance_events", "i"), ("distinct_assets", "i")],
    "dq_join_coverage": [("asset_type", "s"), ("assets_in_maintenance", "i"),
                         ("assets_found_in_production", "i")],
    "dq_rows_per_key": [("check_name", "s"), ("average_rows", "f"), ("worst_case", "i")],
    "dq_nulls_ranges": [("null_cost", "i"), ("negative_cost", "i"), ("null_downtime", "i"),
                        ("negative_downtime", "i"), ("null_failure_type", "i"),
                        ("earliest_event", "d"), ("latest_event", "d")],
    "cost_by_asset": [("asset_id", "s"), ("asset_type", "s"), ("maintenance_events", "i"),
                      ("total_maintenance_cost", "f"), ("avg_cost_per_event", "f"),
                      ("largest_single_event", "f"), ("first_event", "d"), ("latest_event", "d")],
    "cost_concentration": [("cost_rank", "i"), ("asset_id", "s"), ("asset_type", "s"),
                           ("maintenance_events", "i"), ("total_cost", "f"),
                           ("pct_of_total_spend", "f"), ("cumulative_pct_of_spend", "f")],
    "cost_by_type": [("asset_type", "s"), ("assets", "i"), ("maintenance_events", "i"),
                     ("total_cost", "f"), ("avg_cost_per_event", "f"),
                     ("avg_cost_per_asset", "f"), ("pct_of_total_spend", "f")],
    "cost_vs_production": [("asset_id", "s"), ("maintenance_events", "i"),
                           ("total_maintenance_cost", "f"), ("total_downtime_hours", "i"),
                           ("production_readings", "i"), ("total_oil_barrels", "i"),
                           ("maintenance_cost_per_barrel", "f")],
    "wells_without_production": [("asset_id", "s"), ("maintenance_events", "i"),
                                 ("total_maintenance_cost", "f"), ("total_downtime_hours", "i")],
    "cost_efficiency_bands": [("asset_id", "s"), ("maintenance_events", "i"),
                              ("total_maintenance_cost", "f"), ("total_oil_barrels", "i"),
                              ("cost_per_barrel", "f"), ("efficiency_band", "s")],
    "cost_yearly": [("year", "i"), ("maintenance_events", "i"), ("total_cost", "f"),
                    ("total_downtime_hours", "i"), ("change_vs_prior_year", "f"),
                    ("pct_change_vs_prior_year", "f")],
    "failure_cadence": [("asset_id", "s"), ("asset_type", "s"), ("failure_count", "i"),
                        ("first_failure", "d"), ("latest_failure", "d"), ("days_covered", "i"),
                        ("avg_days_between_failures", "f")],
    "downtime_by_asset": [("asset_id", "s"), ("asset_type", "s"), ("failure_count", "i"),
                          ("total_downtime_hours", "i"), ("avg_hours_per_failure", "f"),
                          ("longest_single_outage", "i"), ("total_downtime_days", "f")],
    "downtime_concentration": [("downtime_rank", "i"), ("asset_id", "s"), ("asset_type", "s"),
                               ("failure_count", "i"), ("total_downtime", "i"),
                               ("pct_of_total_downtime", "f"),
                               ("cumulative_pct_of_downtime", "f")],
    "failure_modes": [("failure_type", "s"), ("occurrences", "i"), ("pct_of_all_failures", "f"),
                      ("total_downtime_hours", "i"), ("avg_downtime_hours", "f"),
                      ("worst_outage_hours", "i"), ("total_cost", "f"),
                      ("avg_cost_per_event", "f"), ("pct_of_all_downtime", "f")],
    "failure_modes_by_type": [("asset_type", "s"), ("failure_type", "s"), ("occurrences", "i"),
                              ("total_downtime_hours", "i"), ("avg_downtime_hours", "f"),
                              ("total_cost", "f"), ("pct_within_asset_type", "f")],
    "downtime_vs_production": [("asset_id", "s"), ("failure_count", "i"),
                               ("total_downtime_hours", "i"), ("total_cost", "f"),
                               ("production_readings", "i"), ("total_oil_barrels", "i"),
                               ("avg_water_cut_pct", "f"), ("avg_pressure_psi", "f"),
                               ("barrels_per_downtime_hour", "f")],
    "high_downtime_high_output": [("asset_id", "s"), ("failure_count", "i"),
                                  ("total_downtime_hours", "i"), ("total_oil_barrels", "i"),
                                  ("downtime_quartile", "i"), ("production_quartile", "i"),
                                  ("why_it_is_here", "s")],
    "reliability_yearly": [("year", "i"), ("failures", "i"), ("assets_affected", "i"),
                           ("total_downtime_hours", "i"), ("avg_downtime_per_failure", "f"),
                           ("downtime_change_vs_prior_year", "i"),
                           ("pct_change_in_failures", "f")],
    "asset_reliability": [("asset_id", "s"), ("asset_type", "s"), ("failure_count", "i"),
                          ("total_maintenance_cost", "f"), ("avg_cost_per_failure", "f"),
                          ("total_downtime_hours", "i"), ("avg_downtime_per_failure", "f"),
                          ("worst_outage_hours", "i"), ("most_common_failure_type", "s"),
                          ("first_failure", "d"), ("latest_failure", "d"),
                          ("production_readings", "i"), ("total_oil_barrels", "i"),
                          ("total_gas_mcf", "i"), ("avg_water_cut_pct", "f"),
                          ("avg_pressure_psi", "f"), ("emissions_readings", "i"),
                          ("avg_co2_tons", "f"), ("total_co2_tons", "f"),
                          ("avg_methane_tons", "f"), ("avg_energy_mwh", "f")],
    "emissions_failures": [("asset_id", "s"), ("asset_type", "s"), ("failure_count", "i"),
                           ("total_downtime_hours", "i"), ("avg_co2_tons", "f"),
                           ("avg_methane_tons", "f"), ("avg_energy_mwh", "f"),
                           ("emissions_quartile", "i"), ("failure_quartile", "i")],
    "emissions_quartiles": [("emissions_quartile", "i"), ("band", "s"), ("assets", "i"),
                            ("mean_co2_tons", "f"), ("mean_failures_per_asset", "f"),
                            ("mean_downtime_hours", "f")],
    "dual_p90": [("asset_id", "s"), ("asset_type", "s"), ("failure_count", "i"),
                 ("total_downtime_hours", "i"), ("total_maintenance_cost", "f"),
                 ("most_common_failure_type", "s"), ("total_oil_barrels", "i"),
                 ("failure_threshold_used", "f"), ("downtime_threshold_used", "f")],
    "risk_scores": [("asset_id", "s"), ("asset_type", "s"), ("failure_count", "i"),
                    ("total_downtime_hours", "i"), ("total_maintenance_cost", "f"),
                    ("most_common_failure_type", "s"), ("total_oil_barrels", "i"),
                    ("latest_failure", "d"), ("risk_score", "f"), ("recommended_action", "s"),
                    ("downtime_contribution", "f"), ("frequency_contribution", "f"),
                    ("cost_contribution", "f")],
    "action_bands": [("recommended_action", "s"), ("assets", "i"), ("pct_of_fleet", "f"),
                     ("downtime_hours_covered", "i"), ("pct_of_all_downtime_covered", "f"),
                     ("cost_covered", "f")],
    "worklist": [("priority", "i"), ("asset_id", "s"), ("asset_type", "s"),
                 ("likely_fault", "s"), ("failures_to_date", "i"), ("hours_lost", "i"),
                 ("spend_to_date", "f"), ("barrels_produced", "i"), ("last_seen", "d"),
                 ("risk_score", "f")],
    "fanout_audit": [("asset_id", "s"), ("asset_type", "s"), ("maintenance_events", "i"),
                     ("production_readings", "i"), ("emissions_readings", "i"),
                     ("joined_rows", "f"), ("true_downtime_hours", "i"),
                     ("joined_downtime_hours", "f"), ("true_maintenance_cost", "f"),
                     ("joined_maintenance_cost", "f"), ("true_oil_barrels", "i"),
                     ("joined_oil_barrels", "f")],
    "fixed_threshold_flags": [("asset_id", "s"), ("failures", "i"), ("downtime", "i"),
                              ("cost", "f")],
    "rule_ladder": [("asset_id", "s"), ("failures", "i"), ("downtime", "i"), ("cost", "f"),
                    ("maintenance_action", "s")],
    "tier_mismatches": [("asset_id", "s"), ("failures", "i"), ("downtime", "i"),
                        ("maintenance_action", "s"), ("risk_score", "f"),
                        ("recommended_action", "s"), ("direction", "s")],
    "priority_inversions": [("asset_id", "s"), ("failures", "i"), ("downtime", "i"),
                            ("maintenance_action", "s"), ("risk_score", "f"),
                            ("recommended_action", "s"), ("overtaken_by", "i"), ("overtakes", "i")],
    "outage_patterns": [("asset_id", "s"), ("asset_type", "s"), ("failure_count", "i"),
                        ("outages", "i"), ("outage_hours", "i"), ("longest_outage_hours", "i"),
                        ("largest_outages_hours", "i"), ("pct_of_largest_outages", "f"),
                        ("outage_pattern", "s")],
    "contract_nulls": [("table_name", "s"), ("column_name", "s"), ("required", "i"),
                       ("row_count", "i"), ("null_count", "i")],
    "maintenance_keyed": [("maintenance_id", "i"), ("asset_id", "s"), ("maintenance_date", "d"),
                          ("cost_usd", "f"), ("failure_type", "s"), ("downtime_hours", "i")],
}

CONTRACT["asset_reliability_mart"] = CONTRACT["asset_reliability"]
CONTRACT["maintenance_appended"] = CONTRACT["maintenance_keyed"]
CONTRACT["load_rejects"] = [("asset_id", "s"), ("maintenance_date", "d"), ("cost_usd", "f"),
                            ("failure_type", "s"), ("downtime_hours", "i"), ("reasons", "s")]
CONTRACT["load_reject_counts"] = [("reason", "s"), ("row_count", "i")]
CONTRACT["priority_inversions_scaled"] = CONTRACT["priority_inversions"]

#: The same reports with NULLs left out of the ranking.
MEASURED = ("cost_concentration", "cost_efficiency_bands", "downtime_concentration",
            "high_downtime_high_output", "risk_scores")
CONTRACT |= {f"{key}_measured": CONTRACT[key] for key in MEASURED}

_SPARK_TYPES = {"s": "string", "i": "bigint", "f": "double"}


def conform(df: DataFrame, key: str) -> DataFrame:
    """Select the contract columns in order with their plain edge types."""
    cols = []
    for name, kind in CONTRACT[key]:
        c = F.col(name)
        cols.append((F.date_format(c, "yyyy-MM-dd") if kind == "d"
                     else c.cast(_SPARK_TYPES[kind])).alias(name))
    return df.select(*cols)


def _scored(m: DataFrame, p: DataFrame, e: DataFrame) -> DataFrame:
    return risk.risk_scores(risk.asset_reliability(m, p, e))


def _measured(view: DataFrame) -> DataFrame:
    return risk.risk_scores(view, null_policy="exclude")


FIRST_LOAD_ENDS = "1995-01-01"      # maintenance_appended: events before it are loaded first


def _appended(m: DataFrame) -> DataFrame:
    """S4 over two loads: the events up to a date, then the whole table."""
    spark = m.sparkSession
    mart = Mart(spark, workspace(spark).folder("event-mart"))
    contract.append_keyed(mart, m.where(F.col("maintenance_date") < F.lit(FIRST_LOAD_ENDS).cast("date")))
    return contract.append_keyed(mart, m)


def _view_from_mart(m: DataFrame, p: DataFrame, e: DataFrame) -> DataFrame:
    """3.1 from stored states: every year but the newest built at once, that one added."""
    spark = m.sparkSession
    newest = m.agg(F.max(F.year("maintenance_date")).cast("string")).first()[0]
    mart = AssetMart(spark, workspace(spark).folder("asset-mart"), buckets=8, grain="year")
    dates = ("maintenance_date", "production_date", "reading_date")
    older = [t.where(~F.coalesce(in_period(d, newest), F.lit(False))) if newest else t for t, d in zip((m, p, e), dates)]
    mart.build(*older)
    if newest:
        mart.put(newest, m, p, e)
    return mart.view()


# Every named query as a function of the three domain tables (maintenance,
# production, emissions). An input that a query does not use costs nothing.
# Rankings write their ordered tables while the DataFrame is built.
OPERATORS: dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] = {
    "dq_row_counts": lambda m, p, e: quality.row_counts(m, p, e),
    "dq_asset_types": lambda m, p, e: quality.asset_types(m),
    "dq_join_coverage": lambda m, p, e: quality.join_coverage(m, p),
    "dq_rows_per_key": lambda m, p, e: quality.rows_per_key(p, e),
    "dq_nulls_ranges": lambda m, p, e: quality.nulls_and_ranges(m),
    "cost_by_asset": lambda m, p, e: cost.cost_by_asset(m),
    "cost_concentration": lambda m, p, e: cost.cost_concentration(m),
    "cost_by_type": lambda m, p, e: cost.cost_by_type(m),
    "cost_vs_production": lambda m, p, e: cost.cost_vs_production(m, p),
    "wells_without_production": lambda m, p, e: cost.wells_without_production(m, p),
    "cost_efficiency_bands": lambda m, p, e: cost.cost_efficiency_bands(m, p),
    "cost_yearly": lambda m, p, e: cost.cost_yearly(m),
    "failure_cadence": lambda m, p, e: reliability.failure_cadence(m),
    "downtime_by_asset": lambda m, p, e: reliability.downtime_by_asset(m),
    "downtime_concentration": lambda m, p, e: reliability.downtime_concentration(m),
    "failure_modes": lambda m, p, e: reliability.failure_modes(m),
    "failure_modes_by_type": lambda m, p, e: reliability.failure_modes_by_type(m),
    "downtime_vs_production": lambda m, p, e: reliability.downtime_vs_production(m, p),
    "high_downtime_high_output": lambda m, p, e: reliability.high_downtime_high_output(m, p),
    "reliability_yearly": lambda m, p, e: reliability.reliability_yearly(m),
    "asset_reliability": lambda m, p, e: risk.asset_reliability(m, p, e),
    "emissions_failures": lambda m, p, e: risk.emissions_failures(risk.asset_reliability(m, p, e)),
    "emissions_quartiles": lambda m, p, e: risk.emissions_quartiles(risk.asset_reliability(m, p, e)),
    "dual_p90": lambda m, p, e: risk.dual_p90(risk.asset_reliability(m, p, e)),
    "risk_scores": _scored,
    "action_bands": lambda m, p, e: risk.action_bands(_scored(m, p, e)),
    "worklist": lambda m, p, e: risk.worklist(_scored(m, p, e)),
    "fanout_audit": lambda m, p, e: legacy.fanout_audit(m, p, e),
    "fixed_threshold_flags": lambda m, p, e: legacy.fixed_threshold_flags(m),
    "rule_ladder": lambda m, p, e: legacy.rule_ladder(m),
    "tier_mismatches": lambda m, p, e: legacy.tier_mismatches(_scored(m, p, e)),
    "priority_inversions": lambda m, p, e: legacy.priority_inversions(_scored(m, p, e)),
    "priority_inversions_scaled":
        lambda m, p, e: legacy.priority_inversions(_scored(m, p, e), legacy.scaled_ladder(10)),
    "outage_patterns": lambda m, p, e: reliability.outage_patterns(m),
    "cost_concentration_measured": lambda m, p, e: cost.cost_concentration(m, null_policy="exclude"),
    "cost_efficiency_bands_measured": lambda m, p, e: cost.cost_efficiency_bands(m, p, null_policy="exclude"),
    "downtime_concentration_measured": lambda m, p, e: reliability.downtime_concentration(m, null_policy="exclude"),
    "high_downtime_high_output_measured":
        lambda m, p, e: reliability.high_downtime_high_output(m, p, null_policy="exclude"),
    "risk_scores_measured": lambda m, p, e: _measured(risk.asset_reliability(m, p, e)),
    "maintenance_keyed": lambda m, p, e: contract.with_surrogate_key(m),
    "maintenance_appended": lambda m, p, e: _appended(m),
    "asset_reliability_mart": _view_from_mart,
    "contract_nulls": lambda m, p, e: contract.null_counts(
        {"maintenance": m, "production": p, "emissions": e}),
}


#: Reports that start from the asset view (3.1) or from the scored fleet (3.4).
FROM_VIEW = {
    "asset_reliability": lambda v: v,
    "emissions_failures": risk.emissions_failures,
    "emissions_quartiles": risk.emissions_quartiles,
    "dual_p90": risk.dual_p90,
    "risk_scores_measured": _measured,
}
FROM_SCORES = {
    "risk_scores": lambda s: s,
    "action_bands": risk.action_bands,
    "worklist": risk.worklist,
    "tier_mismatches": legacy.tier_mismatches,
    "priority_inversions": legacy.priority_inversions,
    "priority_inversions_scaled": lambda s: legacy.priority_inversions(s, legacy.scaled_ladder(10)),
}


def reports(m: DataFrame, p: DataFrame, e: DataFrame) -> Callable[[str], DataFrame]:
    """``key -> DataFrame`` with the view and the scores built once and shared.

    Call it inside :func:`assetlens.plans.ranking.owned`, which owns the two
    written tables.
    """
    shared: dict[str, DataFrame] = {}

    def build(key: str) -> DataFrame:
        if (key in FROM_VIEW or key in FROM_SCORES) and "view" not in shared:
            shared["view"] = materialize(risk.asset_reliability(m, p, e), "view")
        if key in FROM_SCORES and "scores" not in shared:
            shared["scores"] = materialize(risk.risk_scores(shared["view"]), "scores")
        if key in FROM_VIEW:
            return FROM_VIEW[key](shared["view"])
        if key in FROM_SCORES:
            return FROM_SCORES[key](shared["scores"])
        return OPERATORS[key](m, p, e)
    return build


def query(key: str) -> Callable[[SparkSession, str], DataFrame]:
    """``(spark, sf_dir) -> DataFrame``: the test tables projected onto the domain,
    the operator over them, and the output contract applied."""
    op = OPERATORS[key]
    return lambda spark, sf_dir: conform(op(*proj.tables(spark, sf_dir)), key)


def _rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a CSV file with defects, written, loaded and judged."""
    path = workspace(spark).folder("raw-lines")
    proj.raw_maintenance_lines(spark, sf_dir).write.text(path)
    loaded = files.read_maintenance_csv(spark, path, mode="PERMISSIVE", header=False)
    return contract.split_rejects(loaded, schemas.MAINTENANCE)[1]


# Named queries over raw files, as functions of the session and the test tables.
FILE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "load_rejects": lambda spark, sf_dir: _rejects(spark, sf_dir).withColumn("reasons", F.concat_ws("; ", schemas.REASONS)),
    "load_reject_counts": lambda spark, sf_dir: contract.reason_counts(_rejects(spark, sf_dir)),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from_files = {key: lambda spark, sf_dir, key=key: conform(FILE_QUERIES[key](spark, sf_dir), key) for key in FILE_QUERIES}
    return {key: query(key) for key in OPERATORS} | from_files
