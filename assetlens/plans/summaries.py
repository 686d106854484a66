"""One-row-per-asset summaries of each source (the grain fix).

Every many-rows-per-asset table is aggregated to asset grain *before* any
join, so a join never multiplies events by readings. The summaries list
every aggregate an operator may need; Catalyst's column pruning drops the
unused ones (including the ``mode`` object aggregate) from each plan.
All aggregates are partial + final, so a hot asset is pre-aggregated on the
map side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import exact_avg, round_ratio
from ..sources.schemas import COST_SCALE, EMISSIONS_SCALE, WATER_CUT_SCALE

# Fixed value that must equal the reference: the asset-class prefix of wells.
WELL_PREFIX = "WEL"


def is_well(c="asset_id") -> Column:
    """``asset_class(c) = 'Well'`` written as a prefix test (Parquet can push it down)."""
    return (F.col(c) if isinstance(c, str) else c).startswith(WELL_PREFIX)


def maintenance_by_asset(m: DataFrame) -> DataFrame:
    """Event aggregates per asset (everything except the failure-type mode)."""
    cost, hours = F.col("cost_usd"), F.col("downtime_hours")
    return m.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum(cost).alias("total_cost"),
        exact_avg(cost, 2, scale=COST_SCALE, precision=14).alias("avg_cost"),
        F.max(cost).alias("max_cost"),
        F.sum(hours).alias("total_downtime"),
        exact_avg(hours, 1, precision=12).alias("avg_downtime"),
        F.max(hours).alias("max_downtime"),
        F.min("maintenance_date").alias("first_date"),
        F.max("maintenance_date").alias("latest_date"),
    )


def maintenance_by_asset_with_mode(m: DataFrame) -> DataFrame:
    """As :func:`maintenance_by_asset` plus ``mode_failure_type``.

    ``MODE() WITHIN GROUP (ORDER BY failure_type)``: the most frequent
    non-NULL type, ties to the smallest. Built as two hash aggregations
    (asset x type, then asset) instead of an object aggregate holding a map
    per asset; every other aggregate is carried through the first level as a
    partial (sums, counts, min, max), so the events are read once.
    """
    return finish_maintenance(maintenance_states(m))


# -- mergeable states ---------------------------------------------------------
#
# Counts, sums and extremes per asset (maintenance: per asset and failure type)
# that add up over any split of the events, for instance over periods. The
# finished summaries follow from the merged states.

def maintenance_states(m: DataFrame, *by) -> DataFrame:
    cost, hours = F.col("cost_usd"), F.col("downtime_hours")
    return m.groupBy(*by, "asset_id", "failure_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(cost).alias("s_cost"), F.count(cost).alias("n_cost"), F.max(cost).alias("mx_cost"),
        F.sum(hours).alias("s_hours"), F.count(hours).alias("n_hours"),
        F.max(hours).alias("mx_hours"),
        F.min("maintenance_date").alias("d0"), F.max("maintenance_date").alias("d1"))


def merge_maintenance(states: DataFrame) -> DataFrame:
    return states.groupBy("asset_id", "failure_type").agg(
        *[F.sum(c).alias(c) for c in ("n", "s_cost", "n_cost", "s_hours", "n_hours")],
        F.max("mx_cost").alias("mx_cost"), F.max("mx_hours").alias("mx_hours"),
        F.min("d0").alias("d0"), F.max("d1").alias("d1"))


def finish_maintenance(states: DataFrame) -> DataFrame:
    """One row per asset from states that are unique by asset and failure type."""
    s_cost, n_cost = F.sum("s_cost"), F.sum("n_cost")
    s_hours, n_hours = F.sum("s_hours"), F.sum("n_hours")
    top = F.min(F.when(F.col("failure_type").isNotNull(),
                       F.struct((-F.col("n")).alias("neg_n"), F.col("failure_type").alias("ft"))))
    return states.groupBy("asset_id").agg(
        F.sum("n").alias("events"),
        s_cost.alias("total_cost"),
        round_ratio(s_cost, n_cost, 2, num_scale=COST_SCALE, precision=14).alias("avg_cost"),
        F.max("mx_cost").alias("max_cost"),
        s_hours.alias("total_downtime"),
        round_ratio(s_hours, n_hours, 1, precision=12).alias("avg_downtime"),
        F.max("mx_hours").alias("max_downtime"),
        F.min("d0").alias("first_date"),
        F.max("d1").alias("latest_date"),
        top["ft"].alias("mode_failure_type"),
    )


def production_states(p: DataFrame, *by) -> DataFrame:
    return p.groupBy(*by, "well_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("oil_production_barrels").alias("s_oil"), F.sum("gas_production_mcf").alias("s_gas"),
        F.sum("water_cut_pct").alias("s_water"), F.count("water_cut_pct").alias("n_water"),
        F.sum("pressure_psi").alias("s_pressure"), F.count("pressure_psi").alias("n_pressure"))


def finish_production(states: DataFrame) -> DataFrame:
    """As :func:`production_by_well`, from any split of its readings."""
    return states.groupBy("well_id").agg(
        F.sum("n").alias("readings"), F.sum("s_oil").alias("total_oil"), F.sum("s_gas").alias("total_gas"),
        round_ratio(F.sum("s_water"), F.sum("n_water"), 2, num_scale=WATER_CUT_SCALE, precision=6).alias("avg_water_cut"),
        round_ratio(F.sum("s_pressure"), F.sum("n_pressure"), 0, precision=12).alias("avg_pressure"))


def emissions_states(e: DataFrame, *by) -> DataFrame:
    measures = {"co2": "co2_tons", "methane": "methane_leakage_tons", "energy": "energy_consumption_mwh"}
    return e.groupBy(*by, "asset_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[f(column).alias(f"{kind}_{name}") for name, column in measures.items() for kind, f in (("s", F.sum), ("n", F.count))])


def finish_emissions(states: DataFrame) -> DataFrame:
    """As :func:`emissions_by_asset`, from any split of its readings."""
    mean = lambda name, precision: round_ratio(
        F.sum(f"s_{name}"), F.sum(f"n_{name}"), 2, num_scale=EMISSIONS_SCALE, precision=precision).alias(f"avg_{name}")
    return states.groupBy("asset_id").agg(
        F.sum("n").alias("readings"), mean("co2", 12), F.sum("s_co2").alias("total_co2"), mean("methane", 12), mean("energy", 14))


def production_by_well(p: DataFrame) -> DataFrame:
    return p.groupBy("well_id").agg(
        F.count(F.lit(1)).alias("readings"),
        F.sum("oil_production_barrels").alias("total_oil"),
        F.sum("gas_production_mcf").alias("total_gas"),
        exact_avg("water_cut_pct", 2, scale=WATER_CUT_SCALE, precision=6).alias("avg_water_cut"),
        exact_avg("pressure_psi", 0, precision=12).alias("avg_pressure"),
    )


def emissions_by_asset(e: DataFrame) -> DataFrame:
    s = EMISSIONS_SCALE
    return e.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("readings"),
        exact_avg("co2_tons", 2, scale=s, precision=12).alias("avg_co2"),
        F.sum("co2_tons").alias("total_co2"),
        exact_avg("methane_leakage_tons", 2, scale=s, precision=12).alias("avg_methane"),
        exact_avg("energy_consumption_mwh", 2, scale=s, precision=14).alias("avg_energy"),
    )
