"""Module 01: where the maintenance money goes (queries 1.1 - 1.7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import asc, asset_class, desc, pct, pct_change, round_ratio
from ..plans import ranking
from ..plans.summaries import is_well, maintenance_by_asset, production_by_well
from ..sources.schemas import COST_SCALE

# Fixed values that must equal the reference: efficiency band labels by quartile.
EFFICIENCY_BANDS = {
    1: "Worst quarter, review first",
    2: "Above average cost",
    3: "Below average cost",
    4: "Best quarter, leave alone",
}


def _label(col, labels: dict):
    out = None
    for k, v in labels.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out


def cost_by_asset(m: DataFrame) -> DataFrame:
    """1.1 Spend per asset with event count, exact average, largest event, date span."""
    s = maintenance_by_asset(m)
    return s.select(
        "asset_id",
        asset_class("asset_id").alias("asset_type"),
        F.col("events").alias("maintenance_events"),
        F.col("total_cost").alias("total_maintenance_cost"),
        F.col("avg_cost").alias("avg_cost_per_event"),
        F.col("max_cost").alias("largest_single_event"),
        F.col("first_date").alias("first_event"),
        F.col("latest_date").alias("latest_event"),
    ).orderBy(desc("total_maintenance_cost"), asc("asset_id"))


def pareto(per_asset: DataFrame, value: str, rank_name: str, total_name: str,
           pct_name: str, cum_name: str, scale: int,
           buckets: int | None = None, null_policy: str = "rank") -> DataFrame:
    """Concentration table: rank by ``value`` desc, share and cumulative share.

    ``ROW_NUMBER`` and the running SUM use distributed positions; ties are
    broken by ``asset_id`` so the result is deterministic. Assets whose value
    is NULL rank first (PostgreSQL DESC order) with NULL shares, or have no rank
    where ``null_policy`` is ``"exclude"``.
    """
    exclude = ranking.excludes_nulls(null_policy)
    first = F.col(value).desc_nulls_last() if exclude else desc(value)
    ranked = ranking.positions(per_asset, [first, asc("asset_id")],
                               sums={"v": F.col(value)}, buckets=buckets)
    kept = F.col(value).isNotNull()
    return ranked.select(
        (F.when(kept, F.col("_pos")) if exclude else F.col("_pos")).alias(rank_name),
        *[c for c in per_asset.columns if c != value],
        F.col(value).alias(total_name),
        pct(value, "_tot_v", 3, scale=scale).alias(pct_name),
        pct(F.when(kept, F.col("_cum_v")) if exclude else "_cum_v", "_tot_v", 2, scale=scale).alias(cum_name),
    )


def assets_to_reach(concentration: DataFrame, share, rank_col: str = "cost_rank",
                    cum_col: str = "cumulative_pct_of_spend") -> DataFrame:
    """How many top-ranked assets it takes to reach ``share`` percent (one row).

    Read off a concentration table (1.2 or 2.3): the smallest rank whose
    cumulative share is at least ``share``.
    """
    from decimal import Decimal
    return concentration.where(F.col(cum_col) >= F.lit(Decimal(str(share)))).agg(
        F.min(rank_col).alias("assets_needed"))


def cost_concentration(m: DataFrame, buckets: int | None = None, null_policy: str = "rank") -> DataFrame:
    """1.2 Pareto of spend."""
    per_asset = maintenance_by_asset(m).select(
        "asset_id", asset_class("asset_id").alias("asset_type"),
        F.col("events").alias("maintenance_events"), "total_cost")
    return pareto(per_asset, "total_cost", "cost_rank", "total_cost",
                  "pct_of_total_spend", "cumulative_pct_of_spend", COST_SCALE,
                  buckets, null_policy).orderBy(asc("cost_rank"), asc("asset_id"))


def cost_by_type(m: DataFrame) -> DataFrame:
    """1.3 Spend by asset class: assets, events, exact averages and share of spend."""
    g = m.groupBy(asset_class("asset_id").alias("asset_type")).agg(
        F.countDistinct("asset_id").alias("assets"),
        F.count(F.lit(1)).alias("maintenance_events"),
        F.sum("cost_usd").alias("total_cost"),
        F.sum("cost_usd").alias("_sum"), F.count("cost_usd").alias("_cnt"))
    # SUM(SUM(cost)) OVER (): a scalar subquery over the grouped rows (computed once,
    # reusing their exchange) instead of a single-partition window
    # (bound to a column once, so the plan holds a single subquery)
    g = g.withColumn("_grand", g.select(F.sum("total_cost")).scalar())
    return g.select(
        "asset_type", "assets", "maintenance_events", "total_cost",
        round_ratio("_sum", "_cnt", 2, num_scale=COST_SCALE).alias("avg_cost_per_event"),
        round_ratio("total_cost", "assets", 2, num_scale=COST_SCALE).alias("avg_cost_per_asset"),
        pct("total_cost", "_grand", 2, scale=COST_SCALE).alias("pct_of_total_spend"),
    ).orderBy(desc("total_cost"), asc("asset_type"))


def cost_vs_production(m: DataFrame, p: DataFrame) -> DataFrame:
    """1.4 Wells only: spend, downtime and barrels, each aggregated before the join."""
    maint = maintenance_by_asset(m).where(is_well("asset_id"))
    prod = production_by_well(p)
    j = maint.join(prod, maint["asset_id"] == prod["well_id"], "left")
    return j.select(
        "asset_id",
        F.col("events").alias("maintenance_events"),
        F.col("total_cost").alias("total_maintenance_cost"),
        F.col("total_downtime").alias("total_downtime_hours"),
        F.col("readings").alias("production_readings"),
        F.col("total_oil").alias("total_oil_barrels"),
        round_ratio("total_cost", F.nullif(F.col("total_oil"), F.lit(0)), 2,
                    num_scale=COST_SCALE).alias("maintenance_cost_per_barrel"),
    ).orderBy(desc("total_maintenance_cost"), asc("asset_id"))


def wells_without_production(m: DataFrame, p: DataFrame) -> DataFrame:
    """1.5 Wells with maintenance and no production row (NOT EXISTS -> left anti join)."""
    maint = maintenance_by_asset(m).where(is_well("asset_id"))
    wells = p.select(F.col("well_id").alias("asset_id")).distinct()
    return maint.join(wells, "asset_id", "left_anti").select(
        "asset_id",
        F.col("events").alias("maintenance_events"),
        F.col("total_cost").alias("total_maintenance_cost"),
        F.col("total_downtime").alias("total_downtime_hours"),
    ).orderBy(desc("total_maintenance_cost"), asc("asset_id"))


def cost_efficiency_bands(m: DataFrame, p: DataFrame, buckets: int | None = None,
                          null_policy: str = "rank") -> DataFrame:
    """1.6 Quartiles of cost per barrel (unrounded) for wells with oil > 0.

    A well whose cost is unknown is in the worst quarter, as in the reference,
    or in none where ``null_policy`` is ``"exclude"``.
    """
    maint = maintenance_by_asset(m)
    prod = production_by_well(p).where(F.col("total_oil") > 0)
    j = maint.join(prod, maint["asset_id"] == prod["well_id"], "inner").select(
        "asset_id", "events", "total_cost", "total_oil",
        (F.col("total_cost") / F.col("total_oil").cast("decimal(20,0)")).alias("_cpb"))
    banded = ranking.with_ntile(j, [desc("_cpb"), asc("asset_id")], 4, "_q", buckets,
                                F.col("_cpb").isNotNull() if ranking.excludes_nulls(null_policy) else None)
    return banded.select(
        "asset_id",
        F.col("events").alias("maintenance_events"),
        F.col("total_cost").alias("total_maintenance_cost"),
        F.col("total_oil").alias("total_oil_barrels"),
        round_ratio("total_cost", "total_oil", 2, num_scale=COST_SCALE).alias("cost_per_barrel"),
        _label(F.col("_q"), EFFICIENCY_BANDS).alias("efficiency_band"),
        "_cpb",
    ).orderBy(desc("_cpb"), asc("asset_id")).drop("_cpb")


def cost_yearly(m: DataFrame) -> DataFrame:
    """1.7 Spend by year with change on the previous year present (gaps not filled)."""
    y = m.groupBy(F.year("maintenance_date").alias("year")).agg(
        F.count(F.lit(1)).alias("maintenance_events"),
        F.sum("cost_usd").alias("total_cost"),
        F.sum("downtime_hours").alias("total_downtime_hours"))
    # one row per calendar year: a plain window over a few dozen rows
    prev = F.lag("total_cost").over(Window.orderBy("year"))
    return y.select(
        "year", "maintenance_events", "total_cost", "total_downtime_hours",
        (F.col("total_cost") - prev).alias("change_vs_prior_year"),
        pct_change("total_cost", prev, 2, scale=COST_SCALE).alias("pct_change_vs_prior_year"),
    ).orderBy("year")
