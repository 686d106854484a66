"""Post-load data-quality checks (D1 - D5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import asc, asset_class, desc, round_ratio

# Fixed values that must equal the reference: labels of the checks.
TABLE_NAMES = ("maintenance", "production", "emissions")
ROWS_PER_KEY_CHECKS = ("production rows per well", "emissions rows per asset")


def row_counts(m: DataFrame, p: DataFrame, e: DataFrame) -> DataFrame:
    """D1 Row count of each table (three global counts, UNION ALL)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(name).alias("table_name"), "row_count")
             for name, df in zip(TABLE_NAMES, (m, p, e))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def asset_types(m: DataFrame) -> DataFrame:
    """D2 Events and distinct assets per asset class."""
    return m.groupBy(asset_class("asset_id").alias("asset_type")).agg(
        F.count(F.lit(1)).alias("maintenance_events"),
        F.countDistinct("asset_id").alias("distinct_assets"),
    ).orderBy(desc("maintenance_events"), asc("asset_type"))


def join_coverage(m: DataFrame, p: DataFrame) -> DataFrame:
    """D3 Per class: maintained assets and how many have production rows.

    The reference counts distinct ids over a raw left join; the same numbers
    come from distinct ids on each side, so no event x reading join is built.
    """
    assets = m.select("asset_id").distinct()
    wells = p.select(F.col("well_id")).distinct()
    j = assets.join(wells, assets["asset_id"] == wells["well_id"], "left")
    return j.groupBy(asset_class("asset_id").alias("asset_type")).agg(
        F.count(F.lit(1)).alias("assets_in_maintenance"),
        F.count("well_id").alias("assets_found_in_production"),
    ).orderBy(asc("asset_type"))


def rows_per_key(p: DataFrame, e: DataFrame) -> DataFrame:
    """D4 Mean (2 dp) and max rows per key; above 1 means direct joins double count."""
    def one(df, key, label):
        per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return per_key.agg(
            round_ratio(F.sum("n"), F.count("n"), 2, precision=20).alias("average_rows"),
            F.max("n").alias("worst_case"),
        ).select(F.lit(label).alias("check_name"), "average_rows", "worst_case")
    return one(p, "well_id", ROWS_PER_KEY_CHECKS[0]).unionByName(
        one(e, "asset_id", ROWS_PER_KEY_CHECKS[1]))


def nulls_and_ranges(m: DataFrame) -> DataFrame:
    """D5 NULL and negative counts, and the event date range, in one pass."""
    return m.agg(
        F.count_if(F.col("cost_usd").isNull()).alias("null_cost"),
        F.count_if(F.col("cost_usd") < 0).alias("negative_cost"),
        F.count_if(F.col("downtime_hours").isNull()).alias("null_downtime"),
        F.count_if(F.col("downtime_hours") < 0).alias("negative_downtime"),
        F.count_if(F.col("failure_type").isNull()).alias("null_failure_type"),
        F.min("maintenance_date").alias("earliest_event"),
        F.max("maintenance_date").alias("latest_event"),
    )
