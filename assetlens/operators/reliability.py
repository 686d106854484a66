"""Module 02: what fails, how often and how long it stays down (queries 2.1 - 2.8)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import asc, asset_class, desc, exact_avg, pct, round_ratio
from ..plans import ranking
from ..plans.summaries import is_well, maintenance_by_asset, production_by_well
from ..sources.schemas import COST_SCALE
from .cost import pareto

# Fixed value that must equal the reference: the reason text of query 2.7.
HIGH_DOWNTIME_HIGH_OUTPUT_REASON = "High downtime on a high producing well"


def failure_cadence(m: DataFrame) -> DataFrame:
    """2.1 Failure count, date span and mean days between failures."""
    s = maintenance_by_asset(m)
    days = F.datediff("latest_date", "first_date")
    return s.select(
        "asset_id",
        asset_class("asset_id").alias("asset_type"),
        F.col("events").alias("failure_count"),
        F.col("first_date").alias("first_failure"),
        F.col("latest_date").alias("latest_failure"),
        days.alias("days_covered"),
        F.when(F.col("events") > 1,
               round_ratio(days, F.col("events") - 1, 1, precision=12))
        .alias("avg_days_between_failures"),
    ).orderBy(desc("failure_count"), asc("avg_days_between_failures"), asc("asset_id"))


def downtime_by_asset(m: DataFrame) -> DataFrame:
    """2.2 Lost hours per asset next to the failure count."""
    s = maintenance_by_asset(m)
    return s.select(
        "asset_id",
        asset_class("asset_id").alias("asset_type"),
        F.col("events").alias("failure_count"),
        F.col("total_downtime").alias("total_downtime_hours"),
        F.col("avg_downtime").alias("avg_hours_per_failure"),
        F.col("max_downtime").alias("longest_single_outage"),
        round_ratio("total_downtime", F.lit(24), 1, precision=20).alias("total_downtime_days"),
    ).orderBy(desc("total_downtime_hours"), asc("asset_id"))


def downtime_concentration(m: DataFrame, buckets: int | None = None, null_policy: str = "rank") -> DataFrame:
    """2.3 Pareto of downtime hours."""
    per_asset = maintenance_by_asset(m).select(
        "asset_id", asset_class("asset_id").alias("asset_type"),
        F.col("events").alias("failure_count"), "total_downtime")
    return pareto(per_asset, "total_downtime", "downtime_rank", "total_downtime",
                  "pct_of_total_downtime", "cumulative_pct_of_downtime", 0,
                  buckets, null_policy).orderBy(asc("downtime_rank"), asc("asset_id"))


def failure_modes(m: DataFrame) -> DataFrame:
    """2.4 Failure types (NULL is a group) ranked by hours lost, with shares."""
    g = m.groupBy("failure_type").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.sum("downtime_hours").alias("total_downtime_hours"),
        exact_avg("downtime_hours", 1, precision=12).alias("avg_downtime_hours"),
        F.max("downtime_hours").alias("worst_outage_hours"),
        F.sum("cost_usd").alias("total_cost"),
        exact_avg("cost_usd", 2, scale=COST_SCALE, precision=14).alias("avg_cost_per_event"))
    # grand totals as scalar subqueries over the grouped rows (failure_type is free
    # text, so the number of groups is not bounded by construction)
    totals = g.select(F.struct(F.sum("occurrences").alias("events"),
                               F.sum("total_downtime_hours").alias("hours"))).scalar()
    g = g.withColumn("_all", totals)
    return g.select(
        "failure_type", "occurrences",
        pct("occurrences", "_all.events", 2).alias("pct_of_all_failures"),
        "total_downtime_hours", "avg_downtime_hours", "worst_outage_hours",
        "total_cost", "avg_cost_per_event",
        pct("total_downtime_hours", "_all.hours", 2).alias("pct_of_all_downtime"),
    ).orderBy(desc("total_downtime_hours"), asc("failure_type"))


def failure_modes_by_type(m: DataFrame) -> DataFrame:
    """2.5 Asset class x failure type, share of events within the class."""
    g = m.groupBy(asset_class("asset_id").alias("asset_type"), "failure_type").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.sum("downtime_hours").alias("total_downtime_hours"),
        exact_avg("downtime_hours", 1, precision=12).alias("avg_downtime_hours"),
        F.sum("cost_usd").alias("total_cost"))
    # four class totals joined back: failure types are free text, so a window by
    # class would gather them all in four tasks
    total = g.groupBy(F.col("asset_type").alias("_class")).agg(F.sum("occurrences").alias("_all"))
    return g.join(total, F.col("asset_type") == F.col("_class")).select(
        "asset_type", "failure_type", "occurrences", "total_downtime_hours",
        "avg_downtime_hours", "total_cost",
        pct("occurrences", "_all", 2).alias("pct_within_asset_type"),
    ).orderBy(asc("asset_type"), desc("total_downtime_hours"), asc("failure_type"))


def downtime_vs_production(m: DataFrame, p: DataFrame) -> DataFrame:
    """2.6 Wells: downtime and output, aggregated separately then left joined."""
    d = maintenance_by_asset(m).where(is_well("asset_id"))
    o = production_by_well(p)
    j = d.join(o, d["asset_id"] == o["well_id"], "left")
    return j.select(
        "asset_id",
        F.col("events").alias("failure_count"),
        F.col("total_downtime").alias("total_downtime_hours"),
        "total_cost",
        F.col("readings").alias("production_readings"),
        F.col("total_oil").alias("total_oil_barrels"),
        F.col("avg_water_cut").alias("avg_water_cut_pct"),
        F.col("avg_pressure").alias("avg_pressure_psi"),
        round_ratio("total_oil", F.nullif(F.col("total_downtime"), F.lit(0)), 1,
                    precision=30).alias("barrels_per_downtime_hour"),
    ).orderBy(desc("total_downtime_hours"), asc("asset_id"))


def high_downtime_high_output(m: DataFrame, p: DataFrame, buckets: int | None = None,
                              null_policy: str = "rank") -> DataFrame:
    """2.7 Wells in the top downtime quartile and the top production quartile.

    Quartiles are taken over the wells left after the join and the oil > 0
    filter, as in the reference. There a well without recorded downtime is in the
    top downtime quartile; ``null_policy="exclude"`` gives it no quartile.
    """
    d = maintenance_by_asset(m).where(is_well("asset_id"))
    o = production_by_well(p).where(F.col("total_oil") > 0)
    j = d.join(o, d["asset_id"] == o["well_id"], "inner").select(
        "asset_id", F.col("events").alias("failure_count"), "total_downtime", "total_oil")
    # NTILE(4) OVER (ORDER BY total_downtime DESC) and (ORDER BY total_oil DESC), NULLs first
    j = ranking.with_ntiles(j, [("downtime_quartile", "total_downtime", True, True),
                                ("production_quartile", "total_oil", True, True)], 4,
                            buckets=buckets, null_policy=null_policy)
    return j.where((F.col("downtime_quartile") == 1) & (F.col("production_quartile") == 1)).select(
        "asset_id", "failure_count",
        F.col("total_downtime").alias("total_downtime_hours"),
        F.col("total_oil").alias("total_oil_barrels"),
        "downtime_quartile", "production_quartile",
        F.lit(HIGH_DOWNTIME_HIGH_OUTPUT_REASON).alias("why_it_is_here"),
    ).orderBy(desc("total_downtime_hours"), desc("total_oil_barrels"), asc("asset_id"))


# Cut-offs of the outage pattern (ours: the reference names the two patterns and gives no number).
MAJOR_OUTAGES = 1             # how many of the largest outages are looked at
MAJOR_SHARE = 50              # their share of the asset's downtime, in percent, from which it is "major"
CHRONIC_OUTAGES = 3           # outages from which the rest is "chronic"
OUTAGE_PATTERNS = ("major outage", "chronic", "few outages", "no downtime recorded")


def outage_patterns(m: DataFrame, largest: int = MAJOR_OUTAGES, share=MAJOR_SHARE,
                    chronic: int = CHRONIC_OUTAGES) -> DataFrame:
    """Does an asset's downtime come from a few long outages or from many short ones?

    An outage is an event with downtime above zero. ``major outage``: the
    ``largest`` longest outages make up ``share`` percent of the downtime or
    more (compared exactly, before rounding); else ``chronic`` from ``chronic``
    outages on, ``few outages`` below. The longest outages are read off each
    asset's histogram of hours, so an asset with a third of all events is a few
    rows and no event list is sorted.
    """
    hours = F.col("downtime_hours")
    hist = m.groupBy("asset_id", F.when(hours > 0, hours).alias("hours")).agg(F.count(F.lit(1)).alias("n"))
    longest = Window.partitionBy("asset_id").orderBy(desc("hours"))
    # NULL hours (no outage) come first and count nothing
    outages = F.when(F.col("hours").isNotNull(), F.col("n")).otherwise(F.lit(0))
    before = F.sum(outages).over(longest.rowsBetween(Window.unboundedPreceding, -1))
    taken = F.greatest(F.least(outages, F.lit(largest) - F.coalesce(before, F.lit(0))), F.lit(0))
    a = hist.withColumn("_out", outages).withColumn("_top", taken).groupBy("asset_id").agg(
        F.sum("n").alias("failure_count"), F.sum("_out").alias("outages"),
        F.coalesce(F.sum(F.col("hours") * F.col("_out")), F.lit(0)).alias("outage_hours"),
        F.max("hours").alias("longest_outage_hours"),
        F.coalesce(F.sum(F.col("hours") * F.col("_top")), F.lit(0)).alias("largest_outages_hours"))
    # share is taken as written: 33.3 is 333 / 1000 of the downtime
    part = Decimal(str(share))
    major = F.col("largest_outages_hours").cast("decimal(24,0)") * F.lit(100) >= F.lit(part) * F.col("outage_hours").cast("decimal(24,0)")
    labels = [F.lit(x) for x in OUTAGE_PATTERNS]
    return a.select(
        "asset_id", asset_class("asset_id").alias("asset_type"), "failure_count", "outages", "outage_hours",
        "longest_outage_hours", "largest_outages_hours",
        pct("largest_outages_hours", F.nullif(F.col("outage_hours"), F.lit(0)), 1).alias("pct_of_largest_outages"),
        F.when(F.col("outages") == 0, labels[3]).when(major, labels[0])
        .when(F.col("outages") >= chronic, labels[1]).otherwise(labels[2]).alias("outage_pattern"),
    ).orderBy(desc("outage_hours"), asc("asset_id"))


def reliability_yearly(m: DataFrame) -> DataFrame:
    """2.8 Failures and lost hours by year with year-on-year change."""
    y = m.groupBy(F.year("maintenance_date").alias("year")).agg(
        F.count(F.lit(1)).alias("failures"),
        F.countDistinct("asset_id").alias("assets_affected"),
        F.sum("downtime_hours").alias("total_downtime_hours"),
        exact_avg("downtime_hours", 1, precision=12).alias("avg_downtime_per_failure"))
    by_year = Window.orderBy("year")   # one row per calendar year
    prev_hours = F.lag("total_downtime_hours").over(by_year)
    prev_failures = F.lag("failures").over(by_year)
    return y.select(
        "year", "failures", "assets_affected", "total_downtime_hours", "avg_downtime_per_failure",
        (F.col("total_downtime_hours") - prev_hours).alias("downtime_change_vs_prior_year"),
        round_ratio((F.col("failures") - prev_failures) * F.lit(100),
                    F.nullif(prev_failures, F.lit(0)), 2, precision=20)
        .alias("pct_change_in_failures"),
    ).orderBy("year")
