"""The superseded rules, kept as comparison operators.

The original queries joined raw event rows to raw readings and used fixed
thresholds. They are not the default, but a user comparing old and new
decisions needs their numbers, so they are reproduced here without ever
materialising the raw join: the fan-out of a row-level join is a product of
per-asset counts, so every inflated total follows from asset-grain
aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import asc, asset_class, desc
from .risk import ACTION_LABELS
from ..plans import ranking
from ..plans.summaries import emissions_by_asset, maintenance_by_asset, production_by_well

# Fixed values that must equal the reference (original queries 7 and 9).
FIXED_MIN_EVENTS = 5
FIXED_MIN_HOURS = 100
LADDER = (
    ("events", 3, "Immediate Maintenance Required"),
    ("hours", 100, "High Risk"),
    ("hours", 50, "Medium Risk"),
)
LADDER_ELSE = "Low Risk"


def fanout_audit(m: DataFrame, p: DataFrame, e: DataFrame) -> DataFrame:
    """Per asset: rows and totals the raw three-way join would produce vs the true ones.

    ``maintenance LEFT JOIN production LEFT JOIN emissions`` repeats each
    event ``max(n_p, 1) * max(n_e, 1)`` times and each production reading
    ``n_m`` times, so:

    * joined rows (what the original counted as "failures") =
      ``n_m * max(n_p, 1) * max(n_e, 1)``
    * downtime / cost summed over ``m LEFT JOIN p`` = true total * ``max(n_p, 1)``
    * oil summed over ``m LEFT JOIN p`` = ``n_m`` * true oil (NULL without production)
    """
    ms = maintenance_by_asset(m).select("asset_id", "events", "total_downtime", "total_cost")
    ps = production_by_well(p).select(F.col("well_id"), F.col("readings").alias("n_p"), "total_oil")
    es = emissions_by_asset(e).select(F.col("asset_id").alias("e_id"), F.col("readings").alias("n_e"))
    j = (ms.join(ps, ms["asset_id"] == ps["well_id"], "left")
           .join(es, ms["asset_id"] == es["e_id"], "left"))
    n_p = F.coalesce(F.col("n_p"), F.lit(0))
    n_e = F.coalesce(F.col("n_e"), F.lit(0))
    # products of counts can pass 2^63 long before the raw join would be
    # attempted, so they are formed as decimal(38,0)
    big = lambda c: c.cast("decimal(38,0)")
    rep_p = big(F.greatest(n_p, F.lit(1)))
    rep_e = big(F.greatest(n_e, F.lit(1)))
    return j.select(
        "asset_id",
        asset_class("asset_id").alias("asset_type"),
        F.col("events").alias("maintenance_events"),
        n_p.alias("production_readings"),
        n_e.alias("emissions_readings"),
        (big(F.col("events")) * rep_p * rep_e).cast("decimal(38,0)").alias("joined_rows"),
        F.col("total_downtime").alias("true_downtime_hours"),
        (big(F.col("total_downtime")) * rep_p).cast("decimal(38,0)").alias("joined_downtime_hours"),
        F.col("total_cost").alias("true_maintenance_cost"),
        (F.col("total_cost") * rep_p).cast("decimal(38,2)").alias("joined_maintenance_cost"),
        F.col("total_oil").alias("true_oil_barrels"),
        (big(F.col("total_oil")) * big(F.col("events"))).cast("decimal(38,0)")
        .alias("joined_oil_barrels"),
    ).orderBy(desc("joined_rows"), asc("asset_id"))


def fixed_threshold_flags(m: DataFrame, min_events: int = FIXED_MIN_EVENTS,
                          min_hours: int = FIXED_MIN_HOURS) -> DataFrame:
    """Original query 7: ``HAVING COUNT(*) > min_events AND SUM(hours) > min_hours``.

    Cost is summed as exact decimal (the original's float cast is a known defect).
    """
    s = maintenance_by_asset(m)
    return s.where((F.col("events") > min_events) & (F.col("total_downtime") > min_hours)).select(
        "asset_id",
        F.col("events").alias("failures"),
        F.col("total_downtime").alias("downtime"),
        F.col("total_cost").alias("cost"),
    ).orderBy(desc("downtime"), asc("asset_id"))


def ladder_action(events, hours, ladder=LADDER, otherwise: str = LADDER_ELSE):
    """The ladder as a Column: the first rule whose metric exceeds its threshold wins."""
    metric = {"events": events, "hours": hours}
    action = None
    for what, threshold, label in ladder:
        cond = metric[what] > threshold
        action = F.when(cond, label) if action is None else action.when(cond, label)
    return action.otherwise(otherwise)


def rule_ladder(m: DataFrame, ladder=LADDER, otherwise: str = LADDER_ELSE) -> DataFrame:
    """Original query 9: first matching rule wins (count first, then hours)."""
    s = maintenance_by_asset(m)
    return s.select(
        "asset_id",
        F.col("events").alias("failures"),
        F.col("total_downtime").alias("downtime"),
        F.col("total_cost").alias("cost"),
        ladder_action(F.col("events"), F.col("total_downtime"), ladder, otherwise)
        .alias("maintenance_action"),
    ).orderBy(asc("asset_id"))


def scaled_ladder(times: int) -> tuple:
    """The ladder with every threshold ``times`` as high, for longer histories
    (the fixed thresholds put a fleet with many events per asset in one tier)."""
    return tuple((what, threshold * times, label) for what, threshold, label in LADDER)


def _tiers(scored: DataFrame, ladder, otherwise: str) -> DataFrame:
    """The scored fleet (3.4) with each asset's ladder label and tier (``_l``, 1 is the
    most urgent); it carries event counts and downtime, so no second pass over the events."""
    labels = [label for _, _, label in ladder] + [otherwise]
    action = ladder_action(F.col("failure_count"), F.col("total_downtime_hours"), ladder, otherwise)
    return scored.select(
        "asset_id",
        F.col("failure_count").alias("failures"),
        F.col("total_downtime_hours").alias("downtime"),
        action.alias("maintenance_action"),
        "risk_score", "recommended_action",
    ).withColumn("_l", F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("maintenance_action")))


def tier_mismatches(scored: DataFrame, ladder=LADDER, otherwise: str = LADDER_ELSE) -> DataFrame:
    """Assets that the rule ladder and the score put in different tiers.

    Both scales have four tiers, most urgent first: the ladder's labels in
    rule order, the score's action bands in label order. ``direction`` says
    which one ranks the asset higher. The tiers' sizes differ, so most of a
    fleet can be listed; :func:`priority_inversions` compares the orders.
    """
    band = F.array_position(F.array(*[F.lit(x) for x in ACTION_LABELS]), F.col("recommended_action"))
    return _tiers(scored, ladder, otherwise).withColumn("_s", band).where("_l <> _s") \
        .withColumn("direction", F.when(F.col("_l") < F.col("_s"), "ladder higher").otherwise("score higher")) \
        .drop("_l", "_s").orderBy(desc("risk_score"), asc("asset_id"))


def priority_inversions(scored: DataFrame, ladder=LADDER, otherwise: str = LADDER_ELSE,
                        buckets: int | None = None) -> DataFrame:
    """Pairs of assets that the rule ladder and the score put in opposite order, counted per asset.

    ``overtaken_by`` counts the assets that the ladder puts in a more urgent
    tier although their score is lower, ``overtakes`` those in a less urgent
    tier although their score is higher. Assets with neither are left out.

    No pair is formed: the score histogram holds one count per tier, its
    running sums over score positions give the assets of each tier below and
    above a score, and every asset reads its two counts off the histogram.
    Assets without a score have no order and are left out.
    """
    tiers = range(1, len(ladder) + 2)
    fleet = ranking.materialize(_tiers(scored, ladder, otherwise).where(F.col("risk_score").isNotNull()), "tiers")
    hist = fleet.groupBy("risk_score").agg(*[F.count_if(F.col("_l") == t).alias(f"_t{t}") for t in tiers])
    sums = ranking.positions(hist, [asc("risk_score")], sums={f"t{t}": F.col(f"_t{t}") for t in tiers}, buckets=buckets)
    below = {t: F.col(f"_cum_t{t}") - F.col(f"_t{t}") for t in tiers}
    above = {t: F.col(f"_tot_t{t}") - F.col(f"_cum_t{t}") for t in tiers}
    total = lambda counts, on: sum((F.when(on(F.col("_l"), t), counts[t]).otherwise(F.lit(0)) for t in tiers), F.lit(0))
    return fleet.join(sums, "risk_score").select(
        "asset_id", "failures", "downtime", "maintenance_action", "risk_score", "recommended_action",
        total(below, lambda own, t: own > t).alias("overtaken_by"),
        total(above, lambda own, t: own < t).alias("overtakes"),
    ).where("overtaken_by + overtakes > 0").orderBy(desc("overtaken_by"), desc("overtakes"), asc("asset_id"))
