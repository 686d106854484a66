"""Module 03: the asset reliability view, risk score, action bands, worklist (3.1 - 3.6)."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import asc, asset_class, desc, pct, round_ratio
from ..plans import ranking
from ..plans.summaries import (emissions_by_asset, maintenance_by_asset_with_mode,
                               production_by_well)
from ..sources.schemas import EMISSIONS_SCALE

# Fixed values that must equal the reference.
# Score weights (downtime, frequency, cost) and band cut-offs on the rounded score.
DEFAULT_WEIGHTS = (Decimal("0.50"), Decimal("0.30"), Decimal("0.20"))
DEFAULT_CUTOFFS = (Decimal("95"), Decimal("85"), Decimal("60"))
ACTION_LABELS = ("1. Inspect now", "2. Schedule this quarter", "3. Monitor", "4. No action")
EMISSIONS_BANDS = {
    1: "Highest emitting quarter",
    2: "Above average",
    3: "Below average",
    4: "Lowest emitting quarter",
}
DUAL_THRESHOLD_PERCENTILE = 0.90

def asset_reliability(m: DataFrame, p: DataFrame, e: DataFrame) -> DataFrame:
    """3.1 One row per maintained asset: three asset-grain aggregates, two left joins."""
    return view_of(maintenance_by_asset_with_mode(m), production_by_well(p), emissions_by_asset(e))


def view_of(ms: DataFrame, ps: DataFrame, es: DataFrame) -> DataFrame:
    """3.1 from the three one-row-per-asset summaries."""
    ps = ps.withColumnRenamed("readings", "production_readings")
    es = es.withColumnRenamed("readings", "emissions_readings").withColumnRenamed("asset_id", "e_asset_id")
    j = (ms.join(ps, ms["asset_id"] == ps["well_id"], "left")
           .join(es, ms["asset_id"] == es["e_asset_id"], "left"))
    return j.select(
        "asset_id",
        asset_class("asset_id").alias("asset_type"),
        F.col("events").alias("failure_count"),
        F.col("total_cost").alias("total_maintenance_cost"),
        F.col("avg_cost").alias("avg_cost_per_failure"),
        F.col("total_downtime").alias("total_downtime_hours"),
        F.col("avg_downtime").alias("avg_downtime_per_failure"),
        F.col("max_downtime").alias("worst_outage_hours"),
        F.col("mode_failure_type").alias("most_common_failure_type"),
        F.col("first_date").alias("first_failure"),
        F.col("latest_date").alias("latest_failure"),
        "production_readings",
        F.col("total_oil").alias("total_oil_barrels"),
        F.col("total_gas").alias("total_gas_mcf"),
        F.col("avg_water_cut").alias("avg_water_cut_pct"),
        F.col("avg_pressure").alias("avg_pressure_psi"),
        "emissions_readings",
        F.col("avg_co2").alias("avg_co2_tons"),
        F.col("total_co2").alias("total_co2_tons"),
        F.col("avg_methane").alias("avg_methane_tons"),
        F.col("avg_energy").alias("avg_energy_mwh"),
    )


def emissions_failures(view: DataFrame, buckets: int | None = None) -> DataFrame:
    """3.2a Assets with CO2 readings, emissions and failure quartiles over that set."""
    v = view.where(F.col("avg_co2_tons").isNotNull()).select(
        "asset_id", "asset_type", "failure_count", "total_downtime_hours",
        "avg_co2_tons", "avg_methane_tons", "avg_energy_mwh")
    # NTILE(4) OVER (ORDER BY avg_co2_tons DESC NULLS LAST) and (ORDER BY failure_count DESC)
    v = ranking.with_ntiles(v, [("emissions_quartile", "avg_co2_tons", True, False),
                                ("failure_quartile", "failure_count", True, True)], 4,
                            buckets=buckets)
    return v.select(
        "asset_id", "asset_type", "failure_count", "total_downtime_hours", "avg_co2_tons",
        "avg_methane_tons", "avg_energy_mwh", "emissions_quartile", "failure_quartile",
    ).orderBy(desc("avg_co2_tons"), asc("asset_id"))


def emissions_quartiles(view: DataFrame, buckets: int | None = None) -> DataFrame:
    """3.2b Per emissions quartile: size, mean (already rounded) CO2, failures, downtime."""
    v = view.where(F.col("avg_co2_tons").isNotNull()).select(
        "asset_id", "failure_count", "total_downtime_hours", "avg_co2_tons")
    v = ranking.with_ntile(v, [desc("avg_co2_tons"), asc("asset_id")], 4,
                           "emissions_quartile", buckets)
    g = v.groupBy("emissions_quartile").agg(
        F.count(F.lit(1)).alias("assets"),
        round_ratio(F.sum("avg_co2_tons"), F.count("avg_co2_tons"), 2,
                    num_scale=EMISSIONS_SCALE, precision=14).alias("mean_co2_tons"),
        round_ratio(F.sum("failure_count"), F.count("failure_count"), 2,
                    precision=20).alias("mean_failures_per_asset"),
        round_ratio(F.sum("total_downtime_hours"), F.count("total_downtime_hours"), 1,
                    precision=20).alias("mean_downtime_hours"))
    band = None
    for k, label in EMISSIONS_BANDS.items():
        cond = F.col("emissions_quartile") == k
        band = F.when(cond, label) if band is None else band.when(cond, label)
    return g.select("emissions_quartile", band.alias("band"), "assets", "mean_co2_tons",
                    "mean_failures_per_asset", "mean_downtime_hours").orderBy("emissions_quartile")


def _pg_numeric_1dp(x: float) -> Decimal:
    """``ROUND(x::NUMERIC, 1)`` for a double: 15 significant digits, then half up."""
    return Decimal(format(x, ".15g")).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP)


def dual_p90(view: DataFrame, fraction: float = DUAL_THRESHOLD_PERCENTILE,
             buckets: int | None = None) -> DataFrame:
    """3.3 Assets at or above the fleet's 90th percentile on both count and downtime.

    The two thresholds are exact ``PERCENTILE_CONT`` values computed with
    distributed positions over value histograms; only the two scalars reach
    the driver and enter the plan as literals.
    """
    v = ranking.materialize(view.select(
        "asset_id", "asset_type", "failure_count", "total_downtime_hours",
        "total_maintenance_cost", "most_common_failure_type", "total_oil_barrels"))
    f90, d90 = ranking.percentile_conts(v, ["failure_count", "total_downtime_hours"], fraction,
                                        buckets=buckets)
    if f90 is None or d90 is None:
        keep = F.lit(False)
        f_used = d_used = F.lit(None).cast("decimal(20,1)")
    else:
        keep = ((F.col("failure_count").cast("double") >= F.lit(f90))
                & (F.col("total_downtime_hours").cast("double") >= F.lit(d90)))
        f_used = F.lit(_pg_numeric_1dp(f90)).cast("decimal(20,1)")
        d_used = F.lit(_pg_numeric_1dp(d90)).cast("decimal(20,1)")
    return v.where(keep).select(
        "asset_id", "asset_type", "failure_count", "total_downtime_hours",
        "total_maintenance_cost", "most_common_failure_type", "total_oil_barrels",
        f_used.alias("failure_threshold_used"), d_used.alias("downtime_threshold_used"),
    ).orderBy(desc("total_downtime_hours"), desc("failure_count"), asc("asset_id"))


def _weight_units(weights) -> tuple[list[int], int]:
    """Weights as integers over a common power of ten (exact)."""
    ws = [Decimal(str(w)) for w in weights]
    scale = max(0, *[-w.as_tuple().exponent for w in ws])
    return [int(w.scaleb(scale)) for w in ws], 10 ** scale


def risk_scores(view: DataFrame, weights=DEFAULT_WEIGHTS, cutoffs=DEFAULT_CUTOFFS,
                buckets: int | None = None, null_policy: str = "rank") -> DataFrame:
    """3.4 Weighted percent-rank score (0-100, 1 dp) and recommended action.

    ``PERCENT_RANK`` of downtime, failure count and cost (ascending, NULLs
    last) is ``(rank - 1) / (n - 1)``; ranks come from distributed value
    histograms. The score is computed exactly from the integer ranks,
    ``sum(w_i * (rank_i - 1)) / (n - 1)``, and rounded half up once, which
    is what the reference's double arithmetic yields after its cast to
    numeric. Bands test the rounded score.

    A NULL metric ranks last, so an asset without recorded downtime gets up to
    50 points, as in the reference. With ``null_policy="exclude"`` it has no
    rank, does not count in its metric's n, and contributes NULL: the score is
    the sum of the measured components. It is exact for fleets of up to 10**10
    assets (three counts multiplied, within 38 digits).
    """
    exclude = ranking.excludes_nulls(null_policy)
    units, denom = _weight_units(weights)
    v = ranking.materialize(view.select(
        "asset_id", "asset_type", "failure_count", "total_downtime_hours",
        "total_maintenance_cost", "most_common_failure_type", "total_oil_barrels",
        "latest_failure"))
    # the three percent ranks come from one distributed pass over value histograms
    ranks = ("_rd", "_rf", "_rc")
    v = ranking.with_ranks(v, dict(zip(("total_downtime_hours", "failure_count", "total_maintenance_cost"), ranks)),
                           key="asset_id", n_name="_n", buckets=buckets, null_policy=null_policy)
    # 100 * w * (r - 1) / (n - 1) with w = unit / denom  ->  unit * (r - 1) / (denom/100 * (n-1))
    parts = [F.lit(u) * (F.col(r) - 1) * F.lit(100) for u, r in zip(units, ranks)]
    steps = [F.greatest(F.coalesce(F.col(r + "_n" if exclude else "_n"), F.lit(1)) - 1, F.lit(1)) for r in ranks]
    contrib = [round_ratio(pt, n * F.lit(denom), 1, precision=4) for pt, n in zip(parts, steps)]
    if exclude:
        # over the common denominator of the three counts
        a, b, c = (n.cast("decimal(12,0)") for n in steps)
        known = [F.coalesce(pt, F.lit(0)).cast("decimal(18,0)") for pt in parts]
        whole = known[0] * b * c + known[1] * a * c + known[2] * a * b
        measured = F.coalesce(*parts).isNotNull()
        score = F.when(measured, round_ratio(whole.cast("decimal(38,0)"), (a * b * c).cast("decimal(38,0)") * F.lit(denom), 1, precision=4))
    else:
        score = round_ratio(parts[0] + parts[1] + parts[2], steps[0] * F.lit(denom), 1, precision=4)
    c1, c2, c3 = (F.lit(Decimal(str(c))) for c in cutoffs)
    action = (F.when(F.col("risk_score") >= c1, ACTION_LABELS[0])
              .when(F.col("risk_score") >= c2, ACTION_LABELS[1])
              .when(F.col("risk_score") >= c3, ACTION_LABELS[2])
              .otherwise(ACTION_LABELS[3]))
    return (v.withColumn("risk_score", score)
            .select(
                "asset_id", "asset_type", "failure_count", "total_downtime_hours",
                "total_maintenance_cost", "most_common_failure_type", "total_oil_barrels",
                "latest_failure", "risk_score", action.alias("recommended_action"),
                contrib[0].alias("downtime_contribution"),
                contrib[1].alias("frequency_contribution"),
                contrib[2].alias("cost_contribution"))
            .orderBy(desc("risk_score"), asc("asset_id")))


# Fixed labels for the main-driver helper, one per score component.
DRIVER_LABELS = ("downtime", "frequency", "cost")


def with_main_driver(scored: DataFrame) -> DataFrame:
    """Add ``main_driver``: the component contributing most to the score.

    Ties go to the earlier component (downtime, then frequency, then cost),
    the order of the weights.
    """
    d, f, c = (F.col(x) for x in ("downtime_contribution", "frequency_contribution",
                                  "cost_contribution"))
    top = (F.when((d >= f) & (d >= c), DRIVER_LABELS[0])
           .when(f >= c, DRIVER_LABELS[1])
           .otherwise(DRIVER_LABELS[2]))
    return scored.withColumn("main_driver", top)


def action_bands(scored: DataFrame) -> DataFrame:
    """3.5 Workload per action band (at most four groups)."""
    g = scored.groupBy("recommended_action").agg(
        F.count(F.lit(1)).alias("assets"),
        F.sum("total_downtime_hours").alias("downtime_hours_covered"),
        F.sum("total_maintenance_cost").alias("cost_covered"))
    # grand totals: one scalar subquery over the (at most four) band rows
    totals = g.select(F.struct(F.sum("assets").alias("assets"),
                               F.sum("downtime_hours_covered").alias("hours"))).scalar()
    g = g.withColumn("_all", totals)
    return g.select(
        "recommended_action", "assets",
        pct("assets", "_all.assets", 1).alias("pct_of_fleet"),
        "downtime_hours_covered",
        pct("downtime_hours_covered", "_all.hours", 1).alias("pct_of_all_downtime_covered"),
        "cost_covered",
    ).orderBy("recommended_action")


def worklist(scored: DataFrame, cutoff=DEFAULT_CUTOFFS[0], capacity: int | None = None,
             buckets: int | None = None) -> DataFrame:
    """3.6 Assets scoring at or above the top cut-off, numbered by score.

    Scores (percent ranks) are computed over the whole fleet before the filter.
    ``capacity`` turns it into a top-N report ("we can inspect N assets"): the
    N best-scoring assets above the cut-off, ties broken by ``asset_id``.
    """
    top = scored.where(F.col("risk_score") >= F.lit(Decimal(str(cutoff))))
    if capacity is not None:
        top = top.orderBy(desc("risk_score"), asc("asset_id")).limit(int(capacity))
    top = ranking.with_row_number(top, [desc("risk_score"), asc("asset_id")], "priority", buckets)
    return top.select(
        "priority", "asset_id", "asset_type",
        F.col("most_common_failure_type").alias("likely_fault"),
        F.col("failure_count").alias("failures_to_date"),
        F.col("total_downtime_hours").alias("hours_lost"),
        F.col("total_maintenance_cost").alias("spend_to_date"),
        F.col("total_oil_barrels").alias("barrels_produced"),
        F.col("latest_failure").alias("last_seen"),
        "risk_score",
    ).orderBy("priority")
