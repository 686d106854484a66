"""NULLs left out of rankings, inversions counted pair by pair, outage patterns, selection of percentiles."""

import random
from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from assetlens.operators import cost, legacy, reliability, risk
from assetlens.plans import ranking
from assetlens.plans.scratch import Scratch
from assetlens.sources import schemas

from fixtures import by, tables


def events(spark, rows):
    """Rows (asset, hours, cost) as events of one day."""
    return spark.createDataFrame([(a, date(2024, 1, 1), None if c is None else D(c), "Leak", h) for a, h, c in rows], schemas.MAINTENANCE)


def test_unknown_policy_is_refused(spark):
    m, _, _ = tables(spark)
    with pytest.raises(ValueError):
        cost.cost_concentration(m, null_policy="drop")


def test_excluded_assets_keep_no_rank_and_do_not_count(spark):
    m = events(spark, [("A", 10, 5), ("B", None, 7), ("C", 30, None), ("D", 10, 9)])
    rows = by(reliability.downtime_concentration(m, null_policy="exclude").collect())
    assert [(rows[a].downtime_rank, rows[a].cumulative_pct_of_downtime) for a in "CAD"] == [(1, D(60)), (2, D(80)), (3, D(100))]
    assert rows["B"].downtime_rank is None and rows["B"].cumulative_pct_of_downtime is None
    assert by(reliability.downtime_concentration(m).collect())["B"].downtime_rank == 1      # the reference's order
    view = risk.asset_reliability(*[m, *tables(spark)[1:]])
    scores = by(risk.risk_scores(view, null_policy="exclude").collect())
    # downtime: A and D share rank 1 of 3, C has rank 3; cost: A, B, D of 3; one event each
    assert scores["C"].risk_score == D("50.0") and scores["C"].cost_contribution is None
    assert scores["B"].downtime_contribution is None and scores["B"].risk_score == D("10.0")
    assert scores["D"].risk_score == D("20.0") and scores["A"].risk_score == D("0.0")
    assert by(risk.risk_scores(view).collect())["B"].downtime_contribution == D("50.0")


def test_policies_agree_without_nulls(spark):
    rnd = random.Random(4)
    m = events(spark, [(f"A{i:03d}", rnd.randint(0, 20), rnd.randint(0, 50)) for i in range(90) for _ in range(rnd.randint(1, 3))])
    view = ranking.materialize(risk.asset_reliability(m, *tables(spark)[1:]))
    assert sorted(risk.risk_scores(view).collect()) == sorted(risk.risk_scores(view, null_policy="exclude").collect())
    assert cost.cost_concentration(m).collect() == cost.cost_concentration(m, null_policy="exclude").collect()


@pytest.mark.parametrize("buckets", [None, 3])
def test_inversions_equal_all_pairs(spark, buckets):
    rnd = random.Random(9)
    # a third of the fleet shares one score
    rows = [(f"A{i:03d}", rnd.choice([1, 2, 4, 9]), rnd.choice([None, 0, 51, 101, 300]), D(500 if i % 3 == 0 else rnd.randint(0, 1000)) / 10)
            for i in range(150)]
    scored = spark.createDataFrame([(*r, "x") for r in rows],
                                   "asset_id string, failure_count long, total_downtime_hours long, risk_score decimal(4,1), recommended_action string")
    tier = lambda n, h: 1 if n > 3 else 2 if (h or 0) > 100 else 3 if (h or 0) > 50 else 4
    want = {}
    for a, n, h, s in rows:
        pairs = [(tier(n2, h2), s2) for b, n2, h2, s2 in rows if b != a]
        got = (sum(t < tier(n, h) and s2 < s for t, s2 in pairs), sum(t > tier(n, h) and s2 > s for t, s2 in pairs))
        if any(got):
            want[a] = got
    out = legacy.priority_inversions(scored, buckets=buckets).collect()
    assert {r.asset_id: (r.overtaken_by, r.overtakes) for r in out} == want and len(want) > 50
    assert sum(r.overtaken_by for r in out) == sum(r.overtakes for r in out)
    assert [(-r.overtaken_by, -r.overtakes, r.asset_id) for r in out] == sorted((-r.overtaken_by, -r.overtakes, r.asset_id) for r in out)


def test_ladder_inversion_of_the_golden_rows(spark):
    # three short failures beat 600 hours on the ladder, not by score
    m = events(spark, [("MANY", 1, 1)] * 4 + [("LONG", 600, 900)] * 2)
    view = risk.asset_reliability(m, *tables(spark)[1:])
    rows = by(legacy.priority_inversions(risk.risk_scores(view)).collect())
    assert (rows["LONG"].overtaken_by, rows["LONG"].overtakes) == (1, 0) and (rows["MANY"].overtaken_by, rows["MANY"].overtakes) == (0, 1)


def test_outage_patterns(spark):
    m = events(spark, [("MAJOR", 100, 1), ("MAJOR", 60, 1), ("MAJOR", 40, 1), ("CHRONIC", 5, 1)] + [("CHRONIC", 5, 1)] * 3
               + [("FEW", 10, 1), ("FEW", 11, 1), ("FEW", -3, 1), ("NONE", 0, 1), ("NONE", None, 1), ("HOT", 1, 1)] + [("HOT", 2, 1)] * 600)
    rows = by(reliability.outage_patterns(m, share=55).collect())
    assert rows["MAJOR"].outage_pattern == "chronic" and rows["MAJOR"].pct_of_largest_outages == D("50.0")
    rows = by(reliability.outage_patterns(m).collect())
    assert {a: r.outage_pattern for a, r in rows.items()} == {
        "MAJOR": "major outage", "CHRONIC": "chronic", "FEW": "major outage", "NONE": "no downtime recorded", "HOT": "chronic"}
    assert (rows["FEW"].outages, rows["FEW"].outage_hours, rows["FEW"].failure_count) == (2, 21, 3)
    assert rows["NONE"].pct_of_largest_outages is None
    # the three largest outages of several asked for, ties split within a histogram row
    top = by(reliability.outage_patterns(m, largest=3, share=99, chronic=5).collect())
    assert top["CHRONIC"].largest_outages_hours == 15 and top["CHRONIC"].outage_pattern == "few outages"
    assert top["HOT"].largest_outages_hours == 6 and top["MAJOR"].outage_pattern == "major outage"


@pytest.mark.parametrize("parts", [None, 2, 7])
def test_percentiles_are_selected_without_a_written_table(spark, parts):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, 7, rnd.randint(-10**9, 10**9)]), D(rnd.randint(-500, 10**6)) / 100) for _ in range(301)]
    df = spark.createDataFrame(rows, "a long, b decimal(14,2)")
    with ranking.owned(spark) as scratch:
        for fraction in (0.0, 0.5, 0.9, 1.0):
            got = ranking.percentile_conts(df, ["a", "b"], fraction, buckets=parts)
            for name, value in zip("ab", got):
                want = df.where(F.col(name).isNotNull()).select(F.percentile(F.col(name).cast("double"), F.lit(fraction))).first()[0]
                assert value == pytest.approx(want, rel=1e-12)
        assert scratch._count == 0
    assert isinstance(scratch, Scratch)
