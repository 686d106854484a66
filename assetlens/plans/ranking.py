"""Fleet-wide ranking without a single-partition window.

The reference ranks the whole fleet with ``ROW_NUMBER``, ``NTILE``,
``PERCENT_RANK``, running ``SUM`` and ``PERCENTILE_CONT`` over un-partitioned
windows. Written naively in Spark, each of those becomes
``Exchange SinglePartition``: every asset in one task. Here the global order
is cut into range buckets instead:

1. ``repartitionByRange`` on the full sort key (always ending in a unique
   column, so heavy ties are split across buckets too), sort inside each
   bucket and number the rows with ``monotonically_increasing_id`` (bucket
   id in the high bits, position in the low bits).
2. That numbered frame is written to the cluster's checkpoint folder and
   read back, so bucket ids and positions are fixed even if a stage is
   recomputed after an executor is lost.
3. Per-bucket counts and sums (one row per bucket, bounded by the bucket
   count, not by the data) become prefix offsets and are broadcast back.

Ties with equal rank (``RANK`` / ``PERCENT_RANK``) are handled on a
histogram (one row per distinct value), which also removes value skew: a
value held by a third of the fleet is one histogram row.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

_LOW_BITS = 33          # monotonically_increasing_id: partition id << 33
_LOW_MASK = (1 << _LOW_BITS) - 1

_OWNER: contextvars.ContextVar[Scratch | None] = contextvars.ContextVar("owner", default=None)


@contextlib.contextmanager
def owned(spark: SparkSession):
    """Tables written by rankings in this block belong to it and go when it ends.

    Evaluate every result inside the block. The tables are dropped after an
    error too. Outside any block a table's owner is the process.
    """
    with Scratch(spark) as scratch:
        token = _OWNER.set(scratch)
        try:
            yield scratch
        finally:
            _OWNER.reset(token)


def materialize(df: DataFrame, name: str = "ranking") -> DataFrame:
    """Write ``df`` as a Parquet table of the current owner and read it back.

    This cuts the lineage like ``checkpoint()`` (the table lives in the shared
    folder the cluster names in ``spark.checkpoint.dir``, so it survives
    executor loss), but runs one job. Everything a caller relies on later
    (bucket ids, positions) is stored as columns, not in the partition layout.
    """
    return workspace(df.sparkSession).save(df, name)


def workspace(spark: SparkSession) -> Scratch:
    """Scratch of the current :func:`owned` block, else one that the process owns."""
    scratch = _OWNER.get()
    if scratch is None:
        scratch = Scratch(spark)
        atexit.register(scratch.drop_all)
    return scratch


def positions(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None,
              buckets: int | None = None, within: str | None = None) -> DataFrame:
    """Add global 1-based ``_pos`` in ``order`` plus ``_n`` (row count).

    ``order`` must be a strict total order (end it with a unique column).
    For every ``name -> column`` in ``sums`` the frame also gets
    ``_cum_<name>`` (running SUM over ``ROWS UNBOUNDED PRECEDING .. CURRENT
    ROW``, NULL while every value so far is NULL) and ``_tot_<name>``.

    ``within`` names a non-null column that is the first key of ``order``
    and takes a handful of values (several metrics stacked into one frame):
    positions, counts and sums then restart for each of its values, so one
    range pass ranks several metrics. Sums must be non-null in that case.
    """
    sums = sums or {}
    base = df
    for name, col in sums.items():
        base = base.withColumn(f"_v_{name}", col)
    # Without ``buckets`` the session's partitions apply and AQE may merge adjacent
    # ones (bucket order stays monotone).
    ranged = base.repartitionByRange(buckets, *order) if buckets else base.repartitionByRange(*order)
    numbered = materialize(
        ranged.sortWithinPartitions(*order)
        .withColumn("_rid", F.monotonically_increasing_id()))
    numbered = (numbered
                .withColumn("_bucket", F.shiftright("_rid", _LOW_BITS))
                .withColumn("_idx", F.col("_rid").bitwiseAND(F.lit(_LOW_MASK)))
                .drop("_rid"))

    stats = numbered.groupBy("_bucket").agg(
        F.count(F.lit(1)).alias("_bn"),
        *[F.sum(f"_v_{name}").alias(f"_bs_{name}") for name in sums])
    # One row per bucket: the window below runs over as many rows as there are buckets.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = stats.select(
        "_bucket",
        F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"),
        F.sum("_bn").over(everything).alias("_n"),
        *[F.sum(f"_bs_{name}").over(before).alias(f"_off_{name}") for name in sums],
        *[F.sum(f"_bs_{name}").over(everything).alias(f"_tot_{name}") for name in sums])

    out = numbered
    if sums:
        inside = (Window.partitionBy("_bucket").orderBy("_idx")
                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        for name in sums:
            out = out.withColumn(f"_in_{name}", F.sum(f"_v_{name}").over(inside))
    out = out.join(F.broadcast(offsets), "_bucket")
    out = out.withColumn("_pos", F.col("_off") + F.col("_idx") + F.lit(1))
    for name in sums:
        off, inb = F.col(f"_off_{name}"), F.col(f"_in_{name}")
        out = out.withColumn(
            f"_cum_{name}",
            F.when(off.isNull(), inb).when(inb.isNull(), off).otherwise(off + inb))
    drop = ["_bucket", "_idx", "_off"]
    for name in sums:
        drop += [f"_v_{name}", f"_in_{name}", f"_off_{name}"]
    out = out.drop(*drop)
    if within is None:
        return out
    # Offsets of each stacked group: one row per group (a handful), broadcast back.
    grp = numbered.groupBy(within).agg(
        F.count(F.lit(1)).alias("_gn"),
        *[F.sum(f"_v_{name}").alias(f"_gs_{name}") for name in sums])
    prior = Window.orderBy(within).rowsBetween(Window.unboundedPreceding, -1)
    goff = grp.select(
        within,
        F.coalesce(F.sum("_gn").over(prior), F.lit(0)).alias("_goff"),
        F.col("_gn"),
        *[F.coalesce(F.sum(f"_gs_{name}").over(prior), F.lit(0)).alias(f"_goff_{name}")
          for name in sums],
        *[F.col(f"_gs_{name}") for name in sums])
    out = out.join(F.broadcast(goff), within)
    out = out.withColumn("_pos", F.col("_pos") - F.col("_goff")).withColumn("_n", F.col("_gn"))
    for name in sums:
        out = (out.withColumn(f"_cum_{name}", F.col(f"_cum_{name}") - F.col(f"_goff_{name}"))
               .withColumn(f"_tot_{name}", F.col(f"_gs_{name}")))
    return out.drop("_goff", "_gn", *[f"_goff_{n}" for n in sums], *[f"_gs_{n}" for n in sums])


def ntile_of(pos, n, k: int) -> Column:
    """``NTILE(k)`` from a 1-based position and the row count.

    The first ``n % k`` tiles hold one extra row, as in PostgreSQL and Spark.
    """
    pos, n = F.col(pos) if isinstance(pos, str) else pos, F.col(n) if isinstance(n, str) else n
    div = lambda a, b: F.call_function("div", a.cast("long"), b.cast("long"))   # exact integers
    q = div(n, F.lit(k))
    r = n - q * F.lit(k)
    big = r * (q + F.lit(1))
    # when n < k every row is in the first branch, so q = 0 is never a divisor
    return (F.when(pos <= big, div(pos - F.lit(1), q + F.lit(1)) + F.lit(1))
            .otherwise(r + div(pos - F.lit(1) - big, q) + F.lit(1))).cast("int")


def with_row_number(df: DataFrame, order: list[Column], name: str,
                    buckets: int | None = None) -> DataFrame:
    """``ROW_NUMBER() OVER (ORDER BY order)`` as column ``name``; also ``_n``."""
    return positions(df, order, buckets=buckets).withColumnRenamed("_pos", name)


def with_ntile(df: DataFrame, order: list[Column], k: int, name: str,
               buckets: int | None = None, measured: Column | None = None) -> DataFrame:
    """``NTILE(k) OVER (ORDER BY order)`` as column ``name``.

    With ``measured`` (a condition that ``order`` puts first), only the rows it
    holds for are cut into tiles; the others' tile is NULL.
    """
    if measured is None:
        p = positions(df, order, buckets=buckets)
        return p.withColumn(name, ntile_of("_pos", "_n", k)).drop("_pos", "_n")
    p = positions(df, [measured.desc(), *order], sums={"m": measured.cast("long")}, buckets=buckets)
    return p.withColumn(name, F.when(measured, ntile_of("_pos", "_tot_m", k))).drop("_pos", "_n", "_cum_m", "_tot_m")


def _check_exact(df: DataFrame, metrics: list[str], value_type: str) -> None:
    """Stacking casts every metric to ``value_type``; refuse casts that lose digits."""
    from pyspark.sql import types as T
    target = T._parse_datatype_string(value_type)
    if not isinstance(target, T.DecimalType):
        return
    int_digits = target.precision - target.scale
    for c in metrics:
        t = df.schema[c].dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            ok = int_digits >= 19
        elif isinstance(t, T.DecimalType):
            ok = t.scale <= target.scale and t.precision - t.scale <= int_digits
        else:
            ok = False
        if not ok:
            raise TypeError(f"metric {c} ({t.simpleString()}) does not fit {value_type} exactly")


def _stack(df: DataFrame, metrics: list[str], value_type: str, keep: list[str]) -> DataFrame:
    """One row per (row, metric): ``_metric`` index and ``_value`` cast to a common type."""
    _check_exact(df, metrics, value_type)
    parts = [F.struct(F.lit(i).alias("_metric"), F.col(c).cast(value_type).alias("_value"))
             for i, c in enumerate(metrics)]
    return df.select(*keep, F.explode(F.array(*parts)).alias("_s")).select(
        *keep, "_s._metric", "_s._value")


#: What a ranking does with NULL values: rank them as the reference's ORDER BY does,
#: or give them no rank and leave them out of the row count.
NULL_POLICIES = ("rank", "exclude")


def excludes_nulls(null_policy: str) -> bool:
    if null_policy not in NULL_POLICIES:
        raise ValueError(f"null_policy is one of {NULL_POLICIES}, not {null_policy!r}")
    return null_policy == "exclude"


def rank_tables(df: DataFrame, metrics: list[str], value_type: str = "decimal(38,6)",
                buckets: int | None = None, null_policy: str = "rank") -> DataFrame:
    """``RANK() OVER (ORDER BY m)`` (ascending, NULLs last as one peer group) for
    several metrics in one distributed pass.

    Returns ``_metric, _value, _rank, _n``: one row per distinct value of each
    metric (NULL included, unless ``null_policy`` excludes it). Ranking runs on
    the value histogram, so a value shared by a third of the fleet is a single row.
    """
    stacked = _stack(df, metrics, value_type, [])
    if excludes_nulls(null_policy):
        stacked = stacked.where(F.col("_value").isNotNull())
    hist = stacked.groupBy("_metric", "_value").agg(F.count(F.lit(1)).alias("_cnt"))
    ranked = positions(hist, [F.col("_metric").asc(), F.col("_value").asc_nulls_last()],
                       sums={"cnt": F.col("_cnt")}, buckets=buckets, within="_metric")
    return ranked.select(
        "_metric", "_value",
        (F.col("_cum_cnt") - F.col("_cnt") + F.lit(1)).alias("_rank"),
        F.col("_tot_cnt").alias("_n"))


def with_ranks(df: DataFrame, metrics: dict[str, str], key: str = "asset_id",
               n_name: str = "_n", value_type: str = "decimal(38,6)",
               buckets: int | None = None, null_policy: str = "rank") -> DataFrame:
    """Attach ``RANK`` of each metric column as ``metrics[col]`` and the row count.

    With ``null_policy="exclude"`` a NULL has a NULL rank, and the counts differ
    by metric: ``metrics[col] + n_name`` holds the ranked rows of each.

    One plan for every size: the fleet's (key, metric, value) rows join the
    rank table on (metric, value), NULL-safe, and fold back to one row per
    ``key`` (unique). Spark picks the join at run time and splits skewed
    values; nothing is counted or broadcast by hand.
    """
    cols = list(metrics)
    exclude = excludes_nulls(null_policy)
    rt = rank_tables(df, cols, value_type, buckets, null_policy).select(
        F.col("_metric").alias("_rm"), F.col("_value").alias("_rv"), "_rank", "_n")
    stacked = _stack(df, cols, value_type, [key])
    j = stacked.join(rt, (stacked["_metric"] == rt["_rm"]) & stacked["_value"].eqNullSafe(rt["_rv"]),
                     "inner")
    # numeric-only fold (hash aggregate), then one join back on the unique key
    ranks = j.groupBy(key).agg(
        *[F.max(F.when(F.col("_metric") == i, F.col("_rank"))).alias(metrics[c])
          for i, c in enumerate(cols)],
        *([F.max(F.when(F.col("_metric") == i, F.col("_n"))).alias(metrics[c] + n_name)
           for i, c in enumerate(cols)] if exclude else [F.max("_n").alias(n_name)]))
    return df.join(ranks, key, "left" if exclude else "inner")


def with_ntiles(df: DataFrame, specs: list[tuple[str, str, bool, bool]], k: int,
                tie: str = "asset_id", value_type: str = "decimal(38,6)",
                buckets: int | None = None, null_policy: str = "rank") -> DataFrame:
    """``NTILE(k)`` for several orders in one distributed pass.

    ``specs`` holds ``(output_name, value_column, descending, nulls_first)``;
    ``tie`` (unique per row) breaks ties so the tiles are deterministic.
    Excluded NULLs have a NULL tile, and the tiles are cut over the other rows.
    """
    metrics = [value for _, value, _, _ in specs]
    stacked = _stack(df, metrics, value_type, [tie])
    exclude = excludes_nulls(null_policy)
    if exclude:
        stacked = stacked.where(F.col("_value").isNotNull())
    # one sort for all metrics: flip ascending metrics, place NULLs explicitly
    key, nulls_rank = F.col("_value"), F.lit(1)
    for i, (_, _, descending, nulls_first) in enumerate(specs):
        is_i = F.col("_metric") == i
        if not descending:
            key = F.when(is_i, -F.col("_value")).otherwise(key)
        nulls_rank = F.when(is_i & F.col("_value").isNull(),
                            F.lit(0 if nulls_first else 2)).otherwise(nulls_rank)
    stacked = stacked.withColumn("_key", key).withColumn("_nr", nulls_rank)
    pos = positions(stacked, [F.col("_metric").asc(), F.col("_nr").asc(),
                              F.col("_key").desc(), F.col(tie).asc()],
                    buckets=buckets, within="_metric")
    pos = pos.withColumn("_tile", ntile_of("_pos", "_n", k))
    tiles = pos.groupBy(tie).agg(*[
        F.max(F.when(F.col("_metric") == i, F.col("_tile"))).alias(name)
        for i, (name, _, _, _) in enumerate(specs)])
    return df.join(tiles, tie, "left" if exclude else "inner")


def percentile_conts(df: DataFrame, metrics: list[str], fraction: float,
                     value_type: str = "decimal(38,6)",
                     buckets: int | None = None) -> list[float | None]:
    """``PERCENTILE_CONT(fraction) WITHIN GROUP (ORDER BY m)`` per metric, NULLs ignored.

    Exact selection without a sort or a written table: each order statistic
    around ``fraction * (n - 1)`` lies in a range of values, at first the whole
    one. A pass cuts every range into ``buckets`` (1024 by default) equal parts,
    counts the values in each and goes on in the part that holds the wanted
    position, so log(range) / log(buckets) passes end in a single value. A pass
    brings at most two ranges of counts per metric to the driver, whatever the
    rows; ``df`` is read once per pass, so hand over a written table.
    Interpolation follows PostgreSQL in double arithmetic,
    ``lo + (hi - lo) * proportion``, so threshold comparisons agree with it.
    """
    from pyspark.sql import types as T
    _check_exact(df, metrics, value_type)
    parts = max(2, buckets or 1024)
    scale = T._parse_datatype_string(value_type).scale
    units = [F.col(m).cast(value_type).cast(f"decimal(38,{scale})") * F.lit(Decimal(10) ** scale) for m in metrics]
    whole = df.select(*[u.cast("decimal(38,0)").alias(f"_u{i}") for i, u in enumerate(units)])
    seen = whole.agg(*[f(f"_u{i}").alias(f"{n}{i}") for i in range(len(metrics))
                       for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    # (metric, position) -> [lowest value, highest value, position counted from the lowest]
    place, ranges = {}, {}
    for i in range(len(metrics)):
        if seen[f"n{i}"]:
            # fraction * (n - 1) in double, as PostgreSQL computes it (IEEE, same as Python)
            place[i] = fraction * float(seen[f"n{i}"] - 1)
            for k in {math.floor(place[i]), math.ceil(place[i])}:
                ranges[i, k] = [int(seen[f"lo{i}"]), int(seen[f"hi{i}"]), k]
    whole_number = lambda x: F.lit(Decimal(x)).cast("decimal(38,0)")
    while open_ := [t for t, (lo, hi, _) in ranges.items() if lo < hi]:
        width = {t: -(-(ranges[t][1] - ranges[t][0] + 1) // parts) for t in open_}
        marks = [F.when(F.col(f"_u{t[0]}").between(whole_number(ranges[t][0]), whole_number(ranges[t][1])),
                        F.struct(F.lit(j).alias("t"), F.call_function("div", F.col(f"_u{t[0]}") - whole_number(ranges[t][0]), whole_number(width[t]))
                                 .cast("int").alias("part"))) for j, t in enumerate(open_)]
        counts = whole.select(F.explode(F.array_compact(F.array(*marks))).alias("m")).groupBy("m.t", "m.part").count().collect()
        for j, t in enumerate(open_):
            lo, hi, k = ranges[t]
            for part, n in sorted((r["part"], r["count"]) for r in counts if r["t"] == j):
                if k < n:
                    ranges[t] = [lo + part * width[t], min(hi, lo + (part + 1) * width[t] - 1), k]
                    break
                k -= n
    value = {t: float(Decimal(lo).scaleb(-scale)) for t, (lo, _, _) in ranges.items()}
    out = []
    for i in range(len(metrics)):
        if i not in place:
            out.append(None)
            continue
        lo, hi = math.floor(place[i]), math.ceil(place[i])
        first, second = value[i, lo], value[i, hi]
        out.append(first if lo == hi else first + (second - first) * (place[i] - lo))
    return out
