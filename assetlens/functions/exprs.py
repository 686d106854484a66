"""Column-level helpers shared by every operator.

Everything here returns a ``Column`` built from Spark built-ins, so it stays
inside whole-stage codegen. Nothing here triggers an action.

Conventions the reference relies on (PostgreSQL):

* ``ORDER BY x`` puts NULLs last, ``ORDER BY x DESC`` puts them first.
  Spark's defaults are the opposite, so every sort goes through
  :func:`asc` / :func:`desc`.
* ``ROUND(numeric, d)`` rounds half away from zero on the exact value.
  Ratios are therefore rounded with integer division on unscaled decimals
  (:func:`round_ratio`) rather than through a double or a truncated
  decimal quotient.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference: asset id prefix -> class label.
ASSET_CLASS_PREFIXES = (
    ("WEL", "Well"),
    ("PIP", "Pipeline"),
    ("REF", "Refinery"),
)
UNKNOWN_CLASS = "Unknown"

ASSET_CLASS_SQL = (
    "CREATE OR REPLACE TEMPORARY FUNCTION asset_class(p_asset_id STRING) "
    "RETURNS STRING RETURN CASE left(p_asset_id, 3) "
    + " ".join(f"WHEN '{p}' THEN '{label}'" for p, label in ASSET_CLASS_PREFIXES)
    + f" ELSE '{UNKNOWN_CLASS}' END"
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def asset_class(asset_id="asset_id") -> Column:
    """``LEFT(id, 3)`` mapped to a class label; NULL and lower case -> Unknown."""
    prefix = F.left(_col(asset_id), F.lit(3))
    out = None
    for p, label in ASSET_CLASS_PREFIXES:
        out = (F.when(prefix == p, label) if out is None
               else out.when(prefix == p, label))
    return out.otherwise(UNKNOWN_CLASS)


def register_sql_functions(spark) -> None:
    """Register ``asset_class`` as a SQL function (inlined by Catalyst)."""
    spark.sql(ASSET_CLASS_SQL)


# -- ordering -------------------------------------------------------------

def asc(c) -> Column:
    """PostgreSQL ``ORDER BY c`` (NULLS LAST)."""
    return _col(c).asc_nulls_last()


def desc(c) -> Column:
    """PostgreSQL ``ORDER BY c DESC`` (NULLS FIRST)."""
    return _col(c).desc_nulls_first()


# -- exact arithmetic -----------------------------------------------------

def unscaled(c, scale: int) -> Column:
    """Integer value of a decimal with ``scale`` digits (exact), as decimal(38,0)."""
    c = _col(c)
    if scale:
        c = c * F.lit(Decimal(10) ** scale)
    return c.cast("decimal(38,0)")


def _times_pow10(c: Column, k: int) -> Column:
    return c * F.lit(Decimal(10) ** k) if k else c


def _scaled_back(q: Column, digits: int, precision: int) -> Column:
    q = q.cast("decimal(38,0)")
    if digits:
        q = q * F.lit(Decimal(1).scaleb(-digits))
    return q.cast(f"decimal({precision},{digits})")


def round_ratio(num, den, digits: int, num_scale: int = 0, den_scale: int = 0,
                precision: int = 38) -> Column:
    """``ROUND(num / den, digits)`` exactly, half away from zero.

    ``num`` and ``den`` are decimal or integral columns with ``num_scale`` /
    ``den_scale`` fractional digits. On the unscaled integers ``a / b`` the
    result is ``(2 * a * 10^digits + sign(a) * |b|) div (2 * b)``: ``div``
    truncates toward zero, so adding half of ``|b|`` in the direction of the
    numerator rounds half away from zero for every sign combination, and no
    intermediate rounding can move a value across a half-unit boundary. NULL
    or zero ``den`` gives NULL (callers that need PostgreSQL's error instead
    guard with ``nullif`` like the reference).
    """
    a = _times_pow10(unscaled(num, num_scale), den_scale)
    b = _times_pow10(unscaled(den, den_scale), num_scale)
    b = F.when(b != 0, b)
    half = F.when(a < 0, -F.abs(b)).when(a > 0, F.abs(b)).otherwise(F.lit(0))
    q = F.call_function("div", (a * F.lit(2 * 10 ** digits) + half).cast("decimal(38,0)"),
                        (b * F.lit(2)).cast("decimal(38,0)"))
    return _scaled_back(q, digits, precision)


def exact_avg(c, digits: int, scale: int = 0, precision: int = 38) -> Column:
    """``ROUND(AVG(c), digits)`` with NULLs skipped; exact on the decimal sum."""
    c = _col(c)
    return round_ratio(F.sum(c), F.count(c), digits, num_scale=scale,
                       precision=precision)


def pct(part, whole, digits: int, scale: int = 0) -> Column:
    """``ROUND(100.0 * part / whole, digits)`` exactly (both with ``scale``)."""
    return round_ratio(_col(part) * F.lit(100), whole, digits,
                       num_scale=scale, den_scale=scale)


def pct_change(cur, prev, digits: int, scale: int = 0) -> Column:
    """``ROUND(100.0 * (cur - prev) / NULLIF(prev, 0), digits)``."""
    return round_ratio((_col(cur) - _col(prev)) * F.lit(100),
                       F.nullif(_col(prev), F.lit(0)), digits,
                       num_scale=scale, den_scale=scale)
