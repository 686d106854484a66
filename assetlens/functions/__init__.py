"""Column helpers: asset class, exact averages and ratios, PostgreSQL null ordering."""

from .exprs import (  # noqa: F401
    asc, asset_class, desc, exact_avg, pct, pct_change, register_sql_functions,
    round_ratio, unscaled,
)
