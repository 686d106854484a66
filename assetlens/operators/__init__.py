"""Operators: each is a function of DataFrames (plus parameters) returning a DataFrame.

quality (D1-D5), cost (1.1-1.7), reliability (2.1-2.8), risk (3.1-3.6),
legacy (the superseded rules, kept as comparison operators).
"""

from . import cost, legacy, quality, reliability, risk  # noqa: F401
