"""The asset view (3.1) kept as stored states: add a period, read no other.

Three tables hold mergeable states (``plans.summaries``) per period and asset:
counts, sums, extremes, and counts by failure type for the mode. They are
partitioned by period and bucketed on the asset key into the same number of
buckets, so that

* adding or correcting a period aggregates that period's events only and
  overwrites its partition,
* the view merges states, joins production and joins emissions without any
  shuffle: equal keys already share a bucket.

States are bounded by periods x failure types per asset, so an asset with a
third of all events is a few rows of its bucket. A period is a month
(``yyyy-MM``) or a year (``yyyy``); rows without a date belong to the period ``none``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.risk import view_of
from ..plans.summaries import (emissions_states, finish_emissions, finish_maintenance, finish_production,
                               maintenance_states, merge_maintenance, production_states)
from .marts import located

NO_DATE = "none"
BUCKETS = 64
# table -> (states, asset key, date column)
_STATES = {
    "maintenance": (maintenance_states, "asset_id", "maintenance_date"),
    "production": (production_states, "well_id", "production_date"),
    "emissions": (emissions_states, "asset_id", "reading_date"),
}


def period_of(date, grain: str = "month") -> Column:
    return F.coalesce(F.date_format(date, {"month": "yyyy-MM", "year": "yyyy"}[grain]), F.lit(NO_DATE))


def in_period(date: str, period: str) -> Column:
    """Rows of a month or a year as a date range, which reaches the scan."""
    if period == NO_DATE:
        return F.col(date).isNull()
    year, _, month = period.partition("-")
    first = F.to_date(F.lit(f"{year}-{month or '01'}-01"))
    return (F.col(date) >= first) & (F.col(date) < F.add_months(first, 1 if month else 12))


class AssetMart:
    """Tables ``<name>_maintenance``, ``<name>_production`` and ``<name>_emissions`` under ``path``.

    The catalog of a session without a metastore is empty at its start:
    opening the mart on an existing path finds its partitions again. ``buckets``
    and ``grain`` (month, year) are fixed when the mart is made; take about one
    bucket per 100 MB of a source's states.
    """

    def __init__(self, spark: SparkSession, path: str, name: str | None = None, buckets: int = BUCKETS, grain: str = "month"):
        self.spark, self.path, self.buckets, self.grain = spark, path.rstrip("/"), buckets, grain
        self.name = name or f"asset_mart_{uuid.uuid4().hex[:12]}"

    def table(self, source: str) -> str:
        return f"{self.name}_{source}"

    def _open(self, source: str, states: DataFrame) -> None:
        if self.spark.catalog.tableExists(self.table(source)):
            return
        _, key, _ = _STATES[source]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in states.schema.fields if f.name != "period")
        self.spark.sql(f"CREATE TABLE {self.table(source)} ({columns}, period STRING) USING parquet PARTITIONED BY (period) "
                       f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{source}'")
        system, folder = located(self.spark, f"{self.path}/{source}")
        if system.exists(folder):
            self.spark.sql(f"MSCK REPAIR TABLE {self.table(source)}")

    def _states(self, source: str, rows: DataFrame) -> DataFrame:
        make, key, date = _STATES[source]
        states = make(rows.withColumn("period", period_of(date, self.grain)), "period")
        # one task per bucket, so a partition has one file per bucket
        return states.repartition(self.buckets, key)

    def build(self, m: DataFrame, p: DataFrame, e: DataFrame) -> "AssetMart":
        """States of every period; the mart must be empty."""
        for source, rows in zip(_STATES, (m, p, e)):
            states = self._states(source, rows)
            self._open(source, states)
            if self.spark.sql(f"SHOW PARTITIONS {self.table(source)}").head(1):
                raise ValueError(f"{self.table(source)} holds periods already; use put()")
            states.createOrReplaceTempView(f"{self.table(source)}_new")
            columns = ", ".join(f"`{c}`" for c in states.columns if c != "period")
            self.spark.sql(f"INSERT INTO {self.table(source)} PARTITION (period) SELECT {columns}, period FROM {self.table(source)}_new")
            self.spark.catalog.dropTempView(f"{self.table(source)}_new")
        return self

    def put(self, period: str, m: DataFrame, p: DataFrame, e: DataFrame) -> "AssetMart":
        """Add a period, or put its states anew. Reads the period's rows of the sources only."""
        for source, rows in zip(_STATES, (m, p, e)):
            states = self._states(source, rows.where(in_period(_STATES[source][2], period)))
            self._open(source, states)
            states.createOrReplaceTempView(f"{self.table(source)}_new")
            columns = ", ".join(f"`{c}`" for c in states.columns if c != "period")
            self.spark.sql(f"INSERT OVERWRITE TABLE {self.table(source)} PARTITION (period = '{period}') "
                           f"SELECT {columns} FROM {self.table(source)}_new")
            self.spark.catalog.dropTempView(f"{self.table(source)}_new")
        return self

    def periods(self) -> list[str]:
        return sorted(r[0].split("=")[1] for r in self.spark.sql(f"SHOW PARTITIONS {self.table('maintenance')}").collect())

    def view(self) -> DataFrame:
        """3.1, merged from the states bucket by bucket (the joins are merge joins
        whatever the tables' size, as a broadcast would move what lies in place)."""
        ms = finish_maintenance(merge_maintenance(self.spark.table(self.table("maintenance"))))
        ps = finish_production(self.spark.table(self.table("production")))
        es = finish_emissions(self.spark.table(self.table("emissions")))
        return view_of(ms, ps.hint("merge"), es.hint("merge"))

    def close(self) -> None:
        """Forget the tables; their files stay."""
        for source in _STATES:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table(source)}")
