"""Readers for the three source tables (CSV as shipped, or Parquet marts).

The CSV contract follows a PostgreSQL ``COPY ... (FORMAT csv, HEADER true)``:
the header line is skipped and columns are taken by position (the production
header says ``date``; it lands in ``production_date``), an unquoted empty
field is NULL and a quoted empty field ``""`` is an empty string, numeric
values with more fractional digits than the column scale are rounded. Casts
are lazy: ``contract.enforce`` evaluates every cell and fails on a bad one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas

# PostgreSQL text cannot hold a zero byte, so this marker can't be data: with it
# Spark keeps "" as an empty string and unquoted empty fields become NULL, while
# a literal \N stays text.
_NULL_MARKER = "\x00"

# What a PERMISSIVE read says of a row (the second is followed by the column).
WRONG_FIELDS = "wrong number of fields"
UNREADABLE = "unreadable "


def _read_csv(spark: SparkSession, path: str, schema, mode: str, multiline: bool, header: bool) -> DataFrame:
    """All columns as text first, then cast.

    FAILFAST: a malformed number or date, or a short row, fails whatever reads
    it (ANSI cast). Any other mode gives NULL there and adds the boolean
    column ``schemas.MALFORMED`` and ``schemas.REASONS``, which says what could
    not be read. ``multiline`` allows line ends inside quoted fields; it makes
    each file one task. ``header`` says whether every file starts with a header line.
    """
    strict = mode.upper() == "FAILFAST"
    fields = [T.StructField(f.name, T.StringType(), True) for f in schema.fields]
    if not strict:
        fields.append(T.StructField("_corrupt", T.StringType(), True))
    raw = (spark.read
           .schema(T.StructType(fields))
           .option("header", header)
           .option("enforceSchema", True)   # positional: header names ignored
           .option("mode", mode)
           .option("columnNameOfCorruptRecord", "_corrupt")
           .option("quote", '"').option("escape", '"')      # doubled quotes, as COPY writes them
           .option("multiLine", multiline)
           .option("nullValue", _NULL_MARKER)
           .option("emptyValue", "")
           .csv(path))
    cols, bad = [], F.lit(False) if strict else F.col("_corrupt").isNotNull()
    reasons = [] if strict else [F.when(F.col("_corrupt").isNotNull(), F.lit(WRONG_FIELDS))]
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            cols.append(c.alias(f.name))
            # Never true: it keeps the column in the scan, without which Spark's
            # parser would not notice a row of too few fields.
            never = F.coalesce(F.length(c) < 0, F.lit(False))
            bad = bad | never
            reasons.append(F.when(never, F.lit(WRONG_FIELDS)))
        else:
            c = F.when(F.trim(c) != "", F.trim(c))
            if strict:
                cols.append(c.cast(f.dataType).alias(f.name))
            else:
                cols.append(c.try_cast(f.dataType).alias(f.name))
                unreadable = c.isNotNull() & c.try_cast(f.dataType).isNull()
                bad = bad | unreadable
                reasons.append(F.when(unreadable, F.lit(UNREADABLE + f.name)))
    if strict:
        return raw.select(*cols)
    return raw.select(*cols, bad.alias(schemas.MALFORMED), F.array_compact(F.array(*reasons)).alias(schemas.REASONS))


def read_maintenance_csv(spark: SparkSession, path: str, mode: str = "FAILFAST",
                         multiline: bool = False, header: bool = True) -> DataFrame:
    return _read_csv(spark, path, schemas.MAINTENANCE, mode, multiline, header)


def read_production_csv(spark: SparkSession, path: str, mode: str = "FAILFAST",
                        multiline: bool = False, header: bool = True) -> DataFrame:
    return _read_csv(spark, path, schemas.PRODUCTION, mode, multiline, header)


def read_emissions_csv(spark: SparkSession, path: str, mode: str = "FAILFAST",
                       multiline: bool = False, header: bool = True) -> DataFrame:
    return _read_csv(spark, path, schemas.EMISSIONS, mode, multiline, header)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Read a Parquet mart of one source table and conform it to the schema."""
    schema = schemas.SCHEMAS[name]
    df = spark.read.parquet(path)
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Idempotent rebuild: overwrite the Parquet output at ``path``."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def register_views(spark: SparkSession, m: DataFrame, p: DataFrame, e: DataFrame) -> None:
    """Expose the tables to Spark SQL under their domain names.

    ``maintenance``, ``production``, ``emissions``, the asset-grain view
    ``v_asset_reliability`` and the ``asset_class()`` SQL function; each is
    create-or-replace, so re-running is idempotent.
    """
    from ..functions.exprs import register_sql_functions
    from ..operators.risk import asset_reliability

    m.createOrReplaceTempView("maintenance")
    p.createOrReplaceTempView("production")
    e.createOrReplaceTempView("emissions")
    asset_reliability(m, p, e).createOrReplaceTempView("v_asset_reliability")
    register_sql_functions(spark)
