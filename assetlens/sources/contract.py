"""Load contract: checks of every declared column and the surrogate event key.

Spark's readers return every column as nullable, so the NOT NULL columns of
the declared schemas are checked explicitly, either failing the load or
splitting the rows into accepted and quarantined frames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import materialize, positions
from . import schemas
from .files import UNREADABLE
from .marts import Mart

MISSING = "missing "            # followed by the required column that is NULL
MALFORMED_ROW = "malformed row"  # marked by a reader that gives no reasons


def violation(df: DataFrame, schema) -> Column:
    """TRUE for rows that break a NOT NULL column of ``schema`` or that the reader marked malformed."""
    checks = [F.col(c).isNull() for c in schemas.required_columns(schema)]
    if schemas.MALFORMED in df.columns:
        checks.append(F.col(schemas.MALFORMED))
    return reduce(lambda a, b: a | b, checks, F.lit(False))


def split_valid(df: DataFrame, schema) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) without any action.

    Read with mode PERMISSIVE, so that rows with unreadable cells or too few
    fields are marked; the accepted frame loses the mark.
    """
    bad = violation(df, schema)
    return df.where(~bad).drop(schemas.MALFORMED, schemas.REASONS), df.where(bad)


def reasons(df: DataFrame, schema) -> Column:
    """The rules that a row breaks, as an array: what the reader could not read,
    then the required columns that are NULL (and were not unreadable)."""
    known = F.array().cast("array<string>")
    if schemas.REASONS in df.columns:
        known = F.col(schemas.REASONS)
    elif schemas.MALFORMED in df.columns:
        known = F.when(F.col(schemas.MALFORMED), F.array(F.lit(MALFORMED_ROW))).otherwise(known)
    missing = [F.when(F.col(c).isNull() & ~F.array_contains(known, UNREADABLE + c), F.lit(MISSING + c))
               for c in schemas.required_columns(schema)]
    return F.concat(known, F.array_compact(F.array(*missing)) if missing else F.array().cast("array<string>"))


def split_rejects(df: DataFrame, schema) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects) without any action; rejects carry ``schemas.REASONS``.

    The rejects are a mart like any other table: write them, count them with
    :func:`reason_counts`, or correct them and load them again.
    """
    judged = df.withColumn(schemas.REASONS, reasons(df, schema)).drop(schemas.MALFORMED)
    broken = F.size(schemas.REASONS) > 0
    return judged.where(~broken).drop(schemas.REASONS), judged.where(broken)


def reason_counts(rejects: DataFrame) -> DataFrame:
    """reason, row_count: rejects per broken rule in one pass (a row counts for each of its rules)."""
    return rejects.select(F.explode(schemas.REASONS).alias("reason")).groupBy("reason") \
        .agg(F.count(F.lit(1)).alias("row_count")).orderBy(F.desc("row_count"), "reason")


def enforce(df: DataFrame, schema) -> DataFrame:
    """Fail on a NULL in a required column, an unreadable cell or a short row.

    One aggregate over *every* column of the schema, so each cast and each
    field of every row is evaluated whatever the later queries select (the
    rows are not collected). Returns the frame typed as ``schema``.
    """
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields],
                      *[c for c in df.columns if c == schemas.MALFORMED])
    marks = [F.count_if(schemas.MALFORMED).alias("malformed rows")] if schemas.MALFORMED in df.columns else []
    found = typed.agg(F.count(F.lit(1)).alias("rows"), *marks,
                      *[F.count(f.name).alias(f.name) for f in schema.fields]).first()
    short = {c: found["rows"] - found[c] for c in schemas.required_columns(schema) if found[c] < found["rows"]}
    if marks and found["malformed rows"]:
        short["malformed rows"] = found["malformed rows"]
    if short:
        raise ValueError(f"contract violated, rows by column: {short}")
    return typed.drop(schemas.MALFORMED)


def null_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, required, row_count, null_count of every declared column.

    One aggregate pass per table, unpivoted to a row per column.
    """
    out = None
    for name, df in tables.items():
        schema = schemas.SCHEMAS[name]
        counts = df.agg(F.count(F.lit(1)).alias("_rows"),
                        *[F.count_if(F.col(f.name).isNull()).alias(f.name) for f in schema.fields])
        rows = counts.select(F.lit(name).alias("table_name"), "_rows", F.explode(F.array(*[
            F.struct(F.lit(f.name).alias("column_name"), F.lit(int(not f.nullable)).alias("required"),
                     F.col(f.name).alias("null_count")) for f in schema.fields])).alias("c")) \
            .select("table_name", "c.column_name", "c.required", F.col("_rows").alias("row_count"), "c.null_count")
        out = rows if out is None else out.unionByName(rows)
    return out


def with_surrogate_key(df: DataFrame, name: str = "maintenance_id",
                       order: list[str] | None = None) -> DataFrame:
    """Dense, increasing 1-based id over the natural columns.

    Numbered with distributed range buckets (no single-task window). Rows
    with equal natural columns are interchangeable, so a row id breaks their
    ties: a block of identical rows, even a third of the table, is spread
    over several buckets. Every distinct row gets the same ids on every run.
    """
    cols = order or df.columns
    tagged = df.withColumn("_tie", F.monotonically_increasing_id())
    keyed = positions(tagged, [F.col(c).asc_nulls_last() for c in cols] + [F.col("_tie").asc()])
    return keyed.withColumnRenamed("_pos", name).drop("_n", "_tie").select(name, *df.columns)


def append_keyed(mart: Mart, loaded: DataFrame, name: str = "maintenance_id", whole: bool = True) -> DataFrame:
    """Publish the events of ``loaded`` that ``mart`` does not hold yet, numbered on from its last id.

    Events keep the id of their first load. A ``whole`` load repeats the stored
    events: they are taken off as a multiset (equal rows are events of their
    own) by one aggregation over the natural columns, and only what is left is
    sorted and numbered. With ``whole=False`` every loaded row is a new event.
    Stored files are not rewritten: a load is a part of the mart. Returns the mart's rows.
    """
    columns = loaded.columns
    last = 0
    if mart.parts():
        stored = mart.read()
        last = stored.agg(F.max(name)).first()[0] or 0
        if whole:
            loaded = materialize(loaded.exceptAll(stored.select(*columns)), "new-events")
    keyed = with_surrogate_key(loaded, name).withColumn(name, F.col(name) + F.lit(last))
    mart.publish({f"load-{mart.version() + 1:06d}": keyed})
    return mart.read()
