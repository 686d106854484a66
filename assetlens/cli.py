"""Run named queries on maintenance, production and emissions tables.

The Spark counterpart of running the analysis scripts: load the three tables
(CSV with a header row, read by position; or Parquet with
``--input-format parquet``), run the requested queries, then print them or
write one output per query.

    python -m assetlens.cli --maintenance data/maintenance.csv \
        --production data/production.csv --emissions data/emissions.csv \
        --query risk_scores --query worklist --show 20
    python -m assetlens.cli ... --out /shared/results --format parquet

With no ``--query`` every named query runs. ``--validate`` checks the NOT
NULL columns first and stops on a violation.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .catalog import OPERATORS, reports
from .functions.exprs import register_sql_functions
from .plans.ranking import owned
from .sources import contract, files, schemas


def _load(spark: SparkSession, path: str, name: str, fmt: str):
    if fmt == "parquet":
        return files.read_table(spark, path, name)
    reader = {"maintenance": files.read_maintenance_csv, "production": files.read_production_csv,
              "emissions": files.read_emissions_csv}[name]
    return reader(spark, path)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="assetlens", description=__doc__.splitlines()[0])
    ap.add_argument("--maintenance", required=True)
    ap.add_argument("--production", required=True)
    ap.add_argument("--emissions", required=True)
    ap.add_argument("--input-format", default="csv", choices=["csv", "parquet"])
    ap.add_argument("--query", action="append", choices=sorted(OPERATORS),
                    help="query to run (repeatable; default: all)")
    ap.add_argument("--show", type=int, default=20, help="rows to print per query")
    ap.add_argument("--out", help="write each result under this folder instead of printing")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    ap.add_argument("--validate", action="store_true", help="fail on NOT NULL violations")
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName("assetlens").getOrCreate()
    register_sql_functions(spark)
    m = _load(spark, args.maintenance, "maintenance", args.input_format)
    p = _load(spark, args.production, "production", args.input_format)
    e = _load(spark, args.emissions, "emissions", args.input_format)
    if args.validate:
        m = contract.enforce(m, schemas.MAINTENANCE)
        p = contract.enforce(p, schemas.PRODUCTION)
        e = contract.enforce(e, schemas.EMISSIONS)
    files.register_views(spark, m, p, e)

    # One owner for the run: the view and the scores are built once for all reports
    # that need them, and every intermediate table goes at the end, after errors too.
    with owned(spark):
        built = reports(m, p, e)
        for key in args.query or list(OPERATORS):
            df = built(key)
            if args.out:
                w = df.write.mode("overwrite")
                if args.format == "csv":
                    w = w.option("header", True)
                getattr(w, args.format)(f"{args.out.rstrip('/')}/{key}")
                print(f"{key}: written", file=sys.stderr)
            else:
                print(f"== {key}")
                df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
