"""Declared schemas of the three source tables (no inference, no evolution)."""

from pyspark.sql import types as T

# Column order is the CSV column order, which the positional loads rely on.
MAINTENANCE = T.StructType([
    T.StructField("asset_id", T.StringType(), False),
    T.StructField("maintenance_date", T.DateType(), False),
    T.StructField("cost_usd", T.DecimalType(14, 2), True),
    T.StructField("failure_type", T.StringType(), True),
    T.StructField("downtime_hours", T.IntegerType(), True),
])

PRODUCTION = T.StructType([
    T.StructField("well_id", T.StringType(), False),
    T.StructField("production_date", T.DateType(), False),
    T.StructField("oil_production_barrels", T.IntegerType(), True),
    T.StructField("gas_production_mcf", T.IntegerType(), True),
    T.StructField("water_cut_pct", T.DecimalType(6, 2), True),
    T.StructField("pressure_psi", T.IntegerType(), True),
    T.StructField("temperature_c", T.IntegerType(), True),
])

EMISSIONS = T.StructType([
    T.StructField("asset_id", T.StringType(), False),
    T.StructField("co2_tons", T.DecimalType(12, 2), True),
    T.StructField("methane_leakage_tons", T.DecimalType(12, 2), True),
    T.StructField("energy_consumption_mwh", T.DecimalType(14, 2), True),
    T.StructField("reading_date", T.DateType(), True),
])

SCHEMAS = {"maintenance": MAINTENANCE, "production": PRODUCTION, "emissions": EMISSIONS}

#: Mark that a PERMISSIVE read puts on rows with an unreadable cell or a wrong field count.
MALFORMED = "_malformed"
#: Its reasons, an array of text.
REASONS = "_reasons"

# Scales of the decimal columns, used by the exact-rounding helpers.
COST_SCALE = 2
WATER_CUT_SCALE = 2
EMISSIONS_SCALE = 2


def required_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if not f.nullable]
