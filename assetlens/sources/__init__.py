"""Sources and sinks: schemas, CSV/Parquet readers, load contract, test-data projection."""

from . import contract, files, projection, schemas  # noqa: F401
