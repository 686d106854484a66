"""Written intermediate tables with an explicit owner.

A :class:`Scratch` owns every table one query (or one shared build) writes.
The tables lie under the folder the cluster names in ``spark.checkpoint.dir``,
so they outlive a lost executor and cut the lineage in one job.
"""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_base(spark: SparkSession) -> str:
    """Shared folder for intermediate tables; only a ``local`` master may lack one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; a shared folder is required")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="assetlens-ckpt-"))
    return sc.getCheckpointDir().rstrip("/")


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a URI or of an absolute local path."""
    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


class Scratch:
    """Tables of one owner; use as a context manager or call :meth:`drop_all`."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{checkpoint_base(spark)}/assetlens-{uuid.uuid4().hex}"
        self._live: dict[str, str] = {}
        self._count = 0

    def folder(self, name: str) -> str:
        """Path of a new sub-folder that the owner's tasks may write to."""
        self._count += 1
        self._live[name] = f"{self.path}/{self._count:03d}-{name}"
        return self._live[name]

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet in one job and return it read back.

        The job's shuffle files go as soon as the table stands.
        """
        path = self.folder(name)
        conf, before = self.spark.conf, self.spark.conf.get(_FREE_SHUFFLES, None)
        conf.set(_FREE_SHUFFLES, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.unset(_FREE_SHUFFLES) if before is None else conf.set(_FREE_SHUFFLES, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no DataFrame will read any more."""
        for name in names:
            system, inner = filesystem(self._live.pop(name))
            if system.get_file_info(inner).type != fs.FileType.NotFound:
                system.delete_dir(inner)

    def drop_all(self) -> None:
        self._live.clear()
        system, inner = filesystem(self.path)
        if system.get_file_info(inner).type != fs.FileType.NotFound:
            system.delete_dir(inner)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *exc) -> None:
        self.drop_all()
