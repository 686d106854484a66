"""Parquet tables published in versions.

A :class:`Mart` is a folder of named parts (loads, periods, or one part for a
whole table). A rebuild writes its parts into new folders and only then
publishes a version: a small file that lists the folder of every part. Readers
follow the newest version, so while a rebuild runs, and after one that failed,
they read the former rows. A version file appears under its final name in one
rename that fails if the name is taken, so two writers can't publish the same
version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

_VERSIONS, _DATA = "versions", "data"


def located(spark: SparkSession, path: str):
    """(file system, path) as Spark itself resolves them, so a mart may lie wherever Spark can write."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


class Mart:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, *parts: str):
        return located(self.spark, "/".join([self.path, *parts]))

    def version(self) -> int:
        """Number of the newest version; 0 before the first."""
        system, folder = self._at(_VERSIONS)
        if not system.exists(folder):
            return 0
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith(("_", "."))), default=0)

    def _manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"schema": None, "parts": {}}
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/{_VERSIONS}/{version:09d}.json").collect()))

    def parts(self, version: int | None = None) -> dict[str, str]:
        """Folder of each part of a version (the newest by default)."""
        return self._manifest(version)["parts"]

    def read(self, *names: str, version: int | None = None) -> DataFrame:
        """Rows of the named parts, or of all of them."""
        held = self._manifest(version)
        if not held["schema"]:
            raise ValueError(f"nothing is published in {self.path}")
        folders = [f"{self.path}/{_DATA}/{f}" for n, f in held["parts"].items() if not names or n in names]
        if not folders:
            return self.spark.createDataFrame([], held["schema"])
        return self.spark.read.schema(held["schema"]).parquet(*folders)

    def publish(self, frames: dict[str, DataFrame], replace: bool = False) -> int:
        """Write ``frames`` as parts of a new version and return its number.

        Parts of the same name are replaced and the others stay, unless
        ``replace`` makes the frames the whole mart. Parts share one schema.
        """
        base = self.version()
        held = self._manifest(base)
        schema = held["schema"] if held["parts"] and not replace else None
        parts = {} if replace else dict(held["parts"])
        for name, df in frames.items():
            found = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
            if schema is None:
                schema = found
            elif schema != found:
                raise ValueError(f"part {name} has columns {found}, the mart has {schema}")
            folder = f"{name}-{uuid.uuid4().hex[:12]}"
            df.write.parquet(f"{self.path}/{_DATA}/{folder}")
            parts[name] = folder
        self._commit(base + 1, {"schema": schema, "parts": parts})
        return base + 1

    def _commit(self, version: int, manifest: dict) -> None:
        system, folder = self._at(_VERSIONS)
        system.mkdirs(folder)
        _, draft = self._at(_VERSIONS, f"_{uuid.uuid4().hex}")
        out = system.create(draft)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        _, final = self._at(_VERSIONS, f"{version:09d}.json")
        gateway = self.spark.sparkContext._gateway
        none = gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, none)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the folders that none of the newest ``keep`` versions lists, and older versions.

        Also clears what failed rebuilds left. Call it when no reader is still
        on an older version and no rebuild is under way.
        """
        newest = self.version()
        kept = range(max(1, newest - keep + 1), newest + 1)
        used = {f for v in kept for f in self.parts(v).values()}
        gone = []
        for parent, stays in ((_DATA, lambda n: n in used), (_VERSIONS, lambda n: not n.startswith("_") and int(n.strip(".").split(".")[0]) in kept)):
            system, folder = self._at(parent)
            for status in system.listStatus(folder) if system.exists(folder) else []:
                name = status.getPath().getName()
                if not name.endswith(".crc") and not stays(name):
                    system.delete(status.getPath(), True)
                    gone.append(f"{parent}/{name}")
        return gone
