"""State between runs: versioned snapshots of tables, with one pointer that makes a run visible.

A store is a folder. The tables of a run are Parquet under ``tables/<run id>``; what
names them is the file ``versions/<number>``, which is created last and never
changed. The highest number is the current state. So a run that fails before that leaves
the old state as it is, readers keep what they opened, and of two runs that began
from one state the second finds its number taken and is refused.

Creating the pointer without overwriting is what must be atomic, as it is on HDFS and
on local disks; on object stores it is as safe as their connector's exclusive create.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another run has changed the state since it was read."""


@dataclass(frozen=True)
class Version:
    number: int
    run_id: str
    tables: dict[str, str]
    folder: str


class Snapshots:
    """A store of snapshots at ``path``, any folder that Hadoop's file systems reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        """Numbers of the versions there are, in order."""
        folder = self._at("versions")
        if not self._files.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self._files.listStatus(folder) if f.getPath().getName().isdigit() and f.getLen() > 0)

    def version(self, number: int) -> Version:
        stream = self._files.open(self._at(f"versions/{number:010d}"))
        try:
            told = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Version(number, told["run_id"], told["tables"], told["folder"])

    def current(self) -> Version | None:
        known = self.versions()
        return self.version(known[-1]) if known else None

    def read(self, version: Version | None = None) -> dict[str, DataFrame] | None:
        """The tables of a version, by default of the current one; None if there is none yet."""
        version = version or self.current()
        if version is None:
            return None
        return {name: self.spark.read.schema(schema).parquet(f"{self.path}/{version.folder}/{name}") for name, schema in version.tables.items()}

    def commit(self, run_id: str, tables: dict[str, DataFrame], base: Version | None) -> Version:
        """Write ``tables`` and make them the state that follows ``base`` (None: the first one).

        Raises ``Conflict`` if ``base`` is no longer current, before and after the tables
        are written. A run may be committed again under its id after a failure.
        """
        number = base.number + 1 if base else 1
        self._still(base)
        folder = f"tables/{run_id}-{uuid.uuid4().hex[:12]}"
        for name, df in tables.items():
            df.write.option("compression", "zstd").parquet(f"{self.path}/{folder}/{name}")
        self._still(base)
        told = {"run_id": run_id, "folder": folder, "tables": {name: df._jdf.schema().toDDL() for name, df in tables.items()}}
        try:
            stream = self._files.create(self._at(f"versions/{number:010d}"), False)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                raise Conflict(f"version {number} of {self.path} was made by another run") from error
            raise
        try:
            stream.write(bytearray(json.dumps(told).encode()))
        finally:
            stream.close()
        return Version(number, run_id, told["tables"], folder)

    def _still(self, base: Version | None) -> None:
        known = self.versions()
        if known and (base is None or known[-1] != base.number):
            raise Conflict(f"the state of {self.path} is version {known[-1]}, not {base.number if base else 'none'}")

    def unreferenced(self) -> list[str]:
        """Folders of runs that never became visible; to be deleted once no run is under way."""
        folder = self._at("tables")
        if not self._files.exists(folder):
            return []
        named = {self.version(n).folder for n in self.versions()}
        return sorted(name for f in self._files.listStatus(folder) if (name := f"tables/{f.getPath().getName()}") not in named)
