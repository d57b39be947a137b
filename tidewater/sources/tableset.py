"""Several tables that change together: staged writes, then one manifest that readers follow.

A commit writes its rows into folders of its own and then publishes the next manifest, a
small JSON file that names the folders of every table.  Publishing is a rename that fails
where the name is taken, so of two writers one wins and the other is told.  A run that dies
before it leaves folders no manifest names; readers never see them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another commit came first: read the new state and decide again."""


@dataclass(frozen=True)
class TableState:
    """What one manifest says of a table."""

    schema: str
    folders: tuple[str, ...]


class TableSet:
    """Tables under one folder of a file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm, sc = spark.sparkContext._jvm, spark.sparkContext
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        self._fs = self._path("x").getFileSystem(sc._jsc.hadoopConfiguration())
        self._jvm = jvm

    def version(self) -> int:
        """The newest manifest's number; 0 before the first commit."""
        where = self._path("manifests")
        if not self._fs.exists(where):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def state(self, version: int | None = None) -> dict[str, TableState]:
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self._fs.open(self._path("manifests", f"{version:08d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {name: TableState(t["schema"], tuple(t["folders"])) for name, t in json.loads(text).items()}

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table as a manifest has it; later commits don't change the result."""
        t = self.state(version)[table]
        schema = StructType.fromJson(json.loads(t.schema))
        if not t.folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in t.folders])

    def commit(self, replaced: Mapping[str, DataFrame] | None = None, appended: Mapping[str, DataFrame] | None = None, base: int | None = None) -> int:
        """All tables change or none does; returns the new version.

        ``base`` is the version that the rows were made from (by default the newest); if
        another commit has come since, nothing changes and Conflict is raised.
        """
        base = self.version() if base is None else base
        replaced, appended = dict(replaced or {}), dict(appended or {})
        if both := replaced.keys() & appended.keys():
            raise ValueError(f"replaced and appended: {sorted(both)}")
        new, made = self.state(base), []
        for name, rows in [*replaced.items(), *appended.items()]:
            folder = f"data/{name}/{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/{folder}")
            made.append(folder)
            old = new.get(name)
            if old is not None and name in appended:
                if StructType.fromJson(json.loads(old.schema)).simpleString() != rows.schema.simpleString():
                    raise ValueError(f"{name}: the appended rows have other columns")
                new[name] = TableState(old.schema, (*old.folders, folder))
            else:
                new[name] = TableState(rows.schema.json(), (folder,))
        self._publish(base + 1, {n: {"schema": t.schema, "folders": list(t.folders)} for n, t in new.items()})
        return base + 1

    def _publish(self, version: int, tables: dict) -> None:
        draft = self._path("drafts", uuid.uuid4().hex)
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(tables).encode("utf-8")))
        out.close()
        self._fs.mkdirs(self._path("manifests"))
        final = self._path("manifests", f"{version:08d}.json")
        # A rename never replaces a file here: checked first where the file system itself would.
        if self._fs.exists(final) or self.version() >= version or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {version} is there already")

    def unreferenced(self) -> list[str]:
        """Folders that no manifest names: what runs that died, or lost a conflict, left behind."""
        named = {f for v in range(1, self.version() + 1) for t in self.state(v).values() for f in t.folders}
        data, found = self._path("data"), []
        if not self._fs.exists(data):
            return found
        for table in self._fs.listStatus(data):
            for folder in self._fs.listStatus(table.getPath()):
                name = f"data/{table.getPath().getName()}/{folder.getPath().getName()}"
                if name not in named:
                    found.append(name)
        return sorted(found)

    def vacuum(self) -> int:
        """Delete the unreferenced folders; only while no commit runs."""
        gone = self.unreferenced()
        for folder in gone:
            self._fs.delete(self._path(folder), True)
        return len(gone)


def fresh_root(spark: SparkSession, what: str = "tables") -> str:
    """A new folder where all executors can read and write."""
    from tidewater.operators.graph import shared_dir

    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
