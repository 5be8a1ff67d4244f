"""Versioned vector tables: Parquet folders, and for each version a small file that lists the folders it reads.

An append writes a folder and then its version's list. A list is created only if no other writer has created that version
meanwhile, so of two writers one fails and nothing is lost; a version counts once its list is whole, and readers never
see a folder that no list names. Compaction writes one folder and a version that lists it alone; older versions stay readable until
`vacuum` deletes what the newest doesn't name.
"""

from __future__ import annotations

import json
import uuid

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from vexel.operators.ordered import running


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("versions") if n.removesuffix(".json").isdigit())

    def _listed(self, version: int) -> dict:
        source = self.fs.open(self._at(f"versions/{version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def _commit(self, version: int, listed: dict) -> None:
        """Writes the list under a name of its own and gives it the version's name, which fails if there is one."""
        draft = self._at(f"versions/draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(listed).encode()))
        out.close()
        at = self._at(f"versions/{version}.json")
        # file contexts rename without overwriting, in one step
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, at, none)
        except Exception as e:
            self.fs.delete(draft, False)
            raise ValueError(f"version {version} of {self.path} was written meanwhile") from e

    def create(self, schema: StructType) -> int:
        """An empty table with these columns, as version 0."""
        return self._next([], schema.json())

    def _next(self, folders: list[str], schema: str, rows: int = 0) -> int:
        have = self.versions()
        version = have[-1] + 1 if have else 0
        self._commit(version, {"folders": folders, "schema": schema, "rows": rows})
        return version

    def open(self, version: int | None = None) -> DataFrame:
        have = self.versions()
        if not have or version is not None and version not in have:
            raise ValueError(f"{self.path} has versions {have}, not {version}")
        listed = self._listed(have[-1] if version is None else version)
        schema = StructType.fromJson(json.loads(listed["schema"]))
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in listed["folders"]]) if listed["folders"] else self.spark.createDataFrame([], schema)

    def append(self, rows: DataFrame, order: str, id_col: str = "id") -> int:
        """Writes rows with dense new ids in the given order; returns the new version."""
        have = self.versions()
        listed = self._listed(have[-1]) if have else {"folders": [], "rows": 0, "schema": None}
        numbered = running(rows, [], [order]).withColumn(id_col, (F.col("__place") + listed["rows"]).cast("long")).drop("__place", "__before")
        if listed["schema"] is not None:
            want = StructType.fromJson(json.loads(listed["schema"])).fieldNames()
            if sorted(numbered.columns) != sorted(want):
                raise ValueError(f"columns {want} are expected, not {numbered.columns}")
            numbered = numbered.select(*want)
        folder = uuid.uuid4().hex
        numbered.write.parquet(f"{self.path}/data/{folder}")
        n = self.spark.read.parquet(f"{self.path}/data/{folder}").count()
        version = have[-1] + 1 if have else 0
        self._commit(version, {"folders": [*listed["folders"], folder], "rows": listed["rows"] + n, "schema": listed["schema"] or numbered.schema.json()})
        return version

    def compact(self) -> int:
        """Rewrites the newest version as one folder and a new version; returns the number of folders that it replaces."""
        have = self.versions()
        listed = self._listed(have[-1]) if have else {"folders": []}
        if len(listed["folders"]) < 2:
            return 0
        folder = uuid.uuid4().hex
        self.open(have[-1]).write.parquet(f"{self.path}/data/{folder}")
        self._commit(have[-1] + 1, listed | {"folders": [folder]})
        return len(listed["folders"])

    def vacuum(self) -> int:
        """Deletes all versions but the newest and the folders that it doesn't name; no writer may be at work. Returns the folders deleted."""
        have = self.versions()
        if not have:
            return 0
        named = set(self._listed(have[-1])["folders"])
        gone = [f for f in self._names("data") if f not in named]
        for v in have[:-1]:
            self.fs.delete(self._at(f"versions/{v}.json"), False)
        for f in gone:
            self.fs.delete(self._at(f"data/{f}"), True)
        return len(gone)
