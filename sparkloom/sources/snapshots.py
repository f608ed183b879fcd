"""Tables that change together: every commit is a new manifest, which appears at once.

A commit writes its tables to new folders and then creates the next manifest, which
fails if another writer has created it meanwhile; so a reader sees all tables of a
commit or none, and of two writers one has to begin anew. What a commit does not
name stays as it is. The manifest keeps the version of the schema: a store of an older one
gets its missing columns as nulls, one of a newer version is refused.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = 1


class NewerStore(ValueError):
    """The store was written by a later version of this library."""


class Conflict(RuntimeError):
    """Another writer has committed since the store was opened."""


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str, version: int = VERSION) -> None:
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version
        self.at = self._latest()
        self.state = self._manifest(self.at) if self.at else {"version": version, "tables": {}, "meta": {}}
        if self.state["version"] > version:
            raise NewerStore(f"{folder} has version {self.state['version']}, this library writes {version}")

    # files, by the file system of the folder
    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _latest(self) -> int:
        fs, at = self._fs(), self._path("manifests")
        if not fs.exists(at):
            return 0
        return max((int(m[1]) for f in fs.listStatus(at) if (m := re.fullmatch(r"(\d+)\.json", f.getPath().getName()))), default=0)

    def _manifest(self, number: int) -> dict:
        # wholetext, as a manifest is one JSON document
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{number}.json", wholetext=True).first()[0])

    # reading
    @property
    def meta(self) -> dict:
        return dict(self.state["meta"])

    def has(self, name: str) -> bool:
        return name in self.state["tables"]

    def read(self, name: str, schema: StructType | str | None = None) -> DataFrame:
        """A table as of the commit that was opened; with ``schema`` its columns in that order, missing ones null."""
        found = self.spark.read.parquet(f"{self.folder}/{self.state['tables'][name]}") if self.has(name) else None
        if schema is None:
            return found
        empty = self.spark.createDataFrame([], schema)
        whole = empty if found is None else empty.unionByName(found, allowMissingColumns=True)
        return whole.select(*empty.columns)

    # writing
    def commit(self, tables: dict[str, DataFrame], meta: dict | None = None) -> int:
        """Write ``tables`` and add ``meta``, all or nothing; the number of the commit."""
        run = uuid.uuid4().hex
        new = dict(self.state["tables"])
        for name, df in tables.items():
            new[name] = f"data/{run}/{name}"
            df.write.parquet(f"{self.folder}/{new[name]}")
        state = {"version": self.version, "tables": new, "meta": {**self.state["meta"], **(meta or {})}}
        fs, at = self._fs(), self._path("manifests", f"{self.at + 1}.json")
        draft = self._path("manifests", f".{run}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(at) or not fs.rename(draft, at):
            fs.delete(draft, False)
            fs.delete(self._path("data", run), True)
            raise Conflict(f"commit {self.at + 1} of {self.folder} exists already")
        self.at, self.state = self.at + 1, state
        return self.at

    def rewrite(self, names: list[str] | None = None, file_rows: int = 1_000_000) -> int:
        """The tables anew in files of about ``file_rows`` rows."""
        names = names or sorted(self.state["tables"])
        count = {n: self.read(n).count() for n in names}
        return self.commit({n: self.read(n).repartition(-(-count[n] // file_rows) or 1) for n in names})

    def vacuum(self, keep: int = 2) -> int:
        """Delete what only commits before the last ``keep`` use; the number of folders that went."""
        fs = self._fs()
        numbers = range(max(1, self.at - keep + 1), self.at + 1)
        used = {t.split("/")[1] for n in numbers for t in self._manifest(n)["tables"].values()}
        gone = 0
        for f in fs.listStatus(self._path("data")) if fs.exists(self._path("data")) else []:
            if f.getPath().getName() not in used:
                gone += bool(fs.delete(f.getPath(), True))
        for f in fs.listStatus(self._path("manifests")) if fs.exists(self._path("manifests")) else []:
            m = re.fullmatch(r"(\d+)\.json", f.getPath().getName())
            if m and int(m[1]) < numbers.start:
                fs.delete(f.getPath(), False)
        return gone


def reconciled(df: DataFrame, schema: StructType) -> DataFrame:
    """S3: ``df`` with the columns of ``schema``, cast, missing ones null; other columns go."""
    own = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(own[f.name.lower()]) if f.name.lower() in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
