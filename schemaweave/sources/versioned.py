"""Tables of Parquet folders whose versions are lists of folders, for projects and other results that are kept.

A row lies in the bucket of its key's hash; a commit writes a folder per bucket it touches, and then one small
manifest that names the folders added and removed. The manifest is renamed into its place last and never over
another one: readers see all of a commit or nothing, a writer that dies leaves folders that nobody reads, and of
two writers one gets the next number and the other one's rename fails, so it tries again on what is there now.
Nothing but manifests and bucket numbers passes through the driver.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BUCKET = "bucket"


class Conflict(Exception):
    """Another writer has taken the version's number."""


@dataclass(frozen=True)
class VersionedTable:
    """A table under `root` with the columns of `schema`, dealt out by `key`."""

    spark: SparkSession
    root: str
    schema: str
    key: str
    buckets: int = 16

    def _files(self):
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests")
        return path, path.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.getFileSystem(conf).getUri(), conf)

    def _manifests(self) -> list[dict]:
        """All manifests in order of their versions."""
        path, files, _ = self._files()
        if not files.exists(path):
            return []
        names = sorted(s.getPath().getName() for s in files.listStatus(path) if s.getPath().getName().endswith(".json"))
        if not names:
            return []
        rows = self.spark.read.text([f"{path}/{n}" for n in names], wholetext=True).collect()  # one small row a commit
        return sorted((json.loads(r["value"]) for r in rows), key=lambda m: m["version"])

    def version(self) -> int:
        return max((m["version"] for m in self._manifests()), default=0)

    def _folders(self, version: int | None = None) -> dict[str, int]:
        """Folders of a version, the last one without a number, with their buckets."""
        out: dict[str, int] = {}
        for m in self._manifests():
            if version is None or m["version"] <= version:
                out = {f: b for f, b in out.items() if f not in set(m["removed"])} | m["added"]
        return out

    def _read(self, folders: dict[str, int]) -> DataFrame:
        kinds = StructType.fromDDL(self.schema)
        if not folders:
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).parquet(*[f"{self.root}/{f}" for f in sorted(folders)])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, of an earlier version too."""
        return self._read(self._folders(version))

    def of(self, key: str) -> DataFrame:
        """The rows of one key, from its bucket alone."""
        number = self.spark.range(1).select(self._bucket(F.lit(key))).first()[0]
        return self._read({f: b for f, b in self._folders().items() if b == number}).where(F.col(self.key) == key)

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> dict[str, int]:
        """Folders, with their buckets, that hold these rows; nothing reads them yet."""
        commit = f"data/{uuid.uuid4().hex}"
        names = StructType.fromDDL(self.schema).names
        dealt = rows.select(*names, self._bucket(F.col(self.key)).alias(_BUCKET))
        dealt.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.root}/{commit}")
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{commit}")
        found = [s.getPath().getName() for s in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)]
        return {f"{commit}/{n}": int(n.partition("=")[2]) for n in found if n.startswith(f"{_BUCKET}=")}

    def _commit(self, version: int, added: dict[str, int], removed: list[str]) -> int:
        path, files, context = self._files()
        jvm = self.spark._jvm
        files.mkdirs(path)
        draft = jvm.org.apache.hadoop.fs.Path(path, f".{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps({"version": version, "added": added, "removed": removed}).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, jvm.org.apache.hadoop.fs.Path(path, f"{version:020}.json"), none)
        except Exception as e:
            files.delete(draft, False)
            if "FileAlreadyExists" in str(e) or isinstance(e, PySparkException) and "exist" in str(e):
                raise Conflict(version) from e
            raise
        return version

    def append(self, rows: DataFrame) -> int:
        """Adds rows; the new version."""
        added = self._write(rows)
        while True:
            try:
                return self._commit(self.version() + 1, added, [])
            except Conflict:
                continue

    def replace(self, keys: DataFrame, rows: DataFrame | None = None) -> int:
        """Rows of the keys in `keys` (with a column like the key) give way to `rows`; only the buckets of these keys are written again."""
        touched = {r[0] for r in keys.select(self._bucket(F.col(self.key)).alias("b")).distinct().collect()}  # at most `buckets` numbers
        while True:
            version = self.version()
            old = {f: b for f, b in self._folders(version).items() if b in touched}
            kept = self._read(old).join(keys.select(self.key).distinct(), self.key, "left_anti")
            names = StructType.fromDDL(self.schema).names
            added = self._write(kept.select(*names) if rows is None else kept.select(*names).unionByName(rows.select(*names)))
            try:
                return self._commit(version + 1, added, list(old))
            except Conflict:
                continue
