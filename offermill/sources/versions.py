"""Tables with versions: what was read stays readable while the table is written, and writers never see half of a write.

A version is a manifest that names a folder of Parquet files for each bucket of keys. A write stores the buckets that it
touches in a new folder, and then its manifest appears under the next number by one rename, which fails if another writer
was first. So a table can be updated from itself, readers keep the version that they began with, and a merge rewrites
only buckets that hold changed keys. A manifest also keeps which batch of which stream it holds, so that a batch that is
replayed after a failure is written once, and the metrics that were observed while the batch was written.

Keys are unique: of changes with one key the last by an order is taken. Rows whose key is null are left out.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import first_of


class Conflict(RuntimeError):
    """Another writer made the version that this one was about to make."""


class VersionedTable:
    """A table of rows with a schema and a key at a path of any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    # Manifests

    def _files(self):
        jvm = self.spark._jvm.org.apache.hadoop.fs
        folder = jvm.Path(f"{self.path}/versions")
        return jvm, folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        _, folder, fs = self._files()
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """That of a version, or of the latest; an empty one before the first."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {"version": 0, "folders": {}, "batches": {}, "what": None, "metrics": {}}
        if version not in known:
            raise ValueError(f"there is no version {version}")
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/versions/{version}.json").first()[0]
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        jvm, folder, fs = self._files()
        fs.mkdirs(folder)
        draft, final = jvm.Path(folder, f"_{uuid.uuid4().hex}"), jvm.Path(folder, f"{manifest['version']}.json")
        out = fs.create(draft, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        # a rename that does not overwrite: of two writers of one version, one fails
        options = self.spark._sc._gateway.new_array(getattr(jvm, "Options$Rename"), 0)
        try:
            jvm.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest['version']} of {self.path} exists") from e
            raise

    # Reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, which stay what they are whatever is written."""
        return self._buckets(self.manifest(version))

    def _buckets(self, manifest: dict, only: set[str] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{f}/_bucket={b}" for b, f in manifest["folders"].items() if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def history(self) -> list[dict]:
        return [self.manifest(v) for v in self.versions()]

    # Writing

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, what: str, changes: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None, metrics: dict[str, Column] | None) -> int:
        before = self.manifest()
        if batch and before["batches"].get(batch[0], -1) >= batch[1]:
            return before["version"]
        folder, seen = uuid.uuid4().hex, Observation(f"o{uuid.uuid4().hex}")
        changes = changes.filter(F.col(self.key).isNotNull())
        if metrics:
            changes = changes.observe(seen, *(c.alias(n) for n, c in metrics.items()))
        # changes are stored first: they are read twice, may come from this table, and are measured once
        draft = f"{self.path}/data/_{folder}"
        changes.withColumn("_bucket", self._bucket()).write.parquet(draft)
        measured = {k: v for k, v in seen.get.items()} if metrics else {}  # noqa: C416
        changes = self.spark.read.parquet(draft)
        touched = {str(r[0]) for r in changes.select("_bucket").distinct().collect()}
        new = merged(self._buckets(before, touched), changes.drop("_bucket")).select(*self.schema.names).withColumn("_bucket", self._bucket())
        new.repartition(max(1, min(self.buckets, len(touched))), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        _, _, fs = self._files()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs.delete(path(draft), True)
        kept = {b: f for b, f in before["folders"].items() if b not in touched}
        for s in fs.listStatus(path(f"{self.path}/data/{folder}")):
            if (name := s.getPath().getName()).startswith("_bucket="):
                kept[name.removeprefix("_bucket=")] = folder
        batches = before["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._commit({"version": before["version"] + 1, "folders": kept, "batches": batches, "what": what, "metrics": measured})
        return before["version"] + 1

    def upsert(self, changes: DataFrame, *last: Column, batch: tuple[str, int] | None = None, metrics: dict[str, Column] | None = None) -> int:
        """Rows of changes in place of those with their keys; the version made. last: of several changes of a key, the first in this order."""

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            one = first_of(new, [self.key], *(last or (F.lit(0).asc(),)))
            return old.join(one.select(self.key), self.key, "left_anti").select(*self.schema.names).unionByName(one.select(*self.schema.names))

        return self._write("upsert", changes, merged, batch, metrics)

    def insert_absent(self, changes: DataFrame, *last: Column) -> int:
        """Rows of changes whose keys the table lacks."""

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            one = first_of(new, [self.key], *(last or (F.lit(0).asc(),)))
            return old.unionByName(one.join(old.select(self.key), self.key, "left_anti").select(*self.schema.names))

        return self._write("insert", changes, merged, None, None)

    def delete(self, keys: DataFrame) -> int:
        return self._write("delete", keys.select(self.key), lambda old, gone: old.join(gone, self.key, "left_anti"), None, None)

    def combine(self, changes: DataFrame, fold: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None, metrics: dict[str, Column] | None = None) -> int:
        """fold makes one row a key of the rows that the table has and those of changes, such as sums or latest values."""
        return self._write("combine", changes, lambda old, new: fold(old.unionByName(new.select(*self.schema.names))), batch, metrics)


def sink(table: VersionedTable, app: str, fold: Callable[[DataFrame], DataFrame], metrics: dict[str, Column] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch is combined into the table once, however often it is replayed, with its metrics."""

    def write(rows: DataFrame, batch: int) -> None:
        table.combine(rows, fold, (app, batch), metrics)

    return write
