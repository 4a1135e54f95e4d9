"""A stored table with one row for each key, whose merges rewrite only what they touch.

Rows lie in buckets by a hash of their key. A version is a manifest, a small file that names the data files of each
bucket. A merge reads the keys in the buckets of its own, writes those buckets anew that have one of them, adds files to
the others, under a folder of its own, and publishes the next
manifest by a rename that fails if another writer was first; until then readers see the version before. Nothing is
changed in place: older versions can be read until ``vacuum``, and a merge that fails leaves nothing but files that no
manifest names.

The driver holds a manifest (a name for each file) and the numbers of the touched buckets. Choose the number of buckets
so that one is about what a task should write. Defined results: null keys are one key; of several changes of a key the
one with the greatest ``order`` counts, without that the greatest row; a key that is changed and deleted is deleted;
merges without rows publish nothing; extra columns of changes are not stored, missing ones are null.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from carefold.storage import hadoop_path, materialize


#: A bucket of more files is written anew by the next merge that touches it.
MAX_FILES = 16


class Conflict(RuntimeError):
    """Another writer published the next version first."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = hadoop_path(spark, self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64) -> KeyedTable:
        table = cls(spark, path)
        fields = spark.createDataFrame([], schema).schema
        table._publish({"version": 0, "key": key, "buckets": buckets, "schema": fields.jsonValue(), "files": {}})
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64) -> KeyedTable:
        """The table at ``path``, made if there is none."""
        table = cls(spark, path)
        return table if table.versions() else cls.create(spark, path, schema, key, buckets)

    # Versions.

    def versions(self) -> list[int]:
        folder = hadoop_path(self.spark, f"{self.path}/manifest")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        version = self.versions()[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{version:012d}.json", wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> None:
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        name = f"{self.path}/manifest/{manifest['version']:012d}.json"
        attempt = hadoop_path(self.spark, f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = self._files.create(attempt)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(attempt.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(attempt, hadoop_path(self.spark, name), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception as e:
            self._files.delete(attempt, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest['version']} is there already") from e
            raise

    # Rows.

    def read(self, version: int | None = None) -> DataFrame:
        manifest = self.manifest(version)
        return self._rows(manifest, [f for files in manifest["files"].values() for f in files])

    def _rows(self, manifest: dict, files: list[str]) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in files))

    def lookup(self, asked: DataFrame) -> DataFrame:
        """``asked`` (with the key) and the columns of its row, null where there is none."""
        manifest = self.manifest()
        return asked.join(self.read(manifest["version"]), manifest["key"], "left")

    def merge(self, changes: DataFrame, deleted: DataFrame | None = None, order: Column | None = None, batch: tuple[str, int] | None = None) -> int:
        """Put the rows of ``changes`` in place of those with their keys, or beside them, and take out the keys of
        ``deleted``; returns the version that has them.

        ``batch`` names a stream and counts its batches: one that was merged already, or an earlier one, changes nothing.
        """
        manifest = self.manifest()
        if batch is not None and manifest.get("batches", {}).get(batch[0], -1) >= batch[1]:
            return manifest["version"]
        key, buckets, schema = manifest["key"], manifest["buckets"], StructType.fromJson(manifest["schema"])
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_bucket")
        cells = [(F.col(f"`{f.name}`") if f.name in changes.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        r = F.struct(*cells)
        if order is None:
            rows = changes.select(r.alias("r")).groupBy(F.col(f"r.`{key}`").alias(key)).agg(F.max("r").alias("r"))
        else:
            rows = changes.select(F.struct(order, r.alias("r")).alias("o")).groupBy(F.col(f"o.r.`{key}`").alias(key)).agg(F.max("o").alias("o")).select(key, "o.r")
        if deleted is not None:
            gone = deleted.select(F.col(key).cast(schema[key].dataType).alias(key)).distinct().select(key, F.lit(None).cast(schema).alias("r"))
            rows = rows.unionByName(gone).groupBy(key).agg(F.when(F.count("*") == F.count("r"), F.max("r")).alias("r"))
        due = materialize(rows.select(key, bucket, "r"), "merge")
        touched = sorted(r[0] for r in due.select("_bucket").distinct().collect())  # at most the number of buckets
        if not touched:
            return manifest["version"]
        named = {b: manifest["files"].get(str(b), []) for b in touched}
        changed = due.select(F.col(key).alias("_key"))
        anew = {b for b in touched if len(named[b]) > MAX_FILES} | self._met(manifest, [f for names in named.values() for f in names], changed, bucket)
        old = self._rows(manifest, [f for b in sorted(anew) for f in named[b]])
        stay = old.join(changed, old[key].eqNullSafe(changed["_key"]), "left_anti").select(*(F.col(f"`{f.name}`") for f in schema))
        new = due.filter("r IS NOT NULL").select("r.*")
        new = stay.unionByName(new) if anew else new
        folder = f"data/{uuid.uuid4().hex}"
        dealt = new.withColumn("_bucket", bucket).repartitionById(len(touched), F.pmod("_bucket", F.lit(len(touched))))
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        written = self._listed(folder)
        files = {b: names for b, names in manifest["files"].items() if int(b) not in anew}
        files |= {b: files.get(b, []) + names for b, names in written.items()}
        batches = manifest.get("batches", {}) | ({} if batch is None else {batch[0]: batch[1]})
        self._publish(manifest | {"version": manifest["version"] + 1, "files": files, "batches": batches})
        return manifest["version"] + 1

    def _met(self, manifest: dict, files: list[str], changed: DataFrame, bucket: Column) -> set[int]:
        """The buckets in which a row has one of the changed keys; only keys are read."""
        if not files:
            return set()
        old = self._rows(manifest, files).select(manifest["key"])
        met = old.join(changed, old[manifest["key"]].eqNullSafe(changed["_key"]), "left_semi")
        return {r[0] for r in met.select(bucket).distinct().collect()}

    def _listed(self, folder: str) -> dict[str, list[str]]:
        """The data files under a folder, by bucket."""
        found: dict[str, list[str]] = {}
        for bucket in self._files.listStatus(hadoop_path(self.spark, f"{self.path}/{folder}")):
            name = bucket.getPath().getName()
            if name.startswith("_bucket="):
                own = [s.getPath().getName() for s in self._files.listStatus(bucket.getPath())]
                found[name.removeprefix("_bucket=")] = sorted(f"{folder}/{name}/{f}" for f in own if not f.startswith((".", "_")))
        return found

    def vacuum(self, keep: int = 1) -> int:
        """Delete all versions but the last ``keep``, and the data files that these don't name; returns how many files.

        No merge may be under way: its files are not named yet.
        """
        versions = self.versions()
        named = {f for v in versions[-keep:] for files in self.manifest(v)["files"].values() for f in files}
        gone = 0
        folder = hadoop_path(self.spark, f"{self.path}/data")
        for batch in self._files.listStatus(folder) if self._files.exists(folder) else ():
            own = [f for files in self._listed(f"data/{batch.getPath().getName()}").values() for f in files]
            for f in own:
                if f not in named:
                    gone += self._files.delete(hadoop_path(self.spark, f"{self.path}/{f}"), False)
            if not named.intersection(own):
                self._files.delete(batch.getPath(), True)
        for v in versions[:-keep]:
            self._files.delete(hadoop_path(self.spark, f"{self.path}/manifest/{v:012d}.json"), False)
        return gone
