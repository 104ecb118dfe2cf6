"""The table of judgement records on disk: buckets by job, and versions that a manifest names.

An upsert rewrites only the buckets that its jobs fall into, beside the old files, and a version is there once its manifest has its name, by
one rename; readers of an older version are not disturbed.  Rows that break a rule are written apart with the rules they break.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcline.operators import records


class Outrun(RuntimeError):
    """Another writer has published this version first; read again and repeat the upsert."""


@dataclass(frozen=True)
class Written:
    version: int
    touched: tuple[int, ...]
    rejected: int


@dataclass(frozen=True)
class RecordTable:
    """``buckets`` is fixed when the table is first written; take so many that a bucket fits a task."""

    spark: SparkSession
    root: str
    buckets: int = 64
    schema: T.StructType = records.SCHEMA

    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *parts]))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, path = self._path("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{version, buckets, files: {bucket: path}, batches: {writer: last batch}, rejected: path or null}; version 0 is the empty table."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {"version": 0, "buckets": self.buckets, "files": {}, "batches": {}, "rejected": None}
        if version not in known:
            raise ValueError(f"no version {version} of this table")
        fs, path = self._path("manifests", f"{version:010d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        fs, draft = self._path("manifests", f".{uuid.uuid4().hex}")
        _, final = self._path("manifests", f"{manifest['version']:010d}.json")
        out = fs.create(draft)
        out.write(json.dumps(manifest, sort_keys=True).encode())
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Outrun(f"version {manifest['version']} is there already")

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        files = [path for b, path in manifest["files"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version))

    def find(self, job_id: str, version: int | None = None) -> DataFrame:
        """The record of a job: one bucket is read, of it the row groups that may hold the job."""
        manifest = self.manifest(version)
        bucket = self.spark.range(1).select(_bucket(F.lit(job_id), manifest["buckets"])).first()[0]
        return self._read(manifest, [bucket]).where(F.col("job_id") == job_id)

    def rejected(self, version: int) -> DataFrame | None:
        """What the batch of that version held that broke a rule, with ``violated``; None if nothing."""
        path = self.manifest(version)["rejected"]
        return self.spark.read.parquet(path) if path else None

    def upsert(self, incoming: DataFrame, batch: tuple[str, int] | None = None) -> Written:
        """The next version: new jobs are added, known ones get every column but their id and creation time (see ``records.upsert``).

        Columns that the schema has and ``incoming`` lacks are null.  A ``batch`` (writer, number) that a version already holds changes nothing.
        Rows that break a rule of ``records.offences`` are set apart.
        """
        manifest = self.manifest()
        if batch and manifest["batches"].get(batch[0], -1) >= batch[1]:
            return Written(manifest["version"], (), 0)
        place = "/".join([self.root.rstrip("/"), "data", uuid.uuid4().hex])
        given = incoming.select(*[(F.col(f.name).cast(f.dataType) if f.name in incoming.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in self.schema])
        given.write.parquet(f"{place}/incoming")  # ids that are made up as rows are read must not be made up twice
        checked = records.offences(self.spark.read.schema(self.schema).parquet(f"{place}/incoming"), self._read(manifest))
        checked.write.parquet(f"{place}/checked")
        checked = self.spark.read.parquet(f"{place}/checked")
        wrong, good = checked.where(F.size("violated") > 0), checked.where(F.size("violated") == 0).drop("violated")
        n_wrong = wrong.count()
        if n_wrong:
            wrong.write.parquet(f"{place}/rejected")
        bucket = _bucket(F.col("job_id"), manifest["buckets"])
        touched = sorted(r[0] for r in good.select(bucket).distinct().collect())  # at most as many as there are buckets
        if touched:
            merged = records.upsert(self._read(manifest, touched), good).withColumn("bucket", bucket)
            merged.repartition(len(touched), "bucket").sortWithinPartitions("bucket", "job_id").write.partitionBy("bucket").parquet(f"{place}/rows")
        for part in ("incoming", "checked"):
            fs, path = self._path("data", place.rpartition("/")[2], part)
            fs.delete(path, True)
        version = manifest["version"] + 1
        self._publish({
            "version": version, "buckets": manifest["buckets"], "files": {**manifest["files"], **{str(b): f"{place}/rows/bucket={b}" for b in touched}},
            "batches": {**manifest["batches"], **({batch[0]: batch[1]} if batch else {})}, "rejected": f"{place}/rejected" if n_wrong else None})
        return Written(version, tuple(touched), n_wrong)

    def vacuum(self, keep: int = 1) -> int:
        """Forget all but the last ``keep`` versions and delete the files that none of these reads; returns how many folders went."""
        kept = self.versions()[-keep:]
        manifests = [self.manifest(v) for v in kept]
        used = {path.rsplit("/data/", 1)[1].split("/")[0] for m in manifests for path in [*m["files"].values(), *([m["rejected"]] if m["rejected"] else [])]}
        for v in self.versions():
            if v not in kept:
                fs, path = self._path("manifests", f"{v:010d}.json")
                fs.delete(path, False)
        fs, data = self._path("data")
        gone = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in used]
        for path in gone:
            fs.delete(path, True)
        return len(gone)


def _bucket(job_id, buckets: int):
    return F.pmod(F.xxhash64(job_id), F.lit(buckets)).cast("int")
