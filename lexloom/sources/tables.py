"""Keyed tables whose rows are replaced in one step, so that a run may break off or come again.

A table is a folder of snapshots. Its rows lie in buckets by a hash of the key; a replacement writes
the buckets it touches anew, under a fresh name, and then one manifest that lists all buckets. Renaming
the manifest into its place is the commit: before it nothing has changed, after it everything has.
Readers take the latest manifest, and keep seeing it while others write. Buckets that have outgrown
their size are split when they are written again.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexloom.storage import hadoop_path, setting, stored

#: Rows of a bucket beyond which it is split.
ROWS = 1_000_000
#: Files that a task writes at once; of more buckets it sorts its rows.
WRITERS = 64
_MANIFEST = re.compile(r"v(\d+)\.json")


class ConflictError(RuntimeError):
    """Another writer has committed since the snapshot that this one started from."""


@dataclass(frozen=True)
class Bucket:
    """Rows whose key's hash ends in `bits` binary digits that are `value`."""

    bits: int
    value: int
    path: str
    rows: int


@dataclass(frozen=True)
class Snapshot:
    version: int
    schema: str
    buckets: tuple[Bucket, ...]


class KeyedTable:
    """Rows by `key`, in `folder`, a path that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id", rows: int = ROWS):
        self.spark, self.folder, self.key, self.rows = spark, folder.rstrip("/"), key, rows

    def versions(self) -> list[int]:
        files, path = hadoop_path(self.spark, f"{self.folder}/manifests")
        if not files.exists(path):
            return []
        return sorted(int(m[1]) for s in files.listStatus(path) if (m := _MANIFEST.fullmatch(s.getPath().getName())))

    def snapshot(self, version: int | None = None) -> Snapshot | None:
        """The latest snapshot, or an earlier one; null if nothing was ever committed."""
        known = self.versions()
        if version is None and not known:
            return None
        files, path = hadoop_path(self.spark, f"{self.folder}/manifests/v{known[-1] if version is None else version}.json")
        stream = files.open(path)
        try:
            m = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Snapshot(m["version"], m["schema"], tuple(Bucket(*b) for b in m["buckets"]))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a snapshot; null where there is none."""
        now = self.snapshot(version)
        return None if now is None else self._rows(now, now.buckets)

    def _rows(self, now: Snapshot, buckets) -> DataFrame:
        schema = StructType.fromJson(json.loads(now.schema))
        paths = [f"{self.folder}/data/{b.path}" for b in buckets if b.path]  # an empty bucket has no files
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _placed(self, rows: DataFrame, buckets: list[tuple[int, int]]) -> DataFrame:
        """`rows` with the bits and value of the bucket that each key falls into, which has to be among
        `buckets`. Nothing is shuffled: rows joined to their buckets would meet in one task a bucket."""
        hashed, values = F.xxhash64(self.key), {}
        for bits, value in buckets:
            values.setdefault(bits, []).append(value)
        *others, last = sorted(values, key=lambda bits: len(values[bits]))  # the depth of most buckets needs no list
        place = lambda bits: F.struct(F.lit(bits).alias("bits"), F.pmod(hashed, F.lit(1 << bits)).alias("value"))
        found = place(last)
        for bits in others:
            found = F.when(F.pmod(hashed, F.lit(1 << bits)).isin(values[bits]), place(bits)).otherwise(found)
        return rows.select(found.alias("place"), *rows.columns).select("place.*", *rows.columns)

    def replace(self, rows: DataFrame, keys: DataFrame | None = None) -> int:
        """Replaces what the table has of each key with `rows`; returns the version committed.

        keys: the keys that are replaced, by default those of `rows`; keys without rows lose theirs. A
        null key is a key. `rows` is worked out once. Raises ConflictError if another writer was faster.
        """
        rows = stored(rows, "replacing")
        keys = stored((rows if keys is None else keys).select(self.key).distinct(), "replaced-keys")
        now = self.snapshot()
        before = {(b.bits, b.value): b for b in now.buckets} if now else {(0, 0): None}
        each = keys.withColumn("_new", F.lit(0)).unionByName(rows.select(self.key, F.lit(1).alias("_new")))
        counts = {(r.bits, r.value): r.n for r in self._placed(each, list(before)).groupBy("bits", "value").agg(F.sum("_new").alias("n")).collect()}
        touched = list(counts)
        left = [b for place in touched if (b := before[place])]
        new = rows
        if left:
            gone = keys.select(F.col(self.key).alias("gone"))
            kept = self._rows(now, left)
            new = kept.join(gone, F.col(self.key).eqNullSafe(F.col("gone")), "left_anti").select(*rows.columns).unionByName(rows)
        # as many binary digits more as the rows that a bucket may hold call for
        places = []
        for bits, value in touched:
            most, more = counts[bits, value] + (before[bits, value].rows if before[bits, value] else 0), 0
            while most >> more > self.rows and bits + more < 40:
                more += 1
            places += [(bits + more, value + (k << bits)) for k in range(1 << more)]
        name = uuid.uuid4().hex
        written: list[Bucket] = []
        if touched:
            placed = self._placed(new, places).withColumnsRenamed({"bits": "_bits", "value": "_value"})
            # Spark sizes the files: it splits what is too large for one task and joins what is small
            with setting(self.spark, "spark.sql.maxConcurrentOutputFileWriters", WRITERS):
                placed.hint("rebalance", "_bits", "_value").write.partitionBy("_bits", "_value").parquet(f"{self.folder}/data/{name}")
            found = self.spark.read.schema(StructType([*new.schema.fields]).add("_bits", "integer").add("_value", "long")).parquet(f"{self.folder}/data/{name}").groupBy("_bits", "_value").count().collect()
            filled = {(r["_bits"], r["_value"]): r["count"] for r in found}
            written = [Bucket(b, v, f"{name}/_bits={b}/_value={v}" if (b, v) in filled else "", filled.get((b, v), 0)) for b, v in places]
        rest = [b for place, b in before.items() if place not in set(touched) and b] if now else []
        self._commit(Snapshot(now.version + 1 if now else 0, json.dumps(new.schema.jsonValue()), tuple(sorted(rest + written, key=lambda b: (b.bits, b.value))) or (Bucket(0, 0, "", 0),)))
        return now.version + 1 if now else 0

    def _commit(self, after: Snapshot) -> None:
        files, draft = hadoop_path(self.spark, f"{self.folder}/manifests/draft-{uuid.uuid4().hex}")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps({"version": after.version, "schema": after.schema, "buckets": [[b.bits, b.value, b.path, b.rows] for b in after.buckets]}).encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # it may not exist yet
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests/v{after.version}.json"), options)
        except Exception as e:
            files.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise ConflictError(f"version {after.version} of {self.folder} is there already") from e
            raise

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes all but the last `keep` snapshots, and files of none of these, such as those of
        writers that broke off; none may be at work. Returns the folders removed."""
        if keep < 1:
            raise ValueError("one snapshot has to stay")
        known = self.versions()
        used = {b.path.partition("/")[0] for v in known[-keep:] for b in self.snapshot(v).buckets if b.path}
        files, data = hadoop_path(self.spark, f"{self.folder}/data")
        gone = [s.getPath() for s in files.listStatus(data) if s.getPath().getName() not in used] if files.exists(data) else []
        for v in known[:-keep]:
            files.delete(hadoop_path(self.spark, f"{self.folder}/manifests/v{v}.json")[1], False)
        for p in gone:
            files.delete(p, True)
        return sorted(p.getName() for p in gone)

