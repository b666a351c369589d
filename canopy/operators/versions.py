"""Tables in versions: files by key bucket, copied on write, and a manifest per version (M1, M3, M4, M8).

A row belongs to the bucket of its key's hash.  A change batch reads and rewrites the
buckets that its keys fall into and no others; the new manifest names, for every bucket, the
batch whose files hold it.  Files are never changed, so a reader keeps the version it
opened, older versions stay readable, and a batch that dies halfway leaves the table as it
was: its files are in no manifest.

Whole rows move through at most one shuffle a change.  Deletes and column changes need none:
a stored file holds rows of one bucket, so its rows are rewritten where they are read, and the changes are
broadcast, as many buckets at a time as the budget holds.  Only changes of a bucket beyond the
budget are joined by a shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.operators import state
from canopy.operators import vectors as Vx

MANIFEST = "bucket int, batch string"


class VersionedTable:
    """A table under ``root`` with unique ``keys``, in ``buckets`` key buckets."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str]):
        self.spark, self.root, self.keys = spark, root, list(keys)

    @classmethod
    def create(cls, root: str, rows: DataFrame, keys: Sequence[str], buckets: int = 64) -> "VersionedTable":
        """Write ``rows`` as version 1; about a task's worth of rows per bucket suits large tables."""
        table = cls(rows.sparkSession, root, keys)
        rows.limit(0).write.parquet(f"{root}/schema")
        batch = table._write(rows, buckets)
        table._publish(1, [(b, batch) for b in range(buckets)])
        return table

    # --- reading -------------------------------------------------------------------

    def versions(self) -> list[int]:
        rows = self.spark.read.schema(f"{MANIFEST}, version int").parquet(f"{self.root}/manifest")
        return sorted(r.version for r in rows.select("version").distinct().collect())

    def manifest(self, version: int | None = None) -> dict[int, str | None]:
        """The batch of every bucket, None for an empty one."""
        version = version or self.versions()[-1]
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/version={version}").collect()
        return {r.bucket: r.batch for r in rows}

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of a version (the newest by default), ``only`` those of some buckets."""
        held = self.manifest(version)
        schema = self.spark.read.parquet(f"{self.root}/schema").schema
        paths = [f"{self.root}/data/{batch}/bucket={b}" for b, batch in sorted(held.items())
                 if batch and (only is None or b in only)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    # --- changing ------------------------------------------------------------------

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, buckets: int) -> str:
        batch = uuid.uuid4().hex[:12]
        self._put(rows.withColumn("bucket", self._bucket(buckets)).repartition("bucket"), batch)
        return batch

    def _put(self, rows: DataFrame, batch: str) -> None:
        rows.write.mode("append").partitionBy("bucket").parquet(f"{self.root}/data/{batch}")

    def _publish(self, version: int, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.root}/manifest/version={version}")

    def change(self, batch: DataFrame, work: Callable[[DataFrame, DataFrame], DataFrame], in_place: bool = False,
               placed: bool = False) -> set[int]:
        """Publish ``work(old rows, batch)`` for the buckets of the batch's keys; the buckets that were rewritten.

        ``in_place``: work joins the batch to the old rows and adds none, so the batch may be broadcast.
        ``placed``: work gets both sides with their ``bucket`` and gives rows partitioned by it.
        """
        version = self.versions()[-1]
        held = self.manifest(version)
        bucket = self._bucket(len(held))
        sizes = {r.bucket: r.bytes for r in batch.groupBy(bucket.alias("bucket")).agg(  # at most all buckets
            F.sum(row_bytes(batch) if in_place else F.lit(0)).alias("bytes")).collect()}
        touched = set(sizes)
        if not touched:
            return touched
        new = uuid.uuid4().hex[:12]
        for some, small in rounds(sizes, Vx.BROADCAST_BUDGET_BYTES) if in_place else [(touched, False)]:
            old = self.read(version, some)
            part = batch if some == touched else batch.where(bucket.isin(*some))
            if placed:
                out = work(old.withColumn("bucket", bucket), part.withColumn("bucket", bucket))
            else:
                out = work(old, F.broadcast(part) if small else part).select(old.columns).withColumn("bucket", bucket)
                out = out if small else out.repartition("bucket")
            self._put(out, new)
        written = self.spark.read.schema(f"{self.keys[0]} string, bucket int").parquet(f"{self.root}/data/{new}")
        left = {r[0] for r in written.select("bucket").distinct().collect()}  # buckets that still have rows
        self._publish(version + 1, [(b, held[b] if b not in touched else new if b in left else None) for b in held])
        return touched

    def upsert(self, rows: DataFrame, seq: str | None = None) -> set[int]:
        """M1: whole rows replaced by key; in the batch the row with the highest ``seq`` wins."""
        return self.change(rows, lambda old, new: state.upsert(old, new, self.keys, seq, "bucket"), placed=True)

    def merge_columns(self, changes: DataFrame, cols: Sequence[str], insert_missing: bool = False) -> set[int]:
        """M3, M4: some columns replaced by key, the others kept."""
        return self.change(changes.select(*self.keys, *cols),
                           lambda old, new: state.merge_columns(old, new, self.keys, cols, insert_missing),
                           in_place=not insert_missing)

    def delete(self, keys: DataFrame) -> set[int]:
        """M8: rows of the given keys dropped."""
        return self.change(keys.select(*self.keys).distinct(),
                           lambda old, new: old.join(new, self.keys, "left_anti"), in_place=True)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row in a broadcast table."""
    size = F.lit(64)
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        wide = F.octet_length(f.name) if kind in ("string", "binary") else F.lit(8) * F.size(f.name) if kind == "array" else F.lit(8)
        size = size + F.lit(8) + F.greatest(F.coalesce(wide, F.lit(0)), F.lit(0))
    return size.cast("bigint")


def rounds(sizes: dict[int, int], budget: int) -> list[tuple[set[int], bool]]:
    """Buckets in sets whose sizes fit the budget together (True); those that alone are too large, in one set (False)."""
    large = {b for b, n in sizes.items() if n > budget}
    out, room = [], -1
    for b in sorted(set(sizes) - large):
        if sizes[b] > room:
            out.append((set(), True))
            room = budget
        out[-1][0].add(b)
        room -= sizes[b]
    return out + [(large, False)] * bool(large)
