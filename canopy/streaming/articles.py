"""Article change stream (N1-N5) with Structured Streaming.

* N1: ``readStream`` of ndjson event files with a declared schema (a file source
  here; a broker source plugs in the same way), request options applied as
  DataFrame predicates;
* N2: resume by per-partition offsets / since-timestamps: options of the log source
  (``sources.article_log``) start the stream there, and the checkpoint owns progress after
  that; on a batch, a small (partition -> bound) table is joined to the events;
* N3: ``foreachBatch`` folds each micro-batch into the page state table: the
  latest event per page (by publish time, then offset) wins across batches;
  deletes are kept as tombstones so late older updates cannot resurrect a page;
* N4: duplicate deliveries dropped with ``dropDuplicatesWithinWatermark``;
* N5: the same fold over a batch read gives the same state (replay).

The state is log-structured: each micro-batch appends its latest-per-page rows
(O(batch) work, idempotent on retry) and periodic compaction folds them into a new
base version; readers fold base + newer deltas with the same latest-wins rule.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("event_identifier", T.LongType()),
    T.StructField("page_id", T.LongType()),
    T.StructField("date_published", T.TimestampNTZType()),
    T.StructField("event_kind", T.StringType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("off", T.LongType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

STATE_COLS = ["page_id", "event_identifier", "event_kind", "value", "date_published", "off"]


def latest_per_page(events: DataFrame) -> DataFrame:
    """Latest event per page (publish time, then offset); map-side reduced (max_by)."""
    order = F.struct("date_published", "off")
    rest = [c for c in STATE_COLS if c != "page_id"]
    agg = events.groupBy("page_id").agg(F.max_by(F.struct(*rest), order).alias("r"))
    return agg.select("page_id", *[F.col("r")[c].alias(c) for c in rest])


def fold(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """New state = latest of (old state, batch) per page."""
    b = latest_per_page(batch)
    if state is None:
        return b
    return latest_per_page(state.select(*STATE_COLS).unionByName(b.select(*STATE_COLS)))


def visible(state: DataFrame) -> DataFrame:
    """Current pages: tombstones removed; visibility changes flagged."""
    return state.where(F.col("event_kind") != "delete").select(
        "page_id", "event_identifier", "event_kind", "value",
        (F.col("event_kind") == "visibility-change").alias("hidden"))


def resume_filter(events: DataFrame, bounds: DataFrame) -> DataFrame:
    """``bounds`` (part, after_offset, since): keep events past both bounds of their partition.

    Partitions without a bound are read from the start.  ``bounds`` has one row per
    stream partition (bounded), so it is broadcast.
    """
    j = events.join(F.broadcast(bounds), "part", "left")
    keep = ((F.col("after_offset").isNull() | (F.col("off") > F.col("after_offset")))
            & (F.col("since").isNull() | (F.col("date_published") >= F.col("since"))))
    return j.where(keep).drop("after_offset", "since")


def run_state_stream(spark: SparkSession, source: str, state_root: str, checkpoint: str,
                     max_files_per_trigger: int | None = None, request_filter=None,
                     compact_every: int = 8) -> DataFrame:
    """N1 + N3: fold the whole available stream into the page state; return the final state.

    The state is a log-structured table under ``state_root``:
    * every micro-batch appends only its own latest-per-page rows as ``delta/batch=<id>``
      (O(batch) work; rewriting the same folder on retry makes the batch idempotent);
    * every ``compact_every`` batches the newest base and the deltas after it are folded
      into a new ``base/v=<id>``;
    * readers fold the newest base with the deltas written after it (``read_state``).
    """
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.json(source)
    if request_filter is not None:
        stream = request_filter(stream)
    return fold_stream(spark, stream, state_root, checkpoint, compact_every)


def fold_stream(spark: SparkSession, stream: DataFrame, state_root: str, checkpoint: str,
                compact_every: int = 8) -> DataFrame:
    """Fold what a stream of events has to give now into the state table; return the state.

    Called again with the same checkpoint and table, it goes on where it ended.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        latest_per_page(batch).write.mode("overwrite").parquet(f"{state_root}/delta/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            state = read_state(spark, state_root, upto=batch_id)
            state.write.mode("overwrite").parquet(f"{state_root}/base/v={batch_id}")

    q = (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return read_state(spark, state_root)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":  # nothing written yet
            return None
        raise


def read_state(spark: SparkSession, state_root: str, upto: int | None = None) -> DataFrame:
    """Newest base version folded with the deltas written after it (up to batch ``upto``)."""
    base_all = _read(spark, f"{state_root}/base")
    deltas = _read(spark, f"{state_root}/delta")
    base_v = None
    if base_all is not None:
        cand = base_all if upto is None else base_all.where(F.col("v") <= upto)
        base_v = cand.agg(F.max("v")).first()[0]
    parts = []
    if base_v is not None:
        parts.append(base_all.where(F.col("v") == base_v).select(*STATE_COLS))
    if deltas is not None:
        d = deltas if base_v is None else deltas.where(F.col("batch") > base_v)
        if upto is not None:
            d = d.where(F.col("batch") <= upto)
        parts.append(d.select(*STATE_COLS))
    if not parts:
        return spark.createDataFrame([], T.StructType([f for f in EVENT_SCHEMA.fields if f.name in STATE_COLS]))
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    return latest_per_page(allp)


def dedup_stream(spark: SparkSession, source: str, sink: str, checkpoint: str,
                 delay: str = "1 hour") -> DataFrame:
    """Drop repeated deliveries of an event id within the watermark delay."""
    stream = (spark.readStream.schema(EVENT_SCHEMA).json(source)
              .withColumn("event_time", F.col("date_published").cast("timestamp"))
              .withWatermark("event_time", delay)
              .dropDuplicatesWithinWatermark(["event_identifier"])
              .drop("event_time"))
    q = (stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(EVENT_SCHEMA).parquet(sink)


def since_bounds(spark: SparkSession, offsets: dict[int, int], since: dict[int, dt.datetime]) -> DataFrame:
    parts = sorted(set(offsets) | set(since))
    return spark.createDataFrame([(p, offsets.get(p), since.get(p)) for p in parts],
                                 "part int, after_offset bigint, since timestamp_ntz")
