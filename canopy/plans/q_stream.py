"""Catalogue: the article change stream."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from canopy import fixtures as fx
from canopy.plans.registry import register
from canopy.sources.article_log import open_log
from canopy.sources.scratch import scratch_dir
from canopy.streaming import articles as N

V = fx.with_views

LATEST_SQL = """SELECT page_id, event_identifier, event_kind, value, event_kind = 'visibility-change' AS hidden FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY date_published DESC, off DESC) AS rn FROM articles)
WHERE rn = 1 AND event_kind <> 'delete'"""


def _write_events(spark, d, name, copies=1, files=6):
    root = scratch_dir(spark, name)
    ev = fx.articles(spark, d)
    for i in range(copies):
        ev.repartition(files).write.mode("append").json(root)
    return root


@register("stream_apply", V(LATEST_SQL, "articles"))
def stream_apply(spark, d):
    """The event files consumed as a stream (2 files per micro-batch), folded into page state."""
    src = _write_events(spark, d, "events-src")
    state = N.run_state_stream(spark, src, scratch_dir(spark, "state"), scratch_dir(spark, "ckpt"),
                               max_files_per_trigger=2)
    return N.visible(state)


@register("batch_replay", V(LATEST_SQL, "articles"))
def batch_replay(spark, d):
    """The same fold over one batch read gives the stream's state."""
    return N.visible(N.fold(None, fx.articles(spark, d)))


OFFSETS = {0: 250, 1: 500, 2: 750, 3: 1000}
SINCE = {p: dt.datetime(2024, 1, 1, 12) for p in range(4)}


@register("stream_resume", V("""SELECT a.event_identifier, a.page_id, a.part, a.off FROM articles a
JOIN (VALUES (0, 250), (1, 500), (2, 750), (3, 1000)) b(part, after_offset) ON b.part = a.part
WHERE a.off > b.after_offset AND a.date_published >= TIMESTAMP '2024-01-01 12:00:00'""", "articles"))
def stream_resume(spark, d):
    """Resume after per-partition offsets and since-timestamps."""
    bounds = N.since_bounds(spark, OFFSETS, SINCE)
    return N.resume_filter(fx.articles(spark, d), bounds).select("event_identifier", "page_id", "part", "off")


RESUMED_SQL = """SELECT page_id, event_identifier, event_kind, value, event_kind = 'visibility-change' AS hidden FROM (
  SELECT a.*, row_number() OVER (PARTITION BY page_id ORDER BY date_published DESC, off DESC) AS rn FROM articles a
  JOIN (VALUES (0, 250), (1, 500), (2, 750)) b(part, after_offset) ON b.part = a.part
  WHERE a.off > b.after_offset AND a.date_published >= TIMESTAMP '2024-01-01 12:00:00')
WHERE rn = 1 AND event_kind <> 'delete'"""


@register("stream_stop_and_resume", V(RESUMED_SQL, "articles"))
def stream_stop_and_resume(spark, d):
    """Three parts of the log read from their offsets, stopped in mid-file and resumed from the checkpoint."""
    ev = fx.articles(spark, d)
    root, state, ckpt = (scratch_dir(spark, name) for name in ("log", "log-state", "log-ckpt"))
    ev.repartitionByRange(12, "part", "off").sortWithinPartitions("part", "off").write.partitionBy("part").json(root)
    bounds = {"parts": [0, 1, 2], "offsets": {p: OFFSETS[p] for p in (0, 1, 2)}, "since": SINCE}
    # the first run ends within a file of each part, wherever the files end
    stop = {r.part: r.m for r in ev.groupBy("part").agg((F.max("off") * 5 / 8).cast("long").alias("m")).collect()}
    N.fold_stream(spark, open_log(spark, path=root, until=stop, **bounds), state, ckpt)
    return N.visible(N.fold_stream(spark, open_log(spark, path=root, **bounds), state, ckpt))


@register("stream_dedup", V("SELECT event_identifier, page_id FROM articles", "articles"))
def stream_dedup(spark, d):
    """Every event delivered twice; duplicates dropped within the watermark."""
    src = _write_events(spark, d, "events-dup", copies=2)
    out = N.dedup_stream(spark, src, scratch_dir(spark, "dedup-sink"), scratch_dir(spark, "dedup-ckpt"))
    return out.select("event_identifier", "page_id")
