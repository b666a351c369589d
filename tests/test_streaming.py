"""Stream state: restart from the checkpoint, idempotent batches, replay equals stream."""

from pyspark.sql import functions as F

from canopy import fixtures as fx
from canopy.sources.scratch import scratch_dir
from canopy.streaming import articles as N
from tests.conftest import SMALL


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_restart_and_replay(spark):
    src = scratch_dir(spark, "t-src")
    ev = fx.articles(spark, SMALL)
    ev.repartition(4).write.json(src)
    state_root, ckpt = scratch_dir(spark, "t-state"), scratch_dir(spark, "t-ckpt")
    first = _rows(N.visible(N.run_state_stream(spark, src, state_root, ckpt, max_files_per_trigger=1,
                                               compact_every=2)))
    # restart: nothing new in the source, the checkpoint owns progress -> same state
    again = _rows(N.visible(N.run_state_stream(spark, src, state_root, ckpt, max_files_per_trigger=1,
                                               compact_every=2)))
    assert first == again
    # replaying the whole history as one batch gives the same state
    assert first == _rows(N.visible(N.fold(None, ev)))
    # compaction wrote base versions; a base alone plus later deltas still reads the same
    assert spark.read.parquet(f"{state_root}/base").select("v").distinct().count() >= 1


def test_fold_is_idempotent(spark):
    ev = fx.articles(spark, SMALL)
    once = N.fold(None, ev)
    twice = N.fold(once, ev)
    assert _rows(once) == _rows(twice)


def test_late_older_update_does_not_resurrect(spark):
    ev = fx.articles(spark, SMALL)
    deleted = ev.where(F.col("event_kind") == "delete").select("page_id").distinct()
    state = N.fold(None, ev)
    stale = ev.join(deleted, "page_id").withColumn("event_kind", F.lit("update")).withColumn(
        "date_published", F.col("date_published") - F.expr("INTERVAL 3650 DAYS"))
    later = N.fold(state, stale)
    assert _rows(N.visible(state)) == _rows(N.visible(later))
