"""A search index that is kept current: immutable segments, tombstones, merges of like sizes.

A change batch names the nodes it touches and gives the state after it.  ``apply_batch``
indexes those nodes alone into a new segment and writes three small tables: the touched
nodes (tombstones: what older segments say about them is dead), how many live nodes each
term loses in each older segment, so that node counts per term stay exact without
reading the postings, and a new version of the manifest.  ``merge`` rewrites segments of
like size, only their live rows, once ``fan`` of them have gathered, so a row is
rewritten a logarithmic number of times.

Files are never changed.  A manifest version is one small Parquet folder; readers take the
highest one that is complete, so a batch is seen whole or not at all.  Buckets carry the
number of their segment in the upper bits; the search itself is that of a single index.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.operators import search as S

KEY = S.KEY
MANIFEST = "segment long, seq long, docs long, tombs string, minus string"
FAN = 4


def _manifest(spark: SparkSession, root: str) -> tuple[int, list]:
    """Number and rows of the newest version; a row per segment (few)."""
    rows = spark.read.schema(f"{MANIFEST}, version long").parquet(f"{root}/manifest")
    newest = rows.groupBy().agg(F.max("version")).first()[0]
    return newest, rows.where(F.col("version") == newest).drop("version").orderBy("seq", "segment").collect()


def _publish(spark: SparkSession, root: str, version: int, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{root}/manifest/version={version}")


def _write_segment(index: S.SearchIndex, root: str, segment: int) -> int:
    """Write an index as a segment, its number in the upper bits of the buckets; the number of its nodes."""
    own = F.lit(segment << 32)
    index.postings = index.postings.withColumn("bucket", F.col("bucket").bitwiseAND(F.lit((1 << 32) - 1)) + own)
    return index.materialize(f"{root}/segment-{segment}").docs.count()


def create(spark: SparkSession, root: str, tree: DataFrame, page_vector: DataFrame, page_log: DataFrame,
           nodes_per_bucket: int = 256) -> None:
    docs = _write_segment(S.build_index(tree, page_vector, page_log, nodes_per_bucket), root, 1)
    _publish(spark, root, 1, [(1, 1, docs, None, None)])


def _tombs(spark: SparkSession, rows: list) -> DataFrame | None:
    """namespace, node_id, dead: rows of a node in segments with a smaller seq are dead."""
    out = None
    for r in rows:
        if r.tombs:
            t = spark.read.parquet(r.tombs).withColumn("dead", F.lit(r.seq))
            out = t if out is None else out.unionByName(t)
    return None if out is None else out.groupBy(*KEY).agg(F.max("dead").alias("dead"))


def _live(rows: DataFrame, tombs: DataFrame | None, seq: int) -> DataFrame:
    return rows if tombs is None else rows.join(tombs.where(F.col("dead") > seq), KEY, "left_anti")


def open_live(spark: SparkSession, root: str, rows: list | None = None, segments: set | None = None) -> S.SearchIndex:
    """The index as of the newest manifest; ``segments`` restricts it to some of them (for merges)."""
    rows = _manifest(spark, root)[1] if rows is None else rows
    tombs = _tombs(spark, rows)
    parts: dict[str, DataFrame] = {}

    def add(name: str, df: DataFrame) -> None:
        parts[name] = df if name not in parts else parts[name].unionByName(df)

    segments = {r.segment for r in rows if r.docs is not None} if segments is None else segments
    for r in rows:
        if r.segment in segments:
            one = S.open_index(spark, f"{root}/segment-{r.segment}")
            for name in ("docs", "postings", "weights"):
                add(name, _live(getattr(one, name), tombs, r.seq))
            add("blocks", one.blocks)
    for r in rows:
        if r.minus:  # nodes that terms have lost; a block of no bucket with a negative count
            lost = spark.read.parquet(r.minus).where(F.col("victim").isin(sorted(segments)))
            add("blocks", lost.select("namespace", "term", F.lit(-1).cast("long").alias("bucket"),
                                      (-F.col("nodes")).alias("nodes"), F.lit(None).cast("double").alias("top"),
                                      F.lit(None).cast("double").alias("avg_len")))
    return S.SearchIndex(parts["docs"], parts["postings"], parts["weights"], parts["blocks"], S.doc_stats(parts["docs"]))


def apply_batch(spark: SparkSession, root: str, touched: DataFrame, tree: DataFrame, page_vector: DataFrame,
                page_log: DataFrame, nodes_per_bucket: int = 256, fan: int = FAN) -> None:
    """Bring the index to the given state, which differs from the last one in the ``touched`` nodes only."""
    version, rows = _manifest(spark, root)
    segment, seq = max(r.segment for r in rows) + 1, max(r.seq for r in rows) + 1
    nodes = touched.select(*KEY).distinct()
    tombs, minus = f"{root}/tombs-{segment}", f"{root}/minus-{segment}"
    nodes.write.parquet(tombs)
    nodes = spark.read.parquet(tombs)
    before = open_live(spark, root, rows)
    before.weights.join(nodes, KEY, "left_semi").groupBy(
        "namespace", "term", F.shiftright("bucket", 32).alias("victim")).agg(F.count("*").alias("nodes")) \
        .write.parquet(minus)
    now = S.build_index(tree.join(nodes, KEY, "left_semi"), page_vector, page_log, nodes_per_bucket)
    docs = _write_segment(now, root, segment)
    _publish(spark, root, version + 1, [tuple(r) for r in rows] + [(segment, seq, docs, tombs, minus)])
    merge(spark, root, fan)


def merge(spark: SparkSession, root: str, fan: int = FAN) -> None:
    """Rewrite segments of like size into one wherever ``fan`` of them have gathered.

    The new segment takes the highest place of those it replaces: what was dead in them is
    left out, and what dies later is dead in it too.
    """
    while True:
        version, rows = _manifest(spark, root)
        tiers: dict[int, list] = {}
        for r in rows:
            if r.docs is not None:  # a replaced segment stays listed only for its tombstones
                tiers.setdefault(int(math.log(max(r.docs, 1), fan)), []).append(r)
        full = [t for t in tiers.values() if len(t) >= fan]
        if not full:
            return
        old = {r.segment for r in full[0]}
        seq = max(r.seq for r in full[0])
        live = open_live(spark, root, rows, old)
        segment = max(r.segment for r in rows) + 1
        docs = _write_segment(live, root, segment)
        kept = [tuple(r) if r.segment not in old else (r.segment, r.seq, None, r.tombs, r.minus)
                for r in rows if r.segment not in old or r.tombs]
        _publish(spark, root, version + 1, kept + [(segment, seq, docs, None, None)])
