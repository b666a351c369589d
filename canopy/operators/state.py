"""Incremental state as table versions: new version = f(old version, change batch) (M1-M8).

All operators are joins or keyed aggregates — no per-row loops, no driver state.
"Latest wins" uses ``max_by`` over an ordering struct instead of a window, so a
key with millions of versions is reduced map-side before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Keep the row with the greatest ``order`` per key (ties: any one)."""
    cols = [c for c in df.columns if c not in keys]
    ordk = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), ordk).alias("__r"))
    return agg.select(*keys, *[F.col("__r")[c].alias(c) for c in cols])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], seq: str | None = None,
           dealt_by: str | None = None) -> DataFrame:
    """M1: replace whole rows by key; within the batch the last (highest ``seq``) duplicate wins.

    ``dealt_by``: a column that follows from the keys; the result is left partitioned by it, from one shuffle.
    """
    cols = old.columns
    o = old.select(*cols, F.lit(0).alias("__src"), F.lit(0).cast("bigint").alias("__seq"))
    n = new.select(*cols, F.lit(1).alias("__src"),
                   (F.col(seq) if seq else F.lit(0)).cast("bigint").alias("__seq"))
    rows = o.unionByName(n)
    if dealt_by:
        rows, keys = rows.repartition(dealt_by), [dealt_by, *keys]
    return latest_per_key(rows, keys, ["__src", "__seq"]).select(*cols)


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """M2: new chunks are inserted; a re-announced chunk keeps both stored paths but
    loses its download/unpack stamps."""
    keys = ["namespace", "chunk_name"]
    o = old.alias("o")
    n = new.alias("n")
    j = o.join(n, keys, "full")
    both = F.col("o.chunk_name").isNotNull() & F.col("n.chunk_name").isNotNull()
    only_new = F.col("o.chunk_name").isNull()

    def pick(c: str, existing: Column) -> Column:
        return F.when(only_new, F.col(f"n.{c}")).when(both, existing).otherwise(F.col(f"o.{c}"))

    return j.select(*keys,
                    pick("chunk_archive_path", F.col("o.chunk_archive_path")).alias("chunk_archive_path"),
                    pick("chunk_extracted_path", F.col("o.chunk_extracted_path")).alias("chunk_extracted_path"),
                    pick("downloaded_at", F.lit(None).cast("timestamp_ntz")).alias("downloaded_at"),
                    pick("unpacked_at", F.lit(None).cast("timestamp_ntz")).alias("unpacked_at"))


def merge_columns(old: DataFrame, changes: DataFrame, keys: Sequence[str], cols: Sequence[str],
                  insert_missing: bool = False) -> DataFrame:
    """M3/M4: keyed column update.  Keys present in ``changes`` take its values for
    ``cols`` (including nulls); other columns are kept.  ``insert_missing`` adds
    change rows whose key is new (other columns null)."""
    keys = list(keys)
    ch = changes.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in cols], F.lit(True).alias("__hit"))
    how = "full" if insert_missing else "left"
    j = old.join(ch, keys, how)
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in cols:
            out.append(F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def insert_nodes(tree: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """M5."""
    return tree.unionByName(new_nodes, allowMissingColumns=True)


def reset_tree(tree: DataFrame, page_vector: DataFrame, namespace: str,
               assignment_cols: Sequence[str] = ("cluster_node_id", "three_d")) -> tuple[DataFrame, DataFrame]:
    """M6: drop the namespace's nodes and clear its page assignments (and stale 3-D vectors)."""
    t = tree.where(F.col("namespace") != namespace)
    pv = page_vector
    for c in assignment_cols:
        if c in pv.columns:
            pv = pv.withColumn(c, F.when(F.col("namespace") == namespace, F.lit(None).cast(pv.schema[c].dataType))
                               .otherwise(F.col(c)))
    return t, pv


def clear_labels(tree: DataFrame, namespace: str) -> DataFrame:
    """Forget first and final labels of one namespace."""
    hit = F.col("namespace") == namespace
    return (tree.withColumn("first_label", F.when(hit, F.lit(None).cast("string")).otherwise(F.col("first_label")))
            .withColumn("final_label", F.when(hit, F.lit(None).cast("string")).otherwise(F.col("final_label"))))


def cascade_delete(page_log: DataFrame, page_vector: DataFrame, deleted: DataFrame,
                   keys: Sequence[str] = ("namespace", "page_id")) -> tuple[DataFrame, DataFrame]:
    """M8: delete pages and (cascade) their vector rows."""
    k = deleted.select(*keys).distinct()
    return page_log.join(k, list(keys), "left_anti"), page_vector.join(k, list(keys), "left_anti")
