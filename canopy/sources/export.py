"""Serving export (A11), typed export (A12) and copy reconciliation by content.

The content of a table is compared as a multiset: per namespace, the number of rows and the
sums of two independent hashes of every row.  The sums do not depend on the order of rows or
files and are combined before the shuffle, so both sides are read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# column-pruned serving projections
SLIM_COLUMNS = {
    "page_log": ["namespace", "page_id", "title", "url"],
    "page_vector": ["namespace", "page_id", "cluster_node_id", "three_d"],
    "cluster_tree": ["namespace", "node_id", "parent_id", "depth", "centroid_3d", "doc_count", "child_count",
                     "final_label"],
}


def slim_copy(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> dict[str, DataFrame]:
    """Write each table's serving columns as Parquet partitioned by namespace; return the copies."""
    out = {}
    for name, df in tables.items():
        cols = [c for c in SLIM_COLUMNS.get(name, df.columns) if c in df.columns]
        path = f"{root}/{name}"
        df.select(*cols).write.mode("overwrite").partitionBy("namespace").parquet(path)
        out[name] = spark.read.parquet(path)
    return out


def typed_copy(vectors: DataFrame, blobs: dict[str, str], root: str) -> DataFrame:
    """A vector table whose columns hold float32 blobs, written as typed Parquet; ``blobs``: column -> new name."""
    from canopy.sources.pages import decode_f32
    keep = [c for c in vectors.columns if c not in blobs]
    vectors.select(*keep, *[decode_f32(F.col(c)).alias(new) for c, new in blobs.items()]) \
        .write.mode("overwrite").partitionBy("namespace").parquet(root)
    return vectors.sparkSession.read.parquet(root)


def content(df: DataFrame, cols: list[str]) -> DataFrame:
    """namespace, rows, h1, h2: a digest of the rows of each namespace, whatever their order."""
    values = [F.col(c) for c in cols]
    sums = [F.sum(F.xxhash64(F.lit(seed), *values).cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)]
    return df.groupBy("namespace").agg(F.count("*").alias("rows"), *sums)


def reconcile(src: dict[str, DataFrame], dst: dict[str, DataFrame], by_namespace: bool = False) -> DataFrame:
    """Per table (and namespace): source rows, target rows, same_content, ok (a missing target counts as 0).

    The columns that both sides have are compared.
    """
    out = None
    for name, df in src.items():
        cols = sorted(set(df.columns) & set(dst[name].columns if name in dst else df.columns))
        s = content(df, cols).select("namespace", F.col("rows").alias("s"), F.struct("h1", "h2").alias("hs"))
        other = content(dst[name], cols) if name in dst else content(df.limit(0), cols)
        t = other.select(F.col("namespace").alias("ns"), F.col("rows").alias("t"), F.struct("h1", "h2").alias("ht"))
        both = s.join(t, F.col("namespace").eqNullSafe(F.col("ns")), "full").select(
            F.coalesce("namespace", "ns").alias("namespace"), F.coalesce("s", F.lit(0)).alias("source_rows"),
            F.coalesce("t", F.lit(0)).alias("target_rows"), F.coalesce(F.col("hs") == F.col("ht"), F.lit(False)).alias("same_content"))
        both = both.withColumn("table_name", F.lit(name))
        out = both if out is None else out.unionByName(both)
    keys = ["table_name", "namespace"] if by_namespace else ["table_name"]
    sums = out.groupBy(*keys).agg(F.sum("source_rows").alias("source_rows"), F.sum("target_rows").alias("target_rows"),
                                  F.bool_and("same_content").alias("same_content"))
    return sums.withColumn("ok", (F.col("source_rows") == F.col("target_rows")) & F.col("same_content"))


def size_report(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Bytes of the files of two Parquet folders and the share that the copy saves."""
    def size(path: str):
        files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size").distinct()
        return files.agg(F.sum("file_size").alias("n"), F.lit(1).alias("k"))

    both = size(source).withColumnRenamed("n", "source_bytes").join(size(target).withColumnRenamed("n", "target_bytes"), "k")
    return both.select("source_bytes", "target_bytes",
                       (F.lit(1.0) - F.col("target_bytes") / F.col("source_bytes")).alias("reduction"))
