"""Status aggregates (D1-D5, D8, D9): single-pass conditional counts, all namespaces at once.

Every aggregate here is a hash aggregate with map-side partial combine, so a
namespace holding a third of all rows costs one extra partial row per task, not
one hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_status(chunk_log: DataFrame) -> DataFrame:
    """Per namespace: chunks, downloaded, extracted."""
    return chunk_log.groupBy("namespace").agg(
        F.count("*").alias("total_chunks"),
        F.count("downloaded_at").alias("downloaded"),
        F.count("unpacked_at").alias("extracted"))


def page_status(page_log: DataFrame, page_vector: DataFrame,
                vector_cols: tuple[str, ...] = ("embedding", "reduced", "three_d", "cluster_node_id")) -> DataFrame:
    """Per namespace: pages, plus the count of non-null values of each vector-table column present."""
    present = [c for c in vector_cols if c in page_vector.columns]
    pv = page_vector.groupBy("namespace").agg(*[F.count(c).alias(f"with_{c}") for c in present])
    pl = page_log.groupBy("namespace").agg(F.count("*").alias("total_pages"))
    return pl.join(pv, "namespace", "full").select(
        "namespace", F.coalesce("total_pages", F.lit(0)).alias("total_pages"),
        *[F.coalesce(f"with_{c}", F.lit(0)).alias(f"with_{c}") for c in present])


def label_status(tree: DataFrame) -> DataFrame:
    """D3: per namespace: nodes, with first label, with final label (empty string = pending)."""
    return tree.groupBy("namespace").agg(
        F.count("*").alias("nodes"),
        F.count_if(F.coalesce(F.col("first_label"), F.lit("")) != "").alias("first_labelled"),
        F.count_if(F.coalesce(F.col("final_label"), F.lit("")) != "").alias("final_labelled"))


def depth_histogram(tree: DataFrame) -> DataFrame:
    """D4."""
    return tree.groupBy("namespace", "depth").agg(F.count("*").alias("nodes"))


def chunk_page_counts(page_log: DataFrame) -> DataFrame:
    """Pages per chunk."""
    return page_log.groupBy("namespace", "chunk_name").agg(F.count("*").alias("pages"))


def vector_counts(page_vector: DataFrame, tree: DataFrame) -> DataFrame:
    """Embedding count and max node id per namespace."""
    e = page_vector.groupBy("namespace").agg(F.count("embedding").alias("embeddings"))
    m = tree.groupBy("namespace").agg(F.max("node_id").alias("max_node_id"))
    return e.join(m, "namespace", "full")


def clusters_pending(page_vector: DataFrame, cluster: str = "cluster_id", position: str = "three_d") -> DataFrame:
    """Pages without a position per cluster."""
    return page_vector.where(F.col(cluster).isNotNull() & F.col(position).isNull()).groupBy(
        "namespace", F.col(cluster).alias("cluster_id")).agg(F.count("page_id").alias("pages"))


def namespaces(*dfs: DataFrame) -> DataFrame:
    """Distinct namespaces over the given tables."""
    out = dfs[0].select("namespace")
    for d in dfs[1:]:
        out = out.unionByName(d.select("namespace"))
    return out.distinct()


def tree_summary(tree: DataFrame) -> DataFrame:
    """Nodes, leaves, stems per namespace (leaf = nobody's parent)."""
    parents = tree.where(F.col("parent_id").isNotNull()).select(
        "namespace", F.col("parent_id").alias("node_id")).distinct().withColumn("is_parent", F.lit(1))
    t = tree.join(parents, ["namespace", "node_id"], "left")
    return t.groupBy("namespace").agg(
        F.count("*").alias("nodes"),
        F.count_if(F.col("is_parent").isNull()).alias("leaves"),
        F.count_if(F.col("is_parent").isNotNull()).alias("stems"))
