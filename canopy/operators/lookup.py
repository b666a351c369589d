"""Point lookups, projections, joins, set operations over the page / tree tables (B, C, F, G).

All functions take DataFrames and return DataFrames; predicates are plain column
expressions so Catalyst pushes them into the parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["namespace", "node_id"]
PKEY = ["namespace", "page_id"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(c: Column) -> Column:
    """Case-fold ASCII letters only (what a case-insensitive ASCII LIKE compares)."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


# --- B: lookups -------------------------------------------------------------

def page_by_id(page_log: DataFrame, namespace: str, page_id: int) -> DataFrame:
    return page_log.where((F.col("namespace") == namespace) & (F.col("page_id") == page_id)).limit(1)


def node_by_id(tree: DataFrame, namespace: str, node_id: int) -> DataFrame:
    return tree.where((F.col("namespace") == namespace) & (F.col("node_id") == node_id))


def root_node(tree: DataFrame) -> DataFrame:
    return tree.where(F.col("parent_id").isNull())


def node_view(tree: DataFrame) -> DataFrame:
    """Display label, leaf flag and a usable 3-D position for every node."""
    c3 = F.col("centroid_3d")
    finite = F.forall(c3, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok3 = c3.isNotNull() & (F.size(c3) == 3) & finite
    label = F.coalesce(F.col("final_label"), F.col("first_label"),
                       F.concat(F.lit("Node "), F.col("node_id").cast("string")))
    return tree.select(*KEY, "parent_id", "depth", label.alias("label"),
                       (F.col("child_count") == 0).alias("is_leaf"),
                       F.when(ok3, c3[0]).otherwise(F.lit(0.0)).alias("x"),
                       F.when(ok3, c3[1]).otherwise(F.lit(0.0)).alias("y"),
                       F.when(ok3, c3[2]).otherwise(F.lit(0.0)).alias("z"))


def node_validity(nodes: DataFrame, dim: int) -> DataFrame:
    """(valid, reason) per node record; centroid missing is valid with a note."""
    c = F.col("centroid")
    finite = F.forall(c, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    reason = (F.when(F.col("node_id").isNull(), F.lit("missing id"))
              .when(c.isNull(), F.lit("centroid missing"))
              .when(F.size(c) != dim, F.lit("wrong length"))
              .when(~finite, F.lit("non-finite value"))
              .otherwise(F.lit("ok")))
    return nodes.select("rec_id", "node_id", reason.alias("reason"),
                        reason.isin("ok", "centroid missing").alias("valid"))


def parent_id_of(tree: DataFrame, namespace: str, node_id: int) -> DataFrame:
    return node_by_id(tree, namespace, node_id).select(*KEY, "parent_id")


def _pages_like(page_log: DataFrame, text: str, where: str) -> DataFrame:
    pat = ascii_fold(F.lit(text))
    t_hit = F.contains(ascii_fold(F.col("title")), pat)
    a_hit = F.contains(ascii_fold(F.coalesce(F.col("abstract"), F.lit(""))), pat)
    cond = {"title": t_hit, "abstract": a_hit, "both": t_hit | a_hit}[where]
    return page_log.where(cond)


def search_pages_like(page_log: DataFrame, text: str, where: str = "both", limit: int = 50,
                      offset: int = 0) -> DataFrame:
    """ASCII-case-insensitive substring match on title / abstract / both, ordered by title."""
    return (_pages_like(page_log, text, where).select(*PKEY, "title", "url")
            .orderBy("title", "page_id").offset(offset).limit(limit))


def count_pages_like(page_log: DataFrame, text: str, where: str = "both") -> DataFrame:
    """How many pages such a search has in all, per namespace."""
    return _pages_like(page_log, text, where).groupBy("namespace").agg(F.count("*").alias("total_count"))


def search_labels_like(tree: DataFrame, rollup: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Nodes whose first or final label contains ``text``, largest doc_count first."""
    pat = ascii_fold(F.lit(text))
    hit = (F.contains(ascii_fold(F.coalesce("final_label", F.lit(""))), pat)
           | F.contains(ascii_fold(F.coalesce("first_label", F.lit(""))), pat))
    return (tree.where(hit).join(rollup.select(*KEY, "doc_count"), KEY, "left")
            .select(*KEY, "final_label", F.coalesce("doc_count", F.lit(0)).alias("doc_count"))
            .orderBy(F.desc("doc_count"), "node_id").limit(limit))


def title_suggestions(page_log: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Distinct titles starting with ``prefix`` (ASCII case-insensitive)."""
    return (page_log.where(ascii_fold(F.col("title")).startswith(ascii_fold(F.lit(prefix))))
            .select("title").distinct().orderBy("title").limit(limit))


# --- C: joins ---------------------------------------------------------------

def page_detail(page_log: DataFrame, page_vector: DataFrame, namespace: str, page_id: int) -> DataFrame:
    pl = page_log.where((F.col("namespace") == namespace) & (F.col("page_id") == page_id))
    pv = page_vector.where((F.col("namespace") == namespace) & (F.col("page_id") == page_id))
    return pl.join(pv.select(*PKEY, "cluster_node_id", F.col("embedding").isNotNull().alias("has_embedding")), PKEY) \
        .select(*PKEY, "title", "url", "abstract", "cluster_node_id", "has_embedding")


def pages_in_cluster(page_log: DataFrame, page_vector: DataFrame, namespace: str, node_id: int,
                     limit: int = 50, offset: int = 0) -> DataFrame:
    pv = page_vector.where((F.col("namespace") == namespace) & (F.col("cluster_node_id") == node_id))
    return (pv.select(*PKEY).join(page_log.where(F.col("namespace") == namespace), PKEY)
            .select(*PKEY, "title", "url").orderBy("page_id").offset(offset).limit(limit))


def pages_needing_embedding(page_log: DataFrame, page_vector: DataFrame, chunk_name: str | None = None) -> DataFrame:
    """Pages (optionally of one chunk) with no embedding yet."""
    pl = page_log if chunk_name is None else page_log.where(F.col("chunk_name") == chunk_name)
    have = page_vector.where(F.col("embedding").isNotNull()).select(*PKEY)
    return pl.join(have, PKEY, "left_anti").select(*PKEY, "chunk_name")


def chunks_needing_embedding(page_log: DataFrame, page_vector: DataFrame) -> DataFrame:
    return pages_needing_embedding(page_log, page_vector).select("namespace", "chunk_name").distinct() \
        .orderBy("namespace", "chunk_name")


def page_content(page_log: DataFrame, page_vector: DataFrame, max_abstract: int = 500) -> DataFrame:
    """Title and abstract (cut to ``max_abstract`` chars) of every clustered page."""
    pv = page_vector.where(F.col("cluster_node_id").isNotNull()).select(*PKEY, "cluster_node_id")
    return pv.join(page_log, PKEY).select(
        *PKEY, F.col("cluster_node_id").alias("node_id"), "title",
        F.col("abstract").substr(F.lit(1), F.lit(max_abstract)).alias("abstract"))


def siblings(tree: DataFrame, namespace: str, node_id: int) -> DataFrame:
    me = node_by_id(tree, namespace, node_id).select("namespace", F.col("parent_id").alias("pid"))
    return (tree.join(me, (tree.namespace == me.namespace) & (tree.parent_id == me.pid))
            .where(tree.node_id != node_id).select(tree["*"]).orderBy("node_id"))


def parent_of(tree: DataFrame, namespace: str, node_id: int) -> DataFrame:
    me = node_by_id(tree, namespace, node_id).select("namespace", F.col("parent_id").alias("pid"))
    return tree.join(me, (tree.namespace == me.namespace) & (tree.node_id == me.pid)).select(tree["*"])


def sibling_first_labels(tree: DataFrame, namespace: str, node_id: int) -> DataFrame:
    """Non-null first labels of the siblings, as one ', '-joined string (node_id order)."""
    sib = siblings(tree, namespace, node_id).where(F.col("first_label").isNotNull())
    return sib.groupBy("namespace").agg(
        F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("node_id", "first_label"))),
                                      lambda s: s["first_label"])).alias("neighbour_labels"),
        F.count("*").alias("n_labels"))


def leaf_nodes(tree: DataFrame) -> DataFrame:
    """C11: nodes that are nobody's parent."""
    parents = tree.where(F.col("parent_id").isNotNull()).select(
        "namespace", F.col("parent_id").alias("node_id")).distinct()
    return tree.join(parents, KEY, "left_anti")


# --- F / G: ordering, set operations ---------------------------------------

def children(tree: DataFrame, namespace: str, node_id: int) -> DataFrame:
    return tree.where((F.col("namespace") == namespace) & (F.col("parent_id") == node_id)).orderBy("node_id")


def children_lists(tree: DataFrame, parent_ids: DataFrame | None = None) -> DataFrame:
    """Parent -> sorted child ids (optionally only for the parents in ``parent_ids``)."""
    kids = tree.where(F.col("parent_id").isNotNull())
    if parent_ids is not None:
        kids = kids.join(parent_ids.select("namespace", F.col("node_id").alias("parent_id")),
                         ["namespace", "parent_id"], "left_semi")
    return kids.groupBy("namespace", "parent_id").agg(
        F.array_sort(F.collect_list("node_id")).alias("child_ids"), F.count("*").alias("n_children"))


def neighbourhood(tree: DataFrame, namespace: str, node_id: int, cols: Sequence[str]) -> DataFrame:
    """G1: the node, its children and its parent, tagged with a role."""
    me = node_by_id(tree, namespace, node_id).select(*cols).withColumn("role", F.lit("self"))
    kids = children(tree, namespace, node_id).select(*cols).withColumn("role", F.lit("child"))
    par = parent_of(tree, namespace, node_id).select(*cols).withColumn("role", F.lit("parent"))
    return me.unionByName(kids).unionByName(par)


def sibling_groups(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Non-root nodes split into (with siblings, only children)."""
    n = tree.where(F.col("parent_id").isNotNull()).groupBy("namespace", "parent_id").agg(
        F.count("*").alias("n_sib"))
    t = tree.where(F.col("parent_id").isNotNull()).join(n, ["namespace", "parent_id"])
    return t.where(F.col("n_sib") > 1).drop("n_sib"), t.where(F.col("n_sib") == 1).drop("n_sib")
