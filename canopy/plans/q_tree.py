"""Catalogue: tree operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy import fixtures as fx
from canopy.operators import lookup as L
from canopy.operators import tree as T
from canopy.plans.registry import register


def paths_sql(tree: str) -> list[tuple[str, str]]:
    return [
        ("p(namespace, node_id, path)", f"""SELECT namespace, node_id, [node_id] FROM {tree} WHERE parent_id IS NULL
UNION ALL SELECT t.namespace, t.node_id, list_append(p.path, t.node_id) FROM {tree} t
JOIN p ON t.namespace = p.namespace AND t.parent_id = p.node_id"""),
        ("cl", """SELECT namespace, node_id, anc AS ancestor_id, CAST(len(path) - 1 - i AS INTEGER) AS distance
FROM (SELECT namespace, node_id, path, unnest(path) AS anc, unnest(range(len(path))) AS i FROM p)"""),
    ]


def V(body, *views, tree="geo_tree", extra=()):
    return fx.with_views(body, *views, extra=paths_sql(tree) + list(extra), recursive=True)


@register("ancestors", V("""SELECT t.*, cl.distance FROM cl JOIN geo_tree t ON t.namespace = cl.namespace
  AND t.node_id = cl.ancestor_id WHERE cl.namespace = 'geo' AND cl.node_id = 40 AND cl.distance > 0
ORDER BY cl.distance""", "geo_tree"))
def ancestors(spark, d):
    """Ancestors of one node, nearest first."""
    return T.ancestors(fx.geo_tree(spark, d), "geo", 40)


@register("ancestor_closure", V("SELECT namespace, node_id, ancestor_id, distance FROM cl WHERE distance > 0",
                                "geo_tree"))
def ancestor_closure(spark, d):
    """J2."""
    return T.closure(fx.geo_tree(spark, d), include_self=False)


_ROLLUP = """SELECT t.namespace, t.node_id, coalesce(dc.doc_count, 0) AS doc_count,
       (SELECT count(*) FROM geo_tree c WHERE c.namespace = t.namespace AND c.parent_id = t.node_id) AS child_count,
       dc.subtree_size
FROM geo_tree t JOIN (
  SELECT cl.namespace, cl.ancestor_id AS node_id, CAST(sum(coalesce(pc.n, 0)) AS BIGINT) AS doc_count,
         count(*) AS subtree_size
  FROM cl LEFT JOIN (SELECT namespace, cluster_node_id AS node_id, count(*) AS n FROM geo_page GROUP BY 1, 2) pc
    ON pc.namespace = cl.namespace AND pc.node_id = cl.node_id
  GROUP BY 1, 2) dc ON dc.namespace = t.namespace AND dc.node_id = t.node_id"""


@register("subtree_rollup", V(_ROLLUP, "geo_tree", "geo_page"))
def subtree_rollup(spark, d):
    """doc_count / child_count / subtree size per node."""
    return T.subtree_rollup(fx.geo_tree(spark, d), fx.geo_page(spark, d))


@register("preorder_ids", V("""SELECT namespace, node_id, row_number() OVER (PARTITION BY namespace ORDER BY path)
         AS preorder_id FROM p""", "geo_tree"))
def preorder_ids(spark, d):
    """Depth-first pre-order renumbering (siblings by node_id)."""
    return T.preorder_ids(fx.geo_tree(spark, d))


@register("tree_integrity", V("""SELECT namespace, CAST(NULL AS BIGINT) AS node_id, 'multiple_roots' AS violation
FROM emb_tree WHERE parent_id IS NULL GROUP BY namespace HAVING count(*) > 1
UNION ALL SELECT DISTINCT namespace, CAST(NULL AS BIGINT), 'no_root' FROM emb_tree t
  WHERE NOT EXISTS (SELECT 1 FROM emb_tree r WHERE r.namespace = t.namespace AND r.parent_id IS NULL)
UNION ALL SELECT namespace, node_id, 'root_id_not_1' FROM emb_tree WHERE parent_id IS NULL AND node_id <> 1
UNION ALL SELECT c.namespace, c.node_id, 'orphan' FROM emb_tree c LEFT JOIN emb_tree p
  ON p.namespace = c.namespace AND p.node_id = c.parent_id WHERE c.parent_id IS NOT NULL AND p.node_id IS NULL
UNION ALL SELECT c.namespace, c.node_id, 'depth_mismatch' FROM emb_tree c JOIN emb_tree p
  ON p.namespace = c.namespace AND p.node_id = c.parent_id WHERE c.depth <> p.depth + 1
UNION ALL SELECT DISTINCT pv.namespace, pv.node_id, 'pages_on_inner_node' FROM pv
  WHERE EXISTS (SELECT 1 FROM emb_tree c WHERE c.namespace = pv.namespace AND c.parent_id = pv.node_id)
UNION ALL SELECT DISTINCT pv.namespace, pv.node_id, 'pages_on_unknown_node' FROM pv
  WHERE NOT EXISTS (SELECT 1 FROM emb_tree t WHERE t.namespace = pv.namespace AND t.node_id = pv.node_id)""",
                              "emb_tree", "emb_page", tree="emb_tree",
                              extra=[("pv", "SELECT namespace, CAST(2 + label AS BIGINT) AS node_id FROM emb_page")]))
def tree_integrity(spark, d):
    """Invariant violations of the embedding tree when pages sit on nodes 2 + label."""
    pv = fx.emb_page(spark, d).select("namespace", "page_id", (F.lit(2) + F.col("label")).cast("bigint")
                                      .alias("cluster_node_id"))
    return T.integrity(fx.emb_tree(spark, d), pv)


@register("style_class", V("""SELECT t.namespace, t.node_id, t.depth,
  CASE WHEN t.parent_id IS NULL THEN 'root'
       WHEN NOT EXISTS (SELECT 1 FROM geo_tree c WHERE c.namespace = t.namespace AND c.parent_id = t.node_id) THEN 'leaf'
       ELSE concat('level_', CAST(((t.depth - 1) % 12) + 1 AS VARCHAR)) END AS style FROM geo_tree t""", "geo_tree"))
def style_class(spark, d):
    """J6."""
    return T.style_class(fx.geo_tree(spark, d))


@register("graph_nodes", V("""SELECT namespace, node_id,
  CASE WHEN parent_id IS NULL THEN 'Root' ELSE coalesce(first_label, CAST(node_id AS VARCHAR)) END AS label,
  depth % 10 AS colour FROM dt""", "doc_tree",
                           extra=[("dt", "SELECT namespace, node_id, parent_id, depth, CASE WHEN node_id % 2 = 0 "
                                         "THEN first_label END AS first_label FROM doc_tree")]))
def graph_nodes(spark, d):
    """A14 nodes (odd node ids carry no label here, so the id fallback is exercised)."""
    t = fx.doc_tree(spark, d).withColumn(
        "first_label", F.when(F.col("node_id") % 2 == 0, F.col("first_label")))
    return T.graph_export(t)[0]


@register("graph_edges", V("SELECT namespace, parent_id AS src, node_id AS dst FROM doc_tree WHERE parent_id IS NOT NULL",
                           "doc_tree"))
def graph_edges(spark, d):
    """A14 edges."""
    return T.graph_export(fx.doc_tree(spark, d))[1]


@register("label_like_search", V(
    """SELECT t.namespace, t.node_id, t.final_label, coalesce(r.doc_count, 0) AS doc_count
FROM geo_tree t LEFT JOIN (""" + _ROLLUP + """) r ON r.namespace = t.namespace AND r.node_id = t.node_id
WHERE contains(translate(coalesce(t.final_label, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               'nation_1')
ORDER BY doc_count DESC, t.node_id LIMIT 50""", "geo_tree", "geo_page"))
def label_like_search(spark, d):
    """Label substring search ranked by subtree page count."""
    t = fx.geo_tree(spark, d).withColumn("first_label", F.lit(None).cast("string"))
    roll = T.subtree_rollup(t, fx.geo_page(spark, d))
    return L.search_labels_like(t, roll, "nation_1", 50)
