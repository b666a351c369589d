"""Tree operators over the adjacency-list node table.

The tree is a rooted forest (one root per namespace) stored as
``(namespace, node_id, parent_id, depth, ...)``.  Everything here is a join /
aggregate; the only loop is over tree *levels* (bounded by the depth, 10 by
default), each level one join whose lineage is cut with a reliable checkpoint.
Node counts are pages / leaf size, far smaller than the page tables, and no
operator collects a group into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.session import cut_lineage

KEY = ["namespace", "node_id"]


def paths(tree: DataFrame, checkpoint_every: int = 4) -> DataFrame:
    """(namespace, node_id, path) with ``path`` = node ids root..self, for nodes reachable from a root.

    One join per level.  The stored depth bounds the loop (one small aggregate);
    a final emptiness probe continues past it if the stored depths are inconsistent.
    """
    # the node table is read once per level: materialise it once (it is pages / leaf size rows)
    nodes = cut_lineage(tree.select("namespace", "node_id", "parent_id", "depth"))
    edges = nodes.where(F.col("parent_id").isNotNull()).select("namespace", "node_id", "parent_id")
    cur = nodes.where(F.col("parent_id").isNull()).select(*KEY, F.array("node_id").alias("path"))
    acc = cur
    bound = nodes.agg(F.max("depth")).first()[0] or 0
    level = 0
    while True:  # a node has one parent, so nothing reached from a root is reached twice
        level += 1
        nxt = (edges.join(cur.select("namespace", F.col("node_id").alias("parent_id"), F.col("path").alias("pp")),
                          ["namespace", "parent_id"])
               .select(*KEY, F.concat("pp", F.array("node_id")).alias("path")))
        if level > bound and nxt.isEmpty():
            break
        if level > 12:    # deep trees: keep the plan short
            nxt = cut_lineage(nxt)
        elif level % checkpoint_every == 0:
            nxt = cut_lineage(nxt)
            acc = cut_lineage(acc)
        acc = acc.unionByName(nxt)
        cur = nxt
    return acc


def closure(tree: DataFrame, include_self: bool = True, path_df: DataFrame | None = None) -> DataFrame:
    """(namespace, node_id, ancestor_id, distance) for every node and each ancestor."""
    p = path_df if path_df is not None else paths(tree)
    out = p.select(*KEY, F.size("path").alias("n"), F.posexplode("path").alias("i", "ancestor_id")) \
        .select(*KEY, "ancestor_id", (F.col("n") - 1 - F.col("i")).alias("distance"))
    return out if include_self else out.where(F.col("distance") > 0)


def ancestors(tree: DataFrame, namespace: str, node_id: int) -> DataFrame:
    """Ancestors of one node, nearest first, self excluded (one join per level); a cycle is an error."""
    me = tree.where((F.col("namespace") == namespace) & (F.col("node_id") == node_id))
    cur = me.select("namespace", F.col("parent_id").alias("node_id"), F.lit(1).alias("distance"))
    acc, seen = None, {node_id}
    while True:
        hit = tree.join(cur, KEY).select(tree["*"], "distance")
        above = hit.select("node_id").first()
        if above is None:
            break
        if above[0] in seen:
            raise ValueError(f"node {node_id} of {namespace!r} is below itself")
        seen.add(above[0])
        if len(seen) % 8 == 0:
            hit, acc = cut_lineage(hit), cut_lineage(acc)
        acc = hit if acc is None else acc.unionByName(hit)
        cur = hit.where(F.col("parent_id").isNotNull()).select(
            "namespace", F.col("parent_id").alias("node_id"), (F.col("distance") + 1).alias("distance"))
    if acc is None:
        return tree.limit(0).withColumn("distance", F.lit(0))
    return acc.orderBy("distance")


def subtree_rollup(tree: DataFrame, page_vector: DataFrame, path_df: DataFrame | None = None) -> DataFrame:
    """Per node: doc_count (pages in its subtree), child_count, subtree_size."""
    cl = closure(tree, True, path_df)
    pages = page_vector.where(F.col("cluster_node_id").isNotNull()).groupBy(
        "namespace", F.col("cluster_node_id").alias("node_id")).agg(F.count("*").alias("own"))
    docs = (cl.join(pages, KEY, "left")
            .groupBy("namespace", F.col("ancestor_id").alias("node_id"))
            .agg(F.sum(F.coalesce("own", F.lit(0))).alias("doc_count"), F.count("*").alias("subtree_size")))
    kids = tree.where(F.col("parent_id").isNotNull()).groupBy(
        "namespace", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("child_count"))
    return (docs.join(kids, KEY, "left")
            .select(*KEY, "doc_count", F.coalesce("child_count", F.lit(0)).alias("child_count"), "subtree_size"))


def preorder_ids(tree: DataFrame, path_df: DataFrame | None = None) -> DataFrame:
    """Depth-first pre-order number per namespace (root = 1, children in node_id order).

    pre(n) = 1 + sum over the non-root nodes a on the root..n path of
             (1 + total subtree size of a's earlier siblings).
    Sibling prefix sums are windows over one parent's children; the rest are
    aggregates, so no global sort or single-partition window is needed.
    """
    p = path_df if path_df is not None else paths(tree)
    cl = closure(tree, True, p)
    size = cl.groupBy("namespace", F.col("ancestor_id").alias("node_id")).agg(F.count("*").alias("sz"))
    sib = Window.partitionBy("namespace", "parent_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    contrib = (tree.where(F.col("parent_id").isNotNull()).select(*KEY, "parent_id").join(size, KEY)
               .select(*KEY, (F.lit(1) + F.coalesce(F.sum("sz").over(sib), F.lit(0))).alias("c")))
    pre = (cl.join(contrib.withColumnRenamed("node_id", "ancestor_id"), ["namespace", "ancestor_id"])
           .groupBy(*KEY).agg(F.sum("c").alias("s")))
    return (p.select(*KEY).join(pre, KEY, "left")
            .select(*KEY, (F.lit(1) + F.coalesce("s", F.lit(0))).alias("preorder_id")))


def integrity(tree: DataFrame, page_vector: DataFrame | None = None) -> DataFrame:
    """One row per violated invariant: (namespace, node_id, violation)."""
    roots = tree.where(F.col("parent_id").isNull())
    per_ns = tree.select("namespace").distinct().join(
        roots.groupBy("namespace").agg(F.count("*").alias("n_roots")), "namespace", "left")
    out = [per_ns.where(F.coalesce("n_roots", F.lit(0)) != 1).select(
        "namespace", F.lit(None).cast("bigint").alias("node_id"),
        F.when(F.col("n_roots").isNull(), "no_root").otherwise("multiple_roots").alias("violation")),
        roots.where(F.col("node_id") != 1).select(*KEY, F.lit("root_id_not_1").alias("violation"))]
    par = tree.select("namespace", F.col("node_id").alias("parent_id"), F.col("depth").alias("pdepth"))
    kids = tree.where(F.col("parent_id").isNotNull()).join(par, ["namespace", "parent_id"], "left")
    out.append(kids.where(F.col("pdepth").isNull()).select(*KEY, F.lit("orphan").alias("violation")))
    out.append(kids.where(F.col("pdepth").isNotNull() & (F.col("depth") != F.col("pdepth") + 1))
               .select(*KEY, F.lit("depth_mismatch").alias("violation")))
    n_kids = tree.where(F.col("parent_id").isNotNull()).groupBy(
        "namespace", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("nk"))
    if "child_count" in tree.columns:
        out.append(tree.join(n_kids, KEY, "left")
                   .where(F.col("child_count") != F.coalesce("nk", F.lit(0)))
                   .select(*KEY, F.lit("child_count_mismatch").alias("violation")))
    if page_vector is not None:
        pv = page_vector.where(F.col("cluster_node_id").isNotNull()).select(
            "namespace", F.col("cluster_node_id").alias("node_id")).distinct()
        out.append(pv.join(n_kids, KEY, "left_semi").select(*KEY, F.lit("pages_on_inner_node").alias("violation")))
        out.append(pv.join(tree.select(*KEY), KEY, "left_anti")
                   .select(*KEY, F.lit("pages_on_unknown_node").alias("violation")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


# --- layout (J4-J6) ---------------------------------------------------------

def layout_positions(tree: DataFrame, vec3: DataFrame, focal_node: int | None = None,
                     namespace: str | None = None, path_df: DataFrame | None = None,
                     step: float = 3.0, focal_scale: float = 3.0) -> DataFrame:
    """Absolute positions: pos(root)=0, pos(n) = pos(parent) + step * v(n) * s(n),
    s(n) = focal_scale when n and its parent are both on the focal path, else 1.

    ``vec3``: (namespace, node_id, x, y, z) relative offsets.  Nodes whose parent is
    missing are placed at step * v(n).
    """
    p = path_df if path_df is not None else paths(tree)
    cl = closure(tree, True, p)
    v = vec3.select(*KEY, "x", "y", "z")
    off = tree.select(*KEY, "parent_id").join(v, KEY, "left")
    if focal_node is not None:
        fp = cl.where((F.col("node_id") == focal_node) & (F.col("namespace") == namespace)).select(
            "namespace", F.col("ancestor_id").alias("fid"))
        on = fp.select("namespace", F.col("fid").alias("node_id"), F.lit(True).alias("n_on"))
        pon = fp.select("namespace", F.col("fid").alias("parent_id"), F.lit(True).alias("p_on"))
        off = off.join(on, KEY, "left").join(pon, ["namespace", "parent_id"], "left")
        scale = F.when(F.col("n_on") & F.col("p_on"), F.lit(focal_scale)).otherwise(F.lit(1.0))
    else:
        scale = F.lit(1.0)
    off = off.select(*KEY, "parent_id", *[(F.lit(step) * F.coalesce(c, F.lit(0.0)) * scale).alias("d" + c)
                                          for c in ("x", "y", "z")])
    # the root has no offset; sum the offsets of every non-root node on the path
    contrib = off.where(F.col("parent_id").isNotNull()).drop("parent_id").withColumnRenamed("node_id", "ancestor_id")
    pos = cl.join(contrib, ["namespace", "ancestor_id"]).groupBy(*KEY).agg(
        *[F.sum("d" + c).alias(c) for c in ("x", "y", "z")])
    reached = p.select(*KEY)
    placed = reached.join(pos, KEY, "left").select(*KEY, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("x", "y", "z")])
    orphans = off.join(reached, KEY, "left_anti").select(*KEY, F.col("dx").alias("x"), F.col("dy").alias("y"),
                                                        F.col("dz").alias("z"))
    return placed.unionByName(orphans)


def edge_geometry(tree: DataFrame, pos: DataFrame) -> DataFrame:
    """Midpoint and length of every parent-child edge."""
    c = pos.alias("c")
    p = pos.select("namespace", F.col("node_id").alias("parent_id"),
                   *[F.col(k).alias("p" + k) for k in ("x", "y", "z")])
    e = tree.where(F.col("parent_id").isNotNull()).select(*KEY, "parent_id").join(c, KEY).join(
        p, ["namespace", "parent_id"])
    return e.select("namespace", "parent_id", "node_id",
                    *[((F.col(k) + F.col("p" + k)) / 2).alias("mid_" + k) for k in ("x", "y", "z")],
                    F.sqrt(sum(((F.col(k) - F.col("p" + k)) ** 2 for k in ("x", "y", "z")), F.lit(0.0))).alias("length"))


def style_class(tree: DataFrame) -> DataFrame:
    """J6: 'root', 'leaf', else 'level_<((depth-1) mod 12)+1>'."""
    kids = tree.where(F.col("parent_id").isNotNull()).select(
        "namespace", F.col("parent_id").alias("node_id")).distinct().withColumn("has_kids", F.lit(True))
    t = tree.join(kids, KEY, "left")
    cls = (F.when(F.col("parent_id").isNull(), F.lit("root"))
           .when(F.col("has_kids").isNull(), F.lit("leaf"))
           .otherwise(F.concat(F.lit("level_"), (F.pmod(F.col("depth") - 1, F.lit(12)) + 1).cast("string"))))
    return t.select(*KEY, "depth", cls.alias("style"))


def graph_export(tree: DataFrame, root_label: str = "Root") -> tuple[DataFrame, DataFrame]:
    """Nodes (label = first label or id; fixed root label; colour = depth mod 10) and edges."""
    label = (F.when(F.col("parent_id").isNull(), F.lit(root_label))
             .otherwise(F.coalesce(F.col("first_label"), F.col("node_id").cast("string"))))
    nodes = tree.select(*KEY, label.alias("label"), F.pmod(F.col("depth"), F.lit(10)).alias("colour"))
    edges = tree.where(F.col("parent_id").isNotNull()).select("namespace", F.col("parent_id").alias("src"),
                                                             F.col("node_id").alias("dst"))
    return nodes, edges
