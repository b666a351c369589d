"""Catalogue: windows, formatting, validity, layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy import fixtures as fx
from canopy import tables
from canopy.functions import vec3
from canopy.operators import lookup as Lk
from canopy.operators import tree as T
from canopy.operators import vectors as Vx
from canopy.operators.windows import first_n_per_group
from canopy.plans.q_tree import paths_sql
from canopy.plans.q_vectors import _shape_values
from canopy.plans.registry import register

V = fx.with_views


@register("first_n_samples", V("""SELECT namespace, cluster_node_id AS node_id, list_sort(list(page_id)) AS sample_ids
FROM (SELECT *, row_number() OVER (PARTITION BY namespace, cluster_node_id ORDER BY page_id) AS rn FROM geo_page)
WHERE rn <= 10 GROUP BY 1, 2""", "geo_page"))
def first_n_samples(spark, d):
    """First 10 member ids per leaf (partial per-group limit before the shuffle)."""
    g = fx.geo_page(spark, d).withColumnRenamed("cluster_node_id", "node_id")
    top = first_n_per_group(g, ["namespace", "node_id"], ["page_id"], 10)
    return top.groupBy("namespace", "node_id").agg(F.array_sort(F.collect_list("page_id")).alias("sample_ids"))


_GEO_SHAPE = ("gp", f"""SELECT t.namespace, t.node_id, t.parent_id, coalesce(s.x, 0.0) AS x, coalesce(s.y, 0.0) AS y,
       coalesce(s.z, 0.0) AS z
FROM (SELECT namespace, node_id, parent_id,
        row_number() OVER (PARTITION BY namespace, parent_id ORDER BY node_id) AS rk,
        count(*) OVER (PARTITION BY namespace, parent_id) AS gs FROM emb_tree) t
LEFT JOIN (VALUES {_shape_values(Vx.SIBLING_SHAPES)}) s(gs, rk, x, y, z)
  ON t.parent_id IS NOT NULL AND s.gs = t.gs AND s.rk = t.rk""")


@register("vec3_text", V("""SELECT node_id, printf('[%.8f, %.8f, %.8f]', x, y, z) AS vec_text, round(x, 8) + 0.0 AS x, round(y, 8) + 0.0 AS y,
       round(z, 8) + 0.0 AS z FROM gp""",
                         "emb_tree", extra=[_GEO_SHAPE]))
def vec3_text(spark, d):
    """H6: 3-D vectors as text (8 decimals, non-finite as 0) — and parsed back without loss."""
    g = Vx.geometric_projection(fx.emb_tree(spark, d))
    txt = g.select("node_id", vec3.to_text(F.array("x", "y", "z")).alias("vec_text"))
    back = txt.select("node_id", "vec_text", vec3.from_text("vec_text").alias("v"))
    return back.select("node_id", "vec_text", *[(F.col("v")[i] + F.lit(0.0)).alias(c) for i, c in enumerate("xyz")])


@register("node_validity", V("""SELECT vec_id AS rec_id, CASE WHEN label = 0 THEN NULL ELSE vec_id END AS node_id,
  CASE WHEN label = 0 THEN 'missing id' WHEN label = 1 THEN 'centroid missing' WHEN label = 2 THEN 'wrong length'
       WHEN label = 3 THEN 'non-finite value' ELSE 'ok' END AS reason,
  label NOT IN (0, 2, 3) AS valid FROM embeddings"""))
def node_validity(spark, d):
    """Node records with a missing id (label 0), no centroid (1), a short centroid (2),
    a non-finite value (3) or a good centroid (others)."""
    e = tables.read(spark, d, "embeddings")
    c = (F.when(F.col("label") == 1, F.lit(None))
         .when(F.col("label") == 2, F.slice("embedding", 1, 63))
         .when(F.col("label") == 3, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float"))))
         .otherwise(F.col("embedding")))
    recs = e.select(F.col("vec_id").alias("rec_id"),
                    F.when(F.col("label") != 0, F.col("vec_id")).alias("node_id"), c.alias("centroid"))
    return Lk.node_validity(recs, 64)


@register("nodes_missing_centroid", V("""SELECT t.namespace, t.node_id FROM emb_tree t
WHERE t.depth < 2 ORDER BY t.node_id""", "emb_tree"))
def nodes_missing_centroid(spark, d):
    """Nodes without a centroid once leaf centroids exist (i.e. the inner nodes), by node_id."""
    t = fx.emb_tree(spark, d)
    leaf = Vx.group_mean(fx.emb_page(spark, d).select(
        "namespace", (F.lit(5) + F.col("label")).cast("bigint").alias("node_id"), F.col("embedding").alias("vec")),
        ["namespace", "node_id"], "vec")
    t = t.join(leaf.select("namespace", "node_id", "centroid"), ["namespace", "node_id"], "left")
    return t.where(F.col("centroid").isNull()).select("namespace", "node_id").orderBy("node_id")


@register("pages_needing_projection", V("""SELECT namespace, cluster_node_id, page_id FROM page_vector
WHERE cluster_node_id IS NOT NULL AND embedding IS NULL ORDER BY cluster_node_id, page_id LIMIT 100""",
                                        "page_vector"))
def pages_needing_projection(spark, d):
    """Pages with a node but no 3-D vector yet (here: the pages without embedding), by node; limit caps pages."""
    pv = fx.page_vector(spark, d).withColumn(
        "three_d", F.when(F.col("embedding").isNotNull(), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))))
    return (pv.where(F.col("cluster_node_id").isNotNull() & F.col("three_d").isNull())
            .select("namespace", "cluster_node_id", "page_id").orderBy("cluster_node_id", "page_id").limit(100))


def _layout_sql(focal: int | None) -> list[tuple[str, str]]:
    focal_cte = ("fp", f"SELECT ancestor_id AS fid FROM cl WHERE node_id = {focal}" if focal is not None
                 else "SELECT CAST(NULL AS BIGINT) AS fid WHERE false")
    return paths_sql("emb_tree") + [_GEO_SHAPE, focal_cte, ("off", """SELECT g.node_id,
  3 * g.x * CASE WHEN g.node_id IN (SELECT fid FROM fp) AND g.parent_id IN (SELECT fid FROM fp) THEN 3 ELSE 1 END AS dx,
  3 * g.y * CASE WHEN g.node_id IN (SELECT fid FROM fp) AND g.parent_id IN (SELECT fid FROM fp) THEN 3 ELSE 1 END AS dy,
  3 * g.z * CASE WHEN g.node_id IN (SELECT fid FROM fp) AND g.parent_id IN (SELECT fid FROM fp) THEN 3 ELSE 1 END AS dz
FROM gp g WHERE g.parent_id IS NOT NULL"""),
        ("pos", """SELECT cl.node_id, coalesce(sum(o.dx), 0.0) AS x, coalesce(sum(o.dy), 0.0) AS y,
       coalesce(sum(o.dz), 0.0) AS z FROM cl LEFT JOIN off o ON o.node_id = cl.ancestor_id GROUP BY cl.node_id""")]


def _positions(spark, d, focal):
    t = fx.emb_tree(spark, d)
    v = Vx.geometric_projection(t)
    return T.layout_positions(t, v, focal_node=focal, namespace="emb")


@register("layout_positions", fx.with_views("""SELECT node_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z
FROM pos""", "emb_tree", extra=_layout_sql(7), recursive=True))
def layout_positions(spark, d):
    """Absolute positions with node 7's path as the focal path."""
    return _positions(spark, d, 7).select("node_id", *[F.round(c, 6).alias(c) for c in ("x", "y", "z")])


@register("edge_geometry", fx.with_views("""SELECT c.node_id, t.parent_id,
       round((c.x + p.x) / 2, 6) AS mid_x, round((c.y + p.y) / 2, 6) AS mid_y, round((c.z + p.z) / 2, 6) AS mid_z,
       round(sqrt((c.x - p.x) ** 2 + (c.y - p.y) ** 2 + (c.z - p.z) ** 2), 6) AS length
FROM emb_tree t JOIN pos c ON c.node_id = t.node_id JOIN pos p ON p.node_id = t.parent_id""",
                                         "emb_tree", extra=_layout_sql(None), recursive=True))
def edge_geometry(spark, d):
    """Edge midpoints and lengths (no focal path)."""
    t = fx.emb_tree(spark, d)
    e = T.edge_geometry(t, _positions(spark, d, None))
    return e.select("node_id", "parent_id", *[F.round(c, 6).alias(c) for c in
                                              ("mid_x", "mid_y", "mid_z", "length")])


@register("first_label_of", V("""SELECT namespace, node_id, first_label FROM doc_tree
WHERE namespace = 'enwiki_namespace_0' AND node_id = 2""", "doc_tree"))
def first_label_of(spark, d):
    """First-pass label of one node."""
    t = fx.doc_tree(spark, d)
    return Lk.node_by_id(t, "enwiki_namespace_0", 2).select("namespace", "node_id", "first_label")


@register("embed_budget", V("""SELECT namespace, chunk_name, page_id FROM (
  SELECT pl.namespace, pl.chunk_name, pl.page_id,
         row_number() OVER (PARTITION BY pl.namespace ORDER BY pl.chunk_name, pl.page_id) AS rn
  FROM page_log pl WHERE NOT EXISTS (SELECT 1 FROM page_vector pv WHERE pv.namespace = pl.namespace
                                     AND pv.page_id = pl.page_id AND pv.embedding IS NOT NULL)) WHERE rn <= 100""",
                            "page_log", "page_vector"))
def embed_budget(spark, d):
    """An embedding run with a budget of 100 pages per namespace, chunks in order."""
    todo = Lk.pages_needing_embedding(fx.page_log(spark, d), fx.page_vector(spark, d))
    return first_n_per_group(todo, ["namespace"], ["chunk_name", "page_id"], 100).select(
        "namespace", "chunk_name", "page_id")


@register("running_embedded", V("""SELECT namespace, page_id,
       CAST(sum(CASE WHEN embedding IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY namespace ORDER BY page_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running
FROM page_vector""", "page_vector"))
def running_embedded(spark, d):
    """Running count of embedded pages per namespace in page order (block-split running sum)."""
    from canopy.operators.windows import grouped_prefix_sum
    pv = fx.page_vector(spark, d).select("namespace", "page_id",
                                         F.col("embedding").isNotNull().cast("bigint").alias("e"))
    return grouped_prefix_sum(pv, ["namespace"], "page_id", "e", "running", inclusive=True, rows_each=64).select(
        "namespace", "page_id", "running")


@register("metadata_namespaces", V("""SELECT DISTINCT namespace AS identifier,
       regexp_extract(namespace, '^([a-z]+)wiki', 1) AS in_language FROM page_log""", "page_log"))
def metadata_namespaces(spark, d):
    """A metadata list (JSON array document) of the namespaces in storage, read back."""
    from canopy.sources.dims import metadata_list
    from canopy.sources.scratch import scratch_dir
    root = scratch_dir(spark, "meta")
    ns = fx.page_log(spark, d).select("namespace").distinct()
    doc = ns.agg(F.to_json(F.array_sort(F.collect_list(F.struct(
        F.col("namespace").alias("identifier"),
        F.regexp_extract("namespace", r"^([a-z]+)wiki", 1).alias("in_language"))))).alias("value"))
    doc.coalesce(1).write.mode("overwrite").text(root)
    return metadata_list(spark, root, "identifier string, in_language string")
