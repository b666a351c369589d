"""Catalogue: closed-form vector operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy import fixtures as fx
from canopy import tables
from canopy.operators import vectors as Vx
from canopy.plans.registry import register


def V(body, *views, extra=()):
    return fx.with_views(body, *views, extra=list(extra))


# exploded embeddings in SQL: (page_id, label, i, x)
EMB_LONG = ("el", """SELECT vec_id AS page_id, label, i, CAST(x AS DOUBLE) AS x FROM (
  SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)""")
LEAF_MEAN = ("lm", "SELECT label, i, avg(x) AS v, count(*) AS n FROM el GROUP BY label, i")


def _emb_pages(spark, d, node_expr):
    return fx.emb_page(spark, d).select("namespace", "page_id", node_expr.cast("bigint").alias("node_id"),
                                        F.col("embedding").alias("vec"), "label")


@register("leaf_centroids", V("""SELECT 'emb' AS namespace, CAST(5 + label AS BIGINT) AS node_id,
       list(round(v, 6) ORDER BY i) AS centroid, max(n) AS n FROM lm GROUP BY label""", extra=[EMB_LONG, LEAF_MEAN]))
def leaf_centroids(spark, d):
    """Leaves of the embedding tree lack a centroid; inner nodes already carry one."""
    t = fx.emb_tree(spark, d).withColumn(
        "centroid", F.when(F.col("depth") < 2, F.array(F.lit(0.0))).otherwise(F.lit(None).cast("array<double>")))
    pages = _emb_pages(spark, d, F.lit(5) + F.col("label"))
    out = Vx.missing_leaf_centroids(t, pages, "vec", check=True)
    return out.select("namespace", "node_id", Vx.round_vec(F.col("centroid")).alias("centroid"), "n")


@register("node_centroids", V("""SELECT 'emb' AS namespace, node_id, list(round(v, 6) ORDER BY i) AS centroid FROM (
  SELECT CAST(5 + label AS BIGINT) AS node_id, i, v FROM lm
  UNION ALL SELECT CAST(2 + label % 3 AS BIGINT), i, avg(v) FROM lm GROUP BY label % 3, i
  UNION ALL SELECT 1, i, avg(v) FROM (SELECT label % 3 AS g, i, avg(v) AS v FROM lm GROUP BY 1, 2) GROUP BY i)
GROUP BY node_id""", extra=[EMB_LONG, LEAF_MEAN]))
def node_centroids(spark, d):
    """Bottom-up unweighted means of child centroids over the embedding tree."""
    t = fx.emb_tree(spark, d)
    leaves = Vx.group_mean(_emb_pages(spark, d, F.lit(5) + F.col("label")), ["namespace", "node_id"], "vec")
    out = Vx.node_centroids_bottom_up(t, leaves)
    return out.select("namespace", "node_id", Vx.round_vec(F.col("centroid")).alias("centroid"))


_CENTRES = ("ce", "SELECT CAST(2 + label AS BIGINT) AS cid, i, v FROM lm")
_ASSIGN = ("asg", """SELECT page_id, cid, d2 FROM (
  SELECT el.page_id, ce.cid, sum((el.x - ce.v) * (el.x - ce.v)) AS d2,
         row_number() OVER (PARTITION BY el.page_id ORDER BY sum((el.x - ce.v) * (el.x - ce.v)), ce.cid) AS rn
  FROM el JOIN ce ON ce.i = el.i GROUP BY el.page_id, ce.cid) WHERE rn = 1""")


def _assignment(spark, d):
    pts = fx.emb_page(spark, d).select("namespace", F.lit(1).cast("bigint").alias("parent_id"), "page_id",
                                       F.col("embedding").alias("vec"))
    cents = Vx.group_mean(_emb_pages(spark, d, F.lit(2) + F.col("label")), ["namespace", "node_id"], "vec") \
        .select("namespace", F.lit(1).cast("bigint").alias("parent_id"), F.col("node_id").alias("cid"),
                F.col("centroid").alias("vec"))
    return Vx.nearest_centre(pts, cents, ["namespace", "parent_id"], "vec", "cid", dim=64)


@register("nearest_centroid", V("SELECT page_id, cid, round(d2, 6) AS dist2 FROM asg",
                                extra=[EMB_LONG, LEAF_MEAN, _CENTRES, _ASSIGN]))
def nearest_centroid(spark, d):
    """Each vector's nearest leaf centroid under the flat tree's root."""
    return _assignment(spark, d).select("page_id", "cid", F.round("dist2", 6).alias("dist2"))


@register("lloyd_step", V("""SELECT cid, list(round(v, 6) ORDER BY i) AS centroid, max(n) AS n FROM (
  SELECT asg.cid, el.i, avg(el.x) AS v, count(*) AS n FROM asg JOIN el ON el.page_id = asg.page_id
  GROUP BY asg.cid, el.i) GROUP BY cid""", extra=[EMB_LONG, LEAF_MEAN, _CENTRES, _ASSIGN]))
def lloyd_step(spark, d):
    """Recompute centres from that assignment."""
    a = _assignment(spark, d)
    return Vx.lloyd_update(a, ["namespace", "parent_id"], "vec", "cid").select(
        "cid", Vx.round_vec(F.col("vec")).alias("centroid"), "n")


_SIL = [("u", """SELECT vec_id AS page_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
FROM embeddings"""),
        ("un", "SELECT page_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM u"),
        ("pd", """SELECT a.page_id, a.label, b.label AS lb, 1 - list_dot_product(a.v, b.v) AS dist
FROM un a JOIN un b ON a.page_id <> b.page_id"""),
        ("pm", "SELECT page_id, label, lb, avg(dist) AS md FROM pd GROUP BY 1, 2, 3"),
        ("sz", "SELECT label, count(*) AS n FROM embeddings GROUP BY label"),
        ("ps", """SELECT p.page_id, p.label,
  CASE WHEN sz.n <= 1 THEN 0.0 ELSE (b.b - coalesce(a.md, 0)) / greatest(coalesce(a.md, 0), b.b) END AS s
FROM (SELECT DISTINCT page_id, label FROM pm) p JOIN sz ON sz.label = p.label
LEFT JOIN pm a ON a.page_id = p.page_id AND a.lb = p.label
JOIN (SELECT page_id, min(md) AS b FROM pm WHERE lb <> label GROUP BY page_id) b ON b.page_id = p.page_id""")]


def _sil_points(spark, d):
    pts = fx.emb_page(spark, d).select("namespace", "page_id", "label", F.col("embedding").alias("vec"))
    return Vx.silhouette_points(pts, ["namespace"], "label", "vec", dim=64)


@register("cosine_silhouette", V("SELECT label, count(*) AS n, round(avg(s), 6) AS silhouette FROM ps GROUP BY label",
                                 extra=_SIL))
def cosine_silhouette(spark, d):
    """I4: per-cluster mean cosine silhouette of the given labels (exact, all points)."""
    return _sil_points(spark, d).groupBy("label").agg(
        F.count("*").alias("n"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


@register("silhouette_score", V("SELECT count(*) AS n, round(avg(s), 6) AS silhouette FROM ps", extra=_SIL))
def silhouette_score(spark, d):
    return _sil_points(spark, d).agg(F.count("*").alias("n"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


def _shape_values(shapes) -> str:
    return ", ".join(f"({n}, {r}, CAST({x!r} AS DOUBLE), CAST({y!r} AS DOUBLE), CAST({z!r} AS DOUBLE))"
                     for n, r, x, y, z in Vx.shape_rows(shapes))


@register("geometric_projection", V(f"""SELECT t.namespace, t.node_id, round(coalesce(s.x, 0.0), 6) AS x,
       round(coalesce(s.y, 0.0), 6) AS y, round(coalesce(s.z, 0.0), 6) AS z
FROM (SELECT namespace, node_id, parent_id,
        row_number() OVER (PARTITION BY namespace, parent_id ORDER BY node_id) AS rk,
        count(*) OVER (PARTITION BY namespace, parent_id) AS gs FROM emb_tree) t
LEFT JOIN (VALUES {_shape_values(Vx.SIBLING_SHAPES)}) s(gs, rk, x, y, z)
  ON t.parent_id IS NOT NULL AND s.gs = t.gs AND s.rk = t.rk
WHERE t.parent_id IS NULL OR t.gs <= 6""", "emb_tree"))
def geometric_projection(spark, d):
    """I8 (groups <= 6): fixed sibling shapes over the embedding tree."""
    out = Vx.geometric_projection(fx.emb_tree(spark, d))
    return out.select("namespace", "node_id", *[F.round(c, 6).alias(c) for c in ("x", "y", "z")])


@register("log_length_normalise", V("""SELECT vec_id AS page_id, list_transform(v, lambda x: round(x * CASE WHEN n >= 1
    THEN 1 + ln(n) ELSE 1.0 END / greatest(n, 1e-8), 6) + 0.0) AS vec FROM (
  SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS n FROM (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * label / 3.0) AS v FROM embeddings))"""))
def log_length_normalise(spark, d):
    """I9 on vectors of length label/3 (both sides of the length-1 switch)."""
    e = tables.read(spark, d, "embeddings")
    v = Vx.scale(Vx.as_double("embedding"), F.col("label") / F.lit(3.0))
    return e.select(F.col("vec_id").alias("page_id"), Vx.round_vec(Vx.log_length(v)).alias("vec"))


@register("small_set_projection", V(f"""SELECT l.l_orderkey, l.l_linenumber, s.x, s.y, s.z FROM (
  SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rk,
         count(*) OVER (PARTITION BY l_orderkey) AS gs FROM lineitem) l
JOIN (VALUES {_shape_values(Vx.SMALL_SET_SHAPES)}) s(gs, rk, x, y, z) ON s.gs = l.gs AND s.rk = l.rk"""))
def small_set_projection(spark, d):
    """Order lines as point sets; 2-line and 3-line orders get the fixed placements."""
    li = tables.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return Vx.small_set_projection(li, ["l_orderkey"], "l_linenumber")
