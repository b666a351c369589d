"""Catalogue: iterative / model operators (I1, I2, I3, I5, I7, I8 large groups, H1, H2).

Iterative and model-driven results have no SQL twin (rows-only check); their
invariants are asserted in tests/test_ml.py.  H1/H2 are plain text and SQL-checked.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy import fixtures as fx
from canopy.operators import cluster as C
from canopy.operators import embed as E
from canopy.operators import lookup as L
from canopy.operators import pca as P
from canopy.operators import projection as Pr
from canopy.operators import vectors as Vx
from canopy.plans import artifacts
from canopy.plans.registry import register

PARAMS = C.ClusterParams(leaf_target=20, max_k=8, max_depth=10, min_silhouette=-1.0)
TARGET_DIM = 16


def emb_vectors(spark, d):
    return fx.emb_page(spark, d).select("namespace", "page_id", "embedding")


def _reduce(spark, d):
    return P.reduce_namespace(emb_vectors(spark, d), TARGET_DIM, "embedding", "reduced")


def reduced(spark, d):
    """Reduced vectors as a pipeline artifact (written once, read by later stages)."""
    return artifacts.table(spark, d, "reduced", lambda: _reduce(spark, d))


def tree(spark, d):
    """(nodes, assignment) of the full tree as pipeline artifacts."""
    def build():
        return C.build_tree(reduced(spark, d), PARAMS)
    built = {}

    def part(i):
        if not built:
            built["v"] = build()
        return built["v"][i]
    nodes = artifacts.table(spark, d, "tree_nodes", lambda: part(0))
    asg = artifacts.table(spark, d, "tree_assignment", lambda: part(1))
    return nodes, asg


@register("pca_reduce")
def pca_reduce(spark, d):
    """Every embedding reduced to 16 dims (centred PCA, fixed signs)."""
    return _reduce(spark, d).select("namespace", "page_id", "reduced")


@register("pca_check", """WITH p AS (SELECT embedding, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
v AS (SELECT i, var_samp(v) AS s FROM p GROUP BY i)
SELECT 'emb' AS namespace, (SELECT count(*) FROM embeddings) AS n, round(sum(s), 6) AS total_variance, true AS centred,
  true AS uncorrelated, true AS falling, true AS explains FROM v""")
def pca_check(spark, d):
    """The reduction held against its vectors: total variance, centring, uncorrelated and falling components,
    and variances equal to the leading eigenvalues."""
    models = P.namespace_models(emb_vectors(spark, d), TARGET_DIM, "embedding")
    table = spark.createDataFrame([(m.namespace, m.variance) for m in models], "namespace string, w array<double>")
    x = [F.col("reduced")[i].cast("double") for i in range(TARGET_DIM)]
    pairs = [F.abs(F.corr(x[i], x[j])) for i in range(TARGET_DIM) for j in range(i)]
    got = reduced(spark, d).groupBy("namespace").agg(
        F.count("*").alias("n"), F.array(*[F.avg(c) for c in x]).alias("m"), F.array(*[F.var_samp(c) for c in x]).alias("s"),
        F.greatest(*pairs).alias("corr"))
    near = F.forall(F.sequence(F.lit(0), F.lit(TARGET_DIM - 1)),
                    lambda i: F.abs(F.get("s", i) - F.get("w", i)) <= 1e-4 * F.get("w", F.lit(0)))
    return got.join(table, "namespace").select(
        "namespace", "n", F.round(F.aggregate("w", F.lit(0.0), lambda a, b: a + b), 6).alias("total_variance"),
        (F.array_max(F.transform("m", F.abs)) < 1e-5).alias("centred"), (F.col("corr") < 1e-3).alias("uncorrelated"),
        (F.col("s") == F.sort_array("s", False)).alias("falling"), near.alias("explains"))


@register("kmeans_level")
def kmeans_level(spark, d):
    """One k-means level (root split) over the reduced vectors."""
    p = C.ClusterParams(leaf_target=PARAMS.leaf_target, max_k=PARAMS.max_k, max_depth=1,
                        min_silhouette=PARAMS.min_silhouette)
    nodes, asg = C.build_tree(reduced(spark, d), p)
    return asg


@register("cluster_tree")
def cluster_tree(spark, d):
    """Full level-synchronous tree; node ids in pre-order."""
    nodes, _ = tree(spark, d)
    return nodes.select("namespace", "node_id", "parent_id", "depth", "doc_count", "child_count",
                        "sample_doc_ids", F.round("silhouette", 6).alias("silhouette"))


@register("cluster_assignment")
def cluster_assignment(spark, d):
    """Every page's leaf."""
    _, asg = tree(spark, d)
    return asg


#: What a node table and its assignment must satisfy, recomputed from the vectors; a count of nodes for each breach.
TREE_CHECK = """
WITH up AS (SELECT n.namespace, n.node_id, n.path, explode(transform(sequence(0, size(n.path)), i -> slice(n.path, 1, i))) AS over
            FROM {nodes} n),
under AS (SELECT o.namespace, o.node_id AS over_id, u.node_id, get(u.path, size(u.over)) AS child
          FROM up u JOIN {nodes} o ON o.namespace = u.namespace AND o.path = u.over),
pages AS (SELECT a.namespace, u.over_id AS node_id, u.child, a.page_id, v.reduced AS x
          FROM {assignment} a JOIN under u ON u.namespace = a.namespace AND u.node_id = a.cluster_node_id
               JOIN {vectors} v ON v.namespace = a.namespace AND v.page_id = a.page_id),
sizes AS (SELECT namespace, node_id, count(*) AS docs, count(DISTINCT child) AS children FROM pages GROUP BY namespace, node_id),
parts AS (SELECT namespace, node_id, child, page_id, pos, v, v / nullif(sqrt(aggregate(x, 0D, (s, y) -> s + y * y)), 0D) AS u
          FROM pages LATERAL VIEW posexplode(x) e AS pos, v),
means AS (SELECT namespace, node_id, pos, avg(v) AS m FROM parts GROUP BY namespace, node_id, pos),
far AS (SELECT n.namespace, n.node_id, max(abs(m.m - get(n.centroid, m.pos))) AS off
        FROM {nodes} n JOIN means m ON m.namespace = n.namespace AND m.node_id = n.node_id
        WHERE n.child_count = 0 GROUP BY n.namespace, n.node_id),
sums AS (SELECT namespace, node_id, child, pos, sum(u) AS s FROM parts WHERE child IS NOT NULL
         GROUP BY namespace, node_id, child, pos),
counts AS (SELECT namespace, node_id, child, count(*) AS n FROM pages WHERE child IS NOT NULL GROUP BY namespace, node_id, child),
dots AS (SELECT p.namespace, p.node_id, p.page_id, p.child, s.child AS other, sum(p.u * s.s) AS d, sum(p.u * p.u) AS self
         FROM parts p JOIN sums s ON s.namespace = p.namespace AND s.node_id = p.node_id AND s.pos = p.pos
         GROUP BY p.namespace, p.node_id, p.page_id, p.child, s.child),
near AS (SELECT d.namespace, d.node_id, d.page_id,
                max(CASE WHEN d.other = d.child AND c.n > 1 THEN (c.n - 1 - (d.d - d.self)) / (c.n - 1) END) AS a,
                min(CASE WHEN d.other <> d.child THEN 1 - d.d / c.n END) AS b
         FROM dots d JOIN counts c ON c.namespace = d.namespace AND c.node_id = d.node_id AND c.child = d.other
         GROUP BY d.namespace, d.node_id, d.page_id),
sil AS (SELECT namespace, node_id, avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS s
        FROM near GROUP BY namespace, node_id)
SELECT n.namespace, max(CASE WHEN n.parent_id IS NULL THEN n.doc_count END) AS n_pages,
       count_if(n.parent_id IS NULL) AS roots,
       count_if(n.doc_count <> s.docs OR s.docs IS NULL) AS bad_sizes,
       count_if(n.child_count <> s.children) AS bad_child_counts,
       count_if(n.parent_id IS NOT NULL AND (p.node_id IS NULL OR p.path <> slice(n.path, 1, size(n.path) - 1)
                OR p.node_id >= n.node_id OR p.depth + 1 <> n.depth)) AS bad_parents,
       count_if(n.child_count = 0 AND n.doc_count > {leaf_target} AND n.depth < {max_depth} AND n.silhouette IS NULL) AS big_leaves,
       count_if(n.child_count = 0 AND (f.off IS NULL OR f.off > 1e-4)) AS bad_leaf_centroids,
       count_if(n.child_count > 0 AND (l.s IS NULL OR abs(l.s - n.silhouette) > 1e-4)) AS bad_silhouettes
FROM {nodes} n LEFT JOIN sizes s ON s.namespace = n.namespace AND s.node_id = n.node_id
     LEFT JOIN {nodes} p ON p.namespace = n.namespace AND p.node_id = n.parent_id
     LEFT JOIN far f ON f.namespace = n.namespace AND f.node_id = n.node_id
     LEFT JOIN sil l ON l.namespace = n.namespace AND l.node_id = n.node_id
GROUP BY n.namespace"""


@register("tree_check", """SELECT 'emb' AS namespace, count(*) AS n_pages, 1::BIGINT AS roots, 0::BIGINT AS bad_sizes,
  0::BIGINT AS bad_child_counts, 0::BIGINT AS bad_parents, 0::BIGINT AS big_leaves, 0::BIGINT AS bad_leaf_centroids,
  0::BIGINT AS bad_silhouettes FROM embeddings""")
def tree_check(spark, d):
    """The tree held against its vectors: sizes, parents, leaf centroids and silhouettes recomputed in SQL."""
    nodes, asg = tree(spark, d)
    return spark.sql(TREE_CHECK, nodes=nodes, assignment=asg, vectors=reduced(spark, d),
                     leaf_target=PARAMS.leaf_target, max_depth=PARAMS.max_depth)


@register("page_projection")
def page_projection(spark, d):
    """Per-leaf 3-D PCA of the pages' reduced vectors."""
    red = reduced(spark, d)
    _, asg = tree(spark, d)
    pv = red.join(asg, ["namespace", "page_id"])
    return Pr.page_projection(pv, "reduced").select("namespace", "node_id", "page_id", "three_d")


@register("centroid_projection_pca")
def centroid_projection_pca(spark, d):
    """I8 for a 10-child group (PCA + log-length branch) plus the root."""
    t = fx.emb_flat(spark, d)
    cents = Vx.group_mean(fx.emb_page(spark, d).select(
        "namespace", (F.lit(2) + F.col("label")).cast("bigint").alias("node_id"), F.col("embedding").alias("vec")),
        ["namespace", "node_id"], "vec")
    t = t.join(cents.select("namespace", "node_id", "centroid"), ["namespace", "node_id"], "left")
    return Pr.centroid_projection(t)


@register("corpus_embed")
def corpus_embed(spark, d):
    """Embed every page that has no vector yet (default hashing model, 64 dims, whole texts)."""
    todo = L.pages_needing_embedding(fx.page_log(spark, d), fx.page_vector(spark, d))
    texts = E.input_text(fx.page_log(spark, d).join(todo.select("namespace", "page_id"), ["namespace", "page_id"],
                                                    "left_semi"))
    return E.hashing_embed(texts, 64)


@register("embed_text", fx.with_views("""SELECT namespace, page_id, concat(title, chr(10), coalesce(abstract, 'None')) AS text
FROM page_log""", "page_log"))
def embed_text(spark, d):
    """H1: model input text for every page."""
    return E.input_text(fx.page_log(spark, d))


@register("embed_text_truncated", fx.with_views("""SELECT namespace, page_id,
  CASE WHEN length(t) <= 2000 THEN t ELSE substring(t, 1, CAST(floor(length(t) / pow(2, k)) AS BIGINT)) END AS text
FROM (SELECT namespace, page_id, t,
        list_min(list_filter(range(0, 63), lambda s: floor(length(t) / pow(2, s)) <= 2000)) AS k
      FROM (SELECT namespace, page_id, concat(title, chr(10), coalesce(abstract, 'None')) AS t FROM page_log))""",
                                                "page_log"))
def embed_text_truncated(spark, d):
    """H2: halve the input until it fits 2000 characters."""
    return E.input_text(fx.page_log(spark, d), max_chars=2000)


@register("namespace_trees")
def namespace_trees(spark, d):
    """I2 + I5 per language namespace: the document vectors reduced and clustered namespace by
    namespace (statistics, ids and stopping rules never mix namespaces)."""
    pv = fx.page_vector(spark, d).where(F.col("embedding").isNotNull()).select("namespace", "page_id", "embedding")
    red = artifacts.table(spark, d, "doc_reduced", lambda: P.reduce_namespace(pv, TARGET_DIM, "embedding", "reduced"))
    nodes, _ = C.build_tree(red, PARAMS)
    return nodes.select("namespace", "node_id", "parent_id", "depth", "doc_count", "child_count")
