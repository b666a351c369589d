"""Catalogue: lookups, joins, ordering, set operations, status (B, C, D, F, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy import fixtures as fx
from canopy.functions import lang
from canopy.operators import lookup as L
from canopy.operators import status as St
from canopy.plans.registry import register

EN = "enwiki_namespace_0"
V = fx.with_views


# --- B ----------------------------------------------------------------------

@register("page_by_id", V(f"SELECT * FROM page_log WHERE namespace = '{EN}' AND page_id = 1 LIMIT 1", "page_log"))
def page_by_id(spark, d):
    return L.page_by_id(fx.page_log(spark, d), EN, 1)


@register("node_by_id", V("SELECT * FROM geo_tree WHERE namespace = 'geo' AND node_id = 9", "geo_tree"))
def node_by_id(spark, d):
    return L.node_by_id(fx.geo_tree(spark, d), "geo", 9)


@register("root_node", V("SELECT * FROM geo_tree WHERE parent_id IS NULL", "geo_tree"))
def root_node(spark, d):
    return L.root_node(fx.geo_tree(spark, d))


@register("parent_id_of", V("SELECT namespace, node_id, parent_id FROM geo_tree WHERE namespace = 'geo' AND node_id = 40",
                            "geo_tree"))
def parent_id_of(spark, d):
    return L.parent_id_of(fx.geo_tree(spark, d), "geo", 40)


@register("node_view", V("""SELECT namespace, node_id, parent_id, depth,
       coalesce(final_label, first_label, concat('Node ', CAST(node_id AS VARCHAR))) AS label,
       child_count = 0 AS is_leaf, CASE WHEN node_id % 5 = 4 THEN node_id * 0.5 ELSE 0 END::DOUBLE AS x,
       CASE WHEN node_id % 5 = 4 THEN -node_id ELSE 0 END::DOUBLE AS y, CASE WHEN node_id % 5 = 4 THEN depth ELSE 0 END::DOUBLE AS z
FROM doc_tree""", "doc_tree"))
def node_view(spark, d):
    """Nodes with no position, one too short, a NaN, an infinite one (all at the origin) and a good one."""
    at, n = F.array((F.col("node_id") * 0.5).cast("double"), (-F.col("node_id")).cast("double"), F.col("depth").cast("double")), F.col("node_id") % 5

    def spoiled(v):
        return F.concat(F.slice(at, 1, 2), F.array(F.lit(float(v))))

    return L.node_view(fx.doc_tree(spark, d).withColumn("centroid_3d", F.when(n == 1, F.slice(at, 1, 2)).when(n == 2, spoiled("nan"))
                                                        .when(n == 3, spoiled("-inf")).when(n == 4, at)))


@register("vector_scan", V("""SELECT namespace, page_id, cluster_node_id FROM page_vector
WHERE embedding IS NOT NULL AND cluster_node_id IS NOT NULL""", "page_vector"))
def vector_scan(spark, d):
    """Rows whose listed columns are all present (partitions replace batches)."""
    return fx.page_vector(spark, d).dropna(subset=["embedding", "cluster_node_id"]).select(
        "namespace", "page_id", "cluster_node_id")


@register("node_vectors", V(f"""SELECT page_id, embedding FROM page_vector
WHERE namespace = '{EN}' AND cluster_node_id = 3 AND embedding IS NOT NULL""", "page_vector"))
def node_vectors(spark, d):
    """Vectors of one node."""
    pv = fx.page_vector(spark, d)
    return pv.where((F.col("namespace") == EN) & (F.col("cluster_node_id") == 3) & F.col("embedding").isNotNull()) \
        .select("page_id", "embedding")


@register("chunks_to_download", V("""SELECT namespace, chunk_name FROM chunk_log WHERE downloaded_at IS NULL
ORDER BY namespace, chunk_name LIMIT 1000""", "chunk_log"))
def chunks_to_download(spark, d):
    """B2 (limit = batch size of the command)."""
    return (fx.chunk_log(spark, d).where(F.col("downloaded_at").isNull()).select("namespace", "chunk_name")
            .orderBy("namespace", "chunk_name").limit(1000))


@register("chunks_to_unpack", V("""SELECT namespace, chunk_name, chunk_archive_path FROM chunk_log
WHERE chunk_archive_path IS NOT NULL AND chunk_extracted_path IS NULL""", "chunk_log"))
def chunks_to_unpack(spark, d):
    """B3."""
    return fx.chunk_log(spark, d).where(
        F.col("chunk_archive_path").isNotNull() & F.col("chunk_extracted_path").isNull()).select(
        "namespace", "chunk_name", "chunk_archive_path")


@register("page_like_search", V("""SELECT namespace, page_id, title, url FROM page_log
WHERE contains(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the')
   OR contains(translate(coalesce(abstract, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the')
ORDER BY title, page_id LIMIT 50 OFFSET 10""", "page_log"))
def page_like_search(spark, d):
    """B13 over whole titles and abstracts."""
    return L.search_pages_like(fx.page_log(spark, d), "the", "both", limit=50, offset=10)


@register("page_like_total", V("""SELECT namespace, count(*) AS total_count FROM page_log
WHERE contains(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the')
   OR contains(translate(coalesce(abstract, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the')
GROUP BY namespace""", "page_log"))
def page_like_total(spark, d):
    """The total count beside a page search."""
    return L.count_pages_like(fx.page_log(spark, d), "the", "both")


@register("title_suggest_accents", V("""SELECT DISTINCT title FROM page_log
WHERE starts_with(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  translate((SELECT substring(title, 1, 3) FROM page_log WHERE NOT regexp_matches(substring(title, 1, 3), '^[ -~]*$')
             ORDER BY page_id LIMIT 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
ORDER BY title LIMIT 10""", "page_log"))
def title_suggest_accents(spark, d):
    """Suggestions for a prefix with a letter beyond ASCII (the first title's that has one)."""
    pl = fx.page_log(spark, d)
    first = pl.where(~F.col("title").substr(1, 3).rlike("^[ -~]*$")).orderBy("page_id").select("title").first()
    return L.title_suggestions(pl, first.title[:3], 10) if first else pl.select("title").limit(0)


@register("title_suggest", V("""SELECT DISTINCT title FROM page_log
WHERE starts_with(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'th')
ORDER BY title LIMIT 10""", "page_log"))
def title_suggest(spark, d):
    """B15."""
    return L.title_suggestions(fx.page_log(spark, d), "th", 10)


@register("articles_by_name", V("""SELECT namespace, page_id, title, url FROM page_log
WHERE title = (SELECT title FROM page_log WHERE page_id = (SELECT min(page_id) FROM page_log))""", "page_log"))
def articles_by_name(spark, d):
    """Every page (any project) whose name equals the name of the first page."""
    pl = fx.page_log(spark, d)
    name = pl.orderBy("page_id").select("title").limit(1)
    return pl.join(name, "title", "left_semi").select("namespace", "page_id", "title", "url")


# --- C ----------------------------------------------------------------------

@register("page_detail", V(f"""SELECT pl.namespace, pl.page_id, pl.title, pl.url, pl.abstract, pv.cluster_node_id,
       pv.embedding IS NOT NULL AS has_embedding
FROM page_log pl JOIN page_vector pv ON pv.namespace = pl.namespace AND pv.page_id = pl.page_id
WHERE pl.namespace = '{EN}' AND pl.page_id = 1""", "page_log", "page_vector"))
def page_detail(spark, d):
    return L.page_detail(fx.page_log(spark, d), fx.page_vector(spark, d), EN, 1)


@register("pages_in_cluster", V(f"""SELECT pl.namespace, pl.page_id, pl.title, pl.url
FROM page_vector pv JOIN page_log pl ON pl.namespace = pv.namespace AND pl.page_id = pv.page_id
WHERE pv.namespace = '{EN}' AND pv.cluster_node_id = 2 ORDER BY pl.page_id LIMIT 20 OFFSET 5""",
                                "page_log", "page_vector"))
def pages_in_cluster(spark, d):
    return L.pages_in_cluster(fx.page_log(spark, d), fx.page_vector(spark, d), EN, 2, limit=20, offset=5)


@register("needs_embedding", V("""SELECT pl.namespace, pl.page_id, pl.chunk_name FROM page_log pl
WHERE NOT EXISTS (SELECT 1 FROM page_vector pv WHERE pv.namespace = pl.namespace AND pv.page_id = pl.page_id
                  AND pv.embedding IS NOT NULL)""", "page_log", "page_vector"))
def needs_embedding(spark, d):
    return L.pages_needing_embedding(fx.page_log(spark, d), fx.page_vector(spark, d))


@register("chunks_needing_embedding", V("""SELECT DISTINCT pl.namespace, pl.chunk_name FROM page_log pl
WHERE NOT EXISTS (SELECT 1 FROM page_vector pv WHERE pv.namespace = pl.namespace AND pv.page_id = pl.page_id
                  AND pv.embedding IS NOT NULL) ORDER BY 1, 2""", "page_log", "page_vector"))
def chunks_needing_embedding(spark, d):
    return L.chunks_needing_embedding(fx.page_log(spark, d), fx.page_vector(spark, d))


@register("page_content_500", V("""SELECT pl.namespace, pl.page_id, pv.cluster_node_id AS node_id, pl.title,
       substring(pl.abstract, 1, 500) AS abstract
FROM page_vector pv JOIN page_log pl ON pl.namespace = pv.namespace AND pl.page_id = pv.page_id
WHERE pv.cluster_node_id IS NOT NULL""", "page_log", "page_vector"))
def page_content_500(spark, d):
    return L.page_content(fx.page_log(spark, d), fx.page_vector(spark, d), 500)


@register("siblings", V("""SELECT t.* FROM geo_tree t JOIN geo_tree me ON me.namespace = t.namespace
  AND me.parent_id = t.parent_id WHERE me.namespace = 'geo' AND me.node_id = 9 AND t.node_id <> 9""", "geo_tree"))
def siblings(spark, d):
    return L.siblings(fx.geo_tree(spark, d), "geo", 9)


@register("parent", V("""SELECT p.* FROM geo_tree p JOIN geo_tree me ON me.namespace = p.namespace
  AND me.parent_id = p.node_id WHERE me.namespace = 'geo' AND me.node_id = 40""", "geo_tree"))
def parent(spark, d):
    return L.parent_of(fx.geo_tree(spark, d), "geo", 40)


@register("sibling_first_labels", V("""SELECT t.namespace, string_agg(t.final_label, ', ' ORDER BY t.node_id)
         AS neighbour_labels, count(*) AS n_labels
FROM geo_tree t JOIN geo_tree me ON me.namespace = t.namespace AND me.parent_id = t.parent_id
WHERE me.namespace = 'geo' AND me.node_id = 9 AND t.node_id <> 9 AND t.final_label IS NOT NULL
GROUP BY t.namespace""", "geo_tree"))
def sibling_first_labels(spark, d):
    """C9 (first label = the fixture's label)."""
    t = fx.geo_tree(spark, d).withColumn("first_label", F.col("final_label"))
    return L.sibling_first_labels(t, "geo", 9)


@register("leaf_nodes", V("""SELECT * FROM geo_tree t WHERE NOT EXISTS
  (SELECT 1 FROM geo_tree c WHERE c.namespace = t.namespace AND c.parent_id = t.node_id)""", "geo_tree"))
def leaf_nodes(spark, d):
    return L.leaf_nodes(fx.geo_tree(spark, d))


@register("namespace_language", V("""SELECT n.namespace, l.code, l.language, l.local_name
FROM (SELECT DISTINCT namespace FROM page_log) n LEFT JOIN languages l ON l.namespace = n.namespace""",
                                  "page_log", "languages"))
def namespace_language(spark, d):
    """Namespaces present in storage with their language."""
    ns = fx.page_log(spark, d).select("namespace").distinct()
    return lang.with_language(ns, lang.languages(spark)).select("namespace", "code", "language", "local_name")


# --- F / G ------------------------------------------------------------------

@register("children", V("SELECT * FROM geo_tree WHERE namespace = 'geo' AND parent_id = 2 ORDER BY node_id",
                        "geo_tree"))
def children(spark, d):
    return L.children(fx.geo_tree(spark, d), "geo", 2)


@register("children_batch", V("""SELECT namespace, parent_id, list_sort(list(node_id)) AS child_ids, count(*) AS n_children
FROM geo_tree WHERE parent_id IS NOT NULL GROUP BY namespace, parent_id""", "geo_tree"))
def children_batch(spark, d):
    return L.children_lists(fx.geo_tree(spark, d))


@register("neighbourhood", V("""SELECT namespace, node_id, parent_id, depth, final_label, 'self' AS role FROM geo_tree
WHERE namespace = 'geo' AND node_id = 9
UNION ALL SELECT namespace, node_id, parent_id, depth, final_label, 'child' FROM geo_tree
WHERE namespace = 'geo' AND parent_id = 9
UNION ALL SELECT p.namespace, p.node_id, p.parent_id, p.depth, p.final_label, 'parent' FROM geo_tree p
JOIN geo_tree me ON me.namespace = p.namespace AND me.parent_id = p.node_id WHERE me.namespace = 'geo' AND me.node_id = 9""",
                             "geo_tree"))
def neighbourhood(spark, d):
    return L.neighbourhood(fx.geo_tree(spark, d), "geo", 9, ["namespace", "node_id", "parent_id", "depth", "final_label"])


@register("sibling_groups", V("""SELECT t.namespace, t.node_id, s.n > 1 AS has_siblings FROM geo_tree t
JOIN (SELECT namespace, parent_id, count(*) AS n FROM geo_tree WHERE parent_id IS NOT NULL GROUP BY 1, 2) s
  ON s.namespace = t.namespace AND s.parent_id = t.parent_id""", "geo_tree"))
def sibling_groups(spark, d):
    """The work-list split, as one flagged table."""
    with_s, only = L.sibling_groups(fx.geo_tree(spark, d))
    return (with_s.select("namespace", "node_id", F.lit(True).alias("has_siblings"))
            .unionByName(only.select("namespace", "node_id", F.lit(False).alias("has_siblings"))))


# --- D ----------------------------------------------------------------------

@register("status_chunks", V("""SELECT namespace, count(*) AS total_chunks, count(downloaded_at) AS downloaded,
       count(unpacked_at) AS extracted FROM chunk_log GROUP BY namespace""", "chunk_log"))
def status_chunks(spark, d):
    return St.chunk_status(fx.chunk_log(spark, d))


@register("status_pages", V("""SELECT coalesce(a.namespace, b.namespace) AS namespace, coalesce(a.total_pages, 0) AS total_pages,
       coalesce(b.with_embedding, 0) AS with_embedding, coalesce(b.with_cluster_node_id, 0) AS with_cluster_node_id
FROM (SELECT namespace, count(*) AS total_pages FROM page_log GROUP BY 1) a
FULL JOIN (SELECT namespace, count(embedding) AS with_embedding, count(cluster_node_id) AS with_cluster_node_id
           FROM page_vector GROUP BY 1) b ON a.namespace = b.namespace""", "page_log", "page_vector"))
def status_pages(spark, d):
    return St.page_status(fx.page_log(spark, d), fx.page_vector(spark, d))


_GEO_PARTIAL = "SELECT namespace, node_id, parent_id, depth, CASE WHEN depth < 3 THEN final_label END AS first_label, " \
               "CASE WHEN depth < 2 THEN final_label END AS final_label FROM geo_tree"


def _geo_partial(spark, d):
    t = fx.geo_tree(spark, d)
    return t.select("namespace", "node_id", "parent_id", "depth",
                    F.when(F.col("depth") < 3, F.col("final_label")).alias("first_label"),
                    F.when(F.col("depth") < 2, F.col("final_label")).alias("final_label"))


@register("status_labels", V("""SELECT namespace, count(*) AS nodes,
       CAST(count_if(coalesce(first_label, '') <> '') AS BIGINT) AS first_labelled,
       CAST(count_if(coalesce(final_label, '') <> '') AS BIGINT) AS final_labelled FROM gp GROUP BY namespace""",
                             "geo_tree", extra=[("gp", _GEO_PARTIAL)]))
def status_labels(spark, d):
    return St.label_status(_geo_partial(spark, d))


@register("depth_histogram", V("SELECT namespace, depth, count(*) AS nodes FROM geo_tree GROUP BY 1, 2", "geo_tree"))
def depth_histogram(spark, d):
    return St.depth_histogram(fx.geo_tree(spark, d))


@register("chunk_page_counts", V("SELECT namespace, chunk_name, count(*) AS pages FROM page_log GROUP BY 1, 2",
                                 "page_log"))
def chunk_page_counts(spark, d):
    return St.chunk_page_counts(fx.page_log(spark, d))


@register("clusters_pending_projection", V("""SELECT namespace, cluster_node_id AS cluster_id, count(page_id) AS pages FROM page_vector
WHERE cluster_node_id IS NOT NULL AND embedding IS NULL GROUP BY 1, 2""", "page_vector"))
def clusters_pending_projection(spark, d):
    """Pages of every cluster that still wait for a position (pages without a vector have none)."""
    pv = fx.page_vector(spark, d).withColumn("three_d", F.col("embedding"))
    return St.clusters_pending(pv, "cluster_node_id", "three_d")


@register("vector_counts", V("""SELECT coalesce(e.namespace, m.namespace) AS namespace, e.embeddings, m.max_node_id
FROM (SELECT namespace, count(embedding) AS embeddings FROM page_vector GROUP BY 1) e
FULL JOIN (SELECT namespace, max(node_id) AS max_node_id FROM doc_tree GROUP BY 1) m ON e.namespace = m.namespace""",
                             "page_vector", "doc_tree"))
def vector_counts(spark, d):
    return St.vector_counts(fx.page_vector(spark, d), fx.doc_tree(spark, d))


@register("namespaces_distinct", V("""SELECT DISTINCT namespace FROM (SELECT namespace FROM page_log UNION ALL
SELECT namespace FROM geo_tree UNION ALL SELECT namespace FROM emb_tree)""", "page_log", "geo_tree", "emb_tree"))
def namespaces_distinct(spark, d):
    return St.namespaces(fx.page_log(spark, d), fx.geo_tree(spark, d), fx.emb_tree(spark, d))


@register("tree_summary", V("""SELECT namespace, count(*) AS nodes, CAST(count_if(NOT is_parent) AS BIGINT) AS leaves,
       CAST(count_if(is_parent) AS BIGINT) AS stems FROM (
  SELECT t.namespace, t.node_id, EXISTS (SELECT 1 FROM allt c WHERE c.namespace = t.namespace
                                        AND c.parent_id = t.node_id) AS is_parent FROM allt t) x GROUP BY namespace""",
                            "geo_tree", "doc_tree",
                            extra=[("allt", "SELECT namespace, node_id, parent_id FROM geo_tree UNION ALL "
                                            "SELECT namespace, node_id, parent_id FROM doc_tree")]))
def tree_summary(spark, d):
    t = fx.geo_tree(spark, d).select("namespace", "node_id", "parent_id").unionByName(
        fx.doc_tree(spark, d).select("namespace", "node_id", "parent_id"))
    return St.tree_summary(t)
