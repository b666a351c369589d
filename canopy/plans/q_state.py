"""Catalogue: incremental state."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy import fixtures as fx
from canopy import tables
from canopy.operators import state as S
from canopy.operators.versions import VersionedTable
from canopy.plans.registry import register
from canopy.sources.scratch import scratch_dir

EN = "enwiki_namespace_0"
V = fx.with_views


#: When the pages of the log, and those of the HTML batch, were read.
FIRST_READ, SECOND_READ = "2025-10-01 00:00:00", "2025-11-01 00:00:00"


def _stamped(pages, at):
    return pages.withColumn("extracted_at", F.to_timestamp_ntz(F.lit(at)))


def _pages(spark, d):
    return _stamped(fx.page_log(spark, d), FIRST_READ), _stamped(fx.page_batch(spark, d), SECOND_READ)


_UPSERTED = f"""SELECT namespace, page_id, title, chunk_name, url, abstract, extracted_at FROM (
  SELECT *, row_number() OVER (PARTITION BY namespace, page_id ORDER BY src DESC) AS rn FROM (
    SELECT *, TIMESTAMP '{FIRST_READ}' AS extracted_at, 0 AS src FROM page_log
    UNION ALL SELECT *, TIMESTAMP '{SECOND_READ}' AS extracted_at, 1 AS src FROM page_batch)) WHERE rn = 1"""


@register("upsert_pages", V(_UPSERTED, "page_log", "page_batch"))
def upsert_pages(spark, d):
    """M1: the HTML page batch upserted into the page log, its pages stamped anew."""
    log, batch = _pages(spark, d)
    return S.upsert(log, batch, ["namespace", "page_id"])


@register("versioned_pages", V(f"""SELECT namespace, page_id, title, chunk_name,
  CASE WHEN page_id % 3 = 0 THEN concat(url, '?moved') ELSE url END AS url, abstract, extracted_at
FROM ({_UPSERTED}) WHERE page_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""", "page_log", "page_batch"))
def versioned_pages(spark, d):
    """M1, M4, M8 on a table in versions: upsert, delete and column update, each rewriting its key buckets only."""
    log, batch = _pages(spark, d)
    table = VersionedTable.create(scratch_dir(spark, "pages"), log, ["namespace", "page_id"], buckets=16)
    table.upsert(batch)
    toxic = tables.read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id"))
    table.delete(table.read().join(toxic, "page_id", "left_semi").select("namespace", "page_id"))
    table.merge_columns(table.read().where("page_id % 3 = 0").select(
        "namespace", "page_id", F.concat("url", F.lit("?moved")).alias("url")), ["url"])
    return table.read()


_NEW_CHUNKS = ("nc", """SELECT namespace, chunk_name, concat('/archive2/', chunk_name, '.tar.gz') AS chunk_archive_path,
       CAST(NULL AS VARCHAR) AS chunk_extracted_path, CAST(NULL AS TIMESTAMP) AS downloaded_at,
       CAST(NULL AS TIMESTAMP) AS unpacked_at
FROM (SELECT DISTINCT namespace, chunk_name FROM page_log UNION SELECT DISTINCT namespace, chunk_name FROM page_batch)""")


@register("upsert_chunks", V("""SELECT coalesce(o.namespace, n.namespace) AS namespace,
       coalesce(o.chunk_name, n.chunk_name) AS chunk_name,
       CASE WHEN o.chunk_name IS NULL THEN n.chunk_archive_path ELSE o.chunk_archive_path END AS chunk_archive_path,
       CASE WHEN o.chunk_name IS NULL THEN n.chunk_extracted_path ELSE o.chunk_extracted_path END AS chunk_extracted_path,
       CASE WHEN o.chunk_name IS NULL THEN n.downloaded_at WHEN n.chunk_name IS NULL THEN o.downloaded_at END
         IS NOT NULL AS downloaded,
       CASE WHEN o.chunk_name IS NULL THEN n.unpacked_at WHEN n.chunk_name IS NULL THEN o.unpacked_at END
         IS NOT NULL AS unpacked
FROM chunk_log o FULL JOIN nc n ON n.namespace = o.namespace AND n.chunk_name = o.chunk_name""",
                             "chunk_log", "page_log", "page_batch", extra=[_NEW_CHUNKS]))
def upsert_chunks(spark, d):
    """M2: a manifest re-announcing every known chunk plus the HTML batch chunks."""
    pl, pb = fx.page_log(spark, d), fx.page_batch(spark, d)
    names = pl.select("namespace", "chunk_name").union(pb.select("namespace", "chunk_name")).distinct()
    new = names.select("namespace", "chunk_name",
                       F.concat(F.lit("/archive2/"), "chunk_name", F.lit(".tar.gz")).alias("chunk_archive_path"),
                       F.lit(None).cast("string").alias("chunk_extracted_path"),
                       F.lit(None).cast("timestamp_ntz").alias("downloaded_at"),
                       F.lit(None).cast("timestamp_ntz").alias("unpacked_at"))
    out = S.upsert_chunks(fx.chunk_log(spark, d), new)
    return out.select("namespace", "chunk_name", "chunk_archive_path", "chunk_extracted_path",
                      F.col("downloaded_at").isNotNull().alias("downloaded"),
                      F.col("unpacked_at").isNotNull().alias("unpacked"))


@register("upsert_embeddings", V("""SELECT coalesce(o.namespace, n.namespace) AS namespace,
       coalesce(o.page_id, n.page_id) AS page_id,
       list_transform(CASE WHEN n.page_id IS NOT NULL THEN n.embedding ELSE o.embedding END,
                      lambda x: round(CAST(x AS DOUBLE), 6) + 0.0) AS embedding,
       o.cluster_node_id
FROM page_vector o FULL JOIN (
  SELECT concat(d.lang, 'wiki_namespace_0') AS namespace, e.vec_id AS page_id, list_reverse(e.embedding) AS embedding
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id) n
ON n.namespace = o.namespace AND n.page_id = o.page_id""", "page_vector"))
def upsert_embeddings(spark, d):
    """M3: a re-embedding batch (reversed vectors) merged into the vector table; other columns kept."""
    doc = tables.read(spark, d, "documents").select("doc_id", "lang")
    emb = tables.read(spark, d, "embeddings")
    new = emb.join(doc, emb.vec_id == doc.doc_id).select(
        F.concat("lang", F.lit("wiki_namespace_0")).alias("namespace"), F.col("vec_id").alias("page_id"),
        F.reverse("embedding").alias("embedding"))
    out = S.merge_columns(fx.page_vector(spark, d), new, ["namespace", "page_id"], ["embedding"], insert_missing=True)
    whole = F.transform("embedding", lambda x: F.round(x.cast("double"), 6) + F.lit(0.0))
    return out.select("namespace", "page_id", whole.alias("embedding"), "cluster_node_id")


@register("apply_updates", V("""SELECT pv.namespace, pv.page_id,
       CASE WHEN l.doc_id IS NOT NULL THEN CAST(100 + l.quality * 2 + l.toxic AS BIGINT) ELSE pv.cluster_node_id END
         AS cluster_node_id
FROM page_vector pv LEFT JOIN labels l ON l.doc_id = pv.page_id""", "page_vector"))
def apply_updates(spark, d):
    """M4: keyed node re-assignment from the labels table."""
    lab = tables.read(spark, d, "labels")
    pv = fx.page_vector(spark, d)
    ch = pv.select("namespace", "page_id").join(lab, pv.page_id == lab.doc_id).select(
        "namespace", "page_id", (F.lit(100) + F.col("quality") * 2 + F.col("toxic")).cast("bigint")
        .alias("cluster_node_id"))
    return S.merge_columns(pv, ch, ["namespace", "page_id"], ["cluster_node_id"]).select(
        "namespace", "page_id", "cluster_node_id")


@register("insert_nodes", V("""SELECT namespace, node_id, parent_id, depth, final_label FROM doc_tree
UNION ALL SELECT namespace, max(node_id) + 1, CAST(1 AS BIGINT), 1, 'New topic' FROM doc_tree GROUP BY namespace""",
                            "doc_tree"))
def insert_nodes(spark, d):
    """M5: one new child of the root per namespace, id = max + 1."""
    t = fx.doc_tree(spark, d).select("namespace", "node_id", "parent_id", "depth", "final_label")
    new = t.groupBy("namespace").agg((F.max("node_id") + 1).alias("node_id")).select(
        "namespace", "node_id", F.lit(1).cast("bigint").alias("parent_id"), F.lit(1).alias("depth"),
        F.lit("New topic").alias("final_label"))
    return S.insert_nodes(t, new)


@register("reset_tree", V(f"""SELECT namespace, page_id,
       CASE WHEN namespace = '{EN}' THEN NULL ELSE cluster_node_id END AS cluster_node_id FROM page_vector""",
                          "page_vector"))
def reset_tree(spark, d):
    """M6: clustering reset for one namespace (assignments cleared)."""
    _, pv = S.reset_tree(fx.doc_tree(spark, d), fx.page_vector(spark, d), EN)
    return pv.select("namespace", "page_id", "cluster_node_id")


@register("reset_tree_nodes", V(f"SELECT namespace, node_id FROM doc_tree WHERE namespace <> '{EN}'", "doc_tree"))
def reset_tree_nodes(spark, d):
    t, _ = S.reset_tree(fx.doc_tree(spark, d), fx.page_vector(spark, d), EN)
    return t.select("namespace", "node_id")


@register("clear_labels", V(f"""SELECT namespace, node_id,
       CASE WHEN namespace = '{EN}' THEN NULL ELSE first_label END AS first_label,
       CASE WHEN namespace = '{EN}' THEN NULL ELSE final_label END AS final_label FROM doc_tree""", "doc_tree"))
def clear_labels(spark, d):
    """L9."""
    return S.clear_labels(fx.doc_tree(spark, d), EN).select("namespace", "node_id", "first_label", "final_label")


@register("cascade_delete", V("""SELECT pv.namespace, pv.page_id, pv.cluster_node_id FROM page_vector pv
WHERE pv.page_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""", "page_vector"))
def cascade_delete(spark, d):
    """M8: toxic-labelled pages deleted; their vector rows go with them."""
    lab = tables.read(spark, d, "labels").where(F.col("toxic") == 1)
    pl = fx.page_log(spark, d)
    deleted = pl.join(lab, pl.page_id == lab.doc_id, "left_semi").select("namespace", "page_id")
    _, pv = S.cascade_delete(pl, fx.page_vector(spark, d), deleted)
    return pv.select("namespace", "page_id", "cluster_node_id")


@register("chunk_transition", V("""SELECT namespace, count(*) AS chunks, count(downloaded_at) AS downloaded
FROM (SELECT namespace, chunk_name, coalesce(downloaded_at, TIMESTAMP '2025-11-01 00:00:00') AS downloaded_at
      FROM chunk_log) GROUP BY namespace""", "chunk_log"))
def chunk_transition(spark, d):
    """M7: stamp every chunk still waiting for download, then report status."""
    cl = fx.chunk_log(spark, d)
    todo = cl.where(F.col("downloaded_at").isNull()).select(
        "namespace", "chunk_name", F.to_timestamp_ntz(F.lit("2025-11-01 00:00:00")).alias("downloaded_at"))
    out = S.merge_columns(cl, todo, ["namespace", "chunk_name"], ["downloaded_at"])
    return out.groupBy("namespace").agg(F.count("*").alias("chunks"), F.count("downloaded_at").alias("downloaded"))
