"""Catalogue: sources and sinks.

Each query writes its input files from the driver tables (a Spark job into the
shared scratch folder) and reads them back through the source under test, so the
work grows with the tables.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from canopy import fixtures as fx
from canopy import tables
from canopy.functions import lang
from canopy.sources import articles as A
from canopy.sources import pages as P
from canopy.sources.archives import damaged, read_archives
from canopy.sources.scratch import scratch_dir
from canopy.plans.registry import register

V = fx.with_views


def _written_records(spark, d):
    root = scratch_dir(spark, "ndjson")
    pl = fx.page_log(spark, d)
    key = F.when(F.col("namespace").isin("enwiki_namespace_0", "frwiki_namespace_0"), "identifier").otherwise("id")
    recs = pl.withColumn("__k", key).unionByName(fx.page_batch(spark, d).withColumn("__k", F.lit("none")))
    P.write_page_records(recs, root, F.col("__k"))
    return root


@register("parse_pages", V("SELECT * FROM page_log", "page_log"))
def parse_pages(spark, d):
    """A1: ndjson page records (id under 'identifier' or 'id') back to page_log rows."""
    good, _ = P.read_page_records(spark, _written_records(spark, d))
    return good


@register("parse_quarantine", V("SELECT namespace, count(*) AS quarantined FROM page_batch GROUP BY namespace",
                                "page_batch"))
def parse_quarantine(spark, d):
    """A1: records without any id are set aside, counted per namespace."""
    _, bad = P.read_page_records(spark, _written_records(spark, d))
    return bad.groupBy("namespace").agg(F.count("*").alias("quarantined"))


@register("record_counts", V("""SELECT namespace, chunk_name, count(*) AS records FROM page_log GROUP BY 1, 2
UNION ALL SELECT namespace, chunk_name, count(*) FROM page_batch GROUP BY 1, 2""", "page_log", "page_batch"))
def record_counts(spark, d):
    """Records per written chunk file."""
    root = _written_records(spark, d)
    c = P.record_counts(spark, root)
    c = c.select(F.regexp_extract("file", r"namespace=([^/]+)/", 1).alias("namespace"),
                 F.regexp_extract("file", r"chunk_name=([^/]+)/", 1).alias("chunk_name"), "records")
    return c.groupBy("namespace", "chunk_name").agg(F.sum("records").alias("records"))


@register("tar_ingest", V("SELECT * FROM page_log", "page_log"))
def tar_ingest(spark, d):
    """A2: one tar.gz per chunk, read back by the archive source, a task per archive."""
    root = scratch_dir(spark, "tar")
    P.write_archives(fx.page_log(spark, d), root).write.format("noop").mode("overwrite").save()
    return read_archives(spark, root)[0]


@register("tar_quarantine", V("""SELECT namespace, chunk_name, 'record without an id' AS error, count(*) AS lines
FROM page_batch GROUP BY 1, 2
UNION ALL SELECT 'damaged_namespace', 'cut', 'damaged archive', 1""", "page_batch"))
def tar_quarantine(spark, d):
    """A2: what is set aside: every record without an id, and an archive that is cut off, named."""
    root = scratch_dir(spark, "tar-bad")
    batch = fx.page_batch(spark, d).withColumn("page_id", F.lit(None).cast("long"))
    P.write_archives(batch.unionByName(fx.page_log(spark, d).limit(0)), root).write.format("noop").mode("overwrite").save()
    damaged(f"{root}/damaged_namespace/cut.tar.gz")
    bad = read_archives(spark, root)[1]
    return bad.groupBy("namespace", "chunk_name", "error").agg(F.count("*").alias("lines"))


@register("chunk_manifest", V("""SELECT namespace, chunk_name, CAST(count(*) AS DOUBLE) AS size_value, 'pages' AS size_unit
FROM page_log GROUP BY namespace, chunk_name""", "page_log"))
def chunk_manifest(spark, d):
    """A3: a manifest with chunk entries and (id-less) namespace entries; keep the chunks."""
    root = scratch_dir(spark, "manifest")
    pl = fx.page_log(spark, d)
    chunks = pl.groupBy("namespace", "chunk_name").agg(F.count("*").cast("double").alias("n")).select(
        F.col("chunk_name").alias("identifier"), F.lit("1").alias("version"),
        F.struct(F.col("namespace").alias("identifier")).alias("is_part_of"),
        F.struct(F.col("n").alias("value"), F.lit("pages").alias("unit_text")).alias("size"))
    nss = pl.select("namespace").distinct().select(
        F.lit(None).cast("string").alias("identifier"), F.lit("1").alias("version"),
        F.struct(F.col("namespace").alias("identifier")).alias("is_part_of"),
        F.struct(F.lit(0.0).alias("value"), F.lit("namespace").alias("unit_text")).alias("size"))
    chunks.unionByName(nss).write.mode("overwrite").json(root)
    return P.read_manifest(spark, root)


def _articles_written(spark, d):
    root = scratch_dir(spark, "articles")
    pl = fx.page_log(spark, d)
    code = F.regexp_extract("namespace", r"^([a-z]+)wiki", 1)
    stamp = F.date_format(F.to_timestamp_ntz(F.lit("2025-10-01 00:00:00")) + F.make_dt_interval(
        mins=F.col("page_id").cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    art = pl.select(
        F.col("title").alias("name"), F.col("page_id").alias("identifier"), "abstract", "url",
        stamp.alias("date_modified"),
        F.struct(code.alias("identifier"), F.lit(None).cast("string").alias("name")).alias("in_language"),
        F.struct(F.col("namespace").alias("identifier"), F.lit(None).cast("string").alias("url")).alias("is_part_of"),
        F.struct((F.col("page_id") * 10).alias("identifier")).alias("version"),
        F.array(F.struct(F.concat(F.lit("Category:"), "chunk_name").alias("name"),
                         F.lit(None).cast("string").alias("url")),
                F.struct(F.concat(F.lit("Category:"), "namespace").alias("name"),
                         F.lit(None).cast("string").alias("url"))).alias("categories"))
    art.write.mode("overwrite").json(root)
    return root


REQ = A.Request(fields=["identifier", "name", "in_language.identifier", "version.identifier"],
                filters=[A.Filter("in_language.identifier", "fr")], since=datetime(2025, 10, 1, 0, 5), limit=20)


@register("request_read", V("""SELECT page_id AS identifier, title AS name, 'fr' AS in_language_identifier,
       page_id * 10 AS version_identifier FROM page_log
WHERE regexp_extract(namespace, '^([a-z]+)wiki', 1) = 'fr' AND page_id >= 5 ORDER BY page_id LIMIT 20""",
                            "page_log"))
def request_read(spark, d):
    """Typed article read with projection, dotted-path filter, since and limit."""
    arts = A.read_articles(spark, _articles_written(spark, d))
    return A.apply_request(arts, REQ)


@register("explode_categories", V("""SELECT page_id AS identifier, 0 AS pos, concat('Category:', chunk_name) AS name,
       CAST(NULL AS VARCHAR) AS url FROM page_log
UNION ALL SELECT page_id, 1, concat('Category:', namespace), NULL FROM page_log""", "page_log"))
def explode_categories(spark, d):
    """Category lists flattened to rows."""
    arts = A.read_articles(spark, _articles_written(spark, d))
    return A.flatten(arts, ["identifier"], "categories")


@register("structured_sections", V("""SELECT conv_id AS identifier,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos,
       role AS name, 'turn' AS type, text AS value FROM conversations"""))
def structured_sections(spark, d):
    """Nested structured records (sections with parts) written and flattened back, every level."""
    root = scratch_dir(spark, "structured")
    conv = tables.read(spark, d, "conversations")
    rec = conv.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "turn", F.col("role").alias("name"), F.lit("turn").alias("type"), F.col("text").alias("value")))).alias("s"))
    rec.select(F.col("conv_id").alias("identifier"),
               F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"),
                                                   x["value"].alias("value"))).alias("sections")) \
        .write.mode("overwrite").json(root)
    return A.unfold_parts(A.read_structured(spark, root), ["identifier"], "sections").select("identifier", "pos", "name", "type", "value")


def _events_written(spark, d):
    root = scratch_dir(spark, "batches")
    arts = fx.articles(spark, d)
    arts.withColumn("date", F.date_format("date_published", "yyyy-MM-dd")).withColumn(
        "hour", F.hour("date_published")).write.mode("overwrite").partitionBy("date", "hour").json(root)
    return root


HOUR = datetime(2024, 1, 1, 3)


@register("hourly_batch", V("""SELECT event_identifier, page_id, event_kind, value FROM articles
WHERE date_published >= TIMESTAMP '2024-01-01 03:00:00' AND date_published < TIMESTAMP '2024-01-01 04:00:00'""",
                            "articles"))
def hourly_batch(spark, d):
    """A5: one hourly batch folder read by partition pruning."""
    from canopy.streaming.articles import EVENT_SCHEMA
    root = _events_written(spark, d)
    return A.read_hour(spark, root, HOUR, EVENT_SCHEMA).select("event_identifier", "page_id", "event_kind", "value")


@register("languages_clean", V("""SELECT l.language, l.code, l.namespace, l.english_name,
       concat(l.local_name, ' (mirror)') AS local_name
FROM languages l WHERE l.namespace IN (SELECT DISTINCT namespace FROM page_log)""", "page_log", "languages"))
def languages_clean(spark, d):
    """A10: languages CSV for the namespaces in storage: trimmed, incomplete rows dropped,
    a repeated namespace keeps its last row."""
    from canopy.sources.dims import load_languages_csv
    root = scratch_dir(spark, "langcsv")
    ns = fx.page_log(spark, d).select("namespace").distinct()
    dim = lang.languages(spark).join(ns, "namespace", "left_semi")
    pad = lambda c: F.concat(F.lit("  "), F.col(c), F.lit(" "))
    first = dim.select(F.lit(0).alias("o"), pad("language").alias("a"), pad("code").alias("b"),
                       pad("namespace").alias("c"), "english_name", "local_name")
    broken = dim.select(F.lit(1).alias("o"), "language", F.lit(" ").alias("b"), "namespace", "english_name",
                        "local_name")
    last = dim.select(F.lit(2).alias("o"), "language", "code", "namespace", "english_name",
                      F.concat("local_name", F.lit(" (mirror)")))
    rows = first.union(broken).union(last).orderBy("o", "c").drop("o")
    rows.toDF("Language", "ISO 639-1 Code", "Namespace", "English Name", "Local Name") \
        .coalesce(1).write.mode("overwrite").option("header", True).csv(root)
    return load_languages_csv(spark, root)


@register("slim_export", V("""SELECT table_name, namespace, n AS source_rows, n AS target_rows, true AS same_content, true AS ok FROM (
  SELECT 'page_log' AS table_name, namespace, count(*) AS n FROM page_log GROUP BY 2
  UNION ALL SELECT 'page_vector', namespace, count(*) FROM page_vector GROUP BY 2
  UNION ALL SELECT 'cluster_tree', namespace, count(*) FROM doc_tree GROUP BY 2)""", "page_log", "page_vector", "doc_tree"))
def slim_export(spark, d):
    """A11 + A13: column-pruned serving copy partitioned by namespace, then reconciled by counts and content."""
    from canopy.sources.export import reconcile, slim_copy
    root = scratch_dir(spark, "slim")
    src = {"page_log": fx.page_log(spark, d), "page_vector": fx.page_vector(spark, d),
           "cluster_tree": fx.doc_tree(spark, d)}
    dst = slim_copy(spark, src, root)
    return reconcile(src, dst, by_namespace=True)


@register("typed_export", V("""SELECT namespace, count(*) AS source_rows, count(*) AS target_rows, true AS same_content, true AS ok,
  round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE))), 4) AS total FROM page_vector GROUP BY namespace""", "page_vector"))
def typed_export(spark, d):
    """The whole vector table from float32 blobs to typed Parquet, its content compared with the source."""
    from canopy.sources.export import reconcile, typed_copy
    pv = fx.page_vector(spark, d)
    blobs = pv.select("namespace", "page_id", "cluster_node_id", P.encode_f32("embedding").alias("embedding_vector"))
    typed = typed_copy(blobs, {"embedding_vector": "embedding"}, scratch_dir(spark, "typed"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    sums = typed.groupBy("namespace").agg(F.round(F.sum(total), 4).alias("total"))
    return reconcile({"page_vector": pv}, {"page_vector": typed}, by_namespace=True).drop("table_name").join(sums, "namespace")


@register("blob_codec", V("SELECT vec_id, CAST(4 * len(embedding) AS INTEGER) AS n_bytes, true AS roundtrip_ok FROM embeddings"))
def blob_codec(spark, d):
    """float32 little-endian blobs and back."""
    e = tables.read(spark, d, "embeddings")
    enc = e.select("vec_id", "embedding", P.encode_f32("embedding").alias("blob"))
    dec = enc.select("vec_id", F.length("blob").alias("n_bytes"),
                     (P.decode_f32("blob") == F.col("embedding")).alias("roundtrip_ok"))
    return dec

