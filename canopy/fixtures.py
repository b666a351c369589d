"""Engine tables derived from the driver's parquet tables.

Each view has two definitions that must agree: a DataFrame builder (what the
engine runs) and an ANSI SQL text (what the DuckDB oracle runs).  All views are
derived from whole tables; nothing is sampled or capped.

* ``page_log``    documents as pages (one namespace per language)
* ``page_vector`` page -> embedding (where present) and tree node (its source)
* ``doc_tree``    per namespace: root 1 (local wiki name) -> one leaf per source
* ``geo_tree`` / ``geo_page``  customers as pages; world -> region -> nation -> leaf
  (nation x market segment, only combinations that have customers)
* ``emb_tree`` / ``emb_flat`` / ``emb_page``  embedding rows as pages in small trees
* ``articles``    events as an article change stream
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from canopy import tables
from canopy.functions import lang

NS_SUFFIX = "wiki_namespace_0"


def _src_no(col: str = "source"):
    return F.expr(f"CAST(substring({col}, 4) AS INT)")


def page_log(spark: SparkSession, d: str) -> DataFrame:
    doc = tables.read(spark, d, "documents")
    return doc.select(
        F.concat("lang", F.lit(NS_SUFFIX)).alias("namespace"),
        F.col("doc_id").alias("page_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.concat("lang", F.lit(NS_SUFFIX + "_chunk_"), F.expr("substring(source, 4)")).alias("chunk_name"),
        F.concat(F.lit("https://"), "lang", F.lit(".example.org/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("abstract"),
    )


def page_vector(spark: SparkSession, d: str) -> DataFrame:
    doc = tables.read(spark, d, "documents").select("doc_id", "lang", "source")
    emb = tables.read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return doc.join(emb, "doc_id", "left").select(
        F.concat("lang", F.lit(NS_SUFFIX)).alias("namespace"),
        F.col("doc_id").alias("page_id"),
        "embedding",
        (F.lit(2) + _src_no()).cast("bigint").alias("cluster_node_id"),
    )


#: Tags and white space between the words of a page's body.
ARTICLE_MARKUP = r"(<[^>]*>|[ \t\n\r])+"


def page_batch(spark: SparkSession, d: str) -> DataFrame:
    """A change batch of pages parsed from raw HTML (``pages`` table), page_log-shaped."""
    p = tables.read(spark, d, "pages")
    lng = F.regexp_extract("html", r'<html lang="([a-z]+)"', 1)
    return p.select(F.concat(lng, F.lit(NS_SUFFIX)).alias("namespace"), "page_id",
                    F.regexp_extract("html", r"<title>(.*?)</title>", 1).alias("title"),
                    F.concat(lng, F.lit(NS_SUFFIX + "_chunk_pages")).alias("chunk_name"), "url",
                    F.trim(F.regexp_replace(F.regexp_extract("html", r"(?s)<body>(.*)</body>", 1), ARTICLE_MARKUP, " "))
                    .alias("abstract"))


def doc_tree(spark: SparkSession, d: str) -> DataFrame:
    doc = tables.read(spark, d, "documents").select(
        F.concat("lang", F.lit(NS_SUFFIX)).alias("namespace"), _src_no().alias("src"))
    leaves = doc.distinct()
    roots = (leaves.groupBy("namespace").agg(F.count("*").alias("child_count"))
             .join(F.broadcast(lang.languages(spark).select("namespace", "local_name")), "namespace", "left")
             .select("namespace", F.lit(1).cast("bigint").alias("node_id"),
                     F.lit(None).cast("bigint").alias("parent_id"), F.lit(0).alias("depth"),
                     F.coalesce("local_name", "namespace").alias("final_label"),
                     F.col("child_count").cast("int").alias("child_count")))
    kids = leaves.select("namespace", (F.lit(2) + F.col("src")).cast("bigint").alias("node_id"),
                         F.lit(1).cast("bigint").alias("parent_id"), F.lit(1).alias("depth"),
                         F.concat(F.lit("Source "), F.col("src").cast("string")).alias("final_label"),
                         F.lit(0).alias("child_count"))
    return roots.unionByName(kids).withColumn("first_label", F.col("final_label"))


def chunk_log(spark: SparkSession, d: str) -> DataFrame:
    """One chunk per (language, source); progress derived from how many of its pages have vectors:
    any vector -> downloaded, more than half -> unpacked."""
    pv = page_vector(spark, d).select("page_id", F.col("embedding").isNotNull().alias("emb"))
    pl = page_log(spark, d).select("namespace", "chunk_name", "page_id")
    per = pl.join(pv, "page_id").groupBy("namespace", "chunk_name").agg(
        F.count("*").alias("n"), F.count_if("emb").alias("n_emb"), F.min("page_id").alias("first_page"))
    down = F.col("n_emb") > 0
    unp = F.col("n_emb") * 2 > F.col("n")
    stamp = F.to_timestamp_ntz(F.lit("2025-10-01 00:00:00")) + F.make_dt_interval(secs=F.col("first_page"))
    return per.select(
        "namespace", "chunk_name",
        F.when(down, F.concat(F.lit("/archive/"), "chunk_name", F.lit(".tar.gz"))).alias("chunk_archive_path"),
        F.when(unp, F.concat(F.lit("/extracted/"), "chunk_name", F.lit(".ndjson"))).alias("chunk_extracted_path"),
        F.when(down, stamp).alias("downloaded_at"),
        F.when(unp, stamp + F.expr("INTERVAL 1 HOUR")).alias("unpacked_at"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    # distinct segments are few; a global rank over them is a one-task job on a tiny input
    seg = tables.read(spark, d, "customer").select("c_mktsegment").distinct()
    return seg.withColumn("s", F.row_number().over(Window.orderBy("c_mktsegment")) - 1)


def geo_page(spark: SparkSession, d: str) -> DataFrame:
    c = tables.read(spark, d, "customer")
    return c.join(_segments(spark, d), "c_mktsegment").select(
        F.lit("geo").alias("namespace"), F.col("c_custkey").alias("page_id"), F.col("c_name").alias("title"),
        (F.lit(32) + F.col("c_nationkey") * 5 + F.col("s")).cast("bigint").alias("cluster_node_id"))


def geo_tree(spark: SparkSession, d: str) -> DataFrame:
    region = tables.read(spark, d, "region")
    nation = tables.read(spark, d, "nation")
    cust = tables.read(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()
    root = spark.range(1).select(F.lit("geo").alias("namespace"), F.lit(1).cast("bigint").alias("node_id"),
                                 F.lit(None).cast("bigint").alias("parent_id"), F.lit(0).alias("depth"),
                                 F.lit("World").alias("final_label"))
    regions = region.select(F.lit("geo"), (F.lit(2) + F.col("r_regionkey")).cast("bigint"),
                            F.lit(1).cast("bigint"), F.lit(1), "r_name").toDF(*root.columns)
    nations = nation.select(F.lit("geo"), (F.lit(7) + F.col("n_nationkey")).cast("bigint"),
                            (F.lit(2) + F.col("n_regionkey")).cast("bigint"), F.lit(2), "n_name").toDF(*root.columns)
    leaves = (cust.join(_segments(spark, d), "c_mktsegment")
              .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
              .select(F.lit("geo"), (F.lit(32) + F.col("n_nationkey") * 5 + F.col("s")).cast("bigint"),
                      (F.lit(7) + F.col("n_nationkey")).cast("bigint"), F.lit(3),
                      F.concat_ws(" ", "n_name", "c_mktsegment")).toDF(*root.columns))
    return root.unionByName(regions).unionByName(nations).unionByName(leaves)


def emb_page(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "embeddings")
    return e.select(F.lit("emb").alias("namespace"), F.col("vec_id").alias("page_id"), "embedding", "label")


def emb_tree(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "embeddings").select("label").distinct()
    root = spark.range(1).select(F.lit("emb").alias("namespace"), F.lit(1).cast("bigint").alias("node_id"),
                                 F.lit(None).cast("bigint").alias("parent_id"), F.lit(0).alias("depth"))
    inner = e.select(F.lit("emb"), (F.lit(2) + F.col("label") % 3).cast("bigint"), F.lit(1).cast("bigint"),
                     F.lit(1)).distinct().toDF(*root.columns)
    leaves = e.select(F.lit("emb"), (F.lit(5) + F.col("label")).cast("bigint"),
                      (F.lit(2) + F.col("label") % 3).cast("bigint"), F.lit(2)).toDF(*root.columns)
    return root.unionByName(inner).unionByName(leaves)


def emb_flat(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "embeddings").select("label").distinct()
    root = spark.range(1).select(F.lit("emb").alias("namespace"), F.lit(1).cast("bigint").alias("node_id"),
                                 F.lit(None).cast("bigint").alias("parent_id"), F.lit(0).alias("depth"))
    leaves = e.select(F.lit("emb"), (F.lit(2) + F.col("label")).cast("bigint"), F.lit(1).cast("bigint"),
                      F.lit(1)).toDF(*root.columns)
    return root.unionByName(leaves)


def articles(spark: SparkSession, d: str) -> DataFrame:
    ev = tables.read(spark, d, "events")
    return ev.select(
        F.col("event_id").alias("event_identifier"), F.col("user_id").alias("page_id"),
        F.col("ts").alias("date_published"),
        F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "visibility-change")
        .otherwise("update").alias("event_kind"),
        (F.col("event_id") % 4).cast("int").alias("part"),
        F.floor(F.col("event_id") / 4).cast("bigint").alias("off"), "value", "props")


# ---------------------------------------------------------------------------
# SQL twins (DuckDB dialect; every name below is a CTE usable by the oracle)
# ---------------------------------------------------------------------------

SQL: dict[str, str] = {
    "page_log": f"""SELECT concat(lang, '{NS_SUFFIX}') AS namespace, doc_id AS page_id,
       split_part(text, chr(10), 1) AS title,
       concat(lang, '{NS_SUFFIX}_chunk_', substring(source, 4)) AS chunk_name,
       concat('https://', lang, '.example.org/', CAST(doc_id AS VARCHAR)) AS url,
       text AS abstract
FROM documents""",
    "page_vector": f"""SELECT concat(d.lang, '{NS_SUFFIX}') AS namespace, d.doc_id AS page_id, e.embedding AS embedding,
       CAST(2 + CAST(substring(d.source, 4) AS INT) AS BIGINT) AS cluster_node_id
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
    "languages": lang.languages_sql(),
    "page_batch": f"""SELECT concat(regexp_extract(html, '<html lang="([a-z]+)"', 1), '{NS_SUFFIX}') AS namespace,
       page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
       concat(regexp_extract(html, '<html lang="([a-z]+)"', 1), '{NS_SUFFIX}_chunk_pages') AS chunk_name, url,
       trim(regexp_replace(regexp_extract(html, '(?s)<body>(.*)</body>', 1), '{ARTICLE_MARKUP}', ' ', 'g'), ' ') AS abstract
FROM pages""",
    "chunk_log": """SELECT namespace, chunk_name,
       CASE WHEN n_emb > 0 THEN concat('/archive/', chunk_name, '.tar.gz') END AS chunk_archive_path,
       CASE WHEN n_emb * 2 > n THEN concat('/extracted/', chunk_name, '.ndjson') END AS chunk_extracted_path,
       CASE WHEN n_emb > 0 THEN TIMESTAMP '2025-10-01 00:00:00' + to_seconds(first_page) END AS downloaded_at,
       CASE WHEN n_emb * 2 > n THEN TIMESTAMP '2025-10-01 00:00:00' + to_seconds(first_page) + INTERVAL 1 HOUR END
         AS unpacked_at
FROM (SELECT pl.namespace, pl.chunk_name, count(*) AS n, count(pv.embedding) AS n_emb, min(pl.page_id) AS first_page
      FROM page_log pl JOIN page_vector pv ON pv.page_id = pl.page_id GROUP BY pl.namespace, pl.chunk_name) x""",
    "doc_leaf": f"""SELECT DISTINCT concat(lang, '{NS_SUFFIX}') AS namespace, CAST(substring(source, 4) AS INT) AS src
FROM documents""",
    "doc_tree": """SELECT r.namespace, CAST(1 AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, 0 AS depth,
       coalesce(l.local_name, r.namespace) AS final_label, CAST(r.n AS INT) AS child_count,
       coalesce(l.local_name, r.namespace) AS first_label
FROM (SELECT namespace, count(*) AS n FROM doc_leaf GROUP BY namespace) r
LEFT JOIN languages l ON l.namespace = r.namespace
UNION ALL
SELECT namespace, CAST(2 + src AS BIGINT), CAST(1 AS BIGINT), 1, concat('Source ', CAST(src AS VARCHAR)), 0,
       concat('Source ', CAST(src AS VARCHAR))
FROM doc_leaf""",
    "seg": """SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS s
FROM (SELECT DISTINCT c_mktsegment FROM customer) x""",
    "geo_page": """SELECT 'geo' AS namespace, c.c_custkey AS page_id, c.c_name AS title,
       CAST(32 + c.c_nationkey * 5 + seg.s AS BIGINT) AS cluster_node_id
FROM customer c JOIN seg ON seg.c_mktsegment = c.c_mktsegment""",
    "geo_tree": """SELECT 'geo' AS namespace, CAST(1 AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id,
       0 AS depth, 'World' AS final_label
UNION ALL SELECT 'geo', CAST(2 + r_regionkey AS BIGINT), CAST(1 AS BIGINT), 1, r_name FROM region
UNION ALL SELECT 'geo', CAST(7 + n_nationkey AS BIGINT), CAST(2 + n_regionkey AS BIGINT), 2, n_name FROM nation
UNION ALL SELECT 'geo', CAST(32 + n.n_nationkey * 5 + seg.s AS BIGINT), CAST(7 + n.n_nationkey AS BIGINT), 3,
       concat(n.n_name, ' ', c.c_mktsegment)
FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) c
JOIN seg ON seg.c_mktsegment = c.c_mktsegment JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    "emb_page": "SELECT 'emb' AS namespace, vec_id AS page_id, embedding, label FROM embeddings",
    "emb_tree": """SELECT 'emb' AS namespace, CAST(1 AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, 0 AS depth
UNION ALL SELECT DISTINCT 'emb', CAST(2 + label % 3 AS BIGINT), CAST(1 AS BIGINT), 1 FROM embeddings
UNION ALL SELECT DISTINCT 'emb', CAST(5 + label AS BIGINT), CAST(2 + label % 3 AS BIGINT), 2 FROM embeddings""",
    "emb_flat": """SELECT 'emb' AS namespace, CAST(1 AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, 0 AS depth
UNION ALL SELECT DISTINCT 'emb', CAST(2 + label AS BIGINT), CAST(1 AS BIGINT), 1 FROM embeddings""",
    "articles": """SELECT event_id AS event_identifier, user_id AS page_id, ts AS date_published,
       CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'visibility-change' ELSE 'update' END
         AS event_kind,
       CAST(event_id % 4 AS INT) AS part, CAST(floor(event_id / 4) AS BIGINT) AS off, value, props
FROM events""",
}

# dependency order for CTE emission
_DEPS = {
    "chunk_log": ["page_log", "page_vector"],
    "doc_tree": ["languages", "doc_leaf"],
    "geo_page": ["seg"],
    "geo_tree": ["seg"],
}


def with_views(body: str, *names: str, extra: list[tuple[str, str]] | None = None,
               recursive: bool = False) -> str:
    """Prefix ``body`` with CTEs for the named views (and their dependencies)."""
    order: list[str] = []

    def add(n: str) -> None:
        for dep in _DEPS.get(n, []):
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS (\n{SQL[n]}\n)" for n in order]
    ctes += [f"{n} AS (\n{q}\n)" for n, q in (extra or [])]
    if not ctes:
        return body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + body


BUILDERS = {
    "page_log": page_log, "page_vector": page_vector, "chunk_log": chunk_log, "page_batch": page_batch, "doc_tree": doc_tree, "geo_page": geo_page,
    "geo_tree": geo_tree, "emb_page": emb_page, "emb_tree": emb_tree, "emb_flat": emb_flat, "articles": articles,
}


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    return BUILDERS[name](spark, d)
