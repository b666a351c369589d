"""Catalogue: whole article records and nested structured contents as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy import fixtures as fx
from canopy import tables
from canopy.plans.registry import register
from canopy.sources import articles as A
from canopy.sources import structured as X
from canopy.sources.scratch import scratch_dir

V = fx.with_views
KEY = ["identifier"]


def _written(spark, name, records, broken="{cut off"):
    """Records (a JSON text column) as a folder of lines, with a line that is no JSON."""
    root = scratch_dir(spark, name)
    lines = records.toDF("value").union(spark.createDataFrame([(broken,)], "value string"))
    lines.write.text(root)
    return X.read_records(spark, root)


def _conversation_tables(spark, d):
    """One table per conversation: a header, a row per turn, and in every third turn a table in a table."""
    conv = tables.read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    inner = F.struct(F.concat(F.lit("deep"), "turn").alias("identifier"),
                     F.array(F.array(F.struct(F.col("turn").cast("string").alias("value")))).alias("footers"))
    middle = F.struct(F.concat(F.lit("in"), "turn").alias("identifier"), F.lit(0.25).alias("confidenceScore"),
                      F.array(F.array(F.struct(F.col("role").alias("value"), inner.alias("nestedTable")))).alias("rows"))
    said = F.struct(F.col("text").alias("value"), F.when(F.col("turn") % 3 == 0, middle).alias("nested_table"))
    row = F.struct("turn", F.array(F.struct(F.col("role").alias("value"), F.lit(None).cast(
        "struct<identifier:string>").alias("nested_table")).alias("c")).alias("first"), F.array(said).alias("second"))
    per = conv.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    table = F.struct(F.concat(F.lit("t"), "conv_id").alias("identifier"), F.lit(0.5).alias("confidence_score"),
                     F.array(F.array(F.struct(F.lit("role").alias("value")), F.struct(F.lit("text").alias("value")))).alias("headers"))
    # a cell of either kind is written as JSON, so that a row may hold both
    text = F.to_json(F.struct(F.col("conv_id").alias("identifier"), F.array(table).alias("tables")))
    rows = F.transform("turns", lambda t: F.concat(F.lit("["), F.to_json(t["first"][0]), F.lit(","),
                                                   F.to_json(t["second"][0]), F.lit("]")))
    whole = F.concat(F.expr("substring(j, 1, length(j) - 3)"), F.lit(',"rows":['), F.array_join("r", ","), F.lit("]}]}"))
    return per.select(text.alias("j"), rows.alias("r")).select(whole)


@register("structured_cells", """
WITH t AS (SELECT conv_id, role, text, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS r
           FROM conversations)
SELECT conv_id AS identifier, '0' AS path, 'headers' AS section, 0 AS row, c AS col, ['role', 'text'][c + 1] AS value,
       false AS nested FROM (SELECT DISTINCT conv_id FROM t), (SELECT unnest([0, 1])::INT AS c)
UNION ALL SELECT conv_id, '0', 'rows', r, 0, role, false FROM t
UNION ALL SELECT conv_id, '0', 'rows', r, 1, text, coalesce(turn % 3 = 0, false) FROM t
UNION ALL SELECT conv_id, concat('0.1.', r, '.1'), 'rows', 0, 0, role, true FROM t WHERE turn % 3 = 0
UNION ALL SELECT conv_id, concat('0.1.', r, '.1.1.0.0'), 'footers', 0, 0, CAST(turn AS VARCHAR), false FROM t WHERE turn % 3 = 0""")
def structured_cells(spark, d):
    """The cells of tables at every depth, as rows."""
    good, _ = _written(spark, "tables", _conversation_tables(spark, d))
    return X.cells(X.tables(good, KEY), KEY).withColumn("path", F.array_join("path", "."))


def _references(spark, d):
    pl = fx.page_log(spark, d)
    link = F.struct("url", F.col("title").alias("text"), F.array(F.struct(
        F.concat("url", F.lit("/i.png")).alias("contentUrl"), F.length("title").alias("width"))).alias("images"))
    ref = F.struct(F.concat(F.lit("r"), "page_id").alias("identifier"), F.col("namespace").alias("group"), F.lit("web").alias("type"),
                   F.create_map(F.lit("chunk"), "chunk_name", F.lit("title"), "title").alias("metadata"),
                   F.struct(F.col("title").alias("value"), F.array(link, link).alias("links")).alias("text"),
                   F.when(F.col("page_id") % 2 == 0, F.struct(F.col("abstract").alias("value"), F.array(link).alias("links"))).alias("source"))
    part = F.struct(F.lit("inner").alias("name"), F.array(link).alias("links"),
                    F.array(F.struct(F.concat(F.lit("c"), "page_id").alias("identifier"), F.lit("[1]").alias("text"))).alias("citations"))
    section = F.struct(F.lit("outer").alias("name"), F.array(F.struct(F.lit("middle").alias("name"), F.array(part).alias("hasParts")))
                       .alias("has_parts"))
    entity = F.struct(F.concat(F.lit("Q"), "page_id").alias("identifier"), "url", F.array(F.lit("S"), F.lit("T")).alias("aspects"))
    return pl.select(F.to_json(F.struct(
        F.col("page_id").alias("identifier"), F.array(ref, F.struct(*[ref[n].alias(n) for n in (
            "identifier", "group", "type", "metadata", "text", "source")])).alias("references"),
        F.array(section).alias("sections"), entity.alias("mainEntity"), F.array(entity).alias("additional_entities"))))


@register("structured_references", V("""SELECT page_id AS identifier, CAST(p AS INT) AS pos, concat('r', page_id) AS reference_id, namespace AS "group",
       'web' AS type, chunk_name AS chunk, title AS text, CASE WHEN page_id % 2 = 0 THEN abstract END AS source,
       CAST(CASE WHEN page_id % 2 = 0 THEN 3 ELSE 2 END AS BIGINT) AS n_links,
       CAST(CASE WHEN page_id % 2 = 0 THEN 3 ELSE 2 END * length(title) AS BIGINT) AS image_widths
FROM page_log, (SELECT unnest([0, 1]) AS p)""", "page_log"))
def structured_references(spark, d):
    """References with metadata, text and source, and what their links and images add up to."""
    good, _ = _written(spark, "references", _references(spark, d))
    refs = X.references(good, KEY)
    linked = X.reference_links(refs, KEY)
    own = [*KEY, "ref", "place", "pos"]
    pics = X.images(linked.withColumnRenamed("pos", "nth"), [*KEY, "ref", "place", "nth"], F.col("link")) \
        .groupBy("identifier", "ref").agg(F.sum("width").alias("image_widths"))
    n = linked.select(*own).groupBy("identifier", "ref").agg(F.count("*").alias("n_links"))
    return refs.withColumn("ref", F.col("pos")).join(n, ["identifier", "ref"]).join(pics, ["identifier", "ref"]).select(
        "identifier", "pos", "reference_id", "group", "type", F.col("metadata")["chunk"].alias("chunk"), "text", "source",
        "n_links", "image_widths")


@register("structured_media", V("""SELECT page_id AS identifier, 'link' AS kind, '0.0.0' AS path, url AS a, title AS b FROM page_log
UNION ALL SELECT page_id, 'citation', '0.0.0', concat('c', page_id), '[1]' FROM page_log
UNION ALL SELECT page_id, 'entity', CAST(p AS VARCHAR), concat('Q', page_id), 'S,T' FROM page_log, (SELECT unnest([-1, 0]) AS p)
UNION ALL SELECT page_id, 'part', p, n, NULL FROM page_log,
  (SELECT unnest(['0', '0.0', '0.0.0']) AS p, unnest(['outer', 'middle', 'inner']) AS n)
UNION ALL SELECT NULL, 'set aside', NULL, '{cut off', NULL""", "page_log"))
def structured_media(spark, d):
    """Links and citations of parts at every depth, entities, and the line that is set aside."""
    good, bad = _written(spark, "media", _references(spark, d))
    found = X.parts(good, KEY, "sections")
    own = [*KEY, "path"]

    def rows(df, kind, path, a, b):
        return df.select("identifier", F.lit(kind).alias("kind"), path.alias("path"), a.alias("a"), b.alias("b"))

    path = F.array_join("path", ".")
    out = rows(X.links(found, own, F.col("part")), "link", path, F.col("url"), F.col("text"))
    for more in (rows(X.citations(found, own, F.col("part")), "citation", path, F.col("citation_id"), F.col("text")),
                 rows(X.entities(good, KEY), "entity", F.col("pos").cast("string"), F.col("entity_id"), F.array_join("aspects", ",")),
                 rows(found, "part", path, F.col("name"), F.lit(None).cast("string")),
                 rows(bad.withColumn("identifier", F.lit(None).cast("long")), "set aside", F.lit(None).cast("string"), F.col("line"),
                      F.lit(None).cast("string"))):
        out = out.unionByName(more)
    return out


@register("article_record", V("""SELECT page_id AS identifier, page_id * 3 AS watchers_count, TIMESTAMP '2025-10-01 00:00:00' AS modified,
  'autoconfirmed' AS protection_level, page_id - 1 AS previous_id, ['tag', namespace] AS tags, page_id % 2 = 0 AS is_minor_edit,
  0.75::DOUBLE AS revert_risk, title AS editor, CAST(length(abstract) AS BIGINT) AS n_characters, abstract AS html,
  concat('L', page_id % 3) AS license, page_id % 5 = 0 AS visible, concat(url, '/i.png') AS image, concat('Q', page_id) AS entity,
  chunk_name AS project FROM page_log""", "page_log"))
def article_record(spark, d):
    """Whole article records written and read by the typed schema, a field of every struct."""
    root = scratch_dir(spark, "article-records")
    pl, s = fx.page_log(spark, d), F.struct
    pl.select(
        F.col("page_id").alias("identifier"), (F.col("page_id") * 3).alias("watchers_count"), F.lit("2025-10-01T00:00:00Z").alias("date_modified"),
        F.array(s(F.lit("edit").alias("type"), F.lit("autoconfirmed").alias("level"))).alias("protection"),
        s((F.col("page_id") - 1).alias("identifier")).alias("previous_version"),
        s(F.array(F.lit("tag"), "namespace").alias("tags"), (F.col("page_id") % 2 == 0).alias("is_minor_edit"),
          s(s(s(F.lit(0.75).alias("true")).alias("probability")).alias("revertrisk")).alias("scores"),
          s(F.col("title").alias("name")).alias("editor"), F.length("abstract").alias("number_of_characters")).alias("version"),
        s(F.col("abstract").alias("html")).alias("article_body"),
        F.array(s(F.concat(F.lit("L"), F.col("page_id") % 3).alias("identifier"))).alias("license"),
        s((F.col("page_id") % 5 == 0).alias("text")).alias("visibility"), s(F.concat("url", F.lit("/i.png")).alias("content_url")).alias("image"),
        s(F.concat(F.lit("Q"), "page_id").alias("identifier")).alias("main_entity"), s(F.col("chunk_name").alias("code")).alias("is_part_of")) \
        .write.json(root)
    a = A.read_articles(spark, root)
    return a.select(
        "identifier", "watchers_count", F.col("date_modified_ts").alias("modified"), F.col("protection")[0]["level"].alias("protection_level"),
        F.col("previous_version.identifier").alias("previous_id"), F.col("version.tags").alias("tags"),
        F.col("version.is_minor_edit").alias("is_minor_edit"), F.col("version.scores.revertrisk.probability.true").alias("revert_risk"),
        F.col("version.editor.name").alias("editor"), F.col("version.number_of_characters").alias("n_characters"),
        F.col("article_body.html").alias("html"), F.col("license")[0]["identifier"].alias("license"), F.col("visibility.text").alias("visible"),
        F.col("image.content_url").alias("image"), F.col("main_entity.identifier").alias("entity"), F.col("is_part_of.code").alias("project"))
