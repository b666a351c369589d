"""Structured contents as rows (A7, A8): nested tables, references, links, images and citations.

Records nest without a bound, so a line is parsed to a ``variant`` once and unfolded by a
worklist: each round turns one level of a recursive field (parts in parts, tables in table
cells) into rows and goes on with what is nested in them, until a level is empty.  All fields
are read in snake_case and camelCase.  A line that is no JSON object is set aside with its
file, and an element of the wrong kind becomes a row of nulls; neither ends the job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.session import cut_lineage

LIST = "array<variant>"
#: Sections of a table, in the order of their numbers in a path.
SECTIONS = ["headers", "rows", "footers"]


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def pick(v: Column, name: str, kind: str) -> Column:
    """A field of an object by either spelling; null if it is missing or of another kind."""
    spellings = dict.fromkeys((name, _camel(name)))
    return F.coalesce(*[F.try_variant_get(v, f"$.{s}", kind) for s in spellings])


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, set aside): ``identifier, v`` of every line that is an object, and ``file, line`` of the others."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line")) \
        .withColumn("v", F.try_parse_json("line"))
    lines = lines.withColumn("whole", F.schema_of_variant("v").startswith("OBJECT"))
    good = lines.where("whole").select(pick(F.col("v"), "identifier", "long").alias("identifier"), "v")
    return good, lines.where("NOT coalesce(whole, false) AND trim(line) <> ''").select("file", "line")


def _levels(rows: DataFrame, step) -> DataFrame:
    """All rounds of a worklist; ``step`` makes the next level's rows from those of one level."""
    rows = cut_lineage(rows)
    out = rows
    while True:
        rows = cut_lineage(step(rows))
        if rows.isEmpty():
            return out
        out = out.unionByName(rows)


def parts(records: DataFrame, keys: Sequence[str], *names: str) -> DataFrame:
    """The parts of every level: keys, ``path`` (positions from the top), ``part`` (variant) and its plain fields."""
    top = F.coalesce(*[pick(F.col("v"), n, LIST) for n in names])
    first = records.select(*keys, F.posexplode(top).alias("pos", "part")).select(*keys, F.array("pos").alias("path"), "part")

    def deeper(rows: DataFrame) -> DataFrame:
        return rows.select(*keys, "path", F.posexplode(pick(F.col("part"), "has_parts", LIST)).alias("pos", "part")) \
            .select(*keys, F.concat("path", F.array("pos")).alias("path"), "part")

    p = F.col("part")
    return _levels(first, deeper).select(
        *keys, "path", "part", *[pick(p, n, "string").alias(n) for n in ("name", "type", "value")],
        pick(p, "values", "array<string>").alias("values"))


def links(holders: DataFrame, keys: Sequence[str], holder: Column) -> DataFrame:
    """The links of variant objects: keys, ``pos``, ``url``, ``text`` and ``link`` (variant, for its images)."""
    rows = holders.select(*keys, F.posexplode(pick(holder, "links", LIST)).alias("pos", "link"))
    return rows.select(*keys, "pos", pick(F.col("link"), "url", "string").alias("url"),
                       pick(F.col("link"), "text", "string").alias("text"), "link")


def images(holders: DataFrame, keys: Sequence[str], holder: Column) -> DataFrame:
    """The images of variant objects: keys, ``pos`` and the fields of an image."""
    rows = holders.select(*keys, F.posexplode(pick(holder, "images", LIST)).alias("pos", "image"))
    return rows.select(*keys, "pos", *image_fields(F.col("image")))


def image_fields(image: Column) -> list[Column]:
    return [pick(image, n, kind).alias(n) for n, kind in (
        ("content_url", "string"), ("alternative_text", "string"), ("caption", "string"), ("width", "long"), ("height", "long"))]


def citations(holders: DataFrame, keys: Sequence[str], holder: Column) -> DataFrame:
    rows = holders.select(*keys, F.posexplode(pick(holder, "citations", LIST)).alias("pos", "citation"))
    c = F.col("citation")
    return rows.select(*keys, "pos", pick(c, "identifier", "string").alias("citation_id"),
                       *[pick(c, n, "string").alias(n) for n in ("group", "text")])


def tables(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every table, nested ones too: keys, ``path``, ``table`` (variant), ``table_id``, ``confidence_score``.

    A path starts with the table's place in the record; a nested table adds the section, row
    and column of the cell it stands in.
    """
    first = records.select(*keys, F.posexplode(pick(F.col("v"), "tables", LIST)).alias("pos", "table")) \
        .select(*keys, F.array("pos").alias("path"), "table")

    def nested(rows: DataFrame) -> DataFrame:
        inner = pick(F.col("cell"), "nested_table", "variant")
        return _cells(rows, keys).where(inner.isNotNull()).select(
            *keys, F.concat("path", F.array("section", "row", "col")).alias("path"), inner.alias("table"))

    t = F.col("table")
    return _levels(first, nested).select(*keys, "path", "table", pick(t, "identifier", "string").alias("table_id"),
                                         pick(t, "confidence_score", "double").alias("confidence_score"))


def _cells(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = F.array(*[pick(F.col("table"), s, LIST) for s in SECTIONS])
    return found.select(*keys, "path", F.posexplode(rows).alias("section", "lines")) \
        .select(*keys, "path", "section", F.posexplode("lines").alias("row", "line")) \
        .select(*keys, "path", "section", "row", F.posexplode(F.try_variant_get("line", "$", LIST)).alias("col", "cell"))


def cells(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cells of ``tables``: keys, ``path``, ``section``, ``row``, ``col``, ``value``, ``nested``."""
    return _cells(found, keys).select(
        *keys, "path", F.element_at(F.array(*map(F.lit, SECTIONS)), F.col("section") + 1).alias("section"), "row", "col",
        pick(F.col("cell"), "value", "string").alias("value"),
        pick(F.col("cell"), "nested_table", "variant").isNotNull().alias("nested"))


def references(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per reference: keys, ``pos``, its plain fields, ``metadata`` (map), and ``text``, ``source`` with their variants."""
    rows = records.select(*keys, F.posexplode(pick(F.col("v"), "references", LIST)).alias("pos", "reference"))
    r = F.col("reference")
    said = [pick(pick(r, n, "variant"), "value", "string").alias(n) for n in ("text", "source")]
    return rows.select(*keys, "pos", pick(r, "identifier", "string").alias("reference_id"),
                       *[pick(r, n, "string").alias(n) for n in ("group", "type")],
                       pick(r, "metadata", "map<string,string>").alias("metadata"), *said, "reference")


def reference_links(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Links in the text and source of ``references``: keys, ``ref``, ``place``, ``pos``, ``url``, ``text``, ``link``."""
    own = [*keys, "ref", "place"]
    out = None
    for place in ("text", "source"):
        held = found.select(*keys, F.col("pos").alias("ref"), F.lit(place).alias("place"),
                            pick(F.col("reference"), place, "variant").alias("holder"))
        rows = links(held, own, F.col("holder"))
        out = rows if out is None else out.unionByName(rows)
    return out


def entities(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Main and additional entities: keys, ``pos`` (-1: the main one), ``entity_id``, ``url``, ``aspects``."""
    main = F.array(pick(F.col("v"), "main_entity", "variant"))
    more = F.coalesce(pick(F.col("v"), "additional_entities", LIST), F.array().cast(LIST))
    rows = records.select(*keys, F.posexplode(F.concat(main, more)).alias("pos", "e")).where("e IS NOT NULL")
    return rows.select(*keys, (F.col("pos") - 1).alias("pos"), pick(F.col("e"), "identifier", "string").alias("entity_id"),
                       pick(F.col("e"), "url", "string").alias("url"), pick(F.col("e"), "aspects", "array<string>").alias("aspects"))
