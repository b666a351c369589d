"""Small dimension sources (A9, A10): language list CSV and metadata lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER = ["Language", "ISO 639-1 Code", "Namespace", "English Name", "Local Name"]
OUT = ["language", "code", "namespace", "english_name", "local_name"]


class LanguageFileError(ValueError):
    pass


def load_languages_csv(spark: SparkSession, path: str) -> DataFrame:
    """A10: header required; fields trimmed; rows missing language, code or namespace
    dropped; a repeated namespace keeps its last row (file order); no rows -> error.

    The file is a small dimension (one row per language), read as one ordered scan.
    """
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    missing = [h for h in HEADER if h not in raw.columns]
    if missing:
        raise LanguageFileError(f"languages file lacks columns {missing}")
    rows = raw.select(*[F.trim(F.col(f"`{h}`")).alias(o) for h, o in zip(HEADER, OUT)]).withColumn(
        "__line", F.monotonically_increasing_id())
    ok = rows.where(F.coalesce(F.length("language"), F.lit(0)) > 0)
    ok = ok.where((F.coalesce(F.length("code"), F.lit(0)) > 0) & (F.coalesce(F.length("namespace"), F.lit(0)) > 0))
    w = Window.partitionBy("namespace").orderBy(F.desc("__line"))
    out = ok.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1).drop("__r", "__line")
    if out.isEmpty():
        raise LanguageFileError("languages file has no usable rows")
    return out


def metadata_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON list of metadata records (codes, languages, projects, namespaces)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
