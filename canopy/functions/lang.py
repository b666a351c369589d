"""Language dimension (namespace -> language) and language-dependent constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The supported languages, one row each, as
# (language, iso code, namespace, English name, local name).
LANGUAGES = [
    ("Chinese", "zh", "zhwiki_namespace_0", "Chinese Wikipedia", "中文维基百科"),
    ("English", "en", "enwiki_namespace_0", "English Wikipedia", "English Wikipedia"),
    ("French", "fr", "frwiki_namespace_0", "French Wikipedia", "Wikipédia en français"),
    ("Spanish", "es", "eswiki_namespace_0", "Spanish Wikipedia", "Wikipedia en español"),
    ("Portuguese", "pt", "ptwiki_namespace_0", "Portuguese Wikipedia", "Wikipédia em português"),
    ("German", "de", "dewiki_namespace_0", "German Wikipedia", "Deutschsprachige Wikipedia"),
    ("Italian", "it", "itwiki_namespace_0", "Italian Wikipedia", "Wikipedia in italiano"),
    ("Russian", "ru", "ruwiki_namespace_0", "Russian Wikipedia", "Русская Википедия"),
    ("Japanese", "ja", "jawiki_namespace_0", "Japanese Wikipedia", "日本語版ウィキペディア"),
    ("Korean", "ko", "kowiki_namespace_0", "Korean Wikipedia", "한국어 위키백과"),
    ("Vietnamese", "vi", "viwiki_namespace_0", "Vietnamese Wikipedia", "Wikipedia tiếng Việt"),
    ("Thai", "th", "thwiki_namespace_0", "Thai Wikipedia", "วิกิพีเดียภาษาไทย"),
    ("Arabic", "ar", "arwiki_namespace_0", "Arabic Wikipedia", "ويكيبيديا العربية"),
    ("Egyptian Arabic", "arz", "arzwiki_namespace_0", "Egyptian Arabic Wikipedia", "ويكيبيديا المصرية"),
]

# Search language policy.  Only English is configured for whole-word
# matching; every other language gets a trailing prefix wildcard on the last word.
WHOLE_WORD_LANGUAGES = ("en",)

# Fixed value: sentence appended to the labelling system text.
SYSTEM_TEXT_SUFFIX = "Generated output should only be in {language}."

LANGUAGE_SCHEMA = T.StructType([
    T.StructField("language", T.StringType(), False),
    T.StructField("code", T.StringType(), False),
    T.StructField("namespace", T.StringType(), False),
    T.StructField("english_name", T.StringType(), False),
    T.StructField("local_name", T.StringType(), False),
])


def languages(spark: SparkSession) -> DataFrame:
    """The 14-row language dimension (bounded: safe to broadcast)."""
    rows = [r + (r[1] not in WHOLE_WORD_LANGUAGES,) for r in LANGUAGES]
    schema = T.StructType(LANGUAGE_SCHEMA.fields + [T.StructField("use_prefix", T.BooleanType(), False)])
    return spark.createDataFrame(rows, schema)


def languages_sql() -> str:
    """The same dimension as a SQL VALUES list (for oracle queries)."""
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"
    vals = ",\n  ".join(
        f"({q(a)}, {q(b)}, {q(c)}, {q(d)}, {q(e)}, {'false' if b in WHOLE_WORD_LANGUAGES else 'true'})"
        for a, b, c, d, e in LANGUAGES)
    return (f"SELECT * FROM (VALUES\n  {vals}\n) AS l(language, code, namespace, english_name, "
            f"local_name, use_prefix)")


def code_from_namespace(ns: Column) -> Column:
    """Fallback language code when a namespace is not in the dimension: ``<code>wiki_...``."""
    return F.regexp_extract(ns, r"^([a-z]+)wiki", 1)


def with_language(df: DataFrame, langs: DataFrame, ns_col: str = "namespace") -> DataFrame:
    """Left-join the (14-row, fixed) language dimension onto ``df`` by namespace."""
    return df.join(F.broadcast(langs.withColumnRenamed("namespace", ns_col)), ns_col, "left")


def system_text(base: str, language: Column) -> Column:
    """Labelling system text for a namespace language."""
    head, tail = SYSTEM_TEXT_SUFFIX.split("{language}")
    return F.concat(F.lit(f"{base} {head}"), language, F.lit(tail))
