"""Quality rules: a threshold table compiled into one Spark projection.

``measure`` computes the per-document counts, ``verdict`` turns a table of ratio rules
into one boolean column; both are plain column expressions, so a run is a single scan
with no shuffle and no user function.

Cases: a null or empty text has no words, so every count is 0; a rule whose denominator
is 0 counts as met (the length rule deals with such texts); repeated rows are measured
one by one; an empty table gives an empty result; other columns of the input, whatever
their names, are left out of the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import SPACE_CLASS

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four corpus languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "was", "on",
    "de", "la", "que", "el", "en", "y", "los", "del", "una", "con", "por",
    "le", "les", "des", "et", "un", "est", "pas", "dans", "du",
    "der", "die", "und", "das", "von", "den", "zu", "mit", "ein", "nicht",
)


@dataclass(frozen=True)
class Rule:
    """``low <= 1000 * top / bottom <= high`` on two counts (``bottom`` None: the plain count ``top``)."""

    name: str
    top: str
    bottom: str | None
    low: int | None = None
    high: int | None = None


#: Production thresholds (ratios in thousandths).
RULES = (
    Rule("length", "n_words", None, low=50),
    Rule("mean_word_length", "word_chars", "n_words", low=2_000, high=12_000),
    Rule("symbols_per_word", "n_symbols", "n_words", high=100),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=700),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=500),
    Rule("stop_words", "n_stop_words", "n_words", low=20),
)


def rule_sql(rule: Rule) -> str:
    """The rule as a SQL condition over the count columns, valid in Spark and in other engines."""
    bottom, scale = (rule.bottom, 1000) if rule.bottom else ("1", 1)
    parts = []
    if rule.low is not None:
        parts.append(f"{scale} * {rule.top} >= {rule.low} * {bottom}")
    if rule.high is not None:
        parts.append(f"{scale} * {rule.top} <= {rule.high} * {bottom}")
    return "(" + " AND ".join(parts or ["true"]) + ")"


def verdict_sql(rules: tuple[Rule, ...] = RULES) -> str:
    return " AND ".join(map(rule_sql, rules)) or "true"


def _spellings(stop_words: tuple[str, ...]) -> list[str]:
    return sorted({s for w in stop_words for s in (w, w.capitalize(), w.upper())})


def _covered(starts: Column) -> Column:
    """Positions covered by windows of three that begin at the ascending ``starts``."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, p: F.struct(
        (acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n"), (p + 3).alias("end"))
    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """One row per document: ``doc_id`` and the counts that the rules read (all long)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = docs.select(
        F.col(id_col).alias("doc_id"), F.length(text).alias("n_chars"),
        F.split(text, f"[{SPACE_CLASS}]").alias("parts"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != "").alias("lines"))
    # every separator is one character, so the parts give the number of white-space characters
    worded = cut.select("*", F.array_remove("parts", "").alias("w"),
                        (F.col("n_chars") - F.size("parts") + 1).alias("word_chars"))
    # windows are compared by their 64-bit hash, inside one text only
    hashed = worded.withColumn("g", F.transform(
        F.expr("slice(w, 1, greatest(size(w) - 2, 0))"),
        lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))))
    # equal windows stand side by side once sorted; a window is repeated if a neighbour equals it
    ordered = hashed.withColumn("tri", F.when(
        F.size(F.array_distinct("g")) < F.size("g"),
        F.array_sort(F.transform("g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    starts = F.array_sort(F.transform(
        F.filter(
            F.arrays_zip(F.col("tri").alias("x"),
                         F.expr("concat(array(cast(null as bigint)), slice(tri.g, 1, size(tri) - 1))").alias("before"),
                         F.expr("slice(tri.g, 2, size(tri))").alias("after")),
            lambda z: F.coalesce(z["x"]["g"] == z["before"], F.lit(False))
            | F.coalesce(z["x"]["g"] == z["after"], F.lit(False))),
        lambda z: z["x"]["i"]))
    stops = _spellings(stop_words)
    return ordered.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(starts), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter("w", lambda w: w.isin(stops))).cast("long").alias("n_stop_words"))


def verdict(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``base_failed`` (too short, or over half its words in repeated windows) and ``kept``."""
    base = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return measured.select("*", base.alias("base_failed"),
                           (~base & F.expr(verdict_sql(rules))).alias("kept"))
