"""Text functions, all JVM-side column expressions.

Search normalisation: lower-case, fold the diacritics of Latin, Greek and Cyrillic letters,
split on anything that is not a letter, digit, mark or private-use character.  Diacritic folding uses ``translate`` with a table generated
from Unicode decomposition data (rule-built, not hand-listed), so it stays inside
whole-stage codegen instead of a Python UDF.
"""

from __future__ import annotations

import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_SPLIT = r"[^\p{L}\p{N}\p{M}\p{Co}]+"
#: marks written after a letter are folded for alphabets whose precomposed letters are folded too;
#: other scripts keep theirs (they are letters' vowels, not accents)
FOLD_SCRIPTS = r"\p{IsLatin}\p{IsGreek}\p{IsCyrillic}"


def _fold_table(lo: int = 0x00C0, hi: int = 0x2000) -> tuple[str, str]:
    """Map each lower-case precomposed letter (Latin, Greek, Cyrillic, ...) to its base letter."""
    src, dst = [], []
    for cp in range(lo, hi):
        ch = chr(cp)
        if ch != ch.lower():
            continue
        dec = unicodedata.normalize("NFD", ch)
        if len(dec) > 1 and all(unicodedata.combining(c) for c in dec[1:]) and dec[0] != ch:
            src.append(ch)
            dst.append(dec[0])
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _fold_table()


def normalize(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.translate(F.lower(c), FOLD_FROM, FOLD_TO), f"([{FOLD_SCRIPTS}])\\p{{M}}+", "$1")


def tokens(col: Column | str) -> Column:
    """array<string> of search tokens (empty strings removed)."""
    return F.filter(F.split(normalize(col), TOKEN_SPLIT), lambda t: t != F.lit(""))


def py_tokens(text: str) -> list[str]:
    """The same tokeniser for short driver-side strings (query text only)."""
    low = text.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))
    low = regex.sub(f"([{FOLD_SCRIPTS}])\\p{{M}}+", r"\1", low)
    return [t for t in regex.split(TOKEN_SPLIT, low) if t]


def embed_input(title: Column | str, abstract: Column | str, null_text: str = "None") -> Column:
    """Embedding input: ``title \\n abstract``; a missing abstract renders as ``null_text``."""
    t = F.col(title) if isinstance(title, str) else title
    a = F.col(abstract) if isinstance(abstract, str) else abstract
    return F.concat(t, F.lit("\n"), F.coalesce(a, F.lit(null_text)))


def halve_to_fit(text: Column | str, max_chars: int) -> Column:
    """Truncate by repeated halving (len//2 each time) until ``length <= max_chars``.

    Closed form: the fewest k with ``length >> k <= max_chars``; result is the first
    ``length >> k`` characters.  Empty input stays empty (callers treat it as an error).
    """
    t = F.col(text) if isinstance(text, str) else text
    n = F.length(t)
    k = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(62)),
                             lambda s: F.floor(n / F.pow(F.lit(2), s)) <= max_chars))
    return F.when(n <= max_chars, t).otherwise(
        t.substr(F.lit(1), F.floor(n / F.pow(F.lit(2), k)).cast("int")))


def snippet(title: Column | str, abstract: Column | str) -> Column:
    """Page evidence snippet: ``title`` or ``title: abstract`` when abstract is non-empty."""
    t = F.col(title) if isinstance(title, str) else title
    a = F.col(abstract) if isinstance(abstract, str) else abstract
    return F.when(F.coalesce(a, F.lit("")) == "", t).otherwise(F.concat(t, F.lit(": "), a))


def collapse_ws(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(c, r"\s+", " "))
