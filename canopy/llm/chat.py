"""Chat formatting: a finite-state machine over roles and a declarative template.

Turns of a conversation are ordered by (turn, role, text), null turns last.  The machine
walks the roles and reports whether the order is allowed and the first turn that is not;
every conversation is formatted either way, so a caller filters on ``valid_order``.  The
template emits text segments with a loss flag each; control strings and backslashes inside
texts and roles are escaped with a backslash, which ``read_back`` undoes exactly.

Cases: a null role or text is empty text; a null conversation id is a conversation of its
own; repeated rows and equal turn numbers are kept, each as its own turn; an empty table
gives no rows; further columns of the input are ignored.  A conversation is one output
row, as its digests need all its text in order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: strings that must not appear inside a text, besides the three marks above
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
    #: state -> roles that may follow it; the state after a turn is its role
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",),
        "assistant": ("user", "tool"), "tool": ("assistant",)})

    @property
    def controls(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([self.start, self.middle, self.end.rstrip("\n"), *self.reserved]))


CHATML = Template()


def _lookahead(template: Template) -> str:
    """Matches the first character of every control string, so overlapping ones are all met."""
    by_first: dict[str, list[str]] = {}
    for c in template.controls:
        by_first.setdefault(c[0], []).append(re.escape(c[1:]))
    return "|".join(f"{re.escape(k)}(?={'|'.join(v)})" for k, v in by_first.items())


def escape(text: Column, template: Template = CHATML) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"({_lookahead(template)})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _machine(template: Template, turns: Column) -> Column:
    """Number of turns accepted before the first role that may not follow its state."""
    allowed = [f"{a}\u0000{b}" for a, bs in template.follows.items() for b in bs]
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("n"), F.lit(True).alias("ok"))

    def step(acc: Column, turn: Column) -> Column:
        ok = acc["ok"] & F.concat(acc["state"], F.lit("\u0000"), turn["role"]).isin(allowed)
        return F.struct(turn["role"].alias("state"), (acc["n"] + ok.cast("int")).alias("n"), ok.alias("ok"))

    return F.aggregate(turns, start, step, lambda acc: acc["n"])


def format_conversations(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """``conv_id, n_turns, valid_order, first_bad_turn, segments`` per conversation.

    ``segments`` is array<struct<text, loss>>; joined, they are the formatted conversation.
    ``first_bad_turn`` counts from 0 and is null if the order is allowed.
    """
    turn = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"),
                    F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.collect_list(turn).alias("turns"))
    walked = grouped.select("conv_id", F.array_sort("turns").alias("turns")) \
        .withColumn("accepted", _machine(template, F.col("turns")))

    def emit(t: Column) -> Column:
        head = F.concat(F.lit(template.start), escape(t["role"], template), F.lit(template.middle))
        off = F.lit(False)
        return F.array(F.struct(head.alias("text"), off.alias("loss")),
                       F.struct(escape(t["text"], template).alias("text"),
                                t["role"].isin(*template.loss_roles).alias("loss")),
                       F.struct(F.lit(template.end).alias("text"), off.alias("loss")))

    n = F.size("turns")
    return walked.select(
        "conv_id", n.cast("long").alias("n_turns"), (F.col("accepted") == n).alias("valid_order"),
        F.when(F.col("accepted") < n, F.col("accepted")).cast("long").alias("first_bad_turn"),
        F.flatten(F.transform("turns", emit)).alias("segments"))


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """``conv_id, formatted, turns (array<struct<role, text>>), loss_text`` parsed from the segments."""
    joined = formatted.select(
        "conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
        .alias("loss_text"))
    pieces = F.split("formatted", re.escape(template.end))
    # the text after the last end mark is empty
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.split(
        F.substring(p, len(template.start) + 1, 2147483647), re.escape(template.middle)))
    return joined.select("conv_id", "formatted", "loss_text", F.transform(
        turns, lambda t: F.struct(unescape(t[0]).alias("role"), unescape(t[1]).alias("text"))).alias("turns"))


def digests(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """Per conversation the counts and digests of what ``read_back`` finds in the output."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted, template).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
