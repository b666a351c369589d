"""Mixing sources to target weights with Sainte-Lague apportionment of equal-token blocks.

Each source's documents, in a seeded order, form one stream of words that is cut into
blocks of ``block`` words (the last one may be short).  The mix consists of ``shards``
shards; the blocks of all shards up to the k-th are apportioned to the sources by the
highest quotients target / (2 * seats - 1).  That rule never takes a seat back when the
house grows, so the difference of two steps is the integer quota of a source in a shard.
A source's quota picks its blocks along a seeded permutation of them; a quota above the
number of blocks begins a second pass.

Cases: a null text has size 0; a null source is a source of its own that sorts last;
a source without words has target 0; repeated rows are rows like any other, told apart by
position; an empty table gives an empty mix; further columns of the input are ignored.
The number of sources is taken to fit one task (their order and weights are global), the
documents never meet in one task: the stream position is a prefix sum over 4096 slots of
each source and a window inside a slot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from canopy.llm.common import SPACE_CLASS, words


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (3, 1, 2)
    volume: float = 1.5
    repeats: int = 2
    block: int = 64
    shards: int = 16
    seed: int = 17


def _order_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def sized(docs: DataFrame, mix: Mix = Mix(), carry: bool = False) -> DataFrame:
    """``doc_id, source, src, size, key, slot``: the word count and the seeded place of each document.

    ``src`` stands for the source in joins and orders: a null one sorts after all others.
    ``carry`` adds the whole input row as ``row``.
    """
    key = _order_key(F.col("doc_id"), mix.seed)
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1")).alias("src"),
        F.size(words(F.col("text"))).cast("long").alias("size"),
        key.alias("key"), F.substring(key, 1, 3).alias("slot"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []))


def targets(slots: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per source: ``src, source_size, rank, target``; slots: words per (src, slot).

    A source's share is proportional to its weight until it reaches ``repeats`` times its
    size; what is above goes to the others by weight.  Sorted by limit / weight, the
    sources at their limit come first, and the level of the others follows from the sums.
    """
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in mix.weights]),
                          (F.col("rank") % len(mix.weights) + 1).cast("int")).cast("double")
    per = slots.groupBy("src").agg(F.sum("size").alias("source_size")) \
        .withColumn("rank", F.row_number().over(Window.orderBy("src")) - 1) \
        .withColumn("w", weight) \
        .withColumn("limit", (F.col("source_size") * mix.repeats).cast("double")) \
        .withColumn("total", F.sum("source_size").over(every) * F.lit(mix.volume))
    by_ratio = Window.orderBy(F.col("limit") / F.col("w"), "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
                           / F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    # the first source, in this order, whose limit is above the level sets the level for the rest
    share = F.max(F.when(F.col("limit") / F.col("w") > F.col("level"), F.col("level"))).over(every)
    return level.select(
        "src", "source_size", "rank",
        F.least(F.col("limit"), F.coalesce(share * F.col("w"), F.col("limit"))).alias("target"))


def quotas(goals: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per source: ``src, n_blocks, upto`` (blocks the first k shards take, for each k) and ``quota``."""
    house = goals.withColumn("total", F.sum("target").over(Window.partitionBy())) \
        .withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(mix.shards)))) \
        .withColumn("seats", F.floor(F.round(F.col("total") / mix.block) * F.col("shard") / mix.shards))
    # rounding the exact share is the apportionment at one divisor; the seats it misses or
    # has too many, half the number of sources at most, go by the quotients next to it
    by_shard = Window.partitionBy("shard")
    first = house.withColumn("base", F.floor(F.coalesce(
        F.col("target") * F.col("seats") / F.nullif(F.col("total"), F.lit(0.0)), F.lit(0.0)) + 0.5)) \
        .withColumn("open", F.col("seats") - F.sum("base").over(by_shard))
    turn = first.filter("open <> 0 AND target > 0") \
        .withColumn("j", F.explode(F.sequence(F.lit(1), F.abs(F.col("open")).cast("int")))) \
        .withColumn("seat", F.when(F.col("open") > 0, F.col("base") + F.col("j"))
                    .otherwise(F.col("base") - F.col("j") + 1)) \
        .filter("seat >= 1") \
        .withColumn("quotient", F.col("target") / (2 * F.col("seat") - 1)) \
        .withColumn("place", F.row_number().over(by_shard.orderBy(
            F.when(F.col("open") > 0, -F.col("quotient")).otherwise(F.col("quotient")), "src", "j"))) \
        .filter(F.col("place") <= F.abs(F.col("open"))) \
        .groupBy("src", "shard").agg(F.sum(F.signum("open")).cast("long").alias("more"))
    fixed = first.join(turn, ["src", "shard"], "left") \
        .withColumn("n_blocks", F.ceil(F.col("source_size") / mix.block)) \
        .withColumn("upto", F.least(F.col("base") + F.coalesce("more", F.lit(0)), F.col("n_blocks") * mix.repeats))
    return fixed.groupBy("src").agg(
        F.max("n_blocks").alias("n_blocks"), F.max("upto").alias("quota"),
        F.transform(F.array_sort(F.collect_list(F.struct("shard", "upto"))), lambda x: x["upto"]).alias("upto"))


def _plan(docs: DataFrame, mix: Mix, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in the source's stream, and the sources' plan."""
    rows = sized(docs, mix, carry)
    slots = rows.groupBy("src", "slot").agg(F.sum("size").alias("size"))
    goals = targets(slots, mix)
    before = Window.partitionBy("src").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.select("src", "slot", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("slot_start"))
    order = ["key", "doc_id", "size"]
    if carry:  # rows that tie so far differ in what else they hold
        other = [F.col("row")[f.name] for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
        rows = rows.withColumn("tie", F.xxhash64(*other))
        order.append("tie")
    inside = Window.partitionBy("src", "slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(starts, ["src", "slot"]) \
        .withColumn("at", F.col("slot_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed, goals.join(quotas(goals, mix), "src")


def _pick(j: Column, mix: Mix) -> tuple[Column, Column]:
    """Place of block ``j`` in its source's seeded permutation, and how often the quota takes it."""
    n, quota = F.col("n_blocks"), F.col("quota")
    prime = F.when(n % 1000003 == 0, F.lit(999983)).otherwise(F.lit(1000003))  # coprime to n
    place = (j * (prime % n) + mix.seed * 7919 + F.col("rank") * 104729) % n
    return place, F.floor(quota / n) + F.when(place < quota % n, 1).otherwise(0)


def _block_numbers(mix: Mix) -> Column:
    """Blocks of the source's stream that a document with words reaches into."""
    return F.sequence(F.floor(F.col("at") / mix.block), F.floor((F.col("at") + F.col("size") - 1) / mix.block))


def mix_pieces(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: ``doc_id, source, start, length, pass, shard`` per picked piece (words of a document)."""
    placed, plan = _plan(docs, mix)
    place, times = _pick(F.col("j"), mix)
    picked = placed.filter("size > 0").join(plan, "src").withColumn("j", F.explode(_block_numbers(mix))) \
        .withColumn("place", place).withColumn("times", times).filter("times > 0") \
        .withColumn("start", F.greatest(F.col("j") * mix.block - F.col("at"), F.lit(0))) \
        .withColumn("length", F.least((F.col("j") + 1) * mix.block - F.col("at"), F.col("size")) - F.col("start")) \
        .withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    number = F.col("place") + (F.col("pass") - 1) * F.col("n_blocks")
    shard = F.size(F.filter("upto", lambda u: u <= number))
    return picked.select("doc_id", "source", "start", "length", "pass", shard.alias("shard"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per document ``doc_id, source, size, source_size, target, taken`` (the sum over its picked pieces)."""
    placed, plan = _plan(docs, mix)

    def share(j: Column) -> Column:
        upper = F.least((j + 1) * mix.block, F.col("at") + F.col("size"))
        return (upper - F.greatest(j * mix.block, F.col("at"))) * _pick(j, mix)[1]

    zero = F.lit(0).cast("long")
    taken = F.when(F.col("size") > 0, F.aggregate(_block_numbers(mix), zero, lambda acc, j: acc + share(j)))
    return placed.join(plan, "src").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce(taken, zero).alias("taken"))


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix as documents: for each pass over a source a row with the words it takes of a document.

    All columns of ``docs`` are kept; ``text`` holds the picked words with the white space
    before each.  A document of which nothing is taken has no row.
    """
    placed, plan = _plan(docs, mix, carry=True)
    parts = F.regexp_extract_all(F.col("row.text"), F.lit(f"[{SPACE_CLASS}]*[^{SPACE_CLASS}]+"), F.lit(0))
    passes = placed.filter("size > 0").join(plan, "src") \
        .withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(mix.repeats)))) \
        .withColumn("picked", F.filter(_block_numbers(mix), lambda j: _pick(j, mix)[1] >= F.col("pass"))) \
        .filter(F.size("picked") > 0).withColumn("parts", parts)

    def words_of(j: Column) -> Column:
        first = F.greatest(j * mix.block - F.col("at"), F.lit(0))
        last = F.least((j + 1) * mix.block - F.col("at"), F.col("size"))
        return F.array_join(F.slice("parts", (first + 1).cast("int"), (last - first).cast("int")), "")

    # a second use of ``parts`` keeps the optimizer from splitting the text anew for every block
    text = F.when(F.size("parts") > 0, F.array_join(F.transform("picked", words_of), ""))
    return passes.withColumn("taken_text", text).select(
        *(F.col("taken_text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
