"""A Merkle manifest of a dataset: a digest tree per group, a tree over the groups, proofs for all rows.

Every row is a leaf.  The leaves of a group are ranked, and the binary digits of the rank
are grouped away one after the other, the lowest first: each step puts the (two or, at the
end of a level, one) children of a node into its struct and hashes their digests.  A block
of ``2 ** bits`` leaves becomes one row of nested structs, all by group-bys that need no
exchange beyond the one by block; the roots of blocks are the leaves of the next tier, until a
group has one root.  Subroots are leaves of a last tree in the same way.  On the way down a
block's nested structs meet the path above them in one aggregate, and a transform over
the nested arrays with an explode gives every leaf its siblings, without a join.

Ranks come from a range partitioning: a row's place in its partition plus the rows of its
group in the partitions before, so no group is sorted or counted in one task.

Cases: nulls are part of a leaf as ``-``; a null group is a group of its own, before all
others; null ids come first; rows with one id follow their leaf, and rows that are wholly
equal share all values but their place; an empty table has no rows; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import materialise

#: Levels that one block spans.
BITS = 6
#: Rows of a range partition, while there are no more than four partitions a core.
ROWS_EACH = 20_000

PATH = "array<struct<side:int,digest:string>>"


def encoded(value: Column) -> Column:
    """A value inside a leaf: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*(encoded(v) for v in values)), 256)


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``rank`` and ``size`` of its group ``key``, ascending by ``order``.

    Rows that are equal in ``order`` are dealt out by ``salt``, a column of ``rows``.
    """
    parts = max(1, min(rows.sparkSession.sparkContext.defaultParallelism * 4, -(-rows.count() // ROWS_EACH)))
    by = ["key", *order, "salt"]
    placed = materialise(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
                         .withColumn("place", F.monotonically_increasing_id()), name)
    # a partition holds a group's rows side by side, so one shift turns their places into ranks
    part = F.shiftright("place", 33)
    counts = placed.groupBy("key", part.alias("part")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    shifts = counts.select("key", "part", "first", F.expr(
        "sum(n) OVER (PARTITION BY key ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").alias("before"),
        F.expr("sum(n) OVER (PARTITION BY key)").alias("size"))
    return placed.withColumn("part", part).join(shifts, ["key", "part"]) \
        .withColumn("rank", F.col("place") - F.col("first") + F.coalesce("before", F.lit(0))) \
        .drop("part", "first", "before", "place", "salt")


@dataclass
class Tier:
    """Blocks of one tier, one row each: ``key, block, size`` (leaves of the group), ``node`` (nested)."""

    blocks: DataFrame
    bits: int


def build_tier(leaves: DataFrame, payload: list[str], bits: int, name: str) -> Tier:
    """Group the rank digits of ``key, size, rank, digest, *payload`` away, block by block."""
    node = F.struct(F.col("digest").alias("digest"), *[F.col(p) for p in payload])
    rows = leaves.select("key", "size", F.shiftright("rank", bits).alias("block"),
                         *[F.shiftright("rank", b).bitwiseAND(1).cast("int").alias(f"d{b}") for b in range(bits)],
                         node.alias("node")).repartition("key", "block")
    for b in range(bits):
        rest = [f"d{k}" for k in range(b + 1, bits)]
        kids = F.array_sort(F.collect_list(F.struct(F.col(f"d{b}").alias("d"), F.col("node"))))
        rows = rows.groupBy("key", "block", "size", *rest).agg(kids.alias("kids"))
        joined = F.sha2(F.array_join(F.transform("kids", lambda k: k["node"]["digest"]), ""), 256)
        # a group whose level b is a single node already is at its root
        rows = rows.select("key", "block", "size", *rest, F.struct(
            F.when(_active(F.col("size"), b), joined).otherwise(F.col("kids")[0]["node"]["digest"]).alias("digest"),
            F.col("kids").alias("kids")).alias("node"))
    return Tier(materialise(rows, name), bits)


def _active(size: Column, level: int) -> Column:
    """Whether level ``level`` of a tree over ``size`` leaves still holds several nodes."""
    return F.shiftright(size - 1, level) > 0


def _above(kids: Column, kid: Column, active: Column, path: Column) -> Column:
    """The path of a child: its sibling's side (-1 left, 1 right, 0 none) and digest, then the parent's path."""
    other = F.when(kid["d"] == 0, F.when(F.size(kids) > 1, kids[1]["node"]["digest"])).otherwise(kids[0]["node"]["digest"])
    step = F.struct(F.when(F.isnull(other), 0).when(kid["d"] == 0, 1).otherwise(-1).cast("int").alias("side"),
                    F.coalesce(other, F.lit("")).alias("digest"))
    return F.when(active, F.concat(F.array(step), path)).otherwise(path)


def _emit(node: Column, level: int, size: Column, path: Column, payload: list[str]) -> Column:
    """An array of the leaves under ``node``, each with its path up to the root."""
    kids = node["kids"]

    def child(kid: Column) -> Column:
        up = _above(kids, kid, _active(size, level), path)
        if level:
            return _emit(kid["node"], level - 1, size, up, payload)
        return F.struct(kid["node"]["digest"].alias("digest"), up.alias("path"), *[kid["node"][p].alias(p) for p in payload])

    found = F.transform(kids, child)
    return F.flatten(found) if level else found


def _paths(tier: Tier, above: DataFrame, payload: list[str]) -> DataFrame:
    """``key, digest, path, roots, *payload`` for every leaf of a tier, given the paths of its blocks."""
    kind = tier.blocks.schema["node"].dataType
    down = tier.blocks.select("key", "block", "size", "node", F.lit(None).cast(above.schema["path"].dataType).alias("path"),
                              F.lit(None).cast(above.schema["roots"].dataType).alias("roots"))
    met = down.unionByName(above.select("key", "block", F.lit(None).cast("long").alias("size"),
                                        F.lit(None).cast(kind).alias("node"), "path", "roots")) \
        .groupBy("key", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("size", "node", "path", "roots")])
    return met.select("key", "roots", F.explode(_emit(F.col("node"), tier.bits - 1, F.col("size"), F.col("path"), payload))
                      .alias("leaf")).select("key", "roots", "leaf.*")


def _tiers(leaves: DataFrame, payload: list[str], bits: int, name: str) -> list[Tier]:
    """Tiers from the leaves up to one block for each key."""
    tiers = [build_tier(leaves, payload, bits, name)]
    while tiers[-1].blocks.agg(F.max("block").alias("m")).first().m:
        # the next tier's tree goes on where this one's blocks end
        up = tiers[-1].blocks.select("key", F.expr(f"shiftright(size - 1, {bits}) + 1").alias("size"),
                                     F.col("block").alias("rank"), F.col("node.digest").alias("digest"))
        tiers.append(build_tier(up.withColumn("unit", F.col("rank")), ["unit"], bits, name))
    return tiers


def _descend(tiers: list[Tier], tops: DataFrame, payload: list[str]) -> DataFrame:
    """Leaves with their paths; ``tops`` holds ``key, path, roots`` above each key's root."""
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for tier in reversed(tiers[1:]):
        above = _paths(tier, above, ["unit"]).withColumnRenamed("unit", "block").drop("digest")
    return _paths(tiers[0], above, payload)


def manifest(leaves: DataFrame, order: list[str], payload: list[str], bits: int = BITS) -> DataFrame:
    """``digest, path, subroot, root, *payload`` for every leaf.

    ``leaves`` holds ``key`` (the group, never null), ``digest``, ``order`` and ``payload`` columns.  ``path`` lists
    the siblings from the leaf to the root.
    """
    held = materialise(leaves.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "merkle-leaves")
    low = _tiers(ranked(held, order, "merkle-order"), payload, bits, "merkle-blocks")
    # the tree over groups: one group of its own, whose leaves are the subroots
    subroots = low[-1].blocks.select(F.lit("").alias("key"), F.col("key").alias("name"), F.col("node.digest").alias("digest"),
                                     F.lit(0).cast("long").alias("salt"))
    high = _tiers(ranked(subroots, ["name"], "merkle-groups"), ["name"], bits, "merkle-top")
    top = high[-1].blocks.select("key", F.array().cast(PATH).alias("path"),
                                 F.struct(F.col("node.digest").alias("root")).alias("roots"))
    named = _descend(high, top, ["name"])
    tops = named.select(F.col("name").alias("key"), "path", F.struct("roots.root", F.col("digest").alias("subroot"))
                        .alias("roots"))
    return _descend(low, tops, payload).select("digest", "path", "roots.subroot", "roots.root", *payload)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(
        F.when(s["side"] == 0, acc).when(s["side"] < 0, F.concat(s["digest"], acc)).otherwise(F.concat(acc, s["digest"])), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: s["digest"]), ""), 256)


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """Leaves of documents by language; ``other`` is the leaf after one more character is claimed, where ``tampered``."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c) for c in ("source", "lang", "n_chars", "text")])
    values = [d[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = [*values[:3], d["n_chars"] + F.lit(1), values[4]]
    return d.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("key"), "doc_id",
                    leaf_digest(*values).alias("digest"),
                    F.when(tampered & F.col("n_chars").isNotNull(), leaf_digest(*more)).alias("other"))


def verified_documents(docs: DataFrame, tampered: Column, bits: int = BITS) -> DataFrame:
    """Every document's leaf, roots and proof, and whether its (perhaps tampered) leaf folds to the root."""
    found = manifest(document_leaves(docs, tampered), ["doc_id", "digest"], ["doc_id", "other"], bits)
    return found.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("other", "digest"), F.col("path")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))
