"""MinHash near-duplicates: one-permutation sketches, banded buckets, star-shaped candidates.

A document's set holds the 64-bit hashes of its distinct word shingles.  One permutation
(the order of the hashes) is cut into ``bands * rows`` equal bins; a bin keeps its smallest
hash, and an empty bin takes that of the first filled bin in an order of its own (optimal
densification), so a bin of two sets agrees with a probability of their similarity.  The
bins of a band are a bucket key: at similarity 0.8 a pair misses all 40 bands of 4 bins
with a probability of 7e-10.

Equal sets are one node.  In a bucket every node is a candidate of the bucket's smallest
node only, a star, so pairs stay linear in the nodes.  Candidates are confirmed on full
sets: a node's most frequent star first, others only where the two ends are not connected
by then.  A star can miss a link between two of its tips, so buckets whose members are
still in several components are compared once more, piece by piece inside tasks: sketches
choose the members that may have a link to another component, and full sets decide.  Pairs
whose sketches agree in fewer than ``least_share`` of the bins are five standard deviations
from a similarity of 0.8 and are the only ones never confirmed.

Cases: a text without words is an empty set, linked with nothing, not even its like; a null
text likewise; fewer words than a shingle are one shingle; copies are linked; rows with a
null id get the smallest id of their component (null if it has none); rows that share an id
are nodes of their own texts; an empty table has no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import materialise
from canopy.llm.graph import components


@dataclass(frozen=True)
class Settings:
    shingle: int = 4
    #: two sets are linked if their similarity is at least this many hundredths
    percent: int = 80
    bands: int = 40
    rows: int = 4
    #: share of equal bins below which a pair of sketches is not confirmed
    least_share: float = 0.64
    #: members of a bucket that are compared in one task at a time
    piece: int = 1024
    #: candidates of one node that one task confirms
    fan: int = 512
    seed: int = 7


class _WordHashes(dict):
    """Word -> 64-bit hash; emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > 500_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: _WordHashes, size: int) -> np.ndarray:
    """Ascending hashes of the distinct shingles of a text (A-Z lowered)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    if not width:
        return h
    with np.errstate(over="ignore"):
        out = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - width + 1 + k])
    return np.unique(out)


class Sketcher:
    """Bins, bucket keys and byte sketches of shingle sets."""

    def __init__(self, s: Settings):
        self.s, self.bins = s, s.bands * s.rows
        rng = np.random.default_rng(s.seed)
        # the place of bin j in the order in which empty bin i looks for a filled one
        self.order = np.argsort(rng.random((self.bins, self.bins)), axis=1).astype(np.int32)
        self.salt = rng.integers(1, 1 << 63, s.bands, dtype=np.uint64)

    def values(self, items: np.ndarray) -> np.ndarray:
        at = ((items >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        filled, first = np.unique(at, return_index=True)
        take = np.full(self.bins, -1)
        take[filled] = first
        empty = np.flatnonzero(take < 0)
        if len(empty):
            take[empty] = first[self.order[np.ix_(empty, filled)].argmin(axis=1)]
        return items[take]

    def keys(self, values: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = self.salt
            for column in values.reshape(self.s.bands, self.s.rows).T:
                out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
        return out


SKETCH = "doc_id long, n int, sig binary, keys array<long>, sketch binary"


def sketches(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """A row per document; ``sig`` (of the set), ``keys`` and ``sketch`` are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        sketcher, hashes = Sketcher(s), _WordHashes()
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                n, sig, keys, sketch = [], [], [], []
                for text in batch.column(1):
                    items = shingle_set(text.as_py(), hashes, s.shingle)
                    n.append(len(items))
                    if not len(items):
                        sig.append(None), keys.append(None), sketch.append(None)
                        continue
                    values = sketcher.values(items)
                    sig.append(xxhash.xxh3_128_digest(items.tobytes()))
                    keys.append(sketcher.keys(values).view(np.int64))
                    sketch.append(values.astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int32()), pa.array(sig, pa.binary()),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    names=["doc_id", "n", "sig", "keys", "sketch"])

    return _texts(docs).mapInArrow(run, SKETCH)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def look_up(rows: DataFrame, values: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` left joined to ``values`` on ``key``, hot keys apart.

    ``weight`` is the number of rows of a key; the keys with a thousandth of all ``total`` rows
    or more, at most a thousand, are broadcast, so none of them fills a task.
    """
    hot = values.filter(F.col(weight) * 1000 >= total).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot.select(key, "_hot")), key, "left")
    few = marked.filter("_hot").drop("_hot").join(F.broadcast(hot.drop("_hot")), key)
    rest = marked.filter("_hot IS NULL").drop("_hot").join(values, key, "left")
    return few.unionByName(rest)


def _sets(docs: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """``node, items`` for the sets of ``nodes`` (node, sig, first_id), read again from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        hashes = _WordHashes()
        for whole in batches:
            for at in range(0, len(whole), 500):
                items = [shingle_set(t.as_py(), hashes, s.shingle) for t in whole.column(0).slice(at, 500)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(i.tobytes()) for i in items], pa.binary()),
                     pa.array([i.view(np.int64) for i in items], pa.list_(pa.int64()))], names=["sig", "items"])

    wanted = nodes.select(F.col("first_id").alias("_id")).distinct()
    texts = _texts(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    found = texts.mapInArrow(run, "sig binary, items array<long>").join(nodes.select("sig", "node"), "sig")
    return found.select("node", "items").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The ``pairs`` (a, b) that are similar; a node with many partners is dealt to several tasks."""
    degree = pairs.groupBy("a").agg(F.count("*").alias("degree"))
    total = pairs.count()
    wide = look_up(pairs, degree, "a", "degree", total) \
        .withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("degree") / s.fan)).cast("long")).drop("degree")
    first = sets.join(degree, F.col("node") == F.col("a")).select(
        "a", F.col("items").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("degree") / s.fan) - 1)).alias("part"))
    both = wide.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b").join(first, ["a", "part"])
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y")).alias("sizes")) \
        .filter(F.col("shared") * (100 + s.percent) >= F.col("sizes") * s.percent).select("a", "b")


def _apart(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Pairs whose ends are in different components."""
    if roots is None:
        return pairs
    return pairs.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left") \
        .filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _open_buckets(members: DataFrame, roots: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """Members of the buckets that hold several components, in pairs of pieces.

    ``key, band, p, q`` name a pair of pieces; ``own, node, root, n, sketch`` a member.
    """
    seen = members.join(roots, "node", "left").select("key", "band", "node", F.coalesce("root", "node").alias("root"))
    still = seen.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("m")) \
        .filter("r0 < r1")
    pieces = F.ceil(F.col("m") / s.piece)
    dealt = seen.join(still.select("key", "m"), "key") \
        .withColumn("own", F.pmod(F.xxhash64("node"), pieces)) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    return dealt.select("key", "band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own",
                        "node", "root").join(nodes.select("node", "n", "sketch"), "node")


def _by_group(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the Arrow table of every (key, p, q); it gives a record batch or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            marks = np.stack([held.column(c).to_numpy() for c in ("key", "p", "q")])
            edges = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            if len(edges):
                cuts = [0, *edges.tolist()]
                for x, y in zip(cuts, cuts[1:]):
                    out = work(held.slice(x, y - x))
                    if out is not None:
                        yield out
                held = held.slice(cuts[-1]).combine_chunks()
        if held is not None and len(held):
            out = work(held)
            if out is not None:
                yield out

    return rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "node").mapInArrow(run, schema)


def _may_link(t: pa.Table, s: Settings) -> np.ndarray:
    """Members that have a partner in another component with a like size and sketch.

    A pair that shares an earlier band is left to the bucket of that band.
    """
    node, root, own, n = (t.column(c).to_numpy() for c in ("node", "root", "own", "n"))
    n = n.astype(np.int64)
    band = t.column("band")[0].as_py()
    one_piece = t.column("p")[0].as_py() == t.column("q")[0].as_py()
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
    marked = np.zeros(len(node), bool)
    for i in range(len(node) - 1):
        j = np.arange(i + 1, len(node))
        ok = (root[j] != root[i]) & (100 * np.minimum(n[j], n[i]) >= s.percent * np.maximum(n[j], n[i]))
        if not one_piece:
            ok &= own[j] != own[i]
        j = j[ok]
        if not len(j):
            continue
        equal = sketch[j] == sketch[i]
        hit = equal.sum(axis=1) >= s.least_share * s.bands * s.rows
        if band and hit.any():
            hit[hit] = ~equal[hit].reshape(-1, s.bands, s.rows)[:, :band].all(axis=2).any(axis=1)
        if hit.any():
            marked[i] = True
            marked[j[hit]] = True
    return marked


def _shared(items: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections of a few thousand sets, by products of their incidence columns."""
    owner = np.repeat(np.arange(len(items)), [len(x) for x in items])
    _, at, count = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    common = count > 1  # an item of one set alone is in no intersection
    number = np.cumsum(common) - 1
    keep = common[at]
    owner, at = owner[keep], number[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(items), len(items)), np.float32)
    for low in range(0, int(common.sum()), width):
        x, y = np.searchsorted(at, [low, low + width])
        part = np.zeros((len(items), width), np.float32)
        part[owner[x:y], at[x:y] - low] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _linked(t: pa.Table, s: Settings) -> list[tuple[int, int]]:
    """A forest over the members of a group that are linked on their full sets."""
    node, root = t.column("node").to_numpy(), t.column("root").to_numpy()
    items = [x.values.to_numpy() for x in t.column("items")]
    n = np.array([len(x) for x in items])
    shared = _shared(items)
    link = shared * (100 + s.percent) >= s.percent * (n[:, None] + n[None, :])
    link |= root[:, None] == root[None, :]  # connected already
    free, out = np.ones(len(node), bool), []
    for i in range(len(node)):
        if not free[i]:
            continue
        tree = np.zeros(len(node), bool)
        edge = np.arange(len(node)) == i
        while edge.any():
            tree |= edge
            edge = link[edge].any(axis=0) & ~tree
        free &= ~tree
        firsts = {int(root[k]): int(node[k]) for k in np.flatnonzero(tree)[::-1]}
        ends = sorted(firsts.values())
        out += [(ends[0], e) for e in ends[1:]]
    return out


def _tip_links(members: DataFrame, roots: DataFrame, nodes: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links between components that share a bucket: sketches choose the members, full sets decide inside tasks.

    Rows grow with the members of open buckets only: pairs are compared in blocks of a piece
    against a piece and never written, but for a forest of the links found.
    """
    def choose(t: pa.Table):
        marked = _may_link(t, s)
        if marked.any():
            return t.select(["key", "p", "q", "node", "root"]).filter(pa.array(marked)).combine_chunks().to_batches()[0]
        return None

    def decide(t: pa.Table):
        found = _linked(t, s)
        if found:
            e = np.array(found, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])
        return None

    chosen = _by_group(_open_buckets(members, roots, nodes, s), choose, "key long, p long, q long, node long, root long")
    chosen = materialise(chosen, "minhash-chosen")
    return _by_group(chosen.join(sets, "node"), decide, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the smallest id reachable over links of similar sets."""
    base = materialise(sketches(docs, s), "minhash-sketches")
    nodes = materialise(base.filter("sig IS NOT NULL").groupBy("sig").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("copies"),
        *[F.first(c).alias(c) for c in ("n", "keys", "sketch")])
        .withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")
    keyed = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    stars = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("size")).filter("size > 1")
    members = materialise(look_up(keyed, stars, "key", "size", nodes.count() * s.bands).filter("hub IS NOT NULL")
                          .select("key", "band", "node", "hub"), "minhash-members")
    sizes = nodes.select("node", "n")
    stars = members.filter("node <> hub").groupBy(F.col("hub").alias("a"), F.col("node").alias("b")) \
        .agg(F.count("*").alias("times")).join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b") \
        .filter(100 * F.least("na", "nb") >= s.percent * F.greatest("na", "nb")).select("a", "b", "times")
    stars = materialise(stars, "minhash-stars")
    links, roots = None, None
    if not stars.isEmpty():
        chosen = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "sig", "first_id")
        sets = materialise(_sets(docs, chosen, s), "minhash-sets")
        best = stars.groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a")).select("a", "b")

        def confirm(pairs: DataFrame, known: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
            pairs = materialise(pairs, "minhash-pairs")
            if pairs.isEmpty():
                return known, roots
            found = materialise(_confirmed(pairs, sets, s), "minhash-links")
            if found.isEmpty():
                return known, roots
            known = found if known is None else known.union(found)
            return known, components(known)

        links, roots = confirm(best, links)
        links, roots = confirm(_apart(stars.join(best, ["a", "b"], "left_anti").select("a", "b"), roots), links)
        nothing = nodes.limit(0).select("node", F.col("node").alias("root"))
        tips = materialise(_tip_links(members, nothing if roots is None else roots, nodes, sets, s), "minhash-tips")
        if not tips.isEmpty():
            roots = components(tips if links is None else links.union(tips))
    named = nodes.select("node", "sig", "first_id", "copies")
    if roots is not None:
        lowest = named.join(roots, "node").groupBy("root").agg(F.min("first_id").alias("low"))
        named = named.join(roots.join(lowest, "root").select("node", "low"), "node", "left") \
            .withColumn("first_id", F.coalesce("low", "first_id"))
    named = materialise(named.select("sig", F.col("first_id").alias("component_id"), "copies"), "minhash-named")
    rows = base.select("doc_id", "n", "sig")
    found = look_up(rows.filter("sig IS NOT NULL"), named, "sig", "copies", base.count()) \
        .select("doc_id", "n", "component_id")
    return found.union(rows.filter("sig IS NULL").select("doc_id", "n", "doc_id")) \
        .select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
