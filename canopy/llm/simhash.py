"""SimHash near-duplicates through an inverted index over positional bytes.

A fingerprint has eight bytes.  Two that differ in at most d bits differ in at most d
bytes, so they share 8 - d positional bytes: the guaranteed minimum.  The index has a
posting for every choice of ``8 - d - 1`` bytes out of the first seven (any seven positions
hold at least that many shared ones).  Inside a posting the shared positional bytes of a
pair are tallied, pairs below the minimum are dropped and the rest verified by their bits.

A posting gives a spanning forest of its links, at most one row per member, never all
pairs.  Small postings are compared pair by pair; a large one is split by each byte that is
still free, and where a split is large too, its three free bytes index a bitmap of 2 ** 24
values in which every neighbour within d bits is looked up, so the work stays linear and
the memory bounded.  Components are found over distinct fingerprints only.

Cases: a null or empty text has fingerprint 0, linked like any other; rows with a null id
get the smallest id of their component (null if it has none); repeated rows share their
fingerprint; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.common import materialise
from canopy.llm.graph import components

SHINGLE = 3
MAX_BITS = 3
SMALL = 64
LARGE = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    import xxhash
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < shingle else list(map(b" ".join, zip(*(w[i:] for i in range(shingle)))))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), 65536):
        part = grams[at:at + 65536]
        h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in part), "<u8", len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, fp long")


def _choices(max_bits: int) -> list[tuple[int, ...]]:
    return list(combinations(range(7), 7 - max_bits))


def _postings(fps: DataFrame, max_bits: int) -> DataFrame:
    """``key, fp`` for every posting a fingerprint stands in; the key holds the chosen bytes and the choice."""
    keys = []
    for number, chosen in enumerate(_choices(max_bits), 1):
        mask = sum(0xFF << (8 * b) for b in chosen)
        free = next(b for b in range(8) if b not in chosen)
        signed = np.uint64(mask).astype(np.int64), np.uint64(number << (8 * free)).astype(np.int64)
        keys.append(F.col("fp").bitwiseAND(F.lit(int(signed[0]))).bitwiseOR(F.lit(int(signed[1]))))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def linked(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs share the guaranteed minimum of positional bytes and then differ in few enough bits."""
    x = a ^ b
    shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1)
    out = shared >= 8 - max_bits
    out[out] = np.bitwise_count(x[out]) <= max_bits
    return out


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the sets of i and j, pair by pair, in the array of roots."""
    while len(i):
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]


def _pairwise(x: np.ndarray, max_bits: int) -> np.ndarray:
    root = np.arange(len(x))
    for at in range(0, len(x), 128):
        i, j = np.nonzero(linked(np.repeat(x[at:at + 128, None], len(x), 1), np.repeat(x[None], min(128, len(x) - at), 0),
                                 max_bits))
        _join(root, i + at, j)
    return root


def _bitmap(x: np.ndarray, fixed: tuple[int, ...], max_bits: int) -> np.ndarray:
    """Roots of distinct fingerprints that agree in the ``fixed`` five bytes or more."""
    free = [b for b in range(8) if b not in fixed][:3]
    code = np.zeros(len(x), np.int64)
    for b in free:
        code = code << 8 | (x >> np.uint64(8 * b) & np.uint64(255)).astype(np.int64)
    place = np.full(1 << 24, -1, np.int32)
    place[code] = np.arange(len(x))
    root = np.arange(len(x))
    for n in range(1, max_bits + 1):
        for bits in combinations(range(24), n):
            other = place[code ^ sum(1 << b for b in bits)]
            hit = np.flatnonzero(other >= 0)
            hit = hit[root[hit] != root[other[hit]]]
            _join(root, hit, other[hit].astype(np.int64))
    return root


def forest(x: np.ndarray, max_bits: int, small: int = LARGE) -> np.ndarray:
    """Roots (positions) of the components of one posting's distinct fingerprints."""
    if len(x) <= small:
        return _pairwise(x, max_bits)
    same = [b for b in range(8) if len(np.unique(x >> np.uint64(8 * b) & np.uint64(255))) == 1]
    root = np.arange(len(x))
    if len(same) >= 5:
        return _bitmap(x, tuple(same[:5]), max_bits)
    for b in (b for b in range(8) if b not in same):  # linked members agree in one of these at least
        value = x >> np.uint64(8 * b) & np.uint64(255)
        for v in np.unique(value):
            rows = np.flatnonzero(value == v)
            if len(rows) > 1:
                _join(root, rows, rows[forest(x[rows], max_bits, small)])
    return root


def _links(postings: DataFrame, max_bits: int) -> DataFrame:
    """``a, b``: for each posting a forest over its linked members."""

    def solve(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        root = np.arange(len(fp))
        group = np.repeat(np.arange(len(starts)), sizes)
        end = (starts + sizes)[group]
        mid = sizes[group] <= SMALL
        i = np.flatnonzero(mid & (sizes[group] > 1))
        pairs = []
        for step in range(1, SMALL):
            i = i[i + step < end[i]]
            if not len(i):
                break
            ok = linked(fp[i], fp[i + step], max_bits)
            pairs.append((i[ok], i[ok] + step))
        if pairs:
            _join(root, np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
        for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            root[s:s + n] = forest(fp[s:s + n], max_bits) + s
        hit = np.flatnonzero(root != np.arange(len(fp)))
        if not len(hit):
            return np.zeros((0, 2), np.uint64)
        return np.unique(np.stack([fp[root[hit]], fp[hit]], 1), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def give(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            e = solve(key, fp).view(np.int64)
            if len(e):
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            n += len(batch)
            if n < 200_000:
                continue
            key, fp = (np.concatenate(c) for c in zip(*held))
            whole = int(np.searchsorted(key, key[-1]))  # the last posting may go on in the next batch
            if whole:
                yield from give(key[:whole], fp[:whole])
            held, n = [(key[whole:], fp[whole:])], len(key) - whole
        if n:
            yield from give(*(np.concatenate(c) for c in zip(*held)))

    return postings.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, root, component_id``: the smallest id among all documents reachable over links.

    ``root`` is a fingerprint that stands for the component.
    """
    if not 0 < max_bits <= 3:
        raise ValueError("max_bits must be 1, 2 or 3")
    fps = materialise(fingerprints(docs, shingle), "simhash-fps")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    links = _links(_postings(distinct.select("fp"), max_bits), max_bits)
    roots = components(links).withColumnRenamed("node", "fp")
    named = roots.join(distinct, "fp")
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = roots.join(lowest, "root")
    by_fp = distinct.join(moved, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first_id").alias("component_id"))
    return fps.join(by_fp, "fp").select("doc_id", "fp", "root", "component_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id.

    Ids that occur once are kept or not by a semi join.  Rows that share an id, or have
    none, are told apart by their text; of equal claims the smallest text stays.
    """
    found = materialise(near_duplicates(docs, shingle, max_bits), "simhash-found")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    per_id = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(first).alias("keep")) \
        .filter("keep").select(F.col("doc_id").alias("_id"), "n")
    once = docs.join(per_id.filter("n = 1 AND _id IS NOT NULL"), F.col("doc_id") == F.col("_id"), "left_semi")
    several = materialise(docs.join(per_id.filter("n > 1 OR _id IS NULL"), F.col("doc_id").eqNullSafe(F.col("_id")),
                                    "left_semi").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")),
                          "simhash-several")
    texts = several.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "row")
    roots = found.filter(first).select(F.col("fp").alias("_fp"), F.col("root").alias("_root")).distinct()
    one = texts.withColumn("fp", _fingerprint_column(shingle)("text")).join(roots, F.col("fp") == F.col("_fp")) \
        .withColumn("place", F.row_number().over(Window.partitionBy("_root").orderBy("text", "fp"))) \
        .filter("place = 1").select("row.*")
    return once.unionByName(one)


def _fingerprint_column(shingle: int):
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t if isinstance(t, str) else None, shingle) for t in texts],
                                  np.uint64).view(np.int64))

    return run


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
