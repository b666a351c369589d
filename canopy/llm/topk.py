"""Exact top-k by integer inner product with norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets.  A query first meets the bucket of the
longest vectors, which gives it a score that its k-th result cannot fall below.  For every
other bucket that score, over the query's length and the bucket's longest vector, is the
local cosine threshold: above 1 the bucket is skipped, a high one prunes by coordinates
(the range that a unit vector's largest query coordinates allow), a low one by length (the
bucket's prefix that is long enough).  What is left is verified by exact products.

Groups of queries meet shares of the buckets, a pair of them in a task, which keeps at most
k rows a query and raises the query's score by them.  Of many buckets the longest sixteenth
comes before the others, so that few rows of those are above the score.  Nothing that grows
with the table passes through the driver but the sample that ranges of lengths are cut by.

Cases: rows with a null id, a null vector or null, NaN or infinite components take no part;
vectors of unequal width are compared as if padded with zeros; rows with the query's own id
are never its results; every query row is answered by itself, so rows that share an id give k
results each, and rows that are equal give the same ones; equal scores go by the smaller id; fewer rows than k give fewer
results; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.common import materialise

BUCKET_ROWS = 8192
QUERY_ROWS = 512
#: a range of lengths that is sorted by itself, and so many ranges at least if there are buckets for them
RANGE_BUCKETS = 16
#: queries that a task holds at a time, with their results so far
HELD_QUERIES = 1 << 17
#: rows and columns of a product, and results that wait until only the best of them are kept
PRODUCT_ROWS = 256
PRODUCT_COLUMNS = 2048
MOST_WAITING = 1 << 20
#: from this local cosine on, coordinates prune better than lengths
COORD_FROM = 0.8
FOCUS = 4


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id, v, norm2``: floor(scale * x) of every component, and the squared length."""
    x = F.col("embedding")
    bad: Column = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad) \
        .select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v")) \
        .withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))


def _matrix(rows: pa.ListArray) -> np.ndarray:
    """The rows padded with zeros to one width, in the narrowest integers that hold them."""
    values, lengths = rows.flatten().to_numpy(), rows.value_lengths().to_numpy()
    low, high = values.min(initial=0), values.max(initial=0)
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), kind)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


BLOCK = "block long, n int, width int, size int, longest double, ids binary, own binary, low binary, matrix binary"


def _blocks(rows_each: int):
    """Packs the rows of a partition into blocks of integer matrices, in their order (longest vectors first)."""

    def pack(part: pa.Table, number: int) -> pa.RecordBatch:
        matrix = _matrix(part["v"].combine_chunks())
        ids, own, low = (part[c].to_numpy().astype(np.int64).tobytes() if c in part.column_names else b"" for c in ("vec_id", "own", "low"))
        row = (number, *matrix.shape, matrix.itemsize, float(np.sqrt(part["norm2"].to_numpy().max())), ids, own, low, matrix.tobytes())
        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
        names, types = zip(*(c.split() for c in BLOCK.split(", ")))
        return pa.RecordBatch.from_arrays([pa.array([x], kinds[t]) for x, t in zip(row, types)], list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        base, made, held = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= rows_each:
                rows = pa.Table.from_batches(held)
                yield pack(rows.slice(0, rows_each), base + made)
                made, held = made + 1, rows.slice(rows_each).to_batches()
        if sum(map(len, held)):
            yield pack(pa.Table.from_batches(held), base + made)

    return run


#: an integer below every score, and the floor of a query that has none
NEVER = np.iinfo(np.int64).min
NONE = NEVER + 1


def _padded(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m


class Asked:
    """Query rows that are held at a time, and the k best rows met so far for each.

    ``own`` holds the vector ids that are no results of a query, ``low`` scores that its k-th result cannot fall below.
    """

    def __init__(self, ids: np.ndarray, own: np.ndarray, low: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.own, self.low, self.q, self.k = ids, own, low.copy(), q, k
        self.lengths = np.concatenate([np.sqrt((q[at:at + 8192].astype(float) ** 2).sum(axis=1)) for at in range(0, len(q), 8192)])
        self.largest = max(abs(int(q.min(initial=0))), int(q.max(initial=0)))
        self.found, self.waiting = [(np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))], 0

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.found.append((rows.astype(np.int32), ids, scores.astype(np.int64)))
        self.waiting += len(rows)
        if self.waiting > MOST_WAITING:
            self.settle()

    def settle(self) -> None:
        """Only the k best of each query stay, and the last of k is its floor."""
        parts, self.found = list(zip(*self.found)), []
        rows, ids, scores = (np.concatenate(parts.pop(0)) for _ in range(3))  # each part is let go as it is copied
        order = np.lexsort((ids, np.negative(scores, out=scores), rows))
        starts = np.searchsorted(rows[order], np.arange(len(self.ids) + 1, dtype=np.int32))
        order = order[np.arange(len(order)) - starts[rows[order]] < self.k]
        self.found, self.waiting = [(rows[order], ids[order], -scores[order])], 0
        ends = np.searchsorted(self.found[0][0], np.arange(len(self.ids), dtype=np.int32), side="right")
        full = np.flatnonzero(np.diff(ends, prepend=0) == self.k)
        self.low[full] = np.maximum(self.low[full], self.found[0][2][ends[full] - 1])

    def best(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """The at most k best of these rows are kept for query i."""
        ok = (scores >= self.low[i]) & (ids != self.own[i])
        ids, scores = ids[ok], scores[ok]
        if len(scores) > self.k:
            ok = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[ok], scores[ok]
        order = np.lexsort((ids, -scores))[:self.k]
        self.add(np.full(len(order), i), ids[order], scores[order])

    def meet(self, ids: np.ndarray, p: np.ndarray) -> None:
        """Verifies what is not pruned of a bucket, which is sorted by falling length."""
        width = max(self.q.shape[1], p.shape[1])
        p = _padded(p, width)
        bound = float(self.largest) * max(abs(int(p.min(initial=0))), int(p.max(initial=0))) * width
        kind = np.float32 if bound < 2.0 ** 24 else np.float64 if bound < 2.0 ** 53 else np.int64  # products stay exact
        pn, qn, low = np.sqrt((p.astype(float) ** 2).sum(axis=1)), self.lengths, np.where(self.low > NONE, self.low, -np.inf)
        flat, slack = p.astype(kind), 1e-9
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where((qn > 0) & (pn[0] > 0), low / (qn * pn[0]), np.where(low > 0, np.inf, -np.inf))
            least = np.where(qn > 0, low / qn, -np.inf)
        # vectors shorter than the threshold over the query's length cannot reach it
        prefix = np.where(least > 0, np.searchsorted(-pn, -least * (1 - slack), side="right"), len(ids))
        live = np.flatnonzero((local <= 1 + slack) & (prefix > 0))
        by_coord = live[local[live] >= COORD_FROM]
        by_length = live[local[live] < COORD_FROM]
        by_length = by_length[np.argsort(prefix[by_length], kind="stable")]
        by_id = np.argsort(ids, kind="stable")
        own_from, own_to = (np.searchsorted(ids[by_id], self.own, side=side) for side in ("left", "right"))

        room = np.empty(PRODUCT_ROWS * PRODUCT_COLUMNS, kind)
        for left in range(0, len(ids), PRODUCT_COLUMNS):
            long_enough = by_length[prefix[by_length] > left]
            for at in range(0, len(long_enough), PRODUCT_ROWS):
                rows = long_enough[at:at + PRODUCT_ROWS]
                n = min(int(prefix[rows[-1]]) - left, PRODUCT_COLUMNS)
                scores = np.matmul(_padded(self.q[rows], width).astype(kind), flat[left:left + n].T, out=room[:len(rows) * n].reshape(-1, n))
                for i in np.flatnonzero(own_to[rows] > own_from[rows]):
                    same = by_id[own_from[rows[i]]:own_to[rows[i]]] - left
                    scores[i, same[(same >= 0) & (same < n)]] = NEVER if kind is np.int64 else -np.inf
                floor = self.low[rows].astype(kind)
                some = np.flatnonzero(scores.max(axis=1) >= floor)
                if not len(some):
                    continue
                rows, scores, floor = rows[some], scores[some], floor[some]
                ok = scores >= floor[:, None]
                many = np.count_nonzero(ok, axis=1) > 4 * self.k
                for i in np.flatnonzero(many):
                    self.best(rows[i], ids[left:left + n], scores[i])
                ok[many] = False
                row, col = np.divmod(np.flatnonzero(ok), n)
                self.add(rows[row], ids[left + col], scores[row, col])
        if not len(by_coord):
            return
        unit = np.ascontiguousarray((p / np.maximum(pn, 1e-300)[:, None]).T)
        for i in by_coord:
            cand = np.arange(prefix[i])
            q = _padded(self.q[i:i + 1], width)[0]
            qu = q.astype(float) / qn[i]
            t = min(1.0, float(local[i]))
            for f in np.argsort(-np.abs(qu))[:FOCUS]:
                # where component f of a unit vector may lie if its cosine to the query is t or more
                reach = np.sqrt(max(0.0, (1 - t * t) * (1 - qu[f] ** 2))) + 1e-6
                x = unit[f, :prefix[i]] if len(cand) == prefix[i] else unit[f][cand]
                if -qu[f] < t and qu[f] < t:
                    cand = cand[(x >= qu[f] * t - reach) & (x <= qu[f] * t + reach)]
                elif -qu[f] < t:
                    cand = cand[x >= qu[f] * t - reach]
                elif qu[f] < t:
                    cand = cand[x <= qu[f] * t + reach]
            if len(cand):
                scores = flat[cand] @ q.astype(kind)
                some = np.flatnonzero(scores >= self.low[i])
                if len(some):
                    self.best(i, ids[cand[some]], scores[some])


FOUND = "query_id long, vec_id long, score long"


def _verify(k: int):
    """Results of every cell: its query blocks come first, then its buckets, longest vectors first."""

    def asked(blocks: list) -> Asked:
        ids, own, low, parts = (list(x) for x in zip(*blocks))
        width, kind = max(m.shape[1] for m in parts), max((m.dtype for m in parts), key=lambda t: t.itemsize)
        return Asked(*map(np.concatenate, (ids, own, low, [_padded(m, width).astype(kind, copy=False) for m in parts])), k)

    def results(met: Asked | None) -> Iterator[pa.RecordBatch]:
        if met:
            met.settle()
            rows, ids, scores = met.found[0]
            for at in range(0, len(rows), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(met.ids[rows[at:at + (1 << 17)]]), pa.array(ids[at:at + (1 << 17)]),
                                                  pa.array(scores[at:at + (1 << 17)])], [c.split()[0] for c in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, blocks, met = None, [], None
        for batch in batches:
            c = {name: batch.column(name) for name in batch.schema.names}
            for i in range(len(batch)):
                if c["cell"][i].as_py() != cell:
                    yield from results(met)
                    cell, blocks, met = c["cell"][i].as_py(), [], None
                ids, own, low = (np.frombuffer(c[x][i].as_buffer(), np.int64) for x in ("ids", "own", "low"))
                m = np.frombuffer(c["matrix"][i].as_buffer(), f"i{c['size'][i].as_py()}").reshape(len(ids), c["width"][i].as_py())
                if not c["bucket"][i].as_py():
                    blocks.append((ids, own, low, m))
                    continue
                if blocks:
                    met, blocks = asked(blocks), []
                if met:
                    met.meet(ids, m)
        yield from results(met)

    return run


def _meet(queries: DataFrame, asked: int, buckets: DataFrame, rows: int, per_part: int, k: int, bucket_rows: int,
          query_rows: int, held: int) -> DataFrame:
    """The at most k best rows for each query of each of several shares of the buckets, about ``rows`` rows in all.

    Queries are dealt into groups, buckets into shares; every group meets every share in a task.  So a group's rows
    move once a share, a share's once a group, and a task holds a group and one bucket.
    """
    groups = max(1, -(-asked // held))
    shares = max(1, min(-(-rows // bucket_rows), max(12, -(-rows * groups // (4 * asked)))))
    packed = queries.repartition(groups).sortWithinPartitions(F.desc("norm2")).mapInArrow(_blocks(query_rows), BLOCK)
    part, place = F.shiftright("block", 32).cast("int"), F.col("block").bitwiseAND(0xFFFFFFFF).cast("int")
    first, share = part % groups * shares, (part * per_part + place) % shares
    q = packed.withColumn("cell", F.explode(F.sequence(first, first + (shares - 1)))).withColumn("bucket", F.lit(False))
    p = buckets.withColumn("cell", F.explode(F.sequence(share, share + (groups - 1) * shares, F.lit(shares)))).withColumn("bucket", F.lit(True))
    return q.unionByName(p).repartitionById(groups * shares, "cell") \
        .sortWithinPartitions("cell", "bucket", F.desc("longest"), "block").mapInArrow(_verify(k), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64,
          bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS, held_queries: int = HELD_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of every row that ``is_query`` holds for."""
    spark = vectors.sparkSession
    points = quantised(vectors, scale)
    rows = points.count()
    n = max(-(-rows // (RANGE_BUCKETS * bucket_rows)), min(RANGE_BUCKETS, -(-rows // bucket_rows)), 1)
    ranged = points.repartitionByRange(n, F.desc("norm2"), F.col("vec_id")).sortWithinPartitions(F.desc("norm2"))
    buckets = materialise(ranged.mapInArrow(_blocks(bucket_rows), BLOCK), "topk-buckets")
    # a query is a row: its number stands for it, and equal rows are asked once
    asked = materialise(points.filter(is_query).groupBy("vec_id", "v").agg(F.count("*").alias("copies"), F.first("norm2").alias("norm2"))
                        .withColumn("row", F.monotonically_increasing_id()), "topk-queries")
    number, longest = asked.count(), buckets.agg(F.min("block")).first()[0]  # blocks are numbered by falling length
    if not number:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = asked.select(F.col("row").alias("vec_id"), F.col("vec_id").alias("own"), "v", "norm2")
    per_part = -(-rows // (n * bucket_rows))

    def known(found: DataFrame) -> DataFrame:
        """The queries with the score that their k-th result cannot fall below."""
        floor = found.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n")) \
            .filter(F.col("n") >= k).select(F.col("query_id").alias("f_id"), "low")
        return queries.join(floor, F.col("vec_id") == F.col("f_id"), "left").drop("f_id").fillna({"low": NONE})

    def meet(asking: DataFrame, which: Column, about: int, held: int = held_queries) -> DataFrame:
        return _meet(asking, number, buckets.filter(which), about, per_part, k, bucket_rows, query_rows, held)

    block = F.col("block")
    found = materialise(meet(queries.withColumn("low", F.lit(NONE)), block == longest, bucket_rows, bucket_rows), "topk-first")
    if n >= RANGE_BUCKETS:
        early = -(-n // RANGE_BUCKETS)
        more = meet(known(found), (block != longest) & (block < early << 32), early * per_part * bucket_rows)
        found = materialise(_best(found.unionByName(more), k).drop("rank"), "topk-early")
        rest = block >= early << 32
    else:
        rest = block != longest
    found = _best(found.unionByName(meet(known(found), rest, rows)), k)
    rows_of = asked.select(F.col("row").alias("query_id"), F.col("vec_id").alias("own"), "copies")
    return found.join(rows_of, "query_id").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))) \
        .select(F.col("own").alias("query_id"), "rank", "vec_id", "score")
