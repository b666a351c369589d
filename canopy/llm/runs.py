"""Periodic runs of words, found on a Re-Pair grammar of each document.

A run is a stretch of words with smallest period q that is at least ``least`` words and
``times`` periods long and that no neighbouring word extends.  Word ids are compressed by
Re-Pair: the most frequent adjacent pair becomes a nonterminal until no pair is left twice.
What remains is joined into balanced nodes, so every run lies inside one node and crosses
the boundary between its two children.  Runs across a boundary are computed once for each
nonterminal, at its first place in the document, moved to all places it derives, and
intervals of one period that overlap by a period or more are merged into the maximal ones.

A run repeats every adjacent word pair that it holds ``times - 1`` times or more, so no run
holds a rarer pair: documents are cut there first, and the grammar covers the pieces that
are long enough.  Prose without repetition has none.

Cases: a null or empty text has no words and no runs; rows with a null id are never altered
by ``looped``; ties and repeated rows are treated row by row; a document is worked on in one
task, in memory of the order of its words; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 6
TIMES = 4

Run = tuple[int, int, int]  # start, length, period


def looped(words: list, doc_id: int | None) -> list:
    """The words of a tenth of the documents, made periodic from a place that the id gives."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a:a + p]
    return words[:a] + (block * (-(-(n - a) // p)))[:n - a]


class Grammar:
    """A Re-Pair grammar over pieces of a sequence, with balanced nodes above what is left.

    Symbols from ``first`` on are nodes: ``left``, ``right``, ``size`` (words) and ``place`` (of
    one occurrence) by symbol - first.  ``roots`` holds a node and its place for every piece.
    """

    def __init__(self, ids: list[int], pieces: list[tuple[int, int]]):
        self.first = max(ids) + 1
        self.left: list[int] = []
        self.right: list[int] = []
        self.size: list[int] = []
        self.place: list[int] = []
        self.roots = [self._balanced(s) for s in self._repair(ids, pieces)]

    def _width(self, symbol: int) -> int:
        return 1 if symbol < self.first else self.size[symbol - self.first]

    def _node(self, a: int, b: int, place: int) -> int:
        self.left.append(a)
        self.right.append(b)
        self.size.append(self._width(a) + self._width(b))
        self.place.append(place)
        return self.first + len(self.left) - 1

    def _repair(self, ids: list[int], pieces: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
        """The pieces as lists of (symbol, place) after all replacements."""
        symbol, after, before = list(ids), list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        places: dict[tuple[int, int], list[int]] = defaultdict(list)
        for start, end in pieces:
            before[start], after[end - 1] = -1, -1
            for i in range(start, end - 1):
                places[ids[i], ids[i + 1]].append(i)
        heap = [(-len(p), pair) for pair, p in places.items() if len(p) > 1]
        heapq.heapify(heap)
        while heap:
            count, pair = heapq.heappop(heap)
            at = places.pop(pair, None)
            if at is None:
                continue
            a, b = pair
            live, end = [], -1
            for i in at:  # ascending; an occurrence that overlaps the one before it is not counted
                j = after[i]
                if symbol[i] == a and j >= 0 and symbol[j] == b and i != end:
                    live.append(i)
                    end = j
            if len(live) < 2:
                continue
            if len(live) < -count:  # counted too high: back with the right count
                places[pair] = live
                heapq.heappush(heap, (-len(live), pair))
                continue
            x = self._node(a, b, live[0])
            fresh = set()
            for i in live:
                j = after[i]
                k, h = after[j], before[i]
                symbol[i], symbol[j] = x, -1
                after[i] = k
                if k >= 0:
                    before[k] = i
                    places[x, symbol[k]].append(i)
                    fresh.add((x, symbol[k]))
                if h >= 0:
                    places[symbol[h], x].append(h)
                    fresh.add((symbol[h], x))
            for pair in fresh:
                if len(places[pair]) > 1:
                    places[pair].sort()
                    heapq.heappush(heap, (-len(places[pair]), pair))
        out = []
        for start, _ in pieces:
            i, rest = start, []
            while i >= 0:
                rest.append((symbol[i], i))
                i = after[i]
            out.append(rest)
        return out

    def _balanced(self, rest: list[tuple[int, int]]) -> tuple[int, int]:
        while len(rest) > 1:
            rest = [(self._node(rest[k][0], rest[k + 1][0], rest[k][1]), rest[k][1]) if k + 1 < len(rest) else rest[k]
                    for k in range(0, len(rest), 2)]
        return rest[0]

    def places_of(self, wanted: dict[int, list]) -> Iterator[tuple[int, int]]:
        """``node, place`` for every place where a wanted node is derived; others are passed over."""
        holds = []
        for k, (a, b) in enumerate(zip(self.left, self.right)):  # children come before their parents
            holds.append(k in wanted or any(c >= self.first and holds[c - self.first] for c in (a, b)))
        stack = [(s - self.first, at) for s, at in self.roots if s >= self.first]
        while stack:
            k, at = stack.pop()
            if not holds[k]:
                continue
            if k in wanted:
                yield k, at
            a, b = self.left[k], self.right[k]
            if a >= self.first:
                stack.append((a - self.first, at))
            if b >= self.first:
                stack.append((b - self.first, at + self._width(a)))


def _forward(x: list[int], i: int, j: int, end: int) -> int:
    """How many words from ``j`` (> ``i``), up to ``end``, equal those from ``i``."""
    n, step = 0, 8
    while j + n < end:
        step = min(step, end - j - n)
        if x[i + n:i + n + step] == x[j + n:j + n + step]:
            n += step
            step *= 2
        elif step == 1:
            break
        else:
            step = max(1, step // 4)
    return n


def _backward(x: list[int], i: int, j: int, start: int) -> int:
    """How many words before ``i`` (< ``j``), down to ``start``, equal those before ``j``."""
    n, step = 0, 8
    while i - n > start:
        step = min(step, i - n - start)
        if x[i - n - step:i - n] == x[j - n - step:j - n]:
            n += step
            step *= 2
        elif step == 1:
            break
        else:
            step = max(1, step // 4)
    return n


def _crossing(x: list[int], start: int, mid: int, end: int, pairs: dict[tuple[int, int], list[int]],
              least: int, times: int) -> list[Run]:
    """Runs inside ``start:end`` that hold the words on both sides of ``mid``.

    A run of ``times`` periods holds the pair at the boundary again a period before or after it.
    """
    most = (end - start) // times
    at = pairs[x[mid - 1], x[mid]]
    near = at[bisect_left(at, mid - 1 - most):bisect_right(at, mid - 1 + most)]
    found: list[Run] = []
    for q in sorted({abs(p - mid + 1) for p in near} - {0}):
        # a multiple of a period that holds on that side gives the same run
        held = [f for f in found if q % f[2] == 0]
        if mid + q <= end and not any(mid + q <= f[0] + f[1] for f in held):
            s = mid - _backward(x, mid, mid + q, start)
            e = mid + q + _forward(x, mid, mid + q, end)
            if e - s >= max(least, times * q) and s < mid:
                found.append((s, e - s, q))
        if mid - q >= start and not any(f[0] <= mid - q for f in held):
            e = mid + _forward(x, mid - q, mid, end)
            s = mid - q - _backward(x, mid - q, mid, start)
            if e - s >= max(least, times * q) and e > mid:
                found.append((s, e - s, q))
    whole: list[Run] = []
    for f in found:  # ascending periods: what lies in a run of a smaller period is that run
        if not any(w[0] <= f[0] and f[0] + f[1] <= w[0] + w[1] for w in whole):
            whole.append(f)
    return whole


def _hot_pieces(ids: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Stretches of at least ``least`` words in which every adjacent pair occurs often enough for a run."""
    keys = ids[:-1] * (int(ids.max()) + 1) + ids[1:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    count = np.diff(np.r_[first, len(keys)])
    hot = np.empty(len(keys), bool)
    hot[order] = np.repeat(count >= times - 1, count)
    edge = np.diff(np.r_[False, hot, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
    keep = ends - starts >= least
    return list(zip(starts[keep].tolist(), ends[keep].tolist()))


def runs(words: list, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All maximal runs of a sequence: (start, length, period), by start and period."""
    if len(words) < least:
        return []
    number: dict = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    pieces = _hot_pieces(np.array(ids, np.int64), least, times)
    if not pieces:
        return []
    grammar = Grammar(ids, pieces)
    pairs: dict[tuple[int, int], list[int]] = defaultdict(list)
    for start, end in pieces:
        for i in range(start, end - 1):
            pairs[ids[i], ids[i + 1]].append(i)
    own = {}
    for k, (a, n, at) in enumerate(zip(grammar.left, grammar.size, grammar.place)):
        if n >= least:
            got = _crossing(ids, at, at + grammar._width(a), at + n, pairs, least, times)
            if got:
                own[k] = [(s - at, length, q) for s, length, q in got]
    by_period: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for k, at in grammar.places_of(own):
        for s, length, q in own[k]:
            by_period[q].add((at + s, at + s + length))
    out = []
    for q, spans in by_period.items():
        start = end = None
        for s, e in sorted(spans):
            if start is not None and s + q <= end:
                end = max(end, e)
                continue
            if start is not None:
                out.append((start, end - start, q))
            start, end = s, e
        out.append((start, end - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list, found: list[Run]) -> list:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        edge[start + q] += 1
        edge[start + length] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep)]


FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
DIGEST = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def _row(doc_id: int | None, text: str | None, loop: bool, least: int, times: int) -> tuple[list, list[Run]]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if loop:
        words = looped(words, doc_id)
    return words, runs(words, least, times)


def _mapped(docs: DataFrame, make, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [make(i, t.as_py()) for i, t in zip(batch.column(0).to_pylist(), batch.column(1))]
            yield pa.RecordBatch.from_pylist(rows, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    target = to_arrow_schema(StructType.fromDDL(schema))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, schema)


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, loop: bool = False) -> DataFrame:
    """Per document its words, its runs by start and period, and its text without what repeats.

    ``loop`` first alters a tenth of the documents as ``looped`` does.
    """
    def make(doc_id, text):
        words, found = _row(doc_id, text, loop, least, times)
        return {"doc_id": doc_id, "n_words": len(words),
                "runs": [{"start": s, "length": n, "period": q} for s, n, q in found],
                "collapsed": b" ".join(collapsed(words, found)).decode("utf-8", "surrogatepass")}

    return _mapped(docs, make, FOUND)


def run_digests(docs: DataFrame, least: int = LEAST, times: int = TIMES, loop: bool = False) -> DataFrame:
    """Per document the number of its runs, the longest one, and digests of all runs and of the kept words."""
    def make(doc_id, text):
        words, found = _row(doc_id, text, loop, least, times)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        return {"doc_id": doc_id, "n_runs": len(found), "start": best[0], "length": best[1], "period": best[2],
                "exponent_milli": 1000 * best[1] // best[2] if found else None,
                "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(),
                "collapsed_sha256": hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()}

    return _mapped(docs, make, DIGEST)
