"""Hierarchical k-means topic tree, a few distributed jobs per tree level.

Every page carries the path (child ordinals from the root) of the node it sits in, and its
vector on an integer grid.  All distances, sums and means of a clustering are then exact
integers, so the tree is the same at any partition count and on every computing path.
Per level, for all nodes that split at once:

1. node sizes by path; nodes with more than ``leaf_target`` pages (and depth below
   ``max_depth``) split into k = min(max_k, ceil(n / leaf_target)) clusters;
2. seeds over all pages of the node: rounds of one minimum-distance pass and one weighted
   pick each.  A page's pick value is an exponential draw over its squared distance to the
   seeds so far, so k pages a round are picked in proportion to it, and a copy of a seed
   never is.  The picks, weighted by the pages nearest to them, are brought down to k
   by the same weighted draws, one at a time, in a group of a few k rows per node;
3. Lloyd steps: nearest centre, exact sums by (node, cluster) combined in each task; a
   centre that loses all pages moves to the page farthest from its own centre; a node
   stops when no centre moves by more than ``tol`` of its largest squared distance;
4. exact cosine silhouette per node in closed form; a node whose silhouette is
   below the threshold (or with a single non-empty cluster) stays a leaf, with
   the mean of its k centres as centroid;
5. pages of accepted nodes move one level down (path + [cluster]).

Steps 2 to 4 run on blocks: pages are ranged by node once a level and kept as matrices of
pages of one node, and every step is one job without a shuffle that hands the driver one small partial
result per node and task.  Centre tables beyond the broadcast budget go through joins instead.

A namespace that one split brings down to leaf size (at most ``max_k * leaf_target`` pages), and a
node below the root of at most ``PART_PAGES`` pages, goes through the same steps inside one
task; larger ones never meet in a task.

Lineage is cut with reliable checkpoints after every level; only centre tables and partial results
within the broadcast budget and per-level scalars reach the driver.  Afterwards node ids are
assigned in depth-first pre-order (root = 1 per namespace).
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.operators import vectors as Vx
from canopy.operators.windows import first_n_per_group
from canopy.session import cut_lineage

NS = "namespace"
KEYS = [NS, "path"]
#: Pages of a node below the root that may split inside one task.
PART_PAGES = 4096
#: Bytes of vectors in a partition of blocks.
BLOCK_BYTES = 16 << 20
#: Stands for a page without an id in a block; such pages come first, as nulls do in Spark's order.
NO_ID = -2 ** 63


@dataclass
class ClusterParams:
    leaf_target: int = 50
    max_k: int = 50
    max_depth: int = 10
    min_silhouette: float = 0.03
    max_iter: int = 50
    tol: float = 1e-4          # of the node's largest squared distance to its first centres
    seed: int = 42
    rounds: int = 4            # least number of seeding rounds
    local_cap: int | None = None  # nodes up to this many pages split inside one task (None: see ``cap``)

    def cap(self, depth: int) -> int:
        if self.local_cap is not None:
            return self.local_cap
        return max(self.max_k * self.leaf_target, PART_PAGES if depth else 0)


# --- the integer grid --------------------------------------------------------------

def grid_bits(dim: int) -> int:
    """Bits of a grid coordinate; a squared distance of ``dim`` of them stays exact in a double."""
    return min(20, (52 - math.ceil(math.log2(max(dim, 1)))) // 2 - 1)


def on_grid(vec: Column, unit: float) -> Column:
    return F.transform(vec, lambda v: F.rint(v / F.lit(unit)))


# --- one node in numpy, step for step as the Spark path ---------------------------------

def _sqdist_np(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """n x k squared distances without an n x k x d temporary (exact on grid vectors)."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :], 0.0)


def race(h: np.ndarray, turn: int, weight: np.ndarray) -> np.ndarray:
    """Exponential draws with rates ``weight``: the smallest is a pick in proportion to the weights."""
    with np.errstate(over="ignore", divide="ignore"):
        z = h.astype(np.int64).view(np.uint64) + np.uint64(turn + 1) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) + 0.5
        return np.where(weight > 0, -np.log(u / 2.0 ** 53) / weight, np.inf)


def _reduce_seeds(ids: np.ndarray, h: np.ndarray, x: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Positions of k of the candidates by weighted D2 draws; candidates are sorted by id."""
    if len(ids) <= k:
        return np.arange(len(ids))
    chosen = [int(np.lexsort((ids, race(h, 1000, weight)))[0])]
    near = _sqdist_np(x, x[chosen])[:, 0]
    while len(chosen) < k:
        chosen.append(int(np.lexsort((ids, race(h, 1000 + len(chosen), near * weight)))[0]))
        near = np.minimum(near, _sqdist_np(x, x[chosen[-1:]])[:, 0])
    return np.sort(chosen)


def _distinct_first(x: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of rows with equal vectors the one with the smallest id."""
    first: dict[bytes, int] = {}
    for r in rows[np.argsort(ids[rows])]:
        first.setdefault(x[r].tobytes(), int(r))
    return np.array(sorted(first.values()), np.int64)


def _seeds_np(x: np.ndarray, h: np.ndarray, ids: np.ndarray, k: int, p: ClusterParams) -> np.ndarray:
    cand = np.lexsort((ids, h))[:1]
    turn = 0
    while True:
        near = _sqdist_np(x, x[cand]).min(axis=1)
        if turn >= p.rounds and len(cand) >= k or not (near > 0).any():
            break
        value = race(h, turn, near)
        picks = np.lexsort((ids, value))[:k]
        cand = np.concatenate([cand, _distinct_first(x, picks[near[picks] > 0], ids)])
        turn += 1
    cand = cand[np.argsort(ids[cand])]
    weight = np.bincount(_sqdist_np(x, x[cand]).argmin(axis=1), minlength=len(cand)).astype(np.float64)
    return x[cand[_reduce_seeds(ids[cand], h[cand], x[cand], weight, k)]]


def _lloyd_np(x: np.ndarray, ids: np.ndarray, c: np.ndarray, p: ClusterParams) -> tuple[np.ndarray, np.ndarray]:
    limit = None
    for _ in range(p.max_iter):
        d2 = _sqdist_np(x, c)
        lab = d2.argmin(axis=1)
        near = d2[np.arange(len(x)), lab]
        limit = p.tol * near.max() if limit is None else limit
        count = np.bincount(lab, minlength=len(c))
        sums = np.stack([np.bincount(lab, x[:, f], len(c)) for f in range(x.shape[1])], 1)
        new = np.where(count[:, None] > 0, np.rint(sums / np.maximum(count, 1)[:, None]), c)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            far = np.lexsort((ids, -near))[:len(empty)]
            far = far[near[far] > 0]
            new[empty[:len(far)]] = x[far]
        shift = ((new - c) ** 2).sum(axis=1).max()
        c = new
        if shift <= limit:
            break
    return c, _sqdist_np(x, c).argmin(axis=1)


def _units(x: np.ndarray) -> np.ndarray:
    nrm = np.linalg.norm(x, axis=1)
    return np.where(nrm[:, None] > 0, x / np.where(nrm > 0, nrm, 1.0)[:, None], 0.0)


def _silhouettes(u: np.ndarray, pos: np.ndarray, sums: np.ndarray, cnt: np.ndarray) -> np.ndarray:
    """Cosine silhouette of unit rows in cluster ``pos``, from the sums and sizes of two or more filled clusters."""
    dots = u @ sums.T                                   # n x k
    selfd = (u * u).sum(axis=1)
    own_n = cnt[pos]
    a = np.where(own_n > 1, (own_n - 1 - (dots[np.arange(len(u)), pos] - selfd)) / np.maximum(own_n - 1, 1), 0.0)
    other = 1.0 - dots / cnt[None, :]
    other[np.arange(len(u)), pos] = np.inf
    b = other.min(axis=1)
    m = np.maximum(a, b)
    return np.where((own_n <= 1) | (m == 0), 0.0, (b - a) / np.where(m == 0, 1.0, m))


def silhouette_np(x: np.ndarray, lab: np.ndarray) -> float:
    """Exact mean cosine silhouette via per-cluster sums (same closed form as the Spark path)."""
    u = _units(x)
    ids = np.unique(lab)
    if len(ids) < 2:
        return float("nan")
    sums = np.vstack([u[lab == c].sum(axis=0) for c in ids])
    cnt = np.array([(lab == c).sum() for c in ids], dtype=np.float64)
    return float(_silhouettes(u, np.searchsorted(ids, lab), sums, cnt).mean())


def local_subtrees(points: DataFrame, nodes: DataFrame, params: ClusterParams) -> DataFrame:
    """Split every bounded node (at most ``params.cap(depth)`` pages) down to its leaves inside one task.

    Output rows are of two kinds: ``page`` rows (namespace, page_id, x, path = final leaf
    path) and ``node`` rows (namespace, path, silhouette, centroid) for every node of the
    subtree that attempted a split (accepted or not).
    """
    p = params

    def grow_all(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page_id").reset_index(drop=True)
        x = np.vstack(pdf["x"].to_numpy()).astype(np.float64)
        h, ids = pdf["h"].to_numpy(np.int64), pdf["page_id"].to_numpy(np.int64)
        base = list(pdf["path"].iloc[0])
        ns = pdf[NS].iloc[0]
        page_path: list = [None] * len(x)
        node_rows = []

        def grow(idx: np.ndarray, rel: list) -> None:
            n, depth = len(idx), len(base) + len(rel)
            k = min(p.max_k, math.ceil(n / p.leaf_target))
            split = n > p.leaf_target and depth < p.max_depth and k > 1
            if split:
                xs = x[idx]
                c, lab = _lloyd_np(xs, ids[idx], _seeds_np(xs, h[idx], ids[idx], k, p), p)
                sil = silhouette_np(xs, lab)
                node_rows.append((base + rel, None if np.isnan(sil) else sil, (c.sum(axis=0) / len(c)).tolist()))
                split = not np.isnan(sil) and round(sil, 9) >= p.min_silhouette
            if not split:
                for i in idx:
                    page_path[i] = base + rel
                return
            for j in range(len(c)):
                m = lab == j
                if m.any():
                    grow(idx[m], rel + [j])

        grow(np.arange(len(x)), [])
        pages = pd.DataFrame({"kind": "page", NS: ns, "page_id": pdf["page_id"], "h": pdf["h"], "x": pdf["x"],
                              "path": page_path, "silhouette": None, "centroid": None})
        nodes_df = pd.DataFrame({"kind": "node", NS: ns, "page_id": None, "h": None, "x": None,
                                 "path": [r[0] for r in node_rows], "silhouette": [r[1] for r in node_rows],
                                 "centroid": [r[2] for r in node_rows]})
        return pd.concat([pages, nodes_df], ignore_index=True)

    inp = points.select(*KEYS, "page_id", "h", "x").join(nodes.select(*KEYS), KEYS, "left_semi")
    # a node costs far more time than its bytes tell, so that the number of tasks is given
    tasks = max(points.sparkSession.sparkContext.defaultParallelism * 4, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return inp.repartition(tasks, *KEYS).groupBy(*KEYS).applyInPandas(
        grow_all, f"kind string, {NS} string, page_id bigint, h bigint, x array<double>, path array<int>, "
                  "silhouette double, centroid array<double>")


# --- all large nodes of a level, on blocks ---------------------------------------------------

def pack_blocks(points: DataFrame, nodes: list, dim: int) -> DataFrame:
    """``node, ids, h, x``: the pages of ``nodes`` (rows of namespace, path, n) in matrices of one node each.

    Pages are ranged by node and id, so that a task holds few nodes and a large node spreads over many tasks.
    """
    spark = points.sparkSession
    table = spark.createDataFrame([(r[NS], list(r.path), i) for i, r in enumerate(nodes)],
                                  f"{NS} string, path array<int>, node int")
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(sum(r.n for r in nodes) * 8 * dim / BLOCK_BYTES))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for node, g in pdf.groupby("node", sort=False):
                yield pd.DataFrame({
                    "node": [node], "ids": [g["page_id"].fillna(NO_ID).to_numpy(np.int64).tobytes()],
                    "h": [g["h"].to_numpy(np.int64).tobytes()],
                    "x": [np.vstack(g["x"].to_numpy()).astype(np.float64).tobytes()]})

    rows = points.select(*KEYS, "page_id", "h", "x").join(F.broadcast(table), KEYS).select("node", "page_id", "h", "x")
    return rows.repartitionByRange(tasks, "node", "page_id", "h").mapInPandas(pack, "node int, ids binary, h binary, x binary")


def _matrices(batches: Iterator[pd.DataFrame], dim: int) -> Iterator[tuple]:
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            yield (r.node, np.frombuffer(r.ids, np.int64), np.frombuffer(r.h, np.int64),
                   np.frombuffer(r.x, np.float64).reshape(-1, dim))


def fold_blocks(blocks: DataFrame, dim: int, shared: dict, part: Callable, merge: Callable) -> dict:
    """{node: merged ``part(shared[node], ids, h, x)``} of the nodes in ``shared``: one job, one partial a node and task."""
    sent = blocks.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for node, ids, h, x in _matrices(batches, dim):
            if node in sent.value:
                got = part(sent.value[node], ids, h, x)
                held[node] = merge(held[node], got) if node in held else got
        yield pd.DataFrame({"node": list(held), "part": [pickle.dumps(v) for v in held.values()]})

    out: dict = {}
    for r in blocks.mapInPandas(run, "node int, part binary").collect():
        got = pickle.loads(r.part)
        out[r.node] = merge(out[r.node], got) if r.node in out else got
    sent.destroy()
    return out


def _sum_parts(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b))


def _least(most: int, value: np.ndarray, *cols: np.ndarray) -> tuple:
    """The ``most`` rows of least (value, first column)."""
    at = np.lexsort((cols[0], value))[:most]
    return most, value[at], *[c[at] for c in cols]


def _merge_least(a: tuple, b: tuple) -> tuple:
    return _least(a[0], *[np.concatenate(c) for c in zip(a[1:], b[1:])])


def _drawn(state: tuple, ids: np.ndarray, h: np.ndarray, x: np.ndarray) -> tuple:
    turn, k, cand = state
    near = _sqdist_np(x, cand).min(axis=1)
    away = near > 0
    return _least(k, race(h[away], turn, near[away]), ids[away], h[away], x[away])


def seeds_of_blocks(blocks: DataFrame, ks: dict[int, int], dim: int, p: ClusterParams) -> dict[int, np.ndarray]:
    """k seeds per node, as ``_seeds_np``: a job a round, all nodes together."""
    first = fold_blocks(blocks, dim, dict.fromkeys(ks, 1),
                        lambda k, ids, h, x: _least(k, h, ids, x), _merge_least)
    cand = {node: (ids, h, x) for node, (_, h, ids, x) in first.items()}
    going, turn = set(cand), 0
    while going:
        drawn = fold_blocks(blocks, dim, {n: (turn, ks[n], cand[n][2]) for n in going}, _drawn, _merge_least)
        turn += 1
        going = set()
        for n, (_, _, ids, h, x) in drawn.items():
            if len(ids):  # else all pages are copies of the candidates
                at = _distinct_first(x, np.arange(len(ids)), ids)
                cand[n] = tuple(np.concatenate([old, new[at]]) for old, new in zip(cand[n], (ids, h, x)))
                if turn < p.rounds or len(cand[n][0]) < ks[n]:
                    going.add(n)
    for n, cols in cand.items():
        order = np.argsort(cols[0])
        cand[n] = tuple(c[order] for c in cols)
    weights = fold_blocks(blocks, dim, {n: c[2] for n, c in cand.items()}, lambda c, ids, h, x: (
        np.bincount(_sqdist_np(x, c).argmin(axis=1), minlength=len(c)).astype(np.float64),), _sum_parts)
    return {n: x[_reduce_seeds(ids, h, x, weights[n][0], ks[n])] for n, (ids, h, x) in cand.items()}


def _cluster_sums(c: np.ndarray, ids: np.ndarray, h: np.ndarray, x: np.ndarray) -> tuple:
    d2 = _sqdist_np(x, c)
    lab = d2.argmin(axis=1)
    return (np.bincount(lab, minlength=len(c)), np.stack([np.bincount(lab, x[:, f], len(c)) for f in range(x.shape[1])], 1),
            d2[np.arange(len(x)), lab].max())


def _merge_clusters(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1], max(a[2], b[2])


def _far_pages(state: tuple, ids: np.ndarray, h: np.ndarray, x: np.ndarray) -> tuple:
    most, c = state
    near = _sqdist_np(x, c).min(axis=1)
    return _least(most, -near[near > 0], ids[near > 0], x[near > 0])


def lloyd_blocks(blocks: DataFrame, centres: dict[int, np.ndarray], dim: int, p: ClusterParams) -> dict[int, np.ndarray]:
    """Lloyd steps of all nodes, as ``_lloyd_np``: a job a step; a node stops on its own, the others go on."""
    centres, limit, live = dict(centres), {}, set(centres)
    for _ in range(p.max_iter):
        got = fold_blocks(blocks, dim, {n: centres[n] for n in live}, _cluster_sums, _merge_clusters)
        new = {n: np.where(count[:, None] > 0, np.rint(sums / np.maximum(count, 1)[:, None]), centres[n])
               for n, (count, sums, _) in got.items()}
        empty = {n: np.flatnonzero(count == 0) for n, (count, _, _) in got.items() if (count == 0).any()}
        if empty:  # a centre without pages moves to a page far from its own
            far = fold_blocks(blocks, dim, {n: (len(e), centres[n]) for n, e in empty.items()}, _far_pages, _merge_least)
            for n, e in empty.items():
                new[n][e[:len(far[n][3])]] = far[n][3]
        for n in live:
            limit.setdefault(n, p.tol * got[n][2])
        live = {n for n in live if ((new[n] - centres[n]) ** 2).sum(axis=1).max() > limit[n]}
        centres.update(new)
        if not live:
            break
    return centres


def _unit_sums(c: np.ndarray, ids: np.ndarray, h: np.ndarray, x: np.ndarray) -> tuple:
    lab, u = _sqdist_np(x, c).argmin(axis=1), _units(x)
    return (np.bincount(lab, minlength=len(c)).astype(np.float64),
            np.stack([np.bincount(lab, u[:, f], len(c)) for f in range(u.shape[1])], 1))


def _silhouette_part(state: tuple, ids: np.ndarray, h: np.ndarray, x: np.ndarray) -> tuple:
    c, filled, cnt, sums = state
    pos = np.searchsorted(filled, _sqdist_np(x, c).argmin(axis=1))
    return float(_silhouettes(_units(x), pos, sums, cnt).sum()), len(x)


def silhouette_blocks(blocks: DataFrame, centres: dict[int, np.ndarray], dim: int) -> dict[int, float]:
    """Mean cosine silhouette of the nodes with two or more filled clusters."""
    parts = fold_blocks(blocks, dim, centres, _unit_sums, _sum_parts)
    state = {}
    for n, (cnt, sums) in parts.items():
        filled = np.flatnonzero(cnt)
        if len(filled) > 1:
            state[n] = (centres[n], filled, cnt[filled], sums[filled])
    return {n: s / m for n, (s, m) in fold_blocks(blocks, dim, state, _silhouette_part, _sum_parts).items()}


def split_blocks(points: DataFrame, nodes: list, dim: int, p: ClusterParams) -> tuple[DataFrame, DataFrame]:
    """One split of every node -> (pages with ``cid`` and ``accepted``, nodes with centroid and silhouette)."""
    spark = points.sparkSession
    blocks = cut_lineage(pack_blocks(points, nodes, dim))
    centres = seeds_of_blocks(blocks, {i: r.k for i, r in enumerate(nodes)}, dim, p)
    centres = lloyd_blocks(blocks, centres, dim, p)
    sil = silhouette_blocks(blocks, centres, dim)
    level = spark.createDataFrame(
        [(r[NS], list(r.path), (centres[i].sum(axis=0) / len(centres[i])).tolist(), sil.get(i),
          i in sil and round(sil[i], 9) >= p.min_silhouette, i) for i, r in enumerate(nodes)],
        f"{NS} string, path array<int>, centroid array<double>, silhouette double, accepted boolean, node int")
    sent = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for node, ids, h, x in _matrices(batches, dim):
            yield pd.DataFrame({"node": node, "page_id": pd.Series(ids, dtype="Int64").mask(ids == NO_ID), "h": h,
                                "x": list(x), "cid": _sqdist_np(x, sent.value[node]).argmin(axis=1)})

    asg = blocks.mapInPandas(assign, "node int, page_id bigint, h bigint, x array<double>, cid int")
    return (asg.join(F.broadcast(level.select("node", *KEYS, "accepted")), "node")
            .select(*KEYS, "page_id", "h", "x", "cid", "accepted"), level.select(*KEYS, "centroid", "silhouette"))


# --- the same steps by joins, for centre tables beyond the broadcast budget --------------------

def seed_centres(points: DataFrame, nodes: DataFrame, dim: int, p: ClusterParams) -> DataFrame:
    """(namespace, path, cid, vec): k seeds per node by rounds of weighted picks over all its pages.

    ``points``: namespace, path, page_id, h, x; ``nodes``: namespace, path, k.
    """
    @F.pandas_udf("double")
    def draw(h: pd.Series, turn: pd.Series, weight: pd.Series) -> pd.Series:
        return pd.Series(race(h.to_numpy(), int(turn.iloc[0]), weight.to_numpy()))

    pts = points.select(*KEYS, "page_id", "h", "x")
    cols = [*KEYS, F.col("page_id").alias("cid"), "h", "x"]
    cand = cut_lineage(first_n_per_group(pts, KEYS, ["h", "page_id"], 1).select(*cols))
    turn = 0
    while True:
        near = _assign(pts, cand.select(*KEYS, "cid", F.col("x").alias("vec")), dim, keep_distance=True)
        away = near.where(F.col("dist2") > 0)
        if turn >= p.rounds:  # only nodes that still lack candidates go on
            short = nodes.join(cand.groupBy(*KEYS).agg(F.count("*").alias("have")), KEYS).where("have < k")
            away = away.join(short.select(*KEYS), KEYS, "left_semi")
        drawn = away.withColumn("draw", draw("h", F.lit(turn), "dist2")).select(*KEYS, "page_id", "h", "x", "draw")
        picks = first_n_per_group(drawn, KEYS, ["draw", "page_id"], p.max_k).join(nodes.select(*KEYS, "k"), KEYS) \
            .where(F.col("rn") <= F.col("k"))
        picks = cut_lineage(picks.groupBy(*KEYS, "x").agg(F.min(F.struct("page_id", "h")).alias("m"))
                            .select(*KEYS, F.col("m.page_id").alias("cid"), "m.h", "x"))
        if picks.isEmpty():
            break
        cand = cut_lineage(cand.unionByName(picks))
        turn += 1
    weights = _assign(pts, cand.select(*KEYS, "cid", F.col("x").alias("vec")), dim).groupBy(*KEYS, "cid") \
        .agg(F.count("*").alias("weight"))
    rows = cand.join(weights, [*KEYS, "cid"], "left").join(nodes.select(*KEYS, "k"), KEYS)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid").reset_index(drop=True)
        x = np.vstack(pdf["x"].to_numpy()).astype(np.float64)
        got = _reduce_seeds(pdf["cid"].to_numpy(np.int64), pdf["h"].to_numpy(np.int64), x,
                            pdf["weight"].fillna(0).to_numpy(float), int(pdf["k"].iloc[0]))
        return pd.DataFrame({NS: pdf[NS].iloc[got], "path": pdf["path"].iloc[got], "cid": np.arange(len(got)),
                             "vec": list(x[got])})

    return cut_lineage(rows.groupBy(*KEYS).applyInPandas(
        choose, f"{NS} string, path array<int>, cid int, vec array<double>"))


def _assign(points: DataFrame, centres: DataFrame, dim: int, keep_distance: bool = False) -> DataFrame:
    """Nearest centre of each point's node (BLAS under the broadcast budget, JVM join beyond it; both exact)."""
    out = Vx.nearest_centre(points, centres.withColumnRenamed("vec", "x"), KEYS, "x", "cid", dim)
    return out if keep_distance else out.drop("dist2")


def _step(assigned: DataFrame, dim: int) -> DataFrame:
    """Exact new centres: (namespace, path, cid, n, vec, far), partial sums before the shuffle."""
    sums = [F.sum(F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(dim)]
    return assigned.groupBy(*KEYS, "cid").agg(F.count("*").alias("n"), F.max("dist2").alias("far"), *sums).select(
        *KEYS, "cid", "n", F.array(*[F.rint(F.col(f"s{i}") / F.col("n")) for i in range(dim)]).alias("vec"), "far")


def _farthest(assigned: DataFrame, most: int) -> DataFrame:
    """The pages of each node that are farthest from their centres: (namespace, path, rn, x)."""
    return first_n_per_group(assigned.where(F.col("dist2") > 0), KEYS, [F.desc("dist2"), "page_id"], most) \
        .select(*KEYS, "rn", "x")


def lloyd(points: DataFrame, centres: DataFrame, dim: int, params: ClusterParams) -> tuple[DataFrame, DataFrame, int]:
    """Run Lloyd steps for all nodes at once -> (centres, assignment, iterations).

    A node stops on its own when no centre moves by more than its limit; the others go on.
    """
    it, limits, live = 0, None, None
    for it in range(1, params.max_iter + 1):
        moving = points if live is None else points.join(live, KEYS, "left_semi")
        asg = _assign(moving, centres, dim, keep_distance=True)
        moved = cut_lineage(_step(asg, dim))
        node = moved.groupBy(*KEYS).agg(F.max("far").alias("far"))
        if limits is None:
            limits = cut_lineage(node.select(*KEYS, (F.lit(params.tol) * F.col("far")).alias("limit")))
        kept = centres.join(moved.select(*KEYS, "cid"), [*KEYS, "cid"], "left_anti")
        empty = kept if live is None else kept.join(live, KEYS, "left_semi")
        if not empty.isEmpty():  # a centre without pages moves to a page far from its own
            nth = Window.partitionBy(*KEYS).orderBy("cid")
            placed = empty.withColumn("rn", F.row_number().over(nth)) \
                .join(_farthest(asg, params.max_k), [*KEYS, "rn"]).select(*KEYS, "cid", F.col("x").alias("vec"))
            placed = cut_lineage(placed)
            kept = kept.join(placed, [*KEYS, "cid"], "left_anti").unionByName(placed)
        new = cut_lineage(moved.select(*KEYS, "cid", "vec").unionByName(kept.select(*KEYS, "cid", "vec")))
        shift = (new.alias("n").join(centres.alias("o"), [*KEYS, "cid"])
                 .groupBy(*KEYS).agg(F.max(Vx.sqdist(F.col("n.vec"), F.col("o.vec"))).alias("shift")))
        if live is not None:
            shift = shift.join(live, KEYS, "left_semi")
        live = cut_lineage(shift.join(limits, KEYS).where(F.col("shift") > F.col("limit")).select(*KEYS))
        centres = new
        if live.isEmpty():
            break
    return centres, _assign(points, centres, dim), it


def split_joins(points: DataFrame, large: DataFrame, dim: int, p: ClusterParams) -> tuple[DataFrame, DataFrame]:
    """As ``split_blocks``, with centres that stay in tables."""
    cpts = cut_lineage(points.select(*KEYS, "page_id", "h", "x").join(large.select(*KEYS), KEYS, "left_semi"))
    centres, asg, _ = lloyd(cpts, seed_centres(cpts, large, dim, p), dim, p)
    asg = cut_lineage(asg)
    sil = Vx.silhouette_points(asg.drop("h").withColumnRenamed("x", "vec"), KEYS, "cid", "vec", dim) \
        .groupBy(*KEYS).agg(F.avg("silhouette").alias("silhouette"))
    cent = centres.groupBy(*KEYS).agg(*[(F.sum(F.col("vec")[i].cast("long")) / F.count("*")).alias(f"c{i}")
                                        for i in range(dim)]) \
        .select(*KEYS, F.array(*[F.col(f"c{i}") for i in range(dim)]).alias("centroid"))
    filled = asg.groupBy(*KEYS).agg(F.countDistinct("cid").alias("filled"))
    level = cut_lineage(
        large.select(*KEYS).join(sil, KEYS, "left").join(filled, KEYS).join(cent, KEYS)
        .withColumn("silhouette", F.when(F.col("filled") > 1, F.col("silhouette")))
        .withColumn("accepted", F.coalesce(F.round("silhouette", 9) >= p.min_silhouette, F.lit(False)))
        .select(*KEYS, "centroid", "silhouette", "accepted"))
    return asg.join(level.select(*KEYS, "accepted"), KEYS), level.drop("accepted")


# --- the level loop ----------------------------------------------------------------

def build_tree(pages: DataFrame, params: ClusterParams = ClusterParams(), vec: str = "reduced"
               ) -> tuple[DataFrame, DataFrame]:
    """Cluster pages (namespace, page_id, vec) into a tree.

    Returns (nodes, assignment):
      nodes: namespace, node_id, parent_id, depth, centroid array<float>, doc_count, child_count,
             sample_doc_ids array<bigint>, silhouette, path
      assignment: namespace, page_id, cluster_node_id (the page's leaf)
    Namespaces with fewer than ``max_k`` vectors get no tree.
    """
    base = pages.where(F.col(vec).isNotNull()).select(NS, "page_id", Vx.as_double(vec).alias("x"))
    sizes = base.groupBy(NS).agg(F.count("*").alias("n"))
    # one row per namespace: broadcast, so the semi-join never shuffles pages by namespace
    base = base.join(F.broadcast(sizes.where(F.col("n") >= params.max_k).select(NS)), NS, "left_semi")
    extent = base.agg(F.max(F.size("x")).alias("dim"),
                      F.max(F.array_max(F.transform("x", F.abs))).alias("reach")).first()
    if extent.dim is None:
        empty = pages.sparkSession.createDataFrame([], "namespace string, node_id bigint")
        return empty, empty
    dim = extent.dim
    unit = (extent.reach or 1.0) / 2 ** grid_bits(dim)
    pts = cut_lineage(base.select(
        NS, "page_id", F.xxhash64("page_id", F.lit(params.seed)).alias("h"), on_grid(F.col("x"), unit).alias("x"),
        F.array().cast("array<int>").alias("path"), F.lit(False).alias("done")))
    row = [NS, "page_id", "h", "x", "path", "done"]
    levels = []
    for depth in range(params.max_depth):
        cap = params.cap(depth)
        active = pts.where(~F.col("done"))
        counts = active.groupBy(*KEYS).agg(F.count("*").alias("n"))
        cand = cut_lineage(counts.where(F.col("n") > params.leaf_target)
                           .withColumn("k", F.least(F.lit(params.max_k), F.ceil(F.col("n") / params.leaf_target)).cast("int"))
                           .where(F.col("k") > 1))
        tally = cand.agg(F.count("*").alias("n"), F.count_if(F.col("n") > cap).alias("big")).first()
        if tally["n"] == 0:
            break
        parts = [pts.where("done").select(*row),
                 active.join(cand.select(*KEYS), KEYS, "left_anti").withColumn("done", F.lit(True)).select(*row)]
        info = []
        if tally["n"] > tally["big"]:  # bounded nodes: one pass, each in one task
            loc = cut_lineage(local_subtrees(active, cand.where(F.col("n") <= cap), params))
            parts.append(loc.where(F.col("kind") == "page").withColumn("done", F.lit(True)).select(*row))
            info.append(loc.where(F.col("kind") == "node").select(*KEYS, "centroid", "silhouette"))
        if tally["big"]:
            large = cand.where(F.col("n") > cap)
            seeds = tally["big"] * (params.rounds + 2) * params.max_k  # candidates of a round and new ones, at most
            if seeds * (8 * dim + 64) <= Vx.BROADCAST_BUDGET_BYTES:
                asg, level = split_blocks(active, large.orderBy(*KEYS).collect(), dim, params)
            else:
                asg, level = split_joins(active, large, dim, params)
            info.append(level)
            below = F.when(F.col("accepted"), F.concat("path", F.array("cid"))).otherwise(F.col("path"))
            parts.append(asg.withColumn("path", below).withColumn("done", ~F.col("accepted")).select(*row))
        merged, new_pts = info[0], parts[0]
        for i in info[1:]:
            merged = merged.unionByName(i)
        for part in parts[1:]:
            new_pts = new_pts.unionByName(part)
        levels.append(cut_lineage(merged))
        pts = cut_lineage(new_pts)
        if not tally["big"]:
            break
    levels = [lv.withColumn("centroid", F.transform("centroid", lambda v: v * F.lit(unit))) for lv in levels]
    return _finish(pts.withColumn("x", F.transform("x", lambda v: v * F.lit(unit))), levels, pages.sparkSession)


def _finish(pts: DataFrame, levels: list[DataFrame], spark) -> tuple[DataFrame, DataFrame]:
    leaves = pts.select(NS, "path").distinct()
    prefixes = leaves.select(NS, F.explode(F.transform(F.sequence(F.lit(0), F.size("path")),
                                                       lambda i: F.slice("path", 1, i))).alias("path")).distinct()
    nodes = prefixes.select(NS, "path", F.size("path").alias("depth"),
                            F.when(F.size("path") > 0, F.slice("path", 1, F.size("path") - 1)).alias("parent"))
    info = None
    for lv in levels:
        info = lv if info is None else info.unionByName(lv)
    if info is not None:
        nodes = nodes.join(info.select(NS, "path", "centroid", "silhouette"), [NS, "path"], "left")
    else:
        nodes = nodes.withColumn("centroid", F.lit(None).cast("array<double>")).withColumn(
            "silhouette", F.lit(None).cast("double"))
    nodes = cut_lineage(nodes)
    ids = cut_lineage(preorder_from_paths(nodes.select(NS, "path")))
    pid = ids.select(NS, F.col("path").alias("parent"), F.col("node_id").alias("parent_id"))
    # subtree statistics: pages contribute to every prefix of their path
    anc = pts.select(NS, "page_id", F.explode(_prefixes(F.col("path"))).alias("path"))
    docs = anc.groupBy(NS, "path").agg(F.count("*").alias("doc_count"))
    samples = (first_n_per_group(anc, [NS, "path"], ["page_id"], 10)
               .groupBy(NS, "path").agg(F.array_sort(F.collect_list("page_id")).alias("sample_doc_ids")))
    kids = nodes.where(F.col("parent").isNotNull()).groupBy(NS, F.col("parent").alias("path")).agg(
        F.count("*").alias("child_count"))
    # leaves without a centroid get the mean of their pages (compute-missing-centroids step)
    leaf_mean = Vx.group_mean(pts, [NS, "path"], "x", "leaf_centroid").select(NS, "path", "leaf_centroid")
    out = (nodes.join(ids, [NS, "path"]).join(pid, [NS, "parent"], "left").join(docs, [NS, "path"], "left")
           .join(kids, [NS, "path"], "left").join(samples, [NS, "path"], "left")
           .join(leaf_mean, [NS, "path"], "left")
           .select(NS, "node_id", "parent_id", "depth",
                   F.coalesce("centroid", "leaf_centroid").cast("array<float>").alias("centroid"),
                   F.coalesce("doc_count", F.lit(0)).alias("doc_count"),
                   F.coalesce("child_count", F.lit(0)).cast("int").alias("child_count"),
                   "sample_doc_ids", "silhouette", "path"))
    assignment = pts.join(ids, [NS, "path"]).select(NS, "page_id", F.col("node_id").alias("cluster_node_id"))
    return out, assignment


def _prefixes(path):
    return F.transform(F.sequence(F.lit(0), F.size(path)), lambda i: F.slice(path, 1, i))


def preorder_from_paths(nodes: DataFrame) -> DataFrame:
    """Depth-first pre-order ids (root = 1) for nodes keyed by ordinal paths.

    pre(n) = 1 + sum over non-root prefixes a of n's path of (1 + sizes of a's earlier siblings);
    subtree sizes come from exploding every node's prefixes — no per-level loop, no global sort.
    """
    anc = nodes.select(NS, "path", F.explode(_prefixes(F.col("path"))).alias("anc"))
    size = anc.groupBy(NS, F.col("anc").alias("path")).agg(F.count("*").alias("sz"))
    w = (Window.partitionBy(NS, "parent").orderBy("last")
         .rowsBetween(Window.unboundedPreceding, -1))
    contrib = (size.where(F.size("path") > 0)
               .withColumn("parent", F.slice("path", 1, F.size("path") - 1))
               .withColumn("last", F.element_at("path", -1))
               .select(NS, F.col("path").alias("anc"),
                       (F.lit(1) + F.coalesce(F.sum("sz").over(w), F.lit(0))).alias("c")))
    pre = anc.join(contrib, [NS, "anc"], "left").groupBy(NS, "path").agg(F.sum(F.coalesce("c", F.lit(0))).alias("s"))
    return pre.select(NS, "path", (F.lit(1) + F.col("s")).cast("bigint").alias("node_id"))
