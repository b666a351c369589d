"""Vector operators in closed form (D7, I3a, I3b, I4, I6, I8 small groups, I9, I10, I12).

Vectors are ``array<float>`` at rest and ``array<double>`` in arithmetic.  Means
and sums use ``Summarizer`` (one vector buffer per group, map-side combined), and
"point vs. candidate centres" work either ships a centre table whose measured size
fits the broadcast budget to every task and runs BLAS products per Arrow batch, or
packs each group's centres into one array (bounded by k <= max_k) joined to the
points and compared with JVM array functions.  No operator forms point pairs; the
silhouette uses per-cluster sums instead.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_BUDGET_BYTES = 64 * 1024 * 1024


# --- array arithmetic (JVM-side higher-order functions) ----------------------

def as_double(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def sqdist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Column, s: Column) -> Column:
    return F.transform(a, lambda x: x * s)


def unit(a: Column) -> Column:
    """a / |a|; the zero vector stays zero."""
    n = norm(a)
    return F.when(n > 0, scale(a, F.lit(1.0) / n)).otherwise(F.transform(a, lambda x: x * 0.0))


def round_vec(a: Column, digits: int = 6) -> Column:
    return F.transform(a, lambda x: F.round(x, digits))


def log_length(a: Column) -> Column:
    """Keep direction, length L -> 1 + ln(L) when L >= 1, else 1 (1e-8 floor on the divisor)."""
    n = norm(a)
    target = F.when(n >= 1.0, F.lit(1.0) + F.log(n)).otherwise(F.lit(1.0))
    return scale(a, target / F.greatest(n, F.lit(1e-8)))


# --- grouped means / sums ------------------------------------------------------

def group_mean(df: DataFrame, keys: Sequence[str], vec: str, out: str = "centroid") -> DataFrame:
    """Mean vector per group (array<double>) with the group size."""
    return (df.where(F.col(vec).isNotNull())
            .select(*keys, array_to_vector(as_double(vec)).alias("__v"))
            .groupBy(*keys)
            .agg(vector_to_array(Summarizer.mean(F.col("__v"))).alias(out), F.count("*").alias("n")))


def group_sum(df: DataFrame, keys: Sequence[str], vec: Column, out: str = "s") -> DataFrame:
    return (df.select(*keys, array_to_vector(vec).alias("__v"))
            .groupBy(*keys)
            .agg(vector_to_array(Summarizer.sum(F.col("__v"))).alias(out), F.count("*").alias("n")))


def broadcast_if_small(df: DataFrame, n_rows: int, row_bytes: int,
                       budget: int = BROADCAST_BUDGET_BYTES) -> DataFrame:
    """Broadcast hint only behind a measured size; otherwise let the planner shuffle."""
    return F.broadcast(df) if n_rows * row_bytes <= budget else df


def pack_centres(centres: DataFrame, keys: Sequence[str], cid: str, vec: str, extra: Sequence[str] = ()) -> DataFrame:
    """One row per group with its sorted candidate list ``cands: array<struct<cid, vec, ...>>``."""
    fields = [F.col(cid).alias("cid"), as_double(vec).alias("vec"), *[F.col(e) for e in extra]]
    return centres.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("cands"))


# --- I3a / I3b: nearest centre and one Lloyd update -----------------------------

def nearest_centre(points: DataFrame, centres: DataFrame, keys: Sequence[str], vec: str = "vec",
                   cid: str = "cid", dim: int | None = None) -> DataFrame:
    """Assign each point to the nearest (squared Euclidean) centre of its group.

    Ties go to the smallest centre id.  Output: points' columns + ``cid``, ``dist2``.
    A centre table within the broadcast budget is shipped once and compared with BLAS
    per Arrow batch; otherwise each group's centres are joined and compared in the JVM.
    """
    width = dim or len(centres.select(vec).first()[0])
    if centres.count() * (8 * width + 64) <= BROADCAST_BUDGET_BYTES:
        return nearest_centre_blas(points, centres, list(keys), vec, cid)
    packed = pack_centres(centres, keys, cid, vec)
    j = points.join(packed, list(keys))
    x = as_double(vec)
    best = F.array_min(F.transform("cands", lambda c: F.struct(sqdist(c["vec"], x).alias("d"),
                                                               c["cid"].alias("c"))))
    return j.withColumn("__b", best).select(
        *[c for c in points.columns], F.col("__b.c").alias(cid), F.col("__b.d").alias("dist2"))


def collect_centres(centres: DataFrame, keys: list[str], cid: str, vec: str) -> dict:
    """{group key: (sorted centre ids, centre matrix)} — callers check the size first."""
    import numpy as np
    table: dict = {}
    for r in centres.select(*keys, cid, vec).collect():
        table.setdefault(tuple(_hashable(r[k]) for k in keys), []).append((r[cid], list(r[vec])))
    return {k: (np.array([c for c, _ in sorted(v)]), np.array([x for _, x in sorted(v)], dtype=np.float64))
            for k, v in table.items()}


def nearest_centre_blas(points: DataFrame, centres: DataFrame, keys: list[str], vec: str, cid: str) -> DataFrame:
    """Broadcast (size-checked by the caller) centres, BLAS distances per Arrow batch."""
    return assign_packed(points, collect_centres(centres, keys, cid, vec), keys, vec, cid,
                         centres.schema[cid].dataType.simpleString())


def assign_packed(points: DataFrame, packed: dict, keys: list[str], vec: str, cid: str,
                  cid_type: str = "int") -> DataFrame:
    """Nearest centre per point from an already collected (bounded) centre table."""
    import numpy as np
    bc = points.sparkSession.sparkContext.broadcast(packed)
    cols = points.columns

    def run(it):
        cent = bc.value
        for pdf in it:
            ids_out = np.zeros(len(pdf), dtype=np.int64)
            d_out = np.full(len(pdf), np.nan)
            hit = np.zeros(len(pdf), dtype=bool)
            keycols = [pdf[k].map(_hashable) for k in keys]
            for key, idx in pdf.groupby(keycols, sort=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                if key not in cent:
                    continue
                ids, c = cent[key]
                x = np.vstack(pdf[vec].to_numpy()[idx]).astype(np.float64)
                d2 = np.maximum((x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :], 0.0)
                best = d2.argmin(axis=1)
                ids_out[idx] = ids[best]
                d_out[idx] = d2[np.arange(len(idx)), best]
                hit[idx] = True
            out = pdf[cols].copy()
            out[cid] = ids_out
            out["dist2"] = d_out
            yield out[hit]          # points whose group has no centre drop out, as in the join path

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInPandas(run, f"{fields}, {cid} {cid_type}, dist2 double")


def lloyd_update(assigned: DataFrame, keys: Sequence[str], vec: str = "vec", cid: str = "cid") -> DataFrame:
    """New centres = mean of the assigned points (empty centres disappear)."""
    return group_mean(assigned, [*keys, cid], vec, "vec")


# --- I4: exact cosine silhouette in linear time -----------------------------------

def silhouette_points(points: DataFrame, keys: Sequence[str], label: str, vec: str,
                      dim: int | None = None) -> DataFrame:
    """Per-point cosine silhouette within each group (all points, no sampling).

    With unit rows u and per-cluster sums S_k, n_k:
      a = (n_c - 1 - (u.S_c - u.u)) / (n_c - 1)
      b = min_{k != c} (1 - u.S_k / n_k)
      s = (b - a) / max(a, b); s = 0 for singleton clusters (and 0/0).
    """
    u = points.select(*keys, label, *[c for c in points.columns if c not in (*keys, label, vec)],
                      unit(as_double(vec)).alias("__u"))
    sums = group_sum(u, [*keys, label], F.col("__u"), "S")
    n_sums = sums.count()
    if n_sums * (8 * (dim or 128) + 64) <= BROADCAST_BUDGET_BYTES:
        return _silhouette_blas(u, sums, list(keys), label)
    packed = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct(F.col(label).alias("cid"), F.col("n"), F.col("S")))).alias("cands"))
    j = u.join(packed, list(keys))
    lab = F.col(label)
    own = F.filter("cands", lambda c: c["cid"] == lab)[0]
    others = F.filter("cands", lambda c: c["cid"] != lab)
    self_dot = dot(F.col("__u"), F.col("__u"))
    a = (own["n"] - 1 - (dot(F.col("__u"), own["S"]) - self_dot)) / (own["n"] - 1)
    b = F.array_min(F.transform(others, lambda c: F.lit(1.0) - dot(F.col("__u"), c["S"]) / c["n"]))
    m = F.greatest(a, b)
    s = F.when((own["n"] <= 1) | (m == 0) | b.isNull(), F.lit(0.0)).otherwise((b - a) / m)
    return j.select(*[c for c in u.columns if c != "__u"], s.alias("silhouette"))


def _silhouette_blas(u: DataFrame, sums: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Same closed form with the (size-checked) cluster sums broadcast and BLAS per Arrow batch."""
    import numpy as np
    table: dict = {}
    for r in sums.collect():
        table.setdefault(tuple(_hashable(r[k]) for k in keys), []).append((r[label], r["n"], r["S"]))
    packed = {k: (np.array([a for a, _, _ in sorted(v)]), np.array([n for _, n, _ in sorted(v)], dtype=np.float64),
                  np.array([sv for _, _, sv in sorted(v)], dtype=np.float64)) for k, v in table.items()}
    bc = u.sparkSession.sparkContext.broadcast(packed)
    out_cols = [c for c in u.columns if c != "__u"]

    def run(it):
        sums_by = bc.value
        for pdf in it:
            s = np.zeros(len(pdf))
            keycols = [pdf[k].map(_hashable) for k in keys]
            for key, idx in pdf.groupby(keycols, sort=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                ids, cnt, S = sums_by[key]
                x = np.vstack(pdf["__u"].to_numpy()[idx]).astype(np.float64)
                pos = np.searchsorted(ids, pdf[label].to_numpy()[idx])
                dots = x @ S.T
                selfd = (x * x).sum(axis=1)
                own = cnt[pos]
                a = np.where(own > 1, (own - 1 - (dots[np.arange(len(x)), pos] - selfd)) / np.maximum(own - 1, 1), 0.0)
                other = 1.0 - dots / cnt[None, :]
                other[np.arange(len(x)), pos] = np.inf
                b = other.min(axis=1) if len(ids) > 1 else np.full(len(x), np.nan)
                m = np.maximum(a, b)
                ok = (own > 1) & (m != 0) & ~np.isnan(b)
                s[idx] = np.where(ok, (b - a) / np.where(ok, m, 1.0), 0.0)
            out = pdf[out_cols].copy()
            out["silhouette"] = s
            yield out

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in u.schema.fields if f.name != "__u")
    return u.mapInPandas(run, f"{fields}, silhouette double")


def _hashable(v):
    return tuple(v) if hasattr(v, "__len__") and not isinstance(v, str) else v


def silhouette_score(points: DataFrame, keys: Sequence[str], label: str, vec: str) -> DataFrame:
    return silhouette_points(points, keys, label, vec).groupBy(*keys).agg(
        F.avg("silhouette").alias("silhouette"), F.count("*").alias("n"))


# --- D7 / I6: leaf and node centroids ----------------------------------------------

class AssumptionViolated(RuntimeError):
    pass


def missing_leaf_centroids(tree: DataFrame, pages: DataFrame, vec: str = "vec", check: bool = True) -> DataFrame:
    """Mean page vector for every node whose centroid is null.

    Such nodes must be leaves (raises ``AssumptionViolated`` otherwise); a node with
    no vectors keeps a null centroid.  ``pages``: (namespace, node_id, vec).
    """
    todo = tree.where(F.col("centroid").isNull()).select("namespace", "node_id")
    if check:
        parents = tree.where(F.col("parent_id").isNotNull()).select(
            "namespace", F.col("parent_id").alias("node_id")).distinct()
        bad = todo.join(parents, ["namespace", "node_id"], "left_semi")
        if not bad.isEmpty():
            raise AssumptionViolated("nodes without centroid have children: "
                                     + ", ".join(str(r.node_id) for r in bad.limit(20).collect()))
    means = group_mean(pages.join(todo, ["namespace", "node_id"], "left_semi"), ["namespace", "node_id"], vec)
    return todo.join(means, ["namespace", "node_id"], "left").select("namespace", "node_id", "centroid", "n")


def node_centroids_bottom_up(tree: DataFrame, leaf_centroids: DataFrame) -> DataFrame:
    """An inner node's centroid is the unweighted mean of its children's centroids.

    One aggregate per level, deepest first (levels <= tree depth).
    """
    known = leaf_centroids.select("namespace", "node_id", "centroid")
    max_depth = tree.agg(F.max("depth")).first()[0] or 0
    for depth in range(max_depth - 1, -1, -1):
        kids = (tree.where(F.col("depth") == depth + 1).select("namespace", "node_id", "parent_id")
                .join(known, ["namespace", "node_id"]))
        level = (group_mean(kids, ["namespace", "parent_id"], "centroid")
                 .select("namespace", F.col("parent_id").alias("node_id"), "centroid"))
        lvl_nodes = tree.where(F.col("depth") == depth).select("namespace", "node_id")
        level = level.join(lvl_nodes, ["namespace", "node_id"], "left_semi").join(
            known.select("namespace", "node_id"), ["namespace", "node_id"], "left_anti")
        known = known.unionByName(level)
    return known


# --- I8 / I10: fixed shapes for small sibling groups --------------------------------

_S3 = math.sqrt(3.0)
# Unit directions for sibling groups of 1..6 nodes, in sibling order
# (1, 2: on the y axis; 3: 120 degrees apart in the x-y plane; 4: tetrahedron;
# 5: the two poles then the equator at 72, 144, 216 degrees; 6: octahedron).
SIBLING_SHAPES = {
    1: [(0.0, 1.0, 0.0)],
    2: [(0.0, 1.0, 0.0), (0.0, -1.0, 0.0)],
    3: [(math.sin(0.0), math.cos(0.0), 0.0),
        (math.sin(2 * math.pi / 3), math.cos(2 * math.pi / 3), 0.0),
        (math.sin(4 * math.pi / 3), math.cos(4 * math.pi / 3), 0.0)],
    4: [(1 / _S3, 1 / _S3, 1 / _S3), (1 / _S3, -1 / _S3, -1 / _S3),
        (-1 / _S3, 1 / _S3, -1 / _S3), (-1 / _S3, -1 / _S3, 1 / _S3)],
    5: [(0.0, 0.0, 1.0), (0.0, 0.0, -1.0),
        (math.cos(2 * math.pi / 5), math.sin(2 * math.pi / 5), 0.0),
        (math.cos(4 * math.pi / 5), math.sin(4 * math.pi / 5), 0.0),
        (math.cos(6 * math.pi / 5), math.sin(6 * math.pi / 5), 0.0)],
    6: [(1.0, 0.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, -1.0, 0.0), (0.0, 0.0, 1.0), (0.0, 0.0, -1.0)],
}

# Placement of 2 or 3 points in the simple geometric projection.
SMALL_SET_SHAPES = {
    2: [(-1.0, 0.0, 0.0), (1.0, 0.0, 0.0)],
    3: [(-1.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)],
}


def shape_rows(shapes: dict) -> list[tuple[int, int, float, float, float]]:
    return [(n, i + 1, *v) for n, vs in sorted(shapes.items()) for i, v in enumerate(vs)]


def shape_table(spark: SparkSession, shapes: dict = SIBLING_SHAPES) -> DataFrame:
    """(group_size, rank, x, y, z) — 21 fixed rows, always safe to broadcast."""
    return spark.createDataFrame(shape_rows(shapes), "group_size int, rank int, x double, y double, z double")


def sibling_rank(tree: DataFrame) -> DataFrame:
    """Position of each non-root node among its siblings (node_id order) and the group size.

    The window spans one parent's children (bounded by the fan-out k <= max_k).
    """
    w = Window.partitionBy("namespace", "parent_id")
    return (tree.where(F.col("parent_id").isNotNull())
            .withColumn("rank", F.row_number().over(w.orderBy("node_id")))
            .withColumn("group_size", F.count("*").over(w)))


def geometric_projection(tree: DataFrame, max_group: int = 6) -> DataFrame:
    """I8 for groups of <= ``max_group`` siblings: fixed shape by sibling order; root at origin.

    Returns (namespace, node_id, x, y, z); nodes in larger groups are left out (PCA path).
    """
    spark = tree.sparkSession
    ranked = sibling_rank(tree).where(F.col("group_size") <= max_group)
    placed = ranked.join(F.broadcast(shape_table(spark)), ["group_size", "rank"]).select(
        "namespace", "node_id", "x", "y", "z")
    roots = tree.where(F.col("parent_id").isNull()).select(
        "namespace", "node_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return roots.unionByName(placed)


def small_set_projection(groups: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """2 points on a line, 3 in a triangle (by ``order`` within each group); other sizes omitted."""
    spark = groups.sparkSession
    w = Window.partitionBy(*keys)
    ranked = (groups.withColumn("rank", F.row_number().over(w.orderBy(order)))
              .withColumn("group_size", F.count("*").over(w)))
    return ranked.join(F.broadcast(shape_table(spark, SMALL_SET_SHAPES)), ["group_size", "rank"]).select(
        *keys, order, "x", "y", "z")
