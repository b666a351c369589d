"""Principal component reduction (I2) and per-group projections (I7, I8 large groups).

Sign convention: each component is flipped so that its largest-magnitude
loading is positive, which fixes the otherwise arbitrary eigenvector signs.

Statistics are mergeable: (count, sum, Gram) of the rows of a group, in blocks of columns, so
that a matrix of 2 048 x 2 048 is many small rows and no large one.  A task folds all its
rows of a group into one state; states are summed before and after one shuffle; the
eigenvectors come from the covariance.

* ``reduce_namespace``: one such pass for all namespaces together, then a projection with
  the components broadcast (their size is checked);
* ``project_groups``: PCA inside every group (tree node).  Groups up to ``small_cap`` rows are
  solved in one ``applyInPandas`` call each (bounded input); larger groups never meet in
  one task and go through the same states.  Both use the same solver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.operators import vectors as Vx
from canopy.operators.vectors import as_double, broadcast_if_small, dot

SMALL_GROUP_CAP = 4096
#: Columns of a Gram block.
BLOCK = 256
#: Bytes of states that a task holds before it hands them on.
STATE_BYTES = 256 << 20


def flip_signs(components: np.ndarray) -> np.ndarray:
    """components: (k, d) rows; make the largest |loading| of each row positive."""
    return components * sign_vector(components)[:, None]


def sign_vector(components: np.ndarray) -> np.ndarray:
    idx = np.argmax(np.abs(components), axis=1)
    signs = np.sign(components[np.arange(components.shape[0]), idx])
    signs[signs == 0] = 1.0
    return signs


def components(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k, d) leading eigenvectors with fixed signs, and all eigenvalues, falling."""
    w, v = np.linalg.eigh(cov)
    order = np.argsort(w)[::-1]
    return flip_signs(v[:, order[:k]].T), w[order]


def group_states(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """``keys, d, bi, bj, n, s, g``: the summed state of every group, a row per block of columns (bi <= bj).

    ``s`` holds the sums of the columns of block bi, ``g`` the products of blocks bi and bj.
    """
    keys = list(keys)

    def rows_of(key: tuple, state: list) -> Iterator[dict]:
        n, s, g = state
        for i in range(0, len(s), BLOCK):
            for j in range(i, len(s), BLOCK):
                yield {**dict(zip(keys, key)), "d": len(s), "bi": i // BLOCK, "bj": j // BLOCK, "n": n,
                       "s": s[i:i + BLOCK], "g": g[i:i + BLOCK, j:j + BLOCK].ravel()}

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple, list] = {}
        held = 0

        def give() -> Iterator[pd.DataFrame]:
            for key, state in states.items():
                for row in rows_of(key, state):
                    yield pd.DataFrame([row])

        for pdf in batches:
            for key, g in pdf.groupby(keys, sort=False, dropna=False):
                x = np.vstack(g[vec].to_numpy()).astype(np.float64)
                key = key if isinstance(key, tuple) else (key,)
                if key not in states:
                    if held and held + 8 * x.shape[1] ** 2 > STATE_BYTES:
                        yield from give()
                        states, held = {}, 0
                    states[key] = [0, np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))]
                    held += 8 * x.shape[1] ** 2
                state = states[key]
                state[0] += len(x)
                state[1] += x.sum(axis=0)
                state[2] += x.T @ x
        yield from give()

    rows = df.where(F.col(vec).isNotNull()).select(*keys, as_double(vec).alias(vec))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
    parts = rows.mapInPandas(fold, f"{kinds}, d int, bi int, bj int, n long, s array<double>, g array<double>")
    return parts.groupBy(*keys, "d", "bi", "bj").agg(
        F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"),
        vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g"))


def group_models(states: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """``keys, d, n, mean, comps, variance`` (eigenvalues, falling) per group; a group is its d x d covariance here."""
    keys = list(keys)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in states.schema.fields if f.name in keys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        d, n = int(pdf["d"].iloc[0]), int(pdf["n"].iloc[0])
        gram, total = np.zeros((d, d)), np.zeros(d)
        for r in pdf.itertuples(index=False):
            i, j = r.bi * BLOCK, r.bj * BLOCK
            part = np.asarray(r.g).reshape(len(r.s), -1)
            gram[i:i + part.shape[0], j:j + part.shape[1]] = part
            gram[j:j + part.shape[1], i:i + part.shape[0]] = part.T
            total[i:i + len(r.s)] = r.s
        mean = total / n
        comps, w = components((gram - n * np.outer(mean, mean)) / max(n - 1, 1), k)
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in keys}, "d": d, "n": n, "mean": mean,
                              "comps": [c.tolist() for c in comps], "variance": np.maximum(w, 0.0)}])

    return states.groupBy(*keys).applyInPandas(
        solve, f"{kinds}, d int, n long, mean array<double>, comps array<array<double>>, variance array<double>")


def namespace_models(page_vector: DataFrame, target_dim: int, vec: str = "embedding") -> list:
    """The models of all namespaces (one row each), from one job."""
    models = group_models(group_states(page_vector.select("namespace", vec), ["namespace"], vec), ["namespace"], target_dim).collect()
    for m in models:
        if target_dim > m.d:
            raise ValueError(f"target_dim {target_dim} exceeds vector width {m.d}")
        if m.n < target_dim:
            raise ValueError(f"PCA needs at least {target_dim} vectors, found {m.n}")
    return models


def reduce_namespace(page_vector: DataFrame, target_dim: int, vec: str = "embedding",
                     out: str = "reduced") -> DataFrame:
    """PCA to ``target_dim`` per namespace, all namespaces in one job; ``out`` is array<float>.

    The components (namespaces x target_dim x width) are broadcast below the budget and
    joined above it.
    """
    rows = page_vector.where(F.col(vec).isNotNull())
    models = namespace_models(rows, target_dim, vec)
    spark = page_vector.sparkSession
    if sum(8 * m.d * (target_dim + 1) for m in models) > Vx.BROADCAST_BUDGET_BYTES:
        table = spark.createDataFrame([(m.namespace, m.mean, m.comps) for m in models],
                                      "namespace string, mean array<double>, comps array<array<double>>")
        centred = F.zip_with(as_double(vec), "mean", lambda a, b: a - b)
        return rows.join(table, "namespace").withColumn(
            out, F.transform("comps", lambda c: dot(centred, c)).cast("array<float>")).drop("mean", "comps") \
            .select(*page_vector.columns, out)
    shared = spark.sparkContext.broadcast({m.namespace: (np.array(m.mean), np.array(m.comps).T) for m in models})

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got: list = [None] * len(pdf)
            for ns, idx in pdf.groupby("namespace", sort=False).indices.items():
                mean, comps = shared.value[ns]
                y = (np.vstack(pdf[vec].to_numpy()[idx]).astype(np.float64) - mean) @ comps
                for i, v in zip(idx, y.astype(np.float32)):
                    got[i] = v
            pdf[out] = got
            yield pdf

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in page_vector.schema.fields)
    return rows.mapInPandas(project, f"{kinds}, {out} array<float>")


# --- per-group projection ------------------------------------------------------

def _pca_rows(x: np.ndarray, k: int) -> np.ndarray:
    """Project rows of x to k dims; fall back to the first k raw features (zero padded)
    when there are fewer features or rows than k."""
    n, d = x.shape
    if d < k or n < k:
        out = np.zeros((n, k))
        out[:, :min(d, k)] = x[:, :min(d, k)]
        return out
    xc = x - x.mean(axis=0)
    comps, _ = components(xc.T @ xc / max(n - 1, 1), k)
    return xc @ comps.T


def project_groups(df: DataFrame, keys: Sequence[str], row_id: str, vec: str, k: int = 3,
                   small_cap: int = SMALL_GROUP_CAP, out: str = "three_d") -> DataFrame:
    """PCA within each group to ``k`` dims -> (keys..., row_id, out array<double>)."""
    keys = list(keys)
    base = df.where(F.col(vec).isNotNull()).select(*keys, row_id, as_double(vec).alias("__x"))
    sizes = base.groupBy(*keys).agg(F.count("*").alias("__n"))
    tagged = base.join(sizes, keys)
    # too few rows or components for k axes: the raw components, zero padded, whatever the group's size
    narrow = (F.size("__x") < k) | (F.col("__n") < k)
    raw = F.slice(F.concat("__x", F.array_repeat(F.lit(0.0), k)), 1, k)
    narrow_res = tagged.where(narrow).select(*keys, row_id, raw.alias(out))
    small = tagged.where(~narrow & (F.col("__n") <= small_cap)).drop("__n")
    large = tagged.where(~narrow & (F.col("__n") > small_cap)).drop("__n")

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "__x"]
                       + [f"{out} array<double>"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row_id)
        x = np.vstack(pdf["__x"].to_numpy()).astype(np.float64)
        y = _pca_rows(x, k)
        res = pdf.drop(columns="__x").copy()
        res[out] = list(y)
        return res

    small_res = small.groupBy(*keys).applyInPandas(solve, schema)
    large_res = _project_large(large, keys, row_id, k, out)
    return small_res.unionByName(large_res).unionByName(narrow_res)


def _project_large(large: DataFrame, keys: list[str], row_id: str, k: int, out: str) -> DataFrame:
    """Distributed PCA for groups too big for one task."""
    model = group_models(group_states(large.select(*keys, "__x"), keys, "__x"), keys, k).select(*keys, "d", "mean", "comps").persist()
    size = model.agg(F.coalesce(F.sum(8 * F.col("d") * (k + 1)), F.lit(0)).alias("bytes")).first()["bytes"]
    j = large.join(broadcast_if_small(model.drop("d"), size, 1), keys)
    centred = F.zip_with("__x", "mean", lambda a, b: a - b)
    return j.select(*keys, row_id, F.transform("comps", lambda c: dot(centred, c)).alias(out))
