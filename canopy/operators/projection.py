"""3-D layout vectors: per-node page projection (I7) and centroid projection (I8)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.operators import pca as P
from canopy.operators import vectors as Vx


def page_projection(page_vector: DataFrame, vec: str = "reduced", k: int = 3,
                    only_missing: bool = True) -> DataFrame:
    """PCA to ``k`` dims inside every tree node -> (namespace, page_id, node_id, three_d).

    Pages without a vector are skipped; with ``only_missing`` pages that already
    have ``three_d`` are left alone.
    """
    pv = page_vector.where(F.col("cluster_node_id").isNotNull() & F.col(vec).isNotNull())
    if only_missing and "three_d" in pv.columns:
        pv = pv.where(F.col("three_d").isNull())
    pv = pv.select("namespace", F.col("cluster_node_id").alias("node_id"), "page_id", vec)
    return P.project_groups(pv, ["namespace", "node_id"], "page_id", vec, k, out="three_d")


def _log_length_np(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1)
    target = np.where(n >= 1.0, 1.0 + np.log(np.maximum(n, 1e-300)), 1.0)
    return v / np.maximum(n, 1e-8)[:, None] * target[:, None]


def centroid_projection(tree: DataFrame, k: int = 3, max_shape_group: int = 6) -> DataFrame:
    """I8: relative 3-D direction of every node among its siblings.

    root -> origin; sibling groups of <= 6 -> fixed shapes (sibling order by node_id);
    larger groups -> PCA(3) of the sibling centroids, lengths log-normalised (>= 1);
    a group whose PCA cannot run gets zeros.  Groups are one parent's children,
    bounded by the fan-out (<= max_k), so each fits one task.
    """
    small = Vx.geometric_projection(tree, max_shape_group)
    ranked = Vx.sibling_rank(tree).where(F.col("group_size") > max_shape_group).select(
        "namespace", "parent_id", "node_id", Vx.as_double("centroid").alias("c"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id")
        out = np.zeros((len(pdf), k))
        if pdf["c"].notna().all():
            x = np.vstack(pdf["c"].to_numpy()).astype(np.float64)
            if x.shape[1] >= k and x.shape[0] >= k:
                xc = x - x.mean(axis=0)
                _, _, vt = np.linalg.svd(xc, full_matrices=False)
                out = _log_length_np(xc @ P.flip_signs(vt[:k]).T)
        return pd.DataFrame({"namespace": pdf["namespace"], "node_id": pdf["node_id"],
                             "x": out[:, 0], "y": out[:, 1], "z": out[:, 2]})

    large = ranked.groupBy("namespace", "parent_id").applyInPandas(
        solve, "namespace string, node_id bigint, x double, y double, z double")
    return small.unionByName(large)
