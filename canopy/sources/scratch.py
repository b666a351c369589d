"""Shared scratch folders for written intermediate tables.

They live under the cluster's checkpoint folder (``spark.checkpoint.dir``), which
every executor can reach — never a machine-local temporary folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from canopy.session import ensure_checkpoint_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/canopy-scratch/{name}-{uuid.uuid4().hex[:12]}"


def local_path(uri: str) -> str:
    """Filesystem path of a ``file:`` URI (for Python-side file access on a shared mount)."""
    if uri.startswith("file://"):
        return uri[len("file://"):]
    if uri.startswith("file:"):
        return uri[len("file:"):]
    return uri
