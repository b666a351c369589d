"""Pipeline artifacts shared by catalogue queries within one application.

The reference's pipeline writes each stage's table once (reduced vectors, the
tree, the search index) and later commands read it.  Catalogue queries do the
same: the first query needing an artifact builds and writes it under the
session's checkpoint folder; later queries in the same application read the
written table.  Keys include the input folder, so different scales never mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from canopy.sources.scratch import scratch_dir

_WRITTEN: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    path = _WRITTEN.get(key)
    if path is None:
        path = scratch_dir(spark, f"artifact-{name}")
        build().write.mode("overwrite").parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(path)


def value(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    """Artifacts that are not a single table (e.g. a search index of several tables)."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _OBJECTS:
        _OBJECTS[key] = build()
    return _OBJECTS[key]


_OBJECTS: dict[tuple[str, str, str], object] = {}
