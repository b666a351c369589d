"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.session import ensure_checkpoint_dir, ship_package
from canopy.sources.scratch import scratch_dir
from canopy.tables import read

#: The six ASCII white-space characters that separate words everywhere in this folder.
SPACE_CLASS = r"\x20\x09-\x0D"


def prepare(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return read(spark, sf_dir, name)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared scratch folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the words of a text column; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+"), "")


def partitions_for(df: DataFrame, rows_each: int) -> int:
    """Number of partitions that holds about ``rows_each`` rows apiece (a count job on the input)."""
    return max(1, -(-df.count() // rows_each))
