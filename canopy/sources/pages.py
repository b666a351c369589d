"""Page snapshot ingestion (A1, A2, A3, A16) and the blob codec (H5).

* ndjson page records -> page_log rows (id = ``identifier``, else ``id``; records
  with neither go to a quarantine frame, or fail the job in strict mode);
* tar.gz archives: one task per archive streams its members line by line
  (bounded Arrow batches), never loading an archive into one row; archives are
  opened through pyarrow filesystems, so file:, hdfs: or object-store URIs work;
* chunk manifests; per-file record counts.
"""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.sources.scratch import local_path

PAGE_RECORD = T.StructType([
    T.StructField("identifier", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("abstract", T.StringType()),
])

PAGE_LOG_SCHEMA = "namespace string, page_id bigint, title string, chunk_name string, url string, abstract string"


def _to_page_log(raw: DataFrame, namespace_col, chunk_col) -> tuple[DataFrame, DataFrame]:
    pid = F.coalesce("identifier", "id")
    good = raw.where(pid.isNotNull()).select(
        namespace_col.alias("namespace"), pid.alias("page_id"), F.col("name").alias("title"),
        chunk_col.alias("chunk_name"), "url", "abstract")
    bad = raw.where(pid.isNull())
    return good, bad


def read_page_records(spark: SparkSession, path: str, namespace: str | None = None,
                      strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """A1: ndjson page records -> (pages, quarantine).

    Folders laid out as ``<path>/namespace=<ns>/chunk_name=<chunk>/`` give both
    columns by partition discovery; otherwise ``namespace`` is given and the
    chunk is the file's base name."""
    raw = spark.read.schema(PAGE_RECORD).json(path)
    ns = F.col("namespace") if "namespace" in raw.columns else F.lit(namespace)
    chunk = (F.col("chunk_name") if "chunk_name" in raw.columns
             else F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^/.]+$", 1))
    good, bad = _to_page_log(raw, ns, chunk)
    if strict and not bad.isEmpty():
        raise ValueError("page record without 'identifier' or 'id'")
    return good, bad


def write_page_records(page_log: DataFrame, path: str, id_field: F.Column) -> None:
    """Write page_log rows as ndjson records, partitioned by namespace and chunk.

    ``id_field``: column expression returning 'identifier' or 'id' per row (which key
    carries the page id), anything else writes a record without an id."""
    rec = page_log.select(
        "namespace", "chunk_name",
        F.when(id_field == "identifier", F.col("page_id")).alias("identifier"),
        F.when(id_field == "id", F.col("page_id")).alias("id"),
        F.col("title").alias("name"), "url", "abstract")
    rec.write.mode("overwrite").partitionBy("namespace", "chunk_name").json(path)


# --- A2: archives ----------------------------------------------------------------------

def _fs(uri: str):
    """(filesystem, path) for a URI: file:, hdfs:, s3: ... via pyarrow; bare paths are local."""
    from pyarrow import fs as pafs
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), local_path(uri)


def write_archives(page_log: DataFrame, path: str) -> DataFrame:
    """Test/producer side: one ``<chunk>.tar.gz`` per (namespace, chunk) holding one ndjson
    member.  Returns (namespace, chunk_name, archive) rows."""
    root = path.rstrip("/")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        ns, chunk = pdf["namespace"].iloc[0], pdf["chunk_name"].iloc[0]
        fs, base = _fs(f"{root}/{ns}")
        fs.create_dir(base, recursive=True)
        lines = "\n".join(json.dumps({"identifier": None if pd.isna(r.page_id) else int(r.page_id), "name": r.title, "url": r.url,
                                      "abstract": r.abstract}, ensure_ascii=False)
                          for r in pdf.sort_values("page_id").itertuples()) + "\n"
        data = lines.encode("utf-8")
        target = f"{root}/{ns}/{chunk}.tar.gz"
        fs_t, p_t = _fs(target)
        with fs_t.open_output_stream(p_t, compression=None) as out, tarfile.open(fileobj=out, mode="w|gz") as tf:
            info = tarfile.TarInfo(name=f"{chunk}.ndjson")
            info.size = len(data)
            tf.addfile(info, io.BytesIO(data))
        return pd.DataFrame({"namespace": [ns], "chunk_name": [chunk], "archive": [target]})

    return page_log.groupBy("namespace", "chunk_name").applyInPandas(
        pack, "namespace string, chunk_name string, archive string")


# --- A3 / A16 ----------------------------------------------------------------------------

MANIFEST = T.StructType([
    T.StructField("identifier", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("date_modified", T.StringType()),
    T.StructField("is_part_of", T.StructType([T.StructField("identifier", T.StringType())])),
    T.StructField("size", T.StructType([T.StructField("value", T.DoubleType()),
                                        T.StructField("unit_text", T.StringType())])),
])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A3: chunk manifest entries that carry an identifier."""
    m = spark.read.schema(MANIFEST).json(path)
    return m.where(F.col("identifier").isNotNull()).select(
        F.col("is_part_of.identifier").alias("namespace"), F.col("identifier").alias("chunk_name"),
        F.col("size.value").alias("size_value"), F.col("size.unit_text").alias("size_unit"))


def record_counts(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines per input file."""
    t = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return t.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("records"))


# --- H5: float32 blob codec ------------------------------------------------------------

@F.pandas_udf(T.BinaryType())
def encode_f32(v: pd.Series) -> pd.Series:
    return v.map(lambda a: None if a is None else np.asarray(a, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_f32(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else np.frombuffer(x, dtype="<f4").tolist())
