"""WARC archives whose records are single Zstandard frames over one dictionary per archive.

The dictionary is built from the archive's own records and stands in a leading skippable
frame; every record is then a frame of its own, so a reader can start at any of them.
Payloads of ``least`` bytes or more that are equal are stored once: the row with the
smallest page id is the response, the others are revisit records that refer to it.

A task writes its archives into a folder of its own attempt and renames it to its final
name at the end, so a lost or repeated task leaves a whole folder or none.

Cases: a null html is an empty payload; a null url is left out of the record; a row with a
null page id is never referred to (if all equal rows have null ids, each is a response);
rows that share the smallest page id are all responses; an archive too small to train a
dictionary on gets none; an empty table writes no archive and reads back as no rows;
further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 100
DICT_MAGIC = 0x184D2A5D  # the skippable frame that holds an archive's dictionary
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def with_first(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id, url, html, digest, refers_to``: refers_to is null for a response.

    Only ids and digests are shuffled by digest, in combined form; the payloads are joined
    by page id and digest, so a payload shared by many rows meets in no single task.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"),
                        F.sha2(html, 256).alias("digest"))
    keys = rows.filter(F.octet_length("html") >= least).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")) \
        .filter("n > 1 AND refers_to IS NOT NULL").drop("n")
    revisits = keys.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    mine = revisits.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to")
    same: Column = rows["page_id"].eqNullSafe(mine["r_id"]) & (rows["digest"] == mine["r_digest"])
    return rows.join(mine, same, "left").drop("r_id", "r_digest")


def _record(page_id, url, html: str, digest: str, refers_to) -> bytes:
    payload = html.encode("utf-8", "surrogatepass")
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
            f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%:/?#[]@!$&'()*+,;=~"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_archive(records: list[bytes], dict_bytes: int = 64 << 10, level: int = 3) -> bytes:
    """The dictionary's frame, then one Zstandard frame per record."""
    import zstandard
    size = min(dict_bytes, max(256, sum(map(len, records)) // 10))
    try:
        trained = zstandard.train_dictionary(size, records, level=level)
    except zstandard.ZstdError:  # too few or too small records
        trained = None
    head = b""
    if trained is not None:
        data = trained.as_bytes()
        head = struct.pack("<II", DICT_MAGIC, len(data)) + data
        trained.precompute_compress(level=level)
    packer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_content_size=True, write_checksum=True)
    return head + b"".join(packer.compress(r) for r in records)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive."""
    import zstandard
    shared = None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_MAGIC:
        n = struct.unpack_from("<I", data, 4)[0]
        shared = zstandard.ZstdCompressionDict(data[8:8 + n])
        data = data[8 + n:]
    stream = zstandard.ZstdDecompressor(dict_data=shared).stream_reader(data, read_across_frames=True)
    plain = stream.readall()
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        n = int(headers["content-length"])
        yield headers, plain[end + 4:end + 4 + n]
        at = end + 4 + n + 4


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, archive_bytes: int = 8 << 20) -> int:
    """Write every row of ``pages`` to archives under ``folder`` (shared storage); the number of records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(folder)
        attempt = f"{root}/_attempts/{uuid.uuid4().hex}"
        held: list[bytes] = []
        size = files = total = 0

        def flush() -> None:
            nonlocal held, size, files
            if not files:
                store.create_dir(attempt)
            with store.open_output_stream(f"{attempt}/{files:05d}.warc.zst", compression=None) as out:
                out.write(build_archive(held))
            files, held, size = files + 1, [], 0

        for batch in batches:
            for page_id, url, html, digest, refers in zip(*(batch[c] for c in (
                    "page_id", "url", "html", "digest", "refers_to"))):
                held.append(_record(page_id, url, html, digest, refers))
                size, total = size + len(held[-1]), total + 1
                if size >= archive_bytes:
                    flush()
        if held:
            flush()
        if files:
            final = f"{root}/part-{TaskContext.get().partitionId():06d}"
            if store.get_file_info(final).type == fs.FileType.NotFound:
                store.move(attempt, final)
            else:  # an earlier attempt of this task has finished its work
                store.delete_dir(attempt)
        yield pd.DataFrame({"n": [total]})

    as_text = [F.col(c).cast("string").alias(c) for c in ("page_id", "refers_to")]  # ids survive null as text
    rows = with_first(pages, least).select(as_text[0], "url", "html", "digest", as_text[1])
    _make_folder(pages.sparkSession, folder)
    return rows.mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def _make_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
           "payload_digest string, payload binary")


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives: for a response, length and digest come from the payload read,
    for a revisit from its headers (they are those of the payload it refers to)."""

    def page(urn: str | None) -> int | None:
        found = re.search(r"<urn:page:(-?\d+)>", urn or "")
        return int(found[1]) if found else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                rows = []
                for h, block in parse_archive(data):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    if h["warc-type"] == "response":
                        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if h["warc-payload-digest"] != f"sha256:{digest}":
                            raise ValueError(f"damaged record {h['warc-record-id']}")
                    else:
                        n = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest = h["warc-payload-digest"].removeprefix("sha256:")
                    rows.append((page(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"],
                                 page(h.get("warc-refers-to")), n, digest, payload if with_payload else None))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")], dtype=object)
                yield out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true") \
        .option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("content").mapInPandas(run, RECORDS)
