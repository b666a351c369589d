"""tar.gz archives of ndjson page records as a Python data source (A2).

``<root>/<namespace>/<chunk>.tar.gz``: a partition per archive, streamed member by member (the
first one only, unless ``all_members``).  Lines are decoded to Arrow in blocks; a block that
does not parse is halved until the lines at fault stand alone, so sound lines never pass
through Python one by one.  Those lines, records without an id and archives that cannot be read
to their end become rows with an ``error``; what was read before the damage is kept.
"""

from __future__ import annotations

import io
import tarfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = ("namespace string, page_id long, title string, chunk_name string, url string, abstract string, error string, "
          "archive string, line string")
BLOCK_BYTES = 4 << 20
_TEXT = pa.string()
_RECORD = pa.schema([("identifier", pa.int64()), ("id", pa.int64()), ("name", _TEXT), ("url", _TEXT), ("abstract", _TEXT)])
_ROW = pa.schema([("namespace", _TEXT), ("page_id", pa.int64()), ("title", _TEXT), ("chunk_name", _TEXT), ("url", _TEXT),
                  ("abstract", _TEXT), ("error", _TEXT), ("archive", _TEXT), ("line", _TEXT)])


@dataclass
class Archive(InputPartition):
    path: str
    namespace: str
    chunk: str
    all_members: bool


def _blocks(stream) -> Iterator[bytes]:
    """The lines of a stream in blocks of whole lines."""
    rest = b""
    while data := stream.read(BLOCK_BYTES):
        rest += data
        cut = rest.rfind(b"\n") + 1
        if cut:
            yield rest[:cut]
            rest = rest[cut:]
    if rest.strip():
        yield rest


def _parsed(lines: list[bytes]) -> Iterator[tuple[pa.Table | None, bytes | None]]:
    """(records, None) for lines that parse, (None, line) for each that does not."""
    import pyarrow.json as pj
    try:
        # no record may span lines, so as many records as lines means that all are sound
        t = pj.read_json(io.BytesIO(b"\n".join(lines)), pj.ReadOptions(block_size=2 * BLOCK_BYTES + sum(map(len, lines))),
                         pj.ParseOptions(explicit_schema=_RECORD, unexpected_field_behavior="ignore"))
        if len(t) == len(lines):
            yield t, None
            return
    except pa.ArrowInvalid:
        pass
    if len(lines) == 1:
        yield None, lines[0]
        return
    yield from _parsed(lines[:len(lines) // 2])
    yield from _parsed(lines[len(lines) // 2:])


def _rows(a: Archive, t: pa.Table) -> pa.RecordBatch:
    import pyarrow.compute as pc
    n = len(t)
    page = pc.coalesce(t["identifier"], t["id"]).combine_chunks()
    error = pc.if_else(pc.is_null(page), pa.scalar("record without an id", _TEXT), pa.scalar(None, _TEXT))
    named = [pa.array([v] * n, _TEXT) for v in (a.namespace, a.chunk, a.path, None)]
    cols = [named[0], page, t["name"].combine_chunks(), named[1], t["url"].combine_chunks(), t["abstract"].combine_chunks(), error,
            named[2], named[3]]
    return pa.RecordBatch.from_arrays(cols, schema=_ROW)


def _fault(a: Archive, error: str, line: str | None = None) -> pa.RecordBatch:
    row = {"namespace": a.namespace, "chunk_name": a.chunk, "error": error, "archive": a.path, "line": line}
    return pa.RecordBatch.from_pylist([row], schema=_ROW)


def read_archive(root: str, a: Archive) -> Iterator[pa.RecordBatch]:
    from canopy.sources.pages import _fs
    files, _ = _fs(root)
    try:
        with files.open_input_stream(a.path, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|gz") as tar:
            for member in tar:
                if not member.isfile():
                    continue
                for block in _blocks(tar.extractfile(member)):
                    for t, line in _parsed([x for x in block.split(b"\n") if x.strip()]):
                        yield _rows(a, t) if t is not None else _fault(a, "line is no record", line.decode("utf-8", "replace"))
                if not a.all_members:
                    return
    except (tarfile.TarError, EOFError, zlib.error):
        yield _fault(a, "damaged archive")


class PageArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "PageArchiveReader":
        return PageArchiveReader(dict(self.options))


class PageArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.all_members = options["path"].rstrip("/"), options.get("all_members") == "true"

    def partitions(self) -> list[Archive]:
        from pyarrow import fs as pafs

        from canopy.sources.pages import _fs
        files, base = _fs(self.root)
        found = []
        for info in files.get_file_info(pafs.FileSelector(base, recursive=True)):
            if info.type == pafs.FileType.File and info.path.endswith(".tar.gz"):
                folder, _, name = info.path.rpartition("/")
                found.append(Archive(info.path, folder.rpartition("/")[2], name[:-7], self.all_members))
        return sorted(found, key=lambda a: a.path)

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        return read_archive(self.root, partition)


def read_archives(spark: SparkSession, root: str, all_members: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pages, set aside) of all archives under ``root``; an archive's damage is a row of the second with its name."""
    spark.dataSource.register(PageArchives)
    rows = spark.read.format("page_archives").option("path", root).option("all_members", str(all_members).lower()).load()
    return rows.where("error IS NULL").drop("error", "archive", "line"), \
        rows.where("error IS NOT NULL").select("namespace", "chunk_name", "archive", "error", "line")


def damaged(path: str) -> None:
    """Write an archive that is cut off (for tests and the quarantine query)."""
    from canopy.sources.pages import _fs
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as tar:
        info = tarfile.TarInfo("x.ndjson")
        body = b'{"identifier": 1}\n' * 5000
        info.size = len(body)
        tar.addfile(info, io.BytesIO(body))
    files, p = _fs(path)
    files.create_dir(p.rpartition("/")[0], recursive=True)
    with files.open_output_stream(p, compression=None) as out:
        out.write(data.getvalue()[:60])
