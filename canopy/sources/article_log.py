"""The change stream as a log in files: a Python data source that resumes at an offset of each part.

The log lies in ``<root>/part=<n>/`` folders of ndjson files; the records of a part carry
ascending offsets, and a file holds a run of them.  A stream starts after the ``offsets``
given per part, or a batch read does; from then on the checkpoint owns the progress, which
is an offset per part and so may lie in the middle of a file.  A task reads one file in
Arrow batches and keeps the records between the two offsets of its micro-batch.

Options: ``path``; ``parts`` (comma list, default all); ``offsets`` (JSON, part -> last offset already seen);
``since`` (JSON, part -> ISO time of the oldest record wanted); ``until`` (JSON, part -> last offset to read).
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = ("event_identifier long, page_id long, date_published timestamp_ntz, event_kind string, part int, off long, "
          "value double, props string")
TAIL_BYTES = 1 << 16
START = -1


def _open(uri: str):
    from canopy.sources.pages import _fs
    return _fs(uri)


@dataclass
class Segment(InputPartition):
    """The records of one file with offsets over ``after`` and up to ``last``."""

    path: str
    part: int
    after: int
    last: int
    since: str | None


class _Log:
    """Files and offsets of a log, as the options ask for them."""

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        parts = options.get("parts")
        self.parts = {int(p) for p in parts.split(",")} if parts else None
        self.offsets, self.until = ({int(k): int(v) for k, v in json.loads(options.get(name, "{}")).items()}
                                    for name in ("offsets", "until"))
        self.since = {int(k): v for k, v in json.loads(options.get("since", "{}")).items()}
        self.known: dict[tuple[str, int], tuple[int, int]] = {}  # (file, size) -> its first and last offset

    def files(self) -> dict[int, list[tuple[str, int, int]]]:
        """part -> (file, first offset, last offset), ascending."""
        from pyarrow import fs as pafs
        files, base = _open(self.root)
        out: dict[int, list[tuple[str, int, int]]] = {}
        for info in files.get_file_info(pafs.FileSelector(base, recursive=True)):
            folder, _, name = info.path.rpartition("/")
            label = folder.rpartition("/")[2]
            if info.type != pafs.FileType.File or not info.size or not label.startswith("part=") or name[0] in "._":
                continue
            part = int(label[5:])
            if self.parts is None or part in self.parts:
                ends = self.known.get((info.path, info.size))
                if ends is None:
                    ends = self.known[info.path, info.size] = self._ends(files, info)
                out.setdefault(part, []).append((info.path, *ends))
        return {p: sorted(f, key=lambda x: x[1]) for p, f in out.items()}

    @staticmethod
    def _ends(files, info) -> tuple[int, int]:
        """First and last offset of a file, from its first and its last line."""
        with files.open_input_file(info.path) as f:
            size = TAIL_BYTES
            head = f.read_at(min(size, info.size), 0)
            while b"\n" not in head and len(head) < info.size:
                size *= 4
                head = f.read_at(min(size, info.size), 0)
            size = TAIL_BYTES
            while True:
                tail = f.read_at(min(size, info.size), max(0, info.size - size)).rstrip(b"\n")
                if b"\n" in tail or size >= info.size:
                    break
                size *= 4
        return json.loads(head.split(b"\n", 1)[0])["off"], json.loads(tail.rsplit(b"\n", 1)[-1])["off"]

    def start(self) -> dict[str, int]:
        return {str(p): self.offsets.get(p, START) for p in sorted(self.files())}

    def end(self) -> dict[str, int]:
        out = {}
        for part, held in self.files().items():
            last = held[-1][2]
            out[str(part)] = max(min(last, self.until.get(part, last)), self.offsets.get(part, START))
        return out

    def between(self, start: dict[str, int], end: dict[str, int]) -> list[Segment]:
        out = []
        for part, held in self.files().items():
            after = start.get(str(part), self.offsets.get(part, START))
            last = end.get(str(part), after)
            out += [Segment(path, part, after, last, self.since.get(part)) for path, low, high in held
                    if high > after and low <= last]
        return out


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
          "timestamp_ntz": pa.timestamp("us")}


def _arrow_schema() -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (field.split() for field in SCHEMA.split(", "))])


def read_segment(root: str, segment: Segment) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc
    import pyarrow.json as pj
    schema = _arrow_schema()
    files, _ = _open(root)
    with files.open_input_stream(segment.path) as f:
        reader = pj.open_json(f, pj.ReadOptions(block_size=8 << 20),
                              pj.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore"))
        for batch in reader:
            columns = [pa.array([segment.part] * len(batch), pa.int32()) if name == "part" else batch.column(name)
                       for name in schema.names]
            off = batch.column("off")
            keep = pc.and_(pc.greater(off, segment.after), pc.less_equal(off, segment.last))
            if segment.since:
                oldest = pa.scalar(dt.datetime.fromisoformat(segment.since), pa.timestamp("us"))
                keep = pc.and_(keep, pc.greater_equal(batch.column("date_published"), oldest))
            yield pa.RecordBatch.from_arrays(columns, schema=schema).filter(keep)


class ArticleLog(DataSource):
    """``spark.read`` or ``spark.readStream`` ``.format("article_log")``, once it is registered."""

    @classmethod
    def name(cls) -> str:
        return "article_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "ArticleLogReader":
        return ArticleLogReader(dict(self.options))

    def streamReader(self, schema) -> "ArticleLogStream":
        return ArticleLogStream(dict(self.options))


class ArticleLogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Segment]:
        log = _Log(self.options)
        return log.between(log.start(), log.end())

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return read_segment(self.options["path"], partition)


class ArticleLogStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self.log = None

    def _log(self) -> _Log:
        if self.log is None:
            self.log = _Log(self.options)
        return self.log

    def initialOffset(self) -> dict:
        return self._log().start()

    def latestOffset(self) -> dict:
        return self._log().end()

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return self._log().between(start, end)

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return read_segment(self.options["path"], partition)

    def commit(self, end: dict) -> None:
        pass


def open_log(spark, stream: bool = True, *, path: str, parts=None, offsets=None, since=None, until=None):
    """The log as a DataFrame; bounds are dicts by part (``since``: datetimes)."""
    spark.dataSource.register(ArticleLog)
    reader = (spark.readStream if stream else spark.read).format("article_log").option("path", path)
    if parts:
        reader = reader.option("parts", ",".join(str(p) for p in parts))
    for name, bounds in (("offsets", offsets), ("until", until)):
        if bounds:
            reader = reader.option(name, json.dumps({str(k): int(v) for k, v in bounds.items()}))
    if since:
        reader = reader.option("since", json.dumps({str(k): v.isoformat() for k, v in since.items()}))
    return reader.load()
