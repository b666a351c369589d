"""The log source: bounds by part, stops in mid-file, files that grow."""

import datetime as dt
import json
import os

import pytest

from canopy.sources.article_log import _Log, open_log
from canopy.sources.scratch import local_path, scratch_dir
from canopy.streaming import articles as N


def write(root, part, name, offs, mode="w"):
    folder = f"{local_path(root)}/part={part}"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", mode) as f:
        for o in offs:
            f.write(json.dumps({"event_identifier": part * 1000 + o, "page_id": o % 7, "off": o, "value": float(o), "more": [1],
                                "date_published": f"2024-01-01T{o % 24:02d}:00:00.000", "event_kind": "update"}) + "\n")


@pytest.fixture()
def root(spark):
    root = scratch_dir(spark, "article-log")
    write(root, 0, "a.json", range(0, 40))
    write(root, 0, "b.json", range(40, 50))
    write(root, 1, "x.json", range(0, 30))
    write(root, 1, "_hidden", range(100, 101))
    return root


def got(df):
    return sorted((r.part, r.off) for r in df.collect())


def test_batch_bounds(spark, root):
    assert len(got(open_log(spark, False, path=root))) == 80
    assert got(open_log(spark, False, path=root, parts=[1], offsets={1: 27})) == [(1, 28), (1, 29)]
    assert got(open_log(spark, False, path=root, offsets={0: 38, 1: 99}, until={0: 41})) == [(0, 39), (0, 40), (0, 41)]
    late = open_log(spark, False, path=root, parts=[0], since={0: dt.datetime(2024, 1, 1, 20)})
    assert got(late) == [(0, o) for o in range(50) if o % 24 >= 20]
    row = open_log(spark, False, path=root, parts=[1]).where("off = 5").first()
    assert (row.event_identifier, row.value, row.date_published) == (1005, 5.0, dt.datetime(2024, 1, 1, 5))


def test_stop_in_mid_file_grow_and_resume(spark, root):
    state, ckpt = scratch_dir(spark, "log-state"), scratch_dir(spark, "log-ckpt")
    seen = []

    def run(**bounds):
        stream = open_log(spark, path=root, offsets={0: 9}, **bounds)
        before = len(seen)
        q = stream.writeStream.foreachBatch(lambda b, _: seen.extend((r.part, r.off) for r in b.collect())) \
            .option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(seen[before:])

    assert run(until={0: 20, 1: 3}) == [(0, o) for o in range(10, 21)] + [(1, o) for o in range(4)]
    write(root, 1, "x.json", range(30, 33), "a")          # a file that has grown
    write(root, 2, "new.json", range(5))                   # a part that was not there
    assert run() == [(0, o) for o in range(21, 50)] + [(1, o) for o in range(4, 33)] + [(2, o) for o in range(5)]
    assert run() == []
    folded = N.fold_stream(spark, open_log(spark, path=root), state, scratch_dir(spark, "log-ckpt2"))
    assert folded.count() == 7


def test_long_records_and_ends_of_files(spark):
    root = scratch_dir(spark, "long-log")
    folder = f"{local_path(root)}/part=3"
    os.makedirs(folder)
    with open(f"{folder}/f.json", "w") as f:
        for o in (4, 5):
            f.write(json.dumps({"off": o, "props": "x" * 200_000}) + "\n")
    assert _Log({"path": root}).end() == {"3": 5} and _Log({"path": root}).start() == {"3": -1}
    assert [len(r.props) for r in open_log(spark, False, path=root).collect()] == [200_000] * 2
