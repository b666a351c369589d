"""Copies are compared by content, archives keep what is sound, prefix sums do not depend on key density."""

import io
import json
import tarfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from canopy.operators import embed as E
from canopy.operators import lookup as L
from canopy.operators import windows as W
from canopy.sources import archives as R
from canopy.sources import export as X
from canopy.sources.scratch import local_path, scratch_dir


def test_one_changed_value_fails_the_comparison(spark):
    rows = [("a", i, f"t{i}", "u") for i in range(50)] + [("b", i, f"t{i}", "u") for i in range(20)] + [(None, 1, "n", "u")]
    df = spark.createDataFrame(rows, "namespace string, page_id long, title string, url string")
    copy = X.slim_copy(spark, {"page_log": df}, scratch_dir(spark, "copy"))["page_log"]

    def ok(other, **more):
        return {r["namespace"]: r["ok"] for r in X.reconcile({"page_log": df}, {"page_log": other}, by_namespace=True).collect()}

    assert set(ok(copy.repartition(5)).values()) == {True}
    changed = copy.withColumn("title", F.when((F.col("page_id") == 7) & (F.col("namespace") == "a"), "x").otherwise(F.col("title")))
    assert ok(changed) == {"a": False, "b": True, None: True}
    swapped = copy.withColumn("title", F.when(F.col("namespace") == "b", F.concat(F.lit("t"), (F.col("page_id") + 1) % 20))
                              .otherwise(F.col("title")))
    assert ok(swapped) == {"a": True, "b": False, None: True}
    assert ok(copy.where("namespace = 'a'")) == {"a": True, "b": False, None: False}
    assert [tuple(r) for r in X.reconcile({"page_log": df}, {}).collect()] == [("page_log", 71, 0, False, False)]
    wide, slim = scratch_dir(spark, "wide"), scratch_dir(spark, "slim")
    df.withColumn("more", F.sha2("title", 512)).write.parquet(wide)
    df.select("page_id").write.parquet(slim)
    assert 0 < X.size_report(spark, wide, slim).first().reduction < 1


def _archive(root, ns, chunk, members):
    import os
    folder = f"{local_path(root)}/{ns}"
    os.makedirs(folder, exist_ok=True)
    with tarfile.open(f"{folder}/{chunk}.tar.gz", "w:gz") as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def test_archives(spark):
    root = scratch_dir(spark, "archives")

    def line(i, **more):
        return json.dumps({"identifier": i, "name": f"n{i}", "abstract": "é\n" * 3, **more}).encode()

    body = b"\n".join([line(1), b"", line(2, extra={"x": [1]}), b"{broken", line(3), b'{"identifier": "text"}', b'{"id": 9}', b'{"name": "none"}'])
    _archive(root, "ns", "c1", [("a.ndjson", body), ("b.ndjson", line(50))])
    _archive(root, "ns", "empty", [("a.ndjson", b"")])
    R.damaged(f"{root}/ns/cut.tar.gz")
    good, bad = R.read_archives(spark, root)
    assert sorted((r.page_id, r.title, r.abstract) for r in good.collect()) == \
        [(1, "n1", "é\n" * 3), (2, "n2", "é\n" * 3), (3, "n3", "é\n" * 3), (9, None, None)]
    assert sorted((r.chunk_name, r.error, r.line) for r in bad.collect()) == [
        ("c1", "line is no record", '{"identifier": "text"}'), ("c1", "line is no record", "{broken"),
        ("c1", "record without an id", None), ("cut", "damaged archive", None)] or \
        sorted((r.chunk_name, r.error) for r in bad.collect()) == [
        ("c1", "line is no record"), ("c1", "line is no record"), ("c1", "record without an id"), ("cut", "damaged archive")]
    assert {r.archive.rsplit("/", 1)[1] for r in bad.collect()} == {"c1.tar.gz", "cut.tar.gz"}
    assert R.read_archives(spark, root, all_members=True)[0].count() == 5


def test_blocks_hold_whole_lines():
    data = b"\n".join(b"x" * (i * 997 % 5000) for i in range(4000))
    got = list(R._blocks(io.BytesIO(data)))
    assert b"".join(got) == data and len(got) > 1 and all(b.endswith(b"\n") for b in got[:-1])


@pytest.mark.parametrize("step", [1, 10**12, -3])
def test_prefix_sums_over_sparse_and_dense_keys(spark, step):
    rows = [("a", i * step, i % 5) for i in range(3000)] + [("b", 7, 4)] + [("c", i * step, None) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(7)
    splits = W.range_splits(df, "k", 100)
    assert 20 < len(splits) < 40
    for inclusive in (False, True):
        got = {(r.g, r.k): r.s for r in W.grouped_prefix_sum(df, ["g"], "k", "v", "s", inclusive, rows_each=100).collect()}
        run = {}
        for g, k, v in sorted(rows, key=lambda r: (r[0], r[1])):
            before = run.get(g, 0)
            run[g] = before + (v or 0)
            assert got[g, k] == (run[g] if inclusive else before)


def test_texts_that_are_too_large_are_halved(spark):
    def model(texts):
        if any(len(t) > 10 for t in texts):
            raise RuntimeError("the input is too large to process (10)")
        if any("bad" in t for t in texts):
            raise RuntimeError("x" * 500)
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "a" * 45), (2, "short"), (3, "bad"), (4, ""), (5, None)], "page_id long, text string").coalesce(1)
    got = {r.page_id: r for r in E.embed_pages(df, model, 2).collect()}
    assert got[1].embedding == [5.0, 1.0] and got[2].embedding == [5.0, 1.0] and got[1].error is None
    assert got[3].embedding is None and got[3].error == "x" * 500
    assert got[4].error == got[5].error == "empty input text"
    with pytest.raises(ValueError):
        E.embed_halving("a" * 40, lambda t: (_ for _ in ()).throw(RuntimeError("input is too large to process")), E.says_too_large)
    assert pd.Series(E.embed_halving("a" * 21, model, E.says_too_large)).tolist() == [10.0, 1.0]


def test_suggestions_for_prefixes_beyond_ascii(spark):
    pl = spark.createDataFrame([("École normale",), ("école b",), ("Ecole",), ("ÉCOLE",), ("THE é",), ("the É",)], "title string")
    assert [r.title for r in L.title_suggestions(pl, "Éc").collect()] == ["École normale", "ÉCOLE"]
    assert [r.title for r in L.title_suggestions(pl, "éC").collect()] == ["école b"]
    assert [r.title for r in L.title_suggestions(pl, "tHe").collect()] == ["THE é", "the É"]
