"""Deep trees, cycles, tokens of every supported script, and checks that must fail."""

import pytest
from pyspark.sql import functions as F

from canopy.functions import text
from canopy.operators import pca, tree
from canopy.streaming import articles
from tests.oracle import _norm

TITLES = ["한국어 위키백과", "ガイド ブック", "สุขภาพ ดี", "مُحَمَّد علي", "École de l'été", "école", "Ñandú", "Ελλάδα Άλφα",
          "Ёлка мир", "中文 维基", "हिन्दी विकि", "Straße", "tiếng Việt", "ab", "İstanbul Çay"]


def test_index_and_query_tokens_agree(spark):
    rows = spark.createDataFrame([(t,) for t in TITLES], "t string").select("t", text.tokens("t").alias("k")).collect()
    assert len(rows) == len(TITLES)
    for r in rows:
        assert r.k == text.py_tokens(r.t) and len(r.k) >= len(r.t.split()) > 0, r.t


def _chain(spark, n):
    rows = [("n", k, k - 1 if k else None, k) for k in range(n)]
    return spark.createDataFrame(rows, "namespace string, node_id long, parent_id long, depth int")


def test_deep_chain_keeps_every_node(spark):
    nodes = _chain(spark, 80)
    assert tree.closure(nodes).count() == 80 * 81 // 2
    assert [r.distance for r in tree.ancestors(nodes, "n", 79).collect()] == list(range(1, 80))


def test_cycle_is_an_error(spark):
    rows = [("n", 1, 3, 1), ("n", 2, 1, 1), ("n", 3, 2, 1)]
    nodes = spark.createDataFrame(rows, "namespace string, node_id long, parent_id long, depth int")
    with pytest.raises(ValueError):
        tree.ancestors(nodes, "n", 1)


def test_narrow_vectors_project_alike_at_any_cap(spark):
    rows = [("n", 1, k, [float(k), k / 2]) for k in range(12)] + [("n", 2, 50 + k, [1.0, 2.0, 3.0, float(k)]) for k in range(2)]
    df = spark.createDataFrame(rows, "namespace string, node_id long, page_id long, v array<double>")
    keys = ["namespace", "node_id"]
    small, large = (sorted((r.page_id, tuple(r.three_d)) for r in pca.project_groups(
        df, keys, "page_id", "v", 3, small_cap=cap).collect()) for cap in (100, 0))
    assert small == large and small[3] == (3, (3.0, 1.5, 0.0)) and small[-1] == (51, (1.0, 2.0, 3.0))


def test_comparison_sees_the_sign_of_zero():
    assert _norm([0.0, 1.0]) != _norm([-0.0, 1.0])


def test_damaged_delta_fails_the_read(spark, tmp_path):
    assert articles.read_state(spark, f"file://{tmp_path}").count() == 0
    folder = tmp_path / "delta" / "batch=0"
    folder.mkdir(parents=True)
    (folder / "part-0.parquet").write_bytes(b"not parquet at all")
    with pytest.raises(Exception):
        articles.read_state(spark, f"file://{tmp_path}").select(F.count("*")).collect()
