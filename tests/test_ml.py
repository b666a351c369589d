"""Invariants of the iterative / numeric operators (no SQL twin), checked against numpy."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy import fixtures as fx
from canopy.operators import cluster as C
from canopy.operators import pca as P
from canopy.operators import projection as Pr
from canopy.operators import vectors as Vx
from canopy.plans import q_ml
from tests.conftest import MEDIUM

PARAMS = dataclasses.replace(q_ml.PARAMS)


@pytest.fixture(scope="module")
def emb(spark):
    df = fx.emb_page(spark, MEDIUM).select("namespace", "page_id", "embedding", "label").cache()
    x = np.array([r.embedding for r in df.orderBy("page_id").collect()], dtype=np.float64)
    return df, x


@pytest.fixture(scope="module")
def reduced(spark, emb):
    df, _ = emb
    return P.reduce_namespace(df, 16, "embedding", "reduced").cache()


def test_pca_matches_numpy(spark, emb, reduced):
    _, x = emb
    got = np.array([r.reduced for r in reduced.orderBy("page_id").collect()], dtype=np.float64)
    xc = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(xc, full_matrices=False)
    comps = P.flip_signs(vt[:16])
    want = xc @ comps.T
    assert np.allclose(got, want, atol=1e-4)
    assert np.allclose(got.mean(axis=0), 0, atol=1e-5)          # centred
    assert np.allclose(comps @ comps.T, np.eye(16), atol=1e-8)  # orthonormal


def test_pca_guard(spark, emb):
    df, _ = emb
    with pytest.raises(ValueError):
        P.reduce_namespace(df, 65, "embedding", "reduced")


def test_silhouette_closed_form_equals_brute_force(spark, emb):
    df, x = emb
    labels = np.array([r.label for r in df.orderBy("page_id").collect()])
    pts = df.select("namespace", "page_id", "label", F.col("embedding").alias("vec"))
    got = Vx.silhouette_points(pts, ["namespace"], "label", "vec").orderBy("page_id")
    s = np.array([r.silhouette for r in got.collect()])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    want = []
    for i in range(len(x)):
        same = labels == labels[i]
        a = d[i, same & (np.arange(len(x)) != i)].mean()
        b = min(d[i, labels == k].mean() for k in np.unique(labels) if k != labels[i])
        want.append((b - a) / max(a, b))
    assert np.allclose(s, want, atol=1e-9)
    assert abs(C.silhouette_np(x, labels) - np.mean(want)) < 1e-9


def _check_tree(nodes, asg, n_pages, params):
    nd = {r.node_id: r for r in nodes.collect()}
    a = asg.collect()
    assert len(a) == n_pages and len({r.page_id for r in a}) == n_pages           # each page once
    leaves = {k for k, r in nd.items() if r.child_count == 0}
    assert {r.cluster_node_id for r in a} <= leaves                                # only leaves own pages
    roots = [k for k, r in nd.items() if r.parent_id is None]
    assert roots == [1]                                                             # root id 1
    for k, r in nd.items():
        if r.parent_id is not None:
            assert nd[r.parent_id].depth + 1 == r.depth
            assert r.parent_id < k                                                  # pre-order: parent first
    kids = {}
    for k, r in nd.items():
        kids.setdefault(r.parent_id, []).append(k)
    for k, r in nd.items():
        assert r.child_count == len(kids.get(k, []))
        if r.child_count:
            assert r.doc_count == sum(nd[c].doc_count for c in kids[k])            # roll-up
            assert r.child_count <= params.max_k
        else:
            assert r.doc_count <= params.leaf_target or r.depth == params.max_depth or r.silhouette is not None
    # pre-order: ids are a DFS numbering 1..n
    order = []

    def dfs(n):
        order.append(n)
        for c in sorted(kids.get(n, [])):
            dfs(c)
    dfs(1)
    assert order == sorted(nd)


def test_cluster_tree_invariants_and_determinism(spark, reduced):
    n = reduced.count()
    nodes, asg = C.build_tree(reduced, PARAMS)
    nodes, asg = nodes.cache(), asg.cache()
    _check_tree(nodes, asg, n, PARAMS)
    nodes2, asg2 = C.build_tree(reduced, PARAMS)
    assert sorted(map(tuple, asg.collect())) == sorted(map(tuple, asg2.collect()))


def _as_rows(built):
    nodes, asg = built
    return (sorted(map(repr, nodes.select("namespace", "node_id", "parent_id", "doc_count",
                                          F.round("silhouette", 9), "centroid").collect())),
            sorted(map(tuple, asg.collect())))


def test_tree_does_not_depend_on_where_it_is_computed(spark, reduced, monkeypatch):
    """One task per node, Spark jobs with centres on the driver, Spark joins, and other partitionings: one tree."""
    p = dataclasses.replace(PARAMS, max_iter=6, max_depth=3)
    local = _as_rows(C.build_tree(reduced, dataclasses.replace(p, local_cap=10**6)))
    spread = dataclasses.replace(p, local_cap=0, max_depth=2)
    jobs = _as_rows(C.build_tree(reduced.repartition(5), spread))
    assert jobs == _as_rows(C.build_tree(reduced, dataclasses.replace(spread, local_cap=10**6)))
    assert local == _as_rows(C.build_tree(reduced.repartition(3), p))
    monkeypatch.setattr(Vx, "BROADCAST_BUDGET_BYTES", 0)
    one = dataclasses.replace(spread, max_depth=1, max_iter=3)
    joins = _as_rows(C.build_tree(reduced, one))
    monkeypatch.undo()
    assert joins == _as_rows(C.build_tree(reduced, dataclasses.replace(one, local_cap=10**6)))


def test_a_level_takes_few_jobs(spark):
    """A seeding round or Lloyd step of a level is one job, whatever the number of its nodes."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(f"ns{i % 3}", i, rng.normal(size=5).tolist()) for i in range(900)],
                               "namespace string, page_id bigint, reduced array<double>")
    p = dataclasses.replace(PARAMS, max_depth=1, local_cap=0, max_iter=10, tol=0.0)
    spark.sparkContext.setJobGroup("tree-jobs", "")
    C.build_tree(df, p)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("tree-jobs"))
    spark.sparkContext.setJobGroup("after", "")
    assert jobs < 2 * p.rounds + 2 * p.max_iter + 40


def test_nodes_below_the_root_split_in_one_pass(spark, monkeypatch):
    """Levels of jobs are taken by namespaces and by parts of them that are too large for a task, and by no other."""
    taken = []
    split = C.split_blocks
    monkeypatch.setattr(C, "split_blocks", lambda pts, nodes, *a: taken.append([r.n for r in nodes]) or split(pts, nodes, *a))
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([("ns", i, rng.normal(size=3).tolist()) for i in range(900)],
                               "namespace string, page_id bigint, reduced array<double>")
    p = C.ClusterParams(leaf_target=10, max_k=3, min_silhouette=-1.0, max_iter=5)
    whole = _as_rows(C.build_tree(df, p))
    assert taken == [[900]]
    monkeypatch.setattr(C, "PART_PAGES", 200)
    assert whole == _as_rows(C.build_tree(df, p))
    assert len(taken) > 2 and all(n > 200 for ns in taken[2:] for n in ns)


def test_pages_without_an_id_and_repeated_ids_keep_their_rows(spark):
    rng = np.random.default_rng(9)
    vecs = [rng.normal(size=3).tolist() for _ in range(300)]
    rows = [("ns", None if i % 50 == 7 else i, v) for i, v in enumerate(vecs)] + [("ns", 5, vecs[5])] * 2
    df = spark.createDataFrame(rows, "namespace string, page_id bigint, reduced array<double>")
    nodes, asg = C.build_tree(df, dataclasses.replace(PARAMS, max_depth=1, local_cap=0, max_iter=4))
    got = [r.page_id for r in asg.collect()]
    assert len(got) == 302 and got.count(None) == 6 and got.count(5) == 3
    assert nodes.where("parent_id IS NULL").first().doc_count == 302


@pytest.mark.parametrize("cap", [0, 10**6])
def test_copies_leave_no_cluster_empty(spark, cap):
    """A third of the pages are copies of one vector; every cluster still gets pages."""
    rng = np.random.default_rng(4)
    x = np.vstack([np.repeat(rng.normal(size=(1, 6)), 100, 0), rng.normal(size=(200, 6))])
    df = spark.createDataFrame([("ns", i, v.tolist()) for i, v in enumerate(x)],
                               "namespace string, page_id bigint, reduced array<double>")
    p = dataclasses.replace(PARAMS, max_depth=1, local_cap=cap, max_iter=4)
    nodes, asg = C.build_tree(df, p)
    root = nodes.where("parent_id IS NULL").first()
    assert root.child_count == min(p.max_k, -(-300 // p.leaf_target))
    same = [("ns", i, [1.0, 2.0]) for i in range(60)] + [("ns", 60 + i, [3.0, float(i % 2)]) for i in range(60)]
    few = C.build_tree(spark.createDataFrame(same, "namespace string, page_id bigint, reduced array<double>"), p)[0]
    assert few.where("parent_id IS NULL").first().child_count == 3   # as many clusters as distinct vectors


def test_seeds_spread_over_all_pages():
    """A far group of a hundredth of the pages gets a seed, which the first pages in an order would miss."""
    rng = np.random.default_rng(1)
    x = np.rint(rng.normal(size=(3000, 4)) * 1000)
    x[17::100] += 500_000
    hits = 0
    for turn in range(5):
        h = rng.integers(-2**62, 2**62, 3000)
        hits += (C._seeds_np(x, h, np.arange(3000), 5, C.ClusterParams())[:, 0] > 250_000).any()
    assert hits == 5


def test_page_projection_small_and_large_paths_agree(spark, reduced):
    asg = reduced.select("namespace", "page_id", F.lit(7).cast("bigint").alias("cluster_node_id"), "reduced")
    small = {r.page_id: np.array(r.three_d) for r in Pr.page_projection(asg, "reduced").collect()}
    big = P.project_groups(asg.withColumnRenamed("cluster_node_id", "node_id"), ["namespace", "node_id"],
                           "page_id", "reduced", 3, small_cap=0)
    large = {r.page_id: np.array(r.three_d) for r in big.collect()}
    assert small.keys() == large.keys()
    for k in small:
        assert np.allclose(small[k], large[k], atol=1e-6)


def test_centroid_projection_lengths(spark):
    t = fx.emb_flat(spark, MEDIUM)
    cents = Vx.group_mean(fx.emb_page(spark, MEDIUM).select(
        "namespace", (F.lit(2) + F.col("label")).cast("bigint").alias("node_id"), F.col("embedding").alias("vec")),
        ["namespace", "node_id"], "vec")
    t = t.join(cents.select("namespace", "node_id", "centroid"), ["namespace", "node_id"], "left")
    out = {r.node_id: np.array([r.x, r.y, r.z]) for r in Pr.centroid_projection(t).collect()}
    assert np.allclose(out[1], 0)
    for k, v in out.items():
        if k != 1:
            assert np.isfinite(v).all() and np.linalg.norm(v) >= 1 - 1e-9


def test_embedding_hooks(spark):
    from canopy.operators import embed as E
    texts = spark.createDataFrame([("ns", 1, "alpha beta"), ("ns", 2, ""), ("ns", 3, "gamma")],
                                  "namespace string, page_id bigint, text string")

    def model(s):
        if (s == "").any():
            raise ValueError("empty input")
        return [[float(len(t)), 1.0] for t in s]

    out = {r.page_id: r for r in E.embed_pages(texts, model, 2).collect()}
    assert out[1].embedding == [10.0, 1.0] and out[1].error is None
    assert out[2].embedding is None and "empty" in out[2].error      # one failure does not sink the batch
    hv = E.hashing_embed(texts.where("page_id <> 2"), 16).collect()
    for r in hv:
        assert abs(np.linalg.norm(r.embedding) - 1.0) < 1e-6


def test_strict_page_records(spark):
    from canopy.sources import pages as SP
    from canopy.sources.scratch import scratch_dir
    root = scratch_dir(spark, "strict")
    spark.createDataFrame([(None, None, "x", "u", "a")], SP.PAGE_RECORD).write.json(root)
    good, bad = SP.read_page_records(spark, root, namespace="ns")
    assert good.count() == 0 and bad.count() == 1
    with pytest.raises(ValueError):
        SP.read_page_records(spark, root, namespace="ns", strict=True)


def test_assignment_paths_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pts = spark.createDataFrame(
        [("ns", [0, 1][i % 2:i % 2 + 1], int(i), rng.normal(size=4).tolist()) for i in range(200)],
        "namespace string, path array<int>, page_id bigint, x array<double>")
    cents = spark.createDataFrame(
        [("ns", [p], c, rng.normal(size=4).tolist()) for p in (0, 1) for c in range(3)],
        "namespace string, path array<int>, cid int, vec array<double>")
    blas = {r.page_id: r.cid for r in C._assign(pts, cents, 4).collect()}
    monkeypatch.setattr(Vx, "BROADCAST_BUDGET_BYTES", 0)
    jvm = {r.page_id: r.cid for r in C._assign(pts, cents, 4).collect()}
    assert blas == jvm and len(blas) == 200


def test_namespace_trees_are_separate(spark):
    from canopy.plans.q_ml import namespace_trees
    rows = namespace_trees(spark, MEDIUM).collect()
    pv = fx.page_vector(spark, MEDIUM).where(F.col("embedding").isNotNull()).groupBy("namespace").count().collect()
    sizes = {r["namespace"]: r["count"] for r in pv}
    by_ns = {}
    for r in rows:
        by_ns.setdefault(r.namespace, []).append(r)
    for ns, nodes in by_ns.items():
        root = [r for r in nodes if r.parent_id is None]
        assert len(root) == 1 and root[0].node_id == 1 and root[0].doc_count == sizes[ns]
    # namespaces with fewer vectors than max_k get no tree
    assert set(by_ns) == {ns for ns, n in sizes.items() if n >= PARAMS.max_k}
