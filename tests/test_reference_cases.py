"""The reference's own unit cases, re-expressed on DataFrames."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.functions import lang
from canopy.operators import lookup as L
from canopy.operators import search as S
from canopy.operators import tree as T
from canopy.operators import vectors as Vx
from canopy.operators import topics as Tp
from canopy.sources.dims import LanguageFileError, load_languages_csv
from canopy.sources.scratch import local_path, scratch_dir
from canopy.streaming import articles as N

NS = "test_namespace"
TREE_SCHEMA = "namespace string, node_id bigint, parent_id bigint, depth int, doc_count bigint, child_count int, " \
              "final_label string"


def tree3(spark, extra=()):
    rows = [(NS, 1, None, 0, 100, 2, "Root"), (NS, 2, 1, 1, 50, 0, "Child 1"), (NS, 3, 1, 1, 30, 0, "Child 2")]
    return spark.createDataFrame(rows + list(extra), TREE_SCHEMA)


def ids(df, col="node_id"):
    return [r[col] for r in df.collect()]


def test_children_siblings_parent_root(spark):
    t = tree3(spark)
    assert ids(L.children(t, NS, 1)) == [2, 3]
    assert ids(L.siblings(t, NS, 2)) == [3]
    assert L.parent_of(t, NS, 1).count() == 0
    assert ids(L.root_node(t)) == [1]
    assert T.ancestors(t, NS, 1).count() == 0


def test_ancestors_and_more_siblings(spark):
    t = tree3(spark, [(NS, 5, 2, 2, 1, 0, "Grandchild"), (NS, 4, 1, 1, 1, 0, "Child 3")])
    assert ids(T.ancestors(t, NS, 5)) == [2, 1]
    assert sorted(ids(L.siblings(t, NS, 2))) == [3, 4]


def test_pages_in_cluster(spark):
    pl = spark.createDataFrame([(NS, 1, "Page 1", "a1", "u1"), (NS, 2, "Page 2", "a2", "u2"),
                                (NS, 3, "Page 3", "a3", "u3")],
                               "namespace string, page_id bigint, title string, abstract string, url string")
    pv = spark.createDataFrame([(NS, 1, 2), (NS, 2, 2), (NS, 3, 3)],
                               "namespace string, page_id bigint, cluster_node_id bigint")
    assert L.pages_in_cluster(pl, pv, NS, 2).count() == 2
    assert L.pages_in_cluster(pl, pv, NS, 2, limit=1).count() == 1
    assert L.pages_in_cluster(pl, pv, NS, 99).count() == 0


def test_query_text_rules():
    q = S.parse_query("quantum mech", "de")
    assert [p.tokens for p in q.parts] == [["quantum"], ["mech"]] and q.parts[-1].prefix
    q = S.parse_query("quantum mech", "en")
    assert not q.parts[-1].prefix
    q = S.parse_query('"quantum mechanics"', "de")
    assert len(q.parts) == 1 and q.parts[0].tokens == ["quantum", "mechanics"] and not q.parts[0].prefix
    assert S.parse_query("!!!", "en") is None
    with pytest.raises(ValueError):
        S.parse_query("x" * 101, "en")


def _search4(spark):
    tree = spark.createDataFrame(
        [(NS, 1, None, 0, "Science"), (NS, 2, 1, 1, "Physics"), (NS, 3, 1, 1, "Chemistry"), (NS, 4, None, 0, "Arts")],
        "namespace string, node_id bigint, parent_id bigint, depth int, final_label string")
    pages = spark.createDataFrame([(NS, 1, "Quantum Mechanics", 2), (NS, 2, "Classical Physics", 2),
                                   (NS, 3, "Organic Chemistry", 3)],
                                  "namespace string, page_id bigint, title string, cluster_node_id bigint")
    return S.build_index(tree, pages, pages)


def _bm25_brute(docs, query_terms, prefix_last):
    """Brute force on the concatenated documents (label, titles)."""
    n = len(docs)
    lens = {k: len(v) for k, v in docs.items()}
    avg = sum(lens.values()) / n

    def hits(toks, t, pre):
        return sum(1 for x in toks if (x.startswith(t) if pre else x == t))
    scores = {}
    for k, toks in docs.items():
        fs = [hits(toks, t, prefix_last and i == len(query_terms) - 1) for i, t in enumerate(query_terms)]
        if all(f > 0 for f in fs):
            s = 0.0
            for i, t in enumerate(query_terms):
                ni = sum(1 for v in docs.values() if hits(v, t, prefix_last and i == len(query_terms) - 1) > 0)
                idf = np.log((n - ni + 0.5) / (ni + 0.5))
                idf = idf if idf > 0 else 1e-6
                s += idf * fs[i] * 2.2 / (fs[i] + 1.2 * (1 - 0.75 + 0.75 * lens[k] / avg))
            scores[k] = round(-s, 6)
    return scores


def test_bm25_against_brute_force(spark):
    idx = _search4(spark)
    docs = {1: ["science"], 2: ["physics", "quantum", "mechanics", "classical", "physics"],
            3: ["chemistry", "organic", "chemistry"], 4: ["arts"]}
    for text, code in [("physics", "en"), ("chem", "de"), ("quantum mech", "fr")]:
        q = S.parse_query(text, code)
        got = {r.node_id: r.score for r in S.search(idx, q, NS, 50).collect()}
        terms = [p.tokens[0] for p in q.parts]
        assert got == _bm25_brute(docs, terms, q.parts[-1].prefix)


def test_phrase_across_titles(spark):
    idx = _search4(spark)
    # 'mechanics classical' spans the boundary between two titles of node 2
    got = S.search(idx, S.parse_query('"mechanics classical"', "en"), NS).collect()
    assert [r.node_id for r in got] == [2]
    assert S.search(idx, S.parse_query('"classical mechanics"', "en"), NS).count() == 0


def test_missing_centroid_error_and_values(spark):
    rng = np.random.default_rng(0)
    tree = spark.createDataFrame(
        [(NS, 1, None, 0, [0.0]), (NS, 2, 1, 1, None), (NS, 3, 1, 1, None), (NS, 4, 1, 1, [0.0]),
         (NS, 5, 4, 2, None)], "namespace string, node_id bigint, parent_id bigint, depth int, centroid array<double>")
    vecs = {2: rng.normal(size=(5, 100)), 3: rng.normal(size=(3, 100)), 5: rng.normal(size=(2, 100))}
    pages = spark.createDataFrame([(NS, int(n), v.tolist()) for n, m in vecs.items() for v in m],
                                  "namespace string, node_id bigint, vec array<double>")
    out = {r.node_id: np.array(r.centroid) for r in Vx.missing_leaf_centroids(tree, pages, "vec").collect()}
    assert sorted(out) == [2, 3, 5]
    for n, m in vecs.items():
        assert np.allclose(out[n], m.mean(axis=0))
    bad = tree.withColumn("centroid", F.when(F.col("node_id") == 4, F.lit(None)).otherwise(F.col("centroid")))
    with pytest.raises(Vx.AssumptionViolated):
        Vx.missing_leaf_centroids(bad, pages, "vec")


def test_languages_lookup_and_csv_rules(spark):
    langs = {r.namespace: r for r in lang.languages(spark).collect()}
    assert len(langs) == 14
    assert langs["dewiki_namespace_0"].code == "de"
    assert langs["arzwiki_namespace_0"].english_name == "Egyptian Arabic Wikipedia"
    root = scratch_dir(spark, "lang-test")
    import os
    os.makedirs(local_path(root), exist_ok=True)
    with open(local_path(root) + "/l.csv", "w") as fh:
        fh.write("Language,ISO 639-1 Code,Namespace,English Name,Local Name\n"
                 " German , de ,dewiki_namespace_0,German Wikipedia,Deutsch 1\n"
                 "Broken,,xxwiki_namespace_0,X,Y\n"
                 "German,de,dewiki_namespace_0,German Wikipedia,Deutsch 2\n")
    out = load_languages_csv(spark, root).collect()
    assert [(r.language, r.code, r.local_name) for r in out] == [("German", "de", "Deutsch 2")]
    root2 = scratch_dir(spark, "lang-bad")
    os.makedirs(local_path(root2), exist_ok=True)
    with open(local_path(root2) + "/l.csv", "w") as fh:
        fh.write("Language,Namespace\nGerman,dewiki_namespace_0\n")
    with pytest.raises(LanguageFileError):
        load_languages_csv(spark, root2)


def test_node_validation(spark):
    recs = spark.createDataFrame(
        [(1, 1, [0.1, 0.2, 0.3]), (2, 2, [0.0, 0.0, 0.0]), (3, 3, [1e30, 1e30, 1e30]), (4, None, [0.1, 0.2, 0.3]),
         (5, 5, None), (6, 6, [0.1, 0.2]), (7, 7, [float("nan"), 0.0, 0.0]), (8, 8, [float("inf"), 0.0, 0.0])],
        "rec_id int, node_id bigint, centroid array<double>")
    got = {r.rec_id: (r.valid, r.reason) for r in L.node_validity(recs, 3).collect()}
    assert got[1] == (True, "ok") and got[2] == (True, "ok") and got[3] == (True, "ok")
    assert got[4] == (False, "missing id") and got[5] == (True, "centroid missing")
    assert got[6] == (False, "wrong length") and got[7][0] is False and got[8][0] is False


def test_system_text_language(spark):
    ns = spark.createDataFrame([("dewiki_namespace_0",), ("enwiki_namespace_0",), ("arzwiki_namespace_0",)],
                               "namespace string")
    got = {r.namespace: r.system for r in Tp.system_texts(ns, lang.languages(spark)).collect()}
    assert got["dewiki_namespace_0"].endswith("Generated output should only be in German.")
    assert got["arzwiki_namespace_0"].endswith("Generated output should only be in Egyptian Arabic.")


def test_resume_bounds(spark):
    ev = spark.createDataFrame([(1, 1, 5, dt.datetime(2024, 1, 1)), (2, 1, 15, dt.datetime(2024, 1, 2)),
                                (3, 2, 25, dt.datetime(2024, 1, 1)), (4, 3, 1, dt.datetime(2024, 1, 1))],
                               "event_identifier long, part int, off long, date_published timestamp_ntz")
    b = N.since_bounds(spark, {1: 10, 2: 20}, {2: dt.datetime(2024, 1, 2)})
    assert sorted(ids(N.resume_filter(ev, b), "event_identifier")) == [2, 4]


def test_search_bounds_and_empty_queries(spark):
    idx = _search4(spark)
    assert S.search_text(idx, "!!!", NS, "en").count() == 0          # no tokens -> empty result
    assert S.search_text(idx, "x" * 101, NS, "en").count() == 0     # out of bounds -> empty result
    assert S.search_text(idx, "physics", NS, "en", limit=1).count() == 1
    with pytest.raises(ValueError):
        S.search(idx, S.parse_query("physics", "en"), NS, limit=101)
    got = S.search(idx, S.parse_query("chemistry", "en"), NS, detect_match_type=True).collect()
    assert [(r.node_id, r.match_type) for r in got] == [(3, "node_label")]
    got = S.search(idx, S.parse_query("organic", "en"), NS, detect_match_type=True).collect()
    assert [(r.node_id, r.match_type) for r in got] == [(3, "page_titles")]


def test_centroid200(spark):
    """Root plus 200 leaves with 3 pages each: 200 centroids, none missing."""
    rng = np.random.default_rng(1)
    nodes = [(NS, 1, None, 0, [0.0])] + [(NS, 2 + i, 1, 1, None) for i in range(200)]
    tree = spark.createDataFrame(nodes, "namespace string, node_id bigint, parent_id bigint, depth int, "
                                        "centroid array<double>")
    pages = spark.createDataFrame([(NS, 2 + i, rng.normal(size=100).tolist()) for i in range(200) for _ in range(3)],
                                  "namespace string, node_id bigint, vec array<double>")
    out = Vx.missing_leaf_centroids(tree, pages, "vec").collect()
    assert len(out) == 200 and all(r.centroid is not None and r.n == 3 for r in out)


def test_projection_sizes(spark):
    """Nodes of 3, 5, 10, 20 and 50 pages: all 88 pages get three coordinates."""
    from canopy.operators import projection as Pr
    rng = np.random.default_rng(2)
    rows, pid = [], 0
    for node, size in enumerate([3, 5, 10, 20, 50]):
        for _ in range(size):
            rows.append((NS, pid, node, rng.normal(size=100).tolist()))
            pid += 1
    pv = spark.createDataFrame(rows, "namespace string, page_id bigint, cluster_node_id bigint, reduced array<double>")
    out = Pr.page_projection(pv, "reduced").collect()
    assert len(out) == 88 and all(len(r.three_d) == 3 and np.isfinite(r.three_d).all() for r in out)


def test_pca150(spark):
    """150 x 2048 float32 vectors reduced to 100 dimensions: 150 reduced rows of width 100."""
    from canopy.operators import pca as P
    rng = np.random.default_rng(4)
    pv = spark.createDataFrame([(NS, i, rng.normal(size=2048).astype(np.float32).tolist()) for i in range(150)],
                               "namespace string, page_id bigint, embedding array<float>")
    out = P.reduce_namespace(pv, 100).collect()
    assert len(out) == 150 and all(len(r.reduced) == 100 for r in out)


def test_label_passes_bottom_up(spark):
    """Four passes over the geo tree: every node labelled, root named after its namespace,
    inner nodes only after their children."""
    from canopy import fixtures as fx
    from tests.conftest import SMALL
    tree = fx.geo_tree(spark, SMALL).select(
        "namespace", "node_id", "parent_id", "depth", F.lit(None).cast("string").alias("first_label"),
        F.lit(None).cast("string").alias("final_label"))
    pages = fx.geo_page(spark, SMALL).select(
        "namespace", F.col("cluster_node_id").alias("node_id"), "page_id", "title",
        F.lit(None).cast("string").alias("abstract"))
    out = {r.node_id: r for r in Tp.run_passes(tree, pages, lang.languages(spark)).collect()}
    assert out[1].first_label == out[1].final_label == "geo"           # unknown namespace -> its own name
    leaves_with_pages = {r.cluster_node_id for r in fx.geo_page(spark, SMALL).select("cluster_node_id").collect()}
    for n in leaves_with_pages:
        assert out[n].first_label and out[n].final_label
    nations = [r for r in out.values() if r.depth == 2]
    assert all(r.first_label for r in nations)
