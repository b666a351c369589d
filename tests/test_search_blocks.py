"""The search index: spread of frequent terms, blocks that are skipped, segments that follow changes."""

import random

import pytest
from pyspark.sql import functions as F

from canopy.operators import search as S
from canopy.operators import segments as G
from canopy.sources.scratch import scratch_dir

NS = "ns"
RARE = ["red", "green", "blue", "plain"]


def tables(spark, nodes, seed=3):
    rng = random.Random(seed)
    tree, pages = [], []
    for n in range(1, nodes + 1):
        tree.append((NS, n, None if n == 1 else 1, 0 if n == 1 else 1, f"label {rng.choice(RARE)}"))
        for k in range(rng.randint(0, 3)):
            # in two nodes of five, and half of all words
            words = ["common"] * (rng.choice([5, 9, 9, 30]) if n % 5 < 2 else 0) + rng.choices(RARE + ["filler"] * 6, k=rng.randint(1, 9))
            pages.append((NS, n * 10 + k, n, " ".join(words)))
    t = spark.createDataFrame(tree, "namespace string, node_id long, parent_id long, depth int, final_label string")
    p = spark.createDataFrame(pages, "namespace string, page_id long, cluster_node_id long, title string")
    return t, p.select("namespace", "page_id", "cluster_node_id"), p.select("namespace", "page_id", "title")


QUERIES = [S.parse_query("common", "en"), S.parse_query("common red", "en"), S.parse_query("common common blue", "en"),
           S.Or([S.Phrase(["green"]), S.Phrase(["common"])]), S.Not(S.Phrase(["common"]), S.Phrase(["red"])),
           S.parse_query("nowhere", "en"), S.parse_query("common nowhere", "en"), S.parse_query("comm", "fr"),
           S.parse_query('"common red"', "en")]


def hits(df):
    return [(r.node_id, r.score) for r in df.collect()]


@pytest.fixture(scope="module")
def index(spark):
    built = S.build_index(*tables(spark, 1500), nodes_per_bucket=8)
    return built.materialize(scratch_dir(spark, "blocks"), files=6)


@pytest.mark.parametrize("n", range(len(QUERIES)))
def test_top_k_by_blocks_is_the_whole_ranking_cut(index, n):
    whole = hits(S.search(index, QUERIES[n], NS, None))
    assert hits(S.search(index, QUERIES[n], NS, 10)) == sorted(whole, key=lambda r: (r[1], r[0]))[:10]
    assert hits(S.search(index, QUERIES[n], None, 7)) == sorted(whole, key=lambda r: (r[1], r[0]))[:7]


def test_a_frequent_term_is_spread_and_most_of_its_blocks_are_skipped(spark, index):
    postings = index.postings.where(F.col("term") == "common")
    share = postings.count() / index.postings.count()
    files = postings.select(F.input_file_name().alias("f")).distinct().count()
    assert share > 0.4 and files >= 2
    assert index.weights.where(F.col("term") == "common").select(F.input_file_name()).distinct().count() >= 2
    expr = S.parse_query("common", "en")
    plan = S.block_plan(index, expr, NS)
    total = index.blocks.where(F.col("term") == "common").count()
    rows = S.phrase_rows(index, S.phrases_of(expr), NS, S._named(plan.first))
    best = S._scored(rows, plan.idf, expr, S.phrases_of(expr)).orderBy(F.desc("gain")).limit(5).collect()
    read = len(plan.first) + S.later_buckets(plan, best[-1].gain).count()
    assert total > 150 and read < total / 3
    scan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in scan and "In(bucket" in scan


def test_segments_follow_changes(spark):
    """After every batch, and after merges, searches give what a rebuilt index gives."""
    tree, pv, pl = (df.cache() for df in tables(spark, 60, seed=5))
    root = scratch_dir(spark, "segments")
    G.create(spark, root, tree, pv, pl, nodes_per_bucket=4)
    for turn in range(2):
        gone = F.col("node_id") % 17 == turn
        changed = F.col("cluster_node_id") % 13 == turn
        touched = tree.where(gone).select("namespace", "node_id").union(
            pv.where(changed).select("namespace", "cluster_node_id"))
        tree2 = tree.where(~gone)
        marked = pv.where(changed).select("namespace", "page_id", F.lit(True).alias("hit"))
        pl2 = pl.join(marked, ["namespace", "page_id"], "left").select(
            "namespace", "page_id", F.when(F.col("hit"), F.concat(F.lit("red "), "title")).otherwise(F.col("title")).alias("title"))
        tree, pl = (spark.createDataFrame(x.collect(), x.schema) for x in (tree2, pl2))
        G.apply_batch(spark, root, touched, tree, pv, pl, nodes_per_bucket=4, fan=2)
        live, fresh = G.open_live(spark, root), S.build_index(tree, pv, pl, nodes_per_bucket=4)
        for expr in (QUERIES[1], QUERIES[8]):
            assert hits(S.search(live, expr, NS, 20)) == hits(S.search(fresh, expr, NS, 20))
    rows = G._manifest(spark, root)[1]
    assert sum(r.docs is not None for r in rows) < 3                       # merged
    assert sum(r.docs or 0 for r in rows) >= tree.count()
