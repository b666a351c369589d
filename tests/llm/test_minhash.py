"""MinHash near-dedup against brute force over all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.llm import graph, minhash
from canopy.llm.queries import QUERIES
from tests.llm.conftest import DOCS, SMALL


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(docs, percent=80):
    """(id, set size, smallest reachable id) over all pairs of rows."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    shared = defaultdict(int)
    for held in holders.values():
        for x, i in enumerate(held):
            for j in held[:x]:
                shared[j, i] += 1
    for (i, j), n in shared.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return sorted(repr((d, len(sets[i]), low[find(i)])) for i, (d, _) in enumerate(docs))


def rows(df):
    return sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in df.collect())


def family(rng, n, size, changes):
    """Copies of one text, each with a few words changed."""
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, changes)):
            t[rng.randrange(size)] = f"x{rng.randrange(9)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("settings", [minhash.Settings(), minhash.Settings(piece=7, fan=3)])
def test_components_equal_brute_force(spark, settings):
    rng = random.Random(3)
    texts = family(rng, 60, 120, 12) + family(rng, 40, 40, 3) + family(rng, 40, 7, 1) + family(rng, 20, 4, 1) \
        + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(60)] \
        + [" ".join(f"w{rng.randrange(5000)}" for _ in range(30)) for _ in range(30)] + [None, "", " \n"]
    rng.shuffle(texts)
    docs = [(rng.choice([i, i, i, i // 2]) if rng.random() > .03 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(minhash.near_duplicates(df, settings)) == brute(docs)


def test_links_between_tips_of_a_star(spark):
    """A chain of texts, each similar only to the next: every link has to be found, whatever the hubs."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(700)]
    chain = [" ".join(words[k * 8:k * 8 + 120]) for k in range(60)]
    assert len(shingles(chain[0]) & shingles(chain[2])) * 100 < 80 * len(shingles(chain[0]) | shingles(chain[2]))
    docs = list(enumerate(chain))
    rng.shuffle(docs)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {0}


def test_links_left_by_stars_are_found(spark):
    """Without any confirmed star, the comparison inside buckets alone gives the components."""
    rng = random.Random(5)
    texts = list(dict.fromkeys(family(rng, 50, 60, 5) + family(rng, 30, 60, 12)))
    s = minhash.Settings(piece=8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = minhash.sketches(docs, s).withColumn("node", F.col("doc_id")).withColumn("first_id", F.col("doc_id"))
    members = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    alone = nodes.select("node", F.col("node").alias("root")).limit(0)
    links = minhash._tip_links(members, alone, nodes, minhash._sets(docs, nodes, s), s)
    found = {r.node: r.root for r in graph.components(links).collect()}
    want = eval("[" + ",".join(brute(list(enumerate(texts)))) + "]")
    ends = {}
    for i, _, low in want:
        assert ends.setdefault(low, found.get(i, i)) == found.get(i, i)
    assert len(set(ends.values())) == len(ends) and len(links.collect()) <= 8 * len(texts)


def test_intersections_by_products():
    rng = np.random.default_rng(2)
    items = [np.unique(rng.integers(0, 300, rng.integers(1, 90))) for _ in range(40)]
    got = minhash._shared(items, width=16)
    assert (got * (1 - np.eye(40, dtype=int)) ==
            np.array([[len(np.intersect1d(a, b)) * (i != j) for j, b in enumerate(items)] for i, a in enumerate(items)])).all()


def test_sketches_estimate_similarity():
    s = minhash.Settings()
    sketcher, rng = minhash.Sketcher(s), np.random.default_rng(1)
    for size in (1, 3, 20, 160, 3000):
        for _ in range(20):
            items = np.unique(rng.integers(0, 1 << 64, 2 * size, dtype=np.uint64))
            a, b = np.sort(items[:-max(1, size // 8)]), np.sort(items[max(1, size // 8):])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            got = (sketcher.values(a) == sketcher.values(b)).mean()
            assert abs(got - true) < .2
    assert len(sketcher.keys(sketcher.values(items))) == s.bands


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_minhash_near_dedup"](spark, SMALL)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert rows(got) == brute(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_odd_rows(spark, odd_docs):
    docs = odd_docs.withColumn("sig", F.lit(1)).withColumn("node", F.lit("x"))
    assert rows(minhash.near_duplicates(docs)) == brute([d[:2] for d in DOCS])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
