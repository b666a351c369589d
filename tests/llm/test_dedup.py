"""SimHash and suffix dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from canopy.llm import graph, simhash, suffix
from canopy.llm.queries import QUERIES
from tests.llm.conftest import DOCS, SMALL


def brute_suffix(docs, least=50):
    first = {}
    for i, t in docs:
        if i is not None:
            for p in range(len(t) - least + 1):
                w = t[p:p + least]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - least + 1 if i is not None else 0):
            if first[t[p:p + least]] < i:
                gone[p:p + least] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def _rows(df):
    return sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in df.collect())


def _random_docs():
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdé ") for _ in range(80)) for _ in range(5)]
    docs = []
    for k in range(90):
        t = "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 200)))
        for _ in range(rng.randint(0, 3)):
            at, part = rng.randint(0, len(t)), rng.choice(passages)[rng.randint(0, 20):rng.randint(55, 80)]
            t = t[:at] + part + t[at:]
        docs.append((rng.choice([k, k, k // 2]) if rng.random() > .03 else None, "ab" * 100 if k % 11 == 0 else t))
    return docs


@pytest.mark.parametrize("settings", [
    suffix.Settings(), suffix.Settings(chunk_bytes=1500, spread=1, transform_symbols=2000),
    suffix.Settings(chunk_bytes=1500, hot_texts=3)])
def test_suffix_equals_brute_force(spark, settings):
    docs = _random_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert _rows(suffix.dedup(df, settings)) == brute_suffix([(i, t.encode()) for i, t in docs])


def test_suffix_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    expected = brute_suffix([(r.doc_id, (r.text or "").encode()) for r in rows])
    assert _rows(QUERIES["op9_suffix_dedup"](spark, SMALL)) == expected


def test_suffix_odd_rows(spark, odd_docs):
    docs = [(r[0], (r[1] or "").encode()) for r in DOCS if len(r[1] or "") < 1000]
    short = odd_docs.filter("text is null or length(text) < 1000")
    assert _rows(suffix.dedup(short)) == brute_suffix(docs)
    assert suffix.dedup(odd_docs).count() == len(DOCS)
    assert suffix.dedup(odd_docs.limit(0)).count() == 0
    kept = suffix.dedup_documents(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(DOCS)
    by_id = {r.doc_id: r for r in kept.filter("doc_id in (1, 8, 9)").collect()}
    assert by_id[1].text == DOCS[0][1] and by_id[8].fp == 7 and by_id[9].at == "k"
    assert suffix.dedup_documents(odd_docs.limit(0)).count() == 0


def test_common_prefixes_stop_at_the_minimum():
    text = np.frombuffer(b"banana$bandana$", np.uint8).astype(np.uint16)
    order, bwt = suffix.transform(text, 3)
    edge = suffix.common_prefixes(bwt, 3)
    rotations = [bytes(np.roll(text, -i).astype(np.uint8))[:3] for i in order]
    assert rotations == sorted(rotations)
    assert [a != b for a, b in zip([None, *rotations], rotations)] == edge.tolist()


def brute_components(docs):
    fps = np.array([simhash.fingerprint(t) for _, t in docs], np.uint64)
    root = np.arange(len(fps))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3)
    simhash._join(root, i, j)
    low = {}
    for r, (d, _) in zip(root, docs):
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return sorted(repr((d, int(f), low.get(r))) for r, f, (d, _) in zip(root, fps, docs))


def _components(df):
    return sorted(repr((r.doc_id, r.fp & (1 << 64) - 1, r.component_id)) for r in df.collect())


def test_simhash_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op1_simhash_near_dedup"](spark, SMALL).collect()
    mine = sorted(repr((r.doc_id, int(r.fingerprint, 16), r.component_id)) for r in got)
    assert mine == brute_components([(r.doc_id, r.text) for r in rows])
    assert all(len(r.fingerprint) == 16 for r in got)


def test_simhash_odd_rows(spark, odd_docs):
    assert _components(simhash.near_duplicates(odd_docs)) == brute_components([r[:2] for r in DOCS])
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0
    kept = simhash.deduplicated(odd_docs)
    roots = simhash.near_duplicates(odd_docs).select("root").distinct().count()
    assert kept.columns == odd_docs.columns and kept.count() == roots
    assert simhash.deduplicated(odd_docs.limit(0)).count() == 0


def test_fingerprint_words():
    import xxhash
    h = xxhash.xxh64_intdigest("one two", 42)
    assert simhash.fingerprint("ONE\n\ttwo ") == h
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    # only A-Z are lower-cased
    assert simhash.fingerprint("É") == xxhash.xxh64_intdigest("É", 42)


@pytest.mark.parametrize("free", [3, 4, 5, 8])
def test_split_postings_find_the_same_components(free):
    rng = random.Random(free)
    base, places = rng.getrandbits(64), rng.sample(range(8), free)
    x = set()
    for _ in range(500):
        v = base
        for _ in range(rng.randint(0, 7)):
            v ^= 1 << (rng.choice(places) * 8 + rng.randrange(8))
        x.add(v)
    x = np.array(sorted(x), np.uint64)
    whole, split = simhash._pairwise(x, 3), simhash.forest(x, 3, small=16)
    assert len(set(zip(whole, split))) == len(set(whole)) == len(set(split))


def test_components_of_a_long_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(60)]
    star = [(1000, 1001 + k) for k in range(40)]
    got = graph.components(spark.createDataFrame(path + star, "a long, b long")).collect()
    roots = {r.node: r.root for r in got}
    assert len(roots) == 61 + 41
    assert len({roots[k] for k in range(61)}) == 1 and len({roots[1000 + k] for k in range(41)}) == 1
    assert roots[0] != roots[1000]
