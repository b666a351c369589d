"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import pytest

from canopy.llm import runs
from canopy.llm.queries import QUERIES
from tests.llm.conftest import DOCS, SMALL


def brute(w, least=6, times=4):
    """Every period tried at every place; only the smallest period of a stretch counts."""
    n, found = len(w), set()
    for q in range(1, n // times + 1):
        same = [w[i] == w[i + q] for i in range(n - q)] + [False]
        start = None
        for i, s in enumerate(same):
            if s and start is None:
                start = i
            elif not s and start is not None:
                if i + q - start >= max(least, times * q):
                    found.add((start, i + q - start, q))
                start = None
    return sorted((f for f in found if not any(g[:2] == f[:2] and g[2] < f[2] for g in found)), key=lambda f: (f[0], f[2]))


def altered(words, doc_id):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    w = altered((text or "").encode().split(), doc_id)
    found = brute(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = sorted(found, key=lambda f: (-f[1], f[0], f[2]))[0] if found else None
    lines = "".join("%d,%d,%d\n" % f for f in found).encode()
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_equal_brute_force(letters):
    rng = random.Random(letters)
    for _ in range(1500):
        w = [rng.randrange(letters) for _ in range(rng.randint(0, rng.choice([9, 30, 90])))]
        if rng.random() < .6 and len(w) > 8:
            p, s = rng.randint(1, len(w) // 4), rng.randint(0, len(w) // 2)
            for i in range(s, rng.randint(s, len(w))):
                w[i] = w[s + (i - s) % p]
        assert runs.runs(w) == brute(w), w


def test_other_thresholds():
    rng = random.Random(9)
    for _ in range(500):
        w = [rng.randrange(2) for _ in range(rng.randint(0, 60))]
        assert runs.runs(w, 9, 3) == brute(w, 9, 3), w


def test_long_repetitive_documents():
    rng = random.Random(4)
    block = [rng.randrange(3000) for _ in range(5000)]
    assert runs.runs(["x"] * 100_000) == [(0, 100_000, 1)]
    assert runs.runs([-1] + block * 4 + block[:7] + [-2]) == [(1, 20_007, 5000)]


def test_grammar_derives_its_pieces():
    rng = random.Random(6)
    ids = [rng.randrange(3) for _ in range(400)]
    g = runs.Grammar(ids, [(0, 150), (150, 151), (160, 400)])

    def text(s):
        return [s] if s < g.first else text(g.left[s - g.first]) + text(g.right[s - g.first])

    assert [text(s) for s, _ in g.roots] == [ids[0:150], ids[150:151], ids[160:400]]
    for k, at in enumerate(g.place):
        assert text(g.first + k) == ids[at:at + g.size[k]]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_periodic_runs"](spark, SMALL)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = {r.doc_id: tuple(r) for r in got.collect()}
    assert len(rows) == len(docs)
    for r in docs:
        assert rows[r.doc_id] == expected(r.doc_id, r.text)


def test_odd_rows(spark, odd_docs):
    docs = odd_docs.withColumn("start", odd_docs["fp"])
    got = runs.run_digests(docs, loop=True).collect()
    short = [d for d in DOCS if len((d[1] or "").split()) < 4000]
    assert len(got) == len(DOCS)
    assert {tuple(r) for r in got} >= {expected(d[0], d[1]) for d in short}
    long = {r.doc_id: r for r in got}[8]
    assert (long.n_runs, long.start, long.period) == (1, 0, 1) and long.length == 30_000
    assert runs.run_digests(docs.limit(0)).count() == 0
    rows = {r.doc_id: r for r in runs.find_runs(docs).collect() if r.doc_id is not None}
    assert rows[3].runs == [] and rows[3].n_words == 0 and rows[3].collapsed == ""
    assert rows[8].collapsed == "lang" and [tuple(x) for x in rows[8].runs] == [(0, 30_000, 1)]
