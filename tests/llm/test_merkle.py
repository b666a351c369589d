"""The Merkle manifest against a plain tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from canopy.llm import merkle
from tests.llm.conftest import DOCS


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(digests):
    """Root, and for every leaf its siblings as (side, digest) from the leaf up."""
    paths, level, under = [[] for _ in digests], list(digests), [[i] for i in range(len(digests))]
    while len(level) > 1:
        pairs = [(level[k:k + 2], under[k:k + 2]) for k in range(0, len(level), 2)]
        for pair, members in pairs:
            for j, m in enumerate(members):
                for i in m:
                    paths[i].append((0, "") if len(pair) == 1 else (1, pair[1]) if j == 0 else (-1, pair[0]))
        level, under = [sha(*p) for p, _ in pairs], [sum(m, []) for _, m in pairs]
    return level[0], paths


def expected(docs):
    groups = {}
    for d in docs:
        groups.setdefault(d[2], []).append(d)
    if not docs:
        return []
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        rows = sorted(((d[0] is not None, d[0] or 0, leaf(*d), d) for d in groups[g]), key=lambda r: r[:3])
        trees[g] = (rows, *plain_tree([r[2] for r in rows]))
    root, tops = plain_tree([trees[g][1] for g in langs])
    out = []
    for g, top in zip(langs, tops):
        rows, subroot, paths = trees[g]
        for r, path in zip(rows, paths):
            d, path = r[3], path + top
            hit = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0 and d[3] is not None
            up = leaf(*d[:3], d[3] + 1, d[4]) if hit else r[2]
            for side, other in path:
                up = sha(up) if side == 0 else sha(other, up) if side < 0 else sha(up, other)
            out.append((d[0], r[2], subroot, root, sha(*(p[1] for p in path)), up, up == root))
    return sorted(map(repr, out))


def tampered():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 0


@pytest.mark.parametrize("rows,bits", [(0, 2), (1, 2), (2, 6), (300, 2), (300, 6)])
def test_manifest_equals_a_plain_tree(spark, rows, bits):
    rng = random.Random(rows)
    docs = [(rng.choice([None, rng.randrange(2 * rows), i, i]), rng.choice([None, "a", ""]),
             rng.choice([None, "", "de", "en", "é", "z"]) if rows > 2 else "en", rng.choice([None, 5, i]),
             rng.choice([None, "", "é", "x" * i])) for i in range(rows)]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    got = merkle.verified_documents(df, tampered(), bits).collect()
    assert sorted(repr(tuple(r)) for r in got) == expected(docs)


def test_odd_rows(spark, odd_docs):
    docs = odd_docs.withColumn("digest", F.lit(1)).withColumn("key", F.lit("k")).withColumn("path", F.lit(2))
    got = merkle.verified_documents(docs, tampered()).collect()
    rows = [(d[0], d[3], d[2], len(d[1] or ""), d[1]) for d in DOCS]
    assert sorted(repr(tuple(r)) for r in got) == expected(rows)
    assert all(r.verified == (r.folded_root == r.root) for r in got)
