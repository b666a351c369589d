"""The pipeline's stages against plain Python on the same rows."""

import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from canopy.llm import mixing, packing, toxicity
from pyspark.sql import functions as F
from tests.llm.conftest import DOCS, SMALL
from tests.llm.test_dedup import brute_components


def test_pipeline_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SMALL), name)
        out[name] = docs
        if name != "packing":
            assert docs.columns == columns
    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.fit(source, spark.read.parquet(f"{SMALL}/labels.parquet"), "toxic",
                         toxicity.remainder(F.col("doc_id"), 5) != 0)
    scores = {r.doc_id: r.score for r in toxicity.score(source, model).collect()}
    clean = {r.doc_id: r.text for r in out["toxicity"].collect()}
    assert set(clean) == {i for i, s in scores.items() if s < 0.5}

    lowest = {eval(x)[2] for x in brute_components(list(clean.items()))}
    single = {r.doc_id: r.text for r in out["simhash_near_dedup"].collect()}
    assert set(single) == lowest and all(single[i] == clean[i] for i in single)

    first = {}
    for i, t in single.items():
        t = t.encode()
        for p in range(len(t) - 49):
            first[t[p:p + 50]] = min(first.get(t[p:p + 50], i), i)
    cut = {r.doc_id: r for r in out["suffix_dedup"].collect()}
    assert set(cut) == set(single)
    for i, t in single.items():
        t = t.encode()
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first[t[p:p + 50]] < i:
                gone[p:p + 50] = True
        want = np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        assert cut[i].text == want and cut[i].n_chars == len(want)

    taken = {r.doc_id: r.taken for r in mixing.mixed(out["suffix_dedup"]).collect()}
    words = Counter()
    for r in out["mix_sources"].collect():
        words[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert {i: n for i, n in taken.items() if n} == dict(words)

    pieces = out["packing"].collect()
    rows = Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0)
    memo = packing._Memo(packing.public_tokenizer())
    assert rows == Counter((r.doc_id, len(packing.encode(r.text, memo)) // 4 + 1) for r in out["mix_sources"].collect())


def test_last_stage_keeps_the_sequences(spark, odd_docs):
    rows = corpus_pipeline.pack_sequences(spark, odd_docs, SMALL).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    memo = packing._Memo(packing.public_tokenizer())
    for i, text in {d[0]: d[1] for d in DOCS if d[0] in (1, 3, 8, 9, 10)}.items():
        got = [x for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start) for x in r.ids]
        assert got == [*np.frombuffer(packing.encode(text or "", memo), "<u4").tolist(), packing.END_ID]


def test_stages_on_odd_and_empty_tables(spark, odd_docs):
    plain = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (plain, plain.limit(0), odd_docs):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialise(stage(spark, docs, SMALL), name)
            assert name == "packing" or docs.columns == rows.columns
        docs.count()
