"""The other operators: SQL twins, round trips, brute force and held-out accuracy."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from canopy.llm import chat, langid, mixing, packing, quality, topk, toxicity, warc
from canopy.llm.queries import ORACLES, QUERIES
from canopy.sources.scratch import scratch_dir
from tests.llm.conftest import DOCS, SMALL
from tests.oracle import compare

MEDIUM = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SMALL), ORACLES[name], SMALL) > 0


# ------------------------------------------------------------ quality

def test_quality_odd_rows(spark, odd_docs):
    rows = quality.verdict(quality.measure(odd_docs)).collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        t = next(d[1] for d in DOCS if d[0] == r.doc_id and len((d[1] or "").split()) >= 0 and
                 len((d[1] or "").encode().split()) == r.n_words)
        w = (t or "").encode().split()
        grams = list(zip(w, w[1:], w[2:]))
        n = Counter(grams)
        cover = {k + d for k, g in enumerate(grams) if n[g] > 1 for d in range(3)}
        assert r.n_repeat_words == len(cover)
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality.measure(odd_docs.limit(0)).count() == 0


# ------------------------------------------------------------ mixing

def test_mixing_odd_rows_and_documents(spark, odd_docs):
    rows = mixing.mixed(odd_docs).collect()
    assert len(rows) == len(DOCS)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    again = mixing.mixed(odd_docs.repartition(5)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert mixing.mixed(odd_docs.limit(0)).count() == 0
    docs = mixing.mixed_documents(odd_docs)
    assert docs.columns == odd_docs.columns
    words = sum(len(r.text.encode().split()) for r in docs.collect())
    assert words == sum(r.taken for r in rows)
    assert mixing.mixed_documents(odd_docs.limit(0)).count() == 0


def test_mixed_documents_do_not_depend_on_the_order_of_tied_rows(spark):
    rows = [(None, f"{c} " * 100, "a", c) for c in "abcdefgh"] + [(1, "x " * 90, "b", "x"), (1, "y " * 90, "b", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mark string")
    got = [sorted(map(repr, mixing.mixed_documents(spark.createDataFrame(part, df.schema).repartition(n)).collect()))
           for n, part in ((1, rows), (3, rows[::-1]), (7, rows[4:] + rows[:4]))]
    assert got[0] == got[1] == got[2] and got[0]


def test_mixing_pieces_and_quotas(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    per = {r.doc_id: r for r in mixing.mixed(docs).collect()}
    pieces = mixing.mix_pieces(docs).groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert {r.doc_id: r.n for r in pieces.collect()} == {k: r.taken for k, r in per.items() if r.taken}
    taken = Counter()
    for r in per.values():
        taken[r.source] += r.taken
    for r in per.values():
        assert abs(taken[r.source] - r.target) <= 2 * mixing.Mix().block
    shards = mixing.mix_pieces(docs).groupBy("shard").agg(F.sum("length").alias("n")).collect()
    assert len(shards) == mixing.Mix().shards
    assert max(r.n for r in shards) - min(r.n for r in shards) <= 25 * mixing.Mix().block


def test_apportionment_is_highest_quotients(spark):
    goals = spark.createDataFrame([("0a", 6400, 0, 6000.0), ("0b", 6400, 1, 2100.0), ("0c", 640, 2, 333.0)],
                                  "src string, source_size long, rank int, target double")
    got = {r.src: list(r.upto) for r in mixing.quotas(goals, mixing.Mix(shards=3)).collect()}
    house = round((6000 + 2100 + 333) / 64)
    for k in range(3):
        seats = Counter()
        for _ in range(house * (k + 1) // 3):
            best = max(("0a", 6000.0), ("0b", 2100.0), ("0c", 333.0), key=lambda x: x[1] / (2 * seats[x[0]] + 1))
            seats[best[0]] += 1
        assert {s: got[s][k] for s in got} == {s: seats[s] for s in got}


# ------------------------------------------------------------ chat

def test_chat_round_trip(spark):
    said = [(1, 0, "system", "\\ \\\\ <|im_end|>\n<|im_start|>"), (1, 1, "user", None), (1, 2, "assistant", "[[INST]]\\"),
            (1, 2, "assistant", "[[INST]]\\"), (None, None, None, "</s>"), (2, 0, "assistant", "<<s>"), (3, 0, "user", "a"),
            (3, 1, "assistant", "x" * 50_000)]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string") \
        .withColumn("turns", F.lit(1)).withColumn("n_turns", F.lit("z"))
    made = chat.format_conversations(df)
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    for conv in (1, None, 2, 3):
        want = [(r or "", t or "") for c, _, r, t in said if c == conv]
        assert [(t.role, t.text) for t in back[conv].turns] == want
        assert back[conv].loss_text == "".join(t for r, t in want if r == "assistant")
        body = back[conv].formatted
        assert body.count("<|im_end|>") == len(want) and "</s>" not in body and "[INST]" not in body
    flags = {r.conv_id: (r.valid_order, r.first_bad_turn) for r in made.collect()}
    assert flags == {1: (False, 3), None: (False, 0), 2: (False, 0), 3: (True, None)}
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


# ------------------------------------------------------------ WARC

def test_warc_records_are_single_frames_over_one_dictionary():
    import zstandard
    records = [warc._record(k, "http://x/ \n", f"<p>page {k} " + "some words of html " * 40, "0" * 64, None) for k in range(80)]
    data = warc.build_archive(records)
    n = int.from_bytes(data[4:8], "little")
    assert int.from_bytes(data[:4], "little") == warc.DICT_MAGIC and n > 0
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + n]))
    body, got = data[8 + n:], []
    while body:
        frame = unpack.decompressobj()
        got.append(frame.decompress(body))
        body = frame.unused_data
    assert got == records
    assert [b for _, b in warc.parse_archive(data)] == [r.split(b"\r\n\r\n", 1)[1][:-4] for r in records]
    assert len(list(warc.parse_archive(warc.build_archive(records[:1])))) == 1


def test_warc_odd_rows(spark):
    same, small = "a" * 100, "b" * 99
    rows = [(5, "u5", same), (3, None, same), (9, "u9", same), (None, "n", same), (1, "x", small), (2, "y", small), (7, "z", None),
            (8, "w", ""), (10, "l", "long " * 300_000), (11, "u\r\nv", "é" * 60), (3, "again", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    folder = scratch_dir(spark, "warc-test")
    assert warc.write_archives(pages.repartition(3), folder, archive_bytes=500) == len(rows)
    got = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest)
                 for r in warc.read_archives(spark, folder).collect())
    want = sorted((i if i is not None else -1, "revisit" if h == same and i != 3 else "response", 3 if h == same and i != 3 else None,
                   len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows)
    assert got == want
    payload = {r.page_id: r.payload for r in warc.read_archives(spark, folder).filter("record_type = 'response'").collect()}
    assert bytes(payload[10]) == ("long " * 300_000).encode()
    empty = scratch_dir(spark, "warc-empty")
    assert warc.write_archives(pages.limit(0), empty) == 0 and warc.read_archives(spark, empty).count() == 0


# ------------------------------------------------------------ packing

def test_packing_odd_rows(spark, odd_docs):
    from tokenizers import Tokenizer
    path = packing.public_tokenizer()
    t = Tokenizer.from_file(path)
    rows = packing.pack(odd_docs, path).collect()
    want = Counter()
    for i, text, *_ in DOCS:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        at = 0
        for n in packing.cut(len(ids)):
            want[i, at, n, zlib.crc32(ids[at:at + n].tobytes()), len(ids)] += 1
            at += n
        assert at == len(ids)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    assert all(r.length <= 2048 and r.length & (r.length - 1) == 0 and r.offset == 0 for r in rows)
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert packing.pack(odd_docs.limit(0), path).count() == 0


def test_memoised_ids_are_the_tokenizer_s(spark):
    from tokenizers import Tokenizer
    path = packing.public_tokenizer()
    t = Tokenizer.from_file(path)
    memo = packing._Memo(path, most=40)
    texts = ["It's I'LL... a.b, c.,d. ..", "ΣΣΣ. ΟΣ, İstanbul é́ é.", "1,2.3 <|endoftext|>.  x y　z\r\nq",
             "中文, 한국어. \U0001f600.́ ́x", "don't. DON'T, 's. 't, ''. x'.", "hello <|endoftext|> world", "a<|startoftext|>. <|endoftext|>b, <|endoftext|.",
             " \n\n ", "a\x1cb \x85c\x00."]
    texts += [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).collect()]
    for text in texts:
        assert np.frombuffer(packing.encode(text, memo), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_every_letter_before_a_full_stop_or_comma():
    from tokenizers import Tokenizer
    path = packing.public_tokenizer()
    t = Tokenizer.from_file(path)
    memo = packing._Memo(path)
    letters = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if c.isalpha()]
    for text in (f"{c}. a{c}. {c}, {c}x." for c in letters):
        assert np.frombuffer(packing.encode(text, memo), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_ascii_chunks_are_split_as_the_tokenizer_does():
    from tokenizers import Tokenizer
    path = packing.public_tokenizer()
    t, memo, rng = Tokenizer.from_file(path), packing._Memo(path), np.random.default_rng(5)
    signs = [chr(c) for c in range(127)] + ["'s", "'LL", "'re", "'D", "don't", "<|", "|>", "<|endoftext|>", "Ab", "xyz"] * 3
    for _ in range(6000):
        text = "".join(rng.choice(signs, rng.integers(1, 7)))
        assert np.frombuffer(packing.encode(text, memo), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, [text]


# ------------------------------------------------------------ top-k

@pytest.mark.parametrize("kind", ["spread", "ties", "unit"])
def test_top_k_equals_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 12)) * (rng.lognormal(size=(700, 1)) if kind == "spread" else 1)
    if kind == "ties":
        v = np.round(v[rng.integers(0, 9, 700)])
        v[::50] = 0
    if kind == "unit":
        v[:, 0] += 9
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(k, [float(x) for x in r]) for k, r in enumerate(v)]
    odd = [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 12), (2060, [float("inf")] * 12), (None, [1.0] * 12),
           (2080, []), (2100, [1.0]), (1, rows[1][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, bucket_rows=64, query_rows=16).collect()
    ints = [(k, np.pad(np.floor(64 * np.array(r, float)), (0, 12 - len(r))).astype(int)) for k, r in [*rows, *odd[5:]]]
    ids, m = np.array([k for k, _ in ints]), np.stack([x for _, x in ints])
    want = []
    for k, q in ints:
        if k % 20 == 0:
            s = m @ q
            ok = ids != k
            order = np.lexsort((ids[ok], -s[ok]))[:20]
            want += [(k, r + 1, int(ids[ok][o]), int(s[ok][o])) for r, o in enumerate(order)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_top_k_answers_every_query_row_by_itself(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (1, [5.0, 0.0]), (2, [4.0, 1.0]), (3, [0.0, 9.0]), (5, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=2).collect()
    want = []
    for i, q in rows[:3]:
        ranked = sorted(((-sum(int(64 * a) * int(64 * b) for a, b in zip(q, v)), j) for j, v in rows if j != i))[:2]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(ranked)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


@pytest.mark.parametrize("kind", ["unit", "near", "ties", "large"])
def test_top_k_of_groups_and_shares_equals_brute_force(spark, kind):
    """Many buckets, early ones first, and more queries than a task holds; scores beyond 2^53 for large."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(600, 10))
    if kind == "near":
        v = v[rng.integers(0, 12, 600)] + 0.02 * rng.normal(size=v.shape)
    if kind == "ties":
        v = np.round(v[rng.integers(0, 6, 600)]) * (rng.random((600, 1)) < 0.5)
    if kind in ("unit", "near"):
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "large":
        v *= 3e6
    ids = np.where(np.arange(600) % 50 == 0, 40, np.arange(600))
    df = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids, v)], "vec_id long, embedding array<double>").repartition(5)
    got = topk.top_k(df, F.col("vec_id") % 5 == 0, k=7, bucket_rows=8, query_rows=4, held_queries=16).collect()
    m, want = np.floor(64 * v).astype(int), []
    for i, q in zip(ids, m):
        if i % 5 == 0:
            s, ok = m @ q, ids != i
            order = np.lexsort((ids[ok], -s[ok]))[:7]
            want += [(int(i), r + 1, int(ids[ok][o]), int(s[ok][o])) for r, o in enumerate(order)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_top_k_brings_nothing_of_each_bucket_to_the_driver(spark, monkeypatch):
    """Neither rows nor plans in the driver grow with the number of buckets."""
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(rng.normal(size=(640, 4)))], "vec_id long, embedding array<double>")
    brought, collect = [], type(df).collect

    def counted(self):
        brought.append(len(rows := collect(self)))
        return rows

    monkeypatch.setattr(type(df), "collect", counted)
    plans = [len(topk.top_k(df, F.col("vec_id") % 20 == 0, bucket_rows=rows)._jdf.queryExecution().optimizedPlan().toString()) for rows in (32, 2)]
    assert max(brought) == 1
    assert plans[1] < plans[0] + 200


def test_top_k_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2, 64 * 192), (2, 1, 64 * 128)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


# ------------------------------------------------------------ classifiers

def test_language_held_out_accuracy(spark):
    got = QUERIES["op10_language_id"](spark, MEDIUM)
    truth = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, odd_docs):
    model = langid.fit(odd_docs, F.col("doc_id").isNotNull())
    rows = langid.predict(odd_docs, model).collect()
    assert len(rows) == len(DOCS)
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (3, 4, 5)} == {3: "und", 4: "und", 5: "und"}
    assert {r.lang_pred for r in rows} <= {"en", "de", "fr", "und"}
    nothing = langid.fit(odd_docs, F.lit(False))
    assert {r.lang_pred for r in langid.predict(odd_docs, nothing).collect()} == {"und"}
    assert langid.predict(odd_docs.limit(0), model).count() == 0


def test_forward_pass_sums_all_segmentations():
    vocabulary = langid.Vocabulary(["a", "ab", "b", "▁", "▁a"])
    p = np.array([[.1], [.2], [.3], [.05], [.25], [.001]])
    # _+a+b, _a+b, _+ab
    want = .05 * .1 * .3 + .25 * .3 + .05 * .2
    assert np.isclose(np.exp(langid.log_likelihood(["ab"], vocabulary, p))[0, 0], want)
    uses = langid.expected_counts(["ab"], np.array([2.0]), vocabulary, p[:, 0])
    assert np.isclose(uses[1], 2 * .05 * .2 / want)
    assert np.isclose(np.exp(langid.log_likelihood(["c"], vocabulary, p))[0, 0], .05 * .001)


def brute_word(word, pieces, p):
    """P(word) by recursion over the first piece of every segmentation."""
    word, memo = "▁" + word, {}
    for at in range(len(word) - 1, -1, -1):
        rest = lambda n: memo.get(at + n, 1.0) if at + n < len(word) else 1.0
        total = 0.0
        for n in range(1, len(word) - at + 1):
            piece = word[at:at + n]
            if piece in pieces:
                total += p[pieces[piece]] * rest(n)
            elif n == 1:
                total += p[-1] * rest(n)
        memo[at] = total
    return memo[0]


@pytest.mark.parametrize("n", [1, 7, 8, 41, 120])
def test_words_of_any_length_sum_all_segmentations(n):
    rng = np.random.default_rng(n)
    names = sorted({"".join(rng.choice(list("ab中文"), rng.integers(1, 5))) for _ in range(60)} | {"▁", "▁a", "▁中"})
    vocabulary = langid.Vocabulary(names)
    table = np.vstack([rng.random((len(names), 2)) / 9, np.full((1, 2), 1e-4)])
    words = ["".join(rng.choice(list("ab中文字"), n)) for _ in range(6)]
    got = langid.log_likelihood(words, vocabulary, table)
    pieces = {x: k for k, x in enumerate(names)}
    for k, w in enumerate(words):
        for lang in range(2):
            assert np.isclose(got[k, lang], np.log(brute_word(w, pieces, table[:, lang])), rtol=1e-9)
    # expected uses are the derivative of log P by log p
    uses = langid.expected_counts(words, np.ones(len(words)), vocabulary, table[:, 0])
    for piece in rng.integers(0, len(names), 8):
        near = table[:, 0].copy()
        near[piece] *= 1 + 1e-6
        slope = sum(np.log(brute_word(w, pieces, near) / brute_word(w, pieces, table[:, 0])) for w in words) / 1e-6
        assert np.isclose(uses[piece], slope, rtol=1e-3, atol=1e-4)


def test_a_very_long_word_has_a_finite_score():
    vocabulary = langid.Vocabulary(["a", "ab", "b", "▁"])
    p = np.array([[1e-12], [1e-13], [1e-12], [1e-9], [1e-4]])
    got = langid.log_likelihood(["ab" * 20_000, "c" * 5000], vocabulary, p)
    assert np.isfinite(got).all() and np.isclose(got[1, 0], np.log(1e-9) + 5000 * np.log(1e-4))
    assert np.isfinite(langid.expected_counts(["ab" * 3000], np.ones(1), vocabulary, p[:, 0])).all()


def plain_ftrl(rows, s):
    """The same learner, one coordinate after the other, on dictionaries."""
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= s.l1:
            return 0.0
        return ((1 if z[i] > 0 else -1) * s.l1 - z[i]) / ((s.beta + n[i] ** .5) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for idx, y in rows:
            w = {i: weight(i) for i in idx}
            g = 1 / (1 + np.exp(-max(-35, min(35, sum(w.values()))))) - y
            for i in idx:
                sigma = ((n[i] + g * g) ** .5 - n[i] ** .5) / s.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_ftrl_equals_plain_python():
    s = toxicity.Settings(bits=8, l1=.3, epochs=3)
    rng = np.random.default_rng(2)
    rows = [(np.append(np.unique(rng.integers(0, 256, 12)), 256), int(rng.random() < .4)) for _ in range(200)]
    z, n = toxicity.ftrl(iter(rows), s)
    got, want = toxicity.weights(z, n, s), plain_ftrl([(r.tolist(), y) for r, y in rows], s)
    assert all(np.isclose(got[i], want.get(i, 0.0), atol=1e-12) for i in range(257)) and (got == 0).any() and (got != 0).any()


def test_features_are_words_pairs_and_skips():
    h = toxicity._WordHashes()
    found = [set(toxicity.features(t, h, 30).tolist()) for t in ("a b c", "A, b", "c", "a x c", "b c")]
    assert len(found[0]) == 6  # a, b, c, ab, bc, a-c
    assert found[1] < found[0] and found[2] < found[0] and found[4] < found[0]
    assert len(found[0] & found[3]) == 3  # a, c and the skip pair
    assert len(toxicity.features(None, h, 30)) == 0


def test_toxicity_held_out(spark):
    got = QUERIES["op3_toxicity"](spark, MEDIUM)
    truth = spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", "toxic")
    assert got.count() == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    rows = got.join(truth, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9
    assert all(r.predicted == (r.score >= 0.5) for r in got.collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_toxicity_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (8, 0), (11, 0), (3, 1), (None, 1), (10, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, labels, "toxic", F.lit(True))
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == len(DOCS) and all(0 <= r.score <= 1 for r in rows)
    blank = toxicity.fit(odd_docs, labels.limit(0), "toxic", F.lit(True))
    assert all(0 <= r.score < 0.5 for r in toxicity.score(odd_docs, blank).collect())
    assert toxicity.score(odd_docs.limit(0), model).count() == 0


LABELS = {"empty": [], "null": [(1, None), (8, None)], "one": [(1, 1)], "tiny": [(1, 1), (8, 0), (11, 0), (9, 1)],
          "one label": [(1, 1)] * 12, "bias alone": [(6, 0), *[(i, 1) for i in (1, 2, 8, 9, 10, 11)]]}


@pytest.mark.parametrize("labels", sorted(LABELS))
def test_labels_without_evidence_predict_0_and_drop_nothing(spark, odd_docs, labels):
    folder = scratch_dir(spark, f"toxicity-{labels.replace(' ', '-')}")
    odd_docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(LABELS[labels], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    rows = QUERIES["op3_toxicity"](spark, folder).collect()
    assert len(rows) == len(DOCS) and {r.predicted for r in rows} == {0}
    assert corpus_pipeline.drop_toxic(spark, odd_docs, folder).count() == len(DOCS)
