"""Language identification with segmentation-marginalised unigrams over a fixed piece vocabulary.

Each language has a probability for every piece of a public vocabulary.  A word's
probability is the sum over all its segmentations into pieces of the product of theirs,
computed by a forward pass; a text's is the product over its words.  Probabilities are
re-estimated from all training texts: a forward-backward pass gives the expected number of
times each piece is used, and the sums per language and piece are the only thing shuffled.

A word is the lower-cased letters of a chunk between white space, however many.  A character
outside the vocabulary counts as a piece of a small fixed probability.

Cases: a null text, or one without letters, is ``und`` with score 0, as is every text if
there is nothing to learn from; rows with a null language or a null id are not learned
from; equal scores go to the language that sorts first; repeated rows count as often as
they occur; an empty table gives no rows; further columns are ignored.  The model is
bounded by languages times vocabulary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMOOTH = 0.1
UNKNOWN = 1e-4
_BASE = np.uint64(0x9E3779B97F4A7C15)


def public_pieces(path: str | None = None) -> list[str]:
    """Lower-case pieces of letters, with a leading mark for those that begin a word."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())}
    return sorted(p for p in found if p.strip("▁").isalpha() and "▁" not in p[1:])


class Vocabulary:
    """Piece numbers by a polynomial hash of their characters, for look-up in arrays."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        h = np.array([self._hash(p) for p in pieces], np.uint64)
        self.order = np.argsort(h)
        self.hashes = h[self.order]

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], -1)


#: Letters times words that one step holds.
STEP = 170_000
#: Positions between two rescalings of a pass; a product over so many pieces stays a normal number.
STRIDE = 8


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, code points with the leading mark) of the words of each length."""
    lengths = np.array([len(w) for w in words], np.int64)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        most = max(1, min(4096, STEP // (n + 1)))
        for at in range(0, len(rows), most):
            part = rows[at:at + most]
            text = "".join("▁" + words[i] for i in part)
            yield part, np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(part), n + 1)


class _Substrings:
    """Piece numbers of the substrings of words of one length."""

    def __init__(self, codes: np.ndarray, vocabulary: Vocabulary):
        self.vocabulary, self.n = vocabulary, codes.shape[1]
        c = codes.astype(np.uint64) + np.uint64(1)
        # power sums: hash(i..j) = H[j] - H[i] * base^(j - i)
        self.pre, self.power = [np.zeros(len(c), np.uint64)], [np.uint64(1)]
        with np.errstate(over="ignore"):
            for j in range(self.n):
                self.pre.append(self.pre[-1] * _BASE + c[:, j])
            for _ in range(vocabulary.longest):
                self.power.append(self.power[-1] * _BASE)
        self.kept: dict[tuple[int, int], np.ndarray] = {}

    def piece(self, i: int, j: int) -> np.ndarray:
        """Piece numbers of the characters from i to j, -1 where they are no piece."""
        got = self.kept.pop((i, j), None)
        if got is None:
            with np.errstate(over="ignore"):
                got = self.vocabulary.find(self.pre[j] - self.pre[i] * self.power[j - i])
        return got

    def starts(self, j: int) -> range:
        return range(j - 1, max(-1, j - 1 - self.vocabulary.longest), -1)

    def ends(self, i: int) -> range:
        return range(i + 1, min(self.n, i + self.vocabulary.longest) + 1)


def log_likelihood(words: list[str], vocabulary: Vocabulary, table: np.ndarray) -> np.ndarray:
    """log P(word | language), one row per word; table: piece probabilities, a last row for unknown ones.

    Only the columns within the longest piece are held, rescaled as they go, so words of any
    length are summed over all their segmentations.
    """
    out = np.zeros((len(words), table.shape[1]))
    for rows, codes in _by_length(words):
        parts = _Substrings(codes, vocabulary)
        a = {0: np.ones((len(rows), table.shape[1]))}
        scale = np.zeros((len(rows), table.shape[1]))
        for j in range(1, parts.n + 1):
            now = np.zeros((len(rows), table.shape[1]))
            for i in parts.starts(j):
                piece = parts.piece(i, j)
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    now[hit] += a[i][hit] * table[piece[hit]]
                if i == j - 1:
                    miss = np.flatnonzero(piece < 0)
                    now[miss] += a[i][miss] * table[-1]
            a[j] = now
            a.pop(j - vocabulary.longest, None)
            if j % STRIDE == 0:
                top = np.maximum.reduce(list(a.values()))
                scale += np.log(top)
                a = {k: v / top for k, v in a.items()}
        out[rows] = np.log(a[parts.n]) + scale
    return out


def expected_counts(words: list[str], weight: np.ndarray, vocabulary: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over the words, by forward-backward; p: one language's probabilities."""
    out = np.zeros(len(p))
    for rows, codes in _by_length(words):
        parts, longest = _Substrings(codes, vocabulary), vocabulary.longest
        n = parts.n
        keep = n <= 64

        def value(i: int, j: int, piece: np.ndarray) -> np.ndarray:
            return np.where(piece >= 0, p[piece], p[-1] if j == i + 1 else 0.0)

        # column j of the forward pass is stored[j] * exp(logs[j]); a holds the last ones at one scale
        stored, logs, scale = [np.ones(len(rows))], [np.zeros(len(rows))], np.zeros(len(rows))
        a = {0: stored[0]}
        for j in range(1, n + 1):
            now = np.zeros(len(rows))
            for i in parts.starts(j):
                piece = parts.piece(i, j)
                if keep:
                    parts.kept[i, j] = piece
                now += a[i] * value(i, j, piece)
            a[j] = now
            stored.append(now)
            logs.append(scale)
            a.pop(j - longest, None)
            if j % STRIDE == 0:
                top = np.maximum.reduce(list(a.values()))
                scale = scale + np.log(top)
                a = {k: v / top for k, v in a.items()}
        total = np.log(stored[n]) + logs[n]
        b, back = {n: np.ones(len(rows))}, np.zeros(len(rows))
        for i in range(n - 1, -1, -1):
            share = stored[i] * np.exp(logs[i] + back - total) * weight[rows]
            now = np.zeros(len(rows))
            for j in parts.ends(i):
                piece = parts.piece(i, j)
                through = b[j] * value(i, j, piece)
                now += through
                hit = piece >= 0
                if hit.any():
                    out += np.bincount(piece[hit], (share * through)[hit], len(p))
            b[i] = now
            b.pop(i + longest, None)
            if (n - i) % STRIDE == 0:
                top = np.maximum.reduce(list(b.values()))
                back = back + np.log(top)
                b = {k: v / top for k, v in b.items()}
    return out


def letters(chunk: str) -> str:
    low = chunk.lower()
    return low if low.isalpha() else "".join(c for c in low if c.isalpha())


@dataclass
class Model:
    langs: list[str]
    pieces: list[str]
    table: np.ndarray  # piece probabilities by language; a last row for characters outside the vocabulary


def _uniform(n: int) -> np.ndarray:
    return np.append(np.full(n, 1.0 / max(n, 1)), UNKNOWN)


def fit(docs: DataFrame, learn: Column, pieces: list[str] | None = None, rounds: int = 1) -> Model:
    """Piece probabilities from all rows that ``learn`` holds for and that have a text and a language."""
    spark = docs.sparkSession
    pieces = public_pieces() if pieces is None else pieces
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    model = Model([], pieces, np.zeros((len(pieces) + 1, 0)))
    for _ in range(rounds):
        known = spark.sparkContext.broadcast((pieces, model.langs, model.table))

        def count(batches: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            names, langs, table = known.value
            vocabulary = Vocabulary(names)
            start = _uniform(len(names))
            held: dict[str, Counter] = {}
            chunks = 0

            def give() -> Iterator[pd.DataFrame]:
                for lang, counter in held.items():
                    by_word: Counter = Counter()
                    for chunk, n in counter.items():
                        by_word[letters(chunk)] += n
                    by_word.pop("", None)
                    if by_word:
                        p = table[:, langs.index(lang)] if lang in langs else start
                        uses = expected_counts(list(by_word), np.array(list(by_word.values()), float), vocabulary, p)
                        hit = np.flatnonzero(uses > 0)
                        yield pd.DataFrame({"lang": lang, "piece": hit, "uses": uses[hit]})
                held.clear()

            for batch in batches:
                for lang, text in zip(batch["lang"], batch["text"]):
                    c = held.setdefault(lang, Counter())
                    before = len(c)
                    c.update(text.split())
                    chunks += len(c) - before
                if chunks > 400_000:
                    yield from give()
                    chunks = 0
            yield from give()

        got = rows.mapInPandas(count, "lang string, piece int, uses double") \
            .groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas()
        langs = sorted(got["lang"].unique())
        uses = np.zeros((len(pieces), len(langs)))
        uses[got["piece"], [langs.index(x) for x in got["lang"]]] = got["uses"]
        table = (uses + SMOOTH) / (uses.sum(axis=0) + SMOOTH * len(pieces)) if langs else uses
        model = Model(langs, pieces, np.vstack([table, np.full((1, len(langs)), UNKNOWN)]))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score``: the most probable language and its posterior under equal priors."""
    shared = docs.sparkSession.sparkContext.broadcast((model.pieces, model.langs, model.table))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, langs, table = shared.value
        vocabulary = Vocabulary(pieces)
        place: dict[str, int] = {}
        logs = np.zeros((1, len(langs)))
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at:at + 1000]
                texts = [[] if t is None else t.split() for t in part["text"]]
                if len(place) > 400_000:  # bounded: forget and score anew
                    place, logs = {}, np.zeros((1, len(langs)))
                new = list({c for t in texts for c in t if c not in place})
                clean = [letters(c) for c in new]
                known = sorted(set(clean) - {""})
                score = dict(zip(known, range(len(logs), len(logs) + len(known))))
                if langs:
                    logs = np.vstack([logs, log_likelihood(known, vocabulary, table)])
                place.update((c, score.get(w, 0)) for c, w in zip(new, clean))
                got, best = [], []
                for t in texts:
                    idx = np.fromiter((place[c] for c in t), np.int64, len(t))
                    idx = idx[idx > 0]
                    if not langs or not len(idx):
                        got.append("und")
                        best.append(0.0)
                        continue
                    s = logs[idx].sum(axis=0)
                    e = np.exp(s - s.max())
                    got.append(langs[int(s.argmax())])
                    best.append(float(e.max() / e.sum()))
                yield pd.DataFrame({"doc_id": part["doc_id"], "lang_pred": got, "score": best})

    ids = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.mapInPandas(run, "doc_id string, lang_pred string, score double") \
        .withColumn("doc_id", F.col("doc_id").cast("long"))
