"""Packing by power-of-two decomposition: no sequence holds two documents and none needs padding.

A document's ids, with the end id, are cut into as many pieces of ``longest`` ids as fit
and then into the powers of two of what is left, the largest first.  Every piece is a
sequence of its own; ``bucket`` (the power) groups sequences of equal length into batches.

The strings of special tokens in a text are their ids, as the tokenizer has it by default.

Cases: a null or empty text is the end id alone, one piece of length 1; repeated rows are
packed like any other; an empty table gives no pieces; further columns are ignored.  A
document is tokenised in one task; memory is that of its ids.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 2048
END_ID = 1

#: Fixed value: the tokenizer's own split of a text without white space, for printable ASCII in lower case.
_ASCII_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall

_MEMOS: dict[str, "_Memo"] = {}


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class _Memo(dict):
    """Chunk between white space -> its ids as little-endian bytes; emptied when it is full.

    The tokenizer lower-cases and never joins ids across white space.  Printable ASCII is
    split by its own rule, and a Latin letter that stays one letter when normalised, followed
    by one full stop or comma, ends a token of its own; such parts are encoded apart by
    the tokenizer's model, all other chunks by the tokenizer.
    """

    def __init__(self, path: str, most: int = 1_200_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.bytes = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.words: dict[str, bytes] = {}
        self.most = most

    def word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= self.most:
                self.words.clear()
            spelled = word if word.isascii() else self.bytes.pre_tokenize_str(word)[0][0]
            ids = np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
            self.words[word] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if len(self) >= self.most // 2:
            self.clear()
        last = chunk[-2:-1]
        if chunk.isascii() and chunk.isprintable() and "<|" not in chunk:
            ids = b"".join(map(self.word, _ASCII_PARTS(chunk.lower())))
        elif chunk[-1:] in ",." and last.isalpha() and last < "\u0250" and last != "\u0130":
            ids = self[chunk[:-1]] + self[chunk[-1]]
        else:
            low = chunk.lower()
            if low.isalpha() and max(chunk) < "\u0250":
                ids = self.word(low)
            else:
                ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        self[chunk] = ids
        return ids


def encode(text: str, memo: _Memo) -> bytes:
    return b"".join(map(memo.__getitem__, text.replace("\n", " ").split(" ")))


def cut(n: int, longest: int = LONGEST) -> list[int]:
    """Piece lengths of a document of ``n`` ids: full pieces, then the binary digits of the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, `offset` long, "
          "bucket int, ids array<int>")


def pack(docs: DataFrame, tokenizer_path: str, longest: int = LONGEST, end_id: int = END_ID,
         with_ids: bool = True) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, offset, bucket, ids, sequence_id``.

    ``ids`` is null unless ``with_ids``.  Sequence ids are unique, not consecutive.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _MEMOS.get(tokenizer_path) or _MEMOS.setdefault(tokenizer_path, _Memo(tokenizer_path))
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = encode(text.as_py(), memo) + end
                n, at = len(data) // 4, 0
                for length in cut(n, longest):
                    piece = data[4 * at:4 * (at + length)]
                    rows.append((doc_id, at, length, zlib.crc32(piece), n, length.bit_length() - 1,
                                 np.frombuffer(piece, "<i4") if with_ids else None))
                    at += length
                held += len(data) if with_ids else 0
                if len(rows) >= 20_000 or held >= 16 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, PIECES) \
        .withColumn("sequence_id", F.monotonically_increasing_id())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, start, length, crc, n, bucket, ids = zip(*rows)
    long = pa.int64()
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_id, long), pa.array(start, long), pa.array(length, long), pa.array(crc, long),
         pa.array(n, long), pa.array([0] * len(rows), long), pa.array(bucket, pa.int32()),
         pa.array(ids, pa.list_(pa.int32()))],
        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset", "bucket", "ids"])
