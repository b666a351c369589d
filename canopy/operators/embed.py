"""Corpus embedding with a pluggable model (I1) and embedding-input text (H1, H2).

``embed_pages`` runs the caller's ``embed_fn(pandas.Series[str]) -> list[vector]``
inside ``mapInPandas`` (Arrow batches), so any local model can be plugged in;
failures of single pages go to an error column instead of failing the job.
The default model is deterministic feature hashing over the search tokens,
L2-normalised — JVM-side, no Python in the hot path.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame

from canopy.functions.text import embed_input, halve_to_fit, tokens


def input_text(page_log: DataFrame, max_chars: int | None = None, null_text: str = "None") -> DataFrame:
    t = embed_input("title", "abstract", null_text)
    if max_chars is not None:
        t = halve_to_fit(t, max_chars)
    return page_log.select("namespace", "page_id", t.alias("text"))


def hashing_embed(texts: DataFrame, dim: int = 64) -> DataFrame:
    """Default offline model: hashed token counts, unit length (array<float>)."""
    tok = texts.withColumn("__tok", tokens("text"))
    tf = HashingTF(numFeatures=dim, inputCol="__tok", outputCol="__tf").transform(tok)
    nv = Normalizer(p=2.0, inputCol="__tf", outputCol="__n").transform(tf)
    return nv.select(*[c for c in texts.columns if c != "text"],
                     vector_to_array("__n").cast("array<float>").alias("embedding"))


def embed_halving(text: str | None, embed_fn: Callable[[pd.Series], list],
                  too_large: Callable[[Exception], bool]) -> np.ndarray:
    """One text's vector; as long as the model finds it too large, its first half is tried."""
    text = text or ""
    while text:
        try:
            return np.asarray(embed_fn(pd.Series([text]))[0], dtype=np.float32)
        except Exception as e:  # noqa: BLE001 - the caller tells which errors mean a smaller text may pass
            if not too_large(e):
                raise
            text = text[:len(text) // 2]
    raise ValueError("empty input text")


def says_too_large(e: Exception) -> bool:
    return "input is too large to process" in str(e)


def embed_pages(texts: DataFrame, embed_fn: Callable[[pd.Series], list], dim: int,
                too_large: Callable[[Exception], bool] = says_too_large) -> DataFrame:
    """Apply a Python model batch-wise; returns (..., embedding, error).

    A batch that the model rejects is embedded page by page: a text that is too large is
    halved until it is accepted (I1), any other failure is the page's error and no one else's.
    """
    keep = [c for c in texts.columns if c != "text"]
    kfields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields if f.name in keep)

    def run(it):
        for pdf in it:
            out = pdf[keep].copy()
            embs, errs = [], []
            try:
                embs = [np.asarray(v, dtype=np.float32).tolist() for v in embed_fn(pdf["text"])]
                errs = [None] * len(pdf)
            except Exception:  # noqa: BLE001 - isolate the pages that fail
                for t in pdf["text"]:
                    try:
                        embs.append(embed_halving(t, embed_fn, too_large).tolist())
                        errs.append(None)
                    except Exception as e:  # noqa: BLE001 - per-page failure is data
                        embs.append(None)
                        errs.append(str(e))
            out["embedding"] = embs
            out["error"] = errs
            yield out

    return texts.mapInPandas(run, f"{kfields}, embedding array<float>, error string")
