"""Subword ids by the longest pieces of a vocabulary, and the probability of a classifier over them."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

# Ids of the padding, of an unknown word, of the begin and the end of a text, and the length of all rows of ids.
PAD, UNKNOWN, BEGIN, END, LENGTH = 0, 100, 101, 102, 512
_WORD = re.compile(r"[a-z0-9]+")


def vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """Pieces and ids of a vocabulary file: one piece a line, its id the number of the line; blank lines have an id but no piece. A vocabulary is a bounded list (tens of thousands)."""
    text = spark.read.text(path, wholetext=True).first()
    return {} if text is None else {line.strip(): k for k, line in enumerate(text.value.split("\n")) if line.strip()}


def encode(text: str, vocab: dict[str, int], length: int = LENGTH) -> list[int]:
    """Ids of a text, without padding: words in lower case of ASCII letters and digits, each as a whole or by its longest pieces; a character no piece begins with is passed over."""
    ids = [BEGIN]
    for m in _WORD.finditer(text.lower()):
        if len(ids) >= length - 1:
            break
        word = m[0]
        if word in vocab:
            ids.append(vocab[word])
            continue
        at, known = 0, False
        while at < len(word) and len(ids) < length - 1:
            head = "##" if at else ""
            end = next((e for e in range(len(word), at, -1) if head + word[at:e] in vocab), None)
            if end is None:
                at += 1
                continue
            ids.append(vocab[head + word[at:end]])
            at, known = end, True
        if not known:
            ids.append(UNKNOWN)
    return [*ids, END]


def token_ids(text: Column, vocab: dict[str, int], length: int = LENGTH) -> Column:
    """Ids padded to ``length``; null for a null text."""

    @F.pandas_udf(ArrayType(LongType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            rows = (None if t is None else encode(t, vocab, length) for t in s)
            yield pd.Series([None if x is None else x + [PAD] * (length - len(x)) for x in rows], dtype=object)

    return ids(text)


def mask(ids: Column) -> Column:
    """1 for each id that isn't padding, as one word may never be id 0."""
    return F.transform(ids, lambda x: (x != PAD).cast("bigint"))


@lru_cache(2)
def _session(path: str):  # noqa: ANN202
    import onnxruntime

    return onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])


def softmax_rows(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def classified(ids: Column, model_path: str | None) -> Column:
    """Probability of class 1 under the model at model_path, one session a worker. No file: null, and only the patterns decide; a corrupt file is an error."""
    if not model_path or not os.path.exists(model_path):
        return F.lit(None).cast("double")

    @F.pandas_udf(DoubleType())
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _session(model_path)
        names = [i.name for i in model.get_inputs()]
        for s in batches:
            known = s[s.notna()]
            out = pd.Series(np.nan, index=s.index)
            if len(known):
                x = np.vstack(known.to_list()).astype(np.int64)
                feed = {n: (x != PAD).astype(np.int64) if "mask" in n else x for n in names}
                out[known.index] = softmax_rows(model.run(None, feed)[0])[:, 1]
            yield out

    return scores(ids)
