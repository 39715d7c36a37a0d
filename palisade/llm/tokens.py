"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Vocabulary file: ranks of byte-level BPE (``.tiktoken``), or a file of the ``tokenizers`` library (``.json``).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public byte-level BPE divides a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are encoded in lots of this many characters, so that long ones don't add up in memory.
LOT = 4_000_000


@lru_cache(2)
def _counter(path: str) -> Callable[[list[str]], list[int]]:
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding(path, pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]


def token_counts(texts: list[str], path: str = TOKENIZER) -> list[int]:
    count, out, lot, n = _counter(path), [], [], 0
    for x in [*texts, None]:
        if lot and (x is None or n + len(x) > LOT):
            out += count(lot)
            lot, n = [], 0
        if x is not None:
            lot.append(x)
            n += len(x)
    return out


def n_tokens(text: Column, path: str = TOKENIZER) -> Column:
    """Number of tokens of a text; a null text has none."""

    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(token_counts(s.fillna("").tolist(), path), dtype="int64")

    return count(text)
