"""Copies that differ only in how they are written.

Byte-identical texts collapse first, with map-side partials, so a text written a billion times is canonicalised once;
only the distinct survivors are canonicalised, and these are grouped again on their full canonical text, adding up the
counts. Group members are found again over 32-byte digests, never by moving texts twice.

Canonical form: without whitespace, letter case (full folding) and punctuation (Unicode P*). A JSON object or list is
parsed, the fields of every object are put in order of their own canonical form at any depth, and lists keep theirs;
escapes stand for their characters and numbers keep their digits as written. A form body ``name=value&name=value``
has its fields in order. Any other character counts, order of words included.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palisade.session import written

_SPACE = "[\\p{IsWhite_Space}\\x1c-\\x1f]+"
_FORM = "^[^=&]+=[^=&]*(&[^=&]+=[^=&]*)+$"


@lru_cache(100_000)
def _dropped(c: str) -> bool:
    return c.isspace() or category(c)[0] == "P"


_WORDS = re.compile(r"[^a-z0-9]+")


def _bare(s: str) -> str:
    return _WORDS.sub(lambda m: "".join(c for c in m[0] if not _dropped(c)), s)


def _value(v: object) -> str:
    if isinstance(v, str):
        return _bare(v)
    if isinstance(v, list):
        return "".join(map(_value, v))
    return {None: "null", True: "true", False: "false"}[v]


class _Object(str):
    """Canonical form of an object: already bare."""


def _in_order(fields: list[tuple[str, object]]) -> str:
    return _Object("".join(sorted(_bare(k) + (v if isinstance(v, _Object) else _value(v)) for k, v in fields)))


def json_form(text: str) -> str | None:
    """Canonical form of a JSON object or list, None if text is neither."""
    try:
        found = json.loads(text.casefold(), object_pairs_hook=_in_order, parse_int=str, parse_float=str, parse_constant=str, strict=False)
        form = found if isinstance(found, _Object) else _value(found)
        form.encode()  # a lone surrogate from an escape has no UTF-8 form
        return str(form)
    except (ValueError, RecursionError, KeyError):
        return None


@F.pandas_udf(StringType())
def _json_forms(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: json_form(t) if t is not None else None).astype(object)


def canonical(text: Column) -> Column:
    """Canonical form of a column of texts; only what looks like JSON leaves the JVM."""
    # upper, then lower: full folding, with sharp s as ss. Side by side, the optimizer would leave out the first
    tight = F.lower(F.regexp_replace(F.upper(text), _SPACE, ""))
    bare = lambda c: F.regexp_replace(c, "\\p{P}+", "")
    # a list or object is also recognised if it doesn't end well: then the parser says no and the text is taken as it is
    parsed = _json_forms(F.when(tight.rlike("^(\\{.*\\}|\\[.*\\])$"), text))
    form = F.array_join(F.array_sort(F.transform(F.split(tight, "&"), bare)), "")
    return F.coalesce(parsed, F.when(tight.rlike(_FORM), form), bare(tight))


def _digest(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def copy_sets(df: DataFrame, space: str, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(contents, members): contents has space, keep_id and n_copies, one row for each distinct content within a space;
    members has space, keep_id and copy_id, one row for each id of a content that more than one row has, keep_id itself included.

    space: names the table a record is of; records of two spaces are never copies. Rows with one (space, key) are one
    record. A null text or key is no record; an empty text, or one of whitespace and punctuation alone, is a content
    like any other. An empty table gives no rows. Other columns play no part.
    """
    rows = df.select(F.col(space).alias("space"), F.col(key).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL AND id IS NOT NULL")
    # an id that is there several times is one record: how often it came again is taken off its content's count
    members = rows.groupBy("space", "id").agg(F.min(_digest(F.col("text"))).alias("raw"), F.count("*").alias("times"))
    survivors = rows.groupBy("space", "text").agg(F.min("id").alias("first_id"), F.count("*").alias("n_rows"))
    forms = written(survivors.select("space", _digest(F.col("text")).alias("raw"), "first_id", "n_rows", canonical(F.col("text")).alias("form")), "copies")
    content_of = forms.select("space", "raw", _digest(F.col("form")).alias("content"))
    again = members.where("times > 1").groupBy("space", "raw").agg(F.sum(F.col("times") - 1).alias("again"))
    again = again.join(content_of, ["space", "raw"]).groupBy("space", "content").agg(F.sum("again").alias("again"))
    contents = forms.groupBy("space", "form").agg(F.min("first_id").alias("keep_id"), F.sum("n_rows").alias("n_rows"))
    contents = contents.select("space", _digest(F.col("form")).alias("content"), "keep_id", "n_rows").join(again, ["space", "content"], "left")
    contents = contents.select("space", "content", "keep_id", (F.col("n_rows") - F.coalesce("again", F.lit(0))).alias("n_copies"))
    # a content with one record is its own only member: it needs no join
    of_raw = content_of.join(contents.where("n_copies > 1"), ["space", "content"]).select("space", "raw", "keep_id")
    found = members.select("space", "id", "raw").join(of_raw, ["space", "raw"]).select("space", "keep_id", F.col("id").alias("copy_id"))
    return contents.select("space", "keep_id", "n_copies"), found
