"""One consistent form for texts that look the same but differ in their characters.

1. Characters that show nothing are deleted; width, presentation forms, joined letters and kinds of blanks are brought
   to their plain form (compatibility normalization without what looks different: superscripts, fractions, circled
   signs); letters and accents are composed in one way.
2. Every word becomes a lattice: each letter stands for all letters that look like it in the scripts of ``TWINS``.
   Viterbi search finds the path with the best character n-gram score, where a change of script within a word costs
   ``SWITCH``; the n-gram counts of each script are taken from all words of the table that can only be of one script.

Words that look the same span the same lattice and so end on the same path: equal forms are exactly equal looks, while
a word keeps the script in which it makes sense.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palisade.session import written

# A Latin letter and the letter of the same look in another script.
TWINS = {
    "cyrillic": "aа cс dԁ eе hһ iі jј lӏ oо pр qԛ sѕ wԝ xх yу AА BВ CС EЕ HН IІ JЈ KК MМ OО PР SЅ TТ XХ YУ",
    "greek": "oο pρ vν AΑ BΒ EΕ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ XΧ YΥ ZΖ",
    "armenian": "hհ nո oօ uս",
    "cherokee": "AᎪ BᏴ CᏟ DᎠ EᎬ GᏀ HᎻ JᎫ KᏦ LᏞ MᎷ PᏢ SᏚ TᎢ VᏙ WᎳ ZᏃ",
}
# Letters of one script that look the same.
ALIKE = {"ɡ": "g", "ɑ": "a"}
SCRIPTS = ("latin", *TWINS)
#: Cost of another script within a word, against log probabilities.
SWITCH = 14.0
#: Log probability of a pair that a script's words never show.
UNSEEN = -12.0
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​‎‏⁠-⁤⁪-⁯ㅤ︀-️﻿ﾠ]|(?<![؀-෿☀-➿\U0001f000-\U0001faff])[‌‍]|[‌‍](?![؀-෿☀-➿\U0001f000-\U0001faff])")
_KINDS = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
_WORD = re.compile(r"(?:[^\W_][̀-ͯ]*)+")


def _plain_char(c: str) -> str:
    """Width, presentation form, joined letter or kind of blank removed."""
    if unicodedata.category(c) == "Zs":
        return " "
    if c in "‐‑":
        return "-"
    kind, *points = unicodedata.decomposition(c).split() or [""]
    if kind in _KINDS or kind == "<compat>" and len(points) > 1 and c != "ŉ" and all(chr(int(p, 16)).isalpha() for p in points):
        return unicodedata.normalize("NFKC", c)
    return c


class _PlainChars(dict):
    def __missing__(self, code: int) -> str:
        self[code] = out = _plain_char(chr(code))
        return out


_PLAIN = _PlainChars()


def plain(text: str) -> str:
    """Step 1: no invisible characters, no compatibility forms, decomposed."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", _INVISIBLE.sub("", text).translate(_PLAIN))


def _lattice() -> dict[str, dict[str, str]]:
    """Letter -> {script: the letter of this look in it}."""
    looks: dict[str, dict[str, str]] = {}
    for script, row in TWINS.items():
        for latin, twin in row.split():
            looks.setdefault(latin, {"latin": latin})[script] = twin
    lattice = {c: same for same in looks.values() for c in same.values()}
    return lattice | {c: lattice.get(plain, {"latin": plain}) for c, plain in ALIKE.items()}


LOOKS = _lattice()
_BLOCKS = (("latin", "A", "ɏ"), ("greek", "Ͱ", "Ͽ"), ("cyrillic", "Ѐ", "ԯ"), ("armenian", "԰", "֏"), ("cherokee", "Ꭰ", "\u13ff"))


def _script(c: str) -> str:
    return next((s for s, a, b in _BLOCKS if a <= c <= b), "other")


_TWIN = "".join(sorted(c for c in LOOKS if c.isascii()))
#: Words of ASCII texts that could be of another script altogether; all other ASCII words stand for themselves.
_OPEN_ASCII = re.compile(f"(?<![A-Za-z0-9])[0-9]*[{_TWIN}][{_TWIN}0-9]*(?![A-Za-z0-9])")


def _pairs(texts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bigrams of the words that can be of one script only, by script; two blanks stand for the edges of a word."""
    words: Counter[str] = Counter()
    pairs: Counter[tuple[str, str, str]] = Counter()

    def fold() -> None:
        for w, n in words.items():
            scripts = {_script(c) for c in w if c.isalpha()}
            if len(scripts) == 1 and any(c.isalpha() and c not in LOOKS for c in w):
                s, low = scripts.pop(), f" {w.lower()} "
                for a, b in zip(low, low[1:]):
                    pairs[s, a, b] += n
        words.clear()

    for batch in texts:
        for t in batch["text"]:
            words.update(_WORD.findall(plain(t)))
        if len(words) > 200_000:
            fold()
    fold()
    yield pd.DataFrame([(*k, n) for k, n in pairs.items() if k[0] in SCRIPTS], columns=["script", "a", "b", "n"])


def fit(texts: DataFrame) -> dict[str, dict[tuple[str, str], float]]:
    """Bigram log probabilities of each script over all rows of texts(text). What reaches the driver is bounded by the pairs of letters of four alphabets."""
    rows = texts.select("text").mapInPandas(_pairs, "script string, a string, b string, n bigint").groupBy("script", "a", "b").agg(F.sum("n").alias("n")).collect()
    model: dict[str, dict[tuple[str, str], float]] = {s: {} for s in SCRIPTS}
    total = Counter()
    before: Counter[tuple[str, str]] = Counter()
    for r in rows:
        before[r.script, r.a] += r.n
        total[r.script] += r.n
    for r in rows:
        model[r.script][r.a, r.b] = max(UNSEEN, math.log(r.n / before[r.script, r.a]))
    for s in SCRIPTS:
        model[s]["", "#"] = math.log((total[s] + 1) / (sum(total.values()) + len(SCRIPTS)))  # the script's share
    return model


def reader(model: dict[str, dict[tuple[str, str], float]]) -> Callable[[str], str]:
    """The function from a text to its consistent form."""
    known: dict[str, str] = {}

    def score(s: str, a: str, b: str) -> float:
        return model[s].get((a, b), UNSEEN)

    def search(word: str) -> str:
        """The best path through the lattice of a decomposed word; accents and digits belong to any script."""
        best: dict[str, tuple[float, str, str]] = {}
        for c in word:
            if not c.isalpha() or c not in LOOKS and _script(c) == "other":
                best = {s: (v, p + c, last) for s, (v, p, last) in best.items()} or {s: (model[s]["", "#"], c, " ") for s in SCRIPTS}
                continue
            options = LOOKS.get(c) or {_script(c): c}
            start = best or {s: (model[s]["", "#"], "", " ") for s in SCRIPTS}
            step = {}
            for s, letter in options.items():
                low = letter.lower()
                step[s] = max((v - SWITCH * (s != t) + score(s, last if s == t else " ", low), p + letter, low) for t, (v, p, last) in start.items())
            best = step
        return max((v + (score(s, last, " ") if last != " " else 0), p) for s, (v, p, last) in best.items())[1]

    def word(m: re.Match[str]) -> str:
        w = m[0]
        out = known.get(w)
        if out is None:
            # the lattice, not the spelling, is searched: its Latin letter names it
            out = search("".join(LOOKS[c]["latin"] if c in LOOKS else c for c in w))
            if len(known) > 300_000:
                known.clear()
            known[w] = out
        return out

    def read(text: str) -> str:
        if text.isascii():
            return _OPEN_ASCII.sub(word, text)
        return unicodedata.normalize("NFC", _WORD.sub(word, plain(text)))

    return read


def _digest(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def read_looks(df: DataFrame, space: str, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(forms, members): forms has space, raw (a digest of the text) and form, one row for each distinct text; members has space, id and raw, one row for each record.

    Rows with one (space, key) are one record; null texts or keys are none. An empty text is its own form. Byte-identical
    texts are read once.
    """
    rows = df.select(F.col(space).alias("space"), F.col(key).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL AND id IS NOT NULL")
    members = rows.select("space", "id", _digest(F.col("text")).alias("raw")).dropDuplicates(["space", "id"])
    texts = written(rows.select("space", "text").distinct(), "writings")
    model = fit(texts)

    @F.pandas_udf(StringType())
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = reader(model)
        for s in batches:
            yield s.map(one)

    forms = written(texts.select("space", _digest(F.col("text")).alias("raw"), read("text").alias("form")), "forms")
    return forms, members


def record_forms(forms: DataFrame, members: DataFrame) -> DataFrame:
    """space, id, form of every record."""
    return members.join(forms, ["space", "raw"]).select("space", "id", "form")


def _varied(forms: DataFrame) -> DataFrame:
    """space, raw and look (a digest of the form) of the texts that read like another."""
    several = forms.groupBy("space", "form").agg(F.count("*").alias("n")).where("n > 1").select("space", _digest(F.col("form")).alias("look"))
    return forms.select("space", "raw", _digest(F.col("form")).alias("look")).join(several, ["space", "look"])


def look_classes(forms: DataFrame, members: DataFrame) -> DataFrame:
    """space, id, class_id and n_links of every record that reads like a differently written one.

    class_id: the smallest id of those that read the same; n_links: how many records of the class are written otherwise.
    Copies aren't expanded into pairs: a class of n records has n rows.
    """
    per_raw = members.groupBy("space", "raw").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    looks = _varied(forms).join(per_raw, ["space", "raw"])
    whole = looks.groupBy("space", "look").agg(F.sum("n").alias("all"), F.min("first").alias("class_id"))
    of_raw = looks.join(whole, ["space", "look"]).select("space", "raw", "class_id", (F.col("all") - F.col("n")).alias("n_links"))
    return members.join(of_raw, ["space", "raw"]).select("space", "id", "class_id", "n_links")


def look_pairs(forms: DataFrame, members: DataFrame) -> DataFrame:
    """space, first_id and second_id: the classes expanded into every two records of a space whose texts differ but look the same.

    Pairs are formed between differing writings and only then carried to the records that hold them, so records that
    agree byte for byte never meet.
    """
    varied = _varied(forms)
    two = varied.alias("a").join(varied.alias("b"), ["space", "look"]).where("a.raw < b.raw").select("space", F.col("a.raw").alias("raw"), F.col("b.raw").alias("other"))
    first = two.join(members, ["space", "raw"]).select("space", F.col("other").alias("raw"), F.col("id").alias("one"))
    return first.join(members, ["space", "raw"]).select("space", F.least("one", "id").alias("first_id"), F.greatest("one", "id").alias("second_id"))


def same_looks(df: DataFrame, space: str, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(forms, pairs): the form of every record, and ``look_pairs``."""
    forms, members = read_looks(df, space, key, text)
    return record_forms(forms, members), look_pairs(forms, members)
