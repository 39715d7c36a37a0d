"""Sentence boundaries across languages and scripts, in SQL expressions alone.

Every step replaces one character by one character, so that positions stay those of the source: full stops that end
nothing (decimals, versions, addresses and file names, initials, abbreviations, marks within quotes, brackets,
headings and list items) become private-use placeholders; what terminators are left end a sentence by the rule of
their script. A sentence's text is the slice of the source between its positions, which restores all placeholders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.session import spread

#: Placeholders: a mark that ends nothing, one within a quote, one within brackets; a boundary between sentences; a blank within a quote or brackets.
MASK, QUOTED, BRACKETED, CUT, HELD = "\ue000", "\ue002", "\ue003", "\ue001", "\ue004"
_ENDS = ".!?…。！？｡؟।॥۔։።။៕។༎།"
_WS = "[\\p{IsWhite_Space}\\x1c-\\x1f]"
#: Opening and closing marks of quotes; straight ones are told apart by what is beside them.
_QUOTES = (("“", "”"), ("«", "»"), ("「", "」"), ("『", "』"), ("„", "“"), ("‘", "’"))
_BRACKETS = (("(", ")"), ("（", "）"), ("[", "]"))

# Abbreviations before which a sentence never ends, by language.
NEVER = {
    "en": "dr mr mrs ms prof rev gen capt sgt lt st mt ver vs cf e.g i.e approx avg est dept fig figs eq sec ch vol vols pp ed eds resp incl viz",
    "de": "abb ggü gem geb nr bd kap ca bzw z.b d.h u.a v.a z.t s.o s.u o.ä i.d.r hrsg evtl ggf vgl inkl zzgl hr str dipl ing sog",
    "es": "aprox pág págs núm núms cap sra sr srta dra d dña tel p.ej ee art avda",
    "fr": "env p.ex c.-à-d éd mme mlle mm av bd chap n.b",
    "ru": "рис стр см напр т.е ок гл п проф д-р тыс млн им ул табл ср акад",
    "hi": "डॉ श्री क्र पृ प्रो सं",
    "ar": "د أ ص",
    "th": "ดร ศ ผศ รศ พ.ศ ค.ศ น.ส ร.ต.อ",
}
# Abbreviations that end a sentence where a capital, or a word that opens sentences, follows.
MAYBE = {
    "en": "etc a.m p.m inc ltd corp co jr ph.d al dept no",
    "de": "usw u.s.w ff u.ä etc",
    "es": "uu etc cía s.a",
    "fr": "etc s.a",
    "ru": "т.д т.п др г гг руб в",
}
# Months, after an ordinal number with a full stop.
_MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jänner"
_OPENERS = "he|she|they|we|it|you|nobody|someone|everyone"


def _words(table: dict[str, str]) -> str:
    """Alternation of abbreviations; a stop within one may be masked already and be followed by a blank."""
    words = sorted({w for row in table.values() for w in row.split()}, key=lambda w: (-len(w), w))
    return "|".join(w.replace(".", f"[.{MASK}]\\s?") for w in words)


def _heads() -> str:
    """Alternation of the parts of abbreviations of several, before the part that follows."""
    parts = sorted({(a, b) for row in (*NEVER.values(), *MAYBE.values()) for w in row.split() for a, b in zip(w.split("."), w.split(".")[1:])})
    return "|".join(f"(?<=(?<![\\p{{L}}\\p{{M}}]){a}\\.)(?=\\s?{b}\\.)" for a, b in parts)


def _where(c: Column, mark: str, step: Callable[[Column], Column]) -> Column:
    """step where mark occurs at all; c is evaluated once."""
    return F.element_at(F.transform(F.array(c), lambda x: F.when(x.contains(mark), step(x)).otherwise(x)), 1)


def _inside(c: Column, start: str, stop: str, marks: str, to: str, opener: str | None = None, closer: str | None = None, within: str = "") -> Column:
    """Marks between start and the next stop of the same paragraph, however far, become ``to``; \\G carries on from one mark to the next.

    closer: what of stop closes; within: what of stop doesn't, and may stand between.
    """
    between = start + stop if start != stop else stop
    some = lambda but, greed: f"(?:[^{between}{but}{CUT}]{'|' + within if within else ''})*{greed}" if within else f"[^{between}{but}{CUT}]*{greed}"
    return F.regexp_replace(c, f"((?:{opener or f'[{start}]'}(?={some('', '+')}{closer or f'[{stop}]'})|(?!^)\\G){some(marks, '')})[{marks}]", f"$1{to}")


def marked(text: Column) -> Column:
    """text with placeholders and a CUT after every sentence."""
    sub = F.regexp_replace
    m = F.translate(text, f"{MASK}{CUT}{QUOTED}{BRACKETED}{HELD}", "xxxxx")
    # headings and list items: one sentence whatever is in them, its mark included
    m = sub(m, "(?m)^([ \\t]*\\(?\\d{1,3})\\.(?=[ \\t]+\\S)", f"$1{MASK}")
    line = f"(?m)^[ \\t]*(?:#{{1,6}}|[-*•‣▪◦·–—]|\\(?(?:\\d{{1,3}}[){MASK}]|\\p{{L}}\\)))[ \\t]+(?=\\S)"
    m = sub(m, f"((?:{line}|(?!^)\\G)[^\\n{_ENDS}]*)[{_ENDS}]", f"$1{MASK}")
    m = sub(m, f"(?m)({line}.*)$", f"{CUT}$1{CUT}")
    m = sub(m, "(\\n[ \\t\\r]*\\n)", f"{CUT}$1")
    # decimals, addresses, file names
    m = sub(m, "(?<=[\\d\\s(])\\.(?=\\d)", MASK)
    m = sub(m, "((?:https?://|www\\.|(?<![\\p{L}\\d/])/(?=[\\p{L}\\d])|(?!^)\\G)[^\\s.!?{C}]*)[.!?](?=[\\p{Ll}\\d/=&%#_-])".replace("{C}", CUT), f"$1{MASK}")
    m = sub(m, "(?<=[\\p{L}\\p{M}\\d_])\\.(?=[\\p{Ll}\\d_-])", MASK)
    # initials and acronyms
    m = sub(m, f"(?<![\\p{{L}}\\p{{M}}\\d.{MASK}])(\\p{{Lu}})\\.(?=[ \\u00a0\\n]?\\p{{Lu}})", f"$1{MASK}")
    m = sub(m, f"(?<=[.{MASK}])(\\p{{Lu}})\\.(?=\\p{{L}}|\\s+[\\p{{Ll}}\\d])", f"$1{MASK}")
    # abbreviations
    m = sub(m, f"(?iu)\\.(?:{_heads()})", MASK)
    m = sub(m, f"(?iu)\\.(?<=(?<![\\p{{L}}\\p{{M}}])(?:{_words(NEVER)})\\.)(?=[\\s\\p{{L}}\\d])", MASK)
    m = sub(m, "(?iu)(?<![\\p{IsLatin}\\p{IsCyrillic}\\p{M}])(no|nos|art|p|s)\\.(?=\\s*\\d)", f"$1{MASK}")
    m = sub(m, f"(?u)\\.(?<=(?<![\\p{{L}}\\p{{M}}])(?i:{_words(MAYBE)})\\.)(?=\\s+[^\\p{{Lu}}\\s¿¡{CUT}]|\\s*[,;:)])(?!\\s+(?:{_OPENERS})\\b)", MASK)
    m = sub(m, f"(?<![\\p{{L}}\\d.,{MASK}])(\\d{{1,2}})\\.(?=\\s+(?:{_MONTHS})\\b)", f"$1{MASK}")
    # dots that trail off within a sentence
    m = sub(m, "……", MASK * 2)
    m = sub(m, f"(\\s)…(?=\\s)", f"$1{MASK}")
    m = sub(m, f"\\.\\.\\.(?=\\s+[^\\p{{Lu}}\\s¿¡«“\"(#{CUT}])", MASK * 3)
    m = sub(m, f"…(?=\\s+[^\\p{{Lu}}\\s¿¡«“\"(#{CUT}])", MASK)
    # quotes and brackets
    for a, b in _QUOTES:
        m = _where(m, a, lambda x, a=a, b=b: _inside(x, a, b, _ENDS, QUOTED))
    m = _where(m, '"', lambda x: _inside(x, '"', '"', _ENDS, QUOTED, '(?<=^|[\\s(\\[{])"(?=\\S)'))
    m = _where(m, "'", lambda x: _inside(x, "'", "'", _ENDS, QUOTED, "(?<=^|[\\s(\\[{])'(?=\\S)", "'(?!\\p{L})", "(?<=\\p{L})'(?=\\p{L})"))
    for a, b in _BRACKETS:
        m = _where(m, a, lambda x, a=a, b=b: _inside(x, f"\\{a}", f"\\{b}", _ENDS + QUOTED, BRACKETED))
    # boundaries
    closers = "[\"'”’»」』）)\\]]"
    m = sub(m, f"([。！？｡።]+{closers}*)", f"$1{CUT}")
    m = sub(m, f"([।॥؟။៕។།༎]+[!?]*)(?!{closers})", f"$1{CUT}")
    m = sub(m, f"([.!?…۔։]+{closers}*)(?=\\s|$)", f"$1{CUT}")
    m = sub(m, "(?<=[\\p{L}\\p{M}\\d)])([!?]+)(?=[\\p{Lu}¿¡])", f"$1{CUT}")
    m = sub(m, "(?<=\\p{Ll}{2})\\.(?=\\p{Lu}\\p{Ll})", f".{CUT}")
    m = sub(m, f"([:：]\\s{{0,3}}[“«「『„\"'‘]\\s?[^“”«»「」『』\"\\n{CUT}]*{QUOTED}\\s?[”»」』“\"'’])(?=\\s|$|[^\\p{{P}}\\p{{ASCII}}]|[“「『（《«])", f"$1{CUT}")
    m = sub(m, f"({QUOTED}\\s?[”»」』“\"'’])(?=\\s+[\\p{{Lu}}¿¡])", f"$1{CUT}")
    m = sub(m, f"((?:^|{CUT}|(?!^)\\G)\\s*[(（\\[][^()（）\\[\\]{CUT}]*{BRACKETED}[)）\\]])", f"$1{CUT}")
    # scripts without a mark at the end of every sentence: Thai, between two words outside quotes and brackets
    held = lambda x: F.regexp_replace(F.regexp_replace(x, f"((?:“(?=[^“”{CUT}]*+”)|(?!^)\\G)[^“”\\s{CUT}]*)\\s", f"$1{HELD}"), f"((?:\\((?=[^()\\n{CUT}]*+\\))|(?!^)\\G)[^()\\s{CUT}]*)[^\\S\\n]", f"$1{HELD}")
    blank = lambda x: F.regexp_replace(held(x), "(?<=[\\u0e01-\\u0e45\\u0e47-\\u0e4e])(?=\\s+[\\u0e01-\\u0e5b])", CUT)
    m = F.element_at(F.transform(F.array(m), lambda x: F.when(x.rlike("[\\u0e01-\\u0e5b]"), blank(x)).otherwise(x)), 1)
    return m


#: Pieces whose places are added up at a time; a long document takes steps of the square of its pieces / BLOCK.
BLOCK = 64


def sentences(df: DataFrame, key: str, text: str, keep_text: bool = False) -> DataFrame:
    """doc_id, start_pos, end_pos (and the sentence's text) for every sentence of df's documents.

    Positions are 0-based in code points, the end exclusive. Together the sentences hold all of a document but white
    space: empty, blank and null documents have none. A very long document without any boundary is one sentence. A
    key that occurs twice gives its sentences twice. Other columns play no part, whatever their names. A quote or bracket, of
    whatever length, that isn't closed within its paragraph (up to a blank line, heading or list item) holds nothing together.
    """
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    pieces = spread(rows).select("doc_id", "text", F.split(marked(F.col("text")), CUT, -1).alias("p"))
    # places of blocks of pieces, then of pieces within a block
    blocks = F.transform(F.sequence(F.lit(0), F.expr(f"(size(p) - 1) div {BLOCK}")), lambda i: F.slice("p", i * BLOCK + 1, BLOCK))
    pieces = pieces.select("doc_id", "text", blocks.alias("blocks"))
    pieces = pieces.withColumn("starts", F.expr("aggregate(blocks, array(0), (a, b) -> array_append(a, element_at(a, -1) + length(array_join(b, ''))))"))
    one = pieces.select("doc_id", "text", F.explode(F.arrays_zip("blocks", "starts")).alias("b")).where("b.blocks IS NOT NULL").select("doc_id", "text", F.col("b.blocks").alias("p"), F.col("b.starts").alias("at"))
    one = one.withColumn("ends", F.expr("aggregate(p, array(at), (a, x) -> array_append(a, element_at(a, -1) + length(x)))"))
    flat = one.select("doc_id", "text", F.explode(F.arrays_zip("p", "ends")).alias("x")).select("doc_id", "text", F.col("x.p").alias("s"), F.col("x.ends").alias("at")).where(F.col("s").rlike("[^\\p{IsWhite_Space}\\x1c-\\x1f]"))
    n = F.length("s")
    lead = n - F.length(F.regexp_replace("s", f"^{_WS}+", ""))
    trail = n - F.length(F.regexp_replace("s", f"{_WS}+$", ""))
    out = flat.select("doc_id", (F.col("at") + lead).cast("bigint").alias("start_pos"), (F.col("at") + n - trail).cast("bigint").alias("end_pos"), *([F.col("text").alias("_text")] if keep_text else []))
    if keep_text:
        out = out.select("doc_id", "start_pos", "end_pos", F.expr("substring(_text, cast(start_pos + 1 as int), cast(end_pos - start_pos as int))").alias("sentence"))
    return out
