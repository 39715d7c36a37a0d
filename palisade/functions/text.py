"""Text detectors as column expressions: they stay inside the JVM and need no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import patterns as P


def any_of(c: Column, patterns: list[str] | str, low: Column | None = None) -> Column:
    """Whether any of patterns is found. The regex is tried only on texts that have one of the words no match can do without. low: c in lower case, where it is at hand."""
    words = P.needed(patterns)
    if words is None:
        return c.rlike(P.java(patterns))
    # letters that Java matches with ASCII ones where case makes no difference, and that lower() leaves as they are
    words = [*words, "ſ", "ı", "i\u0307"]
    has = lambda x: F.exists(F.lit(words), lambda w: x.contains(w))
    some = has(low) if low is not None else F.element_at(F.transform(F.array(F.lower(c)), has), 1)
    return F.when(some, c.rlike(P.java(patterns))).when(c.isNotNull(), F.lit(False))


def has_char(c: Column, chars: str) -> Column:
    """Whether any of chars, none of them ASCII, is in c."""
    return F.when(F.octet_length(c) == F.length(c), F.lit(False)).otherwise(F.translate(c, chars, "") != c)


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else. The parser stops after the first value, so the text is also looked at as an element and as a field."""
    element = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    one = F.try_variant_get(element, "$[0]", "variant").isNotNull() & F.try_variant_get(element, "$[1]", "variant").isNull()
    return F.coalesce(one & F.try_parse_json(F.concat(F.lit('{"_":'), text, F.lit("}"))).isNotNull(), F.lit(False))


def compact(body: Column) -> Column:
    """A JSON object or list without blanks and with its keys in order at any depth; any other body as it is. Numbers are written in their shortest form."""
    return F.when(body.rlike("^\\s*[{\\[]"), F.when(is_json(body), F.to_json(F.try_parse_json(body))).otherwise(body)).otherwise(body)


def content(path: Column, query: Column, body: Column) -> Column:
    """path, query and body on lines of their own; a missing path, query or body has none. A JSON body is compact."""
    return F.concat(F.coalesce(path, F.lit("")), F.lit("\n"), F.coalesce(F.concat(query, F.lit("\n")), F.lit("")), F.coalesce(compact(body), F.lit("")))


def text_content(body: Column) -> Column:
    """The text of a body: for a JSON object, the first present of content, text, body and title if it is a string, else none; for other bodies the body."""
    keys = F.json_object_keys(body)
    value = F.parse_json(F.when(keys.isNotNull(), body))
    pick = F.lit(None).cast("string")
    for k in ("title", "body", "text", "content"):
        v = F.try_variant_get(value, f"$.{k}", "string")
        is_text = F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant")) == "STRING"
        pick = F.when(F.array_contains(keys, k), F.when(is_text, v)).otherwise(pick)
    return F.when(keys.isNotNull(), pick).otherwise(body)


def injection_type(c: Column, low: Column | None = None) -> Column:
    """direct, recursive or indirect, whichever is found first in this order; null if none is."""
    return F.when(any_of(c, P.DIRECT, low), "direct").when(any_of(c, P.RECURSIVE, low), "recursive").when(any_of(c, P.INDIRECT, low), "indirect")


def hits(c: Column, patterns: list[str]) -> Column:
    """How many of patterns are found."""
    return reduce(lambda a, b: a + b, [any_of(c, p).cast("int") for p in patterns])


def injection_confidence(c: Column) -> Column:
    return F.when(any_of(c, P.DIRECT + P.RECURSIVE + P.INDIRECT), F.least(F.lit(1.0), hits(c, P.DIRECT) * 0.3 + hits(c, P.RECURSIVE) * 0.4 + hits(c, P.INDIRECT) * 0.2)).otherwise(0.0)


def families(c: Column, low: Column | None = None) -> Column:
    """Names of the suspicious families found, in their order."""
    return F.array_compact(F.array(*[F.when(any_of(c, p, low), F.lit(n)) for n, p in P.FAMILIES.items()]))


def weighed(names: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the names, added in the order of weights."""
    return reduce(lambda a, b: a + b, [F.when(F.array_contains(names, n), F.lit(w)).otherwise(0.0) for n, w in weights.items()])


def pattern_score(names: Column, strict: bool = False) -> Column:
    return F.least(F.lit(1.0), weighed(names, P.FAMILY_WEIGHT) * (1.2 if strict else 1.0))


def toxic_categories(c: Column, low: Column | None = None) -> Column:
    return F.array_compact(F.array(*[F.when(any_of(c, p, low), F.lit(n)) for n, (_, p) in P.TOXIC.items()]))


def toxicity(categories: Column) -> Column:
    return F.least(F.lit(1.0), weighed(categories, {n: w for n, (w, _) in P.TOXIC.items()}))


def unsafe_output(c: Column, low: Column | None = None) -> Column:
    """Name of the first unsafe construct, null if there is none."""
    found = F.lit(None).cast("string")
    for name, p in reversed(P.UNSAFE_OUTPUT.items()):
        found = F.when(any_of(c, p, low), name).otherwise(found)
    return found


def base64_hidden(c: Column) -> Column:
    """Whether a run of base64, strictly encoded UTF-8 text, hides suspicious words."""

    def suspicious(run: Column) -> Column:
        raw = F.try_to_binary(run, F.lit("base64"))
        text = F.lower(F.try_validate_utf8(raw.cast("string")))
        words = reduce(lambda a, b: a | b, [text.contains(w) for w in P.DECODED_WORDS])
        return F.coalesce((F.base64(raw) == run) & ((text.contains("ignore") & text.contains("instruction")) | words), F.lit(False))

    return F.when(c.rlike(P.BASE64_RUN), F.exists(F.regexp_extract_all(c, F.lit(f"({P.BASE64_RUN})"), 1), suspicious)).otherwise(False)


def encoding_attacks(c: Column) -> Column:
    """Disguises found, in their order."""
    return F.array_compact(
        F.array(
            F.when(base64_hidden(c), F.lit("Base64Obfuscation")),
            F.when(has_char(c, P.HOMOGLYPHS[0]), F.lit("UnicodeHomoglyph")),
            F.when(has_char(c, P.chars(P.INVISIBLE)), F.lit("InvisibleChars")),
            F.when(c.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]"), F.lit("ControlChars")),
            F.when(has_char(c, P.chars(P.BIDI)), F.lit("RtlOverride")),
        )
    )


def normalized(c: Column) -> Column:
    """Without invisible and direction marks, look-alikes as ASCII."""
    return F.translate(c, P.HOMOGLYPHS[0] + P.chars(P.INVISIBLE + P.BIDI), P.HOMOGLYPHS[1])


def with_neural(df: DataFrame, content: str, flags: str = "flags", score: str = "neural_score") -> DataFrame:
    """Adds flags and score of the text layer. Each detector runs once, as a column of its own that flags and score are made of."""
    c, low = F.col(content), F.col("_low")
    found = df.withColumn("_low", F.lower(c)).withColumns({"_attacks": encoding_attacks(c), "_families": families(c, low), "_kind": injection_type(c, low), "_toxic": toxic_categories(c, low), "_unsafe": unsafe_output(c, low).isNotNull()})
    attacks, suspicious, kind, unsafe = F.col("_attacks"), F.col("_families"), F.col("_kind"), F.col("_unsafe")
    toxic = toxicity(F.col("_toxic"))
    is_toxic = toxic >= P.TOXIC_FROM
    named = F.when(kind == "direct", "DirectInjection").when(kind == "indirect", "IndirectInjection").when(kind == "recursive", "RecursiveInjection")
    all_flags = F.concat(attacks, suspicious, F.array_compact(F.array(named, F.when(is_toxic, F.lit("ToxicContent")), F.when(unsafe, F.lit("MaliciousLLMOutput")))))
    risk = weighed(attacks, P.ENCODING_RISK) + weighed(suspicious, P.FAMILY_RISK)
    risk = risk + F.when(kind == "direct", 0.9).when(kind == "indirect", 0.7).when(kind == "recursive", 0.95).otherwise(0.0)
    risk = risk + F.when(is_toxic, toxic * 0.5).otherwise(0.0) + F.when(unsafe, 0.95 * 0.8).otherwise(0.0)
    return found.withColumns({flags: all_flags, score: F.least(F.lit(1.0), risk)}).drop("_low", "_attacks", "_families", "_kind", "_toxic", "_unsafe")


def level(score: Column) -> Column:
    """Level of a layer's or of the total score."""
    return F.when(score >= 0.8, "critical").when(score >= 0.6, "high").when(score >= 0.4, "medium").when(score >= 0.2, "low").otherwise("none")


def session_id(auth: Column, cookie: Column, header: Column) -> Column:
    """Session by bearer token, else by cookie, else by header; null if there is none."""
    token = F.when(auth.startswith("Bearer "), F.concat(F.lit("jwt:"), F.substr(auth, F.lit(8))))
    baked = F.regexp_extract(cookie, "(?:^|;)\\s*(?:session|sid)=([^;]*)", 1)
    by_cookie = F.when(cookie.rlike("(?:^|;)\\s*(?:session|sid)="), F.concat(F.lit("cookie:"), F.trim(baked)))
    return F.coalesce(token, by_cookie, F.concat(F.lit("header:"), header))


def agent_key(auth: Column, agent_id: Column) -> Column:
    return F.coalesce(F.when(auth.startswith("Bearer "), F.concat(F.lit("token:"), F.substr(auth, F.lit(8)))), F.when(agent_id != "", agent_id))


def path_shape(path: Column) -> Column:
    """Path with identifiers left out: UUIDs in lower case, then numbers."""
    ids = F.regexp_replace(path, "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "{id}")
    return F.regexp_replace(ids, "/[0-9]+", "/{num}")


def body_shape(body: Column) -> Column:
    """Top-level keys of a JSON object in order, else empty."""
    return F.coalesce(F.array_join(F.array_sort(F.json_object_keys(body)), ","), F.lit(""))
