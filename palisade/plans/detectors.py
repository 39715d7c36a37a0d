"""Queries over the text detectors and request projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import patterns as P
from palisade.functions import text as X
from palisade.plans.common import C, R, codes, contents, found, quoted, requests

def _c() -> Column:
    return F.col("content")


def _over(**columns: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that gives request_id and columns of the content."""
    return lambda spark, d: contents(spark, d).select("request_id", *[f().alias(n) for n, f in columns.items()])


def write_predicate(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d, "method").select("request_id", F.col("method").isin("POST", "PUT", "PATCH", "DELETE").alias("is_write"))


def text_content(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d, "body")
    return r.select("request_id", X.text_content(F.col("body")).alias("text"), F.coalesce(F.octet_length("body"), F.lit(0)).alias("content_length"))


def session_id(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d, "auth_header", "cookie", "x_session_id")
    return r.select("request_id", X.session_id(F.col("auth_header"), F.col("cookie"), F.col("x_session_id")).alias("session_id"))


def agent_identity(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d, "auth_header", "agent_id")
    return r.select("request_id", X.agent_key(F.col("auth_header"), F.col("agent_id")).alias("agent"))


def path_normalize(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d, "path").groupBy(X.path_shape(F.col("path")).alias("shape")).agg(F.count("*").alias("n"))


def body_structure(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d, "body").select("request_id", X.body_shape(F.col("body")).alias("shape"))


def request_features(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d, "path", "query_string", "body", "method", "user_agent", "accept_language", "auth_header", "cookie", "x_session_id")
    headers = sum((F.col(c).isNotNull().cast("int") for c in ("user_agent", "accept_language", "auth_header", "cookie", "x_session_id")), F.lit(0))
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ("GET", "POST", "PUT", "DELETE", "PATCH"))), F.col("method")), F.lit(0)) - 1, F.lit(5))
    return r.select("request_id", F.octet_length("path").alias("path_length"), F.coalesce(F.size(F.split("query_string", "&")), F.lit(0)).alias("param_count"), F.coalesce(F.octet_length("body"), F.lit(0)).alias("body_size"), headers.alias("header_count"), order.cast("int").alias("method_ordinal"))


def match_details(spark: SparkSession, d: str) -> DataFrame:
    """First match of each pattern of the suspicious families: family, text, byte offsets."""
    c = contents(spark, d)
    rows = []
    for name, several in P.FAMILIES.items():
        for k, p in enumerate(several):
            regex = P.java(p)
            text = F.regexp_extract(_c(), regex, 0)
            start = F.octet_length(F.split(_c(), regex, 2)[0])
            rows.append(F.when(_c().rlike(regex), F.struct(F.lit(name).alias("family"), F.lit(k).alias("pattern"), text.alias("matched"), start.alias("start_byte"), (start + F.octet_length(text)).alias("end_byte"))))
    some = c.where(X.any_of(_c(), [p for several in P.FAMILIES.values() for p in several]))
    return some.select("request_id", F.explode(F.array_compact(F.array(*rows))).alias("m")).select("request_id", "m.*")


def neural_score(spark: SparkSession, d: str) -> DataFrame:
    scored = X.with_neural(contents(spark, d), "content").withColumn("neural_score", F.round("neural_score", 6))
    return scored.select("request_id", F.array_join("flags", ",").alias("flags"), "neural_score", X.level(F.col("neural_score")).alias("level"))


def neural_levels(spark: SparkSession, d: str) -> DataFrame:
    """Requests by level and first flag."""
    first = F.when(F.col("flags") != "", F.split("flags", ",")[0]).otherwise("none")
    return neural_score(spark, d).groupBy("level", first.alias("first_flag")).agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "content_projection": _over(content=_c, content_bytes=lambda: F.octet_length(_c())),
    "write_predicate": write_predicate,
    "text_content": text_content,
    "session_id": session_id,
    "agent_identity": agent_identity,
    "path_normalize": path_normalize,
    "body_structure": body_structure,
    "request_features": request_features,
    "encoding_flags": _over(attacks=lambda: F.array_join(X.encoding_attacks(_c()), ",")),
    "base64_obfuscation": _over(hidden=lambda: X.base64_hidden(_c())),
    "normalize_text": _over(normalized=lambda: X.normalized(_c())),
    "injection_type": _over(injection=lambda: X.injection_type(_c())),
    "injection_confidence": _over(confidence=lambda: F.round(X.injection_confidence(_c()), 6)),
    "pattern_families": _over(families=lambda: F.array_join(X.families(_c()), ",")),
    "pattern_score": _over(score=lambda: F.round(X.pattern_score(X.families(_c())), 6), strict_score=lambda: F.round(X.pattern_score(X.families(_c()), True), 6)),
    "toxicity": _over(categories=lambda: F.array_join(X.toxic_categories(_c()), ","), score=lambda: F.round(X.toxicity(X.toxic_categories(_c())), 6), is_toxic=lambda: X.toxicity(X.toxic_categories(_c())) >= P.TOXIC_FROM),
    "output_safety": _over(construct=lambda: X.unsafe_output(_c())),
    "match_details": match_details,
    "neural_score": neural_score,
    "neural_levels": neural_levels,
}


def _joined(pairs: list[tuple[str, str]]) -> str:
    """SQL: names whose condition holds, joined by commas in their order."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {cond} THEN '{n}' END" for n, cond in pairs) + ")"


def _sum(pairs: list[tuple[str, float]]) -> str:
    return " + ".join(f"CASE WHEN {cond} THEN {w}::DOUBLE ELSE 0 END" for cond, w in pairs)


_words = " OR ".join(f"contains(t, {quoted(w)})" for w in P.DECODED_WORDS)
_ENC = [
    ("Base64Obfuscation", "b64"),
    ("UnicodeHomoglyph", f"regexp_matches(content, '[{P.HOMOGLYPHS[0]}]')"),
    ("InvisibleChars", f"regexp_matches(content, '{codes(P.INVISIBLE)}')"),
    ("ControlChars", "regexp_matches(content, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]')"),
    ("RtlOverride", f"regexp_matches(content, '{codes(P.BIDI)}')"),
]
_B = f"""{C}, runs AS (SELECT request_id, unnest(regexp_extract_all(content, '{P.BASE64_RUN}')) AS x FROM c),
    dec AS (SELECT request_id, x, TRY(from_base64(x)) AS b, lower(TRY(decode(TRY(from_base64(x))))) AS t FROM runs),
    sus AS (SELECT request_id, bool_or(coalesce(to_base64(b) = x AND (contains(t, 'ignore') AND contains(t, 'instruction') OR {_words}), false)) AS b64 FROM dec GROUP BY request_id),
    b AS (SELECT c.request_id, content, coalesce(b64, false) AS b64 FROM c LEFT JOIN sus USING (request_id))"""
_FAM = [(n, found("content", p)) for n, p in P.FAMILIES.items()]
_TOX = [(n, found("content", p)) for n, (_, p) in P.TOXIC.items()]
_KIND = f"CASE WHEN {found('content', P.DIRECT)} THEN 'direct' WHEN {found('content', P.RECURSIVE)} THEN 'recursive' WHEN {found('content', P.INDIRECT)} THEN 'indirect' END"
_SAFE = "CASE " + " ".join(f"WHEN {found('content', p)} THEN '{n}'" for n, p in P.UNSAFE_OUTPUT.items()) + " END"
_TOXSUM = "least(1.0::DOUBLE, " + _sum([(c, P.TOXIC[n][0]) for n, c in _TOX]) + ")"
_HITS = lambda ps: "(" + " + ".join(f"{found('content', p)}::INT" for p in ps) + ")"
_DETAILS = " UNION ALL ".join(f"SELECT {quoted(n)} AS family, {k} AS pattern, {quoted('(?i)' + P.dialect(p))} AS re" for n, ps in P.FAMILIES.items() for k, p in enumerate(ps))
_N = f"""{_B}, parts AS MATERIALIZED (SELECT request_id, content, b64, {_KIND} AS kind, {_TOXSUM} AS tox, {_SAFE} AS unsafe, {", ".join(f"{c} AS f{k}" for k, (_, c) in enumerate(_FAM))}, {", ".join(f"{c} AS a{k}" for k, (_, c) in enumerate(_ENC[1:]))} FROM b),
    n AS (SELECT request_id, concat_ws(',', CASE WHEN b64 THEN 'Base64Obfuscation' END, {", ".join(f"CASE WHEN a{k} THEN '{m}' END" for k, (m, _) in enumerate(_ENC[1:]))}, {", ".join(f"CASE WHEN f{k} THEN '{m}' END" for k, (m, _) in enumerate(_FAM))},
        CASE kind WHEN 'direct' THEN 'DirectInjection' WHEN 'indirect' THEN 'IndirectInjection' WHEN 'recursive' THEN 'RecursiveInjection' END, CASE WHEN tox >= {P.TOXIC_FROM} THEN 'ToxicContent' END, CASE WHEN unsafe IS NOT NULL THEN 'MaliciousLLMOutput' END) AS flags,
        round(least(1.0::DOUBLE, {_sum([("b64", 0.4), *[(f"a{k}", P.ENCODING_RISK[m]) for k, (m, _) in enumerate(_ENC[1:])], *[(f"f{k}", P.FAMILY_RISK[m]) for k, (m, _) in enumerate(_FAM)]])}
        + CASE kind WHEN 'direct' THEN 0.9::DOUBLE WHEN 'indirect' THEN 0.7 WHEN 'recursive' THEN 0.95 ELSE 0 END + CASE WHEN tox >= {P.TOXIC_FROM} THEN tox * 0.5::DOUBLE ELSE 0 END + CASE WHEN unsafe IS NOT NULL THEN 0.95::DOUBLE * 0.8::DOUBLE ELSE 0 END), 6) AS neural_score FROM parts)"""
LEVEL = "CASE WHEN {0} >= 0.8 THEN 'critical' WHEN {0} >= 0.6 THEN 'high' WHEN {0} >= 0.4 THEN 'medium' WHEN {0} >= 0.2 THEN 'low' ELSE 'none' END"
SESSION = """coalesce(CASE WHEN auth_header LIKE 'Bearer %' THEN 'jwt:' || substr(auth_header, 8) END,
    CASE WHEN regexp_matches(cookie, '(?:^|;)\\s*(?:session|sid)=') THEN 'cookie:' || trim(regexp_extract(cookie, '(?:^|;)\\s*(?:session|sid)=([^;]*)', 1)) END, 'header:' || x_session_id)"""
AGENT = "coalesce(CASE WHEN auth_header LIKE 'Bearer %' THEN 'token:' || substr(auth_header, 8) END, CASE WHEN agent_id <> '' THEN agent_id END)"
SHAPE = "regexp_replace(regexp_replace(path, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '{id}', 'g'), '/[0-9]+', '/{num}', 'g')"
KEYS = "CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN array_to_string(list_sort(json_keys(body)), ',') ELSE '' END"

ORACLE = {
    "content_projection": f"WITH {C} SELECT request_id, content, strlen(content)::INT AS content_bytes FROM c",
    "write_predicate": f"WITH {R} SELECT request_id, method IN ('POST', 'PUT', 'PATCH', 'DELETE') AS is_write FROM r",
    "text_content": f"""WITH {R}, j AS (SELECT request_id, body, CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN body::JSON END AS o FROM r),
        k AS (SELECT *, CASE WHEN json_exists(o, '$.content') THEN 'content' WHEN json_exists(o, '$.text') THEN 'text' WHEN json_exists(o, '$.body') THEN 'body' WHEN json_exists(o, '$.title') THEN 'title' END AS key FROM j)
        SELECT request_id, CASE WHEN o IS NULL THEN body WHEN key IS NOT NULL AND json_type(o, '$.' || key) = 'VARCHAR' THEN json_extract_string(o, '$.' || key) END AS text, coalesce(strlen(body), 0)::INT AS content_length FROM k""",
    "session_id": f"WITH {R} SELECT request_id, {SESSION} AS session_id FROM r",
    "agent_identity": f"WITH {R} SELECT request_id, {AGENT} AS agent FROM r",
    "path_normalize": f"WITH {R} SELECT {SHAPE} AS shape, count(*) AS n FROM r GROUP BY 1",
    "body_structure": f"WITH {R} SELECT request_id, {KEYS} AS shape FROM r",
    "request_features": f"""WITH {R} SELECT request_id, strlen(path)::INT AS path_length, coalesce(len(string_split(query_string, '&')), 0)::INT AS param_count, coalesce(strlen(body), 0)::INT AS body_size,
        ((user_agent IS NOT NULL)::INT + (accept_language IS NOT NULL)::INT + (auth_header IS NOT NULL)::INT + (cookie IS NOT NULL)::INT + (x_session_id IS NOT NULL)::INT)::INT AS header_count,
        CASE method WHEN 'GET' THEN 0 WHEN 'POST' THEN 1 WHEN 'PUT' THEN 2 WHEN 'DELETE' THEN 3 WHEN 'PATCH' THEN 4 ELSE 5 END::INT AS method_ordinal FROM r""",
    "encoding_flags": f"WITH {_B} SELECT request_id, {_joined(_ENC)} AS attacks FROM b",
    "base64_obfuscation": f"WITH {_B} SELECT request_id, b64 AS hidden FROM b",
    "normalize_text": f"WITH {C} SELECT request_id, translate(content, '{P.HOMOGLYPHS[0]}' || " + " || ".join(f"chr({p})" for p in P.INVISIBLE + P.BIDI) + f", '{P.HOMOGLYPHS[1]}') AS normalized FROM c",
    "injection_type": f"WITH {C} SELECT request_id, {_KIND} AS injection FROM c",
    "injection_confidence": f"WITH {C} SELECT request_id, round(least(1.0::DOUBLE, {_HITS(P.DIRECT)} * 0.3::DOUBLE + {_HITS(P.RECURSIVE)} * 0.4::DOUBLE + {_HITS(P.INDIRECT)} * 0.2::DOUBLE), 6) AS confidence FROM c",
    "pattern_families": f"WITH {C} SELECT request_id, {_joined(_FAM)} AS families FROM c",
    "pattern_score": f"""WITH {C}, s AS (SELECT request_id, {_sum([(c, P.FAMILY_WEIGHT[n]) for n, c in _FAM])} AS w FROM c)
        SELECT request_id, round(least(1.0::DOUBLE, w), 6) AS score, round(least(1.0::DOUBLE, w * 1.2::DOUBLE), 6) AS strict_score FROM s""",
    "toxicity": f"WITH {C}, s AS (SELECT request_id, {_joined(_TOX)} AS categories, {_TOXSUM} AS t FROM c) SELECT request_id, categories, round(t, 6) AS score, t >= {P.TOXIC_FROM} AS is_toxic FROM s",
    "output_safety": f"WITH {C} SELECT request_id, {_SAFE} AS construct FROM c",
    "match_details": f"""WITH {C}, p AS ({_DETAILS}), m AS (SELECT request_id, content, family, pattern, re FROM c CROSS JOIN p WHERE regexp_matches(content, re))
        SELECT request_id, family, pattern::INT AS pattern, regexp_extract(content, re) AS matched, strlen(string_split_regex(content, re)[1])::INT AS start_byte, (strlen(string_split_regex(content, re)[1]) + strlen(regexp_extract(content, re)))::INT AS end_byte FROM m""",
    "neural_score": f"WITH {_N} SELECT request_id, flags, neural_score, {LEVEL.format('neural_score')} AS level FROM n",
    "neural_levels": f"WITH {_N} SELECT {LEVEL.format('neural_score')} AS level, CASE WHEN flags <> '' THEN string_split(flags, ',')[1] ELSE 'none' END AS first_flag, count(*) AS n FROM n GROUP BY ALL",
}
