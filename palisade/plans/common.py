"""What the plans share: the tables with every row once, and pieces of SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import patterns as P
from palisade.functions import text as X
from palisade.sources.tables import once, table


def requests(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Requests, each once. Only the columns named go through the shuffle that finds rows delivered again."""
    r = table(spark, d, "requests")
    return once(r.select("request_id", *[c for c in columns if c != "request_id"]) if columns else r.drop("received_ts"), "request_id")


def contents(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d, "path", "query_string", "body")
    return r.select("request_id", X.content(F.col("path"), F.col("query_string"), F.col("body")).alias("content"))


def logs(spark: SparkSession, d: str) -> DataFrame:
    """Log records, each once, with the fields at top level; level is the record's, event_level the event's."""
    raw = once(table(spark, d, "logs"), "log_id")
    f = F.col("fields")
    names = ("message", "ip", "path", "score", "flags", "reason", "duration_secs", "body", "action")
    return raw.select("log_id", "log_ts", "level", "target", f.level.alias("event_level"), *[f[n].alias(n) for n in names])


#: CTEs of the oracle.
R = "r AS (SELECT DISTINCT request_id, ts_us, client_ip, method, path, query_string, user_agent, accept_language, auth_header, cookie, x_session_id, agent_id, body FROM requests)"
_COMPACT = """CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN '{' || array_to_string(list_transform(list_sort(json_keys(body)), lambda k: to_json(k)::VARCHAR || ':' || json_extract(body, '$."' || k || '"')::VARCHAR), ',') || '}' WHEN json_valid(body) AND json_type(body) = 'ARRAY' THEN json(body)::VARCHAR ELSE body END"""
C = R + f", c AS (SELECT request_id, path || chr(10) || coalesce(query_string || chr(10), '') || coalesce({_COMPACT}, '') AS content FROM r)"
L = "l AS (SELECT DISTINCT log_id, log_ts, level, target, fields.level AS event_level, fields.message AS message, fields.ip AS ip, fields.path AS path, fields.score AS score, fields.flags AS flags, fields.reason AS reason, fields.duration_secs AS duration_secs, fields.body AS body, fields.action AS action FROM logs)"
E_ = "e AS (SELECT DISTINCT ON (escalation_id) * FROM escalations)"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def found(column: str, patterns: list[str] | str) -> str:
    """SQL: whether any of patterns is in column."""
    several = [patterns] if isinstance(patterns, str) else patterns
    return f"regexp_matches({column}, {quoted('(?i)' + '|'.join(f'(?:{P.dialect(p)})' for p in several))})"


def codes(points: list[int]) -> str:
    return "[" + "".join(f"\\x{{{p:x}}}" for p in points) + "]"
