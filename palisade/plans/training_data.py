"""Queries over the general training-data operators: skewed keys (p2) and sessions (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.skew import distinct_counts
from palisade.sources.tables import table
from palisade.streaming.sessions import sessions


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Distinct requests and escalations of every address and UTC month."""
    part = lambda name, key, kind: table(spark, d, name).select("client_ip", F.date_format("ts", "yyyy-MM").alias("ym"), F.lit(kind).alias("kind"), F.col(key).alias("id"))
    rows = part("requests", "request_id", "r").unionByName(part("escalations", "escalation_id", "e"))
    return distinct_counts(rows, "client_ip", ["ym"], "kind", {"r": "n_requests", "e": "n_escalations"}, "id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of agents, or of addresses where no agent is known, by gaps of more than 1,800 s."""
    return sessions(spark, f"{d}/requests.parquet")


QUERIES = {"p2_found": p2_found, "p5_found": p5_found}

ORACLE = {
    "p2_found": """
        SELECT client_ip, ym, count(DISTINCT rid) AS n_requests, count(DISTINCT eid) AS n_escalations FROM (
          SELECT client_ip, strftime(ts AT TIME ZONE 'UTC', '%Y-%m') AS ym, request_id AS rid, NULL AS eid FROM requests
          UNION ALL SELECT client_ip, strftime(ts AT TIME ZONE 'UTC', '%Y-%m'), NULL, escalation_id FROM escalations)
        GROUP BY client_ip, ym""",
    "p5_found": """
        WITH e AS (SELECT DISTINCT request_id, ts_us, CASE WHEN agent_id IS NOT NULL AND agent_id <> '' THEN 'agent' ELSE 'ip' END AS actor_kind,
                     CASE WHEN agent_id IS NOT NULL AND agent_id <> '' THEN agent_id ELSE client_ip END AS actor FROM requests WHERE ts_us IS NOT NULL),
             f AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w > 1800000000 OR lag(ts_us) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM e WINDOW w AS (PARTITION BY actor_kind, actor ORDER BY ts_us, request_id)),
             g AS (SELECT *, sum(b) OVER (PARTITION BY actor_kind, actor ORDER BY ts_us, request_id ROWS UNBOUNDED PRECEDING) AS s FROM f)
        SELECT actor_kind, actor, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n_events FROM g GROUP BY actor_kind, actor, s""",
}
