"""Queries over the edge and behaviour layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators import behavior as B
from palisade.operators import edge as E
from palisade.plans.common import R, quoted, requests
from palisade.plans.detectors import AGENT, LEVEL, SESSION, SHAPE
from palisade.sources.tables import table


def trap_predicate(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d, "path").select("request_id", E.is_trap(F.col("path")).alias("is_trap"))


def trap_hit_score(spark: SparkSession, d: str) -> DataFrame:
    return E.trap_hits(requests(spark, d, "path", "client_ip", "ts_us")).select("request_id", "client_ip", "hit", "score")


def trapped_ips(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d, "path", "client_ip").where(E.is_trap(F.col("path")))
    return r.groupBy("client_ip").agg(F.count("*").alias("hits"))


def fake_response(spark: SparkSession, d: str) -> DataFrame:
    fakes = spark.createDataFrame(E.FAKE_RESPONSES, "path string, status_code int, fake_body string, content_type string")
    return requests(spark, d, "path").join(F.broadcast(fakes), "path").select("request_id", "path", "status_code", "content_type", F.length("fake_body").alias("body_length"))


def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    x = E.rate_limited(requests(spark, d, "client_ip", "ts_us"))
    return x.select("request_id", F.round("total", 6).alias("total"), "is_limited", F.round("usage_ratio", 9).alias("usage_ratio"), "remaining", "reset_in_secs")


def ddos(spark: SparkSession, d: str) -> DataFrame:
    return E.floods(requests(spark, d, "client_ip", "ts_us", "path")).select("request_id", "last_1s", "last_10s", "paths_100", "flood")


def global_rps(spark: SparkSession, d: str) -> DataFrame:
    return E.global_rate(requests(spark, d, "ts_us"))


def geoip_range_join(spark: SparkSession, d: str) -> DataFrame:
    return E.places(table(spark, d, "requests"), table(spark, d, "cidr"))


def ip_reputation(spark: SparkSession, d: str) -> DataFrame:
    return E.reputation(table(spark, d, "requests"), table(spark, d, "threats"), table(spark, d, "cidr")).select("client_ip", "threat", "is_datacenter", "reputation")


def ban_interval_join(spark: SparkSession, d: str) -> DataFrame:
    return E.banned(requests(spark, d, "client_ip", "ts_us"), table(spark, d, "bans")).select("request_id", "is_banned", "is_permanent", "remaining_secs")


def edge_score(spark: SparkSession, d: str) -> DataFrame:
    x = E.edge(requests(spark, d, "client_ip", "ts_us", "path"), table(spark, d, "threats"), table(spark, d, "cidr"))
    return x.select("request_id", F.array_join("edge_flags", ",").alias("flags"), F.round("edge_score", 6).alias("edge_score"))


def _all(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d)


def agent_profile(spark: SparkSession, d: str) -> DataFrame:
    return B.profiles(requests(spark, d, "auth_header", "agent_id", "ts_us", "path"))


def common_endpoints_topk(spark: SparkSession, d: str) -> DataFrame:
    return B.common_endpoints(requests(spark, d, "auth_header", "agent_id", "path"))


def session_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return B.fingerprints(_all(spark, d)).withColumn("match", F.round("match", 6)).withColumn("score", F.round("score", 6))


def coordination(spark: SparkSession, d: str) -> DataFrame:
    return B.coordination(requests(spark, d, "ts_us", "client_ip", "path", "method", "user_agent")).withColumn("rate", F.round("rate", 6))


def cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    return B.clusters(requests(spark, d, "ts_us", "client_ip", "path", "method", "user_agent")).withColumn("rate", F.round("rate", 6))


def anomalies(spark: SparkSession, d: str) -> DataFrame:
    return B.anomalies(_all(spark, d))


def behavior_score(spark: SparkSession, d: str) -> DataFrame:
    x = B.behavior(_all(spark, d))
    return x.select("request_id", F.array_join("behavior_flags", ",").alias("flags"), F.round("behavior_score", 6).alias("behavior_score"))


_PARTS = (trap_predicate, trap_hit_score, trapped_ips, fake_response, rate_limit, ddos, global_rps, geoip_range_join, ip_reputation, ban_interval_join, edge_score, agent_profile, common_endpoints_topk, session_fingerprint, coordination, cluster_stats, anomalies, behavior_score)
QUERIES = {f.__name__: f for f in _PARTS}

TRAP = "(lower(path) IN (" + ", ".join(map(quoted, E.EXACT_TRAPS)) + ") OR " + " OR ".join([f"starts_with(lower(path), {quoted(p)})" for p in E.PREFIX_TRAPS] + [f"ends_with(lower(path), {quoted(s)})" for s in E.SUFFIX_TRAPS]) + ")"
_RATE = """f AS (SELECT request_id, client_ip, ts_us, ts_us - min(ts_us) OVER (PARTITION BY client_ip) AS el FROM r),
    k AS (SELECT *, el // 60000000 AS k, el % 60000000 AS i FROM f), kn AS (SELECT client_ip, k, count(*) AS n FROM k GROUP BY ALL),
    rate AS (SELECT k.request_id, row_number() OVER (PARTITION BY k.client_ip, k.k ORDER BY ts_us, request_id) + coalesce(kn.n, 0) * (1.0::DOUBLE - (i // 1000)::DOUBLE / 60000::DOUBLE) AS total, i FROM k LEFT JOIN kn ON kn.client_ip = k.client_ip AND kn.k = k.k - 1)"""
_FLOOD = """fl AS (SELECT request_id, client_ip, count(*) OVER (PARTITION BY client_ip ORDER BY ts_us RANGE BETWEEN 999999 PRECEDING AND CURRENT ROW) AS last_1s, count(*) OVER (PARTITION BY client_ip ORDER BY ts_us RANGE BETWEEN 9999999 PRECEDING AND CURRENT ROW) AS last_10s,
      count(DISTINCT path) OVER (PARTITION BY client_ip ORDER BY ts_us, request_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS paths_100 FROM r),
    flood AS (SELECT *, CASE WHEN last_1s > 50 THEN 'volumetric' WHEN last_10s > 30 AND paths_100 < 3 THEN 'application_layer' END AS flood FROM fl)"""
_DC = "(" + ", ".join(map(str, E.DATACENTERS)) + ")"
_GEO = f"""ips AS (SELECT DISTINCT client_ip FROM requests), num AS (SELECT client_ip, CASE WHEN client_ip NOT LIKE '%:%' THEN string_split(client_ip, '.')[1]::BIGINT * 16777216 + string_split(client_ip, '.')[2]::BIGINT * 65536 + string_split(client_ip, '.')[3]::BIGINT * 256 + string_split(client_ip, '.')[4]::BIGINT END AS n FROM ips),
    geo0 AS (SELECT client_ip, (SELECT arg_max(country, prefix) FROM cidr WHERE n BETWEEN start_ip AND end_ip AND country IS NOT NULL) AS country, (SELECT arg_max(asn, prefix) FROM cidr WHERE n BETWEEN start_ip AND end_ip AND asn IS NOT NULL) AS asn FROM num),
    geo AS (SELECT *, coalesce(asn IN {_DC}, false) AS is_datacenter FROM geo0)"""
_REP = f"""{_GEO}, th AS (SELECT ip, arg_min(threat_type, priority) AS threat FROM threats GROUP BY ip),
    rep0 AS (SELECT client_ip, threat, is_datacenter, CASE threat WHEN 'blocked' THEN 0.0::DOUBLE WHEN 'tor' THEN 0.3 WHEN 'proxy' THEN 0.5 WHEN 'scanner' THEN 0.2 ELSE 1 END AS s FROM geo LEFT JOIN th ON ip = client_ip),
    rep AS (SELECT client_ip, threat, is_datacenter, CASE WHEN is_datacenter THEN least(0.7::DOUBLE, s) ELSE s END AS reputation FROM rep0)"""
_EDGE = f"""{R}, {_RATE}, {_FLOOD}, {_REP}, ed AS (SELECT r.request_id, total > 60 AS lim, least(2::DOUBLE, total / 60) AS usage, flood, threat, reputation FROM r JOIN rate USING (request_id) JOIN flood USING (request_id) JOIN rep ON rep.client_ip = r.client_ip),
    edge AS (SELECT request_id, concat_ws(',', CASE WHEN lim THEN 'HighVolume' END, CASE threat WHEN 'blocked' THEN 'KnownAttacker' WHEN 'tor' THEN 'TorExit' WHEN 'proxy' THEN 'Proxy' WHEN 'scanner' THEN 'Scanner' END,
        CASE WHEN NOT lim AND flood = 'volumetric' THEN 'HighVolume' END, CASE WHEN flood = 'application_layer' THEN 'AnomalousPattern' END) AS edge_flags,
        least(1::DOUBLE, CASE WHEN lim THEN 0.8::DOUBLE WHEN usage > 0.7 THEN usage * 0.3 ELSE 0 END + CASE threat WHEN 'blocked' THEN 0.9::DOUBLE WHEN 'tor' THEN 0.2 WHEN 'proxy' THEN 0.1 WHEN 'scanner' THEN 0.7 ELSE 0 END
          + (1::DOUBLE - reputation) * 0.2 + CASE flood WHEN 'volumetric' THEN 0.85::DOUBLE WHEN 'application_layer' THEN 0.8 ELSE 0 END) AS edge_score FROM ed)"""


def behavior_sql(src: str) -> str:
    """CTEs of the behaviour layer over the requests in src."""
    return f"""ag AS (SELECT request_id, {AGENT} AS agent, ts_us, path FROM {src}), ag1 AS (SELECT *, count(*) OVER (PARTITION BY agent ORDER BY ts_us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n_in, ts_us - lag(ts_us) OVER o AS gap, count(*) OVER (PARTITION BY agent ORDER BY ts_us, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b4,
        count(*) OVER (PARTITION BY agent, path ORDER BY ts_us, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same FROM ag WHERE agent IS NOT NULL WINDOW o AS (PARTITION BY agent ORDER BY ts_us, request_id)),
    ag2 AS (SELECT *, coalesce(lag(n_in) OVER (PARTITION BY agent ORDER BY ts_us, request_id), 0) AS request_count, sum(gap) OVER h AS gaps, count(gap) OVER h AS ng FROM ag1 WINDOW h AS (PARTITION BY agent ORDER BY ts_us, request_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)),
    prof0 AS (SELECT request_id, agent, request_count, CASE WHEN ng > 0 THEN (gaps // ng)::BIGINT ELSE 0 END AS avg_interval_us, request_count >= 1000 AS velocity_exceeded, CASE WHEN same = 0 AND b4 > 10 THEN 0.8::DOUBLE WHEN same > 0 AND b4 > 100 AND same::DOUBLE / b4 < 0.01 THEN 0.6 ELSE 0 END AS pattern_deviation FROM ag2),
    prof AS (SELECT *, velocity_exceeded OR pattern_deviation > 0.5 OR (avg_interval_us < 100000 AND request_count > 10) AS is_anomalous FROM prof0),
    se AS (SELECT request_id, ts_us, client_ip, user_agent, accept_language, {SESSION} AS session_id FROM {src}),
    se1 AS (SELECT *, first_value(client_ip) OVER o AS ip0, first_value(user_agent) OVER o AS ua0, first_value(accept_language) OVER o AS la0, lag(ts_us) OVER o AS last, row_number() OVER o AS rn FROM se WHERE session_id IS NOT NULL WINDOW o AS (PARTITION BY session_id ORDER BY ts_us, request_id)),
    se2 AS (SELECT *, CASE WHEN rn = 1 THEN 1::DOUBLE ELSE CASE WHEN client_ip IS NOT DISTINCT FROM ip0 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN user_agent IS NOT DISTINCT FROM ua0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN accept_language IS NOT DISTINCT FROM la0 THEN 0.2::DOUBLE ELSE 0 END END AS match FROM se1),
    sess AS (SELECT request_id, session_id, match, CASE WHEN match < 0.7 THEN 1 - match WHEN client_ip IS DISTINCT FROM ip0 AND ts_us - last < 60000000 THEN 0.8::DOUBLE ELSE 0 END AS score,
        CASE WHEN match < 0.7 THEN concat_ws(', ', CASE WHEN client_ip IS DISTINCT FROM ip0 THEN 'IP changed' END, CASE WHEN user_agent IS DISTINCT FROM ua0 THEN 'User-Agent changed' END) WHEN client_ip IS DISTINCT FROM ip0 AND ts_us - last < 60000000 THEN 'Impossible travel' ELSE '' END AS reasons,
        match < 0.7 OR coalesce(client_ip IS DISTINCT FROM ip0 AND ts_us - last < 60000000, false) AS is_suspicious FROM se2),
    sg AS (SELECT request_id, ts_us, client_ip, concat_ws('|', {SHAPE}, coalesce(method, ''), coalesce(user_agent, '')) AS signature FROM {src}),
    sg1 AS (SELECT *, row_number() OVER (PARTITION BY signature, client_ip ORDER BY ts_us, request_id) = 1 AS fst, count(*) OVER w AS n, min(ts_us) OVER w AS t0, count(*) OVER (PARTITION BY client_ip ORDER BY ts_us, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same_ip FROM sg WINDOW w AS (PARTITION BY signature ORDER BY ts_us RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW)),
    sg2 AS (SELECT *, CASE WHEN n > 1 AND ts_us > t0 THEN n / ((ts_us - t0) / 1000000::DOUBLE) ELSE 0::DOUBLE END AS rt FROM sg1),
    coord0 AS (SELECT request_id, coalesce(sum(fst::INT) OVER (PARTITION BY signature ORDER BY ts_us, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ips, coalesce(lag(rt) OVER (PARTITION BY signature ORDER BY ts_us, request_id), 0) AS rate, same_ip FROM sg2),
    coord AS (SELECT *, CASE WHEN ips >= 10 AND rate >= 10 THEN 'botnet' WHEN ips >= 5 THEN 'distributed_probing' WHEN same_ip >= 20 THEN 'sybil' END AS attack FROM coord0),
    ft AS (SELECT request_id, ts_us, strlen(path)::BIGINT AS x0, coalesce(len(string_split(query_string, '&')), 0)::BIGINT AS x1, coalesce(strlen(body), 0)::BIGINT AS x2, ((user_agent IS NOT NULL)::INT + (accept_language IS NOT NULL)::INT + (auth_header IS NOT NULL)::INT + (cookie IS NOT NULL)::INT + (x_session_id IS NOT NULL)::INT)::BIGINT AS x3,
        CASE method WHEN 'GET' THEN 0 WHEN 'POST' THEN 1 WHEN 'PUT' THEN 2 WHEN 'DELETE' THEN 3 WHEN 'PATCH' THEN 4 ELSE 5 END::BIGINT AS x4 FROM {src}),
    ft1 AS (SELECT *, ts_us - lag(ts_us) OVER (ORDER BY ts_us, request_id) AS gap, (count(*) OVER p)::DOUBLE AS n, {", ".join(f"(sum(x{i}) OVER p)::DOUBLE AS s{i}, (sum(x{i} * x{i}) OVER p)::DOUBLE AS q{i}" for i in range(5))}, count(*) OVER v AS five, {", ".join(f"min(x{i}) OVER v AS lo{i}, max(x{i}) OVER v AS hi{i}" for i in range(3))}
        FROM ft WINDOW p AS (ORDER BY ts_us, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (ORDER BY ts_us, request_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
    ft2 AS (SELECT *, sum(gap) OVER h AS gaps, count(gap) OVER h AS ng FROM ft1 WINDOW h AS (ORDER BY ts_us, request_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)),
    anom AS (SELECT request_id, coalesce(n >= 100 AND ({" OR ".join(f"((q{i} - s{i} * s{i} / n) / (n - 1) > 1e-9 AND abs(x{i} - s{i} / n) / sqrt(greatest((q{i} - s{i} * s{i} / n) / (n - 1), 1e-12)) > 3)" for i in range(5))}), false) AS is_outlier,
        coalesce(ng >= 10 AND gap // 1000 > 0 AND ((gaps // ng) // 1000)::DOUBLE / (gap // 1000) > 10, false) AS is_temporal, coalesce(five = 5 AND {" AND ".join(f"lo{i} = x{i} AND hi{i} = x{i}" for i in range(3))}, false) AS is_sequence FROM ft2),
    beh AS (SELECT s0.request_id, concat_ws(',', CASE WHEN is_suspicious THEN 'SuspiciousSession' END, CASE WHEN is_anomalous THEN 'BehaviorAnomaly' END, CASE WHEN velocity_exceeded THEN 'VelocityExceeded' END, CASE WHEN pattern_deviation > 0.5 THEN 'PatternDeviation' END, CASE WHEN is_outlier THEN 'StatisticalAnomaly' END, CASE WHEN is_temporal THEN 'TemporalAnomaly' END, CASE WHEN is_sequence THEN 'SequenceAnomaly' END,
        CASE attack WHEN 'botnet' THEN 'CoordinatedBotnet' WHEN 'distributed_probing' THEN 'DistributedProbing' WHEN 'sybil' THEN 'SybilAttack' END) AS behavior_flags,
        least(1::DOUBLE, coalesce(score, 0) * 0.3::DOUBLE + CASE WHEN is_anomalous THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN velocity_exceeded THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN pattern_deviation > 0.5 THEN pattern_deviation * 0.5::DOUBLE ELSE 0 END + CASE WHEN is_outlier THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN is_temporal THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN is_sequence THEN 0.5::DOUBLE ELSE 0 END
          + CASE attack WHEN 'botnet' THEN 0.9::DOUBLE WHEN 'distributed_probing' THEN 0.7 WHEN 'sybil' THEN 0.8 ELSE 0 END) AS behavior_score
        FROM {src} s0 LEFT JOIN sess USING (request_id) LEFT JOIN prof USING (request_id) JOIN anom USING (request_id) JOIN coord USING (request_id))"""


_BEH = f"{R}, {behavior_sql('r')}"
EDGE_SQL = _EDGE
ORACLE = {
    "trap_predicate": f"WITH {R} SELECT request_id, {TRAP} AS is_trap FROM r",
    "trap_hit_score": f"WITH {R}, h AS (SELECT request_id, client_ip, row_number() OVER (PARTITION BY client_ip ORDER BY ts_us, request_id) AS hit FROM r WHERE {TRAP}) SELECT request_id, client_ip, hit, CASE hit WHEN 1 THEN 0.7::DOUBLE WHEN 2 THEN 0.85 ELSE 0.95 END AS score FROM h",
    "trapped_ips": f"WITH {R} SELECT client_ip, count(*) AS hits FROM r WHERE {TRAP} GROUP BY 1",
    "fake_response": f"WITH {R}, f AS (SELECT * FROM (VALUES " + ", ".join(f"({quoted(p)}, {s}, {len(b)}, {quoted(t)})" for p, s, b, t in E.FAKE_RESPONSES) + ") v(path, status_code, body_length, content_type)) SELECT request_id, path, status_code::INT AS status_code, content_type, body_length::INT AS body_length FROM r JOIN f USING (path)",
    "rate_limit": f"WITH {R}, {_RATE} SELECT request_id, round(total, 6) AS total, total > 60 AS is_limited, round(least(2::DOUBLE, total / 60), 9) AS usage_ratio, CASE WHEN total > 60 THEN 0 ELSE floor(greatest(0, 60 - total)) END::BIGINT AS remaining, (60000000 - i) // 1000000 AS reset_in_secs FROM rate",
    "ddos": f"WITH {R}, {_FLOOD} SELECT request_id, last_1s, last_10s, paths_100::INT AS paths_100, flood FROM flood",
    "global_rps": f"WITH {R} SELECT (ts_us - (SELECT min(ts_us) FROM r)) // 1000000 AS second, count(*) AS n, count(*) > 500 AS under_attack FROM r GROUP BY 1",
    "geoip_range_join": f"WITH {_GEO} SELECT client_ip, country, asn, is_datacenter FROM geo",
    "ip_reputation": f"WITH {_REP} SELECT client_ip, threat, is_datacenter, reputation FROM rep",
    "ban_interval_join": f"""WITH {R}, h AS (SELECT request_id, bool_or(expires_epoch IS NULL) AS perm, max(expires_epoch - ts_us // 1000000) AS l FROM r JOIN bans ON ip = client_ip AND created_epoch * 1000000 <= ts_us AND (expires_epoch IS NULL OR ts_us <= expires_epoch * 1000000) GROUP BY 1)
        SELECT request_id, perm IS NOT NULL AS is_banned, coalesce(perm, false) AS is_permanent, CASE WHEN perm THEN NULL ELSE coalesce(l, 0) END::BIGINT AS remaining_secs FROM r LEFT JOIN h USING (request_id)""",
    "edge_score": f"WITH {_EDGE} SELECT request_id, edge_flags AS flags, round(edge_score, 6) AS edge_score FROM edge",
    "agent_profile": f"WITH {_BEH} SELECT request_id, agent, request_count, avg_interval_us, velocity_exceeded, pattern_deviation, is_anomalous FROM prof",
    "common_endpoints_topk": f"WITH {R}, n AS (SELECT {AGENT} AS agent, path, count(*) AS n FROM r GROUP BY 1, 2), k AS (SELECT *, (row_number() OVER (PARTITION BY agent ORDER BY n DESC, path))::INT AS rank FROM n WHERE agent IS NOT NULL) SELECT * FROM k WHERE rank <= 5",
    "session_fingerprint": f"WITH {_BEH} SELECT request_id, session_id, round(match, 6) AS match, round(score, 6) AS score, reasons, is_suspicious FROM sess",
    "coordination": f"WITH {_BEH} SELECT request_id, ips, round(rate, 6) AS rate, same_ip, attack FROM coord",
    "cluster_stats": f"WITH {_BEH} SELECT signature, count(*) AS n, count(DISTINCT client_ip) AS ips, round(CASE WHEN count(*) > 1 AND max(ts_us) > min(ts_us) THEN count(*) / ((max(ts_us) - min(ts_us)) / 1000000::DOUBLE) ELSE 0 END, 6) AS rate FROM sg GROUP BY 1",
    "anomalies": f"WITH {_BEH} SELECT * FROM anom",
    "behavior_score": f"WITH {_BEH} SELECT request_id, behavior_flags AS flags, round(behavior_score, 6) AS behavior_score FROM beh",
}
