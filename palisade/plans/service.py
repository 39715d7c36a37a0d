"""Queries over answers, challenges, bookkeeping of bans, read endpoints and clean-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palisade.functions.text import agent_key, path_shape, session_id
from palisade.operators import bans as N
from palisade.operators import behavior as B
from palisade.operators import challenges as G
from palisade.operators import edge as E
from palisade.operators import responses as S
from palisade.operators import risk as K
from palisade.plans.common import E_, L, R, logs, requests
from palisade.plans.detectors import AGENT, SESSION, SHAPE
from palisade.plans.layers import TRAP
from palisade.plans.response import NOW_SQL, _labelled, _LAB, _now, bans_active, escalations
from palisade.sources.readers import adapted
from palisade.sources.tables import table


def _decided(spark: SparkSession, d: str) -> DataFrame:
    """Escalations with the action their level and flags ask for, and the kind of its challenge."""
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    e = escalations(spark, d).select("escalation_id", F.lower("level").alias("level"), flags.alias("flags"), "client_ip", "path", "score", F.unix_seconds("ts").alias("epoch"))
    return e.withColumn("action", K.action(F.col("level"), F.col("flags"))).withColumn("kind", F.when(F.col("level") == "high", "ProofOfWork").otherwise("Interactive"))


def _challenge_id() -> Column:
    return F.substring(G.digest(F.col("escalation_id"), "id"), 1, 32)


def api_response(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("escalation_id", "action", S.details(F.col("action"), F.col("level"), _challenge_id(), F.col("kind")).alias("details"))


def middleware_result(spark: SparkSession, d: str) -> DataFrame:
    parts = S.middleware(F.col("action"), F.col("level"), _challenge_id(), F.col("kind"), F.col("epoch"))
    return _decided(spark, d).select("escalation_id", *[c.alias(n) for n, c in parts.items()])


def enforcement_result(spark: SparkSession, d: str) -> DataFrame:
    parts = S.enforcement(F.col("action"), F.col("escalation_id"), F.col("score"), K.multiplier(K.unified_level(F.col("score"))))
    return _decided(spark, d).select("escalation_id", *[c.alias(n) for n, c in parts.items()])


def error_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Every error with status and code, and how many escalated requests end in it."""
    name = F.when(F.col("action") == "block", "IpBlocked").when(F.col("action") == "challenge", "ChallengeRequired").when(F.col("action") == "rate_limit", "RateLimitExceeded")
    n = _decided(spark, d).groupBy(name.alias("error")).agg(F.count("*").alias("n"))
    return S.errors(spark).join(n, "error", "left").select("error", "status", "code", "is_server_error", F.coalesce("n", F.lit(0)).alias("n"))


def api_envelope(spark: SparkSession, d: str) -> DataFrame:
    """The list of bans as answers: an error for a ban without a reason."""
    b = table(spark, d, "bans")
    data = F.struct(F.col("ip"), N.reason_text(F.col("reason")).alias("reason"))
    return b.select("ban_id", S.envelope(data, F.when(F.col("reason").isNull(), F.lit("no reason"))).alias("answer"))


def _challenges(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, G.KINDS)), (F.col("escalation_id") % len(G.KINDS) + 1).cast("int"))
    return G.generated(_decided(spark, d).select("escalation_id", "level", F.col("epoch").alias("created_epoch"), kind.alias("kind")), "escalation_id", "kind", "level")


def challenges(spark: SparkSession, d: str) -> DataFrame:
    """A challenge for every escalation, its kind by turns."""
    return _challenges(spark, d).select("escalation_id", "challenge_id", "kind", "data", "solution", (F.col("created_epoch") + G.EXPIRY_SECS).alias("expires_epoch"))


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    """Five attempts at each challenge, one of the first six being right, 70 or 170 seconds apart."""
    n = F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n")
    x = _challenges(spark, d).select("escalation_id", "challenge_id", "solution", "created_epoch", n)
    wait = F.when(F.col("escalation_id") % 4 == 0, 170).otherwise(70)
    return x.select((F.col("escalation_id") * 10 + F.col("n")).alias("attempt_id"), "challenge_id", F.when(F.col("n") == F.col("escalation_id") % 6 + 1, F.col("solution")).otherwise(F.concat(F.lit("no"), "n")).alias("response"), (F.col("created_epoch") + (F.col("n") - 1) * wait).alias("epoch"))


def challenge_verify(spark: SparkSession, d: str) -> DataFrame:
    return G.verified(_attempts(spark, d), _challenges(spark, d))


def challenge_pending(spark: SparkSession, d: str) -> DataFrame:
    """Challenges still open 150 seconds after they were made, by kind."""
    c = _challenges(spark, d)
    early = G.verified(_attempts(spark, d), c).join(c.select("challenge_id", "created_epoch"), "challenge_id").where(F.col("epoch") <= F.col("created_epoch") + 150)
    return G.pending(c, early, F.col("created_epoch") + 150).groupBy("kind").agg(F.count("*").alias("n"))


def _acted(spark: SparkSession, d: str) -> DataFrame:
    return logs(spark, d).where("ip IS NOT NULL AND action IS NOT NULL").select("log_id", "ip", "action", F.unix_micros(F.to_timestamp("log_ts")).alias("us"))


def action_history(spark: SparkSession, d: str, most: int = 100, drop: int = 50) -> DataFrame:
    """The actions kept of each address: once there are more than ``most``, the oldest ``drop`` go. nth: 1 is the latest.

    How many are kept follows from their number; no more than ``most`` latest rows of an address are sorted.
    """
    a = _acted(spark, d)
    n = F.col("n")
    kept = a.groupBy("ip").agg(F.count("*").alias("n")).select("ip", F.when(n <= most, n).otherwise(most + 1 - drop + (n - most - 1) % drop).alias("kept"))
    last = a.withColumn("nth", F.row_number().over(W.partitionBy("ip").orderBy(F.desc("us"), F.desc("log_id")))).where(F.col("nth") <= most)
    return last.join(kept, "ip").where("nth <= kept").select("log_id", "ip", "action", "nth")


def bans_unbanned(spark: SparkSession, d: str) -> DataFrame:
    """The ban table after the addresses of the threat list were unbanned."""
    return N.without(table(spark, d, "bans"), table(spark, d, "threats")).select("ban_id", "ip")


def ban_counts_restarted(spark: SparkSession, d: str) -> DataFrame:
    return N.numbered(table(spark, d, "bans"), "ip", "ban_id").select("ban_id", "ip", "nth")


def ban_terms(spark: SparkSession, d: str) -> DataFrame:
    """Bans as the log tells them: when each ends, and what its reason says."""
    x = logs(spark, d).where("message = 'IP banned'").withColumn("epoch", F.unix_seconds(F.to_timestamp("log_ts")))
    return x.select("log_id", N.expiry(F.col("epoch"), F.col("duration_secs")).alias("expires_epoch"), N.reason_text(F.col("reason")).alias("reason_text"))


def ban_totals(spark: SparkSession, d: str) -> DataFrame:
    """Addresses ever banned, banned for ever, and banned at the latest event."""
    n = lambda c: F.count_distinct(F.when(c, F.col("ip")))
    live = bans_active(spark, d).agg(F.count("*").alias("active"))
    return table(spark, d, "bans").agg(F.count_distinct("ip").alias("banned"), n(F.col("expires_epoch").isNull()).alias("for_ever")).join(F.broadcast(live))


def agent_bans(spark: SparkSession, d: str) -> DataFrame:
    """Agents banned by critical escalations of their requests: last reason and expiry, number of bans."""
    r = requests(spark, d, "auth_header", "agent_id").select("request_id", agent_key(F.col("auth_header"), F.col("agent_id")).alias("agent"))
    e = escalations(spark, d).where("level = 'CRITICAL'").select("request_id", F.col("escalation_id").alias("event_id"), F.unix_seconds("ts").alias("epoch"), F.lit("CriticalRisk").alias("reason"))
    return N.folded(e.join(r, "request_id"), "agent", S.BAN_SECS)


def filter_sets(spark: SparkSession, d: str) -> DataFrame:
    return N.export_sets(bans_active(spark, d))


def threat_lists(spark: SparkSession, d: str) -> DataFrame:
    """The threat list and, as scanners, the addresses that asked for traps, each pair once; the list of proxies was cleared."""
    listed = table(spark, d, "threats").where("threat_type <> 'proxy'").select("ip", "threat_type")
    caught = requests(spark, d, "path", "client_ip").where(E.is_trap(F.col("path"))).select(F.col("client_ip").alias("ip"), F.lit("scanner").alias("threat_type"))
    return listed.unionByName(caught).distinct()


def custom_traps(spark: SparkSession, d: str, more: tuple[str, ...] = ("/API/v1/Search", "/health")) -> DataFrame:
    """Requests that fall into traps registered at run time, with the fake answer registered for the path, if any."""
    answers = spark.createDataFrame([("/health", 418, "text/plain")], "path string, status_code int, content_type string")
    return E.with_traps(requests(spark, d, "path"), more, answers).where("is_trap").select("request_id", "path", "status_code", "content_type")


def request_adapter(spark: SparkSession, d: str) -> DataFrame:
    """Requests as they come over the wire, adapted: header names in lower case, kind of the body, whether the address is one."""
    r = requests(spark, d, "client_ip", "user_agent", "accept_language", "body")
    raw = r.select("request_id", "client_ip", F.lit(None).cast("string").alias("method"), F.create_map(F.lit("User-Agent"), "user_agent", F.lit("ACCEPT-LANGUAGE"), "accept_language").alias("headers"), F.col("body").cast("binary").alias("body"))
    a = adapted(raw)
    return a.select("request_id", "client_ip", "ip_error", "method", F.col("headers")["user-agent"].alias("user_agent"), F.size("headers").alias("n_headers"), "body_kind", "content_length")


def rate_peek(spark: SparkSession, d: str) -> DataFrame:
    """The counter of an address at each of its escalations, without counting anything."""
    probes = escalations(spark, d).select(F.col("escalation_id").alias("probe_id"), "client_ip", F.unix_micros("ts").alias("ts_us"))
    return E.rate_peek(probes, requests(spark, d, "client_ip", "ts_us")).select("probe_id", "client_ip", F.round("total", 6).alias("total"), "is_limited", "remaining", "reset_in_secs")


def tracked_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys seen within their time to live before the latest event, by kind."""
    r = requests(spark, d, "ts_us", "client_ip", "auth_header", "agent_id", "cookie", "x_session_id", "path", "method", "user_agent")
    kinds = {"ip": (F.col("client_ip"), 120), "agent": (agent_key(F.col("auth_header"), F.col("agent_id")), 3600), "session": (session_id(F.col("auth_header"), F.col("cookie"), F.col("x_session_id")), 86_400), "cluster": (B._signature(), 300)}
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key"), F.lit(ttl).alias("ttl")) for k, (c, ttl) in kinds.items()])).alias("c")
    seen = r.select("ts_us", cells).where("c.key IS NOT NULL").groupBy("c.kind", "c.key", "c.ttl").agg(F.max("ts_us").alias("last")).join(_now(spark, d))
    return seen.groupBy("kind").agg(F.count("*").alias("tracked"), F.sum((F.expr("last div 1000000") >= F.col("now") - F.col("ttl")).cast("bigint")).alias("live"))


def signature_cap(spark: SparkSession, d: str, most: int = 1000, max_age_secs: int = 1_296_000) -> DataFrame:
    """What a clean-up leaves of the signatures of each address: the first ``most``, of clusters first seen within max_age_secs of the latest event. Counts by address."""
    s = B.signatures(requests(spark, d, "ts_us", "client_ip", "path", "method", "user_agent"))
    young = s.groupBy("signature").agg(F.min("ts_us").alias("first")).join(_now(spark, d)).where(F.expr(f"now - first div 1000000 < {max_age_secs}")).select("signature")
    first = s.withColumn("nth", F.row_number().over(W.partitionBy("client_ip").orderBy("ts_us", "request_id"))).where(F.col("nth") <= most)
    return first.join(young, "signature", "left_semi").groupBy("client_ip").agg(F.count("*").alias("kept"))


def feature_stats(spark: SparkSession, d: str) -> DataFrame:
    """Count, mean, sample deviation (1 for fewer than two), least and greatest of each feature."""
    f = B.features(requests(spark, d))
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("v")) for n in B.FEATURES])).alias("c")
    g = f.select(cells).groupBy("c.feature").agg(F.count("*").alias("n"), F.avg("c.v").alias("mean"), F.stddev_samp("c.v").alias("sd"), F.min("c.v").alias("least"), F.max("c.v").alias("greatest"))
    return g.select("feature", "n", F.round("mean", 6).alias("mean"), F.round(F.coalesce("sd", F.lit(1.0)), 6).alias("sd"), "least", "greatest")


def _latency_cells(spark: SparkSession, d: str) -> DataFrame:
    """One row: requests of each latency bucket and of all, and the mean in whole microseconds, 0 for none."""
    us = table(spark, d, "requests").groupBy("request_id").agg(F.min(F.unix_micros("received_ts") - F.col("ts_us")).alias("us"))
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    cells, low = {}, None
    for top in (100, 500, 1000, 5000, 10000, None):
        cells[f"n{len(cells)}"] = n((F.col("us") < top if top else F.lit(True)) & (F.col("us") >= low if low else F.lit(True)))
        low = top
    return us.agg(F.count("*").alias("total"), F.coalesce(F.expr("sum(us) div nullif(count(us), 0)"), F.lit(0)).alias("avg_us"), *[c.alias(k) for k, c in cells.items()])


def latency_cumulative(spark: SparkSession, d: str) -> DataFrame:
    """Requests within each upper bound, +Inf included, empty buckets too."""
    c = _latency_cells(spark, d)
    upto = lambda k: sum((F.col(f"n{i}") for i in range(k + 1)), F.lit(0))
    rows = F.explode(F.array(*[F.struct(F.lit(le).alias("le"), upto(k).alias("n")) for k, le in enumerate(("100", "500", "1000", "5000", "10000", "+Inf"))])).alias("r")
    return c.select(rows).select("r.le", "r.n")


def metrics_json(spark: SparkSession, d: str) -> DataFrame:
    """Escalations by action and level, and latencies of all requests, as one JSON document."""
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    e = _decided(spark, d).agg(F.count("*").alias("all"), *[n(F.col("action") == a).alias(a) for a in ("allow", "block", "challenge", "rate_limit")], *[n(F.col("level") == x).alias(x) for x in ("none", "low", "medium", "high", "critical")])
    c = e.join(F.broadcast(_latency_cells(spark, d)))
    named = lambda *pairs: F.struct(*[F.col(a).alias(b) for a, b in pairs])
    req = named(("all", "total"), ("allow", "allowed"), ("block", "blocked"), ("challenge", "challenged"), ("rate_limit", "rate_limited")).alias("requests")
    lev = named(*[(x, x) for x in ("none", "low", "medium", "high", "critical")]).alias("risk_levels")
    lat = F.struct(F.col("avg_us"), named(*[(f"n{k}", b) for k, b in enumerate(("under_100us", "under_500us", "under_1ms", "under_5ms", "under_10ms", "over_10ms"))]).alias("buckets")).alias("latency")
    return c.select(F.to_json(F.struct(req, lev, lat)).alias("document"))


def service_stats(spark: SparkSession, d: str) -> DataFrame:
    """Bans in force, challenges open and escalations of the last day at the latest event."""
    now = _now(spark, d)
    e = escalations(spark, d).select("level", F.unix_seconds("ts").alias("epoch")).join(now)
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    counts = e.agg(n((F.col("level") == "HIGH") & (F.col("epoch") <= F.col("now")) & (F.col("epoch") + G.EXPIRY_SECS > F.col("now"))).alias("pending_challenges"), n((F.col("epoch") > F.col("now") - 86_400) & (F.col("epoch") <= F.col("now"))).alias("escalations_today"))
    return bans_active(spark, d).agg(F.count("*").alias("active_bans")).join(F.broadcast(counts))


def health(spark: SparkSession, d: str) -> DataFrame:
    """One row: the tables each layer needs are there."""
    there = lambda *names: F.lit(all(bool(table(spark, d, n).columns) for n in names))
    return spark.range(1).select(F.lit("healthy").alias("status"), there("requests", "threats", "cidr").alias("edge_ready"), there("requests").alias("neural_ready"), there("requests").alias("behavior_ready"), there("bans", "escalations").alias("response_ready"))


def escalation_totals(spark: SparkSession, d: str, last: int = 1000) -> DataFrame:
    """Total and counts by level of the latest escalations, in one row."""
    e = escalations(spark, d).select("escalation_id", "level", "ts").orderBy(F.desc("ts"), F.desc("escalation_id")).limit(last)
    n = lambda x: F.sum((F.col("level") == x).cast("bigint"))
    return e.agg(F.count("*").alias("total"), *[F.coalesce(n(x.upper()), F.lit(0)).alias(x) for x in ("low", "medium", "high", "critical")])


def escalation_log(spark: SparkSession, d: str) -> DataFrame:
    """Escalations as structured log lines, with times of RFC 3339 and flags as text."""
    e = escalations(spark, d)
    flags = F.concat(F.lit("["), F.array_join(F.coalesce("flags", F.array().cast("array<string>")), ", "), F.lit("]"))
    severe = F.col("level") == "CRITICAL"
    fields = F.struct(F.when(severe, "SECURITY ESCALATION").otherwise("Security escalation").alias("message"), F.col("level"), F.col("client_ip").alias("ip"), flags.alias("flags"))
    return e.select("escalation_id", F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.when(severe, "ERROR").otherwise("WARN").alias("level"), fields.alias("fields"))).alias("line"))


def retrain_gate(spark: SparkSession, d: str, least: int = 50) -> DataFrame:
    """Whether there are samples enough to train again."""
    return _labelled(spark, d).agg(F.count("*").alias("n"), (F.count("*") >= least).alias("retrain"))


def training_lines(spark: SparkSession, d: str) -> DataFrame:
    """Samples as JSON lines; part 0 holds the positive ones, part 1 the negative."""
    x = _labelled(spark, d)
    return x.select("log_id", (1 - F.col("label")).alias("part"), F.to_json(F.struct("text", "label")).alias("line"))


def live_filters(spark: SparkSession, d: str) -> DataFrame:
    """Rows that clean-ups by age leave at the latest event: agents (an hour), sessions (a day), trap hits (a day), bans."""
    r = requests(spark, d, "ts_us", "client_ip", "auth_header", "agent_id", "cookie", "x_session_id", "path").join(_now(spark, d))
    within = lambda secs: F.expr(f"ts_us div 1000000 > now - {secs}")
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    agent, session = agent_key(F.col("auth_header"), F.col("agent_id")), session_id(F.col("auth_header"), F.col("cookie"), F.col("x_session_id"))
    out = r.agg(n(within(3600) & agent.isNotNull()).alias("profile_rows"), n(within(86_400) & session.isNotNull()).alias("session_rows"), n(within(86_400) & E.is_trap(F.col("path"))).alias("trap_rows"))
    return out.join(F.broadcast(bans_active(spark, d).agg(F.count("*").alias("bans"))))


_FUNCTIONS = (api_response, middleware_result, enforcement_result, error_mapping, api_envelope, challenges, challenge_verify, challenge_pending, action_history, bans_unbanned, ban_counts_restarted, ban_terms, ban_totals, agent_bans, filter_sets, threat_lists, custom_traps, request_adapter, rate_peek, tracked_keys, signature_cap, feature_stats, latency_cumulative, metrics_json, service_stats, health, escalation_totals, escalation_log, retrain_gate, training_lines, live_filters)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_HASH = lambda part: f"sha256('{part}-' || escalation_id::VARCHAR)"
_NUM = lambda part, below: f"(('0x' || substr({_HASH(part)}, 1, 8))::BIGINT % {below})"
_D = f"""{E_}, de AS (SELECT escalation_id, lower(level) AS level, coalesce(flags, []) AS flags, client_ip, score, epoch_us(ts) // 1000000 AS epoch, substr({_HASH("id")}, 1, 32) AS cid,
      CASE lower(level) WHEN 'critical' THEN 'block' WHEN 'high' THEN 'challenge' WHEN 'medium' THEN CASE WHEN len(coalesce(flags, [])) >= 2 THEN 'challenge' ELSE 'rate_limit' END WHEN 'low' THEN 'rate_limit' ELSE 'allow' END AS action, CASE lower(level) WHEN 'high' THEN 'ProofOfWork' ELSE 'Interactive' END AS kind FROM e),
    rp AS (SELECT *, CASE level WHEN 'medium' THEN 30 ELSE 60 END AS rpm FROM de)"""
_CH = f"""{_D}, c0 AS (SELECT escalation_id, level, epoch AS created_epoch, cid AS challenge_id, ['ProofOfWork', 'Interactive', 'Token', 'RateDelay', 'SignatureVerification'][escalation_id % 5 + 1] AS kind, CASE level WHEN 'critical' THEN 6 WHEN 'high' THEN 5 ELSE 4 END AS dif,
      substr({_HASH("nonce")}, 1, 32) AS nonce, substr({_HASH("token")}, 1, 32) AS token, {_NUM("a", 10)} + 1 AS a, {_NUM("b", 10)} + 1 AS b, {_NUM("delay", 2000)} + 1000 AS delay FROM de),
    ch AS (SELECT *, CASE kind WHEN 'ProofOfWork' THEN '{{"algorithm":"sha256","difficulty":' || dif || ',"nonce":"' || nonce || '","prefix":"' || repeat('0', dif) || '"}}' WHEN 'Interactive' THEN '{{"question":"What is ' || a || ' + ' || b || '?","type":"math"}}' WHEN 'Token' THEN '{{"token":"' || token || '"}}'
      WHEN 'RateDelay' THEN '{{"delay_ms":' || delay || ',"token":"' || token || '"}}' ELSE '{{"algorithm":"ed25519","nonce":"' || nonce || '"}}' END AS data, CASE kind WHEN 'Interactive' THEN (a + b)::VARCHAR WHEN 'Token' THEN token WHEN 'RateDelay' THEN token ELSE '' END AS solution FROM c0),
    tr AS (SELECT escalation_id * 10 + n AS attempt_id, ch.*, CASE WHEN n = escalation_id % 6 + 1 THEN solution ELSE 'no' || n END AS response, created_epoch + (n - 1) * CASE WHEN escalation_id % 4 = 0 THEN 170 ELSE 70 END AS epoch FROM ch, range(1, 6) t(n)),
    tr1 AS (SELECT *, epoch > created_epoch + 300 AS late, CASE kind WHEN 'ProofOfWork' THEN starts_with(sha256(nonce || response), repeat('0', dif)) WHEN 'SignatureVerification' THEN false ELSE response = solution END AS ok, row_number() OVER (PARTITION BY challenge_id ORDER BY epoch, attempt_id) - 1 AS k FROM tr),
    tr2 AS (SELECT *, coalesce(bool_or(ok AND k < 3 AND NOT late) OVER w, false) AS solved, coalesce(bool_or(late) OVER w, false) AS gone FROM tr1 WINDOW w AS (PARTITION BY challenge_id ORDER BY epoch, attempt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    vf AS (SELECT attempt_id, challenge_id, created_epoch, epoch, kind, CASE WHEN solved OR gone OR k > 3 THEN 'not_found' WHEN late THEN 'expired' WHEN k = 3 THEN 'exhausted' WHEN ok THEN 'solved' ELSE 'wrong' END AS outcome FROM tr2)"""
_TEXT = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.REASON_TEXT.items()) + f" ELSE coalesce({c}, 'unknown') END"
_ACT = f"{L}, ac AS (SELECT log_id, ip, action, epoch_us(log_ts::TIMESTAMPTZ) AS us FROM l WHERE ip IS NOT NULL AND action IS NOT NULL)"
_LIVE = f"bl AS (SELECT ip, arg_max({{'e': expires_epoch}}, (created_epoch, ban_id)) AS b FROM bans GROUP BY ip), lv AS (SELECT ip FROM bl WHERE b.e IS NULL OR b.e > {NOW_SQL})"
_LAT = "la AS (SELECT request_id, min(epoch_us(received_ts) - ts_us) AS us FROM requests GROUP BY 1), lc AS (SELECT count(*) AS total, coalesce(sum(us)::BIGINT // nullif(count(us), 0), 0) AS avg_us, count(*) FILTER (us < 100) AS n0, count(*) FILTER (us >= 100 AND us < 500) AS n1, count(*) FILTER (us >= 500 AND us < 1000) AS n2, count(*) FILTER (us >= 1000 AND us < 5000) AS n3, count(*) FILTER (us >= 5000 AND us < 10000) AS n4, count(*) FILTER (us >= 10000) AS n5 FROM la)"
_FT = {"path_length": "strlen(path)", "param_count": "coalesce(len(string_split(query_string, '&')), 0)", "body_size": "coalesce(strlen(body), 0)", "header_count": "(user_agent IS NOT NULL)::INT + (accept_language IS NOT NULL)::INT + (auth_header IS NOT NULL)::INT + (cookie IS NOT NULL)::INT + (x_session_id IS NOT NULL)::INT", "method_ordinal": "CASE method WHEN 'GET' THEN 0 WHEN 'POST' THEN 1 WHEN 'PUT' THEN 2 WHEN 'DELETE' THEN 3 WHEN 'PATCH' THEN 4 ELSE 5 END"}
_FEATURES = " UNION ALL ".join(f"SELECT '{n}' AS feature, ({x})::BIGINT AS v FROM r" for n, x in _FT.items())
_IS_IP = "coalesce(regexp_full_match(client_ip, '(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])') OR contains(client_ip, ':'), false)"

ORACLE = {
    "api_response": f"""WITH {_D} SELECT escalation_id, action, CASE action WHEN 'block' THEN '{{"reason":"Security threat detected","retry_after_secs":86400}}' WHEN 'challenge' THEN '{{"challenge_id":"' || cid || '","challenge_type":"' || kind || '"}}' WHEN 'rate_limit' THEN '{{"requests_per_minute":' || rpm || '}}' ELSE '{{}}' END AS details FROM rp""",
    "middleware_result": f"""WITH {_D} SELECT escalation_id, CASE action WHEN 'block' THEN 403 WHEN 'challenge' THEN 429 ELSE 200 END::INT AS status_code, action IN ('allow', 'rate_limit') AS proceeds,
        CASE action WHEN 'block' THEN '{{"Retry-After":"86400"}}' WHEN 'challenge' THEN '{{"X-Challenge-ID":"' || cid || '"}}' WHEN 'rate_limit' THEN '{{"X-RateLimit-Remaining":"' || rpm || '","X-RateLimit-Reset":"' || (epoch + 60) || '"}}' ELSE '{{}}' END AS headers,
        CASE action WHEN 'block' THEN '{{"error":"Forbidden","message":"Security threat detected","retry_after":86400}}' WHEN 'challenge' THEN '{{"error":"Challenge Required","challenge":{{"id":"' || cid || '","type":"' || kind || '","expires_in":300}}}}' END AS body FROM rp""",
    "enforcement_result": f"""WITH {_D}, h AS (SELECT *, '{{"X-Request-ID":"' || escalation_id || '","X-Risk-Score":"' || printf('%.3f', score) || '"' AS base, CASE WHEN score >= 0.9 THEN 0 WHEN score >= 0.7 THEN 25 WHEN score >= 0.4 THEN 50 WHEN score >= 0.1 THEN 90 ELSE 100 END AS f FROM rp)
        SELECT escalation_id, CASE action WHEN 'block' THEN 403 WHEN 'challenge' THEN 428 ELSE 200 END::INT AS status, action IN ('allow', 'rate_limit') AS allowed, base || CASE action WHEN 'rate_limit' THEN ',"X-RateLimit-Limit":"' || f || '"' WHEN 'challenge' THEN ',"Retry-After":"60"' WHEN 'block' THEN ',"Retry-After":"86400"' ELSE '' END || '}}' AS headers,
        CASE action WHEN 'challenge' THEN '{{"error":{{"code":"CHALLENGE_REQUIRED","message":"Security challenge required"}}}}' WHEN 'block' THEN '{{"error":{{"code":"BLOCKED","message":"Security threat detected"}}}}' ELSE '{{}}' END AS body FROM h""",
    "error_mapping": f"WITH {_D}, k AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}, '{c}')" for a, b, c in S.ERRORS) + ") v(error, status, code)), m AS (SELECT CASE action WHEN 'block' THEN 'IpBlocked' WHEN 'challenge' THEN 'ChallengeRequired' WHEN 'rate_limit' THEN 'RateLimitExceeded' END AS error, count(*) AS n FROM de GROUP BY 1) SELECT k.error, status::INT AS status, code, status >= 500 AS is_server_error, coalesce(n, 0) AS n FROM k LEFT JOIN m ON m.error = k.error",
    "api_envelope": f"""SELECT ban_id, CASE WHEN reason IS NULL THEN '{{"success":false,"error":"no reason"}}' ELSE '{{"success":true,"data":{{"ip":"' || ip || '","reason":"' || {_TEXT("reason")} || '"}}}}' END AS answer FROM bans""",
    "challenges": f"WITH {_CH} SELECT escalation_id, challenge_id, kind, data, solution, created_epoch + 300 AS expires_epoch FROM ch",
    "challenge_verify": f"WITH {_CH} SELECT attempt_id, challenge_id, epoch, outcome FROM vf",
    "challenge_pending": f"WITH {_CH} SELECT kind, count(*) AS n FROM ch WHERE challenge_id NOT IN (SELECT challenge_id FROM vf WHERE epoch <= created_epoch + 150 AND outcome IN ('solved', 'expired', 'exhausted')) GROUP BY 1",
    "action_history": f"WITH {_ACT}, k AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY us DESC, log_id DESC) AS nth, count(*) OVER (PARTITION BY ip) AS n FROM ac) SELECT log_id, ip, action, nth::INT AS nth FROM k WHERE nth <= CASE WHEN n <= 100 THEN n ELSE 51 + (n - 101) % 50 END",
    "bans_unbanned": "SELECT ban_id, ip FROM bans WHERE ip NOT IN (SELECT ip FROM threats WHERE ip IS NOT NULL)",
    "ban_counts_restarted": "WITH x AS (SELECT *, coalesce(lag(expires_epoch) OVER w < created_epoch, false) OR lag(ban_id) OVER w IS NULL AS fresh FROM bans WINDOW w AS (PARTITION BY ip ORDER BY created_epoch, ban_id)), y AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY ip ORDER BY created_epoch, ban_id) AS run FROM x) SELECT ban_id, ip, row_number() OVER (PARTITION BY ip, run ORDER BY created_epoch, ban_id) AS nth FROM y",
    "ban_terms": f"WITH {L} SELECT log_id, CASE WHEN duration_secs > 0 THEN epoch_us(log_ts::TIMESTAMPTZ) // 1000000 + duration_secs END AS expires_epoch, {_TEXT('reason')} AS reason_text FROM l WHERE message = 'IP banned'",
    "ban_totals": f"WITH {_LIVE} SELECT count(DISTINCT ip) AS banned, count(DISTINCT ip) FILTER (expires_epoch IS NULL) AS for_ever, (SELECT count(*) FROM lv) AS active FROM bans",
    "agent_bans": f"WITH {R}, {E_}, x AS (SELECT {AGENT} AS agent, epoch_us(e.ts) // 1000000 AS epoch FROM e JOIN r USING (request_id) WHERE level = 'CRITICAL') SELECT agent, 'CriticalRisk' AS reason, min(epoch) AS created_epoch, max(epoch) + 86400 AS expires_epoch, count(*) AS ban_count FROM x WHERE agent IS NOT NULL GROUP BY 1",
    "filter_sets": f"WITH {_LIVE} SELECT CASE WHEN contains(ip, ':') THEN 'v6' ELSE 'v4' END AS family, ip FROM lv WHERE ip IS NOT NULL",
    "threat_lists": f"WITH {R} SELECT ip, threat_type FROM threats WHERE threat_type <> 'proxy' UNION SELECT client_ip, 'scanner' FROM r WHERE {TRAP}",
    "custom_traps": f"WITH {R} SELECT request_id, path, CASE path WHEN '/health' THEN 418 END::INT AS status_code, CASE path WHEN '/health' THEN 'text/plain' END AS content_type FROM r WHERE {TRAP} OR lower(path) IN ('/api/v1/search', '/health')",
    "request_adapter": f"WITH {R} SELECT request_id, client_ip, NOT {_IS_IP} AS ip_error, 'GET' AS method, user_agent, 2 AS n_headers, CASE WHEN body IS NULL THEN 'none' WHEN json_valid(body) THEN 'json' ELSE 'text' END AS body_kind, coalesce(strlen(body), 0)::INT AS content_length FROM r",
    "rate_peek": f"""WITH {R}, {E_}, f AS (SELECT client_ip, min(ts_us) AS f FROM r GROUP BY 1), q AS (SELECT r.client_ip, ts_us, (ts_us - f) // 60000000 AS k FROM r JOIN f ON f.client_ip = r.client_ip), p AS (SELECT escalation_id, e.client_ip, epoch_us(ts) AS t, f, CASE WHEN epoch_us(ts) >= f THEN (epoch_us(ts) - f) // 60000000 END AS k FROM e LEFT JOIN f ON f.client_ip = e.client_ip),
        n AS (SELECT escalation_id, count(*) FILTER (q.k = p.k AND q.ts_us < t) AS cur, count(*) FILTER (q.k = p.k - 1) AS prev FROM p JOIN q ON q.client_ip = p.client_ip AND q.k BETWEEN p.k - 1 AND p.k GROUP BY 1),
        z AS (SELECT p.*, coalesce(t > f, false) AS seen, CASE WHEN coalesce(t > f, false) THEN coalesce(cur, 0) + coalesce(prev, 0) * (1.0::DOUBLE - ((t - f) % 60000000 // 1000)::DOUBLE / 60000::DOUBLE) ELSE 0 END AS total FROM p LEFT JOIN n USING (escalation_id))
        SELECT escalation_id AS probe_id, client_ip, round(total, 6) AS total, total > 60 AS is_limited, floor(greatest(0, 60 - total))::BIGINT AS remaining, CASE WHEN seen THEN (60000000 - (t - f) % 60000000) // 1000000 ELSE 60 END AS reset_in_secs FROM z""",
    "tracked_keys": f"""WITH {R}, k AS (SELECT 'ip' AS kind, client_ip AS key, 120 AS ttl, ts_us FROM r UNION ALL SELECT 'agent', {AGENT}, 3600, ts_us FROM r UNION ALL SELECT 'session', {SESSION}, 86400, ts_us FROM r UNION ALL SELECT 'cluster', concat_ws('|', {SHAPE}, coalesce(method, ''), coalesce(user_agent, '')), 300, ts_us FROM r),
        s AS (SELECT kind, key, ttl, max(ts_us) AS last FROM k WHERE key IS NOT NULL GROUP BY ALL) SELECT kind, count(*) AS tracked, count(*) FILTER (last // 1000000 >= {NOW_SQL} - ttl) AS live FROM s GROUP BY 1""",
    "signature_cap": f"WITH {R}, s AS (SELECT request_id, ts_us, client_ip, concat_ws('|', {SHAPE}, coalesce(method, ''), coalesce(user_agent, '')) AS g FROM r), y AS (SELECT g FROM s GROUP BY 1 HAVING {NOW_SQL} - min(ts_us) // 1000000 < 1296000), k AS (SELECT *, row_number() OVER (PARTITION BY client_ip ORDER BY ts_us, request_id) AS n FROM s) SELECT client_ip, count(*) AS kept FROM k WHERE n <= 1000 AND g IN (SELECT g FROM y) GROUP BY 1",
    "feature_stats": f"WITH {R}, f AS ({_FEATURES}) SELECT feature, count(*) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 1), 6) AS sd, min(v) AS least, max(v) AS greatest FROM f GROUP BY 1",
    "latency_cumulative": f"WITH {_LAT} SELECT unnest(['100', '500', '1000', '5000', '10000', '+Inf']) AS le, unnest([n0, n0 + n1, n0 + n1 + n2, n0 + n1 + n2 + n3, n0 + n1 + n2 + n3 + n4, n0 + n1 + n2 + n3 + n4 + n5]) AS n FROM lc",
    "metrics_json": f"""WITH {_D}, {_LAT}, a AS (SELECT count(*) AS t, {", ".join(f"count(*) FILTER (action = '{x}') AS {x}_" for x in ("allow", "block", "challenge", "rate_limit"))}, {", ".join(f"count(*) FILTER (level = '{x}') AS {x}_" for x in ("none", "low", "medium", "high", "critical"))} FROM de)
        SELECT '{{"requests":{{"total":' || t || ',"allowed":' || allow_ || ',"blocked":' || block_ || ',"challenged":' || challenge_ || ',"rate_limited":' || rate_limit_ || '}},"risk_levels":{{"none":' || none_ || ',"low":' || low_ || ',"medium":' || medium_ || ',"high":' || high_ || ',"critical":' || critical_ || '}},"latency":{{"avg_us":' || avg_us || ',"buckets":{{"under_100us":' || n0 || ',"under_500us":' || n1 || ',"under_1ms":' || n2 || ',"under_5ms":' || n3 || ',"under_10ms":' || n4 || ',"over_10ms":' || n5 || '}}}}}}' AS document FROM a, lc""",
    "service_stats": f"WITH {_LIVE}, {E_}, x AS (SELECT level, epoch_us(ts) // 1000000 AS t, {NOW_SQL} AS now FROM e) SELECT (SELECT count(*) FROM lv) AS active_bans, count(*) FILTER (level = 'HIGH' AND t <= now AND t + 300 > now) AS pending_challenges, count(*) FILTER (t > now - 86400 AND t <= now) AS escalations_today FROM x",
    "health": "SELECT 'healthy' AS status, true AS edge_ready, true AS neural_ready, true AS behavior_ready, true AS response_ready",
    "escalation_totals": f"WITH {E_}, x AS (SELECT level FROM e ORDER BY ts DESC, escalation_id DESC LIMIT 1000) SELECT count(*) AS total, count(*) FILTER (level = 'LOW') AS low, count(*) FILTER (level = 'MEDIUM') AS medium, count(*) FILTER (level = 'HIGH') AS high, count(*) FILTER (level = 'CRITICAL') AS critical FROM x",
    "escalation_log": f"""WITH {E_} SELECT escalation_id, '{{"timestamp":"' || strftime(ts AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') || '","level":"' || CASE level WHEN 'CRITICAL' THEN 'ERROR' ELSE 'WARN' END || '","fields":{{"message":"' || CASE level WHEN 'CRITICAL' THEN 'SECURITY ESCALATION' ELSE 'Security escalation' END || '","level":"' || level || '","ip":"' || client_ip || '","flags":"[' || array_to_string(coalesce(flags, []), ', ') || ']"}}}}' AS line FROM e""",
    "retrain_gate": f"WITH {_LAB} SELECT count(*) AS n, count(*) >= 50 AS retrain FROM lb WHERE label IS NOT NULL",
    "training_lines": f"""WITH {_LAB} SELECT log_id, 1 - label AS part, '{{"text":' || to_json(text)::VARCHAR || ',"label":' || label || '}}' AS line FROM lb WHERE label IS NOT NULL""",
    "live_filters": f"WITH {R}, {_LIVE}, x AS (SELECT ts_us // 1000000 AS t, {NOW_SQL} AS now, {AGENT} AS a, {SESSION} AS s, {TRAP} AS trap FROM r) SELECT count(*) FILTER (t > now - 3600 AND a IS NOT NULL) AS profile_rows, count(*) FILTER (t > now - 86400 AND s IS NOT NULL) AS session_rows, count(*) FILTER (t > now - 86400 AND trap) AS trap_rows, (SELECT count(*) FROM lv) AS bans FROM x",
}
