"""Queries over risk, bans, escalations, metrics, logs and training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palisade.functions import patterns as P
from palisade.operators import risk as K
from palisade.operators.windows import by_rows, by_size, heavy_keys, rows_at_most, running
from palisade.plans.common import E_, L, R, logs, requests
from palisade.plans.detectors import _N, AGENT, LEVEL, neural_score
from palisade.plans.layers import EDGE_SQL, behavior_score, behavior_sql, edge_score
from palisade.sources.tables import once, table

#: Flags of escalations that stand for components of the unified score.
COMPONENTS = {"DirectInjection": "prompt_injection", "IndirectInjection": "prompt_injection", "ToxicContent": "content_toxicity", "RateLimitExceeded": "rate_limit_pressure", "SessionAnomaly": "behavioral_anomaly", "Coordinated": "coordinated_attack"}
#: The moment at which "active" and "recent" are asked: the latest event of the tables.
NOW_SQL = "(SELECT max(ts_us) // 1000000 FROM requests)"


def escalations(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "escalations"), "escalation_id")


def layer_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Total and level of edge, text and behaviour scores of every request; a layer without a score counts 0."""
    scores = behavior_score(spark, d).select("request_id", "behavior_score").join(neural_score(spark, d).select("request_id", "neural_score"), "request_id", "full")
    scores = scores.join(edge_score(spark, d).select("request_id", "edge_score"), "request_id", "full")
    part = lambda c: F.coalesce(c, F.lit(0.0))
    x = scores.select("request_id", F.round(K.total(part("edge_score"), part("neural_score"), part("behavior_score")), 6).alias("total"))
    return x.withColumn("level", F.when(F.col("total") >= 0.8, "critical").when(F.col("total") >= 0.6, "high").when(F.col("total") >= 0.4, "medium").when(F.col("total") >= 0.2, "low").otherwise("none"))


def unified_risk(spark: SparkSession, d: str) -> DataFrame:
    """Weighed score of every escalation from the components its flags stand for."""
    source = F.element_at(F.create_map(*[F.lit(x) for kv in COMPONENTS.items() for x in kv]), F.col("flag"))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in K.WEIGHTS.items() for x in kv]), F.col("source"))
    e = escalations(spark, d).select("escalation_id", "score", F.explode("flags").alias("flag")).where(F.col("flag").isin(list(COMPONENTS)))
    c = e.select("escalation_id", source.alias("source"), "score").distinct().withColumn("weight", weight).withColumn("confidence", F.lit(0.9))
    u = K.unified(c, "escalation_id")
    return u.select("escalation_id", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), "has_critical", K.unified_level(F.round("score", 6)).alias("level"), K.multiplier(K.unified_level(F.round("score", 6))).alias("multiplier"))


def recommended_action(spark: SparkSession, d: str) -> DataFrame:
    has = lambda *names: F.when(F.coalesce(F.arrays_overlap("flags", F.array(*map(F.lit, names))), F.lit(False)), F.col("score"))
    return escalations(spark, d).select("escalation_id", K.recommended(F.col("score"), has("DirectInjection", "IndirectInjection"), has("Coordinated")).alias("action"))


def _pipeline(spark: SparkSession, d: str) -> DataFrame:
    return K.pipeline(table(spark, d, "requests").drop("received_ts"), table(spark, d, "threats"), table(spark, d, "cidr"), table(spark, d, "bans"))


def final_action(spark: SparkSession, d: str) -> DataFrame:
    """Level, action and flags of every request through all layers."""
    return _pipeline(spark, d).select("request_id", "layer", "level", "action", F.round("score", 6).alias("score"), F.array_join("flags", ",").alias("flags"))


def metrics_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counters of the pipeline: all requests, by action and by level."""
    p = _pipeline(spark, d)
    cells = F.explode(F.array(F.struct(F.lit("total").alias("counter"), F.lit("all").alias("value")), F.struct(F.lit("action").alias("counter"), F.col("action").alias("value")), F.struct(F.lit("level").alias("counter"), F.col("level").alias("value")))).alias("c")
    return p.select(cells).groupBy("c.counter", "c.value").agg(F.count("*").alias("n"))


def prometheus(spark: SparkSession, d: str) -> DataFrame:
    """The counters in exposition format, a line each."""
    m = metrics_counts(spark, d)
    label = F.when(F.col("counter") == "total", F.lit("palisade_requests_total")).otherwise(F.format_string('palisade_requests_by_%s{%s="%s"}', "counter", "counter", "value"))
    return m.select(F.concat_ws(" ", label, F.col("n").cast("string")).alias("line"))


#: Upper bounds of the latency buckets in microseconds.
BUCKETS = [("lt_100us", 100), ("lt_500us", 500), ("lt_1ms", 1000), ("lt_5ms", 5000), ("lt_10ms", 10000)]


def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Requests by time from event to first arrival, in disjoint buckets and added up, with the mean in whole microseconds."""
    r = table(spark, d, "requests").groupBy("request_id").agg(F.min(F.unix_micros("received_ts") - F.col("ts_us")).alias("us"))
    bucket = F.lit(len(BUCKETS))
    for k, (_, top) in reversed(list(enumerate(BUCKETS))):
        bucket = F.when(F.col("us") < top, k).otherwise(bucket)
    n = r.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum("us").alias("us"))
    upto = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    return n.select("bucket", "n", F.sum("n").over(upto).alias("cumulative"), F.expr("us div n").alias("avg_us"))


def _now(spark: SparkSession, d: str) -> DataFrame:
    return F.broadcast(table(spark, d, "requests").agg(F.expr("max(ts_us) div 1000000").alias("now")))


def bans_latest(spark: SparkSession, d: str) -> DataFrame:
    """The ban table after all upserts: the latest ban of each address, and how many it has had."""
    b = table(spark, d, "bans")
    last = b.groupBy("ip").agg(F.max_by(F.struct("ban_id", "reason", "created_epoch", "expires_epoch"), F.struct("created_epoch", "ban_id")).alias("b"), F.count("*").alias("bans"))
    return last.select("ip", "b.*", "bans")


def bans_active(spark: SparkSession, d: str) -> DataFrame:
    """Bans in force at the latest event, with the time that is left."""
    x = bans_latest(spark, d).join(_now(spark, d)).where("expires_epoch IS NULL OR expires_epoch > now")
    return x.select("ip", "reason", F.when(F.col("expires_epoch").isNotNull(), F.greatest(F.lit(0), F.col("expires_epoch") - F.col("now"))).alias("remaining_secs"))


def bans_expired(spark: SparkSession, d: str) -> DataFrame:
    """Addresses whose last ban has run out: what a clean-up deletes."""
    return table(spark, d, "bans").select("ip").distinct().join(bans_active(spark, d), "ip", "left_anti")


def ban_counts(spark: SparkSession, d: str) -> DataFrame:
    by = W.partitionBy("ip").orderBy("created_epoch", "ban_id")
    return table(spark, d, "bans").select("ban_id", "ip", F.row_number().over(by).cast("bigint").alias("nth"))


def ban_reasons(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bans").groupBy(F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("ip").alias("ips"), F.sum(F.col("expires_epoch").isNull().cast("bigint")).alias("permanent"))


def recently_blocked(spark: SparkSession, d: str) -> DataFrame:
    """Whether any of the last five actions of the address before a log record was a block."""
    a = logs(spark, d).where("ip IS NOT NULL AND action IS NOT NULL").select("log_id", "ip", "action", F.unix_micros(F.to_timestamp("log_ts")).alias("us"))
    last = {"recently_blocked": lambda w: F.coalesce(F.max(F.col("action") == "block").over(w.rowsBetween(-5, -1)), F.lit(False))}
    return by_size(a, "ip", heavy_keys(a, ["ip"], rows_at_most(a)), lambda x, cut: by_rows(x, ["ip"], "us", "log_id", 5, last, cut=cut)).select("log_id", "recently_blocked")


def escalation_stats(spark: SparkSession, d: str) -> DataFrame:
    """Levels of the last 1000 escalations."""
    last = escalations(spark, d).select("escalation_id", "level", "ts").orderBy(F.desc("ts"), F.desc("escalation_id")).limit(1000)
    return last.groupBy("level").agg(F.count("*").alias("n"))


def escalation_recent(spark: SparkSession, d: str) -> DataFrame:
    e = escalations(spark, d).orderBy(F.desc("ts"), F.desc("escalation_id")).limit(10)
    return e.select("escalation_id", "level", "client_ip", F.round("score", 6).alias("score"))


def escalation_by_level(spark: SparkSession, d: str) -> DataFrame:
    """The ten latest escalations of each level."""
    n = F.row_number().over(W.partitionBy("level").orderBy(F.desc("ts"), F.desc("escalation_id")))
    return escalations(spark, d).select("escalation_id", "level", n.alias("n")).where("n <= 10")


def escalation_days(spark: SparkSession, d: str) -> DataFrame:
    """Escalations of every UTC day."""
    w = F.window("ts", "1 day")
    return escalations(spark, d).groupBy(w).agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


def pow_verify(spark: SparkSession, d: str) -> DataFrame:
    """Proof of work with the request id as the answer to the user agent: difficulty 1."""
    digest = F.sha2(F.concat(F.coalesce("user_agent", F.lit("")), F.col("request_id").cast("string")), 256)
    return requests(spark, d, "user_agent").select("request_id", digest.alias("digest"), digest.startswith("0").alias("verified"))


def log_threats(spark: SparkSession, d: str) -> DataFrame:
    """Escalation records; those of critical level have a message of their own and are marked."""
    x = logs(spark, d).where(F.col("message").isin("Security escalation", "SECURITY ESCALATION"))
    return x.select("log_id", "log_ts", "event_level", "ip", "path", "score", "flags", (F.col("message") == "SECURITY ESCALATION").alias("is_critical"))


def log_bans(spark: SparkSession, d: str) -> DataFrame:
    return logs(spark, d).where("message = 'IP banned'").select("log_id", "log_ts", "ip", "reason", "duration_secs")


def log_high(spark: SparkSession, d: str) -> DataFrame:
    x = logs(spark, d).where(F.col("level").isin("WARN", "ERROR"))
    return x.select("log_id", "level", "message", F.coalesce("ip", F.lit("N/A")).alias("ip"), F.coalesce("path", F.lit("N/A")).alias("path"))


def log_by_ip(spark: SparkSession, d: str, ip: str = "203.0.113.61") -> DataFrame:
    return logs(spark, d).where(F.col("ip") == ip).select("log_id", "level", "message", F.coalesce("path", F.lit("N/A")).alias("path"))


def log_by_path(spark: SparkSession, d: str, part: str = "/api/") -> DataFrame:
    return logs(spark, d).where(F.col("path").contains(part)).select("log_id", "level", F.coalesce("ip", F.lit("N/A")).alias("ip"), "path")


def log_stats(spark: SparkSession, d: str) -> DataFrame:
    n = lambda cond: F.coalesce(F.sum(cond.cast("bigint")), F.lit(0))
    return logs(spark, d).agg(F.count("*").alias("total"), n(F.col("message") == "Security escalation").alias("threats"), n(F.col("message") == "IP banned").alias("bans"), n(F.col("level") == "ERROR").alias("critical"), n(F.col("level") == "WARN").alias("high"))


def _top(column: str, n: int, severe: bool):  # noqa: ANN202
    def query(spark: SparkSession, d: str) -> DataFrame:
        x = logs(spark, d).where(F.col(column).isNotNull())
        if severe:
            x = x.where(F.col("level").isin("WARN", "ERROR"))
        return x.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)

    return query


def log_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Severe records by hour of the day."""
    x = logs(spark, d).where(F.col("level").isin("WARN", "ERROR"))
    return x.groupBy(F.hour(F.to_timestamp("log_ts")).alias("hour")).agg(F.count("*").alias("n"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Labelled samples from log bodies: positive from a score of 0.5 or a block, negative under 0.2; bodies of 5 to 5000 characters."""
    x = logs(spark, d).where("body <> ''").select("log_id", F.regexp_replace("body", "^[\\p{IsWhite_Space}\\x1c-\\x1f]+|[\\p{IsWhite_Space}\\x1c-\\x1f]+$", "").alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce(F.lower("action").contains("block"), F.lit(False)).alias("blocked"), "flags")
    label = F.when((F.col("score") >= 0.5) | F.col("blocked"), 1).when(F.col("score") < 0.2, 0)
    return x.where(F.length("text").between(5, 5000)).withColumn("label", label).where("label IS NOT NULL")


def training_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("log_id", "text", "label", "score")


def training_cap(spark: SparkSession, d: str, most: int = 50_000) -> DataFrame:
    """The first ``most`` samples of each label in the order of the log."""
    numbered = running(_labelled(spark, d).select("log_id", "label"), ["label"], "log_id", "log_id", {"n": F.lit(1)}, bucket_us=100_000)
    return numbered.where(F.col("n") < most).groupBy("label").agg(F.count("*").alias("n"), F.max("log_id").alias("last_id"))


def flag_frequency(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent flags of positive samples."""
    x = _labelled(spark, d).where("label = 1").select(F.explode(F.split("flags", ",")).alias("f"))
    flag = F.regexp_replace("f", "^[\\[\\]\"' ]+|[\\[\\]\"' ]+$", "")
    return x.select(flag.alias("flag")).where("flag <> ''").groupBy("flag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "flag").limit(10)


def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train").groupBy("label").agg(F.count("*").alias("n"))


def train_split(spark: SparkSession, d: str) -> DataFrame:
    """Stratified split, 90 to 10, by the order of a hash within each label."""
    t = table(spark, d, "train").where("label IS NOT NULL").select("sample_id", "label", F.md5(F.concat(F.lit("42-"), F.col("sample_id").cast("string"))).alias("h"))
    t = t.withColumn("_p", F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint"))
    ranked = running(t, ["label"], "_p", "h", {"_before": F.lit(1)}, bucket_us=1 << 20)
    sizes = t.groupBy("label").agg(F.count("*").alias("_n"))
    share = F.when(F.col("_n") > 1, F.col("_before") / (F.col("_n") - 1)).otherwise(0.0)
    return ranked.join(sizes, "label").select("sample_id", "label", (share >= 0.9).alias("is_test"))


def classifier_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of the score (0.5 or more) against the label."""
    t = table(spark, d, "train").where("label IS NOT NULL AND score IS NOT NULL").select((F.col("score") >= 0.5).alias("p"), (F.col("label") == 1).alias("y"))
    n = lambda cond: F.sum(cond.cast("double"))
    m = t.agg(n(F.col("p") & F.col("y")).alias("tp"), n(F.col("p") & ~F.col("y")).alias("fp"), n(~F.col("p") & F.col("y")).alias("fn"), F.count("*").cast("double").alias("n"), n(F.col("p") == F.col("y")).alias("ok"))
    return m.select(F.round(F.col("ok") / F.col("n"), 6).alias("accuracy"), F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 6).alias("recall"), F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"))


def softmax(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities from the logits (score, 1 - score) of the training samples, shifted by their maximum."""
    t = table(spark, d, "train").where("score IS NOT NULL").select("sample_id", F.array("score", 1.0 - F.col("score")).alias("x"))
    shifted = F.transform("x", lambda v: F.exp(v - F.array_max("x")))
    return t.select("sample_id", F.transform(shifted, lambda v: F.round(v / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b), 6)).alias("p")).select("sample_id", F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1"))


_FUNCTIONS = (layer_fusion, unified_risk, recommended_action, final_action, metrics_counts, prometheus, latency_histogram, bans_latest, bans_active, bans_expired, ban_counts, ban_reasons, recently_blocked, escalation_stats, escalation_recent, escalation_by_level, escalation_days, pow_verify, log_threats, log_bans, log_high, log_by_ip, log_by_path, log_stats, log_timeline, training_labels, training_cap, flag_frequency, class_counts, train_split, classifier_metrics, softmax)
QUERIES = {f.__name__: f for f in _FUNCTIONS} | {"log_top_ips": _top("ip", 20, True), "log_top_paths": _top("path", 20, True), "log_top10_ips": _top("ip", 10, False), "log_top10_paths": _top("path", 10, False)}

_case = lambda c, m, t: "CASE " + c + " " + " ".join(f"WHEN '{a}' THEN {b!r}{t}" for a, b in m.items()) + " END"
_U = f"""{E_}, fl AS (SELECT escalation_id, score, unnest(flags) AS flag FROM e), cp AS (SELECT DISTINCT escalation_id, {_case("flag", COMPONENTS, "")} AS source, score FROM fl), w AS (SELECT *, {_case("source", K.WEIGHTS, "::DOUBLE")} AS weight FROM cp WHERE source IS NOT NULL),
    u AS (SELECT escalation_id, round(greatest(0, least(1, sum(score * weight * 0.9::DOUBLE) / sum(weight))), 6) AS score, round(sum(0.9::DOUBLE * weight) / sum(weight), 6) AS confidence, bool_or(source = 'prompt_injection' AND score > 0.9 OR source = 'coordinated_attack' AND score > 0.8) AS has_critical FROM w GROUP BY 1),
    ul AS (SELECT *, CASE WHEN score >= 0.9 THEN 'critical' WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' WHEN score >= 0.1 THEN 'low' ELSE 'none' END AS level FROM u)"""
_P = f"""{EDGE_SQL.replace("edge AS (SELECT", "edge AS MATERIALIZED (SELECT")}, {_N[len(R) + 2 :]}, t AS MATERIALIZED (SELECT request_id, edge_flags, edge_score, flags AS nf, neural_score AS n, CASE WHEN edge_score >= 0.8 THEN 'edge' WHEN least(1::DOUBLE, edge_score * 0.2::DOUBLE + neural_score * 0.5::DOUBLE) >= 0.6 THEN 'neural' END AS early FROM edge JOIN n USING (request_id)),
    slow AS MATERIALIZED (SELECT r.* FROM r JOIN t USING (request_id) WHERE early IS NULL), {behavior_sql("slow")},
    p0 AS (SELECT request_id, coalesce(early, 'behavior') AS layer, CASE WHEN early = 'edge' THEN edge_score ELSE least(1::DOUBLE, edge_score * 0.2::DOUBLE + n * 0.5::DOUBLE + coalesce(behavior_score, 0) * 0.3::DOUBLE) END AS score,
        CASE WHEN early = 'edge' THEN edge_flags ELSE concat_ws(',', nullif(edge_flags, ''), nullif(nf, ''), nullif(behavior_flags, '')) END AS flags FROM t LEFT JOIN beh USING (request_id)),
    p1 AS (SELECT *, {LEVEL.format("round(score, 9)")} AS level FROM p0),
    bl0 AS (SELECT DISTINCT r.request_id FROM r JOIN bans b ON b.ip = r.client_ip AND b.created_epoch * 1000000 <= r.ts_us AND (b.expires_epoch IS NULL OR r.ts_us <= b.expires_epoch * 1000000)),
    p2 AS (SELECT p1.*, r.ts_us, r.client_ip, {AGENT} AS agent, bl0.request_id IS NOT NULL AS listed FROM p1 JOIN r USING (request_id) LEFT JOIN bl0 ON bl0.request_id = p1.request_id),
    p3 AS (SELECT *, ts_us - max(CASE WHEN level = 'critical' THEN ts_us END) OVER (PARTITION BY client_ip ORDER BY ts_us, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 86400000000 AS by_ip,
        ts_us - max(CASE WHEN level = 'critical' THEN ts_us END) OVER (PARTITION BY agent ORDER BY ts_us, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 86400000000 AND agent IS NOT NULL AS by_agent FROM p2),
    p AS MATERIALIZED (SELECT request_id, layer, level, CASE WHEN listed THEN 'listed' WHEN coalesce(by_ip, false) THEN 'ip' WHEN coalesce(by_agent, false) THEN 'agent' END AS ban, CASE WHEN listed OR coalesce(by_ip, false) OR coalesce(by_agent, false) THEN 'block' ELSE CASE level WHEN 'critical' THEN 'block' WHEN 'high' THEN 'challenge' WHEN 'medium' THEN CASE WHEN contains(flags, ',') THEN 'challenge' ELSE 'rate_limit' END WHEN 'low' THEN 'rate_limit' ELSE 'allow' END END AS action, round(score, 6) AS score, flags FROM p3),
    m AS (SELECT 'total' AS counter, 'all' AS value, count(*) AS n FROM p UNION ALL SELECT 'action', action, count(*) FROM p GROUP BY action UNION ALL SELECT 'level', level, count(*) FROM p GROUP BY level)"""
_BL = "bl AS (SELECT ip, arg_max({'ban_id': ban_id, 'reason': reason, 'created_epoch': created_epoch, 'expires_epoch': expires_epoch}, (created_epoch, ban_id)) AS b, count(*) AS bans FROM bans GROUP BY ip), ba AS (SELECT ip, b.reason AS reason, b.expires_epoch - " + NOW_SQL + " AS remaining_secs FROM bl WHERE b.expires_epoch IS NULL OR b.expires_epoch > " + NOW_SQL + ")"
_LAB = f"""{L}, lb0 AS (SELECT log_id, regexp_replace(body, '^[{P._SPACE}\\x1c-\\x1f]+|[{P._SPACE}\\x1c-\\x1f]+$', '', 'g') AS text, coalesce(score, 0) AS score, coalesce(contains(lower(action), 'block'), false) AS blocked, flags FROM l WHERE body <> ''),
    lb AS (SELECT *, CASE WHEN score >= 0.5 OR blocked THEN 1 WHEN score < 0.2 THEN 0 END AS label FROM lb0 WHERE length(text) BETWEEN 5 AND 5000)"""
_TOP = lambda c, n, severe: f"WITH {L} SELECT {c}, count(*) AS n FROM l WHERE {c} IS NOT NULL {'AND level IN (' + chr(39) + 'WARN' + chr(39) + ', ' + chr(39) + 'ERROR' + chr(39) + ')' if severe else ''} GROUP BY 1 ORDER BY n DESC, {c} LIMIT {n}"

ORACLE = {
    "layer_fusion": f"""WITH {EDGE_SQL}, {_N[len(R) + 2 :]}, {behavior_sql("r")}, t AS (SELECT request_id, round(least(1::DOUBLE, round(edge_score, 6) * 0.2::DOUBLE + neural_score * 0.5::DOUBLE + round(behavior_score, 6) * 0.3::DOUBLE), 6) AS total FROM edge JOIN n USING (request_id) JOIN beh USING (request_id)) SELECT *, {LEVEL.format('total')} AS level FROM t""",
    "unified_risk": f"WITH {_U} SELECT *, CASE level WHEN 'none' THEN 1::DOUBLE WHEN 'low' THEN 0.9 WHEN 'medium' THEN 0.5 WHEN 'high' THEN 0.25 ELSE 0 END AS multiplier FROM ul",
    "recommended_action": f"WITH {E_} SELECT escalation_id, CASE WHEN score > 0.9 AND coalesce(list_has_any(flags, ['DirectInjection', 'IndirectInjection']), false) OR score > 0.8 AND coalesce(list_contains(flags, 'Coordinated'), false) OR score >= 0.9 THEN 'block' WHEN score >= 0.7 THEN 'challenge' WHEN score >= 0.5 THEN 'rate_limit' WHEN score >= 0.3 THEN 'monitor' ELSE 'allow' END AS action FROM e",
    "final_action": f"WITH {_P} SELECT request_id, layer, level, action, score, flags FROM p",
    "metrics_counts": f"WITH {_P} SELECT counter, value, n FROM m",
    "prometheus": f"""WITH {_P} SELECT CASE WHEN counter = 'total' THEN 'palisade_requests_total' ELSE 'palisade_requests_by_' || counter || '{{' || counter || '="' || value || '"}}' END || ' ' || n AS line FROM m""",
    "latency_histogram": "WITH r AS (SELECT request_id, min(epoch_us(received_ts) - ts_us) AS us FROM requests GROUP BY 1), b AS (SELECT CASE WHEN us < 100 THEN 0 WHEN us < 500 THEN 1 WHEN us < 1000 THEN 2 WHEN us < 5000 THEN 3 WHEN us < 10000 THEN 4 ELSE 5 END AS bucket, count(*) AS n, sum(us)::BIGINT AS us FROM r GROUP BY 1) SELECT bucket, n, (sum(n) OVER (ORDER BY bucket))::BIGINT AS cumulative, us // n AS avg_us FROM b",
    "bans_latest": f"WITH {_BL} SELECT ip, b.ban_id AS ban_id, b.reason AS reason, b.created_epoch AS created_epoch, b.expires_epoch AS expires_epoch, bans FROM bl",
    "bans_active": f"WITH {_BL} SELECT * FROM ba",
    "bans_expired": f"WITH {_BL} SELECT ip FROM bl WHERE ip NOT IN (SELECT ip FROM ba)",
    "ban_counts": "SELECT ban_id, ip, row_number() OVER (PARTITION BY ip ORDER BY created_epoch, ban_id) AS nth FROM bans",
    "ban_reasons": "SELECT coalesce(reason, 'unknown') AS reason, count(*) AS n, count(DISTINCT ip) AS ips, sum((expires_epoch IS NULL)::BIGINT)::BIGINT AS permanent FROM bans GROUP BY 1",
    "recently_blocked": f"WITH {L} SELECT log_id, coalesce(max(action = 'block') OVER (PARTITION BY ip ORDER BY log_ts::TIMESTAMPTZ, log_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), false) AS recently_blocked FROM l WHERE ip IS NOT NULL AND action IS NOT NULL",
    "escalation_stats": f"WITH {E_}, x AS (SELECT level FROM e ORDER BY ts DESC, escalation_id DESC LIMIT 1000) SELECT level, count(*) AS n FROM x GROUP BY 1",
    "escalation_recent": f"WITH {E_} SELECT escalation_id, level, client_ip, round(score, 6) AS score FROM e ORDER BY ts DESC, escalation_id DESC LIMIT 10",
    "escalation_by_level": f"WITH {E_}, x AS (SELECT escalation_id, level, (row_number() OVER (PARTITION BY level ORDER BY ts DESC, escalation_id DESC))::INT AS n FROM e) SELECT * FROM x WHERE n <= 10",
    "escalation_days": f"WITH {E_} SELECT strftime(ts AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n FROM e GROUP BY 1",
    "pow_verify": f"WITH {R}, x AS (SELECT request_id, sha256(coalesce(user_agent, '') || request_id::VARCHAR) AS digest FROM r) SELECT request_id, digest, digest LIKE '0%' AS verified FROM x",
    "log_threats": f"WITH {L} SELECT log_id, log_ts, event_level, ip, path, score, flags, message = 'SECURITY ESCALATION' AS is_critical FROM l WHERE message IN ('Security escalation', 'SECURITY ESCALATION')",
    "log_bans": f"WITH {L} SELECT log_id, log_ts, ip, reason, duration_secs FROM l WHERE message = 'IP banned'",
    "log_high": f"WITH {L} SELECT log_id, level, message, coalesce(ip, 'N/A') AS ip, coalesce(path, 'N/A') AS path FROM l WHERE level IN ('WARN', 'ERROR')",
    "log_by_ip": f"WITH {L} SELECT log_id, level, message, coalesce(path, 'N/A') AS path FROM l WHERE ip = '203.0.113.61'",
    "log_by_path": f"WITH {L} SELECT log_id, level, coalesce(ip, 'N/A') AS ip, path FROM l WHERE contains(path, '/api/')",
    "log_stats": f"WITH {L} SELECT count(*) AS total, count(*) FILTER (message = 'Security escalation') AS threats, count(*) FILTER (message = 'IP banned') AS bans, count(*) FILTER (level = 'ERROR') AS critical, count(*) FILTER (level = 'WARN') AS high FROM l",
    "log_timeline": f"WITH {L} SELECT substr(log_ts, 12, 2)::INT AS hour, count(*) AS n FROM l WHERE level IN ('WARN', 'ERROR') GROUP BY 1",
    "training_labels": f"WITH {_LAB} SELECT log_id, text, label, score FROM lb WHERE label IS NOT NULL",
    "training_cap": f"WITH {_LAB}, x AS (SELECT log_id, label, row_number() OVER (PARTITION BY label ORDER BY log_id) AS n FROM lb WHERE label IS NOT NULL) SELECT label, count(*) AS n, max(log_id) AS last_id FROM x WHERE n <= 50000 GROUP BY 1",
    "flag_frequency": f"WITH {_LAB}, x AS (SELECT unnest(string_split(flags, ',')) AS f FROM lb WHERE label = 1), y AS (SELECT trim(f, '[]\"'' ') AS flag FROM x) SELECT flag, count(*) AS n FROM y WHERE flag <> '' GROUP BY 1 ORDER BY n DESC, flag LIMIT 10",
    "class_counts": "SELECT label, count(*) AS n FROM train GROUP BY 1",
    "train_split": "SELECT sample_id, label, percent_rank() OVER (PARTITION BY label ORDER BY md5('42-' || sample_id::VARCHAR), sample_id) >= 0.9 AS is_test FROM train WHERE label IS NOT NULL",
    "classifier_metrics": "WITH t AS (SELECT score >= 0.5 AS p, label = 1 AS y FROM train WHERE label IS NOT NULL AND score IS NOT NULL), m AS (SELECT count(*) FILTER (p AND y)::DOUBLE AS tp, count(*) FILTER (p AND NOT y)::DOUBLE AS fp, count(*) FILTER (NOT p AND y)::DOUBLE AS fn, count(*)::DOUBLE AS n, count(*) FILTER (p = y)::DOUBLE AS ok FROM t) SELECT round(ok / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM m",
    "softmax": "SELECT sample_id, round(exp(score - greatest(score, 1 - score)) / (exp(score - greatest(score, 1 - score)) + exp(1 - score - greatest(score, 1 - score))), 6) AS p0, round(exp(1 - score - greatest(score, 1 - score)) / (exp(score - greatest(score, 1 - score)) + exp(1 - score - greatest(score, 1 - score))), 6) AS p1 FROM train WHERE score IS NOT NULL",
    "log_top_ips": _TOP("ip", 20, True),
    "log_top_paths": _TOP("path", 20, True),
    "log_top10_ips": _TOP("ip", 10, False),
    "log_top10_paths": _TOP("path", 10, False),
}
