"""Behaviour layer: agents, sessions, coordination and anomalies against the history before each row.

Order is (ts_us, request_id) throughout; a row's own values are not part of its history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palisade.functions.text import agent_key, path_shape, session_id
from palisade.operators.windows import by_rows, by_size, by_time, heavy_keys, in_slices, rows_at_most, running, trailing_count
from palisade.session import written

_ORDER = ("ts_us", "request_id")


def agents(requests: DataFrame) -> DataFrame:
    return requests.withColumn("agent", agent_key(F.col("auth_header"), F.col("agent_id"))).where("agent IS NOT NULL")


def _heavy(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    return heavy_keys(df, columns, rows_at_most(df))


def _timed(requests: DataFrame) -> DataFrame:
    """A request without a time has no history and stands before all others."""
    return requests.withColumn("ts_us", F.coalesce("ts_us", F.lit(0)).cast("bigint"))


def _profile(a: DataFrame, cut: bool, window_us: int, most: int, deviation: float) -> DataFrame:
    """Adds request_count, avg_interval_us, velocity_exceeded, pattern_deviation and is_anomalous of a row within its ``agent``."""
    a = by_rows(a, ["agent"], *_ORDER, 1, {"_gap": lambda w: F.col("ts_us") - F.lag("ts_us").over(w)}, cut=cut)
    a = running(a, ["agent"], *_ORDER, {"_before": F.lit(1)}, cut=cut)
    a = trailing_count(a, ["agent"], *_ORDER, "_in", window_us, cut)
    steps = {"request_count": lambda w: F.coalesce(F.lag("_in").over(w), F.lit(0)), "_gaps": lambda w: F.sum("_gap").over(w.rowsBetween(-100, -1)), "_n": lambda w: F.count("_gap").over(w.rowsBetween(-100, -1))}
    a = by_rows(a, ["agent"], *_ORDER, 101, steps, cut=cut)
    a = running(a, ["agent", "path"], *_ORDER, {"_same": F.lit(1)}, cut=cut)
    away = F.when((F.col("_same") == 0) & (F.col("_before") > 10), 0.8).when((F.col("_same") > 0) & (F.col("_before") > 100) & (F.col("_same") / F.col("_before") < 0.01), 0.6).otherwise(0.0)
    a = a.withColumns({"avg_interval_us": F.coalesce(F.expr("_gaps div nullif(_n, 0)"), F.lit(0)), "velocity_exceeded": F.col("request_count") >= most, "pattern_deviation": away})
    odd = F.col("velocity_exceeded") | (F.col("pattern_deviation") > deviation) | ((F.col("avg_interval_us") < 100_000) & (F.col("request_count") > 10))
    return a.withColumn("is_anomalous", odd).drop("_gap", "_before", "_in", "_gaps", "_n", "_same")


def profiles(requests: DataFrame, window_us: int = 3_600_000_000, most: int = 1000, deviation: float = 0.5) -> DataFrame:
    """request_id, agent, request_count, avg_interval_us, velocity_exceeded, pattern_deviation, is_anomalous.

    request_count: rows of the agent in the window as of the row before; avg_interval_us: mean of its last 100 gaps, 0 without
    any; pattern_deviation: 0.8 for an unseen path after more than 10 rows, 0.6 for one with less than a hundredth after more
    than 100. Requests without an agent have no profile.
    """
    a = agents(_timed(requests)).select("request_id", "agent", "ts_us", "path")
    a = by_size(a, "agent", _heavy(a, ["agent"]), lambda x, cut: _profile(x, cut, window_us, most, deviation))
    return a.select("request_id", "agent", "request_count", "avg_interval_us", "velocity_exceeded", "pattern_deviation", "is_anomalous")


def common_endpoints(requests: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent paths of each agent, ties by path."""
    counts = agents(requests).groupBy("agent", "path").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("agent").orderBy(F.desc("n"), "path"))).where(F.col("rank") <= n)


def _fingerprint(s: DataFrame, cut: bool, least: float) -> DataFrame:
    """Adds match, session_score, reasons and is_suspicious of a row against the first of its ``session_id``."""
    facts = F.struct("client_ip", "user_agent", "accept_language", "request_id")
    if cut:  # one row for each heavy session
        first = s.groupBy("session_id").agg(F.min_by(facts, F.struct(*_ORDER)).alias("_f"))
        s = s.join(F.broadcast(first), "session_id")
    else:
        s = s.withColumn("_f", F.first(facts).over(W.partitionBy("session_id").orderBy(*_ORDER).rowsBetween(W.unboundedPreceding, 0)))
    s = by_rows(s, ["session_id"], *_ORDER, 1, {"_last": lambda w: F.lag("ts_us").over(w)}, cut=cut)
    same = lambda c: F.col(c).eqNullSafe(F.col(f"_f.{c}"))
    match = F.when(same("client_ip"), 0.5).otherwise(0.0) + F.when(same("user_agent"), 0.3).otherwise(0.0) + F.when(same("accept_language"), 0.2).otherwise(0.0)
    s = s.withColumn("match", F.when(F.col("_f.request_id") == F.col("request_id"), 1.0).otherwise(match))
    apart = F.col("match") < least
    quick = ~same("client_ip") & (F.col("ts_us") - F.col("_last") < 60_000_000)
    reasons = F.when(apart, F.concat_ws(", ", F.when(~same("client_ip"), "IP changed"), F.when(~same("user_agent"), "User-Agent changed"))).when(quick, "Impossible travel").otherwise("")
    score = F.when(apart, 1.0 - F.col("match")).when(quick, 0.8).otherwise(0.0)
    return s.withColumns({"session_score": score, "reasons": reasons, "is_suspicious": apart | F.coalesce(quick, F.lit(False))}).drop("_f", "_last")


def fingerprints(requests: DataFrame, least: float = 0.7) -> DataFrame:
    """request_id, session_id, match, score, reasons, is_suspicious: the row against the first of its session.

    A match below ``least`` scores 1 - match; else another address less than 60 s after the row before scores 0.8.
    The first row of a session has no history and scores 0. Requests without a session are left out.
    """
    s = _timed(requests).select("request_id", "ts_us", "client_ip", "user_agent", "accept_language", session_id(F.col("auth_header"), F.col("cookie"), F.col("x_session_id")).alias("session_id")).where("session_id IS NOT NULL")
    s = by_size(s, "session_id", _heavy(s, ["session_id"]), lambda x, cut: _fingerprint(x, cut, least))
    return s.select("request_id", "session_id", "match", F.col("session_score").alias("score"), "reasons", "is_suspicious")


def _signature() -> Column:
    """Shape of the path, method, user agent."""
    return F.concat_ws("|", path_shape(F.col("path")), F.coalesce("method", F.lit("")), F.coalesce("user_agent", F.lit("")))


def signatures(requests: DataFrame) -> DataFrame:
    """Requests with their signature: shape of the path, method, user agent."""
    return _timed(requests).select("request_id", "ts_us", "client_ip", _signature().alias("signature"))


def _cluster(s: DataFrame, cut: bool, window_us: int) -> DataFrame:
    """Adds ips and rate of a row within its ``signature``."""
    s = running(s, ["signature"], *_ORDER, {"_at": F.lit(1)}, cut=cut)
    s = running(s, ["signature", "client_ip"], *_ORDER, {"_mine": F.lit(1)}, cut=cut)
    s = running(s, ["signature"], *_ORDER, {"ips": (F.col("_mine") == 0).cast("bigint")}, cut=cut)
    s = trailing_count(s, ["signature"], *_ORDER, "_n", window_us, cut)
    if cut:  # the oldest row of the window is found by its number
        last = running(s, ["signature", "ts_us"], *_ORDER, {"_peers": F.lit(1)}, cut=cut)
        whole = last.groupBy("signature", "ts_us").agg(F.max(F.struct("_at", "_n")).alias("_l")).select("signature", "ts_us", (F.col("_l._at") + 1 - F.col("_l._n")).alias("_oldest"))
        at = s.select("signature", F.col("_at").alias("_oldest"), F.col("ts_us").alias("_from"))
        s = s.join(whole, ["signature", "ts_us"]).join(at, ["signature", "_oldest"]).drop("_oldest")
    else:
        s = by_time(s, ["signature"], "ts_us", window_us, {"_from": lambda w: F.min("ts_us").over(w.rangeBetween(-window_us, 0))}, cut=False)
    s = s.withColumn("_rate", F.when((F.col("_n") > 1) & (F.col("ts_us") > F.col("_from")), F.col("_n") / ((F.col("ts_us") - F.col("_from")) / 1_000_000)).otherwise(0.0))
    s = by_rows(s, ["signature"], *_ORDER, 1, {"rate": lambda w: F.coalesce(F.lag("_rate").over(w), F.lit(0.0))}, cut=cut)
    return s.drop("_at", "_mine", "_n", "_from", "_rate")


def _attack(bot_ips: int, bot_rate: float, probe_ips: int, sybil: int) -> Column:
    return F.when((F.col("ips") >= bot_ips) & (F.col("rate") >= bot_rate), "botnet").when(F.col("ips") >= probe_ips, "distributed_probing").when(F.col("same_ip") >= sybil, "sybil")


def _same_ip(s: DataFrame, cut: bool) -> DataFrame:
    return running(s, ["client_ip"], *_ORDER, {"same_ip": F.lit(1)}, cut=cut)


def _clustered(s: DataFrame, heavy: dict[str, list[str]], window_us: int) -> DataFrame:
    """Adds ips, rate and same_ip; rows of a signature are brought together once, then those of an address."""
    s = by_size(s, "signature", heavy, lambda x, cut: _cluster(x if cut else x.repartition("signature"), cut, window_us))
    return by_size(s, "client_ip", heavy, _same_ip)


def coordination(requests: DataFrame, window_us: int = 300_000_000, bot_ips: int = 10, bot_rate: float = 10.0, probe_ips: int = 5, sybil: int = 20) -> DataFrame:
    """request_id, ips, rate, same_ip, attack.

    ips: addresses that used the signature before; rate: its requests a second over the window as of its row before, 0 with fewer
    than two or no time between; same_ip: requests of the address before. attack: botnet, distributed_probing or sybil, in this order.
    """
    s = signatures(requests)
    s = _clustered(s, _heavy(s, ["signature", "client_ip"]), window_us)
    return s.select("request_id", "ips", "rate", "same_ip", _attack(bot_ips, bot_rate, probe_ips, sybil).alias("attack"))


def clusters(requests: DataFrame) -> DataFrame:
    """Requests, addresses and rate of every signature over all its time."""
    s = signatures(requests)
    per_ip = s.groupBy("signature", "client_ip").agg(F.count("*").alias("n"), F.min("ts_us").alias("a"), F.max("ts_us").alias("b"))
    total = per_ip.groupBy("signature").agg(F.sum("n").alias("n"), F.count("*").alias("ips"), F.min("a").alias("a"), F.max("b").alias("b"))
    return total.select("signature", "n", "ips", F.when((F.col("n") > 1) & (F.col("b") > F.col("a")), F.col("n") / ((F.col("b") - F.col("a")) / 1_000_000)).otherwise(0.0).alias("rate"))


FEATURES = ("path_length", "param_count", "body_size", "header_count", "method_ordinal")


def _features() -> dict[str, Column]:
    headers = sum((F.col(c).isNotNull().cast("bigint") for c in ("user_agent", "accept_language", "auth_header", "cookie", "x_session_id")), F.lit(0))
    at = F.array_position(F.array(*map(F.lit, ("GET", "POST", "PUT", "DELETE", "PATCH"))), F.col("method"))
    length = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint")
    return {"path_length": length("path"), "param_count": F.coalesce(F.size(F.split("query_string", "&")), F.lit(0)).cast("bigint"), "body_size": length("body"), "header_count": headers.cast("bigint"), "method_ordinal": F.when(at > 0, at - 1).otherwise(5).cast("bigint")}


def features(requests: DataFrame) -> DataFrame:
    """request_id, ts_us and five numbers of every request."""
    return _timed(requests).select("request_id", "ts_us", *[c.alias(n) for n, c in _features().items()])


def _strange(f: DataFrame, z: float) -> DataFrame:
    """Adds is_outlier, is_temporal and is_sequence; f has the features and is written."""
    sums = {"_n": F.lit(1)} | {f"_s{i}": F.col(c) for i, c in enumerate(FEATURES)} | {f"_q{i}": F.col(c).cast("decimal(20,0)") * F.col(c) for i, c in enumerate(FEATURES)}
    same = ("path_length", "body_size", "param_count")
    steps = [
        {"_gap": lambda w: F.col("ts_us") - F.lag("ts_us").over(w)},
        {"_gaps": lambda w: F.sum("_gap").over(w.rowsBetween(-100, -1)), "_ng": lambda w: F.count("_gap").over(w.rowsBetween(-100, -1)), "_five": lambda w: F.count(F.lit(1)).over(w.rowsBetween(-5, -1))}
        | {f"_lo_{c}": lambda w, c=c: F.min(c).over(w.rowsBetween(-5, -1)) for c in same}
        | {f"_hi_{c}": lambda w, c=c: F.max(c).over(w.rowsBetween(-5, -1)) for c in same},
    ]
    f = in_slices(f, *_ORDER, sums, 102, steps)
    out = F.lit(False)
    n = F.col("_n").cast("double")
    for i, c in enumerate(FEATURES):
        s, q = F.col(f"_s{i}").cast("double"), F.col(f"_q{i}").cast("double")
        var = (q - s * s / n) / (n - 1)
        dev = F.sqrt(F.greatest(var, F.lit(0.0)))
        out = out | F.when((F.col("_n") >= 100) & (var > 1e-9), F.abs(F.col(c) - s / n) / dev > z).otherwise(False)
    temporal = F.coalesce((F.col("_ng") >= 10) & (F.expr("_gap div 1000") > 0) & (F.expr("(_gaps div _ng) div 1000") / F.expr("nullif(_gap div 1000, 0)") > 10), F.lit(False))
    sequence = F.col("_five") == 5
    for c in same:
        sequence = sequence & (F.col(f"_lo_{c}") == F.col(c)) & (F.col(f"_hi_{c}") == F.col(c))
    f = f.withColumns({"is_outlier": F.coalesce(out, F.lit(False)), "is_temporal": temporal, "is_sequence": F.coalesce(sequence, F.lit(False))})
    return f.drop(*sums, "_gap", "_gaps", "_ng", "_five", *[f"_{a}_{c}" for a in ("lo", "hi") for c in same])


def anomalies(requests: DataFrame, z: float = 3.0) -> DataFrame:
    """request_id, is_outlier, is_temporal, is_sequence over the whole stream of requests as one sequence.

    is_outlier: after 100 rows, a feature more than z sample deviations from its mean (exact integer sums). is_temporal: after
    10 gaps, the mean of the last 100 in whole milliseconds is more than ten times this one. is_sequence: the last five
    rows all have this row's path length, body size and number of parameters.
    """
    return _strange(written(features(requests), "features"), z).select("request_id", "is_outlier", "is_temporal", "is_sequence")


#: What the behaviour layer keeps of a request; of the body, its size.
TRACE = ("request_id", "ts_us", "client_ip", "user_agent", "accept_language", "path", "agent", "session_id", "signature", *FEATURES)


def traces(requests: DataFrame, *more_columns: str) -> DataFrame:
    """The narrow rows the history windows run over, and more_columns. A request without agent or session is alone in one of its own."""
    own = F.concat(F.lit("\0"), F.col("request_id").cast("string"))
    found = agent_key(F.col("auth_header"), F.col("agent_id")), session_id(F.col("auth_header"), F.col("cookie"), F.col("x_session_id"))
    more = {"agent": F.coalesce(found[0], own), "session_id": F.coalesce(found[1], own), "signature": _signature(), **_features()}
    return _timed(requests).withColumns(more).select(*TRACE, *more_columns)


def behavior_of(traced: DataFrame) -> DataFrame:
    """request_id, behavior_flags, behavior_score of written traces: one exchange each for agents, sessions, signatures, addresses and slices of the whole."""
    heavy = _heavy(traced, ["agent", "session_id", "signature", "client_ip"])
    r = _strange(traced, 3.0)
    r = by_size(r, "agent", heavy, lambda x, cut: _profile(x, cut, 3_600_000_000, 1000, 0.5)).drop("request_count", "avg_interval_us")
    r = by_size(r, "session_id", heavy, lambda x, cut: _fingerprint(x, cut, 0.7)).drop("match", "reasons", "user_agent", "accept_language")
    r = _clustered(r, heavy, 300_000_000).withColumn("attack", _attack(10, 10.0, 5, 20))
    known = ~F.col("agent").startswith("\0")
    yes = lambda c: known & F.col(c)
    off = F.when(known, F.col("pattern_deviation")).otherwise(0.0)
    plus = lambda cond, v: F.when(cond, v).otherwise(0.0)
    score = F.col("session_score") * 0.3 + plus(yes("is_anomalous"), 0.4) + plus(yes("velocity_exceeded"), 0.3) + plus(off > 0.5, off * 0.5) + plus(F.col("is_outlier"), 0.3) + plus(F.col("is_temporal"), 0.4) + plus(F.col("is_sequence"), 0.5)
    score = score + F.when(F.col("attack") == "botnet", 0.9).when(F.col("attack") == "distributed_probing", 0.7).when(F.col("attack") == "sybil", 0.8).otherwise(0.0)
    named = F.when(F.col("attack") == "botnet", "CoordinatedBotnet").when(F.col("attack") == "distributed_probing", "DistributedProbing").when(F.col("attack") == "sybil", "SybilAttack")
    flags = F.array_compact(F.array(F.when(F.col("is_suspicious"), F.lit("SuspiciousSession")), F.when(yes("is_anomalous"), F.lit("BehaviorAnomaly")), F.when(yes("velocity_exceeded"), F.lit("VelocityExceeded")), F.when(off > 0.5, F.lit("PatternDeviation")), F.when(F.col("is_outlier"), F.lit("StatisticalAnomaly")), F.when(F.col("is_temporal"), F.lit("TemporalAnomaly")), F.when(F.col("is_sequence"), F.lit("SequenceAnomaly")), named))
    return r.select("request_id", flags.alias("behavior_flags"), F.least(F.lit(1.0), score).alias("behavior_score"))


def behavior(requests: DataFrame) -> DataFrame:
    """request_id, behavior_flags, behavior_score of every request. A request without time, address, agent or session takes part with what it has."""
    return behavior_of(written(traces(requests), "traces"))
