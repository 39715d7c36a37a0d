"""Edge layer: traps, rate limits, floods, reputation of addresses, places of addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palisade.operators.windows import HEAVY, by_rows, by_size, heavy_keys, rows_at_most, running, trailing_count

# Paths that only scanners ask for. Compared with the path in lower case.
EXACT_TRAPS = (
    "/admin /administrator /admin.php /wp-admin /wp-login.php /phpmyadmin /pma /cpanel /plesk /webmail "
    "/.env /.env.local /.env.production /.env.backup /.git/config /.git/HEAD /.gitignore /.aws/credentials /.ssh/id_rsa /.htaccess /.htpasswd "
    "/wp-config.php /config.php /configuration.php /web.config /appsettings.json /debug.log /error.log /access.log /database.sql /dump.sql /backup.sql /db.sql "
    "/graphql /graphiql /playground /swagger.json /openapi.json /api-docs /swagger-ui /swagger-ui.html /actuator /actuator/health /actuator/env /server-status /server-info "
    "/_debug /_profiler /_config /elmah.axd /trace.axd /solr/admin /console /xmlrpc.php /wp-cron.php /wp-includes/ /vendor/phpunit/phpunit/src/Util/PHP/eval-stdin.php /cgi-bin/ /cgi-bin/php "
    "/Dockerfile /docker-compose.yml /docker-compose.yaml /Procfile /Jenkinsfile /.circleci/config.yml /terraform.tfstate /package.json /composer.json /Gemfile /requirements.txt"
).split()
PREFIX_TRAPS = "/wp-admin/ /wp-content/uploads/ /wp-includes/ /phpmyadmin/ /.git/ /.svn/ /cgi-bin/ /vendor/phpunit/".split()
SUFFIX_TRAPS = ".php .asp .aspx .jsp .cgi .bak .old .backup .save .orig .sql .db .sqlite .log .swp .swo".split()
# Autonomous systems of data centers.
DATACENTERS = [13335, 16509, 14618, 15169, 8075, 20940, 54113, 13238, 45090, 37963, 16276, 24940, 63949, 14061, 46844, 55286, 32244]
# Paths that answer with a decoy, and what kind of answer. The bodies are our own.
FAKE_RESPONSES = [
    ("/.env", 200, "APP_MODE=decoy\nDB_HOST=db.invalid\nDB_NAME=nothing_here\nAPI_TOKEN=not-a-token\n", "text/plain"),
    ("/wp-login.php", 200, "<!doctype html><title>Sign in</title><form method=post><input name=user><input name=secret type=password><button>Go</button></form>", "text/html"),
    ("/server-status", 200, "state: idle\nworkers: 4\nqueue: 0\n", "text/plain"),
]
# Reputation by kind of threat, and what the kind adds to the edge score.
REPUTATION = {"blocked": 0.0, "tor": 0.3, "proxy": 0.5, "scanner": 0.2, "botnet": 1.0}
THREAT_RISK = {"blocked": ("KnownAttacker", 0.9), "tor": ("TorExit", 0.2), "proxy": ("Proxy", 0.1), "scanner": ("Scanner", 0.7), "botnet": ("Botnet", 0.95)}


def is_trap(path: Column) -> Column:
    low = F.lower(path)
    return low.isin(EXACT_TRAPS) | reduce(lambda a, b: a | b, [low.startswith(p) for p in PREFIX_TRAPS] + [low.endswith(s) for s in SUFFIX_TRAPS])


def with_traps(requests: DataFrame, more: tuple[str, ...], answers: DataFrame) -> DataFrame:
    """Adds is_trap, by the listed traps and by the paths in more (compared in lower case), and the answer registered for the path as it is written: answers has path, status_code, content_type, a short list."""
    trap = is_trap(F.col("path")) | F.lower("path").isin([p.lower() for p in more])
    return requests.withColumn("is_trap", F.coalesce(trap, F.lit(False))).join(F.broadcast(answers), "path", "left")


def _heavy(df: DataFrame, most: int = HEAVY) -> dict[str, list[str]]:
    return heavy_keys(df, ["client_ip"], rows_at_most(df), most)


def _timed(requests: DataFrame) -> DataFrame:
    """A request without a time stands before all others."""
    return requests.withColumn("ts_us", F.coalesce("ts_us", F.lit(0)).cast("bigint"))


def trap_hits(requests: DataFrame) -> DataFrame:
    """Hits on traps with their number within the address and its score: 0.7, 0.85, then 0.95."""
    trapped = _timed(requests).where(is_trap(F.col("path")))
    hits = by_size(trapped, "client_ip", _heavy(trapped), lambda x, cut: running(x, ["client_ip"], "ts_us", "request_id", {"before": F.lit(1)}, cut=cut))
    return hits.withColumn("hit", F.col("before") + 1).withColumn("score", F.when(F.col("hit") == 1, 0.7).when(F.col("hit") == 2, 0.85).otherwise(0.95)).drop("before")


def _rated(r: DataFrame, cut: bool, window_us: int, most: int) -> DataFrame:
    if cut:  # heavy addresses are few, a window of one holds what came in it
        r = r.join(F.broadcast(r.groupBy(F.col("client_ip").alias("_ip")).agg(F.min("ts_us").alias("_first"))), F.col("client_ip").eqNullSafe(F.col("_ip"))).drop("_ip")
    else:
        r = r.withColumn("_first", F.min("ts_us").over(W.partitionBy("client_ip")))
    r = r.withColumn("_el", F.col("ts_us") - F.col("_first")).withColumn("_k", F.expr(f"_el div {window_us}")).withColumn("_in", F.expr(f"_el % {window_us}"))
    if cut:
        before = r.groupBy(F.col("client_ip").alias("_ip"), (F.col("_k") + 1).alias("_next")).agg(F.count("*").alias("_prev"))
        r = r.join(before, F.col("client_ip").eqNullSafe(F.col("_ip")) & (F.col("_k") == F.col("_next")), "left").drop("_ip", "_next")
        r = running(r, ["client_ip", "_k"], "ts_us", "request_id", {"_cur": F.lit(1)}, bucket_us=window_us).withColumn("_cur", F.col("_cur") + 1)
    else:
        r = r.withColumn("_prev", F.count(F.lit(1)).over(W.partitionBy("client_ip").orderBy("_k").rangeBetween(-1, -1)))
        r = r.withColumn("_cur", F.row_number().over(W.partitionBy("client_ip", "_k").orderBy("ts_us", "request_id")))
    progress = F.expr("_in div 1000") / F.lit(window_us // 1000)
    r = r.withColumn("total", F.col("_cur") + F.coalesce("_prev", F.lit(0)) * (1.0 - progress))
    limited = F.col("total") > most
    more = {"is_limited": limited, "usage_ratio": F.least(F.lit(2.0), F.col("total") / most), "remaining": F.when(limited, 0).otherwise(F.floor(F.greatest(F.lit(0.0), most - F.col("total")))).cast("bigint"), "reset_in_secs": F.expr(f"({window_us} - _in) div 1000000")}
    return r.withColumns(more).drop("_first", "_el", "_k", "_in", "_prev", "_cur")


def rate_limited(requests: DataFrame, window_us: int = 60_000_000, most: int = 60, heavy_from: int = HEAVY) -> DataFrame:
    """Sliding-window counter of each address: requests of its window so far and the weighed count of the window before.

    Windows count from the address's first request; a null address is one of its own, a request without a time stands at 0.
    Adds total, is_limited, usage_ratio (2 at most), remaining, reset_in_secs.
    """
    timed = _timed(requests)
    return by_size(timed, "client_ip", _heavy(timed, heavy_from), lambda x, cut: _rated(x, cut, window_us, most))


def rate_peek(probes: DataFrame, requests: DataFrame, window_us: int = 60_000_000, most: int = 60) -> DataFrame:
    """The counter as it stands at a probe, which itself isn't counted: probes (probe_id, client_ip, ts_us) with total, is_limited, remaining and reset_in_secs.

    An address without requests before the probe has a total of 0. Windows count from its first request.
    """
    first = requests.groupBy("client_ip").agg(F.min("ts_us").alias("_first"))
    window = lambda df: df.withColumn("_k", F.expr(f"(ts_us - _first) div {window_us}"))
    asked = window(probes.select("probe_id", "client_ip", "ts_us").join(first, "client_ip", "left"))
    came = window(requests.select("client_ip", "ts_us").join(first, "client_ip"))
    whole = came.groupBy("client_ip", (F.col("_k") + 1).alias("_k")).agg(F.count("*").alias("_prev"))
    events = came.select("client_ip", "_k", "ts_us", F.lit(None).cast("bigint").alias("probe_id"), F.lit(1).alias("_d")).unionByName(asked.where("_first IS NOT NULL").select("client_ip", "_k", "ts_us", "probe_id", F.lit(0).alias("_d")))
    upto = W.partitionBy("client_ip", "_k").orderBy("ts_us").rangeBetween(W.unboundedPreceding, -1)
    own = events.withColumn("_cur", F.sum("_d").over(upto)).where("probe_id IS NOT NULL").select("probe_id", "_cur")
    r = asked.join(own, "probe_id", "left").join(whole, ["client_ip", "_k"], "left")
    r = r.withColumn("_in", F.expr(f"(ts_us - _first) % {window_us}")).withColumn("_seen", F.coalesce(F.col("ts_us") > F.col("_first"), F.lit(False)))
    total = F.when(F.col("_seen"), F.coalesce("_cur", F.lit(0)) + F.coalesce("_prev", F.lit(0)) * (1.0 - F.expr("_in div 1000") / F.lit(window_us // 1000))).otherwise(0.0)
    r = r.withColumn("total", total)
    return r.select("probe_id", "client_ip", "total", (F.col("total") > most).alias("is_limited"), F.floor(F.greatest(F.lit(0.0), most - F.col("total"))).cast("bigint").alias("remaining"), F.when(F.col("_seen"), F.expr(f"({window_us} - _in) div 1000000")).otherwise(window_us // 1_000_000).cast("bigint").alias("reset_in_secs"))


def _flooded(r: DataFrame, cut: bool, a_second: int, in_ten: int, paths: int) -> DataFrame:
    order = ("ts_us", "request_id")
    r = by_rows(r, ["client_ip"], *order, 99, {"paths_100": lambda w: F.size(F.collect_set("path").over(w.rowsBetween(-99, 0)))}, cut=cut)
    r = trailing_count(r, ["client_ip"], *order, "last_1s", 999_999, cut)
    r = trailing_count(r, ["client_ip"], *order, "last_10s", 9_999_999, cut)
    return r.withColumn("flood", F.when(F.col("last_1s") > a_second, "volumetric").when((F.col("last_10s") > in_ten) & (F.col("paths_100") < paths), "application_layer"))


def floods(requests: DataFrame, a_second: int = 50, in_ten: int = 30, paths: int = 3, heavy_from: int = HEAVY) -> DataFrame:
    """Adds last_1s, last_10s (requests of the address, this one included), paths_100 (paths among its last 100) and flood.

    Requests of an address in the same microsecond count together; a null address is one of its own.
    """
    timed = _timed(requests)
    return by_size(timed, "client_ip", _heavy(timed, heavy_from), lambda x, cut: _flooded(x, cut, a_second, in_ten, paths))


def global_rate(requests: DataFrame, baseline: int = 100) -> DataFrame:
    """Requests of every second, counted from the first request; an attack from five times the baseline."""
    first = requests.agg(F.min("ts_us").alias("_first"))
    seconds = requests.join(F.broadcast(first)).groupBy(F.expr("(ts_us - _first) div 1000000").alias("second")).agg(F.count("*").alias("n"))
    return seconds.withColumn("under_attack", F.col("n") > 5 * baseline)


def ipv4(ip: Column) -> Column:
    """Number of an IPv4 address, null for any other text."""
    p = F.split(ip, "\\.")
    n = sum((F.try_element_at(p, F.lit(i + 1)).try_cast("bigint") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0))
    return F.when(ip.rlike("^(?:(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)(?:\\.(?!$)|$)){4}$"), n)


def places(ips: DataFrame, cidr: DataFrame, bits: int = 16) -> DataFrame:
    """client_ip, country, asn, is_datacenter of each address: from the longest prefix that names a country, and an asn.

    Ranges are cut into blocks of 2^bits addresses, so that the join is on equal blocks and then within the range.
    """
    blocks = cidr.withColumn("_block", F.explode(F.sequence(F.shiftright("start_ip", bits), F.shiftright("end_ip", bits))))
    num = ips.select("client_ip").distinct().withColumn("_n", ipv4(F.col("client_ip")))
    hit = num.withColumn("_block", F.shiftright("_n", bits)).join(blocks, "_block", "left")
    within = F.when(F.col("_n").between(F.col("start_ip"), F.col("end_ip")), F.col("prefix"))
    longest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), within)).alias(c)
    found = hit.groupBy("client_ip").agg(longest("country"), longest("asn"))
    return found.withColumn("is_datacenter", F.coalesce(F.col("asn").isin(DATACENTERS), F.lit(False)))


def ban_days(bans: DataFrame, last_day: int) -> DataFrame:
    """Bans spread over the days they hold, up to last_day: joined to requests on (ip, day), no address meets all its bans at once."""
    to = F.least(F.coalesce(F.expr("expires_epoch div 86400"), F.lit(last_day)), F.lit(last_day))
    day = F.expr("created_epoch div 86400")
    return bans.where(day <= to).withColumn("_day", F.explode(F.sequence(day, to)))


def _held(requests: DataFrame, bans: DataFrame, cut: bool) -> DataFrame:
    """Adds _bans, the bans that may be in force. Those of an address are one list; a heavy address meets those of the day only."""
    one = F.struct("created_epoch", "expires_epoch")
    if not cut:
        return requests.join(bans.groupBy(F.col("ip").alias("client_ip")).agg(F.collect_list(one).alias("_bans")), "client_ip", "left")
    last = requests.agg(F.expr("max(ts_us) div 86400000000")).first()[0] or 0
    spread = ban_days(bans, last).groupBy(F.col("ip").alias("client_ip"), "_day").agg(F.collect_list(one).alias("_bans"))
    return requests.withColumn("_day", F.expr("ts_us div 86400000000")).join(spread, ["client_ip", "_day"], "left").drop("_day")


def banned(requests: DataFrame, bans: DataFrame, heavy_from: int = HEAVY, cut: bool | None = None) -> DataFrame:
    """Adds is_banned, is_permanent and remaining_secs (until the last ban in force ends, null for a permanent one) at the time of each request.

    A ban holds from its creation to its expiry, both included; one without expiry holds for ever. A null address has no bans. cut: whether
    the requests are those of heavy addresses, where that is known.
    """
    listed = bans.where("ip IS NOT NULL AND created_epoch IS NOT NULL")
    r = _held(requests, listed, cut) if cut is not None else by_size(requests, "client_ip", _heavy(requests, heavy_from), lambda x, heavy: _held(x, listed, heavy))
    now = F.filter("_bans", lambda b: (b.created_epoch * 1_000_000 <= F.col("ts_us")) & (b.expires_epoch.isNull() | (F.col("ts_us") <= b.expires_epoch * 1_000_000)))
    r = r.withColumn("_now", now)
    permanent = F.coalesce(F.exists("_now", lambda b: b.expires_epoch.isNull()), F.lit(False))
    left = F.array_max(F.transform("_now", lambda b: b.expires_epoch - F.expr("ts_us div 1000000")))
    return r.select(*requests.columns, F.coalesce(F.size("_now") > 0, F.lit(False)).alias("is_banned"), permanent.alias("is_permanent"), F.when(permanent, None).otherwise(F.coalesce(left, F.lit(0))).cast("bigint").alias("remaining_secs"))


def reputation(ips: DataFrame, threats: DataFrame, cidr: DataFrame) -> DataFrame:
    """client_ip, threat, reputation of each address: its first threat by priority; data centers 0.7 at most."""
    worst = threats.groupBy(F.col("ip").alias("client_ip")).agg(F.min_by("threat_type", "priority").alias("threat"))
    known = places(ips, cidr).join(worst, "client_ip", "left")
    score = F.lit(1.0)
    for kind, s in REPUTATION.items():
        score = F.when(F.col("threat") == kind, F.lit(s)).otherwise(score)
    return known.select("client_ip", "country", "asn", "is_datacenter", "threat", F.when(F.col("is_datacenter"), F.least(F.lit(0.7), score)).otherwise(score).alias("reputation"))


def edge(requests: DataFrame, threats: DataFrame, cidr: DataFrame, heavy_from: int = HEAVY) -> DataFrame:
    """request_id, edge_flags, edge_score of every request; one exchange by address serves all its windows and the join with its reputation."""
    requests = _timed(requests)
    known = reputation(requests, threats, cidr).select("client_ip", "threat", "reputation").where("client_ip IS NOT NULL")
    heavy = _heavy(requests, heavy_from)

    def step(x: DataFrame, cut: bool) -> DataFrame:
        x = _flooded(_rated(x, cut, 60_000_000, 60), cut, 50, 30, 3)
        # of heavy addresses, the reputations are as few as these
        return x.join(F.broadcast(known.where(F.col("client_ip").isin(heavy["client_ip"]))) if cut else known, "client_ip", "left")

    r = by_size(requests, "client_ip", heavy, step).withColumn("reputation", F.coalesce("reputation", F.lit(1.0)))
    kind = F.lit(0.0)
    flag = F.lit(None).cast("string")
    for k, (name, s) in THREAT_RISK.items():
        kind, flag = F.when(F.col("threat") == k, F.lit(s)).otherwise(kind), F.when(F.col("threat") == k, name).otherwise(flag)
    limit = F.when(F.col("is_limited"), 0.8).when(F.col("usage_ratio") > 0.7, F.col("usage_ratio") * 0.3).otherwise(0.0)
    flood = F.when(F.col("flood") == "volumetric", 0.85).when(F.col("flood") == "application_layer", 0.8).otherwise(0.0)
    volume = F.when(F.col("is_limited") | (F.coalesce("flood", F.lit("")) == "volumetric"), F.lit("HighVolume"))
    flags = F.array_compact(F.array(F.when(F.col("is_limited"), volume), flag, F.when(~F.col("is_limited"), volume), F.when(F.col("flood") == "application_layer", F.lit("AnomalousPattern"))))
    return r.select("request_id", flags.alias("edge_flags"), F.least(F.lit(1.0), limit + kind + (1.0 - F.col("reputation")) * 0.2 + flood).alias("edge_score"))
