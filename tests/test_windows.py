import random

from pyspark.sql import functions as F

from palisade.operators import edge as E
from palisade.operators import behavior as B
from palisade.operators.behavior import anomalies, fingerprints
from palisade.operators.windows import by_rows, by_size, by_time, in_slices, running

T0 = 1_700_000_000_000_000


def stream(n=400, keys=3):
    r = random.Random(3)
    t, out = T0, []
    for i in range(n):
        t += r.randrange(0, 40_000_000)
        out.append((i, t, f"k{r.randrange(keys)}", r.randrange(10), f"/p{r.randrange(4)}"))
    return out


SCHEMA = "request_id bigint, ts_us bigint, client_ip string, v bigint, path string"


def test_cut_frames_equal_whole_ones(spark):
    rows = stream()
    df = spark.createDataFrame(rows, SCHEMA)
    got = running(df, ["client_ip"], "ts_us", "request_id", {"s": F.col("v")}, bucket_us=100_000_000)
    got = by_rows(got, ["client_ip"], "ts_us", "request_id", 5, {"m": lambda w: F.max("v").over(w.rowsBetween(-5, -1))}, chunk=16)
    got = by_time(got, ["client_ip"], "ts_us", 90_000_000, {"c": lambda w: F.count(F.lit(1)).over(w.rangeBetween(-90_000_000, 0))}, bucket_us=60_000_000)
    got = {r.request_id: (r.s, r.m, r.c) for r in got.collect()}
    assert len(got) == len(rows)
    for i, t, k, _, _ in rows:
        before = [x for x in rows if x[2] == k and x[0] < i]
        assert got[i] == (sum(x[3] for x in before), max((x[3] for x in before[-5:]), default=None), 1 + sum(t - x[1] <= 90_000_000 for x in before))


def test_running_over_one_sequence_with_null_keys_and_none(spark):
    df = spark.createDataFrame([(1, T0, None), (2, T0, None), (3, T0 + 9_000_000_000, "a")], "request_id bigint, ts_us bigint, k string")
    assert {r.request_id: r.n for r in running(df, [], "ts_us", "request_id", {"n": F.lit(1)}).collect()} == {1: 0, 2: 1, 3: 2}
    assert {r.request_id: r.n for r in running(df, ["k"], "ts_us", "request_id", {"n": F.lit(1)}).collect()} == {1: 0, 2: 1, 3: 0}
    assert running(df.limit(0), ["k"], "ts_us", "request_id", {"n": F.lit(1)}).count() == 0


def test_rate_limit(spark):
    rows = [(i, T0 + i * 1000, "a", 0, "/") for i in range(6)] + [(9, T0, "b", 0, "/")]
    got = {r.request_id: r for r in E.rate_limited(spark.createDataFrame(rows, SCHEMA), most=5).collect()}
    assert [got[i].is_limited for i in range(6)] == [False] * 5 + [True]
    assert got[9].total == 1.0 and got[5].remaining == 0


def test_rate_limit_weighs_the_window_before(spark):
    rows = [(i, T0 + i, "a", 0, "/") for i in range(4)] + [(9, T0 + 90_000_000, "a", 0, "/")]
    got = {r.request_id: r for r in E.rate_limited(spark.createDataFrame(rows, SCHEMA), most=5).collect()}
    assert got[9].total == 1 + 4 * 0.5 and got[9].reset_in_secs == 30


def test_floods(spark):
    rows = [(i, T0 + i * 1000, "a", 0, f"/{i}") for i in range(60)] + [(100 + i, T0 + i * 200_000, "b", 0, "/x") for i in range(40)]
    got = {r.request_id: r.flood for r in E.floods(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[49] is None and got[50] == "volumetric" and got[129] is None and got[130] == "application_layer"


def test_places_longest_prefix_and_other_texts(spark):
    cidr = spark.createDataFrame([(3325256704, 3325256959, 24, "QX", None), (3325256704, 3325256767, 26, None, 16509)], "start_ip bigint, end_ip bigint, prefix int, country string, asn bigint")
    ips = spark.createDataFrame([("198.51.100.5",), ("198.51.100.200",), ("::1",), ("999.1.1.1",), (None,)], "client_ip string")
    got = {r.client_ip: (r.country, r.asn, r.is_datacenter) for r in E.places(ips, cidr).collect()}
    assert got["198.51.100.5"] == ("QX", 16509, True) and got["198.51.100.200"] == ("QX", None, False) and got["::1"] == (None, None, False) and got["999.1.1.1"] == (None, None, False)


def test_bans_in_force(spark):
    bans = spark.createDataFrame([("a", 100, 200), ("a", 150, None), ("b", 100, 200)], "ip string, created_epoch bigint, expires_epoch bigint")
    r = spark.createDataFrame([(1, "a", 99_000_000), (2, "a", 120_000_000), (3, "a", 160_000_000), (4, "b", 200_000_000), (5, "b", 200_000_001)], "request_id bigint, client_ip string, ts_us bigint")
    got = {x.request_id: (x.is_banned, x.is_permanent, x.remaining_secs) for x in E.banned(r, bans).collect()}
    assert got == {1: (False, False, 0), 2: (True, False, 80), 3: (True, True, None), 4: (True, False, 0), 5: (False, False, 0)}


FULL = "request_id bigint, ts_us bigint, client_ip string, method string, path string, query_string string, user_agent string, accept_language string, auth_header string, cookie string, x_session_id string, agent_id string, body string"


def test_session_fingerprint(spark):
    row = lambda i, ip, ua: (i, T0 + i * 1_000_000, ip, "GET", "/", None, ua, "en", "Bearer t", None, None, None, None)
    got = {r.request_id: (round(r.score, 6), r.reasons) for r in fingerprints(spark.createDataFrame([row(1, "a", "u"), row(2, "a", "v"), row(3, "b", "u"), row(4, "b", "v")], FULL)).collect()}
    assert got == {1: (0.0, ""), 2: (0.0, ""), 3: (0.5, "IP changed"), 4: (0.8, "IP changed, User-Agent changed")}


def test_sequence_anomaly(spark):
    rows = [(i, T0 + i * 1_000_000, "a", "GET", "/same", None, None, None, None, None, None, None, "x") for i in range(7)]
    got = {r.request_id: r.is_sequence for r in anomalies(spark.createDataFrame(rows, FULL)).collect()}
    assert [got[i] for i in range(7)] == [False] * 5 + [True] * 2


def test_heavy_keys_give_what_plain_windows_give(spark):
    rows = [(i, t, k if i % 7 else None, v, p) for i, t, k, v, p in stream(n=500, keys=2)] + [(900, None, "k0", 1, "/p1")]
    df = spark.createDataFrame(rows, SCHEMA)
    for f in (E.rate_limited, E.floods):
        plain, cut = ({r.request_id: r.asDict() for r in f(df, heavy_from=n).collect()} for n in (10**6, 50))
        assert len(plain) == len(rows) and plain == cut


def test_heavy_agents_sessions_and_clusters(spark):
    r = random.Random(5)
    rows, t = [], T0
    for i in range(300):
        t += r.randrange(0, 3_000_000)
        rows.append((i, t, f"a{r.randrange(3)}" if r.random() < 0.9 else None, "GET", f"/p/{r.randrange(5)}/x{r.randrange(3)}", None, f"u{r.randrange(2)}", "en", f"Bearer t{r.randrange(2)}", None, None, None, "b" * r.randrange(3)))
    df = spark.createDataFrame(rows, FULL)
    traced = B.traces(df)
    for step, key in ((lambda x, c: B._profile(x, c, 30_000_000, 20, 0.5), "agent"), (lambda x, c: B._fingerprint(x, c, 0.7), "session_id"), (lambda x, c: B._cluster(x, c, 20_000_000), "signature"), (B._same_ip, "client_ip")):
        some = {key: [x[0] if x[0] is not None else "\0" for x in traced.select(key).distinct().collect()][:2]}
        whole, split = ({x.request_id: str(sorted(x.asDict().items())) for x in by_size(traced, key, h, step).collect()} for h in ({}, some))
        assert len(whole) == len(rows) and whole == split


def test_slices_of_the_whole_equal_one_sequence(spark):
    rows = stream(n=300)
    df = spark.createDataFrame(rows, SCHEMA)
    steps = [{"m": lambda w: F.max("v").over(w.rowsBetween(-5, -1)), "p": lambda w: F.lag("v").over(w)}]
    got = {x.request_id: (x.s, x.m, x.p) for x in in_slices(df, "ts_us", "request_id", {"s": F.col("v")}, 5, steps, rows=20).collect()}
    for i in range(300):
        assert got[i] == (sum(x[3] for x in rows[:i]), max((x[3] for x in rows[max(0, i - 5) : i]), default=None), rows[i - 1][3] if i else None)
    assert in_slices(df.limit(0), "ts_us", "request_id", {"s": F.col("v")}, 5, steps).count() == 0


def test_rate_peek_counts_what_came_before(spark):
    seen = spark.createDataFrame([(i, T0 + i * 1000, "a", 0, "/") for i in range(6)], SCHEMA)
    probes = spark.createDataFrame([(1, "a", T0 + 3500), (2, "a", T0 - 5), (3, "b", T0), (4, "a", T0 + 90_000_000)], "probe_id bigint, client_ip string, ts_us bigint")
    got = {r.probe_id: (r.total, r.is_limited, r.remaining) for r in E.rate_peek(probes, seen, most=5).collect()}
    assert got == {1: (4.0, False, 1), 2: (0.0, False, 5), 3: (0.0, False, 5), 4: (3.0, False, 2)}
