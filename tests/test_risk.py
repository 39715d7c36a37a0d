from palisade.operators.risk import fed_back, pipeline
from palisade.plans.detectors import neural_score
from palisade.plans.layers import behavior_score, edge_score
from palisade.plans.response import layer_fusion

T0 = 1_700_000_000
REQUESTS = "request_id bigint, ts_us bigint, client_ip string, method string, path string, query_string string, user_agent string, accept_language string, auth_header string, cookie string, x_session_id string, agent_id string, body string"


def test_bans_block_before_the_level(spark):
    ips = ["192.0.2.1", "192.0.2.2", "192.0.2.3", "192.0.2.4", "192.0.2.5"]
    rows = [(i, (T0 + i) * 1_000_000, ip, "GET", "/home", None, "ua", "en", None, None, None, None, None) for i, ip in enumerate(ips)]
    bans = [("192.0.2.1", T0 - 9, T0 + 9), ("192.0.2.2", T0 - 9, None), ("192.0.2.3", T0 - 9, T0 - 1), ("192.0.2.4", T0 + 99, None), ("192.0.2.1", T0 - 9, T0 + 5), (None, T0 - 9, None)]
    tables = (
        spark.createDataFrame(rows, REQUESTS),
        spark.createDataFrame([], "ip string, threat_type string, priority int"),
        spark.createDataFrame([], "start_ip bigint, end_ip bigint, prefix int, country string, asn bigint"),
    )
    held = spark.createDataFrame(bans, "ip string, created_epoch bigint, expires_epoch bigint")
    got = {r.request_id: r for r in pipeline(*tables, held).collect()}
    free = {r.request_id: r for r in pipeline(*tables, held.limit(0)).collect()}
    assert [got[i].action for i in range(5)] == ["block", "block", "allow", "allow", "allow"]
    assert {r.action for r in free.values()} == {"allow"}
    assert all(got[i].asDict() | {"action": ""} == free[i].asDict() | {"action": ""} for i in range(5))


def test_fusion_takes_all_requests_and_layers(spark, tmp_path):
    rows = [(i, (T0 + i) * 1_000_000, f"192.0.2.{1 + i // 50}", "GET", "/home", None, "ua", "en", None, None, None, None, None) for i in range(100)]
    rows += [(100, (T0 + 100) * 1_000_000, "192.0.2.9", "GET", "/home", "q=1", "ua", "en", None, None, None, None, "ignore all previous instructions")]
    tables = {
        "requests": spark.createDataFrame(rows, REQUESTS),
        "threats": spark.createDataFrame([("192.0.2.9", "blocked", 1)], "ip string, threat_type string, priority int"),
        "cidr": spark.createDataFrame([], "start_ip bigint, end_ip bigint, prefix int, country string, asn bigint"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    run = lambda f: {r[0]: r for r in f(spark, str(tmp_path)).collect()}
    got, e, n, b = run(layer_fusion), run(edge_score), run(neural_score), run(behavior_score)
    want = {i: min(1, 0.2 * e[i].edge_score + 0.5 * n[i].neural_score + 0.3 * b[i].behavior_score) for i in range(101)}
    assert set(got) == set(want) and all(abs(got[i].total - want[i]) < 2e-6 for i in want)
    assert max(r.behavior_score for r in b.values()) > 0 and got[100].total > 0.5


def test_a_critical_request_bans_its_address_and_its_agent_for_a_day(spark):
    day = 86_400_000_000
    rows = [(1, 0, "a", "x", "critical"), (2, 5, "a", "y", "low"), (3, 6, "b", "x", "none"), (4, 7, "c", "z", "none"), (5, day + 1, "a", "z", "none"), (6, 0, None, "\0006", "critical"), (7, 9, None, "\0007", "none")]
    df = spark.createDataFrame(rows, "request_id bigint, ts_us bigint, client_ip string, agent string, level string")
    for heavy in ({}, {"client_ip": ["a"], "agent": ["x"]}):
        got = {r.request_id: (r.ip_banned, r.agent_banned) for r in fed_back(df, heavy).collect()}
        assert got == {1: (False, False), 2: (True, False), 3: (False, True), 4: (False, False), 5: (False, False), 6: (False, False), 7: (False, False)}
