from palisade.operators.skew import distinct_counts, heavy_keys

SCHEMA = "client_ip string, ym string, kind string, id bigint, n_requests int"


def counts(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    out = distinct_counts(df, "client_ip", ["ym"], "kind", {"r": "n_requests", "e": "n_escalations"}, "id", **more)
    return {(r.client_ip, r.ym): (r.n_requests, r.n_escalations) for r in out.collect()}


def test_heavy_and_light_keys_count_alike(spark):
    rows = [("hot", "2024-01", "r", i % 700, 9) for i in range(1400)] + [(f"c{i}", "2024-01", "e", i, 9) for i in range(50)]
    got = counts(spark, rows, share=0.1, salts=4)
    assert got[("hot", "2024-01")] == (700, 0)
    assert all(got[(f"c{i}", "2024-01")] == (0, 1) for i in range(50))
    assert [r.client_ip for r in heavy_keys(spark.createDataFrame(rows, SCHEMA), "client_ip", 0.1).collect()] == ["hot"]


def test_nulls_and_empty(spark):
    got = counts(spark, [(None, "2024-01", "r", 1, 0), (None, "2024-01", "r", None, 0), ("a", None, "e", None, 0)])
    assert got == {(None, "2024-01"): (1, 0), ("a", None): (0, 0)}
    assert counts(spark, []) == {}
