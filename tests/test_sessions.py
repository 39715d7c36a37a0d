import random

from palisade.streaming.sessions import GAP_US, session_stream, sessions

SCHEMA = "request_id bigint, ts_us bigint, client_ip string, agent_id string, actor string"
T0 = 1_700_000_000_000_000


def brute(rows):
    seen, by = set(), {}
    for rid, ts, ip, agent, _ in rows:
        if rid in seen or ts is None:
            continue
        seen.add(rid)
        by.setdefault(("agent", agent) if agent else ("ip", ip), []).append(ts)
    out = set()
    for (kind, actor), times in by.items():
        times.sort()
        start = last = times[0]
        n = 1
        for t in times[1:]:
            if t - last > GAP_US:
                out.add((kind, actor, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.add((kind, actor, start, last, n))
    return out


def run(spark, tmp_path, rows):
    path = str(tmp_path / "requests.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return {tuple(r) for r in sessions(spark, path).collect()}


def test_against_brute_force(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, T0 + r.randrange(4 * 86_400) * 1_000_000, f"ip{r.randrange(4)}", r.choice([None, "", "a", "b"]), "clash") for i in range(600)]
    rows += rows[:50] + [(9001, None, "ip1", None, "x"), (9002, T0, None, None, "x")]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_gap_to_the_microsecond_and_midnight(spark, tmp_path):
    midnight = T0 - T0 % 86_400_000_000 + 86_400_000_000
    rows = [(1, midnight - 5, "x", None, ""), (2, midnight - 5 + GAP_US, "x", None, ""), (3, midnight - 5 + 2 * GAP_US + 1, "x", None, "")]
    assert run(spark, tmp_path, rows) == {("ip", "x", midnight - 5, midnight - 5 + GAP_US, 2), ("ip", "x", midnight - 5 + 2 * GAP_US + 1, midnight - 5 + 2 * GAP_US + 1, 1)}


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []) == set()


def test_a_stream_of_five_batches_with_late_rows(spark, tmp_path):
    """Sessions over midnight and over batches go out whole; rows late by less than the lateness count, delivered again once, later ones don't."""
    day = T0 - T0 % 86_400_000_000
    m = 60_000_000
    batches = [
        [(1, day - 20 * m, "x", None), (2, day - 2 * m, "y", "a")],
        [(3, day + 5 * m, "x", None), (4, day + 12 * m, "z", "")],
        [(5, day + 34 * m, "x", None), (3, day + 5 * m, "x", None), (6, day - 8 * m, "x", None)],
        [(7, day + 300 * m, "x", None)],
        [(8, day + 301 * m, "y", "a"), (9, day - 19 * m, "late", None)],
        [(10, day + 900 * m, "w", None)],
    ]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "request_id bigint, ts_us bigint, client_ip string, agent_id string"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        found = session_stream(spark.readStream.schema(schema).parquet(source), "1 hour")
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    assert got == {("ip", "x", day - 20 * m, day + 34 * m, 4), ("ip", "z", day + 12 * m, day + 12 * m, 1), ("agent", "a", day - 2 * m, day - 2 * m, 1), ("ip", "x", day + 300 * m, day + 300 * m, 1), ("agent", "a", day + 301 * m, day + 301 * m, 1)}


def test_one_actor_with_most_rows_over_many_slices(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, T0 + r.randrange(9 * 86_400) * 1_000_000, "hot" if i % 3 else f"ip{i % 11}", None, "") for i in range(1500)] + [(5000, -3_000_000_000, "old", None, ""), (5001, -1_300_000_000, "old", None, ""), (5002, 7_000_000_000_000_000, "far", None, "")]
    path = str(tmp_path / "requests.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    assert {tuple(x) for x in sessions(spark, path, slice_rows=200).collect()} == brute(rows)
