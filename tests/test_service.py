from datetime import datetime, timedelta

from pyspark.sql import functions as F

from palisade.functions import wordpiece as WP
from palisade.functions.text import compact, is_json
from palisade.operators import bans as N
from palisade.operators import challenges as G
from palisade.operators import responses as S
from palisade.sources.readers import adapted, is_address, log_tail, write_samples
from palisade.streaming.rates import address_rates, emit_escalations, global_rates, split_late


def test_challenges_live_until_solved_expired_or_used_up(spark):
    made = [(1, "c1"), (2, "c2"), (3, "c3"), (4, "c4")]
    c = spark.createDataFrame([(k, i, "Token", "{}", "yes", 1000) for k, i in made], "k int, challenge_id string, kind string, data string, solution string, created_epoch bigint")
    tries = [(1, "c1", "no", 1001), (2, "c1", "yes", 1002), (3, "c1", "yes", 1003), (4, "c2", "no", 1001), (5, "c2", "no", 1002), (6, "c2", "no", 1003), (7, "c2", "yes", 1004), (8, "c2", "yes", 1005), (9, "c3", "yes", 1301), (10, "c3", "yes", 1302), (11, "zz", "yes", 1), (12, None, None, None)]
    out = G.verified(spark.createDataFrame(tries, "attempt_id int, challenge_id string, response string, epoch bigint"), c)
    assert [r.outcome for r in out.orderBy("attempt_id").collect()] == ["wrong", "solved", "not_found", "wrong", "wrong", "wrong", "exhausted", "not_found", "expired", "not_found", "not_found", "not_found"]
    assert [r.challenge_id for r in G.pending(c, out, F.lit(1100)).collect()] == ["c4"] and G.pending(c, out, F.lit(1300)).count() == 0


def test_proof_of_work_defaults_and_signatures(spark):
    x = spark.createDataFrame([("ProofOfWork", "{}", "", "1"), ("SignatureVerification", "{}", "", ""), ("Token", "{}", "t", None)], "kind string, data string, solution string, r string")
    assert [r.ok for r in x.select(G.solves(F.col("kind"), F.col("data"), F.col("solution"), F.col("r")).alias("ok")).collect()] == [False] * 3
    easy = spark.createDataFrame([("ProofOfWork", '{"nonce":"a","difficulty":0}', "", "1")], x.schema)
    assert easy.select(G.solves(F.col("kind"), F.col("data"), F.col("solution"), F.col("r")).alias("ok")).first().ok


def test_bans_numbered_folded_and_taken_back(spark):
    b = spark.createDataFrame([(1, "a", 10, 20), (2, "a", 15, 30), (3, "a", 40, None), (4, "a", 50, 60), (5, None, 1, 2)], "ban_id int, ip string, created_epoch bigint, expires_epoch bigint")
    assert {r.ban_id: r.nth for r in N.numbered(b, "ip", "ban_id").collect()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 1}
    assert N.without(b, spark.createDataFrame([("a",), (None,)], "ip string")).count() == 1
    e = spark.createDataFrame([("x", "r1", 5, 1), ("x", "r2", 9, 2), (None, "r", 1, 3)], "agent string, reason string, epoch bigint, event_id int")
    assert [tuple(r) for r in N.folded(e, "agent", 100).collect()] == [("x", "r2", 5, 109, 2)]


def test_thousandths_round_the_binary_value(spark):
    values = [0.9235, 0.0, 1.0, 0.5315, 0.0005, 0.6394999]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(S.thousandths(F.col("v")).alias("x")).collect()]
    assert got == [f"{v:.3f}" for v in values]


def test_requests_as_they_come_over_the_wire(spark):
    rows = [("198.51.100.7", None, {"User-Agent": "x", "USER-AGENT": "y"}, b'{"a": 1}'), ("999.1.1.1", "POST", None, b"plain"), ("::1", "PUT", {}, bytes([255, 254])), (None, None, None, None), ("2001:db8::1", "GET", {}, b'{"a":1} tail')]
    got = [(r.ip_error, r.method, r.headers.get("user-agent"), r.body_kind, r.content_length) for r in adapted(spark.createDataFrame(rows, "client_ip string, method string, headers map<string,string>, body binary")).collect()]
    assert got == [(False, "GET", "y", "json", 8), (True, "POST", None, "text", 5), (False, "PUT", None, "binary", 2), (True, "GET", None, "none", 0), (False, "GET", None, "text", 12)]
    assert [r.x for r in spark.createDataFrame([("...",), ("::",), ("1::2::3",), ("1:2:3:4:5:6:7:8",), ("",)], "ip string").select(is_address(F.col("ip")).alias("x")).collect()] == [False, True, False, True, False]


def test_json_is_compact_with_keys_in_order(spark):
    rows = ['{"b": [1, {"z": 1, "y": 2}], "a": "x"}', " [1, 2] ", "{broken", "plain {text}", '{"a":1} {"b":2}', None, ""]
    got = [(r.c, r.j) for r in spark.createDataFrame([(x,) for x in rows], "t string").select(compact(F.col("t")).alias("c"), is_json(F.col("t")).alias("j")).collect()]
    assert got == [('{"a":"x","b":[1,{"y":2,"z":1}]}', True), ("[1,2]", True), ("{broken", False), ("plain {text}", False), ('{"a":1} {"b":2}', False), (None, False), ("", False)]


def test_subword_ids(spark, tmp_path):
    (tmp_path / "vocab.txt").write_text("[PAD]\nun\n##believ\n##able\nword\n\ngo\n")
    vocab = WP.vocabulary(spark, str(tmp_path / "vocab.txt"))
    assert vocab == {"[PAD]": 0, "un": 1, "##believ": 2, "##able": 3, "word": 4, "go": 6}
    assert WP.encode("Unbelievable WORD, go! zz", vocab) == [101, 1, 2, 3, 4, 6, 100, 102]
    assert WP.encode("go " * 900, vocab) == [101] + [6] * 510 + [102] and WP.encode("", vocab) == [101, 102]
    df = spark.createDataFrame([("go",), (None,)], "t string").select(WP.token_ids(F.col("t"), vocab, 5).alias("ids"))
    assert [r.ids for r in df.collect()] == [[101, 6, 102, 0, 0], None]
    assert df.select(WP.mask(F.col("ids")).alias("m"), WP.classified(F.col("ids"), str(tmp_path / "none.onnx")).alias("p")).first() == ([1, 1, 1, 0, 0], None)


def test_streaming_twins(spark, tmp_path):
    t = datetime(2024, 5, 1)
    rows = [(i, t + timedelta(milliseconds=10 * i), t, "a", 0.9 if i % 50 == 0 else 0.1) for i in range(100)] + [(900, t + timedelta(hours=2), t, "b", 0.7), (901, t + timedelta(hours=3), t, "b", 0.0)]
    schema = "id int, ts timestamp, seen timestamp, client_ip string, score double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def run(df, name):
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert (t, 100, True) in {tuple(r) for r in run(global_rates(stream(), "1 minute", 19), "g")}
    assert {r.n for r in run(address_rates(stream(), most=99, lateness="1 minute"), "s")} == {100}
    for _ in range(2):
        emit_escalations(stream(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "out")).collect()) == [0, 50, 900]
    ok, late = split_late(spark.createDataFrame([(1, t, t + timedelta(seconds=9)), (2, t, t + timedelta(seconds=11)), (3, None, None)], "id int, ts timestamp, seen timestamp"), "seen", 10)
    assert [r.id for r in ok.collect()] == [1, 3] and [r.id for r in late.collect()] == [2]


def test_log_tail_and_samples(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"timestamp":"t","level":"ERROR","fields":{"message":"m"}}\nnot json\n')
    q = log_tail(spark, str(tmp_path / "log")).writeStream.format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.line for r in spark.table("tail").collect()] == ["\x1b[31mERROR\x1b[0m m"]
    write_samples(spark.createDataFrame([("p", 1, 0.9), ("n", 0, 0.1)], "text string, label int, score double"), str(tmp_path / "s"))
    assert {(r.text, r.part) for r in spark.read.json(str(tmp_path / "s")).collect()} == {("p", 0), ("n", 1)}
