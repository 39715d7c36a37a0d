from palisade.sources.readers import ban_list, log_lines, upserted, write_bans


def test_log_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"timestamp":"t","level":"WARN","fields":{"message":"m"}}\nnot json\n{"level":"INFO"}\n')
    assert [(r.level, r.fields and r.fields.message) for r in log_lines(spark, str(tmp_path / "log.jsonl")).collect()] == [("WARN", "m"), ("INFO", None)]


def test_bans(spark, tmp_path):
    (tmp_path / "bans.json").write_text('[{"ip":"1.2.3.4","created_epoch":1,"expires_epoch":50},{"ip":"1.2.3.5","expires_epoch":null},{"ip":"x y"},{"ip":"::1","expires_epoch":200,"created_epoch":5}]')
    live = ban_list(spark, str(tmp_path / "bans.json"), 50)
    assert {r.ip for r in live.collect()} == {"1.2.3.5", "::1"}
    new = spark.createDataFrame([("::1", "again", 9, None, 1)], live.schema)
    got = {r.ip: (r.reason, r.ban_count) for r in upserted(live, new).collect()}
    assert got["::1"] == ("again", 2)
    write_bans(live, str(tmp_path / "out"))
    assert ban_list(spark, str(tmp_path / "out"), 50).count() in (1, 2)
