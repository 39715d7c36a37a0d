import random

from palisade.llm.copies import copy_sets, json_form

SCHEMA = "space string, id bigint, text string, keep_id int"


def sets(spark, rows):
    counts, members = copy_sets(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), "space", "id", "text")
    return {(r.space, r.keep_id): r.n_copies for r in counts.collect()}, {(r.space, r.keep_id, r.copy_id) for r in members.collect()}


def test_ways_of_writing(spark):
    rows = [("t", 5, "Größe: 3 MB!"), ("t", 3, "GRÖSSE\n3 mb"), ("t", 9, "grösse4mb"), ("u", 1, "Größe 3 MB"), ("t", 3, "GRÖSSE\n3 mb"), ("t", 7, None)]
    counts, members = sets(spark, rows)
    assert counts == {("t", 3): 2, ("t", 9): 1, ("u", 1): 1}
    assert members >= {("t", 3, 3), ("t", 3, 5)}


def test_json_fields_and_lists(spark):
    a, b, c = '{"b": {"y": 1, "x": "Hi"}, "a": [1, 2]}', '{"A":[1,2],\n"B":{"X":"hi!","Y":1}}', '{"a":[2,1],"b":{"x":"hi","y":1}}'
    counts, members = sets(spark, [("t", 1, a), ("t", 2, b), ("t", 3, c)])
    assert counts == {("t", 1): 2, ("t", 3): 1} and ("t", 1, 2) in members


def test_forms_and_plain_texts(spark):
    counts, _ = sets(spark, [("t", 1, "a=1&b=2"), ("t", 2, "B=2&A=1 "), ("t", 3, "a=2&b=1"), ("t", 4, "word order"), ("t", 5, "order word"), ("t", 6, "..."), ("t", 7, ""), ("t", 8, "[x] y"), ("t", 9, "x y")])
    assert counts == {("t", 1): 2, ("t", 3): 1, ("t", 4): 1, ("t", 5): 1, ("t", 6): 2, ("t", 8): 2}


def test_json_form_edges():
    assert json_form('{"n":1.0}') != json_form('{"n":1}')
    assert json_form('{"a":1,"a":2}') == json_form('{"a":2,"a":1}')
    assert json_form("{broken") is None and json_form("[" * 100_000) is None and json_form('{"x":"\\ud800"}') is None


def test_one_hot_group_and_empty_table(spark):
    r = random.Random(1)
    rows = [("t", i, "".join(c.upper() if r.random() < 0.5 else c for c in "the same words")) for i in range(300)]
    counts, members = sets(spark, rows)
    assert counts == {("t", 0): 300} and len(members) == 300
    assert sets(spark, []) == ({}, set())


def test_counts_are_sums_of_records_also_where_ids_come_again(spark):
    rows = [("t", 1, "Same Words"), ("t", 1, "Same Words"), ("t", 2, "same words"), ("t", 3, "SAME words"), ("t", 3, "SAME words"), ("t", 4, "other"), ("t", 4, "other")]
    counts, members = sets(spark, rows)
    assert counts == {("t", 1): 3, ("t", 4): 1}
    assert members == {("t", 1, 1), ("t", 1, 2), ("t", 1, 3)}
