import math
import random

from palisade.llm.mixing import mixture, shares, whole_uses

TARGETS = [("a", 0.5, 3), ("b", 0.3, 2), ("c", 0.2, 4)]


def test_targets_are_met_within_caps(spark):
    r = random.Random(4)
    words = {"a": "alpha beta gamma", "b": "delta rho sigma", "c": "kappa tau phi", "x": "noise"}
    docs = [(i, " ".join(r.choices(words[s].split(), k=8)), s, r.randrange(20, 60)) for i in range(900) for s in [r.choice("aabbbbcx")]] + [(5000, None, "a", None), (5001, "z", None, 9)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, size bigint")
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixed = mixture(df, targets)
    rows = mixed.collect()
    assert {x.doc_id for x in rows} == {d[0] for d in docs if d[2] in ("a", "b", "c")}
    assert all(0 <= x.n_used <= dict((t[0], t[2]) for t in TARGETS)[x.source] for x in rows)
    for x in shares(mixed, targets).collect():
        assert abs(x.actual_share - x.target_share) < 0.03


def test_nothing_to_mix(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string, size bigint")
    assert mixture(empty, targets).count() == 0


def test_whole_uses_follow_the_rates():
    r = random.Random(2)
    sizes = sorted((int(r.paretovariate(1) * 20) for _ in range(500)), reverse=True)
    for rate in (0.3, 0.69, 1.0, 2.4):
        n = whole_uses(sizes, [rate] * len(sizes))
        assert set(n) <= {math.floor(rate), math.ceil(rate)}
        assert abs(sum(a * b for a, b in zip(sizes, n)) - rate * sum(sizes)) <= 20
    assert whole_uses([0, 0], [0.2, 3.0]) == [0, 3] and whole_uses([], []) == []


def test_a_source_that_cannot_reach_its_target_does_not_bend_the_others(spark):
    r = random.Random(8)
    words = {"a": "alpha beta gamma", "b": "delta rho sigma", "c": "kappa tau phi"}
    docs = [(i, " ".join(r.choices(words[s].split() + ["the", "of"], k=8)), s, r.randrange(20, 60)) for i in range(800) for s in [r.choice("aaaabbbbbbbc")]]
    targets = spark.createDataFrame([("a", 0.4, 3), ("b", 0.3, 3), ("c", 0.3, 1)], "source string, target_share double, max_repeats int")
    got = {x.source: x for x in shares(mixture(spark.createDataFrame(docs, "doc_id bigint, text string, source string, size bigint"), targets), targets).collect()}
    assert got["c"].tokens >= 0.99 * got["c"].available_tokens
    assert abs(got["a"].actual_share / got["b"].actual_share - 4 / 3) < 0.02
