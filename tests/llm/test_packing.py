import random

from hypothesis import given, settings
from hypothesis import strategies as st

from palisade.llm.packing import first_fit_decreasing, packed, unused
from palisade.llm.tokens import token_counts


def plain_ffd(sizes, capacity):
    rooms, out = [], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = next((i for i, r in enumerate(rooms) if r >= sizes[k]), len(rooms))
        if at == len(rooms):
            rooms.append(capacity)
        rooms[at] -= sizes[k]
        out[k] = at
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80), st.integers(50, 90))
def test_tree_equals_scan(sizes, capacity):
    assert first_fit_decreasing(sizes, capacity) == plain_ffd(sizes, capacity)


def test_every_piece_once_and_no_container_over(spark):
    r = random.Random(2)
    docs = [(i, r.choice([0, 3, 40, 99, 100, 101, 350])) for i in range(300)] + [(900, None), (901, 100_000)]
    packs = spark.createDataFrame([("small", 100), ("big", 1000), ("none", None), ("zero", 0)], "pack_name string, capacity_tokens bigint")
    got = packed(spark.createDataFrame(docs, "doc_id bigint, size bigint"), packs, group=50)
    for name, capacity in (("small", 100), ("big", 1000)):
        rows = [x for x in got.collect() if x.pack_name == name]
        used, size = {}, {}
        for x in rows:
            used[x.container] = used.get(x.container, 0) + x.size
            size[x.doc_id] = size.get(x.doc_id, 0) + x.size
        assert max(used.values()) <= capacity and size == {i: s or 0 for i, s in docs}
        assert len({(x.doc_id, x.piece) for x in rows}) == len(rows)
    assert {x.pack_name for x in unused(got).collect()} == {"small", "big"}
    assert packed(spark.createDataFrame([], "doc_id bigint, size bigint"), packs).count() == 0


def test_tokens():
    assert token_counts(["", "hello world", "<|endoftext|>"])[:2] == [0, 2] and token_counts(["<|endoftext|>"])[0] > 1 and token_counts([]) == []
