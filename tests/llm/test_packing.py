import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from solweave.llm.packing import best_fit_decreasing, fill_report, pack


def brute(sizes, capacity):
    rooms, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fit = [r for r in rooms if r >= sizes[i]]
        if fit:
            b = min(range(len(rooms)), key=lambda k: rooms[k] if rooms[k] >= sizes[i] else 10**9)
        else:
            rooms.append(capacity)
            b = len(rooms) - 1
        rooms[b] -= sizes[i]
        out[i] = b
    return sorted(rooms)


@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(0, c), max_size=60))))
@settings(max_examples=200, deadline=None)
def test_bins_are_those_of_best_fit_decreasing(case):
    capacity, sizes = case
    bins = best_fit_decreasing(np.array(sizes, dtype=np.int64), capacity)
    room = defaultdict(lambda: capacity)
    for b, s in zip(bins.tolist(), sizes, strict=True):
        room[b] -= s
    assert sorted(room.values()) == brute(sizes, capacity)


def packed(spark, rows, boxes, **kw):
    df = spark.createDataFrame(rows, "id bigint, size bigint, box string, bin bigint, piece bigint")
    return pack(df, "id", "size", boxes, **kw)


def test_every_item_is_whole_and_in_one_bin(spark):
    r = random.Random(2)
    rows = [(i, r.choice([0, 5, 5, 5, r.randint(0, 90), r.randint(90, 400)]), "x", 0, 0) for i in range(2000)] + [(9001, None, "x", 0, 0), (None, 4, "x", 0, 0), (9002, -1, "x", 0, 0)]
    boxes = [("small", 64), ("large", 256)]
    out = packed(spark, rows, boxes, shard_items=700)
    got = out.collect()
    for box, cap in boxes:
        pieces, room = defaultdict(int), defaultdict(int)
        for p in got:
            if p.box == box:
                pieces[p.id] += p.piece_size
                room[p.bin] += p.piece_size
                assert p.pieces == max(1, -(-rows[p.id][1] // cap))
        assert pieces == {i: s for i, s, *_ in rows[:2000]}
        assert max(room.values()) <= cap
        assert sum(room.values()) / (len(room) * cap) > 0.97
    report = {r.box: r for r in fill_report(out).collect()}
    assert report["small"].cut_items == sum(1 for _, s, *_ in rows[:2000] if s > 64)


def test_empty(spark):
    assert packed(spark, [], [("b", 10)]).collect() == []
