import itertools
import json

import numpy as np
import pytest

from solweave.functions import trees
from solweave.operators import drift

SCHEMA = "feed string, seq int, file bigint, line int, body string, field string"


def lines(feed, files, first):
    out = []
    for k, rows in enumerate(files):
        for n, row in enumerate(rows):
            body = row if isinstance(row, str) or row is None else json.dumps(row)
            out.append((feed, k, first + k, n, body, "clash"))
    return out


def many():
    """Twenty feeds that agree on what the fields hold, and one that drifts."""
    rng = np.random.default_rng(0)
    row = lambda **names: {
        names.get("ant", "ant"): f"CS{rng.integers(100, 999)}HBA", names.get("val", "val"): round(float(rng.uniform(1, 40)), 5) + 0.00001,
        names.get("axes", "axesNames"): ["time", "freq", "ant"], names.get("kind", "parmdb_type"): str(rng.choice(["Gain", "TEC", "Clock"])), "weight": round(float(rng.uniform(0.1, 0.9)), 2) + 0.001,
    }
    out = []
    for f in range(20):
        names = {"axes": "AxesNames", "kind": "ptype", "ant": "station"} if f % 2 else {}
        out += lines(f"other{f}", [[row(**names) for _ in range(4)] for _ in range(3)], 10_000 + 10 * f)
    base = [row() for _ in range(3)]
    files = [
        base,
        [row(axes="AxesNames") for _ in range(3)],
        [{**row(axes="AxesNames"), "remark": "first pass"}, '{"ant": "cut'],
        [{k: v for k, v in row(axes="AxesNames").items() if k != "weight"} | {"remark": None}, {"val": None, "ant": None}],
        [{k: v for k, v in row(axes="AxesNames", kind="ptype").items() if k != "weight"} | {"remark": 5}, None],
        [],
        [{k: v for k, v in row(axes="AxesNames", kind="ptype").items() if k != "weight"} | {"remark": 5.5, "AxesNames": {"0": "time", "1": "freq"}}],
    ]
    return out + lines("drifting", files, 1)


def build(spark, rows):
    return drift.Drift(spark.createDataFrame(rows, SCHEMA), "feed", "seq", "file", "line", "body")


def top(changes, feed="drifting"):
    return sorted((r.file_id, r.field, r.change) for r in changes.filter("depth = 1").collect() if r.feed == feed)


WANT = sorted([
    (2, "axesNames", "renamed"), (3, "remark", "added"), (4, "weight", "removed"), (5, "parmdb_type", "renamed"), (5, "remark", "retyped"),
    (7, "AxesNames", "retyped"), (7, "remark", "retyped"),
])


@pytest.mark.parametrize("files", [1024, 2])
def test_changes(spark, monkeypatch, files):
    monkeypatch.setattr(drift, "FILES", files)
    rows = many()
    d = build(spark, rows + rows[:50])
    assert top(d.changes()) == WANT
    deep = [(r.field, r.change) for r in d.changes().filter("depth = 2 AND feed = 'drifting'").collect()]
    assert ("AxesNames.0", "added") in deep


def test_one_table(spark):
    d = build(spark, many())
    names = d.canonical(d.changes())
    assert names["AxesNames"] == names["axesNames"] and names["ptype"] == names["parmdb_type"] and names["ant"] == "ant"
    t = d.table(names)
    got = t.filter("feed = 'drifting'").collect()
    assert len(got) == 3 + 3 + 1 + 2 + 1 + 1
    assert all(json.loads(r[names["axesNames"]]) for r in got if r.file == 2)


def test_empty_and_broken(spark):
    d = build(spark, [])
    assert d.changes().collect() == [] and d.canonical(d.changes()) == {} and d.table({}).collect() == []
    d = build(spark, [("f", 1, 1, 1, "{", ""), ("f", 2, 2, 1, "[1]", ""), ("f", None, 3, 1, "{}", ""), ("f", 4, 4, 1, "{}", ""), ("f", 5, 5, 1, '{"a": 1}', "")])
    assert top(d.changes(), "f") == [(5, "a", "added")]


def test_assignment_is_least():
    rng = np.random.default_rng(1)
    for n in (1, 2, 4, 5):
        c = rng.uniform(size=(n, n))
        got = trees.assign(c)
        assert sorted(got) == list(range(n))
        assert sum(c[i, j] for i, j in enumerate(got)) == pytest.approx(min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))))


def test_edit_scripts():
    sep = "\x1f"
    none = lambda pa, pb, g, c: None
    a = trees.build([("a", "object"), (f"a{sep}x", "text"), ("b", "object"), ("c", "whole")])
    b = trees.build([("a", "object"), ("b", "object"), (f"b{sep}x", "text"), ("c", "real"), ("d", "list")])
    cost, steps = trees.edit_script(a, b, none)
    assert {(s.action, s.old, s.new) for s in steps} == {("moved", ("a", "x"), ("b", "x")), ("retyped", ("c",), ("c",)), ("added", (), ("d",))}
    assert cost == 3
    assert trees.edit_script(a, a, none) == (0.0, [])
    cost, steps = trees.edit_script(trees.build([("p", "text")]), trees.build([("q", "text")]), lambda pa, pb, g, c: 0.2)
    assert cost == pytest.approx(0.2) and steps[0].action == "renamed"
    # Names may change at every depth, and the script says so.
    a, b = trees.build([("a", "object"), (f"a{sep}x", "text")]), trees.build([("b", "object"), (f"b{sep}y", "text")])
    cost, steps = trees.edit_script(a, b, lambda pa, pb, g, c: 0.5 if g.kind == c.kind else None)
    assert [(s.action, s.old, s.new) for s in steps] == [("renamed", ("a",), ("b",)), ("renamed", ("a", "x"), ("b", "y"))] and cost == 1.0


def random_tree(rng, names, depth):
    out = {}
    for n in names:
        if rng.random() < 0.6:
            kind = str(rng.choice(["text", "whole", "object"] if depth else ["text", "whole"]))
            out[n] = trees.Node(n, kind, random_tree(rng, names[:2], depth - 1) if kind == "object" else {})
    return out


def brute_cost(a, b, pa, pb, rename):
    """Every way to pair the siblings of different names."""
    total = 0.0
    for n in a.children.keys() & b.children.keys():
        x, y = a.children[n], b.children[n]
        total += (x.kind != y.kind) + brute_cost(x, y, (*pa, n), (*pb, n), rename)
    gone = [a.children[k] for k in a.children.keys() - b.children.keys()]
    come = [b.children[k] for k in b.children.keys() - a.children.keys()]
    best = np.inf
    for size in range(min(len(gone), len(come)) + 1):
        for left in itertools.combinations(gone, size):
            for right in itertools.permutations(come, size):
                prices = [rename((*pa, g.name), (*pb, c.name), g, c) for g, c in zip(left, right, strict=True)]
                if None in prices:
                    continue
                now = sum(prices) + sum(brute_cost(g, c, (*pa, g.name), (*pb, c.name), rename) for g, c in zip(left, right, strict=True))
                now += sum(g.size() for g in gone if g not in left) + sum(c.size() for c in come if c not in right)
                best = min(best, now)
    return total + best


def brute_script(a, b, rename):
    """Every set of moves of equal subtrees, and every pairing beside them."""
    olds, news = dict(trees._below(a, ())), dict(trees._below(b, ()))
    pairs = [(p, q) for p in olds for q in news if p[-1] == q[-1] and p[:-1] != q[:-1] and (p not in news or q not in olds) and trees._same(olds[p], news[q])]
    best = brute_cost(a, b, (), (), rename)
    for size in range(1, min(3, len(pairs)) + 1):
        for chosen in itertools.combinations(pairs, size):
            if any(trees._inside(x[k], y[k]) for x, y in itertools.permutations(chosen, 2) for k in (0, 1)):
                continue
            c, d = a, b
            for p, q in chosen:
                c, d = trees._without(c, p), trees._without(d, q)
            best = min(best, size + brute_cost(c, d, (), (), rename))
    return best


def test_scripts_are_least_and_cost_what_their_steps_cost():
    rng = np.random.default_rng(8)
    moved = 0
    for _ in range(150):
        a, b = (trees.Node("", "object", random_tree(rng, list("pqrs")[: int(rng.integers(2, 5))], 2)) for _ in range(2))
        price = {}

        def rename(pa, pb, g, c, price=price):
            return None if g.kind != c.kind else price.setdefault((pa, pb), float(rng.choice([0.1, 0.4, 0.7, 2.5])))

        brute_script(a, b, rename)  # settles the prices
        cost, steps = trees.edit_script(a, b, rename)
        assert cost == pytest.approx(brute_script(a, b, rename)) and cost == pytest.approx(sum(s.cost for s in steps))
        moved += sum(s.action == "moved" for s in steps)
    assert moved > 5


def test_no_value_is_lost_where_fields_clash(spark):
    rows = lines("f", [[{"a": 1, "b": 2}, {"a": 3}], [{"b": 4, "c": "x"}, {"b": "odd", "c": None}, {"b": 5}], [{"d": True, "e": 1.5}]], 1)
    d = build(spark, rows)
    got = {(r.file, r.line): r for r in d.table({"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}).collect()}
    assert (got[1, 0].a, got[1, 0].also) == (1, {"b": "2"}) and (got[1, 1].a, got[1, 1].also) == (3, {})
    assert (got[2, 0].a, got[2, 0].c, got[2, 0].also) == (4, "x", {})
    assert (got[2, 1].a, got[2, 1].also) == (None, {"b": "odd"})
    assert (got[3, 0].d, got[3, 0].e, got[3, 0].a) == (True, 1.5, None)
    assert {r.file_id: r.projection for r in d.projections({"a": "a", "b": "a"}).collect()}[1] == {"a": ["a", "b"]}


def test_a_field_that_goes_down_or_comes_up(spark):
    from solweave.plans.problems import _top

    rows = lines("f", [[{"o": {"p": 1}, "x": "t"}], [{"o": {"p": 1, "x": "t"}}], [{"o": {"p": 1}, "x": "t"}]], 1)
    got = _top(build(spark, rows).changes())
    assert sorted((r.file_id, r.field, r.change) for r in got.collect()) == [(2, "x", "removed"), (3, "x", "added")]
