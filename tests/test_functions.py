"""Stitching and the Column functions on their own."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mapweave.functions import geometry as G
from mapweave.functions.rules import is_area
from mapweave.operators.relations import below, cyclic
from mapweave.operators.stitch import chains, flatten
from mapweave.sources.detect import detect_format


def line(*names):
    return [[ord(n), 0, n] for n in names]


def keys(lines):
    return ["".join(p[2] for p in x) for x in lines]


def stitch(lines):
    """The chains of lines as points."""
    lines = [x for x in lines if x]
    out = []
    for run in chains([x[0][2] for x in lines], [x[-1][2] for x in lines]):
        points = []
        for k, (i, turned) in enumerate(run):
            points += (lines[i][::-1] if turned else lines[i])[1 if k else 0 :]
        out.append(points)
    return out


def slow_stitch(lines):
    """The rule, step by step."""
    waiting, out = [list(x) for x in lines if x], []
    while waiting:
        cur = waiting.pop(0)
        while True:
            nxt = waiting[0] if waiting else None
            k, turn, flip = None, False, False
            if nxt:
                if cur[-1][2] == nxt[0][2]:
                    k = 0
                elif cur[-1][2] == nxt[-1][2]:
                    k, turn = 0, True
                elif cur[0][2] == nxt[0][2]:
                    k, flip = 0, True
                elif cur[0][2] == nxt[-1][2]:
                    k, flip, turn = 0, True, True
            if k is None:
                k = next((i for i, x in enumerate(waiting) if x[0][2] == cur[-1][2]), None)
            if k is None:
                k = next((i for i, x in enumerate(waiting) if x[-1][2] == cur[-1][2]), None)
                turn = k is not None
            if k is None:
                break
            nxt = waiting.pop(k)
            cur = cur[::-1] if flip else cur
            cur = cur + (nxt[::-1] if turn else nxt)[1:]
        out.append(cur)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcdef", min_size=1, max_size=4), max_size=12))
def test_stitch_follows_the_rule(words):
    lines = [line(*w) for w in words]
    assert keys(stitch(lines)) == keys(slow_stitch(lines))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("abcdef", min_size=2, max_size=5), max_size=12))
def test_stitch_keeps_segments(words):
    def segments(lines):
        return Counter(frozenset((a[2], b[2])) for x in lines for a, b in zip(x, x[1:], strict=False))

    lines = [line(*w) for w in words]
    assert segments(stitch(lines)) == segments(lines)


def test_stitch_is_linear():
    names = [[[i, 0, str(i)], [i + 1, 0, str(i + 1)]] for i in range(50_000)]
    random.Random(1).shuffle(names)
    assert sum(len(x) - 1 for x in stitch(names)) == 50_000


def test_flatten_shifts_roles():
    parts = [{"path": [], "ways": ["A"], "roles": ["x", "y"]}, {"path": [1], "ways": ["B", "C"], "roles": ["b", "c", "d"]}, {"path": [1, 0], "ways": ["D"], "roles": ["e"]}]
    assert flatten(parts) == (["A", "B", "C", "D"], ["x", "y", "b", "c", "d"])


def test_relations_below():
    edges = [{"from": "a", "i": 2, "ref": "c"}, {"from": "a", "i": 0, "ref": "b"}, {"from": "b", "i": 1, "ref": "c"}]
    assert list(below(["a", "c"], edges)) == [("a", [], "a"), ("a", [0], "b"), ("a", [0, 1], "c"), ("a", [2], "c"), ("c", [], "c")]
    cyclic(["a", "b", "c"], edges)
    with pytest.raises(ValueError, match="c > b > c"):
        cyclic(["a", "b", "c"], [*edges, {"from": "c", "i": 0, "ref": "b"}])
    deep = [{"from": str(i), "i": 0, "ref": str(i + 1)} for i in range(3000)]
    cyclic([str(i) for i in range(3001)], deep)
    assert sum(1 for _ in below(["0"], deep)) == 3001


@pytest.mark.parametrize(("text", "want"), [("12abc", 12.0), ("1e", 1.0), (" .5e1x", 5.0), ("", None), ("-3.", -3.0), ("x1", None)])
def test_parse_float(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(G.parse_float(F.col("t"))).first()[0] == want


def test_ring_functions(spark):
    square = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
    df = spark.createDataFrame([(square,), (square[::-1],), (square[:4],), ([[0.0, 0.0]],)], "r array<array<double>>")
    rows = df.select(G.is_ring(F.col("r")), G.is_clockwise(F.col("r")), G.contains(F.col("r"), F.array(F.lit(1.0), F.lit(1.0)))).collect()
    assert [tuple(r)[:2] for r in rows[:3]] == [(True, False), (True, True), (False, False)]
    assert [r[2] for r in rows[:2]] == [True, True]
    assert rows[3][0] is False
    turned = df.limit(2).select(G.oriented(F.col("r"), True)).collect()
    assert all(r[0] == square[::-1] for r in turned)


@pytest.mark.parametrize(
    ("tags", "want"),
    [([], False), ([("area", "no")], True), ([("highway", "services")], True), ([("highway", "primary")], False), ([("natural", "cliff")], False), ([("natural", "wood")], True),
     ([("building", "yes"), ("highway", "residential")], False), ([("highway", "residential"), ("building", "yes"), ("name", "x")], True), ([("constructor", "x")], False)],
)
def test_area_rules(spark, tags, want):
    assert spark.createDataFrame([(tags,)], "t array<struct<k:string,v:string>>").select(is_area(F.col("t"))).first()[0] is want


def test_detect(spark):
    texts = ["<osm/>", ' {"a": "<osm"}', "\t\n{}", "﻿ {}", "x", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(detect_format(F.col("t"))).collect()]
    assert got == ["xml", "xml", "json", "json", "invalid", "invalid"]
