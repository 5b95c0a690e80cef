"""Proof that only a body changed; exact percentiles and pages over ranges; distances by kind."""

import math
import random

import pytest

from siftworks.operators import changes, graph, stats

DOCS = "path string, language string, bytes binary"
DECLS = "path string, key string, kind string, header string, start long, end long, body_start long, body_end long"
FACTS = "path string, fact string, start long, end long"
SOURCE = "class A { f(x) { go(x) } g() { } }\nh() { up() }"


def measured(source, language="java", header=lambda h: h):
    """Declarations and calls of a source of this one form, by its braces and parentheses."""
    decls, facts, open_ = [], [], []
    for i, c in enumerate(source):
        if c == "{":
            start = max(source.rfind(x, 0, i) for x in "{}\n") + 1
            while source[start] == " ":
                start += 1
            open_.append((start, i))
        elif c == "}":
            start, at = open_.pop()
            name = source[start:at].strip()
            decls.append(("p", name.partition("(")[0], "type" if name.startswith("class") else "method", header(name), start, i + 1, at, i + 1))
        elif c == "(" and source[:i].rpartition("\n")[2].count("{") - source[:i].rpartition("\n")[2].count("}") and source[source.index(")", i) :][:3] != ") {":
            start = max(source.rfind(x, 0, i) for x in " {\n") + 1
            facts.append(("p", "call " + source[start:i], start, source.index(")", i) + 1))
    return ("p", language, source.encode()), decls, facts


CASES = {
    "a longer body": (SOURCE.replace("go(x)", "go(x) go(y)"), True, None),
    "a shorter body": (SOURCE.replace("go(x)", ""), True, None),
    "an empty body filled": (SOURCE.replace("g() { }", "g() { z() }"), True, None),
    "the last body": (SOURCE.replace("up()", "down()"), True, None),
    "unchanged": (SOURCE, None, None),
    "a new declaration": (SOURCE + "\nk() { }", False, "declarations"),
    "a declaration gone": (SOURCE.replace(" g() { }", ""), False, "declarations"),
    "a header": (SOURCE.replace("f(x) {", "f(x, y) {"), False, "headers"),
    "two bodies": (SOURCE.replace("go(x)", "go(y)").replace("up()", "down()"), False, "bodies"),
    "outside": (SOURCE.replace("\nh", "\n\n\nh"), False, "outside"),
    "outside and a body": (SOURCE.replace("\nh", "\n\nh").replace("go(x)", "go(y)"), False, "text"),
}


@pytest.mark.parametrize("name", CASES)
def test_body_only(spark, name):
    new, proved, reason = CASES[name]
    (d0, n0, f0), (d1, n1, f1) = measured(SOURCE), measured(new)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = changes.body_only(frame([d0], DOCS), frame([d1], DOCS), frame(n0, DECLS), frame(n1, DECLS), frame(f0, FACTS), frame(f1, FACTS)).collect()
    if proved is None:
        assert got == []
    else:
        assert [(r.proved, r.reason, r.growth if proved else None) for r in got] == [(proved, reason, len(new) - len(SOURCE) if proved else None)]


def test_body_only_of_facts_and_languages(spark):
    """A fact outside that isn't there any more, and one that moved by another distance than the body grew."""
    (d0, n0, f0), (d1, n1, f1) = measured(SOURCE), measured(SOURCE.replace("go(x)", "go(xyz)"))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    run = lambda d, f: changes.body_only(frame([d0], DOCS), frame([d], DOCS), frame(n0, DECLS), frame(n1, DECLS), frame(f0, FACTS), frame(f, FACTS)).first()
    assert run(d1, f1).owner == "f"
    assert run(d1, f1[:-1]).reason == "facts" and run(d1, [*f1[:-1], (*f1[-1][:2], f1[-1][2] + 1, f1[-1][3] + 1)]).reason == "facts"
    assert run(("p", "rust", d1[2]), f1).reason == "language"


def test_exact_percentiles_of_a_hot_key(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 6 + ["b", None, "one"]), rng.choice([None, rng.randrange(50), rng.randrange(10_000)])) for _ in range(6000)] + [("single", 3), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, value int").repartition(5)
    got = {r.k: (r.n, r.median, r.p95, r.p99) for r in stats.latency_summary(df, ["k"]).collect()}
    for k in {r[0] for r in rows}:
        v = sorted(x for kk, x in rows if kk == k and x is not None)
        at = lambda p: v[max(math.ceil(len(v) * p / 100), 1) - 1] if v else None  # noqa: B023, E731
        assert got[k] == (len(v), at(50), at(95), at(99))
    ranged = stats.ranges(df.filter("value is not null"), ["k"], ["value"], 40)
    assert stats.located(ranged, ["k"]).filter("k = 'hot'").count() > 10


@pytest.mark.parametrize(("offset", "limit"), [(0, 1), (0, 200), (1990, 7), (3000, 200), (10**6, 5)])
def test_pages_deep_in_a_hot_key(spark, offset, limit):
    rows = [("hot" if i % 4 else f"k{i % 3}", (i * 7919) % 5000) for i in range(5000)] + [(None, 1), (None, 2)]
    got = [tuple(r) for r in stats.page(spark.createDataFrame(rows, "k string, v long").repartition(6), ["k"], ["v"], offset, limit).collect()]
    want = []
    for k in {r[0] for r in rows}:
        mine = sorted(v for kk, v in rows if kk == k)
        want += [(k, v, offset + limit if len(mine) > offset + limit else None) for v in mine[offset : offset + limit]]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_distances_by_kind(spark):
    calls = [("a", "b", "internal"), ("b", "c", "internal"), ("b", "x", "external"), ("d", "c", "internal"), ("c", "a", "internal"), ("d", "e", "internal")]
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    run = lambda **o: sorted(tuple(r) for r in graph.distances_by_kind(frame([("a",)], "id string"), frame(calls, "src string, dst string, resolution string"), frame([("a", "d")], "src string, dst string"), **o).collect())
    every = [("a", "called", 0), ("a", "referenced", 3), ("b", "called", 1), ("b", "referenced", 4), ("c", "called", 2), ("c", "referenced", 2), ("d", "referenced", 1), ("e", "referenced", 2)]
    assert run() == every
    assert run(most=1) == [("a", "called", 0), ("b", "called", 1), ("d", "referenced", 1)]
    assert run(allowed=frame([("b",), ("d",), ("c",)], "id string")) == [("a", "called", 0), ("b", "called", 1), ("c", "called", 2), ("c", "referenced", 2), ("d", "referenced", 1)]
