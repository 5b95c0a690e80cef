"""Bounded graph answers against hand-evaluated cases and against a plain queue."""

import random

from siftworks.operators.graph import answer_flags, distances, graph_answers, hierarchy, on_cycle, region_closure, warnings

REQ = "request_id string, root_id string, depth int, max_nodes int, max_calls int"
CALL = "owner_id string, call_id string, pos long, ordinal long, target_id string, reason string"


def queue(root, depth, max_nodes, max_calls, calls):
    nodes, edges, frontier, seen, at, full = [(root, 0)], [], [], {root}, 0, False
    while at < len(nodes):
        owner, level = nodes[at]
        at += 1
        own = calls.get(owner, [])
        if not own:
            continue
        if level == depth or full:
            frontier.append(("depth" if level == depth else "callLimit", owner, None, None, 0, len(own)))
            continue
        for i, (cid, ordinal, target, reason) in enumerate(own):
            if len(edges) == max_calls:
                frontier.append(("callLimit", owner, None, None, ordinal, len(own) - i))
                full = True
                break
            dst, visit = None, "boundary"
            if reason == "none":
                if target in seen:
                    dst, visit = target, "seen"
                elif len(nodes) == max_nodes:
                    reason = "nodeLimit"
                    frontier.append((reason, owner, cid, target, None, 0))
                else:
                    dst, visit = target, "new"
                    seen.add(target)
                    nodes.append((target, level + 1))
            edges.append((cid, owner, dst, visit, reason))
    return nodes, edges, frontier


def run(spark, requests, calls):
    rows = [(o, c, i, n, t, r) for o, cs in calls.items() for i, (c, n, t, r) in enumerate(cs)]
    nodes, edges, frontier = graph_answers(spark.createDataFrame(requests, REQ), spark.createDataFrame(rows, CALL))
    out = {}
    for r in requests:
        out[r[0]] = ([], [], [])
    for x in nodes.orderBy("rank").collect():
        out[x.request_id][0].append((x.node_id, x.depth))
    for x in edges.orderBy("pos").collect():
        out[x.request_id][1].append((x.call_id, x.src, x.dst, x.visit, x.reason))
    for x in frontier.orderBy("seq").collect():
        out[x.request_id][2].append((x.kind, x.node_id, x.call_id, x.target_id, x.next_ordinal, x.omitted_calls))
    return out


def test_hand_cases(spark):
    c = lambda *ts: [(f"{k}", i, t, r) for i, (k, t, r) in enumerate(ts)]
    calls = {
        "A1": c(("a0", "B1", "none")), "B1": c(("b0", "A1", "none")),  # a cycle
        "S": c(("s0", "S", "none")),  # a self-loop
        "A2": c(("x0", "B2", "none"), ("x1", "C2", "none")), "B2": c(("y0", "D2", "none")), "C2": c(("z0", "D2", "none")),  # a diamond
        "A3": c(("k0", "B3", "none"), ("k1", "C3", "none"), ("k2", "A3", "none")),  # node cap, then a seen edge
        "A4": c(("m0", "B4", "none"), ("m1", "C4", "none")), "B4": c(("n0", "D4", "none")),  # call cap
        "A5": c(("v0", "V", "dispatch")),
    }
    requests = [("cycle", "A1", 2, 150, 500), ("self", "S", 2, 150, 500), ("diamond", "A2", 3, 150, 500), ("nodes", "A3", 2, 2, 500), ("calls1", "A4", 2, 150, 1), ("calls0", "A4", 2, 150, 0), ("depth0", "A4", 0, 150, 500), ("dispatch", "A5", 2, 150, 500), ("leaf", "V", 5, 1, 0)]
    got = run(spark, requests, calls)
    assert got["cycle"] == ([("A1", 0), ("B1", 1)], [("a0", "A1", "B1", "new", "none"), ("b0", "B1", "A1", "seen", "none")], [])
    assert got["self"] == ([("S", 0)], [("s0", "S", "S", "seen", "none")], [])
    assert got["diamond"][1][2:] == [("y0", "B2", "D2", "new", "none"), ("z0", "C2", "D2", "seen", "none")]
    assert got["nodes"] == ([("A3", 0), ("B3", 1)], [("k0", "A3", "B3", "new", "none"), ("k1", "A3", None, "boundary", "nodeLimit"), ("k2", "A3", "A3", "seen", "none")], [("nodeLimit", "A3", "k1", "C3", None, 0)])
    assert got["calls1"][2] == [("callLimit", "A4", None, None, 1, 1), ("callLimit", "B4", None, None, 0, 1)]
    assert got["calls0"] == ([("A4", 0)], [], [("callLimit", "A4", None, None, 0, 2)])
    assert got["depth0"] == ([("A4", 0)], [], [("depth", "A4", None, None, 0, 2)])
    assert got["dispatch"] == ([("A5", 0)], [("v0", "A5", None, "boundary", "dispatch")], [])
    assert got["leaf"] == ([("V", 0)], [], [])


def test_against_a_plain_queue(spark):
    rng = random.Random(5)
    calls = {}
    for i in range(40):
        calls[f"n{i}"] = [(f"c{i}-{k}", k, f"n{rng.randrange(45)}", rng.choice(["none"] * 5 + ["external", "stale"])) for k in range(rng.randrange(6))]
    requests = [(f"r{i}", f"n{rng.randrange(45)}", rng.randrange(6), rng.choice([1, 2, 5, 12, 150]), rng.choice([0, 1, 3, 10, 30, 500])) for i in range(60)]
    got = run(spark, requests, calls)
    for rid, root, depth, mn, mc in requests:
        assert got[rid] == queue(root, depth, mn, mc, calls), rid


def test_flags(spark):
    req = spark.createDataFrame([("a", "A", 1, 5, 5), ("b", "B", 1, 5, 5)], REQ)
    calls = spark.createDataFrame([("A", "1", 0, 0, "X", "external"), ("A", "2", 1, 1, "Y", "stale")], CALL)
    _, edges, frontier = graph_answers(req, calls)
    assert {(r.request_id, r.truncated, r.partial) for r in answer_flags(req, edges, frontier).collect()} == {("a", False, True), ("b", False, False)}


def test_warnings(spark):
    """One stale and two possibly stale provenances, two ambiguous bindings of one provenance, and syntax alone."""
    req = spark.createDataFrame([("a", "p"), ("b", None)], "request_id string, producer_id string")
    cov = spark.createDataFrame([("a", False, "omitted"), ("b", True, "complete")], "request_id string, selected boolean, state string")
    prov = spark.createDataFrame([("a", "p1", "possiblyStale"), ("a", "p3", "possiblyStale"), ("a", "p2", "stale"), ("b", "p9", "fresh")], "request_id string, provenance_id string, freshness string")
    bind = spark.createDataFrame([("a", "pA", "ambiguous", False)] * 2, "request_id string, provenance_id string, resolution string, stale_target boolean")
    got = [(r.request_id, r.code, r.provenance_id) for r in warnings(req, cov, prov, bind).orderBy("request_id", "place").collect()]
    assert got == [("a", "staleEvidence", None), ("a", "staleEvidence", "p2"), ("a", "bindingAmbiguous", "pA"), ("b", "syntaxOnly", None)]


def test_deep_distances_and_closures(spark):
    far = spark.createDataFrame([(i, i + 1) for i in range(24)], "src long, dst long")
    seed = spark.createDataFrame([(0,)], "id long")
    assert {r.id: r.distance for r in distances(seed, far).collect()} == {i: i for i in range(25)}
    assert {r.id for r in distances(seed, far, 3).collect()} == set(range(4))
    rel = far.selectExpr("'extends' as kind", "src as source_id", "dst as target_id", "'p' as provenance_id")
    got = {(r.id, r.direction, r.distance) for r in hierarchy(spark.createDataFrame([(1,)], "id long"), rel).collect()}
    assert got == {(i, "ancestor", i - 1) for i in range(2, 25)} | {(0, "descendant", 1)}
    regions = spark.createDataFrame([(i, i + 1 if i < 70 else None) for i in range(71)], "id long, parent_id long")
    assert {r.id for r in region_closure(spark.createDataFrame([("g", 0)], "group string, id long"), regions).collect()} == set(range(71))


def test_cycle_of_many_nodes(spark):
    ring = [(i, (i + 1) % 70) for i in range(70)]
    df = spark.createDataFrame([*ring, (5, 100), (100, 101), (101, 200), (200, 201), (201, 200), (300, 300), (300, 0)], "src long, dst long")
    assert {r.id for r in on_cycle(df).collect()} == {*range(70), 200, 201, 300}


def test_cycles_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(1000 * g + rng.randrange(12), 1000 * g + rng.randrange(12)) for g in range(12) for _ in range(14)]
    reach = set(edges)
    while more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
        reach |= more
    assert {r.id for r in on_cycle(spark.createDataFrame(edges, "src long, dst long")).collect()} == {a for a, b in reach if a == b}
