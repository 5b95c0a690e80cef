"""Graph operators: bounded breadth-first answers for many requests at once, distances, closures and cycles."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftworks.sources.tables import stored

#: Depths that a request may ask for.
MAX_DEPTH = 5
#: Steps of a fixpoint after which what it found is written as one table.
MERGE_STEPS = 16


def validate_requests(requests: DataFrame, denied: DataFrame, revisions: DataFrame, roots: DataFrame, producers: DataFrame) -> DataFrame:
    """request_id, error: the first that holds of invalidRequest, sourceSetDenied, revisionUnavailable, rootMissing and
    producerUnavailable; null for a valid request. Each table holds the one column that its name says."""
    flag = lambda df, c, name: df.select(c).distinct().withColumn(name, F.lit(True))
    j = requests.join(flag(denied, "source_set_id", "_d"), "source_set_id", "left").join(flag(revisions, "revision_id", "_r"), "revision_id", "left")
    j = j.join(flag(roots, "root_id", "_o"), "root_id", "left").join(flag(producers, "producer_id", "_p"), "producer_id", "left")
    bad = ~F.coalesce(F.col("depth").between(0, MAX_DEPTH) & F.col("max_nodes").between(1, 150) & F.col("max_calls").between(0, 500) & F.col("root_id").isNotNull(), F.lit(False))
    error = F.when(bad, "invalidRequest").when(F.col("_d"), "sourceSetDenied").when(F.col("_r").isNull(), "revisionUnavailable").when(F.col("_o").isNull(), "rootMissing").when(F.col("producer_id").isNotNull() & F.col("_p").isNull(), "producerUnavailable")
    return j.select("request_id", error.alias("error"))


def graph_answers(requests: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and frontier of rooted, bounded breadth-first answers, all requests in one job.

    requests: request_id, root_id, depth, max_nodes, max_calls. calls: owner_id, call_id, pos (place among the owner's
    calls, from 0), ordinal, target_id, reason (why the edge can't be followed, or none).

    nodes: request_id, node_id, depth, rank. edges: request_id, pos, call_id, src, dst, visit, reason. frontier:
    request_id, seq, kind, node_id, call_id, target_id, next_ordinal, omitted_calls.

    A queue is served level by level, so a level's work is one join: its nodes in order of admission with their calls
    in order. The call budget cuts this order first; then the first call that reaches a node admits it, as long as the
    node budget lasts; a refused target is refused again each time. Levels are at most six; the calls, the reached
    calls of each level and its edges are written to the shared folder, so that nothing is computed twice. Of an
    owner's calls only those that the budget leaves room for come out of the join.
    """
    spark = requests.sparkSession
    calls = stored(calls.select("owner_id", "call_id", "pos", "ordinal", "target_id", "reason"), "calls")
    sizes = calls.groupBy("owner_id").agg(F.count("*").alias("n_calls"))
    limits = requests.select("request_id", F.col("depth").alias("max_depth"), "max_nodes", "max_calls")
    admitted = stored(requests.select("request_id", F.col("root_id").alias("node_id"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("rank")), "nodes")
    used = limits.select("request_id", F.lit(0).cast("long").alias("used"), F.lit(1).cast("long").alias("n_nodes"))
    all_edges, all_frontier = None, None
    for depth in range(MAX_DEPTH + 1):
        level = admitted.filter(F.col("depth") == depth).join(limits, "request_id").join(used, "request_id").join(sizes.withColumnRenamed("owner_id", "node_id"), "node_id").filter("n_calls > 0")
        level = stored(level, "level")
        if not level.limit(1).count():
            break
        at_depth = level.filter("max_depth = depth").select("request_id", (F.col("rank") * 1000).alias("seq"), F.lit("depth").alias("kind"), "node_id", F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("target_id"), F.lit(0).cast("long").alias("next_ordinal"), F.col("n_calls").alias("omitted_calls"))
        open_ = level.filter("max_depth > depth")
        # how many calls stand before each node's in the level: the budget left decides what a node may emit
        before = Window.partitionBy("request_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        open_ = open_.withColumn("prior", F.coalesce(F.sum("n_calls").over(before), F.lit(0)) + F.col("used")).withColumn("room", F.greatest(F.lit(0).cast("long"), F.least(F.col("n_calls"), F.col("max_calls") - F.col("prior"))))
        near = open_.alias("o").join(calls.alias("c"), (F.col("o.node_id") == F.col("c.owner_id")) & (F.col("c.pos") <= F.col("o.room")))
        joined = stored(near.select("o.*", "call_id", "pos", "ordinal", "target_id", "reason"), "reached")
        cut = joined.filter("room < n_calls and pos = room").select("request_id", (F.col("rank") * 1000 + 999).alias("seq"), F.lit("callLimit").alias("kind"), "node_id", F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("target_id"), F.when(F.col("room") > 0, F.col("ordinal")).otherwise(0).cast("long").alias("next_ordinal"), (F.col("n_calls") - F.col("room")).alias("omitted_calls"))
        taken = joined.filter("pos < room").select("request_id", "node_id", "rank", "max_nodes", "n_nodes", (F.col("prior") + F.col("pos")).alias("at"), "pos", "call_id", "target_id", "reason")
        seen = admitted.select("request_id", F.col("node_id").alias("target_id"), F.lit(True).alias("known"))
        e = taken.join(seen, ["request_id", "target_id"], "left")
        fresh = (F.col("reason") == "none") & F.col("known").isNull()
        first = F.row_number().over(Window.partitionBy("request_id", "target_id", fresh).orderBy("at"))
        e = e.withColumn("fresh", fresh).withColumn("first", fresh & (first == 1))
        # places in the node budget, by order of first discovery; a target beyond it is refused at every call
        place = F.sum(F.col("first").cast("long")).over(Window.partitionBy("request_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        e = e.withColumn("place", F.when(F.col("first"), place))
        e = e.withColumn("place", F.max("place").over(Window.partitionBy("request_id", "target_id", "fresh")))
        e = e.withColumn("fits", F.col("n_nodes") + F.col("place") <= F.col("max_nodes"))
        visit = F.when(F.col("reason") != "none", "boundary").when(~F.col("fresh"), "seen").when(~F.col("fits"), "boundary").when(F.col("first"), "new").otherwise("seen")
        e = stored(e.withColumn("visit", visit).withColumn("why", F.when(F.col("fresh") & ~F.col("fits"), "nodeLimit").otherwise(F.col("reason"))), "edges")
        edges = e.select("request_id", F.col("at").alias("pos"), "call_id", F.col("node_id").alias("src"), F.when(F.col("visit") != "boundary", F.col("target_id")).alias("dst"), "visit", F.col("why").alias("reason"))
        refused = e.filter("why = 'nodeLimit'").select("request_id", (F.col("rank") * 1000 + F.col("pos")).alias("seq"), F.col("why").alias("kind"), "node_id", "call_id", "target_id", F.lit(None).cast("long").alias("next_ordinal"), F.lit(0).cast("long").alias("omitted_calls"))
        frontier = at_depth.unionByName(cut).unionByName(refused)
        new = e.filter("visit = 'new'").select("request_id", F.col("target_id").alias("node_id"), F.lit(depth + 1).alias("depth"), (F.col("n_nodes") + F.col("place") - 1).alias("rank"))
        all_edges = edges if all_edges is None else all_edges.unionByName(edges)
        all_frontier = frontier if all_frontier is None else all_frontier.unionByName(frontier)
        spent = e.groupBy("request_id").agg(F.count("*").alias("c"), F.count_if(F.col("visit") == "new").alias("w"))
        used = stored(used.join(spent, "request_id", "left").select("request_id", (F.col("used") + F.coalesce("c", F.lit(0))).alias("used"), (F.col("n_nodes") + F.coalesce("w", F.lit(0))).alias("n_nodes")), "used")
        admitted = stored(admitted.unionByName(new), "nodes")
    if all_edges is None:
        all_edges = spark.createDataFrame([], "request_id string, pos long, call_id string, src string, dst string, visit string, reason string")
        all_frontier = spark.createDataFrame([], "request_id string, seq long, kind string, node_id string, call_id string, target_id string, next_ordinal long, omitted_calls long")
    return admitted, all_edges, all_frontier


def answer_flags(requests: DataFrame, edges: DataFrame, frontier: DataFrame, incomplete: DataFrame | None = None) -> DataFrame:
    """request_id, truncated (any frontier), partial (truncated, incomplete coverage or any boundary edge)."""
    t = frontier.select("request_id").distinct().withColumn("_t", F.lit(True))
    b = edges.filter("visit = 'boundary'").select("request_id").distinct().withColumn("_b", F.lit(True))
    j = requests.select("request_id").join(t, "request_id", "left").join(b, "request_id", "left")
    if incomplete is not None:
        j = j.join(incomplete.select("request_id").distinct().withColumn("_i", F.lit(True)), "request_id", "left")
    else:
        j = j.withColumn("_i", F.lit(None).cast("boolean"))
    no = F.lit(False)
    return j.select("request_id", F.coalesce("_t", no).alias("truncated"), (F.coalesce("_t", no) | F.coalesce("_b", no) | F.coalesce("_i", no)).alias("partial"))


#: Warning codes in their fixed order.
WARNING_ORDER = ("syntaxOnly", "coverageIncomplete", "staleEvidence", "staleTarget", "bindingAmbiguous")


def warnings(requests: DataFrame, coverage: DataFrame, provenance: DataFrame, bindings: DataFrame) -> DataFrame:
    """request_id, code, provenance_id, place: exactly the warnings that an answer's rows call for, in order of code,
    without a provenance first.

    requests: request_id, producer_id. coverage: request_id, selected, state. provenance: request_id, provenance_id,
    freshness. bindings (of returned edges): request_id, provenance_id, resolution, stale_target. Each holds returned
    rows alone. A stale provenance warns by itself, possibly stale ones warn once together."""
    none = F.lit(None).cast("string").alias("provenance_id")
    one = lambda df, cond, code, pid: df.filter(cond).select("request_id", F.lit(code).alias("code"), pid)
    found = (
        one(requests, "producer_id is null", "syntaxOnly", none)
        .union(one(coverage, "selected and state <> 'complete'", "coverageIncomplete", none))
        .union(one(provenance, "freshness = 'stale'", "staleEvidence", F.col("provenance_id")))
        .union(one(provenance, "freshness = 'possiblyStale'", "staleEvidence", none))
        .union(one(bindings, "stale_target", "staleTarget", F.col("provenance_id")))
        .union(one(bindings, "resolution = 'ambiguous'", "bindingAmbiguous", F.col("provenance_id")))
        .distinct()
    )
    rank = F.array_position(F.array(*[F.lit(x) for x in WARNING_ORDER]), F.col("code"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy(rank, F.col("provenance_id").asc_nulls_first())).cast("long"))


def _steps(most: int | None) -> Iterable[int]:
    return count(1) if most is None else range(1, most + 1)


def _grown(found: DataFrame, front: DataFrame, step: int, name: str) -> DataFrame:
    """found and front, written as one table now and then, so that the plan stays small however many steps there are."""
    both = found.unionByName(front)
    return both if step % MERGE_STEPS else stored(both, name)


def distances(seeds: DataFrame, edges: DataFrame, most: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """id, distance: the least number of edges from any seed, over allowed nodes alone if given; up to `most` if given,
    else until no step finds a node."""
    if allowed is not None:
        edges = edges.join(allowed.select(F.col("id").alias("dst")), "dst", "left_semi")
    edges = stored(edges.select("src", "dst").distinct(), "steps")
    found = stored(seeds.select("id").distinct().withColumn("distance", F.lit(0)), "distances")
    front = found
    for step in _steps(most):
        front = stored(front.select(F.col("id").alias("src")).join(edges, "src").select(F.col("dst").alias("id")).distinct().join(found, "id", "left_anti").withColumn("distance", F.lit(step)), "front")
        if not front.limit(1).count():
            break
        found = _grown(found, front, step, "distances")
    return found


def distances_by_kind(seeds: DataFrame, calls: DataFrame, callbacks: DataFrame, most: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """id, kind, distance: as distances() over calls and callback arguments, by how a node is reached: `called` over calls
    alone, `referenced` over paths with at least one callback argument, which is a reference and no executed call. A
    node may be both, with a distance each. calls: src, dst, resolution (only internal ones lead on); callbacks: src, dst.

    It is one fixpoint over pairs of node and kind, in which a callback argument leads from either kind to referenced."""
    if allowed is not None:
        ok = allowed.select(F.col("id").alias("dst"))
        calls, callbacks = calls.join(ok, "dst", "left_semi"), callbacks.join(ok, "dst", "left_semi")
    at = lambda c, kind: F.struct(F.col(c).alias("id"), F.lit(kind).alias("kind"))
    step = lambda df, a, b: df.select(at("src", a).alias("src"), at("dst", b).alias("dst"))
    inner = calls.filter("resolution = 'internal'")
    both = step(inner, "called", "called").unionByName(step(inner, "referenced", "referenced")).unionByName(step(callbacks, "called", "referenced")).unionByName(step(callbacks, "referenced", "referenced"))
    found = distances(seeds.select(at("id", "called").alias("id")), both, most)
    return found.select("id.id", "id.kind", "distance")


def closure(seeds: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """seed, id, distance of all nodes that each seed reaches, itself at 0; each level drops what the seed has. Up to
    `most` edges if given, else until no step finds a node."""
    edges = stored(edges.select("src", "dst").distinct(), "steps")
    found = stored(seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("distance", F.lit(0)), "closure")
    front = found
    for step in _steps(most):
        front = stored(front.select("seed", F.col("id").alias("src")).join(edges, "src").select("seed", F.col("dst").alias("id")).distinct().join(found, ["seed", "id"], "left_anti").withColumn("distance", F.lit(step)), "front")
        if not front.limit(1).count():
            break
        found = _grown(found, front, step, "closure")
    return found


def hierarchy(seeds: DataFrame, relations: DataFrame, most: int | None = None) -> DataFrame:
    """seed, id, direction, distance: ancestors and descendants over extends and implements with evidence. The two are
    closed apart, so no sibling comes in through a shared ancestor."""
    r = relations.filter("kind in ('extends', 'implements') and provenance_id is not null").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    up = closure(seeds, r, most).withColumn("direction", F.lit("ancestor"))
    down = closure(seeds, r.select(F.col("dst").alias("src"), F.col("src").alias("dst")), most).withColumn("direction", F.lit("descendant"))
    return up.unionByName(down).filter("distance > 0").select("seed", "id", "direction", "distance")


def _peeled(live: DataFrame) -> DataFrame:
    """live without the edges of nodes that lack incoming or outgoing ones, again and again until none is left."""
    n = live.count()
    while n:
        both = live.select(F.col("src").alias("id")).intersect(live.select(F.col("dst").alias("id")))
        live = stored(live.join(both.select(F.col("id").alias("src")), "src", "left_semi").join(both.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"), "live")
        m = live.count()
        if m == n:
            break
        n = m
    return live


def _least_source(live: DataFrame) -> DataFrame:
    """id, label: for each node the least of itself and all nodes that reach it."""
    ids = live.select(F.col("src").alias("id")).union(live.select("dst")).distinct()
    labels = stored(ids.select("id", F.col("id").alias("label"), F.lit(True).alias("moved")), "labels")
    while labels.filter("moved").limit(1).count():
        sent = labels.filter("moved").select(F.col("id").alias("src"), "label").join(live, "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("least"))
        lower = F.coalesce(F.col("least") < F.col("label"), F.lit(False))
        labels = stored(labels.join(sent, "id", "left").select("id", F.least("label", "least").alias("label"), lower.alias("moved")), "labels")
    return labels.select("id", "label")


def on_cycle(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves. Nodes without incoming or outgoing edges are peeled off until none is left to peel;
    what stays is cycles and what lies between them. In this each node gets the least node that reaches it as a label:
    those with a label that reach its node over edges within the label are strongly connected. They are taken out, and
    the rest, whose cycles lie within a label too, goes through the same again until no edge is left."""
    live = stored(edges.select("src", "dst").distinct(), "live")
    found = live.filter("src = dst").select(F.col("src").alias("id"))
    live = _peeled(live.filter("src <> dst"))
    for step in count(1):
        if not live.limit(1).count():
            return found.distinct()
        labels = _least_source(live)
        within = live.join(labels.select(F.col("id").alias("src"), F.col("label").alias("_s")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("_d")), "dst").filter("_s = _d")
        within = stored(within.select("src", "dst"), "live")
        part = stored(distances(labels.filter("id = label"), within.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select("id").join(labels, "id"), "parts")
        several = part.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1")
        found = _grown(found, part.join(several, "label", "left_semi").select("id"), step, "cycles")
        out = lambda end: part.select(F.col("id").alias(end))  # noqa: B023, E731
        live = _peeled(stored(within.join(out("src"), "src", "left_anti").join(out("dst"), "dst", "left_anti").select("src", "dst"), "live"))


def region_closure(ids: DataFrame, regions: DataFrame, most: int | None = None) -> DataFrame:
    """group, id: the regions of each group and all that enclose them, `most` levels up if given."""
    found = stored(ids.select("group", "id").distinct(), "regions")
    regions = stored(regions.select("id", "parent_id").filter("parent_id is not null"), "parents")
    front = found
    for step in _steps(most):
        front = stored(front.join(regions.select("id", "parent_id"), "id").filter("parent_id is not null").select("group", F.col("parent_id").alias("id")).distinct().join(found, ["group", "id"], "left_anti"), "front")
        if not front.limit(1).count():
            break
        found = _grown(found, front, step, "regions")
    return found


def fan(edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out."""
    one = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return one.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def neighborhood(focus: DataFrame, related: DataFrame, valid: DataFrame, expansions: int = 12, most: int = 24) -> DataFrame:
    """request_id, node_id, place: each focus, then at most `expansions` valid related nodes in order, `most` in all.
    No edges are given: names alone are no evidence of a relation."""
    ok = related.join(valid.select("node_id").distinct(), "node_id", "left_semi").join(focus, ["request_id", "node_id"], "left_anti").distinct()
    r = ok.withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy("node_id"))).filter(F.col("place") <= min(expansions, most - 1))
    return focus.withColumn("place", F.lit(0)).unionByName(r.select("request_id", "node_id", "place"))


def view_query(requests: DataFrame, calls: DataFrame, prefixes: list[str], max_calls: int = 500) -> DataFrame:
    """request_id, call_id, omitted: the seed's own calls in source order, without excluded paths, up to max_calls."""
    from .relate import exclude_paths

    j = requests.select("request_id", F.col("seed").alias("owner_id")).join(calls, "owner_id")
    kept = exclude_paths(j, prefixes, F.lit(False))
    w = Window.partitionBy("request_id")
    one = kept.withColumn("_r", F.row_number().over(w.orderBy("path", "start", "end", "call_id"))).withColumn("_n", F.count("*").over(w))
    return one.filter(F.col("_r") <= max_calls).select("request_id", "call_id", F.greatest(F.col("_n") - max_calls, F.lit(0).cast("long")).alias("omitted"))


def view_caps(view: DataFrame, max_nodes: int = 150, max_calls: int = 500) -> DataFrame:
    """request_id, kind (node or call), id, place (from 1), omitted, truncated of what a view shows: the first max_calls
    calls in order, the first max_nodes targets of these, how many of the kind were left out, and whether any of the
    request was. view: request_id, at (order), call_id, target_id."""
    by = Window.partitionBy("request_id")
    calls = view.withColumn("place", F.row_number().over(by.orderBy("at", "call_id"))).withColumn("omitted", F.greatest(F.count("*").over(by) - max_calls, F.lit(0).cast("long"))).filter(F.col("place") <= max_calls)
    first = calls.filter("target_id is not null").groupBy("request_id", F.col("target_id").alias("id")).agg(F.min("place").alias("p"))
    nodes = first.withColumn("place", F.row_number().over(by.orderBy("p"))).withColumn("omitted", F.greatest(F.count("*").over(by) - max_nodes, F.lit(0).cast("long"))).filter(F.col("place") <= max_nodes)
    out = calls.select("request_id", F.lit("call").alias("kind"), F.col("call_id").alias("id"), "place", "omitted").unionByName(nodes.select("request_id", F.lit("node").alias("kind"), "id", "place", "omitted"))
    return out.withColumn("truncated", F.max(F.col("omitted") > 0).over(by))


def sequence_steps(calls: DataFrame, max_steps: int = 200, max_participants: int = 20) -> DataFrame:
    """owner_id, step, call_id, participant, nesting: calls of each owner in evaluation order (an argument before the
    call that takes it), within the enclosing branches and loops. Steps beyond max_steps, and those whose receiver is
    beyond the first max_participants, are left out. calls: owner_id, call_id, start, end, receiver, region_path."""
    w = Window.partitionBy("owner_id")
    step = F.row_number().over(w.orderBy("end", F.col("start").desc(), "call_id"))
    one = calls.withColumn("step", step)
    first = F.min("step").over(Window.partitionBy("owner_id", "receiver"))
    one = one.withColumn("_f", first).withColumn("participant", F.dense_rank().over(w.orderBy("_f")))
    return one.filter((F.col("step") <= max_steps) & (F.col("participant") <= max_participants)).select("owner_id", F.col("step").cast("long").alias("step"), "call_id", F.col("participant").cast("long").alias("participant"), F.array_join("region_path", "/").alias("nesting"))


def source_order(calls: DataFrame, owner: str = "owner_id") -> DataFrame:
    """Adds pos: the place of a call among its owner's, by path, start, end and id."""
    return calls.withColumn("pos", (F.row_number().over(Window.partitionBy(owner).orderBy("path", "start", "end", "call_id")) - 1).cast("long"))
