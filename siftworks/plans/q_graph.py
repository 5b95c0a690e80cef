"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftworks.operators import graph as G
from siftworks.operators import relate as R
from siftworks.operators import stats as S
from siftworks.plans import views as V
from siftworks.plans.registry import query


def _calls(spark, d):
    """Edges as calls: an edge to a part of an even key of a customer's third order can't be followed."""
    e = V.edges(spark, d)
    e = e.select(F.col("src").alias("owner_id"), "call_id", F.lit("p").alias("path"), F.col("ordinal").alias("start"), F.col("ordinal").alias("end"), "ordinal", F.col("dst").alias("target_id"))
    odd = F.when(F.col("target_id").rlike("^part:.*[05]$"), "external").when(F.col("target_id").rlike("^part:.*7$"), "ambiguous").otherwise("none")
    return G.source_order(e).withColumn("reason", odd)


def _requests(spark, d, depth=3, nodes=40, calls=60):
    c = V.table(spark, d, "customer")
    return c.select(F.concat(F.lit("q"), F.col("c_custkey").cast("string")).alias("request_id"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("root_id"), F.lit(depth).alias("depth"), F.lit(nodes).alias("max_nodes"), F.lit(calls).alias("max_calls"))


@query()
def g1_graph_answers(spark, d):
    """Edges of bounded answers, one rooted at each customer; tests/test_graph.py holds them against a plain queue."""
    return G.graph_answers(_requests(spark, d), _calls(spark, d))[1]


@query()
def g2_frontier(spark, d):
    return G.graph_answers(_requests(spark, d), _calls(spark, d))[2]


def _one_level(spark, d):
    """Answers one call deep for each order, at most four calls and three nodes."""
    o = V.table(spark, d, "orders").select("o_orderkey").distinct()
    key = F.col("o_orderkey").cast("string")
    return G.graph_answers(o.select(F.concat(F.lit("o"), key).alias("request_id"), F.concat(F.lit("order:"), key).alias("root_id"), F.lit(1).alias("depth"), F.lit(3).alias("max_nodes"), F.lit(4).alias("max_calls")), _calls(spark, d))


_LEVEL = V.GRAPH + """, c as (select 'o' || o_orderkey as request_id, call_id, dst, ordinal, row_number() over (partition by src order by ordinal, call_id) - 1 as pos, count(*) over (partition by src) as n,
  case when regexp_matches(dst, '^part:.*[05]$') then 'external' when regexp_matches(dst, '^part:.*7$') then 'ambiguous' else 'none' end as why from edges join (select distinct o_orderkey from orders) on src = 'order:' || o_orderkey)"""


@query("with " + _LEVEL + """, f as (select *, row_number() over (partition by request_id, dst order by pos) = 1 as first from c where pos < 4),
p as (select *, sum(case when first and why = 'none' then 1 else 0 end) over (partition by request_id order by pos) as seen from f), q as (select *, max(case when first then seen end) over (partition by request_id, dst) as place from p)
select request_id, call_id, case when why <> 'none' then 'boundary' when place > 2 then 'boundary' when first then 'new' else 'seen' end as visit, case when why = 'none' and place > 2 then 'nodeLimit' else why end as reason from q""")
def w9_first_discovery(spark, d):
    """The first call that reaches a node discovers it, as long as the node budget lasts."""
    return _one_level(spark, d)[1].select("request_id", "call_id", "visit", "reason")


@query("with " + _LEVEL + " select request_id, ordinal as next_ordinal, n - 4 as omitted_calls from c where pos = 4")
def w10_call_budget(spark, d):
    """Where the call budget cut an answer, and how many calls it left out."""
    return _one_level(spark, d)[2].filter("kind = 'callLimit'").select("request_id", "next_ordinal", "omitted_calls")


_FOLLOW = V.GRAPH + """, f as (select src, dst from edges where not regexp_matches(dst, '^part:.*[057]$'))"""


@query("with recursive " + _FOLLOW + """, reach as (select 'customer:' || c_custkey as root, 'customer:' || c_custkey as id, 0 as depth from customer union select root, dst, depth + 1 from reach join f on f.src = reach.id where depth < 2)
select 'q' || string_split(root, ':')[2] as request_id, id as node_id, min(depth) as depth from reach group by 1, 2""")
def g1_reach_unbounded(spark, d):
    """Nodes of answers whose budgets can't run out at this depth: plain reachability."""
    nodes, _, _ = G.graph_answers(_requests(spark, d, depth=2, nodes=10**9, calls=10**9), _calls(spark, d))
    return nodes.select("request_id", "node_id", "depth")


@query("with " + V.BINDINGS + """, w as (select 'q' || n_nationkey as request_id, 'syntaxOnly' as code, null as provenance_id, 1 as r from nation where n_nationkey % 4 = 0 union
select 'q' || c_nationkey, 'coverageIncomplete', null, 2 from customer where c_custkey % 3 = 0 and c_acctbal < 0 union
select 'q' || (l_orderkey % 25), 'staleEvidence', case when l_linestatus = 'F' then 'p' || l_suppkey end, 3 from lineitem where l_linenumber > 5 union
select 'q' || (l_orderkey % 25), 'staleTarget', 'p' || l_suppkey, 4 from lineitem where l_linenumber = 6 union select 'q' || (l_orderkey % 25), 'bindingAmbiguous', 'p' || l_suppkey, 5 from lineitem where l_returnflag = 'R' and l_quantity > 45)
select request_id, code, provenance_id, row_number() over (partition by request_id order by r, provenance_id nulls first) as place from w""")
def a18_warnings(spark, d):
    s = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    n, c, l = (V.table(spark, d, x) for x in ("nation", "customer", "lineitem"))  # noqa: E741
    req = n.select(s("q", F.col("n_nationkey")).alias("request_id"), F.when(F.col("n_nationkey") % 4 != 0, "p").alias("producer_id"))
    cov = c.select(s("q", F.col("c_nationkey")).alias("request_id"), (F.col("c_custkey") % 3 == 0).alias("selected"), F.when(F.col("c_acctbal") < 0, "partial").otherwise("complete").alias("state"))
    rid, pid = s("q", F.col("l_orderkey") % 25).alias("request_id"), s("p", F.col("l_suppkey")).alias("provenance_id")
    prov = l.select(rid, pid, F.when(F.col("l_linenumber") <= 5, "fresh").when(F.col("l_linestatus") == "F", "stale").otherwise("possiblyStale").alias("freshness"))
    bind = l.select(rid, pid, F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), "ambiguous").otherwise("internal").alias("resolution"), (F.col("l_linenumber") == 6).alias("stale_target"))
    return G.warnings(req, cov, prov, bind)


@query()
def a19_answer_flags(spark, d):
    req = _requests(spark, d)
    _, edges, frontier = G.graph_answers(req, _calls(spark, d))
    return G.answer_flags(req, edges, frontier)


@query("select 'q' || c_custkey as request_id, case when c_custkey % 7 = 0 then 'invalidRequest' when c_nationkey = 3 then 'sourceSetDenied' when c_nationkey % 5 = 4 then 'revisionUnavailable' when c_custkey % 11 = 0 then 'rootMissing' when c_custkey % 13 = 0 then 'producerUnavailable' end as error from customer")
def g3_validate_requests(spark, d):
    c = V.table(spark, d, "customer")
    req = c.select(F.concat(F.lit("q"), F.col("c_custkey").cast("string")).alias("request_id"), F.col("c_nationkey").alias("source_set_id"), (F.col("c_nationkey") % 5).alias("revision_id"), F.when(F.col("c_custkey") % 11 == 0, -1).otherwise(F.col("c_custkey")).alias("root_id"), F.when(F.col("c_custkey") % 13 == 0, "x").when(F.col("c_custkey") % 2 == 0, "p").alias("producer_id"), F.when(F.col("c_custkey") % 7 == 0, 9).otherwise(2).alias("depth"), F.lit(10).alias("max_nodes"), F.lit(10).alias("max_calls"))
    one = lambda c, *v: spark.createDataFrame([(x,) for x in v], c)
    return G.validate_requests(req, one("source_set_id int", 3), one("revision_id int", 0, 1, 2, 3), c.select(F.col("c_custkey").alias("root_id")), one("producer_id string", "p"))


@query("with recursive " + V.GRAPH + ", reach as (select 'customer:' || c_custkey as id, 0 as distance from customer where c_mktsegment = 'BUILDING' union select dst, distance + 1 from reach join edges on src = id) select id, min(distance) as distance from reach group by 1")
def g4_distances(spark, d):
    """From all customers of one market segment."""
    seeds = V.table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'")
    return G.distances(seeds.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id")), V.edges(spark, d))


@query("with recursive " + V.GRAPH + """, e as (select src, dst, src like 'part:%' as callback from edges where not (dst like 'supplier:%' and ends_with(dst, '3')) and (src not like 'order:%' or ordinal <> 2)),
reach as (select 'customer:' || c_custkey as id, 'called' as kind, 0 as distance from customer where c_mktsegment = 'BUILDING' union select dst, case when callback then 'referenced' else kind end, distance + 1 from reach join e on src = id) select id, kind, min(distance) as distance from reach group by 1, 2""")
def g4_distances_by_kind(spark, d):
    """A part's suppliers as its callback arguments, suppliers whose id ends in 3 aren't allowed, and the second lines of
    orders aren't internal."""
    seeds = V.table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    e = V.edges(spark, d)
    calls = e.filter("src not like 'part:%'").withColumn("resolution", F.when(F.col("src").startswith("order:") & (F.col("ordinal") == 2), "external").otherwise("internal"))
    allowed = V.nodes(spark, d).filter("not (id like 'supplier:%3')").select("id")
    return G.distances_by_kind(seeds, calls, e.filter("src like 'part:%'"), allowed=allowed)


_HIER = "rel as (select 'supplier:' || s_suppkey as s, 'nation:' || s_nationkey as t from supplier union all select 'nation:' || n_nationkey, 'region:' || n_regionkey from nation)"


@query("with recursive " + _HIER + """, up as (select t0.s as seed, t0.t as id, 1 as distance from rel t0 where t0.s like 'nation:%' union select up.seed, rel.t, distance + 1 from up join rel on rel.s = up.id),
down as (select t0.t as seed, t0.s as id, 1 as distance from rel t0 where t0.t like 'nation:%' union select down.seed, rel.s, distance + 1 from down join rel on rel.t = down.id)
select seed, id, 'ancestor' as direction, distance from up union all select seed, id, 'descendant', distance from down""")
def g5_hierarchy(spark, d):
    s, n = V.table(spark, d, "supplier"), V.table(spark, d, "nation")
    ref = lambda k, c: F.concat(F.lit(k + ":"), F.col(c).cast("string"))
    rel = s.select(F.lit("extends").alias("kind"), ref("supplier", "s_suppkey").alias("source_id"), ref("nation", "s_nationkey").alias("target_id"), F.lit("p").alias("provenance_id"))
    rel = rel.unionByName(n.select(F.lit("implements").alias("kind"), ref("nation", "n_nationkey").alias("source_id"), ref("region", "n_regionkey").alias("target_id"), F.lit("p").alias("provenance_id")))
    rel = rel.unionByName(n.select(F.lit("extends").alias("kind"), ref("nation", "n_nationkey").alias("source_id"), F.lit("nowhere").alias("target_id"), F.lit(None).cast("string").alias("provenance_id")))
    return G.hierarchy(n.select(ref("nation", "n_nationkey").alias("id")), rel)


@query("""with f as (select 'q' || n_nationkey as request_id, 'nation:' || n_nationkey as node_id from nation), r as (select 'q' || s_nationkey as request_id, 'supplier:' || s_suppkey as node_id from supplier union all select 'q' || c_nationkey, 'customer:' || c_custkey from customer),
ok as (select request_id, node_id, row_number() over (partition by request_id order by node_id) as place from r where node_id not like 'supplier:1%') select request_id, node_id, 0 as place from f union all select request_id, node_id, place::int from ok where place <= 12""")
def g6_neighborhood(spark, d):
    ref = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    n, s, c = (V.table(spark, d, x) for x in ("nation", "supplier", "customer"))
    focus = n.select(ref("q", "n_nationkey").alias("request_id"), ref("nation:", "n_nationkey").alias("node_id"))
    rel = s.select(ref("q", "s_nationkey").alias("request_id"), ref("supplier:", "s_suppkey").alias("node_id")).union(c.select(ref("q", "c_nationkey"), ref("customer:", "c_custkey")))
    return G.neighborhood(focus, rel, V.nodes(spark, d).filter("id not like 'supplier:1%'").select(F.col("id").alias("node_id")))


@query("with e as (select distinct s_nationkey as a, s_suppkey % 25 as b from supplier), t as (with recursive r as (select a as s, b as x from e union select s, e.b from r join e on e.a = x) select * from r) select distinct s as id from t where s = x")
def g7_cycles(spark, d):
    s = V.table(spark, d, "supplier")
    return G.on_cycle(s.select(F.col("s_nationkey").cast("long").alias("src"), (F.col("s_suppkey") % 25).alias("dst")))


@query("with c as (select 'q' || c_custkey as request_id, 'customer:' || c_custkey || '>order:' || o_orderkey || '>' || o_orderkey as call_id, row_number() over (partition by c_custkey order by o_orderkey) as r, count(*) over (partition by c_custkey) as n from customer join orders on o_custkey = c_custkey where o_orderkey % 10 <> 3) select request_id, call_id, greatest(n - 5, 0)::bigint as omitted from c where r <= 5")
def g8_view_query(spark, d):
    calls = _calls(spark, d).withColumn("path", F.when(F.col("ordinal") % 10 == 3, "skip/x").otherwise("keep/x"))
    return G.view_query(_requests(spark, d).select("request_id", F.col("root_id").alias("seed")), calls, ["skip/"], 5)


@query("""with c as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 100 as s, l_partkey % 100 + l_quantity as e, l_shipmode from (select *, 'r' || (l_suppkey % 4) as l_shipmode from lineitem)), o as (select l_orderkey as owner_id, l_linenumber || '/' || l_partkey || '/' || l_suppkey as call_id, l_shipmode, row_number() over (partition by l_orderkey order by e, s desc, l_linenumber || '/' || l_partkey || '/' || l_suppkey) as step from c),
f as (select *, min(step) over (partition by owner_id, l_shipmode) as fs from o) select owner_id, step, call_id, dense_rank() over (partition by owner_id order by fs) as participant, 'loop/' || l_shipmode as nesting from f where step <= 200""")
def g9_sequence_steps(spark, d):
    l = V.table(spark, d, "lineitem")  # noqa: E741
    r = F.concat(F.lit("r"), (F.col("l_suppkey") % 4).cast("string"))
    c = l.select(F.col("l_orderkey").alias("owner_id"), F.concat_ws("/", *[F.col(x).cast("string") for x in ("l_linenumber", "l_partkey", "l_suppkey")]).alias("call_id"), (F.col("l_partkey") % 100).cast("double").alias("start"), (F.col("l_partkey") % 100 + F.col("l_quantity")).alias("end"), r.alias("receiver"), F.array(F.lit("loop"), r).alias("region_path"))
    return G.sequence_steps(c)


@query("""with v as (select 's' || l_suppkey as request_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey as call_id, 'part:' || l_partkey as target_id, l_orderkey as o from lineitem),
c as (select *, row_number() over (partition by request_id order by o, call_id) as place, greatest(count(*) over (partition by request_id) - 40, 0)::bigint as omitted from v),
n as (select request_id, target_id as id, row_number() over (partition by request_id order by min(place)) as place, greatest(count(*) over (partition by request_id) - 30, 0)::bigint as omitted from c where place <= 40 group by 1, 2),
x as (select request_id, 'call' as kind, call_id as id, place, omitted from c where place <= 40 union all select request_id, 'node', id, place, omitted from n where place <= 30)
select request_id, kind, id, place::int as place, omitted, bool_or(omitted > 0) over (partition by request_id) as truncated from x""")
def t7_view_caps(spark, d):
    """Caps of 40 calls and 30 nodes, which these tables exceed."""
    l = V.table(spark, d, "lineitem")  # noqa: E741
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    view = l.select(s("s", "l_suppkey").alias("request_id"), F.col("l_orderkey").alias("at"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]).alias("call_id"), s("part:", "l_partkey").alias("target_id"))
    return G.view_caps(view, 30, 40)


@query("with " + V.GRAPH + " select id, sum(i)::bigint as fan_in, sum(o)::bigint as fan_out from (select src as id, 1 as o, 0 as i from edges union all select dst, 0, 1 from edges) group by 1")
def g10_fan(spark, d):
    return G.fan(V.edges(spark, d))


@query("select 'o' || o_orderkey as \"group\", id from orders, lateral (select 'n' || c_nationkey as id from customer where c_custkey = o_custkey union all select 'r' || n_regionkey from customer join nation on n_nationkey = c_nationkey where c_custkey = o_custkey)")
def j5_region_closure(spark, d):
    n, r = V.table(spark, d, "nation"), V.table(spark, d, "region")
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    regions = n.select(s("n", "n_nationkey").alias("id"), s("r", "n_regionkey").alias("parent_id")).union(r.select(s("r", "r_regionkey"), F.lit(None).cast("string")))
    ids = V.table(spark, d, "orders").join(V.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(s("o", "o_orderkey").alias("group"), s("n", "c_nationkey").alias("id"))
    return G.region_closure(ids, regions)
