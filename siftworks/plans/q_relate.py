"""Queries of the joins, ranges and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftworks.functions import text as T
from siftworks.operators import relate as R
from siftworks.operators import stats as S
from siftworks.plans import views as V
from siftworks.plans.registry import query


@query("with " + V.LINES + " select path, line_no from ln where not (path like 'src0/%' or path like 'src1/%')")
def p2_exclude_paths(spark, d):
    return R.exclude_paths(V.lines(spark, d), ["src0/", "src1/"], F.lit(False)).select("path", "line_no")


@query("with " + V.WORDS + " select wd.path, wd.start as at, wd.line_no as line, wd.start - ln.start + 1 as \"column\" from wd join ln using (path, line_no)")
def p5_line_columns(spark, d):
    pts = V.words(spark, d).select("path", F.col("start").alias("at"))
    return R.with_line_columns(pts, V.lines(spark, d)).select("path", "at", "line", "column")


#: Ranges of lines of a document of n lines: the first, the last, the middle third, all, beyond the end, reversed, none.
_RANGES = ("1, 1", "n, n", "n // 3 + 1, 2 * n // 3 + 1", "1, n", "n, n + 5", "3, 2", "n + 1, n + 2")
_RANGED = "l as (select path, string_split(text, chr(10)) as ls from docs), n as (select path, ls, len(ls) as n from l), r as (" + " union all ".join(f"select {i} as k, path, ls, n, a, z from (select *, {x.partition(', ')[0]} as a, {x.partition(', ')[2]} as z from n)" for i, x in enumerate(_RANGES)) + ")"


def _ranged(docs):
    """request_id, path, first, last of all documents' ranges, and n."""
    n = docs.select("path", F.size(F.split("text", "\n")).alias("n"))
    pairs = F.array(*[F.struct(F.lit(i).alias("k"), F.expr(x.partition(", ")[0].replace("//", "div")).cast("int").alias("first"), F.expr(x.partition(", ")[2].replace("//", "div")).cast("int").alias("last")) for i, x in enumerate(_RANGES)])
    return n.select("path", "n", F.inline(pairs)).withColumn("request_id", F.concat_ws("#", "path", F.col("k").cast("string")))


@query("with " + V.DOCS + ", " + _RANGED + " select path || '#' || k as request_id, case when a <= z and a <= n then array_to_string(ls[a:z], chr(10)) end as slice, a <= z and a <= n as valid from r")
def p6_source_slice(spark, d):
    """Seven ranges of lines of every document."""
    docs = V.documents(spark, d)
    return R.read_lines(_ranged(docs).select("request_id", "path", "first", "last"), docs.select("path", F.encode("text", "UTF-8").alias("bytes")))


@query("with " + V.DOCS + " select path || '-' || share as fact_id, strlen(text[1:k])::bigint as byte_at from (select path, text, share, (length(text) * share // 8)::bigint as k from docs, range(9) t(share))")
def p7_coordinates(spark, d):
    """Nine offsets over the whole length of every document, in three units."""
    docs = V.documents(spark, d).select("path", "text")
    at = docs.select("path", "text", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("share")).withColumn("k", F.floor(F.length("text") * F.col("share") / 8).cast("int"))
    enc = F.element_at(F.array(F.lit("scalar"), F.lit("utf16"), F.lit("utf8")), (F.col("share") % 3 + 1).cast("int"))
    prefix = F.left("text", F.col("k"))
    off = F.when(enc == "utf8", F.octet_length(prefix)).when(enc == "utf16", F.octet_length(F.encode(prefix, "UTF-16BE")) / 2).otherwise(F.col("k")).cast("long")
    facts = at.select(F.concat_ws("-", "path", F.col("share").cast("string")).alias("fact_id"), "path", enc.alias("encoding"), off.alias("at"))
    return R.to_byte_offsets(facts, docs)


@query("with " + V.WORDS + " select path || '@' || start as row_id, word_no % 3 <> 0 as ok from wd")
def p8_witness(spark, d):
    w = V.words(spark, d)
    rows = w.select(F.concat_ws("@", "path", F.col("start").cast("string")).alias("row_id"), "path", "start", "end", F.when(F.col("word_no") % 3 == 0, F.concat("word", F.lit("x"))).otherwise(F.col("word")).alias("claimed"), F.lit(0).alias("owner_start"), F.lit(10**9).alias("owner_end"))
    return R.verify_witness(rows, V.documents(spark, d))


@query("select path, parent from (select 'r/' || r_regionkey as path, null as parent from region union all select 'r/' || n_regionkey || '/n/' || n_nationkey, 'r/' || n_regionkey from nation)")
def j1_parent_chain(spark, d):
    key = lambda c: F.struct(F.lit("k").alias("kind"), F.col(c).cast("string").alias("name"))
    r, n = V.table(spark, d, "region"), V.table(spark, d, "nation")
    none = F.array().cast("array<struct<kind:string,name:string>>")
    rows = r.select(F.concat(F.lit("r/"), F.col("r_regionkey").cast("string")).alias("syntax_id"), F.lit(1).alias("version_id"), none.alias("ancestors"), key("r_regionkey").alias("key"))
    rows = rows.unionByName(n.select(F.concat(F.lit("r/"), F.col("n_regionkey").cast("string"), F.lit("/n/"), F.col("n_nationkey").cast("string")).alias("syntax_id"), F.lit(1).alias("version_id"), F.array(key("n_regionkey")).alias("ancestors"), key("n_nationkey").alias("key")))
    return R.with_parent(rows).select(F.col("syntax_id").alias("path"), F.col("parent_id").alias("parent"))


@query("""with f as (select distinct l_orderkey, l_suppkey, l_orderkey || '/' || l_suppkey as fact_id from lineitem), m as (select l_orderkey, l_suppkey, l_linenumber from lineitem where l_linenumber <= 3),
a as (select f.fact_id, list_sort(list_distinct(list(m.l_linenumber::varchar) filter (m.l_linenumber is not null))) as c, any_value(f.l_suppkey) as s from f left join m using (l_orderkey, l_suppkey) group by 1)
select fact_id, case when s % 5 = 0 then 'unsupported' when len(coalesce(c, [])) = 1 then 'exact' when len(coalesce(c, [])) > 1 then 'ambiguous' else 'unmatched' end as join_status, case when s % 5 = 0 then '' else array_to_string(coalesce(c, []), ',') end as candidate_ids from a""")
def j2_anchor_join(spark, d):
    l = V.table(spark, d, "lineitem")  # noqa: E741
    facts = l.select("l_orderkey", "l_suppkey", F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("fact_id")).distinct()
    measured = l.filter("l_linenumber <= 3").select("l_orderkey", "l_suppkey", F.col("l_linenumber").cast("string").alias("m"))
    out = R.anchor_status(facts, measured, ["l_orderkey", "l_suppkey"], "fact_id", "m", F.col("l_suppkey") % 5 != 0)
    return out.withColumn("candidate_ids", F.array_join("candidate_ids", ","))


@query("select l_orderkey, l_linenumber, l_orderkey + (case when l_linenumber = 7 then 100000000 else 0 end) as owner from lineitem where l_linenumber = 7")
def j3_foreign_owners(spark, d):
    l = V.table(spark, d, "lineitem").withColumn("owner", F.col("l_orderkey") + F.when(F.col("l_linenumber") == 7, 100000000).otherwise(0)).withColumn("doc", F.lit(1))  # noqa: E741
    o = V.table(spark, d, "orders").select(F.lit(1).alias("doc"), F.col("o_orderkey").alias("owner"))
    ch = l.withColumn("id", F.struct("l_orderkey", "l_linenumber"))
    return R.foreign_owners(ch, o, "id", "owner", ["doc"]).select("id.l_orderkey", "id.l_linenumber", "owner")


@query("select l_orderkey, string_agg(l_partkey::varchar, ',' order by l_linenumber, l_partkey) as members, count(*) as n from lineitem group by 1")
def j4_ordered_members(spark, d):
    out = R.ordered_members(V.table(spark, d, "lineitem"), "l_orderkey", "l_partkey", ["l_linenumber"])
    return out.select("l_orderkey", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), "n")


@query("with " + V.WORDS + " select wd.path || '@' || wd.start as point_id, wd.path || '#' || wd.line_no as range_id from wd")
def j6_enclosing(spark, d):
    """Smallest range around each word: its line, not the document that also holds it."""
    ln = V.lines(spark, d)
    ranges = ln.select("path", F.concat_ws("#", "path", F.col("line_no").cast("string")).alias("range_id"), "start", "end")
    whole = V.documents(spark, d).select("path", F.concat(F.lit("doc:"), "path").alias("range_id"), F.lit(0).cast("long").alias("start"), (F.octet_length("text") + 1).cast("long").alias("end"))
    pts = V.words(spark, d).select(F.concat_ws("@", "path", F.col("start").cast("string")).alias("point_id"), "path", F.col("start").alias("at"))
    return R.enclosing(pts, ranges.unionByName(whole), "point_id")


@query("with " + V.WORDS + " select path, line_no, count(*) as declared from wd group by 1, 2")
def j7_declared_on_line(spark, d):
    w = V.words(spark, d).select("path", "line_no", "start")
    return V.lines(spark, d).select("path", "line_no").join(w, ["path", "line_no"]).groupBy("path", "line_no").agg(F.count("*").alias("declared"))


@query("select l_orderkey, l_suppkey, min(l_linenumber)::bigint as member from lineitem group by 1, 2 having count(*) = 1")
def j8_exactly_one(spark, d):
    l = V.table(spark, d, "lineitem")  # noqa: E741
    pts = l.select("l_orderkey", "l_suppkey").distinct().withColumn("id", F.struct("l_orderkey", "l_suppkey"))
    return R.exactly_one(pts, l.select("l_orderkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("member")), ["l_orderkey", "l_suppkey"], "id", "member").select("id.*", "member")


@query("with c as (select p_brand, string_agg(p_partkey::varchar, ',' order by p_partkey) filter (r <= 8) as candidates, greatest(count(*) - 8, 0)::bigint as omitted from (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) as r from part) group by 1) select p_partkey, candidates, omitted from part join c using (p_brand)")
def j9_native_candidates(spark, d):
    p = V.table(spark, d, "part")
    out = R.native_candidates(p.select(F.col("p_partkey").alias("call"), "p_brand"), p, "p_brand", "call", "p_partkey")
    return out.select(F.col("call").alias("p_partkey"), F.array_join(F.transform("candidates", lambda x: x.cast("string")), ",").alias("candidates"), "omitted")


@query("with " + V.BINDINGS + ", c as (select distinct call_id from bind), b as (select * from (select *, row_number() over (partition by call_id order by provenance_id, target) as r from bind where producer = 'p1' and freshness = 'fresh') where r = 1) select c.call_id, b.provenance_id, b.target, b.resolution, b.freshness, b.dispatch from c left join b using (call_id)")
def j10_bind_calls(spark, d):
    b = V.bindings(spark, d)
    usable = b.filter("freshness = 'fresh'").select("provenance_id")
    return R.bind_calls(b.select("call_id").distinct(), b, usable, "p1")


@query("select doc_id as id, case when doc_id % 4 = 0 then 'stale' when doc_id % 4 = 1 then 'possiblyStale' else 'fresh' end as freshness from documents where source is not null")
def j11_freshness(spark, d):
    docs = V.table(spark, d, "documents").filter("source is not null")
    pick = lambda k: F.when(F.col("doc_id") % 4 == k, "x").otherwise("y")
    basis = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("source_set_id"), pick(0).alias("manifest_hash"), pick(1).alias("toolchain_hash"), F.lit("y").alias("config_hash"), F.lit(None).cast("string").alias("dependency_hash"), F.lit("1").alias("producer_version"))
    snap = docs.select(F.col("source").alias("source_set_id")).distinct().select("source_set_id", *[F.lit("y").alias(c) for c in ("manifest_hash", "toolchain_hash", "config_hash")], F.lit(None).cast("string").alias("dependency_hash"), F.lit("1").alias("producer_version"))
    return R.freshness(basis, snap)


_COV = "cov as (select path, revision, ['complete', 'failed', 'partial', 'omitted'][((revision + ('0x' || hash[1:4])::bigint) % 4 + 1)::int] as state from revs)"


def _coverage(spark, d):
    st = F.element_at(F.array(*[F.lit(x) for x in ("complete", "failed", "partial", "omitted")]), ((F.col("revision") + F.conv(F.left("hash", F.lit(4)), 16, 10).cast("long")) % 4 + 1).cast("int"))
    return V.revisions(spark, d).withColumn("state", st)


@query("with " + V.REVISIONS + ", " + _COV + " select path, revision, state, (select max(g.revision) from cov g where g.path = c.path and g.revision < c.revision and g.state in ('complete', 'partial')) as usable_revision from cov c where state in ('failed', 'omitted')")
def j12_latest_usable(spark, d):
    return R.latest_usable(_coverage(spark, d), ["path"]).select("path", "revision", "state", "usable_revision")


_DIFF = V.REVISIONS + ", diff as (select coalesce(a.path, b.path) as path, case when a.path is null then 'added' when b.path is null then 'removed' when a.language <> b.language then 'languageChanged' when a.hash <> b.hash then 'changed' else 'unchanged' end as change from (select * from revs where revision = 1995) a full join (select * from revs where revision = 1996) b on a.path = b.path)"


def _diff(spark, d):
    r = V.revisions(spark, d)
    return R.diff_revisions(r.filter("revision = 1995"), r.filter("revision = 1996"))


@query("with " + _DIFF + " select * from diff")
def j13_diff_revisions(spark, d):
    return _diff(spark, d)


@query("select l.doc_id, 'rec-' || l.doc_id as record_id, not exists (select 1 from documents d where d.doc_id = l.doc_id and d.lang = 'en') as orphaned from labels l")
def j14_orphans(spark, d):
    rec = V.table(spark, d, "labels").select("doc_id", F.concat(F.lit("rec-"), F.col("doc_id").cast("string")).alias("record_id"))
    return R.orphans(rec, V.table(spark, d, "documents").filter("lang = 'en'"), "record_id", "doc_id")


@query("""with f as (select l_orderkey, l_suppkey, min(l_returnflag) as label from lineitem group by 1, 2 having count(distinct l_returnflag) = 1),
g as (select l_orderkey, l_suppkey, min(l_linenumber)::bigint as decl from lineitem group by 1, 2 having count(*) = 1) select l_orderkey, l_suppkey, decl, label from f join g using (l_orderkey, l_suppkey)""")
def j15_display_labels(spark, d):
    l = V.table(spark, d, "lineitem").withColumn("decl", F.struct("l_orderkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("decl")))  # noqa: E741
    out = R.display_labels(l.withColumn("label", F.col("l_returnflag")), l, ["l_orderkey", "l_suppkey"], "label", "decl")
    return out.select("decl.*", "label")


@query("with " + V.DOCS + ", " + _RANGED + " select path || '#' || k as citation_id, a <= z and z <= n and length(path) % 3 <> k % 3 as valid from r")
def j16_citations(spark, d):
    """Seven citations of every document, some with a changed last line; ranges that it doesn't have aren't valid."""
    docs = V.documents(spark, d)
    r = _ranged(docs).join(docs.select("path", F.split("text", "\n").alias("ls")), "path")
    quote = F.array_join(F.slice("ls", F.col("first"), F.greatest(F.col("last") - F.col("first") + 1, F.lit(0))), "\n")
    said = F.when(F.length("path") % 3 == F.col("k") % 3, F.concat(quote, F.lit("!"))).otherwise(quote)
    return R.check_citations(r.select(F.col("request_id").alias("citation_id"), "path", "first", "last", said.alias("quote")), docs)


@query("with " + V.GRAPH + ", c as (select id from nodes where kind in ('supplier', 'nation')) select call_id, src, dst from edges where src in (select id from c) and dst in (select id from c)")
def j17_edges_within(spark, d):
    return R.edges_within(V.edges(spark, d), V.nodes(spark, d).filter("kind in ('supplier', 'nation')")).select("call_id", "src", "dst")


@query("""with n as (select 's' || p_size as symbol, p_partkey as id, p_partkey % 4 = 0 as accessor from part where p_size <= 20), c as (select l_orderkey as call_id, ['s' || (l_orderkey % 30), 's' || (min(l_suppkey) % 60)] as cand from lineitem group by l_orderkey union all select o_orderkey + 10000000, [] from orders where o_orderkey % 50 = 0),
x as (select call_id, unnest(cand) as symbol from c), j as (select c.call_id, (select count(distinct n.id) from x join n on n.symbol = x.symbol and not n.accessor where x.call_id = c.call_id) as k, len(cand) as m,
 (select min(n.id) from x join n on n.symbol = x.symbol and not n.accessor where x.call_id = c.call_id) as id from c)
select call_id, case when k = 1 then 'internal' when k > 1 then 'ambiguous' when m > 0 then 'external' else 'unresolved' end as resolution, case when k = 1 then id end as target from j""")
def j18_resolve_symbols(spark, d):
    n = V.table(spark, d, "part").filter("p_size <= 20").select(F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("symbol"), F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4 == 0).alias("accessor"))
    s = lambda c: F.concat(F.lit("s"), c.cast("string"))
    first = V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("k"))
    calls = first.select(F.col("l_orderkey").alias("call_id"), F.array(s(F.col("l_orderkey") % 30), s(F.col("k") % 60)).alias("candidates"))
    none = V.table(spark, d, "orders").filter("o_orderkey % 50 = 0").select((F.col("o_orderkey") + 10000000).alias("call_id"), F.array().cast("array<string>").alias("candidates"))
    return R.resolve_symbols(calls.unionByName(none), n)


@query("""with chain as (select 'n' || n_nationkey as scope, 'n' || n_nationkey as ancestor, 0 as depth from nation union all select 'n' || n_nationkey, 'r' || n_regionkey, 1 from nation),
refs as (select 'c' || c_custkey as ref_id, 'n' || c_nationkey as scope, 'm' || (c_custkey % 4) as name from customer),
b as (select 'n' || n_nationkey as scope, 'm' || (n_nationkey % 4) as name, 'tn' || n_nationkey as target, case when n_nationkey % 3 = 0 then 'blocked' else 'binding' end as kind from nation
 union all select 'r' || r_regionkey, 'm' || m, 'tr' || r_regionkey || m, 'binding' from region, unnest([0, 1, 2]) t(m) union all select 'r' || r_regionkey, 'm1', 'other', 'binding' from region),
h as (select ref_id, depth, count(distinct target) as n, bool_or(kind <> 'binding') as stop, min(target) as t from refs join chain using (scope) join b on b.scope = chain.ancestor and b.name = refs.name group by 1, 2),
near as (select * from h where depth = (select min(depth) from h g where g.ref_id = h.ref_id))
select refs.ref_id, case when not stop and n = 1 then t end as qualified from refs left join near using (ref_id)""")
def j19_qualify_names(spark, d):
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, r = V.table(spark, d, "nation"), V.table(spark, d, "region")
    chain = n.select(s("n", "n_nationkey").alias("scope"), s("n", "n_nationkey").alias("ancestor"), F.lit(0).alias("depth")).union(n.select(s("n", "n_nationkey"), s("r", "n_regionkey"), F.lit(1)))
    refs = V.table(spark, d, "customer").select(s("c", "c_custkey").alias("ref_id"), s("n", "c_nationkey").alias("scope"), F.concat(F.lit("m"), (F.col("c_custkey") % 4).cast("string")).alias("name"))
    own = n.select(s("n", "n_nationkey").alias("scope"), F.concat(F.lit("m"), (F.col("n_nationkey") % 4).cast("string")).alias("name"), s("tn", "n_nationkey").alias("target"), F.when(F.col("n_nationkey") % 3 == 0, "blocked").otherwise("binding").alias("kind"))
    up = r.select("r_regionkey", F.explode(F.array(F.lit("0"), F.lit("1"), F.lit("2"))).alias("m")).select(s("r", "r_regionkey").alias("scope"), F.concat(F.lit("m"), "m").alias("name"), F.concat(s("tr", "r_regionkey"), "m").alias("target"), F.lit("binding").alias("kind"))
    more = r.select(s("r", "r_regionkey").alias("scope"), F.lit("m1").alias("name"), F.lit("other").alias("target"), F.lit("binding").alias("kind"))
    return R.qualify_names(refs, chain, own.unionByName(up).unionByName(more))


@query("""with d as (select distinct p_brand as package from part union all select 'no-' || p_size from part where p_size < 5 group by 1), k as (select p_brand as package, count(distinct case when p_brand like '%1' then p_size else 1 end) as v, min(case when p_brand like '%1' then p_size else 1 end)::varchar as version,
 min((case when p_brand like '%1' then p_size else 1 end)::varchar) as ver from part group by 1), s as (select p_brand as package, bool_or(p_brand like '%2') as allowed from part where p_brand not like '%5' group by 1)
select d.package as dependency, replace(d.package, '-', '_') as alias, case when v is null then 'missing' when v > 1 then 'ambiguous' when allowed is null then 'missing' when not allowed then 'blocked' else 'present' end as state, case when v = 1 then ver end as version from d left join k using (package) left join s using (package)""")
def j20_packages(spark, d):
    p = V.table(spark, d, "part")
    direct = p.select(F.col("p_brand").alias("package")).distinct().union(p.filter("p_size < 5").select(F.concat(F.lit("no-"), F.col("p_size").cast("string"))).distinct())
    lock = p.select(F.col("p_brand").alias("package"), F.when(F.col("p_brand").like("%1"), F.col("p_size")).otherwise(1).cast("string").alias("version"))
    src = p.filter(~F.col("p_brand").like("%5")).select(F.col("p_brand").alias("package"), F.col("p_brand").like("%2").alias("allowed"))
    return R.resolve_packages(direct, lock, src)


@query("""select rule, value, n from (select 'labels.doc_id' as rule, doc_id::varchar as value, count(*) as n from labels where doc_id not in (select doc_id from documents where lang = 'en') group by 2 union all
select 'orders.custkey', o_custkey::varchar, count(*) from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 20) group by 2)""")
def j21_fk_violations(spark, d):
    t = lambda n: V.table(spark, d, n)
    return R.fk_violations([("labels.doc_id", t("labels"), "doc_id", t("documents").filter("lang = 'en'"), "doc_id"), ("orders.custkey", t("orders"), "o_custkey", t("customer").filter("c_nationkey < 20"), "c_custkey")])


@query("with " + V.REVISIONS + " select distinct hash as version_id from revs where hash not in (select hash from revs where revision >= 1997)")
def j22_unreferenced(spark, d):
    r = V.revisions(spark, d).withColumnRenamed("hash", "version_id")
    return R.unreferenced(r.select("version_id").distinct(), r.filter("revision >= 1997"))


@query("with " + V.BINDINGS + " select distinct 'r' || (o_custkey % 10) as request_id, provenance_id from orders join lineitem on l_orderkey = o_orderkey join bind on bind.target = 'part:' || l_partkey ")
def j24_historical_provenance(spark, d):
    o = V.table(spark, d, "orders").join(V.table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") % 10).alias("r"), "l_partkey").distinct()
    answers = o.select(F.concat(F.lit("r"), F.col("r").cast("string")).alias("request_id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("node_id"))
    return R.historical_provenance(answers, V.bindings(spark, d).select(F.col("target").alias("node_id"), "provenance_id"))


@query("with " + V.REVISIONS + ", f as (select path, path || '!' as fact_id from revs where revision = 1995), s as (select a.path from revs a join revs b on a.path = b.path and a.hash = b.hash and a.revision = 1995 and b.revision = 1996) select path, case when path in (select path from s where path not like '%7') then 'complete' else 'partial' end as state from f")
def j25_rejoin(spark, d):
    r = V.revisions(spark, d)
    old, new = r.filter("revision = 1995"), r.filter("revision = 1996")
    facts = old.select("path", F.concat("path", F.lit("!")).alias("fact_id"), F.lit("k").alias("key"))
    decls = new.select("path", F.lit("k").alias("key"), F.concat("path", F.lit("#a")).alias("syntax_id"))
    return R.rejoin_facts(facts, old, new, decls.union(decls.filter(F.col("path").like("%7"))))[1]


@query("select p_partkey, p_name from part where p_partkey in (select l_partkey from lineitem where l_orderkey = 1)")
def j26_point_lookup(spark, d):
    keys = V.table(spark, d, "lineitem").filter("l_orderkey = 1").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return V.table(spark, d, "part").join(keys, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("with " + V.BINDINGS + ", m as (select call_id, producer, list_sort(list_distinct(list(target))) as t, list_sort(list_distinct(list(provenance_id))) as p, min(resolution) as r from bind group by 1, 2) select call_id, producer, case when len(t) > 1 then 'ambiguous' else r end as resolution, array_to_string(t, ',') as targets, array_to_string(p, ',') as provenances from m")
def a12_merge_bindings(spark, d):
    m = R.merge_bindings(V.bindings(spark, d))
    return m.withColumn("targets", F.array_join("targets", ",")).withColumn("provenances", F.array_join("provenances", ","))


@query("with " + V.BINDINGS + " select provenance_id, case when freshness <> 'fresh' then 'stale' when resolution = 'unresolved' then 'unresolved' when resolution = 'external' then 'external' when dispatch not in ('direct', 'constructor') then 'dispatch' else 'none' end as reason from bind")
def c8_boundary_reason(spark, d):
    b = V.bindings(spark, d)
    return b.select("provenance_id", R.boundary_reason(F.col("resolution"), F.col("freshness"), F.col("dispatch"), F.lit(True), F.lit(True)).alias("reason"))


@query("with " + V.REVISIONS + " select count(*) filter (b is null) as only_a, count(*) filter (a is null) as only_b, count(*) filter (a is null or b is null) = 0 as same from (select a.path as a, b.path as b from (select distinct path from revs where revision = 1995) a full join (select distinct path from revs where revision = 1996) b on a.path = b.path)")
def u2_same_inventory(spark, d):
    r = V.revisions(spark, d)
    return S.same_inventory(r.filter("revision = 1995"), r.filter("revision = 1996"))


@query("with c as (select doc_id from documents), dd as (select doc_id, count(*) as n from (select doc_id from labels union all select doc_id from labels where quality = 0 union all select -1 - doc_id from labels where toxic = 1) group by 1) select coalesce(c.doc_id, dd.doc_id) as doc_id, case when c.doc_id is null then 'unknown' when n is null then 'missing' else 'duplicate' end as problem from c full join dd on c.doc_id = dd.doc_id where c.doc_id is null or n is null or n > 1")
def u3_decision_gaps(spark, d):
    lab = V.table(spark, d, "labels").select("doc_id")
    again, unknown = V.table(spark, d, "labels").filter("quality = 0").select("doc_id"), V.table(spark, d, "labels").filter("toxic = 1").select(-1 - F.col("doc_id"))
    return S.decision_gaps(V.table(spark, d, "documents"), lab.union(again).union(unknown), "doc_id")


@query("with " + V.WORDS + " select distinct path from (select path from ln union all select path from wd)")
def u4_touched_paths(spark, d):
    return V.lines(spark, d).select("path").union(V.words(spark, d).select("path")).distinct()


@query("select p_partkey from part where p_size % 3 = 0 or p_size % 5 = 0")
def u5_role_violations(spark, d):
    a = lambda *x: F.array(*[F.lit(y) for y in x])
    cov = V.table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, a("read", "call")).otherwise(a("read")).alias("observed"), F.when(F.col("p_size") % 5 == 0, a("read", "alias")).otherwise(a("read")).alias("supported"), a("read", "write", "call").alias("applicable"))
    return S.role_violations(cov).select("p_partkey")


@query("with " + V.REVISIONS + " select distinct hash from revs where revision = 1995 and hash in (select hash from revs where revision = 1996)")
def u6_shared_versions(spark, d):
    r = V.revisions(spark, d)
    return r.filter("revision = 1995").select("hash").intersect(r.filter("revision = 1996").select("hash"))


@query("select k, min(v) as v from (select c_nationkey as k, 'x' as v from customer union all select s_nationkey, 'x' from supplier) group by 1")
def u1_union_evidence(spark, d):
    a = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("x").alias("v"))
    b = V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("x").alias("v"))
    return S.union_evidence(a, b, key=["k"])


@query("with " + _DIFF + ", n as (select count(*) filter (change in ('added', 'removed')) as inv, count(*) filter (change = 'languageChanged') as lang, count(*) filter (change = 'changed') as changed, max(path) filter (change = 'changed') as last from diff) select case when inv > 0 then 'full' when lang > 0 then 'full' when changed = 0 then 'unchanged' when changed > 1 then 'full' else 'documentLocal' end as class, case when inv > 0 then 'inventory' when lang > 0 then 'language' when changed > 1 then 'severalChanged' end as reason, inv, changed, case when changed = 1 then last end as document from n")
def c1_change_class(spark, d):
    from siftworks.operators.changes import classify_change

    return classify_change(_diff(spark, d))
