"""Queries of counts, gates, budgets, windows, paging and quality rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftworks.functions import text as T
from siftworks.operators import changes as C
from siftworks.operators import stats as S
from siftworks.operators.segments import segment_lines, segment_words
from siftworks.plans import views as V
from siftworks.plans.q_relate import _COV, _coverage, _diff
from siftworks.plans.registry import query


@query("with " + V.WORDS + " select source_set_id, (select count(*) from docs d where d.source_set_id = s.source_set_id) as files, (select count(*) from ln where ln.source_set_id = s.source_set_id) as symbols, (select count(*) from wd where wd.source_set_id = s.source_set_id) as calls from (select distinct source_set_id from docs) s")
def a1_index_stats(spark, d):
    return S.counts_by("source_set_id", files=V.documents(spark, d), symbols=V.lines(spark, d), calls=V.words(spark, d))


@query("with " + V.REVISIONS + ", " + _COV + ", c as (select cov.*, r.language from cov join revs r using (path, revision)) select l as language, count(c.state) as selected, count(*) filter (state = 'complete') as complete, count(*) filter (state = 'partial') as partial, count(*) filter (state = 'failed') as failed, 0::bigint as unselected from unnest(['java', 'javascript', 'python', 'rust']) t(l) left join c on c.language = l group by 1")
def a2_language_status(spark, d):
    return S.language_status(_coverage(spark, d).withColumn("selected", F.lit(True)))


@query("with " + V.BINDINGS + " select producer, count(*) filter (resolution = 'internal') as internal, count(*) filter (resolution = 'external') as external, count(*) filter (resolution = 'unresolved') as unresolved, count(*) filter (resolution = 'ambiguous') as ambiguous from bind group by 1")
def a3_resolution_counts(spark, d):
    names = ("internal", "external", "unresolved", "ambiguous")
    return V.bindings(spark, d).groupBy("producer").agg(*[F.count_if(F.col("resolution") == n).alias(n) for n in names])


@query("with " + V.WORDS + " select source_set_id, count(distinct word) as distinct_references, count(*) as calls, count(distinct path) as documents from wd group by grouping sets ((source_set_id), ())")
def a4_corpus_counts(spark, d):
    V.words(spark, d).createOrReplaceTempView("corpus_words")
    return spark.sql("select source_set_id, count(distinct word) as distinct_references, count(*) as calls, count(distinct path) as documents from corpus_words group by grouping sets ((source_set_id), ())")


@query("select lang as language, metric, value, floor from (select lang, count(*) as docs, sum(n_chars)::bigint as chars from documents group by 1) c, lateral (select 'docs' as metric, docs as value, 4000::bigint as floor union all select 'chars', chars, 1000000) where value < floor")
def a5_corpus_floors(spark, d):
    c = V.table(spark, d, "documents").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    return S.floor_violations(c, {"docs": 4000, "chars": 1000000}, "language")


@query("with " + V.LINES + " select language, count(*) as facts from (select language from ln union all select language from docs) group by 1")
def a6_facts_by_language(spark, d):
    return V.lines(spark, d).select("language").union(V.documents(spark, d).select("language")).groupBy("language").agg(F.count("*").alias("facts"))


@query("with " + V.LINES + " select docs.path, count(ln.name) as methods from docs left join ln using (path) group by 1")
def a7_methods_per_file(spark, d):
    n = V.lines(spark, d).filter("name is not null").groupBy("path").agg(F.count("*").alias("methods"))
    return V.documents(spark, d).select("path").join(n, "path", "left").fillna(0)


@query("with " + V.BINDINGS + " select count(*) as n from (select distinct call_id, producer, target, resolution from bind)")
def a11_distinct_facts(spark, d):
    return V.bindings(spark, d).select("call_id", "producer", "target", "resolution").distinct().agg(F.count("*").alias("n"))


@query("with " + V.BINDINGS + " select call_id, array_to_string(list_sort(list_distinct(list(target))), ',') as candidates from bind group by 1 having count(distinct target) >= 2")
def a13_candidates(spark, d):
    b = V.bindings(spark, d).groupBy("call_id").agg(F.array_sort(F.collect_set("target")).alias("c")).filter("size(c) >= 2")
    return b.select("call_id", F.array_join("c", ",").alias("candidates"))


@query("""with o as (select lang, count(*) as n, count(*) filter ((quality = 1) = (n_chars >= 500)) as correct from documents join labels using (doc_id) group by 1),
w as (select lang, n, correct, greatest((correct / n + 3.841458820694124 / (2 * n) - 1.959963984540054 * sqrt((correct / n * (1 - correct / n) + 3.841458820694124 / (4 * n)) / n)) / (1 + 3.841458820694124 / n), 0.0) as lower from o)
select lang, n, correct, round(lower, 6) as lower, case when n < 30 then 'notMeasured' when lower >= 0.6 then 'passed' else 'failed' end as status from w""")
def a14_qualification(spark, d):
    o = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id")
    q = S.qualification(o, ["lang"], (F.col("quality") == 1) == (F.col("n_chars") >= 500), 0.6, 30)
    return q.withColumn("lower", F.round("lower", 6))


@query("select event_type, count(value) as n, quantile_disc(value, 0.5) as median, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99 from events group by 1")
def a15_latency_summary(spark, d):
    return S.latency_summary(V.table(spark, d, "events"), ["event_type"])


@query("""with s as (select event_type, user_id % 2 as half, avg(value) as value from events where value is not null group by 1, 2), j as (select c.event_type, ['query', 'rss', 'throughput'][(ascii(c.event_type) % 3 + 1)::int] as kind, (c.value - b.value) / b.value as change from s c join s b using (event_type) where c.half = 1 and b.half = 0)
select event_type, kind, round(change, 6) as change, case kind when 'throughput' then change < -0.1 when 'rss' then change > 0.1 else change > 0.15 end as regressed from j""")
def a16_regressions(spark, d):
    e = V.table(spark, d, "events").filter("value is not null").withColumn("kind", F.element_at(F.array(F.lit("query"), F.lit("rss"), F.lit("throughput")), (F.ascii("event_type") % 3 + 1).cast("int")))
    half = lambda k: e.filter(F.col("user_id") % 2 == k).groupBy("event_type", "kind").agg(F.avg("value").alias("value"))
    return S.regressions(half(1), half(0), ["event_type"]).withColumn("change", F.round("change", 6))


@query("select quality as label_a, (n_chars >= 500)::int as label_b, count(*) as n from documents join labels using (doc_id) group by 1, 2")
def a21_agreement(spark, d):
    lab = V.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    rule = V.table(spark, d, "documents").select("doc_id", (F.col("n_chars") >= 500).cast("int").alias("label"))
    return S.agreement(lab, rule, "doc_id", "label")


@query("select user_id, event_type, first from (select *, row_number() over (partition by user_id order by first, event_type) as r from (select user_id, event_type, min(event_id) as first from events group by 1, 2)) where r <= 3")
def a22_capped_warnings(spark, d):
    e = V.table(spark, d, "events").withColumn("first", F.col("event_id"))
    return S.cap_warnings(e, ["user_id"], "first", "event_type", 3)


@query("select o_orderkey, case when t is null or t <= 0 or 900000000 - t < 0 then 'unknown' when 900000000 - t >= 2592000 then 'eligible' else 'recent' end as age_class from (select o_orderkey, case when o_orderkey % 9 = 0 then -1 else epoch(o_orderdate)::bigint end as t from orders)")
def a23_age_classes(spark, d):
    t = F.when(F.col("o_orderkey") % 9 == 0, -1).otherwise(F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    return S.classify_age(V.table(spark, d, "orders").select("o_orderkey", t.alias("t")), F.lit(900000000), "t").select("o_orderkey", "age_class")


@query("with " + V.WORDS + ", p as (select path, count(*) as words, count(distinct word) as shapes, max(line_no) as last_line from wd group by 1) select path, words, shapes, round(100 * (1 - shapes / words), 6) as repeated_percent from p")
def a24_composition(spark, d):
    p = V.words(spark, d).groupBy("path").agg(F.count("*").alias("words"), F.countDistinct("word").alias("shapes"))
    return p.withColumn("repeated_percent", F.round(100 * (1 - F.col("shapes") / F.col("words")), 6))


@query("with " + _diff.__globals__["_DIFF"] + " select path from diff where change = 'changed'")
def a17_changed_files(spark, d):
    return C.changed_files(_diff(spark, d))


@query("select source, count(*) filter (quality = 1) as supporting, count(*) filter (toxic = 1) as uncertain, count(*) filter (quality is null) as omitted from documents left join labels using (doc_id) group by 1")
def a20_selection_summary(spark, d):
    j = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("supporting"), F.count_if(F.col("toxic") == 1).alias("uncertain"), F.count_if(F.col("quality").isNull()).alias("omitted"))


@query("with " + V.DOCS + ", r as (select source_set_id, path, sum(strlen(text)) over (partition by source_set_id order by path) as b, row_number() over (partition by source_set_id order by path) as k from docs) select path, b <= 20000 and k <= 8 as admitted from r")
def w3_admit_by_budget(spark, d):
    f = V.documents(spark, d).select("source_set_id", "path", F.octet_length("text").cast("long").alias("source_bytes"), F.lit(1).cast("long").alias("registry_bytes"))
    return S.admit_by_budget(f, ["source_set_id"], "path", source_bytes=20000, registry_bytes=8).select("path", "admitted")


@query("with " + V.LINES + ', r as (select path, line_no, row_number() over (partition by source_set_id order by path, line_no) as k, sum(strlen(line)) over (partition by source_set_id order by path, line_no) as t from ln) select path, line_no, k <= 60 and t <= 15000 as kept from r')
def w4_admit_details(spark, d):
    items = V.lines(spark, d).select("source_set_id", "path", "line_no", F.lit(1).alias("records"), F.octet_length("line").alias("text"))
    return S.admit_details(items, ["source_set_id"], ["path", "line_no"], 60, 15000).select("path", "line_no", "kept")


@query("select p_partkey, row_number() over (order by case when p_name = 'x' then 0 when starts_with(p_name, 'P') then 1 else 2 end, p_name nulls first, p_partkey) as rank from part where contains(lower(p_name), 'a')")
def w5_search_rank(spark, d):
    p = V.table(spark, d, "part").filter(T.literal_contains(F.col("p_name"), F.lit("a")))
    rank = F.when(F.col("p_name") == "x", 0).when(F.col("p_name").startswith("P"), 1).otherwise(2)
    return S.numbered(p.withColumn("match", rank), [], ["match", F.col("p_name").asc_nulls_first(), "p_partkey"], "rank").select("p_partkey", "rank")


@query("""with j as (select p_brand, p_partkey, '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}' as t from part), r as (select *, sum(strlen(t)) over (partition by p_brand order by p_partkey) as s from j) select p_brand, p_partkey from r where s <= 200""")
def w6_fit_bytes(spark, d):
    return S.fit_bytes(V.table(spark, d, "part"), ["p_brand"], ["p_partkey"], 200, "p_partkey", "p_name").select("p_brand", "p_partkey")


_PUB = "pub as (select o_custkey, o_orderkey as revision, epoch(o_orderdate)::bigint as published_at from orders)"


def _published(spark, d):
    return V.table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("revision"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("published_at"))


@query("with " + _PUB + " select o_custkey, revision, lead(published_at) over (partition by o_custkey order by revision) as superseded_at from pub")
def w7_supersession(spark, d):
    return S.supersession(_published(spark, d), ["o_custkey"], "revision", "published_at").select("o_custkey", "revision", "superseded_at")


@query("with " + _PUB + ", s as (select *, lead(published_at) over (partition by o_custkey order by revision) as sup from pub) select o_custkey, revision from s where sup + 900 <= 820000000")
def c9_expired(spark, d):
    return C.expired(_published(spark, d), F.lit(820000000), ["o_custkey"]).select("o_custkey", "revision")


@query("with " + V.BINDINGS + " select producer, target, min(provenance_id) as provenance_id from bind group by 1, 2")
def w8_representative_edges(spark, d):
    return S.first_by(V.bindings(spark, d), ["producer", "target"], ["provenance_id"]).select("producer", "target", "provenance_id")


@query("select p_partkey, row_number() over (partition by p_brand order by p_size <> 7, p_retailprice desc, p_partkey) as rank from part")
def w11_selection_rank(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy(F.col("p_size") != 7, F.col("p_retailprice").desc(), "p_partkey")
    return V.table(spark, d, "part").select("p_partkey", F.row_number().over(w).cast("long").alias("rank"))


@query("select p_partkey, 'c' || case when r < 1000 then lpad(r::varchar, 3, '0') else r::varchar end as alias from (select p_partkey, row_number() over (partition by p_brand order by p_size, p_partkey) as r from part)")
def w12_aliases(spark, d):
    return S.aliases(V.table(spark, d, "part"), ["p_brand"], ["p_size", "p_partkey"]).select("p_partkey", "alias")


@query("with " + V.WORDS + " select path, word, start from (select *, row_number() over (partition by path order by start, \"end\") as r from wd) where r <= 3")
def t1_source_order(spark, d):
    return S.first_by(V.words(spark, d), ["path"], ["start", "end"], 3).select("path", "word", "start")


@query("with r as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) as r, count(*) over (partition by p_brand) as n from part) select p_brand, p_partkey, case when n > 6 then 6::bigint end as next_offset from r where r > 2 and r <= 6")
def t2_page(spark, d):
    return S.page(V.table(spark, d, "part"), ["p_brand"], ["p_partkey"], 2, 4).select("p_brand", "p_partkey", "next_offset")


@query("with r as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) as r, count(*) over (partition by p_brand) as n from part) select p_brand, p_partkey, n > 7 as truncated from r where r <= 7")
def t3_limited(spark, d):
    return S.limited(V.table(spark, d, "part"), ["p_brand"], ["p_partkey"], 7).select("p_brand", "p_partkey", "truncated")


@query("with k as (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as r from part) select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) as place from k where r <= 5")
def t4_top_then_order(spark, d):
    from pyspark.sql import Window

    top = S.first_by(V.table(spark, d, "part"), ["p_brand"], [F.col("p_retailprice").desc(), "p_partkey"], 5)
    return top.select("p_brand", "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("long").alias("place"))


@query("with " + V.DOCS + " select case when len(s) > 1 then 'directory' else 'file' end as kind, s[1] as name, count(*) as files from (select string_split(path[6:], '/') as s from docs where starts_with(path, 'src0/')) group by 1, 2")
def t5_list_dir(spark, d):
    return S.list_dir(V.documents(spark, d), "src0/")


@query("with d as (select distinct o_custkey, l_partkey from orders join lineitem on l_orderkey = o_orderkey), r as (select *, row_number() over (partition by o_custkey order by l_partkey) as k from d) select o_custkey, l_partkey from r where k <= 4")
def t6_bounded_targets(spark, d):
    t = V.table(spark, d, "orders").join(V.table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct()
    return S.first_by(t, ["o_custkey"], ["l_partkey"], 4).select("o_custkey", "l_partkey")


@query("select doc_id, case when n_chars < 100 then 'notRequested' when lang is null then 'omitted' when lang = 'es' then 'unsupported' when doc_id % 11 = 0 then 'failed' when doc_id % 3 = 0 then 'partial' else 'complete' end as state from documents")
def c6_coverage_state(spark, d):
    c = F.col
    return V.table(spark, d, "documents").select("doc_id", S.coverage_state(c("n_chars") >= 100, c("lang").isNotNull(), c("lang") != "es", c("doc_id") % 11 == 0, F.when(c("doc_id") % 3 == 0, 1).otherwise(0)).alias("state"))


@query("select 'text' as rule, doc_id::varchar as id from documents where text is null or n_chars < 60 union all select 'label', doc_id::varchar from labels where quality = 0 and toxic = 0")
def c4_violations(spark, d):
    doc, lab = V.table(spark, d, "documents"), V.table(spark, d, "labels")
    return S.violations({"text": doc.filter("text is null or n_chars < 60").select(F.col("doc_id").alias("id")), "label": lab.filter("quality = 0 and toxic = 0").select(F.col("doc_id").alias("id"))})


@query("select doc_id, source, lang from documents d where not exists (select 1 from documents e where e.source = d.source and e.lang = d.lang and e.n_chars < 150)")
def c5_reject_artifacts(spark, d):
    doc = V.table(spark, d, "documents")
    return S.reject_artifacts(doc.select("doc_id", "source", "lang"), doc.filter("n_chars < 150"), ["source", "lang"])


@query("with " + V.BINDINGS + " select call_id, n, bad from (select call_id, count(distinct target) as n, bool_or(resolution = 'internal' and dispatch = 'virtual') as bad from bind group by 1) where bad or n > 2")
def c7_binding_rules(spark, d):
    b = V.bindings(spark, d).groupBy("call_id").agg(F.countDistinct("target").alias("n"), F.bool_or((F.col("resolution") == "internal") & (F.col("dispatch") == "virtual")).alias("bad"))
    return b.filter("bad or n > 2")


@query("select (select count(*) from (select l_orderkey, l_partkey from lineitem except all select l_orderkey, l_partkey from lineitem where l_linenumber <> 2)) as only_a, 0::bigint as only_b")
def c10_projection_parity(spark, d):
    l = V.table(spark, d, "lineitem")  # noqa: E741
    return S.projection_parity(l.select("l_orderkey", "l_partkey"), l.filter("l_linenumber <> 2").select("l_orderkey", "l_partkey"))


@query("with r as (select o_custkey as k, list_sort(list(o_orderstatus)) as s, year(o_orderdate) as y from orders group by 1, 3), a as (select * from r where y = 1995), b as (select * from r where y = 1996) select coalesce(a.k, b.k) as o_custkey, coalesce(a.s = b.s, false) as equal from a full join b on a.k = b.k")
def c2_surface_equal(spark, d):
    o = V.table(spark, d, "orders")
    y = lambda n: o.filter(F.year("o_orderdate") == n)
    return C.surface_equal(y(1995), y(1996), "o_custkey", ["o_orderstatus"])


@query("select p_partkey as path, p_partkey % 5 = 0 or p_partkey % 7 = 0 as reread from part")
def c3_stat_drift(spark, d):
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("size"), F.lit(1).alias("mtime"), F.lit(2).alias("inode"))
    new = p.withColumn("size", F.when(F.col("path") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return C.stat_drift(p.filter("path % 7 <> 0"), new)


@query("select event_id, sum(event_id % 10) over (order by event_id)::bigint as running from events")
def w3_running_giant(spark, d):
    e = V.table(spark, d, "events").select("event_id", (F.col("event_id") % 10).alias("v"))
    return S.running_giant(e, "event_id", "v", 8).select("event_id", "running")


@query("with o as (select o_custkey, count(*) as n, count(*) filter (o_orderstatus = 'F') as k from orders group by 1) select o_custkey, round(greatest((k / n + 3.841458820694124 / (2 * n) - 1.959963984540054 * sqrt((k / n * (1 - k / n) + 3.841458820694124 / (4 * n)) / n)) / (1 + 3.841458820694124 / n), 0.0), 6) as lower from o")
def f14_wilson(spark, d):
    o = V.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    return o.select("o_custkey", F.round(T.wilson_lower(F.col("k"), F.col("n")), 6).alias("lower"))


_NEW_LINES = """case when doc_id % 6 = 3 then old_lines || ['extra line of words'] else [case when doc_id % 6 = 1 and i = 2 then l || ' grown body é' when doc_id % 6 = 2 and i = 2 then 'x' || l when doc_id % 6 = 4 and i in (1, 2) then l || ' more' when doc_id % 6 = 5 and i = 3 then '' else l end for l, i in old_lines] end"""


@query("with " + V.DOCS + f""", l as (select path, doc_id, string_split(text, chr(10)) as old_lines from docs), e as (select path, old_lines, {_NEW_LINES} as new_lines from l),
d as (select path, len(old_lines) = len(new_lines) as same_length, [i for i in range(1, len(old_lines) + 1) if old_lines[i] <> new_lines[i]] as diff, old_lines, new_lines from e where array_to_string(old_lines, chr(10)) <> array_to_string(new_lines, chr(10)))
select path, same_length and len(diff) = 1 and nullif(string_split(old_lines[diff[1]], ' ')[1], '') is not null and string_split(old_lines[diff[1]], ' ')[1] = string_split(new_lines[diff[1]], ' ')[1] as proved,
case when same_length and len(diff) = 1 and nullif(string_split(old_lines[diff[1]], ' ')[1], '') is not null and string_split(old_lines[diff[1]], ' ')[1] = string_split(new_lines[diff[1]], ' ')[1] then strlen(new_lines[diff[1]]) - strlen(old_lines[diff[1]]) end::bigint as growth from d""")
def c2_body_only(spark, d):
    """Each document and an edited one: a line is a declaration of its first word, the rest of it its body."""
    docs = V.documents(spark, d)

    def edited(l, i):  # noqa: E741
        k = F.col("doc_id") % 6
        return F.when((k == 1) & (i == 1), F.concat(l, F.lit(" grown body é"))).when((k == 2) & (i == 1), F.concat(F.lit("x"), l)).when((k == 4) & (i < 2), F.concat(l, F.lit(" more"))).when((k == 5) & (i == 2), "").otherwise(l)

    lines = F.split("text", "\n")
    new = docs.withColumn("text", F.array_join(F.when(F.col("doc_id") % 6 == 3, F.concat(lines, F.array(F.lit("extra line of words")))).otherwise(F.transform(lines, edited)), "\n"))

    def facts(frame):
        segments = segment_lines(frame)
        named = segments.filter("name is not null").withColumn("n", F.row_number().over(Window.partitionBy("path", "name").orderBy("line_no")))
        decls = named.select("path", F.concat_ws("#", "name", F.col("n").cast("string")).alias("key"), F.lit("function").alias("kind"), F.col("name").alias("header"), "start", "end", (F.col("start") + F.octet_length("name")).alias("body_start"), F.col("end").alias("body_end"))
        words = segment_words(segments).select("path", F.col("word").alias("fact"), "start", "end")
        return frame.select("path", "language", F.encode("text", "UTF-8").alias("bytes")), decls, words

    (d0, n0, f0), (d1, n1, f1) = facts(docs), facts(new)
    return C.body_only(d0, d1, n0, n1, f0, f1).select("path", "proved", F.col("growth").cast("long").alias("growth"))
