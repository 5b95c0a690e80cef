"""Queries of question focus, catalogs, retrieval, sources and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftworks.functions import text as T
from siftworks.operators import focus as Q
from siftworks.operators import retrieval as X
from siftworks.operators import stats as S
from siftworks.plans import views as V
from siftworks.plans.registry import query


@query("with " + V.LINES + """, h as (select source_set_id, path, line_no, name, case when name = 'the' then 0 when starts_with(name, 'the') then 1 else 2 end as k from ln where instr(translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the') > 0),
r as (select *, row_number() over (partition by source_set_id order by k, name, path, line_no) as rank, count(*) over (partition by source_set_id) as n from h)
select source_set_id, path, line_no, name, rank, n > 50 as truncated from r where rank <= 50""")
def flagship_symbol_search(spark, d):
    """Declarations whose name holds the query literally, best first, at most 50 for each source set, with truncation."""
    hit = V.lines(spark, d).filter(T.literal_contains(F.col("name"), F.lit("the")))
    hit = hit.withColumn("k", F.when(F.col("name") == "the", 0).when(F.col("name").startswith("the"), 1).otherwise(2))
    from pyspark.sql import Window

    out = S.limited(hit, ["source_set_id"], ["k", "name", "path", "line_no"], 50)
    rank = F.row_number().over(Window.partitionBy("source_set_id").orderBy("k", "name", "path", "line_no")).cast("long")
    return out.select("source_set_id", "path", "line_no", "name", rank.alias("rank"), "truncated")


_Q = """qs as (select 'q' || c_custkey as question_id, 'c' || c_custkey as seed, case when c_custkey % 3 = 0 then 'class' else 'function' end as kind, c_mktsegment as question from customer),
cl as (select 'c' || o_custkey as owner_id, o_orderkey::varchar as call_id, 'f' || (o_orderkey % 50) as path from orders), src as (select distinct 'f' || (o_orderkey % 50) as path, repeat('x', (o_orderkey % 50)::int) as text from orders)"""


@query("with " + _Q + """, own as (select question_id, call_id, path from qs join cl on owner_id = seed where kind = 'function'), n as (select question_id, count(*) as n_calls, sha256(string_agg(call_id, ',' order by call_id)) as h from own group by 1),
b as (select question_id, sum(strlen(text)) as b from (select distinct question_id, path from own) join src using (path) group by 1)
select question_id, seed, kind = 'function' as callable, coalesce(n_calls, 0) as n_calls, coalesce(b, 0)::bigint as source_bytes, sha256(question_id || '|' || seed || '|' || question || '|' || coalesce(h, '')) as packet_id, coalesce(b, 0) <= 200 as fits from qs left join n using (question_id) left join b using (question_id)""")
def q1_packets(spark, d):
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    qs = V.table(spark, d, "customer").select(s("q", "c_custkey").alias("question_id"), s("c", "c_custkey").alias("seed"), F.when(F.col("c_custkey") % 3 == 0, "class").otherwise("function").alias("kind"), F.col("c_mktsegment").alias("question"))
    o = V.table(spark, d, "orders").withColumn("path", F.concat(F.lit("f"), (F.col("o_orderkey") % 50).cast("string")))
    calls = o.select(s("c", "o_custkey").alias("owner_id"), F.col("o_orderkey").cast("string").alias("call_id"), "path")
    src = o.select("path", F.repeat(F.lit("x"), (F.col("o_orderkey") % 50).cast("int")).alias("text")).distinct()
    return Q.packets(qs, calls, src, 200)


def _candidates(spark, d):
    l = V.table(spark, d, "lineitem").join(V.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))  # noqa: E741
    cid = F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    base = l.select(F.col("l_orderkey").alias("packet_id"), cid.alias("call_id"), F.col("p_name").alias("callee"), (F.col("l_linenumber") <= 2).alias("direct"), (F.col("l_orderkey") % 2 == 0).alias("deeper"), F.lit("where does an item go").alias("question"), F.array(F.lit(" AN")).alias("terms"), F.lit("p").alias("path"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 5).alias("end"), (F.col("l_discount") * 10).alias("display_score"), F.lit(2).alias("max_visible"))
    return Q.preview(base.dropDuplicates(["packet_id", "call_id"]))


_CAND = """cand as (select distinct on (call_id) *, case when not contains(lower(callee), 'an') then 'uncertain' when direct or deeper then 'essential' else 'supporting' end as relevance from (
  select l_orderkey as packet_id, concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) as call_id, p_name as callee, l_linenumber <= 2 as direct, l_orderkey % 2 = 0 as deeper, l_partkey as start, l_partkey + 5 as "end", l_discount * 10 as display_score from lineitem join part on p_partkey = l_partkey))"""


@query("with " + _CAND + " select packet_id, call_id, relevance from cand")
def q2_preview(spark, d):
    return _candidates(spark, d).select("packet_id", "call_id", "relevance")


@query("with c as (select doc_id from documents), dd as (select case when toxic = 1 then -1 - doc_id else doc_id end as doc_id, (quality + case when doc_id % 50 = 1 then 1 else 0 end)::double as s from labels), g as (select doc_id, count(*) as n from dd group by 1) select coalesce(c.doc_id, g.doc_id) as doc_id, case when c.doc_id is null then 'unknown' when n is null then 'missing' else 'duplicate' end as problem from c full join g on c.doc_id = g.doc_id where c.doc_id is null or n is null or n > 1 union all select distinct doc_id, 'score' from dd where s > 1")
def q3_decision_problems(spark, d):
    dec = V.table(spark, d, "labels").select(F.when(F.col("toxic") == 1, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), (F.col("quality") + F.when(F.col("doc_id") % 50 == 1, 1).otherwise(0)).cast("double").alias("display_score"))
    return Q.decision_problems(V.table(spark, d, "documents"), dec, ["doc_id"])


_VIEW = _CAND + """, e as (select *, row_number() over (partition by packet_id order by not direct, display_score desc, start, "end" desc, call_id) as r from cand where relevance = 'essential' and (direct or deeper)), vis as (select *, row_number() over (partition by packet_id order by start, "end" desc, call_id) as place from e where r <= 2)"""


@query("with " + _VIEW + " select packet_id, call_id, place from vis")
def q4_focused_view(spark, d):
    c = _candidates(spark, d).withColumn("display_score", F.lit(0.5))
    return Q.focused_view(_candidates(spark, d)).select("packet_id", "call_id", "place")


@query("with " + _VIEW + ", n as (select packet_id, count(*) as n, count(*) filter (relevance = 'supporting') as supporting, count(*) filter (relevance = 'uncertain') as uncertain, count(*) filter (relevance = 'essential') as e from cand group by 1), v as (select packet_id, count(*) as v from vis group by 1) select packet_id, supporting, uncertain, n - coalesce(v, 0) as omitted, e - coalesce(v, 0) as policy_hidden from n left join v using (packet_id)")
def q4_focus_counts(spark, d):
    c = _candidates(spark, d)
    return Q.focus_counts(c, Q.focused_view(c))


@query("select p_partkey as packet_id, 'c001' as candidate_id, case when p_size % 4 = 0 then 'labels' when p_size % 4 = 1 then 'invalid' else 'exact' end as status, case when p_size % 4 >= 2 then 0.25 end as display_score from part where p_size % 7 <> 0")
def q5_parse_scores(spark, d):
    ok = '{"c001":{"essential":0.25,"supporting":0.25,"incidental":0.25,"uncertain":0.25}}'
    r = F.when(F.col("p_size") % 7 == 0, "no json").when(F.col("p_size") % 4 == 0, '{"c001":{"essential":1.0}}').when(F.col("p_size") % 4 == 1, ok.replace("0.25,", "0.35,", 1)).otherwise(ok)
    return Q.parse_scores(V.table(spark, d, "part").select(F.col("p_partkey").alias("packet_id"), r.alias("response")))


@query("""with c as (select l_orderkey as answer_id, l_linenumber as claim_id, l_suppkey as branch_id, l_quantity as len, l_linenumber <> 3 as valid from lineitem), p as (select answer_id, count(distinct claim_id) as c, count(distinct branch_id) as b from c group by 1), k as (select answer_id, claim_id, count(*) as n, max(len) as m, bool_or(not valid) as bad from c group by 1, 2)
select distinct * from (select answer_id, 'claims' as problem from p where c not between 1 and 4 union all select answer_id, 'branches' from p where b > 6 union all select answer_id, 'citations' from k where n > 4 union all select answer_id, 'lines' from k where m > 12 union all select answer_id, 'quote' from k where bad)""")
def q6_answer_problems(spark, d):
    l = V.table(spark, d, "lineitem")  # noqa: E741
    return Q.answer_problems(l.select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("claim_id"), F.col("l_suppkey").alias("branch_id"), F.lit(1).alias("first"), F.col("l_quantity").alias("last"), (F.col("l_linenumber") != 3).alias("valid")))


_BASE = """base as (select p_partkey, case when p_partkey % 10 = 0 or p_size % 5 = 1 then 'essential' when p_size % 5 = 2 or p_size % 5 = 0 then 'supporting' when p_partkey % 3 = 0 then 'uncertain' else 'incidental' end as relevance from part)"""


def _base(spark, d):
    p = V.table(spark, d, "part")
    return Q.baseline(p.select("p_partkey", F.lit("Where is the parser used?").alias("question"), F.when(F.col("p_partkey") % 3 == 0, "myParserState").otherwise("other_thing").alias("name"), F.when((F.col("p_size") % 5).isin(0, 1, 2), F.col("p_size") % 5).alias("distance"), (F.col("p_partkey") % 10 == 0).alias("is_seed")))


@query("with " + _BASE + " select * from base")
def q7_baseline(spark, d):
    return _base(spark, d).select("p_partkey", "relevance")


@query("with " + _BASE + " select p_partkey, case when p_partkey % 10 = 0 or relevance = 'essential' then 'visible' when relevance in ('supporting', 'uncertain') then 'collapsed' else 'hidden' end as shown from base")
def q8_assemble_view(spark, d):
    return Q.assemble_view(_base(spark, d)).select("p_partkey", "shown")


@query("with " + V.LINES + """, f as (select source_set_id, path, sum(strlen(text)) over (partition by source_set_id order by path) as b, row_number() over (partition by source_set_id order by path) as k from docs), live as (select ln.* from ln join f using (source_set_id, path) where b <= 20000 and k <= 8),
r as (select path, line_no, row_number() over (partition by source_set_id order by path, line_no) as n, sum(strlen(line)) over (partition by source_set_id order by path, line_no) as t from live) select path, line_no, n <= 40 and t <= 9000 as kept from r""")
def k1_compose_catalog(spark, d):
    f = V.documents(spark, d).select("source_set_id", "path", F.octet_length("text").cast("long").alias("source_bytes"), F.lit(1).cast("long").alias("registry_bytes"))
    items = V.lines(spark, d).select("source_set_id", "path", F.col("line_no").alias("item_no"), F.lit(1).alias("records"), F.octet_length("line").alias("text"))
    _, kept = Q.compose_catalog(f, items, ["source_set_id"], 20000, 8, 40, 9000)
    return kept.select("path", F.col("item_no").alias("line_no"), "kept")


_CATALOG = "with " + V.WORDS + """, f as (select source_set_id, path, doc_id, sum(strlen(text)) over (partition by source_set_id order by path) as b, sum(strlen(path)) over (partition by source_set_id order by path) as g, count(*) over (partition by source_set_id) as n from docs), big as (select distinct source_set_id from f where n > 1000000),
u as (select *, case when b > 60000 then 'sourceLimit' when g > 330 then 'registryTextLimit' end as why from f where source_set_id not in (select source_set_id from big)), cl as (select ln.source_set_id, ln.path, line_no, row_number() over (partition by ln.source_set_id order by ln.path, line_no) as n from ln join u on u.path = ln.path and why is null where name is not null),
it as (select wd.source_set_id, wd.path, wd.line_no, word_no, word, word_no % 4 as kind, count(*) over w as r, sum(strlen(word)) over w as t from wd join cl on cl.path = wd.path and cl.line_no = wd.line_no and cl.n <= 60 window w as (partition by wd.source_set_id order by wd.path, wd.line_no, word_no)),
ju as (select *, case when r > 1200 then 'detailRecordLimit' when t > 6000 then 'detailTextLimit' end as why from it), ends as (select source_set_id, min(path) as last from cl where n > 60 group by 1)"""
_LIMITS = Q.CatalogLimits(files=1_000_000, source_bytes=60_000, registry_text=330, classes=60, records=1200, text=6000)


def _catalog(spark, d):
    """Documents as files, their named lines as classes and the words of these as details."""
    docs, lines, words = V.documents(spark, d), V.lines(spark, d), V.words(spark, d)
    long = lambda c: c.cast("long")
    files = docs.select("source_set_id", "path", long(F.octet_length("text")).alias("source_bytes"), long(F.octet_length("path")).alias("registry_bytes"), F.lit(1).alias("symbols"), (F.col("doc_id") % 9 == 0).alias("warned"), (F.col("doc_id") % 11 == 0).alias("incomplete"))
    classes = lines.filter("name is not null").select("source_set_id", "path", F.col("line_no").alias("class_no"), F.concat_ws("#", "path", F.col("line_no").cast("string")).alias("class_id"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("scope", "field", "method", "relation")]), (F.col("word_no") % 4 + 1).cast("int"))
    items = words.select("source_set_id", "path", F.col("line_no").alias("class_no"), F.col("word_no").alias("item_no"), kind.alias("kind"), F.col("word").alias("item_id"), F.lit(1).cast("long").alias("records"), long(F.octet_length("word")).alias("text"))
    return Q.build_catalog(files, classes, items, ["source_set_id"], _LIMITS)


@query(_CATALOG + """ select source_set_id, 'class' as what, path || '#' || line_no as id, exists (select 1 from ju where ju.path = cl.path and ju.line_no = cl.line_no and why is not null) as truncated from cl where n <= 60
union all select source_set_id, case kind when 1 then 'field' else 'method' end, path || '#' || line_no || '#' || word_no, false from ju where why is null and kind in (1, 2) union all select source_set_id, 'relation', word || '@' || min(path), false from ju where why is null and kind = 3 group by source_set_id, word""")
def k1_catalog(spark, d):
    """Classes, details and relations of each source set's catalog."""
    c, items, relations, _ = _catalog(spark, d)
    no = F.lit(False).alias("truncated")
    one = c.select("source_set_id", F.lit("class").alias("what"), F.col("class_id").alias("id"), "truncated")
    one = one.unionByName(items.select("source_set_id", F.col("kind").alias("what"), F.concat_ws("#", "path", F.col("class_no").cast("string"), F.col("item_no").cast("string")).alias("id"), no))
    return one.unionByName(relations.select("source_set_id", F.lit("relation").alias("what"), F.concat_ws("@", "item_id", "path").alias("id"), no))


@query(_CATALOG + """, own as (select u.* from u left join ends using (source_set_id) where why is null and (last is null or path <= last)), stop as (select source_set_id, arg_min(why, path) as w from u where why is not null and source_set_id not in (select source_set_id from ends) group by 1)
select source_set_id, 'inputLimit' as warning from big union all select source_set_id, w from stop union all select source_set_id, 'classLimit' from ends union all select source_set_id, arg_min(why, r) from ju where why is not null group by 1 union all select distinct source_set_id, 'extraction' from own where doc_id % 9 = 0
union all select distinct source_set_id, 'declaredTypes' from cl where n <= 60 union all select source_set_id, 'registryIncomplete' from (select source_set_id from stop union select source_set_id from ends union select source_set_id from own where doc_id % 11 = 0)""")
def k1_catalog_warnings(spark, d):
    return _catalog(spark, d)[3]


@query("with " + V.LINES + ", h as (select source_set_id, path || '#' || lpad(line_no::varchar, 6, '0') as class_id, path from ln where instr(translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'er') > 0), r as (select *, row_number() over (partition by source_set_id order by path, class_id) as r, count(*) over (partition by source_set_id) as n from h) select class_id, case when n > 7 then 7::bigint end as next_offset from r where r > 2 and r <= 7")
def k2_classes_page(spark, d):
    c = V.lines(spark, d).select("source_set_id", "path", F.concat_ws("#", "path", F.lpad(F.col("line_no").cast("string"), 6, "0")).alias("class_id"), "name", F.lit(None).cast("string").alias("qualified_name"))
    return Q.classes_page(c, "ER", None, 2, 5).select("class_id", "next_offset")


@query("select distinct concat_ws(':', 'class-ref', l_orderkey, l_linenumber, l_linenumber + 1, 'extends', l_partkey) as relation_id, l_orderkey::varchar as owner_id, 'extends' as kind, l_partkey::varchar as name, 'unmatched' as state from lineitem")
def k3_class_relations(spark, d):
    l = V.table(spark, d, "lineitem")  # noqa: E741
    return Q.class_relations(l.select(F.col("l_orderkey").cast("string").alias("owner_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"), F.lit("extends").alias("kind"), F.col("l_partkey").cast("string").alias("name")))


@query("with r as (select p_partkey as symbol_id, p_brand, row_number() over (partition by p_brand order by p_type, p_partkey) as r, count(*) over (partition by p_brand) as n from part where contains(lower(p_name), 'a') or contains(lower(p_type), 'a')) select symbol_id, 'pkg ' || p_brand as title, case when n > 5 then 5::bigint end as next_offset from r where r <= 5")
def k4_package_symbols(spark, d):
    p = V.table(spark, d, "part")
    packs = p.select(F.col("p_brand").alias("package_id"), F.concat(F.lit("pkg "), "p_brand").alias("title")).distinct()
    sym = p.select(F.col("p_brand").alias("package_id"), F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.col("p_type").alias("qualified_name"))
    return Q.package_symbols_page(packs, sym, "A", 0, 5).select("symbol_id", "title", "next_offset")


@query("select p_partkey as id, 'part ' || p_name || chr(10) || p_type || chr(10) || p_brand as card from part")
def x1_symbol_cards(spark, d):
    p = V.table(spark, d, "part")
    return X.symbol_cards(p.select(F.col("p_partkey").alias("id"), F.lit("part").alias("kind"), F.col("p_name").alias("name"), F.col("p_type").alias("signature"), F.lit(None).cast("string").alias("doc"), F.col("p_brand").alias("path")))


@query("with recursive " + V.LINES + """, b as materialized (select path, line_no, strlen(line) + 1 as n from ln),
g as (select path, line_no, n, 0::bigint as c, ceil(n / 1000)::bigint as k, case when n > 1000 then 1000 else n end as used from b where line_no = 1
  union all select b.path, b.line_no, b.n, g.c + g.k - case when b.n <= 1000 and g.used + b.n <= 1000 then 1 else 0 end, ceil(b.n / 1000)::bigint, case when b.n > 1000 then 1000 when g.used + b.n <= 1000 then g.used + b.n else b.n end from g join b on b.path = g.path and b.line_no = g.line_no + 1),
o as (select path, c as chunk, min(line_no) as first, max(line_no) as last, sum(n)::bigint as n_bytes from g where n <= 1000 group by 1, 2
  union all select path, c + i, line_no, line_no, least(1000, n - i * 1000)::bigint from g, unnest(range(k)) t(i) where n > 1000)
select *, path || '#' || first || '-' || last as header from o""")
def x2_chunks(spark, d):
    return X.chunks(V.lines(spark, d), 1000)


@query("select o_orderkey as id, o_orderkey % 3 <= 1 and not exists (select 1 from lineitem where l_orderkey = o_orderkey) and o_orderkey % 5 <> 0 as trivial from orders")
def x3_trivial(spark, d):
    o, l = V.table(spark, d, "orders"), V.table(spark, d, "lineitem")  # noqa: E741
    return X.trivial(o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("statements")), l.select(F.col("l_orderkey").alias("owner_id")), o.filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("owner_id")))


_TERMS = "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"
_BM = """tf as (select id, term, count(*) as tf from (select doc_id as id, unnest(""" + _TERMS + """) as term from (select doc_id, coalesce(text, '') as text from documents)) group by 1, 2), dl as (select id, sum(tf) as dl from tf group by 1), st as (select count(*) as n, avg(dl) as a from dl), df as (select term, count(*) as df from tf group by 1),
q as (select distinct item_id as query_id, unnest(""" + _TERMS + """) as term from benchmark),
sc as (select query_id, id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / a))), 9) as score from q join df using (term) join tf using (term) join dl using (id), st group by 1, 2),
bm as (select *, row_number() over (partition by query_id order by score desc, id) as rank from sc)"""


def _bm(spark, d, k=5):
    b = V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = V.documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    return X.bm25(b, docs, k)


@query("with " + _BM + " select query_id, rank, id, round(score, 4) as score from bm where rank <= 5")
def x4_bm25(spark, d):
    return _bm(spark, d).select("query_id", "rank", "id", F.round("score", 4).alias("score"))


def _vec(spark, d):
    v = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return v, v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vec")


@query("with v as (select vec_id as id, embedding::double[] as vec from embeddings), s as (select a.id as query_id, b.id, round(list_cosine_similarity(a.vec, b.vec), 9) as score from v a, v b where a.id % 100 = 0), r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) select query_id, rank, id, round(score, 5) as score from r where rank <= 5")
def x5_cosine_topk(spark, d):
    v, q = _vec(spark, d)
    return X.cosine_topk(q, v, 5).select("query_id", "rank", "id", F.round("score", 5).alias("score"))


@query("select p_brand as query_id, p_partkey as id, round(coalesce(0.5 / (a + 60), 0) + coalesce(0.5 / (b + 60), 0), 9) as score from (select p_brand, p_partkey, case when a <= 5 then a end as a, case when b <= 5 then b end as b from (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_size, p_partkey) as a, row_number() over (partition by p_brand order by p_retailprice, p_partkey) as b from part)) where a is not null or b is not null")
def x6_hybrid(spark, d):
    p = V.table(spark, d, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("id"), (-F.col("p_size")).alias("s1"), (-F.col("p_retailprice")).alias("s2"))
    one = lambda c: X.top(p.withColumn("score", F.col(c)), 5)
    return X.hybrid(one("s1"), one("s2"), 100).select("query_id", "id", "score")


_SEARCH = """p as (select *, row_number() over (partition by p_brand order by p_size, p_partkey) as a, row_number() over (partition by p_brand order by p_retailprice, p_partkey) as b from part),
r as (select distinct p_brand as query_id, case when right(p_brand, 1) in ('1', '2') then 'java' end as language, case when right(p_brand, 1) = '3' then 'm1/' end as prefix, right(p_brand, 1) = '4' as kinded, right(p_brand, 1) = '5' as no_tests, 'm' || (length(p_brand) % 4) as module from part),
c as (select p_partkey as id, case p_partkey % 3 when 0 then 'java' when 1 then 'rust' else 'python' end as language, 'm' || (p_partkey % 4) as module, case p_size % 2 when 0 then 'method' else 'type' end as kind, p_size % 5 = 0 as public, p_partkey % 7 = 0 as test from part),
s as (select p_brand as query_id, p_partkey as id, coalesce(case when a <= 40 then 0.5::double / (a + 60) end, 0) + coalesce(case when b <= 40 then 0.5::double / (b + 60) end, 0) as fused from p where a <= 40 or b <= 40)"""


@query("with " + _SEARCH + """, t as (select query_id, id, round(fused * case when c.module = r.module then 1.2::double else 1 end * case when public then 1.1::double else 1 end * case when not test then 1.1::double else 1 end, 9) as score from s join r using (query_id) join c using (id)
where (r.language is null or c.language = r.language) and (prefix is null or starts_with(c.module || '/x', prefix)) and (not kinded or kind = 'method') and not (no_tests and test)), k as (select *, row_number() over (partition by query_id order by score desc, id) as rank from t) select query_id, rank, id, round(score, 7) as score from k where rank <= 10""")
def x6_hybrid_search(spark, d):
    """Brands as requests with different filters, their parts as candidates of four modules."""
    p = V.table(spark, d, "part")
    ranked = p.select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("id"), (-F.col("p_size")).alias("s1"), (-F.col("p_retailprice")).alias("s2"))
    one = lambda c: X.top(ranked.withColumn("score", F.col(c)), 40)
    last = F.right("p_brand", F.lit(1))
    none = F.lit(None).cast("string")
    requests = p.select("p_brand").distinct().select(F.col("p_brand").alias("query_id"), F.when(last.isin("1", "2"), "java").otherwise(none).alias("language"), F.when(last == "3", "m1/").otherwise(none).alias("path_prefix"), F.when(last == "4", F.array(F.lit("method"))).alias("kinds"), F.concat(F.lit("m"), (F.length("p_brand") % 4).cast("string")).alias("module"), (last == "5").alias("no_tests"), F.lit(False).alias("no_generated"))
    module = F.concat(F.lit("m"), (F.col("p_partkey") % 4).cast("string"))
    language = F.element_at(F.array(F.lit("java"), F.lit("rust"), F.lit("python")), (F.col("p_partkey") % 3 + 1).cast("int"))
    candidates = p.select(F.col("p_partkey").alias("id"), language.alias("language"), F.concat(module, F.lit("/x")).alias("path"), F.when(F.col("p_size") % 2 == 0, "method").otherwise("type").alias("kind"), module.alias("module"), (F.col("p_size") % 5 == 0).alias("public"), (F.col("p_partkey") % 7 == 0).alias("test"), F.lit(False).alias("generated"))
    return X.hybrid_search(requests, one("s1"), one("s2"), candidates, 10).select("query_id", "rank", "id", F.round("score", 7).alias("score"))


@query("select 'm' || (doc_id % 2) as model, count(*) as total, count(*) filter (doc_id % 3 = 0) as cached, count(*) filter (doc_id % 3 <> 0) as pending from documents group by 1")
def x7_vector_status(spark, d):
    c = V.table(spark, d, "documents").select(F.concat(F.lit("m"), (F.col("doc_id") % 2).cast("string")).alias("model"), F.col("doc_id").alias("text_hash"))
    return X.vector_status(c, c.filter("text_hash % 3 = 0"))


@query("select p_brand as query_id, count(*) filter (r <= 5) / count(*) as recall from (select p_brand, p_size, row_number() over (partition by p_brand order by p_retailprice, p_partkey) as r from part) where p_size <= 25 group by 1")
def x8_recall(spark, d):
    p = V.table(spark, d, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("id"), (-F.col("p_retailprice")).alias("score"), "p_size")
    return X.recall_at_k(X.top(p, 10**6), p.filter("p_size <= 25"), 5)
