"""Queries of the column functions, segmentation, identities and ordinals."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftworks.functions import text as T
from siftworks.functions.names import lookup_key
from siftworks.operators import identity as I
from siftworks.plans import views as V
from siftworks.plans.registry import query


@query("select path, case p_partkey % 7 when 0 then 'javascript' when 1 then 'rust' when 2 then 'python' when 3 then 'java' when 4 then 'javascript' else null end as language from (select p_partkey, 'lib/' || p_partkey || ['.js', '.rs', '.py', '.java', '.mjs', '.txt', '.JS'][(p_partkey % 7 + 1)::int] as path from part)")
def p1_language_of_path(spark, d):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".js", ".rs", ".py", ".java", ".mjs", ".txt", ".JS")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return V.table(spark, d, "part").select(F.concat(F.lit("lib/"), F.col("p_partkey").cast("string"), ext).alias("path")).select("path", T.language(F.col("path")).alias("language"))


@query("with " + V.DOCS + " select doc_id, path, (case when doc_id % 3 = 0 then '../' || path when doc_id % 3 = 1 then path else replace(path, '.', ':') end) as probe, doc_id % 3 = 1 as valid from docs")
def p3_path_validity(spark, d):
    docs = V.documents(spark, d).withColumn("probe", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("../"), "path")).when(F.col("doc_id") % 3 == 1, F.col("path")).otherwise(F.replace("path", F.lit("."), F.lit(":"))))
    return docs.select("doc_id", "path", "probe", T.valid_path(F.col("probe")).alias("valid"))


@query("with " + V.DOCS + " select doc_id, len(string_split(text, chr(10)))::bigint as line_count from docs")
def p4_line_count(spark, d):
    return V.documents(spark, d).select("doc_id", T.line_count(F.col("text")).alias("line_count"))


@query("with " + V.LINES + " select path || '#' || case when doc_id % 2 = 0 then 'Outer.' else '' end || coalesce(name, 'line@' || start) as display_key from ln")
def p9_display_key(spark, d):
    ln = V.lines(spark, d)
    names = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("Outer"), F.col("name"))).when(F.col("name").isNotNull(), F.array("name")).otherwise(F.array().cast("array<string>"))
    key = F.when((F.col("doc_id") % 2 == 0) & F.col("name").isNull(), T.display_key(F.col("path"), F.array(F.lit("Outer"), F.concat(F.lit("line@"), F.col("start").cast("string"))), F.lit("line"), F.lit(None).cast("long"), F.col("start")))
    return ln.select(key.otherwise(T.display_key(F.col("path"), names, F.lit("line"), F.lit(None).cast("long"), F.col("start"))).alias("display_key"))


@query("with " + V.LINES + " select path, line_no, coalesce(name, case when line_no = 1 then path else '<line@' || start || '>' end) as node_name from ln")
def p10_node_name(spark, d):
    return V.lines(spark, d).select("path", "line_no", T.node_name(F.when(F.col("line_no") == 1, "module").otherwise("line"), F.col("name"), F.col("path"), F.col("start")).alias("node_name"))


@query("with " + V.LINES + " select path, line_no, line[1:140] as label from ln")
def p11_region_label(spark, d):
    return V.lines(spark, d).select("path", "line_no", T.region_label(F.col("line")).alias("label"))


@query("select p_partkey, k as kind, case k when 'function' then 'function' when 'constructor' then 'method' when 'type' then 'class' when 'namespace' then 'module' end as graph_kind from (select p_partkey, ['function', 'constructor', 'type', 'namespace', 'macro'][(p_partkey % 5 + 1)::int] as k from part)")
def p12_graph_kind(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("function", "constructor", "type", "namespace", "macro")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return V.table(spark, d, "part").select("p_partkey", kind.alias("kind")).select("p_partkey", "kind", T.graph_kind(F.col("kind")).alias("graph_kind"))


@query("select p_partkey, ['method', 'type', null, 'variable'][(p_partkey % 4 + 1)::int] as kind, p_partkey % 4 = 2 as call from part")
def p16_node_kinds(spark, d):
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = V.table(spark, d, "part").select("p_partkey", pick("rust", "java", "python", "javascript").alias("l"), pick("function_item", "record_declaration", "call", "variable_declarator").alias("n"))
    return p.select("p_partkey", T.node_kind(F.col("l"), F.col("n"), F.lit(True)).alias("kind"), T.is_call_node(F.col("l"), F.col("n")).alias("call"))


@query("select p_partkey, case p_partkey % 3 when 0 then 'definition,read,write,call,type,import' when 1 then 'definition,read,write,call,type,import,alias' end as roles from part")
def p17_applicable_roles(spark, d):
    lang = F.element_at(F.array(F.lit("java"), F.lit("rust"), F.lit("cobol")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return V.table(spark, d, "part").select("p_partkey", F.array_join(T.applicable_roles(lang), ",").alias("roles"))


@query("select p_partkey, p_size % 3 <> 0 and p_size % 7 <> 0 as callable from part where p_size % 3 <> 0 and p_brand in (select p_brand from part where p_size = 7) and p_size % 7 <> 0")
def p15_callables(spark, d):
    """Functions and methods of classes that have a given member: a kind filter and a semi-join."""
    p = V.table(spark, d, "part").withColumn("kind", F.when(F.col("p_size") % 3 == 0, "class").when(F.col("p_size") % 7 == 0, "variable").otherwise("method"))
    has = p.filter("p_size = 7").select("p_brand").distinct()
    return p.filter(F.col("kind").isin("function", "method")).join(has, "p_brand", "left_semi").select("p_partkey", F.lit(True).alias("callable"))


@query("select p_partkey, sha256(encode('siftworks.header.v1') || '\\x00'::blob || encode('{\"modifiers\":[\"static\",\"' || p_brand || '\"],\"name\":\"' || p_name || '\"}')) as header_hash from part")
def i8_header_hash(spark, d):
    c = T.json_object(name=T.json_string(F.col("p_name")), modifiers=T.json_array(F.array(F.lit("static"), F.col("p_brand")), T.json_string))
    return V.table(spark, d, "part").select("p_partkey", T.domain_digest(I.HEADER_DOMAIN, c).alias("header_hash"))


@query("with " + V.WORDS + """, a as (select path, count(*) as facts, sha256(string_agg(line_no || ':' || name, chr(10) order by line_no || ':' || name)) as w from ln where name is not null group by 1), b as (select path, sha256(string_agg(line_no || ':' || word_no || ':' || word, chr(10) order by line_no || ':' || word_no || ':' || word)) as w from wd group by 1)
select path, a.facts, sha256(a.w || b.w) as fingerprint from a join b using (path)""")
def i10_fingerprint(spark, d):
    a = I.document_witness(V.lines(spark, d).filter("name is not null"), "path", ["line_no", "name"])
    b = I.document_witness(V.words(spark, d), "path", ["line_no", "word_no", "word"]).select("path", F.col("witness").alias("w"))
    return a.join(b, "path").select("path", "facts", F.sha2(F.concat("witness", "w"), 256).alias("fingerprint"))


@query("select p_partkey, p_partkey % 3 = 0 as accessor from part")
def p13_accessor(spark, d):
    mods = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("static"), F.lit("get"))).otherwise(F.array(F.lit("static")))
    return V.table(spark, d, "part").select("p_partkey", T.is_accessor(mods).alias("accessor"))


@query("""with docs as (select doc_id, coalesce(text, '') as text from documents),
n as (select doc_id, text, list_max(list_transform(range(0, 101), lambda k: case when strlen(text[1:k]) <= 100 then k else 0 end)) as k from docs)
select doc_id, case when strlen(text) > 100 then text[1:k] else text end as clipped_text, strlen(text) > 100 as clipped from n""")
def p14_clip_bytes(spark, d):
    one = V.documents(spark, d).select("doc_id", T.clip_bytes(F.col("text"), 100).alias("c"))
    return one.select("doc_id", F.col("c.text").alias("clipped_text"), "c.clipped")


def _spellings(spark, d, languages):
    """Every word of the documents in each language, and spelt with an escape in front or a raw identifier's mark."""
    w = V.words(spark, d).select("word").distinct().crossJoin(spark.createDataFrame([(x,) for x in languages], "language string"))  # a row for each language
    more = F.array("word", F.concat(F.lit("\\u0061"), "word"), F.concat(F.lit("r#"), "word"))
    return w.select("language", F.explode(more).alias("spelling")).withColumn("lookup_key", lookup_key(F.col("language"), F.col("spelling")))


@query("with " + V.WORDS + """, s as (select language, unnest([word, '\\u0061' || word, 'r#' || word]) as spelling from (select distinct word from wd), (values ('rust'), ('java'), ('javascript')) t(language))
select language, spelling, case when language = 'rust' then nfc_normalize(case when starts_with(spelling, 'r#') then substr(spelling, 3) else spelling end) when starts_with(spelling, '\\u0061') then 'a' || substr(spelling, 7) else spelling end as lookup_key from s""")
def f1_lookup_key(spark, d):
    return _spellings(spark, d, ("rust", "java", "javascript"))


@query()
def f1_lookup_key_python(spark, d):
    """NFKC, which SQL lacks; a test holds it against unicodedata."""
    return _spellings(spark, d, ("python",))


@query("with " + V.LINES + " select path, line_no from ln where instr(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the the') > 0")
def f2_literal_search(spark, d):
    return V.lines(spark, d).filter(T.literal_contains(F.col("line"), F.lit("The THE"))).select("path", "line_no")


@query("select p_partkey, contains(lower(p_name), 'an') or contains(lower(p_brand), 'an') as hit from part")
def f3_symbol_contains(spark, d):
    return V.table(spark, d, "part").select("p_partkey", T.symbol_contains(F.col("p_name"), F.col("p_brand"), F.lit("AN")).alias("hit"))


@query("select item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: strlen(w) > 2 and w not in (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")))), ' ') as terms from benchmark")
def f4_focus_terms(spark, d):
    none = F.array().cast("array<string>")
    return V.table(spark, d, "benchmark").select("item_id", F.array_join(T.focus_terms(F.col("text"), none), " ").alias("terms"))


@query("select item_id, contains(lower(text), 'ción') or contains(lower(text), 'thed') as hit from benchmark")
def f5_literal_match(spark, d):
    return V.table(spark, d, "benchmark").select("item_id", T.literal_match(F.col("text"), F.array(F.lit("ción"), F.lit("thed"))).alias("hit"))


@query("select distinct name, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> ''), '/') as words from (select p_name || p_type || '_HTTPServer' || p_size as name from part)")
def f6_identifier_words(spark, d):
    name = F.concat("p_name", "p_type", F.lit("_HTTPServer"), F.col("p_size").cast("string"))
    return V.table(spark, d, "part").select(name.alias("name")).distinct().select("name", F.array_join(T.identifier_words(F.col("name")), "/").alias("words"))


@query("with " + V.WORDS + " select distinct word, regexp_matches(word, '^[\\p{L}_$][\\p{L}\\p{N}_$]*(\\.[\\p{L}_$][\\p{L}\\p{N}_$]*)*$') as dotted from wd")
def f7_dotted_name(spark, d):
    return V.words(spark, d).select("word").distinct().select("word", T.is_dotted(F.col("word")).alias("dotted"))


@query("with " + V.DOCS + " select doc_id, replace(path[1:length(path) - 4], '/', '.') as module from docs")
def f8_module_name(spark, d):
    docs = V.documents(spark, d)
    path = F.concat(F.regexp_replace("path", r"\.txt$", ""), F.when(F.col("doc_id") % 2 == 0, "/__init__.py").otherwise(".py"))
    return docs.select("doc_id", T.module_name(path).alias("module"))


@query("with " + V.WORDS + " select distinct word, regexp_full_match(word, '[A-Za-z0-9._-]{1,128}') as valid from wd")
def f9_record_id(spark, d):
    return V.words(spark, d).select("word").distinct().select("word", T.valid_record_id(F.col("word")).alias("valid"))


@query("""select l_orderkey, l_linenumber, case when abs(s - 1) <= 0.002 + 1e-12 then 'exact' when abs(s - 1) <= 0.01 + 1e-12 then 'rounded' else 'invalid' end as status
from (select l_orderkey, l_linenumber, l_discount + l_tax + (0.85 + (l_linenumber % 3) / 100.0::double) as s from lineitem)""")
def f10_probability_rules(spark, d):
    p = F.create_map(F.lit("a"), F.col("l_discount"), F.lit("b"), F.col("l_tax"), F.lit("c"), F.lit(0.85) + F.col("l_linenumber") % 3 / F.lit(100.0))
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.probability_status(p).alias("status"))


@query("select item_id, case when length(text) > 100 then text[1:65] || '...' || right(text, 35) else text end as excerpt from benchmark")
def f11_excerpt(spark, d):
    return V.table(spark, d, "benchmark").select("item_id", T.excerpt(F.col("text"), 100, "...").alias("excerpt"))


@query("select s_suppkey, replace(lower(s_name), '-', '_') as alias from supplier")
def f12_alias(spark, d):
    return V.table(spark, d, "supplier").select("s_suppkey", T.crate_alias(F.lower("s_name")).alias("alias"))


@query("select event_id, date_diff('second', ts, timestamp '2030-01-01 00:00:00')::bigint as age from (select event_id, date_trunc('second', ts) as ts from events)")
def f13_age(spark, d):
    now = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    return V.table(spark, d, "events").select("event_id", T.age_seconds(now, F.date_trunc("second", "ts").cast("timestamp_ntz")).alias("age"))


@query("with " + V.DOCS + " select doc_id, sha256(text) as content_hash from docs")
def i1_content_hash(spark, d):
    return V.documents(spark, d).select("doc_id", T.content_hash(F.encode("text", "UTF-8")).alias("content_hash"))


_JSON = "'\"' || replace(replace(replace({0}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'u000a') || '\"'"


@query("with " + V.DOCS + ", j as (select doc_id, '{\"path\":' || " + _JSON.format("path") + " || ',\"text\":' || " + _JSON.format("text") + " || '}' as c from docs) select doc_id, sha256(c) as canonical_hash, strlen(c)::bigint as bytes from j")
def i2_canonical_json(spark, d):
    one = V.documents(spark, d).select("doc_id", T.json_object(path=T.json_string(F.col("path")), text=T.json_string(F.col("text"))).alias("c"))
    return one.select("doc_id", F.sha2("c", 256).alias("canonical_hash"), F.octet_length("c").cast("long").alias("bytes"))


def _decls(spark, d):
    """Lines as declarations: kind line, name the first word, in the document's top level."""
    ln = I.sibling_ordinals(V.lines(spark, d), ["source_set_id", "path", "name"])
    key = F.struct(F.lit("function").alias("kind"), F.col("name"), F.lit(None).cast("struct<parameterTypes:array<string>,typeParameterCount:bigint,variadic:boolean>").alias("signature"), "ordinal")
    none = F.array().cast("array<struct<kind:string,name:string,signature:struct<parameterTypes:array<string>,typeParameterCount:bigint,variadic:boolean>,ordinal:bigint>>")
    return ln.withColumn("key", key).withColumn("ancestors", none)


_SIB = V.LINES + ', sib as (select *, (row_number() over (partition by source_set_id, path, name order by start, "end") - 1)::bigint as ordinal from ln)'
_SID = _SIB + """, sid as (select path, line_no, ordinal, 'sid:v1:' || sha256(encode('siftworks.syntax.v1') || '\\x00'::blob || encode('{"ancestors":[],"declaration":{"kind":"function","name":' || coalesce(""" + _JSON.format("name") + """, 'null') || ',"ordinal":' || ordinal || ',"signature":null},"language":"' || language || '","path":"' || path || '","sourceSet":"' || source_set_id || '"}'))[1:32] as syntax_id from sib)"""


@query("with " + _SIB + " select path, line_no, name, ordinal from sib")
def w1_sibling_ordinals(spark, d):
    return I.sibling_ordinals(V.lines(spark, d), ["source_set_id", "path", "name"]).select("path", "line_no", "name", "ordinal")


@query("with " + V.WORDS + ", o as (select path, line_no, word_no, (row_number() over (partition by path, line_no order by start, \"end\") - 1)::bigint as ordinal from wd) select path, line_no, count(*) as n, max(ordinal) as last_ordinal from o group by 1, 2")
def w2_occurrence_ordinals(spark, d):
    o = I.sibling_ordinals(V.words(spark, d), ["path", "line_no"])
    return o.groupBy("path", "line_no").agg(F.count("*").alias("n"), F.max("ordinal").alias("last_ordinal"))


@query("with " + _SID + " select path, line_no, syntax_id from sid")
def i4_syntax_id(spark, d):
    return I.with_syntax_id(_decls(spark, d)).select("path", "line_no", "syntax_id")


@query("""with docs as (select doc_id, sha256(coalesce(text, '')) as h from documents)
select doc_id, 'occ:v2:' || sha256(encode('siftworks.occurrence.v1') || '\\x00'::blob || encode('{"contentHash":"' || h || '","extractionContext":"' || sha256('') || '","kind":"call","nativeProducerId":"seg","nativeProducerVersion":"1","ordinal":' || (doc_id % 5) || ',"ownerSyntaxId":"o"}'))[1:32] as occurrence_id from docs""")
def i5_occurrence_id(spark, d):
    docs = V.documents(spark, d).select("doc_id", F.sha2("text", 256).alias("content_hash"), F.sha2(F.lit(""), 256).alias("extraction_context"), F.lit("seg").alias("producer_id"), F.lit("1").alias("producer_version"), F.lit("o").alias("owner_syntax_id"), F.lit("call").alias("kind"), (F.col("doc_id") % 5).alias("ordinal"))
    return I.with_occurrence_id(docs).select("doc_id", "occurrence_id")


@query("""with c as (select distinct lang as language, source as name, sha256(source) as hash from documents where lang is not null)
select language, sha256(encode('siftworks.extraction-context.v1') || '\\x00'::blob || encode('{"components":[' || string_agg('{"hash":"' || hash || '","name":"' || name || '"}', ',' order by name, hash) || '],"language":"' || language || '"}')) as extraction_context from c group by language""")
def i6_extraction_context(spark, d):
    c = V.documents(spark, d).filter("language is not null").select("language", F.col("source_set_id").alias("name"), F.sha2("source_set_id", 256).alias("hash"))
    return I.extraction_contexts(c)


@query("with docs as (select doc_id, n_chars % 50 as handle, text from documents) select handle, count(distinct text) as inputs from docs group by handle having count(distinct text) > 1")
def i7_collisions(spark, d):
    docs = V.table(spark, d, "documents").select((F.col("n_chars") % 50).alias("handle"), F.col("text").alias("canonical"))
    return I.id_collisions(docs, "handle")


@query("with " + V.LINES + """, h as (select path, name, start, "end", sha256(line) as header_hash from ln), g as (select path, name, list(header_hash order by start, "end", header_hash) as hs from h group by 1, 2)
select path, name, sha256(encode('siftworks.siblings.v1') || '\\x00'::blob || encode('["' || array_to_string(hs, '","') || '"]')) as sibling_group_hash, len(hs)::bigint as sibling_count, len(list_distinct(hs))::bigint as distinct_headers from g""")
def a10_sibling_groups(spark, d):
    h = V.lines(spark, d).withColumn("header_hash", F.sha2("line", 256))
    return I.sibling_groups(h, ["path", "name"])


@query("with " + _SID + """, h as (select s.path, s.name, s.syntax_id, s.line_no, sha256(l.line) as hh from (select sid.*, ln.name from sid join ln using (path, line_no)) s join ln l using (path, line_no)),
n as (select *, sha256(case when line_no % 10 = 0 then 'x' else '' end) as salt from h)
select syntax_id, case when line_no % 7 = 0 or line_no % 10 = 0 then 'orphaned' else 'attached' end as state, case when line_no % 7 = 0 then 'missing' when line_no % 10 = 0 then 'headerMismatch' end as reason from n""")
def j23_anchor_audit(spark, d):
    """Anchors of all lines against a revision without every seventh line and with every tenth changed; each line is a
    group of its own, so that groups don't change."""
    decls = I.with_syntax_id(_decls(spark, d)).withColumn("header_hash", F.sha2("line", 256))
    anchors = I.capture_anchors(decls, ["path", "line_no"])
    now = decls.filter("line_no % 7 <> 0").withColumn("header_hash", F.when(F.col("line_no") % 10 == 0, F.sha2(F.concat("line", F.lit("x")), 256)).otherwise(F.col("header_hash")))
    return I.audit_anchors(anchors, now, ["path", "line_no"])


@query("with " + _SID + """, h as (select path, coalesce(ln.name, '') as name, syntax_id, line_no, start, "end", sha256(line) as was, case when line_no % 7 = 0 then null when line_no % 10 = 0 then sha256(line || 'x') else sha256(line) end as now from sid join ln using (path, line_no)),
a as (select *, list(was) over g as was_all, count(*) over (partition by path, name, was) as was_same from h window g as (partition by path, name order by start rows between unbounded preceding and unbounded following)),
b as (select syntax_id, list(now) over g as now_all, count(*) over (partition by path, name, now) as now_same from h where now is not null window g as (partition by path, name order by start rows between unbounded preceding and unbounded following)),
r as (select syntax_id, case when now is null then 'missing' when now <> was then 'headerMismatch' when (was_same > 1 or now_same > 1) and (was_all <> now_all or was_same <> now_same) then 'groupChanged' when was_same > 1 or now_same > 1 then 'unprovenContinuity' end as reason from a left join b using (syntax_id))
select syntax_id, case when reason is null then 'attached' else 'orphaned' end as state, reason from r""")
def i9_anchor_states(spark, d):
    """Anchors of all lines, siblings being a document's lines of one name, against a revision without every seventh line
    and with every tenth changed, where nothing proves that the others stayed."""
    decls = I.with_syntax_id(_decls(spark, d)).withColumn("name", F.coalesce("name", F.lit(""))).withColumn("header_hash", F.sha2("line", 256))
    now = decls.filter("line_no % 7 <> 0").withColumn("header_hash", F.when(F.col("line_no") % 10 == 0, F.sha2(F.concat("line", F.lit("x")), 256)).otherwise(F.col("header_hash")))
    return I.audit_anchors(I.capture_anchors(decls, ["path", "name"]), now, ["path", "name"], "unknown")


@query("select doc_id, sha256(encode('siftworks.test.v1') || '\\x00'::blob || encode(coalesce(text, ''))) as digest from documents")
def i3_domain_digest(spark, d):
    return V.documents(spark, d).select("doc_id", T.domain_digest("siftworks.test.v1", F.col("text")).alias("digest"))


def _keyed_sql(rows: str, columns: str, name: str, buckets: int = 1024) -> str:
    """keyed_digest() of rows (k, columns), as a table expression."""
    return f"""{name} as (select k, sha256(string_agg(d, '' order by b)) as {name} from (select k, b, sha256(string_agg(h, '' order by h)) as d from (select *, ('0x' || h[1:8])::bigint % {buckets} as b from (select k, sha256(concat_ws(chr(31), {columns})) as h from ({rows}))) group by 1, 2) group by 1)"""


@query("with " + V.DOCS + ", " + _keyed_sql("select source_set_id as k, sha256(text) as hash, path from docs", "hash, path", "manifest_hash", 1 << 14) + ", n as (select source_set_id, count(*) as files from docs group by 1) select source_set_id, files, manifest_hash from n join manifest_hash on k = source_set_id")
def a9_manifest_hash(spark, d):
    return I.manifest_hashes(V.documents(spark, d))


@query("with " + V.WORDS + ", f as (select path, start || ':' || \"end\" || ':' || word as f from wd) select path, count(*) as facts, sha256(string_agg(f, chr(10) order by f)) as witness from f group by 1")
def i11_document_witness(spark, d):
    return I.document_witness(V.words(spark, d), "path", ["start", "end", "word"])


@query("""select doc_id, 'prov:' || sha256(encode('siftworks.provenance.v1') || '\\x00'::blob || encode('{"path":"' || doc_id || '","producer":"' || source || '","revision":"' || lang || '"}'))[1:32] as provenance_id from documents""")
def i14_provenance_id(spark, d):
    return V.table(spark, d, "documents").select("doc_id", I.provenance_id(F.col("source"), F.col("doc_id").cast("string"), F.col("lang")).alias("provenance_id"))


_JSON = "'\"' || replace(replace(replace(replace(coalesce({c}, ''), '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(9), '\\t') || '\"'"
#: Tables whose rows are exported: integers and texts.
_EXPORTED = {"nation": ("n_name", "n_nationkey", "n_regionkey"), "region": ("r_name", "r_regionkey"), "labels": ("doc_id", "quality", "toxic"), "conversations": ("conv_id", "role", "text", "turn"), "benchmark": ("item_id", "text"), "documents": ("doc_id", "lang", "n_chars", "source")}
_TEXTS = {"n_name", "r_name", "role", "text", "lang", "source"}
_ROWS = " union all ".join(f"select '{t}' as kind, '{{' || " + " || ',' || ".join(f"'\"{c}\":' || " + (f"case when {c} is null then 'null' else {_JSON.format(c=c)} end" if c in _TEXTS else f"coalesce({c}::varchar, 'null')") for c in cs) + f" || '}}' as payload from {t}" for t, cs in _EXPORTED.items())


@query("with r as (" + _ROWS + ") select kind, (row_number() over (partition by kind order by payload) - 1)::bigint as row_key, payload from r")
def s9_canonical_rows(spark, d):
    """All rows of six tables."""
    return I.canonical_rows({t: V.table(spark, d, t).select(*cs) for t, cs in _EXPORTED.items()})


@query("""with r as (select sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') as h from orders),
b as (select ('0x' || h[1:8])::bigint % 1024 as b, count(*) as n, sha256(string_agg(h, '' order by h)) as d from r group by 1)
select sum(n)::bigint as rows, sha256(string_agg(d, '' order by b)) as digest from b""")
def a8_table_digest(spark, d):
    return I.table_digest(V.table(spark, d, "orders"), ["o_orderkey", "o_orderstatus"])


@query("with " + V.DOCS + ", " + ", ".join([_keyed_sql("select distinct source_set_id as k, language from docs", "language", "p"), _keyed_sql("select source_set_id as k, sha256(text) as hash, path from docs", "hash, path", "s"), _keyed_sql("select source_set_id as k, language, count(*)::varchar as n from docs group by 1, 2", "language, n", "f")]) + " select k as source_set_id, 'catalog:' || sha256(concat_ws(chr(10), 'p1', 'g1', '7', p, s, f)) as catalog_id from p join s using (k) join f using (k)")
def i13_catalog_id(spark, d):
    docs = V.documents(spark, d)
    per = docs.groupBy("source_set_id", "language").agg(F.count("*").alias("n"))
    return I.catalog_id(docs.select("source_set_id", "language").distinct(), docs.select("source_set_id", F.sha2("text", 256).alias("hash"), "path"), per, "source_set_id", "p1", "g1", 7)
