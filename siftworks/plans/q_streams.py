"""Queries of sources, extraction, publication and signal batches."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftworks.operators import relate
from siftworks.operators.extract import extract_facts, header_facts
from siftworks.plans import views as V
from siftworks.plans.registry import query
from siftworks.sources import corpus, tables
from siftworks.streaming import signals as R


def _paths(spark, d):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".js", ".rs", ".py", ".txt")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    top = F.element_at(F.array(*[F.lit(x) for x in ("lib/", "node_modules/", "target/", "src/main/java/target/", "")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return V.table(spark, d, "part").select("p_partkey", F.concat(top, F.lit("f"), F.col("p_partkey").cast("string"), ext).alias("path"))


@query("select p_partkey, p_partkey % 4 <> 3 and p_partkey % 5 not in (1, 2) as supported from part")
def s1_supported_paths(spark, d):
    p = _paths(spark, d)
    return p.select("p_partkey", corpus.supported(F.col("path")).alias("supported"))


@query("with " + V.DOCS + " select path, strlen(text)::bigint as n_bytes, sha256(text) as content_hash from docs")
def s2_text_table(spark, d):
    docs = corpus.documents_from_table(V.documents(spark, d), "path", "text")
    return docs.select("path", F.octet_length("bytes").cast("long").alias("n_bytes"), "content_hash")


@query("with " + V.DOCS + " select path, doc_id % 4 <> 0 as authentic from docs")
def s3_verify_manifest(spark, d):
    docs = V.documents(spark, d)
    m = docs.select("path", F.sha2(F.concat("text", F.when(F.col("doc_id") % 4 == 0, "x").otherwise("")), 256).alias("sha256"))
    return corpus.verify_manifest(corpus.documents_from_table(docs, "path", "text"), m)


@query("with " + V.DOCS + " select v.name, d.path is not null as present, sha256(d.text) as content_hash from (select path as name from docs union all select 'absent.lock') v left join docs d on d.path = v.name")
def s5_capture_inputs(spark, d):
    docs = V.documents(spark, d)
    names = docs.select(F.col("path").alias("name")).union(spark.range(1).select(F.lit("absent.lock")))
    return corpus.capture_inputs(corpus.documents_from_table(docs, "path", "text"), names)


@query("with " + V.WORDS + " select word as symbol, count(*) as n from wd group by 1")
def s4_imported_facts(spark, d):
    """Every word as an imported fact in UTF-16 units; its range is turned into bytes and its text checked there."""
    out = f"{tables.shared_dir(spark)}/facts-{uuid.uuid4().hex}"
    docs = V.documents(spark, d).select("path", "text")
    units = lambda c: (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")
    before = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    flat = docs.select("path", F.posexplode(F.split("text", "[ \n]")).alias("i", "word"))
    at = F.coalesce(F.sum(units(F.col("word")) + 1).over(before), F.lit(0))
    facts = flat.withColumn("at", at).filter("word <> ''").select("path", F.array("at", F.col("at") + units(F.col("word"))).alias("range"), F.lit("utf16").alias("encoding"), F.col("word").alias("symbol"), F.lit("read").alias("role"))
    facts.select(F.to_json(F.struct(*facts.columns))).write.option("compression", "gzip").text(out)
    read = corpus.read_facts(spark, out)
    ends = read.select("path", "encoding", "symbol", F.col("range")[0].alias("first"), F.explode("range").alias("at"))
    # both ends of a range and its row are known by path and place, so they stay together and take no join of their own
    byte = relate.to_byte_offsets(ends, docs, keep=("path", "first", "symbol"))
    rows = byte.groupBy("path", "first", F.col("symbol").alias("claimed")).agg(F.min("byte_at").alias("start"), F.max("byte_at").alias("end"))
    rows = rows.select(F.struct("path", "first").alias("row_id"), "path", "claimed", "start", "end", F.lit(0).alias("owner_start"), F.lit(2**62).alias("owner_end"))
    return relate.verify_witness(rows, docs, keep=("claimed",)).filter("ok").groupBy(F.col("claimed").alias("symbol")).agg(F.count("*").alias("n"))


def _published(spark, d):
    """Two revisions, with a writer that comes too late and retries in between, and a third of the same versions."""
    out = f"{tables.shared_dir(spark)}/published-{uuid.uuid4().hex}"
    r = V.revisions(spark, d).withColumnRenamed("hash", "version_id")
    lost = 0
    for before, year in ((None, 1995), (None, 1996), ("1995", 1996), ("1995", 1996)):
        one = r.filter(F.col("revision") == year)
        try:
            tables.publish(one.select("version_id").distinct(), one.select("path", "version_id"), out, str(year), before)
        except tables.StaleHead:
            lost += 1
    tables.publish_unchanged(spark, out, "1997", "1996")
    return out, lost


@query("with " + V.REVISIONS + " select path, hash as version_id from revs where revision = 1996")
def s7_pinned_read(spark, d):
    """The pin reads the second revision whole, though a third came after."""
    return tables.at_pin(spark, _published(spark, d)[0], "1996").select("path", "version_id")


@query("with " + V.REVISIONS + " select revision::varchar as revision_id, count(*) as paths, count(distinct hash) as versions, 1::bigint as lost, (select count(distinct hash) from revs where revision in (1995, 1996)) as stored from revs where revision in (1995, 1996) group by 1 union all select '1997', count(*), count(distinct hash), 1, (select count(distinct hash) from revs where revision in (1995, 1996)) from revs where revision = 1996")
def s6_publish(spark, d):
    """What readers of each revision see, how many writers lost, and how many versions are stored."""
    out, lost = _published(spark, d)
    every = None
    for r in ("1995", "1996", "1997"):
        one = tables.at_pin(spark, out, r).agg(F.count("*").alias("paths"), F.count_distinct("version_id").alias("versions")).select(F.lit(r).alias("revision_id"), "*")
        every = one if every is None else every.unionByName(one)
    stored = spark.read.parquet(f"{out}/versions").agg(F.count("*").alias("stored"))
    return every.withColumn("lost", F.lit(lost).cast("long")).crossJoin(stored)  # one row


@query("with " + V.REVISIONS + " select path, hash as version_id from revs where revision = 1996")
def s8_publish_unchanged(spark, d):
    return tables.at_pin(spark, _published(spark, d)[0], "1997").select("path", "version_id")


@query("with " + V.REVISIONS + " select path, language, hash from revs a where revision = 1996 and not exists (select 1 from revs b where b.revision < 1996 and b.path = a.path and b.language = a.language and b.hash = a.hash)")
def s10_new_versions(spark, d):
    r = V.revisions(spark, d)
    return corpus.new_versions(r.filter("revision = 1996"), r.filter("revision < 1996"), ("path", "language", "hash")).select("path", "language", "hash")


_SRC = """src as (select path, doc_id, language = 'de' as other, list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_extract(l, '[a-z]+')), lambda w: w <> '') as ws from docs),
fn as (select path, doc_id, unnest(ws) as w from src where not other and len(ws) > 0)"""


def _sources(spark, d):
    """Each document as a source file: a class with two methods, and a function for each line, named by the line's first
    lower-case word. Those without such a word don't parse, German ones are in another language."""
    docs = V.documents(spark, d)
    names = F.filter(F.transform(F.split("text", "\n"), lambda l: F.regexp_extract(l, "[a-z]+", 0)), lambda w: w != "")  # noqa: E741
    one = F.transform(names, lambda w: F.concat(F.lit("def w_"), w, F.lit("(a, /, b: int, *rest, k=0, **more) -> str:\n    def Inner(): pass\n    if a:\n        return g(h(a), b)\n")))
    head = F.concat(F.lit("class k"), F.col("doc_id").cast("string"), F.lit("(Base, metaclass=M):\n    @p.q\n    async def run(self, *args): pass\n    def stop[T](self): pass\n"))
    src = F.when(F.size(names) == 0, "def f(:").otherwise(F.concat(head, F.array_join(one, "\n")))
    return docs.select("path", F.when(F.col("language") == "de", "rust").otherwise("python").alias("language"), F.encode(src, "UTF-8").alias("bytes"))


@query("with " + V.DOCS + ", " + _SRC + """, r as (select 'coverage' as tag, case when other then 'unsupported' when len(ws) = 0 then 'failed' else 'complete' end as kind, null as name, count(*) as n from src group by all
union all select 'declaration', 'function', 'w_' || w, count(*) from fn group by all union all select 'declaration', 'function', 'Inner', count(*) from fn
union all select 'declaration', 'class', 'k' || doc_id, 1 from (select distinct doc_id from fn) union all select 'declaration', 'method', m, count(distinct doc_id) from fn, unnest(['run', 'stop']) t(m) group by all
union all select 'call', 'call', c, count(*) from fn, unnest(['g', 'h']) t(c) group by all union all select 'region', 'branch', null, count(*) from fn)
select tag, kind, name, sum(n)::bigint as n from r where n > 0 group by all""")
def e1_extract_facts(spark, d):
    return extract_facts(_sources(spark, d)).groupBy("tag", "kind", "name").agg(F.count("*").alias("n"))


@query("with " + V.DOCS + ", " + _SRC + """, h as (select 'class' as kind, '' as modifiers, '' as type_parameters, '' as parameters, null as result, 'Base,metaclass=M' as bases, count(distinct doc_id) as n from fn
union all select 'method', 'p.q,async', '', 'self plain,args variadic', null, '', count(distinct doc_id) from fn union all select 'method', '', 'T', 'self plain', null, '', count(distinct doc_id) from fn
union all select 'function', '', '', 'a positional,b plain,rest variadic,k keyword,more keywords', 'str', '', count(*) from fn union all select 'function', '', '', '', null, '', count(*) from fn) select * from h where n > 0""")
def e3_header_facts(spark, d):
    h = header_facts(extract_facts(_sources(spark, d)))
    flat = h.select("kind", *[F.array_join(c, ",").alias(c) for c in ("modifiers", "type_parameters", "bases")], F.array_join(F.transform("parameters", lambda p: F.concat_ws(" ", p["name"], p["kind"])), ",").alias("parameters"), "result")
    return flat.groupBy(*flat.columns).agg(F.count("*").alias("n"))


@query("select count(*) as segments, sum(n)::bigint as n_words from (with " + V.WORDS + " select path, line_no, count(*) as n from wd group by 1, 2)")
def e2_segment_text(spark, d):
    w = V.words(spark, d).groupBy("path", "line_no").agg(F.count("*").alias("n"))
    return w.agg(F.count("*").alias("segments"), F.sum("n").alias("n_words"))


def _signals(spark, d):
    e = V.table(spark, d, "events").filter("user_id is not null and ts is not null")
    kind = F.when(F.col("event_id") % 17 == 0, "urgent").when(F.col("event_id") % 11 == 0, "create").when(F.col("event_id") % 5 == 0, "access").otherwise("modify")
    return e.select((F.col("user_id") % 20).cast("string").alias("source_set_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), kind.alias("event_kind"), F.col("event_id").cast("string").alias("path"))


@query("select (user_id % 20)::varchar as source_set_id, event_id::varchar as path from events where user_id is not null and ts is not null and not (event_id % 5 = 0 and event_id % 17 <> 0 and event_id % 11 <> 0)")
def r4_relevant_signals(spark, d):
    return R.relevant_signals(_signals(spark, d)).select("source_set_id", "path")


@query("""with e as (select (user_id % 20)::varchar as s, floor(epoch_us(ts) / 1000)::bigint as t, event_id, case when event_id % 17 = 0 then 'urgent' when event_id % 11 = 0 then 'create' when event_id % 5 = 0 then 'access' else 'modify' end as k from events where user_id is not null and ts is not null),
l as (select *, lag(t) over w as pt, lag(k) over w as pk from e where k <> 'access' window w as (partition by s order by t, k, event_id::varchar)), g as (select *, sum(case when pt is null or t >= pt + 3600000 or pk = 'urgent' then 1 else 0 end) over (partition by s order by t, k, event_id::varchar) as grp from l),
b as (select s, grp, min(t) as opened_ms, count(*) as signals, count(distinct event_id) as paths, bool_or(k = 'create') or count(distinct event_id) > 256 as "full", max(t) as last, bool_or(k = 'urgent') as urgent from g group by 1, 2)
select s as source_set_id, (row_number() over (partition by s order by grp) - 1)::bigint as generation, opened_ms, case when urgent then last else last + 3600000 end as closed_ms, signals, paths, "full" from b""")
def r1_batch_signals(spark, d):
    """Batches with an hour's gap and no longest wait, which SQL can express; tests hold the wait against a plain loop."""
    return R.batch_signals(R.relevant_signals(_signals(spark, d)), 3_600_000, 10**15)


_EVENTS = """e0 as (select (user_id % 20)::varchar as s, floor(epoch_us(ts) / 1000)::bigint as t, event_id::varchar as p, case when event_id % 17 = 0 then 'urgent' when event_id % 11 = 0 then 'create' when event_id % 5 = 0 then 'access' else 'modify' end as k from events where user_id is not null and ts is not null),
e as (select *, row_number() over (partition by s order by t, k, p) as pos, lag(t) over (partition by s order by t, k, p) as prior from e0 where k <> 'access')"""
#: Batches with a longest wait, walked from one to the next.
_WAITED = _EVENTS + """, firsts as (select s, t, min(pos) as pos from e group by 1, 2), later as (select e.s, e.pos, min(f.pos) as nxt from e join firsts f on e.s = f.s and f.t >= e.t + 7200000 group by 1, 2),
ends as (select s, pos, min(case when k = 'urgent' then pos + 1 end) over (partition by s order by pos rows between current row and unbounded following) as u, min(case when t >= prior + 3600000 then pos end) over (partition by s order by pos rows between 1 following and unbounded following) as g from e),
nx as materialized (select s, pos, nxt from (select s, pos, least(nxt, u, g) as nxt, max(pos) over (partition by s) as n from ends left join later using (s, pos)) where nxt <= n), walk as (select s, 1::bigint as pos, 0::bigint as generation from e group by 1 union all select w.s, nx.nxt, generation + 1 from walk w join nx using (s, pos)),
begun as (select *, lead(pos) over (partition by s order by pos) as stop from walk), batched as (select e.*, w.generation from e join begun w on e.s = w.s and e.pos >= w.pos and (w.stop is null or e.pos < w.stop)),
b as (select s as source_set_id, generation, min(t) as opened_ms, case when bool_or(k = 'urgent') then max(t) else least(max(t) + 3600000, min(t) + 7200000) end as closed_ms, count(*) as signals, count(distinct p) as paths, bool_or(k = 'create') or count(distinct p) > 256 as "full" from batched group by 1, 2)"""


@query("with recursive " + _WAITED + " select * from b")
def r2_batches_with_wait(spark, d):
    return R.batch_signals(R.relevant_signals(_signals(spark, d)), 3_600_000, 7_200_000)


@query("with recursive " + _WAITED + " select source_set_id, generation, (select max(t) from e where e.s = b.source_set_id) <= closed_ms as cleared from b")
def r3_acknowledge(spark, d):
    s = R.relevant_signals(_signals(spark, d))
    return R.acknowledge(R.batch_signals(s, 3_600_000, 7_200_000), s)


def _streamed(spark, stream, name: str):
    """The rows of a stream over what is there, from a table that it writes."""
    out = f"{tables.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    R.replay(spark, stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint"))
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query("with recursive " + _WAITED + " select * from b")
def r1_batch_signal_stream(spark, d):
    """The same batches from a stream with processing-time timers."""
    folder = f"{tables.shared_dir(spark)}/signals-{uuid.uuid4().hex}"
    s = R.relevant_signals(_signals(spark, d)).select("source_set_id", F.timestamp_millis("at_ms").alias("received_at"), "event_kind", "path")
    s.write.parquet(folder)
    return _streamed(spark, R.batch_signal_stream(spark.readStream.schema(s.schema).parquet(folder), 3_600_000, 7_200_000), "batches")


_SUPERSEDED = "r as (select o_custkey || '/' || o_orderkey as revision_id, epoch_ms(lead(o_orderdate::timestamp) over (partition by o_custkey order by o_orderdate, o_orderkey)) as ms from orders)"


@query("with " + _SUPERSEDED + " select revision_id, ms as superseded_ms, ms + 900000 as due_ms from r where ms is not null")
def r5_release_stream(spark, d):
    """Each order of a customer is a revision that the next one supersedes; all but the heads are released."""
    o = V.table(spark, d, "orders")
    lead = F.lead(F.col("o_orderdate").cast("timestamp")).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    r = o.select(F.concat_ws("/", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("revision_id"), lead.alias("superseded_at"))
    folder = f"{tables.shared_dir(spark)}/superseded-{uuid.uuid4().hex}"
    r.write.parquet(folder)
    return _streamed(spark, R.release_stream(spark.readStream.schema(r.schema).parquet(folder)), "released")


@query("with " + V.REVISIONS + " select path, hash as version_id from revs where revision = 1997")
def r6_incremental_publish(spark, d):
    """A micro-batch of changed paths for each year, after a first one of all: the last revision is the year's own."""
    root = f"{tables.shared_dir(spark)}/incremental-{uuid.uuid4().hex}"
    revs, years = tables.stored(V.revisions(spark, d).filter("revision between 1995 and 1997"), "revisions"), (1995, 1996, 1997)
    of = lambda y: revs.filter(F.col("revision") == y).select("path", "language", "hash")
    for before, year in zip((None, *years), years, strict=False):
        diff = of(year).select("path") if before is None else relate.diff_revisions(of(before), of(year)).filter("change <> 'unchanged'").select("path")
        diff.withColumn("full", F.lit(False)).coalesce(1).write.mode("append").parquet(f"{root}/signals")
    stream = spark.readStream.schema("path string, full boolean").option("maxFilesPerTrigger", 1).parquet(f"{root}/signals")
    derive = lambda docs: docs.select("path", F.col("hash").alias("version_id"), "language")
    R.replay(spark, R.apply_changes(stream, lambda batch: of(years[batch]), derive, f"{root}/out", f"{root}/checkpoint"))
    return tables.at_pin(spark, f"{root}/out", f"batch-{len(years) - 1:012d}").select("path", "version_id")
