"""Views of the test tables in the shapes that the operators work on, as DataFrames and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_set_id, language, path, doc_id, text."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("source_set_id"), F.col("lang").alias("language"), F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


DOCS = "docs as (select source as source_set_id, lang as language, source || '/' || lang || '/' || doc_id || '.txt' as path, doc_id, coalesce(text, '') as text from documents)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines: line_no from 1, byte range [start, end) without the line feed, name (the first word)."""
    from siftworks.operators.segments import segment_lines

    return segment_lines(documents(spark, sf_dir))


LINES = (
    DOCS
    + """,
ln as (select source_set_id, language, path, doc_id, line_no::bigint as line_no, line, start::bigint as start, (start + strlen(line))::bigint as "end", nullif(string_split(line, ' ')[1], '') as name
  from (select *, coalesce(sum(strlen(line) + 1) over (partition by path order by line_no rows between unbounded preceding and 1 preceding), 0) as start
    from (select source_set_id, language, path, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from docs)))"""
)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the lines, parted by spaces, with byte ranges."""
    from siftworks.operators.segments import segment_words

    return segment_words(lines(spark, sf_dir))


WORDS = (
    LINES
    + """,
wd as (select source_set_id, path, doc_id, line_no, word_no::bigint as word_no, word, (start + off)::bigint as start, (start + off + strlen(word))::bigint as "end"
  from (select *, coalesce(sum(strlen(word) + 1) over (partition by path, line_no order by word_no rows between unbounded preceding and 1 preceding), 0) as off
    from (select source_set_id, path, doc_id, line_no, start, unnest(string_split(line, ' ')) as word, generate_subscripts(string_split(line, ' '), 1) as word_no from ln)) where word <> '')"""
)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, name of a graph over customers, orders, parts, suppliers, nations and regions."""
    t = lambda n: table(spark, sf_dir, n)
    one = lambda df, k, kind, name: df.select(F.concat(F.lit(kind + ":"), F.col(k).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"))
    parts = [one(t("customer"), "c_custkey", "customer", "c_name"), one(t("orders"), "o_orderkey", "order", "o_orderkey"), one(t("part"), "p_partkey", "part", "p_name"), one(t("supplier"), "s_suppkey", "supplier", "s_name"), one(t("nation"), "n_nationkey", "nation", "n_name"), one(t("region"), "r_regionkey", "region", "r_name")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_id, src, dst, ordinal: customer to order to part to supplier to nation to region."""
    t = lambda n: table(spark, sf_dir, n)
    ref = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    co = t("orders").select(ref("customer", "o_custkey").alias("src"), ref("order", "o_orderkey").alias("dst"), F.col("o_orderkey").alias("ordinal"))
    op = t("lineitem").select(ref("order", "l_orderkey").alias("src"), ref("part", "l_partkey").alias("dst"), F.col("l_linenumber").cast("long").alias("ordinal"))
    ps = t("lineitem").select(ref("part", "l_partkey").alias("src"), ref("supplier", "l_suppkey").alias("dst"), F.col("l_suppkey").alias("ordinal")).distinct()
    sn = t("supplier").select(ref("supplier", "s_suppkey").alias("src"), ref("nation", "s_nationkey").alias("dst"), F.lit(0).cast("long").alias("ordinal"))
    nr = t("nation").select(ref("nation", "n_nationkey").alias("src"), ref("region", "n_regionkey").alias("dst"), F.lit(0).cast("long").alias("ordinal"))
    every = co.unionByName(op).unionByName(ps).unionByName(sn).unionByName(nr)
    return every.select(F.concat_ws(">", "src", "dst", F.col("ordinal").cast("string")).alias("call_id"), "src", "dst", "ordinal").distinct()


GRAPH = """
nodes as (select 'customer:' || c_custkey as id, 'customer' as kind, c_name as name from customer union all select 'order:' || o_orderkey, 'order', o_orderkey::varchar from orders
  union all select 'part:' || p_partkey, 'part', p_name from part union all select 'supplier:' || s_suppkey, 'supplier', s_name from supplier
  union all select 'nation:' || n_nationkey, 'nation', n_name from nation union all select 'region:' || r_regionkey, 'region', r_name from region),
edges as (select distinct src || '>' || dst || '>' || ordinal as call_id, src, dst, ordinal::bigint as ordinal from (
  select 'customer:' || o_custkey as src, 'order:' || o_orderkey as dst, o_orderkey as ordinal from orders
  union all select 'order:' || l_orderkey, 'part:' || l_partkey, l_linenumber from lineitem
  union all select distinct 'part:' || l_partkey, 'supplier:' || l_suppkey, l_suppkey from lineitem
  union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 0 from supplier
  union all select 'nation:' || n_nationkey, 'region:' || n_regionkey, 0 from nation))"""


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """revision (a year), path, language, hash: what each customer ordered in the year, as a document."""
    o = table(spark, sf_dir, "orders")
    one = o.groupBy(F.year("o_orderdate").cast("long").alias("revision"), F.col("o_custkey").alias("c")).agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("p"))
    return one.select("revision", F.concat_ws("/", F.lit("customer"), F.col("c").cast("string")).alias("path"), F.element_at(F.array(F.lit("python"), F.lit("java"), F.lit("rust")), (F.col("c") % 3 + 1).cast("int")).alias("language"), F.sha2(F.concat_ws("|", F.col("n").cast("string"), "p"), 256).alias("hash"))


REVISIONS = """revs as (select revision, 'customer/' || c as path, ['python', 'java', 'rust'][(c % 3 + 1)::int] as language, sha256(n || '|' || p) as hash from (
  select year(o_orderdate)::bigint as revision, o_custkey as c, count(*) as n, max(o_orderpriority) as p from orders group by 1, 2))"""


def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_id, producer, target, resolution, freshness, dispatch, provenance_id from lineitem."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    pick = lambda c, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (c % len(v) + 1).cast("int"))
    res = F.when(F.col("l_returnflag") == "A", "internal").when(F.col("l_returnflag") == "N", "external").otherwise("unresolved")
    return l.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), (F.col("l_linenumber") % 3).cast("string")).alias("call_id"), F.concat(F.lit("p"), (F.col("l_suppkey") % 2).cast("string")).alias("producer"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target"), res.alias("resolution"), F.when(F.col("l_linestatus") == "F", "fresh").otherwise("stale").alias("freshness"), pick(F.col("l_partkey"), "direct", "virtual", "constructor").alias("dispatch"), F.concat_ws("-", F.lit("prov"), *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag")]).alias("provenance_id"))


BINDINGS = """bind as (select l_orderkey || '-' || (l_linenumber % 3) as call_id, 'p' || (l_suppkey % 2) as producer, 'part:' || l_partkey as target,
  case l_returnflag when 'A' then 'internal' when 'N' then 'external' else 'unresolved' end as resolution, case l_linestatus when 'F' then 'fresh' else 'stale' end as freshness,
  ['direct', 'virtual', 'constructor'][(l_partkey % 3 + 1)::int] as dispatch, concat_ws('-', 'prov', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, l_returnflag) as provenance_id from lineitem)"""
