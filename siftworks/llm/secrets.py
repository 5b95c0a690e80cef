"""Secret scans: base patterns, and multipart credential linking by an interval join, in DataFrame expressions alone.

Every text is searched once for each kind. The base kinds (assignments of secrets, access identifiers, long hex
strings) are always reported. Weak kinds alone prove nothing: a long mixed string (`secret`) or the address of a
service (`endpoint`) is reported only when a complementary part starts within `scope` code points of it: an access
identifier or an endpoint for a mixed string, an access identifier, assignment, hex or mixed string for an endpoint. A
mixed string inside of a URL is part of it, so it and endpoints are no complements. The join bins starts by the scope
and tests the own and both neighbouring bins, as a semi join: however many parts a scope holds, a candidate comes out
at most once for each bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .quality import let

#: Kinds in order: pattern, group whose length counts, and the least length. Matches are leftmost and never overlap.
BASE = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
WEAK = {
    "secret": (r"[A-Za-z0-9+/=_-]+", 0, 32),
    "endpoint": (r"""[Hh][Tt][Tt][Pp][Ss]?://[A-Za-z0-9._-]+(:[0-9]+)?([^\x20\x09-\x0D"'<>]*)""", 0, 11),
}
#: The group of a match that isn't part of its span: the rest of an endpoint's URL.
TAIL = {"endpoint": 2}
#: What must stand near a weak part.
PARTNERS = {"secret": ("access", "endpoint"), "endpoint": ("access", "assign", "hex", "secret")}
#: A cheap test that a text must pass to be searched for a kind; it holds for every text with a match that counts.
GATES = {
    "assign": r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "secret": r"[A-Za-z0-9+/=_-]{32}",
    "endpoint": r"://",
}
ORDER = [*BASE, *WEAK]
SCOPE = 400


def _lengths(kind: str) -> Column:
    """For each match of a kind: code points from the end of the last match, code points in it, how many of them at its
    end aren't part of the span, whether it counts."""
    pattern, group, least = (BASE | WEAK)[kind]
    t, p = F.col("text"), F.lit(pattern)
    lengths = lambda x: F.transform(x, lambda m: F.length(m).cast("long"))
    gaps = lengths(F.split(t, pattern, -1))
    whole = F.regexp_extract_all(t, p, F.lit(0))
    ok = F.transform(whole if group == 0 else F.regexp_extract_all(t, p, F.lit(group)), lambda x: F.length(x) >= least)
    if kind == "secret":
        ok = F.transform(whole, lambda x: (F.length(x) >= least) & x.rlike("[0-9]") & x.rlike("[A-Z]") & x.rlike("[a-z]"))
    tails = lengths(F.regexp_extract_all(t, p, F.lit(TAIL[kind]))) if kind in TAIL else F.array().cast("array<long>")
    one = F.struct(gaps.alias("g"), lengths(whole).alias("m"), tails.alias("t"), ok.alias("o"))
    parts = let(one, lambda s: F.transform(s["m"], lambda m, i: F.struct(F.lit(ORDER.index(kind)).alias("k"), i.alias("i"), F.get(s["g"], i).alias("gap"), m.alias("len"), F.coalesce(F.get(s["t"], i), F.lit(0)).cast("long").alias("tail"), F.get(s["o"], i).alias("ok"))))
    return F.when(t.rlike(GATES[kind]), parts)


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> tuple[DataFrame, DataFrame]:
    """Rows of docs as (doc_id, h), and spans as (doc_id, h, k, start, end): k is the place of the kind in ORDER, start
    and end are code points, end exclusive; h is a hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    found = stored(one.select("doc_id", "h", *[_lengths(k).alias(k) for k in ORDER]), "matches")
    every = F.flatten(F.filter(F.array(*ORDER), lambda x: x.isNotNull()))
    rows = found.filter(" or ".join(f"size({k}) > 0" for k in ORDER)).dropDuplicates(["doc_id", "h"])
    flat = rows.select("doc_id", "h", F.inline(every))
    run = Window.partitionBy("doc_id", "h", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    far = flat.withColumn("far", F.sum(F.col("gap") + F.col("len")).over(run)).filter("ok")
    spans = far.select("doc_id", "h", "k", (F.col("far") - F.col("len")).alias("start"), (F.col("far") - F.col("tail")).alias("end"), "far")
    return found.select("doc_id", "h"), _linked(stored(spans, "spans"), scope)


def _linked(spans: DataFrame, scope: int) -> DataFrame:
    """All base spans, and the weak ones that overlap no base span and have a partner in scope."""
    n, secret, endpoint = len(BASE), ORDER.index("secret"), ORDER.index("endpoint")
    by, back = Window.partitionBy("doc_id", "h").orderBy("start", "k"), Window.partitionBy("doc_id", "h").orderBy(F.desc("start"), F.desc("k"))
    is_base = F.col("k") < n
    around = {
        "be": F.max(F.when(is_base, F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, -1)),
        "bn": F.min(F.when(is_base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1)),
        "url": F.max(F.when(F.col("k") == endpoint, F.col("far"))).over(by.rowsBetween(Window.unboundedPreceding, -1)),
    }
    placed = spans.withColumns(around).withColumn("inside", (F.col("k") == secret) & F.coalesce(F.col("url") > F.col("start"), F.lit(False)))
    alone = placed.filter(f"k >= {n} and coalesce(be <= start, true) and coalesce(bn >= end, true)").select("doc_id", "h", "k", "start", "end", "inside")
    partner = {ORDER.index(w): [ORDER.index(p) for p in ps] for w, ps in PARTNERS.items()}
    weak = alone.withColumn("bin", F.explode(F.array(*[F.floor(F.col("start") / scope) + d for d in (-1, 0, 1)])))
    parts = placed.withColumn("bin", F.floor(F.col("start") / scope)).select(*[F.col(c).alias(f"p_{c}") for c in ("doc_id", "h", "k", "start", "bin", "inside")])
    fits = F.lit(False)
    for w, ps in partner.items():
        fits = fits | ((F.col("k") == w) & F.col("p_k").isin(ps))
    fits = fits & ~(F.col("inside") & (F.col("p_k") == endpoint)) & ~(F.col("p_inside") & (F.col("k") == endpoint))
    cond = F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("h") == F.col("p_h")) & (F.col("bin") == F.col("p_bin")) & (F.abs(F.col("start") - F.col("p_start")) <= scope) & fits
    return spans.filter(f"k < {n}").select("doc_id", "h", "k", "start", "end").unionByName(weak.join(parts, cond, "left_semi").select("doc_id", "h", "k", "start", "end").distinct())


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs (doc_id, text, ...).

    spans lists kind:start:end of all spans by start, then kind, joined by commas; base_sha256 is the SHA-256 of the
    same list of base spans alone. A null text counts as empty; a null doc_id is kept and scanned; repeated rows get
    the same result each. An empty table gives an empty result; other columns are ignored.
    """
    rows, spans = secret_spans(docs, scope)
    name = F.element_at(F.array(*[F.lit(k) for k in ORDER]), F.col("s.k") + 1)
    item = lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in ORDER]), s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    listed = spans.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "k", "end"))).alias("s"))
    out = rows.alias("r").join(listed.alias("l"), F.expr("r.doc_id <=> l.doc_id and r.h = l.h"), "left").select("r.doc_id", F.coalesce("s", F.array().cast(listed.schema["s"].dataType)).alias("s"))
    count = lambda k: F.size(F.filter("s", lambda x: x["k"] == ORDER.index(k))).cast("long")
    base = F.array_join(F.transform(F.filter("s", lambda x: x["k"] < len(BASE)), item), ",")
    return out.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("s", item), ",").alias("spans"))


def secrets_sql(scope: int = SCOPE) -> str:
    """scan_secrets() over the table documents (doc_id unique), for DuckDB."""
    q = lambda s: s.replace("'", "''")
    kinds = []
    for k, (pattern, group, least) in (BASE | WEAK).items():
        counts = f"len(list_extract(part, i)) >= {least}"
        if k == "secret":
            counts += " and " + " and ".join(f"regexp_matches(list_extract(part, i), '{c}')" for c in ("[0-9]", "[A-Z]", "[a-z]"))
        tail = f"regexp_extract_all(text, '{q(pattern)}', {TAIL[k]})" if k in TAIL else "null::varchar[]"
        kinds.append(f"""select doc_id, {ORDER.index(k)} as k, '{k}' as name, far - len as start, far - tail as "end", far, ok from (
  select doc_id, i, length(list_extract(m, i)) as len, coalesce(length(list_extract(t, i)), 0) as tail, {counts} as ok,
    sum(length(list_extract(g, i)) + length(list_extract(m, i))) over (partition by doc_id order by i) as far
  from (select doc_id, m, g, part, t, unnest(range(1, len(m) + 1)) as i from (
    select doc_id, regexp_extract_all(text, '{q(pattern)}') as m, string_split_regex(text, '{q(pattern)}') as g, regexp_extract_all(text, '{q(pattern)}', {group}) as part, {tail} as t from d where regexp_matches(text, '{q(GATES[k])}'))))""")
    partner = " or ".join(f"w.name = '{w}' and p.name in ({', '.join(repr(x) for x in ps)})" for w, ps in PARTNERS.items())
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
found as (select * from ({' union all '.join(kinds)}) where ok),
s as (select f.*, name = 'secret' and exists (select 1 from found e where e.name = 'endpoint' and e.doc_id = f.doc_id and e.start < f.start and e.far > f.start) as inside from found f),
base as (select * from s where k < {len(BASE)}),
weak as (select * from s w where k >= {len(BASE)} and not exists (select 1 from base b where b.doc_id = w.doc_id and b.start < w."end" and b."end" > w.start)),
linked as (select * from weak w where exists (select 1 from s p where p.doc_id = w.doc_id and abs(p.start - w.start) <= {scope} and ({partner}) and not (w.inside and p.name = 'endpoint') and not (p.inside and w.name = 'endpoint'))),
spans as (select doc_id, k, name, start::bigint as start, "end"::bigint as "end" from (select * from base union all select * from linked)),
l as (select doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
  string_agg(name || ':' || start || ':' || "end", ',' order by start, k) filter (k < {len(BASE)}) as b, string_agg(name || ':' || start || ':' || "end", ',' order by start, k) as spans from spans group by 1)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans
from d left join l using (doc_id)
"""
