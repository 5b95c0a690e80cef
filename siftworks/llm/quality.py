"""Quality rules with risk-controlled thresholds, in DataFrame expressions alone.

Each rule rejects a document when one of its measures exceeds a cutoff. Cutoffs are chosen by language (the stratum)
on labelled documents: a cutoff is admitted when the exact binomial tail P(Bin(good, alpha) <= falsely rejected) is at
most delta, so that with confidence 1 - delta the rule rejects at most a share alpha of good documents. Cutoffs are
fixed in advance and tested from the most lenient on, stopping at the first that fails, so one rule in one stratum
needs no correction of its own; over rules and strata delta is divided by their number (Bonferroni), and alpha by the
number of rules, so all guarantees hold together. A stratum with too few labels to prove anything rejects nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, stored

_SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
#: Each rule's measure, and its cutoffs from lenient to strict.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05),
    "upper_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "repeat_share": (0.29, 0.26, 0.23, 0.2, 0.17, 0.14),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{_SPACE}+"), "")


def repeat_words(w: Column, k: int = WINDOW) -> Column:
    """How many words stand in windows of k words that the text has twice or more."""

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda e, i: F.least(F.lit(k), F.coalesce(F.get(p, i + 1), e + k) - e))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        same = lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))
        return F.transform(F.filter(s, same), lambda e: e["i"])

    def of(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        any_ = F.size(F.array_distinct(h)) < F.size(h)
        return F.when(any_, let(F.array_sort(let(pairs, repeated)), covered)).otherwise(0)

    windows = let(w, lambda v: F.transform(F.sequence(F.lit(1), F.size(v) - (k - 1)), lambda i: F.xxhash64(F.slice(v, i, k))))
    return F.when(F.size(w) > k, let(windows, of)).otherwise(0)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, h (hash of the text: rows are told apart by both), the base measures and the rules' measures."""
    lang = F.col("lang").cast("string") if "lang" in {c.lower() for c in docs.columns} else F.lit(None).cast("string")
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    t = F.col("text")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(lines, lambda v: F.struct(F.size(v).cast("long").alias("lines"), (F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("dup")))
    by_word = let(words(t), lambda v: F.struct(F.size(v).cast("long").alias("n"), repeat_words(v).cast("long").alias("r")))
    raw = one.select("doc_id", "lang", "h", by_word.alias("w"), dup.alias("d"), (F.length(t) - F.regexp_count(t, F.lit(_SPACE))).cast("long").alias("word_chars"), F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"))
    flat = raw.select("doc_id", "lang", "h", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("d.dup").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"), "n_upper", F.col("d.lines").alias("n_lines"))
    share = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    return flat.withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"), "upper_share": share("n_upper", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        }
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed in logarithms; 1 from the mean on, where no bound can pass."""
    odds = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log(F.lit(1 - p))).cast("double").alias("t"), F.exp(n * F.log(F.lit(1 - p))).cast("double").alias("s"))

    def step(a: Column, j: Column) -> Column:
        t = a["t"] + F.log((n - j + 1) / j) + odds
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    total = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")), start, step, lambda a: a["s"])
    return F.when(k >= n * p, 1.0).otherwise(total)


def cutoffs(measures: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05, rules: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """lang and a column for each rule: its strictest admitted cutoff, null if none is.

    One row for each stratum. A trial is a text that the base rules keep and that is labelled good: each once, however
    often its rows or its labels repeat, as a copy is no further evidence. A doc_id that is labelled both good and poor
    is no evidence at all, and neither is a null label. Near copies that differ in their text are trials of their own.
    """
    rules = rules or RULES
    settled = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("worst"), F.max("quality").alias("best"))
    good = settled.filter("worst = 1 and best = 1").select("doc_id")
    held = measures.filter("not base_failed").join(good, "doc_id").groupBy("lang", "h").agg(*[F.first(r).alias(r) for r in rules])
    tests = [(r, c, i) for r, cs in rules.items() for i, c in enumerate(cs)]
    counts = held.groupBy("lang").agg(F.count("*").alias("n"), *[F.count_if(F.col(r) > c).alias(f"{r}_{i}") for r, c, i in tests])
    strata = counts.crossJoin(counts.agg(F.count("*").alias("strata")))  # one row
    level = F.lit(delta / len(rules)) / F.col("strata")
    out = []
    for r, cs in rules.items():
        passed = F.array(*[binomial_tail(F.col(f"{r}_{i}"), F.col("n"), alpha / len(rules)) <= level for i in range(len(cs))])
        # fixed sequence: as many as pass before the first that doesn't
        upto = F.coalesce(F.array_position(passed, F.lit(False)), F.lit(0))
        n = F.when(upto == 0, len(cs)).otherwise(upto - 1).cast("int")
        out.append(F.get(F.array(*[F.lit(c) for c in cs]), n - 1).alias(r))
    return strata.select("lang", *out)


def judged(docs: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05, rules: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """doc_id, h, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the cutoff of each
    rule in the document's stratum (max_*, null where none is proved): a row for each of docs.

    A null text counts as empty (no words, so base_failed). A null or missing lang is a stratum of its own. A null
    doc_id has no label. Repeated rows are judged alike, each once. Without labels every cutoff is open and only the
    base rules reject. Empty tables give an empty result; other columns are ignored.
    """
    rules = rules or RULES
    measures = stored(measured(docs), "measures")
    at = cutoffs(measures, labels, alpha, delta, rules).select(F.col("lang").alias("stratum"), *[F.col(r).alias(f"max_{r}") for r in rules])
    both = measures.join(F.broadcast(at) if _small(at) else at, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    over = F.lit(False)
    for r in rules:
        over = over | F.coalesce(F.col(r) > F.col(f"max_{r}"), F.lit(False))
    return both.select("doc_id", "h", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~over).alias("kept"), *[f"max_{r}" for r in rules])


def _small(strata: DataFrame, most: int = 10_000) -> bool:
    """Whether there are few enough strata to send them to every task."""
    return strata.limit(most + 1).count() <= most


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that judged() keeps, with all their columns."""
    kept = judged(docs, labels, **options).filter("kept").select(F.col("doc_id").alias("id"), "h").distinct()
    cond = F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("h"))
    return boxed(docs).join(kept, cond, "left_semi").select("row.*")


QUALITY_SQL = """
with d as (select doc_id, lang, coalesce(text, '') as text from documents),
good as (select doc_id from labels where quality is not null and doc_id is not null group by 1 having min(quality) = 1 and max(quality) = 1),
w as (select doc_id, lang, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from d),
win as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from win) where n > 1),
cov as (select doc_id, sum(least(8, coalesce(nxt - i, 8)))::bigint as r from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from rep) group by 1),
m as (select w.doc_id, lang, sha256(text) as h, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
        coalesce(r, 0)::bigint as n_repeat_words, length(regexp_replace(text, '[^\\p{Lu}]', '', 'g'))::bigint as n_upper, len(ls)::bigint as n_lines
      from w left join cov using (doc_id)),
f as (select *, coalesce(n_symbols / nullif(word_chars, 0), 0.0) as symbol_share, coalesce(n_upper / nullif(word_chars, 0), 0.0) as upper_share,
        coalesce(n_dup_lines / nullif(n_lines, 0), 0.0) as dup_line_share, coalesce(n_repeat_words / nullif(n_words, 0), 0.0) as repeat_share,
        n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m),
grid as (@GRID@),
held as (select distinct f.lang, f.h, symbol_share, upper_share, dup_line_share, repeat_share from f join good using (doc_id) where not base_failed),
size as (select lang, count(*) as n, count(*) over () as strata from held group by lang),
fails as (select h.lang, g.rule, g.pos, g.cut, count(*) filter (case g.rule when 'symbol_share' then symbol_share when 'upper_share' then upper_share when 'dup_line_share' then dup_line_share else repeat_share end > g.cut) as k
      from held h cross join grid g group by all),
tail as (select f.lang, rule, pos, cut, case when k >= n * @P@ then 1.0 else
        list_sum(list_transform(range(0, k + 1), lambda j: exp((case when n = 0 then 0 else lgamma(n + 1) end) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(@P@) + (n - j) * ln(1 - @P@)))) end <= @D@ / strata as ok
      from fails f join size s on s.lang is not distinct from f.lang),
best as (select lang, rule, min(cut) as cut from tail t where not exists (select 1 from tail u where u.lang is not distinct from t.lang and u.rule = t.rule and u.pos <= t.pos and not u.ok) group by 1, 2),
wide as (select lang, @WIDE@ from best group by 1)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not exists (select 1 from best b where b.lang is not distinct from f.lang and
    case b.rule when 'symbol_share' then symbol_share when 'upper_share' then upper_share when 'dup_line_share' then dup_line_share else repeat_share end > b.cut) as kept, @CUTS@
from f left join wide on wide.lang is not distinct from f.lang
"""


def quality_sql(alpha: float = 0.01, delta: float = 0.05) -> str:
    """judged() over the tables documents and labels, for DuckDB."""
    grid = " union all ".join(f"select '{r}' as rule, {i} as pos, {c!r}::double as cut" for r, cs in RULES.items() for i, c in enumerate(cs))
    wide, cuts = ", ".join(f"max(cut) filter (rule = '{r}') as max_{r}" for r in RULES), ", ".join(f"max_{r}" for r in RULES)
    return QUALITY_SQL.replace("@WIDE@", wide).replace("@CUTS@", cuts).replace("@GRID@", grid).replace("@P@", f"{alpha / len(RULES)!r}::double").replace("@D@", f"{delta / len(RULES)!r}::double")
