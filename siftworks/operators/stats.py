"""Counts, status tables, gates, budgets and set comparisons over evidence tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftworks.functions.text import wilson_lower
from siftworks.sources.tables import stored

ALL_LANGUAGES = ("java", "javascript", "python", "rust")


def counts_by(key: str, **tables: DataFrame) -> DataFrame:
    """key and one count column for each table, zero where a table has no row of the key."""
    parts = [df.groupBy(key).agg(F.count("*").alias("n")).withColumn("what", F.lit(name)) for name, df in tables.items()]
    one = reduce(DataFrame.unionByName, parts)
    return one.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), F.lit(0)).alias(name) for name in tables])


def language_status(coverage: DataFrame, languages: tuple[str, ...] = ALL_LANGUAGES) -> DataFrame:
    """Coverage rows by state for each language, all languages present."""
    spark = coverage.sparkSession
    every = spark.createDataFrame([(x,) for x in languages], "language string")
    got = coverage.groupBy("language").agg(F.count_if("selected").alias("selected"), *[F.count_if(F.col("state") == s).alias(s) for s in ("complete", "partial", "failed")], F.count_if(~F.col("selected")).alias("unselected"))
    return every.join(got, "language", "left").fillna(0)


def floor_violations(counts: DataFrame, floors: dict[str, int], key: str) -> DataFrame:
    """key, metric, value, floor of counts below their floor."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("long").alias("value"), F.lit(v).cast("long").alias("floor")) for k, v in floors.items()])
    return counts.select(key, F.inline(pairs)).filter("value < floor")


def qualification(outcomes: DataFrame, keys: list[str], correct: Column, floor: float, least: int = 1000) -> DataFrame:
    """keys, n, correct, lower, status: notMeasured below `least` outcomes, else passed or failed by the lower bound."""
    one = outcomes.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(correct).alias("correct")).withColumn("lower", wilson_lower(F.col("correct"), F.col("n")))
    return one.withColumn("status", F.when(F.col("n") < least, "notMeasured").when(F.col("lower") >= floor, "passed").otherwise("failed"))


def latency_summary(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Nearest-rank median, p95 and p99, and the count of values; null where a key has none."""
    places = {"median": 50, "p95": 95, "p99": 99}
    counts = samples.groupBy(*keys).agg(F.count(value).alias("n"))
    found = exact_percentiles(samples.filter(F.col(value).isNotNull()), keys, value, list(places.values()))
    wide = found.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*[F.max(F.when(F.col("percent") == p, F.col("value"))).alias(c) for c, p in places.items()])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return counts.join(wide, same, "left").select(*keys, "n", *places)


def located(ranged: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _p, _before, _here, _all: of each range of a key how many of its rows are in earlier ranges, in this one, and
    in all; a row for each range."""
    per = ranged.groupBy(*keys, "_p").agg(F.count("*").alias("_here"))
    w = Window.partitionBy(*keys)
    before = F.sum("_here").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    return per.withColumns({"_before": F.coalesce(before, F.lit(0).cast("long")), "_all": F.sum("_here").over(w)})


def _in_ranges(ranged: DataFrame, hits: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows of the ranges in hits, with the columns of hits."""
    named = hits.select(F.col("_p").alias("_hp"), *[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], *[c for c in hits.columns if c not in (*keys, "_p")])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)], F.col("_p") == F.col("_hp"))
    joined = ranged.join(named, same, how)
    return joined if how == "left_semi" else joined.drop("_hp", *[f"_h{i}" for i in range(len(keys))])


def exact_percentiles(df: DataFrame, keys: list[str], value: str, percents: list[int], parts: int | None = None) -> DataFrame:
    """keys, percent, value: the value of nearest rank, the least that at least `percent` of 100 of a key's rows reach.

    Values are dealt out in sorted ranges. The ranges' sizes tell which of them holds a rank, and only those are sorted
    and numbered, each by itself, so no task holds a key's rows, and of a hot key a few ranges are read again."""
    ranged = ranges(df.select(*keys, value), keys, [value], parts)
    ranks = F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), F.greatest(F.floor((F.col("_all") * p + 99) / 100), F.lit(1)).alias("rank")) for p in percents]))
    hits = located(ranged, keys).select(*keys, "_p", "_before", "_here", ranks.alias("_r")).filter("_r.rank > _before and _r.rank <= _before + _here")
    hits = stored(hits.select(*keys, "_p", F.col("_r.percent").alias("percent"), (F.col("_r.rank") - F.col("_before")).alias("_local")), "percentile-ranges")
    rows = _in_ranges(ranged, hits.select(*keys, "_p").distinct(), keys, "left_semi")
    placed = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(value)))
    return _in_ranges(placed, hits, keys).filter("_n = _local").select(*keys, "percent", F.col(value).alias("value"))


#: Metric kinds and by how much they may change: positive for at most, negative for at least.
REGRESSION_LIMITS = {"query": 0.15, "index": 0.15, "rss": 0.10, "storage": 0.10, "throughput": -0.10}


def regressions(current: DataFrame, base: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    """keys, kind, change, regressed: relative change against the baseline of the same keys; from a baseline of zero
    any growth regresses, except of throughput."""
    j = current.select(*keys, kind, F.col("value").alias("cur")).join(base.select(*keys, kind, F.col("value").alias("old")), [*keys, kind])
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in REGRESSION_LIMITS.items() for x in kv]), F.col(kind))
    change = F.when(F.col("old") != 0, (F.col("cur") - F.col("old")) / F.col("old"))
    bad = F.when(F.col("old") == 0, (limit > 0) & (F.col("cur") > 0)).otherwise(F.when(limit > 0, change > limit).otherwise(change < limit))
    return j.select(*keys, kind, change.alias("change"), bad.alias("regressed"))


def agreement(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """label_a, label_b, n over the candidates that both selectors judged."""
    j = a.select(key, F.col(label).alias("label_a")).join(b.select(key, F.col(label).alias("label_b")), key)
    return j.groupBy("label_a", "label_b").agg(F.count("*").alias("n"))


def cap_warnings(warnings: DataFrame, keys: list[str], order: str, message: str, most: int = 100) -> DataFrame:
    """The first `most` distinct messages of each key in order."""
    first = warnings.groupBy(*keys, message).agg(F.min(order).alias(order))
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order, message))).filter(F.col("_r") <= most).drop("_r")


def classify_age(df: DataFrame, now: Column, at: str, day: int = 86_400) -> DataFrame:
    """Adds age_class: unknown for a missing or non-positive time or one in the future, eligible from 30 days, recent."""
    age = now - F.col(at)
    return df.withColumn("age_class", F.when(F.col(at).isNull() | (F.col(at) <= 0) | (age < 0), "unknown").when(age >= 30 * day, "eligible").otherwise("recent"))


# --- budgets ---------------------------------------------------------------------------------------------------------


def ranges(df: DataFrame, keys: list[str], order: list[str | Column], parts: int | None = None) -> DataFrame:
    """df in ranges of keys and order, with the range's number as _p: a hot key is dealt out over many of them.

    Written, so that whatever reads it sees the same ranges even if tasks are run again."""
    by = [*keys, *order]
    dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return stored(dealt.withColumn("_p", F.spark_partition_id()), "ranged")


def with_earlier(ranged: DataFrame, keys: list[str], fold: Callable[[Column], Column], **of: str) -> DataFrame:
    """ranged with columns that hold fold (a sum or a maximum) of a key's rows in all earlier ranges; null without any.

    Only the first key of a range can have begun in an earlier one, so a row for each range is broadcast, no more."""
    w = Window.partitionBy(*keys).orderBy("_p")
    per = ranged.groupBy(*keys, "_p").agg(*[fold(F.col(c)).alias(n) for n, c in of.items()])
    before = {n: fold(F.col(n)).over(w.rowsBetween(Window.unboundedPreceding, -1)) for n in of}
    first = per.withColumns({"_n": F.row_number().over(w), **before}).filter("_n > 1")
    base = first.select(F.col("_p").alias("_bp"), *[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], *of)
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_b{i}")) for i, k in enumerate(keys)], F.col("_p") == F.col("_bp"))
    return ranged.join(F.broadcast(base), same, "left").drop("_bp", *[f"_b{i}" for i in range(len(keys))])


def running(df: DataFrame, keys: list[str], order: list[str | Column], parts: int | None = None, **sums: str) -> DataFrame:
    """Adds running sums in order within the keys, over keys of any size: each range of a key sums up by itself, and
    what its earlier ranges sum up to is added."""
    ranged = with_earlier(ranges(df, keys, order, parts), keys, F.sum, **{f"_e_{n}": c for n, c in sums.items()})
    by = Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = {n: F.coalesce(F.sum(c).over(by) + F.coalesce(f"_e_{n}", F.lit(0)), f"_e_{n}") for n, c in sums.items()}
    return ranged.withColumns(here).drop("_p", *[f"_e_{n}" for n in sums])


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str) -> DataFrame:
    """Adds the place of each row in order within the keys, from 1; a key's rows are never in one task."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), keys, order, **{name: "_one"}).drop("_one")


def running_giant(df: DataFrame, order: str, value: str, parts: int = 64) -> DataFrame:
    """Adds running: the sum of value up to each row in order, over one table of any size without keys."""
    return running(df, [], [order], parts, running=value)


def admit_by_budget(files: DataFrame, keys: list[str], path: str, **limits: int) -> DataFrame:
    """Adds admitted: files in order of path while every running sum is within its limit. Running sums never fall, so
    the first overflow stops all later files."""
    sums = {f"_{c}": c for c in limits}
    one = running(files, keys, [path], **sums)
    ok = reduce(lambda a, b: a & b, [F.col(f"_{c}") <= n for c, n in limits.items()])
    return one.withColumn("admitted", ok).drop(*sums)


def admit_details(items: DataFrame, keys: list[str], order: list[str], records: int, text: int) -> DataFrame:
    """Adds kept: items in order while running records and text are within the limits; the first overflow closes
    details for good."""
    one = running(items, keys, order, _r="records", _t="text")
    return one.withColumn("kept", (F.col("_r") <= records) & (F.col("_t") <= text)).drop("_r", "_t")


def fit_bytes(df: DataFrame, keys: list[str], order: list[str], limit: int, *columns: str) -> DataFrame:
    """The longest ordered prefix of each key whose rows as JSON take at most limit bytes."""
    one = df.withColumn("_n", F.octet_length(F.to_json(F.struct(*columns))))
    return running(one, keys, order, _s="_n").filter(F.col("_s") <= limit).drop("_n", "_s")


def supersession(revisions: DataFrame, keys: list[str], order: str, published: str) -> DataFrame:
    """Adds superseded_at: when the next revision was published; null for the head."""
    return revisions.withColumn("superseded_at", F.lead(published).over(Window.partitionBy(*keys).orderBy(order)))


def first_by(df: DataFrame, keys: list[str], order: list[Column | str], k: int = 1) -> DataFrame:
    """The first k rows of each key in order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def aliases(df: DataFrame, keys: list[str], order: list[Column | str], prefix: str = "c", width: int = 3) -> DataFrame:
    """Adds alias: c001, c002, ... in order within the keys."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("string")
    return df.withColumn("alias", F.concat(F.lit(prefix), F.when(F.length(n) < width, F.lpad(n, width, "0")).otherwise(n)))


# --- paging and sets -------------------------------------------------------------------------------------------------


def page(df: DataFrame, keys: list[str], order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit - 1 of each key in order, with next_offset where more rows exist.

    Rows are dealt out in sorted ranges, whose sizes tell which of them a page overlaps; only those are numbered, so
    an offset deep in a key of very many rows reads its own ranges and no task holds the key."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be from 1 to 200, offset not negative")
    ranged = ranges(df, keys, order)
    hits = located(ranged, keys).filter((F.col("_before") < offset + limit) & (F.col("_before") + F.col("_here") > offset)).drop("_here")
    one = _in_ranges(ranged, stored(hits, "page-ranges"), keys)
    placed = one.withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(*order)))
    more = F.when(F.col("_all") > offset + limit, F.lit(offset + limit).cast("long"))
    return placed.filter((F.col("_r") > offset) & (F.col("_r") <= offset + limit)).withColumn("next_offset", more).drop("_r", "_p", "_before", "_all")


def limited(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key, with truncated: whether there was one more."""
    w = Window.partitionBy(*keys)
    one = df.withColumn("_r", F.row_number().over(w.orderBy(*order))).filter(F.col("_r") <= n + 1)
    return one.withColumn("truncated", F.max("_r").over(w) > n).filter(F.col("_r") <= n).drop("_r")


def list_dir(docs: DataFrame, prefix: str) -> DataFrame:
    """kind, name, files one level under a prefix (which ends in / or is empty), directories first, then by name."""
    rest = F.substring("path", F.lit(len(prefix) + 1), F.length("path"))
    one = docs.filter(F.col("path").startswith(prefix)).select(F.split(rest, "/").alias("s"))
    got = one.groupBy(F.when(F.size("s") > 1, "directory").otherwise("file").alias("kind"), F.col("s")[0].alias("name")).agg(F.count("*").alias("files"))
    return got.orderBy(F.col("kind") != "directory", "name")


def same_inventory(a: DataFrame, b: DataFrame, key: str = "path") -> DataFrame:
    """One row: whether the key sets are equal, and how many are in one alone."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, key, "full_outer")
    return j.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b")).withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def decision_gaps(candidates: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """key, problem: unknown (decided, no candidate), duplicate (decided twice or more), missing (not decided)."""
    c, d = candidates.select(key).distinct(), decisions.groupBy(key).agg(F.count("*").alias("n"))
    j = c.withColumn("_c", F.lit(1)).join(d, key, "full_outer")
    problem = F.when(F.col("_c").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate")
    return j.select(key, problem.alias("problem")).filter("problem is not null")


def union_evidence(*tables: DataFrame, key: list[str]) -> DataFrame:
    """Rows of all tables, one for each key."""
    return reduce(DataFrame.unionByName, tables).dropDuplicates(key)


def role_violations(coverage: DataFrame) -> DataFrame:
    """Rows where observed roles aren't supported, or supported ones not applicable."""
    return coverage.filter((F.size(F.array_except("observed", "supported")) > 0) | (F.size(F.array_except("supported", "applicable")) > 0))


def coverage_state(requested: Column, ran: Column, supported: Column, failed: Column, missing: Column) -> Column:
    """State in fixed order: notRequested, omitted, unsupported, failed, partial, complete."""
    return F.when(~requested, "notRequested").when(~ran, "omitted").when(~supported, "unsupported").when(failed, "failed").when(missing > 0, "partial").otherwise("complete")


def reject_artifacts(df: DataFrame, violations: DataFrame, keys: list[str]) -> DataFrame:
    """df without any row of a producer and revision that has a violation."""
    return df.join(violations.select(*keys).distinct(), keys, "left_anti")


def violations(rules: dict[str, DataFrame]) -> DataFrame:
    """rule, id of all rows that break a rule; each table holds (id) of what breaks it."""
    parts = [df.select(F.lit(name).alias("rule"), F.col("id").cast("string").alias("id")) for name, df in rules.items()]
    return reduce(DataFrame.unionByName, parts)


def projection_parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of one table that the other lacks, counting repeats, both ways."""
    cols = sorted(a.columns)
    one = a.select(*cols, F.lit(1).alias("_n")).unionAll(b.select(*cols, F.lit(-1).alias("_n"))).groupBy(*cols).agg(F.sum("_n").alias("d"))
    return one.agg(F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("only_b"))
