"""Line dedup: a suffix array over the documents' line-ID sequences, by distributed prefix doubling, and its intervals.

A suffix of a document is the sequence of its line IDs from one line on. Line IDs are ranks: all lines are sorted once
in ranges, and lines that stand only once go. Prefix doubling then ranks suffixes by their first 2, 4, ... lines: the
pair of a suffix's rank and the rank of the suffix `depth` lines on is sorted in ranges again, places breaking ties, so
that a line or passage which very many documents share is dealt over many tasks. A rank is the place of the first equal
pair; what crosses the edge of a range is settled from one row for each range.

The last sort is the suffix array. The longest common prefix of neighbours is taken from the line IDs that doubling
brought along; the suffixes between two values below d are the interval of the runs of d lines. In every interval all
suffixes but the earliest start a later copy, so the longest repeated run at a suffix is the deepest interval in which
it isn't the earliest.

Doubling stops at the first depth of min_words lines or more. That loses nothing: every line has a word, so each run of
that many lines counts, and a longer run is the union of the runs of that depth inside of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, doc_text, stored

_HAS_WORD = r"[^ \t\n\x0B\f\r]"
#: A suffix: the document (rows that share a doc_id are told apart by a hash of their texts) and the number of its line.
PLACE = ("doc_id", "t", "p")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(_HAS_WORD))


def _words(line: Column) -> Column:
    return F.size(F.array_remove(F.split(line, r"[ \t\n\x0B\f\r]+"), ""))


# --- ranks -----------------------------------------------------------------------------------------------------------


def _differ(a: pa.RecordBatch, names: tuple[str, ...], last: tuple | None) -> np.ndarray:
    """Which rows differ from the row before in the named columns; last: those of the row before the batch."""
    new = np.zeros(a.num_rows, bool)
    for k, n in enumerate(names):
        v = a.column(n).to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
        new[0] |= last is None or v[0] != last[k]
    return new


def _last(a: pa.RecordBatch, names: tuple[str, ...]) -> tuple:
    return tuple(a.column(n)[a.num_rows - 1].as_py() for n in names)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of a, b and place: without repeated rows, each with its range, its number there, the number
    of the first row with its a and b, and whether it is the only one. Holds one batch."""
    from pyspark import TaskContext

    part, at, head = TaskContext.get().partitionId(), 0, 0
    pair, place = ("a", "b"), ("a", "b", *PLACE)
    held, last = None, None

    def out(batch, idx, heads, alone):
        cols = [*batch.columns, pa.array(np.full(len(idx), part, np.int64)), pa.array(idx), pa.array(heads), pa.array(alone)]
        return pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "part", "idx", "head", "alone"])

    for batch in batches:
        batch = batch.filter(pa.array(_differ(batch, place, last))) if batch.num_rows else batch
        n = batch.num_rows
        if not n:
            continue
        new = _differ(batch, pair, last and last[:2])
        idx = at + np.arange(n)
        heads = np.maximum.accumulate(np.where(new, idx, head))
        alone = new.copy()
        alone[:-1] &= new[1:]
        if held is not None:
            held[3][-1] &= new[0]  # the row before: alone only if this batch starts a new class
            yield out(*held)
        held, last, at, head = (batch, idx, heads, alone), _last(batch, place), at + n, int(heads[-1])
    if held is not None:
        yield out(*held)


def _in_ranges(df: DataFrame) -> DataFrame:
    keys = ("a", "b", *PLACE)
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _ranked(df: DataFrame) -> DataFrame:
    """df (a, b, place, ...) with rank, the number of the first row of its a and b in the order of all rows, and many,
    whether it has others beside it, instead of a and b. Rows that repeat a place go."""
    spec = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    rows = stored(_in_ranges(df).mapInArrow(_classes, f"{spec}, part long, idx long, head long, alone boolean"), "ranks")
    pair = F.struct("a", "b")
    edges = rows.groupBy("part").agg(F.count("*").alias("n"), F.min_by(pair, "idx").alias("first"), F.max_by(pair, "idx").alias("last"), F.max("head").alias("tail"))
    plan, base, open_pair, open_rank = [], 0, None, None
    for e in sorted(edges.collect(), key=lambda r: r["part"]):  # a row for each range
        carry = open_rank if e["first"] == open_pair else None
        if carry is not None:
            plan[-1][4] = True
        plan.append([e["part"], base, carry, e["tail"], False])
        if e["tail"] or carry is None:
            open_rank = base + e["tail"]
        open_pair, base = e["last"], base + e["n"]
    ranges = F.broadcast(df.sparkSession.createDataFrame(plan, "part long, base long, carry long, tail long, more boolean"))
    goes_on = (F.col("head") == 0) & F.col("carry").isNotNull()
    both = rows.join(ranges, "part").withColumn("rank", F.when(goes_on, F.col("carry")).otherwise(F.col("base") + F.col("head")))
    many = ~F.col("alone") | goes_on | ((F.col("head") == F.col("tail")) & F.col("more"))
    return both.withColumn("many", many).drop("part", "idx", "head", "alone", "base", "carry", "tail", "more", "a", "b")


# --- intervals -------------------------------------------------------------------------------------------------------


def _intervals(depth: int):
    """From the suffix array's rows in order: place, w, the longest run at it that starts earlier in this range (n),
    and how many lines it shares with the range's first and last row. Rows that share nothing go, but for those two.

    Holds a range's places and common prefixes, some 40 bytes for each suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows, common, before = [], [], None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = batch.column("ids")
            size = np.diff(np.asarray(col.offsets))
            ids = np.full((n + 1, depth), -1, np.int64)
            ids[1:][np.arange(depth) < size[:, None]] = np.asarray(col.flatten())
            if before is not None:
                ids[0] = before
            same = (ids[1:] == ids[:-1]) & (ids[1:] >= 0)
            common.append(np.cumprod(same, axis=1).sum(axis=1))
            before = ids[-1]
            rows.append(batch)
        if not rows:
            return
        doc, t, p = (np.concatenate([b.column(c).to_numpy() for b in rows]) for c in PLACE)
        lcp = np.concatenate(common)
        lcp[0] = -1
        n = len(lcp)
        order = np.empty(n, np.int64)
        order[np.lexsort((p, t, doc))] = np.arange(n)
        longest = np.zeros(n, np.int32)
        for d in range(1, depth + 1):
            starts = np.flatnonzero(lcp < d)
            longest[order > np.repeat(np.minimum.reduceat(order, starts), np.diff(np.append(starts, n)))] = d
        left, right = np.full(n, depth), np.full(n, depth)
        left[1:] = np.minimum.accumulate(lcp[1:])
        right[:-1] = np.minimum.accumulate(lcp[:0:-1])[::-1]
        part, at = TaskContext.get().partitionId(), 0
        for b in rows:
            i = np.arange(at, at + b.num_rows)
            at += b.num_rows
            keep = (longest[i] > 0) | (left[i] > 0) | (right[i] > 0)
            i, b = i[keep], b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in (*PLACE, "w", "ids")), pa.array(longest[i]), pa.array(left[i].astype(np.int32)), pa.array(right[i].astype(np.int32)), pa.array(np.full(len(i), part, np.int64)), pa.array(i)],
                [*PLACE, "w", "ids", "n", "l", "r", "part", "idx"],
            )

    return run


def _common(a: list[int], b: list[int]) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _longest(suffixes: DataFrame, depth: int) -> DataFrame:
    """place, w, n: how many lines the longest run at the place has that also starts earlier, up to depth lines."""
    schema = "doc_id long, t long, p int, w array<int>, ids array<long>, n int, l int, r int, part long, idx long"
    rows = stored(_in_ranges(suffixes).mapInArrow(_intervals(depth), schema), "intervals")
    place = F.struct(*PLACE)
    least = [F.min(F.when(F.col(side) >= d, place)).alias(f"{side}{d}") for side in "lr" for d in range(1, depth + 1)]
    edges = rows.groupBy("part").agg(F.min_by("ids", "idx").alias("first"), F.max_by("ids", "idx").alias("last"), F.min_by("r", "idx").alias("through"), *least)
    ranges = sorted(edges.collect(), key=lambda r: r["part"])  # a row for each range

    def carried(order: list, side: str, near: str, far: str) -> dict[int, list]:
        """For each range and d the earliest place of the ranges before it, in its edge's interval of d lines."""
        out, open_, ids = {}, [None] * depth, []
        for e in order:
            reach = _common(ids, e[near])
            here = [x if d < reach else None for d, x in enumerate(open_)]
            out[e["part"]] = here
            through = [x if e["through"] > d else None for d, x in enumerate(here)]
            own = [e[f"{side}{d}"] for d in range(1, depth + 1)]
            open_ = [min((tuple(x) for x in (a, b) if x is not None), default=None) for a, b in zip(own, through, strict=True)]
            ids = e[far]
        return out

    lower, upper = carried(ranges, "r", "first", "last"), carried(ranges[::-1], "l", "last", "first")
    spot = "array<struct<doc_id: long, t: long, p: int>>"
    beside = F.broadcast(suffixes.sparkSession.createDataFrame([(e["part"], lower[e["part"]], upper[e["part"]]) for e in ranges], f"part long, lower {spot}, upper {spot}"))
    longest = F.col("n")
    for d in range(1, depth + 1):
        for side, other in (("l", "lower"), ("r", "upper")):
            longest = F.greatest(longest, F.when((F.col(side) >= d) & (F.get(other, F.lit(d - 1)) < place), d))
    return rows.join(beside, "part").select(*PLACE, "w", longest.alias("n")).filter("n > 0")


def repeated_runs(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """doc_id, t, p, n: runs of n lines from the document's p-th line with a word on, that also start earlier and have
    min_words words or more. t is xxhash64 of the text. Runs may overlap; see drop_repeated_lines."""
    if min_words < 1:
        raise ValueError("min_words must be 1 or more")
    depth = 1 << (min_words - 1).bit_length()
    one = doc_text(docs, F.xxhash64("text").alias("t")).filter("doc_id is not null")
    split = one.select("doc_id", "t", F.posexplode(_lines(F.col("text"))).alias("p", "line"))
    names = split.select(*PLACE, F.xxhash64("line").alias("a"), F.xxhash64("line", F.lit(7)).alias("b"), F.array(_words(F.col("line"))).alias("w"))
    level = _ranked(stored(names, "lines")).filter("many").select(*PLACE, "w", "rank", F.array("rank").alias("ids"))
    have = 1
    while True:
        level = stored(level, "suffixes")
        if have < depth:
            ahead = level.select("doc_id", "t", (F.col("p") - have).alias("p"), F.col("rank").alias("next"), F.col("ids").alias("more"), F.col("w").alias("v"))
            # a suffix that ends or meets a line without copies goes no further
            both = level.alias("s").join(ahead.alias("q"), [F.col(f"s.{c}") == F.col(f"q.{c}") for c in PLACE] + [F.size("s.ids") == have], "left").select("s.*", "next", "more", "v")
            longer = lambda a, b, kind: F.concat(a, F.coalesce(b, F.array().cast(kind)))
            level = both.select(*PLACE, longer("w", F.col("v"), "array<int>").alias("w"), longer("ids", F.col("more"), "array<long>").alias("ids"), F.col("rank").alias("a"), F.coalesce("next", F.lit(-1)).alias("b"))
        else:
            level = level.select(*PLACE, "w", "ids", F.col("rank").alias("a"), F.lit(-1).cast("long").alias("b"))
        have *= 2
        if have >= depth:
            break
        level = _ranked(level).select(*PLACE, "w", "rank", "ids")
    words = F.aggregate(F.slice("w", F.lit(1), F.col("n")), F.lit(0), lambda a, x: a + x)
    return _longest(level, depth).filter(words >= min_words).select(*PLACE, "n")


def drop_repeated_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """doc_id, n_lines, n_deleted, kept_text for each row of docs (doc_id, text, ...).

    Lines are the text split at LF; lines without a word are not counted in runs and never deleted. A line is deleted
    if it is in a run of one or more lines (the same whole lines, min_words words or more together) that also starts
    earlier: in a document of smaller doc_id, or before it in the same one, both as given.

    A null text has no lines and stays null. Rows with a null doc_id take no part. Rows that share a doc_id and have
    different texts are different documents, in order of xxhash64 of the text; rows that repeat both are one document,
    and each gets its result. An empty table gives an empty result; other columns are ignored.
    """
    rows = _with_runs(docs, min_words)
    text = F.col("row.text")
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).cast("long")
    gone = _gone(F.col("runs"))
    return rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), n_lines.alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_deleted"), _kept(text, gone).alias("kept_text"))


def without_repeated_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """docs with the texts of drop_repeated_lines() and all other columns as they are; rows that lose all their words
    are dropped, as everything they say stands in earlier rows."""
    rows = _with_runs(docs, min_words).withColumn("kept", _kept(F.col("row.text"), _gone(F.col("runs"))))
    rows = rows.filter(F.col("runs").isNull() | F.col("kept").rlike(_HAS_WORD))
    return rows.select(*[F.col("kept").alias(c) if c.lower() == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def _with_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """row (all columns of docs), runs (null where nothing repeats)."""
    runs = repeated_runs(docs, min_words).groupBy(F.col("doc_id").alias("id"), F.col("t").alias("h")).agg(F.collect_list(F.struct("p", "n")).alias("runs"))
    # doc_text() reads a null text as empty, which has no runs either
    return boxed(docs).join(runs, (F.col("row.doc_id").cast("long") == F.col("id")) & (F.xxhash64("row.text") == F.col("h")), "left").select("row", "runs")


def _gone(runs: Column) -> Column:
    """Numbers of the lines with a word that runs cover."""
    return F.array_distinct(F.flatten(F.transform(runs, lambda s: F.sequence(s["p"], s["p"] + s["n"] - 1))))


def _kept(text: Column, gone: Column) -> Column:
    """text without the lines whose numbers among the lines with a word are in gone, which may be null."""
    one = F.struct(F.split(text, "\n").alias("l"), gone.alias("g"))

    def numbered(s: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(s["l"]) - 1)
        return F.struct(s["l"].alias("l"), s["g"].alias("g"), every.alias("e"), F.filter(every, lambda i: F.get(s["l"], i).rlike(_HAS_WORD)).alias("w"))

    def left(s: Column) -> Column:
        # numbers of lines to keep, by a hash set rather than a search for each line
        return F.struct(s["l"].alias("l"), F.array_except(s["e"], F.transform(s["g"], lambda i: F.get(s["w"], i))).alias("k"))

    kept = F.transform(F.transform(F.transform(F.array(one), numbered), left), lambda s: F.array_join(F.transform(s["k"], lambda i: F.get(s["l"], i)), "\n"))[0]
    return F.when(gone.isNull() | text.isNull(), text).otherwise(kept)
