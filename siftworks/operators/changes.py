"""Revisions: change classes, drift, surfaces, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftworks.sources.tables import stored

from .stats import supersession

#: How long a superseded revision stays readable.
GRACE_SECONDS = 15 * 60


def classify_change(diff: DataFrame, options: Column | None = None, inputs: Column | None = None, unproved: Column | None = None) -> DataFrame:
    """class, reason, inv, changed, document of a diff (path, change): full for other options, inputs, inventory or
    languages, several changed documents or an unproved one, in that order; else unchanged or documentLocal. document
    is the changed one where there is one alone; the paths of many are the diff's own rows (changed_files)."""
    n = diff.agg(F.count_if(F.col("change").isin("added", "removed")).alias("inv"), F.count_if(F.col("change") == "languageChanged").alias("lang"), F.count_if(F.col("change") == "changed").alias("changed"), F.max(F.when(F.col("change") == "changed", F.col("path"))).alias("last"))
    no = F.lit(False)
    reason = (
        F.when(options if options is not None else no, "options").when(inputs if inputs is not None else no, "inputs").when(F.col("inv") > 0, "inventory").when(F.col("lang") > 0, "language")
        .when(F.col("changed") > 1, "severalChanged").when((F.col("changed") == 1) & (unproved if unproved is not None else no), "unproved")
    )
    cls = F.when(reason.isNotNull(), "full").when(F.col("changed") == 0, "unchanged").otherwise("documentLocal")
    return n.select(cls.alias("class"), reason.alias("reason"), "inv", "changed", F.when(F.col("changed") == 1, F.col("last")).alias("document"))


def changed_files(diff: DataFrame) -> DataFrame:
    """path of each changed document of a diff (path, change)."""
    return diff.filter("change = 'changed'").select("path")


def surface_equal(prev: DataFrame, cur: DataFrame, key: str, surface: list[str]) -> DataFrame:
    """key, equal: whether a document's declarations, headers and calls are the same but for their places."""
    one = lambda df, name: df.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", *[F.col(c).cast("string") for c in surface]))), "\n"), 256).alias(name))
    return one(prev, "_a").join(one(cur, "_b"), key, "full_outer").select(key, F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("equal"))


def stat_drift(old: DataFrame, new: DataFrame, key: str = "path", stats: tuple[str, ...] = ("size", "mtime", "inode")) -> DataFrame:
    """key, reread: whether a file's stat differs or is new; files that are gone aren't listed."""
    o = old.select(key, F.struct(*stats).alias("_o"))
    return new.select(key, F.struct(*stats).alias("_n")).join(o, key, "left").select(key, (~F.col("_n").eqNullSafe(F.col("_o"))).alias("reread"))


def expired(revisions: DataFrame, now: Column, keys: list[str], order: str = "revision", published: str = "published_at") -> DataFrame:
    """Revisions to release: superseded for GRACE_SECONDS or longer; a head never is."""
    r = supersession(revisions, keys, order, published)
    return r.filter(F.col("superseded_at").isNotNull() & (F.col("superseded_at") + GRACE_SECONDS <= now))


_CHANGE = ("language", "declarations", "headers", "outside", "bodies", "text", "facts")


def body_only(old_docs: DataFrame, new_docs: DataFrame, old_decls: DataFrame, new_decls: DataFrame, old_facts: DataFrame, new_facts: DataFrame) -> DataFrame:
    """path, proved, reason, owner, growth of each document whose text changed between two revisions: whether all that
    changed is the body of one callable, so that nothing outside this document needs to be derived again.

    docs: path, language, bytes. decls: path, key (unique in its document), kind, header (all of a declaration but its
    body and its place), start, end, body_start, body_end (null without a body). facts: path, fact (all but its place),
    start, end.

    Declarations are matched by key, and must all be there with the same kind and header. Of the bodies that differ the
    innermost is the changed one; all others must contain it. The revisions are then aligned by its growth: what ends
    before the body stays, what begins behind it moves, what contains it grows, and facts inside it are its own. All
    facts outside must be equal after that, and so must the bytes before and behind the body.

    reason is the first that fails: language, declarations (one is new, gone or of another kind), headers, outside (no
    body differs), bodies (several do), text (bytes outside differ), facts (a fact outside is new, gone or moved by
    another distance; so is a declaration's own range). owner and growth tell which body changed and by how many bytes. Documents of one revision alone
    and unchanged ones aren't listed."""
    pair = old_docs.select("path", F.col("language").alias("_lo"), F.col("bytes").alias("_bo")).join(new_docs.select("path", F.col("language").alias("_ln"), F.col("bytes").alias("_bn")), "path").filter("_bo <> _bn")
    docs = stored(pair, "changed-documents")
    columns = ["kind", "header", "start", "end", "body_start", "body_end"]
    side = lambda df, s: df.join(docs.select("path"), "path", "left_semi").select("path", "key", F.lit(True).alias(f"_is{s}"), *[F.col(c).alias(f"{c}{s}") for c in columns])
    both = side(old_decls, "0").join(side(new_decls, "1"), ["path", "key"], "full_outer")
    cut = lambda c, s: F.substring(c, (F.col(f"body_start{s}") + 1).cast("int"), (F.col(f"body_end{s}") - F.col(f"body_start{s}")).cast("int"))
    known = both.join(docs.select("path", "_bo", "_bn"), "path")
    differs = F.col("body_start0").isNotNull() & F.col("body_start1").isNotNull() & (cut("_bo", "0") != cut("_bn", "1"))
    judged = stored(known.select("path", "key", *[f"{c}{s}" for s in "01" for c in ("body_start", "body_end")], (F.col("_is0").isNull() | F.col("_is1").isNull() | ~F.col("kind0").eqNullSafe(F.col("kind1"))).alias("_gone"), (~F.col("header0").eqNullSafe(F.col("header1")) | (F.col("body_start0").isNull() != F.col("body_start1").isNull())).alias("_header"), F.coalesce(differs, F.lit(False)).alias("_differs")), "paired-declarations")
    place = F.struct(F.col("body_end0") - F.col("body_start0"), F.col("body_start0"), F.col("key"))
    found = F.struct(F.col("key").alias("owner"), *[F.col(f"{c}{s}") for s in "01" for c in ("body_start", "body_end")])
    one = judged.groupBy("path").agg(F.bool_or("_gone").alias("_gone"), F.bool_or("_header").alias("_header"), F.count_if("_differs").alias("_n"), F.min_by(found, F.when(F.col("_differs"), place)).alias("_body"))
    one = one.withColumn("_body", F.when(F.col("_n") > 0, F.col("_body")))
    body = one.select("path", "_body.*").filter("owner is not null")
    apart = judged.filter("_differs").join(body.select("path", *[F.col(f"body_{c}0").alias(f"_{c}") for c in ("start", "end")]), "path").filter("body_start0 > _start or body_end0 < _end").select("path").distinct().withColumn("_apart", F.lit(True))
    edges = body.select("path", *[F.col(f"{c}{s}").alias(f"_{n}{s}") for s in "01" for c, n in (("body_start", "b"), ("body_end", "e"))])
    growth = (F.col("_e1") - F.col("_b1")) - (F.col("_e0") - F.col("_b0"))

    def outside(df: DataFrame, s: str, sign: int) -> DataFrame:
        """Facts that aren't inside the body, old ones with the place that they should have now."""
        b, e = F.col(f"_b{s}"), F.col(f"_e{s}")
        joined = df.join(edges, "path").filter(~((F.col("start") >= b) & (F.col("end") <= e)))
        if s == "1":
            return joined.select("path", "fact", "start", "end", F.lit(sign).alias("_n"))
        # where the body was empty, what ends there stands before it, but for the declarations that have it
        holds = F.coalesce((F.col("_from") <= b) & (F.col("_to") >= e), F.lit(False))
        grows = (F.col("end") > e) | (F.col("end") == e) & ((b < e) | holds)
        end = F.when(grows, F.col("end") + growth).otherwise(F.col("end"))
        return joined.select("path", "fact", F.when(F.col("start") >= e, F.col("start") + growth).otherwise(F.col("start")).alias("start"), end.alias("end"), F.lit(sign).alias("_n"))

    none = F.lit(None).cast("long")
    with_decls = lambda facts, decls: facts.select("path", "fact", "start", "end", none.alias("_from"), none.alias("_to")).unionByName(decls.select("path", F.concat(F.lit("declaration "), "key").alias("fact"), "start", "end", F.col("body_start").alias("_from"), F.col("body_end").alias("_to")))
    odd = outside(with_decls(old_facts, old_decls), "0", -1).unionByName(outside(with_decls(new_facts, new_decls), "1", 1)).groupBy("path", "fact", "start", "end").agg(F.sum("_n").alias("_n")).filter("_n <> 0").select("path").distinct().withColumn("_odd", F.lit(True))
    head = lambda c, s: F.sha2(F.substring(c, F.lit(1), F.col(f"body_start{s}").cast("int")), 256)
    tail = lambda c, s: F.sha2(F.substring(c, (F.col(f"body_end{s}") + 1).cast("int"), F.greatest(F.octet_length(c) - F.col(f"body_end{s}"), F.lit(0)).cast("int")), 256)
    joined = docs.join(one, "path", "left").join(apart, "path", "left").join(odd, "path", "left").select("*", "_body.*")
    same_text = (head("_bo", "0") == head("_bn", "1")) & (tail("_bo", "0") == tail("_bn", "1"))
    fails = [~F.col("_lo").eqNullSafe(F.col("_ln")), F.col("_gone"), F.col("_header"), F.coalesce(F.col("_n") == 0, F.lit(True)), F.col("_apart"), ~same_text, F.col("_odd")]
    reason = reduce(lambda w, x: w.when(x[1], x[0]), list(zip(_CHANGE, fails, strict=True))[1:], F.when(fails[0], _CHANGE[0]))
    grown = (F.col("body_end1") - F.col("body_start1")) - (F.col("body_end0") - F.col("body_start0"))
    return joined.select("path", reason.isNull().alias("proved"), reason.alias("reason"), F.when(reason.isNull(), F.col("owner")).alias("owner"), F.when(reason.isNull(), grown).alias("growth"))
