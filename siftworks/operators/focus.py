"""Question focus, selection views, answer checking, and the class and package catalogs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftworks.functions.text import focus_terms, literal_contains, literal_match, probability_status, symbol_contains
from siftworks.sources.tables import stored

from .stats import admit_by_budget, admit_details, numbered, page, running

LABELS = ("essential", "supporting", "incidental", "uncertain")
PACKET_BYTES = 1 << 20


def packets(questions: DataFrame, calls: DataFrame, sources: DataFrame, limit: int = PACKET_BYTES) -> DataFrame:
    """question_id, seed, callable, n_calls, source_bytes, packet_id, fits: what goes with each question. A seed that
    isn't callable carries no calls; a packet of more than limit source bytes doesn't fit.

    questions: question_id, seed, kind, question. calls: owner_id, call_id, path. sources: path, text."""
    own = questions.filter("kind in ('function', 'method')").select("question_id", F.col("seed").alias("owner_id")).join(calls, "owner_id").select("question_id", "call_id", "path")
    n = own.groupBy("question_id").agg(F.count("*").alias("n_calls"), F.sha2(F.array_join(F.array_sort(F.collect_list("call_id")), ","), 256).alias("calls_hash"))
    paths = own.select("question_id", "path").distinct().join(sources, "path")
    size = paths.groupBy("question_id").agg(F.sum(F.octet_length("text")).alias("source_bytes"))
    j = questions.join(n, "question_id", "left").join(size, "question_id", "left").fillna(0, ["n_calls", "source_bytes"])
    pid = F.sha2(F.concat_ws("|", "question_id", "seed", "question", F.coalesce("calls_hash", F.lit(""))), 256)
    return j.select("question_id", "seed", F.col("kind").isin("function", "method").alias("callable"), "n_calls", "source_bytes", pid.alias("packet_id"), (F.col("source_bytes") <= limit).alias("fits"))


def preview(candidates: DataFrame, question: str = "question", terms: str = "terms") -> DataFrame:
    """Adds relevance by literal names alone: essential where a term is in the callee and the call is the seed's own or
    deeper ones are allowed, else supporting; uncertain without a term."""
    t = focus_terms(F.col(question), F.col(terms))
    hit = literal_match(F.col("callee"), t)
    return candidates.withColumn("relevance", F.when(~hit, "uncertain").when(F.col("direct") | F.col("deeper"), "essential").otherwise("supporting"))


def decision_problems(candidates: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, problem: score (outside 0..1), unknown, duplicate, missing."""
    bad = decisions.filter(~F.coalesce(F.col("display_score").between(0, 1), F.lit(True))).select(*keys, F.lit("score").alias("problem")).distinct()
    c = candidates.select(*keys).distinct().withColumn("_c", F.lit(1))
    d = decisions.groupBy(*keys).agg(F.count("*").alias("_n"))
    problem = F.when(F.col("_c").isNull(), "unknown").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate")
    return c.join(d, keys, "full_outer").select(*keys, problem.alias("problem")).filter("problem is not null").unionByName(bad)


def focused_view(calls: DataFrame, packet: str = "packet_id", most: str = "max_visible") -> DataFrame:
    """Visible calls of each packet with their place in source order: essential ones (the seed's own, or deeper if
    allowed), the seed's own first, then by score; ranking chooses them, source order shows them."""
    ok = calls.filter((F.col("relevance") == "essential") & (F.col("direct") | F.col("deeper")))
    src = [F.col("path"), F.col("start"), F.col("end").desc(), F.col("call_id")]
    rank = F.row_number().over(Window.partitionBy(packet).orderBy(~F.col("direct"), F.coalesce("display_score", F.lit(0.0)).desc(), *src))
    top = ok.withColumn("_r", rank).filter(F.col("_r") <= F.col(most))
    return top.withColumn("place", F.row_number().over(Window.partitionBy(packet).orderBy(*src)).cast("long")).drop("_r")


def focus_counts(calls: DataFrame, view: DataFrame, packet: str = "packet_id") -> DataFrame:
    """supporting, uncertain, omitted and policy_hidden counts of each packet."""
    c = calls.groupBy(packet).agg(F.count("*").alias("n"), *[F.count_if(F.col("relevance") == r).alias(r) for r in ("supporting", "uncertain", "essential")])
    v = view.groupBy(packet).agg(F.count("*").alias("v"))
    j = c.join(v, packet, "left").fillna(0, ["v"])
    return j.select(packet, "supporting", "uncertain", (F.col("n") - F.col("v")).alias("omitted"), (F.col("essential") - F.col("v")).alias("policy_hidden"))


def parse_scores(responses: DataFrame) -> DataFrame:
    """packet_id, candidate_id, status, display_score of JSON answers {candidate: {label: probability}}: the chance of
    essential where the labels are complete and the probabilities pass; a response that isn't such JSON gives none."""
    p = F.from_json("response", "map<string,map<string,double>>")
    one = responses.select("packet_id", F.explode(p).alias("candidate_id", "p"))
    full = (F.size("p") == len(LABELS)) & F.forall(F.map_keys("p"), lambda k: k.isin(*LABELS))
    status = F.when(~full, "labels").otherwise(probability_status(F.col("p")))
    return one.select("packet_id", "candidate_id", status.alias("status"), F.when(status.isin("exact", "rounded"), F.element_at("p", "essential")).alias("display_score"))


def answer_problems(claims: DataFrame) -> DataFrame:
    """answer_id, problem of cited answers (answer_id, branch_id, claim_id, first, last, valid), a row for each
    citation: claims (not 1-4), branches (over 6), citations (not 1-4), lines (over 12 or reversed), quote (not exact)."""
    per = claims.groupBy("answer_id").agg(F.countDistinct("claim_id").alias("c"), F.countDistinct("branch_id").alias("b"))
    cit = claims.groupBy("answer_id", "claim_id").agg(F.count("first").alias("n"), F.bool_or((F.col("last") - F.col("first") + 1 > 12) | (F.col("last") < F.col("first"))).alias("long"), F.bool_or(~F.col("valid")).alias("bad"))
    out = per.select("answer_id", F.explode(F.array_compact(F.array(F.when(~F.col("c").between(1, 4), "claims"), F.when(F.col("b") > 6, "branches")))).alias("problem"))
    more = cit.select("answer_id", F.explode(F.array_compact(F.array(F.when(~F.col("n").between(1, 4), "citations"), F.when(F.col("long"), "lines"), F.when(F.col("bad"), "quote")))).alias("problem"))
    return out.union(more).distinct()


def baseline(candidates: DataFrame) -> DataFrame:
    """Adds relevance by distance and shared words: the seed and its neighbours essential, two away supporting, a word
    of four letters or more in common uncertain, all others incidental. question, name, distance, is_seed."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0))
    shared = F.arrays_overlap(words(F.regexp_replace("name", "([a-z])([A-Z])", "$1 $2")), words(F.col("question")))
    return candidates.withColumn("relevance", F.when(F.col("is_seed") | (F.col("distance") == 1), "essential").when(F.col("distance") <= 2, "supporting").when(F.coalesce(shared, F.lit(False)), "uncertain").otherwise("incidental"))


def assemble_view(candidates: DataFrame) -> DataFrame:
    """Adds shown: visible (the seed, always, and essential ones), collapsed or hidden."""
    return candidates.withColumn("shown", F.when(F.col("is_seed") | (F.col("relevance") == "essential"), "visible").when(F.col("relevance").isin("supporting", "uncertain"), "collapsed").otherwise("hidden"))


# --- catalogs --------------------------------------------------------------------------------------------------------


def compose_catalog(files: DataFrame, items: DataFrame, keys: list[str], total_bytes: int, registry_text: int, records: int, text: int) -> tuple[DataFrame, DataFrame]:
    """Files with admitted, and the items of admitted files with kept, in order of path under all budgets.

    files: keys, path, source_bytes, registry_bytes. items: keys, path, item_no, records, text."""
    f = admit_by_budget(files, keys, "path", source_bytes=total_bytes, registry_bytes=registry_text)
    live = items.join(f.filter("admitted").select(*keys, "path"), [*keys, "path"], "left_semi")
    return f, admit_details(live, keys, ["path", "item_no"], records, text)


def classes_page(classes: DataFrame, query: str, path: str | None, offset: int, limit: int) -> DataFrame:
    """Classes of which the name or qualified name holds the query literally, a page of each source set."""
    q = F.lit(query)
    hit = classes.filter(literal_contains(F.coalesce("name", F.lit("")), q) | literal_contains(F.coalesce("qualified_name", F.lit("")), q))
    if path is not None:
        hit = hit.filter(F.col("path") == path)
    return page(hit, ["source_set_id"], ["path", "class_id"], offset, limit)


def class_relations(references: DataFrame) -> DataFrame:
    """relation_id, owner_id, kind, name, state: declared class references. A name is no evidence of a target, so
    every relation is unmatched; repeats of an id are one."""
    rid = F.concat_ws(":", F.lit("class-ref"), "owner_id", F.col("start").cast("string"), F.col("end").cast("string"), "kind", "name")
    return references.select(rid.alias("relation_id"), "owner_id", "kind", "name", F.lit("unmatched").alias("state")).dropDuplicates(["relation_id"])


def package_symbols_page(packages: DataFrame, symbols: DataFrame, query: str, offset: int, limit: int) -> DataFrame:
    """Symbols of which the name or qualified name holds the query, with their package's name, a page of each package."""
    hit = symbols.filter(symbol_contains(F.col("name"), F.col("qualified_name"), F.lit(query))).join(packages, "package_id")
    return page(hit, ["package_id"], ["qualified_name", "symbol_id"], offset, limit)


@dataclass(frozen=True)
class CatalogLimits:
    """What a catalog of one source set holds at most."""

    files: int = 100_000
    symbols: int = 1_000_000
    source_bytes: int = 256 << 20
    registry_text: int = 64 << 20
    classes: int = 250_000
    records: int = 250_000
    text: int = 64 << 20


#: Codes of the closing warnings, in the order in which a catalog lists them.
CATALOG_WARNINGS = ("inputLimit", "sourceLimit", "registryTextLimit", "classLimit", "detailRecordLimit", "detailTextLimit", "extraction", "declaredTypes", "registryIncomplete")


def build_catalog(files: DataFrame, classes: DataFrame, items: DataFrame, keys: list[str], limits: CatalogLimits = CatalogLimits()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Classes, details, relations and closing warnings of the catalog of each source set.

    files: keys, path, source_bytes, registry_bytes, symbols, truncated, incomplete (its own registry), warned.
    classes: keys, path, class_no (in its file), class_id. items: keys, path, class_no, item_no, kind (field, method,
    relation or scope), item_id, records, text.

    A source set of too many files or symbols has no catalog. Files come in order of path while their source and
    registry text fit; classes come in order while they are no more than the limit, and the first beyond it ends the
    catalog; details come in order while records and text fit, and the first that doesn't closes them for good, so
    that classes with later items are truncated. Relations with an id that an earlier one has go.

    classes: keys, path, class_no, class_id, truncated. details: keys, path, class_no, item_no, kind, item_id, without
    scopes and relations. relations: keys, path, item_id. warnings: keys, warning (see CATALOG_WARNINGS): the limits that
    ended something, `extraction` if an admitted file has a warning of its own, `declaredTypes` with any class, and
    `registryIncomplete` if a class may be absent. Sums go by ranges, so a source set may be of any size."""
    first = lambda df, order: df.groupBy(*keys).agg(F.min_by(F.col("_why"), order).alias("warning"))
    sizes = files.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("symbols").alias("_s"))
    large = stored(sizes.filter((F.col("_n") > limits.files) | (F.col("_s") > limits.symbols)).select(*keys), "large-inputs")
    usable = files.join(large, keys, "left_anti")
    ran = stored(running(usable, keys, ["path"], _source="source_bytes", _registry="registry_bytes").withColumn("_why", F.when(F.col("_source") > limits.source_bytes, "sourceLimit").when(F.col("_registry") > limits.registry_text, "registryTextLimit")), "catalog-files")
    closed = first(ran.filter("_why is not null"), F.col("path"))
    admitted = ran.filter("_why is null")
    counted = stored(numbered(classes.join(admitted.select(*keys, "path"), [*keys, "path"], "left_semi"), keys, ["path", "class_no", "class_id"], "_n"), "catalog-classes")
    kept = counted.filter(F.col("_n") <= limits.classes)
    over = counted.filter(F.col("_n") > limits.classes).select(*keys).distinct().withColumn("warning", F.lit("classLimit"))
    live = items.join(kept.select(*keys, "path", "class_no").distinct(), [*keys, "path", "class_no"], "left_semi")
    summed = running(live, keys, ["path", "class_no", "item_no"], _r="records", _t="text")
    judged = stored(summed.withColumn("_why", F.when(F.col("_r") > limits.records, "detailRecordLimit").when(F.col("_t") > limits.text, "detailTextLimit")), "catalog-items")
    shut = first(judged.filter("_why is not null"), F.struct("path", "class_no", "item_no"))
    cut = judged.filter("_why is not null").select(*keys, "path", "class_no").distinct().withColumn("truncated", F.lit(True))
    out = kept.join(cut, [*keys, "path", "class_no"], "left").select(*keys, "path", "class_no", "class_id", F.coalesce("truncated", F.lit(False)).alias("truncated"))
    fits = judged.filter("_why is null")
    details = fits.filter("kind in ('field', 'method')").select(*keys, "path", "class_no", "item_no", "kind", "item_id")
    relations = fits.filter("kind = 'relation'").groupBy(*keys, "item_id").agg(F.min("path").alias("path")).select(*keys, "path", "item_id")
    # the first class too many ends the catalog: files behind its own aren't looked at
    last = counted.filter(F.col("_n") > limits.classes).groupBy(*keys).agg(F.min("path").alias("_last"))
    closed = closed.join(last, keys, "left_anti")
    own = admitted.filter("warned or incomplete").join(last, keys, "left").filter("_last is null or path <= _last").groupBy(*keys).agg(F.bool_or("warned").alias("_w"), F.bool_or("incomplete").alias("_i"))
    said = lambda df, code: df.select(*keys).distinct().withColumn("warning", F.lit(code))
    absent = said(closed.select(*keys).unionByName(over.select(*keys)).unionByName(own.filter("_i").select(*keys)), "registryIncomplete")
    parts = [said(large, "inputLimit"), closed, over, shut, said(own.filter("_w"), "extraction"), said(kept, "declaredTypes"), absent]
    return out, details, relations, reduce(DataFrame.unionByName, parts)
