"""Retrieval over symbol cards and chunks: lexical ranking, cosine ranking, fusion, and recall."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftworks.functions.text import identifier_words
from siftworks.sources.tables import shared_dir, stored


def symbol_cards(decls: DataFrame) -> DataFrame:
    """id, card: one text for each declaration."""
    return decls.select("id", F.concat_ws("\n", F.concat_ws(" ", "kind", "name"), "signature", "doc", "path").alias("card"))


def _gathered(sizes: list[int], budget: int) -> list[dict]:
    """first, last (places in sizes), n of each chunk."""
    out: list[dict] = []
    open_ = False
    for i, n in enumerate(sizes):
        if n > budget:
            out += [{"first": i, "last": i, "n": min(budget, n - k)} for k in range(0, n, budget)]
            open_ = False
        elif open_ and out[-1]["n"] + n <= budget:
            out[-1] = {"first": out[-1]["first"], "last": i, "n": out[-1]["n"] + n}
        else:
            out.append({"first": i, "last": i, "n": n})
            open_ = True
    return out


def chunks(lines: DataFrame, budget: int) -> DataFrame:
    """path, chunk, first, last, n_bytes, header: lines in order, merged as long as they fit into the budget (bytes, line
    feeds included). A line beyond the budget is split into chunks of its own, all but the last of budget bytes. So no
    chunk is over the budget. A document's lines go as one row of numbers; texts don't move."""

    @F.pandas_udf("array<struct<first: int, last: int, n: long>>")
    def gathered(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda x: _gathered([int(n) for n in x], budget))

    one = lines.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", (F.octet_length("line") + 1).cast("long").alias("n")))).alias("l"))
    flat = one.select("path", F.col("l.line_no").alias("no"), F.posexplode(gathered(F.col("l.n"))).alias("chunk", "c"))
    out = flat.select("path", F.col("chunk").cast("long").alias("chunk"), F.get("no", F.col("c.first")).alias("first"), F.get("no", F.col("c.last")).alias("last"), F.col("c.n").alias("n_bytes"))
    return out.withColumn("header", F.concat_ws("#", "path", F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string"))))


def trivial(decls: DataFrame, calls: DataFrame, regions: DataFrame, max_statements: int = 1) -> DataFrame:
    """id, trivial: declarations of few statements without calls or branches need no vector."""
    c = calls.groupBy(F.col("owner_id").alias("id")).agg(F.count("*").alias("c"))
    r = regions.groupBy(F.col("owner_id").alias("id")).agg(F.count("*").alias("r"))
    j = decls.join(c, "id", "left").join(r, "id", "left")
    return j.select("id", ((F.col("statements") <= max_statements) & F.col("c").isNull() & F.col("r").isNull()).alias("trivial"))


def _terms(text: str) -> Column:
    return identifier_words(F.col(text))


#: Distinct terms of queries up to which they are sent to every task; more are met by a join on the term.
SMALL_TERMS = 100_000


#: Documents of a query, for each of the k wanted, whose whole scores set its threshold.
PROBES = 4
#: Scores are rounded to nine digits; bounds leave more room than that.
_SLACK = 1e-7
#: Shares of the threshold down to which weak terms are added before a document is judged again.
_STEPS = (0.6, 0.35, 0.15)


def bm25(queries: DataFrame, docs: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, id, score, rank: the k best documents of each query over split identifiers.

    queries: query_id, text. docs: id, text; id is unique. Lengths are counted in place, and only postings of the
    queries' terms go on, so nothing else of a document is shuffled.

    Exact, without scoring every document that shares a term (MaxScore). A term's bound is its largest weight in any
    document. A query's strongest terms find a few documents, whose whole scores give it a threshold: its k-th best
    document has at least that. Its weakest terms, whose bounds together don't reach the threshold, can't bring a
    document in by themselves, so only postings of the others are joined with the query. Of the documents that these
    find, those that can't reach the threshold with all weak terms added go; the others are looked up by term and id, the
    stronger of the weak terms first, and judged again after each step."""
    ranked, _ = _bm25(queries, docs, k, k1, b)
    return ranked


def bm25_work(queries: DataFrame, docs: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """One row: pairs of query and document whose whole score was computed, and all pairs there are."""
    _, scored = _bm25(queries, docs, k, k1, b)
    n = queries.select("query_id").distinct().agg(F.count("*").alias("q")).crossJoin(docs.agg(F.count("*").alias("d")))  # one row each
    return scored.agg(F.count("*").alias("scored")).crossJoin(n).select("scored", (F.col("q") * F.col("d")).alias("pairs"))


def _bm25(queries: DataFrame, docs: DataFrame, k: int, k1: float, b: float) -> tuple[DataFrame, DataFrame]:
    q = stored(queries.select("query_id", F.explode(_terms("text")).alias("term")).distinct(), "query-terms")
    wanted = q.select("term").union(docs.sparkSession.createDataFrame([("",)], "term string")).distinct()
    bag = docs.select("id", _terms("text").alias("terms")).withColumn("dl", F.size("terms").cast("long"))
    if few := wanted.limit(SMALL_TERMS + 1).count() <= SMALL_TERMS:
        wanted = F.broadcast(wanted)
    # one more term, an empty one, stands for the document itself, so that texts are cut into terms once
    every = bag.select("id", "dl", F.explode(F.concat("terms", F.array(F.lit("")))).alias("term")).join(wanted, "term", "left_semi")
    counted = stored(every.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")), "term-counts")
    stats = counted.filter("term = '' and dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avg"))
    tf = counted.filter("term <> ''")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg")))
    known = tf.join(F.broadcast(df) if few else df, "term").crossJoin(F.broadcast(stats))  # stats is one row
    postings = stored(known.select("term", "id", weight.alias("w")), "postings")
    bounds = postings.groupBy("term").agg(F.count("*").alias("df"), F.max("w").alias("most"))
    strong = Window.partitionBy("query_id").orderBy(F.desc("most"), "term")
    earlier, on = strong.rowsBetween(Window.unboundedPreceding, -1), strong.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    terms = stored(q.join(bounds, "term").select("query_id", "term", "most", F.coalesce(F.sum("df").over(earlier), F.lit(0)).alias("found"), F.sum("most").over(on).alias("rest")), "bounded-terms")

    def looked_up(pairs: DataFrame, which: DataFrame) -> DataFrame:
        """query_id, id, w of the pairs' postings of these terms of the query."""
        return pairs.select("query_id", "id").join(which.select("query_id", "term"), "query_id").join(postings, ["term", "id"]).select("query_id", "id", "w")

    first = terms.filter(F.col("found") < PROBES * k).join(postings, "term").groupBy("query_id", "id").agg(F.sum("w").alias("score"))
    probes = stored(top(first, PROBES * k), "probes")
    whole = looked_up(probes, terms).groupBy("query_id", "id").agg(F.sum("w").alias("score"))
    least = top(whole, k).filter(F.col("rank") == k).select("query_id", (F.col("score") - _SLACK).alias("least"))
    ruled = stored(terms.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0))).withColumn("weak", F.col("rest") < F.col("least")), "ruled-terms")
    # weak terms in steps, the stronger ones first: what all later ones can still add falls from step to step
    step = F.when(~F.col("weak"), 0)
    for i, share in enumerate(_STEPS):
        step = step.when(F.col("rest") >= share * F.col("least"), i + 1)
    steps = stored(ruled.select("query_id", "term", "most", "least", step.otherwise(len(_STEPS) + 1).alias("step")), "term-steps")
    scored = steps.filter("step = 0").join(postings, "term").groupBy("query_id", "id").agg(F.sum("w").alias("part"))
    for i in range(len(_STEPS) + 1):
        tail = steps.groupBy("query_id").agg(F.sum(F.when(F.col("step") > i, F.col("most")).otherwise(0.0)).alias("tail"), F.max("least").alias("least"))
        scored = stored(scored.join(tail, "query_id").filter("part + tail >= least").select("query_id", "id", "part"), "candidates")
        more = scored.select("query_id", "id", F.col("part").alias("w")).unionByName(looked_up(scored, steps.filter(F.col("step") == i + 1)))
        whole, scored = scored, more.groupBy("query_id", "id").agg(F.sum("w").alias("part"))
    return top(scored.select("query_id", "id", F.round("part", 9).alias("score")), k), whole


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query by score, ties by id, with rank."""
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return scores.withColumn("rank", r.cast("long")).filter(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _matrix(vectors: pa.Array, length: int) -> np.ndarray:
    """Vectors as rows of unit length; NaN where one is null, has nulls or another length, or is zero."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    out = np.full((len(vectors), length), np.nan)
    fit = pc.fill_null(pc.equal(pc.list_value_length(vectors), length), False)
    rows = np.flatnonzero(fit.to_numpy(zero_copy_only=False))
    if len(rows):
        out[rows] = vectors.filter(fit).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), length)
    size = np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
    return np.divide(out, size, out=np.full_like(out, np.nan), where=size > 0)


def _nearest(query_ids: pa.Array, by_length: list[tuple[np.ndarray, np.ndarray]], k: int, slice_: int = 4096):
    """The best k of each slice of vectors for each query; by_length: places of queries of one length, and their matrix."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, slice_):
                part = batch.slice(at, slice_)
                part = part.take(pc.sort_indices(part.column("id")))  # ties go by id
                for places, queries in by_length:
                    # a query without any component has no score with anything
                    scores = np.round(queries @ _matrix(part.column("vec"), queries.shape[1]).T, 9) if queries.shape[1] else np.full((len(places), part.num_rows), np.nan)
                    known = np.where(np.isnan(scores), -np.inf, scores)
                    n = min(k, known.shape[1])
                    least = np.partition(known, -n, axis=1)[:, -n]
                    picked = []
                    for row, low in zip(known, least, strict=True):
                        near = np.flatnonzero(row >= low)
                        picked.append(near[np.argsort(-row[near], kind="stable")][:n])
                    ids = np.concatenate(picked)
                    of = np.repeat(np.arange(len(places)), n)
                    value = pa.array(scores[of, ids], from_pandas=True)
                    yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(places[of])), part.column("id").take(pa.array(ids)), value], ["query_id", "id", "score"])

    return found


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """query_id, id, score, rank: exact nearest vectors by cosine, a scan of all vectors for each block of queries.

    queries: query_id, vec. vectors: id, vec. The queries go out in blocks of about `block` rows, so that what is sent
    to tasks is bounded; a task multiplies slices of its vectors with the block as matrices and keeps the best k of each
    slice for each query before anything is shuffled. Scores of vectors that are null, zero, of another length than the
    query or that hold nulls are null and come last. Where there are several blocks, each one's answer is written before
    the next starts, so that no plan grows with the queries."""
    blocks = max(1, -(-queries.count() // block))
    numbered = queries.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["id"]

    def answer(part: DataFrame) -> DataFrame:
        one = part.select("query_id", F.col("vec").cast("array<double>").alias("vec")).toArrow().combine_chunks()
        vecs = one.column("vec").combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(vecs), 0).to_numpy(zero_copy_only=False)
        by_length = [(at := np.flatnonzero(lengths == n), _matrix(vecs.take(pa.array(at)), int(n))) for n in np.unique(lengths)]
        scored = vectors.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(_nearest(one.column("query_id").combine_chunks(), by_length, k), f"query_id {kinds[0]}, id {kinds[1]}, score double")
        return top(scored, k)

    if blocks == 1:
        return answer(numbered)
    numbered, path = stored(numbered, "queries"), f"{shared_dir(queries.sparkSession)}/cosine-{uuid.uuid4().hex}"
    for i in range(blocks):
        best = answer(numbered.filter(F.col("_b") == i))
        best.write.mode("append").parquet(path)
    return queries.sparkSession.read.schema(best.schema).parquet(path)


def hybrid(lexical: DataFrame, vector: DataFrame, k: int, weight: float = 0.5, c: int = 60) -> DataFrame:
    """query_id, id, score, rank: weighted reciprocal ranks of both lists."""
    a = lexical.select("query_id", "id", F.col("rank").alias("_l"))
    b = vector.select("query_id", "id", F.col("rank").alias("_v"))
    part = lambda r, w: F.coalesce(F.lit(w) / (F.col(r) + c), F.lit(0.0))
    j = a.join(b, ["query_id", "id"], "full_outer")
    return top(j.select("query_id", "id", F.round(part("_l", weight) + part("_v", 1 - weight), 9).alias("score")), k)


@dataclass(frozen=True)
class Boosts:
    """Factors of a fused score: candidates of the caller's own module, public ones, and those that aren't tests."""

    same_module: float = 1.2
    public: float = 1.1
    production: float = 1.1


def hybrid_search(requests: DataFrame, lexical: DataFrame, vector: DataFrame, candidates: DataFrame, k: int, boosts: Boosts = Boosts(), weight: float = 0.5, c: int = 60) -> DataFrame:
    """query_id, id, score, rank: the k best candidates that pass a request's filters, by fused rank times boosts.

    requests: query_id, language, path_prefix, kinds (array), module (each null for any), no_tests, no_generated.
    lexical and vector: query_id, id, rank. candidates: id, language, path, kind, module, public, test, generated.

    Filters apply before the best are taken, so the lists should be as deep as the filters are narrow; a candidate that
    isn't described passes none. A request without filters keeps all; a null flag is false. Ties go by id."""
    a = lexical.select("query_id", "id", (F.lit(weight) / (F.col("rank") + c)).alias("s"))
    b = vector.select("query_id", "id", (F.lit(1 - weight) / (F.col("rank") + c)).alias("s"))
    fused = a.unionByName(b).groupBy("query_id", "id").agg(F.sum("s").alias("fused"))
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    wanted = requests.select("query_id", F.col("language").alias("_language"), F.col("path_prefix").alias("_prefix"), F.col("kinds").alias("_kinds"), F.col("module").alias("_module"), flag("no_tests").alias("_no_tests"), flag("no_generated").alias("_no_generated"))
    known = candidates.select("id", "language", "path", "kind", "module", flag("public").alias("public"), flag("test").alias("test"), flag("generated").alias("generated"))
    joined = fused.join(wanted, "query_id").join(known, "id")
    passes = (
        (F.col("_language").isNull() | (F.col("language") == F.col("_language"))) & (F.col("_prefix").isNull() | F.startswith("path", "_prefix")) & (F.col("_kinds").isNull() | F.array_contains("_kinds", F.col("kind")))
        & ~(F.col("_no_tests") & F.col("test")) & ~(F.col("_no_generated") & F.col("generated"))
    )
    times = lambda cond, by: F.when(cond, F.lit(by)).otherwise(F.lit(1.0))
    score = F.col("fused") * times(F.col("module") == F.col("_module"), boosts.same_module) * times(F.col("public"), boosts.public) * times(~F.col("test"), boosts.production)
    return top(joined.filter(passes).select("query_id", "id", F.round(score, 9).alias("score")), k)


def vector_status(chunks_: DataFrame, cache: DataFrame) -> DataFrame:
    """model, total, cached, pending: which chunks (model, text_hash) have a vector; the others are lexical only."""
    have = cache.select("model", "text_hash").distinct().withColumn("_h", F.lit(1))
    j = chunks_.join(have, ["model", "text_hash"], "left")
    return j.groupBy("model").agg(F.count("*").alias("total"), F.count("_h").alias("cached"), F.count_if(F.col("_h").isNull()).alias("pending"))


def recall_at_k(ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """query_id, recall: the share of a query's judged hits among its first k."""
    hit = judged.join(ranked.filter(F.col("rank") <= k).select("query_id", "id").withColumn("_h", F.lit(1)), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.count("_h") / F.count("*")).alias("recall"))
