"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two fixed permutations of the 64-bit words stand behind all signature coordinates: the first scatters the shingles,
the second is applied after a circular shift by k, and coordinate k is the least value over the document's shingles.
Coordinates are cut into bands; documents that share a band are candidates, and a candidate pair becomes a link only
when the Jaccard similarity of the two full shingle sets reaches the threshold.

How groups of any size stay cheap and whole:

* documents with the same shingle set are one class from the start;
* in every bucket each class is compared with the bucket's smallest one (a star, linear in the bucket);
* then, in buckets that still hold several components, the classes outside the component of the smallest one are
  compared with the others. In a small bucket that is every such pair; in a large one a pair is left out only if
  counts prove that its similarity is below the threshold: how many shingles no other document of such buckets has,
  and how many each of the two shares with the bucket's smallest one.

So no pair of one bucket that could be a link between different components goes unchecked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, WordHasher, boxed, components, doc_text, grams, long, mix, slices, spread, stored, text_of

_U = np.uint64
#: Members up to which all pairs between components of a bucket are compared; beyond it the proof above prunes first.
SMALL_BUCKET = 16


def shingle_sets(hashes: np.ndarray, firsts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, end to end, and where each text's begin. A text of fewer words
    has its whole word sequence as the only shingle, an empty one has none."""
    n = len(hashes)
    length = np.diff(firsts)
    texts = text_of(firsts)
    g = grams(hashes, words)
    at = np.arange(len(g))
    fits = at + words <= np.repeat(firsts[1:], length)[: len(g)]
    values, owner = [g[fits]], [texts[: len(g)][fits]]
    for short in range(1, words):
        who = np.flatnonzero(length == short)
        if len(who):
            seq = np.full(len(who), short, _U)
            for j in range(short):
                seq = mix(seq * _U(0x9E3779B97F4A7C15) + hashes[firsts[:-1][who] + j])
            values.append(seq)
            owner.append(who)
    value, own = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    value, own = value[new], own[new]
    return value, np.searchsorted(own, np.arange(len(length) + 1))


def signatures(sets: np.ndarray, firsts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts x bands) of non-empty sets: coordinate k is min over x of second(first(x) + k)."""
    scattered = mix(sets ^ _U(0xA5A5A5A55A5A5A5A))
    out = np.zeros((len(firsts) - 1, bands), _U)
    step = 1 << 14
    cuts = [0]
    while cuts[-1] < len(firsts) - 1:
        i = cuts[-1]
        cuts.append(max(i + 1, int(np.searchsorted(firsts, firsts[i] + step, "right")) - 1))
    for i, j in zip(cuts, cuts[1:], strict=False):
        part, starts = scattered[firsts[i] : firsts[j]], firsts[i:j] - firsts[i]
        for band in range(bands):
            acc = np.full(j - i, band + 1, _U)
            for r in range(rows):
                x = part + _U(band * rows + r)
                x *= _U(0xFF51AFD7ED558CCD)
                x ^= x >> _U(32)
                x *= _U(0xC4CEB9FE1A85EC53)
                x ^= x >> _U(29)
                acc = acc * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(x, starts)
            out[i:j, band] = mix(acc)
    return out


def _sketch(words: int, bands: int, rows: int):
    hasher = WordHasher(seed=9, lower=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for at, count, data, bounds in slices(batch):
                hashes, _, _, firsts = hasher.words(data, bounds)
                sets, begin = shingle_sets(hashes, firsts, words)
                sizes = np.diff(begin)
                full = np.flatnonzero(sizes)
                sig = np.zeros((count, bands), _U)
                if len(full):
                    sig[full] = signatures(sets, np.append(begin[:-1][full], len(sets)), bands, rows)
                # two words that stand for the whole set: sums over its shingles of two scatterings
                sums = [np.concatenate(([_U(0)], np.cumsum(mix(sets + _U(salt)), dtype=_U))) for salt in (11, 12)]
                keys = [mix(s[begin[1:]] - s[begin[:-1]]) for s in sums]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, count), pa.array(sizes, pa.int64()), long(keys[0]), long(keys[1]), pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * bands, pa.int32()), long(sig.ravel()))],
                    ["doc_id", "n_shingles", "k1", "k2", "sig"],
                )

    return run


def _sets(words: int):
    hasher = WordHasher(seed=9, lower=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, count, data, bounds in slices(batch):
                hashes, _, _, firsts = hasher.words(data, bounds)
                sets, begin = shingle_sets(hashes, firsts, words)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, count), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), long(sets))], ["doc_id", "shingles"])

    return run


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """a, b, common, linked: how many shingles two sets share, and whether 100 * |a and b| >= percent * |a or b|."""
    for batch in batches:
        ca, cb = batch.column("sa"), batch.column("sb")
        va, vb = (np.asarray(c.values).view(_U) for c in (ca, cb))
        oa, ob = (np.asarray(c.offsets) for c in (ca, cb))
        common = np.zeros(batch.num_rows, np.int64)
        i = 0
        while i < batch.num_rows:  # about SLICE shingles at once
            j = max(i + 1, int(np.searchsorted(oa, oa[i] + SLICE // 4, "right")) - 1)
            na, nb = np.diff(oa[i : j + 1]), np.diff(ob[i : j + 1])
            value = np.concatenate([va[oa[i] : oa[j]], vb[ob[i] : ob[j]]])
            pair = np.concatenate([np.repeat(np.arange(j - i), na), np.repeat(np.arange(j - i), nb)])
            order = np.lexsort((value, pair))
            value, pair = value[order], pair[order]
            same = (value[1:] == value[:-1]) & (pair[1:] == pair[:-1])
            common[i:j] = np.bincount(pair[1:][same], minlength=j - i)
            i = j
        union = np.diff(oa) + np.diff(ob) - common
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common), pa.array(100 * common >= percent * union)], ["a", "b", "common", "linked"])


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 28, rows: int = 4, small: int = SMALL_BUCKET) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text, ...).

    Words are runs of anything but ASCII white space, A-Z taken as a-z; a document's set holds its distinct shingles
    of `words` words. Two documents are linked when 100 * |both| >= percent * |either|; component_id is the smallest
    doc_id reachable over links, kept whether that is the document itself.

    A null text counts as empty; texts without words are linked with nothing and are kept. Rows that share a doc_id
    are one document with several texts, and so in one component. A null doc_id is linked with nothing: component_id
    is null, kept is true. An empty table gives an empty result. Other columns of docs are ignored.

    The chance that no band holds a pair at the threshold is (1 - s^rows)^bands: 1e-9 at 0.85 with 28 bands of four.
    """
    text = doc_text(docs)
    sketch = stored(text.mapInArrow(_sketch(words, bands, rows), "doc_id long, n_shingles long, k1 long, k2 long, sig array<long>"), "sketch")
    usable = sketch.filter("doc_id is not null and n_shingles > 0")
    # written by themselves, so that the joins below deal out both sides anew and Spark can split a hot key
    classes = stored(usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    member = stored(usable.select("doc_id", "k1", "k2", "n_shingles").join(classes, ["k1", "k2"]).select("doc_id", "rep", "k1", "n_shingles"), "members")
    # one row for each class: that of its smallest document
    reps = usable.select("doc_id", "k1", "n_shingles", "sig").join(member.filter("doc_id = rep").select("doc_id", "k1").distinct(), ["doc_id", "k1"], "left_semi").dropDuplicates(["doc_id", "k1"])
    banded = reps.select("doc_id", F.col("n_shingles").alias("n"), F.posexplode("sig").alias("band", "bucket"))
    heads = stored(banded.groupBy("band", "bucket").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail"), F.count("*").alias("m")).filter("head < tail"), "heads")
    buckets = stored(banded.join(heads, ["band", "bucket"]), "buckets")

    seen = stored(buckets.filter("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b")).distinct(), "pairs")
    wanted = buckets.select("doc_id").distinct()
    sets = stored(text.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(words), "doc_id long, shingles array<long>"), "sets")
    compared = stored(_compared(seen, sets, percent), "compared")
    found = stored(components(compared.filter("linked")), "components")

    more = stored(_cross_pairs(buckets, reps.select("doc_id", "sig"), found, compared, sets, percent, small).join(seen, ["a", "b"], "left_anti"), "pairs")
    late = stored(_compared(more, sets, percent).filter("linked"), "links")
    # nodes now: the components found so far
    of = found.select(F.col("node"), "component")
    up = late.join(of.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    # written apart too: very many documents may have one component
    merged = stored(components(up.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))), "merged")
    same = member.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # rows of one doc_id with different texts tie their classes together
    twice = member.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    final = found.join(merged.withColumnRenamed("component", "top"), found["component"] == merged["node"], "left").select(found["node"].alias("rep"), F.coalesce("top", "component").alias("c"))
    extra = merged.join(found.select("node"), "node", "left_anti").select(F.col("node").alias("rep"), F.col("component").alias("c"))
    by_rep = final.unionByName(extra)
    if twice.limit(1).count():
        every = by_rep.select(F.col("rep").alias("a"), F.col("c").alias("b")).union(same)
        named = components(every).select(F.col("node").alias("doc_id"), F.col("component").alias("c")).groupBy("doc_id").agg(F.min("c").alias("c"))
    else:
        named = member.select("doc_id", "rep").join(by_rep, "rep", "left").select("doc_id", F.coalesce("c", "rep").alias("c"))
    out = sketch.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    cid = F.coalesce("c", "doc_id")
    return out.select("doc_id", "n_shingles", cid.alias("component_id"), F.coalesce(cid == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, **options) -> DataFrame:
    """The rows of docs whose document near_duplicates() keeps, with all their columns: of each group one document,
    the one of smallest doc_id. Rows that share a doc_id are one document and stay or go together, but of rows that
    repeat both doc_id and text one stays, the first by its columns as JSON. Rows with a null doc_id and texts without
    words stay."""
    gone = near_duplicates(docs, words, percent, **options).filter("not kept").select(F.col("doc_id").alias("id")).distinct()
    left = boxed(docs).join(gone, F.col("row.doc_id").cast("long") == F.col("id"), "left_anti")
    key = F.when(F.col("row.doc_id").isNotNull() & F.coalesce("row.text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.struct(F.col("row.doc_id").cast("long").alias("d"), F.xxhash64("row.text").alias("h")))
    several = left.groupBy(key.alias("k")).agg(F.count("*").alias("n")).filter("k is not null and n > 1").select("k")
    if not several.limit(1).count():
        return left.select("row.*")
    tagged = left.withColumn("key", key)
    one = tagged.join(several, F.col("key") == F.col("k"), "left_semi").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return tagged.join(several, F.col("key") == F.col("k"), "left_anti").select("row").unionByName(one).select("row.*")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes allow a link, compared."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(a, "a").join(b, "b").filter(f"100 * least(size(sa), size(sb)) >= {percent} * greatest(size(sa), size(sb))")
    return both.select("a", "b", "sa", "sb").mapInArrow(lambda it: _verify(it, percent), "a long, b long, common long, linked boolean")


def _cross_pairs(buckets: DataFrame, signed: DataFrame, found: DataFrame, compared: DataFrame, sets: DataFrame, percent: int, small: int) -> DataFrame:
    """Pairs (a > b) of one bucket in different components, at least one outside the component of the bucket's head.

    A pair comes from the first band that it shares, and once."""
    of = found.select(F.col("node").alias("doc_id"), "component")
    labelled = buckets.select("band", "bucket", "doc_id", "n", "head", "m").join(of, "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id"))
    heads = of.select(F.col("doc_id").alias("head"), F.col("component").alias("hc"))
    labelled = labelled.join(heads, "head", "left").withColumn("out", F.col("c") != F.coalesce("hc", "head"))
    open_ = stored(labelled.filter("out").select("band", "bucket").distinct(), "open-buckets")
    live = labelled.join(open_, ["band", "bucket"], "left_semi").select("band", "bucket", "doc_id", "n", "c", "out", "m", "head")
    live = stored(live.join(signed.dropDuplicates(["doc_id"]), "doc_id"), "open")

    def paired(probe: DataFrame, build: DataFrame, on: list[str], cond: str) -> DataFrame:
        p = probe.alias("p").join(build.alias("q"), on).filter(f"p.c <> q.c and (p.doc_id > q.doc_id or not q.out and p.doc_id <> q.doc_id) and 100 * least(p.n, q.n) >= {percent} * greatest(p.n, q.n){cond}" + " and array_position(zip_with(p.sig, q.sig, (x, y) -> x = y), true) - 1 = band")
        return p.select(F.greatest("p.doc_id", "q.doc_id").alias("a"), F.least("p.doc_id", "q.doc_id").alias("b"))

    few, many = live.filter(f"m <= {small}"), live.filter(f"m > {small}")
    near = paired(few.filter("out"), few, ["band", "bucket"], "")
    # shingles that one document alone has, among all of large open buckets, are in no intersection there
    # (what a document shares with a head isn't its own, so beside the heads' only the other shingles are listed)
    chosen = stored(many.groupBy("doc_id").agg(F.min("head").alias("head")), "heads")
    heads = chosen.select(F.col("head").alias("doc_id")).distinct()
    whole = sets.join(heads, "doc_id", "left_semi").select("doc_id", F.explode("shingles").alias("token"))
    of_head = sets.select(F.col("doc_id").alias("head"), F.col("shingles").alias("common"))
    beside = chosen.join(heads, "doc_id", "left_anti").join(sets, "doc_id").join(of_head, "head").select("doc_id", F.explode(F.array_except("shingles", "common")).alias("token"))
    tokens = whole.unionByName(beside)
    alone = tokens.groupBy("token").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("other")).filter("doc_id = other").groupBy("doc_id").agg(F.count("*").alias("own"))
    t = percent / 100
    # overlap of a linked pair >= t / (1 + t) * (n + n'), and neither shares more than it has in common with anyone
    shared = many.join(alone, "doc_id", "left").withColumn("s", F.col("n") - F.coalesce("own", F.lit(0)))
    # of what can be shared, at most h lies in the bucket's head and s - h outside of it
    with_head = compared.select(F.col("a").alias("doc_id"), F.col("b").alias("head"), F.col("common").alias("h"))
    shared = shared.join(with_head, ["doc_id", "head"], "left").withColumn("h", F.when(F.col("doc_id") == F.col("head"), F.col("s")).otherwise(F.col("h"))).drop("head")
    width = 0.02
    shared = shared.withColumn("bin", F.floor(F.log("n") / width).cast("long"))
    lowest = F.floor(F.log(F.greatest(F.lit(1.0), F.col("n") * t)) / width).cast("long")
    highest = F.floor(F.log(F.greatest(F.lit(1.0), F.least(F.col("n") / t, F.col("s") * (1 + t) / t - F.col("n")) + 1e-6)) / width).cast("long")
    probe = shared.filter("out").withColumn("bins", F.when(lowest <= highest, F.sequence(lowest, highest))).filter("bins is not null").select("band", "bucket", "doc_id", "n", "c", "s", "h", "sig", "out", F.explode("bins").alias("bin"))
    far = paired(probe, shared, ["band", "bucket", "bin"], f" and (100 + {percent}) * coalesce(least(p.h, q.h) + least(p.s - p.h, q.s - q.h), least(p.s, q.s)) >= {percent} * (p.n + q.n)")
    return near.union(far).distinct()
