"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

For every length that benchmark items have, windows of that many words slide over every text. A window's SimHash (64
signs of the weighted sum of its shingles' bits) is looked up in a multi-index of the items of that length:
fingerprints are cut into eight blocks of a byte, and two fingerprints within radius 8 * d + 7 agree to within d bits in
at least one block, so the union over blocks of the items whose byte is within d holds every item within the radius.
These pairs of window and item, and no others, are confirmed by the full Hamming distance and then compared exactly:
similarity is the weighted Jaccard similarity of the two shingle multisets, a shingle weighing its share of different
words, so that stretches of one repeated word say little.

Two steps before that lose nothing. A window of which less than the threshold's share (by weight) are shingles of any
item at all can't reach the threshold with one, so it gets no fingerprint. And windows of one text with the same
sequence of shingles are looked up once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Powers, WordHasher, boxed, grams, mix, slices, stored

_U = np.uint64
#: Items, and characters of their texts, that each task holds at once; a larger benchmark goes over the documents in as
#: many blocks as needed.
BLOCK_ITEMS, BLOCK_CHARS = 5_000, 16_000_000
#: Windows that are fingerprinted, and pairs of window and item that are looked up, at once.
BATCH_WINDOWS, BATCH_PAIRS = 4096, 1 << 21
#: ASCII punctuation parts words too, so that quoting or another full stop doesn't hide an item.
_PARTS = WHITE + bytes(c for c in range(33, 127) if not chr(c).isalnum())
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Shingle hashes of one word sequence; a shorter sequence is a shingle by itself."""
    return grams(hashes, size) if len(hashes) >= size else grams(hashes, len(hashes)) if len(hashes) else hashes


def shingle_weights(hashes: np.ndarray, size: int) -> np.ndarray:
    """For each shingle the share of its words that are different; a shorter sequence is a shingle by itself."""
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    if size == 0:
        return np.zeros(0)
    new = np.ones(n)
    for j in range(1, size):
        seen = np.zeros(n, bool)
        for i in range(j):
            seen |= hashes[i : i + n] == hashes[j : j + n]
        new += ~seen
    return new / size


def simhash(sums: np.ndarray) -> np.ndarray:
    """64-bit fingerprints from rows of 64 weighted sums: bit b is set where sum b is positive."""
    return np.packbits(sums > 0, axis=-1).view(">u8").astype(_U).reshape(-1)


def signs(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows of 64: the weight, with the sign of the shingle's bit."""
    bits = np.unpackbits(mix(shingles ^ _U(0x51)).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.where(bits, weights[:, None], -weights[:, None]).astype(np.float32)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _BITS[(a ^ b).view(np.uint8).reshape(-1, 8)].sum(axis=1)


class Group:
    """Items of one length in words: their shingles and fingerprints, and the multi-index of these."""

    def __init__(self, words: int, size: int, members: list[tuple[int, np.ndarray, np.ndarray]], radius: int):
        self.words, self.size, self.radius = words, size, radius
        self.ids = [i for i, _, _ in members]
        self.bags = [Counter(sh.tolist()) for _, sh, _ in members]
        self.total = [float(w.sum()) for _, _, w in members]
        self.prints = np.array([simhash(signs(sh, w).sum(axis=0, dtype=np.float64)[None, :])[0] for _, sh, w in members], _U)
        # for block k and byte value v, the items whose byte k differs from v in at most d bits
        blocks = self.prints.view(np.uint8).reshape(-1, 8)
        near = _BITS[np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]] <= radius // 8
        self.index = [near[:, blocks[:, k]] for k in range(8)]  # 256 x items each

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (fingerprint, item) that the multi-index brings together and the radius confirms."""
        windows, items = [], []
        step = max(1, BATCH_PAIRS // len(self.ids))
        for lo in range(0, len(prints), step):
            part = prints[lo : lo + step]
            bytes_ = part.view(np.uint8).reshape(-1, 8)
            met = self.index[0][bytes_[:, 0]]
            for k in range(1, 8):
                met = met | self.index[k][bytes_[:, k]]
            w, i = np.nonzero(met)
            sure = hamming(part[w], self.prints[i]) <= self.radius
            windows.append(w[sure] + lo)
            items.append(i[sure])
        return (np.concatenate(windows), np.concatenate(items)) if windows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Items:
    """A block of benchmark items by length, and all their shingles. Texts are in lower case."""

    def __init__(self, ids: list[int], texts: list[str], shingle: int, radius: int):
        hasher = WordHasher(seed=3, lower=True, white=_PARTS)
        by_length: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        self.weight: dict[int, float] = {}
        known: dict[int, list[np.ndarray]] = {}
        for item, t in zip(ids, texts, strict=True):
            data = np.frombuffer(t.encode(), np.uint8)
            h = hasher.words(data, np.array([0, len(data)]))[0]
            if len(h):
                sh, w = _shingles(h, shingle), shingle_weights(h, shingle)
                by_length.setdefault(len(h), []).append((item, sh, w))
                self.weight.update(zip(sh.tolist(), w.tolist(), strict=True))
                known.setdefault(min(shingle, len(h)), []).append(sh)
        self.groups = [Group(n, min(shingle, n), members, radius) for n, members in sorted(by_length.items())]
        #: by shingle size: all shingles in order, and a filter of their low bits
        self.known = {k: np.unique(np.concatenate(x)) for k, x in known.items()}
        self.filter = {}
        for k, x in self.known.items():
            self.filter[k] = np.zeros(1 << 20, bool)
            self.filter[k][(x & _LOW).astype(np.int64)] = True

    def has(self, shingles: np.ndarray, size: int) -> np.ndarray:
        """Which shingles any item has."""
        hit = self.filter[size][(shingles & _LOW).astype(np.int64)]
        maybe = np.flatnonzero(hit)
        slot = np.minimum(np.searchsorted(self.known[size], shingles[maybe]), len(self.known[size]) - 1)
        hit[maybe] = self.known[size][slot] == shingles[maybe]
        return hit


_LOW = _U((1 << 20) - 1)


def _fingerprints(sh: np.ndarray, weight: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Of the windows of m shingles from each place `at` (rising) on."""
    out = []
    lo = 0
    while lo < len(at):
        hi = min(lo + BATCH_WINDOWS, int(np.searchsorted(at, at[lo] + 4 * BATCH_WINDOWS, "right")))
        a, b = int(at[lo]), int(at[hi - 1]) + m
        sums = np.zeros((b - a + 1, 64))
        np.cumsum(signs(sh[a:b], weight[a:b]), axis=0, dtype=np.float64, out=sums[1:])
        out.append(simhash(sums[at[lo:hi] - a + m] - sums[at[lo:hi] - a]))
        lo = hi
    return np.concatenate(out)


def _in_text(items: Items, words: np.ndarray, sizes: list[int], threshold: float, powers: Powers) -> Iterator[tuple[int, int, int, float]]:
    """(item, start, words, similarity) of the window of the text that is most like each item, the first of equals."""
    by_size = {}
    for k in sizes:
        if k <= len(words):
            sh, weight = grams(words, k), shingle_weights(words, k)
            up, down = powers.get(len(sh) + 1)
            sums = np.zeros((2, len(sh) + 1))
            np.cumsum(np.where(items.has(sh, k), weight, 0), out=sums[0, 1:])
            np.cumsum(weight, out=sums[1, 1:])
            order = np.zeros(len(sh) + 1, _U)
            np.cumsum(sh * up[: len(sh)], dtype=_U, out=order[1:])
            by_size[k] = sh, weight, sums, order, down
    for group in items.groups:
        if group.size not in by_size:
            continue
        sh, weight, sums, order, down = by_size[group.size]
        n = min(group.words, len(words))  # a text shorter than the item is one window
        m = n - group.size + 1
        shared, whole = sums[:, m:] - sums[:, : len(sh) - m + 1]
        at = np.flatnonzero(shared >= (threshold - 1e-9) * whole - 1e-9)
        if not len(at):
            continue
        at = np.sort(at[np.unique((order[at + m] - order[at]) * down[at], return_index=True)[1]])
        best: dict[int, tuple[float, int]] = {}
        for w, i in zip(*(x.tolist() for x in group.candidates(_fingerprints(sh, weight, at, m))), strict=True):
            s = int(at[w])
            bag, own = Counter(sh[s : s + m].tolist()), group.bags[i]
            both = sum(items.weight[x] * min(c, own[x]) for x, c in bag.items() if x in own)
            value = both / (group.total[i] + float(weight[s : s + m].sum()) - both)
            if value >= threshold - 1e-12 and (i not in best or value > best[i][0]):
                best[i] = (value, s)
        for i, (value, s) in best.items():
            yield group.ids[i], s, n, value


def _matches(items: Items, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, powers = WordHasher(seed=3, lower=True, white=_PARTS), Powers()
        sizes = sorted(items.known)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out: list[tuple] = []
            for at, count, data, bounds in slices(batch):
                hashes, _, _, firsts = hasher.words(data, bounds)
                hits = np.zeros(count, bool)  # texts with a shingle of some item
                for k in sizes:
                    g = grams(hashes, k)
                    where = np.flatnonzero(items.has(g, k))
                    doc = np.searchsorted(firsts, where, "right") - 1
                    hits[doc[where + k <= firsts[doc + 1]]] = True
                for d in np.flatnonzero(hits).tolist():
                    out += [(ids[at + d], *found) for found in _in_text(items, hashes[firsts[d] : firsts[d + 1]], sizes, threshold, powers)]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "item_id", "start", "n_words", "similarity"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8, radius: int = 23, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity: for each document and item the most similar window, if any window
    of the item's length reaches the threshold; the first of equals.

    Words are lower-cased and parted by ASCII white space and punctuation; similarity is that of the module's text.
    Null texts and items without words match nothing; an item of fewer than `shingle` words is one shingle by itself.
    Rows are matched each by itself, so a repeated or null doc_id gives rows of its own; rows that repeat an item
    match twice. Empty tables give an empty result; other columns are ignored.

    The benchmark is read in blocks of block_items items and block_chars characters (or one longer item), each small
    enough to go to every task; documents are read once for each block and are never shuffled. The driver holds one
    block at a time: where there are several, each one's matches are written before the next is read.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, start long, n_words long, similarity double"
    text = F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text")
    lowered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text).orderBy("item_id", "text")
    found: list[DataFrame] = []

    def search(block: list) -> DataFrame:
        items = Items([r["item_id"] for r in block], [r["text"] for r in block], shingle, radius)
        return lowered.mapInArrow(_matches(items, threshold), schema)

    block, chars = [], 0
    for row in wanted.toLocalIterator():
        if block and (len(block) >= block_items or chars + len(row["text"]) > block_chars):
            found.append(stored(search(block), "leaks"))
            block, chars = [], 0
        block.append(row)
        chars += len(row["text"])
    if block:
        found.append(search(block))
    if not found:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs without a window that contaminated() finds, with all their columns. Rows that share a doc_id go
    together; rows with a null doc_id are judged as one document as well."""
    found = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("id")).distinct()
    return boxed(docs).join(found, F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")), "left_anti").select("row.*")
