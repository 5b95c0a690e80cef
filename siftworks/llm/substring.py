"""Substring dedup: words covered by windows whose word sequence also starts earlier, found by level-wise doubling.

Level one looks at windows of half the length. Not at all of them: every full window chooses the half window with the
least hash inside it (the leftmost of equals), so equal full windows choose equal halves at equal places, and only
chosen halves need to be compared. Only a half that repeats is extended. Level two looks at windows of the full length:

* the full windows that chose one half form a cell, a stretch of consecutive starts. A cell whose whole stretch of
  words occurs earlier settles all its windows in one row; most of a long copy is settled so;
* where one half stands in different stretches (the edges of a copy), the first cell of each stretch is extended to
  its single windows, and these are compared by themselves.

Nothing survives to be doubled again: a longer repeat is a union of repeated full windows. The earliest copy of a
window always lies in a first cell, so the rows compared at the second level are enough.

A passage may stand in a third of all documents. Equal cells are reduced within a slice of text before the shuffle.
A half that a task has met often already, in different stretches, has all further cells extended at once: two
stretches of it are in the shuffle, which has all their first cells extended too, so nothing is missed and no task is
sent a row for each document. Single windows are reduced to the first of their kind by an aggregation with partial
sums, and joined with it from written tables, where Spark can split a hot window's rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Powers, WordHasher, doc_text, grams, long, mix, slices, spread, stored, text_of

_U = np.uint64
_ODD, _ODD2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
#: Cells of one half that a task sends to be compared, about; further ones are extended without.
OFTEN = 64
#: Kinds of cells: to be compared, settled, to be extended without comparison.
_COMPARE, _SETTLED, _EXTEND = 0, 1, 2


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """For each start, how far on the least of `width` values is; the leftmost of equals."""
    v, o, have = values, np.zeros(len(values), np.int64), 1
    while have < width:
        step = min(have, width - have)
        v2, o2 = v[step:], o[step:] + step
        v1, o1 = v[: len(v2)], o[: len(o2)]
        less = v2 < v1
        v, o, have = np.where(less, v2, v1), np.where(less, o2, o1), have + step
    return o


def _ids(batch: pa.RecordBatch, at: int, count: int) -> np.ndarray:
    return batch.column("doc_id").slice(at, count).to_numpy(zero_copy_only=False)


def _first_of(keys: list[np.ndarray], docs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of keys, document and place; and which of them are the first with their keys."""
    order = np.lexsort([at, docs, *reversed(keys)])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, new


class _Often:
    """Halves that a task meets often: how many of their cells it sent to be compared, and whether in more than one
    stretch. Of bounded size: when it is full, all counts fall until rare halves give way."""

    SIZE = 1 << 16

    def __init__(self, most: int):
        self.most = most
        self.h, self.s, self.n, self.several = np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, bool)

    def extend(self, h: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Which of the cells (halves h, stretches s) need no comparison; the others are counted."""
        if not len(h):
            return np.zeros(0, bool)
        known = np.zeros(len(h), bool)
        if len(self.h):
            i = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            known = (self.h[i] == h) & (self.n[i] >= self.most) & self.several[i]
        sent = ~known
        hs, ss = np.concatenate([self.h, h[sent]]), np.concatenate([self.s, s[sent]])
        order = np.argsort(hs, kind="stable")
        hs, ss = hs[order], ss[order]
        first = np.flatnonzero(np.append(True, hs[1:] != hs[:-1]))
        other = ss != np.repeat(ss[first], np.diff(np.append(first, len(hs))))
        counts = np.concatenate([self.n, np.ones(int(sent.sum()), np.int64)])[order]
        several = np.concatenate([self.several, np.zeros(int(sent.sum()), bool)])[order]
        self.h, self.s, self.n, self.several = hs[first], ss[first], np.add.reduceat(counts, first), np.logical_or.reduceat(several | other, first)
        if len(self.h) > self.SIZE:
            self.n = self.n - np.partition(self.n, -self.SIZE - 1)[-self.SIZE - 1]
            keep = self.n > 0
            self.h, self.s, self.n, self.several = self.h[keep], self.s[keep], self.n[keep], self.several[keep]
        return known


def _cells(length: int, most: int):
    """Rows h, s, doc_id, at of cells; at = start << 10 | kind << 8 | windows << 4 | offset of the half."""
    half, hasher, powers = length // 2, WordHasher(seed=2), Powers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = _Often(most)
        for batch in batches:
            for at, count, data, bounds in slices(batch):
                ids = _ids(batch, at, count)
                hashes, _, _, firsts = hasher.words(data, bounds)
                n = len(hashes) - length + 1
                if n <= 0:
                    continue
                g = grams(hashes, half)
                chosen = np.arange(n) + _least(g, length - half + 1)[:n]
                left = np.repeat(firsts[1:], np.diff(firsts))[:n]
                fits = np.arange(n) + length <= left
                owner = text_of(firsts)[:n]
                new = np.ones(n, bool)
                new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1]) | ~fits[:-1]
                begin = np.flatnonzero(new & fits)
                if not len(begin):
                    continue
                # a cell ends where the next begins or windows no longer fit
                edge = np.append(np.flatnonzero(new | ~fits), n)
                windows = edge[np.searchsorted(edge, begin, "right")] - begin
                up, down = powers.get(len(hashes) + 1)
                sums = np.zeros(len(hashes) + 1, _U)
                np.cumsum(hashes * up[:-1], dtype=_U, out=sums[1:])
                span = windows + length - 1
                offset = chosen[begin] - begin
                s = mix((sums[begin + span] - sums[begin]) * down[begin] + span.astype(_U) * _ODD + offset.astype(_U) * _ODD2)
                h = g[chosen[begin]]
                doc = ids[owner[begin]].astype(np.int64)
                place = begin - firsts[:-1][owner[begin]]
                order, first = _first_of([h, s], doc, place)
                h, s, doc, place, windows, offset = (x[order] for x in (h, s, doc, place, windows, offset))
                # later ones of the slice are settled: they go along under keys of their own, like those to extend
                head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
                same = ~first & (doc == doc[head]) & (place == place[head])
                kind = np.where(first, _COMPARE, _SETTLED)
                rows = np.flatnonzero(first)
                kind[rows[often.extend(h[rows], s[rows])]] = _EXTEND
                packed = place << 10 | kind << 8 | windows << 4 | offset
                h = np.where(kind == _COMPARE, h, mix(doc.astype(_U) * _ODD + place.astype(_U)))
                keep = ~same
                yield pa.RecordBatch.from_arrays([long(h[keep]), long(s[keep]), pa.array(doc[keep]), pa.array(packed[keep])], ["h", "s", "doc_id", "at"])

    return run


def _settle(length: int):
    """From cells in order of h, s, doc_id, at: doc_id, start, n, windows. Settled stretches of n words (windows false),
    and cells to extend, of n windows (windows true)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ph = ps = None  # keys of the last row
        pdoc = pplace = 0  # the first cell of its stretch
        classes, held = 0, None  # stretches of its half so far; the only one's first row
        for batch in batches:
            h, s, doc, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            kind = at >> 8 & 3
            flagged = [np.flatnonzero(kind == _SETTLED)]
            rows = np.flatnonzero(kind == _COMPARE)
            expand: list[np.ndarray] = [np.flatnonzero(kind == _EXTEND)]
            prior = []
            if len(rows):
                h_, s_, d_, a_ = h[rows], s[rows], doc[rows], at[rows] >> 10
                new_h = np.ones(len(rows), bool)
                new_h[1:] = h_[1:] != h_[:-1]
                new_h[0] = ph is None or h_[0] != ph
                new_s = new_h.copy()
                new_s[1:] |= s_[1:] != s_[:-1]
                new_s[0] |= ps is None or s_[0] != ps
                head = np.maximum.accumulate(np.where(new_s, np.arange(len(rows)), -1))
                hd, ha = np.where(head >= 0, d_[head], pdoc), np.where(head >= 0, a_[head], pplace)
                later = ~new_s & ((d_ != hd) | (a_ != ha))
                flagged.append(rows[later])
                group = np.cumsum(new_h)  # 0: goes on from the batch before
                per = np.bincount(group, weights=new_s, minlength=group[-1] + 1).astype(np.int64)
                per[0] += classes
                if per[0] > 1 and held is not None:
                    prior.append(held)
                    held = None
                many = per > 1
                expand.append(rows[new_s & many[group]])
                last = group[-1]
                classes = int(per[last])
                if last > 0:
                    held = None
                if classes == 1 and last > 0:
                    i = rows[np.flatnonzero(new_s & (group == last))[0]]
                    held = (int(doc[i]), int(at[i]))
                ph, ps, pdoc, pplace = h_[-1], s_[-1], hd[-1], ha[-1]
            f, e = np.concatenate(flagged), np.concatenate(expand)
            extra = np.array(prior, np.int64).reshape(-1, 2)
            d_out = np.concatenate([doc[f], doc[e], extra[:, 0]])
            a_out = np.concatenate([at[f], at[e], extra[:, 1]])
            windows = np.arange(len(d_out)) >= len(f)
            n = (a_out >> 4 & 15) + np.where(windows, 0, length - 1)
            if len(d_out):
                yield pa.RecordBatch.from_arrays([pa.array(d_out), pa.array(a_out >> 10), pa.array(n), pa.array(windows)], ["doc_id", "start", "n", "windows"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the shuffle."""
    codec = zstandard.ZstdCompressor(level=1, write_content_size=True)
    for batch in batches:
        z = [codec.compress(x) for x in batch.column("text").cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(z, pa.binary())], ["doc_id", "z"])


def _windows(length: int):
    """Rows w1, w2, doc_id, start, later of the windows of cells to extend; later: an equal one stands before it here."""
    hasher = WordHasher(seed=2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            doc, cells = batch.column("doc_id").to_numpy(), batch.column("cells")
            flat, off = cells.values, np.asarray(cells.offsets)
            start, n = (np.asarray(flat.field(i)) for i in range(2))
            for i, z in enumerate(batch.column("z").to_pylist()):
                data = np.frombuffer(codec.decompress(z), np.uint8)
                hashes, _, _, _ = hasher.words(data, np.array([0, len(data)]))
                at = np.unique(spread(start[off[i] : off[i + 1]], n[off[i] : off[i + 1]]))
                at = at[at + length <= len(hashes)]
                w1 = np.zeros(len(at), _U)
                w2 = np.zeros(len(at), _U)
                for j in range(length):
                    x = hashes[at + j]
                    w1 = w1 * _ODD + x
                    w2 = w2 * _ODD2 + (x ^ (x >> _U(31)))
                w1, w2 = mix(w1), mix(w2 + _ODD)
                order, first = _first_of([w1, w2], np.zeros(len(at), np.int64), at)
                w1, w2, at = w1[order], w2[order], at[order]
                yield pa.RecordBatch.from_arrays([long(w1), long(w2), pa.array(np.full(len(at), doc[i])), pa.array(at), pa.array(~first)], ["w1", "w2", "doc_id", "start", "later"])

    return run


def _strip(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            total, removed, digests, texts = [], [], [], []
            for z, cells in zip(batch.column("z").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                words = codec.decompress(z).split()
                gone = 0
                total.append(len(words))
                if cells:
                    mask = np.zeros(len(words) + 1, np.int64)
                    start = np.minimum(np.array([c["start"] for c in cells]), len(words))
                    np.add.at(mask, start, 1)
                    np.add.at(mask, np.minimum(start + np.array([c["n"] for c in cells]), len(words)), -1)
                    keep = np.cumsum(mask[:-1]) == 0
                    gone = len(words) - int(keep.sum())
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                removed.append(gone)
                kept = b" ".join(words)
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode())
            out = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                out, names = [*out, pa.array(texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def repeated_spans(docs: DataFrame, length: int = 20, often: int = OFTEN) -> DataFrame:
    """doc_id, start, n: stretches of n words from word `start` that windows repeated from earlier cover."""
    if length % 2 or not 4 <= length <= 28:
        raise ValueError("length must be even and from 4 to 28")
    text = doc_text(docs).filter("doc_id is not null")
    cells = text.mapInArrow(_cells(length, often), "h long, s long, doc_id long, at long")
    met = cells.repartition("h").sortWithinPartitions("h", "s", "doc_id", "at")
    settled = stored(met.mapInArrow(_settle(length), "doc_id long, start long, n long, windows boolean"), "cells")
    extend = settled.filter("windows").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("cells"))
    packed = text.mapInArrow(_packed, "doc_id long, z binary")
    single = packed.join(extend, "doc_id").select("doc_id", "z", "cells").mapInArrow(_windows(length), "w1 long, w2 long, doc_id long, start long, later boolean")
    single = stored(single, "windows")
    rest = single.filter("not later").select("w1", "w2", "doc_id", "start")
    firsts = stored(rest.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "firsts")
    found = rest.join(firsts, ["w1", "w2"]).filter(F.struct("doc_id", "start") > F.col("first"))
    windows = single.filter("later").select("doc_id", "start").unionByName(found.select("doc_id", "start"))
    return settled.filter("not windows").select("doc_id", "start", "n").unionByName(windows.withColumn("n", F.lit(length).cast("long")))


def drop_repeated_windows(docs: DataFrame, length: int = 20, with_text: bool = False, often: int = OFTEN) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for each row of docs (doc_id, text, ...).

    Words are runs of anything but ASCII white space. A word is removed if a window of `length` words covers it whose
    words also start earlier: in a document of smaller doc_id, or before it in the same one, both as given. Kept words
    are joined by one space.

    A null text has no words. A null doc_id takes no part: nothing is removed from it or because of it. Rows that
    share a doc_id are one document: what is removed at a place of one goes at that place of all, and equal places
    are not earlier than each other. An empty table gives an empty result; other columns are ignored. often changes how
    the work is dealt out, never the result.
    """
    spans = repeated_spans(docs, length, often).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("cells"))
    packed = doc_text(docs).mapInArrow(_packed, "doc_id long, z binary")
    both = packed.join(spans, "doc_id", "left").select("doc_id", "z", "cells")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return both.mapInArrow(_strip(with_text), schema)
