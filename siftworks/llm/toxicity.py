"""Toxicity by compression distance: two trained zstandard dictionaries, and how much shorter one makes each window.

Labels mark whole documents, most of whose words are ordinary. So the toxic text that a dictionary is trained on are
the words of toxic documents that begin with a segment which marks such documents (far more frequent in them than in
ordinary ones); near copies among the training documents count once, or one copied text would pass for common usage.
The ordinary dictionary is trained by the same zstandard trainer, with the same parameters, on as many words of
ordinary documents, and both are cut to the same size. Both stand before the same background, a dictionary trained on
windows of ordinary text, which keeps common words from drowning the difference.

Windows of a few words are compressed with both. Ordinary windows get about the same length twice; a window with toxic
words gets shorter with the toxic dictionary. A document's counts of windows beyond several gains are then turned into
a probability by a logistic fit on labelled documents that the dictionaries weren't trained on.

Only the fit runs on the driver, on samples of bounded size; every window of every text is compressed in the cluster.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text

#: Labelled documents that the fit uses at most: toxic and ordinary ones for the dictionaries, any for the calibration.
TRAIN_TOXIC, TRAIN_ORDINARY, CALIBRATE = 1500, 3000, 5000
#: Characters of text that each of these three samples has at most.
TRAIN_CHARS = 20_000_000
WINDOW_WORDS = 8
#: Bytes that the trainer is asked for: for a class, and for the background; its segments, and the strings it counts.
CLASS_BYTES, BACKGROUND_BYTES, SEGMENT, COUNTED = 4096, 16384, 32, 6
#: Windows that the background is trained on at most.
BACKGROUND_WINDOWS = 40_000
_STEMS = (4, 5, 6, 7, 8, 10, 12)


def _lower(text: str) -> list[bytes]:
    return text.encode().lower().split()


def windows(words: list[bytes], size: int = WINDOW_WORDS) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)]


def _apart(texts: list[list[bytes]]) -> list[list[bytes]]:
    """The texts without near copies of earlier ones: those that share one of eight least hashes of word pairs."""
    seen: set[tuple[int, int]] = set()
    out = []
    for words in texts:
        pairs = {xxhash.xxh3_64_intdigest(a + b" " + b) for a, b in zip(words, words[1:], strict=False)} or {0}
        grams = np.array(sorted(pairs), np.uint64)
        least = {(k, int(((grams * np.uint64(2 * k + 1)) ^ (grams >> np.uint64(k + 7))).min())) for k in range(8)}
        if not least & seen:
            out.append(words)
        seen |= least
    return out


def _segments(words: list[bytes]) -> set[bytes]:
    out = set()
    for w in set(words):
        out |= {w[:k] for k in _STEMS if len(w) > k}
        out.add(w + b" ")
    return out


def toxic_segments(toxic: list[list[bytes]], ordinary: list[list[bytes]], ratio: float = 30.0, least: int = 5) -> list[bytes]:
    """Segments by falling share of toxic documents, each that marks them `ratio` times more often than ordinary ones.

    Of a word and its beginnings the longest that still stands for nearly all their documents is taken.
    """
    nt, no = max(1, len(toxic)), max(1, len(ordinary))
    tox, plain = (Counter(s for words in docs for s in _segments(words)) for docs in (toxic, ordinary))
    floor = max(least, 0.005 * nt)
    marks = {s: c for s, c in tox.items() if c >= floor and c / nt > ratio * (plain[s] + 0.5) / no and len(s) >= 4}
    longer: Counter = Counter()
    for s, c in marks.items():
        for k in range(3, len(s)):
            longer[s[:k]] = max(longer[s[:k]], c)
    ends = {s: c for s, c in marks.items() if longer[s] < 0.7 * c}
    stems = [s for s in ends if not s.endswith(b" ")]
    chosen = [s for s, c in ends.items() if not any(s != p and s.startswith(p) and ends[p] >= 1.5 * c for p in stems)]
    return sorted(chosen, key=lambda s: (-ends[s], s))


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]  # of features(), the constant first
    size: int

    def pair(self):
        return tuple(_codec(d).compress for d in (self.ordinary, self.toxic))


def _codec(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(window_log=15, chain_log=15, hash_log=15, search_log=4, min_match=5, target_length=16, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)


def gains(text: str, pair, size: int) -> np.ndarray:
    """By how many bytes each window is shorter with the toxic dictionary."""
    ordinary, toxic = pair
    return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(_lower(text), size)], np.int64)


def features(g: np.ndarray) -> list[float]:
    n = max(1, len(g))
    counts = [int((g >= k).sum()) for k in (1, 2, 3, 4, 6)]
    return [1.0, *[float(np.log1p(c)) for c in counts], float(np.log1p(100 * counts[2] / n)), float(min(12, g.max(initial=0))) / 4, float(np.log(n))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary that zstandard trains on the samples; of too few samples, these themselves."""
    try:
        whole = zstandard.train_dictionary(size, samples, k=SEGMENT, d=COUNTED).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]
    # the content stands behind the entropy tables, which end with the three repeat offsets
    return whole[whole.rfind(b"\x01\0\0\0\x04\0\0\0\x08\0\0\0") + 12 :]


def fit(toxic: list[str], ordinary: list[str], calibrate: list[tuple[str, int]], size: int = WINDOW_WORDS) -> Model:
    """A model from texts. Without toxic or ordinary texts both dictionaries are alike, and every score is the prior."""
    tox, plain = _apart([_lower(t) for t in toxic]), _apart([_lower(t) for t in ordinary])
    rng = random.Random(1)
    marks = tuple(b" " + s for s in toxic_segments(tox, plain)) if plain else ()
    padded = lambda docs: [b" " + w + b" " for words in docs for w in words]
    marked, common = [w for w in padded(tox) if w.startswith(marks)], padded(plain)
    windowed = [w for words in plain for w in windows(words, size)]
    background = _trained(rng.sample(windowed, min(len(windowed), BACKGROUND_WINDOWS)), BACKGROUND_BYTES) or b" " * 8
    one, other = _trained(marked, CLASS_BYTES), _trained(rng.sample(common, min(len(common), len(marked))), CLASS_BYTES)
    most = min(len(one), len(other))
    model = Model(other[len(other) - most :] + background, one[len(one) - most :] + background, [], size)
    pair = model.pair()
    x = np.array([features(gains(t, pair, size)) for t, _ in calibrate] or [features(np.zeros(0, np.int64))])
    y = np.array([v for _, v in calibrate] or [0], float)
    model.weights = logistic(x, y).tolist()
    return model


def _score(model: Model):
    weights = np.array(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.pair()
        for batch in batches:
            z = [float(np.dot(weights, features(gains(t, pair, model.size)))) for t in batch.column("text").to_pylist()]
            score = 1 / (1 + np.exp(-np.clip(np.array(z), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.3).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, size: int = WINDOW_WORDS, most: tuple[int, int, int] = (TRAIN_TOXIC, TRAIN_ORDINARY, CALIBRATE), chars: int = TRAIN_CHARS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text, ...); labels: doc_id, toxic.

    held_out: crc32 of the doc_id as text leaves 2 when divided by four. Labels of such documents are never read; of
    the others, those that leave 0 or 1 train the dictionaries and those that leave 3 calibrate: in order of a hash of
    their doc_id at most `most` of each, and of these one after the other as long as it fits into `chars` characters of
    text together. predicted is 1 from a score of 0.3.

    A null text counts as empty and gets the score of a text without toxic windows. A null doc_id is scored, not held
    out, and has no label. Repeated rows are scored alike; of contradicting labels the toxic one counts. Without
    labels all scores are 0.5 or the prior's. An empty table gives an empty result; other columns are ignored.
    """
    part = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 4
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("fold", part("doc_id")).filter("fold <> 2")
    order = (F.xxhash64("doc_id", F.lit(7)), F.col("doc_id"))
    chosen = []
    for k, (cond, n) in enumerate(zip(("fold < 2 and toxic = 1", "fold < 2 and toxic = 0", "fold = 3"), most, strict=True)):
        chosen.append(known.filter(cond).orderBy(*order).limit(n).withColumn("sample", F.lit(k)))
    ids = chosen[0].unionByName(chosen[1]).unionByName(chosen[2])  # as many as `most` says
    text = doc_text(docs)
    sizes = text.select("doc_id", F.length("text").cast("long").alias("n")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic", "fold", "sample").agg(F.sum("n").alias("n"))
    # as many rows as `most` says, of a number each: taken in order as long as there is room
    fitting, room = [], [chars] * len(most)
    for r in sizes.orderBy(*order).collect():
        if r["n"] <= room[r["sample"]]:
            room[r["sample"]] -= r["n"]
            fitting.append((r["doc_id"], r["toxic"], r["fold"]))
    fits = docs.sparkSession.createDataFrame(fitting, "doc_id long, toxic int, fold long")
    rows = text.join(F.broadcast(fits), "doc_id").select("doc_id", "text", "toxic", "fold").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    train = [r for r in rows if r["fold"] < 2]
    model = fit([r["text"] for r in train if r["toxic"]], [r["text"] for r in train if not r["toxic"]], [(r["text"], r["toxic"]) for r in rows if r["fold"] == 3], size)
    held = text.withColumn("held_out", F.coalesce(part("doc_id") == 2, F.lit(False)))
    return held.select("doc_id", "held_out", "text").mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
