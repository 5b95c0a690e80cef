"""Best-fit packing of tokenised documents into sequences, by bin completion over the table of lengths.

Packing depends on lengths alone, and there are at most `capacity` of them, so the search runs on the table of how
many pieces have each length: it is as small for 100 TB as for a test. It is a branch and bound over whole packings. It
branches over the undominated fillings of a sequence with the largest piece left (none of the pieces left out could
take the place of some of the filling's), least waste first, and over how many sequences get each filling. A branch is
cut once its sequences and a lower bound of the rest aren't fewer than the best packing's. Best fit and a narrow search
for each filling alone are the incumbents, for the whole and then for the rest each time this has halved. The search
ends when the best packing meets the lower bound, when all is tried, or after PACKING_NODES; fillings() says more.

The pieces of each length are numbered in the cluster (counts by task, a prefix sum, then numbers in each task) and
take their places by looking up which filling their number falls to. No piece goes to the driver.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_text, stored
from .tokens import ByteBpe

#: Branches that the search for one filling of an incumbent may enter before it takes the best one found.
SEARCH_NODES = 4000
#: Fillings that the search for the packing may look at or take in all before it ends with the best one found.
PACKING_NODES = 40_000
#: Depths of the search whose fillings are held at a time; the others are enumerated again when it gets back to them.
OPEN_DEPTHS = 32


def _pieces(capacity: int, json_path: str | None, ranks_path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(json_path, ranks_path)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(bpe.ids(text), 0).astype("<u4")
                at = 0
                first = len(ids) % capacity or capacity
                for k, end in enumerate(range(first, len(ids) + 1, capacity)):
                    for c, v in zip(cols, (doc_id, k, at, end - at, zlib.crc32(ids[at:end].tobytes())), strict=True):
                        c.append(v)
                    at = end
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, capacity: int = 2048, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and a closing 0, cut into pieces if longer than
    capacity; then all but the first are of that length. A null text is empty: one piece of the closing 0."""
    return doc_text(docs).mapInArrow(_pieces(capacity, json_path, ranks_path), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_filling(counts: np.ndarray, room: int, nodes: int = SEARCH_NODES) -> list[int]:
    """Lengths to put into `room`, at most counts[length] of each: a good filling by a narrow search that
    doesn't see all; fillings() takes it as an incumbent alone."""
    sizes = np.flatnonzero(counts[: room + 1])
    if not len(sizes) or sizes[-1] == 0:
        return []
    left = counts.copy()
    best: list[int] = []
    best_waste = room
    # the incumbent: best fit, the largest piece that fits, again and again
    rest, greedy = room, []
    while rest > 0:
        i = int(np.searchsorted(sizes, rest, "right")) - 1
        while i >= 0 and left[sizes[i]] == 0:
            i -= 1
        if i < 0 or sizes[i] == 0:
            break
        greedy.append(int(sizes[i]))
        left[sizes[i]] -= 1
        rest -= int(sizes[i])
    best, best_waste = greedy, rest
    left = counts.copy()
    budget = nodes
    smallest = int(sizes[sizes > 0][0])
    chosen: list[int] = []

    def search(rest: int, most: int) -> bool:
        """Fill rest with lengths of at most `most`; True once nothing is wasted."""
        nonlocal best, best_waste, budget
        if rest < best_waste:
            best, best_waste = chosen.copy(), rest
            if not rest:
                return True
        if rest < smallest or budget <= 0:
            return False
        if rest <= most and left[rest]:  # fits exactly: no other filling of this room is better
            best, best_waste = [*chosen, rest], 0
            return True
        i = int(np.searchsorted(sizes, min(rest, most), "right")) - 1
        while i >= 0 and budget > 0:
            s = int(sizes[i])
            i -= 1
            if s == 0 or not left[s]:
                continue
            if rest - s >= best_waste and rest - s < smallest:
                break  # narrow: two smaller ones may waste less, which fillings() tries
            budget -= 1
            chosen.append(s)
            left[s] -= 1
            done = search(rest - s, s)
            left[s] += 1
            chosen.pop()
            if done:
                return True
        return False

    if best_waste and nodes:
        search(room, room)
    return best


def _filled(have: np.ndarray, capacity: int, nodes: int) -> list[tuple[tuple[int, ...], int]]:
    """A packing by best_filling, each filling as often as the counts allow: an incumbent of fillings()."""
    have = have.copy()
    out: list[tuple[tuple[int, ...], int]] = []
    while True:
        sizes = np.flatnonzero(have)
        if not len(sizes):
            return out
        largest = int(sizes[-1])
        have[largest] -= 1
        rest = best_filling(have, capacity - largest, nodes)
        have[largest] += 1
        one = (largest, *sorted(rest, reverse=True))
        use, need = np.unique(one, return_counts=True)
        times = int((have[use] // need).min())
        have[use] -= need * times
        out.append((one, times))


def lower_bound(have: np.ndarray, capacity: int) -> int:
    """Sequences that have[length] pieces of each length need at least: tokens over capacity, and for each a the pieces
    too long to share one with any of length a or more, with those over the half and what of the others they can't take."""
    n, tokens = np.cumsum(have), np.cumsum(have * np.arange(capacity + 1))
    half = capacity // 2
    a = np.arange(half + 1)
    alone = n[capacity] - n[capacity - a]
    long, long_tokens = n[capacity - a] - n[half], tokens[capacity - a] - tokens[half]
    short = tokens[half] - np.where(a > 0, tokens[a - 1], 0)
    return int((alone + long + np.maximum(0, -((long * capacity - long_tokens - short) // capacity))).max())


def _reach(have: np.ndarray, sizes: list[int], room: int) -> list[int]:
    """For each i the sums up to room, as bits, that pieces of sizes[:i] (ascending) reach."""
    mask, out = (1 << room + 1) - 1, [1]
    for s in sizes:
        bits, left, step = out[-1], min(int(have[s]), room // s), 1
        while left > 0:
            n = min(step, left)
            bits |= bits << n * s & mask
            left -= n
            step *= 2
        out.append(bits)
    return out


def _sums(have: np.ndarray, sizes: list[int], reach: list[int], total: int, upto: int) -> Iterator[tuple[int, ...]]:
    """All ways to reach `total` with pieces of sizes[:upto], larger pieces first; no branch ends without one."""
    if not total:
        yield ()
    while total and reach[upto] >> total & 1:
        upto -= 1
        s = sizes[upto]
        for n in range(min(int(have[s]), total // s), 0, -1):
            if reach[upto] >> total - n * s & 1:
                for rest in _sums(have, sizes, reach, total - n * s, upto):
                    yield (s,) * n + rest


def _spread(bits: int, width: int) -> int:
    """bits, each also at the `width` places above it."""
    done = 0
    while done < width:
        step = min(done + 1, width - done)
        bits |= bits << step
        done += step
    return bits


def _dominated(have: np.ndarray, lengths: int, filling: tuple[int, ...], waste: int) -> bool:
    """Whether a piece left out could take the place of some of the filling's pieces and of its waste, and those that
    piece's place: a larger one for one piece or none, one at least as large for several. lengths: of `have`, as bits."""
    for s in set(filling):
        if have[s] == filling.count(s):
            lengths ^= 1 << s
    one = several = 0
    for s in filling:
        several |= (one | several) << s
        one |= 1 << s
    hit = _spread(several, waste) | (_spread((one | 1) << 1, waste - 1) if waste else 0)
    return bool(hit & lengths)


def _beside(have: np.ndarray, capacity: int) -> tuple[int, np.ndarray, list[int], list[int]]:
    """The largest length, what stands beside one such piece, its lengths that fit, and their sums."""
    largest = int(np.flatnonzero(have)[-1])
    have = have.copy()
    have[largest] -= 1
    sizes = np.flatnonzero(have[: capacity - largest + 1]).tolist()
    return largest, have, sizes, _reach(have, sizes, capacity - largest)


def _moves(have: np.ndarray, capacity: int, slack: int, budget: list[int]) -> Iterator[tuple[tuple[int, ...], int]]:
    """(filling, times) of the largest piece: all undominated fillings that waste at most slack, least waste first."""
    largest, have, sizes, reach = _beside(have, capacity)
    room, copies = capacity - largest, int(have[largest]) + 1
    lengths = sum(1 << s for s in sizes)
    for waste in range(min(slack, room) + 1):
        if not reach[-1] >> room - waste & 1:
            continue
        for rest in _sums(have, sizes, reach, room - waste, len(sizes)):
            if budget[0] <= 0:
                return
            budget[0] -= 1
            if _dominated(have, lengths, rest, waste):
                continue
            times = min([copies // (1 + rest.count(largest)), *(int(have[s]) // rest.count(s) for s in set(rest) - {largest})])
            for t in range(min(times, slack // waste) if waste else times, 0, -1):
                yield (largest, *rest), t


def fillings(counts: dict[int, int], capacity: int, nodes: int = PACKING_NODES) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many such sequences) that hold counts[length] pieces of each length, in the fewest
    sequences. If `nodes` end the search before it is through, it is the best one found, at least as good as the first
    incumbents, and may lie above lower_bound()."""
    have = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        have[size] = n
    count = lambda found: sum(n for _, n in found)
    quick = lambda: min((_filled(have, capacity, n) for n in (SEARCH_NODES, 0)), key=count)
    best = quick()
    least, needed = lower_bound(have, capacity), count(best)
    budget, used = [nodes], 0
    path: list[tuple[tuple[int, ...], int]] = []
    frames: list[list[int]] = [[0, 0]]  # at each depth the moves tried, and the waste that they were listed for
    open_: dict[int, Iterator] = {}  # the deepest depths' moves
    seen: dict[bytes, int] = {}
    tried = least  # lower bound where the rest was last packed in the quick ways
    while frames and needed > least and budget[0] > 0:
        depth = len(frames) - 1
        if len(path) > depth:  # back from the last move
            filling, times = path.pop()
            used -= times
            np.add.at(have, list(filling), times)
        if depth not in open_:
            if not frames[depth][0]:
                frames[depth][1] = (needed - 1 - used) * capacity - int((have * np.arange(capacity + 1)).sum())
            open_[depth] = islice(_moves(have, capacity, frames[depth][1], budget), frames[depth][0], None)
            open_.pop(depth - OPEN_DEPTHS, None)
        move = next(open_[depth], None)
        if move is None:
            del open_[depth]
            frames.pop()
            continue
        budget[0] -= 1
        frames[depth][0] += 1
        filling, times = move
        path.append(move)
        used += times
        np.subtract.at(have, list(filling), times)
        rest = lower_bound(have, capacity)
        if used + rest >= needed:
            continue
        if not rest:
            best, needed = path.copy(), used
            continue
        state = hashlib.sha256(have).digest()
        if seen.get(state, used + 1) <= used:
            continue
        seen[state] = used
        if rest * 2 <= tried:
            tried = rest
            tail = quick()
            if used + count(tail) < needed:
                best, needed = path + tail, used + count(tail)
        frames.append([0, 0])
    return best


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row how many rows of its length the task saw before."""
    seen: dict[int, int] = {}
    for batch in batches:
        length = batch.column("length").to_numpy()
        order = np.argsort(length, kind="stable")
        value, first, n = np.unique(length[order], return_index=True, return_counts=True)
        nth = np.empty(len(length), np.int64)
        base = np.array([seen.get(int(v), 0) for v in value], np.int64)
        nth[order] = np.arange(len(length)) - np.repeat(first, n) + np.repeat(base, n)
        for v, b, k in zip(value.tolist(), base.tolist(), n.tolist(), strict=True):
            seen[v] = b + k
        yield batch.append_column("nth", pa.array(nth))


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """cut (with a column length from 1 to capacity) with sequence_id and offset: where each row goes.

    A sequence holds at most capacity tokens and its pieces follow without a gap. An empty table stays empty.
    """
    spark = cut.sparkSession
    names = cut.columns
    spec = ", ".join(f"{n} {t}" for n, t in cut.dtypes)
    tagged = cut.withColumn("task", F.spark_partition_id().cast("long"))
    numbered = stored(tagged.mapInArrow(_number, f"{spec}, task long, nth long"), "numbered")
    per_task = numbered.groupBy("length", "task").agg(F.count("*").alias("n"))
    base = per_task.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots, sequence, used = [], 0, dict.fromkeys(counts, 0)
    for lengths, times in fillings(counts, capacity):
        at = 0
        for k, size in enumerate(lengths):  # the k-th piece of `times` sequences
            slots.append((size, used[size], used[size] + times, sequence, at))
            used[size] += times
            at += size
        sequence += times
    if not slots:
        return cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    # a few rows for each length and filling: bounded by the capacity, however many pieces there are
    plan = F.broadcast(spark.createDataFrame(slots, "length long, lo long, hi long, first long, offset long"))
    placed = numbered.join(base.select("length", "task", "base"), ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    spot = placed.join(plan, (placed["length"] == plan["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return spot.select(*[placed[n] for n in names], (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, capacity: int = 2048, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs (doc_id, text, ...).

    See pieces() and pack(). Null texts are empty documents of one closing id. Rows are packed each by itself, so a
    repeated or null doc_id gives pieces of its own. An empty table gives an empty result; other columns are ignored.
    """
    return pack(pieces(docs, capacity, json_path, ranks_path), capacity)
