"""Conversation repair: cheapest edits to alternating turns by a DP over segments of rows, with persistent audits."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from functools import cmp_to_key, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rows of one segment: 2 ** SEGMENT_BITS at most.
SEGMENT_BITS = 13
#: What a kept role must begin with, by state: nothing kept yet, then a system, a user or an assistant row.
START, S, U, A = range(4)
_CLASS = {"s": S, "u": U, "a": A}
_LEGAL = {(S, U), (U, A), (A, U)}
_FAULTS = (None, "blank", "duplicate", "truncated")
INSERT, DELETE, KEEP, REROLE = "IDKR"
COSTS = {INSERT: 2, DELETE: 3, KEEP: 0, REROLE: 2}
TRUNCATED_COST = 1
_NEVER = 1 << 60


class Audits:
    """Edit sequences that share their prefixes: a sequence is a node, its parent the sequence without its last letter.

    Each node has its ancestors at distances 1, 2, 4, .. and a rolling hash of its letters. Two sequences compare by
    the end of their longest common prefix, which a search over the ancestors finds from the hashes. Prefixes that the
    hashes call equal are then compared letter by letter, back to where their nodes meet or to a pair that was compared
    before; where they differ after all, the sequences are spelt out. Letters may be anything that has an order."""

    def __init__(self, modulus: int = (1 << 61) - 1):
        self.modulus = modulus
        self.letter: list = [None]
        self.depth, self.hash, self.up = [0], [0], [()]
        self.equal: set[tuple[int, int]] = set()
        self.collisions = 0

    def extend(self, node: int, letter) -> int:
        new, up, k = len(self.letter), [node], 0
        while k < len(self.up[up[-1]]):
            up.append(self.up[up[-1]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * 1_000_003 + (ord(letter) if isinstance(letter, str) else letter) + 7) % self.modulus)
        self.up.append(tuple(up))
        return new

    def prefix(self, node: int, depth: int) -> int:
        """The first `depth` letters of a sequence."""
        while far := self.depth[node] - depth:
            node = self.up[node][far.bit_length() - 1]
        return node

    def spell(self, node: int) -> list:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return out[::-1]

    def _same(self, x: int, y: int) -> bool:
        """Whether two sequences of equal hash and length are equal, letter by letter."""
        walked = []
        while x != y and (x, y) not in self.equal:
            if self.letter[x] != self.letter[y]:
                self.collisions += 1
                return False
            walked.append((x, y))
            x, y = self.up[x][0], self.up[y][0]
        self.equal.update(walked[:1])
        return True

    def compare(self, a: int, b: int) -> int:
        """Below, equal to or above 0 as a comes before, with or after b; a prefix comes first."""
        if a == b:
            return 0
        short = min(self.depth[a], self.depth[b])
        x, y = self.prefix(a, short), self.prefix(b, short)
        if self.hash[x] == self.hash[y]:
            if self._same(x, y):
                return self.depth[a] - self.depth[b]
        else:
            for k in range(len(self.up[x]) - 1, -1, -1):
                if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            if self._same(self.up[x][0], self.up[y][0]):
                return -1 if self.letter[x] < self.letter[y] else 1
        one, two = self.spell(a), self.spell(b)
        return (one > two) - (one < two)


def _least(audits: Audits, found: list[tuple[int, int, str]]) -> tuple[int, int]:
    """Of (cost, sequence, letters to add) the cheapest, ties by letters: cost and new sequence."""
    cost = min(x[0] for x in found)
    best = None
    for c, node, letters in found:
        if c == cost:
            for x in letters:
                node = audits.extend(node, x)
            if best is None or audits.compare(node, best) < 0:
                best = node
    return cost, best


def _step(state: dict[int, tuple[int, int]], row: int, audits: Audits) -> dict[int, tuple[int, int]]:
    """The cheapest audits of each state after one more row: inserts, then the row's edit. row: class + 4 x fault."""
    kind, fault = row % 4, row // 4
    extra = TRUNCATED_COST if fault == 3 else 0
    # more inserts than one between user and assistant, or two at the beginning, come back to a state at a higher cost
    before = [(q, c, n, "") for q, (c, n) in state.items()]
    before += [(U, c + COSTS[INSERT], n, INSERT) for q, (c, n) in state.items() if q != U]
    before += [(A, c + COSTS[INSERT], n, INSERT) for q, (c, n) in state.items() if q == U]
    before += [(A, c + 2 * COSTS[INSERT], n, INSERT * 2) for q, (c, n) in state.items() if q in (START, S)]
    to: dict[int, list] = {}
    for q, c, n, inserted in before:
        to.setdefault(q, []).append((c + COSTS[DELETE], n, inserted + DELETE))
        if fault in (1, 2):
            continue
        if (q, kind) in _LEGAL or q == START and kind in (S, U):
            to.setdefault(kind, []).append((c + COSTS[KEEP] + extra, n, inserted + KEEP))
        to.setdefault(A if q == U else U, []).append((c + COSTS[REROLE] + extra, n, inserted + REROLE))
    return {q: _least(audits, found) for q, found in to.items()}


def _run(rows: bytes, start: int, audits: Audits) -> dict[int, tuple[int, int]]:
    state = {start: (0, 0)}
    for row in rows:
        state = _step(state, row, audits)
    return state


@lru_cache(maxsize=4096)
def segment_costs(rows: bytes, starts: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """For each first and last state (4 x first + last): the least cost over a segment, and where the cheapest audit
    stands among those of the other pairs. The audits have one letter for each row after its inserts and end in a row's
    letter, so none is a part of another's beginning, and ranks decide between sequences of segments."""
    audits, costs = Audits(), [_NEVER] * 16
    nodes = {}
    for p in starts:
        for q, (cost, node) in _run(rows, p, audits).items():
            costs[4 * p + q], nodes[4 * p + q] = cost, node
    order = sorted(nodes, key=cmp_to_key(lambda x, y: audits.compare(nodes[x], nodes[y])))
    ranks, rank = [-1] * 16, 0
    for i, at in enumerate(order):
        rank += i > 0 and audits.compare(nodes[order[i - 1]], nodes[at]) != 0
        ranks[at] = rank
    return costs, ranks


@lru_cache(maxsize=4096)
def segment_audit(rows: bytes, start: int, end: int) -> str:
    """The cheapest edits of a segment between two states, ties ASCII-least."""
    audits = Audits()
    return "".join(audits.spell(_run(rows, start, audits)[end][1]))


#: What is inserted after the last row to end well, by the state there.
_CLOSING = {START: "", A: "", U: INSERT, S: INSERT * 2}


def best_path(segments: list[tuple[list[int], list[int]]], modulus: int = (1 << 61) - 1) -> tuple[int, list[tuple[int, int]], str]:
    """The least cost of a conversation, each segment's first and last state, and the inserts at the end. A letter of
    these audits is a segment's rank, so there is one node for each segment and state."""
    audits, pair = Audits(modulus), {}
    state = {START: (0, 0)}
    for costs, ranks in segments:
        after = {}
        for q in range(4):
            for p, (c, node) in state.items():
                if costs[4 * p + q] < _NEVER:
                    cost, new = c + costs[4 * p + q], audits.extend(node, ranks[4 * p + q])
                    pair[new] = (p, q)
                    if q not in after or (cost, 0) < (after[q][0], audits.compare(after[q][1], new)):
                        after[q] = (cost, new)
        state = after
    best = None
    for q, (c, node) in state.items():
        c += COSTS[INSERT] * len(_CLOSING[q])
        if best is None or c < best[0] or c == best[0] and audits.compare(node, best[1]) < 0:
            best = (c, node, _CLOSING[q])
    path, node = [], best[1]
    while node:
        path.append(pair[node])
        node = audits.up[node][0]
    return best[0], path[::-1], best[2]


# --- the stages ------------------------------------------------------------------------------------------------------

_KEY = ("turn", "role", "head", "digest", "copy")


def _order(*first: str | Column) -> list:
    return [*first, F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "head", "digest", "copy"]


def _keyed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, and what orders rows of one turn: the text's first 64 characters, then its digest,
    then the number of the copy."""
    copy = F.col("copy").cast("int") if "copy" in rows.columns else F.lit(0)
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copy.alias("copy"))
    return plain.withColumns({"head": F.substring("text", 1, 64), "digest": F.unhex(F.sha2("text", 256))})


class _Segment:
    """A run of rows of one conversation: what it sums up to."""

    NAMES = ("conv_id", "at", *_KEY, "rows", "faults", "illegal", "low", "high", "distinct", "first", "last", "costs", "ranks")

    def __init__(self, mid: int, conv, key: tuple, begins: bool):
        self.mid, self.conv, self.key, self.begins = mid, conv, key, begins
        self.rows, self.low, self.high, self.distinct = bytearray(), None, None, 0

    def add(self, role: str, fault: int, turn: int | None) -> None:
        self.rows.append(_CLASS.get(role[:1], 0) + 4 * fault)
        if turn is not None and turn != self.high:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1

    def row(self) -> tuple:
        rows = bytes(self.rows)
        costs, ranks = segment_costs(rows, (START,) if self.begins else (START, S, U, A))
        faults = [sum(x >> 2 == k for x in rows) for k in (1, 2, 3)]
        illegal = sum((a & 3, b & 3) not in _LEGAL for a, b in zip(rows, rows[1:], strict=False))
        return self.conv, self.mid, *self.key, rows, faults, illegal, self.low, self.high, self.distinct, rows[0] & 3, rows[-1] & 3, costs, ranks


def _batch(rows: list[tuple], names: tuple[str, ...], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


_LONGS = pa.list_(pa.int64())


def _segments(bits: int):
    """Rows by block and place, each row's place announced before it where it is the first of its kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, block, now, types = None, None, None, None
        for b in batches:
            done = []
            types = types or [b.column("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.binary(), _LONGS, *[pa.int64()] * 6, _LONGS, _LONGS]
            for mid, announced, conv, turn, role, head, digest, copy, blank, cut in zip(*[b.column(x).to_pylist() for x in ("mid", "announced", "conv_id", *_KEY, "blank", "cut")], strict=True):
                if announced:
                    first = mid
                    continue
                if now is None or block != mid >> bits or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    # a conversation that begins inside a block has no earlier segment
                    now = _Segment(mid, conv, (turn, role, head, digest, copy), now is not None and block == mid >> bits)
                    block = mid >> bits
                now.add(role, 1 if blank else 2 if first != mid else 3 if cut else 0, turn)
            if done:
                yield _batch(done, _Segment.NAMES, types)
        if now is not None:
            yield _batch([now.row()], _Segment.NAMES, types)

    return run


_PLAN = ("conv_id", "at", "start", "end", "closing", "report", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments by conversation and place: a row for each segment with its states, and on a conversation's last the report."""
    held: list[dict] = []

    def planned() -> list[tuple]:
        cost, path, closing = best_path([(x["costs"], x["ranks"]) for x in held])
        faults = [sum(x["faults"][k] for x in held) for k in range(3)]
        illegal = sum(x["illegal"] for x in held) + sum((x["last"], y["first"]) not in _LEGAL for x, y in zip(held, held[1:], strict=False))
        dated = [x for x in held if x["low"] is not None]
        distinct = sum(x["distinct"] for x in dated) - sum(x["high"] == y["low"] for x, y in zip(dated, dated[1:], strict=False))
        gaps = dated[-1]["high"] - dated[0]["low"] + 1 - distinct if dated else 0
        end = len(held) - 1
        return [(x["conv_id"], x["at"], p, q, closing if i == end else "", i == end, gaps, *faults, illegal, cost) for i, (x, (p, q)) in enumerate(zip(held, path, strict=True))]

    types = None
    for b in batches:
        done = []
        types = types or [b.column("conv_id").type, pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), *[pa.int64()] * 6]
        for x in b.to_pylist():
            if held and held[0]["conv_id"] != x["conv_id"]:
                done += planned()
                held = []
            held.append(x)
        if done:
            yield _batch(done, _PLAN, types)
    if held:
        yield _batch(planned(), _PLAN, types)


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each segment as text."""
    for b in batches:
        found = [segment_audit(rows, p, q) + closing for rows, p, q, closing in zip(*[b.column(x).to_pylist() for x in ("rows", "start", "end", "closing")], strict=True)]
        kept = ["conv_id", *_KEY]
        yield pa.RecordBatch.from_arrays([*[b.column(x) for x in kept], pa.array(found, pa.string())], [*kept, "audit"])


_EDITS = ("conv_id", "turn", "role", "text", "edit")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each segment's edits before its first row: the edits with what they leave."""
    state, conv, audit, types, any_row = START, None, "", None, False
    at = 0

    def take(turn, role, text) -> list[tuple]:
        """The inserts that come next, then the edit of a row; without a role, the inserts alone."""
        nonlocal state, at
        out = []
        while at < len(audit) and (role is not None or audit[at] == INSERT):
            edit, at = audit[at], at + 1
            if edit == DELETE:
                return [*out, (conv, turn, role, None, edit)]
            state = _CLASS[role[0]] if edit == KEEP else A if state == U else U
            name = role if edit == KEEP else "assistant" if state == A else "user"
            out.append((conv, None, name, "", edit) if edit == INSERT else (conv, turn, name, text, edit))
            if edit != INSERT:
                return out
        return out

    for b in batches:
        done = []
        types = types or [b.column("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()]
        for c, turn, role, text, edits in zip(*[b.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "audit")], strict=True):
            if edits is None:
                done += take(turn, role, text)
                continue
            done += take(None, None, None)
            if not any_row or c != conv:
                state = START
            any_row, conv, audit, at = True, c, edits, 0
        if done:
            yield _batch(done, _EDITS, types)
    if any_row and (done := take(None, None, None)):
        yield _batch(done, _EDITS, types)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of conversations with the faults that crc32("conv_id:turn") % 20 chooses: 0 drops a row, 1 empties its
    text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's. Nulls count as
    one space; `copy` is 1 for a repeat."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("case"))
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("case") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.filter("case <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy"))


def repair(rows: DataFrame, segment_bits: int = SEGMENT_BITS) -> tuple[DataFrame, DataFrame]:
    """The edits that repair each conversation, and a report. rows: conv_id, turn, role, text, and `copy` if rows of one
    turn have an order of their own.

    A conversation's rows come by turn, nulls first, then by role, the text's first 64 characters, its digest, and copy.
    The first fault of a row counts: blank (white space alone), duplicate (role and text of an earlier row of the
    conversation), truncated (doesn't end in a full stop, exclamation or question mark). An edit keeps a row (0), makes
    it the user's or the assistant's (2), deletes it (3; the only edit of blank and duplicate rows), or inserts an empty
    turn of user or assistant anywhere (2); a truncated row that stays costs 1 more. The repaired roles are nothing, or
    at most one system row and then user and assistant in turns, ending with the assistant. Of the cheapest sequences
    of edits the one whose initials are ASCII-least is taken.

    Edits: conv_id, turn, role, text, edit (K, R, D, I), in order within each task and each conversation in one; role
    and text are what the edit leaves (a deleted row has its role and no text, an inserted one no turn). Report:
    conv_id, gaps, blank, duplicate, truncated, illegal (adjacent roles other than system-user, user-assistant,
    assistant-user), cost.

    Rows are placed in ranges of their order and written without their texts. A segment is a conversation's rows within
    2 ** segment_bits places; its least costs from each state to each (and how its audits compare) form a small matrix,
    so segments are worked on by themselves, and a conversation combines a row for each of its segments. Duplicates are
    found by aggregation. Texts are shuffled once, and stream by while their edits are applied.

    Null roles and texts are one space. A null conv_id is one conversation; repeated rows are duplicates; an empty table
    gives empty results; other columns are ignored."""
    kinds = dict(rows.dtypes)
    keyed = _keyed(rows)
    end = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    bare = keyed.select("conv_id", *_KEY, (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    order = _order()
    placed = stored(bare.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mid", F.monotonically_increasing_id()), "places")
    firsts = placed.groupBy("conv_id", "role", "digest").agg(F.min("mid").alias("mid")).select("mid", F.lit(True).alias("announced"))
    told = placed.withColumn("announced", F.lit(False)).unionByName(firsts, allowMissingColumns=True)
    block = F.shiftright("mid", segment_bits)
    schema = f"conv_id {kinds['conv_id']}, at bigint, turn bigint, role string, head string, digest binary, copy int, rows binary, faults array<bigint>, illegal bigint, low bigint, high bigint, distinct bigint, first bigint, last bigint, costs array<bigint>, ranks array<bigint>"
    columns = ["mid", "announced", "conv_id", *_KEY, "blank", "cut"]
    segments = stored(told.select(*columns).repartition(block).sortWithinPartitions("mid", F.desc("announced")).mapInArrow(_segments(segment_bits), schema), "segments")
    summary = segments.select("conv_id", "at", "faults", "illegal", "low", "high", "distinct", "first", "last", "costs", "ranks")
    plan_schema = f"conv_id {kinds['conv_id']}, at bigint, start int, end int, closing string, report boolean, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
    plan = stored(summary.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_plan, plan_schema), "plans")
    piece_schema = f"conv_id {kinds['conv_id']}, turn bigint, role string, head string, digest binary, copy int, audit string"
    pieces = segments.select("conv_id", "at", *_KEY, "rows").join(plan.select("at", "start", "end", "closing"), "at").select("conv_id", *_KEY, "rows", "start", "end", "closing").mapInArrow(_audit, piece_schema)
    both = keyed.unionByName(pieces, allowMissingColumns=True)
    lined = both.repartition("conv_id").sortWithinPartitions(*_order(), F.asc_nulls_last("audit"))
    edits = lined.select("conv_id", "turn", "role", "text", "audit").mapInArrow(_apply, f"conv_id {kinds['conv_id']}, turn bigint, role string, text string, edit string")
    report = plan.filter("report").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return edits, report


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types, now = ("conv_id", "audit", "repaired_sha256"), None, None
    for b in batches:
        done = []
        types = types or [b.column("conv_id").type, pa.string(), pa.string()]
        for conv, role, text, edit in zip(*[b.column(x).to_pylist() for x in ("conv_id", "role", "text", "edit")], strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    done.append((now[0], now[1].getvalue(), now[2].hexdigest()))
                now, any_row = (conv, io.StringIO(), hashlib.sha256()), False
            now[1].write(edit)
            if edit != DELETE:
                now[2].update(("\n" if any_row else "").encode() + f"{role}:{text}".encode())
                any_row = True
        if done:
            yield _batch(done, names, types)
    if now is not None:
        yield _batch([(now[0], now[1].getvalue(), now[2].hexdigest())], names, types)


def repaired_digests(conversations: DataFrame) -> DataFrame:
    """Each conversation of the table, damaged and repaired: gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 (role:text of the repaired rows, newline-joined). One of which no row is left after the damage has
    zeros, an empty audit and the hash of nothing. Odd rows as in `repair`."""
    edits, report = repair(damage(conversations))
    kind = dict(conversations.dtypes)["conv_id"]
    digests = edits.select("conv_id", "role", "text", "edit").mapInArrow(_digests, f"conv_id {kind}, audit string, repaired_sha256 string")
    every = conversations.select("conv_id").distinct()
    same = lambda other: F.col("e.conv_id").eqNullSafe(F.col(f"{other}.conv_id"))
    joined = every.alias("e").join(report.alias("r"), same("r"), "left").join(digests.alias("d"), same("d"), "left")
    numbers = [F.coalesce(f"r.{c}", F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("e.conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repair_sql() -> str:
    """The whole of op11 in SQL: the DP keeps whole audits and results as strings."""
    return r"""with recursive base as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    [ord(c)::ubigint for c in string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), '')] as bytes from conversations
), cased as (
  select *, xor(list_reduce(list_prepend(4294967295::ubigint, bytes), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::ubigint))), 4294967295::ubigint) % 20 as kind from base
), damaged as (
  select conv_id, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, copy
  from cased, unnest(case kind when 3 then [0, 1] else [0] end) as t(copy) where kind <> 0
), numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, substring(text, 1, 64), sha256(text), copy) as n, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare, left(role, 1) as i from damaged
), faulty as (
  select *, case when bare = '' then 1 when row_number() over (partition by conv_id, role, text order by n) > 1 then 2 when right(bare, 1) not in ('.', '!', '?') then 3 else 0 end as fault,
    n > 1 and lag(i) over (partition by conv_id order by n) || i not in ('su', 'ua', 'au') as illegal from numbered
), inserts(q, q1, letters, lines) as (
  values ('', '', '', ''), ('s', 's', '', ''), ('u', 'u', '', ''), ('a', 'a', '', ''), ('', 'u', 'I', 'user:' || chr(10)), ('s', 'u', 'I', 'user:' || chr(10)), ('a', 'u', 'I', 'user:' || chr(10)),
    ('u', 'a', 'I', 'assistant:' || chr(10)), ('', 'a', 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), ('s', 'a', 'II', 'user:' || chr(10) || 'assistant:' || chr(10))
), walk as (
  select distinct conv_id, 0::bigint as n, '' as q, {'cost': 0, 'audit': '', 'result': ''} as best from faulty
  union all
  select conv_id, n, q2, min({'cost': cost, 'audit': audit, 'result': result}) from (
    select f.conv_id, f.n, case e when 'D' then q1 when 'K' then i when 'R' then case q1 when 'u' then 'a' else 'u' end end as q2,
      best.cost + 2 * length(letters) + case e when 'D' then 3 when 'K' then 0 else 2 end + case when e <> 'D' and fault = 3 then 1 else 0 end as cost, best.audit || letters || e as audit,
      best.result || lines || case e when 'D' then '' else case e when 'K' then role else case q1 when 'u' then 'assistant' else 'user' end end || ':' || text || chr(10) end as result
    from walk w join faulty f on f.conv_id is not distinct from w.conv_id and f.n = w.n + 1 join inserts using (q), (values ('D'), ('K'), ('R')) t(e)
    where e = 'D' or fault not in (1, 2) and (e = 'R' or q1 || i in ('su', 'ua', 'au') or q1 = '' and i in ('s', 'u'))
  ) group by conv_id, n, q2
), ended as (
  select conv_id, min({'cost': best.cost + case q when 'u' then 2 when 's' then 4 else 0 end, 'audit': best.audit || case q when 'u' then 'I' when 's' then 'II' else '' end,
    'result': best.result || case q when 'u' then 'assistant:' || chr(10) when 's' then 'user:' || chr(10) || 'assistant:' || chr(10) else '' end}) as best
  from walk w where n = (select max(n) from faulty f where f.conv_id is not distinct from w.conv_id) group by conv_id
), counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated, count(*) filter (illegal) as illegal from faulty group by conv_id
)
select d.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(best.cost, 0)::bigint as cost,
  coalesce(best.audit, '') as audit, sha256(coalesce(left(best.result, greatest(length(best.result) - 1, 0)), '')) as repaired_sha256
from (select distinct conv_id from conversations) d left join counted c on c.conv_id is not distinct from d.conv_id left join ended e on e.conv_id is not distinct from d.conv_id"""
