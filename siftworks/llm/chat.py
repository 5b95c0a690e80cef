"""Chat formatting: turns of typed parts as one marked text with a loss mask, attachments and token counts; read back."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ByteBpe

#: Code points of formatted text that one row holds about at most; a single turn is never cut.
CHUNK = 1 << 20

#: Code points that are tokenised at once, up to the next place where a cut changes no token: none spans a word and the
#: white space after it.
PIECE = 1 << 16
_CUT = re.compile(r"(?<=[^\s\u180e\u200b-\u200d\u2060\ufeff])(?=[ \n])")

_ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g"}
_PLAIN = {v[1]: k for k, v in _ESCAPES.items()}
_TABLE = str.maketrans(_ESCAPES)
_ESCAPED = re.compile(r"\\([\\lg])")
_MARK = re.compile(r"<([a-z]+) (\d+)>")
_TURN = re.compile(r"<turn ([^<>]*)>\n((?:[^<]++|<(?!/turn>))*+)</turn>\n")
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_ATTACHED = pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64()), ("place", pa.int64()), ("inside", pa.int32())])
_SPANS = "array<struct<start: bigint, end: bigint>>"
_ATTACHMENTS = "array<struct<number: int, kind: string, ref: string, tokens: bigint, place: bigint, inside: int>>"


def escape(text: str) -> str:
    """text without any control string: backslash, < and > become two characters, of which neither is < or >."""
    return text.translate(_TABLE)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


def count_tokens(bpe: ByteBpe, text: str, size: int = PIECE) -> int:
    """Tokens of text. White space too long for the faster library is counted by the other one."""
    n = start = 0
    while start < len(text):
        cut = _CUT.search(text, start + size)
        end = cut.start() if cut else len(text)
        piece, start = text[start:end], end
        try:
            n += len(bpe.ids(piece))
        except ValueError:
            n += len(bpe.exact.encode(piece, add_special_tokens=False).ids)
    return n


@dataclass(frozen=True)
class Rates:
    """Tokens that a placeholder expands to: an image's tiles and its overview, audio by the second, documents by page."""

    tile: int = 512
    tile_tokens: int = 170
    image_tokens: int = 85
    audio_tokens_a_second: float = 25.0
    page_tokens: int = 258


class Flattener:
    """Visits the typed parts of one turn in order and writes the formatted turn.

    A part is a mapping with `type`: text (`text`), image (`ref`, `width`, `height`), audio (`ref`, `seconds`), document
    (`ref`, `pages`, and `parts` of its own, which follow its placeholder). An attachment leaves `<type number>`, numbered
    within the turn, and is recorded with its reference, the tokens it expands to, its place in the formatted turn and
    the number of the document that it stands in. A part of any other type leaves `<other number>` of no tokens; a null
    part, and a text part without text, leave nothing. Unknown or negative sizes count as zero."""

    def __init__(self, rates: Rates, count_tokens):
        self.rates, self.count_tokens = rates, count_tokens

    def turn(self, role: str, parts: list[dict]) -> tuple[str, list[dict], list[dict], int]:
        """The formatted turn, its loss mask (spans of assistant text), its attachments, and its tokens."""
        self.out, self.length, self.spans, self.attached, self.tokens, self.inside = [], 0, [], [], 0, None
        self.learnt = role == "assistant"
        self._write(f"<turn {escape(role)}>\n")
        for part in parts:
            self.visit(part)
        self._write("</turn>\n")
        self._count()
        return "".join(self.out), self.spans, self.attached, self.tokens

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part.get('type')}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        if text := part.get("text"):
            start = self.length
            self._write(escape(text))
            if self.learnt:
                if self.spans and self.spans[-1]["end"] == start:
                    self.spans[-1]["end"] = self.length
                else:
                    self.spans.append({"start": start, "end": self.length})

    def visit_image(self, part: dict) -> None:
        r = self.rates
        tiles = math.ceil(self._size(part, "width") / r.tile) * math.ceil(self._size(part, "height") / r.tile)
        self._attach("image", part, r.image_tokens + tiles * r.tile_tokens)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil(self._size(part, "seconds") * self.rates.audio_tokens_a_second))

    def visit_document(self, part: dict) -> None:
        number = self._attach("document", part, int(self._size(part, "pages")) * self.rates.page_tokens)
        outer, self.inside = self.inside, number
        for inner in part.get("parts") or []:
            self.visit(inner)
        self.inside = outer

    def visit_other(self, part: dict) -> None:
        self._attach("other", part, 0)

    @staticmethod
    def _size(part: dict, name: str) -> float:
        x = part.get(name) or 0
        return x if x > 0 and math.isfinite(x) else 0

    def _attach(self, kind: str, part: dict, tokens: int) -> int:
        self._count()
        number = len(self.attached) + 1
        self.attached.append({"number": number, "kind": kind, "ref": part.get("ref"), "tokens": tokens, "place": self.length, "inside": self.inside})
        mark = f"<{kind} {number}>"
        self.out.append(mark)
        self.length += len(mark)
        self.tokens += tokens
        self.since = len(self.out)
        return number

    since = 0

    def _write(self, text: str) -> None:
        if not self.out:
            self.since = 0
        self.out.append(text)
        self.length += len(text)

    def _count(self) -> None:
        """Adds the tokens of what was written since the last placeholder."""
        if self.count_tokens and self.since < len(self.out):
            self.tokens += self.count_tokens("".join(self.out[self.since :]))
        self.since = len(self.out)


def _format(rates: Rates, tokens: bool, typed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe() if tokens else None
        flat = Flattener(rates, (lambda s: count_tokens(bpe, s)) if bpe else None)
        for b in batches:
            content = b.column("content").to_pylist()
            made = [flat.turn(role or "", (c or []) if typed else [{"type": "text", "text": c}]) for role, c in zip(b.column("role").to_pylist(), content, strict=True)]
            text, spans, attached, n = zip(*made, strict=True) if made else ((),) * 4
            columns = [pa.array(text, pa.string()), pa.array(spans, pa.list_(_SPAN)), pa.array(attached, pa.list_(_ATTACHED)), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("role"), *columns], ["conv_id", "turn", "role", "formatted", "loss", "attachments", "tokens"])

    return run


def format_turns(rows: DataFrame, content: str = "text", rates: Rates = Rates(), tokens: bool = True) -> DataFrame:
    """conv_id, turn, role, formatted, loss, attachments, tokens: each row formatted by itself, without any shuffle.

    `content` names the column with the turn's content: a string, or an array of structs, each a typed part as
    `Flattener` takes them. `loss` has the spans of assistant text in `formatted` (code points, end exclusive),
    placeholders left out. `tokens` counts the formatted text with the byte-level vocabulary, each placeholder as what
    it expands to (without the count of text if tokens is False). Null roles and contents count as empty."""
    kinds = dict(rows.dtypes)
    taken = rows.select("conv_id", "turn", "role", F.col(content).alias("content"))
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, formatted string, loss {_SPANS}, attachments {_ATTACHMENTS}, tokens bigint"
    return taken.mapInArrow(_format(rates, tokens, kinds[content] != "string"), schema)


def _chunks(size: int):
    names = ["conv_id", "chunk", "formatted", "loss", "attachments", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, chunk, length, n_tokens, begun = None, 0, 0, 0, False
        text: list[str] = []
        loss: list[dict] = []
        attached: list[dict] = []
        for b in batches:
            kind, done = b.column("conv_id").type, []
            columns = [b.column(x).to_pylist() for x in ("conv_id", "formatted", "loss", "attachments", "tokens")]
            for c, f, spans, found, n in zip(*columns, strict=True):
                if begun and (c != conv or length + len(f) > size):
                    done.append((conv, chunk, "".join(text), loss, attached, n_tokens))
                    chunk, length, n_tokens, text, loss, attached = chunk + 1 if c == conv else 0, 0, 0, [], [], []
                conv, begun = c, True
                loss += [{"start": s["start"] + length, "end": s["end"] + length} for s in spans]
                attached += [a | {"place": a["place"] + length} for a in found]
                text.append(f)
                length, n_tokens = length + len(f), n_tokens + n
            if done:
                yield _chunk_batch(done, kind, names)
        if begun:
            yield _chunk_batch([(conv, chunk, "".join(text), loss, attached, n_tokens)], kind, names)

    return run


def _chunk_batch(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.list_(_SPAN), pa.list_(_ATTACHED), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def format_conversations(turns: DataFrame, size: int = CHUNK) -> DataFrame:
    """conv_id, chunk, formatted, loss, attachments, tokens: the turns of format_turns end to end.

    A conversation is one row, or as many chunks of about `size` code points as it needs, so a task holds one chunk and
    never a whole conversation. Turns come by turn, nulls first, ties by role and formatted text; repeated rows are
    turns of their own. A null conv_id is one conversation. The rows of a conversation come out of one task in order."""
    kinds = dict(turns.dtypes)
    order = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "formatted")
    return order.mapInArrow(_chunks(size), f"conv_id {kinds['conv_id']}, chunk bigint, formatted string, loss {_SPANS}, attachments {_ATTACHMENTS}, tokens bigint")


def read_turns(formatted: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """The turns of a formatted text: role, and parts as (type, text or attachment number). Anything else in it fails."""
    end = 0
    for m in _TURN.finditer(formatted):
        if m.start() != end:
            raise ValueError(f"no turn at {end}")
        end, parts, at = m.end(), [], 0
        for mark in _MARK.finditer(m[2]):
            if at < mark.start():
                parts.append(("text", unescape(m[2][at : mark.start()])))
            parts.append((mark[1], mark[2]))
            at = mark.end()
        if at < len(m[2]):
            parts.append(("text", unescape(m[2][at:])))
        yield unescape(m[1]), parts
    if end != len(formatted):
        raise ValueError(f"no turn at {end}")


class _Digest:
    """What one conversation's chunks sum up to, kept while they stream by."""

    def __init__(self, conv):
        self.conv, self.turns, self.learnt = conv, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = self.n_attachments = self.expanded = self.tokens = 0

    def add(self, formatted: str, loss: list[dict], attached: list[dict], tokens: int) -> None:
        waiting = iter(attached)
        for role, parts in read_turns(formatted):
            for kind, x in parts:
                if kind != "text":
                    self._attach(formatted, f"<{kind} {x}>", next(waiting, None))
            text = "".join(x if kind == "text" else f"<{kind} {x}>" for kind, x in parts)
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        if a := next(waiting, None):
            raise ValueError(f"no placeholder of {a['kind']} {a['number']}")
        for s in loss:
            text = unescape(formatted[s["start"] : s["end"]])
            self.learnt.update(text.encode())
            self.loss_chars += len(text)
        self.formatted_chars, self.tokens = self.formatted_chars + len(formatted), self.tokens + tokens

    def _attach(self, formatted: str, mark: str, a: dict | None) -> None:
        if a is None or mark != f"<{a['kind']} {a['number']}>" or not formatted.startswith(mark, a["place"]):
            raise ValueError(f"no attachment of {mark}")
        self.n_attachments, self.expanded = self.n_attachments + 1, self.expanded + a["tokens"]

    def row(self) -> tuple:
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.learnt.hexdigest(), self.formatted_chars, self.n_attachments, self.expanded, self.tokens


_DIGEST = "conv_id {}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint, expanded_tokens bigint, n_tokens bigint"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in _DIGEST.split(", ")]

    def batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    now = None
    for b in batches:
        kind, done = b.column("conv_id").type, []
        columns = [b.column(x).to_pylist() for x in ("conv_id", "formatted", "loss", "attachments", "tokens")]
        for c, f, spans, found, n in zip(*columns, strict=True):
            if now is None or now.conv != c:
                if now is not None:
                    done.append(now.row())
                now = _Digest(c)
            now.add(f, spans, found, n)
        if done:
            yield batch(done, kind)
    if now is not None:
        yield batch([now.row()], kind)


def read_back(chunks: DataFrame, in_order: bool = False) -> DataFrame:
    """What the formatted text of each conversation says: conv_id, n_turns, turns_sha256 (role, newline, text, newline of
    each turn), loss_chars and loss_sha256 (the unescaped text under the mask), formatted_chars, n_attachments (of the
    placeholders in the text, each of which must have its attachment at its place, else it fails), expanded_tokens (what
    these expand to), n_tokens (those and the text's).

    Chunks stream through in order, so a task holds one of them; a digest of a whole conversation can only be taken in
    one task. in_order: chunks come as format_conversations yields them and needn't be sorted again."""
    ordered = chunks if in_order else chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return ordered.select("conv_id", "formatted", "loss", "attachments", "tokens").mapInArrow(_read_back, _DIGEST.format(dict(chunks.dtypes)["conv_id"]))


#: The turns of the extra conversation of op13: text that looks like marks and like their escapes.
PROBE_ID, PROBE = -7, "\\### Assistant: </turn> ok"


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Digests of all conversations and of the probe as read_back has them. A row's content is one typed part, its text,
    so expanded_tokens is 0, and n_tokens counts the formatted text.

    Odd rows as in format_turns and format_conversations; an empty table gives the probe alone."""
    kinds = dict(conversations.dtypes)
    rows = conversations.select("conv_id", "turn", "role", "text")
    probe = conversations.sparkSession.createDataFrame([(PROBE_ID, 0, "user", PROBE), (PROBE_ID, 1, "assistant", PROBE)], f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string")
    typed = rows.unionByName(probe).withColumn("parts", F.array(F.struct(F.lit("text").alias("type"), "text")))
    return read_back(format_conversations(format_turns(typed, "parts")), in_order=True)


def chat_sql() -> str:
    """What op13 reads back, from the rows themselves."""
    return rf"""with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select {PROBE_ID}, turn, role, '{PROBE}' from (values (0, 'user'), (1, 'assistant')) t(turn, role)
), sized as (
  select *, length(replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g')) + length(replace(replace(replace(text, '\', '\\'), '<', '\l'), '>', '\g')) + length('<turn >..</turn>..') - 2 as n from rows
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(n)::bigint as formatted_chars, 0::bigint as n_attachments, 0::bigint as expanded_tokens
from sized group by conv_id"""
