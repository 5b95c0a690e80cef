"""Conversation repair, chat formatting and vector codes against plain versions of themselves."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from siftworks.llm import chat, codes, queries, repair

WHITE = " \t\n\x0b\x0c\r"
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def conversations(seed=3, n=60):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "", " \n", "What?", "Well, then", None, "Go on!  ", "x. ", "Ja."]
    rows = []
    for c in range(n):
        for t in range(rng.randrange(0, 14)):
            rows.append((c if c != 5 else None, t if rng.random() < 0.95 else rng.choice([None, t + 2]), rng.choice(["system"] * 2 + ["user", "assistant"] * 6 + ["", None, "tool", "s2"]), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randrange(40)}."))
    rows += [(999, t, "user" if t % 2 == 0 else "assistant", f"Answer {t % 700}.") for t in range(900)]
    rng.shuffle(rows)
    return rows


def damaged(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        out[c]  # also where nothing is left
        case = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case:
            text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
            out[c] += [(t, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    for v in out.values():
        v.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2][:64], hashlib.sha256(x[2].encode()).digest()))
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        out.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, result) over whole strings."""
    def inserted(q, best):
        yield q, *best
        for _ in range(3):
            role = "assistant" if q == "u" else "user"
            q, best = role[0], (best[0] + 2, best[1] + "I", (*best[2], f"{role}:"))
            yield q, *best

    state = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for q0, best in state.items():
            for q, cost, audit, result in inserted(q0, best):
                moves = [(q, cost + 3, audit + "D", result)]
                if fault not in (1, 2):
                    late = fault == 3
                    if role and (q + role[0] in ("su", "ua", "au") or not q and role[0] in "su"):
                        moves.append((role[0], cost + late, audit + "K", (*result, f"{role}:{text}")))
                    to = "assistant" if q == "u" else "user"
                    moves.append((to[0], cost + 2 + late, audit + "R", (*result, f"{to}:{text}")))
                for to, *new in moves:
                    after[to] = min(after.get(to, tuple(new)), tuple(new), key=lambda x: x[:2])
        state = after
    ends = [x for q0, best in state.items() for q, *x in inserted(q0, best) if q in ("", "a")]
    return min(ends, key=lambda x: tuple(x[:2]))


def expected(rows):
    out = {}
    for c, v in damaged(rows).items():
        faults, turns = faults_of(v), [t for t, _, _ in v if t is not None]
        cost, audit, result = cheapest(v, faults)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(v, v[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, *[faults.count(k) for k in (1, 2, 3)], illegal, cost, audit, hashlib.sha256("\n".join(result).encode()).hexdigest())
    return out


@pytest.mark.parametrize("bits", [1, 3, 13])
def test_repair(spark, monkeypatch, bits):
    monkeypatch.setattr(repair.repair, "__defaults__", (bits,))
    rows = conversations(seed=bits)
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumns({c: F.lit("x") for c in ("mid", "copy", "audit", "digest", "edit", "at", "cost")}).repartition(7)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repaired_digests(df).collect()}
    assert got == expected(rows)


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert repair.repaired_digests(none).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = repair.repaired_digests(spark.createDataFrame([(gone, 0, "user", "x")], CONVERSATIONS)).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_repair_edits(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Who is it?"), (1, 2, "assistant", "Me.")]
    edits, report = repair.repair(spark.createDataFrame(rows, CONVERSATIONS))
    assert [tuple(r) for r in edits.collect()] == [(1, 0, "user", "Hello.", "K"), (1, None, "assistant", "", "I"), (1, 1, "user", "Who is it?", "K"), (1, 2, "assistant", "Me.", "K")]
    assert report.first()["cost"] == 2


@pytest.mark.parametrize("modulus", [2, 7, 101, (1 << 61) - 1])
def test_audits_compare_as_strings(modulus):
    """Hashes modulo a small number collide all the time; verification must find out."""
    rng, audits = random.Random(modulus), repair.Audits(modulus)
    text = {0: ""}
    for _ in range(600):
        node, letter = rng.choice(list(text)[-40:]), rng.choice("DK")
        text[audits.extend(node, letter)] = text[node] + letter
    for _ in range(3000):
        a, b = rng.choice(list(text)), rng.choice(list(text))
        assert np.sign(audits.compare(a, b)) == (text[a] > text[b]) - (text[a] < text[b])
    assert "".join(audits.spell(max(text))) == text[max(text)]
    assert (audits.collisions > 0) == (modulus < 1000)


def test_segments_combine():
    """Any cuts of a conversation give the audit of the whole, with colliding hashes too."""
    rng = random.Random(8)
    for _ in range(60):
        rows = bytes(rng.randrange(4) + 4 * rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(rng.randrange(1, 25)))
        cost, path, closing = repair.best_path([repair.segment_costs(rows, (0,))])
        whole = repair.segment_audit(rows, *path[0]) + closing
        cuts = sorted({0, len(rows), *[rng.randrange(len(rows)) for _ in range(4)]})
        parts = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for modulus in (5, (1 << 61) - 1):
            c, path, closing = repair.best_path([repair.segment_costs(x, (0, 1, 2, 3)) for x in parts], modulus)
            assert (c, "".join(repair.segment_audit(x, p, q) for x, (p, q) in zip(parts, path, strict=True)) + closing) == (cost, whole)


# --- chat formatting -------------------------------------------------------------------------------------------------


def test_chat_digests(spark):
    rng = random.Random(2)
    odd = ["<turn user>", "</turn>\n", "\\", "\\l", "<image 1>", "\\\\g>", "### User:", "é\U0001f600", "", None, "a\nb", "x" * 3000]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(30)]), rng.choice(["user", "assistant", None, "sys>tem", "a\nb"]), rng.choice(odd)) for _ in range(300)]
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumns({c: F.lit("x") for c in ("content", "loss", "chunk", "tokens")}).repartition(6)
    want = defaultdict(list)
    for c, t, role, text in [*rows, (-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)]:
        want[c].append((t is not None, t or 0, role or "", f"<turn {chat.escape(role or '')}>\n{chat.escape(text or '')}</turn>\n", text or ""))
    got = {r["conv_id"]: r for r in chat.chat_digests(df).collect()}
    assert set(got) == set(want)
    for c, v in want.items():
        v.sort()
        learnt = "".join(x[4] for x in v if x[2] == "assistant")
        r = got[c]
        assert (r["n_turns"], r["loss_chars"], r["formatted_chars"]) == (len(v), len(learnt), sum(len(x[3]) for x in v))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[4]}\n" for x in v).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
    assert chat.chat_digests(spark.createDataFrame([], CONVERSATIONS)).count() == 1


def test_chat_chunks(spark):
    """Small chunks read back as whole conversations do, in any order of rows."""
    rows = [(c, t, "assistant" if t % 2 else "user", f"<{c}> \\ {t}" * (t + 1)) for c in range(5) for t in range(20)]
    turns = chat.format_turns(spark.createDataFrame(rows, CONVERSATIONS))
    whole = chat.format_conversations(turns)
    small = chat.format_conversations(turns, size=300)
    assert whole.count() == 5 < small.count()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(chat.read_back(whole)) == key(chat.read_back(small.orderBy(F.rand(1))))
    for r in whole.collect():
        assert [(role, parts) for role, parts in chat.read_turns(r["formatted"])] == [(x[2], [("text", x[3])]) for x in rows if x[0] == r["conv_id"]]


def test_typed_parts(spark):
    part = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int, parts: array<struct<type: string, text: string, ref: string, width: int, height: int>>>"
    none = (None,) * 8
    make = lambda **x: tuple(x.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages", "parts"))
    content = [make(type="text", text="see <b> "), make(type="image", ref="i.png", width=513, height=512), make(type="text", text=None), None, make(type="audio", ref="a.wav", seconds=1.01), make(type="document", ref="d.pdf", pages=3, parts=[("text", "inner", None, None, None), ("image", None, "j.png", -4, None)]), make(type="video", ref="v"), make(type="text", text="end")]
    df = spark.createDataFrame([(1, 0, "assistant", content), (1, 1, "user", None), (1, 2, "user", [none])], f"conv_id long, turn long, role string, content array<{part}>")
    turns = chat.format_turns(df, "content")
    first = next(r for r in turns.collect() if r["turn"] == 0)
    assert first["formatted"] == "<turn assistant>\nsee \\lb\\g <image 1><audio 2><document 3>inner<image 4><other 5>end</turn>\n"
    assert [(a["kind"], a["ref"], a["tokens"], a["inside"]) for a in first["attachments"]] == [("image", "i.png", 85 + 2 * 170, None), ("audio", "a.wav", 26, None), ("document", "d.pdf", 774, None), ("image", "j.png", 85, 3), ("other", "v", 0, None)]
    assert all(first["formatted"][a["place"] :].startswith(f"<{a['kind']} {a['number']}>") for a in first["attachments"])
    assert [first["formatted"][s["start"] : s["end"]] for s in first["loss"]] == ["see \\lb\\g ", "inner", "end"]
    bpe = chat.ByteBpe()
    assert first["tokens"] == sum(len(bpe.ids(x)) for x in ("<turn assistant>\nsee \\lb\\g ", "inner", "end</turn>\n")) + 425 + 26 + 774 + 85
    row = chat.read_back(chat.format_conversations(turns)).first()
    assert (row["n_turns"], row["n_attachments"], row["loss_chars"]) == (3, 6, len("see <b> innerend"))
    with pytest.raises(ValueError, match="no turn"):
        list(chat.read_turns("<turn user>\nx"))


def test_chat_digests_count_tokens(spark):
    rows = [(1, 0, "user", "see <b> \\ <image 1>"), (1, 1, "assistant", None), (1, 2, None, "x" * 3000 + "\u200b é\U0001f600"), (2, 0, "sys>tem", "<|endoftext|>")]
    exact = chat.ByteBpe().exact
    want = defaultdict(int)
    for c, _, role, text in [*rows, (-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)]:
        want[c] += len(exact.encode(f"<turn {chat.escape(role or '')}>\n{chat.escape(text or '')}</turn>\n", add_special_tokens=False).ids)
    got = chat.chat_digests(spark.createDataFrame(rows, CONVERSATIONS)).collect()
    assert {r["conv_id"]: (r["n_tokens"], r["expanded_tokens"], r["n_attachments"]) for r in got} == {c: (n, 0, 0) for c, n in want.items()}


def test_tokens_of_long_texts():
    """Cuts change no count, and white space that the faster library refuses is counted."""
    rng, bpe = random.Random(4), chat.ByteBpe()
    count = lambda s: len(bpe.exact.encode(s, add_special_tokens=False).ids)
    odd = ["a", "it's", "'s", "é", "слово", "12", "\U0001f600", "\\l", "!", " ", " ", "  ", "\n", "\n\n", "\t", "\r", "\x1c", "\x85", "\xa0", "\u180e", "\u200b", "\u2060", "\u3000", "\ufeff", "\x00"]
    for i in range(400):
        text = "".join(rng.choices(odd[: 15 if i % 2 else None], k=60))
        assert [chat.count_tokens(bpe, text, size) for size in (1, 7, 1000)] == [count(text)] * 3
    assert chat.count_tokens(bpe, "so" + " " * 1_000_000 + "on") == count("so" + " " * 1_000_000 + "on")


def test_attachments_are_read_back(spark):
    """Attachments are those that the formatted text has placeholders for, in all chunks; one without the other fails."""
    part = "array<struct<type: string, text: string, ref: string, width: int, height: int>>"
    content = [("text", "<image 1>", None, None, None), ("image", None, "i.png", 513, 512), ("image", None, "j.png", 1, 1), ("video", None, "v", None, None)]
    df = spark.createDataFrame([(1, t, "user", content) for t in range(9)], f"conv_id long, turn long, role string, content {part}")
    turns = chat.format_turns(df, "content")
    chunks = chat.format_conversations(turns, size=100)
    assert chunks.count() > 1
    row = chat.read_back(chunks).first()
    assert (row["n_attachments"], row["expanded_tokens"], row["n_tokens"]) == (27, 9 * (425 + 255), sum(r["tokens"] for r in turns.collect()))
    text = "<turn user>\n\\limage 1\\g<image 1><audio 2></turn>\n"
    first = {"number": 1, "kind": "image", "ref": "i", "tokens": 85, "place": 23}
    second = {"number": 2, "kind": "audio", "ref": "a", "tokens": 25, "place": 32}
    digest = chat._Digest(1)
    digest.add(text, [], [first, second], 130)
    assert digest.row()[-3:] == (2, 110, 130)
    for attached in ([first], [], [second, first], [first, second, second], [first | {"place": 22}, second], [first, second | {"number": 3}]):
        with pytest.raises(ValueError, match="no attachment of|no placeholder of"):
            chat._Digest(1).add(text, [], attached, 130)


# --- vector codes ----------------------------------------------------------------------------------------------------

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def lloyd(vectors, k, rounds, parts=4):
    """Codes, errors and codebooks, every vector compared with every entry in whole numbers."""
    w = len(vectors[0]) // parts
    books = [[v[p * w : (p + 1) * w] for v in vectors[:k]] for p in range(parts)]
    for i in range(rounds + 1):
        best = [[min((sum((a - b) ** 2 for a, b in zip(v[p * w : (p + 1) * w], e, strict=True)), j) for j, e in enumerate(books[p])) for p in range(parts)] for v in vectors]
        if i == rounds:
            return ["".join(f"{j:02x}" for _, j in b) for b in best], [sum(d for d, _ in b) for b in best], books
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [v[p * w : (p + 1) * w] for v, b in zip(vectors, best, strict=True) if b[p][1] == j]
                books[p][j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else books[p][j]


@pytest.mark.parametrize("length", [8, 6])
def test_vector_codes(spark, length):
    rng = random.Random(length)
    value = lambda: rng.choice([-0.5, -0.25, 0.0, 0.126, 0.25, 1.5])  # noqa: E731  coarse, so that distances tie
    rows = [(i, [value() for _ in range(length - (i % 40 == 7))], rng.choice([None, 1, 2])) for i in range(160)]
    rows += [rows[3], rows[3], (None, [0.5] * length, 3), (400, None, 1), (401, [0.1, None] + [0.0] * (length - 2), 1), (402, [float("nan")] * length, 1), (403, [float("inf")] * length, 2), (404, [], 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, EMBEDDINGS).withColumns({c: F.lit("x") for c in ("code", "kind", "v", "slot", "error")}).repartition(6)
    coded, books = codes.compress(df, entries=32, rounds=4)
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    width = -(-length // 4) * 4
    whole = sorted(((r[0] is None, r[0] or 0, [int(np.floor(1024 * float(np.float32(x)))) for x in r[1]] + [0] * (width - len(r[1])), r[2]) for r in kept), key=lambda x: x[:3])
    want_codes, errors, want_books = lloyd([x[2] for x in whole], 32, 4)
    key = lambda x: (x[0] is None, *[y if y is not None else -1 for y in x])
    want = sorted([(None if x[0] else x[1], x[3], c, e) for x, c, e in zip(whole, want_codes, errors, strict=True)], key=key)
    assert sorted([tuple(r) for r in coded.select("vec_id", "label", "code", "error").collect()], key=key) == want
    assert books.books.tolist() == want_books
    assert len(books.decode(want_codes[0])) == width


def test_vector_codes_odd_tables(spark):
    assert codes.vector_codes(spark.createDataFrame([], EMBEDDINGS)).count() == 0
    one = codes.vector_codes(spark.createDataFrame([(1, [], 1), (2, [], None)], EMBEDDINGS)).orderBy("vec_id").collect()
    assert [tuple(r)[:4] for r in one] == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]
    with pytest.raises(OverflowError):
        codes.compress(spark.createDataFrame([(1, [1e30, 0.0, 0.0, 0.0], 1)], EMBEDDINGS))


def test_reassign_is_a_whole_rescan():
    rng = np.random.default_rng(4)
    for _ in range(30):
        x, book = rng.integers(-3, 4, (200, 3)), rng.integers(-3, 4, (20, 3))
        code, dist = codes.nearest(x, book)
        after = book.copy()
        after[rng.integers(0, 20, 4)] = rng.integers(-3, 4, (4, 3))
        got = codes.reassign(x, code, dist, after, (after != book).any(1))
        for a, b in zip(got, codes.nearest(x, after), strict=True):
            assert (a == b).all()
    big = np.array([[1 << 28, -(1 << 28)], [0, 3]])
    assert codes.nearest(big, big[::-1])[1].tolist() == [0, 0]


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_vector_codes", "op13_chat_formatting"])
def test_new_queries(spark, duck, sf_dir, name):
    same_rows(queries.queries()[name](spark, sf_dir), duck, queries.oracle_sql()[name])
