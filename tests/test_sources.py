"""Publication, scans, extraction, signals and column functions on small literal rows."""

import datetime
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from siftworks.functions import text as T
from siftworks.functions.names import lookup_key
from siftworks.operators import identity as I
from siftworks.operators import relate as R
from siftworks.operators import stats
from siftworks.operators.extract import extract_facts
from siftworks.sources import corpus, tables
from siftworks.streaming import signals as S


def test_publish_pin_and_release(spark, tmp_path):
    out = str(tmp_path / "p")
    v = lambda *x: spark.createDataFrame([(i, i * 2) for i in x], "version_id string, body string")
    m = lambda *x: spark.createDataFrame([("f" + i, i) for i in x], "path string, version_id string")
    assert tables.head(spark, out) is None
    tables.publish(v("a", "b"), m("a", "b"), out, "r1", None)
    tables.publish(v("b", "c"), m("b", "c"), out, "r2", "r1")
    with pytest.raises(tables.StaleHead):
        tables.publish(v("d"), m("d"), out, "r3", "r1")
    assert tables.head(spark, out) == "r2"
    tables.publish_unchanged(spark, out, "r3", "r2")
    assert {r.version_id for r in tables.at_pin(spark, out, "r3").collect()} == {"b", "c"}
    assert spark.read.parquet(f"{out}/versions").count() == 3
    with pytest.raises(tables.ExpiredPin):
        tables.at_pin(spark, out, "r9")
    assert [r.version_id for r in tables.release(spark, out, ["r2", "r3"]).collect()] == ["a"]


def test_scan_and_extract(spark, tmp_path):
    for path, text in {"a.py": "class K(B):\n    def m(self, é=1):\n        for x in y:\n            g(h(x))\n", "bad.py": "def (", "c.rs": "fn x() {}", "node_modules/d.py": "x", "target/e.py": "x", "src/main/java/target/F.java": "x", "target/src/main/java/H.java": "x", ".hid/i.py": "x", "g.txt": "x"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    docs = corpus.scan_corpus(spark, str(tmp_path))
    assert sorted(r.path for r in docs.collect()) == ["a.py", "bad.py", "c.rs", "src/main/java/target/F.java"]
    facts = extract_facts(docs).collect()
    assert {(r.path, r.kind) for r in facts if r.tag == "coverage"} == {("a.py", "complete"), ("bad.py", "failed"), ("c.rs", "unsupported"), ("src/main/java/target/F.java", "unsupported")}
    assert {(r.kind, r.name, r.owner) for r in facts if r.tag == "declaration"} == {("class", "K", ""), ("method", "m", "K")}
    source = (tmp_path / "a.py").read_bytes()
    assert {(source[r.start : r.end].decode(), r.owner) for r in facts if r.tag == "call"} == {("g(h(x))", "K.m"), ("h(x)", "K.m")}


def loop(rows, quiet, longest):
    out, cur, gen = [], [], 0
    for t, k, p in sorted(rows):
        if cur and t >= min(cur[-1][0] + quiet, cur[0][0] + longest):
            out.append((gen, cur[0][0], min(cur[-1][0] + quiet, cur[0][0] + longest), len(cur)))
            cur, gen = [], gen + 1
        cur.append((t, k, p))
        if k == "urgent":
            out.append((gen, cur[0][0], t, len(cur)))
            cur, gen = [], gen + 1
    if cur:
        out.append((gen, cur[0][0], min(cur[-1][0] + quiet, cur[0][0] + longest), len(cur)))
    return out


def test_signal_batches_and_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = {s: [(1_700_000_000_000 + rng.randrange(4000), rng.choice(["modify"] * 9 + ["urgent"]), f"p{i}") for i in range(120)] for s in ("x", "y")}
    flat = [(s, t, k, p) for s, rs in rows.items() for t, k, p in rs]
    got = S.batch_signals(spark.createDataFrame(flat, "source_set_id string, at_ms long, event_kind string, path string")).collect()
    for s, rs in rows.items():
        assert sorted((r.generation, r.opened_ms, r.closed_ms, r.signals) for r in got if r.source_set_id == s) == loop(rs, 75, 250)
    # the same from a stream, which closes what was due long ago without another signal
    timed = [(s, datetime.datetime.fromtimestamp(t / 1000, datetime.UTC).replace(tzinfo=None), k, p) for s, t, k, p in flat]
    schema = "source_set_id string, received_at timestamp, event_kind string, path string"
    spark.createDataFrame(timed, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    closed = streamed(spark, S.batch_signal_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), tmp_path / "cp")
    for s, rs in rows.items():
        assert sorted((r.generation, r.opened_ms, r.closed_ms, r.signals) for r in closed if r.source_set_id == s) == loop(rs, 75, 250)


def streamed(spark, df, checkpoint, **trigger):
    """The rows of a stream over what is there; with a trigger the running query and a function for its rows so far."""
    name = f"t{uuid.uuid4().hex}"
    writer = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(checkpoint))
    if trigger:
        return writer.trigger(**trigger).start(), lambda: spark.sql(f"select * from {name}").collect()
    S.replay(spark, writer)
    return spark.sql(f"select * from {name}").collect()


def until(rows, n, seconds=90):
    end = time.time() + seconds
    while len(rows()) < n and time.time() < end:
        time.sleep(0.3)
    return rows()


def one_file_each(spark, rows, schema, folder):
    """A file for each row, to be read in this order."""
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").json(str(folder))
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_late_signals_are_in_a_batch(spark, tmp_path):
    """Arrivals at 100, 200 and 50 seconds, one in each micro-batch, and two that share a time."""
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("s", at(100), "modify", "a"), ("s", at(200), "modify", "b"), ("s", at(50), "create", "c"), ("s", at(50), "modify", "d")]
    stream = one_file_each(spark, rows, "source_set_id string, received_at timestamp, event_kind string, path string", tmp_path / "in")
    got = streamed(spark, S.batch_signal_stream(stream), tmp_path / "cp")
    assert sum(r.signals for r in got) == 4 and sorted(r.generation for r in got) == list(range(len(got)))
    assert any(r.full for r in got) and [r.opened_ms for r in sorted(got, key=lambda r: r.generation)] == sorted(r.opened_ms for r in got)


def test_open_batch_closes_by_the_clock(spark, tmp_path):
    """A signal of now, with a gap of thirty seconds: its batch comes out when they are over, though nothing follows."""
    schema = "source_set_id string, received_at timestamp, event_kind string, path string"
    now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    stream = one_file_each(spark, [("s", now, "modify", "a"), ("s", now, "modify", "b")], schema, tmp_path / "in")
    q, rows = streamed(spark, S.batch_signal_stream(stream, 30_000, 60_000), tmp_path / "cp", processingTime="0 seconds")
    try:
        assert [(r.signals, r.paths, r.closed_ms - r.opened_ms) for r in until(rows, 1)] == [(2, 2, 30_000)]
    finally:
        q.stop()


def test_release_by_the_clock(spark, tmp_path):
    """A revision superseded long ago comes out at once, one superseded now after its grace without any other row, the
    head never, and a replayed one no second time."""
    schema = "revision_id string, superseded_at timestamp"
    now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    old = datetime.datetime(2024, 1, 1)
    rows = [("r1", old), ("r2", now), ("r3", None), ("r1", old), ("r4", old + datetime.timedelta(days=40_000)), ("r4", None), (None, old)]
    stream = one_file_each(spark, rows, schema, tmp_path / "in")
    q, got = streamed(spark, S.release_stream(stream, grace_ms=30_000), tmp_path / "cp", processingTime="0 seconds")
    try:
        found = until(got, 2)
        time.sleep(3)
        assert [r.revision_id for r in got()] == ["r1", "r2"] and found[1].due_ms - found[1].superseded_ms == 30_000
    finally:
        q.stop()


def test_incremental_publication_is_a_cold_build(spark, tmp_path):
    """Documents that come, change and go over four micro-batches; a failure between publication and commit."""
    out, cold = str(tmp_path / "out"), str(tmp_path / "cold")
    states = [{"a": "1", "b": "1", "c": "1"}, {"a": "2", "b": "1", "d": "1"}, {"b": "1", "d": "1", "a": "1"}, {"b": "3", "d": "1"}]
    schema = "path string, full boolean"
    batches = [[("a", False)], [("a", False), ("c", False), ("d", False)], [("a", False), ("zz", None)], [("b", True)]]
    folder = tmp_path / "in"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))
        time.sleep(0.05)
    asked = []

    def documents(batch):
        asked.append(batch)
        return spark.createDataFrame(list(states[batch].items()), "path string, text string")

    derive = lambda docs: docs.select("path", F.sha2("text", 256).alias("version_id"), F.length("text").alias("n"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    run = lambda: S.apply_changes(stream(), documents, derive, out, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
    run()
    digest = lambda o, r: sorted(map(tuple, tables.at_pin(spark, o, r).select("path", "version_id", "n").collect()))
    for i, state in enumerate(states):
        tables.publish(*[(v := derive(spark.createDataFrame(list(state.items()), "path string, text string"))).drop("path"), v.select("path", "version_id")], f"{cold}{i}", "r", None)
        assert digest(out, f"batch-{i:012d}") == digest(f"{cold}{i}", "r")
    # the last batch is run again, as after a failure before its commit: nothing is published twice
    (tmp_path / "cp" / "commits" / "3").unlink()
    for crc in (tmp_path / "cp" / "commits").glob(".3.crc"):
        crc.unlink()
    heads = sorted(p.name for p in (tmp_path / "out" / "head").glob("*.json"))
    run()
    assert sorted(p.name for p in (tmp_path / "out" / "head").glob("*.json")) == heads and len(heads) == 4
    assert asked == [0, 1, 2, 3]


def test_lost_writer_blocks_nothing(spark, tmp_path):
    """An empty head file, as of a writer that was lost, doesn't stop the next publication; a stale one still fails."""
    out = str(tmp_path / "out")
    v = spark.createDataFrame([("a", "1")], "path string, version_id string")
    tables.publish(v.select("version_id"), v, out, "r1", None)
    (tmp_path / "out" / "head" / "000000000001.json").write_bytes(b"")
    tables.publish(v.select("version_id"), v, out, "r2", "r1")
    assert tables.head(spark, out) == "r2" and tables.at_pin(spark, out, "r2").count() == 1
    with pytest.raises(tables.StaleHead):
        tables.publish(v.select("version_id"), v, out, "r3", "r1")
    with pytest.raises(tables.StaleHead):
        tables._create(spark, f"{out}/head/000000000002.json", "{}")
    with pytest.raises(tables.ExpiredPin):
        tables.at_pin(spark, out, "r3")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batches_by_pointer_doubling(spark, seed):
    """One stretch without a gap, of hundreds of batches, and random ones, with random waits and urgent signals."""
    rng = random.Random(seed)
    quiet, longest = rng.choice([(75, 250), (40, 41), (500, 90), (60, 10**15)])
    rows, at = [], 0
    for i in range(4000):
        at += rng.choice([0, 1, 20, 39]) if i < 3500 else rng.choice([0, 30, 80, 600])
        rows.append(("hot" if i % 9 else rng.choice(["b", None]), at, "urgent" if rng.random() < 0.02 else rng.choice(["modify", "create"]), f"p{rng.randrange(60):02}"))
    df = spark.createDataFrame(rows, "source_set_id string, at_ms long, event_kind string, path string").repartition(9)
    got = [tuple(r) for r in S.batch_signals(df, quiet, longest).collect()]
    want = []
    for key in {r[0] for r in rows}:
        out, open_, generation = S._step([], sorted(r[1:] for r in rows if r[0] == key), key, 0, quiet, longest)
        want += out + ([S._close(open_, key, generation, min(open_[-1][0] + quiet, open_[0][0] + longest))] if open_ else [])
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert S.batch_signals(df.limit(0)).count() == 0


def test_acknowledge(spark):
    batches = spark.createDataFrame([("a", 0, 100), ("a", 1, 300), ("b", 0, 50), ("c", 0, 10)], "source_set_id string, generation long, closed_ms long")
    signals = spark.createDataFrame([("a", 90), ("a", 300), ("b", 51)], "source_set_id string, at_ms long")
    assert sorted(tuple(r) for r in S.acknowledge(batches, signals).collect()) == [("a", 0, False), ("a", 1, True), ("b", 0, False), ("c", 0, True)]


def test_full_rescan(spark):
    one = lambda n, k: [("s", 1000, k if i == 0 else "modify", f"p{i}") for i in range(n)]
    schema = "source_set_id string, at_ms long, event_kind string, path string"
    full = lambda rows: S.batch_signals(spark.createDataFrame(rows, schema)).first().full
    assert not full(one(256, "modify")) and full(one(257, "modify")) and full(one(2, "remove"))


def test_column_functions(spark):
    df = spark.createDataFrame([('a"\\\n\x01 \u2028😀',)], "t string")
    assert df.select(T.json_string(F.col("t"))).first()[0] == '"a\\"\\\\\\u000a\\u0001 \u2028😀"'
    paths = {"a/b.py": True, "/a": False, "a//b": False, "a/../b": False, "a\\b": False, "": False, "c:x": False}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", T.valid_path(F.col("p")).alias("v")).collect()
    assert {r.p: r.v for r in got} == paths
    names = [("python", "ｆoo"), ("rust", "r#e\u0301"), ("java", "e\u0301"), ("rust", "r#if")]
    got = spark.createDataFrame(names, "l string, s string").select("s", lookup_key(F.col("l"), F.col("s")).alias("k")).collect()
    assert {r.s: r.k for r in got} == {"ｆoo": "foo", "r#e\u0301": "é", "e\u0301": "e\u0301", "r#if": "if"}
    clip = spark.createDataFrame([("é" * 6,), ("abc",), ("a😀b",)], "t string").select("t", T.clip_bytes(F.col("t"), 4).alias("c")).collect()
    assert {r.t: (r.c.text, r.c.clipped) for r in clip} == {"é" * 6: ("éé", True), "abc": ("abc", False), "a😀b": ("a", True)}
    probs = [({"a": 0.5, "b": 0.5}, "exact"), ({"a": 0.33, "b": 0.66}, "rounded"), ({"a": 0.333, "b": 0.66}, "invalid"), ({"a": 1.5, "b": -0.5}, "invalid")]
    got = spark.createDataFrame([(p,) for p, _ in probs], "p map<string,double>").select(T.probability_status(F.col("p")).alias("s")).collect()
    assert [r.s for r in got] == [s for _, s in probs]


def test_anchor_groups(spark):
    row = lambda sid, start, h: (sid, "g", start, start + 5, h)
    df = lambda *rows: spark.createDataFrame(rows, "syntax_id string, grp string, start long, end long, header_hash string")
    old = df(row("a", 0, "h"), row("b", 10, "h"), row("c", 20, "k"))
    anchors = I.capture_anchors(old, ["grp"])
    state = lambda now, cont: {r.syntax_id: r.reason for r in I.audit_anchors(anchors, now, ["grp"], cont).collect()}
    assert state(old, "unchanged") == {"a": None, "b": None, "c": None}
    assert state(old, "unknown") == {"a": "unprovenContinuity", "b": "unprovenContinuity", "c": None}
    assert state(df(row("a", 0, "h"), row("c", 20, "x")), "unchanged") == {"a": "groupChanged", "b": "missing", "c": "headerMismatch"}


def test_ranges_in_other_units(spark):
    docs = spark.createDataFrame([("p", "a😀é\nb")], "path string, text string")
    facts = [("1", "p", "utf16", 3, 5), ("2", "p", "utf16", 2, None), ("3", "p", "scalar", 2, 5), ("4", "p", "utf8", 5, 5), ("5", "p", "utf8", 4, None), ("6", "p", "scalar", 99, None), ("7", "p", "utf8", 0, 0)]
    df = spark.createDataFrame([f[:4] for f in facts], "fact_id string, path string, encoding string, at long")
    assert {r.fact_id: r.byte_at for r in R.to_byte_offsets(df, docs).collect()} == {f[0]: f[4] for f in facts}
    raw = spark.createDataFrame([("p", b"ok\n\xff\xfe\nend\n")], "path string, bytes binary")
    req = spark.createDataFrame([("a", "p", 1, 1), ("b", "p", 2, 2), ("c", "p", 3, 3)], "request_id string, path string, first int, last int")
    got = {r.request_id: (r.slice, r.valid) for r in R.read_lines(req, raw).collect()}
    assert got == {"a": ("ok", True), "b": (None, False), "c": ("end", True)}


def test_capture_inputs_of_many_names(spark, tmp_path):
    from siftworks.plans.q_streams import s5_capture_inputs
    from siftworks.plans.views import documents

    n = 60_000
    text = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("t"), F.col("doc_id").cast("string")))
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang")).withColumn("text", text).write.parquet(str(tmp_path / "documents.parquet"))
    got = s5_capture_inputs(spark, str(tmp_path)).collect()
    assert sorted(r.name for r in got) == sorted(["absent.lock", *(f"s/en/{i}.txt" for i in range(n))])
    assert [r.name for r in got if not r.present] == ["absent.lock"]
    docs = documents(spark, str(tmp_path))
    names = docs.select(F.col("path").alias("name")).union(spark.range(1).select(F.lit("absent.lock")))
    every = corpus.capture_inputs(corpus.documents_from_table(docs, "path", "text"), names)
    assert every.agg(F.count("*"), F.count_if("present"), F.count("content_hash"), F.countDistinct("name")).first() == (n + 1, n, n, n + 1)


def test_lookup_keys_of_escapes(spark):
    import unicodedata

    rows = [("java", r"\u0061b"), ("java", r"\uuu0061b"), ("javascript", r"\u{61}b"), ("javascript", r"\u{1F600}"), ("java", r"\uD83D\uDE00"), ("java", r"\uD83D"), ("javascript", r"\u{110000}"), ("rust", "r#e\u0301"), ("rust", r"\u0061"), ("python", "\ufb01x"), ("python", "ab"), ("java", "\ufb01"), ("java", None)]
    got = spark.createDataFrame(rows, "language string, spelling string").select(lookup_key(F.col("language"), F.col("spelling")).alias("k")).collect()
    assert [r.k for r in got] == ["ab", "ab", "ab", "\U0001f600", "\U0001f600", r"\uD83D", r"\u{110000}", "\u00e9", r"\u0061", "fix", "ab", "\ufb01", None]
    assert unicodedata.normalize("NFKC", "\ufb01x") == "fix"


def test_python_lookup_keys_of_all_words(spark, sf_dir):
    import unicodedata

    from siftworks.plans.q_text import f1_lookup_key_python

    got = f1_lookup_key_python(spark, sf_dir).collect()
    assert len(got) > 300 and all(r.lookup_key == unicodedata.normalize("NFKC", r.spelling) for r in got)


def test_publication_of_broken_and_lost_attempts(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    v = spark.createDataFrame([("a", 1), ("b", 2)], "version_id string, x int")
    m = v.select(F.col("version_id").alias("path"), "version_id")
    create = tables._create
    monkeypatch.setattr(tables, "_create", lambda *_: (_ for _ in ()).throw(OSError("lost before the head")))
    with pytest.raises(OSError):
        tables.publish(v, m, out, "r1", None)
    assert tables.head(spark, out) is None
    with pytest.raises(tables.ExpiredPin):
        tables.at_pin(spark, out, "r1")
    monkeypatch.setattr(tables, "_create", create)
    for _ in range(2):  # the retry, and one more that finds it done
        tables.publish(v, m, out, "r1", None)
        assert sorted((r.version_id, r.path) for r in tables.at_pin(spark, out, "r1").collect()) == [("a", "a"), ("b", "b")]
    heads = tables._numbers(spark, out)
    assert len(heads) == 1
    # a writer that read the same head, but creates the next file second
    monkeypatch.setattr(tables, "_numbers", lambda *_: heads)
    tables.publish(v.limit(1), m.limit(1), out, "r2", "r1")
    with pytest.raises(tables.StaleHead):
        tables.publish(v, m, out, "r3", "r1")
    monkeypatch.undo()
    assert tables.head(spark, out) == "r2" and tables.at_pin(spark, out, "r2").count() == 1


def test_chunks_keep_to_the_budget(spark):
    from siftworks.operators.retrieval import chunks

    rng = random.Random(3)
    rows = [("p", 1, "x" * 600), ("p", 2, "y" * 399), ("p", 3, "z" * 5000), ("p", 4, "w")]
    rows += [(f"q{k}", i, "v" * rng.choice([0, 3, 40, 900, 2500])) for k in range(20) for i in range(1, rng.randrange(2, 30))]
    got = chunks(spark.createDataFrame(rows, "path string, line_no long, line string"), 1000).collect()
    assert max(r.n_bytes for r in got) <= 1000
    assert sorted((r.chunk, r["first"], r["last"], r.n_bytes) for r in got if r.path == "p") == [(0, 1, 1, 601), (1, 2, 2, 400), *((2 + k, 3, 3, 1000) for k in range(5)), (7, 3, 3, 1), (8, 4, 4, 2)]
    for path in {p for p, _, _ in rows}:
        own = sorted((r for r in got if r.path == path), key=lambda r: r.chunk)
        assert [r.chunk for r in own] == list(range(len(own)))
        assert sum(r.n_bytes for r in own) == sum(len(t) + 1 for p, _, t in rows if p == path)
        for a, b in zip(own, own[1:], strict=False):  # neighbours that would have fitted are merged
            assert b["first"] in (a["last"], a["last"] + 1) and (a.n_bytes + b.n_bytes > 1000 or a["last"] == b["first"] or a["first"] == a["last"] or b["first"] == b["last"])


def test_methods_by_node_type(spark):
    src = b"class foo(A, metaclass=M):\n    def m[T](self, *a, **k): pass\ndef Foo(x, /, y, *, z) -> int:\n    def inner(): pass\n    class C:\n        async def n(self): pass\n"
    docs = spark.createDataFrame([("a.py", "python", bytearray(src))], "path string, language string, bytes binary")
    got = {r.name: r for r in extract_facts(docs).filter("tag = 'declaration'").collect()}
    assert {n: r.kind for n, r in got.items()} == {"foo": "class", "m": "method", "Foo": "function", "inner": "function", "C": "class", "n": "method"}
    assert got["foo"].header.bases == ["A", "metaclass=M"] and got["m"].header.type_parameters == ["T"] and got["n"].header.modifiers == ["async"] and got["Foo"].header.result == "int"
    assert [(p.name, p.kind) for p in got["Foo"].header.parameters] == [("x", "positional"), ("y", "plain"), ("z", "keyword")]
    assert [(p.name, p.kind) for p in got["m"].header.parameters] == [("self", "plain"), ("a", "variadic"), ("k", "keywords")]


def test_offsets_inside_characters(spark):
    docs = spark.createDataFrame([("p", "a\u00e9\U0001f600b")], "path string, text string")
    want = {("scalar", 0): 0, ("scalar", 3): 7, ("scalar", 4): 8, ("scalar", 5): None, ("utf8", 2): None, ("utf8", 3): 3, ("utf8", 8): 8, ("utf8", 9): None, ("utf16", 2): 3, ("utf16", 3): None, ("utf16", 4): 7, ("utf16", 5): 8, ("utf16", 6): None, ("utf16", -1): None, ("utf16", 0): 0}
    facts = spark.createDataFrame([(f"{e}{n}", "p", e, n) for e, n in want], "fact_id string, path string, encoding string, at long")
    assert {r.fact_id: r.byte_at for r in R.to_byte_offsets(facts, docs).collect()} == {f"{e}{n}": v for (e, n), v in want.items()}


def test_running_sums_over_ranges(spark):
    """Keys of one row, of a third of all rows, of null; a range holds many keys and a key many ranges."""
    rows = [(None if i % 7 == 0 else "hot" if i % 3 == 0 else f"k{i % 50}", i // 2 if i % 11 else None, i, None if i % 5 == 0 else i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, at long, id long, v long")
    want, total = {}, {}
    for k, at, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        n, t = total.get(k, (0, None))
        total[k] = n + 1, t if v is None else (t or 0) + v
        want[i] = total[k]
    got = stats.numbered(stats.running(df, ["k"], ["at", "id"], 16, s="v"), ["k"], ["at", "id"], "n")
    assert {r.id: (r.n, r.s) for r in got.collect()} == want
    assert stats.running(df.limit(0), ["k"], ["id"], s="v").count() == 0


def test_signals_of_a_hot_source(spark):
    """Stretches are batched apart with the same result as one loop over the whole source set."""
    rng = random.Random(5)
    rows, at = [], 0
    for i in range(3000):
        at += rng.choice([0, 5, 30, 74, 75, 76, 300])
        rows.append(("hot" if i % 3 else f"s{i % 4}", at, rng.choice(["modify", "modify", "modify", "urgent", "create"]), f"p{i % 40:02}"))
    got = sorted(tuple(r) for r in S.batch_signals(spark.createDataFrame(rows, "source_set_id string, at_ms long, event_kind string, path string").repartition(7)).collect())
    want = []
    for key in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == key)
        out, open_, generation = S._step([], mine, key, 0, S.QUIET_MS, S.LONGEST_MS)
        want += out
        if open_:
            want.append(S._close(open_, key, generation, min(open_[-1][0] + S.QUIET_MS, open_[0][0] + S.LONGEST_MS)))
    assert got == sorted(want)
