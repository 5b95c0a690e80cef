"""What moves: rows that joins make and bytes that are shuffled or stored, so that work grows with its input."""

from pyspark.sql import functions as F

from siftworks.operators import relate as R
from siftworks.operators import retrieval as X
from siftworks.operators.segments import segment_lines, segment_words
from siftworks.plans import all_queries


def metrics(df):
    """(rows of joins, bytes shuffled, exchanges) of df, which is run."""
    df.collect()
    rows, shuffled, n, todo, seen = 0, 0, 0, [df._jdf.queryExecution().executedPlan()], set()
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            if p.id() not in seen:
                seen.add(p.id())
                todo.append(p.plan())
        else:
            one = lambda name: p.metrics().get(name).get().value() if p.metrics().contains(name) else 0  # noqa: B023, E731
            rows += one("numOutputRows") if kind.endswith(("JoinExec", "ProductExec")) else 0
            shuffled += one("shuffleBytesWritten") if kind == "ShuffleExchangeExec" else 0
            n += kind == "ShuffleExchangeExec"
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return rows, shuffled, n


def test_symbols_of_many_nodes(spark):
    """A candidate costs one row, however many nodes have its symbol."""
    nodes = spark.range(3000).select(F.when(F.col("id") < 2990, "hot").otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("symbol"), "id", (F.col("id") % 4 == 0).alias("accessor"))
    of = F.when(F.col("id") % 5 == 0, F.array(F.lit("hot"))).when(F.col("id") % 5 == 1, F.array(F.lit("s2991"), F.lit("s2992"), F.lit("none"))).when(F.col("id") % 5 == 2, F.array(F.lit("s2991"), F.lit("s2993"))).when(F.col("id") % 5 == 3, F.array(F.lit("none"))).otherwise(F.array().cast("array<string>"))
    calls = spark.range(2000).select(F.col("id").alias("call_id"), of.alias("candidates"))
    out = R.resolve_symbols(calls, nodes)
    want = [("ambiguous", None), ("internal", 2991), ("ambiguous", None), ("external", None), ("unresolved", None)]
    assert {r["call_id"]: (r["resolution"], r["target"]) for r in out.collect()} == {i: want[i % 5] for i in range(2000)}
    assert metrics(out)[0] <= 2000 * 3


def test_provenance_of_many_requests(spark):
    """Facts that many requests return are not shuffled once for each of them."""
    answers = spark.range(200).crossJoin(spark.range(50).toDF("n")).select(F.concat(F.lit("request-"), F.sha2(F.col("id").cast("string"), 256)).alias("request_id"), F.concat(F.lit("n"), "n").alias("node_id"))
    plain = spark.range(2000).select(F.concat(F.lit("n"), F.col("id") % 100).alias("node_id"), F.sha2(F.col("id").cast("string"), 256).alias("provenance_id"))
    odd = spark.createDataFrame([("n1", "two"), ("n2", "two"), ("n1", "again"), ("n1", "again"), ("n1", None), ("n2", None), (None, "lost"), ("n3", "half"), (None, "half"), ("gone", "away"), ("n4", "away")], plain.schema)
    facts = plain.unionByName(odd)
    out = R.historical_provenance(answers.unionByName(answers.limit(7)), facts)
    by = {}
    for a in answers.collect():
        by.setdefault(a["node_id"], set()).add(a["request_id"])
    want = {(r, f["provenance_id"]) for f in facts.collect() for r in by.get(f["node_id"], ())}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    assert set(got) == want
    assert metrics(out)[1] < 3_000_000


def test_segments_stay_in_place(spark):
    """Lines and words are cut with their byte ranges without a shuffle."""
    texts = ["x y\n\n z  w\n", "", "\n", "é ü\n日本 語\r\nq\tq", None, " ", "one", None]
    docs = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "doc_id int, path string, text string").withColumn("source_set_id", F.lit("s"))
    lines, words = segment_lines(docs), segment_words(segment_lines(docs))
    want_lines, want_words = [], []
    for path, text in [(str(i), t) for i, t in enumerate(texts) if t is not None]:
        at = 0
        for no, line in enumerate(text.split("\n"), 1):
            want_lines.append((path, no, line, at, at + len(line.encode()), line.split(" ")[0] or None))
            off = at
            for k, word in enumerate(line.split(" "), 1):
                want_words += [(path, no, k, word, off, off + len(word.encode()))] if word else []
                off += len(word.encode()) + 1
            at += len(line.encode()) + 1
    assert sorted(map(tuple, lines.select("path", "line_no", "line", "start", "end", "name").collect()), key=repr) == sorted(want_lines, key=repr)
    assert sorted(map(tuple, words.select("path", "line_no", "word_no", "word", "start", "end").collect()), key=repr) == sorted(want_words, key=repr)
    assert segment_lines(docs.filter("text is null")).count() == 0
    assert metrics(words)[2] == 0


def test_enclosing_groups_no_points(spark):
    points = spark.range(20000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), (F.col("id") % 3).cast("string").alias("path"), (F.col("id") * 7 % 1000).alias("at"))
    ranges = spark.range(400).select((F.col("id") % 4).cast("string").alias("path"), F.format_string("r%03d", "id").alias("range_id"), (F.col("id") * 11 % 900).alias("start"), (F.col("id") * 11 % 900 + F.col("id") % 60).alias("end"))
    out = R.enclosing(points, ranges, "id", width=64)
    by = {}
    for r in ranges.collect():
        by.setdefault(r["path"], []).append((r["end"] - r["start"], r["range_id"], r["start"], r["end"]))
    best = {p["id"]: min((x for x in by[p["path"]] if x[2] <= p["at"] < x[3]), default=None) for p in points.collect()}
    got = {r["id"]: r["range_id"] for r in out.collect()}
    assert got == {k: v[1] for k, v in best.items() if v}
    assert metrics(out)[1] < 200_000  # ranges alone, as these are few enough to be sent to all tasks


def test_cosine_pairs_are_no_rows(spark):
    """Pairs of query and vector are scored as matrices: tasks give the best of each slice, and no join makes a row for a
    pair. Ties, copies, and vectors that have no score go by id."""
    row = lambda i: (i, None if i == 40 else [0.0, 0.0] if i == 41 else [1.0] if i == 42 else [1.0, None] if i == 43 else [float(i % 7), float(i % 5) + 0.5])
    vectors = spark.createDataFrame([row(i) for i in range(300)], "id long, vec array<float>")
    queries = vectors.filter("id % 10 = 0 and id not in (40)").select(F.col("id").alias("query_id"), "vec").unionByName(spark.createDataFrame([(-1, None), (-2, [3.0])], "query_id long, vec array<float>"))
    known = {r["id"]: r["vec"] for r in vectors.collect()}

    def score(a, b):
        if not a or not b or len(a) != len(b) or None in a + b or not any(a) or not any(b):
            return None
        dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
        return round(dot(a, b) / (dot(a, a) ** 0.5 * dot(b, b) ** 0.5), 9)

    want = set()
    for q in queries.collect():
        best = sorted(((s := score(q["vec"], v)) is None, -(s or 0), i) for i, v in known.items())[:4]
        want |= {(q["query_id"], i, None if none else -s, n) for n, (none, s, i) in enumerate(best, 1)}
    near = lambda df: {(r["query_id"], r["id"], r["score"], r["rank"]) for r in df.collect()}
    for block in (2048, 7):
        got = near(X.cosine_topk(queries, vectors, 4, block))
        assert {(q, i, n) for q, i, _, n in got} == {(q, i, n) for q, i, _, n in want}
        assert all((a is None) == (b is None) and abs((a or 0) - (b or 0)) < 1e-8 for (*_, a, _), (*_, b, _) in zip(sorted(got, key=lambda x: (x[0], x[3])), sorted(want, key=lambda x: (x[0], x[3])), strict=True))
    assert metrics(X.cosine_topk(queries, vectors, 4))[0] == 0


def test_imported_facts_keep_their_columns(spark, sf_dir):
    """Facts go through their offsets and witnesses with what they say, and aren't joined with themselves by id."""
    facts = spark.createDataFrame([("a", "utf16", 2, "x"), ("a", "utf8", 1, "y")], "path string, encoding string, at long, note string")
    docs = spark.createDataFrame([("a", "é\n日z")], "path string, text string")
    assert {tuple(r) for r in R.to_byte_offsets(facts, docs, keep=("note",)).collect()} == {("x", 3), ("y", None)}
    rows = spark.createDataFrame([(1, "a", 0, 2, "é", 0, 9), (2, "a", 0, 2, "e", 0, 9)], "row_id int, path string, start long, end long, claimed string, owner_start long, owner_end long")
    assert {tuple(r) for r in R.verify_witness(rows, docs, keep=("claimed",)).collect()} == {(1, "é", True), (2, "e", False)}
    out = all_queries.QUERIES["s4_imported_facts"](spark, sf_dir)
    assert metrics(out)[2] <= 5
