"""Small tables for the training-data operators, with every kind of row that they must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("component_id", "kept", "gone", "words", "h", "n", "label", "score", "piece", "offset", "length", "start", "k", "file", "stratum")


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def corpus(seed=1, n=60):
    """Documents with exact and near copies, repeated lines and passages, empty, null and one-word texts, and a long one."""
    rng = random.Random(seed)
    v = vocabulary(rng)
    text = lambda k: "\n".join(" ".join(rng.choice(v) for _ in range(rng.randrange(4, 14))) for _ in range(k))
    texts = [text(rng.randrange(1, 9)) for _ in range(n)]
    passage = " ".join(rng.choice(v) for _ in range(30))
    for i in range(n // 3):
        a = rng.randrange(len(texts))
        kind = i % 5
        if kind == 0:
            texts.append(texts[a])
        elif kind == 1:
            w = texts[a].split(" ")
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        elif kind == 2:
            texts.append(texts[a] + "\nshared boilerplate line that many documents have\n" + text(2))
        elif kind == 3:
            texts.append(text(1) + " " + passage + " " + text(1))
        else:
            texts.append(texts[a].upper())
    texts += ["", None, "word", "two words", "\n\n \t", "a " * 300, texts[0] + "\n" + texts[0], " ".join(rng.choice(v) for _ in range(30_000))]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i * 3 - 5, texts[k], rng.choice(["en", "fr", None]), "s", 0) for i, k in enumerate(order)]


def frame(spark, rows, clashes=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clashes:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in CLASHES})
    return df.repartition(5)


def words(text):
    return (text or "").encode().split()
