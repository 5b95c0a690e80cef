"""Catalogs of source sets against one loop over each."""

import random

import pytest

from siftworks.operators import focus

FILES = "s string, path string, source_bytes long, registry_bytes long, symbols long, truncated boolean, incomplete boolean, warned boolean"


def loop(files, classes, items, limits):
    out, details, relations, warnings = [], [], {}, []
    if len(files) > limits.files or sum(f[4] for f in files) > limits.symbols:
        return [], [], {}, ["inputLimit"]
    source = registry = records = text = 0
    complete = open_ = True
    for f in sorted(files, key=lambda f: f[1]):
        if source + f[2] > limits.source_bytes or registry + f[3] > limits.registry_text:
            warnings.append("sourceLimit" if source + f[2] > limits.source_bytes else "registryTextLimit")
            complete = False
            break
        source, registry = source + f[2], registry + f[3]
        warnings += ["extraction"] * f[7]
        complete &= not f[6]
        for c in sorted(x for x in classes if x[1] == f[1]):
            if len(out) == limits.classes:
                warnings.append("classLimit")
                complete = False
                break
            cut = False
            for i in sorted(x for x in items if x[1:3] == c[1:3]):
                if open_ and (records + i[6] > limits.records or text + i[7] > limits.text):
                    warnings.append("detailRecordLimit" if records + i[6] > limits.records else "detailTextLimit")
                    open_ = False
                if not open_:
                    cut = True
                    continue
                records, text = records + i[6], text + i[7]
                if i[4] in ("field", "method"):
                    details.append((*c[1:3], i[3]))
                elif i[4] == "relation":
                    relations.setdefault(i[5], c[1])
            out.append((*c[1:4], cut))
        else:
            continue
        break
    return out, details, relations, warnings + ["declaredTypes"] * bool(out) + ["registryIncomplete"] * (not complete)


@pytest.mark.parametrize("limits", [focus.CatalogLimits(), focus.CatalogLimits(classes=9), focus.CatalogLimits(source_bytes=40), focus.CatalogLimits(registry_text=25, records=20), focus.CatalogLimits(text=60, classes=20), focus.CatalogLimits(files=7), focus.CatalogLimits(symbols=14)])
def test_catalog(spark, limits):
    rng = random.Random(7)
    files, classes, items = [], [], []
    for s in ("a", "b", "c", "d"):
        for p in range(rng.randrange(4, 10)):
            files.append((s, f"p{p}", rng.randrange(1, 12), rng.randrange(1, 6), rng.randrange(1, 4), False, rng.random() < 0.1, rng.random() < 0.2))
            for c in range(rng.randrange(0, 5)):
                classes.append((s, f"p{p}", c, f"{s}{p}{c}"))
                items += [(s, f"p{p}", c, i, rng.choice(["field", "method", "relation", "scope"]), f"r{rng.randrange(6)}", rng.randrange(0, 3), rng.randrange(0, 5)) for i in range(rng.randrange(0, 4))]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(4)
    got = focus.build_catalog(frame(files, FILES), frame(classes, "s string, path string, class_no int, class_id string"), frame(items, "s string, path string, class_no int, item_no int, kind string, item_id string, records long, text long"), ["s"], limits)
    c, d, r, w = [[tuple(x) for x in df.collect()] for df in got]
    want = {s: loop(*[[x for x in rows if x[0] == s] for rows in (files, classes, items)], limits) for s in "abcd"}
    assert sorted(c) == sorted((s, *x) for s in want for x in want[s][0])
    assert sorted(x[:4] for x in d) == sorted((s, *x) for s in want for x in want[s][1])
    assert sorted(r) == sorted((s, p, i) for s in want for i, p in want[s][2].items())
    assert sorted(w) == sorted({(s, x) for s in want for x in want[s][3]})
