"""Vector codes: each vector as one codebook index for each of its parts, codebooks by Lloyd rounds over active entries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Vectors that a task compares with a codebook at once.
ROWS = 4096
#: The rows of a round's table: vectors with their codes, and what a task's vectors add to the entries' sums.
_VECTOR, _SUM = 0, 1
_STATE = "kind int, vec_id {id}, label {label}, v array<int>, code array<int>, dist array<bigint>, slot int, at int, total bigint"


@dataclass
class Codebooks:
    """books: parts x entries x components, as integers of 1/scale. Bounded by entries x the vectors' length."""

    books: np.ndarray
    scale: int

    def sha256(self) -> str:
        """Digest of all components in decimal by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> list[float]:
        """The vector that a code stands for."""
        at = bytes.fromhex(code)
        return [x / self.scale for part, entry in enumerate(at) for x in self.books[part, entry].tolist()]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of x and its squared distance, ties to the lower index.

    Products are taken as doubles where no sum can leave their 53 bits, else as 64-bit integers; both are exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * most * most * max(1, x.shape[1]) < 1 << 53 else np.int64
    a, b = x.astype(kind), book.astype(kind)
    d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at].astype(np.int64)


def reassign(x: np.ndarray, code: np.ndarray, dist: np.ndarray, book: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entries after some entries moved, from the ones before (code, dist; code -1: none yet).

    A row whose entry stayed keeps its distance, so only moved entries can beat it: nearer, or as near and of lower
    index. All that stayed were compared before. A row whose entry moved is compared with the whole codebook."""
    code, dist = code.copy(), dist.copy()
    stays = code >= 0
    stays[stays] = ~moved[code[stays]]
    rescan = np.flatnonzero(~stays)
    if len(rescan):
        code[rescan], dist[rescan] = nearest(x[rescan], book)
    active, rest = np.flatnonzero(moved), np.flatnonzero(stays)
    if len(active) and len(rest):
        at, d = nearest(x[rest], book[active])
        at = active[at]
        wins = (d < dist[rest]) | ((d == dist[rest]) & (at < code[rest]))
        code[rest[wins]], dist[rest[wins]] = at[wins], d[wins]
    return code, dist


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """A list column as a matrix; shorter lists end in zeros."""
    n = len(column)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if (lengths == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width), kind)
    out[np.repeat(np.arange(n), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), kind)).cast(pa.list_(kind))


def _integers(scale: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                v = np.floor(_matrix(b.column("embedding"), width, np.float64) * scale).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), _lists(v, pa.int32())], ["vec_id", "label", "v"])

    return run


def _round(books: np.ndarray, moved: np.ndarray, last: bool, id_type: pa.DataType, label_type: pa.DataType):
    """One pass: new codes of a task's vectors, and what the changed ones add to and take from the entries' sums."""
    parts, entries, w = books.shape
    names = ["kind", "vec_id", "label", "v", "code", "dist", "slot", "at", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, w), np.int64), np.zeros(parts * entries, np.int64)
        for whole in batches:
            for i in range(0, len(whole), ROWS):
                b = whole.slice(i, ROWS)
                n = len(b)
                v = _matrix(b.column("v"), parts * w, np.int64)
                first = b.column("code").null_count == n
                old = np.full((n, parts), -1) if first else _matrix(b.column("code"), parts, np.int64)
                dist = np.zeros((n, parts), np.int64) if first else _matrix(b.column("dist"), parts, np.int64)
                code = old.copy()
                for p in range(parts):
                    x = v[:, p * w : (p + 1) * w]
                    code[:, p], dist[:, p] = reassign(x, old[:, p], dist[:, p], books[p], moved[p])
                    changed = np.flatnonzero(code[:, p] != old[:, p])
                    for slots, sign in ((code[changed, p], 1), (old[changed, p], -1)):
                        real = slots >= 0
                        np.add.at(sums, p * entries + slots[real], sign * x[changed[real]])
                        np.add.at(counts, p * entries + slots[real], sign)
                none = lambda t: pa.nulls(n, t)  # noqa: E731, B023
                vectors = pa.nulls(n, pa.list_(pa.int32())) if last else b.column("v")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, _VECTOR), pa.int32()), b.column("vec_id"), b.column("label"), vectors, _lists(code, pa.int32()), _lists(dist, pa.int64()), none(pa.int32()), none(pa.int32()), none(pa.int64())], names)
        if not last:
            slot, at = np.nonzero(sums)
            used = np.flatnonzero(counts)
            slot, at, total = np.concatenate((slot, used)), np.concatenate((at, np.full(len(used), -1))), np.concatenate((sums[slot, at], counts[used]))
            for i in range(0, len(slot), 1 << 16):
                s = slice(i, i + (1 << 16))
                n = len(slot[s])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, _SUM), pa.int32()), pa.nulls(n, id_type), pa.nulls(n, label_type), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64())), pa.array(slot[s], pa.int32()), pa.array(at[s], pa.int32()), pa.array(total[s], pa.int64())], names)

    return run


def compress(embeddings: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error), and the codebooks. embeddings: vec_id, embedding (array of float or double), label.

    Components become floor(scale x); a vector is cut into equal consecutive parts, each with a codebook that starts as
    that part of the vectors of smallest vec_id. Each round assigns every part to its nearest entry and moves entries
    to the floor of their parts' mean; unused entries stay. `code` has two hex digits for each part, `error` is the sum
    of the parts' squared distances after the last round.

    Each round is one pass over a table that holds the integer vectors with their assigned entries and exact distances
    (see `reassign`). The same pass yields, for each task, what the vectors that changed their entry add to and take
    from the entries' sums. So no vector is shuffled; what reaches the driver is at most entries x (length + parts)
    numbers a round, whatever the table's size, and so is what goes out with the codebooks.

    Rows go whose vector is null or has null or non-finite components. A shorter vector ends in zeros, as does a length
    that the parts don't divide. Rows that repeat a vec_id are vectors of their own, seeded in the order of their
    components; a null vec_id comes last. With fewer vectors than entries, all seed. An empty table gives an empty
    result. Values whose distances couldn't fit in a long are refused. Other columns are ignored."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part: 1 to 256 entries")
    spark = embeddings.sparkSession
    finite = embeddings.select("vec_id", "label", "embedding").filter(F.expr("embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"))
    size = finite.agg(F.max(F.size("embedding")).alias("n"), F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))).alias("most")).collect()[0]
    width = -(-(size["n"] or 0) // parts) * parts
    most = int(size["most"] or 0) * scale + scale + 1
    if most >= 1 << 31 or 4 * most * most * max(1, width) >= 1 << 63:
        raise OverflowError(f"components up to {size['most']} at length {width}: their squared distances don't fit in a long")
    kinds = dict(finite.dtypes)
    state = stored(finite.mapInArrow(_integers(scale, width), f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<int>"), "vectors")
    seeds = [r["v"] for r in state.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]
    k, w = len(seeds), width // parts
    books = np.array(seeds, np.int64).reshape(k, parts, w).transpose(1, 0, 2).copy()
    sums, counts, moved = np.zeros((parts * k, w), np.int64), np.zeros(parts * k, np.int64), np.ones((parts, k), bool)
    state = state.withColumns({"code": F.lit(None).cast("array<int>"), "dist": F.lit(None).cast("array<bigint>")})
    schema = _STATE.format(id=kinds["vec_id"], label=kinds["label"])
    arrow = {f.name: f.type for f in _arrow_schema(finite)}
    for i in range(rounds + 1):
        done = state.select("vec_id", "label", "v", "code", "dist").mapInArrow(_round(books, moved, i == rounds, arrow["vec_id"], arrow["label"]), schema)
        table = stored(done, f"codes{i}")
        state = table.filter(F.col("kind") == _VECTOR)
        if i == rounds:
            break
        for r in table.filter(F.col("kind") == _SUM).groupBy("slot", "at").agg(F.sum("total").alias("total")).collect():
            if r["at"] < 0:
                counts[r["slot"]] += r["total"]
            else:
                sums[r["slot"], r["at"]] += r["total"]
        used = counts > 0
        after = books.reshape(parts * k, w).copy()
        after[used] = np.floor_divide(sums[used], counts[used, None])
        after = after.reshape(books.shape)
        moved = (after != books).any(2)
        books = after
    digits = F.concat(*[F.lpad(F.lower(F.hex(F.get("code", p))), 2, "0") for p in range(parts)])
    coded = state.select("vec_id", "label", digits.alias("code"), F.expr("aggregate(dist, 0L, (a, x) -> a + x)").alias("error"))
    return coded, Codebooks(books, scale)


def _arrow_schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def vector_codes(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (the errors of all vectors of equal label, nulls together), codebooks_sha256.

    Odd rows as in `compress`. A label's error is summed before it is joined, one row for each label."""
    coded, books = compress(embeddings)
    by_label = stored(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def codes_sql(rounds: int = 4) -> str:
    """The whole of op12 in SQL: each round is a pair of tables, assignments by full comparison and new entries."""
    steps = [
        "kept as (select vec_id, label, [floor(1024 * x::double) for x in embedding] v from embeddings where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0)",
        "numbered as (select *, row_number() over (order by vec_id, v) r, (len(v) // 4)::bigint w from kept)",
        "x as materialized (select r, p, v[p * w + 1:(p + 1) * w] v from numbered, range(4) t(p))",
        "b0 as materialized (select p, r - 1 e, v c from x where r <= 256)",
    ]
    pick = "a{i} as materialized (select r, p, any_value(v) v, min({{'d': d, 'e': e}}) best from (select x.r, x.p, x.v, b.e, (list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.c) + list_inner_product(b.c, b.c))::bigint d from x join b{i} b using (p)) group by r, p)"
    move = "b{j} as materialized (select b.p, b.e, coalesce(m.c, b.c) c from b{i} b left join (select p, e, list(floor(s / n) order by i) c from (select p, best.e e, i, sum(v[i]) s, count(*) n from a{i}, unnest(range(1, len(v) + 1)) t(i) group by all) group by p, e) m on m.p = b.p and m.e = b.e)"
    for i in range(rounds):
        steps += [pick.format(i=i), move.format(i=i, j=i + 1)]
    steps += [pick.format(i=rounds), "total as (select r, string_agg(printf('%02x', best.e), '' order by p) code, sum(best.d)::bigint error from a{i} group by r)".format(i=rounds)]
    steps += ["digest as (select sha256(string_agg(c[i]::bigint::varchar, ',' order by p, e, i)) h from b{i} b, unnest(range(1, len(c) + 1)) t(i))".format(i=rounds)]
    return "with " + ",\n".join(steps) + "\nselect n.vec_id, t.code, t.error, sum(t.error) over (partition by n.label)::bigint label_error, (select h from digest) codebooks_sha256 from total t join numbered n using (r)"
