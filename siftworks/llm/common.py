"""What the training-data operators share: stored intermediate tables, word hashing, n-gram hashing, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of a word boundary: space, tab, LF, VT, FF, CR.
WHITE = b" \t\n\x0b\x0c\r"
#: Bytes of text that are hashed at once; a longer text is hashed as a whole.
SLICE = 1 << 20

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)


# --- intermediate tables ---------------------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, or the folder given to setCheckpointDir.

    Where neither is set, local mode gets a folder of its own; on a cluster executors couldn't see one, so that fails."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        hadoop = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = hadoop.get() if hadoop.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-stages-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs its running tasks, never the stages before the table.
    """
    path = f"{shared_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_text(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id as long, text without nulls, and no other columns: extra columns of docs can't clash with ours."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def boxed(docs: DataFrame) -> DataFrame:
    """docs as one column `row`, so that none of its columns can clash with helper columns; back by select("row.*")."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


# --- hashing ---------------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (a multiply-xorshift finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_values(seed: int, lower: bool, white: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A random value for each byte (A-Z as a-z if lower), and whether the byte belongs to a word."""
    values = mix(np.arange(1, 257, dtype=_U) * _ODD + _U(seed))
    word = np.ones(256, bool)
    word[list(white)] = False
    if lower:
        values[65:91] = values[97:123]
    return values, word


class Powers:
    """Powers of the rolling base and of its inverse, as many as the longest slice needs."""

    def __init__(self):
        self.up, self.down = np.ones(1, _U), np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE + 1)
            up, down = np.full(size, _U(_BASE)), np.full(size, _U(_BASE_INV))
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
        return self.up[:n], self.down[:n]


class WordHasher:
    """64-bit hashes of the words of many texts at once.

    The hash of a word is a polynomial in its bytes, taken from prefix sums over the slice and shifted back to the
    word's own start, so equal words have equal hashes wherever they stand.
    """

    def __init__(self, seed: int = 1, lower: bool = False, white: bytes = WHITE):
        self.values, self.word = _byte_values(seed, lower, white)
        self.powers = Powers()

    def words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """data: bytes of texts end to end; bounds: where they begin, and the end.

        Returns hash, start and end (in data) of each word, and for each text the number of its first word, and the
        number of words at last.
        """
        n = len(data)
        inside = self.word[data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        first = bounds[:-1][bounds[:-1] < n]
        before[first] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        if n:
            after[:-1] = inside[1:]
            after[first[first > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        up, down = self.powers.get(n + 1)
        sums = np.zeros(n + 1, _U)
        np.cumsum(self.values[data] * up[:n], dtype=_U, out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
        return hashes, starts, ends, np.searchsorted(starts, bounds)


def slices(batch: pa.RecordBatch | pa.Table, column: str = "text", size: int = SLICE):
    """Yields (first row, rows, bytes, bounds) for runs of texts of about size bytes; a text is never cut."""
    col = batch.column(column)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else pa.binary()
    col = col.cast(kind)
    wide = np.int64 if kind == pa.large_binary() else np.int32
    _, at, data = col.buffers()
    offsets = np.frombuffer(at, wide)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j - i, whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each position on; one for each position but the last k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return hashes[:0]
    out = np.zeros(n, _U)
    for j in range(k):
        out = out * _ODD + hashes[j : j + n]
    return mix(out)


def window_fits(n: int, firsts: np.ndarray, k: int) -> np.ndarray:
    """Whether the k words from each position on lie in one text. firsts: as from words()."""
    left = np.repeat(firsts[1:], np.diff(firsts))
    return np.arange(n) + k <= left


def text_of(firsts: np.ndarray) -> np.ndarray:
    """The number of the text of each word."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == _U else values.astype(np.int64), pa.int64())


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + lengths[0] - 1, starts[1] .. and so on."""
    total = int(lengths.sum())
    at = np.cumsum(lengths) - lengths
    return np.repeat(starts - at, lengths) + np.arange(total)


# --- components ------------------------------------------------------------------------------------------------------


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """(node, component) for each node of an undirected link table; component is the smallest node reachable.

    Alternates large-star and small-star steps: each is one shuffle by node, a node's neighbours are never gathered
    (only their minimum is), and long chains shrink geometrically. Links with a null end are dropped.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v"))).distinct()
    edges = stored(edges.filter("u <> v").distinct(), "edges")

    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u"))) if large else e.select("u", "v")
        # written apart, so that the join deals out both sides anew and Spark can split a hub's neighbours
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "least")
        moved = both.join(low, "u")
        if large:  # larger neighbours go to the smallest one
            return moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()

    for _ in range(rounds):
        after = stored(step(step(edges, True), False), "edges")
        # done if every node hangs on a root: no node is both a child and a parent, and each has one parent
        state = after.groupBy("u").agg(F.count("*").alias("n")).agg(F.max("n").alias("most")).collect()[0]["most"]
        deep = after.select("v").join(after.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        edges = after
        if (state or 1) == 1 and not deep:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
