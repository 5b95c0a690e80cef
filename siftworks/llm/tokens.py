"""Token ids of texts, flat token files on disk, and token counts by a separator scan over byte ranges of them."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftworks.operators.stats import ranges, with_earlier

from .common import shared_dir, stored

#: The separator of the byte-level vocabulary that stands between documents in flat files.
END_OF_TEXT = "<|endoftext|>"
END_ID = 50256
#: Where the two libraries could read white space otherwise: the slower one decides.
_WHITE = r"[\x1c-\x1f\x85\u180e\u200b-\u200d\u2060\ufeff]"
_ODD, _ODD_OR_SPECIAL = regex.compile(_WHITE), regex.compile(_WHITE + r"|<\|endoftext\|>")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """Ids of the byte-level vocabulary as `tokenizers` gives them with add_special_tokens=False.

    The same vocabulary as ranks is several times faster in tiktoken, and gives the same ids; a text with characters
    that the two might part differently goes to `tokenizers` itself. plain: the special token's string in a text is
    ordinary text, and no text has the special token's id.
    """

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None, plain: bool = False):
        self.plain, self.odd = plain, _ODD if plain else _ODD_OR_SPECIAL
        self.json_path = json_path or vocabulary("byte_bpe_50k.json")
        self.ranks_path = ranks_path or vocabulary("byte_bpe_50k.tiktoken")
        self._exact = self._fast = None

    @property
    def exact(self):
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self.json_path)
            self._exact.encode_special_tokens = self.plain
        return self._exact

    @property
    def fast(self):
        if self._fast is None:
            import public_tokenizers
            import tiktoken

            with open(self.ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return self._fast

    def ids(self, text: str) -> np.ndarray:
        if self.odd.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        if hasattr(self.fast, "encode_to_numpy"):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


#: Documents that a task tokenises before it writes their ids.
_DOCUMENTS = 256


def _write(folder: str, json_path: str | None, ranks_path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, file = ["file", "document", "doc_id", "n_bytes"], None
        document = n_bytes = 0
        for whole in batches:
            for i in range(0, len(whole), _DOCUMENTS):
                batch = whole.slice(i, _DOCUMENTS)
                n = len(batch)
                if file is None:  # a task without documents writes nothing
                    bpe = ByteBpe(json_path, ranks_path, plain=True)
                    file = f"{folder}/{uuid.uuid4().hex}.bin"
                    system, path = fs.FileSystem.from_uri(file)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path)
                for text in batch.column("text").to_pylist():
                    data = np.append(bpe.ids(text or ""), END_ID).astype("<u2").tobytes()
                    out.write(data)
                    n_bytes += len(data)
                yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(range(document, document + n), pa.int64()), batch.column("doc_id"), pa.nulls(n, pa.int64())], names)
                document += n
        if file is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([n_bytes], pa.int64())], names)

    return run


def write_flat_files(docs: DataFrame, folder: str | None = None, json_path: str | None = None, ranks_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes the documents' ids end to end into flat files: little-endian unsigned 16-bit words, each document closed
    by the end-of-text id, and nothing else: no header and no index.

    Returns files (file, n_bytes) and documents (file, document, doc_id): which document came where in its file, from
    0. Each task writes one file under a name of its own in the folder, by default one in spark.checkpoint.dir, through
    pyarrow.fs, so the folder may be on a shared disk or an object store that pyarrow knows. A task that is tried again
    writes another file; those of lost attempts are in no table. A null text is an empty document; the end-of-text
    token's string in a text is ordinary text. Repeated rows are documents of their own; an empty table writes no file."""
    folder = folder or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    written = stored(text.mapInArrow(_write(folder, json_path, ranks_path), "file string, document long, doc_id long, n_bytes long"), "flat-files")
    return written.filter("document is null").select("file", "n_bytes"), written.filter("document is not null").drop("n_bytes")


def flat_files(spark, folder: str) -> DataFrame:
    """file, n_bytes of the flat files in a folder; contents aren't read."""
    return spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), F.col("length").cast("long").alias("n_bytes"))


def _scan(separator: int, block_ids: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, opened, source = pa.list_(pa.int64()), None, None
        for batch in batches:
            found = []
            for file, block in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
                if file != opened:
                    system, path = fs.FileSystem.from_uri(file)
                    opened, source = file, system.open_input_file(path)
                ids = np.frombuffer(source.read_at(block_ids * width, block * block_ids * width), f"<u{width}")
                found.append(np.flatnonzero(ids == separator))
            off = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            at = pa.array(np.concatenate(found) if found else [], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.ListArray.from_arrays(pa.array(off), at).cast(kind)], ["file", "block", "at"])

    return run


def token_counts(files: DataFrame, separator: int = END_ID, block_ids: int = 1 << 17, width: int = 2) -> DataFrame:
    """file, document, start, n_tokens: the documents of flat token files and their counts, separators not counted.

    files: file, n_bytes. Files are dealt out as byte ranges of block_ids ids (words of `width` bytes), so that one file
    is read by many tasks; each range is searched by itself, as a vector. A prefix scan over the blocks then gives each
    block how many documents stand before it and where the last separator was, so a document may span any number of
    blocks. The scan itself goes by ranges of blocks: what a file's earlier ranges add up to is one row for each range,
    so no task sees all blocks of a large file. It moves a row for each block, of a few bytes for each document.

    `document` counts from 0 in a file, `start` is the place of its first id. Ids after the last separator are a
    document of their own; two separators in a row close an empty one. A file that is listed twice counts once; null
    files and those without bytes have no documents; a length that the width doesn't divide fails. Other columns are
    ignored."""
    sized = files.filter("file is not null and n_bytes > 0").groupBy("file").agg(F.max("n_bytes").cast("long").alias("n_bytes"))
    whole = F.when(F.col("n_bytes") % width == 0, F.col("n_bytes") / width).otherwise(F.raise_error(F.concat_ws(" ", "file", F.lit("has no whole number of ids")))).cast("long")
    sized = sized.select("file", whole.alias("ids"))
    blocks = sized.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("ids") - 1) / block_ids))).alias("block")).repartition("file", "block")
    found = blocks.mapInArrow(_scan(separator, block_ids, width), "file string, block long, at array<long>")
    base = F.col("block") * block_ids
    one = found.withColumns({"k": F.size("at").cast("long"), "end": base + F.element_at(F.when(F.size("at") > 0, F.col("at")), -1) + 1})
    dealt = with_earlier(ranges(one, ["file"], ["block"]), ["file"], F.sum, _k="k")
    dealt = with_earlier(dealt, ["file"], F.max, _end="end")
    before = Window.partitionBy("file", "_p").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    scan = dealt.select("file", "block", "at", (F.coalesce(F.sum("k").over(before), zero) + F.coalesce("_k", zero)).alias("docs"), F.coalesce(F.max("end").over(before), "_end", zero).alias("since"), "end", "k")
    scan = stored(scan, "separators")
    ends = scan.select("file", "docs", base.alias("base"), "since", "at", F.posexplode("at").alias("i", "e"))
    prior = F.when(F.col("i") > 0, F.col("base") + F.get("at", F.col("i") - 1) + 1).otherwise(F.col("since"))
    closed = ends.select("file", (F.col("docs") + F.col("i")).alias("document"), prior.alias("start"), (F.col("base") + F.col("e") - prior).alias("n_tokens"))
    last = scan.groupBy("file").agg(F.coalesce(F.max("end"), zero).alias("last"), F.sum("k").alias("k")).join(sized, "file").filter("ids > last")
    return closed.unionByName(last.select("file", F.col("k").alias("document"), F.col("last").alias("start"), (F.col("ids") - F.col("last")).alias("n_tokens")))


def document_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens of each row of docs, by writing flat files and scanning them. How the input is parted changes
    the files and nothing in the result. Odd rows as in write_flat_files."""
    files, documents = write_flat_files(docs)
    return documents.join(token_counts(files), ["file", "document"]).select("doc_id", "n_tokens")
