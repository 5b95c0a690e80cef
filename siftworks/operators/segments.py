"""Text segmentation: lines and words with byte ranges, so that all other operators run on any text corpus."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _starts(text: Column, mark: str) -> Column:
    """Where the pieces of a text between marks of one byte begin, in bytes: a running sum over the text's own pieces,
    taken in place, so that nothing is shuffled for it."""

    @F.arrow_udf("array<long>")
    def starts(texts: pa.Array) -> pa.Array:
        parts = pc.split_pattern(texts.cast(pa.large_string()), mark)
        sizes = pc.add(pc.cast(pc.binary_length(parts.flatten()), pa.int64()), 1)
        ends = pc.cumulative_sum(sizes)
        begins = pc.subtract(ends, sizes)
        # a text's first piece begins at 0: what stands before the text is taken off
        first = parts.offsets.take(pc.list_parent_indices(parts))
        moved = pc.subtract(begins, begins.take(first))
        return pa.ListArray.from_arrays(parts.offsets, moved, mask=pc.is_null(texts) if texts.null_count else None)

    return starts(text)


def segment_lines(docs: DataFrame) -> DataFrame:
    """A row for each line of docs (path, text, ...): line_no from 1, line, [start, end) in bytes, name (first word)."""
    keys = [c for c in docs.columns if c != "text"]
    flat = docs.select(*keys, F.posexplode(F.arrays_zip(F.split("text", "\n").alias("line"), _starts(F.col("text"), "\n").alias("start"))).alias("i", "l"))
    out = flat.select(*keys, (F.col("i") + 1).cast("long").alias("line_no"), "l.line", "l.start")
    return out.select("*", (F.col("start") + F.octet_length("line")).alias("end"), F.nullif(F.split("line", " ")[0], F.lit("")).alias("name"))


def segment_words(lines: DataFrame) -> DataFrame:
    """A row for each word (parted by spaces) of lines: word_no from 1 in its line, word, [start, end) in bytes."""
    words = F.posexplode(F.arrays_zip(F.split("line", " ").alias("word"), _starts(F.col("line"), " ").alias("off")))
    flat = lines.select("source_set_id", "path", "doc_id", "line_no", F.col("start").alias("at"), words.alias("i", "w")).filter("w.word <> ''")
    out = flat.select("source_set_id", "path", "doc_id", "line_no", (F.col("i") + 1).cast("long").alias("word_no"), "w.word", (F.col("at") + F.col("w.off")).alias("start"))
    return out.withColumn("end", F.col("start") + F.octet_length("word"))
