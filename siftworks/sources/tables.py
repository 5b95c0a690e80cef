"""Intermediate tables, publication of revisions, and pinned reads."""

from __future__ import annotations

import json
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's spark.checkpoint.dir. Where it is unset, local mode gets a folder
    of its own; on a cluster executors couldn't see one, so that fails."""
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
    """Write df as a Parquet table in the shared folder and read it again: lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class StaleHead(RuntimeError):
    """Another publication came first."""


class ExpiredPin(RuntimeError):
    """The pinned revision isn't published any more, or never was."""


HEAD = "seq long, revision_id string, before string, attempt string"


def _files(spark: SparkSession, path: str):
    """The file context of a path, and the path; for what Spark's readers and writers can't do."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.getFileSystem(conf).getUri(), conf), place


def _numbers(spark: SparkSession, out: str) -> list[int]:
    """The numbers of all head files, read or not, falling."""
    files, place = _files(spark, f"{out}/head")
    if not files.util().exists(place):
        return []
    names = [f.getPath().getName() for f in files.util().listStatus(place)]
    return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)


def _last(spark: SparkSession, out: str, numbers: list[int]):
    """The newest head that can be read: one row, or None. One that is empty is what a writer left that was lost."""
    for n in numbers:
        rows = spark.read.schema(HEAD).json(f"{out}/head/{n:012d}.json").filter("seq is not null and revision_id is not null").collect()
        if rows:
            return rows[0]
    return None


def head(spark: SparkSession, out: str) -> str | None:
    """The published revision, from the last head file; None before the first publication."""
    row = _last(spark, out, _numbers(spark, out))
    return row["revision_id"] if row else None


def _create(spark: SparkSession, path: str, text: str) -> None:
    """A new file with its whole content, or StaleHead if there is one: it is written under a name of its own and then
    renamed without overwriting, so that of two writers one loses and a lost one leaves no half-written head."""
    folder, _, name = path.rpartition("/")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(draft := f"{folder}/_draft-{uuid.uuid4().hex}")
    files, place = _files(spark, draft)
    part = next(f.getPath() for f in files.util().listStatus(place) if f.getPath().getName().startswith("part-"))
    jvm = spark.sparkContext._jvm
    never = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(part, jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), never)
    except Exception as e:  # noqa: BLE001  the JVM's exception is wrapped
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            raise StaleHead(path) from e
        raise
    files.delete(place, True)


def _publish(spark: SparkSession, versions: DataFrame | None, manifest: DataFrame, out: str, revision_id: str, expected_head: str | None) -> None:
    numbers = _numbers(spark, out)
    last = _last(spark, out, numbers)
    now = last["revision_id"] if last else None
    if now == revision_id and last["before"] == expected_head:
        return  # a retry of what was published after all
    if now != expected_head:
        raise StaleHead(f"the head of {out} isn't {expected_head}")
    if versions is not None:
        new = versions.dropDuplicates(["version_id"])
        if last:
            new = new.join(spark.read.parquet(f"{out}/versions").select("version_id"), "version_id", "left_anti")
        new.write.mode("append").parquet(f"{out}/versions")
    # what a lost or broken attempt leaves behind is under another attempt, which no head names
    attempt = uuid.uuid4().hex
    manifest.withColumns({"revision_id": F.lit(revision_id), "attempt": F.lit(attempt)}).write.mode("append").partitionBy("revision_id", "attempt").parquet(f"{out}/manifest")
    seq = numbers[0] + 1 if numbers else 0
    _create(spark, f"{out}/head/{seq:012d}.json", json.dumps({"seq": seq, "revision_id": revision_id, "before": expected_head, "attempt": attempt}))


def publish(versions: DataFrame, manifest: DataFrame, out: str, revision_id: str, expected_head: str | None) -> None:
    """Append new versions (version_id, ...) and the manifest of a revision (path, version_id), and then move the head.

    Readers go from the head to the manifest to the versions, so they see the old revision or the new one whole. The
    head must be expected_head, and the new head is a file that appears whole and that only one writer can name; else
    StaleHead is raised and nothing is published. (The file system must refuse to rename onto a file that exists, in one
    step where writers race; the local one checks first.) A head file that can't be read counts as absent, and its
    number isn't used again. Versions that are stored already are not written again. A publication may be
    tried again after any failure: if it had gone through, nothing happens.
    """
    _publish(versions.sparkSession, versions, manifest, out, revision_id, expected_head)


def publish_unchanged(spark: SparkSession, out: str, revision_id: str, expected_head: str) -> None:
    """A new revision of the same versions: a manifest and a head, and no version rows."""
    if _attempt(spark, out, expected_head) is None:
        raise StaleHead(f"{expected_head} was never published to {out}")
    _publish(spark, None, manifest_of(spark, out, expected_head), out, revision_id, expected_head)


def _attempt(spark: SparkSession, out: str, revision_id: str) -> str | None:
    """The attempt by which a revision was published last."""
    if not _numbers(spark, out):
        return None
    found = spark.read.schema(HEAD).json(f"{out}/head").filter(F.col("revision_id") == revision_id).agg(F.max_by("attempt", "seq").alias("a"))
    return found.collect()[0]["a"]


def manifest_of(spark: SparkSession, out: str, revision_id: str) -> DataFrame:
    """path, version_id of a published revision; ExpiredPin if it isn't one."""
    attempt = _attempt(spark, out, revision_id)
    if attempt is None:
        raise ExpiredPin(revision_id)
    m = spark.read.parquet(f"{out}/manifest").filter((F.col("revision_id") == revision_id) & (F.col("attempt") == attempt))
    return m.drop("revision_id", "attempt")


def at_pin(spark: SparkSession, out: str, revision_id: str) -> DataFrame:
    """Versions of one revision, by its manifest partition alone; ExpiredPin if it isn't there. Versions that two writers
    stored at the same time count once."""
    manifest = manifest_of(spark, out, revision_id)
    wanted = spark.read.parquet(f"{out}/versions").join(manifest.select("version_id").distinct(), "version_id", "left_semi")
    return wanted.dropDuplicates(["version_id"]).join(manifest, "version_id")


def release(spark: SparkSession, out: str, keep: list[str]) -> DataFrame:
    """Versions that no kept revision names: what may be removed."""
    kept = [manifest_of(spark, out, r).select("version_id") for r in keep]
    versions = spark.read.parquet(f"{out}/versions").select("version_id").distinct()
    return versions.join(reduce(DataFrame.union, kept).distinct(), "version_id", "left_anti") if kept else versions
