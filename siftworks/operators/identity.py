"""Content-derived identities, ordinals, digests and durable anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftworks.functions.text import content_hash, domain_digest, json_array, json_bool, json_number, json_object, json_string

from .stats import numbered

#: Domains of the digests; whoever needs the identities of another system passes its domains.
SYNTAX_DOMAIN, OCCURRENCE_DOMAIN, CONTEXT_DOMAIN = "siftworks.syntax.v1", "siftworks.occurrence.v1", "siftworks.extraction-context.v1"
SIBLINGS_DOMAIN, HEADER_DOMAIN, PROVENANCE_DOMAIN = "siftworks.siblings.v1", "siftworks.header.v1", "siftworks.provenance.v1"


def canonical_signature(s: Column) -> Column:
    of = json_object(parameterTypes=json_array(s["parameterTypes"], json_string), typeParameterCount=json_number(s["typeParameterCount"]), variadic=json_bool(s["variadic"]))
    return F.when(s.isNull(), F.lit("null")).otherwise(of)


def canonical_key(k: Column) -> Column:
    return json_object(kind=json_string(k["kind"]), name=json_string(k["name"]), ordinal=json_number(k["ordinal"]), signature=canonical_signature(k["signature"]))


def with_syntax_id(decls: DataFrame, domain: str = SYNTAX_DOMAIN) -> DataFrame:
    """Adds syntax_id (sid:v1: and 32 hex digits) and its canonical input, from source_set_id, path, language,
    ancestors (keys, outermost first) and key."""
    canonical = json_object(ancestors=json_array(F.col("ancestors"), canonical_key), declaration=canonical_key(F.col("key")), language=json_string(F.col("language")), path=json_string(F.col("path")), sourceSet=json_string(F.col("source_set_id")))
    return decls.withColumn("canonical", canonical).withColumn("syntax_id", F.concat(F.lit("sid:v1:"), F.left(domain_digest(domain, F.col("canonical")), F.lit(32))))


def with_occurrence_id(occ: DataFrame, domain: str = OCCURRENCE_DOMAIN) -> DataFrame:
    """Adds occurrence_id from content_hash, extraction_context, producer_id, producer_version, owner_syntax_id, kind
    and ordinal: equal bytes have equal ids in every revision."""
    canonical = json_object(
        contentHash=json_string(F.col("content_hash")), extractionContext=json_string(F.col("extraction_context")), nativeProducerId=json_string(F.col("producer_id")),
        nativeProducerVersion=json_string(F.col("producer_version")), ownerSyntaxId=json_string(F.col("owner_syntax_id")), kind=json_string(F.col("kind")), ordinal=json_number(F.col("ordinal")),
    )
    return occ.withColumn("canonical", canonical).withColumn("occurrence_id", F.concat(F.lit("occ:v2:"), F.left(domain_digest(domain, F.col("canonical")), F.lit(32))))


def extraction_contexts(components: DataFrame, domain: str = CONTEXT_DOMAIN) -> DataFrame:
    """language, extraction_context from (language, name, hash): over the sorted distinct components."""
    one = components.groupBy("language").agg(F.array_sort(F.collect_set(F.struct("name", "hash"))).alias("c"))
    item = lambda c: json_object(name=json_string(c["name"]), hash=json_string(c["hash"]))
    return one.select("language", domain_digest(domain, json_object(language=json_string(F.col("language")), components=json_array(F.col("c"), item))).alias("extraction_context"))


def id_collisions(df: DataFrame, id_col: str, canonical: str = "canonical") -> DataFrame:
    """Ids that stand for several canonical inputs, with how many."""
    return df.groupBy(id_col).agg(F.countDistinct(canonical).alias("inputs")).filter("inputs > 1")


def sibling_ordinals(decls: DataFrame, group: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Adds ordinal (from 0 by range in the group) and clash (whether another sibling has the same range)."""
    by = Window.partitionBy(*group).orderBy(start, end)
    same = Window.partitionBy(*group, start, end)
    return decls.withColumn("ordinal", (F.row_number().over(by) - 1).cast("long")).withColumn("clash", F.count("*").over(same) > 1)


def sibling_groups(decls: DataFrame, group: list[str], domain: str = SIBLINGS_DOMAIN) -> DataFrame:
    """For each group of (.., start, end, header_hash): the digest of the header hashes in source order, and counts."""
    one = decls.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "header_hash"))), lambda s: s["header_hash"]).alias("headers"))
    return one.select(*group, domain_digest(domain, json_array(F.col("headers"), json_string)).alias("sibling_group_hash"), F.size("headers").cast("long").alias("sibling_count"), F.size(F.array_distinct("headers")).cast("long").alias("distinct_headers"))


def capture_anchors(decls: DataFrame, group: list[str], domain: str = SIBLINGS_DOMAIN) -> DataFrame:
    """A durable anchor of each declaration: syntax_id, header_hash, and what its sibling group looks like."""
    same = decls.groupBy(*group, "header_hash").agg(F.count("*").alias("identical_header_count"))
    return decls.join(sibling_groups(decls, group, domain), group).join(same, [*group, "header_hash"]).select("syntax_id", *group, "header_hash", "sibling_group_hash", "sibling_count", "identical_header_count")


def audit_anchors(anchors: DataFrame, current: DataFrame, group: list[str], continuity: str = "unchanged", domain: str = SIBLINGS_DOMAIN) -> DataFrame:
    """syntax_id, state, reason of anchors against the declarations of another revision.

    In order: missing, headerMismatch; where headers repeat among siblings, groupChanged if the group looks otherwise
    or is known to have changed, unprovenContinuity if nothing proves that it hasn't; else attached.
    """
    now = capture_anchors(current, group, domain).select("syntax_id", *[F.col(c).alias(f"now_{c}") for c in ("header_hash", "sibling_group_hash", "sibling_count", "identical_header_count")])
    a = anchors.join(now, "syntax_id", "left")
    repeated = (F.col("identical_header_count") > 1) | (F.col("now_identical_header_count") > 1)
    other = (F.col("sibling_group_hash") != F.col("now_sibling_group_hash")) | (F.col("sibling_count") != F.col("now_sibling_count")) | (F.col("identical_header_count") != F.col("now_identical_header_count")) | F.lit(continuity == "changed")
    reason = F.when(F.col("now_header_hash").isNull(), "missing").when(F.col("now_header_hash") != F.col("header_hash"), "headerMismatch").when(repeated & other, "groupChanged").when(repeated & F.lit(continuity == "unknown"), "unprovenContinuity")
    return a.select("syntax_id", F.when(reason.isNull(), "attached").otherwise("orphaned").alias("state"), reason.alias("reason"))


def table_digest(df: DataFrame, keys: list[str], buckets: int = 1024) -> DataFrame:
    """rows and digest of a table, independent of its order and partitions: rows are hashed with their keys, ordered
    within buckets of the hash, and the buckets' digests are hashed in order. No task holds more than a bucket."""
    row = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    one = df.select(row.alias("h")).withColumn("b", F.conv(F.left("h", F.lit(8)), 16, 10).cast("long") % buckets)
    per = one.groupBy("b").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda s: s["d"]), ""), 256).alias("digest"))


def keyed_digest(df: DataFrame, key: str, columns: list[str], name: str, buckets: int = 1024) -> DataFrame:
    """key and name: a digest of each key's rows, whatever their order; rows are hashed, then buckets of hashes, then the
    buckets' digests, so a key of very many rows is spread over its buckets."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    one = df.select(key, row.alias("h")).withColumn("b", F.conv(F.left("h", F.lit(8)), 16, 10).cast("long") % buckets)
    per = one.groupBy(key, "b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    return per.groupBy(key).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda s: s["d"]), ""), 256).alias(name))


def catalog_id(packages: DataFrame, sources: DataFrame, fingerprints: DataFrame, key: str, parser_version: str, generation: str, revision: int) -> DataFrame:
    """key, catalog_id: a digest of the versions and of each catalog's packages, sources and fingerprints (key, ...)."""
    parts = [(packages, "packages"), (sources, "sources"), (fingerprints, "fingerprints")]
    digests = [keyed_digest(df, key, sorted(c for c in df.columns if c != key), name) for df, name in parts]
    j = digests[0].join(digests[1], key, "full_outer").join(digests[2], key, "full_outer")
    text = F.concat_ws("\n", F.lit(parser_version), F.lit(generation), F.lit(str(revision)), *[F.coalesce(n, F.lit("")) for _, n in parts])
    return j.select(key, F.concat(F.lit("catalog:"), F.sha2(text, 256)).alias("catalog_id"))


def manifest_hashes(docs: DataFrame, data: str = "text", buckets: int = 1 << 14) -> DataFrame:
    """source_set_id, files, manifest_hash: a digest of each source set's paths and content hashes, equal if and only if
    the manifests are. Taken over buckets as keyed_digest() does: no row holds a whole manifest."""
    one = docs.select("source_set_id", "path", content_hash(F.encode(F.col(data), "UTF-8")).alias("hash"))
    files = one.groupBy("source_set_id").agg(F.count("*").alias("files"))
    return files.join(keyed_digest(one, "source_set_id", ["hash", "path"], "manifest_hash", buckets), "source_set_id")


def document_witness(facts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, facts, witness: a digest of one document's facts in order of columns, without revision ids."""
    one = facts.groupBy(key).agg(F.array_sort(F.collect_list(F.concat_ws(":", *[F.col(c).cast("string") for c in columns]))).alias("f"))
    return one.select(key, F.size("f").cast("long").alias("facts"), F.sha2(F.array_join("f", "\n"), 256).alias("witness"))


def provenance_id(producer: Column, path: Column, revision: Column, domain: str = PROVENANCE_DOMAIN) -> Column:
    return F.concat(F.lit("prov:"), F.left(domain_digest(domain, json_object(producer=json_string(producer), path=json_string(path), revision=json_string(revision))), F.lit(32)))


def canonical_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """kind, row_key, payload of all rows of all tables: payload is their canonical JSON, row_key its place by payload."""
    out = None
    for kind, df in tables.items():
        cols = sorted(df.columns)
        one = df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("payload"))
        out = one if out is None else out.unionByName(one)
    return numbered(out, ["kind"], ["payload"], "row_key").select("kind", (F.col("row_key") - 1).alias("row_key"), "payload")
