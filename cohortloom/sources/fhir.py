"""FHIR resources: reading, keys, deduplication, patient ownership, attachments, bundles.

A resource frame has resource_type, id and body (JSON text).
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom.functions.columns import audit_token, normalize_reference, references
from cohortloom.sources.tables import small, written

MAX_DOCUMENT_BYTES = 20 * 1024 * 1024


def canonical_json(body: Column) -> Column:
    """JSON text with sorted keys and no blanks; a text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(body)), body)


def strip_narrative(body: Column) -> Column:
    """JSON text without any key ``text`` at any depth."""

    def without(x):
        if isinstance(x, dict):
            return {k: without(v) for k, v in x.items() if k != "text"}
        return [without(v) for v in x] if isinstance(x, list) else x

    @F.pandas_udf("string")
    def strip(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(without(json.loads(t)), sort_keys=True, separators=(",", ":"), ensure_ascii=False))

    return F.when(body.contains('"text"'), strip(body)).otherwise(canonical_json(body))


def with_type_and_id(bodies: DataFrame) -> DataFrame:
    return bodies.select(F.get_json_object("body", "$.resourceType").alias("resource_type"), F.get_json_object("body", "$.id").alias("id"), "body")


def unwrap_bundles(bodies: DataFrame) -> DataFrame:
    """Bundle texts become their entries' resources; other texts pass through."""
    kind = F.get_json_object("body", "$.resourceType")
    entries = F.from_json(F.get_json_object("body", "$.entry"), "array<struct<resource: string>>")
    inner = bodies.where(kind == "Bundle").select(F.explode(entries).alias("e")).select(F.col("e.resource").alias("body")).where("body is not null")
    return bodies.where(~kind.eqNullSafe("Bundle")).select("body").unionByName(inner)


#: Files of one resource a line, and files of one JSON value; suffixes are case-blind.
LINES = "*.{[nN][dD][jJ][sS][oO][nN],[jJ][sS][oO][nN][lL]}"
WHOLE = "*.[jJ][sS][oO][nN]"


def line_files(reader, path: str) -> DataFrame:
    """(file, block, body) of every line below path; a block is a file's split."""
    lines = reader.option("recursiveFileLookup", True).option("pathGlobFilter", LINES).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("body"))


def whole_files(reader, path: str) -> DataFrame:
    """(file, body) of every .json file below path."""
    files = reader.option("recursiveFileLookup", True).option("pathGlobFilter", WHOLE).option("wholetext", True).text(path)
    return files.select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("body"))


def parsed(lines: DataFrame, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resources, bad lines (file, line, body)) of ``line_files`` and ``whole_files``, Bundles unwrapped.

    Blank lines are skipped but counted. The number of a bad line is the lines of the
    file's earlier blocks and its place in its own; a bad value of a .json file has none.
    """
    listed = F.from_json("body", "array<string>")
    single = whole.where(~F.col("body").startswith("[")).unionByName(whole.where(F.col("body").startswith("[")).select("file", F.explode(listed).alias("body")))
    good = F.coalesce(F.trim("body").startswith("{") & F.try_parse_json("body").isNotNull(), F.lit(False))
    lines = lines.withColumn("at", F.monotonically_increasing_id())  # by one from line to line of a block
    held = lines.where(F.trim("body") != "")
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    bad = held.where(~good).join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "body")
    bad = bad.unionByName(single.where(~good).select("file", F.lit(None).cast("long").alias("line"), "body"))
    return with_type_and_id(unwrap_bundles(held.select("body").unionByName(single.select("body")).where(good))), bad


def read_fhir(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(resources, bad lines) of all .ndjson, .jsonl and .json files below path, suffixes case-blind, Bundles unwrapped.

    Blank lines are skipped. A .json file is one object, a list or a Bundle.
    Bad lines carry file, line number and text.
    """
    return parsed(line_files(spark.read, path), whole_files(spark.read, path))


def with_key(resources: DataFrame) -> DataFrame:
    """key (``Type/id``, else ``sha256:<digest>``) and digest of the canonical text."""
    out = resources.withColumn("digest", F.sha2(canonical_json(F.col("body")), 256))
    both = F.col("resource_type").isNotNull() & F.col("id").isNotNull()
    return out.withColumn("key", F.when(both, F.concat_ws("/", "resource_type", "id")).otherwise(F.concat(F.lit("sha256:"), "digest")))


def dedupe(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per key with its number of copies, conflicts: keys with several digests)."""
    got = keyed.groupBy("key").agg(
        F.min("resource_type").alias("resource_type"), F.min("id").alias("id"), F.min_by("body", "digest").alias("body"), F.min("digest").alias("digest"),
        F.count_distinct("digest").alias("digests"), F.count("*").alias("copies"),
    )
    return got.drop("digests"), got.where("digests > 1").select("key", "digests", "copies")


def with_references(keyed: DataFrame) -> DataFrame:
    """(key, resource_type, id, refs) of the resources: refs are their distinct references in normal form; written once, so that texts are parsed once."""
    if "refs" in keyed.columns:
        return keyed
    return written(keyed.select("key", "resource_type", "id", F.array_distinct(F.transform(references(F.col("body")), normalize_reference)).alias("refs")), "fhir-references")


def edges(keyed: DataFrame) -> DataFrame:
    """(key, ref): references between resources that are both present."""
    keyed = with_references(keyed)
    return keyed.select("key", F.explode("refs").alias("ref")).join(keyed.select(F.col("key").alias("ref")), "ref", "left_semi").select("key", "ref")


def ownership(keyed: DataFrame, max_rounds: int = 50, links: DataFrame | None = None) -> DataFrame:
    """(key, patient_id): every known patient that owns a resource, directly or through what it refers to.

    A round hands owners one reference further, from the referenced resource to
    the referring one, only for pairs that are new; lineage is cut each round. Patients
    are handed to those that name them at once, so that rounds need references to
    resources alone that refer to something themselves. Helpers shared by many
    patients hand nothing on, as they own nothing.
    """
    keyed = with_references(keyed)
    people = keyed.where("resource_type = 'Patient' and id is not null")
    refs = keyed.select("key", F.explode("refs").alias("ref")) if links is None else links
    chain = written(refs.join(keyed.where(F.size("refs") > 0).select(F.col("key").alias("ref")), "ref", "left_semi").select("key", "ref"), "fhir-chain")
    named = keyed.select("key", F.explode("refs").alias("r")).where(F.col("r").startswith("Patient/")).select("key", F.substring_index("r", "/", -1).alias("patient_id"))
    fresh = written(named.join(people.select(F.col("id").alias("patient_id")), "patient_id", "left_semi").select("key", "patient_id").distinct(), "fhir-owners")
    owners = fresh.unionByName(people.select("key", F.col("id").alias("patient_id"))).distinct()
    owners = written(owners, "fhir-owners")
    for _ in range(max_rounds):
        handed = chain.join(fresh.withColumnRenamed("key", "ref"), "ref").select("key", "patient_id").distinct()
        fresh = written(handed.join(owners, ["key", "patient_id"], "left_anti"), "fhir-owners")
        if fresh.isEmpty():
            return owners
        owners = owners.unionByName(fresh)
    raise RuntimeError("ownership did not settle")


def group_by_patient(keyed: DataFrame, max_rounds: int = 50, links: DataFrame | None = None, owners: DataFrame | None = None) -> dict[str, DataFrame]:
    """members (patient_id, key) with helpers copied in, ambiguous (key) and orphans (key); links and owners where they are known already."""
    keyed = with_references(keyed)
    owners = ownership(keyed, max_rounds, links) if owners is None else owners
    links = edges(keyed) if links is None else links
    counted = written(owners.groupBy("key").agg(F.count("*").alias("n"), F.min("patient_id").alias("patient_id")), "fhir-owned")
    single, ambiguous = counted.where("n = 1").select("patient_id", "key"), counted.where("n > 1").select("key")
    free = written(links.join(counted.select(F.col("key").alias("ref")), "ref", "left_anti").select("key", "ref"), "fhir-free")
    fresh = written(free.join(single, "key").select("patient_id", F.col("ref").alias("key")).distinct(), "fhir-members")
    helpers = fresh
    for _ in range(max_rounds):
        # many patients share few helpers, so that few references are left to follow
        onward = free.join(small(fresh.select("key").distinct()), "key", "left_semi")
        reached = onward.join(fresh, "key").select("patient_id", F.col("ref").alias("key")).distinct()
        fresh = written(reached.join(helpers, ["patient_id", "key"], "left_anti"), "fhir-members")
        if fresh.isEmpty():
            break
        helpers = helpers.unionByName(fresh)
    held = single.select("key").unionByName(helpers.select("key").distinct())
    orphans = keyed.where("resource_type is null or resource_type <> 'Patient'").select("key").join(held, "key", "left_anti")
    return {"members": single.unionByName(helpers), "ambiguous": ambiguous, "orphans": orphans}


def write_bundles(bundles: DataFrame, folder: str, key: bytes) -> None:
    """Writes ``patient_bundles`` as one file per patient below ``patient=<keyed token>``; a patient that is written again replaces its file, others stay."""
    named = bundles.select(audit_token(F.col("patient_id"), key, 64).alias("patient"), F.col("bundle").alias("value"))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("patient").text(folder)


def read_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """(patient, bundle): token and text of every written bundle."""
    return spark.read.option("wholetext", True).text(folder).select("patient", F.rtrim(F.regexp_replace("value", "\\n+$", "")).alias("bundle"))


def patient_bundles(keyed: DataFrame, members: DataFrame) -> DataFrame:
    """(patient_id, bundle): one collection Bundle per patient, the Patient first, then by type, id and digest."""
    rows = members.join(keyed, "key")
    entry = F.struct((F.col("resource_type") != "Patient").alias("rest"), F.coalesce("resource_type", F.lit("")).alias("t"), F.coalesce("id", F.lit("")).alias("i"), "digest", "body")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat(F.lit('{"resource":'), e["body"], F.lit("}"))), ",")
    return rows.groupBy("patient_id").agg(F.concat(F.lit('{"resourceType":"Bundle","type":"collection","entry":['), listed, F.lit("]}")).alias("bundle"))


def extract_attachments(resources: DataFrame, limit: int = MAX_DOCUMENT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents, failures) of DocumentReference attachments: decoded bytes with media type and hash."""
    content = F.from_json(F.get_json_object("body", "$.content"), "array<struct<attachment: struct<contentType: string, data: string>>>")
    rows = resources.where("resource_type = 'DocumentReference'").select("id", F.posexplode(content).alias("position", "c")).select("id", "position", "c.attachment.*")
    rows = rows.withColumn("bytes", F.try_to_binary("data", F.lit("base64"))).withColumn("media_type", F.trim(F.substring_index("contentType", ";", 1)))
    reason = F.when(F.col("data").isNull(), "no_data").when(F.col("bytes").isNull(), "bad_base64").when(F.octet_length("bytes") > limit, "too_large")
    good = rows.where(reason.isNull()).select("id", "position", "media_type", "bytes", F.sha2("bytes", 256).alias("document_hash"))
    return good, rows.where(reason.isNotNull()).select("id", "position", reason.alias("reason"))


def distinct_documents(documents: DataFrame) -> DataFrame:
    """(document_hash, media_type, bytes, referrers): each distinct document once, for one processing."""
    return documents.groupBy("document_hash").agg(F.min("media_type").alias("media_type"), F.first("bytes").alias("bytes"), F.count("*").alias("referrers"))


def tag_enriched(resources: DataFrame, document_hash: str = "document_hash", pages: str = "pages") -> DataFrame:
    """Extracted resources with the id ``enr-<hash12>-<id>`` and three provenance tags."""
    tag = lambda name, value: F.struct(F.lit(name).alias("system"), value.cast("string").alias("code"))
    tags = F.array(tag("origin", F.lit("enriched")), tag("document-hash", F.col(document_hash)), tag("source-pages", F.col(pages)))
    return resources.withColumn("id", F.concat(F.lit("enr-"), F.substring(document_hash, 1, 12), F.lit("-"), F.col("id"))).withColumn("tags", tags)


def first_seen(found: DataFrame) -> DataFrame:
    """(patient_id, seq): first place of each patient over all pages of a search."""
    return found.groupBy("patient_id").agg(F.min("seq").alias("seq"))


def page_summary(resources: DataFrame) -> DataFrame:
    """(resource_type, total, patients)."""
    return resources.groupBy("resource_type").agg(F.count("*").alias("total"), F.count_distinct("id").alias("ids"))
