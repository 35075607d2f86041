"""Incremental arrival with Structured Streaming; results equal the batch jobs'."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.columns import normalize_reference, references
from cohortloom.operators import omop
from cohortloom.sources import fhir
from cohortloom.sources.tables import written


def ingest_new_files(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Takes only files that have not been taken before (.ndjson, .jsonl and .json); keeps resources, references, owners and bad lines.

    Every batch writes folders of its own, the ownership last; one that is run again
    after a failure replaces them and does not read them.
    """
    lines = fhir.line_files(spark.readStream, source)
    whole = fhir.whole_files(spark.readStream, source).select("file", F.lit(None).cast("long").alias("block"), "body")

    def take(batch: DataFrame, batch_id: int) -> None:
        resources, bad = fhir.parsed(batch.where("block is not null"), batch.where("block is null").select("file", "body"))
        fhir.with_key(resources).dropDuplicates(["key", "digest"]).write.mode("overwrite").parquet(f"{target}/resources/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{target}/bad/batch={batch_id}")
        extend_ownership(spark, target, batch_id)

    query = lines.unionByName(whole).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


RESOURCES = "resource_type string, id string, body string, digest string, key string, batch int"
REFERENCES = "key string, ref string, since int, batch int"
OWNERS = "key string, patient_id string, since int, batch int"


def _taken(spark: SparkSession, target: str, name: str, schema: str, before: int) -> DataFrame:
    """What batches earlier than ``before`` have written."""
    if before == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{target}/{name}").where(F.col("batch") < before)


def _current(rows: DataFrame, since: int) -> DataFrame:
    """References or owners since the last time that they were made anew."""
    return rows.where((F.col("since") == since) & F.col("key").isNotNull()).drop("since", "batch")


def _since(refs: DataFrame) -> int:
    """The batch that made references and owners anew last; every batch writes a reference without key that tells it."""
    return refs.agg(F.max("since")).first()[0] or 0


def _referred(keyed: DataFrame) -> DataFrame:
    """(key, ref) of every reference, also to resources that are not there yet."""
    return keyed.select("key", F.explode(F.array_distinct(F.transform(references(F.col("body")), normalize_reference))).alias("ref")).where("ref is not null")


def extend_ownership(spark: SparkSession, target: str, batch_id: int, max_rounds: int = 50) -> None:
    """Writes a batch's references and the (key, patient_id) pairs that it adds to the stored owners.

    New pairs come from new patients, and from new references to resources that are
    owned already; each round hands the pairs of the last one on over all references,
    to resources of this batch and of earlier ones. Owners are never recomputed, but
    for one case: a known key arrives with another text of a smaller digest, which is
    then the text that counts; all references and owners are made anew.
    """
    stored = _taken(spark, target, "resources", RESOURCES, batch_id)
    known = stored.groupBy("key").agg(F.min("digest").alias("kept"))
    batch = fhir.dedupe(spark.read.schema(RESOURCES).parquet(f"{target}/resources").where(F.col("batch") == batch_id))[0]
    now = written(batch.join(known, "key", "left"), "fhir-arrived")
    refs, owners = _taken(spark, target, "references", REFERENCES, batch_id), _taken(spark, target, "owners", OWNERS, batch_id)
    since = _since(refs)
    if now.where("kept is not null and digest < kept").isEmpty():
        arrived = now.where("kept is null")
        new_refs = written(_referred(arrived), "fhir-references")
        refs, owners = _current(refs, since), _current(owners, since)
    else:
        since = batch_id
        arrived = fhir.dedupe(stored.drop("batch").unionByName(now.select(*stored.drop("batch").columns)))[0]
        new_refs = written(_referred(arrived), "fhir-references")
        refs, owners = refs.select("key", "ref").limit(0), owners.select("key", "patient_id").limit(0)
    every = refs.unionByName(new_refs)
    own = arrived.where("resource_type = 'Patient' and id is not null").select("key", F.col("id").alias("patient_id"))
    met = new_refs.join(owners.withColumnRenamed("key", "ref"), "ref").select("key", "patient_id")
    added = fresh = written(own.unionByName(met).distinct(), "fhir-owners")
    for _ in range(max_rounds):
        handed = every.join(fresh.withColumnRenamed("key", "ref"), "ref").select("key", "patient_id").distinct()
        told = handed.join(owners.unionByName(added), ["key", "patient_id"])
        fresh = written(handed.join(told, ["key", "patient_id"], "left_anti"), "fhir-owners")
        if fresh.isEmpty():
            break
        added = added.unionByName(fresh)
    else:
        raise RuntimeError("ownership did not settle")
    mark = spark.createDataFrame([(None, None)], "key string, ref string")
    new_refs.unionByName(mark).withColumn("since", F.lit(since)).write.mode("overwrite").parquet(f"{target}/references/batch={batch_id}")
    added.join(owners, ["key", "patient_id"], "left_anti").withColumn("since", F.lit(since)).write.mode("overwrite").parquet(f"{target}/owners/batch={batch_id}")


def ingested(spark: SparkSession, target: str) -> DataFrame:
    """All resources taken so far, one row per key and digest."""
    return spark.read.schema(RESOURCES).parquet(f"{target}/resources").drop("batch").dropDuplicates(["key", "digest"])


def ingested_groups(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """resources, conflicts, members, ambiguous, orphans and bad lines of all files taken so far; owners are read, not found again."""
    unique, conflicts = fhir.dedupe(ingested(spark, target))
    unique = written(unique, "fhir-unique")
    refs, owners = (spark.read.schema(schema).parquet(f"{target}/{name}") for name, schema in (("references", REFERENCES), ("owners", OWNERS)))
    since = _since(refs)
    refs, owners = _current(refs, since), _current(owners, since)
    links = written(refs.join(unique.select(F.col("key").alias("ref")), "ref", "left_semi").select("key", "ref"), "fhir-links")
    groups = fhir.group_by_patient(unique, links=links, owners=owners)
    return {"resources": unique, "conflicts": conflicts, **groups, "bad": spark.read.schema("file string, line long, body string, batch int").parquet(f"{target}/bad").drop("batch")}


def materialize_new_responses(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, table_names: list[str]) -> None:
    """Takes response files (one JSON line per patient) that have not been taken before and materialises changed patients.

    Each batch writes its tables and its part of the patient ledger into folders
    of its own, the ledger last; a batch that is run again replaces them and does
    not read them. Unchanged patients are skipped, failed ones tried again.
    """
    from cohortloom.plans import jobs

    lines = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(source)

    def take(batch: DataFrame, batch_id: int) -> None:
        ledger = patient_ledger(spark, target, batch_id)
        latest = batch.groupBy("source_patient_id").agg(F.max_by(F.struct(*batch.columns), "bundle_hash").alias("x")).select("x.*")
        got = jobs.materialize(latest, ledger, table_names)
        told = got.pop("meta.ingest_patient")
        blocks = told.where("status = 'ok'").select("source_patient_id", "id_offset")
        for name, df in got.items():
            if name in table_names:
                offset = (F.floor(F.col("person_id") / omop.BLOCK) * omop.BLOCK).cast("long")
                df = df.withColumn("id_offset", offset).join(blocks, "id_offset").drop("id_offset")
            df.write.mode("overwrite").parquet(f"{target}/{name}/batch={batch_id}")
        told.write.mode("overwrite").parquet(f"{target}/ledger/batch={batch_id}")

    query = lines.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


LEDGER = "source_patient_id string, bundle_hash string, status string, id_offset long, batch int"


def patient_ledger(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """The latest row of each patient over all batches (earlier than ``before``, if given), and the block once given."""
    root = spark.createDataFrame([], LEDGER)
    rows = root
    if before is None or before > 0:
        rows = spark.read.schema(LEDGER).parquet(f"{target}/ledger")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    last = rows.groupBy("source_patient_id").agg(F.max_by(F.struct("bundle_hash", "status"), "batch").alias("x"), F.max("id_offset").alias("id_offset"))
    return last.select("source_patient_id", "x.*", "id_offset")


def materialized(spark: SparkSession, target: str, table: str) -> DataFrame:
    """The rows of each patient's latest batch."""
    rows = spark.read.parquet(f"{target}/{table}")
    latest = spark.read.schema(LEDGER).parquet(f"{target}/ledger").where("status = 'ok'").groupBy("source_patient_id").agg(F.max("batch").alias("batch"))
    return rows.join(latest, ["source_patient_id", "batch"], "left_semi").drop("batch", "source_patient_id")


def changed_patients(incoming: DataFrame, ledger: DataFrame) -> DataFrame:
    """Responses whose bundle hash is new for the patient; failed patients are tried again."""
    done = ledger.where("status = 'ok'").select("source_patient_id", "bundle_hash")
    return incoming.join(done, ["source_patient_id", "bundle_hash"], "left_anti")
