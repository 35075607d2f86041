"""Queries of loading: sidecars of patients who share local ids, tables patched in place by batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators import omop
from cohortloom.plans import jobs
from cohortloom.queries.records import enriched_resources
from cohortloom.schemas import schema
from cohortloom.sources import tables
from cohortloom.sources.patched import PatchedTables
from cohortloom.testbed import load

LOADED = ["omop.care_site", "omop.person", "omop.condition_occurrence"]


def mapped_responses(spark, d, version: str = "v1", people: str = "true", rows: str = "true") -> DataFrame:
    """A response per customer: one person and one care site of id 1, conditions numbered from 1 by order key.

    Every tenth order has a bad date; every mapping names its Condition, those of
    keys that 7 divides no id, and a third of the conditions have a second mapping.
    """
    c, o = load(spark, d, "customer").where(people), load(spark, d, "orders").where(rows)
    keys = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")))).alias("keys"))
    # customers are dealt as the orders are, so that a small file is not one task
    c = c.repartition("c_custkey")
    joined = c.join(keys, c["c_custkey"] == keys["o_custkey"], "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<struct<o_orderkey:bigint,day:string>>")))
    one = F.lit(1).cast("long")
    condition = lambda x, k: F.struct((k + 1).cast("long").alias("condition_occurrence_id"), one.alias("person_id"), F.lit(0).cast("long").alias("condition_concept_id"), F.when(x["o_orderkey"] % 10 == 0, F.lit("2024-13-77")).otherwise(x["day"]).alias("condition_start_date"))
    mapping = lambda x, k, more: F.struct(F.lit("Condition").alias("resource_type"), F.concat(F.lit("c"), x["o_orderkey"] + more).alias("resource_id"), F.lit("condition_occurrence").alias("omop_table"), F.when(x["o_orderkey"] % 7 != 0, k + 1).cast("long").alias("omop_id"), F.lit("MAPPED").alias("mapping_status"))
    maps = F.concat(F.transform("keys", lambda x, k: mapping(x, k, 0)), F.filter(F.transform("keys", lambda x, k: F.when(x["o_orderkey"] % 3 == 0, mapping(x, k, 1))), lambda m: m.isNotNull()))
    person = F.struct(one.alias("person_id"), F.lit(0).cast("long").alias("gender_concept_id"), (F.lit(1930) + F.col("c_custkey") % 65).cast("int").alias("year_of_birth"))
    site = F.struct(one.alias("care_site_id"), F.col("c_mktsegment").alias("care_site_name"))
    none = F.array().cast("array<struct<resource_type string, resource_id string, reason string>>")
    return joined.select(
        F.col("c_name").alias("source_patient_id"), F.concat(F.lit(version), F.lit("|"), "c_custkey").alias("bundle_hash"),
        F.struct(F.array(person).alias("person"), F.when(F.col("c_custkey") % 2 == 0, F.array(site)).otherwise(F.array().cast("array<struct<care_site_id:bigint,care_site_name:string>>")).alias("care_site"), F.transform("keys", condition).alias("condition_occurrence")).alias("tables"),
        maps.alias("mappings"), none.alias("dropped"), F.struct(F.lit(0.5).alias("off_vocab_rate")).alias("summary"), F.lit(version).alias("vocab_version"),
    )


def _loaded(spark, d, name):
    nobody = spark.createDataFrame([], schema("meta.ingest_patient"))
    return jobs.materialize(mapped_responses(spark, d), nobody, LOADED, enriched_resources(spark, d))[name]


def patched(spark, d) -> PatchedTables:
    """Two batches: everybody, then every third customer anew, with the finished orders only."""
    some = load(spark, d, "region").limit(1)
    store = PatchedTables(spark, f"{tables.written(some, 'store').inputFiles()[0].rsplit('/', 1)[0]}/patched", 32)
    jobs.load_batch(store, mapped_responses(spark, d), LOADED)
    jobs.load_batch(store, mapped_responses(spark, d, "v2", "c_custkey % 3 = 0", "o_orderstatus = 'F'"), LOADED)
    return store


def _patched_tables(spark, d):
    store = patched(spark, d)
    long = lambda t, i, owner, value: store.read(t).select(F.lit(t).alias("what"), F.col(i).cast("long").alias("id"), F.col(owner).cast("string").alias("owner"), F.col(value).cast("string").alias("value"))
    parts = [long("omop.person", "person_id", "person_id", "year_of_birth"), long("omop.care_site", "care_site_id", "care_site_id", "care_site_name"), long("omop.condition_occurrence", "condition_occurrence_id", "person_id", "condition_start_date"), long("meta.mapping", "omop_id", "source_patient_id", "resource_id"), long("meta.ingest_patient", "id_offset", "source_patient_id", "bundle_hash")]
    return reduce(DataFrame.unionByName, parts)


QUERIES = {
    "materialized_mapping": lambda s, d: _loaded(s, d, "meta.mapping").select("source_patient_id", "resource_id", "omop_table", "omop_id", "vocab_version"),
    "materialized_provenance": lambda s, d: _loaded(s, d, "meta.row_provenance").select("source_patient_id", "omop_table", "omop_id", "origin", "resource_id"),
    "materialized_invalid_dates": lambda s, d: _loaded(s, d, "meta.invalid_date"),
    "patched_tables": _patched_tables,
}

#: Blocks by name, local ids by order key.
PLACED = f"""placed AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_name) * {omop.BLOCK} AS id_offset FROM customer),
local AS (SELECT o_orderkey AS k, o_orderdate, o_orderstatus, c_custkey, c_name, id_offset, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + id_offset AS id FROM orders JOIN placed ON o_custkey = c_custkey),
mapped AS (SELECT *, 'c' || k AS r FROM local UNION ALL SELECT *, 'c' || (k + 1) FROM local WHERE k % 3 = 0)"""

ORACLES = {
    "materialized_mapping": f"WITH {PLACED} SELECT c_name AS source_patient_id, r AS resource_id, 'condition_occurrence' AS omop_table, CASE WHEN k % 7 <> 0 THEN id END AS omop_id, 'v1' AS vocab_version FROM mapped",
    # the smallest enriched resource; c{k} is one where 3 divides k and an order has that key
    "materialized_provenance": f"""WITH {PLACED}, told AS (SELECT *, r IN (SELECT 'c' || o_orderkey FROM orders WHERE o_orderkey % 3 = 0) AS e FROM mapped WHERE k % 7 <> 0)
        SELECT c_name AS source_patient_id, 'condition_occurrence' AS omop_table, id AS omop_id, CASE WHEN bool_or(e) THEN 'enriched' ELSE 'structured' END AS origin, coalesce(min(r) FILTER (e), min(r)) AS resource_id FROM told GROUP BY c_name, id""",
    "materialized_invalid_dates": f"WITH {PLACED} SELECT c_name AS source_patient_id, 'condition_occurrence' AS omop_table, id AS omop_id, 'condition_start_date' AS column_name, '2024-13-77' AS original_value FROM local WHERE k % 10 = 0",
    "patched_tables": f"""WITH {PLACED}, again AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY k) + id_offset AS new_id FROM local WHERE c_custkey % 3 = 0 AND o_orderstatus = 'F'),
        now AS (SELECT k, o_orderdate, c_name, id_offset, id FROM local WHERE c_custkey % 3 <> 0 UNION ALL SELECT k, o_orderdate, c_name, id_offset, new_id FROM again)
        SELECT 'omop.person' AS what, id_offset + 1 AS id, CAST(id_offset + 1 AS VARCHAR) AS owner, CAST(1930 + c_custkey % 65 AS VARCHAR) AS value FROM placed
        UNION ALL SELECT 'omop.care_site', id_offset + 1, CAST(id_offset + 1 AS VARCHAR), c_mktsegment FROM placed JOIN customer USING (c_custkey) WHERE c_custkey % 2 = 0
        UNION ALL SELECT 'omop.condition_occurrence', id, CAST(id_offset + 1 AS VARCHAR), CASE WHEN k % 10 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END FROM now
        UNION ALL SELECT 'meta.mapping', CASE WHEN k % 7 <> 0 THEN id END, c_name, 'c' || k FROM now UNION ALL SELECT 'meta.mapping', CASE WHEN k % 7 <> 0 THEN id END, c_name, 'c' || (k + 1) FROM now WHERE k % 3 = 0
        UNION ALL SELECT 'meta.ingest_patient', id_offset, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'v2|' ELSE 'v1|' END || c_custkey FROM placed""",
}
