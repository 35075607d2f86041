"""Loading of patients who share local ids, and tables patched in place."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import omop
from cohortloom.plans import jobs
from cohortloom.sources.fhir import with_type_and_id
from cohortloom.sources.patched import PatchedTables

RESPONSE = """source_patient_id string, bundle_hash string, vocab_version string,
  tables struct<person: array<struct<person_id: bigint>>, care_site: array<struct<care_site_id: bigint, care_site_name: string>>, condition_occurrence: array<struct<condition_occurrence_id: bigint, person_id: bigint, condition_start_date: string>>>,
  mappings array<struct<resource_type: string, resource_id: string, omop_table: string, omop_id: bigint, mapping_status: string>>,
  dropped array<struct<resource_type: string, resource_id: string, reason: string>>, summary struct<off_vocab_rate: double>"""
LOADED = ["omop.care_site", "omop.person", "omop.condition_occurrence"]


def response(patient, version, conditions, mappings=(), person=1, sites=()):
    return (patient, version, "v1", ([(person,)], list(sites), [(i, person, day) for i, day in conditions]), list(mappings), [("Basic", "b", "why")], (0.0,))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), RESPONSE)


def two(spark):
    maps = [("Condition", "c1", "condition_occurrence", 1, "MAPPED"), ("Condition", "c2", "condition_occurrence", 1, "MAPPED"), ("Condition", "c3", None, None, "UNMAPPED")]
    return frame(spark, response("ann", "a", [(1, "2024-01-01"), (2, "soon")], maps, sites=[(0, "north")]), response("bob", "b", [(1, "later")], maps[:1], sites=[(0, "south")]))


def nobody(spark):
    return spark.createDataFrame([], "source_patient_id string, bundle_hash string, status string, id_offset long, person_id long")


def test_patients_who_share_local_ids(spark):
    tagged = [{"resourceType": "Condition", "id": "c2", "meta": {"tag": [{"system": "http://x/origin", "code": "enriched"}]}}, {"resourceType": "Condition", "id": "c1"}]
    resources = with_type_and_id(spark.createDataFrame([(json.dumps(r),) for r in tagged], "body string"))
    got = jobs.materialize(two(spark), nobody(spark), LOADED, resources)
    a, b = omop.BLOCK, 2 * omop.BLOCK
    assert sorted((r["source_patient_id"], r["omop_id"]) for r in got["meta.mapping"].collect() if r["omop_id"]) == [("ann", a + 1), ("ann", a + 1), ("bob", b + 1)]
    assert got["meta.mapping"].where("omop_id is null").count() == 1
    assert {(r["source_patient_id"], r["omop_id"], r["origin"], r["resource_id"]) for r in got["meta.row_provenance"].collect()} == {("ann", a + 1, "enriched", "c2"), ("bob", b + 1, "structured", "c1")}
    assert {tuple(r) for r in got["meta.invalid_date"].collect()} == {("ann", "condition_occurrence", a + 2, "condition_start_date", "soon"), ("bob", "condition_occurrence", b + 1, "condition_start_date", "later")}
    assert {r["care_site_id"] for r in got["omop.care_site"].collect()} == {a, b}
    assert {(r["source_patient_id"], r["person_id"]) for r in got["meta.ingest_patient"].collect()} == {("ann", a + 1), ("bob", b + 1)}


@pytest.mark.parametrize(("mapping", "reason"), [(("Condition", "c", "condition_occurrence", omop.BLOCK, "MAPPED"), "mapping id outside the block"), (("Condition", "c", "elsewhere", 1, "MAPPED"), "mapping of an unknown table")])
def test_mappings_that_cannot_be_rekeyed(spark, mapping, reason):
    got = jobs.materialize(frame(spark, response("ann", "a", [], [mapping]), response("bob", "b", [])), nobody(spark), LOADED)
    assert [tuple(r) for r in got["rejects"].collect()] == [("ann", reason)]
    assert {(r["source_patient_id"], r["status"]) for r in got["meta.ingest_patient"].collect()} == {("ann", "failed"), ("bob", "ok")}
    assert got["meta.mapping"].count() == 0


def files(root, table):
    return {p.name for p in Path(root, table).rglob("*.parquet")}


def test_batches_rewrite_their_buckets(spark, tmp_path):
    store = PatchedTables(spark, str(tmp_path), 16)
    people = [f"p{k:02d}" for k in range(24)]
    jobs.load_batch(store, frame(spark, *[response(p, "1", [(1, "2024-01-01"), (2, "x")], [("Condition", p, "condition_occurrence", 2, "MAPPED")], sites=[(3, p)]) for p in people]), LOADED)
    tables = ("omop/person", "omop/care_site", "omop/condition_occurrence", "meta/mapping", "meta/invalid_date", "meta/ingest_patient")
    before = {t: files(tmp_path, t) for t in tables}
    rejects = jobs.load_batch(store, frame(spark, response("p03", "2", [(7, "2025-01-01")], person=9), response("p04", "1", [(8, "2025-01-01")]), response("p05", "2", [(-1, "2025-01-01")])), LOADED)
    assert [r["source_patient_id"] for r in rejects.collect()] == ["p05"]
    for t in tables:  # one bucket of 16, of the ledger two
        touched = [k for k in range(16) if files(tmp_path, f"{t}/bucket={k}") - before[t]]
        assert 1 <= len(touched) <= 2 and len(before[t] & files(tmp_path, t)) >= len(before[t]) - 2, t
    got = {r["condition_occurrence_id"] - omop.BLOCK * k: str(r["condition_start_date"]) for r in store.read("omop.condition_occurrence").collect() if (k := r["condition_occurrence_id"] // omop.BLOCK) == 4}
    assert got == {7: "2025-01-01"}  # p03 has the fourth block
    assert store.read("omop.condition_occurrence").count() == 2 * 23 + 1
    assert sorted(r["person_id"] for r in store.read("omop.person").collect()) == [omop.BLOCK * (k + 1) + (9 if k == 3 else 1) for k in range(24)]
    assert store.read("omop.care_site").count() == 23 and store.read("meta.mapping").where("source_patient_id = 'p03'").count() == 0
    assert store.read("meta.invalid_date").count() == 23
    ledger = {r["source_patient_id"]: (r["bundle_hash"], r["status"], r["id_offset"], r["person_id"]) for r in store.read("meta.ingest_patient").collect()}
    assert ledger["p03"] == ("2", "ok", 4 * omop.BLOCK, 4 * omop.BLOCK + 9)
    assert ledger["p05"] == ("2", "failed", 6 * omop.BLOCK, 6 * omop.BLOCK + 1) and ledger["p04"][0] == "1"


def test_a_batch_that_is_repeated(spark, tmp_path):
    """Replacing twice is replacing once; a bucket whose last patient loses its rows is empty."""
    store = PatchedTables(spark, str(tmp_path), 4)
    assert store.read("omop.person").count() == 0
    jobs.load_batch(store, frame(spark, response("ann", "1", [(1, "2024-01-01")])), LOADED)
    patients = store.read("meta.ingest_patient").select("source_patient_id", "id_offset", "person_id")
    rows = store.read("omop.condition_occurrence")
    again = spark.createDataFrame(rows.collect(), rows.schema)
    for _ in range(2):
        store.replace(patients, {"omop.condition_occurrence": again})
    assert store.read("omop.condition_occurrence").count() == 1
    store.replace(patients, {"omop.condition_occurrence": again.limit(0)})
    assert store.read("omop.condition_occurrence").count() == 0
    with pytest.raises(ValueError):
        PatchedTables(spark, str(tmp_path), 8)


def test_only_touched_buckets_are_read(spark, tmp_path):
    store = PatchedTables(spark, str(tmp_path), 8)
    jobs.load_batch(store, frame(spark, *[response(f"p{k}", "1", []) for k in range(9)]), LOADED)
    plan = store._stored("omop.person").where(F.col("bucket").isin([3]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_latest_response_of_a_patient(spark, tmp_path):
    """Responses are grouped whole only if a patient has several; of those the greatest hash counts, before it is compared with the ledger."""
    once = frame(spark, response("ann", "1", []), response("bob", None, []))
    assert jobs.latest_of_each(once) is once
    several = frame(spark, response("ann", "1", [(1, "2024-01-01")]), response("ann", "2", [(2, "2024-01-02")]), response("bob", None, []))
    assert {(r["source_patient_id"], r["bundle_hash"]) for r in jobs.latest_of_each(several).collect()} == {("ann", "2"), ("bob", None)}
    store = PatchedTables(spark, str(tmp_path), 4)
    jobs.load_batch(store, several, LOADED)
    assert [r["condition_occurrence_id"] - omop.BLOCK for r in store.read("omop.condition_occurrence").collect()] == [2]
    before = files(tmp_path, "omop/person"), files(tmp_path, "meta/ingest_patient")
    jobs.load_batch(store, several.where("source_patient_id = 'ann'"), LOADED)
    assert (files(tmp_path, "omop/person"), files(tmp_path, "meta/ingest_patient")) == before
