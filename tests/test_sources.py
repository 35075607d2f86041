"""FHIR reading, ownership, streaming, exports and policies."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from cohortloom import schemas
from cohortloom.functions.columns import keyed_value, normalize_domain, shift_days
from cohortloom.operators import deid, omop
from cohortloom.sources import fhir, tables
from cohortloom.streaming import incremental


def resource_files(folder):
    """Two families of resources and strays: a procedure two references away from its patient, a device that both patients use, one resource of two patients."""
    folder.mkdir(parents=True, exist_ok=True)
    ref = lambda to: {"reference": to}
    lines = [
        {"resourceType": "Patient", "id": "anna"}, {"resourceType": "Patient", "id": "bo"},
        {"resourceType": "Encounter", "id": "visit-7", "subject": ref("http://server/fhir/Patient/anna/_history/3")},
        {"resourceType": "Procedure", "id": "scan", "encounter": ref("Encounter/visit-7"), "focalDevice": [{"manipulated": ref("Device/scanner")}]},
        {"resourceType": "Immunization", "id": "shot", "patient": ref("Patient/bo"), "performer": [{"actor": ref("Device/scanner")}]},
    ]
    (folder / "first.NDJSON").write_text("\n".join(map(json.dumps, lines)) + "\n\n{broken\n")
    rest = [{"resourceType": "Device", "id": "scanner"}, {"resourceType": "Location", "id": "attic"}, {"resourceType": "Group", "id": "pair", "member": [{"entity": ref("Patient/anna")}, {"entity": ref("Patient/bo")}]}]
    (folder / "second.json").write_text(json.dumps({"resourceType": "Bundle", "entry": [{"resource": x} for x in rest]}))


def test_read_and_group(spark, tmp_path):
    resource_files(tmp_path / "in")
    resources, bad = fhir.read_fhir(spark, str(tmp_path / "in"))
    assert resources.count() == 8 and [r["body"] for r in bad.collect()] == ["{broken"]
    keyed = fhir.with_key(resources)
    got = fhir.group_by_patient(keyed)
    members = {}
    for r in got["members"].collect():
        members.setdefault(r["patient_id"], set()).add(r["key"])
    assert members == {"anna": {"Patient/anna", "Encounter/visit-7", "Procedure/scan", "Device/scanner"}, "bo": {"Patient/bo", "Immunization/shot", "Device/scanner"}}
    assert [r["key"] for r in got["ambiguous"].collect()] == ["Group/pair"]
    assert sorted(r["key"] for r in got["orphans"].collect()) == ["Group/pair", "Location/attic"]
    bundle = json.loads(fhir.patient_bundles(keyed, got["members"]).where("patient_id = 'anna'").first()["bundle"])
    assert bundle["entry"][0]["resource"]["resourceType"] == "Patient" and len(bundle["entry"]) == 4


def test_conflicts(spark):
    rows = spark.createDataFrame([('{"resourceType":"Patient","id":"a","x":1}',), ('{"id":"a","resourceType":"Patient","x":1}',), ('{"resourceType":"Patient","id":"a","x":2}',)], "body string")
    unique, conflicts = fhir.dedupe(fhir.with_key(fhir.with_type_and_id(rows)))
    assert unique.count() == 1 and conflicts.first()["digests"] == 2
    assert fhir.with_key(rows.limit(1).select(F.lit(None).cast("string").alias("resource_type"), F.lit(None).cast("string").alias("id"), "body")).first()["key"].startswith("sha256:")


def test_streaming_equals_batch(spark, tmp_path):
    source, target = tmp_path / "s", tmp_path / "t"
    source.mkdir()
    (source / "1.ndjson").write_text('{"resourceType":"Patient","id":"p1"}\n')
    incremental.ingest_new_files(spark, str(source), str(target), str(tmp_path / "c"))
    (source / "2.ndjson").write_text('{"resourceType":"Patient","id":"p2"}\n{"resourceType":"Patient","id":"p1"}\n')
    incremental.ingest_new_files(spark, str(source), str(target), str(tmp_path / "c"))
    assert sorted(r["key"] for r in incremental.ingested(spark, str(target)).collect()) == ["Patient/p1", "Patient/p2"]


def test_hmac_and_shift(spark):
    row = spark.range(5, 6).select(keyed_value(F.col("id"), b"k", "ns", "tok_").alias("v"), shift_days(F.col("id"), b"salt", 180).alias("s")).first()
    assert row["v"] == "tok_" + hmac.new(b"k", b"ns\0" + b"5", hashlib.sha256).hexdigest()
    assert row["s"] == int.from_bytes(hmac.new(b"salt", b"5", hashlib.sha256).digest(), "big") % 361 - 180


def test_policy_leaves_no_canary(spark, tmp_path):
    shared = {}
    for table, fields in schemas.REGISTRY.items():
        kinds = {"long": 7, "int": 7, "double": 7.0, "string": "CANARY", "boolean": True}
        cols = [F.lit(kinds.get(f.type)).cast(schemas.SPARK_TYPES[f.type]).alias(f.name) if f.type in kinds else F.lit("2024-01-01").cast(schemas.SPARK_TYPES[f.type]).alias(f.name) for f in fields]
        shared[table] = deid.apply_policy(spark.range(1).select(*cols), table, b"key")
    assert deid.audit_policy(shared).count() == 0
    assert deid.policy_difference(spark, shared).count() == 0
    for table, df in shared.items():
        for row in df.collect():
            for f in schemas.REGISTRY[table]:
                if f.action != "keep":
                    assert row[f.name] != "CANARY"
    deid.export_parquet(shared, str(tmp_path / "out"))
    assert tables.payload_inventory(spark, str(tmp_path / "out")).count() > 22
    with pytest.raises(ValueError):
        deid.apply_policy(spark.range(1), "omop.person", b"key")


def test_interval_survives_shift(spark):
    df = spark.createDataFrame([(1, "2024-01-01", "2024-01-11")], "person_id long, a string, b string").select("person_id", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    r = deid.date_shift(df, ["a", "b"], b"salt").first()
    assert (r["b"] - r["a"]).days == 10


def test_rekey_refuses_foreign_ids(spark):
    rows = spark.createDataFrame([(1_000_000, 1, 5_000_000)], "condition_occurrence_id long, person_id long, id_offset long")
    with pytest.raises(Exception, match="leaves its block"):
        omop.rekey(rows, "omop.condition_occurrence").collect()


def test_load_frame(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert tables.load_frame(spark, query="select * from three").count() == 3
    for bad in ({"query": "select 1; drop table x"}, {"query": "delete from x"}, {"table": "a b"}, {}, {"table": "three", "query": "select 1"}):
        with pytest.raises(ValueError):
            tables.load_frame(spark, **bad)


def test_domains(spark):
    assert spark.range(1).select(normalize_domain(F.lit(" Drug_Exposure ")).alias("d")).first()["d"] == "drug"
    with pytest.raises(Exception, match="unknown domain"):
        spark.range(1).select(normalize_domain(F.lit("x"))).collect()


def test_table_hash_is_the_query_result(spark, data):
    """The fingerprint against brute force, and that contents (not order or partitions) decide it."""
    import hashlib

    from cohortloom import registry
    from cohortloom.testbed import load

    df = load(spark, data, "orders")
    got = registry.QUERIES["table_hash"](spark, data).collect()
    hashes = [hashlib.sha256(t.encode()).hexdigest() for t in df.select(*sorted(df.columns)).toJSON().collect()]
    sums = [sum(int(h[15 * k : 15 * k + 15], 16) for h in hashes) for k in range(4)]
    want = hashlib.sha256(",".join(map(str, [len(hashes), *sums])).encode()).hexdigest()
    assert [tuple(r) for r in got] == [(len(hashes), want)]
    assert tables.table_hash(df.repartition(3, "o_custkey")).collect() == got
    assert tables.table_hash(df.withColumn("o_orderkey", F.col("o_orderkey") + (F.col("o_orderkey") == 1).cast("int"))).collect() != got


def test_whole_queries_read_all_orders(spark, data):
    from cohortloom import registry
    from cohortloom.testbed import load

    n = load(spark, data, "orders").count()
    keys = {r["resource_type"]: r["count"] for r in registry.QUERIES["fhir_keys"](spark, data).groupBy("resource_type").count().collect()}
    assert keys["Encounter"] == keys["Observation"] == n
    assert registry.QUERIES["shareable_ledger"](spark, data).count() == load(spark, data, "orders").where("o_orderpriority in ('1-URGENT', '2-HIGH')").count()


RESPONSE = """source_patient_id string, bundle_hash string, vocab_version string, summary struct<off_vocab_rate double>, dropped array<struct<resource_id string, reason string>>,
    mappings array<struct<resource_type string, resource_id string, omop_table string, omop_id long, mapping_status string>>,
    tables struct<person array<struct<person_id bigint, year_of_birth int>>, condition_occurrence array<struct<condition_occurrence_id bigint, person_id bigint, condition_start_date string>>>"""
TABLES = ["omop.person", "omop.condition_occurrence"]


def response(patient, version, conditions, people=1):
    rows = [{"condition_occurrence_id": k, "person_id": 1, "condition_start_date": day} for k, day in conditions]
    return {"source_patient_id": patient, "bundle_hash": version, "vocab_version": "v1", "summary": {"off_vocab_rate": 0.1}, "dropped": [{"resource_id": "z", "reason": "no code"}], "mappings": [], "tables": {"person": [{"person_id": 1, "year_of_birth": 1980}] * people, "condition_occurrence": rows}}


def test_streamed_materialisation(spark, tmp_path):
    """New patients get the next blocks, changed ones are replaced, unchanged ones skipped, failed ones tried again; a repeated batch changes nothing."""
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    take = lambda: incremental.materialize_new_responses(spark, str(source), str(target), str(tmp_path / "c"), RESPONSE, TABLES)
    put = lambda name, *rows: (source / name).write_text("\n".join(map(json.dumps, rows)) + "\n")
    put("1.json", response("ann", "a1", [(1, "2024-01-01"), (2, "not-a-date")]), response("bob", "b1", [(1, "2024-02-01")], people=2), response("cyd", "c1", [(2_000_000, "2024-03-01")]))
    take()
    ledger = lambda: {r["source_patient_id"]: (r["bundle_hash"], r["status"], r["id_offset"]) for r in incremental.patient_ledger(spark, str(target)).collect()}
    rows = lambda: sorted((r["condition_occurrence_id"], str(r["condition_start_date"])) for r in incremental.materialized(spark, str(target), "omop.condition_occurrence").collect())
    assert ledger() == {"ann": ("a1", "ok", omop.BLOCK), "bob": ("b1", "failed", None), "cyd": ("c1", "failed", None)}
    assert rows() == [(omop.BLOCK + 1, "2024-01-01"), (omop.BLOCK + 2, "None")]
    assert sorted(r["reason"] for r in spark.read.parquet(f"{target}/rejects").collect()) == ["id outside the block", "not exactly one person"]
    put("2.json", response("ann", "a2", [(5, "2024-05-01")]), response("bob", "b1", [(1, "2024-02-01")]), response("dan", "d1", [(1, "2024-06-01")]))
    take()
    take()
    assert ledger() == {"ann": ("a2", "ok", omop.BLOCK), "bob": ("b1", "ok", 2 * omop.BLOCK), "cyd": ("c1", "failed", None), "dan": ("d1", "ok", 3 * omop.BLOCK)}
    want = [(omop.BLOCK + 5, "2024-05-01"), (2 * omop.BLOCK + 1, "2024-02-01"), (3 * omop.BLOCK + 1, "2024-06-01")]
    assert rows() == want
    put("3.json", response("ann", "a2", [(5, "2024-05-01")]))
    take()
    assert rows() == want and ledger()["ann"] == ("a2", "ok", omop.BLOCK)


def test_responses_and_tables(spark, tmp_path):
    for folder, version in (("raw", "r"), ("enriched", "e")):
        (tmp_path / folder).mkdir()
        for patient in ("ann", "bob") if folder == "raw" else ("bob",):
            (tmp_path / folder / f"{patient}.json").write_text(json.dumps(response(patient, version, [(1, "2024-01-01")]), indent=1))
    got = omop.read_responses(spark, RESPONSE, str(tmp_path / "raw"), str(tmp_path / "enriched"))
    assert {r["source_patient_id"]: r["bundle_hash"] for r in got.collect()} == {"ann": "r", "bob": "e"}
    side = omop.sidecars(got)
    assert {(r["source_patient_id"], r["vocab_version"]) for r in side["dropped"].collect()} == {("ann", "v1"), ("bob", "v1")}
    rows = spark.createDataFrame([("c", 1, "2024-01-01", True, None)], "cohort_name string, person_id int, index_date string, included boolean, exclusion_reason string")
    rows.write.parquet(str(tmp_path / "db/study/cohort"))
    read = tables.read_tables(spark, str(tmp_path / "db"), ["study.cohort"])["study.cohort"]
    assert dict(read.dtypes)["person_id"] == "bigint" and dict(read.dtypes)["index_date"] == "date" and spark.table("study_cohort").count() == 1
    rows.drop("included").write.parquet(str(tmp_path / "db/study/attrition"))
    with pytest.raises(ValueError):
        tables.read_tables(spark, str(tmp_path / "db"), ["study.attrition"])


def test_provenance_spellings(spark):
    tags = [[], [{"system": "http://x/origin", "code": "Enriched"}], [{"system": "s", "code": "doc_ref_id:D1"}, {"system": "http://x/source-pages", "code": "[1,2]"}], [{"system": "my-provenance", "code": "generated"}], [{"system": "http://x/document-hash", "code": "h1"}], [{"system": "s", "code": "enriched"}]]
    rows = [(json.dumps({"resourceType": "Condition", "id": f"c{k}", "meta": {"tag": t}}),) for k, t in enumerate(tags)]
    got = {r["resource_id"]: r for r in omop.resource_provenance(fhir.with_type_and_id(spark.createDataFrame(rows, "body string"))).collect()}
    assert [got[f"c{k}"]["origin"] for k in range(6)] == ["structured", "enriched", "enriched", "enriched", "enriched", "structured"]
    assert (got["c2"]["doc_ref_id"], got["c2"]["source_pages"], got["c4"]["document_hash"]) == ("D1", "[1,2]", "h1")


def test_numeric_and_groups(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "x"), ("a", "inf"), (None, None)], "g string, v string")
    got = tables.numeric_problems(rows, ["v"]).first()
    assert (got["rows"], got["missing"], got["non_numeric"], got["infinite"]) == (4, 1, 1, 1)
    with pytest.raises(ValueError):
        tables.validated_numeric(rows, "v")
    assert tables.validated_numeric(rows.limit(1), "v").first()["v"] == 1.0
    assert tables.two_groups(rows, "g") == ("a", "b") and tables.two_groups(rows, "g", "b") == ("b", "a")
    with pytest.raises(ValueError):
        tables.two_groups(rows.where("g = 'a'"), "g")


def test_results_of_one_run(spark, tmp_path):
    rows = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "k int, v double")
    tables.write_result({"old": rows, "data": rows}, str(tmp_path), {"kind": "x"})
    tables.write_result({"data": rows}, str(tmp_path), {"kind": "y"})
    got, envelope = tables.read_result(spark, str(tmp_path))
    assert set(got) == {"data"} and envelope["kind"] == "y" and sorted(map(tuple, got["data"].collect())) == [(1, None), (2, 3.0)]


def test_texts_are_parsed_once(spark):
    """Owners, members and orphans come from one reading of the texts, over chains of helpers and of owners and over patients that name others."""
    bodies = {
        "Patient/a": [], "Patient/b": ["Patient/a"], "Encounter/1": ["Patient/a", "Practitioner/p"], "Observation/1": ["Encounter/1"], "Observation/2": ["Observation/1"],
        "Encounter/2": ["Patient/b"], "Practitioner/p": ["Organization/o"], "Organization/o": ["Location/l"], "Location/l": [], "Organization/x": ["Location/y"], "Location/y": [], "Encounter/3": ["Patient/none"],
    }
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(*k.split("/"), k, '{"r":[' + ",".join(f'{{"reference":"{r}"}}' for r in refs) + "]}") for k, refs in bodies.items()]
    keyed = spark.createDataFrame(rows, "resource_type string, id string, key string, body string").mapInArrow(counted, "resource_type string, id string, key string, body string")
    got = fhir.group_by_patient(keyed)
    pairs = sorted(tuple(r) for r in got["members"].select("patient_id", "key").collect())
    helpers = ["Location/l", "Organization/o", "Practitioner/p"]
    assert pairs == sorted([("a", k) for k in ["Patient/a", "Encounter/1", "Observation/1", "Observation/2", *helpers]])
    assert sorted(r[0] for r in got["ambiguous"].collect()) == ["Encounter/2", "Patient/b"]
    assert sorted(r[0] for r in got["orphans"].collect()) == ["Encounter/2", "Encounter/3", "Location/y", "Organization/x"]
    assert read.value == len(rows)
