"""FHIR files that arrive bit by bit: the stream against the batch, numbered bad lines, bundle files."""

import json

from pyspark.sql import functions as F

from cohortloom.plans import jobs
from cohortloom.sources import fhir
from cohortloom.streaming import incremental


def resource(kind, i, *refs, **more):
    return {"resourceType": kind, "id": i, **more, "links": [{"reference": r} for r in refs]}


def lines(*rows):
    return "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n"


def facts(groups, bad):
    told = {name: sorted(map(tuple, groups[name].select(*columns).collect())) for name, columns in (("members", ["patient_id", "key"]), ("orphans", ["key"]), ("ambiguous", ["key"]), ("conflicts", ["key", "digests"]), ("resources", ["key", "digest"]))}
    return told | {"bad": sorted((r["file"].rsplit("/", 1)[1], r["line"], r["body"]) for r in bad.collect()), "links": groups["members"].count()}


def test_arrivals_equal_the_batch(spark, tmp_path):
    """Patients after their resources, references to what comes later, a second owner, a shared helper, broken lines, .json files, a changed text."""
    arrivals = [
        {
            "1.ndjson": lines(resource("Encounter", "e1", "Patient/p1", "Practitioner/s1"), "", "{broken", resource("Observation", "o1", "Encounter/e1"), "[1]"),
            "1.json": json.dumps([resource("Observation", "o2", "Observation/o1"), resource("Practitioner", "s9")]),
        },
        {
            "2.JSONL": lines(resource("Patient", "p1"), resource("Practitioner", "s1", "Organization/g1"), resource("Observation", "o3", "Encounter/e9"), "nothing"),
            "2.json": "{not json",
        },
        {
            "3.ndjson": lines(resource("Patient", "p2"), resource("Encounter", "e9", "Patient/p2"), resource("Observation", "o4", "Encounter/e1", "Encounter/e9"), resource("Organization", "g1"), resource("Patient", "p1")),
            "3.json": json.dumps({"resourceType": "Bundle", "entry": [{"resource": resource("Observation", "o5", "Observation/o4")}, {"resource": resource("Device", "d1", "Patient/p7")}]}),
        },
        {"4.ndjson": lines(*(resource("Observation", "o1", f"Patient/{p}", note=k) for k, p in enumerate(["p2", "p1", "p2", "p2"])), resource("Patient", "p7"))},
    ]
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for files in arrivals:
        for name, text in files.items():
            (source / name).write_text(text)
        incremental.ingest_new_files(spark, str(source), target, str(tmp_path / "c"))
        got = incremental.ingested_groups(spark, target)
        resources, bad = fhir.read_fhir(spark, str(source))
        want = jobs.ingest(resources)
        assert facts(got, got["bad"]) == facts(want, bad)
    assert {(r["file"].rsplit("/", 1)[1], r["line"]) for r in got["bad"].collect()} == {("1.ndjson", 3), ("1.ndjson", 5), ("2.JSONL", 4), ("2.json", None)}
    owners = spark.read.parquet(f"{target}/owners")
    assert owners.groupBy("since", "key", "patient_id").count().where("count > 1").count() == 0
    before = facts(got, got["bad"])
    incremental.extend_ownership(spark, target, 1)  # a batch that is run again
    again = incremental.ingested_groups(spark, target)
    assert facts(again, again["bad"]) == before


def test_line_numbers_across_splits(spark, tmp_path):
    """A file of several splits: a bad line's number counts the lines of the splits before, blank ones too."""
    rows = ["" if k % 17 == 0 else f"bad {k}" if k % 101 == 0 else json.dumps({"resourceType": "Basic", "id": str(k), "pad": "x" * (k % 50)}) for k in range(1, 3001)]
    (tmp_path / "a.ndjson").write_text("\n".join(rows) + "\n")
    (tmp_path / "b.ndjson").write_text("\n".join(rows[:300]))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        held = fhir.line_files(spark.read, str(tmp_path))
        assert held.select("file", "block").distinct().count() > 5
        got = sorted((r["file"][-8:], r["line"], r["body"]) for r in fhir.read_fhir(spark, str(tmp_path))[1].collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    want = [(f, k, r) for f, n in (("a.ndjson", 3000), ("b.ndjson", 300)) for k, r in enumerate(rows[:n], 1) if r.startswith("bad")]
    assert got == sorted(want)


def test_bundle_files(spark, tmp_path):
    rows = [resource("Patient", "p1"), resource("Patient", "p2"), resource("Observation", "o1", "Patient/p1"), resource("Observation", "o2", "Patient/p2")]
    keyed = fhir.with_key(fhir.with_type_and_id(spark.createDataFrame([(json.dumps(r),) for r in rows], "body string")))
    bundles = fhir.patient_bundles(keyed, fhir.group_by_patient(keyed)["members"])
    fhir.write_bundles(bundles, str(tmp_path), b"key")
    assert len(list(tmp_path.glob("patient=*/*.txt"))) == 2 and not list(tmp_path.glob("*p1*"))
    want = sorted(r["bundle"] for r in bundles.collect())
    assert sorted(r["bundle"] for r in fhir.read_bundles(spark, str(tmp_path)).collect()) == want
    fhir.write_bundles(bundles.where("patient_id = 'p1'").withColumn("bundle", F.lit("{}")), str(tmp_path), b"key")
    assert sorted(r["bundle"] for r in fhir.read_bundles(spark, str(tmp_path)).collect()) == sorted(["{}", next(b for b in want if '"p2"' in b)])
