"""Scope of analyses, refused exports, shared calls, chains over partitions, digests of directories, E-values of continuous outcomes."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import guardrails, ledger
from cohortloom.operators.cohorts import Cohort, Criterion
from cohortloom.plans import jobs

MAPPING = "source_system string, source_code string, omop_table string, mapping_status string"


def test_unchecked_of_code_sets_or_tables(spark):
    mapping = spark.createDataFrame([("s", "a", "drug_exposure", "UNCHECKED"), ("s", "b", "measurement", "MAPPED"), ("s", "c", "observation", "UNCHECKED"), (None, None, "measurement", "MAPPED")], MAPPING)
    sets = spark.createDataFrame([("x", "s", "a", True), ("x", "s", "c", False)], "code_set_name string, source_system string, source_code string, accepted boolean")
    assert tuple(guardrails.unchecked_fraction(mapping, sets.where("accepted"), ["measurement"]).first()) == (3, pytest.approx(1 / 3))
    assert tuple(guardrails.unchecked_fraction(mapping, sets.where("accepted")).first()) == (1, 1.0)
    analyses = [jobs.Analysis("one", "cohort_compare", ("arm",), (("x", 1, 2, 0),)), jobs.Analysis("two", "patient_signature", domains=("measurement", "drug"), code_sets=("x",)), jobs.Analysis("none", "patient_signature")]
    scope = jobs.analysis_scope(spark, analyses, [Cohort("arm", index_set="x", exclusion=(Criterion("y"),)), Cohort("other", index_set="z")])
    assert {r["code_set_name"] for r in scope.where("analysis_id = 'one'").collect()} == {"x", "y", None}
    got = {r["analysis_id"]: (r["rows"], r["unchecked_fraction"]) for r in guardrails.unchecked_by_analysis(mapping, sets, scope).collect()}
    assert got == {"one": (1, 1.0), "two": (3, pytest.approx(1 / 3)), "none": (0, 0.0)}


ENTRIES = "seq long, step string, status string, params map<string,string>, inputs map<string,string>, outputs map<string,string>, items array<struct<status: string>>, api_calls array<struct<endpoint: string, count: long, ms: double, credits: double>>"


def entry(seq, outputs, inputs=None, calls=()):
    return (seq, "s", "ok", {"seed": "1"}, inputs or {}, outputs, [("ok",)], list(calls))


def test_refused_export_writes_nothing(spark, tmp_path):
    entries = spark.createDataFrame([entry(1, {"r": "1"}, {"i": "9"}, [("map", 1, 2.0, None), ("patients/7", 5, 1.0, 1.0), ("map", 2, 0.5, 3.0)])], ENTRIES)
    shared = {"study.person_demographic": spark.createDataFrame([(1, "0-4", 0, 4, False, None)], "person_id long, age_bucket string, age_bucket_start int, age_bucket_end int, age_capped boolean, reference_date date")}
    allowed = spark.createDataFrame([("s", "seed")], "step string, param string")
    wrong = spark.createDataFrame([("r", "2", "i", "9")], "path string, sha256 string, input_path string, input_sha256 string")
    got = jobs.export(shared, entries, allowed, str(tmp_path / "out"), wrong)
    assert [tuple(r) for r in got["problems"].collect()] == [("r", "no_producer")] and not (tmp_path / "out").exists()
    right = wrong.withColumn("sha256", F.lit("1"))
    got = jobs.export(shared, entries, allowed, str(tmp_path / "out"), right, ("map",))
    assert list((tmp_path / "out").rglob("*.parquet")) and got["problems"].count() == 0
    assert [tuple(c) for c in got["ledger"].first()["calls"]] == [("map", 3, 2.5, 3.0)]
    assert ledger.shareable(entries, allowed).first()["calls"] == []


def chain(n):
    """A chain made by walking it: (seq, step, prev_hash, entry_hash)."""
    rows, before = [], "0" * 64
    for k in range(n):
        body = hashlib.sha256(json.dumps({"seq": k, "step": f"s{k % 3}"}, separators=(",", ":")).encode()).hexdigest()
        entry_hash = hashlib.sha256((before + body).encode()).hexdigest()
        rows.append((k, f"s{k % 3}", before, entry_hash))
        before = entry_hash
    return rows


def test_chain_over_partitions(spark):
    rows = chain(200)
    frame = lambda x: spark.createDataFrame(x, "seq long, step string, prev_hash string, entry_hash string").repartition(5)
    assert ledger.chain_problems(frame(rows), ["seq", "step"]).count() == 0
    bent = list(rows)
    bent[50] = (50, "other", *bent[50][2:])
    bent[120] = (120, bent[120][1], None, None)
    del bent[77]
    got = {r["seq"]: r["problem"] for r in ledger.chain_problems(frame(bent), ["seq", "step"]).collect()}
    assert got == {50: "altered", 78: "broken_link", 120: "altered", 121: "broken_link"}
    plan = ledger.chain_problems(frame(rows), ["seq", "step"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") >= 2 and "lag(entry_hash" in plan


def test_digests_of_directories(spark):
    files = {"a/x": "1", "a/b/y": "2", "a/b/z": "3", "top": "4", "c/x": "5"}
    got = {r["path"]: r["sha256"] for r in ledger.directory_digests(spark.createDataFrame(list(files.items()), "path string, sha256 string")).collect()}
    digest = lambda names: hashlib.sha256("".join(f"{n}\0{h}\n" for n, h in names).encode()).hexdigest()
    assert got == {"a": digest([("b/y", "2"), ("b/z", "3"), ("x", "1")]), "a/b": digest([("y", "2"), ("z", "3")]), "c": digest([("x", "5")])}
    entries = spark.createDataFrame([entry(1, {"a": got["a"], "c": "old"}), entry(2, {"top": "9"}, {"c": got["c"]}), entry(3, {"top": "4"}, {"top": "9", "gone": "1"})], ENTRIES)
    latest = ledger.latest_artifacts(entries)
    assert {r["path"]: (r["sha256"], r["seq"], r["side"]) for r in latest.collect()} == {"a": (got["a"], 1, "output"), "c": (got["c"], 2, "input"), "top": ("4", 3, "output"), "gone": ("1", 3, "input")}
    inventory = lambda more: spark.createDataFrame(list((files | more).items()), "path string, sha256 string")
    assert [tuple(r) for r in ledger.artifact_audit(latest, inventory({})).collect()] == [("gone", "missing")]
    assert {tuple(r) for r in ledger.artifact_audit(latest, inventory({"a/b/new": "7"})).collect()} == {("gone", "missing"), ("a", "changed")}


def test_large_directories_are_hashed_in_order_and_travel_only_if_wanted(spark):
    rows = [(f"top/d{k % 30}/f{k}", str(k)) for k in range(25_000)]
    files = spark.createDataFrame(rows, "path string, sha256 string").repartition(7)
    text = lambda folder: "".join(f"{p}\0{h}\n" for p, h in sorted((p[len(folder) + 1 :], h) for p, h in rows if p.startswith(folder + "/")))
    digest = lambda folder: hashlib.sha256(text(folder).encode()).hexdigest()
    whole = {r["path"]: r["sha256"] for r in ledger.directory_digests(files).collect()}
    assert whole == {f: digest(f) for f in ["top", *(f"top/d{k}" for k in range(30))]}
    some = spark.createDataFrame([("top/d3",), ("top/d3",), ("else",)], "path string")
    assert {r["path"]: r["sha256"] for r in ledger.directory_digests(files, some, 2000).collect()} == {"top/d3": digest("top/d3")}
    assert [r["path"] for r in ledger.directory_digests(files, spark.createDataFrame([("top",)], "path string"), 2000).collect()] == ["top"]
    declared = spark.createDataFrame([("top/d4", digest("top/d4")), ("top/d5", "old")], "path string, sha256 string")
    audit = ledger.artifact_audit(declared, files)
    assert [tuple(r) for r in audit.collect()] == [("top/d5", "changed")]
    plan = audit._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "strategy=broadcast" in plan


def test_e_value_of_a_mean_difference(spark):
    rng = np.random.default_rng(3)
    x, t = rng.normal(size=300), rng.random(300) < 0.5
    y = 5 + 0.8 * t + 0.3 * x + rng.normal(size=300)
    rows = [(int(i), "a" if t[i] else "b", float(x[i]), float(y[i])) for i in range(300)]
    got = jobs.causal_effect(spark.createDataFrame(rows, "person_id long, cohort_name string, x double, y double"), "y", "a", ["x"], replicates=20)["data"].first()
    ratio = math.exp(0.91 * abs(got["difference"]) / np.std(y, ddof=1))
    assert got["e_value"] == pytest.approx(ratio + math.sqrt(ratio * (ratio - 1)))
    assert got["e_value_limit"] is None and got["e_value_basis"] == "standardized_mean_difference"
