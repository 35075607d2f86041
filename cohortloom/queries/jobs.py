"""Queries of the study-level jobs and of plot data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import stats
from cohortloom.operators import causal, compare, deid, eras, features, guardrails, ledger, omop, survival, trajectory, windows
from cohortloom.plans import jobs
from cohortloom.queries.analyses import CATEGORICAL, CATS, ERAS, LINES, OUTCOMES, SURVIVED, TABS, _continuous_sql, _two_by_two_sql, outcomes, survived
from cohortloom.queries.cohorts import FRAME, PLAN, RESOLVED, events_of, frame, matched, resolved, with_ctes
from cohortloom.queries.records import BALANCE, WEIGHTED, _weighted, entries, measured, resources
from cohortloom.sources import fhir, tables
from cohortloom.testbed import ctes, load

ARMS = ("arm_a", "arm_b")


def _ingest_report(spark, d):
    """All rows of the ingest job over the FHIR testbed: (what, key, patient_id)."""
    got = jobs.ingest(resources(spark, d))
    none = F.lit(None).cast("string")
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("what"), "key", (F.col("patient_id") if "patient_id" in df.columns else none).alias("patient_id")) for k, df in sorted(got.items())])


def conditions_fhir(spark, d):
    o = load(spark, d, "orders")
    body = F.concat(
        F.lit('{"resourceType":"Condition","id":"c'), "o_orderkey", F.lit('","subject":{"reference":"Patient/p'), "o_custkey", F.lit('"},"onsetDateTime":"'), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit('","code":{"coding":[{"system":"status","code":"'), "o_orderstatus", F.lit('"}]}}'),
    )
    return fhir.with_type_and_id(o.select(body.alias("body")))


def _flatten(spark, d):
    concepts = spark.createDataFrame([("status", "F", 101, "MAPPED"), ("status", "O", 102, "ALREADY_STANDARD")], "source_system string, source_code string, concept_id long, mapping_status string")
    return jobs.flatten_fhir(conditions_fhir(spark, d), concepts).select("resource_id", "omop_table", "source_patient_id", "start", "concept_id", "mapping_status", "source_value")


def responses(spark, d):
    """One mapping response per customer with a person and its conditions."""
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    local = F.struct((F.col("o_orderkey") % 1000000).alias("condition_occurrence_id"), F.lit(1).cast("long").alias("person_id"), F.lit(0).cast("long").alias("condition_concept_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("condition_start_date"))
    conditions = o.groupBy("o_custkey").agg(F.collect_list(local).alias("condition_occurrence"))
    person = F.array(F.struct(F.lit(1).cast("long").alias("person_id"), F.lit(0).cast("long").alias("gender_concept_id"), (F.lit(1930) + F.col("c_custkey") % 65).cast("int").alias("year_of_birth")))
    empty = F.array().cast("array<struct<resource_id string, reason string>>")
    maps = F.array(F.struct(F.lit("Condition").alias("resource_type"), F.lit("MAPPED").alias("mapping_status")))
    joined = c.join(conditions, c["c_custkey"] == conditions["o_custkey"], "left")
    return joined.select(
        F.col("c_name").alias("source_patient_id"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("bundle_hash"),
        F.struct(F.when(F.col("c_custkey") % 10 == 9, F.array_repeat(person[0], 2)).otherwise(person).alias("person"), F.coalesce("condition_occurrence", F.array().cast("array<struct<condition_occurrence_id:bigint,person_id:bigint,condition_concept_id:bigint,condition_start_date:string>>")).alias("condition_occurrence")).alias("tables"),
        maps.alias("mappings"), empty.alias("dropped"), F.struct(F.lit(0.0).alias("off_vocab_rate")).alias("summary"), F.lit("v1").alias("vocab_version"),
    )


def ledger_rows(spark, d):
    c = load(spark, d, "customer").where("c_custkey % 4 = 0")
    return c.select(F.col("c_name").alias("source_patient_id"), ((F.col("c_custkey") + 1) * omop.BLOCK).alias("id_offset"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("bundle_hash"), F.when(F.col("c_custkey") % 8 == 0, "ok").otherwise("failed").alias("status"))


def _materialized(spark, d, name):
    return jobs.materialize(responses(spark, d), ledger_rows(spark, d), ["omop.person", "omop.condition_occurrence"])[name]


def clinical_fhir(spark, d):
    """Line items as medication requests, procedures, observations (half of them with a quantity) and encounters."""
    li = load(spark, d, "lineitem")
    kind, day = F.col("l_linenumber") % 4, F.date_format("l_shipdate", "yyyy-MM-dd")
    coding = lambda system: F.concat(F.lit('{"coding":[{"system":"' + system + '","code":"'), "l_returnflag", F.lit('"}]}'))
    quantity = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit(',"valueQuantity":{"value":'), "l_quantity", F.lit(',"unit":"mg"}'))).otherwise("")
    rest = (
        F.when(kind == 0, F.concat(F.lit('"MedicationRequest","authoredOn":"'), day, F.lit('","medicationCodeableConcept":'), coding("rx")))
        .when(kind == 1, F.concat(F.lit('"Procedure","performedDateTime":"'), day, F.lit('","code":'), coding("px")))
        .when(kind == 2, F.concat(F.lit('"Observation","effectiveDateTime":"'), day, F.lit('","code":'), coding("ob"), quantity))
        .otherwise(F.concat(F.lit('"Encounter","period":{"start":"'), day, F.lit('"},"type":['), coding("vt"), F.lit("]")))
    )
    letter = F.element_at(F.array(*map(F.lit, "mpov")), kind.cast("int") + 1)
    body = F.concat(F.lit('{"id":"'), letter, "l_orderkey", F.lit("-"), "l_linenumber", F.lit('","subject":{"reference":"Patient/p1"},"resourceType":'), rest, F.lit("}"))
    return fhir.with_type_and_id(li.select(body.alias("body")))


def _flatten_types(spark, d):
    none = spark.createDataFrame([], "source_system string, source_code string, concept_id long, mapping_status string")
    return jobs.flatten_fhir(clinical_fhir(spark, d), none).select("resource_id", "omop_table", "start", "source_value", "value")


def _enriched(spark, d):
    """Documents as attachments, of each distinct one a resource extracted: who gets it."""
    from cohortloom.queries.records import documents_fhir

    docs = documents_fhir(spark, d)
    hashed = load(spark, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("document_hash")).distinct()
    extracted = hashed.select("document_hash", F.lit("Condition").alias("resource_type"), F.lit("c1").alias("id"), F.lit("{}").alias("body"), F.lit("1").alias("pages"))
    return jobs.enrich(docs, extracted)["resources"].select("id", "doc_ref_id", "document_hash")


def _table_one_job(spark, d):
    got = jobs.table_one(outcomes(spark, d).withColumnRenamed("race_source_value", "race").withColumn("outcome", F.col("any_o")), ["balance", "year_of_birth"], ["race", "outcome"], threshold=12)
    return got["continuous"].select("variable", "group", "statistic", F.lit(None).cast("string").alias("level"), "value").unionByName(
        got["categorical"].select("variable", "group", F.lit("count").alias("statistic"), "level", F.col("value").cast("double").alias("value"))
    )


def _cohort_compare(spark, d):
    return jobs.cohort_compare(outcomes(spark, d), ["any_o", "any_urgent", "year_of_birth"], *ARMS, adjustment=["race_source_value", "year_of_birth"])


def _survival_job(spark, d):
    got = jobs.survival_analysis(frame(spark, d), events_of(spark, d, "status-o"), *ARMS, 1000.0, 1500, events_of(spark, d, "status-p"), ["race_source_value", "year_of_birth"])
    rows = [got["rmst"].select(F.concat(F.lit("rmst|"), "group").alias("what"), F.col("rmst").alias("value")), got["rmst_difference"].select(F.lit("rmst_difference").alias("what"), F.col("estimate").alias("value")), got["log_rank"].select(F.lit("log_rank").alias("what"), F.col("statistic").alias("value"))]
    return reduce(DataFrame.unionByName, [*rows, got["summary"].select(F.concat(F.lit("median|"), "group").alias("what"), F.col("median").alias("value"))])


def _survival_models(spark, d):
    data = survived(spark, d).withColumn("exposed", (F.col("cohort_name") == "arm_a").cast("int")).join(load(spark, d, "person").select("person_id", F.col("race_source_value").alias("race")), "person_id")
    low, high = survival.rmst_difference_limits(data, *ARMS, 1000.0)
    rows = [tuple(r.values()) for r in survival.cox(data, ["exposed", "race"])] + [("rmst_difference", None, low, high, None, None, None)]
    return spark.createDataFrame(rows, "term string, estimate double, lower double, upper double, p_value double, ph_statistic double, ph_p_value double")


def _incidence_job(spark, d):
    return jobs.incidence_rate(frame(spark, d).where("observation_end > index_date"), events_of(spark, d, "urgent"), *ARMS)["data"]


CONVERSIONS = [("mg/dL", "mg/dL", 1.0, 0.0), ("g/L", "mg/dL", 100.0, 0.0)]


def _trajectory_job(spark, d):
    fr, m = measured(spark, d)
    conversions = spark.createDataFrame(CONVERSIONS, "unit string, target string, multiplier double, offset double")
    return jobs.trajectory_means(jobs.trajectory_analysis(fr, m, conversions)["data"]).select("group", "time", "value")


def _mixed_model(spark, d):
    """Order values of both arms over the days from the index date."""
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderdate").cast("date").alias("event_date"), F.col("o_totalprice").alias("value"))
    rows = trajectory.random_intercept(trajectory.relative_times(frame(spark, d), o), exposed="arm_a")
    return spark.createDataFrame([tuple(r.values()) for r in rows], "term string, estimate double, lower double, upper double, p_value double")


def _matched_effect(spark, d):
    return jobs.causal_effect(outcomes(spark, d), "any_urgent", "arm_a", ["balance", "race_source_value"], method="ps_matching")["data"]


ANALYSES = [
    jobs.Analysis("compare", "cohort_compare", ARMS, (("status-o", 1, 730, 30), ("urgent", 1, 365, 0)), ("year_of_birth", "race_source_value")),
    jobs.Analysis("effect", "causal_effect", ARMS, (("urgent", 1, 365, 0),), ("year_of_birth",)),
    jobs.Analysis("signature", "patient_signature"),
]


def _data_summary(spark, d):
    got = jobs.data_summary(frame(spark, d), matched(spark, d, "status-o", "urgent"), ANALYSES)
    of = lambda m, k: F.element_at(m, F.lit(k))
    return got.select("analysis_id", "kind", "total_n", "events_total", of("arm_n", "arm_a").alias("n_a"), of("arm_n", "arm_b").alias("n_b"), of("events_by_arm", "arm_a").alias("e_a"), of("events_by_arm", "arm_b").alias("e_b"), "model_parameters", "outcomes")


def _export_problems(spark, d):
    """Results declared by the ledger: the latest version of some paths, an old one of others, and one nobody wrote."""
    e = entries(spark, d)
    told = e.where("status = 'ok'").select("seq", F.explode("outputs").alias("path", "sha256"), F.map_entries("inputs")[0].alias("i"))
    pick = lambda f: told.groupBy("path").agg(f(F.struct("sha256", "i"), "seq").alias("x")).select("path", "x.sha256", F.col("x.i.key").alias("input_path"), F.col("x.i.value").alias("input_sha256"))
    even = F.substring_index("path", "/", -1).cast("int") % 2 == 0
    results = pick(F.max_by).where(even).unionByName(pick(F.min_by).where(~even)).unionByName(told.limit(1).select(F.lit("out/none").alias("path"), F.lit("0").alias("sha256"), F.lit("x").alias("input_path"), F.lit("y").alias("input_sha256")))
    people = load(spark, d, "person").select("person_id", F.lit("1998-01-01").cast("date").alias("reference_date"))
    shared = {"study.person_demographic": deid.person_demographics(load(spark, d, "person"), people)}
    folder = f"{tables.written(people.limit(1), 'export').inputFiles()[0].rsplit('/', 1)[0]}/out"
    return jobs.export(shared, e, spark.createDataFrame([], "step string, param string"), folder, results)["problems"]


def _exported(spark, d):
    """The shareable ledger and the written tables of an export without problems: (what, n)."""
    people = load(spark, d, "person").select("person_id", F.lit("1998-01-01").cast("date").alias("reference_date"))
    shared = deid.deidentify({"study.person_demographic": deid.person_demographics(load(spark, d, "person"), people)}, b"key")
    folder = f"{tables.written(people.limit(1), 'export').inputFiles()[0].rsplit('/', 1)[0]}/out"
    rows = entries(spark, d).withColumn("params", F.create_map(F.lit("seed"), F.lit("1"))).withColumn("items", F.array(F.struct(F.lit("ok").alias("status")))).withColumn("api_calls", F.array(F.struct(F.lit("map").alias("endpoint"), F.lit(1).cast("long").alias("count"))))
    got = jobs.export(shared, rows, spark.createDataFrame([("1-URGENT", "seed")], "step string, param string"), folder, endpoints=("map",))
    again = tables.read_tables(spark, folder, ["study.person_demographic"], views=False)["study.person_demographic"]
    return again.groupBy("age_bucket").agg(F.count("*").alias("n")).unionByName(got["ledger"].agg(F.count("*").alias("n")).select(F.lit("ledger").alias("age_bucket"), "n"))


def _detectable(spark, d):
    """The least rate ratio that the events of both arms could show."""
    rates = compare.incidence(frame(spark, d).where("observation_end > index_date"), events_of(spark, d, "urgent"))
    arms = rates.agg(*[F.sum(F.when(F.col("group") == g, F.col("events"))).alias(f"events_{g}") for g in ARMS])
    return arms.select("*", stats.detectable_rate_ratio(F.col("events_arm_a"), F.col("events_arm_b")).alias("ratio"))


def _forest(spark, d):
    """Risk differences with a complete interval; one outcome has none."""
    got = compare.two_by_two(outcomes(spark, d), ["any_o", "any_urgent"], "cohort_name", *ARMS).select("outcome", F.col("risk_difference").alias("estimate"), "lower", "upper")
    return jobs.forest_rows(got.unionByName(got.where("outcome = 'any_o'").withColumn("outcome", F.lit("open")).withColumn("upper", F.lit(None).cast("double"))))


def _result_tables(spark, d):
    """A result written and read back: non-finite numbers are null."""
    rows = load(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, float("nan")).when(F.col("event_id") % 10 == 1, float("inf")).otherwise(F.col("value")).alias("value"))
    folder = f"{tables.written(rows.limit(1), 'result').inputFiles()[0].rsplit('/', 1)[0]}/out"
    tables.write_result({"data": rows.limit(3), "stale": rows.limit(1)}, folder, {"kind": "old"})
    tables.write_result({"data": rows}, folder, {"kind": "events"})
    return tables.read_result(spark, folder)[0]["data"]


def _pathways(spark, d):
    drugs = load(spark, d, "drug_event").withColumn("drug_class", F.lower(F.substring("source_value", 7, 50))).where("drug_class in ('promo', 'standard', 'economy')")
    return jobs.treatment_pathways(frame(spark, d), drugs)["data"]


AFTER = ERAS.replace("FROM drug_event WHERE", "FROM drug_event JOIN (SELECT DISTINCT person_id, index_date FROM frame) USING (person_id) WHERE event_date >= index_date AND")


def _calls(spark, d):
    rows = entries(spark, d).withColumn("params", F.create_map(F.lit("seed"), F.lit("1"), F.lit("token"), F.lit("secret")))
    item = lambda s: F.struct(F.lit(s).alias("status"))
    rows = rows.withColumn("items", F.array(item("ok"), item("ok"), item("failed")))
    call = lambda e, n: F.struct(F.lit(e).alias("endpoint"), F.lit(n).cast("long").alias("count"))
    rows = rows.withColumn("api_calls", F.array(call("map", 2), call("map", 3), call("look", 1)))
    allowed = spark.createDataFrame([("1-URGENT", "seed"), ("2-HIGH", "seed")], "step string, param string")
    got = ledger.shareable(rows, allowed, ("map", "look"))
    return got.select("seq", "step", F.map_keys("params")[0].alias("param"), F.col("item_counts")["ok"].cast("int").alias("ok_items"), F.size("calls").alias("endpoints"), F.aggregate("calls", F.lit(0).cast("long"), lambda a, c: a + c["count"]).alias("calls"))


def _shared_calls(spark, d):
    """Calls of two allowed endpoints and of one whose path holds an id: (seq, endpoint, count, ms, credits)."""
    k = F.col("o_orderkey")
    call = lambda e, n, ms, credits: F.struct(F.lit(e).alias("endpoint") if isinstance(e, str) else e.alias("endpoint"), n.cast("long").alias("count"), ms.cast("double").alias("ms"), credits.cast("double").alias("credits"))
    calls = F.array(call("map", k % 5, k % 7 + 0.5, F.when(k % 2 == 0, 1)), call("map", F.lit(2), k % 3, F.lit(2)), call("look", F.lit(1), F.lit(None), k % 4), call(F.concat(F.lit("patients/"), k), F.lit(9), F.lit(9), F.lit(9)))
    rows = load(spark, d, "orders").select(k.alias("seq"), F.col("o_orderpriority").alias("step"), F.lit("ok").alias("status"), F.create_map(F.lit("seed"), F.lit("1")).alias("params"), F.array(F.struct(F.lit("ok").alias("status"))).alias("items"), calls.alias("api_calls"))
    allowed = spark.createDataFrame([("1-URGENT", "seed"), ("2-HIGH", "seed")], "step string, param string")
    return ledger.shareable(rows, allowed, ("look", "map")).select("seq", F.explode("calls").alias("c")).select("seq", "c.*")


def _unchecked_by_analysis(spark, d):
    """The three analyses and two with features: the share of unchecked mappings that each draws on."""
    more = [jobs.Analysis("features", "patient_signature", domains=("condition", "drug")), jobs.Analysis("both", "trajectory", ("urgent_f",), (("status-p", 1, 90, 0),), domains=("visit",))]
    sets = load(spark, d, "code_set").withColumn("source_system", F.substring_index("source_value", "#", 1)).withColumn("source_code", F.substring_index("source_value", "#", -1))
    m = load(spark, d, "code_mapping").select("source_system", "source_code", F.when(F.col("omop_id") % 4 == 0, "visit_occurrence").otherwise(F.col("omop_table")).alias("omop_table"), F.when(F.col("omop_id") % 3 == 0, "UNCHECKED").otherwise(F.col("mapping_status")).alias("mapping_status"))
    return guardrails.unchecked_by_analysis(m, sets, jobs.analysis_scope(spark, [*ANALYSES, *more], PLAN))


def _artifacts(spark, d):
    """Orders as files in two levels of folders, declared by entries as files and as folders; some have changed or are gone."""
    k = F.col("o_orderkey")
    o = load(spark, d, "orders")
    path = F.concat(F.lit("out/c"), F.col("o_custkey"), F.lit("/f"), k)
    files = o.where(k % 11 > 0).select(path.alias("path"), F.sha2(F.when(k % 13 == 0, "changed").otherwise(k.cast("string")), 256).alias("sha256"))
    told = o.select(path.alias("path"), F.sha2(k.cast("string"), 256).alias("sha256"))
    named = o.select(F.concat(F.lit("out/c"), F.col("o_custkey")).alias("path"))
    folders = ledger.directory_digests(o.where(k % 11 > 0).select(path.alias("path"), F.sha2(k.cast("string"), 256).alias("sha256")), named)
    declared = told.unionByName(folders)
    return ledger.artifact_audit(declared, files)


def _declaring(spark, d):
    e = entries(spark, d)
    wanted = e.select(F.explode("outputs").alias("path", "sha256"), F.map_entries("inputs")[0].alias("i"), "seq").groupBy("path").agg(F.max_by(F.struct("sha256", F.col("i.key").alias("input_path"), F.col("i.value").alias("input_sha256")), "seq").alias("x")).select("path", "x.*")
    return ledger.declaring_entry(e, wanted)


def _stage_signature(spark, d):
    fr, m = measured_people(spark, d)
    rows = jobs.patient_signature(fr, m, m, clusters=3, numeric=["year"], categories=["race"])
    return rows["data"].withColumn("stability", F.lit(rows["stability"])).withColumn("matrix_hash", F.lit(rows["matrix_hash"]))


def measured_people(spark, d):
    """The measured frame with demographics: a birth year that every fifth lacks, and a segment that every seventh lacks."""
    fr, m = measured(spark, d)
    k = F.col("person_id")
    return fr.withColumn("year", F.when(k % 5 > 0, 1930 + k % 65)).withColumn("race", F.when(k % 7 > 0, F.concat(F.lit("r"), k % 3))), m


def _scaled_matrix(spark, d):
    """The whole scaled matrix: present cells, and for each column the value of its absent cells with their number."""
    fr, m = measured_people(spark, d)
    got = jobs.feature_matrix(fr, m, m.where("event_id % 3 = 0"), numeric=["year"], categories=["race"])
    absent = got["columns"].select(F.lit(None).cast("long").alias("person_id"), "feature", F.col("absent").alias("value"), (F.col("n") - F.col("present")).alias("cells"))
    return got["cells"].select(F.col("person_id").cast("long").alias("person_id"), "feature", "value", F.lit(1).cast("long").alias("cells")).unionByName(absent)


def _crosswalk(spark, d):
    codes = load(spark, d, "code_mapping").select("source_system", "source_code").distinct()
    table = load(spark, d, "orders").select(F.lit("status").alias("source_system"), F.col("o_orderstatus").alias("source_code"), F.col("o_orderpriority").alias("target_vocabulary"), (F.col("o_orderkey") % 10).cast("string").alias("target_code"), F.col("o_orderkey").alias("rank"))
    return omop.crosswalk(codes, table)


def _lineage(spark, d):
    m = load(spark, d, "code_mapping").select("omop_table", "omop_id", "source_patient_id", "mapping_status")
    people = load(spark, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("pt-"), "c_custkey").alias("source_patient_id"), F.col("c_custkey").alias("person_id"))
    prov = m.where("omop_id % 3 = 0").select("omop_table", "omop_id", F.lit("enriched").alias("origin"), F.lit("d1").alias("doc_ref_id"))
    return omop.mapping_lineage(m, people, prov).select("omop_id", "source_patient_id", "mapping_status", "person_id", "origin")


def _fresh(spark, d):
    c = load(spark, d, "customer")
    stored = c.select(F.col("c_name").alias("name"), F.sha2(F.col("c_mktsegment"), 256).alias("sha256"))
    now = c.where("c_custkey % 5 > 0").select(F.col("c_name").alias("name"), F.sha2(F.when(F.col("c_custkey") % 3 == 0, "changed").otherwise(F.col("c_mktsegment")), 256).alias("sha256"))
    return ledger.freshness(stored, now)


def _evidence(spark, d):
    """Customers as code sets: reviews for most of them, told in the ledger for some."""
    c = load(spark, d, "customer")
    k = F.col("c_custkey")
    sets = c.select(F.col("c_name").alias("code_set_name"), F.sha2(F.col("c_mktsegment"), 256).alias("fingerprint"))
    reviews = c.where(k % 7 > 0).select(F.col("c_name").alias("code_set_name"), F.concat(F.lit("review/"), k).alias("review_path"), F.sha2(k.cast("string"), 256).alias("review_sha256"), (k % 5 > 0).alias("approved"), F.when(k % 11 == 0, "old").otherwise(F.sha2(F.col("c_mktsegment"), 256)).alias("reviewed_fingerprint"))
    told = c.where(k % 3 > 0).select(k.alias("seq"), F.lit("review").alias("step"), F.lit("ok").alias("status"), F.create_map(F.concat(F.lit("review/"), k), F.when(k % 13 == 0, "other").otherwise(F.sha2(k.cast("string"), 256))).alias("outputs"))
    return ledger.review_evidence(sets, reviews, told)


QUERIES = {
    "ingest_report": _ingest_report,
    "flatten_fhir": _flatten,
    "flatten_types": _flatten_types,
    "materialized_person": lambda s, d: _materialized(s, d, "omop.person"),
    "materialized_conditions": lambda s, d: _materialized(s, d, "omop.condition_occurrence"),
    "materialize_rejects": lambda s, d: _materialized(s, d, "rejects"),
    "patient_ledger": lambda s, d: _materialized(s, d, "meta.ingest_patient").select("source_patient_id", "status", "id_offset"),
    "enriched_resources": _enriched,
    "table_one_job": _table_one_job,
    "cohort_compare": _cohort_compare,
    "cohort_compare_counts": lambda s, d: _cohort_compare(s, d).select("outcome", "outcome_type", "n_exposed", "events_exposed", "n_comparator", "events_comparator", F.when(F.col("outcome_type") == "continuous", F.col("estimate")).alias("shift")),
    "survival_job": _survival_job,
    "survival_models": _survival_models,
    "incidence_job": _incidence_job,
    "trajectory_job": _trajectory_job,
    "mixed_model": _mixed_model,
    "causal_matching": _matched_effect,
    "data_summary": _data_summary,
    "export_problems": _export_problems,
    "exported_tables": _exported,
    "result_tables": _result_tables,
    "love_plot": lambda s, d: jobs.love_plot(causal.balance(_weighted(s, d), ["balance", "year_of_birth"])),
    "attrition_steps": lambda s, d: jobs.attrition_steps(resolved(s, d)[1]),
    "pathways_after_index": _pathways,
    "risk_at_ticks": lambda s, d: jobs.risk_at_ticks(tables.written(survival.kaplan_meier(survived(s, d)), "curve")),
    "coverage_shares": lambda s, d: jobs.coverage_shares(omop.mapping_coverage(load(s, d, "code_mapping"))),
    "feature_provenance": lambda s, d: features.feature_provenance(features.windowed(*measured(s, d), {"baseline": (-365, -1)})),
    "shareable_ledger": _calls,
    "declaring_entry": _declaring,
    "cohort_frame_problems": lambda s, d: windows.cohort_frame_problems(cohort_rows(s, d), ["arm_a", "arm_b", "urgent_f", "nobody"]),
    "arm_summary": lambda s, d: guardrails.arm_summary(outcomes(s, d), "any_o", "a1", "cohort_compare").select("total_n", "events_total", F.element_at("arm_n", "arm_a").alias("n_a"), F.element_at("events_by_arm", "arm_b").alias("e_b")),
    "covariate_patterns": lambda s, d: compare.covariate_patterns(outcomes(s, d), "any_o", ["gender_source_value", "race_source_value"]),
    "trajectory_bootstrap": lambda s, d: trajectory.bootstrap_means(trajectory.relative_times(*measured(s, d))),
    "patient_signature": _stage_signature,
    "scaled_matrix": _scaled_matrix,
    "detectable_rate_ratio": _detectable,
    "forest_rows": _forest,
    "shareable_calls": _shared_calls,
    "unchecked_by_analysis": _unchecked_by_analysis,
    "artifact_audit": _artifacts,
    "causal_iptw": lambda s, d: jobs.causal_effect(outcomes(s, d), "any_urgent", "arm_a", ["balance", "year_of_birth"])["data"],
    "first_seen": lambda s, d: fhir.first_seen(load(s, d, "events").select(F.concat(F.lit("u"), "user_id").alias("patient_id"), F.col("event_id").alias("seq"))),
    "class_overlaps": lambda s, d: eras.class_overlaps(load(s, d, "drug_event").select("event_id", F.col("source_value").alias("drug_class"))),
    "crosswalk": _crosswalk,
    "mapping_lineage": _lineage,
    "hash_freshness": _fresh,
    "review_evidence": _evidence,
    "demographics_encoding": lambda s, d: features.encode_demographics(frame(s, d).withColumn("y", F.when(F.col("person_id") % 5 > 0, F.col("year_of_birth"))), ["y"], ["race_source_value"]),
}

def cohort_rows(spark, d):
    from cohortloom.queries.cohorts import resolved

    return resolved(spark, d)[0]


ENC = "enc AS (SELECT * FROM orders)"

NEW = """WITH new AS (SELECT * FROM customer WHERE c_custkey % 8 <> 0), good AS (SELECT * FROM new WHERE c_custkey % 10 <> 9), top AS (SELECT max(c_custkey) + 1 AS t FROM customer WHERE c_custkey % 4 = 0),
    placed AS (SELECT good.*, CASE WHEN c_custkey % 4 = 0 THEN c_custkey + 1 ELSE t + row_number() OVER (PARTITION BY c_custkey % 4 = 0 ORDER BY c_name) END * 1000000 AS id_offset FROM good, top)"""

ORACLES = {
    "detectable_rate_ratio": with_ctes("""SELECT a AS events_arm_a, b AS events_arm_b, exp((1.959963984540054 + 0.8416212335729143) * sqrt(1.0 / a + 1.0 / b)) AS ratio FROM (
        SELECT CAST(sum(e) FILTER (cohort_name = 'arm_a') AS BIGINT) AS a, CAST(sum(e) FILTER (cohort_name = 'arm_b') AS BIGINT) AS b FROM (
          SELECT f.cohort_name, (SELECT count(*) FROM matched m WHERE m.person_id = f.person_id AND code_set_name = 'urgent' AND event_date BETWEEN index_date AND observation_end) AS e FROM frame f WHERE observation_end > index_date))""", FRAME),
    "forest_rows": with_ctes("SELECT outcome, risk_difference AS estimate, lower, upper FROM (" + _two_by_two_sql() + ")", TABS),
    "shareable_calls": """WITH o AS (SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
        SELECT o_orderkey AS seq, 'map' AS endpoint, o_orderkey % 5 + 2 AS count, CAST(o_orderkey % 7 + 0.5 + o_orderkey % 3 AS DOUBLE) AS ms, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 2 END AS DOUBLE) AS credits FROM o
        UNION ALL SELECT o_orderkey, 'look', 1, CAST(0 AS DOUBLE), CAST(o_orderkey % 4 AS DOUBLE) FROM o""",
    "unchecked_by_analysis": ctes("code_mapping") + """, m AS (SELECT source_code, CASE WHEN omop_id % 4 = 0 THEN 'visit_occurrence' ELSE omop_table END AS t, CASE WHEN omop_id % 3 = 0 THEN 'UNCHECKED' ELSE mapping_status END AS s FROM code_mapping),
        scope AS (SELECT * FROM (VALUES ('compare', ['O', 'F'], ['']), ('effect', ['F'], ['']), ('signature', [''], ['']), ('features', [''], ['condition_occurrence', 'drug_exposure']), ('both', ['P', 'F'], ['visit_occurrence'])) AS x (analysis_id, codes, tables))
        SELECT analysis_id, count(s) AS rows, coalesce(avg(CAST(s = 'UNCHECKED' AS DOUBLE)), 0.0) AS unchecked_fraction FROM scope LEFT JOIN m ON list_contains(codes, source_code) OR list_contains(tables, t) GROUP BY 1""",
    "artifact_audit": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
        SELECT 'out/c' || c || '/f' || k AS path, CASE WHEN k % 11 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM o WHERE k % 11 = 0 OR k % 13 = 0
        UNION ALL SELECT 'out/c' || c, 'changed' FROM o WHERE k % 11 > 0 GROUP BY c HAVING count(*) FILTER (k % 13 = 0) > 0""",
    "scaled_matrix": ctes("measurement_event") + """, person AS (SELECT DISTINCT person_id, CASE WHEN person_id % 5 > 0 THEN 1930 + person_id % 65 END AS year, CASE WHEN person_id % 7 > 0 THEN 'r' || person_id % 3 ELSE 'Missing' END AS race FROM measurement_event),
        e AS (SELECT *, substr(source_value, 7) AS k, datediff('day', DATE '2024-01-15', event_date) AS day FROM measurement_event),
        n AS (SELECT person_id, CASE WHEN day < 0 THEN 'baseline' ELSE 'post' END || '|measurement|' || k AS base, count(*) AS n FROM e WHERE day BETWEEN -365 AND 90 GROUP BY 1, 2),
        s AS (SELECT person_id, 'baseline|measurement|' || k AS base, last(value ORDER BY event_date, event_id) AS l, median(value) AS m, CASE WHEN count(*) >= 3 AND count(DISTINCT event_date) >= 2 THEN regr_slope(value, day) END AS sl
              FROM e WHERE day < 0 AND value IS NOT NULL AND event_id % 3 = 0 GROUP BY ALL),
        raw AS (SELECT person_id, base, '|presence' AS f, 1.0 AS v FROM n UNION ALL SELECT person_id, base, '|log1p_count', ln(1 + n) FROM n
              UNION ALL SELECT person_id, base, '|latest_before_index', l FROM s UNION ALL SELECT person_id, base, '|median', m FROM s
              UNION ALL SELECT person_id, base, '|slope', sl FROM s WHERE sl IS NOT NULL AND (SELECT count(sl) FROM s AS o WHERE o.base = s.base) >= 3),
        enough AS (SELECT base FROM raw GROUP BY 1 HAVING count(DISTINCT person_id) >= greatest(3, ceil(0.02 * (SELECT count(*) FROM person)))),
        cells AS (SELECT person_id, base || f AS feature, v FROM raw JOIN enough USING (base)
              UNION ALL SELECT person_id, 'demographic|year', year FROM person WHERE year IS NOT NULL UNION ALL SELECT person_id, 'demographic|race=' || race, 1.0 FROM person),
        fills AS (SELECT feature, CASE WHEN regexp_matches(feature, '[|](latest_before_index|median|slope)$') OR feature = 'demographic|year' THEN median(v) ELSE 0.0 END AS z FROM cells GROUP BY 1),
        dense AS (SELECT p.person_id, f.feature, coalesce(c.v, z) AS v, c.v IS NULL AS gone FROM person p CROSS JOIN fills f LEFT JOIN cells c ON c.person_id = p.person_id AND c.feature = f.feature),
        q AS (SELECT feature, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS q3 FROM dense GROUP BY 1),
        scaled AS (SELECT person_id, feature, gone, CASE WHEN q3 > q1 THEN (v - m) / (q3 - q1) ELSE v - m END AS value FROM dense JOIN q USING (feature))
        SELECT person_id, feature, value, 1 AS cells FROM scaled WHERE NOT gone
        UNION ALL SELECT NULL, f.feature, min(CASE WHEN q3 > q1 THEN (z - m) / (q3 - q1) ELSE z - m END), count(*) FILTER (gone) FROM fills f JOIN q ON q.feature = f.feature JOIN scaled s ON s.feature = f.feature GROUP BY f.feature""",
    "ingest_report": f"""WITH {ENC}, helper AS (SELECT DISTINCT o_custkey, o_orderkey % 7 AS h FROM enc WHERE o_orderkey % 7 IN (SELECT s_suppkey FROM supplier)),
        every AS (SELECT 'Patient/p' || c_custkey AS key, 'p' || c_custkey AS patient_id FROM customer UNION ALL SELECT 'Encounter/e' || o_orderkey, 'p' || o_custkey FROM enc UNION ALL SELECT 'Observation/b' || o_orderkey, 'p' || o_custkey FROM enc)
        SELECT 'members' AS what, * FROM every UNION ALL SELECT 'members', 'Practitioner/s' || h, 'p' || o_custkey FROM helper
        UNION ALL SELECT 'orphans', 'Practitioner/s' || s_suppkey, NULL FROM supplier WHERE s_suppkey NOT IN (SELECT o_orderkey % 7 FROM enc)
        UNION ALL SELECT 'resources', key, NULL FROM every UNION ALL SELECT 'resources', 'Practitioner/s' || s_suppkey, NULL FROM supplier""",
    "flatten_fhir": """SELECT 'c' || o_orderkey AS resource_id, 'condition_occurrence' AS omop_table, 'p' || o_custkey AS source_patient_id, strftime(o_orderdate, '%Y-%m-%d') AS start, CAST(CASE o_orderstatus WHEN 'F' THEN 101 WHEN 'O' THEN 102 ELSE 0 END AS BIGINT) AS concept_id,
        CASE o_orderstatus WHEN 'F' THEN 'MAPPED' WHEN 'O' THEN 'ALREADY_STANDARD' ELSE 'UNCHECKED' END AS mapping_status, 'status#' || o_orderstatus AS source_value FROM orders""",
    "flatten_types": " UNION ALL ".join(f"""SELECT '{letter}' || l_orderkey || '-' || l_linenumber AS resource_id, '{t}' AS omop_table, strftime(l_shipdate, '%Y-%m-%d') AS start, '{system}#' || l_returnflag AS source_value, {value} AS value FROM lineitem WHERE l_linenumber % 4 = {k}{more}""" for letter, t, system, value, k, more in (
        ("m", "drug_exposure", "rx", "NULL", 0, ""), ("p", "procedure_occurrence", "px", "NULL", 1, ""), ("o", "observation", "ob", "NULL", 2, " AND l_orderkey % 2 = 1"), ("o", "measurement", "ob", "l_quantity", 2, " AND l_orderkey % 2 = 0"), ("v", "visit_occurrence", "vt", "NULL", 3, ""))),
    "materialized_person": f"{NEW} SELECT 1 + id_offset AS person_id, CAST(0 AS BIGINT) AS gender_concept_id, CAST(1930 + c_custkey % 65 AS INT) AS year_of_birth FROM placed",
    "materialized_conditions": f"{NEW} SELECT o_orderkey % 1000000 + id_offset AS condition_occurrence_id, 1 + id_offset AS person_id, CAST(0 AS BIGINT) AS condition_concept_id, CAST(o_orderdate AS DATE) AS condition_start_date FROM placed JOIN orders ON o_custkey = c_custkey",
    "materialize_rejects": f"{NEW} SELECT c_name AS source_patient_id, 'not exactly one person' AS reason FROM new WHERE c_custkey % 10 = 9",
    "patient_ledger": f"{NEW} SELECT c_name AS source_patient_id, 'ok' AS status, id_offset FROM placed UNION ALL SELECT c_name, 'failed', NULL FROM new WHERE c_custkey % 10 = 9",
    "enriched_resources": """WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL) SELECT 'enr-' || substr(h, 1, 12) || '-c1' AS id, 'd' || doc_id AS doc_ref_id, h AS document_hash FROM h""",
    "table_one_job": with_ctes(f"""SELECT variable, "group", statistic, NULL AS level, value FROM ({_continuous_sql()}) UNION ALL SELECT variable, "group", 'count', level, CAST(value AS DOUBLE) FROM ({CATEGORICAL})""", CATS),
    "cohort_compare_counts": with_ctes("""SELECT outcome, 'binary' AS outcome_type, CAST(n1 AS BIGINT) AS n_exposed, CAST(e1 AS BIGINT) AS events_exposed, CAST(n2 AS BIGINT) AS n_comparator, CAST(e2 AS BIGINT) AS events_comparator, NULL AS shift FROM tab
        UNION ALL SELECT 'year_of_birth', 'continuous', (SELECT count(*) FROM outcomes WHERE cohort_name = 'arm_a'), NULL, (SELECT count(*) FROM outcomes WHERE cohort_name = 'arm_b'), NULL,
        (SELECT quantile_cont(CAST(a.year_of_birth - b.year_of_birth AS DOUBLE), 0.5) FROM outcomes a, outcomes b WHERE a.cohort_name = 'arm_a' AND b.cohort_name = 'arm_b')""", TABS),
    "survival_job": with_ctes("""SELECT 'rmst|' || "group" AS what, rmst AS value FROM areas UNION ALL SELECT 'rmst_difference', max(rmst) FILTER ("group" = 'arm_a') - max(rmst) FILTER ("group" = 'arm_b') FROM areas
        UNION ALL SELECT 'median|' || "group", min(time) FILTER (survival <= 0.5) FROM km GROUP BY "group"
        UNION ALL SELECT 'log_rank', pow(observed - expected, 2) / variance FROM (SELECT CAST(sum(d1) AS DOUBLE) AS observed, sum(d * n1 * 1.0 / n) AS expected,
        sum(CASE WHEN n > 1 THEN CAST(n1 AS DOUBLE) * (n - n1) * d * (n - d) / (CAST(n AS DOUBLE) * n * (n - 1)) ELSE 0 END) AS variance FROM (
          SELECT duration, sum(c) OVER (ORDER BY duration DESC) AS n, sum(c1) OVER (ORDER BY duration DESC) AS n1, d, d1 FROM (
            SELECT duration, count(*) AS c, count(*) FILTER (cohort_name = 'arm_a') AS c1, sum(event) AS d, coalesce(sum(event) FILTER (cohort_name = 'arm_a'), 0) AS d1 FROM survived GROUP BY 1)) WHERE d > 0)""", SURVIVED,
        """areas AS (SELECT "group", sum(greatest(0.0, least(coalesce(nx, 1000.0), 1000.0) - time) * survival) AS rmst FROM (SELECT *, lead(time) OVER (PARTITION BY "group" ORDER BY time, step) AS nx FROM km) GROUP BY 1)"""),
    "trajectory_job": ctes("measurement_event") + """ SELECT 'all' AS "group", CAST(datediff('day', DATE '2024-01-15', event_date) AS INT) AS time, avg(v) AS value
        FROM (SELECT *, CASE unit WHEN 'g/L' THEN value * 100 ELSE value END AS v FROM measurement_event) WHERE v IS NOT NULL GROUP BY 2""",
    "data_summary": with_ctes("""SELECT 'compare' AS analysis_id, 'cohort_compare' AS kind, na + nb AS total_n, ea + eb AS events_total, na AS n_a, nb AS n_b, ea AS e_a, eb AS e_b, 3 AS model_parameters, 2 AS outcomes FROM (SELECT
          min(count(*) FILTER (cohort_name = 'arm_a')) OVER () AS na, min(count(*) FILTER (cohort_name = 'arm_b')) OVER () AS nb, CAST(min(sum(y) FILTER (cohort_name = 'arm_a')) OVER () AS BIGINT) AS ea, CAST(min(sum(y) FILTER (cohort_name = 'arm_b')) OVER () AS BIGINT) AS eb
          FROM long WHERE y IS NOT NULL GROUP BY outcome LIMIT 1)
        UNION ALL SELECT 'effect', 'causal_effect', count(*), CAST(sum(y) AS BIGINT), count(*) FILTER (cohort_name = 'arm_a'), count(*) FILTER (cohort_name = 'arm_b'), CAST(sum(y) FILTER (cohort_name = 'arm_a') AS BIGINT), CAST(sum(y) FILTER (cohort_name = 'arm_b') AS BIGINT), 2, 1 FROM long WHERE outcome = 'any_urgent' AND y IS NOT NULL
        UNION ALL SELECT 'signature', 'patient_signature', count(*), 0, count(*) FILTER (cohort_name = 'arm_a'), count(*) FILTER (cohort_name = 'arm_b'), 0, 0, NULL, NULL FROM frame""", TABS),
    "export_problems": """WITH ok AS (SELECT o_orderkey % 11 AS p, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
        SELECT 'out/' || p AS path, 'superseded' AS problem FROM ok WHERE p % 2 = 1 AND lo <> hi UNION ALL SELECT 'out/none', 'no_producer'""",
    "exported_tables": ctes("person") + """ SELECT CASE WHEN a >= 90 THEN '90+' ELSE (a // 5 * 5) || '-' || least(a // 5 * 5 + 4, 89) END AS age_bucket, count(*) AS n FROM (SELECT greatest(0, 1998 - year_of_birth) AS a FROM person) GROUP BY 1
        UNION ALL SELECT 'ledger', (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT')""",
    "result_tables": "SELECT event_id, CASE WHEN event_id % 10 > 1 THEN value END AS value FROM events",
    "love_plot": with_ctes("SELECT covariate, abs(smd_before) AS smd_before, abs(smd_after) AS smd_after, row_number() OVER (ORDER BY abs(smd_before) DESC, covariate) AS place FROM (" + BALANCE + ")", WEIGHTED),
    "attrition_steps": with_ctes("""SELECT cohort_name, stage_order, stage, remaining, remaining * 1.0 / (SELECT count(*) FROM person) AS share FROM (SELECT s.cohort_name, s.stage_order, s.stage,
        (SELECT count(*) FROM judged j WHERE j.cohort_name = s.cohort_name AND (j.stage_order IS NULL OR j.stage_order > s.stage_order)) AS remaining FROM stages s)""", RESOLVED),
    "pathways_after_index": with_ctes("SELECT sequence, count(*) AS count, count(*) * 100.0 / (SELECT count(*) FROM lines) AS percent FROM lines GROUP BY 1", FRAME, LINES.replace(ERAS, AFTER)),
    "risk_at_ticks": with_ctes("""SELECT s."group", s.tick, min(at_risk) AS at_risk FROM (SELECT "group", k * m / 4.0 AS tick FROM (SELECT DISTINCT "group" FROM km), (SELECT max(time) AS m FROM km), (SELECT unnest(range(0, 5)) AS k)) s
        JOIN km ON km."group" = s."group" AND km.time <= s.tick GROUP BY 1, 2""", SURVIVED),
    "coverage_shares": ctes("code_mapping") + " SELECT omop_table, " + ", ".join(f"avg(CAST(mapping_status = '{m}' AS DOUBLE)) AS \"{m}\"" for m in ("ALREADY_STANDARD", "MAPPED", "UNMAPPED", "UNCHECKED")) + " FROM code_mapping GROUP BY 1",
    "feature_provenance": ctes("measurement_event") + """ SELECT 'baseline|measurement|' || substr(source_value, 7) AS feature, 'measurement' AS domain, 'MAPPED' AS mapping_status, count(*) AS rows, 1.0 AS fraction FROM measurement_event
        WHERE datediff('day', DATE '2024-01-15', event_date) BETWEEN -365 AND -1 GROUP BY 1""",
    "shareable_ledger": "SELECT o_orderkey AS seq, o_orderpriority AS step, 'seed' AS param, CAST(2 AS INT) AS ok_items, CAST(2 AS INT) AS endpoints, CAST(6 AS BIGINT) AS calls FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "declaring_entry": "SELECT 'out/' || (o_orderkey % 11) AS path, CASE WHEN last(o_orderstatus ORDER BY o_orderkey) <> 'P' THEN max(o_orderkey) END AS seq FROM orders GROUP BY 1",
    "cohort_frame_problems": with_ctes("""SELECT 'overlap' AS problem, count(*) AS n FROM (SELECT person_id FROM cohort WHERE included AND cohort_name IN ('arm_a', 'arm_b', 'urgent_f') GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0
        UNION ALL SELECT 'empty_cohort', 1 + (SELECT count(*) FROM (VALUES ('arm_a'), ('arm_b'), ('urgent_f')) AS t (c) WHERE c NOT IN (SELECT cohort_name FROM cohort WHERE included))""", FRAME.split(",\nframe AS")[0]),
    "arm_summary": with_ctes("SELECT count(*) AS total_n, CAST(coalesce(sum(any_o), 0) AS BIGINT) AS events_total, count(*) FILTER (cohort_name = 'arm_a') AS n_a, CAST(coalesce(sum(any_o) FILTER (cohort_name = 'arm_b'), 0) AS BIGINT) AS e_b FROM outcomes", OUTCOMES),
    "covariate_patterns": with_ctes("SELECT gender_source_value, race_source_value, count(*) AS n, CAST(sum(any_o) AS BIGINT) AS events FROM outcomes WHERE any_o IS NOT NULL GROUP BY 1, 2", OUTCOMES),
    "first_seen": "SELECT 'u' || user_id AS patient_id, min(event_id) AS seq FROM events GROUP BY 1",
    "class_overlaps": ctes("drug_event") + " SELECT event_id, count(DISTINCT source_value) AS classes FROM drug_event GROUP BY 1 HAVING count(DISTINCT source_value) > 1",
    "crosswalk": "SELECT 'status' AS source_system, o_orderstatus AS source_code, o_orderpriority AS target_vocabulary, CAST(o_orderkey % 10 AS VARCHAR) AS target_code, min(o_orderkey) AS rank FROM orders GROUP BY ALL",
    "mapping_lineage": ctes("code_mapping") + """ SELECT omop_id, source_patient_id, mapping_status, c_custkey AS person_id, CASE WHEN omop_id % 3 = 0 THEN 'enriched' END AS origin
        FROM code_mapping LEFT JOIN customer ON source_patient_id = 'pt-' || c_custkey AND c_custkey % 2 = 0""",
    "hash_freshness": "SELECT c_name AS name, c_custkey % 5 > 0 AND c_custkey % 3 > 0 AS fresh FROM customer",
    "review_evidence": """SELECT c_name AS code_set_name, reason FROM (SELECT *, CASE WHEN c_custkey % 7 = 0 THEN 'no_review' WHEN c_custkey % 5 = 0 THEN 'not_approved' WHEN c_custkey % 11 = 0 THEN 'codings_changed'
        WHEN c_custkey % 3 = 0 THEN 'no_ledger_row' WHEN c_custkey % 13 = 0 THEN 'artifact_changed' END AS reason FROM customer) WHERE reason IS NOT NULL""",
    "demographics_encoding": with_ctes("""SELECT person_id, 'demographic|y' AS feature, CAST(coalesce(y, (SELECT quantile_cont(CAST(y AS DOUBLE), 0.5) FROM ys)) AS DOUBLE) AS value FROM ys
        UNION ALL SELECT person_id, 'demographic|race_source_value=' || race_source_value, 1.0 FROM ys""", FRAME, "ys AS (SELECT *, CASE WHEN person_id % 5 > 0 THEN year_of_birth END AS y FROM frame)"),
}
