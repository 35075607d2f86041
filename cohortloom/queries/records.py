"""Queries of OMOP loading, FHIR sources, de-identification, features, guardrails and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom import schemas
from cohortloom.functions.columns import audit_token, normalize_reference, references
from cohortloom.operators import causal, deid, features, guardrails, ledger, matching, omop, trajectory
from cohortloom.queries.analyses import OUTCOMES, outcomes
from cohortloom.queries.cohorts import _hmac_sql, with_ctes
from cohortloom.sources import fhir, tables
from cohortloom.testbed import ctes, load

KEY = b"study-key"


# ------------------------------------------------------------------ sources


def resources(spark, d):
    """Customers as Patients, orders as Encounters that refer to them and as Observations of those, suppliers as shared Practitioners."""
    c = load(spark, d, "customer")
    p = c.select(F.concat(F.lit('{"resourceType":"Patient","id":"p'), "c_custkey", F.lit('"}')).alias("body"))
    o = load(spark, d, "orders")
    e = o.select(F.concat(F.lit('{"resourceType":"Encounter","id":"e'), "o_orderkey", F.lit('","subject":{"reference":"Patient/p'), "o_custkey", F.lit('/_history/2"},"performer":[{"reference":"Practitioner/s'), F.col("o_orderkey") % 7, F.lit('"}]}')).alias("body"))
    obs = o.select(F.concat(F.lit('{"resourceType":"Observation","id":"b'), "o_orderkey", F.lit('","encounter":{"reference":"http://x/Encounter/e'), "o_orderkey", F.lit('?v=1"}}')).alias("body"))
    s = load(spark, d, "supplier").select(F.concat(F.lit('{"resourceType":"Practitioner","id":"s'), "s_suppkey", F.lit('"}')).alias("body"))
    return fhir.with_type_and_id(p.union(e).union(obs).union(s))


def keyed_resources(spark, d):
    return fhir.with_key(resources(spark, d))


def _keys(spark, d):
    return keyed_resources(spark, d).select("resource_type", "id", "key")


def _dedupe(spark, d):
    keyed = keyed_resources(spark, d)
    return fhir.dedupe(keyed.union(keyed.where("resource_type = 'Patient'")))[0].groupBy("resource_type", "copies").agg(F.count("*").alias("n"))


def _members(spark, d):
    got = fhir.group_by_patient(keyed_resources(spark, d))
    return got["members"].groupBy("patient_id").agg(F.count("*").alias("n"))


def _orphans(spark, d):
    return fhir.group_by_patient(keyed_resources(spark, d))["orphans"]


def documents_fhir(spark, d):
    docs = load(spark, d, "documents")
    data = F.base64(F.encode("text", "UTF-8"))
    body = F.to_json(F.struct(F.lit("DocumentReference").alias("resourceType"), F.concat(F.lit("d"), "doc_id").alias("id"), F.array(F.struct(F.struct(F.lit("text/plain; charset=utf-8").alias("contentType"), F.regexp_replace(data, r"\s", "").alias("data")).alias("attachment"))).alias("content")))
    return fhir.with_type_and_id(docs.select(body.alias("body")))


def _attachments(spark, d):
    good, _ = fhir.extract_attachments(documents_fhir(spark, d))
    return fhir.distinct_documents(good).select("document_hash", "media_type", "referrers")


def _references(spark, d):
    rows = resources(spark, d).select("resource_type", F.explode(F.transform(references(F.col("body")), normalize_reference)).alias("ref"))
    return rows.groupBy("resource_type", "ref").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ loading


def raw_conditions(spark, d):
    """Local condition rows with text dates, some of them invalid."""
    o = load(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 10 == 0, "not-a-date").when(F.col("o_orderkey") % 10 == 1, F.date_format("o_orderdate", "yyyy-MM")).when(F.col("o_orderkey") % 10 == 2, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select((F.col("o_orderkey") % 1000).alias("condition_occurrence_id"), F.lit(1).cast("long").alias("person_id"), F.lit(0).cast("long").alias("condition_concept_id"), text.alias("condition_start_date"), (F.col("o_custkey") * omop.BLOCK).alias("id_offset"))


def _blocks(spark, d):
    patients = load(spark, d, "customer").select(F.col("c_name").alias("source_patient_id"))
    known = load(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_name").alias("source_patient_id"), ((F.col("c_custkey") + 1) * omop.BLOCK).alias("id_offset"))
    return omop.allocate_blocks(patients, known)


def _upsert(spark, d):
    old = load(spark, d, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("row_id"), F.lit("old").alias("version"))
    new = load(spark, d, "orders").where("o_custkey % 3 = 0 and o_orderkey % 2 = 0").select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("row_id"), F.lit("new").alias("version"))
    return omop.replace_patients(old, new).groupBy("person_id", "version").agg(F.count("*").alias("n"))


def condition_status(spark, d):
    ev = load(spark, d, "condition_event")
    m = load(spark, d, "code_mapping")
    prov = m.where("omop_id % 6 = 0").select("omop_table", "omop_id", F.when(F.col("omop_id") % 12 == 0, "enriched").otherwise("structured").alias("origin"))
    return omop.with_status(ev, m.where("omop_id % 5 > 0"), prov, "condition_occurrence")


STATUS = """statused AS (SELECT e.*, coalesce(m.mapping_status, CASE WHEN concept_id > 0 THEN 'MAPPED' ELSE 'UNCHECKED' END) AS mapping_status,
   CASE WHEN event_id % 12 = 0 THEN 'enriched' ELSE 'structured' END AS origin FROM condition_event e LEFT JOIN code_mapping m ON m.omop_id = event_id AND omop_id % 5 > 0)"""


# ------------------------------------------------------------------ sharing


def shared_mapping(spark, d):
    m = load(spark, d, "code_mapping").select("source_patient_id", F.lit("Condition").alias("resource_type"), F.concat(F.lit("c"), "omop_id").alias("resource_id"), "omop_table", "omop_id", "source_system", "source_code", F.lit("name").alias("source_name"), F.col("mapping_status"))
    return deid.apply_policy(m, "meta.mapping", KEY)


def shared_conditions(spark, d, shift=True):
    c = load(spark, d, "condition_event").select(F.col("event_id").alias("condition_occurrence_id"), "person_id", F.col("concept_id").alias("condition_concept_id"), F.col("event_date").alias("condition_start_date"), F.col("end_date").alias("condition_end_date"), F.lit(7).cast("long").alias("provider_id"), F.col("source_value").alias("condition_source_value"))
    return deid.apply_policy(c, "omop.condition_occurrence", KEY, shift, 180)


def _audit(spark, d):
    m = shared_mapping(spark, d)
    leaky = m.withColumn("resource_id", F.when(F.col("omop_id") % 100 == 0, "raw").otherwise(F.col("resource_id")))
    full = {f.name for f in schemas.REGISTRY["meta.mapping"]}
    for c in sorted(full - set(leaky.columns)):
        leaky = leaky.withColumn(c, F.lit(None).cast("string"))
    return deid.audit_policy({"meta.mapping": leaky})


def _k_anonymity(spark, d):
    people = load(spark, d, "person").withColumn("reference_date", F.lit("1998-01-01").cast("date"))
    rows = deid.person_demographics(people, people.select("person_id", "reference_date"), 20, 60).join(people.select("person_id", "gender_source_value", "race_source_value"), "person_id")
    return deid.k_anonymity(rows, ["age_bucket", "gender_source_value", "race_source_value"], 8)


SHIFT = "CAST(list_reduce(list_prepend(0, list_transform(range(0, 32), lambda i: CAST('0x' || substr(h, CAST(i * 2 + 1 AS INT), 2) AS INT))), lambda a, c: (a * 256 + c) % 361) - 180 AS INT)"


def _hash_of(column, namespace, prefix):
    lead = "".join(f"\\x{b:02X}" for b in namespace.encode() + b"\0")
    return f"'{prefix}' || " + _hmac_sql(KEY, f"('{lead}'::BLOB || encode({column}))")


# ------------------------------------------------------------------ features, trajectories, guardrails


def measured(spark, d):
    """Measurements with a study frame: index on 2024-01-15 for every user."""
    m = load(spark, d, "measurement_event").withColumn("event_key", F.substring("source_value", 7, 50))
    frame = m.select("person_id").distinct().select(F.lit("all").alias("cohort_name"), "person_id", F.lit("2024-01-15").cast("date").alias("index_date"))
    return frame, m


def _feature_counts(spark, d):
    frame, m = measured(spark, d)
    rows = features.windowed(frame, m, {"baseline": (-365, -1), "post": (0, 90)})
    return features.feature_counts(rows).groupBy("feature").agg(F.count("*").alias("people"), F.sum("value").alias("total"))


def _measurement_features(spark, d):
    frame, m = measured(spark, d)
    return features.measurement_features(frame, m)


def _robust(spark, d):
    frame, m = measured(spark, d)
    counts = features.feature_counts(features.windowed(frame, m, {"baseline": (-365, -1)})).where("feature like '%log1p_count'")
    return features.robust_scale(counts, frame)


def _floor(spark, d):
    frame, m = measured(spark, d)
    rows = features.windowed(frame, m, {"baseline": (-3, -1)})
    n = frame.count()
    return features.prevalence(features.feature_counts(rows), n).withColumn("kept", F.col("people") >= max(3, -(-2 * n // 100)))


def _trajectory(spark, d):
    frame, m = measured(spark, d)
    conv = spark.createDataFrame([("mg/dL", "mg/dL", 1.0, 0.0), ("g/L", "mg/dL", 100.0, 0.0)], "unit string, target string, multiplier double, offset double")
    rows = trajectory.relative_times(frame, trajectory.harmonize_units(m, conv))
    return trajectory.summarise(rows)


def _guardrails(spark, d):
    f = outcomes(spark, d)
    base = guardrails.arm_summary(f, "any_o", "a1", "cohort_compare").unionByName(guardrails.arm_summary(f.where("race_source_value = 'BUILDING' and ethnicity_source_value = 'ASIA'"), "any_o", "a2", "causal_effect"))
    none = lambda t: F.lit(None).cast(t)
    summary = base.select(
        "*", none("int").alias("model_parameters"), F.lit(0.3).alias("unchecked_fraction"), none("array<string>").alias("measurement_units"), none("double").alias("median_measurements"), F.element_at("arm_n", "arm_a").alias("exposed_n"),
        F.lit(True).alias("adjusted"), F.lit(3).alias("covariates"), F.lit(0).alias("covariates_without_rationale"), F.lit(False).alias("cox"), F.lit(False).alias("mixed_model"), F.lit(False).alias("unit_map"),
        none("string").alias("censor_rule"), F.lit(False).alias("unchecked_override"), F.lit(2).alias("outcomes"), F.lit("bh").alias("multiplicity"), F.lit(True).alias("code_sets_approved"),
    )
    return guardrails.evaluate(summary)


def _weighted(spark, d, estimand="ate"):
    """Closed-form weights on an arithmetic score, so that SQL can follow."""
    f = outcomes(spark, d).withColumn("treated", (F.col("cohort_name") == "arm_a").cast("int"))
    scored = f.withColumn("propensity_score", (F.lit(20.0) + F.col("year_of_birth") % 61) / 100)
    return causal.weights(scored, estimand, (0.01, 0.99))


WEIGHTED = OUTCOMES + """,
scored AS (SELECT *, CAST(cohort_name = 'arm_a' AS INT) AS treated, (20.0 + year_of_birth % 61) / 100.0 AS ps FROM outcomes),
raw AS (SELECT *, CASE WHEN treated = 1 THEN sh / ps ELSE (1 - sh) / (1 - ps) END AS w0 FROM scored, (SELECT CAST(avg(treated) AS DOUBLE) AS sh FROM scored)),
weighted AS (SELECT raw.*, least(greatest(w0, lo), hi) AS weight FROM raw, (SELECT quantile_cont(CAST(w0 AS DOUBLE), 0.01) AS lo, quantile_cont(CAST(w0 AS DOUBLE), 0.99) AS hi FROM raw))"""


def entries(spark, d):
    """Orders as ledger rows: each writes a file named by its key, and reads what an earlier order wrote under that name."""
    o = load(spark, d, "orders")
    path = lambda k: F.concat(F.lit("out/"), (F.col("o_orderkey") % k).cast("string"))
    return o.select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("step"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ok").alias("status"),
        F.create_map(path(11), F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("outputs"), F.create_map(path(11), F.sha2((F.col("o_orderkey") - 11).cast("string"), 256)).alias("inputs"),
    )


def narrative(spark, d):
    """Customers as Patients with narrative at two depths."""
    body = F.concat(F.lit('{"text":{"div":"x"},"resourceType":"Patient","id":"p'), "c_custkey", F.lit('","contact":[{"text":"y","n":'), "c_nationkey", F.lit("}]}"))
    return load(spark, d, "customer").select("c_custkey", body.alias("body"))


def _tagged(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("document_hash"), (F.col("doc_id") % 9).cast("string").alias("pages"))
    tags = lambda k: F.filter("tags", lambda t: t["system"] == k)[0]["code"]
    return fhir.tag_enriched(docs).select("id", tags("origin").alias("origin"), tags("document-hash").alias("document_hash"), tags("source-pages").alias("source_pages"))


def enriched_resources(spark, d):
    """Orders as Conditions; of every third key one is extracted from a document, told in one of three tag spellings."""
    k = F.col("o_orderkey")
    tag = F.when(k % 9 == 0, F.concat(F.lit('{"system":"http://x/document-hash","code":"h'), k, F.lit('"}'))).when(k % 9 == 3, F.concat(F.lit('{"system":"other","code":"doc-ref:D'), k, F.lit('"}'))).otherwise(F.lit('{"system":"http://x/origin","code":"ENRICHED"}'))
    tags = F.when(k % 3 == 0, tag).otherwise(F.lit('{"system":"other","code":"plain"}'))
    body = F.concat(F.lit('{"resourceType":"Condition","id":"c'), k, F.lit('","meta":{"tag":['), tags, F.lit("]}}"))
    return fhir.with_type_and_id(load(spark, d, "orders").select(body.alias("body")))


def _row_provenance(spark, d):
    k = F.col("o_orderkey")
    mapping = load(spark, d, "orders").select(F.lit("condition_occurrence").alias("omop_table"), F.floor(k / 2).alias("omop_id"), F.lit("Condition").alias("resource_type"), F.concat(F.lit("c"), k).alias("resource_id"))
    got = omop.row_provenance(mapping, omop.resource_provenance(enriched_resources(spark, d)))
    return got.select("omop_id", "origin", "resource_id", "document_hash", "doc_ref_id")


def _numeric(spark, d):
    e = load(spark, d, "events").select(F.when(F.col("event_id") % 7 > 0, F.col("user_id")).alias("a"), F.when(F.col("event_id") % 5 == 0, "n/a").when(F.col("event_id") % 11 == 0, "Infinity").otherwise(F.col("user_id").cast("string")).alias("b"))
    return tables.numeric_problems(e, ["a", "b"])


def _identifiers(spark, d):
    """A shared copy in which some ids were left."""
    p = load(spark, d, "person").select("person_id", F.when(F.col("person_id") % 9 == 0, F.col("year_of_birth")).alias("year_of_birth"), F.lit(None).cast("timestamp").alias("birth_datetime"), F.when(F.col("person_id") % 4 == 0, "x").alias("person_source_value"), F.lit(None).cast("long").alias("location_id"))
    m = shared_mapping(spark, d)
    return deid.identifier_audit(p, m.withColumn("resource_id", F.when(F.col("omop_id") % 100 == 0, "raw").otherwise(F.col("resource_id"))))


def _union_events(spark, d):
    c, v = load(spark, d, "condition_event"), load(spark, d, "visit_event")
    return features.union_events(c, v, c.where("event_id % 2 = 0")).groupBy("domain", "person_id").agg(F.count("*").alias("n"))


def _output_rows(spark, d):
    frame, m = measured(spark, d)
    rows = trajectory.relative_times(frame, m)
    return trajectory.output_rows(rows, trajectory.summarise(rows)).select("row_type", "person_id", "group", "time", "value", "n_patients")


def _untracked(spark, d):
    files = load(spark, d, "orders").select(F.concat(F.lit("out/"), F.col("o_orderkey") % 500).alias("path")).distinct()
    return ledger.untracked(files, ledger.latest_declarations(entries(spark, d)))


def _cluster_tables(spark, d):
    """Customers by nation as clusters, order priorities as presence features."""
    members = load(spark, d, "customer").select(F.col("c_custkey").alias("person_id"), (F.col("c_nationkey") - 1).cast("int").alias("cluster"))
    presence = load(spark, d, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderpriority").alias("feature"))
    return features.cluster_tables(members, presence)


def _bundles(spark, d):
    keyed = keyed_resources(spark, d)
    got = fhir.patient_bundles(keyed, fhir.group_by_patient(keyed)["members"])
    body = F.col("bundle")
    return got.select("patient_id", F.get_json_object(body, "$.entry[0].resource.id").alias("first_id"), F.size(F.from_json(F.get_json_object(body, "$.entry"), "array<string>")).alias("entries"))


def _off_vocabulary(spark, d):
    rows = load(spark, d, "customer").select(F.col("c_name").alias("source_patient_id"), F.lit("v1").alias("vocab_version"), F.struct(((F.col("c_custkey") % 10) / 10).alias("off_vocab_rate")).alias("summary"), F.array().cast("array<struct<a:int>>").alias("mappings"), F.array().cast("array<struct<a:int>>").alias("dropped"))
    return omop.off_vocabulary(omop.sidecars(rows)["coverage"])


QUERIES = {
    "off_vocabulary": _off_vocabulary,
    "strip_narrative": lambda s, d: narrative(s, d).select("c_custkey", fhir.strip_narrative(F.col("body")).alias("body")),
    "tag_enriched": _tagged,
    "row_provenance": _row_provenance,
    "numeric_problems": _numeric,
    "identifier_audit": _identifiers,
    "audit_tokens": lambda s, d: load(s, d, "customer").select("c_custkey", audit_token(F.col("c_custkey"), KEY).alias("token")),
    "union_events": _union_events,
    "trajectory_rows": _output_rows,
    "untracked_files": _untracked,
    "cluster_tables": _cluster_tables,
    "patient_bundles": _bundles,
    "att_effect": lambda s, d: causal.effect(_weighted(s, d, "att"), "any_urgent"),
    "fhir_references": _references,
    "fhir_keys": _keys,
    "fhir_dedupe": _dedupe,
    "fhir_members": _members,
    "fhir_orphans": _orphans,
    "fhir_attachments": _attachments,
    "fhir_page_summary": lambda s, d: fhir.page_summary(resources(s, d)),
    "block_allocation": _blocks,
    "rekey": lambda s, d: omop.rekey(raw_conditions(s, d), "omop.condition_occurrence").select("condition_occurrence_id", "person_id", "condition_concept_id"),
    "invalid_dates": lambda s, d: omop.coerce_dates(raw_conditions(s, d), "omop.condition_occurrence")[1],
    "coerced_dates": lambda s, d: omop.coerce_dates(raw_conditions(s, d), "omop.condition_occurrence")[0].groupBy("condition_start_date").agg(F.count("*").alias("n")),
    "replace_patients": _upsert,
    "mapping_coverage": lambda s, d: omop.mapping_coverage(load(s, d, "code_mapping")),
    "event_status": lambda s, d: condition_status(s, d).select("event_id", "mapping_status", "origin"),
    "provenance_fractions": lambda s, d: omop.provenance_fractions(condition_status(s, d)),
    "unchecked_fraction": lambda s, d: guardrails.unchecked_fraction(load(s, d, "code_mapping"), s.createDataFrame([("status", "P"), ("status", "F")], "source_system string, source_code string")),
    "shared_mapping": shared_mapping,
    "shared_conditions": shared_conditions,
    "policy_audit": _audit,
    "k_anonymity": _k_anonymity,
    "table_hash": lambda s, d: tables.table_hash(load(s, d, "orders")),
    "table_hash_keys": lambda s, d: tables.table_hash(load(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")),
    "feature_counts": _feature_counts,
    "measurement_features": _measurement_features,
    "robust_scaling": _robust,
    "prevalence_floor": _floor,
    "trajectory_summary": _trajectory,
    "measurement_summary": lambda s, d: guardrails.measurement_summary(load(s, d, "measurement_event")),
    "guardrail_rules": _guardrails,
    "iptw_effect": lambda s, d: causal.effect(_weighted(s, d), "any_urgent"),
    "balance": lambda s, d: causal.balance(_weighted(s, d), ["balance", "year_of_birth"]),
    "latest_declarations": lambda s, d: ledger.latest_declarations(entries(s, d)),
    "last_status": lambda s, d: ledger.last_status(entries(s, d)),
    "artifact_lineage": lambda s, d: ledger.lineage(entries(s, d)),
    "propensity_scores": lambda s, d: causal.propensity(outcomes(s, d), "arm_a", ["balance", "year_of_birth"]).select("person_id", "treated", "propensity_score"),
    "propensity_matching": lambda s, d: matching.match(causal.propensity(outcomes(s, d).select("cohort_name", "person_id", "balance", "year_of_birth"), "arm_a", ["balance", "year_of_birth"])),
}

RES = """pat AS (SELECT 'Patient/p' || c_custkey AS key FROM customer), enc AS (SELECT * FROM orders)"""

BALANCE = " UNION ALL ".join(f"""SELECT '{c}' AS covariate, (b1 - b0) / sqrt((c1 + c0) / 2) AS smd_before, (m1 - m0) / sqrt((v1 + v0) / 2) AS smd_after FROM (SELECT
        avg({c}) FILTER (treated = 1) AS b1, avg({c}) FILTER (treated = 0) AS b0, var_pop({c}) FILTER (treated = 1) AS c1, var_pop({c}) FILTER (treated = 0) AS c0,
        {', '.join(f"sum(weight * {c}) FILTER (treated = {k}) / sum(weight) FILTER (treated = {k}) AS m{k}, sum(weight * {c} * {c}) FILTER (treated = {k}) / sum(weight) FILTER (treated = {k}) - pow(sum(weight * {c}) FILTER (treated = {k}) / sum(weight) FILTER (treated = {k}), 2) AS v{k}" for k in (0, 1))} FROM weighted)""" for c in ("balance", "year_of_birth"))
ATT = WEIGHTED.replace("CASE WHEN treated = 1 THEN sh / ps ELSE (1 - sh) / (1 - ps) END", "CASE WHEN treated = 1 THEN 1 ELSE sh / (1 - sh) * ps / (1 - ps) END")
EFFECT = """SELECT m1 AS mean_exposed, m0 AS mean_comparator, m1 - m0 AS difference, m1 / m0 AS ratio FROM (SELECT sum(weight * any_urgent) FILTER (treated = 1) / sum(weight) FILTER (treated = 1) AS m1,
        sum(weight * any_urgent) FILTER (treated = 0) / sum(weight) FILTER (treated = 0) AS m0 FROM weighted WHERE any_urgent IS NOT NULL)"""

ORACLES = {
    "off_vocabulary": "SELECT count(*) AS patients, avg(r) AS mean, min(r) AS least, max(r) AS most FROM (SELECT (c_custkey % 10) / 10.0 AS r FROM customer)",
    "strip_narrative": """SELECT c_custkey, '{"contact":[{"n":' || c_nationkey || '}],"id":"p' || c_custkey || '","resourceType":"Patient"}' AS body FROM customer""",
    "tag_enriched": """SELECT 'enr-' || substr(h, 1, 12) || '-' || doc_id AS id, 'enriched' AS origin, h AS document_hash, CAST(doc_id % 9 AS VARCHAR) AS source_pages FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)""",
    "row_provenance": """SELECT omop_id, origin, resource_id, CASE WHEN origin = 'enriched' AND k % 9 = 0 THEN 'h' || k END AS document_hash, CASE WHEN origin = 'enriched' AND k % 9 = 3 THEN 'D' || k END AS doc_ref_id FROM (
        SELECT *, 'c' || k AS resource_id, row_number() OVER (PARTITION BY omop_id ORDER BY origin = 'structured', 'c' || k) AS r FROM (SELECT o_orderkey AS k, o_orderkey // 2 AS omop_id, CASE WHEN o_orderkey % 3 = 0 THEN 'enriched' ELSE 'structured' END AS origin FROM orders)) WHERE r = 1""",
    "numeric_problems": """SELECT 'a' AS "column", count(*) AS rows, count(*) FILTER (event_id % 7 = 0) AS missing, 0 AS non_numeric, 0 AS infinite FROM events
        UNION ALL SELECT 'b', count(*), 0, count(*) FILTER (event_id % 5 = 0), count(*) FILTER (event_id % 5 > 0 AND event_id % 11 = 0) FROM events""",
    "identifier_audit": """SELECT 'year_of_birth' AS "check", (SELECT count(*) FROM customer WHERE c_custkey % 9 = 0) AS n UNION ALL SELECT 'birth_datetime', 0 UNION ALL SELECT 'person_source_value', (SELECT count(*) FROM customer WHERE c_custkey % 4 = 0)
        UNION ALL SELECT 'location_id', 0 UNION ALL SELECT 'source_patient_id', 0 UNION ALL SELECT 'resource_id', (SELECT count(*) FROM orders WHERE o_orderkey % 100 = 0)""",
    "audit_tokens": f"""SELECT c_custkey, substr({_hash_of('CAST(c_custkey AS VARCHAR)', 'audit', '')}, 1, 16) AS token FROM customer""",
    "union_events": "SELECT domain, o_custkey AS person_id, count(*) AS n FROM orders, (VALUES ('condition'), ('visit')) AS t (domain) GROUP BY 1, 2",
    "trajectory_rows": ctes("measurement_event") + """, r AS (SELECT person_id, 'all' AS "group", CAST(datediff('day', DATE '2024-01-15', event_date) AS INT) AS time, value FROM measurement_event WHERE value IS NOT NULL)
        SELECT 'individual' AS row_type, person_id, "group", time, value, NULL AS n_patients FROM r UNION ALL SELECT 'summary', NULL, "group", time, avg(value), count(DISTINCT person_id) FROM r GROUP BY "group", time""",
    "untracked_files": "SELECT DISTINCT 'out/' || (o_orderkey % 500) AS path FROM orders WHERE o_orderkey % 500 NOT IN (SELECT o_orderkey % 11 FROM orders WHERE o_orderstatus <> 'P')",
    "cluster_tables": """WITH p AS (SELECT DISTINCT o_custkey, o_orderpriority AS feature FROM orders), m AS (SELECT c_custkey, CAST(c_nationkey - 1 AS INT) AS cluster FROM customer), i AS (SELECT cluster, feature, count(*) AS e FROM m JOIN p ON o_custkey = c_custkey GROUP BY 1, 2)
        SELECT s.cluster, f.feature, n AS n_exposed, coalesce(e, 0) AS events_exposed, t - n AS n_comparator, a - coalesce(e, 0) AS events_comparator FROM (SELECT cluster, count(*) AS n FROM m WHERE cluster >= 0 GROUP BY 1) s, (SELECT feature, CAST(sum(e) AS BIGINT) AS a FROM i GROUP BY 1) f,
        (SELECT count(*) AS t FROM m) LEFT JOIN i ON i.cluster = s.cluster AND i.feature = f.feature""",
    "patient_bundles": f"""WITH {RES} SELECT 'p' || c_custkey AS patient_id, 'p' || c_custkey AS first_id, CAST(1 + 2 * count(o_orderkey) + count(DISTINCT CASE WHEN s_suppkey IS NOT NULL THEN o_orderkey % 7 END) AS INT) AS entries
        FROM customer LEFT JOIN enc ON o_custkey = c_custkey LEFT JOIN supplier ON s_suppkey = o_orderkey % 7 GROUP BY 1""",
    "att_effect": with_ctes(EFFECT, ATT),
    "fhir_references": f"""WITH {RES} SELECT 'Encounter' AS resource_type, 'Patient/p' || o_custkey AS ref, count(*) AS n FROM enc GROUP BY 1, 2
        UNION ALL SELECT 'Encounter', 'Practitioner/s' || (o_orderkey % 7), count(*) FROM enc GROUP BY 1, 2 UNION ALL SELECT 'Observation', 'Encounter/e' || o_orderkey, count(*) FROM enc GROUP BY 1, 2""",
    "fhir_keys": """SELECT 'Patient' AS resource_type, 'p' || c_custkey AS id, 'Patient/p' || c_custkey AS key FROM customer UNION ALL SELECT 'Encounter', 'e' || o_orderkey, 'Encounter/e' || o_orderkey FROM orders
        UNION ALL SELECT 'Observation', 'b' || o_orderkey, 'Observation/b' || o_orderkey FROM orders UNION ALL SELECT 'Practitioner', 's' || s_suppkey, 'Practitioner/s' || s_suppkey FROM supplier""",
    "fhir_dedupe": f"""WITH {RES} SELECT 'Patient' AS resource_type, CAST(2 AS BIGINT) AS copies, count(*) AS n FROM pat UNION ALL SELECT 'Encounter', 1, count(*) FROM enc
        UNION ALL SELECT 'Observation', 1, count(*) FROM enc UNION ALL SELECT 'Practitioner', 1, count(*) FROM supplier""",
    "fhir_members": f"""WITH {RES} SELECT 'p' || c_custkey AS patient_id, 1 + 2 * count(o_orderkey) + count(DISTINCT CASE WHEN s_suppkey IS NOT NULL THEN o_orderkey % 7 END) AS n
        FROM customer LEFT JOIN enc ON o_custkey = c_custkey LEFT JOIN supplier ON s_suppkey = o_orderkey % 7 GROUP BY 1""",
    "fhir_orphans": f"WITH {RES} SELECT 'Practitioner/s' || s_suppkey AS key FROM supplier WHERE s_suppkey NOT IN (SELECT o_orderkey % 7 FROM enc)",
    "fhir_attachments": "SELECT sha256(text) AS document_hash, 'text/plain' AS media_type, count(*) AS referrers FROM documents GROUP BY 1",
    "fhir_page_summary": f"""WITH {RES} SELECT 'Patient' AS resource_type, count(*) AS total, count(*) AS ids FROM pat UNION ALL SELECT 'Encounter', count(*), count(*) FROM enc
        UNION ALL SELECT 'Observation', count(*), count(*) FROM enc UNION ALL SELECT 'Practitioner', count(*), count(*) FROM supplier""",
    "block_allocation": """SELECT c_name AS source_patient_id, (c_custkey + 1) * 1000000 AS id_offset FROM customer WHERE c_custkey % 5 = 0
        UNION ALL SELECT c_name, ((SELECT max(c_custkey) + 1 FROM customer WHERE c_custkey % 5 = 0) + row_number() OVER (ORDER BY c_name)) * 1000000 FROM customer WHERE c_custkey % 5 <> 0""",
    "rekey": "SELECT o_orderkey % 1000 + o_custkey * 1000000 AS condition_occurrence_id, 1 + o_custkey * 1000000 AS person_id, CAST(0 AS BIGINT) AS condition_concept_id FROM orders",
    "invalid_dates": """SELECT 'omop.condition_occurrence' AS omop_table, o_orderkey % 1000 AS omop_id, 'condition_start_date' AS column_name,
        CASE WHEN o_orderkey % 10 = 0 THEN 'not-a-date' ELSE strftime(o_orderdate, '%Y-%m') END AS original_value FROM orders WHERE o_orderkey % 10 < 2""",
    "coerced_dates": "SELECT CASE WHEN o_orderkey % 10 >= 2 THEN CAST(o_orderdate AS DATE) END AS condition_start_date, count(*) AS n FROM orders GROUP BY 1",
    "replace_patients": """WITH new AS (SELECT * FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 2 = 0) SELECT o_custkey AS person_id, 'new' AS version, count(*) AS n FROM new GROUP BY 1
        UNION ALL SELECT o_custkey, 'old', count(*) FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM new) GROUP BY 1""",
    "mapping_coverage": ctes("code_mapping") + " SELECT mapping_status, omop_table, count(*) AS n FROM code_mapping GROUP BY GROUPING SETS ((mapping_status), (mapping_status, omop_table))",
    "event_status": ctes("condition_event", "code_mapping") + f", {STATUS} SELECT event_id, mapping_status, origin FROM statused",
    "provenance_fractions": ctes("condition_event", "code_mapping") + f""", {STATUS} SELECT domain, count(*) AS n, avg(CAST(mapping_status = 'UNCHECKED' AS DOUBLE)) AS unchecked,
        avg(CAST(mapping_status = 'UNMAPPED' AS DOUBLE)) AS unmapped, avg(CAST(origin = 'enriched' AS DOUBLE)) AS enriched FROM statused GROUP BY ROLLUP (domain)""",
    "unchecked_fraction": ctes("code_mapping") + " SELECT count(*) AS rows, avg(CAST(mapping_status = 'UNCHECKED' AS DOUBLE)) AS unchecked_fraction FROM code_mapping WHERE source_code IN ('P', 'F')",
    "shared_mapping": ctes("code_mapping") + f""" SELECT {_hash_of('source_patient_id', 'source-patient-id', 'tok_')} AS source_patient_id, 'Condition' AS resource_type,
        {_hash_of("'c' || omop_id", 'fhir-resource-id', 'tok_')} AS resource_id, omop_table, omop_id, source_system, source_code, CAST(NULL AS VARCHAR) AS source_name, mapping_status FROM code_mapping""",
    "shared_conditions": ctes("condition_event") + f""" SELECT event_id AS condition_occurrence_id, person_id, concept_id AS condition_concept_id, event_date + s AS condition_start_date, end_date + s AS condition_end_date,
        CAST(NULL AS BIGINT) AS provider_id, source_value AS condition_source_value FROM condition_event JOIN (SELECT c_custkey, {SHIFT} AS s FROM (SELECT c_custkey, {_hmac_sql(KEY, "encode(CAST(c_custkey AS VARCHAR))")} AS h FROM customer)) ON c_custkey = person_id""",
    "policy_audit": """SELECT 'meta.mapping' AS "table", 'resource_id' AS "column", 'hmac' AS action, count(*) AS violations FROM orders WHERE o_orderkey % 100 = 0""",
    "k_anonymity": ctes("person") + """ SELECT CAST(8 AS INT) AS k, min(n) AS minimum_cell_size, count(*) FILTER (n < 8) AS groups_below_k, CAST(sum(n) AS BIGINT) AS patient_count FROM (
        SELECT CASE WHEN a >= 60 THEN 60 ELSE a // 20 END, gender_source_value, race_source_value, count(*) AS n FROM (SELECT *, greatest(0, 1998 - year_of_birth) AS a FROM person) GROUP BY 1, 2, 3)""",
    "table_hash_keys": """SELECT count(*) AS rows, sha256(concat_ws(',', count(*), """ + ", ".join(f"sum(CAST('0x' || substr(h, {1 + 15 * k}, 15) AS BIGINT))" for k in range(4)) + """)) AS fingerprint FROM (SELECT sha256('{"o_custkey":' || o_custkey ||
        ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') AS h FROM orders)""",
    "feature_counts": ctes("measurement_event") + """, c AS (SELECT person_id, CASE WHEN event_date < DATE '2024-01-15' THEN 'baseline' ELSE 'post' END || '|measurement|' || substr(source_value, 7) AS b, count(*) AS n
        FROM measurement_event WHERE datediff('day', DATE '2024-01-15', event_date) BETWEEN -365 AND 90 GROUP BY 1, 2)
        SELECT b || '|presence' AS feature, count(*) AS people, CAST(count(*) AS DOUBLE) AS total FROM c GROUP BY 1 UNION ALL SELECT b || '|log1p_count', count(*), sum(ln(1 + n)) FROM c GROUP BY 1""",
    "measurement_features": ctes("measurement_event") + """, g AS (SELECT person_id, substr(source_value, 7) AS k, last(value ORDER BY event_date, event_id) AS l, median(value) AS m,
        CASE WHEN count(*) >= 3 AND count(DISTINCT event_date) >= 2 THEN regr_slope(value, CAST(datediff('day', DATE '2024-01-15', event_date) AS DOUBLE)) END AS s FROM measurement_event WHERE event_date < DATE '2024-01-15' AND value IS NOT NULL GROUP BY 1, 2)
        SELECT person_id, 'baseline|measurement|' || k || '|latest_before_index' AS feature, l AS value FROM g UNION ALL SELECT person_id, 'baseline|measurement|' || k || '|median', m FROM g
        UNION ALL SELECT person_id, 'baseline|measurement|' || k || '|slope', s FROM g WHERE s IS NOT NULL AND k IN (SELECT k FROM g WHERE s IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)""",
    "robust_scaling": ctes("measurement_event") + """, c AS (SELECT person_id, 'baseline|measurement|' || substr(source_value, 7) || '|log1p_count' AS feature, ln(1 + count(*)) AS v FROM measurement_event
        WHERE datediff('day', DATE '2024-01-15', event_date) BETWEEN -365 AND -1 GROUP BY 1, 2), p AS (SELECT DISTINCT person_id FROM measurement_event),
        x AS (SELECT p.person_id, f.feature, coalesce(v, 0.0) AS v FROM p CROSS JOIN (SELECT DISTINCT feature FROM c) f LEFT JOIN c ON c.person_id = p.person_id AND c.feature = f.feature),
        q AS (SELECT feature, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS b FROM x GROUP BY 1)
        SELECT person_id, feature, CASE WHEN b > a THEN (v - m) / (b - a) ELSE v - m END AS value FROM x JOIN q USING (feature)""",
    "prevalence_floor": ctes("measurement_event") + """, n AS (SELECT count(DISTINCT person_id) AS n FROM measurement_event) SELECT 'baseline|measurement|' || substr(source_value, 7) AS base, count(DISTINCT person_id) AS people,
        count(DISTINCT person_id) * 1.0 / max(n) AS prevalence, count(DISTINCT person_id) >= greatest(3, ceil(0.02 * max(n))) AS kept FROM measurement_event, n WHERE datediff('day', DATE '2024-01-15', event_date) BETWEEN -3 AND -1 GROUP BY 1""",
    "trajectory_summary": ctes("measurement_event") + """ SELECT 'all' AS "group", CAST(datediff('day', DATE '2024-01-15', event_date) AS INT) AS time, avg(v) AS value, count(*) AS n_measurements, stddev_samp(v) AS standard_deviation, count(DISTINCT person_id) AS n_patients,
        avg(v) - 1.959963984540054 * stddev_samp(v) / sqrt(count(*)) AS lower, avg(v) + 1.959963984540054 * stddev_samp(v) / sqrt(count(*)) AS upper
        FROM (SELECT *, CASE unit WHEN 'g/L' THEN value * 100 ELSE value END AS v FROM measurement_event) WHERE v IS NOT NULL GROUP BY 2""",
    "measurement_summary": ctes("measurement_event") + " SELECT (SELECT list_sort(list(DISTINCT unit)) FROM measurement_event) AS measurement_units, median(n) AS median_measurements FROM (SELECT count(*) AS n FROM measurement_event GROUP BY person_id)",
    "guardrail_rules": with_ctes("""SELECT 'a1' AS analysis_id, r AS rule, s AS severity FROM (SELECT count(*) AS n, count(*) FILTER (cohort_name = 'arm_a') AS a, count(*) FILTER (cohort_name = 'arm_b') AS b, coalesce(sum(any_o), 0) / 4.0 AS epv FROM outcomes),
        LATERAL (VALUES ('GLOBAL-MIN-N', CASE WHEN n < 10 THEN 'REFUSE' END), ('COMP-MIN-ARM', CASE WHEN least(a, b) < 5 THEN 'REFUSE' END), ('EPV-LOGISTIC', CASE WHEN epv < 5 THEN 'REFUSE' WHEN epv < 10 THEN 'WARN' END), ('UNCHECKED-FRACTION', 'WARN'), ('MULTIPLICITY', 'INFO')) AS t (r, s) WHERE s IS NOT NULL
        UNION ALL SELECT 'a2', r, s FROM (SELECT count(*) AS n, least(nullif(count(*) FILTER (cohort_name = 'arm_a'), 0), nullif(count(*) FILTER (cohort_name = 'arm_b'), 0)) AS m, nullif(count(*) FILTER (cohort_name = 'arm_a'), 0) AS a, coalesce(sum(any_o), 0) AS e FROM outcomes WHERE race_source_value = 'BUILDING' AND ethnicity_source_value = 'ASIA'),
        LATERAL (VALUES ('GLOBAL-MIN-N', CASE WHEN n < 10 THEN 'REFUSE' END), ('COMP-MIN-ARM', CASE WHEN m < 5 THEN 'REFUSE' END), ('CAUSAL-MIN', CASE WHEN a < 20 OR e < 10 THEN 'REFUSE' END), ('UNCHECKED-FRACTION', 'WARN')) AS t (r, s) WHERE s IS NOT NULL""", OUTCOMES),
    "iptw_effect": with_ctes(EFFECT, WEIGHTED),
    "balance": with_ctes(BALANCE, WEIGHTED),
    "latest_declarations": "SELECT 'out/' || (o_orderkey % 11) AS path, last(sha256(CAST(o_orderkey AS VARCHAR)) ORDER BY o_orderkey) AS sha256, max(o_orderkey) AS seq, last(o_orderpriority ORDER BY o_orderkey) AS step FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1",
    "last_status": "SELECT o_orderpriority AS step, last(CASE o_orderstatus WHEN 'P' THEN 'failed' ELSE 'ok' END ORDER BY o_orderkey) AS status, max(o_orderkey) AS seq FROM orders GROUP BY 1",
    "artifact_lineage": "SELECT 'out/' || (b.o_orderkey % 11) AS path, b.o_orderkey AS consumer, a.o_orderkey AS producer FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 11",
}
