"""Study-level jobs: compositions of the operators that a user calls.

Every job takes DataFrames and parameters and returns named DataFrames, or for
closed forms small lists of rows. Nothing person-level reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom.functions import stats
from cohortloom.functions.columns import source_value
from cohortloom.operators import causal, compare, deid, describe, eras, features, ledger, matching, omop, survival, trajectory, windows
from cohortloom.operators.codesets import match_events
from cohortloom.operators.cohorts import Cohort, resolve_cohorts
from cohortloom.operators.resample import percentile_limits
from cohortloom.sources import fhir, tables
from cohortloom.sources.patched import PatchedTables


@dataclass(frozen=True)
class Analysis:
    """What the data summary must know of an analysis: outcomes are (code set, start, end, washout).

    arms are cohorts; adjustment and code_sets may name code sets; domains are those
    of its features.
    """

    analysis_id: str
    kind: str
    arms: tuple[str, ...] = ()
    outcomes: tuple[tuple[str, int, int, int], ...] = ()
    adjustment: tuple[str, ...] = ()
    code_sets: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()


def ingest(resources: DataFrame) -> dict[str, DataFrame]:
    """Unique resources, patient members, orphans, ambiguous resources and conflicts."""
    keyed = fhir.with_key(resources)
    unique, conflicts = fhir.dedupe(keyed)
    unique = tables.written(unique, "fhir-unique")
    return {"resources": unique, "conflicts": conflicts, **fhir.group_by_patient(unique)}


def latest_of_each(responses: DataFrame) -> DataFrame:
    """The response of each patient with the greatest bundle hash; whole responses are shuffled only if a patient has several."""
    if responses.groupBy("source_patient_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return responses
    return responses.groupBy("source_patient_id").agg(F.max_by(F.struct(*responses.columns), F.struct("bundle_hash")).alias("x")).select("x.*")


def materialize(responses: DataFrame, ledger_rows: DataFrame, table_names: list[str], resources: DataFrame | None = None, latest: bool = False) -> dict[str, DataFrame]:
    """Rekeyed, typed tables and sidecars of changed patients; a patient without exactly one person or with an id outside the block is a reject and holds up nobody.

    Ids of tables and mappings move into the patient's block, so that patients who
    share local ids keep rows of their own in every table and sidecar. A reject keeps
    the block that it had. resources adds meta.row_provenance from their tags; latest
    takes one response of each patient, whose state is then settled on keys alone.
    """
    from cohortloom.streaming.incremental import changed_patients

    reason = F.when(~F.coalesce(F.size("tables.person") == 1, F.lit(False)) | F.element_at("tables.person", 1)["person_id"].isNull(), "not exactly one person").when(omop.outside_block(responses, table_names), "id outside the block").otherwise(omop.mapping_problem(responses))
    told = responses.withColumn("_reason", reason)
    if latest:
        new = latest_of_each(tables.written(told, "responses"))
        states = tables.written(changed_patients(new.select("source_patient_id", "bundle_hash", "_reason"), ledger_rows), "states")
    else:
        new = states = tables.written(changed_patients(told, ledger_rows), "responses")
    blocks = tables.written(omop.allocate_blocks(states.where("_reason is null"), ledger_rows), "blocks")
    placed = tables.written(new.where("_reason is null").drop("_reason").join(blocks, "source_patient_id"), "placed-responses")
    out, bad = {}, None
    for name in table_names:
        rows = omop.unpack_table(placed, name.split(".")[1])
        typed, invalid = omop.coerce_dates(omop.rekey(rows, name), name)
        out[name] = typed.drop("id_offset", "source_patient_id")
        bad = invalid if bad is None else bad.unionByName(invalid)
    side = omop.sidecars(placed)
    if resources is not None:
        side["row_provenance"] = omop.row_provenance(side["mapping"], omop.resource_provenance(resources))
    person = F.element_at("tables.person", 1)["person_id"] + F.col("id_offset")
    done = placed.select("source_patient_id", "bundle_hash", F.lit("ok").alias("status"), "id_offset", person.alias("person_id"))
    known = ledger_rows.groupBy("source_patient_id").agg(F.max("id_offset").alias("id_offset"))
    failed = states.where("_reason is not null").select("source_patient_id", "bundle_hash", F.lit("failed").alias("status")).join(known, "source_patient_id", "left").withColumn("person_id", F.lit(None).cast("long"))
    rejects = states.where("_reason is not null").select("source_patient_id", F.col("_reason").alias("reason"))
    told = bad.withColumn("omop_table", F.substring_index("omop_table", ".", -1))
    return {**out, **{f"meta.{k}": v for k, v in side.items()}, "meta.invalid_date": told, "meta.ingest_patient": done.unionByName(failed), "rejects": rejects}


def load_batch(store: PatchedTables, responses: DataFrame, table_names: list[str], resources: DataFrame | None = None) -> DataFrame:
    """Materialises the changed patients of a batch and replaces them in the store's tables and sidecars; returns the rejects.

    Of several responses of a patient the one with the greatest bundle hash counts.
    A reject's earlier rows stay. The ledger is written last: a batch that failed
    before that is taken as new again.
    """
    before = tables.written(store.read("meta.ingest_patient"), "ledger")
    got = materialize(responses, before, table_names, resources, latest=True)
    told, rejects = tables.written(got.pop("meta.ingest_patient"), "told"), got.pop("rejects")
    kept = before.select("source_patient_id", F.col("person_id").alias("_person"))
    patients = told.where("status = 'ok'").select("source_patient_id", "id_offset", "person_id")
    # a person whose local id has changed: the old rows go as well
    old = before.join(patients.select("source_patient_id"), "source_patient_id", "left_semi").select("source_patient_id", "id_offset", "person_id")
    store.replace(tables.written(patients.unionByName(old).distinct(), "replaced"), got)
    rows = told.join(kept, "source_patient_id", "left").withColumn("person_id", F.coalesce("person_id", "_person"))
    store.replace(told.select("source_patient_id", "id_offset", "person_id"), {"meta.ingest_patient": rows})
    return rejects


#: Coded FHIR types with the table that they fill and the paths of code and start.
CODED = {
    "Condition": ("condition_occurrence", "$.code.coding", "$.onsetDateTime"),
    "MedicationRequest": ("drug_exposure", "$.medicationCodeableConcept.coding", "$.authoredOn"),
    "Procedure": ("procedure_occurrence", "$.code.coding", "$.performedDateTime"),
    "Observation": ("observation", "$.code.coding", "$.effectiveDateTime"),
    "Encounter": ("visit_occurrence", "$.type[0].coding", "$.period.start"),
}


def flatten_fhir(resources: DataFrame, concept_map: DataFrame) -> DataFrame:
    """Coded resources as OMOP-shaped rows: omop_table, source_value ``system#code``, value and unit; concept 0 where the map lacks the code.

    An Observation with a quantity is a measurement.
    """
    kind, at = F.col("resource_type"), lambda path: F.get_json_object("body", path)
    pick = lambda k: F.coalesce(*[F.when(kind == t, F.lit(spec[0]) if k == 0 else at(spec[k])) for t, spec in CODED.items()])
    quantity = at("$.valueQuantity.value")
    rows = resources.where(kind.isin(*CODED)).select(
        F.col("id").alias("resource_id"), F.when((kind == "Observation") & quantity.isNotNull(), "measurement").otherwise(pick(0)).alias("omop_table"),
        fhir.normalize_reference(F.coalesce(at("$.subject.reference"), at("$.patient.reference"))).alias("patient"), pick(2).alias("start"), quantity.try_cast("double").alias("value"), at("$.valueQuantity.unit").alias("unit"),
        F.explode(F.from_json(pick(1), "array<struct<system: string, code: string>>")).alias("c"),
    )
    rows = rows.select("resource_id", "omop_table", F.substring_index("patient", "/", -1).alias("source_patient_id"), "start", "value", "unit", F.col("c.system").alias("source_system"), F.col("c.code").alias("source_code"))
    return omop.code_to_concept(rows, concept_map).withColumn("source_value", source_value(F.coalesce("source_system", F.lit("")), F.col("source_code")))


def enrich(resources: DataFrame, extracted: DataFrame) -> dict[str, DataFrame]:
    """Distinct documents to process, failures, and extracted resources tagged and given to every referrer.

    extracted: document_hash, resource_type, id, body, pages.
    """
    good, bad = fhir.extract_attachments(resources)
    tagged = fhir.tag_enriched(extracted.join(good.select(F.col("id").alias("doc_ref_id"), "document_hash"), "document_hash"))
    return {"documents": fhir.distinct_documents(good), "failures": bad, "resources": tagged}


def comparison_frame(persons: DataFrame, events: DataFrame, code_sets: DataFrame, periods: DataFrame, cohorts: list[Cohort]) -> tuple[DataFrame, DataFrame]:
    """(frame of the included with observation window, matched events)."""
    rows, _ = resolve_cohorts(persons, events, code_sets, cohorts)
    return windows.with_observation(windows.cohort_frame(rows, persons), periods), match_events(events, code_sets)


def table_one(frame: DataFrame, numeric: list[str], categories: list[str], group: str = "cohort_name", threshold: int = 5) -> dict[str, DataFrame]:
    groups = [r[0] for r in frame.select(group).distinct().orderBy(group).limit(3).collect()]
    out = {"continuous": describe.continuous(frame, numeric, group)} if numeric else {}
    if categories:
        out["categorical"] = describe.categorical(frame, categories, group, threshold)
    if len(groups) == 2:
        out["smd"] = describe.smd(frame, numeric, categories, group, *groups)
    return out


def cohort_compare(frame: DataFrame, outcomes: list[str], exposed: str, comparator: str, adjustment: list[str] | None = None, correction: str = "auto_bh", exact_test: str = "fisher", permutations: int = 10_000, replicates: int = 2000, seed: int = 1) -> DataFrame:
    """One row per outcome: outcome_type, arm counts, estimand, estimate, limits, p_value, permutation_p_value, adjusted odds ratio, method, q_value.

    Binary outcomes: conditional odds ratio with an exact test. Continuous ones:
    Mann-Whitney, permutation test and Hodges-Lehmann shift with bootstrap limits.
    correction is ``auto_bh``, ``bh`` or ``none``; several outcomes need one.
    """
    if correction not in ("auto_bh", "bh", "none") or (len(outcomes) > 1 and correction == "none"):
        raise ValueError("several outcomes need a correction: auto_bh or bh")
    group = "cohort_name"
    rows = tables.written(frame.where(F.col(group).isin(exposed, comparator)), "compared")  # each test reads it
    kinds = {r["outcome"]: r["outcome_type"] for r in compare.outcome_types(rows, outcomes).collect()}
    binary = [o for o in outcomes if kinds.get(o) == "binary"]
    tested = {r["outcome"]: r for r in compare.exact_tests(compare.two_by_two(rows, binary, group, exposed, comparator), exact_test).collect()} if binary else {}
    out = []
    for k, o in enumerate(outcomes):
        row = {"outcome": o, "outcome_type": kinds.get(o), "exposed": exposed, "comparator": comparator}
        if o in tested:
            t = tested[o]
            row |= {"n_exposed": t["n_exposed"], "n_comparator": t["n_comparator"], "events_exposed": t["events_exposed"], "events_comparator": t["events_comparator"], "estimand": "odds_ratio", "estimate": t["odds_ratio"], "lower": t["or_lower"], "upper": t["or_upper"], "p_value": t["p_value"], "method": exact_test}
            if adjustment:
                got = compare.adjusted_odds_ratio(rows, o, group, exposed, adjustment)
                row |= {f"adjusted_{x}": got[x] for x in ("estimate", "lower", "upper", "p_value")}
        elif kinds.get(o) == "continuous":
            ranks = compare.rank_sums(rows, o, group, exposed, comparator).first()
            low, high = compare.hodges_lehmann_limits(rows, o, group, exposed, comparator, replicates, seed + k)
            row |= {"n_exposed": ranks["n1"], "n_comparator": ranks["n2"], "estimand": "hodges_lehmann_shift", "estimate": compare.hodges_lehmann(rows, o, group, exposed, comparator).first()["shift"], "lower": low, "upper": high, "p_value": stats.normal_p(ranks["z"]) if ranks["z"] is not None else None, "method": "mann_whitney", "permutation_p_value": compare.permutation_p(rows, o, group, exposed, permutations, seed + k)}
        out.append(row)
    fields = "outcome string, outcome_type string, exposed string, comparator string, n_exposed long, events_exposed long, n_comparator long, events_comparator long, estimand string, estimate double, lower double, upper double, p_value double, permutation_p_value double, adjusted_estimate double, adjusted_lower double, adjusted_upper double, adjusted_p_value double, method string"
    names = [f.split()[0] for f in fields.split(", ")]
    data = frame.sparkSession.createDataFrame([tuple(r.get(n) for n in names) for r in out], fields)
    return compare.benjamini_hochberg(data) if correction == "bh" or (correction == "auto_bh" and len(outcomes) > 1) else data.withColumn("q_value", F.lit(None).cast("double"))


def survival_analysis(frame: DataFrame, outcome: DataFrame, exposed: str, comparator: str, horizon: float, max_days: int | None = None, censor: DataFrame | None = None, covariates: list[str] | None = None, ridge: float | None = None, replicates: int = 1000, seed: int = 1) -> dict:
    """Curves with medians, RMST with the limits of its difference, log-rank test and Cox model of two cohorts."""
    data = survival.survival_frame(frame, outcome, None, max_days, censor).withColumn("group", F.col("cohort_name")).withColumn("exposed", (F.col("cohort_name") == exposed).cast("int"))
    data = tables.written(data, "survival")
    curve = tables.written(survival.kaplan_meier(data), "curve")
    rmst = survival.restricted_mean(curve, horizon)
    low, high = survival.rmst_difference_limits(data, exposed, comparator, horizon, replicates=replicates, seed=seed)
    on = lambda g: F.max(F.when(F.col("group") == g, F.col("rmst")))
    difference = rmst.agg((on(exposed) - on(comparator)).alias("estimate")).select("estimate", F.lit(low).alias("lower"), F.lit(high).alias("upper"))
    ridge = (0.1 if data.count() < 200 else 0.0) if ridge is None else ridge
    return {
        "data": curve, "summary": survival.median_survival(curve), "rmst": rmst, "rmst_difference": difference, "log_rank": survival.log_rank(data, exposed),
        "cox": frame.sparkSession.createDataFrame([tuple(r.values()) for r in survival.cox(data, ["exposed", *(covariates or [])], ridge)], "term string, estimate double, lower double, upper double, p_value double, ph_statistic double, ph_p_value double"),
    }


def incidence_rate(frame: DataFrame, outcome: DataFrame, exposed: str, comparator: str) -> dict:
    rates = compare.incidence(frame, outcome)
    return {"data": compare.incidence_intervals(rates), "ratio": compare.incidence_ratio(rates, exposed, comparator)}


def treatment_pathways(frame: DataFrame, exposures: DataFrame, gap_days: int = 30, max_lines: int = 3) -> dict[str, DataFrame]:
    """Pathways of exposures on or after the index date."""
    after = exposures.join(frame.select("person_id", "index_date"), "person_id").where("event_date >= index_date").drop("index_date")
    found = eras.drug_eras(after, gap_days)
    lines = eras.therapy_lines(found, max_lines)
    return {"eras": found, "patient_sequences": lines, "data": eras.pathway_counts(lines), "time_to_switch": eras.time_to_switch(lines, max_lines)}


def trajectory_analysis(frame: DataFrame, measurements: DataFrame, conversions: DataFrame, replicates: int = 1000, mixed: bool = False, exposed: str | None = None) -> dict:
    """Individual and summary rows with bootstrap limits; mixed adds the random-intercept model, by group if an exposed one is named."""
    rows = trajectory.relative_times(frame, trajectory.harmonize_units(measurements, conversions))
    limits = trajectory.bootstrap_means(rows, replicates)
    summary = trajectory.summarise(rows).drop("lower", "upper").join(limits, ["group", "time"], "left")
    out = {"data": trajectory.output_rows(rows, summary)}
    if mixed:
        out["mixed_model"] = trajectory.random_intercept(rows, exposed=exposed)
    return out


def feature_matrix(frame: DataFrame, keyed: DataFrame, measurements: DataFrame, spans: dict[str, tuple[int, int]] | None = None, numeric: list[str] | None = None, categories: list[str] | None = None, floor: int | None = None) -> dict:
    """The scaled matrix (cells and columns), its hash, presence cells, dropped features and the mapping statuses behind the features.

    numeric and categories are demographic columns of frame; they have no floor.
    """
    spans = spans or {"baseline": (-365, -1), "post": (0, 90)}
    people = frame.select("person_id")
    n = people.count()
    rows = features.windowed(frame, keyed, spans)
    kept, dropped = features.apply_floor(features.feature_counts(rows).unionByName(features.measurement_features(frame, measurements)), n, floor)
    if numeric or categories:
        kept = kept.unionByName(features.demographic_cells(frame, numeric or [], categories or []))
    kept = tables.written(kept, "cells")
    cells, columns = features.scaled_matrix(kept, n)
    cells = tables.written(cells, "scaled")
    return {"cells": cells, "columns": columns, "matrix_hash": features.matrix_hash(cells, columns, people), "presence": kept.where("feature like '%|presence'"), "dropped": dropped, "feature_provenance": features.feature_provenance(rows)}


def patient_signature(frame: DataFrame, keyed: DataFrame, measurements: DataFrame, spans: dict[str, tuple[int, int]] | None = None, clusters: int = 8, min_size: int = 5, seeds=(1, 2, 3), numeric: list[str] | None = None, categories: list[str] | None = None) -> dict:
    """Feature matrix with its hash, SVD coordinates, clusters with medoids, characterisation and stability over seeds."""
    matrix = feature_matrix(frame, keyed, measurements, spans, numeric, categories)
    points = tables.written(features.truncated_svd((matrix["cells"], matrix["columns"]), frame.select("person_id")), "points")
    labelled = [tables.written(features.cluster(points, clusters, min_size, s), "clusters") for s in seeds]
    ari = [features.adjusted_rand(labelled[i].select("person_id", F.col("cluster").alias("a")).join(labelled[j].select("person_id", F.col("cluster").alias("b")), "person_id")).first()["ari"] for i in range(len(seeds)) for j in range(i)]
    tests = compare.benjamini_hochberg(compare.exact_tests(features.cluster_tables(labelled[0].select("person_id", "cluster"), matrix["presence"]).withColumn("outcome", F.col("feature"))), by=["cluster"])
    place = lambda k: F.coalesce(F.get("coords", F.lit(k)), F.lit(0.0))
    data = labelled[0].select("person_id", place(0).alias("pc_1"), place(1).alias("pc_2"), "cluster")
    told = {k: matrix[k] for k in ("cells", "columns", "matrix_hash", "feature_provenance", "dropped")}
    return {"data": data, "medoids": features.medoids(labelled[0]), "characterization": tests, "stability": sum(ari) / len(ari) if ari else None, **told}


def causal_effect(frame: DataFrame, outcome: str, exposed: str, covariates: list[str], method: str = "iptw", estimand: str = "ate", replicates: int = 500, seed: int = 1) -> dict:
    """Effect with bootstrap limits and E-value (of the risk ratio, or of the standardised difference of a continuous outcome), balance and scores. iptw: every replicate refits the whole adjustment; ps_matching: matched pairs are resampled."""
    rows = frame.where(F.col(outcome).isNotNull())
    scored, terms = causal.propensity_design(rows, exposed, covariates)
    scored = tables.written(scored, "propensity")
    if method == "ps_matching":
        pairs = tables.written(matching.match(scored), "pairs")
        ids = pairs.select(F.col("exposed_id").alias("person_id")).union(pairs.select(F.col("comparator_id").alias("person_id")))
        weighted = tables.written(scored.join(ids, "person_id").withColumn("weight", F.lit(1.0)), "weighted")
        limits = {"difference": causal.bootstrap_pairs(scored, pairs, outcome, replicates, seed), "ratio": (None, None)}
    else:
        weighted = tables.written(causal.weights(scored, estimand), "weighted")
        reps = tables.written(causal.bootstrap_effect(scored, list(terms), outcome, estimand, replicates=replicates, seed=seed), "replicates")
        limits = {"difference": percentile_limits(reps.select("rep", F.col("difference").alias("x")), replicates), "ratio": percentile_limits(reps.select("rep", F.col("ratio").alias("x")), replicates)}
    got = causal.effect(weighted, outcome)
    kind = compare.outcome_types(scored, [outcome]).first()["outcome_type"]
    spread = weighted.agg(F.stddev_samp(F.col(outcome).cast("double"))).first()[0] or 0.0
    bound = lambda k, i: F.lit(limits[k][i]).cast("double")
    low, high = bound("ratio", 0), bound("ratio", 1)
    if kind == "binary":
        e_value, e_limit, basis = stats.e_value(F.col("ratio")), stats.e_value_limit(F.col("ratio"), low, high), "risk_ratio"
    else:
        e_value = stats.e_value_continuous(F.col("difference"), F.lit(float(spread))) if spread > 0 else F.lit(1.0)
        e_limit, basis = F.lit(None).cast("double"), "standardized_mean_difference"
    data = got.select(
        "*", bound("difference", 0).alias("lower"), bound("difference", 1).alias("upper"), low.alias("ratio_lower"), high.alias("ratio_upper"), e_value.alias("e_value"), e_limit.alias("e_value_limit"), F.lit(basis).alias("e_value_basis"),
    )
    named = weighted.select("treated", "weight", *[F.col(c).alias(t) for c, t in terms.items()])
    return {"data": data, "balance": causal.balance(named, list(terms.values())), "propensity": weighted.select("person_id", F.col("cohort_name").alias("group"), "propensity_score", "weight")}


def export(shared: dict[str, DataFrame], entries: DataFrame, allowed: DataFrame, folder: str, results: DataFrame | None = None, endpoints: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Checks the results, then audits and writes the shared tables; returns inventory, shareable ledger and problems.

    results (path, sha256, input_path, input_sha256): every result must be the
    latest output of a successful entry that read exactly those inputs. With a
    problem nothing is written.
    """
    spark = entries.sparkSession
    problems = spark.createDataFrame([], "path string, problem string")
    if results is not None:
        produced = ledger.declaring_entry(entries, results)
        latest = ledger.latest_declarations(entries).select("path", F.col("sha256").alias("told"), F.col("seq").alias("told_seq"))
        joined = results.select("path", "sha256").distinct().join(produced, "path", "left").join(latest, "path", "left")
        problem = F.when(F.col("seq").isNull(), "no_producer").when((F.col("told") != F.col("sha256")) | (F.col("told_seq") > F.col("seq")), "superseded")
        problems = joined.select("path", problem.alias("problem")).where("problem is not null")
        if not problems.isEmpty():
            return {"problems": problems}
    deid.export_parquet(shared, folder)
    return {"inventory": tables.payload_inventory(spark, folder), "ledger": ledger.shareable(entries, allowed, endpoints), "problems": problems}


#: The table of each clinical domain.
DOMAIN_TABLES = {
    "condition": "condition_occurrence",
    "drug": "drug_exposure",
    "procedure": "procedure_occurrence",
    "measurement": "measurement",
    "observation": "observation",
    "visit": "visit_occurrence",
}


def analysis_scope(spark: SparkSession, analyses: list[Analysis], cohorts: list[Cohort]) -> DataFrame:
    """(analysis_id, code_set_name, omop_table): every code set and table whose mappings can affect an analysis.

    Code sets of the outcomes, covariates and the analysis's own, of the criteria and
    index rule of its cohorts; tables of the domains of its features. Names that are
    no code sets match nothing.
    """
    rows = []
    for a in analyses:
        names = {o[0] for o in a.outcomes} | set(a.adjustment) | set(a.code_sets)
        for c in cohorts:
            if c.name in a.arms:
                names |= {x.code_set for x in (*c.inclusion, *c.exclusion)} | ({c.index_set} if c.index_set else set())
        rows += [(a.analysis_id, name, None) for name in sorted(names)] + [(a.analysis_id, None, DOMAIN_TABLES[d]) for d in a.domains]
        rows.append((a.analysis_id, None, None))
    return spark.createDataFrame(rows, "analysis_id string, code_set_name string, omop_table string")


def data_summary(frame: DataFrame, matched: DataFrame, analyses: list[Analysis], unchecked: DataFrame | None = None, measurements: DataFrame | None = None) -> DataFrame:
    """One row per analysis with the counts that the guardrails read; of several outcomes the least counts stand.

    frame: everyone included with the observation window; unchecked: (analysis_id,
    unchecked_fraction); measurements: (analysis_id, person_id, unit).
    """
    spark = frame.sparkSession
    wanted = {f"{a.analysis_id}|{k}": (a, o) for a in analyses for k, o in enumerate(a.outcomes)}
    flagged = windows.incident_outcomes(frame, matched, {name: o for name, (_, o) in wanted.items()}) if wanted else frame
    entry = lambda a, k, y: F.struct(F.lit(a.analysis_id).alias("analysis_id"), F.lit(k).alias("k"), F.col("cohort_name").alias("arm"), y.alias("y"))
    each = []
    for a in analyses:
        mine = F.col("cohort_name").isin(*a.arms) if a.arms else F.lit(True)
        for k in range(max(1, len(a.outcomes))):
            y = F.col(f"`{a.analysis_id}|{k}`") if a.outcomes else F.lit(None).cast("int")
            counted = y.isNotNull() if a.outcomes else F.lit(True)
            each.append(F.when(mine & counted, entry(a, k, y)))
    long = flagged.select(F.explode(F.array_compact(F.array(*each))).alias("x")).select("x.*")
    spine = spark.createDataFrame([(a.analysis_id, a.kind, k, arm) for a in analyses for k in range(max(1, len(a.outcomes))) for arm in (a.arms or [None])], "analysis_id string, kind string, k int, arm string")
    per = long.groupBy("analysis_id", "k", "arm").agg(F.count("*").alias("n"), F.sum("y").alias("e"))
    joined = spine.where("arm is not null").join(per, ["analysis_id", "k", "arm"], "left").unionByName(spine.where("arm is null").drop("arm").join(per, ["analysis_id", "k"]).select("analysis_id", "k", "arm", "kind", "n", "e"))
    least = joined.groupBy("analysis_id", "kind", "arm").agg(F.min(F.coalesce("n", F.lit(0))).alias("n"), F.min(F.coalesce("e", F.lit(0))).alias("e"))
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("arm", c))))
    out = least.groupBy("analysis_id", "kind").agg(F.sum("n").alias("total_n"), entries("n").alias("arm_n"), F.sum("e").alias("events_total"), entries(F.least("e", "n").alias("e")).alias("events_by_arm"))
    facts = spark.createDataFrame([(a.analysis_id, len(a.adjustment) + 1 if a.adjustment else None, len(a.outcomes) or None) for a in analyses], "analysis_id string, model_parameters int, outcomes int")
    out = out.join(facts, "analysis_id")
    if unchecked is not None:
        out = out.join(unchecked, "analysis_id", "left")
    if measurements is not None:
        per = measurements.groupBy("analysis_id", "person_id").agg(F.count("*").alias("c"), F.collect_set("unit").alias("u"))
        out = out.join(per.groupBy("analysis_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("u")))).alias("measurement_units"), F.median("c").alias("median_measurements")), "analysis_id", "left")
    return out


# ---------------------------------------------------------------- plot data


def risk_at_ticks(curve: DataFrame, ticks: int = 5) -> DataFrame:
    """(group, tick, at_risk): the number at risk at evenly spaced times, from the last curve row at or before each."""
    top = curve.agg(F.max("time").alias("top"))
    spine = curve.select("group").distinct().crossJoin(top).select("group", F.explode(F.transform(F.sequence(F.lit(0), F.lit(ticks - 1)), lambda k: k * F.col("top") / (ticks - 1))).alias("tick"))
    joined = spine.join(curve.select(F.col("group").alias("g"), "time", F.col("at_risk").alias("n")), (F.col("group") == F.col("g")) & (F.col("time") <= F.col("tick")), "left")
    return joined.groupBy("group", "tick").agg(F.min("n").alias("at_risk"))


def forest_rows(estimates: DataFrame) -> DataFrame:
    """Rows with a complete interval."""
    return estimates.where("estimate is not null and lower is not null and upper is not null")


def coverage_shares(coverage: DataFrame) -> DataFrame:
    """(omop_table, one column per status) shares of a table's mappings."""
    share = coverage.where("omop_table is not null").withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("omop_table")))
    return share.groupBy("omop_table").pivot("mapping_status", ["ALREADY_STANDARD", "MAPPED", "UNMAPPED", "UNCHECKED"]).agg(F.first("share")).fillna(0.0)


def love_plot(balance: DataFrame) -> DataFrame:
    """(covariate, smd_before, smd_after, worst) with absolute differences, the covariate with the largest first by ``place``."""
    rows = balance.select("covariate", F.abs("smd_before").alias("smd_before"), F.abs("smd_after").alias("smd_after"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("smd_before"), "covariate")))  # one row per covariate


def attrition_steps(attrition: DataFrame) -> DataFrame:
    """(cohort_name, stage_order, stage, remaining, share): what is left of the source population at each stage."""
    whole = F.first("remaining").over(Window.partitionBy("cohort_name").orderBy("stage_order"))
    return attrition.select("cohort_name", "stage_order", "stage", "remaining", F.when(whole > 0, F.col("remaining") / whole).alias("share"))


def trajectory_means(rows: DataFrame) -> DataFrame:
    """(group, time, value, lower, upper) of the summary rows."""
    return rows.where("row_type = 'summary'").select("group", "time", "value", "lower", "upper")
