"""Guardrails: rules over aggregate summaries, one row per analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Thresholds of the rules.
MIN_TOTAL, MIN_ARM = 10, 5
EPV_REFUSE, EPV_WARN = 5, 10
MIN_ARM_EVENTS = 5
MAP_REFUSE, MAP_WARN = 30, 100
UNCHECKED_WARN, UNCHECKED_REFUSE = 0.2, 0.5
MIXED_PATIENTS, MIXED_ROWS = 30, 3
CAUSAL_EXPOSED, CAUSAL_EVENTS = 20, 10
COMPARATIVE = ("cohort_compare", "survival", "incidence_rate", "causal_effect")


def evaluate(summary: DataFrame) -> DataFrame:
    """(analysis_id, rule, severity) of all rules that fire.

    summary: analysis_id, kind, total_n, arm_n map, events_total, events_by_arm
    map, model_parameters, unchecked_fraction, measurement_units array,
    median_measurements, exposed_n, and the static facts adjusted, covariates,
    covariates_without_rationale, cox, mixed_model, unit_map, censor_rule,
    unchecked_override, outcomes, multiplicity, code_sets_approved. Missing
    counts fire nothing.
    """
    kind = F.col("kind")
    comparative = kind.isin(*COMPARATIVE)
    least = lambda m: F.array_min(F.map_values(m))
    parameters = F.coalesce("model_parameters", F.when(F.col("adjusted"), F.coalesce("covariates", F.lit(0)) + 1))
    epv = F.when(F.col("adjusted") & (parameters > 0), F.col("events_total") / parameters)
    share, override = F.col("unchecked_fraction"), F.coalesce("unchecked_override", F.lit(False))
    rules = [
        ("GLOBAL-MIN-N", comparative & (F.col("total_n") < MIN_TOTAL), "REFUSE"),
        ("COMP-MIN-ARM", comparative & (least("arm_n") < MIN_ARM), "REFUSE"),
        ("EPV-LOGISTIC", (kind == "cohort_compare") & (epv < EPV_REFUSE), "REFUSE"),
        ("EPV-LOGISTIC", (kind == "cohort_compare") & (epv >= EPV_REFUSE) & (epv < EPV_WARN), "WARN"),
        ("SURV-CENSOR", (kind == "survival") & F.col("censor_rule").isNull(), "REFUSE"),
        ("SURV-EVENTS", (kind == "survival") & F.col("cox") & (least("events_by_arm") < MIN_ARM_EVENTS), "REFUSE"),
        ("UMAP-MIN-N", (kind == "patient_signature") & (F.col("total_n") < MAP_REFUSE), "REFUSE"),
        ("UMAP-MIN-N", (kind == "patient_signature") & (F.col("total_n") >= MAP_REFUSE) & (F.col("total_n") < MAP_WARN), "WARN"),
        ("UNCHECKED-FRACTION", (share > UNCHECKED_REFUSE) & ~override, "REFUSE"),
        ("UNCHECKED-FRACTION", (share > UNCHECKED_WARN) & ((share <= UNCHECKED_REFUSE) | override), "WARN"),
        ("MEAS-UNITS", (kind == "trajectory") & (F.size("measurement_units") > 1) & ~F.coalesce("unit_map", F.lit(False)), "REFUSE"),
        ("TRAJ-MIXED-MIN", (kind == "trajectory") & F.col("mixed_model") & ((F.col("total_n") < MIXED_PATIENTS) | (F.col("median_measurements") < MIXED_ROWS)), "REFUSE"),
        ("CAUSAL-ADJUSTMENT", (kind == "causal_effect") & ((F.coalesce("covariates", F.lit(0)) == 0) | (F.coalesce("covariates_without_rationale", F.lit(0)) > 0)), "REFUSE"),
        ("CAUSAL-MIN", (kind == "causal_effect") & ((F.col("exposed_n") < CAUSAL_EXPOSED) | (F.col("events_total") < CAUSAL_EVENTS)), "REFUSE"),
        ("MULTIPLICITY", (kind == "cohort_compare") & (F.col("outcomes") > 1) & (F.col("multiplicity") == "none"), "REFUSE"),
        ("MULTIPLICITY", (kind == "cohort_compare") & (F.col("outcomes") > 1) & (F.col("multiplicity") != "none"), "INFO"),
        ("CODESET-APPROVAL", ~F.coalesce("code_sets_approved", F.lit(True)), "REFUSE"),
    ]
    fired = [F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))) for rule, test, severity in rules]
    return summary.select("analysis_id", F.explode(F.array_compact(F.array(*fired))).alias("r")).select("analysis_id", "r.*")


def arm_summary(frame: DataFrame, outcome: str, analysis_id: str, kind: str, group: str = "cohort_name") -> DataFrame:
    """total_n, arm_n, events_total and events_by_arm of one analysis; missing outcomes count for no arm's events."""
    y = F.coalesce(F.col(outcome).cast("int"), F.lit(0))
    per = frame.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"), F.sum(y).alias("e"))
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("g", c))))
    return per.agg(F.sum("n").alias("total_n"), entries("n").alias("arm_n"), F.sum("e").alias("events_total"), entries("e").alias("events_by_arm")).select(F.lit(analysis_id).alias("analysis_id"), F.lit(kind).alias("kind"), "*")


def measurement_summary(measurements: DataFrame) -> DataFrame:
    """One row (measurement_units, median_measurements): units seen and the median of rows per person."""
    per = measurements.groupBy("person_id").agg(F.count("*").alias("n")).agg(F.median("n").alias("median_measurements"))
    units = measurements.agg(F.array_sort(F.collect_set("unit")).alias("measurement_units"))
    return units.crossJoin(per)


def unchecked_fraction(mapping: DataFrame, code_sets: DataFrame, tables: list[str] | None = None) -> DataFrame:
    """One row (rows, unchecked_fraction) over the mapping rows of the code sets' codings or of the named tables."""
    codings = code_sets.select("source_system", "source_code", F.lit(True).alias("_coded")).distinct()
    held = F.col("_coded").isNotNull() | F.coalesce(F.col("omop_table").isin(*(tables or [])), F.lit(False))
    scoped = mapping.join(codings, ["source_system", "source_code"], "left").where(held)
    return scoped.agg(F.count("*").alias("rows"), F.avg((F.col("mapping_status") == "UNCHECKED").cast("double")).alias("unchecked_fraction"))


def unchecked_by_analysis(mapping: DataFrame, code_sets: DataFrame, scope: DataFrame) -> DataFrame:
    """(analysis_id, rows, unchecked_fraction): of the mapping rows of any coding or table that an analysis draws on; 0 where there is none.

    scope: analysis_id, code_set_name, omop_table (one of the two in a row, both null
    for an analysis without a scope). Only accepted codings count. Mappings are
    counted per coding, table and status first; every analysis then meets counts.
    """
    counts = mapping.groupBy("source_system", "source_code", "omop_table").agg(F.count("*").alias("n"), F.count_if(F.col("mapping_status") == "UNCHECKED").alias("unchecked"))
    accepted = code_sets.where("accepted").select("code_set_name", "source_system", "source_code")
    codings = scope.where("code_set_name is not null").join(accepted, "code_set_name").select("analysis_id", "source_system", "source_code").distinct()
    whole = scope.where("omop_table is not null").select("analysis_id", "omop_table").distinct()
    hits = counts.join(codings, ["source_system", "source_code"]).unionByName(counts.join(whole, "omop_table")).distinct()
    per = hits.groupBy("analysis_id").agg(F.sum("n").alias("rows"), F.sum("unchecked").alias("unchecked"))
    joined = scope.select("analysis_id").distinct().join(per, "analysis_id", "left")
    return joined.select("analysis_id", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce(F.col("unchecked") / F.col("rows"), F.lit(0.0)).alias("unchecked_fraction"))
