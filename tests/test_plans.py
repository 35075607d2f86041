"""Plans: sides that a study's parameters bound are broadcast, so that events are not dealt by a handful of keys."""

import re

from cohortloom.operators import codesets, cohorts, eras, trajectory
from cohortloom.queries.cohorts import PLAN
from cohortloom.sources import tables
from cohortloom.testbed import load


def joins(df):
    """(keys of broadcast joins, keys of joins that deal both sides) of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    of = lambda kind: [re.sub(r"#\d+L?", "", k) for k in re.findall(kind + r" \[([^\]]*)\]", plan)]
    return of("BroadcastHashJoin"), of("SortMergeJoin")


def without_sizes(spark):
    """Spark's own size check set aside, as large inputs would."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def test_bounded_sides(spark, data):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    events, sets, people = load(spark, data, "domain_event"), load(spark, data, "code_set"), load(spark, data, "person")
    without_sizes(spark)
    try:
        matched = codesets.match_events(events.where("domain <> 'drug'"), sets)
        assert joins(matched) == (["domain, source_value", "domain, concept_id"], [])
        keyed = tables.written(matched.select("person_id", "code_set_name", "event_date"), "matched")
        sent, dealt = joins(cohorts.criterion_counts(keyed, cohorts.index_dates(people, keyed, PLAN), PLAN))
        assert "code_set_name" in sent and "code_set_name" not in dealt
        classes = spark.createDataFrame([("class#PROMO", "promo")], "source_value string, drug_class string")
        assert joins(eras.assign_class(load(spark, data, "condition_event"), classes)) == (["source_value"], [])
        units = spark.createDataFrame([("mg/dL", "mg/dL", 1.0, 0.0), ("g/L", "mg/dL", 100.0, 0.0)], "unit string, target string, multiplier double, offset double")
        assert joins(trajectory.harmonize_units(load(spark, data, "measurement_event"), units)) == (["unit"], [])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_larger_sides_shuffle(spark):
    rows = spark.range(50)
    assert "ResolvedHint" in tables.small(rows, 50)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in tables.small(rows, 49)._jdf.queryExecution().analyzed().toString()
