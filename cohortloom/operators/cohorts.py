"""Cohort resolution: index dates, criteria and attrition of all cohorts in one pass."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.columns import demographic_reason
from cohortloom.operators.codesets import match_events
from cohortloom.sources.tables import written


@dataclass(frozen=True)
class Criterion:
    """At least min_count events of a code set; before/after bound the days around the index date (None: open)."""

    code_set: str
    min_count: int = 1
    window: tuple[int | None, int | None] | None = None
    anchor: str = "index_date"

    def __post_init__(self):
        if self.anchor != "index_date":
            raise ValueError(f"unsupported anchor {self.anchor!r}; only index_date is available")


@dataclass(frozen=True)
class Cohort:
    name: str
    index_set: str | None = None
    strategy: str = "first_occurrence"
    fixed_date: str | None = None
    inclusion: tuple[Criterion, ...] = ()
    exclusion: tuple[Criterion, ...] = ()
    demographics: dict = field(default_factory=dict)

    def stages(self) -> list[tuple[str, str | None]]:
        """(stage, detail) in the order in which people are taken out."""
        out = [] if self.strategy == "fixed_date" else [("missing_index_date", None)]
        out += [(f"inclusion:{c.code_set}", f"required count >= {c.min_count}") for c in self.inclusion]
        out.append(("demographics", None))
        return out + [(f"exclusion:{c.code_set}", f"excluded at count >= {c.min_count}") for c in self.exclusion]


def index_dates(persons: DataFrame, matched: DataFrame, cohorts: list[Cohort]) -> DataFrame:
    """(cohort_name, person_id, index_date) for every person and cohort; null where a person has no index event."""
    spark = persons.sparkSession
    rules = spark.createDataFrame([(c.name, c.index_set, c.strategy, c.fixed_date) for c in cohorts], "cohort_name string, index_set string, strategy string, fixed string")
    everyone = persons.select("person_id").crossJoin(F.broadcast(rules))
    dates = matched.groupBy("code_set_name", "person_id").agg(F.min("event_date").alias("first"), F.max("event_date").alias("last"))
    joined = everyone.join(dates.withColumnRenamed("code_set_name", "index_set"), ["index_set", "person_id"], "left")
    chosen = F.when(F.col("strategy") == "fixed_date", F.to_date("fixed")).when(F.col("strategy") == "last_occurrence", F.col("last")).otherwise(F.col("first"))
    return joined.select("cohort_name", "person_id", chosen.alias("index_date"))


def criterion_counts(matched: DataFrame, indexes: DataFrame, cohorts: list[Cohort]) -> DataFrame:
    """(cohort_name, person_id, counts map<criterion number, events>) over inclusions then exclusions, in one aggregation.

    Criteria without a window count null-dated events too; windows are inclusive
    and need an index date. The criteria are as many as the plan has, so events are
    not dealt by the few code sets.
    """
    spark = matched.sparkSession
    rows = []
    for c in cohorts:
        for k, x in enumerate((*c.inclusion, *c.exclusion)):
            before, after = x.window or (None, None)
            rows.append((c.name, k, x.code_set, x.window is not None, before, after))
    criteria = spark.createDataFrame(rows, "cohort_name string, k int, code_set_name string, windowed boolean, before int, after int")
    wanted = matched.select("person_id", "code_set_name", "event_date").join(F.broadcast(criteria), "code_set_name").join(indexes, ["cohort_name", "person_id"])
    day = F.datediff("event_date", "index_date")
    inside = (F.col("before").isNull() | (day >= -F.col("before"))) & (F.col("after").isNull() | (day <= F.col("after"))) & day.isNotNull()
    counted = wanted.groupBy("cohort_name", "person_id", "k").agg(F.count_if(~F.col("windowed") | inside).alias("n"))
    return counted.groupBy("cohort_name", "person_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("counts"))


def wanted_sets(cohorts: list[Cohort]) -> list[str]:
    """The code sets that the cohorts ask for."""
    return sorted({c.index_set for c in cohorts if c.index_set} | {x.code_set for c in cohorts for x in (*c.inclusion, *c.exclusion)})


def resolve_cohorts(persons: DataFrame, events: DataFrame, code_sets: DataFrame, cohorts: list[Cohort]) -> tuple[DataFrame, DataFrame]:
    """(cohort rows, attrition rows) of all cohorts.

    cohort: cohort_name, person_id, index_date, included, exclusion_reason.
    attrition: cohort_name, stage_order, stage, remaining, removed, detail.
    Matched events feed index dates and counts, so they are written once.
    """
    matched = match_events(events, code_sets, wanted_sets(cohorts)).select("person_id", "code_set_name", "event_date")
    return resolve_matched(persons, written(matched, "matched"), cohorts)


def resolve_matched(persons: DataFrame, matched: DataFrame, cohorts: list[Cohort]) -> tuple[DataFrame, DataFrame]:
    """The same over events that are matched already."""
    spark = persons.sparkSession
    indexes = index_dates(persons, matched, cohorts)
    counts = criterion_counts(matched, indexes, cohorts)
    person = {"sex": F.col("gender_source_value"), "race": F.col("race_source_value"), "ethnicity": F.col("ethnicity_source_value"), "year_of_birth": F.col("year_of_birth")}
    base = indexes.join(counts, ["cohort_name", "person_id"], "left").join(persons, "person_id")
    stage, reason = F.lit(None).cast("int"), F.lit(None).cast("string")
    for c in cohorts:
        got = lambda k: F.coalesce(F.element_at("counts", F.lit(k)), F.lit(0))
        demands = demographic_reason(person, F.col("index_date"), **c.demographics)
        checks = [] if c.strategy == "fixed_date" else [F.col("index_date").isNull()]
        checks += [got(k) < x.min_count for k, x in enumerate(c.inclusion)]
        checks.append(demands.isNotNull())
        checks += [got(len(c.inclusion) + k) >= x.min_count for k, x in enumerate(c.exclusion)]
        at, why = F.lit(None).cast("int"), F.lit(None).cast("string")
        for k in range(len(checks) - 1, -1, -1):
            name = c.stages()[k][0]
            at = F.when(checks[k], k + 1).otherwise(at)
            why = F.when(checks[k], demands if name == "demographics" else F.lit(name)).otherwise(why)
        mine = F.col("cohort_name") == c.name
        stage, reason = F.when(mine, at).otherwise(stage), F.when(mine, why).otherwise(reason)
    judged = base.select("cohort_name", "person_id", "index_date", stage.alias("stage_order"), reason.alias("exclusion_reason"))
    judged = written(judged, "judged")
    rows = judged.select("cohort_name", "person_id", "index_date", F.col("exclusion_reason").isNull().alias("included"), "exclusion_reason")
    listed = [(c.name, 0, "source population", None) for c in cohorts]
    listed += [(c.name, k + 1, s, d) for c in cohorts for k, (s, d) in enumerate(c.stages())]
    stages = spark.createDataFrame(listed, "cohort_name string, stage_order int, stage string, detail string")
    removed = judged.groupBy("cohort_name", F.coalesce("stage_order", F.lit(-1)).alias("stage_order")).agg(F.count("*").alias("n"))
    totals = removed.groupBy("cohort_name").agg(F.sum("n").alias("all"))
    joined = stages.join(removed, ["cohort_name", "stage_order"], "left").join(totals, "cohort_name", "left")
    gone = F.coalesce("n", F.lit(0))
    running = F.sum(gone).over(Window.partitionBy("cohort_name").orderBy("stage_order"))
    attrition = joined.select("cohort_name", "stage_order", "stage", (F.coalesce("all", F.lit(0)) - running).alias("remaining"), gone.alias("removed"), "detail")
    return rows, attrition


def cohort_totals(rows: DataFrame) -> DataFrame:
    """(cohort_name, included, total)."""
    return rows.groupBy("cohort_name").agg(F.count_if("included").alias("included"), F.count("*").alias("total"))
