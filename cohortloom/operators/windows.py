"""Joins of a cohort frame to observation periods and events around the index date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cohort_frame(cohort: DataFrame, persons: DataFrame, demographics: DataFrame | None = None) -> DataFrame:
    """Included people with their person columns, and their demographic row where there is one."""
    out = cohort.where("included").select("cohort_name", "person_id", "index_date").join(persons, "person_id")
    return out if demographics is None else out.join(demographics, "person_id", "left")


def cohort_frame_problems(cohort: DataFrame, names: list[str]) -> DataFrame:
    """(problem, n): people in several of the cohorts, cohorts without anyone, missing index dates."""
    mine = cohort.where(F.col("included") & F.col("cohort_name").isin(names))
    spark = cohort.sparkSession
    several = mine.groupBy("person_id").agg(F.count_distinct("cohort_name").alias("c")).where("c > 1").agg(F.count("*").alias("n")).select(F.lit("overlap").alias("problem"), "n")
    wanted = spark.createDataFrame([(x,) for x in names], "cohort_name string")
    empty = wanted.join(mine, "cohort_name", "left_anti").agg(F.count("*").alias("n")).select(F.lit("empty_cohort").alias("problem"), "n")
    undated = mine.where("index_date is null").agg(F.count("*").alias("n")).select(F.lit("missing_index_date").alias("problem"), "n")
    return several.union(empty).union(undated).where("n > 0")


def with_observation(frame: DataFrame, periods: DataFrame) -> DataFrame:
    """observation_start and observation_end over the periods that hold the index date; null without one."""
    key = ["cohort_name", "person_id", "index_date"]
    p = periods.select("person_id", F.col("observation_period_start_date").alias("s"), F.col("observation_period_end_date").alias("e"))
    held = frame.select(*key).join(p, "person_id").where("s <= index_date and index_date <= e")
    spans = held.groupBy(*key).agg(F.min("s").alias("observation_start"), F.max("e").alias("observation_end"))
    return frame.join(spans, key, "left")


def window_presence(frame: DataFrame, events: DataFrame, name: str, first: int | None = -365, last: int | None = -1) -> DataFrame:
    """Column ``name``: 1 if any event lies first..last days from the index date, else 0."""
    key = ["cohort_name", "person_id", "index_date"]
    day = F.datediff("event_date", "index_date")
    near = frame.select(*key).join(events.select("person_id", "event_date"), "person_id")
    if first is not None:
        near = near.where(day >= first)
    if last is not None:
        near = near.where(day <= last)
    marked = near.select(*key).distinct().withColumn(name, F.lit(1))
    return frame.join(marked, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def assemble_covariates(frame: DataFrame, matched: DataFrame, names: list[str], first: int = -365, last: int = -1) -> DataFrame:
    """All baseline presence columns of several code sets in one conditional aggregation; taken names are refused."""
    taken = sorted(set(names) & set(frame.columns))
    if taken:
        raise ValueError(f"columns already there: {', '.join(taken)}")
    key = ["cohort_name", "person_id", "index_date"]
    near = frame.select(*key).join(matched.where(F.col("code_set_name").isin(names)).select("person_id", "event_date", "code_set_name"), "person_id")
    near = near.where(F.datediff("event_date", "index_date").between(first, last))
    flags = near.groupBy(*key).agg(*[F.max((F.col("code_set_name") == n).cast("int")).alias(n) for n in names])
    return frame.join(flags, key, "left").fillna(0, names)


def incident_outcome(frame: DataFrame, events: DataFrame, name: str, start: int, end: int, washout: int) -> DataFrame:
    """Column ``name``: 1, 0 or null. frame needs observation_start and observation_end.

    Prevalent: an event in [index - washout, index). Case: an event in
    [index + start, index + end] not after the observation end. Both need
    observation from index - washout to index + start; a non-case needs it to
    index + end. Everything else stays missing.
    """
    return incident_outcomes(frame, events.withColumn("code_set_name", F.lit(name)), {name: (name, start, end, washout)})


def incident_outcomes(frame: DataFrame, matched: DataFrame, outcomes: dict[str, tuple[str, int, int, int]]) -> DataFrame:
    """A column per outcome (code set, start, end, washout) as incident_outcome gives it, all from one join and one aggregation."""
    for _, start, end, washout in outcomes.values():
        if start < 0 or end < start or washout < 0:
            raise ValueError("0 <= start <= end and washout >= 0 are required")
    key = ["cohort_name", "person_id", "index_date"]
    day, of = F.datediff("event_date", "index_date"), F.col("code_set_name")
    first, last = -max(o[3] for o in outcomes.values()), max(o[2] for o in outcomes.values())
    wanted = matched.where(of.isin(sorted({o[0] for o in outcomes.values()}))).select("person_id", "event_date", "code_set_name")
    near = frame.select(*key, "observation_end").join(wanted, "person_id").where(day.between(first, last))
    flags = []
    for k, (code_set, start, end, washout) in enumerate(outcomes.values()):
        flags.append(F.max(((of == code_set) & (day >= -washout) & (day < 0)).cast("int")).alias(f"_before{k}"))
        flags.append(F.max(((of == code_set) & day.between(start, end) & (F.col("event_date") <= F.col("observation_end"))).cast("int")).alias(f"_during{k}"))
    joined = frame.join(near.groupBy(*key).agg(*flags), key, "left")
    since, until = F.datediff("observation_start", "index_date"), F.datediff("observation_end", "index_date")
    columns = {}
    for k, (name, (_, start, end, washout)) in enumerate(outcomes.items()):
        eligible = (since <= -washout) & (until >= start) & (F.coalesce(f"_before{k}", F.lit(0)) == 0)
        columns[name] = F.when(eligible & (F.coalesce(f"_during{k}", F.lit(0)) == 1), 1).when(eligible & (until >= end), 0)
    return joined.withColumns(columns).drop(*[f"_{w}{k}" for k in range(len(outcomes)) for w in ("before", "during")])


def first_event_from_index(frame: DataFrame, events: DataFrame, name: str) -> DataFrame:
    """Column ``name``: the first event on or after the index date."""
    key = ["cohort_name", "person_id", "index_date"]
    ahead = frame.select(*key).join(events.select("person_id", "event_date"), "person_id").where("event_date >= index_date")
    return frame.join(ahead.groupBy(*key).agg(F.min("event_date").alias(name)), key, "left")


def reference_dates(persons: DataFrame, cohort: DataFrame, periods: DataFrame, default: str) -> DataFrame:
    """(person_id, reference_date): earliest included index date, else earliest observation start, else the default."""
    first = cohort.where("included").groupBy("person_id").agg(F.min("index_date").alias("i"))
    start = periods.groupBy("person_id").agg(F.min("observation_period_start_date").alias("s"))
    joined = persons.select("person_id").join(first, "person_id", "left").join(start, "person_id", "left")
    return joined.select("person_id", F.coalesce("i", "s", F.to_date(F.lit(default))).alias("reference_date"))
