"""Drug eras, lines of therapy and pathway counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.sources.tables import small


def assign_class(exposures: DataFrame, classes: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Exposures with drug_class from a map (source_value, drug_class); unmatched and unlisted ones are left out.

    A code with two classes is refused.
    """
    single = classes.groupBy("source_value").agg(F.min("drug_class").alias("drug_class"), F.count_distinct("drug_class").alias("n"))
    single = single.select("source_value", F.when(F.col("n") == 1, F.col("drug_class")).otherwise(F.raise_error(F.concat(F.lit("several classes: "), "source_value")).cast("string")).alias("drug_class"))
    out = exposures.join(small(single), "source_value")
    return out.where(F.col("drug_class").isin(allowed)) if allowed else out


def unmatched_exposures(exposures: DataFrame, classes: DataFrame) -> DataFrame:
    """(source_value, exposures, persons) of exposures that no class names."""
    return exposures.join(classes.select("source_value").distinct(), "source_value", "left_anti").groupBy("source_value").agg(F.count("*").alias("exposures"), F.count_distinct("person_id").alias("persons"))


def class_overlaps(exposures: DataFrame) -> DataFrame:
    """(event_id, classes) of exposures that carry more than one class."""
    return exposures.groupBy("event_id").agg(F.count_distinct("drug_class").alias("classes")).where("classes > 1")


def drug_eras(exposures: DataFrame, gap_days: int = 30, keys: tuple[str, ...] = ("person_id", "drug_class")) -> DataFrame:
    """(keys, era_start, era_end, exposure_count): exposures joined while a start lies within the gap of the running end.

    A missing end counts as the start; an end before the start is refused.
    """
    end = F.coalesce("end_date", "event_date")
    end = F.when(end < F.col("event_date"), F.raise_error(F.lit("exposure ends before it starts")).cast("date")).otherwise(end)
    rows = exposures.select(*keys, F.col("event_date").alias("s"), end.alias("e"))
    order = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("opens", (reach.isNull() | (F.col("s") > F.date_add(reach, gap_days))).cast("int"))
    rows = rows.withColumn("era", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "era").agg(F.min("s").alias("era_start"), F.max("e").alias("era_end"), F.count("*").alias("exposure_count")).drop("era")


def therapy_lines(eras: DataFrame, max_lines: int = 3) -> DataFrame:
    """(person_id, sequence, line_count, line_k, days_to_line_k): eras by start and class, neighbouring repeats collapsed."""
    order = Window.partitionBy("person_id").orderBy("era_start", "drug_class")
    kept = eras.withColumn("before", F.lag("drug_class").over(order)).where("before is null or before <> drug_class")
    kept = kept.withColumn("line", F.row_number().over(order)).withColumn("days", F.datediff("era_start", F.lag("era_start").over(order))).where(F.col("line") <= max_lines)
    sequence = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "drug_class"))), lambda x: x["drug_class"]), " → ")
    per_line = [F.max(F.when(F.col("line") == k, F.col("drug_class"))).alias(f"line_{k}") for k in range(1, max_lines + 1)]
    waits = [F.max(F.when(F.col("line") == k, F.col("days"))).alias(f"days_to_line_{k}") for k in range(2, max_lines + 1)]
    return kept.groupBy("person_id").agg(sequence.alias("sequence"), F.count("*").cast("int").alias("line_count"), *per_line, *waits)


def pathway_counts(lines: DataFrame) -> DataFrame:
    """(sequence, count, percent)."""
    total = lines.agg(F.count("*").alias("n"))
    counts = lines.groupBy("sequence").agg(F.count("*").alias("count"))
    return counts.crossJoin(F.broadcast(total)).select("sequence", "count", (F.col("count") * 100.0 / F.col("n")).alias("percent"))


def top_pathways(lines: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent sequences, ties by sequence."""
    return pathway_counts(lines).orderBy(F.desc("count"), "sequence").limit(k)


def time_to_switch(lines: DataFrame, max_lines: int = 3) -> DataFrame:
    """(line, patients_switching, median_days, q1_days, q3_days)."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("line"), F.col(f"days_to_line_{k}").alias("days")) for k in range(2, max_lines + 1)]))
    long = lines.select(each.alias("x")).select("x.*").where("days is not null")
    quartile = lambda p: F.percentile("days", F.lit(p))
    return long.groupBy("line").agg(F.count("*").alias("patients_switching"), quartile(0.5).alias("median_days"), quartile(0.25).alias("q1_days"), quartile(0.75).alias("q3_days"))
