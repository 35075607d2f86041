"""Table one: continuous and categorical summaries and standardised differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.stats import smd_continuous, smd_proportion

OVERALL = "Overall"


def _with_overall(frame: DataFrame, group: str) -> DataFrame:
    """Every row once for its group and once for Overall."""
    return frame.withColumn("group", F.explode(F.array(F.col(group).cast("string"), F.lit(OVERALL))))


def continuous(frame: DataFrame, variables: list[str], group: str) -> DataFrame:
    """(variable, group, statistic, value) rows of n, missing, mean, sd, median, q1, q3."""
    long = _with_overall(frame, group).select("group", F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables])).alias("x")).select("group", "x.*")
    quartile = lambda p: F.percentile("value", F.lit(p))
    got = long.groupBy("variable", "group").agg(
        F.count("value").cast("double").alias("n"), F.count_if(F.col("value").isNull()).cast("double").alias("missing"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"), quartile(0.5).alias("median"), quartile(0.25).alias("q1"), quartile(0.75).alias("q3"),
    )
    names = ["n", "missing", "mean", "sd", "median", "q1", "q3"]
    return got.select("variable", "group", F.explode(F.array(*[F.struct(F.lit(k).alias("statistic"), F.col(k).alias("value")) for k in names])).alias("x")).select("variable", "group", "x.*")


def categorical(frame: DataFrame, variables: list[str], group: str, threshold: int = 5) -> DataFrame:
    """(variable, level, group, value, percent, display, suppressed): all levels in all groups, and a missing row.

    Percents are of the non-missing, of all rows for the missing row. Cells of
    1 to threshold - 1 people are suppressed; zeros stay visible.
    """
    long = _with_overall(frame, group).select("group", F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level")) for v in variables])).alias("x")).select("group", "x.*")
    counts = long.groupBy("variable", "group", "level").agg(F.count("*").alias("c"))
    totals = counts.groupBy("variable", "group").agg(F.sum("c").alias("all"), F.sum(F.when(F.col("level").isNotNull(), F.col("c")).otherwise(0)).alias("known"))
    # The spine pairs levels with groups: both are aggregates of few rows.
    levels = counts.select("variable", "level").distinct().unionByName(totals.select("variable", F.lit(None).cast("string").alias("level"))).distinct()
    spine = totals.join(levels, "variable")
    joined = spine.join(counts.withColumnsRenamed({"level": "l2"}), (spine["variable"] == counts["variable"]) & (spine["group"] == counts["group"]) & spine["level"].eqNullSafe(F.col("l2")), "left")
    n = F.coalesce("c", F.lit(0))
    missing = spine["level"].isNull()
    percent = F.when(missing, n * 100.0 / F.col("all")).otherwise(F.when(F.col("known") > 0, n * 100.0 / F.col("known")))
    hide = (n > 0) & (n < threshold)
    return joined.select(
        spine["variable"], F.coalesce(spine["level"], F.lit("Missing")).alias("level"), spine["group"],
        F.when(~hide, n).alias("value"), F.when(~hide, percent).alias("percent"),
        F.when(hide, F.lit(f"<{threshold}")).otherwise(n.cast("string")).alias("display"), hide.alias("suppressed"),
    )


def smd(frame: DataFrame, numeric: list[str], levels: list[str], group: str, first: str, second: str) -> DataFrame:
    """(variable, level, estimate) between two groups; level is null for numeric variables."""
    one, two = F.col(group) == first, F.col(group) == second
    aggs = []
    for v in numeric:
        x = F.col(v).cast("double")
        aggs += [F.avg(F.when(one, x)).alias(f"m1_{v}"), F.variance(F.when(one, x)).alias(f"v1_{v}"), F.avg(F.when(two, x)).alias(f"m2_{v}"), F.variance(F.when(two, x)).alias(f"v2_{v}")]
    out = None
    if numeric:
        wide = frame.agg(*aggs)
        each = [F.struct(F.lit(v).alias("variable"), F.lit(None).cast("string").alias("level"), smd_continuous(F.col(f"m1_{v}"), F.col(f"v1_{v}"), F.col(f"m2_{v}"), F.col(f"v2_{v}")).alias("estimate")) for v in numeric]
        out = wide.select(F.explode(F.array(*each)).alias("x")).select("x.*")
    if levels:
        long = frame.where(one | two).select(one.alias("one"), F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level")) for v in levels])).alias("x")).select("one", "x.*").where("level is not null")
        per = long.groupBy("variable", "level").agg(F.count_if("one").alias("a"), F.count_if(~F.col("one")).alias("b"))
        whole = Window.partitionBy("variable")  # few levels
        cat = per.select("variable", "level", smd_proportion(F.col("a") / F.sum("a").over(whole), F.col("b") / F.sum("b").over(whole)).alias("estimate"))
        out = cat if out is None else out.unionByName(cat)
    return out
