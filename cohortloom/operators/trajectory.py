"""Longitudinal measurements: units, summaries, cluster bootstrap, random-intercept model."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.stats import normal_p, z_value
from cohortloom.operators.resample import person_weights
from cohortloom.sources.tables import small


def harmonize_units(measurements: DataFrame, conversions: DataFrame) -> DataFrame:
    """Values in one unit: value * multiplier + offset under the unit's target.

    conversions: unit, target, multiplier, offset. With a single unit in the data
    nothing changes; with several, an unmapped unit or several targets are refused.
    """
    units = measurements.select("unit").distinct()
    seen = units.join(conversions, "unit", "left").agg(F.count("*").alias("n"), F.count_if(F.col("target").isNull()).alias("unmapped"), F.count_distinct("target").alias("targets")).first()
    if seen["n"] <= 1:
        return measurements
    if seen["unmapped"] or seen["targets"] != 1:
        raise ValueError("every unit must be mapped to one common target")
    joined = measurements.join(small(conversions), "unit")
    return joined.withColumn("value", F.col("value") * F.coalesce("multiplier", F.lit(1.0)) + F.coalesce("offset", F.lit(0.0))).withColumn("unit", F.col("target")).drop("target", "multiplier", "offset")


def relative_times(frame: DataFrame, measurements: DataFrame) -> DataFrame:
    """(person_id, group, time, value): days from the index date."""
    joined = frame.select("person_id", F.col("cohort_name").alias("group"), "index_date").join(measurements.where("value is not null"), "person_id")
    return joined.select("person_id", "group", F.datediff("event_date", "index_date").alias("time"), "value")


def summarise(rows: DataFrame, level: float = 0.95) -> DataFrame:
    """(group, time, value, n_measurements, standard_deviation, lower, upper, n_patients) with normal limits of the mean."""
    got = rows.groupBy("group", "time").agg(F.avg("value").alias("value"), F.count("value").alias("n_measurements"), F.stddev_samp("value").alias("standard_deviation"), F.count_distinct("person_id").alias("n_patients"))
    half = z_value(level) * F.col("standard_deviation") / F.sqrt("n_measurements")
    return got.withColumn("lower", F.col("value") - half).withColumn("upper", F.col("value") + half)


def bootstrap_means(rows: DataFrame, replicates: int = 1000, seed: int = 1, level: float = 0.95) -> DataFrame:
    """(group, time, lower, upper): percentile limits of the mean, people resampled as clusters.

    Rows are first collapsed to (person, group, time) sums. A person's weight in a
    replicate is a Poisson(1) draw from a hash, the same for all their rows. One pass
    over Arrow batches adds weighted sums up by group, time and replicate, so neither
    a resample nor a row per person and replicate is ever made.
    """
    per = rows.groupBy("person_id", "group", "time").agg(F.sum("value").alias("s"), F.count("*").cast("double").alias("n"))
    per = per.select(F.col("person_id").cast("long").alias("person_id"), "group", F.col("time").cast("double").alias("time"), F.col("s").cast("double").alias("s"), "n")
    reps = np.arange(replicates)

    def add(batches):
        totals: dict = {}
        for batch in batches:
            ids, s, n = (batch.column(c).to_numpy() for c in ("person_id", "s", "n"))
            table = pa.table({"group": batch.column("group"), "time": batch.column("time")})
            cells = table.group_by(["group", "time"]).aggregate([])
            keys = {k: j for j, k in enumerate(zip(cells.column("group").to_pylist(), cells.column("time").to_pylist(), strict=True))}
            at = np.array([keys[k] for k in zip(table.column("group").to_pylist(), table.column("time").to_pylist(), strict=True)])
            order = np.argsort(at, kind="stable")
            starts = np.searchsorted(at[order], np.arange(len(keys)))
            for key, lo, hi in zip(keys, starts, [*starts[1:], len(order)], strict=True):
                total = totals.setdefault(key, np.zeros((2, replicates)))
                for k in range(lo, hi, 2000):
                    mine = order[k : min(k + 2000, hi)]
                    w = person_weights(ids[mine], reps, seed)
                    total += np.stack([s[mine], n[mine]]) @ w
        for (group, time), (s, n) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([group] * replicates, pa.string()), pa.array(np.full(replicates, time)), pa.array(reps), pa.array(s), pa.array(n)], ["group", "time", "rep", "s", "n"])

    sums = per.mapInArrow(add, "group string, time double, rep long, s double, n double").groupBy("group", "time", "rep").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0")
    tail = (1 - level) / 2
    m = F.col("s") / F.col("n")
    kind = dict(rows.dtypes)["time"]
    return sums.groupBy("group", F.col("time").cast(kind).alias("time")).agg(F.percentile(m, F.lit(tail)).alias("lower"), F.percentile(m, F.lit(1 - tail)).alias("upper"))


def output_rows(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """Individual and summary rows with row_type, absent columns null."""
    one = rows.withColumn("row_type", F.lit("individual"))
    return one.unionByName(summary.withColumn("row_type", F.lit("summary")), allowMissingColumns=True)


def random_intercept(rows: DataFrame, min_people: int = 30, min_rows: int = 3, exposed: str | None = None) -> list[dict]:
    """REML of value ~ time with a random intercept per person: (term, estimate, lower, upper, p_value).

    With ``exposed``, value ~ time * group: the terms of the other group, then the
    differences of the exposed one. People are collapsed to sufficient statistics,
    and those are added up per number of rows and group, so each likelihood
    evaluation runs over a few rows.
    """
    mine = F.lit(0) if exposed is None else (F.col("group") == exposed).cast("int")
    per = rows.groupBy("person_id", mine.alias("g")).agg(
        F.count("*").alias("n"), F.sum("time").cast("double").alias("t"), F.sum("value").alias("y"),
        F.sum(F.col("time") * F.col("time")).cast("double").alias("tt"), F.sum(F.col("time") * F.col("value")).alias("ty"), F.sum(F.col("value") * F.col("value")).alias("yy"),
    )
    facts = per.agg(F.count("*").alias("people"), F.median("n").alias("rows")).first()
    if facts["people"] < min_people or facts["rows"] < min_rows:
        raise ValueError("too few people or rows for the mixed model")
    sums = [F.count("*").alias("k"), *[F.sum(c).alias(c) for c in ("t", "y", "tt", "ty", "yy")]]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in (("t", "t"), ("t", "y"), ("y", "y"))]
    at = per.groupBy("n", "g").agg(*sums).toPandas()
    n, k = at["n"].to_numpy(float), at["k"].to_numpy(float)
    total, size = float((n * k).sum()), 2 if exposed is None else 4

    def fit(ratio):
        """ratio: intercept variance over residual variance. Returns (-2 REML, beta, covariance, residual variance)."""
        c = ratio / (1 + n * ratio)
        one = np.stack([(n - c * n * n) * k, (1 - c * n) * at["t"], at["tt"] - c * at["t_t"], (1 - c * n) * at["y"], at["ty"] - c * at["t_y"]], 1)
        info, right = np.zeros((size, size)), np.zeros(size)
        for g in range(size // 2):
            a11, a12, a22, b1, b2 = one[at["g"] == g].sum(0) if exposed is not None else one.sum(0)
            block, load = np.array([[a11, a12], [a12, a22]]), np.array([b1, b2])
            # People of the exposed group have every term twice: the common one and the difference.
            for i in range(g + 1):
                right[2 * i : 2 * i + 2] += load
                for j in range(g + 1):
                    info[2 * i : 2 * i + 2, 2 * j : 2 * j + 2] += block
        yy = (at["yy"] - c * at["y_y"]).sum()
        beta = np.linalg.solve(info, right)
        sigma = float(yy - right @ beta) / (total - size)
        value = (total - size) * math.log(sigma) + float((k * np.log1p(n * ratio)).sum()) + math.log(np.linalg.det(info))
        return value, beta, np.linalg.inv(info) * sigma, sigma

    low, high, golden = -20.0, 10.0, (math.sqrt(5) - 1) / 2
    for _ in range(100):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if fit(math.exp(a))[0] < fit(math.exp(b))[0] else (a, high)
    _, beta, cov, _ = fit(math.exp((low + high) / 2))
    z = z_value()
    return [
        {"term": t, "estimate": float(b), "lower": float(b - z * s), "upper": float(b + z * s), "p_value": normal_p(b / s)}
        for t, b, s in zip(("intercept", "time", "exposed", "time:exposed"), beta, np.sqrt(np.diag(cov)), strict=False)
    ]
