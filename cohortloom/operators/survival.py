"""Survival: durations, risk tables, Kaplan-Meier, RMST, medians, log-rank, Cox.

Curves are one row per distinct time, found by aggregation; running sums go over
those rows only, never over people.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.stats import chi2_p_1df, normal_p, z_value
from cohortloom.operators.compare import running_totals
from cohortloom.operators.design import design
from cohortloom.operators.resample import percentile_limits, replicate_cells
from cohortloom.operators.windows import first_event_from_index, with_observation


def survival_frame(frame: DataFrame, outcome: DataFrame, periods: DataFrame | None = None, max_days: int | None = None, censor: DataFrame | None = None) -> DataFrame:
    """frame with duration (days) and event (1/0).

    The end is the observation end; an administrative limit replaces a missing
    or later one, an event of ``censor`` a missing or later one. An outcome not
    after the end is an event; its date ends the duration. No end, or an end
    before the index date, is refused.
    """
    out = with_observation(frame, periods) if periods is not None else frame
    out = first_event_from_index(out, outcome, "_outcome")
    end = F.col("observation_end")
    if max_days is not None:
        limit = F.date_add("index_date", max_days)
        end = F.when(end.isNotNull() & (end < limit), end).otherwise(limit)
    out = out.withColumn("_end", end)
    if censor is not None:
        out = first_event_from_index(out, censor, "_censor")
        keep = F.col("_censor").isNull() | (F.col("_end").isNotNull() & (F.col("_end") <= F.col("_censor")))
        out = out.withColumn("_end", F.when(keep, F.col("_end")).otherwise(F.col("_censor"))).drop("_censor")
    wrong = F.col("_end").isNull() | (F.col("_end") < F.col("index_date"))
    out = out.withColumn("_end", F.when(wrong, F.raise_error(F.lit("no observation end on or after the index date")).cast("date")).otherwise(F.col("_end")))
    event = F.coalesce((F.col("_outcome") <= F.col("_end")).cast("int"), F.lit(0))
    stop = F.when(event == 1, F.col("_outcome")).otherwise(F.col("_end"))
    return out.withColumn("event", event).withColumn("duration", F.datediff(stop, "index_date").cast("double")).drop("_outcome", "_end")


def risk_table(data: DataFrame, group: str = "group") -> DataFrame:
    """(group, time, at_risk, events, censored) at each distinct time, and a first row at time 0."""
    counts = data.groupBy(F.col(group).alias("group"), F.col("duration").alias("time")).agg(
        F.count("*").alias("n"), F.sum(F.col("event").cast("long")).alias("events")
    )
    later = Window.partitionBy("group").orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.select("group", "time", F.sum("n").over(later).alias("at_risk"), "events", (F.col("n") - F.col("events")).alias("censored"), F.lit(1).alias("step"))
    zero = counts.groupBy("group").agg(F.sum("n").alias("at_risk"))
    none = F.lit(0).cast("long")
    return zero.select("group", F.lit(0.0).alias("time"), "at_risk", none.alias("events"), none.alias("censored"), F.lit(0).alias("step")).unionByName(rows)


def kaplan_meier(data: DataFrame, group: str = "group", level: float = 0.95) -> DataFrame:
    """(group, time, survival, lower, upper, at_risk, events, censored) with Greenwood log-log intervals."""
    z = z_value(level)
    so_far = Window.partitionBy("group").orderBy("time", "step").rowsBetween(Window.unboundedPreceding, 0)
    d, n = F.col("events").cast("double"), F.col("at_risk").cast("double")
    some = d > 0
    rows = risk_table(data, group).select(
        "*",
        F.sum(F.when(some & (n > d), F.log1p(-d / n)).otherwise(0.0)).over(so_far).alias("log_s"),
        F.max(F.when(some & (n <= d), 1).otherwise(0)).over(so_far).alias("dead"),
        F.sum(F.when(some & (n > d), d / (n * (n - d))).otherwise(0.0)).over(so_far).alias("green"),
    )
    s = F.when(F.col("dead") == 1, 0.0).otherwise(F.exp("log_s"))
    half = z * F.sqrt("green") / F.abs("log_s")
    spread = lambda sign: F.exp(-F.exp(F.log(-F.col("log_s")) + sign * half))
    bound = lambda sign: F.when(F.col("dead") == 1, 0.0).when(F.col("green") == 0, s).otherwise(spread(sign))
    return rows.select("group", "time", s.alias("survival"), bound(1).alias("lower"), bound(-1).alias("upper"), "at_risk", "events", "censored")


def restricted_mean(curve: DataFrame, horizon: float) -> DataFrame:
    """(group, rmst): area under each curve up to the horizon; a horizon beyond a group's last time is refused."""
    if horizon <= 0:
        raise ValueError("the horizon must be positive")
    order = Window.partitionBy("group").orderBy("time", F.desc("survival"))
    stop = F.least(F.coalesce(F.lead("time").over(order), F.lit(float(horizon))), F.lit(float(horizon)))
    area = curve.select("group", "survival", "time", F.greatest(F.lit(0.0), stop - F.col("time")).alias("width"))
    rmst = F.sum(F.col("width") * F.col("survival"))
    refused = F.raise_error(F.lit("the horizon lies beyond the last time of a group")).cast("double")
    return area.groupBy("group").agg(F.when(F.max("time") >= horizon, rmst).otherwise(refused).alias("rmst"))


def rmst_difference_limits(data: DataFrame, exposed: str, comparator: str, horizon: float, group: str = "group", replicates: int = 1000, seed: int = 1, level: float = 0.95) -> tuple[float, float]:
    """Percentile bootstrap limits of the RMST difference, both groups resampled.

    Cells are people per group, day and event: as few as the days of follow-up.
    """
    known = F.col(group).isin(exposed, comparator)
    cells = data.where(known).groupBy((F.col(group) == exposed).cast("int").alias("g"), F.least("duration", F.lit(float(horizon))).alias("time"), F.when(F.col("duration") <= horizon, F.col("event")).otherwise(0).alias("event")).agg(F.count("*").alias("n"))

    def area(time, event, n):
        """RMST of every replicate (rows of n) from cells in ascending time."""
        times, at = np.unique(time, return_inverse=True)
        all_n, died = np.zeros((len(n), len(times))), np.zeros((len(n), len(times)))
        for k in range(len(time)):
            all_n[:, at[k]] += n[:, k]
            died[:, at[k]] += n[:, k] * (event[k] == 1)
        risk = np.cumsum(all_n[:, ::-1], 1)[:, ::-1]
        left = np.cumprod(1 - died / np.maximum(risk, 1), 1)
        survival = np.concatenate([np.ones((len(n), 1)), left], 1)
        out = (survival * np.diff(np.concatenate([[0.0], times, [horizon]]))).sum(1)
        return np.where(all_n.sum(1) > 0, out, np.nan)

    def differences(columns, draws):
        first = columns["g"] == 1
        return area(columns["time"][first], columns["event"][first], draws[:, first]) - area(columns["time"][~first], columns["event"][~first], draws[:, ~first])

    return percentile_limits(replicate_cells(cells, ["g", "time", "event"], differences, replicates, seed), replicates, level)


def median_survival(curve: DataFrame) -> DataFrame:
    """(group, median, median_lower, median_upper): first times with the curve or its limits at or below one half."""
    first = lambda c: F.min(F.when(F.col(c) <= 0.5, F.col("time")))
    return curve.groupBy("group").agg(first("survival").alias("median"), first("lower").alias("median_lower"), first("upper").alias("median_upper"))


def log_rank(data: DataFrame, exposed: str, group: str = "group") -> DataFrame:
    """One row (observed, expected, variance, statistic) of the two-group log-rank test."""
    one = (F.col(group) == exposed).cast("long")
    counts = data.groupBy("duration").agg(
        F.count("*").alias("c"), F.sum(one).alias("c1"), F.sum(F.col("event").cast("long")).alias("d"), F.sum(F.col("event").cast("long") * one).alias("d1")
    )
    # At risk: those whose time is the same or later, that is, has no later negative time.
    counts = running_totals(counts.withColumn("back", -F.col("duration")), "back", ["c", "c1"])
    r = counts.select("d", "d1", (F.col("c") + F.col("c_before")).cast("double").alias("n"), (F.col("c1") + F.col("c1_before")).cast("double").alias("n1")).where("d > 0")
    sums = r.agg(
        F.sum("d1").cast("double").alias("observed"),
        F.sum(F.col("d") * F.col("n1") / F.col("n")).alias("expected"),
        F.sum(F.when(F.col("n") > 1, F.col("n1") * (F.col("n") - F.col("n1")) * F.col("d") * (F.col("n") - F.col("d")) / (F.col("n") * F.col("n") * (F.col("n") - 1))).otherwise(0.0)).alias("variance"),
    )
    gap = F.col("observed") - F.col("expected")
    return sums.withColumn("statistic", F.when(F.col("variance") > 0, gap * gap / F.col("variance")).otherwise(0.0))


def log_rank_p(row) -> float:
    return chi2_p_1df(row["statistic"])


def cox(data: DataFrame, covariates: list[str], ridge: float = 0.0, rounds: int = 50, tolerance: float = 1e-9) -> list[dict]:
    """Cox regression by Newton steps with Efron ties: (term, estimate, lower, upper, p_value, ph_statistic, ph_p_value) with hazard ratios.

    Each step is one aggregation to sums per distinct time; the driver sees
    those sums. ridge penalises the sum of squared coefficients times half the
    number of rows. Categories become dummies; incomplete rows are left out. The
    ph columns test proportional hazards: scaled Schoenfeld residuals against the
    rank of the event times, deaths at one time sharing their mean rank.
    """
    rows, terms = design(data, covariates)
    columns = list(terms)
    p = len(columns)
    rows = rows.select("duration", F.col("event").cast("int").alias("event"), *columns)
    n = rows.count()
    beta = np.zeros(p)
    for _ in range(rounds):
        at = _sums_by_time(rows, columns, beta)
        score, info, residuals, deaths = _efron(at, p)
        score, info = score - ridge * n * beta, info + ridge * n * np.eye(p)
        step = np.linalg.solve(info, score)
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    variance = np.linalg.inv(info)
    se, z = np.sqrt(np.diag(variance)), z_value()
    ph = _rank_test(residuals, deaths, variance)
    return [
        {"term": terms[c], "estimate": math.exp(b), "lower": math.exp(b - z * s), "upper": math.exp(b + z * s), "p_value": normal_p(b / s), "ph_statistic": float(t), "ph_p_value": chi2_p_1df(float(t))}
        for c, b, s, t in zip(columns, beta, se, ph, strict=True)
    ]


def _sums_by_time(rows: DataFrame, columns: list[str], beta: np.ndarray):
    """Per distinct time, latest first: sums of w, w x and w x x' over everyone (s) and over deaths (t), of x over deaths, and deaths d; w = exp(x beta)."""
    eta = sum((F.col(c) * float(b) for c, b in zip(columns, beta, strict=True)), F.lit(0.0))
    w, died = F.exp(eta), F.col("event") == 1
    cols = [F.sum(w).alias("s0"), F.sum(F.col("event")).alias("d"), F.sum(F.when(died, w).otherwise(0.0)).alias("t0")]
    for i, a in enumerate(columns):
        cols += [F.sum(w * F.col(a)).alias(f"s1_{i}"), F.sum(F.when(died, w * F.col(a)).otherwise(0.0)).alias(f"t1_{i}"), F.sum(F.when(died, F.col(a)).otherwise(0.0)).alias(f"x_{i}")]
        for j in range(i, len(columns)):
            product = w * F.col(a) * F.col(columns[j])
            cols += [F.sum(product).alias(f"s2_{i}_{j}"), F.sum(F.when(died, product).otherwise(0.0)).alias(f"t2_{i}_{j}")]
    return rows.groupBy("duration").agg(*cols).orderBy(F.desc("duration")).toPandas()


def _efron(at, p: int):
    """Score, information, and at each time with deaths the summed Schoenfeld residuals and the deaths; latest time first."""
    s0, t0 = at["s0"].cumsum().to_numpy(), at["t0"].to_numpy()
    vector = lambda name, total: np.stack([at[f"{name}_{i}"].cumsum() if total else at[f"{name}_{i}"] for i in range(p)], 1)
    s1, t1, x = vector("s1", True), vector("t1", False), vector("x", False)
    s2, t2 = np.zeros((len(at), p, p)), np.zeros((len(at), p, p))
    for i in range(p):
        for j in range(i, p):
            s2[:, i, j] = s2[:, j, i] = at[f"s2_{i}_{j}"].cumsum()
            t2[:, i, j] = t2[:, j, i] = at[f"t2_{i}_{j}"]
    info, residuals, deaths = np.zeros((p, p)), [], []
    for k in np.flatnonzero(at["d"].to_numpy() > 0):
        # All deaths of one time at once: fractions f of the dying are taken out of the risk set.
        d = int(at["d"].iloc[k])
        f = np.arange(d) / d
        z0 = s0[k] - f * t0[k]
        z1 = (s1[k] - f[:, None] * t1[k]) / z0[:, None]
        info += s2[k] * (1 / z0).sum() - t2[k] * (f / z0).sum() - z1.T @ z1
        residuals.append(x[k] - z1.sum(0))
        deaths.append(d)
    residuals = np.array(residuals).reshape(-1, p)
    return residuals.sum(0), info, residuals, np.array(deaths, float)


def _rank_test(residuals: np.ndarray, deaths: np.ndarray, variance: np.ndarray) -> np.ndarray:
    """Chi-squared statistic of each coefficient against the rank of time."""
    residuals, deaths = residuals[::-1], deaths[::-1]
    total = deaths.sum()
    rank = np.cumsum(deaths) - (deaths - 1) / 2
    rank = rank - (rank * deaths).sum() / max(total, 1)
    spread = (rank * rank * deaths).sum()
    trend = variance @ (rank[:, None] * residuals).sum(0) * total
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(spread > 0, trend**2 / (total * np.diag(variance) * spread), 0.0)
