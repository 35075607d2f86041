"""Two-arm comparison: 2x2 tables, ranks, multiplicity, permutation, Hodges-Lehmann, incidence, Firth."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.stats import boschloo, fisher_exact, newcombe, normal_p, poisson_interval, rate_ratio, z_value
from cohortloom.operators.design import design
from cohortloom.operators.resample import percentile_limits, replicate_cells
from cohortloom.sources.tables import written


def outcome_types(frame: DataFrame, outcomes: list[str], event_value=1) -> DataFrame:
    """(outcome, outcome_type): binary when at most two values are seen, all of 0, 1 or the event value."""
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).cast("double").alias("v")) for o in outcomes]))
    long = frame.select(each.alias("x")).select("x.*").where("v is not null")
    got = long.groupBy("outcome").agg(F.count_if(~F.col("v").isin(0.0, 1.0, float(event_value))).alias("odd"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_if((F.col("v") == 0.0)).alias("z"), F.count_if(F.col("v") == 1.0).alias("o"), F.count_if(F.col("v") == float(event_value)).alias("e"))
    kinds = (F.col("z") > 0).cast("int") + (F.col("o") > 0).cast("int") + ((F.col("e") > 0) & F.lit(float(event_value) not in (0.0, 1.0))).cast("int")
    return got.select("outcome", F.when((F.col("odd") == 0) & (kinds <= 2), "binary").otherwise("continuous").alias("outcome_type"))


def two_by_two(frame: DataFrame, outcomes: list[str], group: str, exposed: str, comparator: str) -> DataFrame:
    """(outcome, n_exposed, events_exposed, n_comparator, events_comparator, risk_difference, lower, upper); missing outcomes are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).cast("int").alias("y")) for o in outcomes]))
    long = frame.select(F.col(group).alias("g"), each.alias("x")).select("g", "x.*").where("y is not null")
    one, two = F.col("g") == exposed, F.col("g") == comparator
    t = long.groupBy("outcome").agg(
        F.count_if(one).alias("n_exposed"), F.count_if(one & (F.col("y") == 1)).alias("events_exposed"),
        F.count_if(two).alias("n_comparator"), F.count_if(two & (F.col("y") == 1)).alias("events_comparator"),
    )
    args = [F.col(c).cast("double") for c in ("events_exposed", "n_exposed", "events_comparator", "n_comparator")]
    low, high = newcombe(*args)
    return t.select("*", (args[0] / args[1] - args[2] / args[3]).alias("risk_difference"), low.alias("lower"), high.alias("upper"))


def exact_tests(tables: DataFrame, test_name: str = "fisher") -> DataFrame:
    """2x2 rows with odds_ratio, or_lower, or_upper, p_value of Fisher's or Boschloo's test; one small row per outcome."""
    if test_name not in ("fisher", "boschloo"):
        raise ValueError(f"unknown test: {test_name}")

    @F.pandas_udf("odds_ratio double, or_lower double, or_upper double, p_value double")
    def test(a: pd.Series, n1: pd.Series, c: pd.Series, n2: pd.Series) -> pd.DataFrame:
        got = [fisher_exact(int(x), int(m - x), int(y), int(k - y)) for x, m, y, k in zip(a, n1, c, n2, strict=True)]
        if test_name == "boschloo":
            got = [g | {"p_value": boschloo(int(x), int(m - x), int(y), int(k - y))} for g, x, m, y, k in zip(got, a, n1, c, n2, strict=True)]
        return pd.DataFrame([(g["odds_ratio"], g["lower"], g["upper"], g["p_value"]) for g in got], columns=["odds_ratio", "or_lower", "or_upper", "p_value"])

    return tables.withColumn("_t", test("events_exposed", "n_exposed", "events_comparator", "n_comparator")).select(*tables.columns, "_t.*")


def benjamini_hochberg(tests: DataFrame, p: str = "p_value", by: list[str] | None = None) -> DataFrame:
    """tests with q_value: reverse running minimum of p * m / rank; null and non-finite p stay without q.

    Tests are aggregates: one row per outcome or feature of a cluster.
    """
    keys = by or []
    ok = F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double"))
    part = Window.partitionBy(*keys, ok)
    rank = F.row_number().over(part.orderBy(p))
    raw = tests.withColumn("_raw", F.when(ok, F.col(p) * F.count("*").over(part) / rank)).withColumn("_rank", rank)
    back = Window.partitionBy(*keys, ok).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("q_value", F.when(ok, F.least(F.lit(1.0), F.min("_raw").over(back)))).drop("_raw", "_rank")


def running_totals(counts: DataFrame, by: str, columns: list[str], within: str | None = None) -> DataFrame:
    """counts with ``<column>_before``: sums over the rows with a smaller ``by`` (distinct) of the same ``within``, from totals of range partitions and running sums inside each."""
    keys = [within] if within else []
    ranged = written(counts.repartitionByRange(*keys, by).withColumn("_part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("_part", *keys).agg(*[F.sum(c).alias(f"_all_{c}") for c in columns])
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = parts.select("_part", *keys, *[F.coalesce(F.sum(f"_all_{c}").over(ahead), F.lit(0)).alias(f"_ahead_{c}") for c in columns])
    inside = Window.partitionBy("_part", *keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(parts, ["_part", *keys])
    return out.select(*counts.columns, *[(F.col(f"_ahead_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_before") for c in columns])


def rank_sums(frame: DataFrame, value: str, group: str, exposed: str, comparator: str) -> DataFrame:
    """One row (n1, n2, u, z) of the Mann-Whitney test with average ranks and tie correction.

    Ranks come from counts per distinct value and their running totals.
    """
    one, two = F.col(group) == exposed, F.col(group) == comparator
    counts = frame.where(F.col(value).isNotNull() & (one | two)).groupBy(F.col(value).cast("double").alias("v")).agg(F.count_if(one).alias("a"), F.count("*").alias("t"))
    ranked = running_totals(counts, "v", ["t"]).select("a", "t", (F.col("t_before") + (F.col("t") + 1) / 2).alias("rank"))
    t = F.col("t").cast("double")
    s = ranked.agg(F.sum("a").cast("double").alias("n1"), F.sum("t").cast("double").alias("n"), F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum(t * t * t - t).alias("ties"))
    n1, n = F.col("n1"), F.col("n")
    n2 = n - n1
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return s.select(n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), u.alias("u"), F.when(sd > 0, (u - n1 * n2 / 2) / sd).alias("z"))


def permutation_p(frame: DataFrame, value: str, group: str, exposed: str, iterations: int = 10_000, seed: int = 1, bins: int = 4096) -> float:
    """(extreme + 1) / (iterations + 1) of the mean difference under relabelling.

    A relabelling gives the exposed group a multivariate hypergeometric draw from
    the counts per value, so only those are held; more distinct values than
    ``bins`` are rounded to as many equal steps.
    """
    rows = frame.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), (F.col(group) == exposed).alias("one"))
    low, high, distinct, n, n1 = rows.agg(F.min("v"), F.max("v"), F.approx_count_distinct("v"), F.count("*"), F.count_if("one")).first()
    if not 0 < n1 < n:
        raise ValueError("both groups need a value")
    step = (high - low) / (bins - 1) or 1.0
    v = F.col("v") if distinct <= bins // 2 else low + F.round((F.col("v") - low) / step) * step
    cells = written(rows.groupBy(v.alias("v")).agg(F.count("*").alias("n"), F.count_if("one").alias("a")), "cells")
    total, top = cells.agg(F.sum(F.col("v") * F.col("n")), F.sum(F.col("v") * F.col("a"))).first()
    observed = abs(top / n1 - (total - top) / (n - n1))

    def extreme(columns, draws):
        tops = draws @ columns["v"]
        return np.abs(tops / n1 - (total - tops) / (n - n1)) >= observed - 1e-12

    draw = lambda generator, counts, size: generator.multivariate_hypergeometric(counts, n1, size, method="marginals")
    return (replicate_cells(cells.select("v", "n"), ["v"], extreme, iterations, seed, draw=draw).agg(F.sum("x")).first()[0] + 1) / (iterations + 1)


def pair_counts(cells: DataFrame, shifts: list[float]) -> list[int]:
    """For each shift the number of pairs (x of arm 1, y of arm 0) with x - y at most the shift.

    cells: (g, v, n) counts per arm and value. A pair counts where y is at least
    x - shift, so one sorted pass over the values of arm 0 and the moved ones of arm 1
    has all the counts.
    """
    spark = cells.sparkSession
    moved = cells.where("g = 1").join(F.broadcast(spark.createDataFrame([(k, float(s)) for k, s in enumerate(shifts)], "k int, shift double")), how="cross")
    # 0 before 1 at equal values: what is counted before x - shift is smaller than it
    ours = moved.select((F.col("v") - F.col("shift")).alias("v"), F.lit(0).alias("side"), "k", F.col("n").alias("x"), F.lit(0).cast("long").alias("y"))
    theirs = cells.where("g = 0").select("v", F.lit(1).alias("side"), F.lit(-1).alias("k"), F.lit(0).cast("long").alias("x"), F.col("n").alias("y"))
    rows = ours.unionByName(theirs).withColumn("key", F.struct("v", "side", "k", "x"))
    total = theirs.agg(F.sum("y")).first()[0] or 0
    got = running_totals(rows, "key", ["y"]).where("k >= 0").groupBy("k").agg(F.sum(F.col("x").cast("decimal(38,0)") * (F.lit(total) - F.col("y_before"))).cast("decimal(38,0)").alias("pairs")).collect()
    found = {r["k"]: int(r["pairs"]) for r in got}
    return [found.get(k, 0) for k in range(len(shifts))]


def pairs_between(cells: DataFrame, low: float, high: float) -> DataFrame:
    """(d, w): differences x - y above low and at most high, with the number of pairs; for brackets that hold few pairs."""
    theirs = running_totals(cells.where("g = 0").select("v", F.lit(1).alias("one")), "v", ["one"]).select(F.col("v").alias("y"), F.col("one_before").alias("place"))
    theirs = written(theirs.join(cells.where("g = 0").select(F.col("v").alias("y"), F.col("n").alias("ny")), "y"), "places")
    moved = cells.where("g = 1").select(F.col("v").alias("x"), F.col("n").alias("nx"))
    # y from x - high (included) to x - low (left out): the places of both ends among the y
    ends = moved.select("x", "nx", F.explode(F.array(F.struct((F.col("x") - high).alias("v"), F.lit("first").alias("end")), F.struct((F.col("x") - low).alias("v"), F.lit("last").alias("end")))).alias("e")).select("x", "nx", "e.*")
    rows = ends.select("v", F.lit(0).alias("side"), "x", "nx", "end", F.lit(0).cast("long").alias("one")).unionByName(theirs.select(F.col("y").alias("v"), F.lit(1).alias("side"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("long").alias("nx"), F.lit(None).cast("string").alias("end"), F.lit(1).cast("long").alias("one")))
    placed = running_totals(rows.withColumn("key", F.struct("v", "side", "x", "end")), "key", ["one"]).where("side = 0")
    spans = placed.groupBy("x", "nx").agg(F.max(F.when(F.col("end") == "first", F.col("one_before"))).alias("a"), F.max(F.when(F.col("end") == "last", F.col("one_before"))).alias("b")).where("b > a")
    met = spans.select("x", "nx", F.explode(F.sequence("a", F.col("b") - 1)).alias("place")).join(theirs, "place")
    return met.groupBy((F.col("x") - F.col("y")).alias("d")).agg(F.sum(F.col("nx").cast("decimal(20,0)") * F.col("ny")).alias("w"))


def hodges_lehmann(frame: DataFrame, value: str, group: str, exposed: str, comparator: str, ways: int = 16, few: int = 1_000_000) -> DataFrame:
    """One row (shift): the median of all pairwise differences, exact.

    The bracket of the middle differences is cut into ``ways`` parts, whose pairs are
    counted in one pass, until at most ``few`` pairs of values are left in it; those
    are made and read off. No grid, and no more pairs than that.
    """
    spark = frame.sparkSession
    one, two = F.col(group) == exposed, F.col(group) == comparator
    rows = frame.where(F.col(value).isNotNull() & (one | two)).select(one.cast("int").alias("g"), F.col(value).cast("double").alias("v"))
    cells = written(rows.groupBy("g", "v").agg(F.count("*").alias("n")), "value-counts")
    facts = {r["g"]: r for r in cells.groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("values"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    if len(facts) < 2:
        return spark.createDataFrame([(None,)], "shift double")
    if facts[0]["values"] * facts[1]["values"] <= few:
        ours, theirs = cells.where("g = 1").select(F.col("v").alias("x"), F.col("n").alias("nx")), cells.where("g = 0").select(F.col("v").alias("y"), F.col("n").alias("ny"))
        pairs = ours.join(theirs, how="cross").groupBy((F.col("x") - F.col("y")).alias("d")).agg(F.sum(F.col("nx") * F.col("ny")).alias("w"))
        return pairs.agg(F.percentile("d", F.lit(0.5), F.col("w")).alias("shift"))
    n = facts[0]["n"] * facts[1]["n"]
    middle = sorted({(n - 1) // 2, n // 2})  # places from 0
    found = []
    for place in middle:
        low, high = float(np.nextafter(facts[1]["low"] - facts[0]["high"], -np.inf)), facts[1]["high"] - facts[0]["low"]
        below, upto = 0, n
        # pairs of values in the bracket are at most its pairs of people
        while upto - below > few:
            cuts = [c for c in np.unique(np.linspace(low, high, ways + 1)[1:-1]).tolist() if low < c < high]
            if not cuts:
                break
            for cut, pairs in zip(cuts, pair_counts(cells, cuts), strict=True):
                if pairs > place:
                    high, upto = cut, pairs
                    break
                low, below = cut, pairs
        if upto - below > few:
            found.append(high)  # one difference fills the bracket
            continue
        order = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)  # at most ``few`` rows
        reach = pairs_between(cells, low, high).withColumn("reach", F.sum("w").over(order) + F.lit(below)).where(F.col("reach") > place)
        found.append(reach.agg(F.min("d")).first()[0])
    return spark.createDataFrame([(sum(found) / len(found),)], "shift double")


def hodges_lehmann_limits(frame: DataFrame, value: str, group: str, exposed: str, comparator: str, replicates: int = 2000, seed: int = 1, level: float = 0.95, bins: int = 1024, exact_pairs: int = 60_000) -> tuple[float, float]:
    """Percentile bootstrap limits of the shift, both arms resampled.

    Exact where the arms have at most ``exact_pairs`` pairs of distinct values; more
    values are rounded to ``bins`` equal steps of the range, which moves a limit by
    one step at most.
    """
    one, two = F.col(group) == exposed, F.col(group) == comparator
    rows = frame.where(F.col(value).isNotNull() & (one | two)).select(one.cast("int").alias("g"), F.col(value).cast("double").alias("v"))
    counts = written(rows.groupBy("g", "v").agg(F.count("*").alias("n")), "value-counts")
    low, high, ours, theirs = counts.agg(F.min("v"), F.max("v"), F.count_if(F.col("g") == 1), F.count_if(F.col("g") == 0)).first()
    if ours * theirs <= exact_pairs:

        def medians(columns, draws):
            x, y = (np.flatnonzero(columns["g"] == g) for g in (1, 0))
            d = (columns["v"][x][:, None] - columns["v"][y][None]).ravel()
            order = np.argsort(d, kind="stable")
            out = []
            for draw in draws:
                reach = np.cumsum((draw[x][:, None] * draw[y][None]).ravel()[order])
                total = reach[-1] if len(reach) else 0
                out.append(np.mean([d[order[np.searchsorted(reach, k, "right")]] for k in ((total - 1) // 2, total // 2)]) if total else np.nan)
            return out

        return percentile_limits(replicate_cells(counts, ["g", "v"], medians, replicates, seed), replicates, level)
    step = (high - low) / (bins - 1) or 1.0
    cells = rows.groupBy("g", F.round((F.col("v") - low) / step).cast("int").alias("k")).agg(F.count("*").alias("n"))

    def shifts(columns, draws):
        arms = np.zeros((2, len(draws), bins))
        for arm in (0, 1):
            at = columns["g"] == arm
            arms[arm][:, columns["k"][at]] = draws[:, at]
        out = []
        for y, x in zip(arms[0], arms[1], strict=True):
            # Pairs by difference: a correlation of the counts by fast Fourier transform.
            size = 2 * bins
            pairs = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size)
            pairs = np.rint(np.concatenate([pairs[bins + 1 :], pairs[:bins]]))
            total = pairs.sum()
            reach = np.cumsum(pairs)
            ends = [int(np.searchsorted(reach, k + 0.5)) for k in ((total - 1) // 2, total // 2)]
            out.append((sum(ends) / 2 - (bins - 1)) * step if total else np.nan)
        return out

    return percentile_limits(replicate_cells(cells, ["g", "k"], shifts, replicates, seed), replicates, level)


def incidence(frame: DataFrame, outcome: DataFrame, unit_days: float = 365.25, scale: float = 1000.0, group: str = "cohort_name") -> DataFrame:
    """(group, n, events, person_time, rate): all events from index to observation end over the time in that span."""
    key = ["cohort_name", "person_id", "index_date"]
    seen = frame.select(*key, "observation_end").join(outcome.select("person_id", "event_date"), "person_id").where("event_date between index_date and observation_end")
    counts = seen.groupBy(*key).agg(F.count("*").alias("events"))
    days = F.datediff("observation_end", "index_date")
    days = F.when(days > 0, days).otherwise(F.raise_error(F.lit("person-time must be positive")).cast("int"))
    people = frame.join(counts, key, "left").select(F.col(group).alias("group"), F.coalesce("events", F.lit(0)).alias("events"), (days / unit_days).alias("person_time"))
    got = people.groupBy("group").agg(F.count("*").alias("n"), F.sum("events").alias("events"), F.sum("person_time").alias("person_time"))
    return got.withColumn("rate", F.col("events") / F.col("person_time") * scale)


def incidence_intervals(rates: DataFrame, scale: float = 1000.0) -> DataFrame:
    """Rates with exact Poisson limits."""

    @F.pandas_udf("lower double, upper double")
    def limits(events: pd.Series, time: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tuple(x / t * scale for x in poisson_interval(int(e))) for e, t in zip(events, time, strict=True)], columns=["lower", "upper"])

    return rates.withColumn("_l", limits("events", "person_time")).select(*rates.columns, "_l.*")


def incidence_ratio(rates: DataFrame, exposed: str, comparator: str) -> dict:
    got = {r["group"]: r for r in rates.where(F.col("group").isin(exposed, comparator)).collect()}
    a, b = got[exposed], got[comparator]
    return rate_ratio(a["events"], a["person_time"], b["events"], b["person_time"])


def covariate_patterns(frame: DataFrame, outcome: str, covariates: list[str]) -> DataFrame:
    """Distinct covariate rows with n and events: the only thing a logistic fit needs."""
    y = F.col(outcome).cast("int")
    return frame.where(y.isNotNull()).groupBy(*covariates).agg(F.count("*").alias("n"), F.sum(y).alias("events"))


def firth(patterns: DataFrame, covariates: list[str], rounds: int = 500, tolerance: float = 1e-8) -> list[dict]:
    """Jeffreys-penalised logistic regression over covariate patterns: (term, estimate, lower, upper, p_value) with Wald limits.

    Each Newton step is two aggregations over the patterns, to the p x p
    information and to the modified score. Rank-deficient designs and fewer rows
    than parameters are refused.
    """
    p = len(covariates) + 1
    patterns = written(patterns.select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(covariates)], F.col("n").cast("double").alias("n"), F.col("events").cast("double").alias("events")), "patterns")

    def sums(run, size: int) -> np.ndarray:
        """The sum over all patterns of run(x, n, events), a vector of ``size``."""

        def add(batches):
            total = np.zeros(size)
            for batch in batches:
                cols = [np.asarray(c) for c in batch.columns]
                total += run(np.column_stack([np.ones(batch.num_rows), *cols[:-2]]), cols[-2], cols[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["k", "v"])

        out = np.zeros(size)
        for r in patterns.mapInArrow(add, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            out[r["k"]] = r["v"]
        return out

    gram = sums(lambda x, n, y: np.append((x.T @ (x * n[:, None])).ravel(), n.sum()), p * p + 1)
    if np.linalg.matrix_rank(gram[:-1].reshape(p, p)) < p or gram[-1] <= p:
        raise ValueError("the design is rank-deficient or has too few rows")
    beta = np.zeros(p)

    def information(x, n, y, beta):
        q = 1 / (1 + np.exp(-x @ beta))
        return (x.T @ (x * (n * q * (1 - q))[:, None])).ravel()

    def modified_score(x, n, y, beta, inverse):
        q = 1 / (1 + np.exp(-x @ beta))
        hat = q * (1 - q) * np.einsum("ij,jk,ik->i", x, inverse, x)
        return x.T @ (y - n * q + n * hat * (0.5 - q))

    for _ in range(rounds):
        inverse = np.linalg.inv(sums(lambda x, n, y, b=beta: information(x, n, y, b), p * p).reshape(p, p))
        step = inverse @ sums(lambda x, n, y, b=beta, i=inverse: modified_score(x, n, y, b, i), p)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    se, z = np.sqrt(np.diag(inverse)), z_value()
    return [{"term": t, "estimate": float(b), "lower": float(b - z * s), "upper": float(b + z * s), "p_value": normal_p(b / s)} for t, b, s in zip(["intercept", *covariates], beta, se, strict=True)]


def adjusted_odds_ratio(frame: DataFrame, outcome: str, group: str, exposed: str, covariates: list[str]) -> dict:
    """Firth's odds ratio of the exposure among complete rows, categories as dummies."""
    rows = frame.where(F.col(outcome).isNotNull() & F.col(group).isNotNull()).withColumn("_exposed", (F.col(group) == exposed).cast("double"))
    coded, terms = design(rows, covariates)
    columns = ["_exposed", *terms]
    got = firth(covariate_patterns(coded, outcome, columns), columns)[1]
    return {k: float(np.exp(got[k])) for k in ("estimate", "lower", "upper")} | {"p_value": got["p_value"]}
