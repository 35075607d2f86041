"""Adjusted effects: propensity model, weights, balance, matching, effect estimates, bootstrap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.design import design
from cohortloom.operators.resample import percentile_limits, person_weights, replicate_cells
from cohortloom.sources.tables import written

SCORE_FLOOR = 1e-6


def propensity(frame: DataFrame, exposed: str, covariates: list[str], group: str = "cohort_name") -> DataFrame:
    """frame with treated (1/0) and propensity_score: L2 logistic with C = 1, scores clipped to [1e-6, 1 - 1e-6].

    Missing numbers take the median and get a flag; categories become dummies
    with a level Missing; constants are dropped.
    """
    scored, _ = propensity_design(frame, exposed, covariates, group)
    return scored.drop(*[c for c in scored.columns if c.startswith("_x_")])


def propensity_design(frame: DataFrame, exposed: str, covariates: list[str], group: str = "cohort_name") -> tuple[DataFrame, dict[str, str]]:
    """The scored frame with its design columns, and their terms. The frame is written first, as facts, levels, fit and scores each read it."""
    frame = written(frame, "covariates")
    rows, terms = design(frame.withColumn("treated", (F.col(group) == exposed).cast("int")), covariates, "flag")
    ready = VectorAssembler(inputCols=list(terms), outputCol="_features").transform(rows)
    model = LogisticRegression(featuresCol="_features", labelCol="treated", regParam=1.0 / rows.count(), elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-10).fit(ready)
    p = vector_to_array("probability")[1]
    scored = model.transform(ready).withColumn("propensity_score", F.least(F.greatest(p, F.lit(SCORE_FLOOR)), F.lit(1 - SCORE_FLOOR)))
    return scored.select(*frame.columns, "treated", "propensity_score", *terms), terms


def weights(scored: DataFrame, estimand: str = "ate", trim: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """scored with weight: stabilised ATE or ATT odds weights, clipped at quantiles of all weights."""
    p, t, share = F.col("propensity_score"), F.col("treated"), F.col("_share")
    odds = share / (1 - share) * p / (1 - p)
    rule = F.when(t == 1, share / p).otherwise((1 - share) / (1 - p)) if estimand == "ate" else F.when(t == 1, 1.0).otherwise(odds)
    raw = scored.crossJoin(F.broadcast(scored.agg(F.avg("treated").alias("_share")))).withColumn("_w", rule).drop("_share")
    cut = raw.agg(F.percentile("_w", F.lit(trim[0])).alias("_lo"), F.percentile("_w", F.lit(trim[1])).alias("_hi"))
    return raw.crossJoin(F.broadcast(cut)).withColumn("weight", F.least(F.greatest("_w", "_lo"), F.col("_hi"))).drop("_w", "_lo", "_hi")


def weighted_smd(rows: DataFrame, covariates: list[str], weight: str | None = None) -> DataFrame:
    """(covariate, smd) with population-style weighted variances."""
    w = F.col(weight) if weight else F.lit(1.0)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("x")) for c in covariates]))
    long = rows.select("treated", w.alias("w"), each.alias("c")).select("treated", "w", "c.*").where("x is not null")
    on = lambda k, e: F.sum(F.when(F.col("treated") == k, e))
    s = long.groupBy("covariate").agg(*[on(k, e).alias(f"{n}{k}") for k in (0, 1) for n, e in (("w", F.col("w")), ("x", F.col("w") * F.col("x")), ("q", F.col("w") * F.col("x") * F.col("x")))])
    mean = lambda k: F.col(f"x{k}") / F.col(f"w{k}")
    var = lambda k: F.greatest(F.lit(0.0), F.col(f"q{k}") / F.col(f"w{k}") - mean(k) * mean(k))
    pooled = F.sqrt((var(0) + var(1)) / 2)
    return s.select("covariate", F.when(pooled > 0, (mean(1) - mean(0)) / pooled).when(mean(1) == mean(0), 0.0).alias("smd"))


def balance(weighted: DataFrame, covariates: list[str]) -> DataFrame:
    """(covariate, smd_before, smd_after)."""
    before = weighted_smd(weighted, covariates).withColumnRenamed("smd", "smd_before")
    return before.join(weighted_smd(weighted, covariates, "weight").withColumnRenamed("smd", "smd_after"), "covariate")


def effect(weighted: DataFrame, outcome: str) -> DataFrame:
    """One row (mean_exposed, mean_comparator, difference, ratio) of weighted outcome means; missing outcomes are left out."""
    rows = weighted.where(F.col(outcome).isNotNull())
    mean = lambda k: F.sum(F.when(F.col("treated") == k, F.col("weight") * F.col(outcome))) / F.sum(F.when(F.col("treated") == k, F.col("weight")))
    got = rows.agg(mean(1).alias("mean_exposed"), mean(0).alias("mean_comparator"))
    return got.select("*", (F.col("mean_exposed") - F.col("mean_comparator")).alias("difference"), F.when(F.col("mean_comparator") != 0, F.col("mean_exposed") / F.col("mean_comparator")).alias("ratio"))


def bootstrap_effect(scored: DataFrame, terms: list[str], outcome: str, estimand: str = "ate", trim: tuple[float, float] = (0.01, 0.99), replicates: int = 500, seed: int = 1, block: int = 500, bins: int = 512) -> DataFrame:
    """(rep, difference, ratio): the whole adjustment in every replicate, people resampled by Poisson(1) weights.

    scored holds person_id, treated, propensity_score, the design columns
    ``terms`` and the outcome. A replicate refits the propensity model (from the
    coefficients of all people, by Newton steps whose sums are one pass over the
    people for all replicates of a block), makes its own weights, clips them at
    its own quantiles (of a histogram of the log weights with ``bins`` steps,
    refined once) and takes the weighted outcome means. Only sums reach the driver.
    """
    p = len(terms) + 1
    rows = written(scored.where(F.col(outcome).isNotNull()).select(F.col("person_id").cast("long").alias("id"), F.col("treated").cast("double").alias("t"), F.col(outcome).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(terms)]), "resampled")

    def sums(reps, size, run):
        """For each replicate the sum over people of run(x, t, y, w), an array (replicates, size)."""

        def add(batches):
            total = np.zeros((len(reps), size))
            for batch in batches:
                ids, t, y, *xs = (np.asarray(c) for c in batch.columns)
                for lo in range(0, len(ids), 2000):
                    cut = slice(lo, lo + 2000)
                    x = np.column_stack([np.ones(len(ids[cut])), *(c[cut] for c in xs)])
                    total += run(x, t[cut], y[cut], person_weights(ids[cut], reps, seed))
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(list(total), pa.list_(pa.float64()))], ["rep", "v"])

        def added(table):
            total = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, size).sum(0)
            return pa.table({"rep": table.column("rep").slice(0, 1), "v": pa.array([total], pa.list_(pa.float64()))})

        got = rows.mapInArrow(add, "rep long, v array<double>").groupBy("rep").applyInArrow(added, "rep long, v array<double>")
        return np.array([r["v"] for r in sorted(got.collect(), key=lambda r: r["rep"])])

    def expit(eta):
        return 1 / (1 + np.exp(-np.clip(eta, -40, 40)))

    out = []
    for first in range(0, replicates, block):
        reps = np.arange(first, min(first + block, replicates))
        beta, penalty = np.zeros((len(reps), p)), np.diag([0.0] + [1.0] * (p - 1))

        def newton(x, t, y, w, beta):
            q = expit(x @ beta.T)
            score = (w * (t[:, None] - q)).T @ x
            pairs = (x[:, :, None] * x[:, None]).reshape(len(x), -1)
            return np.concatenate([score, (w * q * (1 - q)).T @ pairs, w.T @ np.column_stack([np.ones(len(x)), t])], 1)

        for _ in range(25):
            got = sums(reps, p + p * p + 2, lambda x, t, y, w, b=beta: newton(x, t, y, w, b))
            share = got[:, -1] / got[:, -2]
            score = got[:, :p] - beta @ penalty
            step = np.linalg.solve(got[:, p:-2].reshape(-1, p, p) + penalty, score[..., None])[..., 0]
            beta = beta + step
            if np.abs(step).max() < 1e-7:
                break

        def raw(x, t, beta, share):
            q = np.clip(expit(x @ beta.T), SCORE_FLOOR, 1 - SCORE_FLOOR)
            other = (1 - share) / (1 - q) if estimand == "ate" else share / (1 - share) * q / (1 - q)
            return np.where(t[:, None] == 1, share / q if estimand == "ate" else 1.0, other)

        def histograms(x, t, w, beta, share, lows, steps):
            logs, flat = np.log(raw(x, t, beta, share)), np.arange(len(reps))[None] * (bins + 2) + 1
            at = [(np.clip(np.floor((logs - low) / step), -1, bins).astype(np.int64) + flat).ravel() for low, step in zip(lows, steps, strict=True)]
            return np.concatenate([np.bincount(k, w.ravel(), minlength=len(reps) * (bins + 2)).reshape(len(reps), -1) for k in at], 1)

        # both ends of the trim from one pass a round
        lows, steps = [np.full(len(reps), -16.0) for _ in trim], [np.full(len(reps), 32.0 / bins) for _ in trim]
        for _ in range(3):
            both = sums(reps, len(trim) * (bins + 2), lambda x, t, y, w, b=beta, s=share, lo=tuple(lows), d=tuple(steps): histograms(x, t, w, b, s, lo, d))
            for j, (q, seen) in enumerate(zip(trim, np.split(both, len(trim), 1), strict=True)):
                reach = np.cumsum(seen, 1)
                at = np.array([np.searchsorted(c, q * (c[-1] - 1) + 1e-9, "right") for c in reach])
                lows[j], steps[j] = lows[j] + (np.clip(at, 1, bins) - 1) * steps[j], steps[j] / bins
        limits = [np.exp(low + step * bins / 2) for low, step in zip(lows, steps, strict=True)]

        def means(x, t, y, w, beta, share, floor, top):
            v = w * np.clip(raw(x, t, beta, share), floor, top)
            return np.column_stack([v[t == k].T @ z[t == k] for k in (1, 0) for z in (y, np.ones(len(y)))])

        got = sums(reps, 4, lambda x, t, y, w, b=beta, s=share, lo=limits[0], hi=limits[1]: means(x, t, y, w, b, s, lo, hi))
        with np.errstate(divide="ignore", invalid="ignore"):
            one, two = got[:, 0] / got[:, 1], got[:, 2] / got[:, 3]
            out += [(int(r), float(a - b), float(a / b)) for r, a, b in zip(reps, one, two, strict=True)]
    return scored.sparkSession.createDataFrame(out, "rep long, difference double, ratio double")


def bootstrap_pairs(scored: DataFrame, pairs: DataFrame, outcome: str, replicates: int = 500, seed: int = 1, bins: int = 4096) -> tuple[float, float]:
    """Percentile limits of the mean difference of matched pairs, pairs resampled; differences are rounded to ``bins`` equal steps of their range."""
    y = lambda who: scored.select(F.col("person_id").alias(f"{who}_id"), F.col(outcome).cast("double").alias(who))
    d = written(pairs.join(y("exposed"), "exposed_id").join(y("comparator"), "comparator_id").select((F.col("exposed") - F.col("comparator")).alias("d")), "pair-differences")
    low, high = d.agg(F.min("d"), F.max("d")).first()
    if low is None:
        raise ValueError("no matched pairs")
    step = (high - low) / (bins - 1) or 1.0
    cells = d.groupBy(F.round((F.col("d") - low) / step).cast("int").alias("k")).agg(F.count("*").alias("n"))

    def means(columns, draws):
        with np.errstate(invalid="ignore"):
            return draws @ (low + step * columns["k"]) / draws.sum(1)

    return percentile_limits(replicate_cells(cells, ["k"], means, replicates, seed), replicates)
