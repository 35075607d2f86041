"""Estimators against hand-computed numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import stats
from cohortloom.operators import causal, compare, describe, features, ledger, matching, survival, trajectory
from cohortloom.operators.ledger import chain_problems, with_hashes


def test_fisher_and_risk_difference(spark):
    got = stats.fisher_exact(7, 3, 2, 8)
    assert got["odds_ratio"] == pytest.approx(8.1538354145, abs=1e-6)
    assert got["p_value"] == pytest.approx(0.0697785187, abs=1e-9)
    rows = [("a", int(i < 7)) for i in range(10)] + [("b", int(i < 2)) for i in range(10)]
    table = compare.two_by_two(spark.createDataFrame(rows, "g string, y int"), ["y"], "g", "a", "b").first()
    assert table["risk_difference"] == pytest.approx(0.5)
    assert -1 <= table["lower"] < 0.5 < table["upper"] <= 1


def test_kaplan_meier_and_rmst(spark):
    data = spark.createDataFrame([("g", 1.0, 1), ("g", 2.0, 1), ("g", 2.0, 0), ("g", 3.0, 1)], "group string, duration double, event int")
    curve = survival.kaplan_meier(data)
    rows = curve.orderBy("time").collect()
    assert [r["at_risk"] for r in rows] == [4, 4, 3, 1]
    assert [round(r["survival"], 9) for r in rows] == [1.0, 0.75, 0.5, 0.0]
    assert survival.restricted_mean(curve, 3.0).first()["rmst"] == pytest.approx(2.25)
    assert survival.median_survival(curve).first()["median"] == 2.0


def test_smd(spark):
    rows = [("a", 10.0), ("a", 12.0), ("b", 11.0), ("b", 13.0)]
    got = describe.smd(spark.createDataFrame(rows, "g string, x double"), ["x"], [], "g", "a", "b").first()
    assert got["estimate"] == pytest.approx(-1 / math.sqrt(2))


def test_poisson_and_rate_ratio():
    low, high = stats.poisson_interval(10)
    assert (low, high) == (pytest.approx(4.795389, abs=1e-5), pytest.approx(18.390356, abs=1e-5))
    assert stats.poisson_interval(0)[0] == 0 and stats.poisson_interval(0)[1] == pytest.approx(-math.log(0.025), abs=1e-9)
    same = stats.rate_ratio(10, 100.0, 10, 100.0)
    assert same["estimate"] == 1 and same["lower"] * same["upper"] == pytest.approx(1, abs=1e-6) and same["p_value"] == 1


def test_benjamini_hochberg(spark):
    rows = [("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)]
    got = {r["k"]: r["q_value"] for r in compare.benjamini_hochberg(spark.createDataFrame(rows, "k string, p_value double")).collect()}
    assert got["a"] == pytest.approx(0.03) and got["b"] == pytest.approx(0.04) and got["c"] == pytest.approx(0.04) and got["d"] is None


def test_firth_is_finite_under_separation(spark):
    rows = [(0, 10, 0), (1, 10, 10)]
    got = compare.firth(spark.createDataFrame(rows, "x int, n long, events long"), ["x"])
    # Saturated design: the penalty adds half a case and half a non-case to each cell.
    assert got[1]["estimate"] == pytest.approx(2 * math.log(10.5 / 0.5), abs=1e-5)


def test_cox_two_groups(spark):
    # Without ties the score at 0 and the information are small sums; the estimate is a root of the partial likelihood.
    rows = [(1.0, 1, 1.0), (2.0, 1, 0.0), (3.0, 1, 1.0), (4.0, 0, 0.0), (5.0, 1, 0.0), (6.0, 1, 1.0)]
    got = survival.cox(spark.createDataFrame(rows, "duration double, event int, x double"), ["x"])[0]
    b = math.log(got["estimate"])
    risk = lambda t: [x for d, _, x in rows if d >= t]
    score = sum(x - sum(y * math.exp(b * y) for y in risk(t)) / sum(math.exp(b * y) for y in risk(t)) for t, e, x in rows if e)
    assert score == pytest.approx(0, abs=1e-6)


def test_random_intercept_recovers_slope(spark):
    rows = [(p, t, 5.0 + 2.0 * t + (p % 5) + ((p * 7 + t * 3) % 5 - 2) * 0.1) for p in range(40) for t in range(4)]
    got = trajectory.random_intercept(spark.createDataFrame(rows, "person_id long, time int, value double"))
    assert got[1]["estimate"] == pytest.approx(2.0, abs=0.05)
    with pytest.raises(ValueError):
        trajectory.random_intercept(spark.createDataFrame(rows[:40], "person_id long, time int, value double"))


def test_greedy_matching(spark):
    rows = [(1, 1, 0.5), (2, 1, 0.52), (3, 0, 0.51), (4, 0, 0.525), (5, 0, 0.05), (6, 1, 0.95)]
    got = matching.match(spark.createDataFrame(rows, "person_id long, treated int, propensity_score double"), 0.2)
    assert sorted(map(tuple, got.collect())) == [(1, 3), (2, 4)]


def test_permutation_and_rand(spark):
    rows = [(k, "a", float(k)) for k in range(8)] + [(k, "b", float(k)) for k in range(20, 28)]
    assert compare.permutation_p(spark.createDataFrame(rows, "person_id long, g string, v double"), "v", "g", "a", 99) == pytest.approx(0.01, abs=0.011)
    same = spark.createDataFrame([(i % 3, i % 3) for i in range(9)], "a int, b int")
    assert features.adjusted_rand(same).first()["ari"] == pytest.approx(1)


def numpy_matrix(cells, people):
    """The dense matrix that cells stand for, scaled: people x features in order of names."""
    names = sorted({f for _, f, _ in cells})
    raw = np.full((len(people), len(names)), np.nan)
    for p, f, v in cells:
        raw[people.index(p), names.index(f)] = v
    for k, f in enumerate(names):
        whole = f.rsplit("|", 1)[-1] in ("median", "slope", "latest_before_index") or (f.startswith("demographic|") and "=" not in f)
        raw[np.isnan(raw[:, k]), k] = np.nanmedian(raw[:, k]) if whole else 0.0
    q1, m, q3 = np.quantile(raw, [0.25, 0.5, 0.75], axis=0)
    return names, (raw - m) / np.where(q3 > q1, q3 - q1, 1.0)


CELLS = "person_id long, feature string, value double"


def sparse_cells(seed=4, people=37):
    rng = np.random.default_rng(seed)
    rows = [(p, "m|x|median", float(rng.normal(100, 9))) for p in range(people) if rng.random() < 0.4]
    rows += [(p, "m|x|slope", float(rng.integers(3))) for p in range(people) if rng.random() < 0.9]
    rows += [(p, "demographic|age", float(rng.integers(20, 60))) for p in range(people - 3)]
    rows += [(p, f"demographic|sex={'MF'[p % 2]}", 1.0) for p in range(people)]
    return rows + [(p, f"b|d|k{k}|log1p_count", float(rng.integers(-1, 4))) for p in range(people - 2) for k in range(6) if rng.random() < 0.15 * (k + 1)]


def test_sparse_matrix(spark):
    """Scaled cells and absent values are those of the dense matrix; absent summaries are at the median, not at 0."""
    rows, people = sparse_cells(), list(range(37))
    cells, columns = features.scaled_matrix(spark.createDataFrame(rows, CELLS).repartition(5), 37)
    names, want = numpy_matrix(rows, people)
    absent = {r["feature"]: r["absent"] for r in columns.collect()}
    got = np.array([[absent[f] for f in names]] * 37)
    for r in cells.collect():
        got[r["person_id"], names.index(r["feature"])] = r["value"]
    assert np.allclose(got, want)
    probe = spark.createDataFrame([(1, "x|median", 100.0), (2, "x|median", 102.0), (3, "x|median", 104.0)], CELLS)
    assert features.scaled_matrix(probe, 4)[1].first()["absent"] == 0
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_matrix_hash(spark):
    rows, people = sparse_cells(), spark.range(37).select(F.col("id").alias("person_id"))
    of = lambda cells: features.matrix_hash(*features.scaled_matrix(spark.createDataFrame(cells, CELLS), 37), people)
    first = of(rows)
    assert first == of(rows[::-1]) and first != of([(p, f, v + (k == 5)) for k, (p, f, v) in enumerate(rows)])


def test_svd_against_numpy(spark):
    rows = sparse_cells(7, 60)
    _, dense = numpy_matrix(rows, list(range(60)))
    people = spark.range(60).select(F.col("id").alias("person_id"))
    matrix = features.scaled_matrix(spark.createDataFrame(rows, CELLS).repartition(3), 60)
    got = {r["person_id"]: r["coords"] for r in features.truncated_svd(matrix, people, 4, extra=2).collect()}
    u, s, v = np.linalg.svd(dense, full_matrices=False)
    signs = np.where(v[np.arange(4), np.abs(v[:4]).argmax(axis=1)] < 0, -1.0, 1.0)
    assert np.allclose(np.array([got[p] for p in range(60)]), u[:, :4] * s[:4] * signs, atol=1e-6)


def test_signature(spark):
    rows = [(p, f"f{k}", 1.0) for p in range(12) for k in ((0, 1) if p < 6 else (2, 3))]
    people = spark.range(12).select(F.col("id").alias("person_id"))
    points = features.truncated_svd(features.scaled_matrix(spark.createDataFrame(rows, CELLS), 12), people, 2)
    got = features.cluster(points, 2, 5)
    sizes = sorted(r["n"] for r in got.groupBy("cluster").agg(F.count("*").alias("n")).collect())
    assert sizes == [6, 6] and features.medoids(got).count() == 2


def test_hash_chain(spark):
    rows = spark.createDataFrame([(1, "a", None, None), (2, "b", None, None)], "seq long, step string, prev_hash string, entry_hash string")
    first = with_hashes(rows, ["seq", "step"]).where("seq = 1").first()["expected"]
    chained = rows.withColumn("prev_hash", F.when(F.col("seq") == 1, "0" * 64).otherwise(first))
    chained = with_hashes(chained, ["seq", "step"]).withColumn("entry_hash", F.col("expected")).select("seq", "step", "prev_hash", "entry_hash")
    assert chain_problems(chained, ["seq", "step"]).count() == 0
    bent = chained.withColumn("step", F.when(F.col("seq") == 1, "x").otherwise(F.col("step")))
    assert [r["problem"] for r in chain_problems(bent, ["seq", "step"]).collect()] == ["altered"]
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    told = spark.createDataFrame([("a", "1"), ("b", "3"), ("../c", "4"), ("d", "5")], "path string, sha256 string")
    assert sorted(r["problem"] for r in ledger.artifact_audit(told, files).collect()) == ["changed", "missing", "outside_root"]


def test_surveyed_replicate_counts():
    """Defaults draw as many replicates as the survey names."""
    import inspect

    from cohortloom.plans import jobs

    default = lambda f, k: inspect.signature(f).parameters[k].default
    assert default(trajectory.bootstrap_means, "replicates") == default(jobs.trajectory_analysis, "replicates") == 1000
    assert default(causal.bootstrap_effect, "replicates") == default(jobs.causal_effect, "replicates") == 500
    assert default(survival.rmst_difference_limits, "replicates") == default(jobs.survival_analysis, "replicates") == 1000
    assert default(compare.hodges_lehmann_limits, "replicates") == default(jobs.cohort_compare, "replicates") == 2000
    assert default(compare.permutation_p, "iterations") == default(jobs.cohort_compare, "permutations") == 10_000


def test_boschloo_and_large_fisher():
    # One of two against none of two: Fisher's one-sided p of the table is 1/2; at risk r the tables as extreme have chance 2r(1-r)^3 + ..., largest at 1/2.
    assert stats.boschloo(7, 3, 2, 8) < stats.fisher_exact(7, 3, 2, 8)["p_value"]
    reach = max(sum(math.comb(2, i) * math.comb(2, j) * r ** (i + j) * (1 - r) ** (4 - i - j) for i, j in ((2, 0),)) for r in (0.45, 0.5, 0.55))
    assert stats.boschloo(2, 0, 0, 2) == pytest.approx(2 * reach, abs=1e-6)
    big = stats.fisher_exact(30_000, 70_000, 29_000, 71_000)
    assert big["odds_ratio"] == pytest.approx(30 * 71 / (70 * 29), rel=1e-4) and big["lower"] < big["odds_ratio"] < big["upper"]


def test_weights_by_hand(spark):
    rows = [(1, 1, 0.5), (2, 0, 0.5), (3, 0, 0.2), (4, 0, 0.8)]
    scored = spark.createDataFrame(rows, "person_id long, treated int, propensity_score double")
    # A quarter is treated: the odds of the share are 1/3.
    att = {r["person_id"]: r["weight"] for r in causal.weights(scored, "att", (0.0, 1.0)).collect()}
    assert att == {1: 1.0, 2: pytest.approx(1 / 3), 3: pytest.approx(1 / 12), 4: pytest.approx(4 / 3)}
    ate = {r["person_id"]: r["weight"] for r in causal.weights(scored, "ate", (0.0, 1.0)).collect()}
    assert ate == {1: pytest.approx(0.5), 2: pytest.approx(1.5), 3: pytest.approx(0.9375), 4: pytest.approx(3.75)}


def test_matching_ties_take_the_smaller_id(spark):
    half = math.log(0.5 / 0.5)
    at = lambda x: 1 / (1 + math.exp(-(half + x)))
    rows = [(1, 1, at(0.0)), (9, 0, at(-0.5)), (4, 0, at(0.5)), (3, 0, at(5.0)), (2, 1, at(-5.0))]
    got = matching.match(spark.createDataFrame(rows, "person_id long, treated int, propensity_score double"), 0.2)
    assert sorted(map(tuple, got.collect())) == [(1, 4)]


def people(n, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    sex = rng.choice(["f", "m", "u"], n)
    t = rng.random(n) < 1 / (1 + np.exp(-(0.8 * x + (sex == "m"))))
    y = (rng.random(n) < 0.3 + 0.15 * t + 0.1 * (x > 0)).astype(int)
    return [(int(i), "a" if t[i] else "b", float(x[i]), str(sex[i]), int(y[i])) for i in range(n)]


def test_causal_bootstrap_refits(spark):
    """Against a plain resampling of people that refits the same model; and the point estimate against numpy."""
    from cohortloom.plans import jobs

    rows = people(400)
    df = spark.createDataFrame(rows, "person_id long, cohort_name string, x double, sex string, y int")
    got = jobs.causal_effect(df, "y", "a", ["x", "sex"], replicates=200)["data"].first()
    t, y = np.array([r[1] == "a" for r in rows], float), np.array([r[4] for r in rows], float)
    design = np.column_stack([np.ones(400), [r[2] for r in rows], [float(r[3] == "m") for r in rows], [float(r[3] == "u") for r in rows]])

    def estimate(at):
        x, tt, yy = design[at], t[at], y[at]
        beta = np.zeros(4)
        for _ in range(30):
            q = 1 / (1 + np.exp(-x @ beta))
            penalty = np.diag([0.0, 1.0, 1.0, 1.0])
            beta = beta + np.linalg.solve((x.T * (q * (1 - q))) @ x + penalty, x.T @ (tt - q) - penalty @ beta)
        q, share = 1 / (1 + np.exp(-x @ beta)), tt.mean()
        w = np.where(tt == 1, share / q, (1 - share) / (1 - q))
        w = np.clip(w, *np.quantile(w, [0.01, 0.99]))
        return (w * tt * yy).sum() / (w * tt).sum() - (w * (1 - tt) * yy).sum() / (w * (1 - tt)).sum()

    assert got["difference"] == pytest.approx(estimate(np.arange(400)), abs=1e-3)
    rng = np.random.default_rng(1)
    draws = np.array([estimate(rng.integers(0, 400, 400)) for _ in range(400)])
    low, high = np.quantile(draws, [0.025, 0.975])
    assert got["upper"] - got["lower"] == pytest.approx(high - low, rel=0.25)
    assert got["lower"] < got["difference"] < got["upper"] and got["ratio_lower"] < got["ratio"] < got["ratio_upper"]


def test_rmst_and_shift_limits(spark):
    """Against a plain bootstrap of people."""
    rng = np.random.default_rng(2)
    rows = [(g, float(np.ceil(rng.exponential(20 if g == "a" else 12))), int(rng.random() < 0.8)) for g in ("a", "b") for _ in range(120)]
    df = spark.createDataFrame(rows, "group string, duration double, event int")

    def area(sample):
        left, out, at = 1.0, 0.0, 0.0
        for time in sorted({d for d, _ in sample if d <= 10}):
            out += left * (time - at)
            at = time
            left *= 1 - sum(d == time and e for d, e in sample) / sum(d >= time for d, _ in sample)
        return out + left * (10 - at)

    arms = {g: [(d, e) for k, d, e in rows if k == g] for g in ("a", "b")}
    draws = [area([arms["a"][i] for i in rng.integers(0, 120, 120)]) - area([arms["b"][i] for i in rng.integers(0, 120, 120)]) for _ in range(300)]
    low, high = survival.rmst_difference_limits(df, "a", "b", 10.0)
    want = np.quantile(draws, [0.025, 0.975])
    assert (low, high) == (pytest.approx(want[0], abs=0.3), pytest.approx(want[1], abs=0.3))
    shift = compare.hodges_lehmann(df, "duration", "group", "a", "b").first()["shift"]
    a, b = (np.array([d for d, _ in arms[g]]) for g in ("a", "b"))
    assert shift == np.median(a[:, None] - b[None])
    draws = [np.median(rng.choice(a, 120)[:, None] - rng.choice(b, 120)[None]) for _ in range(300)]
    low, high = compare.hodges_lehmann_limits(df, "duration", "group", "a", "b")
    want = np.quantile(draws, [0.025, 0.975])
    assert (low, high) == (pytest.approx(want[0], abs=1.1), pytest.approx(want[1], abs=1.1))


def test_continuous_values_in_steps(spark):
    """Many distinct values: the shift and ranks are exact."""
    rng = np.random.default_rng(3)
    a, b = rng.normal(0.5, 1, 300), rng.normal(0, 1, 200)
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "g string, v double")
    assert compare.hodges_lehmann(df, "v", "g", "a", "b").first()["shift"] == pytest.approx(np.median(a[:, None] - b[None]), abs=1e-12)
    got = compare.rank_sums(df, "v", "g", "a", "b").first()
    assert got["u"] == (a[:, None] > b[None]).sum()


def test_cox_against_the_partial_likelihood(spark):
    """Ties, a category and the rank test against direct sums."""
    rng = np.random.default_rng(6)
    rows = [(float(rng.integers(1, 15)), int(rng.random() < 0.7), float(rng.normal()), str(rng.choice(["p", "q"]))) for _ in range(150)]
    got = {r["term"]: r for r in survival.cox(spark.createDataFrame(rows, "duration double, event int, x double, c string"), ["x", "c"])}
    assert set(got) == {"x", "c_q"}
    time, event = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    x = np.column_stack([[r[2] for r in rows], [float(r[3] == "q") for r in rows]])
    beta = np.array([math.log(got["x"]["estimate"]), math.log(got["c_q"]["estimate"])])
    w = np.exp(x @ beta)
    score, info, residuals = np.zeros(2), np.zeros((2, 2)), []
    for t in sorted(set(time[event == 1])):
        risk, dead = time >= t, (time == t) & (event == 1)
        d, total = dead.sum(), np.zeros(2)
        for m in range(d):
            v = w * (risk - m / d * dead)
            mean = v @ x / v.sum()
            info += (x.T * v) @ x / v.sum() - np.outer(mean, mean)
            total += mean
        residuals.append((d, x[dead].sum(0) - total))
        score += residuals[-1][1]
    assert score == pytest.approx([0, 0], abs=1e-6)
    variance = np.linalg.inv(info)
    assert math.log(got["x"]["upper"]) - beta[0] == pytest.approx(1.959963984540054 * math.sqrt(variance[0, 0]), rel=1e-6)
    deaths = np.array([d for d, _ in residuals])
    rank = np.cumsum(deaths) - (deaths - 1) / 2
    rank = rank - (rank * deaths).sum() / deaths.sum()
    trend = variance @ sum(r * s for r, (_, s) in zip(rank, residuals)) * deaths.sum()
    want = trend**2 / (deaths.sum() * np.diag(variance) * (rank**2 * deaths).sum())
    assert [got["x"]["ph_statistic"], got["c_q"]["ph_statistic"]] == pytest.approx(want, rel=1e-6)


def test_design(spark):
    from cohortloom.operators.design import design

    rows = [("f", 1.0, 7, True), ("m", None, 7, False), (None, 3.0, 7, True), ("f", 5.0, 7, True)]
    df = spark.createDataFrame(rows, "sex string, x double, same int, flag boolean")
    coded, terms = design(df, ["sex", "x", "same", "flag"], "flag")
    assert list(terms.values()) == ["sex_f", "sex_m", "x_missing", "x", "flag_true"]
    assert [tuple(r) for r in coded.select(*terms).collect()] == [(1, 0, 0, 1, 1), (0, 1, 1, 3, 0), (0, 0, 0, 3, 1), (1, 0, 0, 5, 1)]
    dropped, terms = design(df, ["sex", "x"], "drop")
    assert dropped.count() == 2 and list(terms.values()) == ["x"]
    with pytest.raises(ValueError):
        design(df, ["same"], "flag")


def test_firth_against_numpy(spark):
    rows = people(120, 8)
    df = spark.createDataFrame(rows, "person_id long, cohort_name string, x double, sex string, y int")
    got = compare.adjusted_odds_ratio(df, "y", "cohort_name", "a", ["x", "sex"])
    x = np.column_stack([np.ones(120), [float(r[1] == "a") for r in rows], [r[2] for r in rows], [float(r[3] == "m") for r in rows], [float(r[3] == "u") for r in rows]])
    y, beta = np.array([r[4] for r in rows], float), np.zeros(5)
    for _ in range(200):
        q = 1 / (1 + np.exp(-x @ beta))
        w = q * (1 - q)
        inverse = np.linalg.inv((x.T * w) @ x)
        hat = w * np.einsum("ij,jk,ik->i", x, inverse, x)
        beta = beta + inverse @ (x.T @ (y - q + hat * (0.5 - q)))
    assert got["estimate"] == pytest.approx(math.exp(beta[1]), rel=1e-5)
    assert got["upper"] == pytest.approx(math.exp(beta[1] + 1.959963984540054 * math.sqrt(inverse[1, 1])), rel=1e-5)


def test_interaction_of_the_mixed_model(spark):
    rows = [(p, "a" if p % 2 else "b", t, 5.0 + 2.0 * t + (1.5 * t - 3.0) * (p % 2) + ((p * 7 + t * 3) % 5 - 2) * 0.1 + (p % 6) // 2) for p in range(60) for t in range(4)]
    got = trajectory.random_intercept(spark.createDataFrame(rows, "person_id long, group string, time int, value double"), exposed="a")
    assert [r["term"] for r in got] == ["intercept", "time", "exposed", "time:exposed"]
    assert got[1]["estimate"] == pytest.approx(2.0, abs=0.05) and got[3]["estimate"] == pytest.approx(1.5, abs=0.07) and got[2]["estimate"] == pytest.approx(-3.0, abs=0.6)


def test_at_risk_ticks(spark):
    from cohortloom.plans import jobs

    curve = spark.createDataFrame([("g", 0.0, 10), ("g", 3.0, 9), ("g", 5.0, 6), ("g", 8.0, 1)], "group string, time double, at_risk long")
    assert [r["at_risk"] for r in jobs.risk_at_ticks(curve).orderBy("tick").collect()] == [10, 10, 9, 6, 1]


def test_horizon_beyond_a_group_is_refused(spark):
    curve = survival.kaplan_meier(spark.createDataFrame([("g", 1.0, 1), ("g", 2.0, 0), ("h", 9.0, 1)], "group string, duration double, event int"))
    with pytest.raises(Exception, match="horizon"):
        survival.restricted_mean(curve, 5.0).collect()


def plain_greedy(rows, logit, caliper):
    """One pass over all people: ascending score, nearest free comparator, ties by id."""
    free, pairs = {i for i, t, _ in rows if not t}, []
    for x, i in sorted((logit[i], i) for i, t, _ in rows if t):
        if free:
            best = min(free, key=lambda j: (abs(logit[j] - x), j))
            if abs(logit[best] - x) <= caliper:
                pairs.append((i, best))
                free.remove(best)
    return sorted(pairs)


@pytest.mark.parametrize(("share", "part_rows", "digits"), [(0.3, 11, 9), (0.5, 7, 9), (0.75, 5, 9), (0.5, 1000, 9), (0.5, 6, 1)])
def test_matching_by_parts(spark, share, part_rows, digits):
    """Parts of a few people give what one pass gives: many, even and scarce comparators, and tied scores."""
    rng = np.random.default_rng(int(100 * share) + part_rows)
    x = np.round(rng.normal(size=150), digits)
    rows = [(int(i), int(rng.random() < share), float(1 / (1 + math.exp(-v)))) for i, v in zip(rng.permutation(150), x, strict=True)]
    scored = spark.createDataFrame(rows, "person_id long, treated int, propensity_score double")
    logit = {r[0]: r[1] for r in scored.select("person_id", F.log(F.col("propensity_score") / (1 - F.col("propensity_score")))).collect()}
    got = matching.match(scored, 0.2, part_rows)
    assert sorted(map(tuple, got.collect())) == plain_greedy(rows, logit, 0.2 * float(np.std(list(logit.values()), ddof=1)))


def test_matching_of_nobody(spark):
    schema = "person_id long, treated int, propensity_score double"
    assert matching.match(spark.createDataFrame([], schema)).count() == 0
    assert matching.match(spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.5)], schema)).count() == 0
    assert matching.match(spark.createDataFrame([(1, 0, 0.5), (2, 1, 0.5)], schema)).collect() == [(2, 1)]


@pytest.mark.parametrize(("n", "digits", "few", "ways"), [(41, 9, 50, 4), (40, 9, 50, 16), (60, 1, 20, 3), (33, 0, 10, 4), (300, 9, 1_000_000, 16)])
def test_hodges_lehmann_is_exact(spark, n, digits, few, ways):
    """Against all pairs: continuous and tied values, odd and even numbers of pairs."""
    rng = np.random.default_rng(n + digits)
    a, b = np.round(rng.normal(3, 2, n), digits), np.round(rng.exponential(2, n + 3), digits)
    rows = [(0, "a", float(v)) for v in a] + [(0, "b", float(v)) for v in b] + [(0, "a", None), (0, "c", 9.0)]
    got = compare.hodges_lehmann(spark.createDataFrame(rows, "person_id long, g string, v double"), "v", "g", "a", "b", ways, few).first()["shift"]
    assert got == pytest.approx(np.median(a[:, None] - b[None]), abs=1e-12)


def test_trajectory_bootstrap_is_a_cluster_bootstrap(spark):
    """Limits against the same weights drawn in numpy; several rows of a person share their weight."""
    from cohortloom.operators.resample import person_weights

    rng = np.random.default_rng(8)
    rows = [(p, g, t, float(rng.normal(t, 2))) for p in range(40) for g in ("x", "y")[: 1 + p % 2] for t in (0, 7) for _ in range(1 + p % 3)]
    frame = spark.createDataFrame(rows, "person_id long, `group` string, time int, value double").repartition(4)
    got = {(r["group"], r["time"]): (r["lower"], r["upper"]) for r in trajectory.bootstrap_means(frame, 300, 5).collect()}
    w = person_weights(np.arange(40), np.arange(300), 5)
    for g in "xy":
        for t in (0, 7):
            mine = [(p, v) for p, h, u, v in rows if (h, u) == (g, t)]
            ids, v = np.array([p for p, _ in mine]), np.array([v for _, v in mine])
            means = (w[ids] * v[:, None]).sum(axis=0) / w[ids].sum(axis=0)
            assert np.allclose(got[g, t], np.quantile(means, [0.025, 0.975]))


def test_hodges_lehmann_limits_of_few_values_are_exact(spark):
    """Against the same draws expanded to people and all their pairs; a grid of two steps would be far off."""
    rng = np.random.default_rng(2)
    rows = [(k, "ab"[k % 2], float(rng.choice([0.1, 0.25, 1.7, 3.3, 8.0]) + (k % 2) * 0.4)) for k in range(80)]
    frame = spark.createDataFrame(rows, "person_id long, g string, v double")
    got = compare.hodges_lehmann_limits(frame, "v", "g", "b", "a", 100, 3, bins=3)
    cells = sorted((int(g == "b"), v, sum((h, u) == (g, v) for _, h, u in rows)) for g, v in {(g, v) for _, g, v in rows})
    arm, v, n = (np.array(c) for c in zip(*cells, strict=True))
    shifts = []
    for lo in (0, 50):
        for draw in np.random.default_rng([3, lo]).poisson(n, (50, len(n))):
            a, b = np.repeat(v[arm == 1], draw[arm == 1]), np.repeat(v[arm == 0], draw[arm == 0])
            shifts.append(np.median(a[:, None] - b[None]))
    assert np.allclose(got, np.quantile(shifts, [0.025, 0.975]))


def test_an_adjustment_reads_its_frame_once(spark):
    from cohortloom.plans import jobs

    rng = np.random.default_rng(5)
    read = spark.sparkContext.accumulator(0)
    rows = [(int(i), "a" if i % 2 else "b", float(rng.normal()), "xyz"[i % 3], int(rng.random() < 0.4)) for i in range(300)]

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    frame = spark.createDataFrame(rows, "person_id long, cohort_name string, x double, k string, y int")
    for method in ("iptw", "ps_matching"):
        before = read.value
        got = jobs.causal_effect(frame.mapInArrow(passed, frame.schema), "y", "a", ["x", "k"], method, replicates=60)
        assert got["data"].first()["lower"] is not None and read.value - before == 300


def test_both_ends_of_the_trim_come_from_one_pass(spark, monkeypatch):
    """Passes over the people: one a Newton step, three for both quantiles, one for the means."""
    from cohortloom.operators.resample import STEPS, person_weights

    passes, solve, run = [], np.linalg.solve, type(spark.range(0)).mapInArrow
    monkeypatch.setattr(np.linalg, "solve", lambda *a: passes.append(-1) or solve(*a))
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda *a, **k: passes.append(1) or run(*a, **k))
    rng = np.random.default_rng(6)
    rows = [(int(i), int(rng.random() < 0.5), float(rng.normal()), float(rng.normal())) for i in range(200)]
    got = causal.bootstrap_effect(spark.createDataFrame(rows, "person_id long, treated int, x double, y double"), ["x"], "y", replicates=8)
    assert got.count() == 8 and sum(passes) == 4
    # weights are those of the cumulative Poisson chances
    w = person_weights(np.arange(3000), np.arange(60), 2)
    assert abs(np.mean(w == 0) - STEPS[0]) < 0.01 and abs(w.mean() - 1) < 0.01 and w.min() == 0


def test_a_comparison_reads_its_frame_once(spark):
    from cohortloom.plans import jobs

    rng = np.random.default_rng(7)
    read = spark.sparkContext.accumulator(0)
    frame = spark.createDataFrame([(int(i), "ab"[i % 2], float(rng.normal()), int(rng.random() < 0.4)) for i in range(200)], "person_id long, cohort_name string, x double, y int")

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    got = jobs.cohort_compare(frame.mapInArrow(passed, frame.schema), ["y", "x"], "a", "b", ["x"], permutations=99, replicates=60)
    assert got.count() == 2 and read.value == 200


def test_median_only_of_columns_with_gaps(spark, monkeypatch):
    """An exact median gathers all distinct values; a column without gaps needs none."""
    from cohortloom.operators.design import design

    rows = spark.createDataFrame([(1.0, 3.0), (2.0, None), (4.0, 8.0), (5.0, 4.0)], "x double, y double")
    asked = []
    percentile = F.percentile
    monkeypatch.setattr(F, "percentile", lambda *a: asked.append(a) or percentile(*a))
    design(rows, ["x"], "flag")
    assert not asked
    assert [r["_x_y"] for r in design(rows, ["x", "y"], "flag")[0].orderBy("x").collect()] == [3.0, 4.0, 8.0, 4.0]
    assert len(asked) == 1


def test_matching_rounds_leave_settled_pairs(spark, monkeypatch):
    """Pairs are put together once at the end, not written anew in each round."""
    rng = np.random.default_rng(4)
    rows = [(k, int(t), float(p)) for k, (t, p) in enumerate(zip(rng.random(300) < 0.5, rng.uniform(0.2, 0.8, 300), strict=True))]
    scored, names = spark.createDataFrame(rows, "person_id long, treated int, propensity_score double"), []
    written = matching.written
    monkeypatch.setattr(matching, "written", lambda df, name: names.append(name) or written(df, name))
    got = sorted(map(tuple, matching.match(scored, 0.2, 40).collect()))
    assert names.count("pairs-found") > 1 and names.count("pairs") == 1
    assert got == sorted(map(tuple, matching.match(scored, 0.2, 1000).collect()))
