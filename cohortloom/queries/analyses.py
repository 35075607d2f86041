"""Queries of descriptive, comparative, survival, incidence and pathway analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import stats
from cohortloom.operators import compare, describe, eras, survival, windows
from cohortloom.queries.cohorts import FRAME, events_of, frame, matched, with_ctes
from cohortloom.testbed import ctes, load

ARMS = ("arm_a", "arm_b")


def outcomes(spark, d):
    """Arms with two three-valued outcomes and the acct balance as a value."""
    wanted = {"any_o": ("status-o", 1, 730, 30), "any_urgent": ("urgent", 1, 365, 0)}
    f = windows.incident_outcomes(frame(spark, d), matched(spark, d, "status-o", "urgent"), wanted)
    balance = load(spark, d, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_acctbal").alias("balance"))
    return f.join(balance, "person_id")


def outcome_sql(name, code, start, end, washout):
    inside = f"SELECT 1 FROM matched m WHERE m.person_id = f.person_id AND code_set_name = '{code}' AND event_date"
    return f"""CASE WHEN observation_start IS NULL OR NOT (observation_start <= index_date - {washout} AND observation_end >= index_date + {start}) THEN NULL
        WHEN EXISTS ({inside} >= index_date - {washout} AND event_date < index_date) THEN NULL
        WHEN EXISTS ({inside} BETWEEN index_date + {start} AND index_date + {end} AND event_date <= observation_end) THEN 1
        WHEN observation_end >= index_date + {end} THEN 0 END AS {name}"""


OUTCOMES = FRAME + f""",
outcomes AS (SELECT f.*, {outcome_sql('any_o', 'status-o', 1, 730, 30)}, {outcome_sql('any_urgent', 'urgent', 1, 365, 0)}, c_acctbal AS balance
  FROM frame f JOIN customer ON c_custkey = person_id)"""


def survived(spark, d):
    f = survival.survival_frame(frame(spark, d), events_of(spark, d, "status-o"), None, 1500, events_of(spark, d, "status-p"))
    return f.withColumn("group", F.col("cohort_name"))


SURVIVED = FRAME + """,
ends AS (SELECT f.*, (SELECT min(event_date) FROM matched m WHERE m.person_id = f.person_id AND code_set_name = 'status-o' AND event_date >= index_date) AS o,
   (SELECT min(event_date) FROM matched m WHERE m.person_id = f.person_id AND code_set_name = 'status-p' AND event_date >= index_date) AS p,
   CASE WHEN observation_end < index_date + 1500 THEN observation_end ELSE index_date + 1500 END AS e0 FROM frame f),
ends2 AS (SELECT *, CASE WHEN p IS NULL OR e0 <= p THEN e0 ELSE p END AS e FROM ends),
survived AS (SELECT cohort_name, person_id, cohort_name AS "group", CAST(o IS NOT NULL AND o <= e AS INT) AS event,
   CAST(datediff('day', index_date, CASE WHEN o IS NOT NULL AND o <= e THEN o ELSE e END) AS DOUBLE) AS duration FROM ends2),
times AS (SELECT "group", duration AS time, count(*) AS n, sum(event) AS d FROM survived GROUP BY 1, 2),
risk AS (SELECT "group", time, CAST(sum(n) OVER (PARTITION BY "group" ORDER BY time DESC) AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events, CAST(n - d AS BIGINT) AS censored, 1 AS step FROM times
   UNION ALL SELECT "group", 0.0, CAST(sum(n) AS BIGINT), 0, 0, 0 FROM times GROUP BY 1),
run AS (SELECT *, sum(CASE WHEN events > 0 AND at_risk > events THEN ln(1 - events * 1.0 / at_risk) ELSE 0 END) OVER w AS ls,
   max(CASE WHEN events > 0 AND at_risk <= events THEN 1 ELSE 0 END) OVER w AS dead,
   sum(CASE WHEN events > 0 AND at_risk > events THEN events * 1.0 / (at_risk * (at_risk - events)) ELSE 0 END) OVER w AS g
   FROM risk WINDOW w AS (PARTITION BY "group" ORDER BY time, step ROWS UNBOUNDED PRECEDING)),
km AS (SELECT "group", time, step, CASE WHEN dead = 1 THEN 0.0 ELSE exp(ls) END AS survival,
   CASE WHEN dead = 1 THEN 0.0 WHEN g = 0 THEN exp(ls) ELSE exp(-exp(ln(-ls) + 1.959963984540054 * sqrt(g) / abs(ls))) END AS lower,
   CASE WHEN dead = 1 THEN 0.0 WHEN g = 0 THEN exp(ls) ELSE exp(-exp(ln(-ls) - 1.959963984540054 * sqrt(g) / abs(ls))) END AS upper, at_risk, events, censored FROM run)"""


def drug_classes(spark):
    return spark.createDataFrame([(f"class#{k}", k.lower()) for k in ("PROMO", "STANDARD", "ECONOMY", "SMALL")], "source_value string, drug_class string")


def exposures(spark, d):
    return eras.assign_class(load(spark, d, "drug_event"), drug_classes(spark), ["promo", "standard", "economy"])


def person_eras(spark, d):
    return eras.drug_eras(exposures(spark, d), 30)


ERAS = """expo AS (SELECT person_id, lower(substr(source_value, 7)) AS drug_class, event_date AS s, end_date AS e FROM drug_event WHERE source_value IN ('class#PROMO', 'class#STANDARD', 'class#ECONOMY')),
marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY person_id, drug_class ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 30 THEN 0 ELSE 1 END AS opens FROM expo),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY person_id, drug_class ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS era FROM marked),
eras AS (SELECT person_id, drug_class, min(s) AS era_start, max(e) AS era_end, count(*) AS exposure_count FROM numbered GROUP BY person_id, drug_class, era)"""
LINES = ERAS + """,
turns AS (SELECT *, lag(drug_class) OVER (PARTITION BY person_id ORDER BY era_start, drug_class) AS before FROM eras),
kept AS (SELECT *, row_number() OVER w AS line, datediff('day', lag(era_start) OVER w, era_start) AS days FROM turns WHERE before IS NULL OR before <> drug_class WINDOW w AS (PARTITION BY person_id ORDER BY era_start, drug_class)),
lines AS (SELECT person_id, string_agg(drug_class, ' → ' ORDER BY line) AS sequence, CAST(count(*) AS INT) AS line_count, max(drug_class) FILTER (line = 1) AS line_1, max(drug_class) FILTER (line = 2) AS line_2,
   max(drug_class) FILTER (line = 3) AS line_3, CAST(max(days) FILTER (line = 2) AS INT) AS days_to_line_2, CAST(max(days) FILTER (line = 3) AS INT) AS days_to_line_3 FROM kept WHERE line <= 3 GROUP BY 1)"""


def era_ctes(text, *parts):
    return ctes("drug_event") + "".join(",\n" + p for p in parts) + "\n" + text


def tests(spark, d):
    """One p-value column per outcome from the normal deviate of the risk difference."""
    t = compare.two_by_two(outcomes(spark, d), ["any_o", "any_urgent"], "cohort_name", *ARMS)
    e1, n1, e2, n2 = (F.col(c) for c in ("events_exposed", "n_exposed", "events_comparator", "n_comparator"))
    p = (e1 + e2) / (n1 + n2)
    z = (e1 / n1 - e2 / n2) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    return t.select("outcome", F.exp(-F.abs(z)).alias("p_value"))


WILSON = lambda e, n: (
    f"({e} / {n} + 3.8414588206941254 / (2 * {n})) / (1 + 3.8414588206941254 / {n})",
    f"1.959963984540054 * sqrt({e} / {n} * (1 - {e} / {n}) / {n} + 3.8414588206941254 / (4 * {n} * {n})) / (1 + 3.8414588206941254 / {n})",
)


def _two_by_two_sql():
    (c1, h1), (c2, h2) = WILSON("e1", "n1"), WILSON("e2", "n2")
    return f"""SELECT outcome, CAST(n1 AS BIGINT) AS n_exposed, CAST(e1 AS BIGINT) AS events_exposed, CAST(n2 AS BIGINT) AS n_comparator, CAST(e2 AS BIGINT) AS events_comparator, e1 / n1 - e2 / n2 AS risk_difference,
      greatest(-1.0, e1 / n1 - e2 / n2 - sqrt(pow(e1 / n1 - greatest(0.0, {c1} - {h1}), 2) + pow(least(1.0, {c2} + {h2}) - e2 / n2, 2))) AS lower,
      least(1.0, e1 / n1 - e2 / n2 + sqrt(pow(least(1.0, {c1} + {h1}) - e1 / n1, 2) + pow(e2 / n2 - greatest(0.0, {c2} - {h2}), 2))) AS upper FROM tab"""


TABS = OUTCOMES + """,
long AS (SELECT cohort_name, 'any_o' AS outcome, any_o AS y FROM outcomes UNION ALL SELECT cohort_name, 'any_urgent', any_urgent FROM outcomes),
tab AS (SELECT outcome, CAST(count(*) FILTER (cohort_name = 'arm_a') AS DOUBLE) AS n1, CAST(count(*) FILTER (cohort_name = 'arm_a' AND y = 1) AS DOUBLE) AS e1,
  CAST(count(*) FILTER (cohort_name = 'arm_b') AS DOUBLE) AS n2, CAST(count(*) FILTER (cohort_name = 'arm_b' AND y = 1) AS DOUBLE) AS e2 FROM long WHERE y IS NOT NULL GROUP BY 1)"""

GROUPED = OUTCOMES + """,
grouped AS (SELECT cohort_name AS "group", * FROM outcomes UNION ALL SELECT 'Overall', * FROM outcomes)"""


def _continuous_sql():
    parts = []
    for v in ("balance", "year_of_birth"):
        for s, e in (("n", f"count({v})"), ("missing", f"count(*) - count({v})"), ("mean", f"avg({v})"), ("sd", f"stddev_samp({v})"), ("median", f"quantile_cont(CAST({v} AS DOUBLE), 0.5)"), ("q1", f"quantile_cont(CAST({v} AS DOUBLE), 0.25)"), ("q3", f"quantile_cont(CAST({v} AS DOUBLE), 0.75)")):
            parts.append(f"""SELECT '{v}' AS variable, "group", '{s}' AS statistic, CAST({e} AS DOUBLE) AS value FROM grouped GROUP BY "group\"""")
    return " UNION ALL ".join(parts)


CATEGORICAL = """SELECT v.variable, coalesce(level, 'Missing') AS level, g."group", CASE WHEN n > 0 AND n < 12 THEN NULL ELSE n END AS value,
   CASE WHEN n > 0 AND n < 12 THEN NULL WHEN level IS NULL THEN n * 100.0 / total ELSE n * 100.0 / known END AS percent,
   CASE WHEN n > 0 AND n < 12 THEN '<12' ELSE CAST(n AS VARCHAR) END AS display, n > 0 AND n < 12 AS suppressed
 FROM (SELECT sp.variable, sp."group", sp.level, count(l."group") AS n FROM
        (SELECT * FROM (SELECT DISTINCT variable, level FROM cats UNION SELECT DISTINCT variable, NULL FROM cats) lv CROSS JOIN (SELECT DISTINCT "group" FROM cats) gr) sp
        LEFT JOIN cats l ON l.variable = sp.variable AND l."group" = sp."group" AND l.level IS NOT DISTINCT FROM sp.level GROUP BY 1, 2, 3) v
 JOIN (SELECT variable, "group", count(*) AS total, count(level) AS known FROM cats GROUP BY 1, 2) g ON g.variable = v.variable AND g."group" = v."group\""""
CATS = GROUPED + """,
cats AS (SELECT "group", 'race' AS variable, race_source_value AS level FROM grouped UNION ALL SELECT "group", 'outcome', CAST(any_o AS VARCHAR) FROM grouped)"""


def _categorical(spark, d):
    f = outcomes(spark, d).withColumnRenamed("race_source_value", "race").withColumnRenamed("any_o", "outcome")
    return describe.categorical(f, ["race", "outcome"], "cohort_name", 12)


def _smd(spark, d):
    return describe.smd(outcomes(spark, d), ["balance", "year_of_birth"], ["race_source_value"], "cohort_name", *ARMS)


SMD = """SELECT * FROM (
  SELECT 'balance' AS variable, NULL AS level, (avg(balance) FILTER (a) - avg(balance) FILTER (NOT a)) / sqrt((var_samp(balance) FILTER (a) + var_samp(balance) FILTER (NOT a)) / 2) AS estimate FROM arms
  UNION ALL SELECT 'year_of_birth', NULL, (avg(year_of_birth) FILTER (a) - avg(year_of_birth) FILTER (NOT a)) / sqrt((var_samp(year_of_birth) FILTER (a) + var_samp(year_of_birth) FILTER (NOT a)) / 2) FROM arms
  UNION ALL SELECT 'race_source_value', level, (p1 - p2) / sqrt((p1 + p2) / 2 * (1 - (p1 + p2) / 2)) FROM (
    SELECT race_source_value AS level, count(*) FILTER (a) * 1.0 / (SELECT count(*) FILTER (a) FROM arms) AS p1, count(*) FILTER (NOT a) * 1.0 / (SELECT count(*) FILTER (NOT a) FROM arms) AS p2 FROM arms GROUP BY 1))"""


def _power(spark, d):
    t = compare.two_by_two(outcomes(spark, d), ["any_o", "any_urgent"], "cohort_name", *ARMS)
    n1, n2, e2 = (F.col(c).cast("double") for c in ("n_exposed", "n_comparator", "events_comparator"))
    return t.select("outcome", stats.detectable_binary(n1, n2, e2 / n2).alias("risk_difference"), stats.detectable_hazard_ratio(F.col("events_exposed") + e2, n1 / (n1 + n2)).alias("hazard_ratio"), stats.e_value((F.col("events_exposed") / n1) / (e2 / n2)).alias("e_value"))


QUERIES = {
    "table_one_continuous": lambda s, d: describe.continuous(outcomes(s, d), ["balance", "year_of_birth"], "cohort_name"),
    "table_one_categorical": _categorical,
    "table_one_smd": _smd,
    "outcome_types": lambda s, d: compare.outcome_types(outcomes(s, d), ["any_o", "any_urgent", "balance"]),
    "two_by_two": lambda s, d: compare.two_by_two(outcomes(s, d), ["any_o", "any_urgent"], "cohort_name", *ARMS),
    "multiplicity": lambda s, d: compare.benjamini_hochberg(tests(s, d)),
    "rank_test": lambda s, d: compare.rank_sums(outcomes(s, d).withColumn("year_of_birth", F.col("year_of_birth")), "year_of_birth", "cohort_name", *ARMS),
    "hodges_lehmann": lambda s, d: compare.hodges_lehmann(outcomes(s, d), "year_of_birth", "cohort_name", *ARMS),
    "detectable_effect": _power,
    "survival_frame": lambda s, d: survived(s, d).select("cohort_name", "person_id", "event", "duration"),
    "kaplan_meier": lambda s, d: survival.kaplan_meier(survived(s, d)),
    "rmst": lambda s, d: survival.restricted_mean(survival.kaplan_meier(survived(s, d)), 1000.0),
    "median_survival": lambda s, d: survival.median_survival(survival.kaplan_meier(survived(s, d))),
    "log_rank": lambda s, d: survival.log_rank(survived(s, d), "arm_a"),
    "incidence_rates": lambda s, d: compare.incidence(frame(s, d).where("observation_end > index_date"), events_of(s, d, "urgent")),
    "drug_eras": person_eras,
    "unmatched_exposures": lambda s, d: eras.unmatched_exposures(load(s, d, "drug_event"), drug_classes(s)),
    "therapy_lines": lambda s, d: eras.therapy_lines(person_eras(s, d)),
    "pathway_top": lambda s, d: eras.top_pathways(eras.therapy_lines(person_eras(s, d)), 20),
    "time_to_switch": lambda s, d: eras.time_to_switch(eras.therapy_lines(person_eras(s, d))),
    "exact_tests": lambda s, d: compare.exact_tests(compare.two_by_two(outcomes(s, d), ["any_o", "any_urgent"], "cohort_name", *ARMS)),
    "incidence_intervals": lambda s, d: compare.incidence_intervals(compare.incidence(frame(s, d).where("observation_end > index_date"), events_of(s, d, "urgent"))),
}

Z = 1.959963984540054 + 0.8416212335729143

ORACLES = {
    "table_one_continuous": with_ctes(_continuous_sql(), GROUPED),
    "table_one_categorical": with_ctes(CATEGORICAL, CATS),
    "table_one_smd": with_ctes(SMD, OUTCOMES, "arms AS (SELECT *, cohort_name = 'arm_a' AS a FROM outcomes)"),
    "outcome_types": with_ctes(" UNION ALL ".join(f"SELECT '{c}' AS outcome, CASE WHEN count(DISTINCT {c}) <= 2 AND count({c}) = count(*) FILTER ({c} IN (0, 1)) THEN 'binary' ELSE 'continuous' END AS outcome_type FROM outcomes" for c in ("any_o", "any_urgent", "balance")), OUTCOMES),
    "two_by_two": with_ctes(_two_by_two_sql(), TABS),
    "multiplicity": with_ctes("""SELECT outcome, p_value, least(1.0, min(p_value * m / r) OVER (ORDER BY r DESC)) AS q_value FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p_value) AS r FROM ps)""", TABS,
        "ps AS (SELECT outcome, exp(-abs((e1 / n1 - e2 / n2) / sqrt((e1 + e2) / (n1 + n2) * (1 - (e1 + e2) / (n1 + n2)) * (1 / n1 + 1 / n2)))) AS p_value FROM tab)"),
    "rank_test": with_ctes("""SELECT CAST(n1 AS BIGINT) AS n1, CAST(n - n1 AS BIGINT) AS n2, r1 - n1 * (n1 + 1) / 2 AS u, (r1 - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2) / sqrt(n1 * (n - n1) / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z
        FROM (SELECT CAST(sum(a) AS DOUBLE) AS n1, CAST(sum(t) AS DOUBLE) AS n, sum(a * r) AS r1, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM (SELECT *, sum(t) OVER (ORDER BY v) - t + (t + 1) / 2.0 AS r FROM
          (SELECT year_of_birth AS v, count(*) FILTER (cohort_name = 'arm_a') AS a, count(*) AS t FROM outcomes GROUP BY 1)))""", OUTCOMES),
    "hodges_lehmann": with_ctes("SELECT quantile_cont(CAST(a.year_of_birth - b.year_of_birth AS DOUBLE), 0.5) AS shift FROM outcomes a, outcomes b WHERE a.cohort_name = 'arm_a' AND b.cohort_name = 'arm_b'", OUTCOMES),
    "detectable_effect": with_ctes(f"""SELECT outcome, {Z} * sqrt(e2 / n2 * (1 - e2 / n2) * (1 / n1 + 1 / n2)) AS risk_difference, exp({Z} / sqrt((e1 + e2) * n1 / (n1 + n2) * (1 - n1 / (n1 + n2)))) AS hazard_ratio,
        r + sqrt(r * (r - 1)) AS e_value FROM (SELECT *, CASE WHEN e1 / n1 < e2 / n2 THEN (e2 / n2) / (e1 / n1) ELSE (e1 / n1) / (e2 / n2) END AS r FROM tab)""", TABS),
    "survival_frame": with_ctes("SELECT cohort_name, person_id, event, duration FROM survived", SURVIVED),
    "kaplan_meier": with_ctes('SELECT "group", time, survival, lower, upper, at_risk, events, censored FROM km', SURVIVED),
    "rmst": with_ctes("""SELECT "group", sum(greatest(0.0, least(coalesce(nx, 1000.0), 1000.0) - time) * survival) AS rmst FROM (SELECT *, lead(time) OVER (PARTITION BY "group" ORDER BY time, step) AS nx FROM km) GROUP BY 1""", SURVIVED),
    "median_survival": with_ctes("""SELECT "group", min(time) FILTER (survival <= 0.5) AS median, min(time) FILTER (lower <= 0.5) AS median_lower, min(time) FILTER (upper <= 0.5) AS median_upper FROM km GROUP BY 1""", SURVIVED),
    "log_rank": with_ctes("""SELECT observed, expected, variance, pow(observed - expected, 2) / variance AS statistic FROM (SELECT CAST(sum(d1) AS DOUBLE) AS observed, sum(d * n1 * 1.0 / n) AS expected,
        sum(CASE WHEN n > 1 THEN CAST(n1 AS DOUBLE) * (n - n1) * d * (n - d) / (CAST(n AS DOUBLE) * n * (n - 1)) ELSE 0 END) AS variance FROM (
          SELECT duration, sum(c) OVER (ORDER BY duration DESC) AS n, sum(c1) OVER (ORDER BY duration DESC) AS n1, d, d1 FROM (
            SELECT duration, count(*) AS c, count(*) FILTER (cohort_name = 'arm_a') AS c1, sum(event) AS d, coalesce(sum(event) FILTER (cohort_name = 'arm_a'), 0) AS d1 FROM survived GROUP BY 1)) WHERE d > 0)""", SURVIVED),
    "incidence_rates": with_ctes("""SELECT cohort_name AS "group", count(*) AS n, CAST(sum(e) AS BIGINT) AS events, sum(t) AS person_time, sum(e) / sum(t) * 1000 AS rate FROM (
        SELECT cohort_name, (SELECT count(*) FROM matched m WHERE m.person_id = f.person_id AND code_set_name = 'urgent' AND event_date BETWEEN index_date AND observation_end) AS e,
        datediff('day', index_date, observation_end) / 365.25 AS t FROM frame f WHERE observation_end > index_date) GROUP BY 1""", FRAME),
    "unmatched_exposures": ctes("drug_event") + " SELECT source_value, count(*) AS exposures, count(DISTINCT person_id) AS persons FROM drug_event WHERE source_value NOT IN ('class#PROMO', 'class#STANDARD', 'class#ECONOMY', 'class#SMALL') GROUP BY 1",
    "drug_eras": era_ctes("SELECT * FROM eras", ERAS),
    "therapy_lines": era_ctes("SELECT * FROM lines", LINES),
    "pathway_top": era_ctes("SELECT sequence, count(*) AS count, count(*) * 100.0 / (SELECT count(*) FROM lines) AS percent FROM lines GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", LINES),
    "time_to_switch": era_ctes("""SELECT line, count(*) AS patients_switching, quantile_cont(CAST(days AS DOUBLE), 0.5) AS median_days, quantile_cont(CAST(days AS DOUBLE), 0.25) AS q1_days, quantile_cont(CAST(days AS DOUBLE), 0.75) AS q3_days
        FROM (SELECT 2 AS line, days_to_line_2 AS days FROM lines UNION ALL SELECT 3, days_to_line_3 FROM lines) WHERE days IS NOT NULL GROUP BY 1""", LINES),
}
