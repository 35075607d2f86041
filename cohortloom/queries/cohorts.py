"""Queries of code sets, cohorts and windows around the index date."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.columns import age_bucket, age_value, demographic_reason, demographic_value, shift_days
from cohortloom.operators import codesets, cohorts, windows
from cohortloom.sources import tables
from cohortloom.testbed import ctes, load

#: Study plan of the queries: three cohorts over the driver's tables.
PLAN = [
    cohorts.Cohort(
        "urgent_f", index_set="status-f",
        inclusion=(cohorts.Criterion("urgent", 1, (365, 365)), cohorts.Criterion("promo", 1)),
        exclusion=(cohorts.Criterion("status-p", 1, (0, 730)),),
        demographics={"min_age": 18, "max_age": 60},
    ),
    cohorts.Cohort("arm_a", index_set="status-f", demographics={"sex": ("f",)}),
    cohorts.Cohort("arm_b", index_set="status-f", demographics={"sex": ("M",)}, exclusion=(cohorts.Criterion("high", 4),)),
    cohorts.Cohort("fixed", strategy="fixed_date", fixed_date="1998-01-01", inclusion=(cohorts.Criterion("urgent", 1, (None, 0)),)),
]

MATCHED = """matched AS (
    SELECT e.*, s.code_set_name FROM domain_event e JOIN code_set s
      ON e.domain = s.domain AND s.accepted AND ((s.concept_id > 0 AND e.concept_id = s.concept_id) OR e.source_value = s.source_value))"""

#: The same plan in SQL: one row for each person and cohort with the first failing stage.
RESOLVED = (
    MATCHED
    + """,
first_f AS (SELECT person_id, min(event_date) AS d FROM matched WHERE code_set_name = 'status-f' GROUP BY 1),
base AS (
    SELECT c.cohort_name, p.*, CASE WHEN c.cohort_name = 'fixed' THEN DATE '1998-01-01' ELSE f.d END AS index_date
    FROM person p CROSS JOIN (VALUES ('urgent_f'), ('arm_a'), ('arm_b'), ('fixed')) AS c (cohort_name) LEFT JOIN first_f f USING (person_id)),
counted AS (
    SELECT b.cohort_name, b.person_id,
      count(*) FILTER (code_set_name = 'urgent' AND abs(datediff('day', index_date, event_date)) <= 365) AS urgent_near,
      count(*) FILTER (code_set_name = 'promo') AS promo,
      count(*) FILTER (code_set_name = 'status-p' AND datediff('day', index_date, event_date) BETWEEN 0 AND 730) AS p_after,
      count(*) FILTER (code_set_name = 'high') AS high,
      count(*) FILTER (code_set_name = 'urgent' AND event_date <= index_date) AS urgent_before
    FROM base b JOIN matched m ON m.person_id = b.person_id GROUP BY 1, 2),
judged AS (
    SELECT b.*, CASE cohort_name
      WHEN 'urgent_f' THEN CASE WHEN index_date IS NULL THEN 1 WHEN coalesce(urgent_near, 0) < 1 THEN 2 WHEN coalesce(promo, 0) < 1 THEN 3
           WHEN year(index_date) - year_of_birth < 18 OR year(index_date) - year_of_birth > 60 THEN 4 WHEN coalesce(p_after, 0) >= 1 THEN 5 END
      WHEN 'arm_a' THEN CASE WHEN index_date IS NULL THEN 1 WHEN gender_source_value <> 'F' THEN 2 END
      WHEN 'arm_b' THEN CASE WHEN index_date IS NULL THEN 1 WHEN gender_source_value <> 'M' THEN 2 WHEN coalesce(high, 0) >= 4 THEN 3 END
      ELSE CASE WHEN coalesce(urgent_before, 0) < 1 THEN 1 END END AS stage_order
    FROM base b LEFT JOIN counted USING (cohort_name, person_id)),
stages AS (SELECT * FROM (VALUES
    ('urgent_f', 0, 'source population', NULL), ('urgent_f', 1, 'missing_index_date', NULL), ('urgent_f', 2, 'inclusion:urgent', 'required count >= 1'),
    ('urgent_f', 3, 'inclusion:promo', 'required count >= 1'), ('urgent_f', 4, 'demographics', NULL), ('urgent_f', 5, 'exclusion:status-p', 'excluded at count >= 1'),
    ('arm_a', 0, 'source population', NULL), ('arm_a', 1, 'missing_index_date', NULL), ('arm_a', 2, 'demographics', NULL),
    ('arm_b', 0, 'source population', NULL), ('arm_b', 1, 'missing_index_date', NULL), ('arm_b', 2, 'demographics', NULL), ('arm_b', 3, 'exclusion:high', 'excluded at count >= 4'),
    ('fixed', 0, 'source population', NULL), ('fixed', 1, 'inclusion:urgent', 'required count >= 1'), ('fixed', 2, 'demographics', NULL)
  ) AS t (cohort_name, stage_order, stage, detail)),
cohort AS (
    SELECT j.cohort_name, j.person_id, j.index_date, j.stage_order IS NULL AS included,
      CASE WHEN s.stage = 'demographics' THEN CASE
        WHEN j.cohort_name <> 'urgent_f' THEN 'demographics:sex' WHEN year(index_date) - year_of_birth < 18 THEN 'demographics:min_age' ELSE 'demographics:max_age' END
        ELSE s.stage END AS exclusion_reason
    FROM judged j LEFT JOIN stages s USING (cohort_name, stage_order))"""
)

#: The two arms with observation window.
FRAME = (
    RESOLVED
    + """,
frame AS (
    SELECT c.cohort_name, c.person_id, c.index_date, p.gender_source_value, p.year_of_birth, p.race_source_value, p.ethnicity_source_value,
           o.s AS observation_start, o.e AS observation_end
    FROM cohort c JOIN person p USING (person_id) LEFT JOIN (
        SELECT cohort_name, c2.person_id, min(observation_period_start_date) AS s, max(observation_period_end_date) AS e
        FROM cohort c2 JOIN observation_period q ON c2.person_id = q.person_id AND index_date BETWEEN observation_period_start_date AND observation_period_end_date
        GROUP BY 1, 2) o ON o.cohort_name = c.cohort_name AND o.person_id = c.person_id
    WHERE c.included AND c.cohort_name IN ('arm_a', 'arm_b'))"""
)

VIEWS = ("person", "domain_event", "code_set", "observation_period")


def resolved(spark, d, plan=PLAN):
    return cohorts.resolve_cohorts(load(spark, d, "person"), load(spark, d, "domain_event"), load(spark, d, "code_set"), plan)


def matched(spark, d, *names):
    """Matched events, of the named code sets only if any is named."""
    return codesets.match_events(load(spark, d, "domain_event"), load(spark, d, "code_set"), list(names) or None)


def events_of(spark, d, name):
    return matched(spark, d, name)


def frame(spark, d):
    """Arms a and b, included, with the observation window; written, as outcomes and covariates join it several times."""
    rows = resolved(spark, d, [c for c in PLAN if c.name in ("arm_a", "arm_b")])[0]
    out = windows.with_observation(windows.cohort_frame(rows, load(spark, d, "person")), load(spark, d, "observation_period"))
    return tables.written(out, "frame")


def with_ctes(text: str, *parts: str) -> str:
    return ctes(*VIEWS) + "".join(",\n" + p for p in parts) + "\n" + text


def _key(df):
    return df.select("cohort_name", "person_id", *df.columns[-1:])


def _buckets(spark, d):
    b = age_bucket(F.col("year_of_birth"), F.lit("1998-01-01").cast("date"), 5, 65)
    return load(spark, d, "person").select("person_id", b.alias("b")).select("person_id", "b.*")


def order_code_sets(spark, d):
    """Codings seen in orders: a set per priority, some over two domains, some never accepted."""
    return load(spark, d, "orders").select(
        F.col("o_orderpriority").alias("code_set_name"), F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 2 == 0), "visit").otherwise("condition").alias("domain"),
        (F.col("o_orderkey") % 50).alias("concept_id"), F.concat(F.lit("status#"), "o_orderstatus").alias("source_value"),
        F.when(F.col("o_orderstatus") == "F", "MAPPED").when(F.col("o_orderstatus") == "O", "ALREADY_STANDARD").otherwise("UNCHECKED").alias("mapping_status"),
        (F.col("o_orderpriority") != "5-LOW").alias("accepted"),
    ).distinct()


ORDER_SETS = """sets AS (SELECT DISTINCT o_orderpriority AS code_set_name, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0 THEN 'visit' ELSE 'condition' END AS domain,
    o_orderkey % 50 AS concept_id, 'status#' || o_orderstatus AS source_value, CASE o_orderstatus WHEN 'F' THEN 'MAPPED' WHEN 'O' THEN 'ALREADY_STANDARD' ELSE 'UNCHECKED' END AS mapping_status,
    o_orderpriority <> '5-LOW' AS accepted FROM orders)"""


def _event_keys(spark, d):
    keyed = codesets.event_keys(load(spark, d, "domain_event"), load(spark, d, "code_set"))
    return keyed.groupBy("domain", "event_key").agg(F.count("*").alias("n"))


def _references(spark, d):
    out = windows.reference_dates(load(spark, d, "person"), resolved(spark, d)[0].where("cohort_name = 'urgent_f'"), load(spark, d, "observation_period"), "2000-01-01")
    return out


def _reasons(spark, d):
    """The first unmet demand of everybody, with gaps in birth years and index dates."""
    p = load(spark, d, "person")
    k = F.col("person_id")
    person = {"sex": F.col("gender_source_value"), "race": F.col("race_source_value"), "ethnicity": F.col("ethnicity_source_value"), "year_of_birth": F.when(k % 7 > 0, F.col("year_of_birth"))}
    index = F.when(k % 11 > 0, F.lit("1998-06-01").cast("date"))
    demands = {"sex": ("m", "f"), "race": ("building", "MACHINERY", "furniture"), "ethnicity": ("Asia", "EUROPE"), "min_age": 20, "max_age": 60}
    return p.select("person_id", demographic_reason(person, index, **demands).alias("reason"))


def _coding_differences(spark, d):
    sets = order_code_sets(spark, d)
    return codesets.coding_differences(sets.where("concept_id % 7 > 0"), sets.where("concept_id % 5 > 0"))


QUERIES = {
    "demographic_reasons": _reasons,
    "age_values": lambda s, d: load(s, d, "person").select("person_id", age_value(F.col("year_of_birth"), F.lit("1998-01-01").cast("date"), 10, 70).alias("age")),
    "coding_differences": _coding_differences,
    "cohort_attrition": lambda s, d: resolved(s, d)[1],
    "cohort_rows": lambda s, d: resolved(s, d)[0],
    "cohort_totals": lambda s, d: cohorts.cohort_totals(resolved(s, d)[0]),
    "index_dates": lambda s, d: cohorts.index_dates(load(s, d, "person"), matched(s, d, "status-f"), PLAN),
    "code_set_match": lambda s, d: matched(s, d).groupBy("code_set_name").agg(F.count("*").alias("n"), F.count_distinct("person_id").alias("persons")),
    "code_set_problems": lambda s, d: codesets.code_set_problems(order_code_sets(s, d)),
    "code_set_status": lambda s, d: codesets.status_counts(order_code_sets(s, d)),
    "code_set_fingerprints": lambda s, d: codesets.fingerprints(order_code_sets(s, d)),
    "event_keys": _event_keys,
    "observation_window": lambda s, d: frame(s, d).select("cohort_name", "person_id", "observation_start", "observation_end"),
    "window_presence": lambda s, d: _key(windows.window_presence(frame(s, d), events_of(s, d, "urgent"), "urgent_before")),
    "covariates": lambda s, d: windows.assemble_covariates(frame(s, d), matched(s, d, "urgent", "high", "promo"), ["urgent", "high", "promo"]).select("cohort_name", "person_id", "urgent", "high", "promo"),
    "incident_outcome": lambda s, d: _key(windows.incident_outcome(frame(s, d), events_of(s, d, "status-o"), "outcome", 1, 365, 180)),
    "first_event_from_index": lambda s, d: _key(windows.first_event_from_index(frame(s, d), events_of(s, d, "status-p"), "first_p")),
    "reference_dates": _references,
    "age_buckets": _buckets,
    "demographic_value": lambda s, d: load(s, d, "person").select("person_id", demographic_value(F.when(F.col("person_id") % 3 > 0, F.col("race_source_value")), F.lit(8527)).alias("race")),
    "date_shift_days": lambda s, d: load(s, d, "person").select("person_id", shift_days(F.col("person_id"), b"study-salt", 180).alias("shift_days")),
}


def _hmac_sql(key: bytes, message: str) -> str:
    key = key.ljust(64, b"\0")
    pads = ["".join(f"\\x{b ^ p:02X}" for b in key) for p in (0x36, 0x5C)]
    return f"sha256('{pads[1]}'::BLOB || unhex(sha256('{pads[0]}'::BLOB || {message})))"


ORACLES = {
    "demographic_reasons": with_ctes("""SELECT person_id, CASE WHEN race_source_value NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 'demographics:race' WHEN ethnicity_source_value NOT IN ('ASIA', 'EUROPE') THEN 'demographics:ethnicity'
        WHEN person_id % 7 = 0 OR person_id % 11 = 0 THEN 'demographics:age_missing' WHEN 1998 - year_of_birth < 20 THEN 'demographics:min_age' WHEN 1998 - year_of_birth > 60 THEN 'demographics:max_age' END AS reason FROM person"""),
    "age_values": with_ctes("SELECT person_id, CASE WHEN a >= 70 THEN 70 ELSE CAST(a // 10 * 10 AS INT) END AS age FROM (SELECT person_id, greatest(0, 1998 - year_of_birth) AS a FROM person)"),
    "coding_differences": f"""WITH {ORDER_SETS}, c AS (SELECT DISTINCT code_set_name, domain, concept_id, source_value FROM sets)
        SELECT *, CASE WHEN concept_id % 7 > 0 THEN 'plan' ELSE 'artifact' END AS side FROM c WHERE (concept_id % 7 > 0) <> (concept_id % 5 > 0)""",
    "cohort_attrition": with_ctes("""SELECT s.cohort_name, s.stage_order, s.stage,
        CAST((SELECT count(*) FROM judged j WHERE j.cohort_name = s.cohort_name AND (j.stage_order IS NULL OR j.stage_order > s.stage_order)) AS BIGINT) AS remaining,
        CAST((SELECT count(*) FROM judged j WHERE j.cohort_name = s.cohort_name AND j.stage_order = s.stage_order) AS BIGINT) AS removed, s.detail FROM stages s""", RESOLVED),
    "cohort_rows": with_ctes("SELECT * FROM cohort", RESOLVED),
    "cohort_totals": with_ctes("SELECT cohort_name, count(*) FILTER (included) AS included, count(*) AS total FROM cohort GROUP BY 1", RESOLVED),
    "index_dates": with_ctes("SELECT cohort_name, person_id, index_date FROM base", RESOLVED),
    "code_set_match": with_ctes("SELECT code_set_name, count(*) AS n, count(DISTINCT person_id) AS persons FROM matched GROUP BY 1", MATCHED),
    "code_set_problems": f"""WITH {ORDER_SETS} SELECT code_set_name, CASE WHEN count(DISTINCT domain) <> 1 THEN 'several_domains' ELSE 'no_accepted_coding' END AS problem FROM sets
        GROUP BY 1 HAVING count(DISTINCT domain) <> 1 OR count(*) FILTER (accepted) = 0""",
    "code_set_status": f"""WITH {ORDER_SETS} SELECT code_set_name, count(*) FILTER (mapping_status = 'ALREADY_STANDARD') AS already_standard, count(*) FILTER (mapping_status = 'MAPPED') AS mapped,
        count(*) FILTER (mapping_status = 'UNMAPPED') AS unmapped, count(*) FILTER (mapping_status = 'UNCHECKED') AS unchecked FROM sets GROUP BY 1""",
    "code_set_fingerprints": f"""WITH {ORDER_SETS} SELECT code_set_name, sha256(string_agg(h, ',' ORDER BY h)) AS fingerprint FROM (
        SELECT DISTINCT code_set_name, sha256(domain || chr(1) || concept_id || chr(1) || source_value) AS h FROM sets) GROUP BY 1""",
    "event_keys": with_ctes("""SELECT e.domain, coalesce((SELECT min(code_set_name) FROM code_set s WHERE s.domain = e.domain AND s.concept_id > 0 AND s.concept_id = e.concept_id),
        (SELECT min(code_set_name) FROM code_set s WHERE s.domain = e.domain AND s.source_value = e.source_value),
        CASE WHEN concept_id > 0 THEN 'concept:' || concept_id ELSE 'source:' || source_value END) AS event_key, count(*) AS n FROM domain_event e GROUP BY ALL"""),
    "observation_window": with_ctes("SELECT cohort_name, person_id, observation_start, observation_end FROM frame", FRAME),
    "window_presence": with_ctes("""SELECT cohort_name, person_id, CAST(EXISTS (SELECT 1 FROM matched m WHERE m.person_id = f.person_id AND code_set_name = 'urgent'
        AND datediff('day', f.index_date, m.event_date) BETWEEN -365 AND -1) AS INT) AS urgent_before FROM frame f""", FRAME),
    "covariates": with_ctes("SELECT cohort_name, person_id, " + ", ".join(f"""CAST(EXISTS (SELECT 1 FROM matched m WHERE m.person_id = f.person_id AND code_set_name = '{c}'
        AND datediff('day', f.index_date, m.event_date) BETWEEN -365 AND -1) AS INT) AS {c}""" for c in ("urgent", "high", "promo")) + " FROM frame f", FRAME),
    "incident_outcome": with_ctes("""SELECT cohort_name, person_id, CASE WHEN NOT (observation_start <= index_date - 180 AND observation_end >= index_date + 1) OR observation_start IS NULL THEN NULL
        WHEN EXISTS (SELECT 1 FROM matched m WHERE m.person_id = f.person_id AND code_set_name = 'status-o' AND event_date >= index_date - 180 AND event_date < index_date) THEN NULL
        WHEN EXISTS (SELECT 1 FROM matched m WHERE m.person_id = f.person_id AND code_set_name = 'status-o' AND event_date >= index_date + 1 AND event_date <= index_date + 365 AND event_date <= observation_end) THEN 1
        WHEN observation_end >= index_date + 365 THEN 0 END AS outcome FROM frame f""", FRAME),
    "first_event_from_index": with_ctes("""SELECT cohort_name, person_id, (SELECT min(event_date) FROM matched m WHERE m.person_id = f.person_id AND code_set_name = 'status-p' AND event_date >= index_date) AS first_p FROM frame f""", FRAME),
    "reference_dates": with_ctes("""SELECT p.person_id, coalesce((SELECT min(index_date) FROM cohort c WHERE c.person_id = p.person_id AND included AND cohort_name = 'urgent_f'),
        (SELECT min(observation_period_start_date) FROM observation_period o WHERE o.person_id = p.person_id), DATE '2000-01-01') AS reference_date FROM person p""", RESOLVED),
    "age_buckets": with_ctes("""SELECT person_id, CASE WHEN a >= 65 THEN '65+' ELSE lo || '-' || least(lo + 4, 64) END AS age_bucket, CASE WHEN a >= 65 THEN 65 ELSE lo END AS age_bucket_start,
        CASE WHEN a >= 65 THEN NULL ELSE least(lo + 4, 64) END AS age_bucket_end, a >= 65 AS age_capped
        FROM (SELECT person_id, greatest(0, 1998 - year_of_birth) AS a, CAST(greatest(0, 1998 - year_of_birth) // 5 * 5 AS INT) AS lo FROM person)"""),
    "demographic_value": with_ctes("SELECT person_id, CASE WHEN person_id % 3 > 0 THEN race_source_value ELSE '8527' END AS race FROM person"),
    "date_shift_days": with_ctes("SELECT person_id, CAST(list_reduce(list_prepend(0, list_transform(range(0, 32), lambda i: CAST('0x' || substr(h, CAST(i * 2 + 1 AS INT), 2) AS INT))), lambda a, c: (a * 256 + c) % 361) - 180 AS INT) AS shift_days FROM (SELECT person_id, " + _hmac_sql(b"study-salt", "encode(CAST(person_id AS VARCHAR))") + " AS h FROM person)"),
}
