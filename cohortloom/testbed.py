"""Clinical views over the driver's tables, as SQL that Spark and DuckDB both run.

VIEWS maps a view to its SELECT; later views may read earlier ones. ``load``
gives them as DataFrames, ``ctes`` as the WITH list of an oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "person": """
        SELECT c_custkey AS person_id, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender_source_value,
               CAST(1930 + c_custkey % 65 AS INT) AS year_of_birth, c_mktsegment AS race_source_value,
               r_name AS ethnicity_source_value, c_name AS person_source_value
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "observation_period": """
        SELECT o_custkey AS person_id, CAST(min(o_orderdate) AS DATE) - 365 AS observation_period_start_date,
               CAST(max(o_orderdate) AS DATE) + 30 AS observation_period_end_date
        FROM orders GROUP BY o_custkey""",
    "condition_event": """
        SELECT o_orderkey AS event_id, o_custkey AS person_id, CAST(o_orderdate AS DATE) AS event_date,
               CAST(o_orderdate AS DATE) AS end_date,
               CAST(CASE o_orderstatus WHEN 'F' THEN 101 WHEN 'O' THEN 102 ELSE 0 END AS BIGINT) AS concept_id,
               concat('status#', o_orderstatus) AS source_value, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS VARCHAR(10)) AS unit,
               'condition' AS domain FROM orders""",
    "visit_event": """
        SELECT o_orderkey AS event_id, o_custkey AS person_id, CAST(o_orderdate AS DATE) AS event_date,
               CAST(o_orderdate AS DATE) AS end_date, CAST(0 AS BIGINT) AS concept_id,
               concat('priority#', o_orderpriority) AS source_value, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS VARCHAR(10)) AS unit,
               'visit' AS domain FROM orders""",
    "drug_event": """
        SELECT l_orderkey * 10 + l_linenumber AS event_id, o_custkey AS person_id, CAST(l_shipdate AS DATE) AS event_date,
               CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) AS end_date, CAST(0 AS BIGINT) AS concept_id,
               concat('class#', p_type) AS source_value, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS VARCHAR(10)) AS unit,
               'drug' AS domain
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "measurement_event": """
        SELECT event_id, user_id AS person_id, CAST(ts AS DATE) AS event_date, CAST(ts AS DATE) AS end_date,
               CAST(300 AS BIGINT) AS concept_id, concat('event#', event_type) AS source_value, value,
               CASE WHEN event_id % 10 < 7 THEN 'mg/dL' ELSE 'g/L' END AS unit, 'measurement' AS domain FROM events""",
    "domain_event": """
        SELECT * FROM condition_event UNION ALL SELECT * FROM visit_event UNION ALL SELECT * FROM drug_event""",
    "code_mapping": """
        SELECT o_orderkey AS omop_id, 'condition_occurrence' AS omop_table, 'status' AS source_system, o_orderstatus AS source_code,
               concat('pt-', CAST(o_custkey AS VARCHAR(20))) AS source_patient_id,
               CASE o_orderstatus WHEN 'F' THEN 'MAPPED' WHEN 'O' THEN 'ALREADY_STANDARD'
                    ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'UNMAPPED' ELSE 'UNCHECKED' END END AS mapping_status
        FROM orders""",
    "code_set": """
        SELECT * FROM (VALUES
            ('status-f', 'condition', CAST(101 AS BIGINT), 'status#F', true), ('status-p', 'condition', 0, 'status#P', true),
            ('status-o', 'condition', 102, 'status#O', true), ('urgent', 'visit', 0, 'priority#1-URGENT', true),
            ('high', 'visit', 0, 'priority#2-HIGH', true), ('promo', 'drug', 0, 'class#PROMO', true),
            ('retired', 'condition', 102, 'status#O', false)
        ) AS t (code_set_name, domain, concept_id, source_value, accepted)""",
}


def needed(names) -> list[str]:
    """The views that the named ones read, in order of definition."""
    todo, found = list(names), set()
    while todo:
        name = todo.pop()
        if name in VIEWS and name not in found:
            found.add(name)
            todo += [v for v in VIEWS if v != name and re.search(rf"\b(?:FROM|JOIN) {v}\b", VIEWS[name])]
    return [v for v in VIEWS if v in found]


def load(spark: SparkSession, sf_dir: str, name: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """A driver table or a clinical view as a DataFrame; tables and views that a view reads several times are opened once."""
    known = {} if known is None else known
    if name not in known:
        if name not in VIEWS:
            known[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            parts = sorted({m for m in re.findall(r"\b(?:FROM|JOIN) (\w+)", VIEWS[name])})
            text = re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", VIEWS[name])
            known[name] = spark.sql(text, **{p: load(spark, sf_dir, p, known) for p in parts})
    return known[name]


def ctes(*names: str) -> str:
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in needed(names))
