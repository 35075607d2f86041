"""De-identification: column policy, date shift, audits, k-anonymity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom import schemas
from cohortloom.functions.columns import age_bucket, keyed_value, shift_days


def policy_difference(spark: SparkSession, found: dict[str, DataFrame]) -> DataFrame:
    """(table, column, side): columns in the data that the registry lacks (``unregistered``) and the reverse (``missing``)."""
    have = spark.createDataFrame([(t, c) for t, df in found.items() for c in df.columns], "table string, column string")
    want = spark.createDataFrame([(t, f.name) for t, fs in schemas.REGISTRY.items() for f in fs], "table string, column string")
    return have.exceptAll(want).withColumn("side", F.lit("unregistered")).unionByName(want.exceptAll(have).withColumn("side", F.lit("missing")))


def apply_policy(df: DataFrame, table: str, key: bytes, shift: bool = False, max_days: int = 180) -> DataFrame:
    """The table's columns under their action; unregistered columns are refused; dropped tables come back empty.

    With shift, every registered date of a person moves by the person's offset.
    """
    fields = {f.name: f for f in schemas.REGISTRY[table]}
    unknown = sorted(set(df.columns) - set(fields))
    if unknown:
        raise ValueError(f"{table}: columns without a policy: {', '.join(unknown)}")
    moved = set(schemas.date_columns(table)) if shift and "person_id" in fields else set()
    offset = shift_days(F.col("person_id"), key, max_days)

    def cell(f):
        kind = schemas.SPARK_TYPES[f.type]
        if f.action == "null":
            return F.lit(None).cast(kind).alias(f.name)
        if f.action == "hmac":
            return keyed_value(F.col(f.name), key, *schemas.KEYED[f.name]).alias(f.name)
        if f.action == "constant":
            return F.lit(schemas.CONSTANT_TIME).cast(kind).alias(f.name)
        if f.name in moved:
            new = F.date_add(f.name, offset) if f.type == "date" else F.col(f.name) + F.make_dt_interval(offset)
            return new.cast(kind).alias(f.name)
        return F.col(f.name)

    out = df.select(*[cell(fields[c]) for c in df.columns])
    return out.limit(0) if schemas.is_dropped(table) else out


def date_shift(df: DataFrame, columns: list[str], salt: bytes, max_days: int = 180) -> DataFrame:
    """Dates of a person moved by one offset, so that intervals stay."""
    offset = shift_days(F.col("person_id"), salt, max_days)
    types = dict(df.dtypes)
    return df.select(*[(F.date_add(c, offset) if types[c] == "date" else F.col(c) + F.make_dt_interval(offset)).alias(c) if c in columns else F.col(c) for c in df.columns])


def audit_policy(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, action, violations) with violations above 0, over the shared tables."""
    parts = []
    for table, df in tables.items():
        if schemas.is_dropped(table):
            parts.append(df.agg(F.count("*").alias("violations")).select(F.lit(table).alias("table"), F.lit("*").alias("column"), F.lit("drop").alias("action"), "violations"))
            continue
        checks = []
        for f in schemas.REGISTRY[table]:
            c = F.col(f.name)
            if f.action == "null":
                checks.append((f, c.isNotNull()))
            elif f.action == "hmac":
                checks.append((f, c.isNotNull() & ~c.rlike(f"^{schemas.KEYED[f.name][1]}[0-9a-f]{{64}}$")))
            elif f.action == "constant":
                checks.append((f, ~c.eqNullSafe(F.lit(schemas.CONSTANT_TIME).cast("timestamp_ntz"))))
        if checks:
            sums = df.agg(*[F.count_if(bad).alias(f.name) for f, bad in checks])
            rows = F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.action).alias("action"), F.col(f.name).alias("violations")) for f, _ in checks]))
            parts.append(sums.select(F.lit(table).alias("table"), rows.alias("x")).select("table", "x.*"))
    if not parts:  # no table with a rule to break
        return next(iter(tables.values())).sparkSession.createDataFrame([], "table string, column string, action string, violations long")
    return reduce(DataFrame.unionByName, parts).where("violations > 0")


def person_demographics(persons: DataFrame, references: DataFrame, width: int = 5, cap: int = 90) -> DataFrame:
    """study.person_demographic, taken before the birth year is nulled."""
    joined = persons.select("person_id", "year_of_birth").join(references, "person_id", "left")
    return joined.select("person_id", age_bucket(F.col("year_of_birth"), F.col("reference_date"), width, cap).alias("b"), "reference_date").select("person_id", "b.*", "reference_date")


def k_anonymity(rows: DataFrame, quasi: list[str], k: int = 5) -> DataFrame:
    """One row (k, minimum_cell_size, groups_below_k, patient_count); nulls group together."""
    cells = rows.groupBy(*quasi).agg(F.count("*").alias("n"))
    return cells.agg(F.lit(k).alias("k"), F.min("n").alias("minimum_cell_size"), F.count_if(F.col("n") < k).alias("groups_below_k"), F.sum("n").alias("patient_count"))


def identifier_audit(persons: DataFrame, mapping: DataFrame) -> DataFrame:
    """(check, n) of counts that must be zero in a shared copy."""
    p = persons.agg(*[F.count(c).alias(c) for c in ("year_of_birth", "birth_datetime", "person_source_value", "location_id")])
    m = mapping.agg(F.count_if(F.col("source_patient_id").isNotNull() & ~F.col("source_patient_id").startswith("tok_")).alias("source_patient_id"), F.count_if(F.col("resource_id").isNotNull() & ~F.col("resource_id").startswith("tok_")).alias("resource_id"))
    rows = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in df.columns])).alias("x")).select("x.*")
    return rows(p).unionByName(rows(m))


def deidentify(tables: dict[str, DataFrame], key: bytes, shift: bool = False, max_days: int = 180) -> dict[str, DataFrame]:
    """All registered tables under the policy; an unknown table is refused."""
    unknown = sorted(set(tables) - set(schemas.REGISTRY))
    if unknown:
        raise ValueError(f"tables without a policy: {', '.join(unknown)}")
    return {t: apply_policy(df, t, key, shift, max_days) for t, df in tables.items()}


def export_parquet(shared: dict[str, DataFrame], folder: str) -> None:
    """ZSTD Parquet of every table with its registered columns; refused when the audit finds a violation."""
    spark = next(iter(shared.values())).sparkSession
    extra = policy_difference(spark, shared).where("side = 'unregistered'")
    if not extra.isEmpty() or not audit_policy(shared).isEmpty():
        raise ValueError("the shared tables break the column policy")
    for table, df in shared.items():
        names = [f.name for f in schemas.REGISTRY[table] if f.name in df.columns]
        df.select(*names).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{table.replace('.', '/')}")
