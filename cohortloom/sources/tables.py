"""Reading and writing tables: registered schemas, frames from one source, results, exports, inventories."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom import schemas


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage with a table in the folder of spark.checkpoint.dir; where it is unset, in one of our own in local mode, and an error on a cluster."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has at most ``rows`` rows, as parameters of a study have; else df, and joins shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def load_frame(spark: SparkSession, query: str | None = None, table: str | None = None, csv: str | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Exactly one source. A query is one SELECT or WITH; a table is a plain name; duplicate columns are refused."""
    given = [x for x in (query, table, csv, rows) if x is not None]
    if len(given) != 1:
        raise ValueError("exactly one of query, table, csv and rows is needed")
    if query is not None:
        text = query.strip().rstrip(";").strip()
        if ";" in text or not re.match(r"(?is)(select|with)\b", text):
            raise ValueError("the query must be one SELECT or WITH")
        out = spark.sql(text)
    elif table is not None:
        if not re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?", table):
            raise ValueError("the table must be a plain name")
        out = spark.table(table)
    else:
        out = rows if rows is not None else spark.read.csv(csv, header=True, inferSchema=True)
    names = [c.lower() for c in out.columns]
    if len(set(names)) < len(names):
        raise ValueError("column names must differ")
    return out


def finite(df: DataFrame) -> DataFrame:
    """Non-finite floats as null."""
    cols = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(*cols)


def write_result(tables: dict[str, DataFrame], folder: str, envelope: dict) -> None:
    """A run's named tidy tables in a folder of its own, then the envelope, which names that folder.

    Readers follow the envelope, so they see whole tables of one run and none that
    an earlier run left; the envelope's file is the last thing written.
    """
    for name in tables:
        if not re.fullmatch(r"[a-z][a-z0-9_]*", name):
            raise ValueError(f"bad table name: {name}")
    spark = next(iter(tables.values())).sparkSession
    run = f"run-{uuid.uuid4().hex}"
    for name, df in tables.items():
        finite(df).write.parquet(f"{folder}/{run}/{name}")
    row = [(k, str(v)) for k, v in sorted({**envelope, "tables": ",".join(sorted(tables)), "run": run}.items())]
    spark.createDataFrame(row, "key string, value string").coalesce(1).write.mode("overwrite").json(f"{folder}/envelope")


def read_result(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(tables, envelope) of the latest run."""
    envelope = {r["key"]: r["value"] for r in spark.read.schema("key string, value string").json(f"{folder}/envelope").collect()}
    return {t: spark.read.parquet(f"{folder}/{envelope['run']}/{t}") for t in envelope["tables"].split(",")}, envelope


def payload_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256, bytes) of every file below the folder, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_replace("path", ".*" + re.escape(folder.split("://")[-1].rstrip("/")) + "/", "").alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def table_hash(df: DataFrame) -> DataFrame:
    """One row (rows, fingerprint): an order-free hash of the contents."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    part = lambda k: F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    return df.select(row.alias("h")).agg(F.count("*").alias("rows"), *[F.sum(part(k)).alias(f"s{k}") for k in range(4)]).select("rows", F.sha2(F.concat_ws(",", "rows", *[F.coalesce(F.col(f"s{k}").cast("string"), F.lit("0")) for k in range(4)]), 256).alias("fingerprint"))


def numeric_problems(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, missing, non_numeric, infinite) of each column in one pass."""
    text = lambda c: F.col(c).cast("string")
    number = lambda c: text(c).try_cast("double")
    counts = {"missing": lambda c: F.col(c).isNull(), "non_numeric": lambda c: F.col(c).isNotNull() & number(c).isNull(), "infinite": lambda c: F.isnan(number(c)) | (F.abs(number(c)) == float("inf"))}
    sums = df.agg(F.count("*").alias("rows"), *[F.count_if(test(c)).alias(f"{c}|{k}") for c in columns for k, test in counts.items()])
    each = [F.struct(F.lit(c).alias("column"), F.col("rows"), *[F.col(f"`{c}|{k}`").alias(k) for k in counts]) for c in columns]
    return sums.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def validated_numeric(df: DataFrame, column: str) -> DataFrame:
    """df with the column as double; missing, non-numeric and infinite cells are refused."""
    bad = numeric_problems(df, [column]).first()
    if bad["missing"] or bad["non_numeric"] or bad["infinite"]:
        raise ValueError(f"{column}: {bad['missing']} missing, {bad['non_numeric']} non-numeric, {bad['infinite']} infinite cells")
    return df.withColumn(column, F.col(column).cast("double"))


def two_groups(df: DataFrame, column: str, exposed: str | None = None) -> tuple[str, str]:
    """(exposed, comparator): the two values of the column, the smaller one first if none is named; any other number is refused."""
    found = [r[0] for r in df.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).distinct().limit(3).collect()]
    if len(found) != 2 or (exposed is not None and exposed not in found):
        raise ValueError(f"{column} must hold two groups")
    first = exposed or min(found)
    return first, next(x for x in found if x != first)


def read_tables(spark: SparkSession, folder: str, names: list[str], views: bool = True) -> dict[str, DataFrame]:
    """Registered tables below ``folder`` (schema/table), with the registered types; other columns and missing ones are refused."""
    out = {}
    for name in names:
        want = schemas.schema(name)
        found = spark.read.parquet(f"{folder}/{name.replace('.', '/')}")
        if set(found.columns) != set(want.fieldNames()):
            raise ValueError(f"{name}: columns differ: {sorted(set(found.columns) ^ set(want.fieldNames()))}")
        out[name] = found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want])
        if views:
            out[name].createOrReplaceTempView(name.replace(".", "_"))
    return out
