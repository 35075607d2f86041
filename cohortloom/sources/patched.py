"""Tables of patients that a batch patches in place: only the buckets of its patients are rewritten.

Every table lies in folders ``bucket=k``. Rows of a person are dealt by person_id,
rows without a person by the patient's block of ids, sidecars by source_patient_id,
so whatever a patient owns in a table is in one bucket and a batch reads and rewrites
the buckets of its patients alone (dynamic partition overwrite).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom import schemas

BLOCK = 1_000_000
#: Tables that are written at a time.
WRITERS = 4


class PatchedTables:
    """A folder of patched tables with a fixed number of buckets.

    A batch that failed half-way is repeated whole: it replaces the same patients
    again. Each rewritten bucket holds a row that marks it, so that a bucket whose
    patients are all gone is replaced as well; ``read`` leaves these rows out.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        told = self._found("layout", "buckets int")
        if told is None:
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{self.root}/layout")
        elif (have := told.first()["buckets"]) != buckets:
            raise ValueError(f"the tables have {have} buckets, not {buckets}")

    def _found(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    @staticmethod
    def owner(table: str) -> str:
        """What tells whose a row is: person_id, id_offset (the block of its key) or source_patient_id."""
        if table.startswith("meta."):
            return "source_patient_id"
        return "person_id" if "person_id" in [f.name for f in schemas.REGISTRY[table]] else "id_offset"

    def _owned(self, table: str) -> Column:
        if (name := self.owner(table)) != "id_offset":
            return F.col(name)
        key = next(f.name for f in schemas.REGISTRY[table] if f.role == "pk")
        return (F.floor(F.col(key) / BLOCK) * BLOCK).cast("long")

    def _bucket(self, owner: Column) -> Column:
        return F.pmod(F.xxhash64(owner), F.lit(self.buckets)).cast("int")

    def _stored(self, table: str) -> DataFrame | None:
        fields = ", ".join(f"{f.name} {schemas.SPARK_TYPES[f.type]}" for f in schemas.REGISTRY[table])
        return self._found(table.replace(".", "/"), f"{fields}, _live boolean, bucket int")

    def read(self, table: str) -> DataFrame:
        """The rows of a table; none if nothing has been written."""
        rows = self._stored(table)
        if rows is None:
            return self.spark.createDataFrame([], schemas.schema(table))
        return rows.where("_live").drop("_live", "bucket")

    def replace(self, patients: DataFrame, tables: dict[str, DataFrame]) -> None:
        """Drops the rows of the patients (source_patient_id, id_offset, person_id) from the named tables and adds the new ones.

        A registered column that new rows lack is null. The numbers of the touched
        buckets, at most as many as there are buckets, are all that the driver sees.
        Tables are independent, so several are written at a time.
        """
        owners = sorted({self.owner(t) for t in tables})
        found = patients.agg(*[F.collect_set(F.when(F.col(o).isNotNull(), self._bucket(F.col(o)))).alias(o) for o in owners]).first()
        jobs = [(t, rows, patients.select(F.col(self.owner(t)).alias("_owner")).where("_owner is not null"), sorted(found[self.owner(t)])) for t, rows in tables.items()]
        with ThreadPoolExecutor(WRITERS) as pool:
            list(pool.map(lambda job: self._rewrite(*job), [j for j in jobs if j[3]]))

    def _rewrite(self, table: str, rows: DataFrame, whose: DataFrame, touched: list[int]) -> None:
        """The touched buckets of one table without the rows of ``whose`` (_owner) and with the new ones."""
        want = schemas.schema(table)
        held = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want]
        kept = new = rows.select(*held)
        stored = self._stored(table)
        if stored is not None:
            old = stored.where(F.col("_live") & F.col("bucket").isin(touched)).withColumn("_owner", self._owned(table))
            kept = new.unionByName(old.join(whose, "_owner", "left_anti").select(*want.fieldNames()))
        marks = self.spark.range(0, self.buckets, 1, 1).select(F.col("id").cast("int").alias("bucket")).where(F.col("bucket").isin(touched)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in want], F.lit(False).alias("_live"), "bucket")
        out = kept.withColumn("_live", F.lit(True)).withColumn("bucket", self._bucket(self._owned(table))).unionByName(marks)
        out.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/{table.replace('.', '/')}")
