"""OMOP loading: block allocation, rekeying, dates, upsert, sidecars, provenance and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom import schemas
from cohortloom.functions.columns import to_date_strict, to_timestamp_strict

BLOCK = 1_000_000
#: Mapping statuses from worst to best.
STATUS_RANK = {"UNMAPPED": 1, "UNCHECKED": 2, "MAPPED": 3, "ALREADY_STANDARD": 4}


def allocate_blocks(patients: DataFrame, ledger: DataFrame) -> DataFrame:
    """(source_patient_id, id_offset): known patients keep their block, new ones get the next ones in id order.

    Ranks come from counts per range partition and a row number inside each, so
    no single task orders all patients.
    """
    known = patients.select("source_patient_id").distinct().join(ledger.select("source_patient_id", "id_offset"), "source_patient_id", "left")
    top = ledger.agg(F.coalesce(F.max("id_offset"), F.lit(0)).alias("top"))
    new = known.where("id_offset is null").select("source_patient_id").repartitionByRange("source_patient_id").withColumn("part", F.spark_partition_id())
    from cohortloom.sources.tables import written

    new = written(new, "new-patients")
    counts = new.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    local = new.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("source_patient_id")))
    placed = local.join(before, "part").crossJoin(top).select("source_patient_id", ((F.floor(F.col("top") / BLOCK) + F.col("before") + F.col("k")) * BLOCK).cast("long").alias("id_offset"))
    return known.where("id_offset is not null").unionByName(placed)


def rekey(rows: DataFrame, table: str, offset: str = "id_offset") -> DataFrame:
    """Local ids of declared key columns plus the patient's offset; null stays null; ids outside the block are refused."""
    ids = set(schemas.id_columns(table)) | {"person_id"}

    def moved(c):
        local = F.col(c).cast("long")
        bad = (local < 0) | (local >= BLOCK)
        return F.when(bad, F.raise_error(F.concat(F.lit(f"{c} leaves its block: "), local.cast("string"))).cast("long")).otherwise(local + F.col(offset)).alias(c)

    return rows.select(*[moved(c) if c in ids else F.col(c) for c in rows.columns])


def coerce_dates(rows: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(typed rows, invalid dates): cells that are no ISO date or datetime become null and are listed with their text, and the patient where rows name one."""
    fields = {f.name: f for f in schemas.REGISTRY[table]}
    dates = [c for c in rows.columns if c in fields and fields[c].type in ("date", "ts")]
    parse = lambda c: to_date_strict(F.col(c)) if fields[c].type == "date" else to_timestamp_strict(F.col(c))
    typed = rows.select(*[parse(c).alias(c) if c in dates else F.col(c) for c in rows.columns])
    key = next(f.name for f in schemas.REGISTRY[table] if f.role == "pk")
    told = [*(["source_patient_id"] if "source_patient_id" in rows.columns else []), F.lit(table).alias("omop_table"), F.col(key).alias("omop_id")]
    if not dates:
        none = rows.select(*told, F.lit("").alias("column_name"), F.lit("").alias("original_value"))
        return typed, none.limit(0)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("original_value"), parse(c).isNull().alias("bad")) for c in dates]))
    bad = rows.select(*told, cells.alias("x")).select("*", "x.*").drop("x")
    return typed, bad.where("bad and original_value is not null").drop("bad")


def replace_patients(existing: DataFrame, new: DataFrame, person: str = "person_id") -> DataFrame:
    """Existing rows without the batch's people, plus the new rows."""
    return existing.join(new.select(person).distinct(), person, "left_anti").unionByName(new)


def unpack_table(responses: DataFrame, table: str) -> DataFrame:
    """Rows of one table of the mapping responses, with the patient id (and block, where responses have it)."""
    stamp = ["source_patient_id", *(["id_offset"] if "id_offset" in responses.columns else [])]
    return responses.select(*stamp, F.explode(f"tables.{table}").alias("r")).select(*stamp, "r.*")


def sidecars(responses: DataFrame) -> dict[str, DataFrame]:
    """mapping, dropped and coverage rows with the registered columns, stamped with patient and vocabulary version.

    Where responses have an id_offset, the mappings' omop_id moves into the patient's
    block as the tables' keys do; null stays null.
    """
    offset = F.col("id_offset") if "id_offset" in responses.columns else F.lit(0)

    def of(name, table, own):
        there = responses.schema[name].dataType.elementType.fieldNames()
        rows = responses.select("source_patient_id", "vocab_version", offset.alias("_offset"), F.explode(name).alias("r"))
        cell = lambda f: own.get(f.name, F.col(f"r.{f.name}") if f.name in there else F.lit(None)).cast(schemas.SPARK_TYPES[f.type]).alias(f.name)
        return rows.select(*[cell(f) for f in schemas.REGISTRY[table]], *([] if "vocab_version" in own else ["vocab_version"]))

    stamp = {c: F.col(c) for c in ("source_patient_id", "vocab_version")}
    there = responses.schema["mappings"].dataType.elementType.fieldNames()
    moved = {"omop_id": F.col("r.omop_id").cast("long") + F.col("_offset")} if "omop_id" in there else {}
    coverage = responses.select("source_patient_id", "summary.*", "vocab_version")
    return {"mapping": of("mappings", "meta.mapping", stamp | moved), "dropped": of("dropped", "meta.dropped", {"source_patient_id": F.col("source_patient_id")}), "coverage": coverage}


def mapping_problem(responses: DataFrame) -> Column:
    """Why a patient's mappings cannot be rekeyed: an id outside the block, or an id of a table that is not registered; else null."""
    there = responses.schema["mappings"].dataType.elementType.fieldNames()
    if "omop_id" not in there or "omop_table" not in there:
        return F.lit(None).cast("string")
    known = [name.split(".")[1] for name in schemas.REGISTRY if name.startswith("omop.")]
    some = lambda test: F.coalesce(F.exists("mappings", lambda m: F.coalesce(m["omop_id"].isNotNull() & test(m), F.lit(False))), F.lit(False))
    strange = some(lambda m: ~F.coalesce(m["omop_table"].isin(known), F.lit(False)))
    return F.when(strange, "mapping of an unknown table").when(some(lambda m: (m["omop_id"] < 0) | (m["omop_id"] >= BLOCK)), "mapping id outside the block")


def read_responses(spark: SparkSession, schema: str, raw: str, enriched: str | None = None) -> DataFrame:
    """Mapping responses, one JSON file per patient; an enriched file overrides the raw one of the same name."""
    read = lambda path: spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file_name", F.col("_metadata.file_name"))
    first = read(raw)
    return latest_responses(first, read(enriched) if enriched else first.limit(0))


def latest_responses(raw: DataFrame, enriched: DataFrame) -> DataFrame:
    """One response per file name; an enriched one overrides the raw one, and of several the one with the smallest bundle hash stands."""
    both = raw.withColumn("_rank", F.lit(1)).unionByName(enriched.withColumn("_rank", F.lit(0)))
    order = Window.partitionBy("file_name").orderBy("_rank", *(["bundle_hash"] if "bundle_hash" in both.columns else []))
    return both.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_rank", "_k")


#: Spellings of a tag that names a document's hash, the document, its pages.
TAG_SPELLINGS = {
    "document_hash": ("document-hash", "document-hash:", "document_hash:"),
    "doc_ref_id": ("document-reference", "doc-ref:", "doc_ref_id:"),
    "source_pages": ("source-pages", "source-pages:", "source_pages:"),
}


def resource_provenance(resources: DataFrame) -> DataFrame:
    """(resource_type, resource_id, origin, document_hash, doc_ref_id, source_pages) from the tags of resources; enriched where a tag says so."""
    tags = F.from_json(F.get_json_object("body", "$.meta.tag"), "array<struct<system: string, code: string>>")
    rows = resources.where("resource_type is not null and id is not null").select("resource_type", F.col("id").alias("resource_id"), F.coalesce(tags, F.array().cast("array<struct<system:string,code:string>>")).alias("tags"))
    system, code = (lambda t: F.lower(F.coalesce(t["system"], F.lit("")))), (lambda t: F.coalesce(t["code"], F.lit("")))

    def value(part, *prefixes):
        """The code of a tag of this system, or what follows a prefix of a code; the last tag counts."""
        fits = lambda t: F.lower(code(t)).rlike(f"^(?:{'|'.join(prefixes)})")
        found = F.filter("tags", lambda t: system(t).contains(part) | fits(t))
        last = F.element_at(found, -1)
        return F.when(F.size(found) > 0, F.when(fits(last), F.regexp_replace(code(last), f"(?i)^(?:{'|'.join(prefixes)})", "")).otherwise(code(last)))

    told = {c: value(*spellings) for c, spellings in TAG_SPELLINGS.items()}
    marked = F.exists("tags", lambda t: ((system(t) == "origin") | system(t).endswith("/origin")) & (F.lower(code(t)) == "enriched"))
    marked = marked | F.exists("tags", lambda t: system(t).contains("provenance") & F.lower(code(t)).isin("enriched", "generated"))
    rows = rows.withColumns(told)
    enriched = marked | F.coalesce("document_hash", "doc_ref_id", "source_pages").isNotNull()
    return rows.select("resource_type", "resource_id", F.when(enriched, "enriched").otherwise("structured").alias("origin"), *told)


def row_provenance(mapping: DataFrame, provenance: DataFrame) -> DataFrame:
    """One row per mapped row: omop_table, omop_id, origin, resource_type, resource_id, document_hash, doc_ref_id, source_pages.

    An enriched resource stands before others, then the smaller id. Mappings without
    a table or an id are left out. Where mappings name a patient, rows are told apart
    by patient and carry it.
    """
    keys = [*(["source_patient_id"] if "source_patient_id" in mapping.columns else []), "omop_table", "omop_id"]
    mapped = mapping.where("omop_table is not null and omop_id is not null").select(*keys, "resource_type", "resource_id")
    joined = mapped.join(provenance, ["resource_type", "resource_id"], "left").withColumn("origin", F.coalesce("origin", F.lit("structured")))
    rest = ["origin", "resource_type", "resource_id", "document_hash", "doc_ref_id", "source_pages"]
    best = F.min_by(F.struct(*rest), F.struct((F.col("origin") != "enriched").cast("int"), "resource_type", "resource_id"))
    return joined.groupBy(*keys).agg(best.alias("x")).select(*keys, "x.*")


def outside_block(responses: DataFrame, names: list[str]) -> Column:
    """Whether any id of a patient's rows leaves the block."""
    out = F.lit(False)
    for name in names:
        field = name.split(".")[1]
        held = {f.name for f in responses.schema["tables"].dataType[field].dataType.elementType}
        ids = sorted(held & (set(schemas.id_columns(name)) | {"person_id"}))
        for c in ids:
            out = out | F.coalesce(F.exists(F.col(f"tables.{field}.{c}"), lambda v: F.coalesce((v < 0) | (v >= BLOCK), F.lit(False))), F.lit(False))
    return out


def with_status(events: DataFrame, mapping: DataFrame, provenance: DataFrame, table: str) -> DataFrame:
    """Events with mapping_status (worst first) and origin (enriched first).

    Both sides are aggregated to one row per event before the join.
    """
    rank = F.coalesce(*[F.when(F.col("mapping_status") == s, r) for s, r in STATUS_RANK.items()], F.lit(9))
    status = mapping.where(F.col("omop_table") == table).groupBy(F.col("omop_id").alias("event_id")).agg(F.min_by("mapping_status", F.struct(rank, "mapping_status")).alias("mapping_status"))
    origin = provenance.where(F.col("omop_table") == table).groupBy(F.col("omop_id").alias("event_id")).agg(F.min_by("origin", F.struct((F.col("origin") != "enriched").cast("int"), "origin")).alias("origin"))
    joined = events.join(status, "event_id", "left").join(origin, "event_id", "left")
    fallback = F.when(F.col("concept_id") > 0, "MAPPED").otherwise("UNCHECKED")
    return joined.withColumn("mapping_status", F.coalesce("mapping_status", fallback)).withColumn("origin", F.coalesce("origin", F.lit("structured")))


def mapping_coverage(mapping: DataFrame) -> DataFrame:
    """(mapping_status, omop_table, n): by status, and by status and table (omop_table null for the former)."""
    return mapping.groupingSets([["mapping_status"], ["mapping_status", "omop_table"]], "mapping_status", "omop_table").agg(F.count("*").alias("n"))


def off_vocabulary(coverage: DataFrame) -> DataFrame:
    """One row (patients, mean, least, most) of the patients' shares of codes outside the vocabularies."""
    rate = F.col("off_vocab_rate")
    return coverage.agg(F.count("*").alias("patients"), F.avg(rate).alias("mean"), F.min(rate).alias("least"), F.max(rate).alias("most"))


def provenance_fractions(events: DataFrame) -> DataFrame:
    """(domain, n, unchecked, unmapped, enriched) shares, overall (domain null) and per domain."""
    share = lambda c: F.avg(c.cast("double"))
    return events.rollup("domain").agg(
        F.count("*").alias("n"), share(F.col("mapping_status") == "UNCHECKED").alias("unchecked"), share(F.col("mapping_status") == "UNMAPPED").alias("unmapped"), share(F.col("origin") == "enriched").alias("enriched")
    )


def code_to_concept(codes: DataFrame, concept_map: DataFrame) -> DataFrame:
    """Codes with concept_id and mapping_status; 0 and UNCHECKED when the map lacks them."""
    joined = codes.join(concept_map, ["source_system", "source_code"], "left")
    return joined.withColumn("concept_id", F.coalesce("concept_id", F.lit(0).cast("long"))).withColumn("mapping_status", F.coalesce("mapping_status", F.lit("UNCHECKED")))


def crosswalk(codes: DataFrame, table: DataFrame) -> DataFrame:
    """(source_system, source_code, target_vocabulary, target_code): the first match of each target vocabulary and code."""
    got = codes.join(table, ["source_system", "source_code"])
    return got.groupBy("source_system", "source_code", "target_vocabulary", "target_code").agg(F.min("rank").alias("rank"))


def mapping_lineage(mapping: DataFrame, ledger: DataFrame, provenance: DataFrame) -> DataFrame:
    """Mapping rows with the patient's ledger row and the row's provenance."""
    return mapping.join(ledger, "source_patient_id", "left").join(provenance.select("omop_table", "omop_id", "origin", "doc_ref_id"), ["omop_table", "omop_id"], "left")
