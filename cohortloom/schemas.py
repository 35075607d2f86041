"""Registry of the study tables: columns, roles and shared-zone actions.

Fixed values. A column is ``name:type`` with ``*`` for the primary key, ``+`` for
a foreign key, and the action in the shared zone: none kept, ``^N`` nulled, ``^H``
keyed hash, ``^C`` constant, ``^D`` dropped with its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StructType

_TABLES = """
omop.location | *location_id:long^D, address_1:string^D, address_2:string^D, city:string^D, state:string^D, zip:string^D, county:string^D, location_source_value:string^D, country_concept_id:long^D, country_source_value:string^D, latitude:double^D, longitude:double^D
omop.care_site | *care_site_id:long^D, care_site_name:string^D, place_of_service_concept_id:long^D, +location_id:long^D, care_site_source_value:string^D, place_of_service_source_value:string^D
omop.provider | *provider_id:long^D, provider_name:string^D, npi:string^D, dea:string^D, specialty_concept_id:long^D, +care_site_id:long^D, year_of_birth:int^D, gender_concept_id:long^D, provider_source_value:string^D, specialty_source_value:string^D, specialty_source_concept_id:long^D, gender_source_value:string^D, gender_source_concept_id:long^D
omop.person | *person_id:long, gender_concept_id:long, year_of_birth:int^N, month_of_birth:int^N, day_of_birth:int^N, birth_datetime:ts^N, race_concept_id:long, ethnicity_concept_id:long, +location_id:long^N, person_source_value:string^N, gender_source_value:string, race_source_value:string, ethnicity_source_value:string
omop.death | *person_id:long, death_date:date, death_datetime:ts, death_type_concept_id:long, cause_concept_id:long, cause_source_value:string, cause_source_concept_id:long
omop.observation_period | *observation_period_id:long, +person_id:long, observation_period_start_date:date, observation_period_end_date:date, period_type_concept_id:long
omop.visit_occurrence | *visit_occurrence_id:long, +person_id:long, visit_concept_id:long, visit_start_date:date, visit_start_datetime:ts, visit_end_date:date, visit_end_datetime:ts, visit_type_concept_id:long, +provider_id:long^N, +care_site_id:long^N, visit_source_value:string
omop.condition_occurrence | *condition_occurrence_id:long, +person_id:long, condition_concept_id:long, condition_start_date:date, condition_start_datetime:ts, condition_end_date:date, condition_type_concept_id:long, +visit_occurrence_id:long, +provider_id:long^N, condition_source_value:string, condition_source_concept_id:long, condition_status_source_value:string
omop.drug_exposure | *drug_exposure_id:long, +person_id:long, drug_concept_id:long, drug_exposure_start_date:date, drug_exposure_start_datetime:ts, drug_exposure_end_date:date, drug_type_concept_id:long, stop_reason:string^N, sig:string^N, +visit_occurrence_id:long, +provider_id:long^N, drug_source_value:string, drug_source_concept_id:long
omop.procedure_occurrence | *procedure_occurrence_id:long, +person_id:long, procedure_concept_id:long, procedure_date:date, procedure_datetime:ts, procedure_type_concept_id:long, +visit_occurrence_id:long, +provider_id:long^N, procedure_source_value:string, procedure_source_concept_id:long
omop.measurement | *measurement_id:long, +person_id:long, measurement_concept_id:long, measurement_date:date, measurement_datetime:ts, measurement_type_concept_id:long, value_as_number:double, operator_concept_id:long, value_as_concept_id:long, unit_concept_id:long, range_low:double, range_high:double, +visit_occurrence_id:long, +provider_id:long^N, measurement_source_value:string, measurement_source_concept_id:long, unit_source_value:string, value_source_value:string^N
omop.observation | *observation_id:long, +person_id:long, observation_concept_id:long, observation_date:date, observation_datetime:ts, observation_type_concept_id:long, value_as_number:double, value_as_string:string^N, value_as_concept_id:long, unit_concept_id:long, +visit_occurrence_id:long, +provider_id:long^N, observation_source_value:string, observation_source_concept_id:long, unit_source_value:string, value_source_value:string^N
meta.ingest_patient | source_patient_id:string^H, person_id:long, id_offset:long, bundle_hash:string^H, response_hash:string^H, status:string, error:string^N, updated_at:ts^C
meta.mapping | source_patient_id:string^H, resource_type:string, resource_id:string^H, omop_table:string, omop_id:long, source_system:string, source_code:string, source_name:string^N, target_vocabulary:string, target_code:string, target_name:string^N, mapping_status:string, note:string^N, vocab_version:string
meta.coverage | source_patient_id:string^H, codes_already_standard:long, codes_normalized:long, codes_unmapped:long, off_vocab_rate:double, vocab_version:string
meta.row_provenance | source_patient_id:string^H, omop_table:string, omop_id:long, origin:string, resource_type:string, resource_id:string^H, doc_ref_id:string^H, document_hash:string^H, source_pages:string^N
meta.dropped | source_patient_id:string^H, resource_type:string, resource_id:string^H, reason:string^N
meta.invalid_date | source_patient_id:string^H, omop_table:string, omop_id:long, column_name:string, original_value:string^N
study.code_set | code_set_name:string, domain:string, concept_id:long, source_system:string, source_code:string, source_value:string, display:string, mapping_status:string, accepted:boolean
study.cohort | cohort_name:string, person_id:long, index_date:date, included:boolean, exclusion_reason:string
study.attrition | cohort_name:string, stage_order:int, stage:string, remaining:long, removed:long, detail:string
study.person_demographic | person_id:long, age_bucket:string, age_bucket_start:int, age_bucket_end:int, age_capped:boolean, reference_date:date
"""

#: Keyed-hash namespace and prefix of each hashed column.
KEYED = {
    "source_patient_id": ("source-patient-id", "tok_"),
    "resource_id": ("fhir-resource-id", "tok_"),
    "doc_ref_id": ("document-reference-id", "tok_"),
    "document_hash": ("document-content", "hmac_"),
    "bundle_hash": ("input-bundle-content", "hmac_"),
    "response_hash": ("mapping-response-content", "hmac_"),
}
CONSTANT_TIME = "1970-01-01 00:00:00"
ACTIONS = {"N": "null", "H": "hmac", "C": "constant", "D": "drop", "": "keep"}
SPARK_TYPES = {"long": "bigint", "string": "string", "double": "double", "int": "int", "date": "date", "ts": "timestamp_ntz", "boolean": "boolean"}


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    role: str
    action: str


def _field(text: str) -> Field:
    text, _, action = text.strip().partition("^")
    role = {"*": "pk", "+": "fk"}.get(text[0], "")
    name, _, kind = text.lstrip("*+").partition(":")
    return Field(name, kind, role, ACTIONS[action])


REGISTRY: dict[str, list[Field]] = {
    line.split("|")[0].strip(): [_field(x) for x in line.split("|")[1].split(",")] for line in _TABLES.strip().splitlines()
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(", ".join(f"{f.name} {SPARK_TYPES[f.type]}" for f in REGISTRY[table]))


def id_columns(table: str) -> list[str]:
    """Declared key columns; concepts are never among them."""
    return [f.name for f in REGISTRY[table] if f.role]


def date_columns(table: str) -> list[str]:
    """Columns that a date shift moves."""
    if table.startswith("meta.") or table == "study.attrition":
        return []
    return [f.name for f in REGISTRY[table] if f.type in ("date", "ts")]


def is_dropped(table: str) -> bool:
    return all(f.action == "drop" for f in REGISTRY[table])
