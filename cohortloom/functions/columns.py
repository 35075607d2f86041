"""Column expressions of the study engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six clinical domains and the names accepted for them.
DOMAINS = {
    "condition": "condition", "conditions": "condition", "condition_occurrence": "condition",
    "drug": "drug", "drugs": "drug", "medication": "drug", "drug_exposure": "drug",
    "procedure": "procedure", "procedures": "procedure", "procedure_occurrence": "procedure",
    "measurement": "measurement", "measurements": "measurement", "lab": "measurement",
    "observation": "observation", "observations": "observation",
    "visit": "visit", "visits": "visit", "visit_occurrence": "visit",
}


def source_value(system, code) -> Column:
    """``system#code``."""
    return F.concat(F.col(system) if isinstance(system, str) else system, F.lit("#"), F.col(code) if isinstance(code, str) else code)


def normalize_domain(name: Column) -> Column:
    """One of the six domains for a trimmed, case-blind alias; anything else is an error."""
    known = F.create_map(*[F.lit(x) for pair in DOMAINS.items() for x in pair])
    found = F.element_at(known, F.lower(F.trim(name)))
    return F.when(name.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(found, F.raise_error(F.concat(F.lit("unknown domain: "), name)).cast("string")))


def demographic_value(source: Column, concept: Column) -> Column:
    """The source value, else the concept id as text."""
    return F.coalesce(source, concept.cast("string"))


def age_value(year_of_birth: Column, reference: Column, width: int = 5, cap: int = 90) -> Column:
    """Age as an analysis variable: the start of its bucket."""
    return age_bucket(year_of_birth, reference, width, cap)["age_bucket_start"]


def age_bucket(year_of_birth: Column, reference: Column, width: int = 5, cap: int = 90) -> Column:
    """struct(age_bucket, age_bucket_start, age_bucket_end, age_capped) at the reference date; nulls without a birth year."""
    age = F.greatest(F.lit(0), F.year(reference) - year_of_birth).cast("int")
    low = (F.floor(age / width) * width).cast("int")
    high = F.least(low + width - 1, F.lit(cap - 1)).cast("int")
    text = F.concat(low.cast("string"), F.lit("-"), high.cast("string"))
    none = F.lit(None)
    return F.when(
        year_of_birth.isNull(),
        F.struct(none.cast("string").alias("age_bucket"), none.cast("int").alias("age_bucket_start"), none.cast("int").alias("age_bucket_end"), F.lit(False).alias("age_capped")),
    ).otherwise(
        F.when(age >= cap, F.struct(F.lit(f"{cap}+").alias("age_bucket"), F.lit(cap).alias("age_bucket_start"), none.cast("int").alias("age_bucket_end"), F.lit(True).alias("age_capped"))).otherwise(
            F.struct(text.alias("age_bucket"), low.alias("age_bucket_start"), high.alias("age_bucket_end"), F.lit(False).alias("age_capped"))
        )
    )


def demographic_reason(person: dict[str, Column], index_date: Column, sex=(), race=(), ethnicity=(), min_age=None, max_age=None) -> Column:
    """The first demographic demand that is not met, as ``demographics:<which>``; null when all are."""
    out = F.lit(None).cast("string")
    checks = []
    for name, wanted in (("sex", sex), ("race", race), ("ethnicity", ethnicity)):
        if wanted:
            checks.append((name, ~F.lower(F.coalesce(person[name], F.lit(""))).isin([w.lower() for w in wanted])))
    if min_age is not None or max_age is not None:
        age = F.year(index_date) - person["year_of_birth"]
        checks.append(("age_missing", index_date.isNull() | person["year_of_birth"].isNull()))
        if min_age is not None:
            checks.append(("min_age", age < min_age))
        if max_age is not None:
            checks.append(("max_age", age > max_age))
    for name, fails in reversed(checks):
        out = F.when(fails, f"demographics:{name}").otherwise(out)
    return out


def normalize_reference(reference: Column) -> Column:
    """``Type/id`` of a FHIR reference: no query, fragment, trailing slash or history, last two path parts."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(reference), r"[?#].*$", ""), r"/+$", "")
    plain = F.regexp_replace(plain, r"/_history(/.*)?$", "")
    parts = F.split(plain, "/")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), "/")).otherwise(plain)


def references(body: Column) -> Column:
    """Every ``reference`` string at any depth of a JSON text."""
    return F.regexp_extract_all(body, F.lit(r'"reference"\s*:\s*"([^"]+)"'), F.lit(1))


def to_date_strict(text: Column) -> Column:
    """ISO dates only, null otherwise: a DATE column refuses datetimes and partial dates."""
    dashed = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    return F.coalesce(dashed, F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd")))


def to_timestamp_strict(text: Column) -> Column:
    """ISO dates and datetimes, ``Z`` read as +00:00, as a timestamp without zone; null otherwise."""
    whole = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(whole, F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")).cast("timestamp_ntz"))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 of a binary column, from sha2 and precomputed pads."""
    import hashlib

    if not key:
        raise ValueError("the key must not be empty")
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), message), 256))), 256)


def keyed_value(value: Column, key: bytes, namespace: str, prefix: str) -> Column:
    """prefix + HMAC of namespace, a zero byte and the value; null stays null."""
    message = F.concat(F.lit(bytearray(namespace.encode() + b"\0")), value.cast("string").cast("binary"))
    return F.when(value.isNotNull(), F.concat(F.lit(prefix), hmac_sha256(key, message)))


def shift_days(person_id: Column, salt: bytes, max_days: int = 180) -> Column:
    """A person's date shift in [-max_days, max_days]: HMAC of the id as a big-endian number modulo the width."""
    if max_days < 0:
        raise ValueError("max_days must not be negative")
    width = 2 * max_days + 1
    digest = hmac_sha256(salt, person_id.cast("string").cast("binary"))
    # Eight numbers of 32 bits, each weighted by the remainder of its power of two.
    parts = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") % width * pow(2, 32 * (7 - k), width) for k in range(8)]
    return (sum(parts[1:], parts[0]) % width - max_days).cast("int")


def audit_token(value: Column, key: bytes, length: int = 16) -> Column:
    """A short keyed token that stands for an id in logs."""
    return F.substring(keyed_value(value, key, "audit", ""), 1, length)
