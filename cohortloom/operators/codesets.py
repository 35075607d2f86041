"""Code sets: matching events, checks, keys and fingerprints.

Code sets are small by nature: up to a number of codings they are broadcast, beyond
it joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.sources.tables import small


def match_events(events: DataFrame, code_sets: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Events with ``code_set_name`` for each accepted code set they match (of ``names``, if given), once per set.

    An event matches by concept (above 0) or by source value. The sets' domains,
    which are as few as the event domains, become a filter on the events, so that
    other domains are not scanned; one pass looks up the names by concept and by
    source value and unites them. Null dates are kept.
    """
    accepted = code_sets.where("accepted")
    if names is not None:
        accepted = accepted.where(F.col("code_set_name").isin(names))
    domains = sorted(r[0] for r in accepted.select("domain").distinct().collect())
    of = lambda key: accepted.where(f"{key} is not null").groupBy("domain", key).agg(F.collect_set("code_set_name").alias(f"by_{key}"))
    found = events.where(F.col("domain").isin(domains)).join(small(of("concept_id").where("concept_id > 0")), ["domain", "concept_id"], "left").join(small(of("source_value")), ["domain", "source_value"], "left")
    none = F.array().cast("array<string>")
    names_of = F.array_union(F.coalesce("by_concept_id", none), F.coalesce("by_source_value", none))
    return found.select(*events.columns, F.explode(names_of).alias("code_set_name"))


def code_set_problems(code_sets: DataFrame) -> DataFrame:
    """(code_set_name, problem): sets over several domains or without an accepted coding."""
    got = code_sets.groupBy("code_set_name").agg(F.count_distinct("domain").alias("domains"), F.count_if(F.col("accepted")).alias("accepted"))
    return got.select("code_set_name", F.when(F.col("domains") != 1, "several_domains").when(F.col("accepted") == 0, "no_accepted_coding").alias("problem")).where("problem is not null")


def event_keys(events: DataFrame, code_sets: DataFrame) -> DataFrame:
    """Events with ``event_key``: the first code-set name by concept, else by source value, else ``concept:<id>``, else ``source:<value>``.

    Acceptance is not asked for here.
    """
    concepts = small(code_sets.where("concept_id > 0").groupBy("domain", "concept_id").agg(F.min("code_set_name").alias("by_concept")))
    sources = small(code_sets.where("source_value is not null").groupBy("domain", "source_value").agg(F.min("code_set_name").alias("by_source")))
    joined = events.join(concepts, ["domain", "concept_id"], "left").join(sources, ["domain", "source_value"], "left")
    plain = F.when(F.col("concept_id") > 0, F.concat(F.lit("concept:"), F.col("concept_id").cast("string"))).when(
        F.coalesce(F.col("source_value"), F.lit("")) != "", F.concat(F.lit("source:"), F.col("source_value"))
    )
    return joined.withColumn("event_key", F.coalesce("by_concept", "by_source", plain)).drop("by_concept", "by_source")


def status_counts(code_sets: DataFrame) -> DataFrame:
    """Codings of each set by mapping status."""
    names = ("ALREADY_STANDARD", "MAPPED", "UNMAPPED", "UNCHECKED")
    return code_sets.groupBy("code_set_name").agg(*[F.count_if(F.col("mapping_status") == n).alias(n.lower()) for n in names])


def fingerprints(code_sets: DataFrame) -> DataFrame:
    """(code_set_name, fingerprint): an order-free hash of a set's codings."""
    coding = F.sha2(F.concat_ws("\u0001", "domain", F.coalesce(F.col("concept_id").cast("string"), F.lit("")), F.coalesce("source_value", F.lit(""))), 256)
    return code_sets.groupBy("code_set_name").agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_set(coding))), 256).alias("fingerprint"))


def coding_differences(plan: DataFrame, artifact: DataFrame) -> DataFrame:
    """(code_set_name, domain, concept_id, source_value, side): codings that only the plan or only the artifact has, whatever their order; none when the fingerprints agree."""
    names = ["code_set_name", "domain", "concept_id", "source_value"]
    a, b = plan.select(*names).distinct(), artifact.select(*names).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("plan")).unionByName(b.exceptAll(a).withColumn("side", F.lit("artifact")))
