"""Ledger: chain check, latest declarations, artifact audit, shareable copy, freshness, review evidence.

Rows: seq, step, status, params map, inputs map<path, sha256>, outputs map,
items, api_calls array<struct<endpoint, count, ms, credits>>, prev_hash, entry_hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.sources.tables import written


def entry_text(*columns: str):
    """Canonical text of an entry: named fields as sorted JSON, without its own hash."""
    return F.to_json(F.struct(*sorted(columns)))


def with_hashes(entries: DataFrame, columns: list[str], genesis: str = "0" * 64) -> DataFrame:
    """Recomputed body hash of each entry; the chain hash covers the previous entry's hash and the body."""
    return entries.withColumn("body_hash", F.sha2(entry_text(*columns), 256)).withColumn("expected", F.sha2(F.concat(F.coalesce("prev_hash", F.lit(genesis)), "body_hash"), 256))


def chain_problems(entries: DataFrame, columns: list[str], genesis: str = "0" * 64) -> DataFrame:
    """(seq, problem): entries whose hash does not match or that do not follow the one before.

    Entries are compared inside range partitions of seq; the first of a partition is
    compared with the last of the partition before, so no task holds the whole chain.
    """
    checked = written(with_hashes(entries, columns, genesis).repartitionByRange("seq").withColumn("_part", F.spark_partition_id()), "chain")
    last = checked.groupBy("_part").agg(F.max_by("entry_hash", "seq").alias("_last"))
    carried = last.select("_part", F.lag("_last", 1, genesis).over(Window.orderBy("_part")).alias("_carried"))  # one row per partition
    order = Window.partitionBy("_part").orderBy("seq")
    first = F.row_number().over(order) == 1
    linked = checked.join(carried, "_part").withColumn("before", F.when(first, F.col("_carried")).otherwise(F.lag("entry_hash").over(order)))
    altered, broken = ~F.col("entry_hash").eqNullSafe(F.col("expected")), ~F.col("prev_hash").eqNullSafe(F.col("before"))
    return linked.select("seq", F.when(altered, "altered").when(broken, "broken_link").alias("problem")).where("problem is not null")


def latest_declarations(entries: DataFrame, side: str = "outputs") -> DataFrame:
    """(path, sha256, seq, step): the last successful declaration of each path."""
    rows = entries.where("status = 'ok'").select("seq", "step", F.explode(side).alias("path", "sha256"))
    return rows.groupBy("path").agg(F.max_by(F.struct("sha256", "seq", "step"), "seq").alias("x")).select("path", "x.*")


def last_status(entries: DataFrame) -> DataFrame:
    return entries.groupBy("step").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def lineage(entries: DataFrame) -> DataFrame:
    """(producer, consumer, path): an entry reads a path with the hash that another wrote."""
    out = entries.select(F.col("seq").alias("producer"), F.explode("outputs").alias("path", "sha256"))
    into = entries.select(F.col("seq").alias("consumer"), F.explode("inputs").alias("path", "sha256"))
    return out.join(into, ["path", "sha256"]).where("producer < consumer").groupBy("path", "consumer").agg(F.max("producer").alias("producer"))


def directory_digests(inventory: DataFrame, wanted: DataFrame | None = None, many: int = 100_000) -> DataFrame:
    """(path, sha256) of every directory above the files (path, sha256): the hash of its files' relative paths and hashes, in order of path.

    A directory's text is one line per file, ``<relative path> NUL <hash> LF``. Lines
    are hashed as they come in order, so a task holds no directory's text. wanted
    (path): the digests of these alone; directories of more than ``many`` files that
    nobody wants are left out by a broadcast (at most lines / many of them) before
    lines travel.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    rows = inventory.where(F.size(parts) > 1).select(F.explode(above).alias("folder"), "path", "sha256")
    if wanted is not None:
        named = wanted.select(F.col("path").alias("folder")).distinct()
        large = rows.groupBy("folder").agg(F.count("*").alias("n")).where(F.col("n") > many).join(named, "folder", "left_anti").select("folder")
        rows = rows.join(F.broadcast(large), "folder", "left_anti").join(named, "folder", "left_semi")
    name = F.expr("substring(path, length(folder) + 2)")
    lines = rows.select("folder", name.alias("name"), "sha256", F.concat(name, F.lit("\0"), "sha256", F.lit("\n")).cast("binary").alias("line"))

    def digests(batches):
        folder, state = None, None
        for batch in batches:
            folders = batch.column("folder").to_numpy(zero_copy_only=False)
            line = batch.column("line").cast(pa.large_binary())
            offsets, data = np.frombuffer(line.buffers()[1], np.int64), memoryview(line.buffers()[2] or b"")
            starts = np.flatnonzero(np.append(True, folders[1:] != folders[:-1])) if len(folders) else []
            done = []
            for lo, hi in zip(starts, [*starts[1:], len(folders)], strict=True):
                if folders[lo] != folder:
                    if state:
                        done.append((folder, state.hexdigest()))
                    folder, state = folders[lo], hashlib.sha256()
                state.update(data[offsets[line.offset + lo] : offsets[line.offset + hi]])
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], ["path", "sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([state.hexdigest()])], ["path", "sha256"])

    return lines.repartition("folder").sortWithinPartitions("folder", "name", "sha256").select("folder", "line").mapInArrow(digests, "path string, sha256 string")


def latest_artifacts(entries: DataFrame) -> DataFrame:
    """(path, sha256, seq, side): the last declaration of each path as input or output; of one entry the output counts."""
    sides = [entries.select("seq", F.lit(k).alias("rank"), F.explode(side).alias("path", "sha256")) for k, side in enumerate(("inputs", "outputs"))]
    last = sides[0].unionByName(sides[1]).groupBy("path").agg(F.max_by(F.struct("sha256", "seq", "rank"), F.struct("seq", "rank")).alias("x"))
    return last.select("path", "x.sha256", "x.seq", F.when(F.col("x.rank") == 0, "input").otherwise("output").alias("side"))


def artifact_audit(declared: DataFrame, inventory: DataFrame) -> DataFrame:
    """(path, problem) of declared files and directories: outside the root, missing or changed. inventory lists files."""
    declared = written(declared.select("path", "sha256"), "declared")
    there = inventory.select("path", F.col("sha256").alias("actual"))
    folders = directory_digests(inventory, declared)
    joined = declared.join(there.unionByName(folders.withColumnRenamed("sha256", "actual")), "path", "left")
    outside = F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)")
    return joined.select("path", F.when(outside, "outside_root").when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("sha256"), "changed").alias("problem")).where("problem is not null")


def untracked(inventory: DataFrame, declared: DataFrame) -> DataFrame:
    return inventory.join(declared.select("path"), "path", "left_anti")


def shareable(entries: DataFrame, allowed: DataFrame, endpoints: tuple[str, ...] = ()) -> DataFrame:
    """Allow-listed steps with their allowed parameters, items reduced to status counts, calls of the allowed endpoints summed by endpoint.

    An endpoint that is not named is left out, as it may hold a path with an id. Calls
    have a count and, where entries tell them, milliseconds and credits; null counts as 0.
    """
    rules = allowed.groupBy("step").agg(F.collect_set("param").alias("names"))
    kept = entries.join(rules, "step").withColumn("_calls", F.filter("api_calls", lambda c: F.coalesce(c["endpoint"].isin(*endpoints), F.lit(False))))
    counts = lambda items: F.map_from_entries(
        F.transform(F.array_distinct(F.transform(items, lambda i: i["status"])), lambda s: F.struct(s, F.size(F.filter(items, lambda i: i["status"] == s))))
    )
    told = entries.schema["api_calls"].dataType.elementType.fieldNames()
    kinds = {"count": "long", "ms": "double", "credits": "double"}
    add = lambda e, f: F.aggregate(F.filter("_calls", lambda c: c["endpoint"] == e), F.lit(0).cast(kinds[f]), lambda a, c: a + F.coalesce(c[f].cast(kinds[f]), F.lit(0)))
    call = lambda e: F.struct(e.alias("endpoint"), *[add(e, f).alias(f) for f in kinds if f in told])
    calls = F.transform(F.array_sort(F.array_distinct(F.transform("_calls", lambda c: c["endpoint"]))), call)
    return kept.select("seq", "step", "status", F.map_filter("params", lambda k, _: F.array_contains("names", k)).alias("params"), counts(F.col("items")).alias("item_counts"), calls.alias("calls"))


def declaring_entry(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, seq): the latest successful entry that wrote the file with this hash from these inputs; seq null when stale.

    wanted: path, sha256, input_path, input_sha256.
    """
    out = entries.where("status = 'ok'").select("seq", F.explode("outputs").alias("path", "sha256"))
    into = entries.select("seq", F.explode("inputs").alias("input_path", "input_sha256"))
    hits = wanted.join(out, ["path", "sha256"]).join(into, ["seq", "input_path", "input_sha256"])
    need = wanted.groupBy("path").agg(F.count("*").alias("need"))
    full = hits.groupBy("path", "seq").agg(F.count("*").alias("have")).join(need, "path").where("have = need")
    return need.select("path").join(full.groupBy("path").agg(F.max("seq").alias("seq")), "path", "left")


def freshness(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(name, fresh): whether each stored hash equals the current one."""
    joined = stored.join(current.select("name", F.col("sha256").alias("now")), "name", "full_outer")
    return joined.select("name", F.coalesce(F.col("sha256") == F.col("now"), F.lit(False)).alias("fresh"))


def review_evidence(code_sets: DataFrame, reviews: DataFrame, entries: DataFrame) -> DataFrame:
    """(code_set_name, reason): sets whose approval is not backed by a review artifact and its latest ledger row."""
    told = latest_declarations(entries).select(F.col("path").alias("review_path"), F.col("sha256").alias("told"))
    joined = code_sets.join(reviews, "code_set_name", "left").join(told, "review_path", "left")
    reason = F.when(F.col("review_path").isNull(), "no_review").when(~F.coalesce(F.col("approved"), F.lit(False)), "not_approved").when(F.col("reviewed_fingerprint") != F.col("fingerprint"), "codings_changed")
    reason = reason.when(F.col("told").isNull(), "no_ledger_row").when(F.col("told") != F.col("review_sha256"), "artifact_changed")
    return joined.select("code_set_name", reason.alias("reason")).where("reason is not null")
