"""Feature matrix in long form: presence, counts, measurement summaries, floors, scaling, coordinates, clusters.

A matrix is a table of present cells (person_id, feature, value) and one of columns
(feature, n, present, fill, median, spread, absent): a cell that is not there has its
column's value ``absent``. Nothing is written for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.operators.compare import running_totals
from cohortloom.sources.tables import table_hash, written

#: Last parts of the names of measurement summaries: an absent one is the column's median, as an absent number of a person is.
SUMMARIES = ("latest_before_index", "median", "slope")
#: Bytes of the basis that is sent to all tasks. The floor of people per feature keeps the columns below 50 times a person's mean number of feature bases.
BASIS_BYTES = 32 << 20


def union_events(*parts: DataFrame) -> DataFrame:
    """Domain events of all parts, one row per (domain, event_id)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["domain", "event_id"])


def windowed(frame: DataFrame, keyed: DataFrame, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """(person_id, window, domain, key, status) of keyed events inside the inclusive windows around the index date."""
    near = frame.select("person_id", "index_date").join(keyed.where("event_key is not null"), "person_id")
    day = F.datediff("event_date", "index_date")
    names = F.array_compact(F.array(*[F.when(day.between(lo, hi), F.lit(n)) for n, (lo, hi) in windows.items()]))
    status = F.col("mapping_status") if "mapping_status" in keyed.columns else F.lit("MAPPED")
    return near.select("person_id", F.explode(names).alias("window"), "domain", F.col("event_key").alias("key"), status.alias("status"))


def feature_counts(rows: DataFrame) -> DataFrame:
    """(person_id, feature, value): presence 1 and log1p of the count for each window, domain and key."""
    n = rows.groupBy("person_id", "window", "domain", "key").agg(F.count("*").alias("n"))
    base = F.concat_ws("|", "window", "domain", "key")
    both = F.array(F.struct(F.concat(base, F.lit("|presence")).alias("feature"), F.lit(1.0).alias("value")), F.struct(F.concat(base, F.lit("|log1p_count")).alias("feature"), F.log1p("n").alias("value")))
    return n.select("person_id", F.explode(both).alias("x")).select("person_id", "x.*")


def measurement_features(frame: DataFrame, measurements: DataFrame, min_slopes: int = 3) -> DataFrame:
    """(person_id, feature, value): latest, median and slope over all pre-index days; a slope needs 3 rows on 2 days and min_slopes people."""
    pre = frame.select("person_id", "index_date").join(measurements, "person_id").where("event_date < index_date and value is not null")
    day = F.datediff("event_date", "index_date").cast("double")
    got = pre.groupBy("person_id", "event_key").agg(
        F.max_by("value", F.struct("event_date", "event_id")).alias("latest_before_index"), F.median("value").alias("median"),
        F.when((F.count("*") >= 3) & (F.count_distinct("event_date") >= 2), F.regr_slope("value", day)).alias("slope"),
    )
    names = ("latest_before_index", "median", "slope")
    long = got.select("person_id", "event_key", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("x")).select("person_id", "event_key", "x.*").where("value is not null")
    enough = long.where("name = 'slope'").groupBy("event_key").agg(F.count("*").alias("n")).where(F.col("n") >= min_slopes).select("event_key")
    kept = long.where("name <> 'slope'").unionByName(long.where("name = 'slope'").join(enough, "event_key", "left_semi").select(long.columns))
    return kept.select("person_id", F.concat(F.lit("baseline|measurement|"), "event_key", F.lit("|"), "name").alias("feature"), "value")


def prevalence(features: DataFrame, n_people: int) -> DataFrame:
    """(base, people, prevalence) of each feature base (its name without the last part)."""
    base = F.regexp_replace("feature", r"\|[^|]*$", "")
    return features.select(base.alias("base"), "person_id").distinct().groupBy("base").agg(F.count("*").alias("people")).withColumn("prevalence", F.col("people") / n_people)


def apply_floor(features: DataFrame, n_people: int, floor: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept features, dropped bases): bases with fewer people than the floor, max(3, 2 % rounded up) by default."""
    floor = max(3, -(-2 * n_people // 100)) if floor is None else floor
    bases = prevalence(features, n_people)
    rare = bases.where(F.col("people") < floor)
    keyed = features.withColumn("base", F.regexp_replace("feature", r"\|[^|]*$", ""))
    return keyed.join(rare, "base", "left_anti").drop("base"), rare


def encode_demographics(frame: DataFrame, numeric: list[str], categories: list[str]) -> DataFrame:
    """(person_id, feature, value): numbers with missing ones at the median, one-hot levels incl. Missing."""
    medians = frame.agg(*[F.percentile(F.col(c).cast("double"), F.lit(0.5)).alias(f"_{c}") for c in numeric]) if numeric else None
    joined = frame.crossJoin(F.broadcast(medians)) if numeric else frame
    rows = [F.struct(F.lit(f"demographic|{c}").alias("feature"), F.coalesce(F.col(c).cast("double"), F.col(f"_{c}")).alias("value")) for c in numeric]
    rows += [F.struct(F.concat(F.lit(f"demographic|{c}="), F.coalesce(F.col(c).cast("string"), F.lit("Missing"))).alias("feature"), F.lit(1.0).alias("value")) for c in categories]
    return joined.select("person_id", F.explode(F.array(*rows)).alias("x")).select("person_id", "x.*")


def demographic_cells(frame: DataFrame, numeric: list[str], categories: list[str]) -> DataFrame:
    """(person_id, feature, value) of the present cells: numbers that are not missing, and 1 for a person's level (Missing is one)."""
    rows = [F.when(F.col(c).isNotNull(), F.struct(F.lit(f"demographic|{c}").alias("feature"), F.col(c).cast("double").alias("value"))) for c in numeric]
    rows += [F.struct(F.concat(F.lit(f"demographic|{c}="), F.coalesce(F.col(c).cast("string"), F.lit("Missing"))).alias("feature"), F.lit(1.0).alias("value")) for c in categories]
    return frame.select("person_id", F.explode(F.array_compact(F.array(*rows))).alias("x")).select("person_id", "x.*")


def fills_with_median(feature: Column) -> Column:
    """Whether an absent cell of the column is its median: measurement summaries and numeric demographics. Others are 0."""
    return F.substring_index(feature, "|", -1).isin(*SUMMARIES) | (feature.startswith("demographic|") & ~feature.contains("="))


def at_places(ranked: DataFrame, facts: DataFrame, places: dict[str, Column]) -> DataFrame:
    """facts (one row per feature) with the column's present value at each place, from 0; null where the place is null."""
    at = lambda k: F.max(F.when((F.col("c_before") <= k) & (k < F.col("c_before") + F.col("c")), F.col("value")))
    return ranked.join(facts, "feature").groupBy(*facts.columns).agg(*[at(k).alias(name) for name, k in places.items()])


def matrix_columns(cells: DataFrame, n: int) -> DataFrame:
    """(feature, n, present, fill, median, spread, absent) of every column of n people.

    Quantiles are interpolated order statistics of the present values and as many
    fills as cells are absent. They are read off running counts of distinct values, so
    neither absent cells nor a column's values stand together anywhere.
    """
    counts = cells.groupBy("feature", "value").agg(F.count("*").alias("c"))
    ranked = written(running_totals(counts, "value", ["c"], "feature"), "ranked-values")

    sizes = ranked.groupBy("feature").agg(F.sum("c").alias("present"))
    middle = (F.col("present") - 1) / 2
    halves = at_places(ranked, sizes, {"low": F.floor(middle), "high": F.ceil(middle)})
    fill = F.when(fills_with_median(F.col("feature")), (F.col("low") + F.col("high")) / 2).otherwise(0.0)
    filled = halves.select("feature", "present", fill.alias("fill"))
    below = ranked.join(filled, "feature").groupBy("feature", "present", "fill").agg(F.sum(F.when(F.col("value") < F.col("fill"), F.col("c")).otherwise(0)).alias("below"))
    facts = written(below.withColumn("n", F.lit(n).cast("long")), "column-facts")
    gap = F.col("n") - F.col("present")

    def place(k: int) -> Column:
        """Where the k-th of all values is among the present ones; null in the run of fills."""
        return F.when(F.lit(k) < F.col("below"), F.lit(k)).when(F.lit(k) >= F.col("below") + gap, F.lit(k) - gap)

    ends = {f"{name}_{side}": k for name, p in (("q1", 0.25), ("m", 0.5), ("q3", 0.75)) for side, k in (("low", int((n - 1) * p)), ("high", -int(-(n - 1) * p // 1)))}
    found = at_places(ranked, facts, {name: place(k) for name, k in ends.items()})

    def quantile(name: str, p: float) -> Column:
        low, high = (F.coalesce(f"{name}_{side}", F.col("fill")) for side in ("low", "high"))
        part = (n - 1) * p - int((n - 1) * p)
        return low + (high - low) * part

    q = found.select("feature", "n", "present", "fill", quantile("m", 0.5).alias("median"), (quantile("q3", 0.75) - quantile("q1", 0.25)).alias("spread"))
    return q.withColumn("absent", scaled_value(F.col("fill")))


def scaled_value(value: Column) -> Column:
    """(x - median) / spread, or x - median where the spread is 0."""
    return F.when(F.col("spread") > 0, (value - F.col("median")) / F.col("spread")).otherwise(value - F.col("median"))


def scaled_matrix(cells: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(present cells scaled, columns): medians and quartiles are of all n people, absent cells at their fill."""
    columns = written(matrix_columns(cells, n), "columns")
    return cells.join(columns, "feature").select("person_id", "feature", scaled_value(F.col("value")).alias("value")), columns


def robust_scale(features: DataFrame, people: DataFrame) -> DataFrame:
    """(person_id, feature, value) of every person and feature: ``scaled_matrix`` spread out, which is for small matrices only."""
    cells, columns = scaled_matrix(features, people.count())
    every = people.select("person_id").join(columns.select("feature", "absent"), how="cross")
    return every.join(cells, ["person_id", "feature"], "left").select("person_id", "feature", F.coalesce("value", "absent").alias("value"))


def matrix_hash(cells: DataFrame, columns: DataFrame, people: DataFrame) -> str:
    """A hash of the whole matrix, whatever the order of its rows: cells that differ from their column's absent value, columns, and people, to 12 decimals."""
    text = lambda c: F.format_string("%.12f", F.round(c, 12) + F.lit(0.0))
    told = cells.join(columns.select("feature", "absent"), "feature").where(F.round("value", 12) != F.round("absent", 12)).select(F.col("person_id").cast("string").alias("person"), "feature", text(F.col("value")).alias("value"))
    none = F.lit(None).cast("string")
    rows = told.unionByName(columns.select(none.alias("person"), "feature", text(F.col("absent")).alias("value"))).unionByName(people.select(F.col("person_id").cast("string").alias("person"), none.alias("feature"), none.alias("value")))
    return table_hash(rows).first()["fingerprint"]


def feature_provenance(rows: DataFrame) -> DataFrame:
    """(feature, mapping_status, rows, fraction, domain)."""
    n = rows.groupBy(F.concat_ws("|", "window", "domain", "key").alias("feature"), "domain", F.col("status").alias("mapping_status")).agg(F.count("*").alias("rows"))
    return n.withColumn("fraction", F.col("rows") / F.sum("rows").over(Window.partitionBy("feature")))


def matrix_rows(cells: DataFrame, columns: DataFrame, people: DataFrame) -> tuple[DataFrame, list[str], np.ndarray]:
    """(rows (person_id, at, by), names, absent): where a person's cells differ from the absent values and by how much, written once."""
    facts = columns.select("feature", "absent").orderBy("feature").collect()  # bounded by the floor of people per feature
    names, absent = [r["feature"] for r in facts], np.array([r["absent"] for r in facts])
    places = columns.sparkSession.createDataFrame([(f, k, float(a)) for k, (f, a) in enumerate(zip(names, absent, strict=True))], "feature string, k int, absent double")
    own = cells.join(places, "feature").where("value <> absent").groupBy("person_id").agg(F.sort_array(F.collect_list(F.struct("k", (F.col("value") - F.col("absent")).alias("by")))).alias("cells"))
    rows = people.select("person_id").distinct().join(own, "person_id", "left").select("person_id", F.coalesce("cells.k", F.array().cast("array<int>")).alias("at"), F.coalesce("cells.by", F.array().cast("array<double>")).alias("by"))
    return written(rows, "matrix-rows"), names, absent


def products(batch: pa.RecordBatch, basis: np.ndarray, absent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows x basis, row of each cell, column of each cell, difference of each cell) of a batch of sparse rows."""
    sizes = batch.column("at").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at, by = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("at", "by"))
    out = np.zeros((len(sizes), basis.shape[1]))
    np.add.at(out, row, basis[at] * by[:, None])
    return out + absent @ basis, row, at, by


def truncated_svd(matrix: tuple[DataFrame, DataFrame], people: DataFrame, components: int = 30, extra: int = 10, rounds: int = 12, tolerance: float = 1e-10, seed: int = 1) -> DataFrame:
    """(person_id, coords array): the uncentred matrix times its leading right singular vectors, the greatest first.

    A random sketch of the columns is taken through the matrix and back and made
    orthogonal to what is there already, round by round (a block Krylov space), until
    the best vectors in the space are taken to multiples of themselves; then people are
    projected on them. A round reads the sparse rows in Arrow batches, and a task
    returns a sum as large as a block (columns x components), which is also what the
    driver keeps of each round. Every vector's largest entry is positive.
    """
    rows, names, absent = matrix_rows(*matrix, people)
    d = len(names)
    width = min(components + extra, d)
    if d * width * 8 > BASIS_BYTES:
        raise ValueError(f"{d} columns: raise the floor of people per feature")
    spark = rows.sparkSession

    def there_and_back(basis: np.ndarray) -> np.ndarray:
        sums = [f"z{j}" for j in range(basis.shape[1])]
        shared = spark.sparkContext.broadcast((basis, absent))

        def taken(batches):
            v, a = shared.value
            total, ones = np.zeros_like(v), np.zeros(v.shape[1])
            for batch in batches:
                y, row, at, by = products(batch, v, a)
                np.add.at(total, at, y[row] * by[:, None])
                ones += y.sum(axis=0)
            total += np.outer(a, ones)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), *[pa.array(total[:, j]) for j in range(v.shape[1])]], ["k", *sums])

        added = rows.mapInArrow(taken, "k long, " + ", ".join(f"{c} double" for c in sums)).groupBy("k").agg(*[F.sum(c).alias(c) for c in sums]).orderBy("k").toArrow()
        return np.stack([added.column(c).to_numpy() for c in sums], axis=1)

    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    space, images, keep = np.zeros((d, 0)), np.zeros((d, 0)), min(components, d)
    for _ in range(rounds):
        image = there_and_back(block)
        space, images = np.hstack([space, block]), np.hstack([images, image])
        inner = space.T @ images
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1][:keep], turn[:, ::-1][:, :keep]
        vectors = space @ turn
        if np.linalg.norm(images @ turn - vectors * values, axis=0).max() <= tolerance * max(values[0], 1e-300):
            break
        for _ in range(2):
            image = image - space @ (space.T @ image)
        left, sizes, _ = np.linalg.svd(image, full_matrices=False)
        block = left[:, sizes > 1e-12 * max(values[0], 1e-300)]
        if not block.shape[1]:
            break
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    shared = spark.sparkContext.broadcast((vectors, absent))

    def project(batches):
        v, a = shared.value
        for batch in batches:
            y = products(batch, v, a)[0]
            coords = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * v.shape[1]), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("person_id"), coords], ["person_id", "coords"])

    return rows.mapInArrow(project, f"person_id {dict(rows.dtypes)['person_id']}, coords array<double>")


def cluster(points: DataFrame, k: int = 8, min_size: int = 5, seed: int = 1) -> DataFrame:
    """points with cluster; clusters below the minimum size become -1.

    Points are moved off the origin first: a cluster is split along its centre's
    length, and one that is centred on the origin would never be split.
    """
    top = points.agg(F.max(F.aggregate("coords", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))).first()[0] or 0.0
    rows = points.withColumn("features", array_to_vector(F.transform("coords", lambda x: x + top)))
    got = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows).transform(rows).drop("features")
    sizes = got.groupBy("cluster").agg(F.count("*").alias("n"))
    return got.join(sizes, "cluster").withColumn("cluster", F.when(F.col("n") >= min_size, F.col("cluster")).otherwise(-1)).drop("n")


def medoids(points: DataFrame) -> DataFrame:
    """(cluster, person_id, cluster_size): the member nearest the centroid, the smallest id on ties."""
    exploded = points.where("cluster >= 0").select("cluster", "person_id", F.posexplode("coords").alias("k", "x"))
    centre = exploded.groupBy("cluster", "k").agg(F.avg("x").alias("c"))
    far = exploded.join(centre, ["cluster", "k"]).groupBy("cluster", "person_id").agg(F.sum((F.col("x") - F.col("c")) * (F.col("x") - F.col("c"))).alias("d"))
    return far.groupBy("cluster").agg(F.min_by("person_id", F.struct(F.round("d", 9), "person_id")).alias("person_id"), F.count("*").alias("cluster_size"))


def adjusted_rand(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (ari) of two labelings of the same people."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(two("n").alias("ij"), F.sum("n").alias("t"))
    left = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(two("n").alias("i"))
    right = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(two("n").alias("j"))
    total = F.col("t") * (F.col("t") - 1) / 2
    expected = F.col("i") * F.col("j") / total
    top = (F.col("i") + F.col("j")) / 2
    return both.crossJoin(left).crossJoin(right).select(F.when(top == expected, 1.0).otherwise((F.col("ij") - expected) / (top - expected)).alias("ari"))


def cluster_tables(members: DataFrame, presence: DataFrame) -> DataFrame:
    """(cluster, feature, n_exposed, events_exposed, n_comparator, events_comparator): a feature inside a cluster against the rest."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n_exposed"))
    total = members.agg(F.count("*").alias("t"))
    inside = members.join(presence.select("person_id", "feature").distinct(), "person_id").groupBy("cluster", "feature").agg(F.count("*").alias("e"))
    every = inside.groupBy("feature").agg(F.sum("e").alias("all"))
    grid = sizes.crossJoin(every).crossJoin(total).join(inside, ["cluster", "feature"], "left")
    e = F.coalesce("e", F.lit(0))
    return grid.where("cluster >= 0").select("cluster", "feature", "n_exposed", e.alias("events_exposed"), (F.col("t") - F.col("n_exposed")).alias("n_comparator"), (F.col("all") - e).alias("events_comparator"))
