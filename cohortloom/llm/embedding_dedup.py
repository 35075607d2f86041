"""Embedding near-dedup by collision-counting projections.

Unit vectors are projected on many fixed Gaussian directions. Two vectors at
cosine t differ by a normal variable of deviation sqrt(2 - 2t) in each, so the
half-width of the query-centred windows and the number of windows in which a
true link must collide follow from the wanted recall (``calibrate``).

Several projections are sorted. The first ``dealt`` of them deal the work: their
ranges are cut into strips as wide as the window, a vector stands in its own
strip and visits the next one in each, and a pair belongs to the one cell where
neither projection sees both as visitors. Cells above a bounded number of rows
are cut into blocks whose pairs are separate groups. Inside a group the next
``sorted_ones`` projections are sorted in turn, and the candidates of each strip
of queries are narrowed to those inside its windows, until few pairs are left;
those are filtered by the windows of the remaining sorted projections. Then
collisions over all projections are counted per pair, and pairs that reach the
least count are verified by cosine in double precision.

Groups return sums of links and a spanning forest, one row per vector at most,
never the pairs, which are folded as they are found; equal vectors are one row
from the start. Components come from the forests.

Edges: vectors that are null, zero, or hold null or non-finite components, null
labels and null ids link with nothing; vectors of different length or label are
not compared; rows that repeat vec_id, label and vector are one vector; one
vec_id with several vectors is several vectors, each judged on its own; extra
columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import shared as S
from cohortloom.llm.components import connected_components

LEAF_PAIRS = 1 << 17
FOLD_LINKS = 1 << 18


def calibrate(cosine: float, projections: int, half_width: float, miss: float) -> tuple[float, int]:
    """(window half-width, least collisions): a pair at ``cosine`` falls short with probability below miss.

    half_width is in deviations of the difference of two projections at that cosine.
    """
    hit = math.erf(half_width / math.sqrt(2))
    tail = 0.0
    for lost in range(projections, -1, -1):
        tail += math.comb(projections, lost) * (1 - hit) ** lost * hit ** (projections - lost)
        if tail > miss:
            return half_width * math.sqrt(2 - 2 * cosine), projections - lost
    return half_width * math.sqrt(2 - 2 * cosine), projections


def sorted_width(cosine: float, windows: int, miss: float) -> float:
    """Half-width of the sorted projections' windows: a pair at ``cosine`` leaves any of them with probability below miss."""
    return NormalDist().inv_cdf(1 - miss / windows / 2) * math.sqrt(2 - 2 * cosine)


def directions(dim: int, projections: int, seed: int = 20) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, projections))


def fold_links(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A flat forest (root of each node) after the links (u, v); roots are the smallest nodes."""
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def windowed(proj: np.ndarray, a: np.ndarray, b: np.ndarray | None, width: float, level: int, last: int):
    """Yields (rows, rows, level): tiles that together hold all pairs inside the windows of the projections up to that level."""
    n_pairs = len(a) * (len(a) - 1) // 2 if b is None else len(a) * len(b)
    if not n_pairs:
        return
    if n_pairs <= LEAF_PAIRS or level == last:
        step = max(1, LEAF_PAIRS // len(a if b is None else b))
        for lo in range(0, len(a), step):
            yield a[lo : lo + step], (a[lo:] if b is None else b), level
        return
    value = proj[:, level]
    a = a[np.argsort(value[a], kind="stable")]
    cuts = np.flatnonzero(np.diff(np.floor(value[a] / width), prepend=np.inf))
    if b is not None:
        b = b[np.argsort(value[b], kind="stable")]
    for k, lo in enumerate(cuts):
        queries = a[lo : cuts[k + 1] if k + 1 < len(cuts) else len(a)]
        if b is None:
            yield from windowed(proj, queries, None, width, level + 1, last)
            to = np.searchsorted(value[a], value[queries[-1]] + width, "right")
            ahead = a[lo + len(queries) : to]
            if len(ahead):
                yield from windowed(proj, queries[value[queries] >= value[ahead[0]] - width], ahead, width, level + 1, last)
        else:
            near = b[np.searchsorted(value[b], value[queries[0]] - width) : np.searchsorted(value[b], value[queries[-1]] + width, "right")]
            yield from windowed(proj, queries, near, width, level + 1, last)


def link_group(nodes, sizes, away, block, cross, x, cosine, projections, half_width, miss, dealt, sorted_ones):
    """Links inside one group: (nodes, links of each, root row of each, pairs counted).

    away has a bit for each dealt projection in which the row is a visitor;
    block tells the two sides of a cross group.
    """
    order = np.argsort(nodes, kind="stable")
    nodes, sizes, away, block, x = nodes[order], sizes[order], away[order], block[order], x[order]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    proj = unit @ directions(x.shape[1], projections)
    width, least = calibrate(cosine, projections, half_width, miss / 2)
    wide = sorted_width(cosine, dealt + sorted_ones, miss / 2)
    narrow = proj.astype(np.float32)
    rows = np.arange(len(nodes))
    a, b = (rows[block == block[0]], rows[block != block[0]]) if cross else (rows, None)
    links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    us, vs, held, counted = [], [], 0, 0
    for p, q, level in windowed(proj, a, b, wide + 1e-9, dealt, dealt + sorted_ones):
        # The windows of the sorted projections that the tile has not been narrowed by.
        near = np.ones((len(p), len(q)), bool) if level == dealt + sorted_ones else np.abs(narrow[p, level, None] - narrow[None, q, level]) <= wide + 1e-6
        i, j = np.nonzero(near)
        u, v = p[i], q[j]
        for k in range(level + 1, dealt + sorted_ones):
            inside = np.abs(narrow[u, k] - narrow[v, k]) <= wide + 1e-6
            u, v = u[inside], v[inside]
        ok = (away[u] & away[v]) == 0
        if b is None:
            # Where a tile meets itself, each pair stands in it twice and each row once with itself.
            ok &= (u != v) & ((u < v) | ~np.isin(v, p))
        u, v = u[ok], v[ok]
        counted += len(u)
        hits = (np.abs(narrow[u] - narrow[v]) <= width + 1e-6).sum(1)
        u, v = u[hits >= least], v[hits >= least]
        true = np.einsum("ij,ij->i", unit[u], unit[v]) >= cosine
        u, v = u[true], v[true]
        np.add.at(links, u, sizes[v])
        np.add.at(links, v, sizes[u])
        us.append(u)
        vs.append(v)
        held += len(u)
        if held > FOLD_LINKS:
            root = fold_links(root, np.concatenate(us), np.concatenate(vs))
            us, vs, held = [], [], 0
    if us:
        root = fold_links(root, np.concatenate(us), np.concatenate(vs))
    return nodes, links, root, counted


def link_embeddings(
    vectors: DataFrame, cosine: float = 0.98, projections: int = 32, half_width: float = 2.5, miss: float = 1e-6,
    dealt: int = 2, sorted_ones: int = 8, block_rows: int = 4096, block_values: int = 1 << 22,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per vector row.

    block_rows and block_values (components of vectors) bound one side of a group.
    """
    S.small_batches(vectors.sparkSession)
    all_rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("string").alias("label"))
    finite = F.forall("x", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("x", lambda e: e != 0)
    rows = all_rows.where(usable).withColumn("h", F.xxhash64("x")).withColumn("g", F.xxhash64(F.lit(7), "x"))
    copies = rows.groupBy("label", "h", "g", "vec_id").agg(F.first("x").alias("x")).groupBy("label", "h", "g")
    classes = copies.agg(F.min("vec_id").alias("id"), F.count("*").alias("size"), F.first("x").alias("x"))
    # Written, so that the number of a class stays what it is.
    classes = S.written(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")

    width = sorted_width(cosine, dealt + sorted_ones, miss / 2)

    def strips(batches):
        for batch in batches:
            lists = batch.column("x")
            offsets = lists.offsets.to_numpy()
            dims, starts, values = np.diff(offsets), offsets[:-1] - offsets[0], lists.flatten().to_numpy()
            place = np.zeros((len(lists), dealt), np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = values[starts[at][:, None] + np.arange(dim)]
                place[at] = np.floor(x @ directions(int(dim), projections)[:, :dealt] / np.linalg.norm(x, axis=1, keepdims=True) / width)
            strips = pa.ListArray.from_arrays(pa.array(np.arange(0, place.size + 1, dealt), pa.int32()), pa.array(place.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims.astype(np.int64)), strips], [*batch.schema.names, "dim", "strips"])

    placed = classes.select("label", "node", "size", "x").mapInArrow(strips, "label string, node long, size long, x array<double>, dim long, strips array<long>")
    placed = placed.withColumn("away", F.explode(F.sequence(F.lit(0), F.lit((1 << dealt) - 1))))
    cell = [(F.col("strips")[k] + F.shiftright("away", k).bitwiseAND(F.lit(1))).alias(f"strip{k}") for k in range(dealt)]
    placed = placed.select("label", "dim", "node", "size", "x", "away", *cell)
    key = ["label", "dim", *(f"strip{k}" for k in range(dealt))]
    side = F.greatest(F.lit(1), F.least(F.lit(block_rows), F.floor(block_values / F.col("dim"))))
    crowd = placed.groupBy(*key).agg(F.count("*").alias("n")).select(*key, F.ceil(F.col("n") / side).cast("int").alias("blocks"))
    split = placed.join(crowd, key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    split = split.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.select("*", F.least("block", "mate").alias("i"), F.greatest("block", "mate").alias("j"))

    def group(table: pa.Table) -> pa.Table:
        x = np.stack(table.column("x").to_numpy())
        cols = [table.column(k).to_numpy() for k in ("node", "size", "away", "block")]
        cross = table.column("i")[0] != table.column("j")[0]
        nodes, links, root, _ = link_group(*cols, cross, x, cosine, projections, half_width, miss, dealt, sorted_ones)
        some = np.flatnonzero(links)
        return pa.table({"node": pa.array(nodes[some]), "links": pa.array(links[some]), "root": pa.array(nodes[root[some]])})

    found = split.select(*key, "i", "j", "node", "size", "away", "block", "x")
    found = S.written(found.groupBy(*key, "i", "j").applyInArrow(group, "node long, links long, root long"), "vector-links")
    comps = connected_components(found, "node", "root")
    lowest = comps.join(classes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("component_id"))
    linked = classes.select("label", "h", "g", "id", "size", "node").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    linked = linked.join(comps.join(lowest, "component").select("node", "component_id"), "node", "left")
    linked = linked.select("label", "h", "g", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    good = rows.select("vec_id", "label", "h", "g").join(linked, ["label", "h", "g"]).select("vec_id", "n_links", "component_id")
    bad = all_rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(bad).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
