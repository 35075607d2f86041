"""MinHash near-dedup with SuperMinHash signatures.

A text's set is its distinct word shingles (words of non-blank characters,
A-Z lower-cased; fewer words than a shingle make one shingle; no word, an empty
set). Signatures: SuperMinHash, where every element takes its ranks in one
random permutation of the components, so signature values are negatively
correlated and an element stops as soon as no component can improve. Equal sets
are first collapsed to one representative, so a group of copies is one row.
Bands of signature rows give buckets; candidates are verified on the full sets
of exact strings; verified links are grouped by connected components.

Inside a bucket not all pairs are made. First a few pivots of each bucket are
verified against its rows. Buckets that then still hold several components are
gathered by their largest component and compared in blocks of bounded size
inside tasks, where an exact bound on the intersection rejects nearly all pairs;
a block returns a forest of links. No link between bucket mates is lost. With
48 bands of 6 rows a pair at the threshold 0.8 shares no bucket with
probability 5e-7.

Sets are kept as 64-bit shingle fingerprints, so a set of a million shingles has
a wrong member with probability below 1e-7. Signatures of large sets are made
from bounded pieces of the set, whose lowest ranks are the set's.

Edges: null and empty texts link with nothing; rows with a null doc_id are kept
without a component; repeated rows are returned each, and stay or go together;
one doc_id with several texts is several documents, of which each has its own
component; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm import shared as S
from cohortloom.llm.components import connected_components

U64 = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """(hashes, cuts): row i's distinct shingle hashes, sorted, are hashes[cuts[i]:cuts[i+1]]."""
    n = len(offsets) - 1
    words, rows, _, _ = S.words_of(data, offsets)
    h, r = S.ngram_hash(words, rows, size)
    counts = np.bincount(rows, minlength=n)
    for k in range(1, size):
        few = np.flatnonzero(counts == k)
        if len(few):
            hk, rk = S.ngram_hash(words, rows, k)
            at = counts[rk] == k
            h, r = np.concatenate([h, S.mix(hk[at] + U64(k))]), np.concatenate([r, rk[at]])
    order = np.argsort(r, kind="stable")
    h, r = h[order], r[order]
    bounds = np.searchsorted(r, np.arange(n + 1))
    parts = [S.distinct_sorted(h[bounds[i] : bounds[i + 1]]) for i in range(n)]
    cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else h[:0]), cuts


PIECE = 1 << 16


def super_minhash(elements: np.ndarray, cuts: np.ndarray, m: int, piece: int = PIECE) -> np.ndarray:
    """(rows, m) signatures of sets given as in shingle_sets; empty sets keep the largest value.

    In round j every element draws r in [0, 1) and the j-th place of its own
    permutation (Fisher-Yates on demand); that component is lowered to j + r. A
    set is finished when all of its components are below j + 1. Values are fixed
    point: j in the upper and r in the lower 32 bits. Elements are worked through
    in pieces, which bounds the permutations held; a set over several pieces
    starts each with the ranks that it has.
    """
    sig = np.full((len(cuts) - 1, m), np.iinfo(np.uint64).max, U64)
    owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    for lo in range(0, len(elements), piece):
        _lower_ranks(sig, elements[lo : lo + piece], owner[lo : lo + piece])
    return sig


def _lower_ranks(sig: np.ndarray, elements: np.ndarray, owner: np.ndarray) -> None:
    m = sig.shape[1]
    flat = sig.reshape(-1)
    perm = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), m)).copy()
    live = np.arange(len(elements))
    open_rows = np.zeros(len(sig), bool)
    open_rows[owner] = True
    for j in range(m):
        x = S.mix(elements[live] + U64((0x9E3779B97F4A7C15 * (j + 1)) & (2**64 - 1)))
        k = (((x & U64(0xFFFFFFFF)) * U64(m - j)) >> U64(32)).astype(np.int64) + j
        place = perm[live, k].astype(np.int64)
        perm[live, k] = perm[live, j]
        np.minimum.at(flat, owner[live] * m + place, (x >> U64(32)) | U64(j << 32))
        rows = np.flatnonzero(open_rows)
        open_rows[rows[sig[rows].max(1) < U64((j + 1) << 32)]] = False
        live = live[open_rows[owner[live]]]
        if not len(live):
            break


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    n, m = sig.shape
    rows = sig.reshape(n, bands, m // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * U64(S.MULTIPLIER), (n, bands)).copy()
    for k in range(m // bands):
        key = S.mix(key * U64(S.MULTIPLIER) + rows[:, :, k])
    return key


def sketch(docs: DataFrame, size: int, bands: int, band_rows: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_hi, set_lo, bands): the set's size, its 128-bit digest and its band keys."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in S.text_chunks(batch.column("text"), 1 << 20):
                h, cuts = shingle_sets(data, offsets, size)
                n = np.diff(cuts)
                sums = np.concatenate([[U64(0)], np.cumsum(S.mix(h + U64(17)), dtype=U64)])
                other = np.concatenate([[U64(0)], np.cumsum(S.mix(h ^ U64(S.MULTIPLIER)), dtype=U64)])
                keys = band_keys(super_minhash(h, cuts, bands * band_rows), bands).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * bands, bands), pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("text_key").slice(lo, hi - lo), pa.array(n), pa.array((sums[cuts[1:]] - sums[cuts[:-1]]).view(np.int64)), pa.array((other[cuts[1:]] - other[cuts[:-1]]).view(np.int64)), lists],
                    ["doc_id", "text_key", "n_shingles", "set_hi", "set_lo", "bands"],
                )

    return docs.mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_hi long, set_lo long, bands array<long>")


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) with 100 * intersection >= percent * union of their full sets."""

    def run(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            done = 0
            # The longer text of a pair sets the chunk, so both sides of it are held for few rows.
            longer = pa.compute.binary_length(batch.column("text_a")).to_numpy() + pa.compute.binary_length(batch.column("text_b")).to_numpy()
            for lo, hi in S.chunks(np.concatenate([[0], np.cumsum(longer)])):
                sides = []
                for name in ("text_a", "text_b"):
                    data, offsets = S.flat(batch.column(name).slice(lo, hi - lo))
                    sides.append(shingle_sets(data[offsets[0] : offsets[-1]], offsets - offsets[0], size))
                (ha, ca), (hb, cb) = sides
                for i in range(hi - lo):
                    mine, other = ha[ca[i] : ca[i + 1]], hb[cb[i] : cb[i + 1]]
                    both = common(mine, other)
                    ok[done] = 100 * both >= percent * (len(mine) + len(other) - both)
                    done += 1
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok)], ["a", "b", "linked"])

    b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    joined = pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "text_a", "b", "text_b")
    return joined.mapInArrow(run, "a long, b long, linked boolean")


def common(mine: np.ndarray, other: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    both = np.sort(np.concatenate([mine, other]))
    return int((both[1:] == both[:-1]).sum())


def hashed_sets(texts: DataFrame, size: int) -> DataFrame:
    """(id, h): the sorted shingle hashes of each text."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in S.text_chunks(batch.column("text"), 1 << 20):
                h, cuts = shingle_sets(data, offsets, size)
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), lists], ["id", "h"])

    return texts.select("id", "text").mapInArrow(run, "id long, h array<long>")


def crossing_links(sets: list[np.ndarray], comp: np.ndarray, block: np.ndarray, percent: int, top_shingles: int = 2048):
    """Yields (row, its linked later rows): pairs of different components (and blocks, if there are two) that reach percent of their union.

    The most frequent shingles become bits. The intersection is at most the
    shared bits plus the smaller rest, which is exact for what it rejects; the
    few pairs that it leaves are intersected in full.
    """
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    values, inverse, df = np.unique(flat, return_inverse=True, return_counts=True)
    top = np.argsort(-df, kind="stable")[:top_shingles]
    place = np.full(len(values), -1)
    place[top] = np.arange(len(top))
    at = place[inverse]
    bits = np.zeros((len(sets), -(-max(1, len(top)) // 64)), U64)
    hit = at >= 0
    np.bitwise_or.at(bits, (row[hit], at[hit] >> 6), U64(1) << (at[hit] & 63).astype(U64))
    rest = sizes - np.bincount(row[hit], minlength=len(sets))
    two = len(np.unique(block)) > 1
    for lo in range(0, len(sets), 512):
        hi = min(lo + 512, len(sets))
        most = np.zeros((hi - lo, len(sets)), np.int32)
        for w in range(bits.shape[1]):
            most += np.bitwise_count(bits[lo:hi, w, None] & bits[None, :, w])
        most += np.minimum(rest[lo:hi, None], rest[None])
        union = sizes[lo:hi, None] + sizes[None] - most
        ok = (100 * most >= percent * union) & (comp[lo:hi, None] != comp[None]) & (np.arange(lo, hi)[:, None] < np.arange(len(sets))[None])
        if two:
            ok &= block[lo:hi, None] != block[None]
        for i in np.flatnonzero(ok.any(1)):
            mates = np.flatnonzero(ok[i])
            mine = sets[lo + i]
            inside = np.isin(np.concatenate([sets[j] for j in mates]), mine)
            both = np.add.reduceat(inside.astype(np.int64), np.cumsum(sizes[mates]) - sizes[mates])
            linked = 100 * both >= percent * (len(mine) + sizes[mates] - both)
            if linked.any():
                yield lo + int(i), mates[linked]


def block_links(members: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """members (main, id, comp, h) → (a, b): enough links to connect what is linked inside each main's rows.

    A main with many rows is cut into blocks; each pair of blocks is a group of
    its own, and a group returns a forest, never its pairs, which are folded as
    they are found.
    """
    crowd = members.groupBy("main").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    split = members.join(crowd, "main").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    split = split.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.select("main", "id", "comp", "h", "block", F.least("block", "mate").alias("i"), F.greatest("block", "mate").alias("j"))

    def group(table: pa.Table) -> pa.Table:
        ids, comp, block = (table.column(k).to_numpy() for k in ("id", "comp", "block"))
        sets = [np.asarray(x).view(U64) for x in table.column("h").to_numpy()]
        parent = {int(c): int(c) for c in comp}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for x, mates in crossing_links(sets, comp, block, percent):
            for y in mates:
                p, q = find(int(comp[x])), find(int(comp[y]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return split.groupBy("main", "i", "j").applyInArrow(group, "a long, b long")


def text_components(docs: DataFrame, size: int, percent: int, bands: int = 48, band_rows: int = 6, pivots: int = 3, block_rows: int = 1024) -> DataFrame:
    """docs (doc_id, text_key, text) → (doc_id, text_key, n_shingles, first_id, first_key): one row per row, with the first document of its component; null for rows that have no set."""
    sketches = S.written(sketch(docs, size, bands, band_rows), "sketches")
    usable = sketches.where("doc_id is not null and n_shingles > 0")
    # One row per distinct set, written, so that its number stays what it is.
    first = F.min_by(F.struct("doc_id", "text_key", "n_shingles", "bands"), F.struct("doc_id", "text_key"))
    sets = usable.groupBy("set_hi", "set_lo").agg(first.alias("r")).withColumn("node", F.monotonically_increasing_id())
    sets = S.written(sets.select("set_hi", "set_lo", "node", "r.doc_id", "r.text_key", F.col("r.n_shingles").alias("n"), "r.bands"), "sets")
    rows = sets.select(F.col("node").alias("id"), "n", F.explode("bands").alias("key"))
    shared_keys = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    mates = S.written(rows.join(shared_keys, "key").select("key", "id", "n"), "mates")
    needed = sets.join(mates.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("doc_id", "text_key", F.col("node").alias("id"))
    texts = docs.join(needed, ["doc_id", "text_key"]).groupBy("id").agg(F.min("text").alias("text"))
    texts = S.written(texts, "texts")

    # A few pivots of each bucket against its other rows.
    order = Window.partitionBy("key").orderBy("id")
    chosen = mates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pivots).select("key", F.col("id").alias("id2"), F.col("n").alias("n2"))
    near = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent
    pairs = mates.join(chosen, "key").where((F.col("id") != F.col("id2")) & near)
    pairs = pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
    links = S.written(verify(pairs, texts, size, percent).where("linked").select("a", "b"), "links")
    comps = connected_components(links).withColumnRenamed("node", "id")

    # Buckets of more rows than the pivots cover that still hold several components: in blocks, named by their largest component.
    labelled = mates.join(comps, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    groups = labelled.groupBy("key", "comp").agg(F.count("*").alias("c"))
    main = groups.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("k"), F.sum("c").alias("g")).where(f"k > 1 and g > {pivots + 1}")
    members = labelled.join(main.select("key", "main"), "key").select("main", "id", "comp").distinct()
    members = S.written(members, "open")
    bodies = texts.join(members.select("id").distinct(), "id", "left_semi")
    found = S.written(block_links(members.join(hashed_sets(bodies, size), "id"), percent, block_rows).distinct(), "late-links")
    comps = S.written(connected_components(links.union(found)), "components")
    # The first document of a component is the least of its sets' first ones: found on sets, so that copies are not joined to their component.
    of_set = F.struct("doc_id", "text_key")
    firsts = comps.join(sets.select("node", of_set.alias("first")), "node").groupBy("component").agg(F.min("first").alias("least"))
    firsts = comps.join(firsts, "component").select("node", "least")
    reps = sets.select("set_hi", "set_lo", "node", of_set.alias("first")).join(firsts, "node", "left").select("set_hi", "set_lo", F.coalesce("least", "first").alias("first"))
    linked = usable.select("doc_id", "text_key", "n_shingles", "set_hi", "set_lo").join(reps, ["set_hi", "set_lo"])
    linked = linked.select("doc_id", "text_key", "n_shingles", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"))
    none = F.lit(None).cast("long")
    alone = sketches.where("doc_id is null or n_shingles = 0").select("doc_id", "text_key", "n_shingles", none.alias("first_id"), none.alias("first_key"))
    return linked.union(alone)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per document row. options: bands, band_rows, pivots, block_rows."""
    S.small_batches(docs.sparkSession)
    rows = text_components(S.boxed(docs).drop("d"), size, percent, **options)
    out = rows.select("doc_id", "n_shingles", F.coalesce("first_id", "doc_id").alias("component_id"))
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group stays: that of the smallest doc_id (of several texts of it, of the smallest hash); columns unchanged."""
    S.small_batches(docs.sparkSession)
    rows = text_components(S.boxed(docs).drop("d"), size, percent).where("first_id is not null")
    gone = rows.where((F.col("doc_id") != F.col("first_id")) | (F.col("text_key") != F.col("first_key"))).select("doc_id", "text_key").distinct()
    return S.boxed(docs).join(gone, ["doc_id", "text_key"], "left_anti").select("d.*")
