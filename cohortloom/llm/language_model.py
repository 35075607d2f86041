"""LM scoring by deleted interpolation of n-gram estimates up to order 3.

p_n(w | h) = l_n(b) * c(h, w) / c(h) + (1 - l_n(b)) * p_{n-1}(w | shorter h), with
b the context-frequency bucket floor(log2 c(h)), and p_1(w) = m * c(w) / N +
(1 - m) / (V + 1). Contexts never seen leave the word to the shorter one. The
weights m and l_n(b) are learned together by expectation-maximisation on a
deleted part of the learning documents against the counts of the rest; the final
model counts all learning documents. Buckets that the deleted part never met
take the weight of the nearest one.

Spark jobs: texts become blocks of a few megabytes (one fold each) with a word
dictionary, written once. Each block sends its distinct n-grams with counts,
sorted and packed, to hash buckets; a bucket adds up all blocks and answers
each block only where the totals differ from the block's own counts. Words are
64-bit hashes; longer n-grams take log2(tokens) + SPARE_BITS bits of theirs, so
one in 2^SPARE_BITS shares its count with another at any size of the input. The
deleted part's counts are written as distinct rows with their frequency, and each
round of expectation-maximisation is one pass over them that returns sums by
level and bucket. Scoring joins blocks with their answers. Words that occur
everywhere are one entry of a block, so no key is hot; nothing but weights and
sums reaches the driver.

Tokens: words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end per text.

Edges: null and empty texts hold only the end; rows with a null doc_id are
scored but not learned from; an empty learning set leaves the uniform model;
without a deleted part all weights are 1/2; repeated rows count and are scored
each; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import shared as S

U64 = np.uint64
END, BEGIN = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
REST, DELETED, OTHER = 0, 1, 2
BUCKETS = 48
SPARE_BITS = 16
SEEN_ROWS = 1 << 15
SLICE = 1 << 16


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    used = max(1, int(planes.any(0).nonzero()[0].max(initial=0)) + 1) if len(values) else 1
    body = np.ascontiguousarray(planes[:, :used].T).tobytes()
    return np.array([len(values), used], "<u4").tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    n, used = (int(x) for x in np.frombuffer(blob[:8], "<u4"))
    body = pa.decompress(blob[8:], decompressed_size=n * used, codec="zstd", asbytes=True)
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :used] = np.frombuffer(body, np.uint8).reshape(used, n).T
    return planes.reshape(-1).view("<u8")


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values.astype(U64), prepend=U64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=U64)


def tokens_with_end(texts) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all rows, one end after each row; tokens per row)."""
    hashes, sizes = [], []
    for lo, hi, data, offsets in S.text_chunks(texts):
        words, rows, _, _ = S.words_of(data, offsets)
        n = np.bincount(rows, minlength=hi - lo)
        hashes.append(np.insert(words, np.cumsum(n), END))
        sizes.append(n + 1)
    none = np.zeros(0, U64)
    return (np.concatenate(hashes) if hashes else none), (np.concatenate(sizes) if sizes else none.astype(np.int64))


def _blocks(block_bytes: int):
    """Texts → one row per block: ids, token counts and tokens as codes by falling frequency."""

    def flush(part, ids, hashes, sizes):
        tokens, sizes = np.concatenate(hashes), np.concatenate(sizes)
        words, codes, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        blobs = [pack_sorted(words), pack(counts), pack(order), pack(rank[codes]), pack(sizes)]
        idx = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([secrets.randbits(63)], pa.int64()), pa.array([part], pa.int32()), pa.array([len(idx)], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([idx.to_pylist()], pa.list_(pa.int64())), *(pa.array([b], pa.binary()) for b in blobs)],
            ["block", "part", "n_docs", "n_tokens", "ids", "words", "counts", "ranked", "codes", "sizes"],
        )

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            parts = np.asarray(batch.column("part").to_numpy(zero_copy_only=False))
            for part in np.unique(parts):
                rows = batch.filter(pa.array(parts == part))
                got = held.setdefault(int(part), [0, [], [], []])
                hashes, sizes = tokens_with_end(rows.column("text"))
                got[0] += 8 * len(hashes)
                for into, x in zip(got[1:], (rows.column("doc_id"), hashes, sizes), strict=True):
                    into.append(x)
                if got[0] >= block_bytes:
                    yield flush(int(part), *held.pop(int(part))[1:])
        for part, got in held.items():
            yield flush(part, *got[1:])

    return run


BLOCK = "block long, part int, n_docs long, n_tokens long, ids array<long>, words binary, counts binary, ranked binary, codes binary, sizes binary"


class Block:
    """A block's tokens, and for n = 1 .. order its distinct n-grams: sorted hashes, counts and the place of each token's n-gram."""

    def __init__(self, row: dict, order: int, bits: int):
        self.block, self.part, self.ids = row["block"], row["part"], row["ids"]
        self.sizes = unpack(row["sizes"]).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        words = unpack_sorted(row["words"])
        place = unpack(row["ranked"]).astype(np.int64)[unpack(row["codes"]).astype(np.int64)]
        self.hashes, self.counts, self.place = [words], [unpack(row["counts"]).astype(np.int64)], [place.astype(np.int32)]
        tokens = words[place]
        del place
        longer, begin = tokens, BEGIN
        for _ in range(1, order):
            before = np.empty_like(longer)
            before[1:] = longer[:-1]
            before[self.starts] = begin
            longer = S.mix(before * U64(S.MULTIPLIER) + tokens)
            begin = S.mix(np.array([begin], U64) * U64(S.MULTIPLIER) + BEGIN)[0]
            hashes, place, counts = np.unique(longer >> U64(64 - bits), return_inverse=True, return_counts=True)
            self.hashes.append(hashes)
            self.counts.append(counts.astype(np.int64))
            self.place.append(place.astype(np.int32))

    def totals(self, answers: list[dict]) -> list[list[np.ndarray]]:
        """For each n the counts (rest, deleted) of the distinct n-grams over all blocks."""
        zero = [np.zeros_like(c) for c in self.counts]
        out = [[c.copy(), z] if self.part == REST else [z, c.copy()] if self.part == DELETED else [z, z.copy()] for c, z in zip(self.counts, zero, strict=True)]
        for x in answers:
            at = unpack_sorted(x["places"]).astype(np.int64)
            rest, deleted = out[x["n"] - 1]
            rest[at], deleted[at] = unpack(x["rest"]).astype(np.int64), unpack(x["deleted"]).astype(np.int64)
        return out

    def seen(self, counts: list[np.ndarray], begin: int):
        """Yields (first token, own, contexts) for ranges of whole texts of about SLICE tokens: the tokens' n-gram counts, and their contexts' counts from n = 2 on; begin is the number of texts."""
        ends = np.append(self.starts, self.sizes.sum())
        for first, last in S.chunks(ends, SLICE):
            lo, hi = ends[first], ends[last]
            own = [c[p[lo:hi]] for c, p in zip(counts, self.place, strict=True)]
            contexts = []
            for c in own[:-1]:
                h = np.empty_like(c)
                h[1:] = c[:-1]
                h[self.starts[first:last] - lo] = begin
                contexts.append(h)
            yield lo, own, contexts


def _count_rows(n_buckets: int, order: int, bits: int):
    """Blocks → their distinct n-grams, cut into hash buckets."""
    top = n_buckets.bit_length() - 1

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, order, bits)
                out = []
                for n, (hashes, counts) in enumerate(zip(block.hashes, block.counts, strict=True), 1):
                    cuts = np.searchsorted(hashes >> U64((64 if n == 1 else bits) - top), np.arange(n_buckets + 1, dtype=U64))
                    for k in np.flatnonzero(np.diff(cuts)):
                        lo, hi = cuts[k], cuts[k + 1]
                        out.append((n, int(k), block.block, block.part, int(lo), pack_sorted(hashes[lo:hi]), pack(counts[lo:hi])))
                cols = list(zip(*out, strict=True))
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], "n bucket block part first hashes counts".split())

    return run


COUNTS = "n int, bucket int, block long, part int, first long, hashes binary, counts binary"
ANSWER = "block long, part int, n int, places binary, rest binary, deleted binary, stats array<long>"


def _add_up(group: pa.Table) -> pa.Table:
    """One bucket of one order: totals over all blocks, answered where they differ from a block's own."""
    rows = group.to_pylist()
    hashes = [unpack_sorted(r["hashes"]) for r in rows]
    counts = [unpack(r["counts"]).astype(np.int64) for r in rows]
    part = np.repeat([r["part"] for r in rows], [len(h) for h in hashes])
    flat = np.concatenate(counts)
    distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    rest = np.bincount(inverse, flat * (part == REST), minlength=len(distinct)).astype(np.int64)
    deleted = np.bincount(inverse, flat * (part == DELETED), minlength=len(distinct)).astype(np.int64)
    out, at = [], 0
    for r, c in zip(rows, counts, strict=True):
        mine = inverse[at : at + len(c)]
        at += len(c)
        zero = np.zeros_like(c)
        a, b = (c, zero) if r["part"] == REST else (zero, c) if r["part"] == DELETED else (zero, zero)
        differ = np.flatnonzero((rest[mine] != a) | (deleted[mine] != b))
        if len(differ):
            to = mine[differ]
            out.append((r["block"], r["part"], r["n"], pack_sorted(differ + r["first"]), pack(rest[to]), pack(deleted[to]), None))
    if rows[0]["n"] == 1:
        out.append((None, -1, 1, None, None, None, [int((rest + deleted > 0).sum()), int((rest + deleted).sum()), int((rest > 0).sum()), int(rest.sum())]))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    names = "block part n places rest deleted stats".split()
    cols = list(zip(*out, strict=True)) or [[]] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


class Weights:
    """Mixture weights: by_level[0] is m, by_level[n - 1][b] is l_n(b)."""

    def __init__(self, order: int):
        self.by_level = [np.full(1 if n == 1 else BUCKETS, 0.5) for n in range(1, order + 1)]

    def levels(self, own, contexts, n_tokens: int, n_words: int):
        """For each level from 1 on: (estimate, weight, bucket), and the uniform probability."""
        out = [(own[0] / max(1, n_tokens), np.full(len(own[0]), self.by_level[0][0] if n_tokens else 0.0), np.zeros(len(own[0]), np.int64))]
        for c, h, w in zip(own[1:], contexts, self.by_level[1:], strict=True):
            bucket = _bucket(h)
            out.append((c / np.maximum(h, 1), np.where(h > 0, w[bucket], 0.0), np.where(h > 0, bucket, -1)))
        return out, 1.0 / (n_words + 1)

    def probability(self, own, contexts, n_tokens: int, n_words: int) -> np.ndarray:
        levels, p = self.levels(own, contexts, n_tokens, n_words)
        for estimate, weight, _ in levels:
            p = weight * estimate + (1 - weight) * p
        return p

    def expected(self, own, contexts, times, n_tokens: int, n_words: int):
        """One round's sums: for each level (times taken, times reached) by bucket."""
        levels, p = self.levels(own, contexts, n_tokens, n_words)
        mixed = []
        for estimate, weight, _ in levels:
            p = weight * estimate + (1 - weight) * p
            mixed.append(p)
        reach, sums = times.astype(float), []
        for (estimate, weight, bucket), p, held in zip(reversed(levels), reversed(mixed), reversed(self.by_level), strict=True):
            taken = reach * weight * estimate / p
            known = bucket >= 0
            sums.append([np.bincount(bucket[known], x[known], minlength=len(held)) for x in (taken, reach)])
            reach = reach - taken
        return sums[::-1]

    def updated(self, sums) -> Weights:
        out = Weights(len(self.by_level))
        for new, (taken, reach) in zip(out.by_level, sums, strict=True):
            known = np.flatnonzero(reach > 0)
            if len(known):
                near = known[np.abs(np.arange(len(new))[:, None] - known).argmin(1)]
                new[:] = np.clip(taken[near] / reach[near], 1e-6, 1 - 1e-6)
        return out

    def distance(self, other: Weights) -> float:
        return max(float(np.abs(a - b).max()) for a, b in zip(self.by_level, other.by_level, strict=True))


def learn_weights(seen: DataFrame, order: int, n_tokens: int, n_words: int, rounds: int, tolerance: float) -> Weights:
    """Expectation-maximisation over seen: rows of packed c1 .. c_order, h2 .. h_order and times, one job a round."""
    weights = Weights(order)
    for _ in range(rounds):
        now = weights

        def run(batches, now=now):
            total = [[np.zeros(len(w)), np.zeros(len(w))] for w in now.by_level]
            for batch in batches:
                for i in range(batch.num_rows):
                    flat = {k: unpack(batch.column(k)[i].as_py()).astype(np.int64) for k in batch.schema.names}
                    own, contexts = [flat[f"c{n}"] for n in range(1, order + 1)], [flat[f"h{n}"] for n in range(2, order + 1)]
                    for into, x in zip(total, now.expected(own, contexts, flat["times"], n_tokens, n_words), strict=True):
                        into[0] += x[0]
                        into[1] += x[1]
            level = np.repeat(np.arange(order), [len(t[0]) for t in total])
            bucket = np.concatenate([np.arange(len(t[0])) for t in total])
            yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(bucket), *(pa.array(np.concatenate([t[k] for t in total])) for k in (0, 1))], ["level", "bucket", "taken", "reach"])

        got = seen.mapInArrow(run, "level long, bucket long, taken double, reach double").groupBy("level", "bucket").agg(F.sum("taken").alias("taken"), F.sum("reach").alias("reach")).collect()
        sums = [[np.zeros(len(w)), np.zeros(len(w))] for w in now.by_level]
        for r in got:
            sums[r["level"]][0][r["bucket"]], sums[r["level"]][1][r["bucket"]] = r["taken"], r["reach"]
        weights = now.updated(sums)
        if weights.distance(now) < tolerance:
            break
    return weights


def _bucket(contexts: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(contexts, 1))).astype(np.int64), BUCKETS - 1)


def language_model_scores(
    docs: DataFrame, folds: int = 7, held_out: int = 2, deleted: int = 3, order: int = 3, block_bytes: int = 4 << 20, bucket_bytes: int = 2 << 20, rounds: int = 20, tolerance: float = 1e-3
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per document row.

    Learns from documents outside fold ``held_out``; of those, fold ``deleted``
    is the part that the mixture weights are learned on, in at most ``rounds``
    rounds or until no weight moves by ``tolerance``. block_bytes bounds a block's
    token hashes, bucket_bytes about the packed n-grams of a bucket.
    """
    S.small_batches(docs.sparkSession)
    fold = S.crc_mod(F.col("doc_id"), folds)
    part = F.when(fold == held_out, OTHER).when(fold == deleted, DELETED).when(fold.isNull(), OTHER).otherwise(REST)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("part", part.cast("int"))
    blocks = S.written(docs.mapInArrow(_blocks(block_bytes), BLOCK), "lm-blocks")
    sizes = blocks.groupBy("part").agg(F.sum("n_docs").alias("docs"), F.sum("n_tokens").alias("tokens"), F.sum(F.octet_length("codes") + F.octet_length("words")).alias("bytes")).collect()
    n_docs = {r["part"]: r["docs"] for r in sizes}
    bits = min(64, sum(r["tokens"] for r in sizes).bit_length() + SPARE_BITS)
    n_buckets = 1 << max(5, (sum(r["bytes"] for r in sizes) // bucket_bytes).bit_length())
    counted = blocks.mapInArrow(_count_rows(n_buckets, order, bits), COUNTS).groupBy("n", "bucket").applyInArrow(_add_up, ANSWER)
    answers = S.written(counted, "lm-answers")
    sums = answers.where("stats is not null")
    v, n, v_rest, n_rest = (x or 0 for x in sums.agg(*(F.sum(F.col("stats")[k]) for k in range(4))).first())
    told = answers.where("block is not null").select("block", "part", "n", "places", "rest", "deleted")

    def cogroup(which, run, schema):
        return blocks.where(which).groupBy("block").cogroup(told.where(which).groupBy("block")).applyInArrow(run, schema)

    begin_rest, begin_all = n_docs.get(REST, 0), n_docs.get(REST, 0) + n_docs.get(DELETED, 0)
    names = [*(f"c{k}" for k in range(1, order + 1)), *(f"h{k}" for k in range(2, order + 1)), "times"]

    def observe(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left.to_pylist()[0], order, bits)
        parts = []
        for _, own, contexts in block.seen([rest for rest, _ in block.totals(right.to_pylist())], begin_rest):
            rows = [*own, *contexts]
            key = np.zeros(len(rows[0]), U64)
            for x in rows:
                key = S.mix(key * U64(S.MULTIPLIER) + x.astype(U64))
            _, first, times = np.unique(key, return_index=True, return_counts=True)
            parts += [[x[lo : lo + SEEN_ROWS] for x in (*(r[first] for r in rows), times)] for lo in range(0, len(times), SEEN_ROWS)]
        return pa.table({k: pa.array([pack(p[i]) for p in parts], pa.binary()) for i, k in enumerate(names)})

    seen = S.written(cogroup(F.col("part") == DELETED, observe, ", ".join(f"{k} binary" for k in names)), "lm-deleted")
    weights = learn_weights(seen, order, n_rest, v_rest, rounds, tolerance)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left.to_pylist()[0], order, bits)
        known, base, score = (np.zeros(len(block.place[0])) for _ in range(3))
        for lo, own, contexts in block.seen([rest + deleted for rest, deleted in block.totals(right.to_pylist())], begin_all):
            here = slice(lo, lo + len(own[0]))
            known[here] = own[0] > 0
            base[here] = np.log10((own[0] + 1) / (n + v + 1))
            score[here] = np.log10(weights.probability(own, contexts, n, v))
        per_text = lambda x: np.add.reduceat(x, block.starts)
        return pa.table({
            "doc_id": pa.array(block.ids, pa.int64()), "n_tokens": pa.array(block.sizes), "n_known": pa.array(per_text(known).astype(np.int64)),
            "base_score": pa.array(per_text(base)), "score": pa.array(per_text(score)),
        })

    out = cogroup(F.lit(True), score, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    held = F.coalesce(S.crc_mod(F.col("doc_id"), folds) == held_out, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
