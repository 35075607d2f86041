"""Toxicity: character n-gram linear classifier on naive Bayes log-count ratios.

Text is lower-cased (A-Z), everything but letters becomes a blank, and windows
of several lengths over the bytes are hashed. Over the labelled sample each
n-gram's document counts per class give the log-count ratio r (add-one); the
n-grams with the strongest evidence are kept, presence times r are the features,
and a ridge logistic regression is fitted on them. A text's score is a sparse
dot product over the distinct kept n-grams that it holds.

Edges: null and empty texts get the intercept's score; null labels and ids are
ignored in training; without both classes every score is the share of label 1
(0 without labels); repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import shared as S
from cohortloom.llm.labelled import labelled_sample

U64 = np.uint64
BITS = 21
LENGTHS = (4, 6, 8)
KEPT = 4096

_LETTERS = S.LOWER.copy()
_LETTERS[[b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)]] = 32


def ngram_slots(data: np.ndarray, offsets: np.ndarray, lengths=LENGTHS, bits: int = BITS):
    """Yields (row, slot) of every byte window of each length inside a row; rows are padded by a blank."""
    n_rows = len(offsets) - 1
    padded = np.full(len(data) + 2 * n_rows, 32, np.uint8)
    shift = 2 * np.repeat(np.arange(n_rows), np.diff(offsets)) + 1
    padded[np.arange(len(data)) + shift] = _LETTERS[data]
    bounds = offsets + 2 * np.arange(n_rows + 1)
    sums = S.prefix_sums(padded)
    _, down = S.powers(len(sums))
    rows = np.repeat(np.arange(n_rows, dtype=np.int32), np.diff(bounds))
    for n in lengths:
        if len(padded) < n:
            continue
        last = len(padded) - n + 1
        h = ((sums[n:] - sums[:last]) * down[:last]) * U64(S.MULTIPLIER + 2 * n)
        slot = ((h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)) >> U64(64 - bits)
        ok = (rows[:last] == rows[n - 1 :]) & (padded[:last] != 0)
        yield rows[:last][ok], slot[ok].astype(np.int64)


def presence(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None, bits: int = BITS):
    """Distinct (row, slot) pairs of a chunk, only of wanted slots if given."""
    keys = []
    for rows, slots in ngram_slots(data, offsets, bits=bits):
        if wanted is not None:
            hit = wanted[slots]
            rows, slots = rows[hit], slots[hit]
        keys.append((rows.astype(np.int64) << bits) | slots)
    key = S.distinct_sorted(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return key >> bits, key & ((1 << bits) - 1)


def log_count_ratios(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """log of add-one document rates of an n-gram in either class."""
    return np.log((pos + 1.0) / (n_pos + 2.0)) - np.log((neg + 1.0) / (n_neg + 2.0))


def strongest(counts: DataFrame, n_pos: int, n_neg: int, kept: int) -> DataFrame:
    """counts (slot, pos, neg): the kept slots with the largest likelihood-ratio evidence against equal rates; ties by slot."""
    total = F.col("pos") + F.col("neg")
    part = lambda seen, rate: F.when(F.col(seen) > 0, F.col(seen) * F.log(F.col(seen) / (total * rate))).otherwise(0.0)
    evidence = part("pos", n_pos / (n_pos + n_neg)) + part("neg", n_neg / (n_pos + n_neg))
    ranked = counts.withColumn("evidence", F.round(evidence, 9)).where("evidence > 0")
    return ranked.orderBy(F.desc("evidence"), "slot").limit(kept)


def ridge_logistic(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, n_cols: int, ridge: float = 1.0, rounds: int = 300):
    """Logistic regression by accelerated gradient steps over sparse triples; the intercept is not penalised."""
    n = len(y)
    w, b = np.zeros(n_cols), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    # A bound of the curvature: largest row norm squared / 4 by power steps.
    v = np.ones(n_cols) / max(1, np.sqrt(n_cols))
    for _ in range(20):
        u = np.bincount(rows, vals * v[cols], minlength=n)
        v = np.bincount(cols, vals * u[rows], minlength=n_cols)
        top = np.linalg.norm(v)
        v = v / max(top, 1e-12)
    step = 1 / (top / 4 + n / 4 + ridge)
    pw, pb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        z = np.bincount(rows, vals * pw[cols], minlength=n) + pb
        e = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        nw = pw - step * (np.bincount(cols, vals * e[rows], minlength=n_cols) + ridge * pw)
        nb = pb - step * e.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def score_texts(column, table: np.ndarray, wanted: np.ndarray, bias: float, bits: int = BITS) -> np.ndarray:
    out = np.full(len(column), bias)
    for lo, hi, data, offsets in S.text_chunks(column, 1 << 20):
        r, s = presence(data, offsets, wanted, bits)
        out[lo:hi] += np.bincount(r, table[s], minlength=hi - lo)
    return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def train(sample: DataFrame, bits: int = BITS, kept: int = KEPT):
    """(table of weights by slot, wanted slots, intercept).

    Counts are summed per slot and ranked on the executors, and the kept slots
    come back. The second pass brings back the kept n-grams present in each
    sampled row, bounded by rows x kept.
    """
    spark = sample.sparkSession

    def count(batches):
        for batch in batches:
            y = np.asarray(batch.column("y").to_numpy(zero_copy_only=False)) > 0
            pos, neg = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
            for lo, hi, data, offsets in S.text_chunks(batch.column("text"), 1 << 20):
                r, s = presence(data, offsets, None, bits)
                at = y[lo:hi][r]
                pos += np.bincount(s[at], minlength=1 << bits).astype(np.int32)
                neg += np.bincount(s[~at], minlength=1 << bits).astype(np.int32)
            seen = np.flatnonzero(pos | neg)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(pos[seen]), pa.array(neg[seen])], ["slot", "pos", "neg"])

    n_rows = {int(r["y"]): r["n"] for r in sample.groupBy(F.least("y", F.lit(1)).alias("y")).agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = n_rows.get(1, 0), n_rows.get(0, 0)
    table, wanted = np.zeros(1 << bits), np.zeros(1 << bits, bool)
    if not n_pos or not n_neg:
        share = n_pos / max(1, n_pos + n_neg)
        return table, wanted, float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    sums = sample.mapInArrow(count, "slot long, pos int, neg int").groupBy("slot").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    got = strongest(sums, n_pos, n_neg, kept).toArrow().sort_by("slot")
    slots = got.column("slot").to_numpy()
    ratios = log_count_ratios(got.column("pos").to_numpy(), got.column("neg").to_numpy(), n_pos, n_neg)
    wanted[slots] = True
    picked = spark.sparkContext.broadcast(np.packbits(wanted))

    def mark(batches):
        want = np.unpackbits(picked.value).astype(bool)
        for batch in batches:
            for lo, hi, data, offsets in S.text_chunks(batch.column("text"), 1 << 20):
                r, s = presence(data, offsets, want, bits)
                cuts = np.searchsorted(r, np.arange(hi - lo + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(s.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(lo, hi - lo), batch.column("doc_id").slice(lo, hi - lo), lists], ["y", "doc_id", "slots"])

    marked = sample.mapInArrow(mark, "y int, doc_id long, slots array<int>").toArrow().sort_by("doc_id").combine_chunks()
    y = np.minimum(marked.column("y").to_numpy(), 1).astype(float)
    lists = marked.column("slots").combine_chunks()
    sizes = np.diff(np.asarray(lists.offsets))
    cols = np.searchsorted(slots, np.asarray(lists.flatten()))
    rows = np.repeat(np.arange(len(y)), sizes)
    w, b = ridge_logistic(rows, cols, ratios[cols], y, len(slots))
    table[slots] = w * ratios
    return table, wanted, b


def classify_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample_rows: int = 16_000, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per document row; sample_rows bounds the labelled rows of the fit."""
    spark = docs.sparkSession
    S.small_batches(spark)
    sample = S.written(labelled_sample(docs, labels, "toxic", folds, held_out, sample_rows), "toxic-sample")
    model = spark.sparkContext.broadcast(train(sample))

    def score(batches):
        table, wanted, bias = model.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_texts(batch.column("text"), table, wanted, bias))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")
    held = F.coalesce(S.crc_mod(F.col("doc_id"), folds) == held_out, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
