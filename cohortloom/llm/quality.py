"""Quality classifier: hashed word n-grams, logistic regression by FTRL.

Tokens are runs of letters and digits or runs of other visible characters.
Features are hashed: lower-cased token unigrams and bigrams, n-grams of token
shapes (lower, capital, upper, or the punctuation itself), and the share of
trigrams that repeat an earlier one of the same text. Values are shares of the
text's tokens, so scoring a text is one sparse dot product.

Training: follow-the-regularised-leader updates (per-coordinate, proximal) over
a bounded sample of labelled rows, in an order fixed by a hash of doc_id.

Edges: null and empty texts have no feature and get the model's intercept;
null labels and ids are ignored in training; without labels every score is 0.5;
repeated rows are scored each; extra columns are ignored (kept by the filter);
an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import shared as S
from cohortloom.llm.labelled import labelled_sample

BITS = 18
U64 = np.uint64

_KIND = np.full(256, 2, np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _slots(hashes: np.ndarray, salt: int, bits: int) -> np.ndarray:
    return (S.mix(hashes + U64(salt)) >> U64(64 - bits)).astype(np.int64)


def token_features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS):
    """(row, slot, value) of all features of a chunk of texts; values of a row add up to its feature families."""
    n_rows = len(offsets) - 1
    kind = _KIND[data]
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    breaks = np.ones(len(data), bool)
    breaks[1:] = kind[1:] != kind[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    breaks[inner] = True
    first = np.flatnonzero(breaks)
    ends = np.append(first[1:], len(data))
    keep = kind[first] > 0
    starts, ends = first[keep], ends[keep]
    rows = np.searchsorted(offsets, starts, "right") - 1
    tokens = S.span_hash(S.prefix_sums(S.LOWER[data]), starts, ends)
    second = np.minimum(starts + 1, len(data) - 1)
    up1, up2 = _UPPER[data[starts]], _UPPER[data[second]] & (ends - starts > 1)
    shapes = np.where(kind[starts] == 2, tokens, 1 + up1.astype(U64) + (up1 & up2).astype(U64))
    counts = np.bincount(rows, minlength=n_rows)
    out_r, out_s, out_v = [], [], []

    def add(r, h, salt):
        out_r.append(r)
        out_s.append(_slots(h, salt, bits))
        out_v.append(1.0 / counts[r])

    add(rows, tokens, 11)
    h, r = S.ngram_hash(tokens, rows, 2)
    add(r, h, 12)
    add(rows, shapes, 13)
    h, r = S.ngram_hash(shapes, rows, 2)
    add(r, h, 14)
    h, r = S.ngram_hash(tokens, rows, 3)
    if len(h):
        keyed = S.mix(h ^ (r.astype(U64) * U64(S.MULTIPLIER)))
        _, where = np.unique(keyed, return_index=True)
        again = np.ones(len(h), bool)
        again[where] = False
        add(r[again], np.zeros(int(again.sum()), U64), 15)
    return np.concatenate(out_r), np.concatenate(out_s), np.concatenate(out_v)


def score_texts(column, weights: np.ndarray, bias: float, bits: int = BITS) -> np.ndarray:
    out = np.full(len(column), bias)
    for lo, hi, data, offsets in S.text_chunks(column):
        r, s, v = token_features(data, offsets, bits)
        out[lo:hi] += np.bincount(r, weights[s] * v, minlength=hi - lo)
    return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def ftrl(rows, bits: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4):
    """FTRL-proximal over a stream of (slots, values, y), one update each; slot 2^bits is the intercept. Returns (weights, bias)."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    for s, v, y in rows:
        zs, ns = z[s], n[s]
        root = np.sqrt(ns)
        w = np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + root) / alpha + l2))
        p = 1 / (1 + np.exp(-np.clip(w @ v, -50, 50)))
        g = (p - y) * v
        z[s] = zs + g - (np.sqrt(ns + g * g) - root) / alpha * w
        n[s] = ns + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w[:-1], float(w[-1])


def train(sample: DataFrame, bits: int = BITS, scale: float = 8.0, epochs: int = 3) -> tuple[np.ndarray, float]:
    """Features are made where the texts are; the updates, which follow each other, read one sorted stream of the bounded sample and hold the model only."""

    def featurise(batches):
        for batch in batches:
            ids, ys = batch.column("doc_id"), batch.column("y")
            for lo, hi, data, offsets in S.text_chunks(batch.column("text")):
                r, s, v = token_features(data, offsets, bits)
                key, at = np.unique(r * (1 << bits) + s, return_inverse=True)
                total = np.bincount(at, v, minlength=len(key))
                cuts = np.searchsorted(key, np.arange(hi - lo + 1) << bits)
                slots = pa.array((key & ((1 << bits) - 1)).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), slots)
                values = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(total.astype(np.float32)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), ys.slice(lo, hi - lo), lists, values], ["doc_id", "y", "slots", "vals"])

    def fit(batches):
        def rows():
            for batch in batches:
                ys = np.minimum(batch.column("y").to_numpy(), 1).astype(float)
                lists, values = batch.column("slots"), batch.column("vals").flatten().to_numpy()
                cuts, slots = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
                for i, y in enumerate(ys):
                    lo, hi = cuts[i], cuts[i + 1]
                    yield np.append(slots[lo:hi], 1 << bits), np.append(values[lo:hi] * scale, 1.0), y

        w, b = ftrl(rows(), bits)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, 1 << bits), pa.int64()), pa.array(np.append(w[at] * scale, b), pa.float64())], ["slot", "w"])

    features = sample.mapInArrow(featurise, "doc_id long, y int, slots array<int>, vals array<float>")
    features = features.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    stream = features.repartition(1).sortWithinPartitions("epoch", F.xxhash64("doc_id", F.lit(5)), "doc_id", "y", "slots")
    got = stream.mapInArrow(fit, "slot long, w double").toArrow()
    weights, bias = np.zeros(1 << bits), 0.0
    slots, ws = got.column("slot").to_numpy(), got.column("w").to_numpy()
    inside = slots < 1 << bits
    weights[slots[inside]] = ws[inside]
    if (~inside).any():
        bias = float(ws[~inside][0])
    return weights, bias


def classify_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, sample_rows: int = 16_000, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per document row, label 1 likelier with a higher score.

    sample_rows bounds the labelled rows that the fit takes.
    """
    spark = docs.sparkSession
    S.small_batches(spark)
    weights, bias = train(labelled_sample(docs, labels, "quality", folds, held_out, sample_rows))
    model = spark.sparkContext.broadcast((weights, bias))

    def score(batches):
        w, b = model.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_texts(batch.column("text"), w, b))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")
    held = F.coalesce(S.crc_mod(F.col("doc_id"), folds) == held_out, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier accepts, with their columns unchanged."""
    spark = docs.sparkSession
    S.small_batches(spark)
    weights, bias = train(labelled_sample(docs, labels, "quality", options.get("folds", 3), options.get("held_out", 1), options.get("sample_rows", 16_000)))
    model = spark.sparkContext.broadcast((weights, bias))
    threshold = options.get("threshold", 0.5)

    def accept(batches):
        w, b = model.value
        for batch in batches:
            yield batch.filter(pa.array(score_texts(batch.column("text"), w, b) >= threshold))

    return docs.mapInArrow(accept, docs.schema)
