"""Language ID: nearest of several clustered TF-IDF centroids per language.

Character trigrams (lower-cased bytes, everything that is no letter as one
blank) are hashed to a fixed number of slots; vectors are term frequency times
inverse document frequency, L2-normalised. Document frequencies come from all
training documents; the centroids come from spherical k-means inside each
language over a bounded sample of its documents. A text takes the language of
the centroid with the largest cosine; it is marked rejected when its distance
exceeds that language's radius, a quantile over sampled rows that the centroids
were not fitted on.

Edges: null texts and texts without a letter get ``und`` and score 0; null
languages are not learned from; without a learned language every text is
``und``; repeated rows are predicted each; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import shared as S

U64 = np.uint64
SLOTS = 4096
_LETTERS = S.LOWER.copy()
_LETTERS[[b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)]] = 32


def trigram_counts(data: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Dense (rows, slots) counts of the hashed byte trigrams of each row."""
    n_rows = len(offsets) - 1
    out = np.zeros((n_rows, slots), np.float32)
    if len(data) < 3:
        return out
    text = _LETTERS[data].astype(np.uint32)
    code = (text[:-2] << 16) | (text[1:-1] << 8) | text[2:]
    blank = text == 32
    used = ~(blank[:-2] & blank[1:-1]) & ~(blank[1:-1] & blank[2:])
    rows = np.repeat(np.arange(n_rows), np.diff(offsets))
    used &= rows[:-2] == rows[2:]
    slot = (S.mix(code[used].astype(U64)) >> U64(40)).astype(np.int64) % slots
    flat = np.bincount(rows[:-2][used] * slots + slot, minlength=n_rows * slots)
    return flat.reshape(n_rows, slots).astype(np.float32)


def vectors(data: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = trigram_counts(data, offsets, len(idf))
    x *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    x /= np.maximum(norm, 1e-12)[:, None]
    return x


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; starts are the row nearest the mean, then the farthest from those chosen."""
    k = max(1, min(k, len(x)))
    mean = x.mean(0)
    chosen = [int(np.argmax(x @ mean))]
    best = x @ x[chosen[0]]
    while len(chosen) < k:
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, x @ x[chosen[-1]])
    c = x[chosen].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T, 1)
        for j in range(k):
            if (near == j).any():
                m = x[near == j].sum(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def _small_chunks(column):
    """Chunks with few rows, as vectors are dense."""
    for lo, hi, data, offsets in S.text_chunks(column, 1 << 20):
        for a in range(0, hi - lo, 500):
            b = min(a + 500, hi - lo)
            yield lo + a, lo + b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def train(learn: DataFrame, per_language: int, centroids: int, slots: int, quantile: float):
    """learn: (doc_id, text, lang). Returns (idf, [(language, radius)], centroid matrix, owner of each centroid)."""
    spark = learn.sparkSession

    def count(batches):
        total, n = np.zeros(slots, np.int64), 0
        for batch in batches:
            for lo, hi, data, offsets in _small_chunks(batch.column("text")):
                total += (trigram_counts(data, offsets, slots) > 0).sum(0)
                n += hi - lo
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(slots + 1)), pa.array(np.append(total, n))], ["slot", "n"])

    sums = learn.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(slots + 1)
    df[sums.column("slot").to_numpy()] = sums.column("n").to_numpy()
    idf = (np.log((df[-1] + 1) / (df[:-1] + 1)) + 1).astype(np.float32)
    sizes = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return idf, [], np.zeros((0, slots), np.float32), np.zeros(0, np.int64)
    share = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    sample = learn.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    given = spark.sparkContext.broadcast(idf)

    def cluster(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        parts = [vectors(data, offsets, given.value) for _, _, data, offsets in _small_chunks(group.column("text"))]
        x = np.concatenate(parts)
        x = x[x.any(1)]
        lang = group.column("lang")[0].as_py()
        if not len(x):
            return pa.table({"lang": pa.array([], pa.string()), "radius": pa.array([], pa.float64()), "centroid": pa.array([], pa.binary())})
        # Every fifth row sets the radius and takes no part in the clustering.
        apart = np.arange(len(x)) % 5 == 4
        c = spherical_kmeans(x[~apart], centroids)
        far = x[apart] if apart.any() else x
        radius = float(np.quantile(1 - (far @ c.T).max(1), quantile))
        return pa.table({"lang": [lang] * len(c), "radius": [radius] * len(c), "centroid": pa.array([v.astype(np.float32).tobytes() for v in c], pa.binary())})

    got = sample.groupBy("lang").applyInArrow(cluster, "lang string, radius double, centroid binary").collect()
    got = sorted(got, key=lambda r: (r["lang"], bytes(r["centroid"])))
    langs = sorted({(r["lang"], r["radius"]) for r in got})
    at = {name: i for i, (name, _) in enumerate(langs)}
    matrix = np.stack([np.frombuffer(r["centroid"], np.float32) for r in got]) if got else np.zeros((0, slots), np.float32)
    return idf, langs, matrix, np.array([at[r["lang"]] for r in got], np.int64)


def identify_language(
    docs: DataFrame, folds: int = 5, held_out: int = 0, per_language: int = 1500, centroids: int = 4, slots: int = SLOTS, quantile: float = 0.999, reject_as_und: bool = False
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): one row per document row.

    score is the cosine to the nearest centroid. per_language is the expected
    number of documents of a language in the sample that the centroids are
    fitted on. With reject_as_und a rejected text gets ``und`` too.
    """
    spark = docs.sparkSession
    S.small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    held = F.coalesce(S.crc_mod(F.col("doc_id"), folds) == held_out, F.lit(False))
    learn = docs.where(~held & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    model = spark.sparkContext.broadcast(train(learn, per_language, centroids, slots, quantile))

    def predict(batches):
        idf, langs, matrix, owner = model.value
        for batch in batches:
            n = batch.num_rows
            near, cosine = np.zeros(n, np.int64), np.zeros(n)
            if len(matrix):
                for lo, hi, data, offsets in _small_chunks(batch.column("text")):
                    sims = vectors(data, offsets, idf) @ matrix.T
                    best = sims.argmax(1)
                    near[lo:hi], cosine[lo:hi] = owner[best], sims[np.arange(hi - lo), best]
            names = np.array([x for x, _ in langs] or ["und"], object)
            radius = np.array([x for _, x in langs] or [0.0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("letters"), pa.array(names[near], pa.string()), pa.array(np.clip(cosine, 0, 1)), pa.array(1 - cosine > radius[near])],
                ["doc_id", "letters", "lang_pred", "score", "rejected"],
            )

    out = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    out = out.mapInArrow(predict, "doc_id long, letters boolean, lang_pred string, score double, rejected boolean")
    unknown = ~F.col("letters") | (F.col("rejected") & F.lit(reject_as_und))
    return out.select(
        "doc_id",
        F.coalesce(S.crc_mod(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"),
        F.when(unknown, "und").otherwise(F.col("lang_pred")).alias("lang_pred"),
        F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"),
        (F.col("letters") & F.col("rejected")).alias("rejected"),
    )
