"""Helpers shared by the training-data operators.

Byte-level text work is vectorised with numpy inside Arrow batches. A batch of
texts is one flat byte array plus row offsets, worked through in chunks of
bounded size; whole texts are always processed, never prefixes.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20
BATCH_ROWS = 2000
U64 = np.uint64
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small enough for texts of tens of kilobytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, one of our own in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def boxed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text, d): all columns of docs in the struct d, so that no added column can clash; text_key tells texts of one doc_id apart."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text", row.alias("d"))


def crc_mod(doc_id, n: int):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


# ---------------------------------------------------------------- flat bytes


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Arrow strings → (bytes, offsets with one more entry than rows); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges of at most ``limit`` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def text_chunks(column, limit: int = CHUNK_BYTES):
    """(first row, last row + 1, bytes, offsets from 0) for each chunk of a batch's column."""
    data, offsets = flat(column)
    for lo, hi in chunks(offsets, limit):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def ascii_lower_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


LOWER = ascii_lower_table()
#: Words of [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


with np.errstate(over="ignore"):
    BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))

_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M^0..M^(n-1) and the inverse powers, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 1))
        for name, m in (("up", MULTIPLIER), ("down", INVERSE)):
            out = np.full(size, m, U64)
            out[0] = 1
            _POWERS[name] = np.cumprod(out, dtype=U64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with (P[e] - P[s]) * M^-s the polynomial hash of bytes s..e-1."""
    up, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, U64)
    out[0] = 0
    np.cumsum(BYTE_CODES[data] * up[:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross rows: starts, ends, row of each."""
    n = len(inside)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def segments(inside: np.ndarray, limit: int):
    """Ranges of about ``limit`` bytes that end outside words."""
    lo, n = 0, len(inside)
    while lo < n:
        hi = min(lo + limit, n)
        while hi < n and inside[hi]:
            stop = np.flatnonzero(~inside[hi : hi + limit])
            hi = hi + int(stop[0]) if len(stop) else min(hi + limit, n)
        yield lo, hi
        lo = hi


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE, lower: bool = True):
    """(word hash, row of each word, starts, ends) of a chunk; long chunks are hashed piece by piece, which bounds the memory of a long text."""
    inside = is_word[LOWER[data] if lower else data]
    starts, ends, rows = spans_of(inside, offsets)
    out = np.empty(len(starts), U64)
    for lo, hi in segments(inside, 2 * CHUNK_BYTES):
        a, b = np.searchsorted(starts, [lo, hi])
        if a < b:
            piece = LOWER[data[lo:hi]] if lower else data[lo:hi]
            out[a:b] = span_hash(prefix_sums(piece), starts[a:b] - lo, ends[a:b] - lo)
    return out, rows, starts, ends


def ngram_hash(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one row, and the row of each."""
    if len(words) < n:
        return words[:0], rows[:0]
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * U64(MULTIPLIER) + words[k : len(words) - n + 1 + k])
    ok = rows[: len(rows) - n + 1] == rows[n - 1 :]
    return out[ok], rows[: len(rows) - n + 1][ok]


def distinct_sorted(values: np.ndarray) -> np.ndarray:
    if len(values) == 0:
        return values
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    return values[keep]
