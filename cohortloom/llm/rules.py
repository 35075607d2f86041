"""Quality rules: statistics of every text, fixed rules, and an isolation forest on the statistics.

The forest isolates documents by random splits of their statistics; a short path is
an anomaly. Labelled good documents are dealt into halves; every tree is grown over all of
one half (and a copy of them with some statistics moved at random), so that the length of
a path tells how far a document is from good text; trees differ by their splits. All trees
grow a level at a time: one pass over the rows returns the count and the ranges of the
nodes. The threshold is the anomaly score that at most ``max_loss`` of all good documents
exceed, each scored by the trees of the other half; it is found by counting. Trees are at most ``trees`` x 2 to the power of
``depth`` + 1 nodes, which bounds what goes to the driver and back; counts, trees,
threshold, statistics and verdicts are of all rows.

Edge cases: a null or empty text has no words and fails the rules. A line is what
stands between line feeds, compared with all its spaces; lines without a word are
never duplicates. Windows of five words are compared by 64-bit hashes. Without labels
of good documents the forest rejects nothing. Several rows of a doc_id are judged
apart; null labels and ids are no labels. Of several label rows of a document the
smallest counts. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import shared as S

#: Symbols that count, words of a window, and the rules' limits.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_marks", "n_digits", "n_alpha_words")
#: What the forest splits: shares of the counts, so that the length of a text is no anomaly.
FEATURES = {
    "word_length": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "letters": ("n_letters", "word_chars"),
    "upper": ("n_upper", "word_chars"),
    "marks": ("n_marks", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "alpha_words": ("n_alpha_words", "n_words"),
}


def byte_table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


START = np.ones(256, bool)  # bytes that begin a character
START[0x80:0xC0] = False
UPPER, DIGIT, SYMBOL = byte_table(bytes(range(65, 91))), byte_table(b"0123456789"), byte_table(SYMBOLS)
MARK = byte_table(b"!?.,;:()[]{}=/\\_~^@+\"'`|#*$%&<>")
LETTER = START & ~byte_table(bytes(range(128)))
LETTER[65:91] = LETTER[97:123] = True
BEYOND = byte_table(bytes(range(128, 192)))


def repeated_lines(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, of them those equal to an earlier line) of each row."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([offsets[1:], breaks]))
    row = np.sort(np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1]))
    held = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=held[1:])
    some = held[ends] > held[starts]
    starts, ends, row = starts[some], ends[some], row[some]
    hashes = np.empty(len(starts), S.U64)
    for a, b in S.chunks(np.append(starts, ends[-1:])) if len(starts) else ():
        lo = starts[a]
        sums = S.prefix_sums(data[lo : ends[b - 1]])
        hashes[a:b] = S.span_hash(sums, starts[a:b] - lo, ends[a:b] - lo)
    order = np.lexsort((ends - starts, hashes, row))
    same = np.zeros(len(order), bool)
    x, y = order[1:], order[:-1]
    same[1:] = (row[x] == row[y]) & (hashes[x] == hashes[y]) & ((ends - starts)[x] == (ends - starts)[y])
    return np.bincount(row, minlength=n), np.bincount(row[order[same]], minlength=n)


def repeated_words(words: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Words in windows that stand at least twice in their row, the first time included."""
    grams, _ = S.ngram_hash(words, rows, WINDOW)
    first = np.flatnonzero(rows[: len(rows) - WINDOW + 1] == rows[WINDOW - 1 :]) if len(rows) >= WINDOW else np.zeros(0, np.int64)
    order = np.lexsort((grams, rows[first]))
    twice = np.zeros(len(order), bool)
    equal = (grams[order[1:]] == grams[order[:-1]]) & (rows[first[order[1:]]] == rows[first[order[:-1]]])
    twice[1:] |= equal
    twice[:-1] |= equal
    begins = np.zeros(len(words) + 1, np.int64)
    hit = first[order[twice]]
    np.add.at(begins, hit, 1)
    np.add.at(begins, hit + WINDOW, -1)
    return np.bincount(rows[np.cumsum(begins[:-1]) > 0], minlength=n)


def counted(column) -> np.ndarray:
    """COUNTS of every text of an Arrow column, as rows x counts."""
    out = [np.zeros((0, len(COUNTS)), np.int64)]
    for lo, hi, data, offsets in S.text_chunks(column):
        n = hi - lo
        words, rows, starts, ends = S.words_of(data, offsets, lower=False)
        inside = S.NOT_SPACE[data]

        def total(flags, offsets=offsets):
            sums = np.zeros(len(flags) + 1, np.int64)
            np.cumsum(flags, out=sums[1:])
            return sums[offsets[1:]] - sums[offsets[:-1]]

        lines, doubled = repeated_lines(data, offsets, inside)
        letters = np.zeros(len(data) + 1, np.int64)
        np.cumsum(LETTER[data] | BEYOND[data], out=letters[1:])
        alpha = np.bincount(rows[letters[ends] - letters[starts] == ends - starts], minlength=n)
        cells = {
            "n_words": np.bincount(rows, minlength=n), "word_chars": total(inside & START[data]), "n_symbols": total(SYMBOL[data]), "n_dup_lines": doubled, "n_repeat_words": repeated_words(words, rows, n),
            "n_lines": lines, "n_letters": total(LETTER[data]), "n_upper": total(UPPER[data]), "n_marks": total(MARK[data]), "n_digits": total(DIGIT[data]), "n_alpha_words": alpha,
        }
        out.append(np.stack([cells[c] for c in COUNTS], axis=1))
    return np.concatenate(out)


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, *COUNTS) of every whole text."""

    def count(batches):
        for batch in batches:
            got = counted(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(got[:, k].astype(np.int64)) for k in range(len(COUNTS))]], ["doc_id", *COUNTS])

    S.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def shares(counts: dict[str, np.ndarray]) -> np.ndarray:
    """FEATURES of rows of counts, as rows x features."""
    return np.stack([counts[a] / np.maximum(counts[b], 1) for a, b in FEATURES.values()], axis=1).astype(np.float64)


def mean_path(n: np.ndarray) -> np.ndarray:
    """The mean path of an unsuccessful search among n rows: what a leaf of n rows stands for."""
    n = np.asarray(n, np.float64)
    big = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: the feature that a node splits (-1 at a leaf), its value, its left child (the right one is next), the path length of a leaf; root and rows of each tree."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    tree_rows: np.ndarray

    def reached(self, root: int, x: np.ndarray) -> np.ndarray:
        """The node without a split that each row ends in."""
        at = np.full(len(x), root)
        while (open_ := np.flatnonzero(self.feature[at] >= 0)).size:
            node = at[open_]
            at[open_] = self.left[node] + (x[open_, self.feature[node]] >= self.value[node])
        return at

    def scores(self, x: np.ndarray, half: np.ndarray | None = None) -> np.ndarray:
        """Anomaly scores in (0, 1): 2 to the power of -(the mean over trees of path / mean path of the tree's rows); rows of a half by the trees of the other one."""
        total, used = np.zeros(len(x)), np.zeros(len(x))
        for k, (root, scale) in enumerate(zip(self.roots, np.maximum(mean_path(self.tree_rows), 1e-9), strict=True)):
            rows = np.arange(len(x)) if half is None else np.flatnonzero(half != k % 2)
            total[rows] += self.path[self.reached(root, x[rows])] / scale
            used[rows] += 1
        return 2.0 ** -(total / np.maximum(used, 1))


class Ranges:
    """Rows, least and greatest value of every feature in the nodes from ``first`` on; added up over batches of rows."""

    def __init__(self, forest: Forest, first: int, features: int) -> None:
        size = len(forest.feature) - first
        self.forest, self.first = forest, first
        self.n, self.low, self.high = np.zeros(size, np.int64), np.full((size, features), np.inf), np.full((size, features), -np.inf)

    def add(self, root: int, x: np.ndarray) -> None:
        at = self.forest.reached(root, x)
        order = np.argsort(at, kind="stable")
        order = order[np.searchsorted(at[order], self.first) :]
        if not len(order):
            return
        nodes, starts, n = np.unique(at[order], return_index=True, return_counts=True)
        k, rows = nodes - self.first, x[order]
        self.n[k] += n
        self.low[k] = np.minimum(self.low[k], np.minimum.reduceat(rows, starts))
        self.high[k] = np.maximum(self.high[k], np.maximum.reduceat(rows, starts))


def grow_levels(ranges, trees: int, depth: int, seed: int) -> Forest:
    """An isolation forest from ranges(forest, first), the (n, low, high) of its nodes from ``first`` on: every node splits a random feature between its least and greatest value at random."""
    rng = np.random.default_rng(seed)
    feature, value, left, path = np.full(trees, -1), np.zeros(trees), np.zeros(trees, np.int64), np.zeros(trees)
    first, size = 0, np.zeros(trees, np.int64)
    for level in range(depth + 1):
        n, low, high = ranges(Forest(feature, value, left, path, np.arange(trees), size), first)
        size = n if level == 0 else size
        path[first:] = level + mean_path(n)
        split = np.flatnonzero((n > 1) & (high > low).any(axis=1)) if level < depth else np.zeros(0, np.int64)
        if not len(split):
            break
        f = np.where(high[split] > low[split], rng.random((len(split), low.shape[1])), -1).argmax(axis=1)
        lo, hi = low[split, f], high[split, f]
        cut = np.maximum(lo + (hi - lo) * (1 - rng.random(len(split))), np.nextafter(lo, np.inf))  # above the least value, so that neither side is empty
        feature[first + split], value[first + split], path[first + split] = f, cut, 0.0
        left[first + split] = len(feature) + 2 * np.arange(len(split))
        first, more = len(feature), 2 * len(split)
        feature, value, left, path = (np.concatenate([cells, np.full(more, blank, cells.dtype)]) for cells, blank in ((feature, -1), (value, 0), (left, 0), (path, 0)))
    return Forest(feature, value, left, path, np.arange(trees), size)


def grow(x: np.ndarray, trees: int, tree_rows: int, seed: int) -> Forest:
    """An isolation forest on rows x features in memory, each tree on tree_rows random rows, to the depth log2(tree_rows)."""
    rng = np.random.default_rng(seed)
    size = min(tree_rows, len(x))
    held = [rng.choice(len(x), size, replace=False) for _ in range(trees)]

    def ranges(forest, first):
        got = Ranges(forest, first, x.shape[1])
        for root in forest.roots:
            got.add(root, x[held[root]])
        return got.n, got.low, got.high

    return grow_levels(ranges, trees, int(np.ceil(np.log2(max(size, 2)))), seed)


def moved(x: np.ndarray, keys: np.ndarray, share: float = 0.1, by: float = 0.3) -> np.ndarray:
    """x and a copy with some cells moved, by the rows' keys: a statistic that is the same in all rows would never be split, and no value of it stand out."""
    cells = (keys.astype(S.U64)[:, None] + np.arange(1, 2 * x.shape[1] + 1, dtype=S.U64) * S.U64(S.MULTIPLIER)).reshape(-1)
    drawn = (S.mix(cells) >> S.U64(11)).astype(np.float64).reshape(len(x), -1) / 2.0**53
    chosen, way = drawn[:, : x.shape[1]], drawn[:, x.shape[1] :]
    return np.concatenate([x, x + by * (2 * way - 1) * (chosen < share)])


def count_ranges(rows: DataFrame, forest: Forest, first: int, at_once: int = 8000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, low, high) of the nodes from ``first`` on, over all rows (_key, _half, *COUNTS) and their moved copies, each in the trees of its half (of both, if -1): one pass, of which the driver sees a row per node."""
    spark, width = rows.sparkSession, len(FEATURES)
    shared = spark.sparkContext.broadcast(forest)

    def reach(batches):
        got = Ranges(shared.value, first, width)
        held, n = [], 0

        def add():
            table = pa.Table.from_batches(held)
            x = moved(shares({c: table.column(c).to_numpy() for c in COUNTS}), table.column("_key").to_numpy())
            half = np.tile(table.column("_half").to_numpy(), 2)
            for k, root in enumerate(got.forest.roots):
                got.add(root, x[(half == k % 2) | (half < 0)])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= at_once:
                add()
                held, n = [], 0
        if n:
            add()
        k = np.flatnonzero(got.n)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(got.n[k]), *[pa.array(np.ascontiguousarray(got.low[k, f])) for f in range(width)], *[pa.array(np.ascontiguousarray(got.high[k, f])) for f in range(width)]], names)

    lows, highs = [f"low{f}" for f in range(width)], [f"high{f}" for f in range(width)]
    names = ["node", "n", *lows, *highs]
    told = rows.mapInArrow(reach, "node long, n long, " + ", ".join(f"{c} double" for c in (*lows, *highs)))
    table = told.groupBy("node").agg(F.sum("n").alias("n"), *[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs]).toArrow()
    k, cells = table.column("node").to_numpy(), {c: table.column(c).to_numpy() for c in names[1:]}
    size = len(forest.feature) - first
    n, low, high = np.zeros(size, np.int64), np.zeros((size, width)), np.zeros((size, width))
    n[k], low[k], high[k] = cells["n"], np.stack([cells[c] for c in lows], axis=1), np.stack([cells[c] for c in highs], axis=1)
    return n, low, high


def with_scores(rows: DataFrame, forest: Forest) -> DataFrame:
    """rows, which hold COUNTS, with the anomaly score; where they tell a half, by the trees of the other one."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def score(batches):
        for batch in batches:
            x = shares({c: batch.column(c).to_numpy() for c in COUNTS})
            half = batch.column("_half").to_numpy() if "_half" in batch.schema.names else None
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(x, half))], [*batch.schema.names, "score"])

    return rows.mapInArrow(score, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", score double")


def at_rank(rows: DataFrame, column: str, rank: int, steps: int = 1024, most: int = 10_000) -> float:
    """The exact value at a place of the ascending order, from 0: brackets of equal width are counted until the one that holds it has at most ``most`` rows."""
    x = F.col(column)
    low, high, n = rows.agg(F.min(x), F.max(x), F.count(x)).first()
    while low < high and n > most:
        cell = F.least(F.floor((x - low) / (high - low) * steps), F.lit(steps - 1))
        cells = rows.where(x.between(low, high)).groupBy(cell.alias("k")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).orderBy("k").collect()
        for c in cells:
            if rank < c["n"]:
                low, high, n = c["low"], c["high"], c["n"]
                break
            rank -= c["n"]
    return low if low == high else sorted(r[0] for r in rows.where(x.between(low, high)).select(x).collect())[rank]


def fit_forest(stats: DataFrame, labels: DataFrame, label: str = "quality", trees: int = 100, depth: int = 8, max_loss: float = 0.005, seed: int = 1) -> tuple[Forest, float] | None:
    """(forest, threshold) from all labelled good documents that pass the rules; None without any."""
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).where("y is not null and doc_id is not null").groupBy("doc_id").agg(F.min("y").alias("y")).where("y = 1")
    key = F.xxhash64("doc_id", F.lit(seed))
    rows = S.written(stats.where(~failed_rules()).join(good, "doc_id").select(key.alias("_key"), F.pmod(key, F.lit(2)).cast("int").alias("_half"), *COUNTS), "good-statistics")
    n, odd = rows.agg(F.count("*"), F.sum("_half")).first()
    if not n:
        return None
    if odd in (0, n):  # nobody in the other half
        rows = rows.withColumn("_half", F.lit(-1))
    forest = grow_levels(lambda forest, first: count_ranges(rows, forest, first), trees, depth, seed)
    scored = S.written(with_scores(rows, forest).select("score"), "good-scores")
    return forest, at_rank(scored, "score", n - 1 - int(max_loss * n))


def failed_rules():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge_quality(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """(doc_id, counts, base_failed, score, kept) of every row of docs: kept if it fails no rule and its anomaly score is at most the threshold."""
    stats = S.written(text_statistics(docs), "text-statistics")
    fitted = fit_forest(stats, labels, **fit)
    base = stats.withColumn("base_failed", failed_rules())
    if fitted is None:
        return base.withColumn("score", F.lit(0.0)).withColumn("kept", ~F.col("base_failed"))
    forest, threshold = fitted
    return with_scores(base, forest).withColumn("kept", ~F.col("base_failed") & (F.col("score") <= threshold))
