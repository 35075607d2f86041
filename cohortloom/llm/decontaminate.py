"""Benchmark decontamination: BM25 inverted index of test items, block-max WAND, overlap check.

Every text is cut into overlapping passages of at least twice the longest item,
so that each place of an item lies whole in one of them; every passage is a
query. Impacts are BM25 weights divided by the item's score for its own text, so
scores run from 0 to 1 and one threshold serves all items. Item count, document
frequencies, mean and longest length are those of all items.

Postings are kept by term, item and block of items, with the largest impact of
each term in each block. Two steps find all items above the threshold. First the
heaviest terms of each item, those that leave a known rest, are added up per
passage and block from block-max impacts; a passage passes over the blocks that
cannot reach the threshold with that rest, which is nearly all of them. Then
the cursors of the passage's terms move through the postings of a block by
pivoting: sorted by their item, their block-max impacts are added up to the
first that reaches the threshold; items before that pivot are skipped, the pivot
is scored if all cursors before it stand on it. Items above the threshold are
verified: word trigrams of question and answer must both occur in the passage.

Words are runs of ASCII letters and digits or non-ASCII bytes, A-Z lower-cased.
The answer is an item's last line, or without several lines its last quarter.

Items are dealt into shards of at most about ``shard_items``, whose indexes are
built in tasks. One shard's index at a time is held by the driver and broadcast,
so its size is bounded; the result does not depend on the number of shards.

Edges: null and empty texts and items match nothing; items with a null id take
no part; several texts of one item_id are one answer; repeated document rows and
rows with a null doc_id are judged each; extra columns are kept; empty tables
give no row or no match.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import shared as S

U64 = np.uint64
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
FILTER_BITS = 20


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return S.words_of(data, np.array([0, len(data)]), _WORD)[0]


def split_item(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Words of question and answer."""
    lines = [x for x in (word_hashes(line) for line in text.split("\n")) if len(x)]
    if len(lines) > 1:
        return np.concatenate(lines[:-1]), lines[-1]
    words = lines[0] if lines else np.zeros(0, U64)
    cut = len(words) - max(1, len(words) // 4) if len(words) > 1 else len(words)
    return words[:cut], words[cut:]


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    n = max(1, min(n, len(words)))
    return np.unique(S.ngram_hash(words, np.zeros(len(words), np.int64), n)[0]) if len(words) else words


def item_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    question, answer = split_item(text)
    return question, answer, np.concatenate([question, answer])


class Index:
    """Inverted index of items in blocks.

    stats: (item count, mean length, longest length, sorted terms, their document
    frequencies) of all items; those of the given items if left out.
    """

    def __init__(self, items, threshold: float, stats=None, block: int = 8, k1: float = 1.2, b: float = 0.75, gram: int = 3):
        self.threshold, self.block, self.gram = threshold, block, gram
        parts = [(i, *item_words(t)) for i, t in items]
        parts = [x for x in parts if len(x[3])]
        parts.sort(key=lambda x: (len(x[3]), x[0], x[3].tobytes()))
        self.ids = [x[0] for x in parts]
        self.words = [x[3] for x in parts]
        self.question = [_grams(x[1], gram) for x in parts]
        self.answer = [_grams(x[2], gram) for x in parts]
        # A part shorter than a trigram is one gram of its own length.
        self.sizes = [(min(gram, len(x[1])), min(gram, len(x[2]))) for x in parts]
        terms = [np.unique(w, return_counts=True) for w in self.words]
        if stats is None:
            held, df = np.unique(np.concatenate([t for t, _ in terms]), return_counts=True) if terms else (np.zeros(0, U64), np.zeros(0))
            stats = (len(parts), np.mean([len(w) for w in self.words]) if parts else 1.0, max(map(len, self.words), default=0), held, df)
        count, mean, self.longest, all_terms, df = stats
        self.vocabulary = np.unique(np.concatenate([t for t, _ in terms])) if terms else np.zeros(0, U64)
        df = df[np.searchsorted(all_terms, self.vocabulary)]
        idf = np.log(1 + (count - df + 0.5) / (df + 0.5))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.vocabulary >> U64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.terms, self.impacts = [], []
        self.rest = np.zeros(-(-len(parts) // block))
        heavy = []
        for at, ((t, tf), w) in enumerate(zip(terms, self.words, strict=True)):
            ids = np.searchsorted(self.vocabulary, t)
            x = idf[ids] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / mean))
            x = x / x.sum()
            self.terms.append(ids)
            self.impacts.append(x)
            order = np.lexsort((ids, -x))
            essential = np.zeros(len(x), bool)
            essential[order[: int(np.searchsorted(np.cumsum(x[order]), (1 + threshold) / 2)) + 1]] = True
            heavy.append(essential)
            self.rest[at // block] = max(self.rest[at // block], 1 - x[essential].sum())
        none = np.zeros(0)
        item = np.repeat(np.arange(len(parts)), [len(t) for t in self.terms]).astype(np.int64)
        term = np.concatenate([*self.terms, none]).astype(np.int64)
        impact, heavy = np.concatenate([*self.impacts, none]), np.concatenate([*heavy, none]).astype(bool)
        order = np.lexsort((item, term))
        item, term, self.posting_impact, heavy = item[order], term[order], impact[order], heavy[order]
        self.posting_item = item
        # Postings of a term in a block follow each other: one range and one largest impact for each.
        self.ranges, self.range_first = np.unique(term * len(self.rest) + item // block, return_index=True) if len(term) else (none.astype(np.int64), none.astype(np.int64))
        self.range_max = np.maximum.reduceat(self.posting_impact, self.range_first) if len(term) else none
        self.range_end = np.append(self.range_first[1:], len(term))
        # The same of the essential postings only.
        key, first = np.unique((term * len(self.rest) + item // block)[heavy], return_index=True) if heavy.any() else (none.astype(np.int64), none.astype(np.int64))
        self.block_max = np.maximum.reduceat(self.posting_impact[heavy], first) if len(key) else none
        self.blocks = key % max(1, len(self.rest))
        self.first = np.searchsorted(key // max(1, len(self.rest)), np.arange(len(self.vocabulary) + 1))

    def found(self, words: np.ndarray, rows: np.ndarray, limit: int = 1 << 16) -> list[tuple[int, int, float]]:
        """(row, item, score) of the verified items in rows of words, about ``limit`` words at a time; long rows are cut where passages start."""
        if not len(words) or not len(self.vocabulary):
            return []
        half = max(128, 2 * self.longest) // 2
        starts = np.searchsorted(rows, np.arange(rows[-1] + 2))
        step, out = max(1, limit // half) * half, []
        for lo, hi in S.chunks(starts, limit):
            if starts[hi] - starts[lo] <= limit:
                out += self._found(words[starts[lo] : starts[hi]], rows[starts[lo] : starts[hi]])
                continue
            for at in range(starts[lo], starts[hi], step):
                piece = slice(at, min(at + step + half, starts[hi]))
                out += self._found(words[piece], rows[piece])
        return out

    def _found(self, words: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, float]]:
        if not len(words):
            return []
        span = max(128, 2 * self.longest)
        half = span // 2
        n_blocks = len(self.rest)
        starts = np.searchsorted(rows, np.arange(rows[-1] + 2))
        maybe = np.flatnonzero(self.filter[(words >> U64(64 - FILTER_BITS)).astype(np.int64)])
        term = np.searchsorted(self.vocabulary, words[maybe])
        term = np.minimum(term, len(self.vocabulary) - 1)
        hit = self.vocabulary[term] == words[maybe]
        where, term = maybe[hit], term[hit]
        useful = self.first[term + 1] > self.first[term]
        where, term = where[useful], term[useful]
        # A word of half h lies in the passages that start at halves h and h - 1 of its row.
        halves = (where - starts[rows[where]]) // half
        base = np.concatenate([[0], np.cumsum(np.diff(starts) // half + 1)])
        passage = base[rows[where]] + halves
        passage = np.concatenate([passage, passage[halves > 0] - 1])
        term = np.concatenate([term, term[halves > 0]])
        pairs = S.distinct_sorted(passage * len(self.vocabulary) + term)
        passage, term = pairs // len(self.vocabulary), pairs % len(self.vocabulary)
        count = self.first[term + 1] - self.first[term]
        posting = np.repeat(self.first[term], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        key, inverse = np.unique(np.repeat(passage, count) * n_blocks + self.blocks[posting], return_inverse=True)
        bound = np.bincount(inverse, self.block_max[posting], minlength=len(key)) + self.rest[key % n_blocks]
        out, last, have = [], -1, None
        for k in key[bound >= self.threshold - 1e-9]:
            p, blk = divmod(int(k), n_blocks)
            if p != last:
                last, row = p, int(np.searchsorted(base, p, "right")) - 1
                lo = starts[row] + (p - base[row]) * half
                mine = words[lo : min(lo + span, starts[row + 1])]
                have = np.unique(mine)
            for at in self.pivots(have, blk):
                score = self.score(have, at)
                if score >= self.threshold - 1e-9 and self.overlaps(mine, at):
                    out.append((row, at, score))
        return out

    def pivots(self, have: np.ndarray, blk: int):
        """Items of a block whose terms among have (sorted) reach the threshold, by pivoting over the terms' cursors."""
        place = np.minimum(np.searchsorted(self.vocabulary, have), len(self.vocabulary) - 1)
        wanted = place[self.vocabulary[place] == have] * len(self.rest) + blk
        at = np.minimum(np.searchsorted(self.ranges, wanted), len(self.ranges) - 1)
        at = at[self.ranges[at] == wanted]
        cursor, end, most = self.range_first[at].copy(), self.range_end[at], self.range_max[at]
        while True:
            live = cursor < end
            cursor, end, most = cursor[live], end[live], most[live]
            item = self.posting_item[cursor]
            order = np.argsort(item, kind="stable")
            reach = int(np.searchsorted(np.cumsum(most[order]), self.threshold - 1e-9))
            if reach == len(order):
                return
            pivot = item[order[reach]]
            if item[order[0]] == pivot:
                here = item == pivot
                if self.posting_impact[cursor[here]].sum() >= self.threshold - 1e-9:
                    yield int(pivot)
                cursor[here] += 1
            else:
                for k in np.flatnonzero(item < pivot):
                    cursor[k] += np.searchsorted(self.posting_item[cursor[k] : end[k]], pivot)

    def score(self, have: np.ndarray, at: int) -> float:
        return float(self.impacts[at][np.isin(self.vocabulary[self.terms[at]], have)].sum())

    def overlaps(self, words: np.ndarray, at: int, share: float = 0.6) -> bool:
        for grams, size in ((self.question[at], self.sizes[at][0]), (self.answer[at], self.sizes[at][1])):
            if len(grams) and np.isin(grams, _grams(words, size)).mean() < share:
                return False
        return True


def build_indexes(items: DataFrame, threshold: float, shard_items: int) -> DataFrame:
    """items (item_id, text) → (shard, index): pickled indexes of about shard_items items each, built in tasks with the statistics of all items."""

    def parse(batches):
        for batch in batches:
            words = [item_words(t)[2] for t in batch.column("text").to_pylist()]
            terms = [np.unique(w).view(np.int64) for w in words]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(w) for w in words], pa.int64()), pa.array(terms, pa.list_(pa.int64()))], [*batch.schema.names, "n", "terms"])

    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    parsed = S.written(items.mapInArrow(parse, "item_id long, text string, n long, terms array<long>").where("n > 0"), "items")
    count, mean, longest = parsed.agg(F.count("*"), F.avg("n"), F.max("n")).first()
    terms = parsed.select("item_id", "text", F.explode("terms").alias("term"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    # Every item carries the document frequencies of its terms to its shard.
    told = terms.join(df, "term").groupBy("item_id", "text").agg(F.collect_list(F.struct("term", "df")).alias("df"))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-count // shard_items)))).cast("int")

    def build(group: pa.Table) -> pa.Table:
        pairs = group.column("df").combine_chunks().flatten()
        held, first = np.unique(pairs.field("term").to_numpy().view(U64), return_index=True)
        stats = (count, mean, longest, held, pairs.field("df").to_numpy()[first])
        index = Index(list(zip(group.column("item_id").to_pylist(), group.column("text").to_pylist(), strict=True)), threshold, stats)
        return pa.table({"shard": group.column("shard")[:1], "index": pa.array([pickle.dumps(index)], pa.binary())})

    return S.written(told.withColumn("shard", shard).groupBy("shard").applyInArrow(build, "shard int, index binary"), "item-indexes")


def leak_hits(docs: DataFrame, items: DataFrame, threshold: float, shard_items: int) -> DataFrame:
    """docs (doc_id, text_key, text) → (doc_id, text_key, item_id, score): the verified items of each text."""
    spark = docs.sparkSession
    schema = "doc_id long, text_key long, item_id long, score double"
    indexes = build_indexes(items, threshold, shard_items)
    hits = spark.createDataFrame([], schema)
    for shard in [r["shard"] for r in indexes.select("shard").orderBy("shard").collect()]:
        given = spark.sparkContext.broadcast(bytes(indexes.where(F.col("shard") == shard).first()["index"]))

        def look(batches, given=given):
            index = pickle.loads(given.value)
            for batch in batches:
                rows_found, items_found, scores = [], [], []
                for lo, _, data, offsets in S.text_chunks(batch.column("text")):
                    words, rows, _, _ = S.words_of(data, offsets, _WORD)
                    for row, at, score in index.found(words, rows):
                        rows_found.append(lo + row)
                        items_found.append(index.ids[at])
                        scores.append(score)
                at = pa.array(rows_found, pa.int64())
                cols = [batch.column("doc_id").take(at), batch.column("text_key").take(at), pa.array(items_found, pa.int64()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "item_id", "score"])

        found = S.written(docs.select("doc_id", "text_key", "text").mapInArrow(look, schema), "leaks")
        given.destroy()
        hits = hits.union(found)
    return hits


def judge(docs: DataFrame, items: DataFrame, threshold: float = 0.7, shard_items: int = 20_000) -> DataFrame:
    """(doc_id, text_key, d, leak_ids, leak_score): d holds the document's columns, leak_ids the item_ids found, ascending, leak_score the best score."""
    S.small_batches(docs.sparkSession)
    docs = S.boxed(docs)
    hits = leak_hits(docs, items, threshold, shard_items).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("item_id")).alias("leak_ids"), F.max("score").alias("leak_score"))
    hits = hits.withColumnsRenamed({"doc_id": "hit_id", "text_key": "hit_key"})
    both = docs.drop("text").join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left")
    return both.select("doc_id", "text_key", "d", F.coalesce("leak_ids", F.array().cast("array<long>")).alias("leak_ids"), F.coalesce("leak_score", F.lit(0.0)).alias("leak_score"))


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, best_score): one row per document row."""
    out = judge(docs, items, threshold)
    n = F.size("leak_ids")
    return out.select("doc_id", (n > 0).alias("contaminated"), n.cast("long").alias("n_items"), F.col("leak_ids").alias("item_ids"), F.least("leak_score", F.lit(1.0)).alias("best_score"))


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents in which no item was found, columns unchanged."""
    return judge(docs, items, threshold).where(F.size("leak_ids") == 0).select("d.*")
