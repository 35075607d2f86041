"""Audit of how far the sources of a language diverge in their terms, and in which.

The terms of a language are found by iceberg refinement: prefixes of a few bytes are
counted first, by distinct documents; a prefix below the threshold is discarded with
every term that begins with it, the others are extended to twice their length, until
complete terms remain. Kept prefixes travel as a bit map of fixed size: where two
share a bit a prefix too many is extended, never one too few, and complete terms are
counted by their own bytes.

Probabilities are whole billionths with one added to every count, so all arithmetic
is exact. Sums over all kept terms of two sources come from three parts: terms that
both hold, terms that one holds (by their counts' frequencies) and terms that neither
holds, so no table of all terms by all sources is made.

Edge cases: null text, lang and source count as empty. Every row is a document, so
repeated rows count as often as they stand. A group without a term is a group (all its
counts are 0); a language without a kept term has values of 0 and no term rows. Terms
are bytes, only A-Z are lower-cased. Ties are ranked by the item's bytes. Columns
other than the three are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm import shared as S

#: Billionths; counts below nine times as much keep their products in a long.
SCALE = 1_000_000_000
#: Bytes of the first prefixes; each level doubles them.
FIRST = 4
#: The map of kept prefixes has 2 ** MAP_BITS bits: two megabytes, whatever the size of the corpus.
MAP_BITS = 24
#: Terms of the lists that are put in order of their groups, added up, and hashed at a time.
BUFFER_TERMS, CHUNK_TERMS, PIECE_TERMS = 1_500_000, 300_000, 100_000
#: Letters A-Z, a-z and all bytes of characters beyond ASCII.
IN_TERM = np.zeros(256, bool)
IN_TERM[65:91] = IN_TERM[97:123] = IN_TERM[128:] = True

#: Terms that a bucket of the shuffle holds at most about; 2 ** LEAST_BITS buckets at least.
BUCKET_TERMS, LEAST_BITS = 1 << 20, 7

#: Terms, their sizes and counts (int) stand one after another in one value per row.
TERM_LISTS = "lang string, source string, held int, terms binary, sizes binary, counts binary"
#: What a task sends a bucket: complete terms (sizes, group and docs int, n long) and prefixes (long, docs int), packed as well.
PACKED = "bucket int, terms binary, sizes binary, group binary, docs binary, n binary, prefix binary, prefix_docs binary"
LEVEL = "lang string, term binary, held array<struct<source: string, n: bigint>>, n long, prefix long"
PACKED_NAMES = [f.split()[0] for f in PACKED.split(", ")]
LEVEL_NAMES = ["lang", "term", "held", "n", "prefix"]


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the pieces of data, one after another."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)], offsets


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of values from cut to cut."""
    return binaries(np.ascontiguousarray(values).view(np.uint8), cuts * values.itemsize)


def numbers(column, kind: type) -> np.ndarray:
    """The values of all packed rows of a column."""
    data, offsets = S.flat(column)
    return data[offsets[0] : offsets[-1]].view(kind)


def term_lists(docs: DataFrame) -> DataFrame:
    """(lang, source, held, terms, sizes, counts) of every row: its distinct terms, packed, and how often each stands there."""

    def lists(batches):
        for batch in batches:
            for lo, hi, data, offsets in S.text_chunks(batch.column("text")):
                hashes, rows, starts, ends = S.words_of(data, offsets, IN_TERM)
                order = np.lexsort((hashes, rows))
                hashes, rows, starts, ends = hashes[order], rows[order], starts[order], ends[order]
                first = np.ones(len(order), bool)
                first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
                at = np.flatnonzero(first)
                counts = np.diff(np.append(at, len(order)))
                terms, offsets = gathered(S.LOWER[data], starts[at], ends[at] - starts[at])
                cuts = np.searchsorted(rows[at], np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").slice(lo, hi - lo), batch.column("source").slice(lo, hi - lo), pa.array(np.diff(cuts).astype(np.int32)), binaries(terms, offsets[cuts]), blobs(np.diff(offsets).astype(np.int32), cuts), blobs(counts.astype(np.int32), cuts)],
                    ["lang", "source", "held", "terms", "sizes", "counts"],
                )

    S.small_batches(docs.sparkSession)
    cells = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*cells).mapInArrow(lists, TERM_LISTS)


def unpacked(batches):
    """Batches (lang, source, terms, counts) with lists of terms and of counts."""
    for batch in batches:
        sizes = numbers(batch.column("sizes"), np.int32)
        ends, cuts = np.zeros(len(sizes) + 1, np.int64), np.zeros(len(batch) + 1, np.int32)
        np.cumsum(sizes, out=ends[1:])
        np.cumsum(batch.column("held").to_numpy(), out=cuts[1:])
        lists = [pa.ListArray.from_arrays(pa.array(cuts), x) for x in (binaries(numbers(batch.column("terms"), np.uint8), ends), pa.array(numbers(batch.column("counts"), np.int32)))]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("source"), *lists], ["lang", "source", "terms", "counts"])


def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(a row of each distinct key, sums of the values by key)."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    at = np.flatnonzero(new)
    return order[at], [np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values]


def list_cuts(batch) -> np.ndarray:
    cuts = np.zeros(len(batch) + 1, np.int64)
    np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False), out=cuts[1:])
    return cuts


def chunks_of_lists(batches):
    """Lists in chunks of about CHUNK_TERMS terms, or a longer row alone.

    Rows are buffered up to BUFFER_TERMS terms and put in order of language and source
    first, so that a chunk holds few groups and its terms add up well.
    """

    def ordered(held):
        table = pa.Table.from_batches(held)
        codes = [table.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in ("source", "lang")]
        batch = table.take(np.lexsort(codes)).combine_chunks().to_batches()[0]
        for lo, hi in S.chunks(list_cuts(batch), CHUNK_TERMS):
            yield batch.slice(lo, hi - lo)

    held, size = [], 0
    for batch in batches:
        cuts = list_cuts(batch)
        for lo, hi in S.chunks(cuts, BUFFER_TERMS):
            more = int(cuts[hi] - cuts[lo])
            if held and size + more > BUFFER_TERMS:
                yield from ordered(held)
                held, size = [], 0
            held.append(batch.slice(lo, hi - lo))
            size += more
    if size:
        yield from ordered(held)


def beginnings(data: np.ndarray, ends: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the first ``sizes`` bytes of the given terms (ascending); terms are hashed piece by piece, which bounds the memory."""
    out = np.empty(len(rows), S.U64)
    for lo in range(0, len(rows), PIECE_TERMS):
        mine, n = rows[lo : lo + PIECE_TERMS], sizes[lo : lo + PIECE_TERMS]
        base = ends[mine[0]]
        starts = ends[mine] - base
        out[lo : lo + PIECE_TERMS] = S.span_hash(S.prefix_sums(data[base : ends[mine[-1] + 1]]), starts, starts + n)
    return out


def group_names(lists: DataFrame) -> list[tuple[str, str]]:
    """(lang, source) of all groups in order of their bytes: as many as there are groups, of which the result has the square."""
    got = lists.select("lang", "source").distinct().toArrow()
    return sorted(zip(got.column("lang").to_pylist(), got.column("source").to_pylist(), strict=True), key=lambda g: (g[0].encode(), g[1].encode()))


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def added(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, at) if len(at) else values[:0]


def sent(lists: DataFrame, length: int, before: int, shared, bits: int) -> DataFrame:
    """What tasks send the 2 ** ``bits`` buckets of hashes: at most one row (PACKED) a bucket and chunk of lists, already added up by term and group."""
    to_bucket = S.U64(64 - bits)

    def level(batches):
        kept, groups = shared.value
        place = {g: k for k, g in enumerate(groups)}
        for batch in chunks_of_lists(unpacked(batches)):
            column = batch.column("terms")
            data, ends = S.flat(column.flatten())
            data, ends = data[ends[0] : ends[-1]], ends - ends[0]
            sizes = np.diff(ends)
            doc = np.repeat(np.arange(len(batch)), column.value_lengths().to_numpy(zero_copy_only=False))
            counts = batch.column("counts").flatten().to_numpy(zero_copy_only=False)
            langs, sources = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
            lang, source = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (langs, sources))
            pairs, which = np.unique(lang * len(sources.dictionary) + source, return_inverse=True)
            a, b = langs.dictionary.to_pylist(), sources.dictionary.to_pylist()
            group = np.array([place[a[k // len(b)], b[k % len(b)]] for k in pairs.tolist()], np.int32)[which]
            names, offsets = S.flat(langs.dictionary)
            salt = S.span_hash(S.prefix_sums(names), offsets[:-1] - offsets[0], offsets[1:] - offsets[0])
            # a language's prefixes have bits of their own
            of = lambda rows, n: S.mix(beginnings(data, ends, rows, n) + salt[lang[doc[rows]]])
            rows = np.flatnonzero(sizes > before)
            if kept is not None:
                bit = (of(rows, np.full(len(rows), before)) >> S.U64(64 - MAP_BITS)).astype(np.int64)
                rows = rows[(kept[bit >> 6] >> (bit & 63).astype(S.U64)) & S.U64(1) == 1]
            closed, open_ = rows[sizes[rows] <= length], rows[sizes[rows] > length]
            hashes = of(closed, sizes[closed])
            # in order of buckets, then of terms with their groups
            keys = (hashes >> to_bucket << to_bucket) | (S.mix(hashes + group[doc[closed]].astype(S.U64) * S.U64(S.MULTIPLIER)) >> S.U64(bits))
            order = np.argsort(keys)
            keys = keys[order]
            at = runs(keys)
            mine, docs, n = closed[order[at]], np.diff(np.append(at, len(order))), added(counts[closed[order]].astype(np.int64), at)
            terms, offsets = gathered(data, ends[mine], sizes[mine])
            prefixes = of(open_, np.full(len(open_), length))
            order = np.argsort(prefixes, kind="stable")  # documents stay in order, so that each counts once
            prefixes, owner = prefixes[order], doc[open_[order]]
            first = np.ones(len(order), bool)
            first[1:] = (prefixes[1:] != prefixes[:-1]) | (owner[1:] != owner[:-1])
            prefixes = prefixes[first]
            start = runs(prefixes)
            prefix_docs, prefixes = np.diff(np.append(start, len(prefixes))), prefixes[start]
            of_term, of_prefix = (np.searchsorted((h >> to_bucket).astype(np.int64), np.arange(2**bits + 1)) for h in (keys[at], prefixes))
            out = [pa.array(np.arange(2**bits, dtype=np.int32)), binaries(terms, offsets[of_term]), *(blobs(x, of_term) for x in (sizes[mine].astype(np.int32), group[doc[mine]], docs.astype(np.int32), n)), blobs(prefixes.view(np.int64), of_prefix), blobs(prefix_docs.astype(np.int32), of_prefix)]
            yield pa.RecordBatch.from_arrays(out, PACKED_NAMES).filter(pa.array((np.diff(of_term) > 0) | (np.diff(of_prefix) > 0)))

    return lists.mapInArrow(level, PACKED)


def refine(lists: DataFrame, length: int, before: int, kept: np.ndarray | None, least: int, groups: list[tuple[str, str]] | None = None, bits: int = LEAST_BITS) -> DataFrame:
    """One level: (lang, term, held array of (source, n), n, prefix) of terms that end within ``length`` bytes and of the prefixes of longer ones, which at least ``least`` documents have.

    Only terms of more than ``before`` bytes whose prefix of that length has its bit
    in the map are looked at. Buckets add up what tasks have sent by the terms'
    bytes. A prefix is a hash with its distinct documents.
    """
    groups = group_names(lists) if groups is None else groups
    shared = lists.sparkSession.sparkContext.broadcast((kept, groups))

    def bucket(table):
        groups = shared.value[1]
        langs = sorted({g[0] for g in groups}, key=str.encode)
        rank = {lang: k for k, lang in enumerate(langs)}
        lang_of = np.array([rank[g[0]] for g in groups], np.int64)
        prefixes = numbers(table.column("prefix"), np.int64)
        order = np.argsort(prefixes)
        at = runs(prefixes[order])
        docs = added(numbers(table.column("prefix_docs"), np.int32).astype(np.int64)[order], at)
        prefixes = prefixes[order[at[docs >= least]]]
        sizes, group = numbers(table.column("sizes"), np.int32), numbers(table.column("group"), np.int32)
        ends = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        terms = binaries(numbers(table.column("terms"), np.uint8), ends).dictionary_encode()
        keys = terms.indices.to_numpy().astype(np.int64) * len(groups) + group
        order = np.argsort(keys)
        at = runs(keys[order])
        docs, n = (added(numbers(table.column(c), t).astype(np.int64)[order], at) for c, t in (("docs", np.int32), ("n", np.int64)))
        term, group = np.divmod(keys[order[at]], max(len(groups), 1))
        # groups of a language stand next to each other, sources in order
        start = runs(term * len(langs) + lang_of[group])
        sizes = np.diff(np.append(start, len(term)))
        enough = added(docs, start) >= least
        cells = np.repeat(enough, sizes)
        total, term, lang, sizes = added(n, start)[enough], term[start[enough]], lang_of[group[start[enough]]], sizes[enough]
        own = pa.DictionaryArray.from_arrays(pa.array(group[cells].astype(np.int32)), pa.array([g[1] for g in groups], pa.string())).cast(pa.string())
        held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.StructArray.from_arrays([own, pa.array(n[cells])], ["source", "n"]))
        names = pa.DictionaryArray.from_arrays(pa.array(lang.astype(np.int32)), pa.array(langs, pa.string())).cast(pa.string())
        parts = [pa.table([names, terms.dictionary.take(pa.array(term)), held, pa.array(total), pa.nulls(len(term), pa.int64())], LEVEL_NAMES)]
        none = [pa.nulls(len(prefixes), parts[0].schema.field(k).type) for k in range(4)]
        return pa.concat_tables([*parts, pa.table([*none, pa.array(prefixes)], LEVEL_NAMES)])

    S.small_batches(lists.sparkSession)
    return sent(lists, length, before, shared, bits).groupBy("bucket").applyInArrow(bucket, LEVEL)


def bit_map(prefixes: DataFrame) -> np.ndarray | None:
    """The bits of prefixes (their hashes' upper bits), in a fixed number of words; None if there is no prefix."""
    bit = F.shiftrightunsigned("prefix", 64 - MAP_BITS)
    word = F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))")
    words = prefixes.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("k")).agg(word.alias("word")).toArrow()
    if not words.num_rows:
        return None
    out = np.zeros(2**MAP_BITS // 64, S.U64)
    out[words.column("k").to_numpy()] = words.column("word").to_numpy().view(S.U64)
    return out


def kept_terms(docs: DataFrame, least: int = 3) -> DataFrame:
    """(lang, term binary, held, n): terms that stand in at least ``least`` documents of their language; held lists (source, n), n occurrences there."""
    lists = S.written(term_lists(docs), "term-lists")
    groups, size = group_names(lists), lists.agg(F.sum("held")).first()[0] or 0
    bits = max(LEAST_BITS, (size // BUCKET_TERMS).bit_length())
    found, before, kept = None, 0, None
    while True:
        length = 2 * before or FIRST
        level = S.written(refine(lists, length, before, kept, least, groups, bits), "term-level")
        terms = level.where("term is not null").drop("prefix")
        found = terms if found is None else found.unionByName(terms)
        kept = bit_map(level.where("prefix is not null"))
        if kept is None:
            return found
        before = length


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)) as an exact long; 1 where there is no term."""
    wide = lambda c: c.cast("decimal(20,0)")
    divide = lambda a, b: F.call_function("div", a, b)
    below = F.greatest(total + terms, F.lit(1))
    whole = F.when(count < 9 * SCALE, divide(F.lit(SCALE) * (count + 1), below)).otherwise(divide(F.lit(SCALE).cast("decimal(10,0)") * wide(count + 1), wide(below)))
    return F.when(terms > 0, whole + 1).otherwise(F.lit(1)).cast("long")


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), exact in a long: p and q are at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def source_groups(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, v, held, total, p0, lang_total) of every group that occurs."""
    both = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in ("lang", "source")]
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    own = terms.select("lang", F.explode("held").alias("x")).groupBy("lang", "x.source").agg(F.count("*").alias("held"), F.sum("x.n").alias("total"))
    groups = docs.select(*both).distinct().join(langs, "lang", "left").join(own, ["lang", "source"], "left").fillna(0, ["v", "lang_total", "held", "total"])
    return S.written(groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("v"))), "source-groups")


def met_values(profiles: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) partial sums over the terms that two sources both hold of what ``pair_values`` lacks for them.

    profiles: lang, held, k. Every two entries of a profile are worked out in numpy, at
    most about PIECE_TERMS at a time. The groups' totals go to all tasks: as many
    rows as there are groups, of which the result has the square.
    """
    facts = groups.select("lang", "source", "v", "total", "p0").toArrow()
    place = {key: k for k, key in enumerate(zip(facts.column("lang").to_pylist(), facts.column("source").to_pylist(), strict=True))}
    shared = groups.sparkSession.sparkContext.broadcast((list(place), place, *(facts.column(c).to_numpy() for c in ("v", "total", "p0"))))

    def work(batches):
        names, place, v, total, base = shared.value
        for batch in batches:
            held, k = batch.column("held"), batch.column("k").to_numpy()
            sizes = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            entries = held.flatten()
            langs, sources = batch.column("lang").to_pylist(), entries.field("source").to_pylist()
            row = np.repeat(np.arange(len(sizes)), sizes)
            group = np.array([place[langs[r], s] for r, s in zip(row, sources, strict=True)], np.int64)
            n = entries.field("n").to_numpy(zero_copy_only=False)
            exact = (lambda x: x) if n.max(initial=0) < 9 * SCALE else (lambda x: x.astype(object))
            p = (1 + SCALE * (exact(n) + 1) // (total[group] + v[group])).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for lo, hi in S.chunks(np.concatenate([[0], np.cumsum(sizes * sizes)]), PIECE_TERMS):
                mine = np.arange(starts[lo], starts[hi])
                times = sizes[row[mine]]
                a = np.repeat(mine, times)
                b = np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times) + starts[row[a]]
                a, b = a[a != b], b[a != b]
                f = lambda x, y: (x - y) * (x - y) // y
                p0, q0 = base[group[a]], base[group[b]]
                value = k[row[a]] * (f(p[a], p[b]) - f(p[a], q0) - f(p0, p[b]) + f(p0, q0))
                at, (value,) = summed([group[b], group[a]], [value])
                mine, other = group[a][at], group[b][at]
                yield pa.RecordBatch.from_arrays([pa.array([names[g][0] for g in mine], pa.string()), pa.array([names[g][1] for g in mine], pa.string()), pa.array([names[g][1] for g in other], pa.string()), pa.array(value, pa.int64())], ["lang", "source", "item", "value"])

    return profiles.mapInArrow(work, "lang string, source string, item string, value long")


def pair_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): sums over all kept terms of a language for each two of its sources."""
    big = lambda c: F.sum(c.cast("decimal(38,0)")).alias("value")
    ours = groups.select("lang", "source", F.col("held").alias("own"), "v", "total", "p0")
    theirs = groups.select("lang", F.col("source").alias("item"), F.col("held").alias("item_own"), F.col("p0").alias("q0"))
    two = ours.join(theirs, "lang").where("source <> item")
    rest = two.select("lang", "source", "item", ((F.col("v") - F.col("own") - F.col("item_own")) * excess(F.col("p0"), F.col("q0"))).cast("decimal(38,0)").alias("value"))
    often = terms.select("lang", F.explode("held").alias("x")).groupBy("lang", "x.source", "x.n").agg(F.count("*").alias("k"))
    often = S.written(often.join(ours, ["lang", "source"]).select("lang", "source", "k", "p0", share(F.col("n"), F.col("total"), F.col("v")).alias("p")), "term-frequencies")
    one = often.join(theirs, "lang").where("source <> item").groupBy("lang", "source", "item").agg(big(F.col("k") * excess(F.col("p"), F.col("q0"))))
    other = often.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "k").join(ours, "lang").where("source <> item")
    other = other.groupBy("lang", "source", "item").agg(big(F.col("k") * excess(F.col("p0"), F.col("q"))))
    # terms that the same sources hold as often are taken together; held has an entry for each source of the language at most
    profiles = terms.where(F.size("held") > 1).groupBy("lang", "held").agg(F.count("*").alias("k"))
    shared = met_values(profiles, groups).groupBy("lang", "source", "item").agg(big(F.col("value")))
    parts = rest.unionByName(one).unionByName(other).unionByName(shared)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def source_divergence(docs: DataFrame, least: int = 3, most: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources of the language by divergence (``pair``), and the ``most`` terms that stand out (``term``)."""
    terms = kept_terms(docs, least)
    groups = source_groups(docs, terms)
    cells = terms.select("lang", "term", F.col("n").alias("lang_n"), F.explode("held").alias("x")).select("lang", "term", "lang_n", "x.*")
    told = cells.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v"))).withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("v"))).where("p > q")
    found = {"pair": pair_values(terms, groups), "term": told.select("lang", "source", F.col("term").cast("string").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))}
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = {part: rows.withColumn("rank", F.row_number().over(order)) for part, rows in found.items()}
    out = ranked["pair"].unionByName(ranked["term"].where(F.col("rank") <= most).withColumn("part", F.lit("term")), allowMissingColumns=True)
    return out.select("lang", "source", F.coalesce("part", F.lit("pair")).alias("part"), "item", "value", "rank")
