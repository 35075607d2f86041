"""Suffix-array dedup as a depth-limited radix sort of suffixes.

Every byte position of every text starts a suffix; suffixes are compared only
through their first ``length`` bytes, by most-significant-digit passes, and the
groups that are still equal after the last pass are exactly the repeated
windows. Passes:

1. Leading digit: the smallest-hashed ``digit``-byte window among a suffix's
   first ``length`` bytes, at its distance. Neighbouring suffixes share it, so a
   pass carries runs of suffixes instead of single ones (about one row for 30
   bytes). A batch of texts keeps one row of equal runs before the shuffle.
2. Context: all bytes that a run's suffixes read. Sorted by (digit, context,
   doc_id, start), all but the first of equal runs are repeats, and digits with
   one context are finished: singletons leave the sort.
3. Whole depth: the first runs of digits with several contexts are compared
   suffix by suffix over all ``length`` bytes. A digit with more than
   ``hot_runs`` of them is taken apart into suffixes, dealt and sorted by
   (digit, hash of ``length`` bytes, doc_id, start), so it spreads over all
   tasks; the result is the same.

Keys are pairs of 64-bit hashes of the bytes they stand for. The sorted stream
of a partition is read once with bounded state (pass 3: one key, or the window
hashes of one digit of at most ``hot_runs`` runs), so no group is collected. Long
texts are worked through in overlapping pieces.

Edges: null texts count as empty; texts shorter than ``length`` keep all bytes;
rows with a null doc_id take no part; rows that repeat doc_id and text are one
document; several texts of one doc_id are documents of their own, in the order
of their hashes (``part`` numbers them from 0); an empty table gives no row;
extra columns are ignored by the digest and kept by the cutter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm import shared as S

U64 = np.uint64
INDEX_BITS = 28


def suffix_runs(data: np.ndarray, offsets: np.ndarray, length: int, digit: int):
    """Runs of neighbouring suffixes that share their leading digit.

    A suffix's first digit is the smallest-hashed ``digit``-byte window among
    its first ``length`` bytes (the leftmost of equals), so equal suffixes have
    equal digits at equal distance. Returns arrays (digit hash, context hash,
    row, first start, last start, digit position): the context is everything
    that the run's suffixes read, bytes first .. last + length - 1.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(U64), none.astype(U64), none, none, none, none
    sums = S.prefix_sums(data)
    _, down = S.powers(len(sums))
    h = S.mix((sums[digit:] - sums[: n - digit + 1]) * down[: n - digit + 1])
    low = U64((1 << INDEX_BITS) - 1)
    packed = (h & ~low) | np.arange(len(h), dtype=U64)
    width, have = length - digit + 1, 1
    while have * 2 <= width:
        packed = np.minimum(packed[:-have], packed[have:])
        have *= 2
    if have < width:
        packed = np.minimum(packed[: len(packed) - (width - have)], packed[width - have :])
    at = (packed & low).astype(np.int64)
    # Starts of which the suffix's first `length` bytes lie in its own row.
    good = np.ones(len(at), bool)
    for end in offsets[1:-1]:
        good[max(0, end - length + 1) : end] = False
    edge = np.ones(len(at), bool)
    edge[1:] = (at[1:] != at[:-1]) | ~good[:-1]
    first = np.flatnonzero(good & edge)
    stop = np.ones(len(at), bool)
    stop[:-1] = edge[1:] | ~good[1:]
    last = np.flatnonzero(good & stop)
    place = at[first]
    context = (sums[last + length] - sums[first]) * down[first]
    context = S.mix(context + ((place - first).astype(U64) << U64(40)) + ((last - first).astype(U64) << U64(20)))
    return h[place], np.maximum(context, U64(1)), np.searchsorted(offsets, first, "right") - 1, first, last, place


RUN = "a long, c long, doc_id long, part int, lo int, last int"
SPAN = "kind int, a long, doc_id long, part int, lo int, last int"


def _batch(names, *columns):
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names.split())


def _first_in_batch(a, c, doc, part, lo, last, length):
    """Keeps the first of equal runs and turns the others into merged covered ranges (c = 0)."""
    order = np.lexsort((lo, part, doc, c, a))
    a, c, doc, part, lo, last = a[order], c[order], doc[order], part[order], lo[order], last[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    later = (doc != doc[head]) | (part != part[head]) | (lo != lo[head])
    keep = new | ~later
    d, p, s, e = merge(doc[~keep], part[~keep], lo[~keep], last[~keep] + length)
    spread = S.mix(d.astype(U64)).view(np.int64)
    return (
        np.concatenate([a[keep].view(np.int64), spread]),
        np.concatenate([c[keep].view(np.int64), np.zeros(len(d), np.int64)]),
        np.concatenate([doc[keep], d]),
        np.concatenate([part[keep], p]),
        np.concatenate([lo[keep], s]),
        np.concatenate([last[keep], e - length]),
    )


def merge(doc, part, lo, end):
    """Unions of ranges [lo, end) of each document (doc, part)."""
    if not len(doc):
        return doc, part, lo, end
    order = np.lexsort((lo, part, doc))
    doc, part, lo, end = doc[order], part[order], lo[order], end[order]
    # Ranges of later documents are lifted above all earlier ones, so one running maximum serves.
    group = np.cumsum(np.append(True, (doc[1:] != doc[:-1]) | (part[1:] != part[:-1]))) - 1
    lift = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    new = np.ones(len(doc), bool)
    new[1:] = (lo[1:] + lift[1:] > reach[:-1]) | (group[1:] != group[:-1])
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(doc)) - 1
    return doc[first], part[first], lo[first], reach[stop] - lift[first]


PIECE_BYTES = 2 * S.CHUNK_BYTES


def pieces(data: np.ndarray, offsets: np.ndarray, length: int, limit: int):
    """(bytes, offsets, place of the first byte): a chunk as it is, or a long row in pieces that overlap by all but one byte of a window."""
    if len(data) <= limit:
        yield data, offsets, 0
        return
    for lo in range(0, max(1, len(data) - length + 1), limit):
        piece = data[lo : lo + limit + length - 1]
        yield piece, np.array([0, len(piece)]), lo


def _runs(length: int, digit: int, piece_bytes: int):
    def run(batches):
        for batch in batches:
            ids, parts_of = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in ("doc_id", "part"))
            found = []
            # Chunks of half a piece: only a row that stands alone is longer than a piece.
            for first, _, data, offsets in S.text_chunks(batch.column("text"), piece_bytes >> 1):
                for piece, cuts, at in pieces(data, offsets, length, piece_bytes):
                    a, c, row, lo, last, _ = suffix_runs(piece, cuts, length, digit)
                    found.append((a, c, ids[row + first], parts_of[row + first], lo - cuts[row] + at, last - cuts[row] + at))
            if found:
                a, c, doc, part, lo, last = _first_in_batch(*(np.concatenate(x) for x in zip(*found, strict=True)), length)
                yield _batch("a c doc_id part lo last", a, c, doc, part.astype(np.int32), lo.astype(np.int32), last.astype(np.int32))

    return run


def _resolve(batches):
    """Sorted runs → covered ranges (kind 1) and the first runs of digits with several contexts (kind 2)."""
    last_a = last_c = None
    head = (0, 0, 0)
    contexts = 0
    pending = None
    for batch in batches:
        a, c, *where, last = (batch.column(k).to_numpy() for k in ("a", "c", "doc_id", "part", "lo", "last"))
        n = len(a)
        if not n:
            continue
        ready = c == 0
        new_a = np.ones(n, bool)
        new_a[1:] = a[1:] != a[:-1]
        new_a[0] = last_a is None or a[0] != last_a
        new_c = new_a.copy()
        new_c[1:] |= c[1:] != c[:-1]
        new_c[0] |= last_c is None or c[0] != last_c
        at = np.maximum.accumulate(np.where(new_c, np.arange(n), -1))
        firsts = [np.where(at < 0, h, x[at]) for h, x in zip(head, where, strict=True)]
        differs = np.logical_or.reduce([x != f for x, f in zip(where, firsts, strict=True)])
        covered = ready | (~new_c & differs)
        group = np.cumsum(new_a)
        opens = new_c & ~ready
        per = np.bincount(group[opens], minlength=group[-1] + 1)
        if not new_a[0]:
            per[group[0]] += contexts
        several = opens & (per[group] > 1)
        out = [(np.full(int(mask.sum()), kind), a[mask], *(x[mask] for x in where), last[mask]) for kind, mask in ((1, covered), (2, several))]
        if pending is not None and not new_a[0] and per[group[0]] > 1:
            out.append(tuple(np.array([x]) for x in (2, *pending)))
            pending = None
        if new_a[0] or group[-1] != group[0]:
            pending = None
        if per[group[-1]] == 1:
            mine = np.flatnonzero(opens & (group == group[-1]))
            if len(mine):
                pending = tuple(x[mine[0]] for x in (a, *where, last))
        contexts, last_a, last_c, head = int(per[group[-1]]), a[-1], c[-1], tuple(f[-1] for f in firsts)
        kind, a, doc, part, lo, last = (np.concatenate(x) for x in zip(*out, strict=True))
        yield _batch("kind a doc_id part lo last", kind.astype(np.int32), a, doc, part.astype(np.int32), lo.astype(np.int32), last.astype(np.int32))


SUFFIX_BATCH = 1 << 16
#: Digits with more open runs go suffix by suffix; the others stay in one task, whose state this bounds.
HOT_RUNS = 1000
DEPTH = "a long, key long, doc_id long, part int, lo int, body binary"


def _depths(length: int):
    """Texts joined to their open runs → a row with the bytes that a run's suffixes read (key 0), or for a hot digit a row for each suffix with the hash of its whole depth."""

    def run(batches):
        for batch in batches:
            ids, parts_of = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "part"))
            spans = batch.column("spans")
            for first, to_row, data, offsets in S.text_chunks(batch.column("text")):
                held = spans.slice(first, to_row - first)
                counts = pa.compute.list_value_length(held).to_numpy(zero_copy_only=False)
                fields = held.flatten()
                a, lo, last, hot = (fields.field(k).to_numpy(zero_copy_only=False) for k in ("a", "lo", "last", "hot"))
                row = np.repeat(np.arange(to_row - first), counts)
                lo, hot, start = lo.astype(np.int64), hot.astype(bool), offsets[row] + lo
                size = last.astype(np.int64) - lo + 1
                stops = np.cumsum(size)
                at = 0
                while at < len(size):
                    # Runs of about SUFFIX_BATCH suffixes together.
                    to = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + SUFFIX_BATCH, "right")))
                    bytes_of = size[at:to] + length - 1
                    cuts = np.concatenate([[0], np.cumsum(bytes_of)])
                    bodies = data[np.repeat(start[at:to] - cuts[:-1], bytes_of) + np.arange(cuts[-1])]
                    cold = np.flatnonzero(~hot[at:to])
                    raw = bodies.tobytes()
                    texts = pa.array([raw[cuts[k] : cuts[k + 1]] for k in cold], pa.binary())
                    cold += at
                    yield _batch("a key doc_id part lo body", a[cold], np.zeros(len(cold), np.int64), ids[row[cold] + first], parts_of[row[cold] + first], lo[cold].astype(np.int32), texts)
                    warm = np.flatnonzero(hot[at:to])
                    run_of = np.repeat(warm, size[at:to][warm])
                    within = np.arange(len(run_of)) - np.repeat(np.cumsum(size[at:to][warm]) - size[at:to][warm], size[at:to][warm])
                    begin = cuts[run_of] + within
                    key = S.span_hash(S.prefix_sums(bodies), begin, begin + length)
                    run_of += at
                    yield _batch("a key doc_id part lo body", a[run_of], key.view(np.int64), ids[row[run_of] + first], parts_of[row[run_of] + first], (lo[run_of] + within).astype(np.int32), pa.nulls(len(run_of), pa.binary()))
                    at = to

    return run


def _whole_depth(length: int):
    """Sorted rows of _depths → covered ranges of the suffixes that are equal to an earlier one of the same digit."""

    def run(batches):
        last_a, seen, last_hot, before = None, np.zeros(0, U64), None, None
        for batch in batches:
            # Rows that repeat a document bring its runs again, one after the other.
            where = [batch.column(k).to_numpy() for k in ("a", "key", "doc_id", "part", "lo")]
            fresh = np.ones(batch.num_rows, bool)
            fresh[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in where])
            if len(fresh):
                fresh[0] = before != tuple(x[0] for x in where)
                before = tuple(x[-1] for x in where)
            batch = batch.filter(pa.array(fresh))
            cold = batch.filter(pa.compute.is_valid(batch.column("body")))
            if cold.num_rows:
                a, doc, part, lo = (cold.column(k).to_numpy() for k in ("a", "doc_id", "part", "lo"))
                data, offsets = S.flat(cold.column("body"))
                data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
                count = np.diff(offsets) - length + 1
                row = np.repeat(np.arange(len(a)), count)
                within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = offsets[row] + within
                key = S.mix(S.span_hash(S.prefix_sums(data), start, start + length) + a[row].view(U64))
                _, first = np.unique(key, return_index=True)
                again = np.ones(len(key), bool)
                again[first] = False
                if last_a is not None and a[0] == last_a:
                    again |= np.isin(key, seen)
                mine = S.distinct_sorted(key[a[row] == a[-1]])
                seen = np.union1d(seen, mine) if a[-1] == last_a else mine
                last_a = a[-1]
                here = lo[row[again]] + within[again]
                d, p, s, e = merge(doc[row[again]], part[row[again]], here, here + length)
                yield _batch("doc_id part lo last", d, p.astype(np.int32), s.astype(np.int32), (e - length).astype(np.int32))
            hot = batch.filter(pa.compute.is_null(batch.column("body")))
            if hot.num_rows:
                a, key, doc, part, lo = (hot.column(k).to_numpy() for k in ("a", "key", "doc_id", "part", "lo"))
                again = np.zeros(len(a), bool)
                again[1:] = (a[1:] == a[:-1]) & (key[1:] == key[:-1])
                again[0] = (a[0], key[0]) == last_hot
                last_hot = (a[-1], key[-1])
                lo = lo[again].astype(np.int64)
                d, p, s, e = merge(doc[again], part[again], lo, lo + length)
                yield _batch("doc_id part lo last", d, p.astype(np.int32), s.astype(np.int32), (e - length).astype(np.int32))

    return run


def with_parts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text_key, ...) with the column part: 0, or the number of this text among the texts of one doc_id."""
    keys = docs.where("doc_id is not null").select("doc_id", "text_key").distinct()
    part = F.row_number().over(Window.partitionBy("doc_id").orderBy("text_key")) - 1
    later = S.written(keys.withColumn("part", part).where("part > 0"), "parts")
    return docs.join(later, ["doc_id", "text_key"], "left").withColumn("part", F.coalesce("part", F.lit(0)))


def covered_spans(docs: DataFrame, length: int = 100, digit: int = 32, hot_runs: int = HOT_RUNS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """docs (doc_id, part, text) → (doc_id, part, spans): ranges of start positions lo..last whose windows of ``length`` bytes start earlier too."""
    docs = docs.where("doc_id is not null").select("doc_id", "part", "text")
    runs = docs.mapInArrow(_runs(length, digit, piece_bytes), RUN)
    runs = runs.repartition("a").sortWithinPartitions("a", "c", "doc_id", "part", "lo")
    spans = S.written(runs.mapInArrow(_resolve, SPAN), "suffix-runs")
    several = spans.where("kind = 2").drop("kind")
    # At most one digit for hot_runs open runs, so that every task can hold them; a join by digit would send a hot one to one task.
    hot = several.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > hot_runs).select("a", F.lit(True).alias("hot"))
    several = several.join(F.broadcast(hot), "a", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    still = several.groupBy("doc_id", "part").agg(F.collect_list(F.struct("a", "lo", "last", "hot")).alias("spans"))
    depths = docs.join(still, ["doc_id", "part"]).select("doc_id", "part", "text", "spans").mapInArrow(_depths(length), DEPTH)
    # Both keys deal a hot digit over all tasks; the others have one key.
    depths = depths.repartition("a", "key").sortWithinPartitions("a", "key", "doc_id", "part", "lo")
    late = depths.mapInArrow(_whole_depth(length), "doc_id long, part int, lo int, last int")
    both = spans.where("kind = 1").select("doc_id", "part", "lo", "last").union(late)
    return both.groupBy("doc_id", "part").agg(F.collect_list(F.struct("lo", "last")).alias("spans"))


def removed_mask(n: int, spans, length: int) -> np.ndarray:
    """True at each byte of a text of n bytes that a covered window holds."""
    step = np.zeros(n + 1, np.int64)
    for x in spans or ():
        step[min(x["lo"], n)] += 1
        step[min(x["last"] + length, n)] -= 1
    return np.cumsum(step[:-1]) > 0


def repeated_bytes(docs: DataFrame, length: int = 100, digit: int = 32) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): one row per document row."""
    S.small_batches(docs.sparkSession)

    def digest(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                data = (text.as_py() or "").encode()
                spans = spans.as_py()
                if not spans:
                    out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                    continue
                gone = removed_mask(len(data), spans, length)
                starts = int((gone & ~np.append(False, gone[:-1])).sum())
                rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((len(data), int(gone.sum()), starts, hashlib.sha256(rest).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield _batch("doc_id n_bytes n_removed n_spans kept_sha256", batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.string()))

    named = with_parts(S.boxed(docs).drop("d"))
    joined = named.join(covered_spans(named, length, digit), ["doc_id", "part"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame, length: int = 100, digit: int = 32) -> DataFrame:
    """The documents without their repeated windows, columns unchanged and n_chars renewed.

    A character stays if all of its bytes stay. Documents of which nothing is
    left go; documents that were empty before stay.
    """
    S.small_batches(docs.sparkSession)
    keyed = with_parts(S.boxed(docs))
    joined = keyed.join(covered_spans(keyed, length, digit), ["doc_id", "part"], "left").select("d", "spans")
    schema = docs.schema
    names = schema.fieldNames()

    def cut(batches):
        at = names.index("text")
        for batch in batches:
            rows = pa.RecordBatch.from_struct_array(batch.column("d"))
            texts, keep = [], []
            for text, spans in zip(rows.column(at).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if spans and text:
                    data = text.encode()
                    gone = removed_mask(len(data), spans, length)
                    raw = np.frombuffer(data, np.uint8)
                    heads = np.flatnonzero((raw & 0xC0) != 0x80)
                    gone = np.repeat(np.logical_or.reduceat(gone, heads), np.diff(np.append(heads, len(data))))
                    text = raw[~gone].tobytes().decode()
                    keep.append(bool(text))
                else:
                    keep.append(True)
                texts.append(text)
            yield rows.set_column(at, "text", pa.array(texts, pa.string())).filter(pa.array(keep, pa.bool_()))

    out = joined.mapInArrow(cut, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out
