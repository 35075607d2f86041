"""Brute force, invariants and edge cases of the training-data operators."""

import collections
import hashlib
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import decontaminate, embedding_dedup, language, language_model, licenses, minhash, mixing, quality, repeats, toxicity
from cohortloom.llm import shared as S
from cohortloom.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    rows = [(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows]
    return spark.createDataFrame(rows, DOCS).withColumns({"label": F.lit("clash"), "comp": F.lit(1), "key": F.lit(2)})


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size):03d}" for _ in range(n))


def corpus(spark):
    """Copies, near copies, shared passages, nulls, empties, a long text, repeated rows."""
    rng = random.Random(3)
    base = words(rng, 120)
    passage = words(rng, 60)
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, base + " tail end", "en", "b"), (4, None, None, None), (5, "", "en", "b")]
    rows += [(6, "one", "en", "a"), (7, "One", "en", "c"), (8, "  \n ", "en", "c"), (9, words(rng, 6000), "fr", "c"), (9, words(random.Random(3), 5), "fr", "c")]
    rows += [(10 + k, f"{words(rng, 30)} {passage} {words(rng, 30)}", "en", "a") for k in range(6)]
    rows += [(20 + k, " ".join(w if rng.random() > 0.01 * k else "x" + w for w in base.split()), "en", "a") for k in range(12)]
    rows += [(40, "ééé ñandú " * 40, "es", "a"), (41, "x" + "ééé ñandú " * 40, "es", "a"), (42, "ab " * 200, "en", "a")]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def docs(spark):
    out = corpus(spark)
    out = S.written(out.union(out.where("doc_id in (3, 20)")), "docs")
    return out, [(r["doc_id"], r["text"]) for r in out.collect()]


@pytest.fixture(scope="module")
def text_keys(docs):
    """The number by which texts of one doc_id are told apart."""
    return {r["text"]: r["k"] for r in docs[0].select("text", F.xxhash64("text").alias("k")).collect()}


def exact_set(text, size):
    w = text.encode().lower().split()
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(zip(*(w[k:] for k in range(size))))


def linked(a, b):
    both = len(a & b)
    return both and 100 * both >= 80 * (len(a) + len(b) - both)


def union_find(ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    return find, join


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(None, 3), (5, 5)]
    find, join = union_find(range(500))
    for a, b in pairs:
        if a is not None:
            join(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a is not None and a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("size", [2, 5])
def test_minhash(docs, text_keys, size):
    """Repeated rows, and one doc_id with two texts, of which each has its own group."""
    df, rows = docs
    sets = {k: exact_set(k[1] or "", size) for k in rows}
    order = {k: (k[0], text_keys[k[1]]) for k in sets}
    parent = {k: k for k in sets}

    def root(k):
        return k if parent[k] == k else root(parent[k])

    for a in sets:
        for b in sets:
            if a != b and linked(sets[a], sets[b]):
                x, y = sorted((root(a), root(b)), key=order.get)
                parent[y] = x
    got = sorted(map(tuple, minhash.near_duplicates(df, size).select("doc_id", "n_shingles", "component_id", "kept").collect()))
    assert got == sorted((k[0], len(sets[k]), root(k)[0], root(k)[0] == k[0]) for k in rows)
    kept = minhash.drop_near_duplicates(df, size)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted((k for k in rows if root(k) == k), key=repr)


def test_super_minhash_estimates_jaccard():
    rng = np.random.default_rng(5)
    a, extra = rng.integers(0, 2**63, 400, dtype=np.uint64), rng.integers(0, 2**63, 100, dtype=np.uint64)
    elements = np.concatenate([np.sort(a), np.sort(np.concatenate([a, extra]))])
    sig = minhash.super_minhash(elements, np.array([0, 400, 900]), 256)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.08
    # Pieces of a set give the signature of the whole set.
    assert (minhash.super_minhash(elements, np.array([0, 400, 900]), 256, piece=37) == sig).all()


def brute_repeats(rows, length, keys=None):
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda x: (x[0], keys and keys[x[1]])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen.add(w)
        rest = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i, t] = (i, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return sorted(out[r] for r in rows)


def test_repeats(docs, text_keys):
    df, rows = docs
    assert sorted(map(tuple, repeats.repeated_bytes(df).collect())) == brute_repeats(rows, 100, text_keys)
    clash = df.withColumns({k: F.lit(7) for k in ("cut_spans", "spans", "part", "text_key", "d", "a")})
    cut = repeats.cut_repeats(clash)
    assert cut.columns == clash.columns
    got = [(r["doc_id"], r["text"]) for r in cut.collect()]
    by_id = dict(got)
    assert by_id[1] == dict(rows)[1] and 2 not in by_id and by_id[5] == "" and by_id[4] is None and sum(i == 9 for i, _ in got) == 2
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect() if r["text"] is not None)


def flat_spans(got):
    return {(r["doc_id"], r["part"], k) for r in got.collect() for x in r["spans"] for k in range(x["lo"], x["last"] + 1)}


def test_repeats_in_long_texts(docs):
    """Texts longer than a piece give what they give as one."""
    named = repeats.with_parts(S.boxed(docs[0]))
    want = flat_spans(repeats.covered_spans(named))
    for piece in (300, 5000):
        assert flat_spans(repeats.covered_spans(named, piece_bytes=piece)) == want


def test_repeats_of_a_short_common_passage(spark):
    """A passage below the window length in many surroundings: equal to brute force, and its digit spread over tasks."""
    rng = random.Random(8)
    passage = "all rights reserved by the holders of this common passage that stands in every text here"
    rows = [(k, f"{words(rng, 12)} {passage} {words(rng, 12)}") for k in range(300)] + [(300 + k, f"x{k} {passage} and then the same tail {words(rng, 3, 1)} {k}") for k in range(20)]
    df = frame(spark, [(i, t, None, None) for i, t in rows])
    assert sorted(map(tuple, repeats.repeated_bytes(df).collect())) == brute_repeats(rows, 100)
    named = repeats.with_parts(S.boxed(df))
    want = flat_spans(repeats.covered_spans(named))
    for hot_runs in (0, 50):
        assert flat_spans(repeats.covered_spans(named, hot_runs=hot_runs)) == want
    (plan,) = [x for x in repeats.covered_spans(named)._jdf.queryExecution().logical().toString().splitlines() if "RepartitionByExpression" in x and "key" in x]
    assert "[a" in plan and ", key" in plan


def brute_language_model(rows, order, rounds):
    """Counts in dictionaries, weights by plain expectation-maximisation: {row: (n_tokens, n_known, N, base, score)}."""
    tokens = [(i, (t or "").encode().lower().split() + ["END"]) for i, t in rows]
    fold = lambda i: zlib.crc32(str(i).encode()) % 7
    rest, whole = collections.Counter(), collections.Counter()

    def grams(t):
        for k in range(len(t)):
            padded = ["BEGIN"] * (order - 1) + t[: k + 1]
            yield [tuple(padded[-n:]) for n in range(1, order + 1)]

    begin = [0, 0]
    for i, t in tokens:
        if fold(i) != 2:
            begin[1] += 1
            begin[0] += fold(i) != 3
            for gs in grams(t):
                whole.update(gs)
                if fold(i) != 3:
                    rest.update(gs)

    def stats(counts):
        return sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)

    def levels(gs, counts, begin, n, v, weights):
        out = [(counts[gs[0]] / max(1, n), weights[0][0] if n else 0.0, 0)]
        for g in gs[1:]:
            h = begin if set(g[:-1]) == {"BEGIN"} else counts[g[:-1]]
            bucket = int(math.log2(h)) if h else None
            out.append((counts[g] / h if h else 0.0, weights[len(g) - 1][bucket] if h else 0.0, bucket))
        return out, 1 / (v + 1)

    weights = [[0.5]] + [[0.5] * language_model.BUCKETS for _ in range(order - 1)]
    n, v = stats(rest)
    for _ in range(rounds):
        taken, reached = [collections.Counter() for _ in range(order)], [collections.Counter() for _ in range(order)]
        for i, t in tokens:
            if fold(i) != 3:
                continue
            for gs in grams(t):
                ls, p = levels(gs, rest, begin[0], n, v, weights)
                ps = []
                for e, w, _ in ls:
                    p = w * e + (1 - w) * p
                    ps.append(p)
                reach = 1.0
                for k in reversed(range(order)):
                    e, w, bucket = ls[k]
                    got = reach * w * e / ps[k]
                    if bucket is not None:
                        taken[k][bucket] += got
                        reached[k][bucket] += reach
                    reach -= got
        new = []
        for k in range(order):
            known = sorted(reached[k])
            near = lambda b: min(known, key=lambda x: (abs(x - b), x))
            new.append([min(max(taken[k][near(b)] / reached[k][near(b)], 1e-6), 1 - 1e-6) if known else 0.5 for b in range(len(weights[k]))])
        weights = new
    n, v = stats(whole)
    out = []
    for i, t in tokens:
        score = 0.0
        for gs in grams(t):
            ls, p = levels(gs, whole, begin[1], n, v, weights)
            for e, w, _ in ls:
                p = w * e + (1 - w) * p
            score += math.log10(p)
        base = sum(math.log10((whole[(w,)] + 1) / (n + v + 1)) for w in t)
        out.append((i, len(t), sum(whole[(w,)] > 0 for w in t), n, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(docs, order):
    df, rows = docs
    got = sorted(tuple(r[k] for k in ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in language_model.language_model_scores(df, order=order, rounds=4, tolerance=0.0, block_bytes=4000).collect())
    want = sorted(brute_language_model(rows, order, 4))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for a, b in zip(got, want):
        assert a[4:] == pytest.approx(b[4:], rel=1e-9)


def test_packing():
    x = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64))
    assert (language_model.unpack_sorted(language_model.pack_sorted(x)) == x).all()
    assert len(language_model.unpack(language_model.pack(np.zeros(0, np.uint64)))) == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((6, 16))
    rows = []
    for k in range(120):
        v = centre[k % 6] + 0.05 * rng.standard_normal(16) * (k % 4)
        rows.append((k, [float(x) for x in v], k % 2))
    rows += [(200, rows[0][1], 0), (201, [0.0] * 16, 0), (202, None, 0), (203, [1.0, None] * 8, 0), (204, [float("nan")] * 16, 0), (205, rows[0][1], None), (206, [2 * x for x in rows[0][1]], 0), (207, [1.0, 2.0], 0), (None, rows[0][1], 0)]
    # One vec_id with several vectors, and repeated rows.
    rows += [(2, rows[3][1], 0), (2, rows[4][1], 0), (2, rows[4][1], 0), rows[5], rows[8]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("h", F.lit(1))
    stored = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    good = [(i, np.array(v, float), l) for i, v, l in stored if l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    vectors = {(i, tuple(v), l): v for i, v, l in good if i is not None}
    groups = {k: {k} for k in vectors}
    links = collections.Counter()
    for a in vectors:
        for b in vectors:
            v, w = vectors[a], vectors[b]
            if a != b and a[2] == b[2] and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[a] += 1
                if groups[a] is not groups[b]:
                    groups[a] |= groups[b]
                    for k in groups[b]:
                        groups[k] = groups[a]
    want = []
    for i, v, l in stored:
        k = (i, None if v is None else tuple(v), l)
        c = min(x[0] for x in groups[k]) if k in vectors else i
        want.append((i, links[k], c, i == c if i is not None else True))
    for block in (4096, 16):
        assert sorted(map(tuple, embedding_dedup.link_embeddings(df, block_rows=block).collect()), key=repr) == sorted(want, key=repr)
    assert embedding_dedup.link_embeddings(df.limit(0)).count() == 0
    width, least = embedding_dedup.calibrate(0.98, 32, 2.5, 1e-6)
    assert width == pytest.approx(0.5) and 20 < least < 32


def test_embedding_windows_prune():
    """The windows lose no link and leave few of all pairs to be counted."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 64))
    x[2000:] = x[:1000] + 0.08 * rng.standard_normal((1000, 64))
    n = len(x)
    nodes = np.arange(n)
    for block, cross in ((np.zeros(n, int), False), (nodes % 2, True)):
        _, links, root, counted = embedding_dedup.link_group(nodes, np.ones(n, np.int64), np.zeros(n, np.int64), block, cross, x, 0.98, 32, 2.5, 1e-6, 0, 10)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        want = (unit @ unit.T >= 0.98) & ~np.eye(n, dtype=bool) & (True if not cross else block[:, None] != block[None])
        assert (links == want.sum(1)).all() and counted < 0.05 * n * (n - 1) / 2
        assert (root == embedding_dedup.fold_links(np.arange(n), *np.nonzero(want))).all()


def test_licenses(spark):
    rows = [(1, "Released under the MIT License.\nReleased under the MIT-license; mit license mit license", None, None), (2, None, None, None), (3, "", None, None), (4, "éMIT license", None, None), (5, "the work is under license gnu general public, version 3 licensed this", None, None), (5, "CC   BY", None, None)]
    got = sorted(map(tuple, licenses.scan_licenses(frame(spark, rows)).collect()), key=repr)
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for i, t, _, _ in rows:
        w = cut.findall((t or "").lower())
        starts, base, labels, best = [], set(), set(), 0.0
        for p, label in licenses.PHRASES.items():
            k = p.split()
            at = [s for s in range(len(w) - len(k) + 1) if w[s : s + len(k)] == k]
            starts += at
            base |= {label} if at else set()
        for line in (t or "").lower().split("\n"):
            held = set(cut.findall(line))
            for label, text in licenses.TEMPLATES:
                need = set(text.split())
                if len(need & held) >= math.ceil(0.8 * len(need) - 1e-9):
                    labels.add(label)
                    best = max(best, len(need & held) / len(need))
        want.append((i, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if starts else best))
    assert got == sorted(want, key=repr)
    assert licenses.scan_licenses(frame(spark, [(1, "x", None, None)]).limit(0)).count() == 0


@pytest.mark.parametrize("mark", ["", "# ", " * ", "rem "])
def test_wrapped_licenses(spark, mark):
    """Notices wrapped to short lines, after other text and behind comment marks, are found; their scattered words are not."""
    rng = random.Random(5)
    wrap = lambda t, width: "\n".join(mark + x for x in textwrap.wrap(t, width))
    rows = [(100 * k + width, f"{words(rng, 20)}\n{wrap(text, width)}\n{words(rng, 20)}", None, None) for k, (_, text) in enumerate(licenses.TEMPLATES) for width in (40, 72)]
    rows += [(100 * k + 1, "\n".join(f"{w} {words(rng, 3)}" for w in text.split()), None, None) for k, (_, text) in enumerate(licenses.TEMPLATES)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    for k, (label, _) in enumerate(licenses.TEMPLATES):
        for width in (40, 72):
            assert label in got[100 * k + width]["labels"].split(",") and got[100 * k + width]["score"] >= 0.8
        assert got[100 * k + 1]["labels"] == ""


def test_decontaminate(spark):
    rng = random.Random(9)
    items = [(k, f"{words(rng, 25, 3000)}\n{words(rng, 8, 3000)}") for k in range(40)] + [(50, None), (51, ""), (52, words(rng, 20, 3000))]
    texts = [(1, f"{words(rng, 700, 3000)} {items[3][1]} {words(rng, 500, 3000)}"), (2, items[7][1].upper() + " " + items[42][1]), (3, words(rng, 900, 3000)), (4, None), (5, ""), (6, items[5][1].split("\n")[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, [(i, t, None, None) for i, t in texts])
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == {1: [3], 2: [7, 52], 3: [], 4: [], 5: [], 6: []}
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(df, bench).collect()) == [3, 4, 5, 6]
    # Statistics are those of all items: the same scores whatever the number of shards.
    scored = lambda **o: sorted((r["doc_id"], tuple(r["leak_ids"]), r["leak_score"]) for r in decontaminate.judge(df, bench, **o).collect())
    assert scored(shard_items=7) == scored() == scored(shard_items=1)
    assert decontaminate.find_leaks(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0
    clash = df.union(df).union(df.withColumn("doc_id", F.lit(None).cast("long"))).withColumns({k: F.lit(1) for k in ("leak_ids", "leak_score", "text_key", "d", "hit_id")})
    kept = decontaminate.drop_leaks(clash, bench)
    assert kept.columns == clash.columns and kept.count() == 12 and kept.where("leak_score = 1").count() == 12


def test_block_max_skips_nothing():
    """Every item whose full score reaches the threshold is found, whatever its place."""
    rng = random.Random(4)
    items = [(k, words(rng, 30, 500)) for k in range(60)]
    index = decontaminate.Index(items, 0.5)
    text = " ".join(t for _, t in items[10:12]) + " " + words(rng, 600, 500)
    data = np.frombuffer(text.encode(), np.uint8)
    w, rows, _, _ = S.words_of(data, np.array([0, len(data)]), decontaminate._WORD)
    span = max(128, 2 * index.longest)
    counts, mean = [collections.Counter(decontaminate.item_words(t)[2].tolist()) for _, t in items], 30
    df = collections.Counter(x for c in counts for x in c)
    weight = lambda c, x: math.log(1 + (60 - df[x] + 0.5) / (df[x] + 0.5)) * c[x] * 2.2 / (c[x] + 1.2)
    want, every = set(), set()
    for lo in range(0, len(w), span // 2):
        have = set(w[lo : lo + span].tolist())
        for k, c in enumerate(counts):
            score = sum(weight(c, x) for x in c if x in have) / sum(weight(c, x) for x in c)
            if score >= 0.5:
                every.add(k)
                want |= {k} if index.overlaps(w[lo : lo + span], index.ids.index(k)) else set()
    assert mean == index.longest and {index.ids[at] for _, at, _ in index.found(w, rows)} == want and len(want) >= 2
    # Cut into pieces, the passages are the same.
    assert {(row, at) for row, at, _ in index.found(w, rows, limit=100)} == {(row, at) for row, at, _ in index.found(w, rows)}
    have = np.unique(w)
    total = {k for k, c in enumerate(counts) if sum(weight(c, x) for x in c if x in set(have.tolist())) / sum(weight(c, x) for x in c) >= 0.5}
    assert {index.ids[at] for blk in range(len(index.rest)) for at in index.pivots(have, blk)} == total and every <= total


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(k, words(rng, rng.randrange(5, 40)), None, "big" if k % 3 else f"s{k % 7}") for k in range(600)] + [(700, None, None, None), (701, "", None, "big")]
    df = frame(spark, rows)
    got = mixing.mix_sources(df, target_entropy=0.98, budget=1.5, block_docs=16).collect()
    tokens = {i: len((t or "").split()) for i, t, _, _ in rows}
    per = collections.Counter()
    for r in got:
        per[r["source"]] += r["n_tokens"]
    total = sum(tokens.values())
    weights = {r["source"]: r["weight"] for r in got}
    entropy = -sum(w * math.log(w) for w in weights.values()) / math.log(len(weights))
    assert sum(weights.values()) == pytest.approx(1) and entropy == pytest.approx(0.98, abs=1e-4)
    for s, w in weights.items():
        budget = round(w * total * 1.5)
        assert 0 <= budget - per[s] < 2 * 40
    for s in weights:
        for e in {r["epoch"] for r in got if r["source"] == s}:
            order = sorted((r["token_start"], r["n_tokens"]) for r in got if r["source"] == s and r["epoch"] == e)
            assert all(a + n == b for (a, n), (b, _) in zip(order, order[1:]))
    again = mixing.mix_sources(df.repartition(7), target_entropy=0.98, budget=1.5, block_docs=16).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert mixing.mix_sources(df.limit(0)).count() == 0
    limited = mixing.mix_sources(df, target_entropy=None, max_repetition=1.2, budget=1.0, block_docs=16)
    used = limited.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    own = collections.Counter()
    for i, _, _, s in rows:
        own[s or ""] += tokens[i]
    assert max(r["n"] / own[r["source"]] for r in used) <= 1.2 + 1e-6


def mixture(shares, x):
    w = np.array(shares, float) ** x
    return w / w.sum()


@pytest.mark.parametrize("shares,target,limit,budget", [([0.9, 0.1], 0.2, None, 1.0), ([0.5, 0.3, 0.2], 0.8, 4.0, 1.0), ([0.9, 0.07, 0.03], 0.95, 4.0, 1.0), ([0.6, 0.4], 0.5, 1.3, 1.0), ([1.0], 0.9, 2.0, 1.5), ([0.5, 0.5], 0.5, 4.0, 1.0)])
def test_exponent(spark, shares, target, limit, budget):
    """Against bisection in plain Python, below and above the natural mixture."""
    entropy = lambda x: -sum(w * math.log(w) for w in mixture(shares, x) if w > 0) / math.log(len(shares))
    most = lambda x: budget * max(w / s for w, s in zip(mixture(shares, x), shares))
    x, met = 1.0, True
    if len(shares) > 1:
        lo, hi = 0.0, mixing.HIGHEST
        if entropy(hi) >= target:
            met = False
        else:
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if entropy(mid) >= target else (lo, mid)
            x = lo
    if limit is not None and most(x) > limit:
        met, bad, good = False, x, 1.0
        for _ in range(200):
            mid = (bad + good) / 2
            bad, good = (bad, mid) if most(mid) <= limit else (mid, good)
        x = good
    sources = spark.createDataFrame([(s,) for s in shares], "share double")
    got = mixing.find_exponent(sources, target, limit, budget)
    assert got[0] == pytest.approx(x, abs=1e-6) and got[1] == met
    with pytest.raises(ValueError):
        mixing.find_exponent(sources, target, 1.2, 3.0)


def test_mixing_order(spark):
    """Blocks of an epoch follow each other by groups; weights, exponent and uses are those of the plan."""
    rng = random.Random(7)
    rows = [(k, words(rng, rng.randrange(1, 9)), None, "hot" if k % 3 == 0 else f"s{k % 2}") for k in range(900)] + [(5, words(rng, 3), None, "hot")]
    got = mixing.mix_sources(frame(spark, rows), target_entropy=0.9, budget=2.5, block_docs=4, group_blocks=8).collect()
    assert len({(r["exponent"], r["target_met"]) for r in got}) == 1
    for s in ("hot", "s0", "s1"):
        for e in {r["epoch"] for r in got if r["source"] == s}:
            mine = sorted((r["token_start"], r["n_tokens"], r["block"]) for r in got if r["source"] == s and r["epoch"] == e)
            assert all(a[0] + a[1] == b[0] for a, b in zip(mine, mine[1:])) and mine[0][0] == 0
            runs = [k for k, x in enumerate(mine) if k == 0 or x[2] != mine[k - 1][2]]
            assert len(runs) == len({x[2] for x in mine})


def noisy(rng, good):
    body = words(rng, 40)
    return body.capitalize() + "." if good else " ".join(w + "!!" for w in body.upper().split())


def test_quality(spark):
    rng = random.Random(8)
    rows = [(k, noisy(rng, k % 4 > 0), "en", "a") for k in range(300)] + [(400, None, None, None), (401, "", None, None), (0, noisy(rng, False), "en", "a")]
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify_quality(frame(spark, rows), labels).collect()
    assert len(got) == 303 and {r["held_out"] for r in got} == {True, False}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held) / len(held) > 0.97
    kept = quality.keep_quality(frame(spark, rows), labels)
    assert kept.columns == frame(spark, rows).columns and kept.count() < 303
    none = quality.classify_quality(frame(spark, rows[:5]), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_ftrl_is_the_textbook_update():
    """Against per-coordinate updates in dictionaries."""
    rng = random.Random(3)
    stream = [(np.array([*rng.sample(range(8), 3), 8]), np.array([rng.random(), 1.0, 2.0, 1.0]), float(rng.random() < 0.5)) for _ in range(60)]
    z, n, alpha, beta, l1, l2 = collections.defaultdict(float), collections.defaultdict(float), 0.5, 1.0, 1e-4, 1e-4
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for slots, values, y in stream:
        w = {i: weight(i) for i in slots}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(slots, values))))
        for i, v in zip(slots, values):
            g = (p - y) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
            n[i] += g * g
    w, b = quality.ftrl(iter(stream), 3)
    assert w == pytest.approx([weight(i) for i in range(8)]) and b == pytest.approx(weight(8))


def test_quality_features():
    """Token shares, counted in plain Python: every feature family of a text adds up to its share of n-grams."""
    text = "The cat, the CAT the cat, the CAT!!"
    data = np.frombuffer(text.encode(), np.uint8)
    rows, slots, values = quality.token_features(data, np.array([0, len(data)]))
    tokens = re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]+", text)
    grams = lambda n: [tuple(t.lower() for t in tokens[k : k + n]) for k in range(len(tokens) - n + 1)]
    again = len(grams(3)) - len(set(grams(3)))
    n = len(tokens)
    assert values.sum() == pytest.approx((n + n - 1 + n + n - 1 + again) / n) and (rows == 0).all()
    one = S.words_of(np.frombuffer(b"cat", np.uint8), np.array([0, 3]))[0]
    mine = slots == quality._slots(one, 11, quality.BITS)[0]
    assert values[mine].sum() == pytest.approx(sum(t.lower() == "cat" for t in tokens) / n)


def test_toxicity_counts_and_ratios(spark):
    """Document counts per n-gram, ranking and scores against plain Python; rare n-grams count too."""
    rng = random.Random(4)
    rows = [(k, words(rng, 6, 30) + (f" vile brute{'zyxq' if k == 8 else ''}" if k % 4 == 0 else ""), k % 4 == 0) for k in range(60)]

    def grams(text):
        s = " " + re.sub("[^a-z]", " ", text.lower()) + " "
        return {s[k : k + n] for n in toxicity.LENGTHS for k in range(len(s) - n + 1)}

    data = np.frombuffer("".join(t for _, t, _ in rows).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for _, t, _ in rows])])
    r, slots = toxicity.presence(data, offsets)
    per_row = [set(slots[r == k].tolist()) for k in range(len(rows))]
    assert [len(x) for x in per_row] == [len(grams(t)) for _, t, _ in rows]
    pos, neg = collections.Counter(), collections.Counter()
    for x, (_, _, bad) in zip(per_row, rows):
        (pos if bad else neg).update(x)
    n_pos, n_neg = sum(b for *_, b in rows), sum(not b for *_, b in rows)
    g = {}
    for x in {*pos, *neg}:
        t = pos[x] + neg[x]
        g[x] = sum(c * math.log(c / (t * m / (n_pos + n_neg))) for c, m in ((pos[x], n_pos), (neg[x], n_neg)) if c)
    want = sorted((x for x in g if round(g[x], 9) > 0), key=lambda x: (-round(g[x], 9), x))[:200]
    counts = spark.createDataFrame([(x, pos[x], neg[x]) for x in g], "slot long, pos int, neg int")
    got = toxicity.strongest(counts, n_pos, n_neg, 200).collect()
    assert [r["slot"] for r in got] == want and any(r["pos"] + r["neg"] < 3 for r in toxicity.strongest(counts, n_pos, n_neg, 10**6).collect())
    assert toxicity.log_count_ratios(3, 1, 10, 20) == pytest.approx(math.log((4 / 12) / (2 / 22)))


def test_toxicity(spark):
    rng = random.Random(8)
    bad = lambda: words(rng, 30).replace("w1", "idiot", 1) + " moron"
    rows = [(k, bad() if k % 5 == 0 else words(rng, 32), "en", "a") for k in range(400)] + [(500, None, None, None), (501, "", None, None)]
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(400)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify_toxicity(frame(spark, rows), labels).collect()}
    held = [r for i, r in got.items() if r["held_out"] and i < 400]
    assert sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held) / len(held) > 0.97
    assert 0 <= got[500]["score"] == got[501]["score"] < 0.3
    assert toxicity.classify_toxicity(frame(spark, rows[:3]), labels.limit(0)).count() == 3


def test_language(spark):
    rng = random.Random(2)
    alphabets = {"xx": "abcde", "yy": "vwxyz", "zz": "éñçüö"}
    make = lambda a: " ".join("".join(rng.choice(a) for _ in range(rng.randrange(2, 7))) for _ in range(30))
    rows = [(k, make(alphabets[lang]), lang, "a") for k in range(150) for lang in [sorted(alphabets)[k % 3]]]
    rows += [(200, None, None, None), (201, "12 34 !!", None, None), (202, "", "xx", None), (203, make("abcde"), None, None)]
    got = {r["doc_id"]: r for r in language.identify_language(frame(spark, rows)).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _ in rows if i < 150)
    assert [got[i]["lang_pred"] for i in (200, 201, 202, 203)] == ["und", "und", "und", "xx"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    alone = language.identify_language(frame(spark, [(1, "abc", None, None)])).first()
    assert alone["lang_pred"] == "und"
    # A text of other letters is farther from every centroid than the language's own held-back texts.
    odd = frame(spark, rows + [(300, make("jklmnop"), None, None), (None, make("abcde"), "xx", None)])
    got = {r["doc_id"]: r for r in language.identify_language(odd, reject_as_und=True).collect()}
    assert got[300]["rejected"] and got[300]["lang_pred"] == "und" and got[0]["lang_pred"] == "xx" and got[None]["lang_pred"] == "xx"


def test_language_vectors():
    """TF-IDF of byte trigrams and cosines against plain Python."""
    texts = ["abc abd", "xyz abc, abc", "Zeé"]
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    idf = np.random.default_rng(1).random(language.SLOTS).astype(np.float32)
    x = language.vectors(np.frombuffer(data, np.uint8), offsets, idf)
    for k, t in enumerate(texts):
        raw = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in t.encode().lower())
        grams = collections.Counter(raw[i : i + 3] for i in range(len(raw) - 2) if b"  " not in raw[i : i + 3])
        want = np.zeros(language.SLOTS)
        for gram, n in grams.items():
            code = np.array([gram[0] << 16 | gram[1] << 8 | gram[2]], np.uint64)
            want[int((S.mix(code) >> np.uint64(40))[0]) % language.SLOTS] += n
        want *= idf
        assert x[k] == pytest.approx(want / max(np.linalg.norm(want), 1e-12), abs=1e-6)
    c = language.spherical_kmeans(x, 2)
    assert np.linalg.norm(c, axis=1) == pytest.approx(1) and (x @ c.T).max(1).min() > 0


def with_labels(run):
    def call(df):
        return run(df, df.sparkSession.createDataFrame([(3, 1, 1), (1, 0, 0), (4, None, 1)], "doc_id long, quality int, toxic int"))

    return call


def against_items(run):
    def call(df):
        return run(df, df.sparkSession.createDataFrame([(1, "what is it\na thing of note")], "item_id long, text string"))

    return call


EVERY = {
    "minhash": minhash.near_duplicates, "repeats": repeats.repeated_bytes, "model": language_model.language_model_scores, "language": language.identify_language,
    "licenses": licenses.scan_licenses, "mixing": mixing.mix_sources, "quality": with_labels(quality.classify_quality), "toxicity": with_labels(toxicity.classify_toxicity), "leaks": against_items(decontaminate.find_leaks),
}
STAGES = {"minhash": minhash.drop_near_duplicates, "repeats": repeats.cut_repeats, "quality": with_labels(quality.keep_quality), "leaks": against_items(decontaminate.drop_leaks)}


@pytest.mark.parametrize("name", EVERY)
def test_edges(spark, name):
    """Empty tables, null ids, repeated rows, one id with several texts, nulls in every column."""
    assert EVERY[name](frame(spark, [(1, "x", "en", "a")]).where("doc_id > 5")).count() == 0
    rows = [(None, "some words here", None, None), (None, None, None, None), (3, "a few words", "en", "a"), (3, "a few words", "en", "a"), (3, "other words", "en", "a")]
    got = EVERY[name](frame(spark, rows)).collect()
    assert sum(r["doc_id"] == 3 for r in got) in ((3,) if name != "mixing" else (2, 3)) and sum(r["doc_id"] is None for r in got) in ((2,) if name != "mixing" else (1,))


@pytest.mark.parametrize("name", STAGES)
def test_stage_edges(spark, name):
    """A stage keeps the columns whatever their names, and the rows that it has no reason to drop."""
    rows = [(None, "some words here", None, None), (None, None, None, None), (3, "a few words", "en", "a"), (4, "", "en", "a"), (3, "other words", "en", "a")]
    df = frame(spark, rows).withColumns({k: F.lit(1) for k in ("spans", "part", "text_key", "d", "first", "score", "leak_ids")})
    got = STAGES[name](df)
    assert got.columns == df.columns and STAGES[name](df.limit(0)).count() == 0
    assert name == "quality" or got.count() == 5


def test_crossing_links_are_exact():
    rng = random.Random(12)
    base = rng.sample(range(1, 10**9), 90)
    sets = []
    for k in range(300):
        kept = [x if rng.random() > 0.002 * (k % 90) else rng.randrange(1, 10**9) for x in base] if k % 3 else rng.sample(range(1, 10**9), rng.randrange(1, 60))
        sets.append(np.array(sorted(set(kept)), np.uint64))
    comp, block = np.arange(300) // 2, np.zeros(300, int)
    want = set()
    for i in range(300):
        for j in range(i + 1, 300):
            both = len(np.intersect1d(sets[i], sets[j]))
            if comp[i] != comp[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                want.add((i, j))
    for common in (64, 2048):
        assert {(i, int(j)) for i, js in minhash.crossing_links(sets, comp, block, 80, common) for j in js} == want
    halves = np.arange(300) % 2
    assert {(i, int(j)) for i, js in minhash.crossing_links(sets, comp, halves, 80) for j in js} == {(i, j) for i, j in want if halves[i] != halves[j]}


def test_minhash_blocks(spark):
    """A group larger than its pivots and blocks: the links between the far members are found too."""
    rng = random.Random(5)
    base = words(rng, 150, 5000).split()
    rows = [(k, " ".join(w if rng.random() > 0.001 * (k % 60) else f"n{rng.randrange(10**6)}" for w in base), "en", "a") for k in range(150)]
    sets = {i: exact_set(t, 2) for i, t, _, _ in rows}
    find, join = union_find(sets)
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                join(i, j)
    got = minhash.near_duplicates(frame(spark, rows), 2, pivots=1, block_rows=40).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in sets}
