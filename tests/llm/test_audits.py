"""Quality rules, Merkle manifest and source divergence against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import divergence, manifest, rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    rows = [(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows]
    return spark.createDataFrame(rows, DOCS).withColumns({"g": F.lit("clash"), "term": F.lit(1), "pos": F.lit(2), "n": F.lit(3)})


def rows_of(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    pick = lambda n, k=30: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) + str(rng.randrange(k) % 3) + rng.choice(["", "é", "Ñandú", "#"]) for _ in range(n))
    rows = [(1, None, None, None), (2, "", "en", None), (3, "one", "en", "a"), (3, "two\ntwo\n\n \ntwo\r\nTwo", "en", "a"), (None, "no id\n", "en", "b")]
    rows += [(4 + k, pick(rng.randrange(1, 60)) + rng.choice(["\n", " "]) + "x y z v w " * rng.randrange(4), rng.choice(["en", "fr", "", None]), rng.choice(["a", "b", "c", None])) for k in range(80)]
    long = "verylongterm" * 9
    rows += [(200 + k, f"{long} {long}x {long}{'abcd'[k]} ß日本", "de", "ab"[k % 2]) for k in range(4)]
    rows += [(300, " ".join(pick(5) for _ in range(3000)), "fr", "a"), (301, "12 34 !!", "xx", "only"), (302, "99", "xx", "other")]
    return frame(spark, rows + rows[3:9] + [rows[5]] * 2)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def brute_manifest(rows):
    def leaf(i, text, lang, source, n):
        cells = [i, source, lang, n, text]
        return h(*["-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells])

    groups = collections.defaultdict(list)
    for i, t, lang, src in rows:
        n = None if t is None else len(t)
        odd = i is not None and t is not None and zlib.crc32(str(i).encode()) % 3 == 0
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t) if odd else t
        groups[lang].append(((i is not None, i or 0, leaf(i, t, lang, src, n)), i, leaf(i, low, lang, src, n)))
    trees = {lang: brute_levels([x[0][2] for x in sorted(v)]) for lang, v in groups.items()}
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = brute_levels([trees[lang][-1][0] for lang in names])
    out = []
    for lang, v in groups.items():
        for k, (key, i, start) in enumerate(sorted(v)):
            siblings, node = [], start
            for levels, at in ((trees[lang], k), (top, names.index(lang))):
                for level in levels[:-1]:
                    run = at // 8 * 8
                    left, right = level[run:at], level[at + 1 : run + 8]
                    siblings += left + right
                    node, at = h(*left, node, *right), at // 8
            root = top[-1][0]
            out.append((i, key[2], trees[lang][-1][0], root, h(*siblings), node, node == root))
    return sorted(out, key=repr)


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_manifest(docs):
    assert plain(manifest.verify_manifest(docs)) == brute_manifest(rows_of(docs))


def test_manifest_of_several_rounds(spark):
    """Over 512 leaves in a language: roots of blocks are the leaves of another round."""
    rows = [(k, f"Text {k}", "en" if k % 11 else "fr", "s") for k in range(1300)] + [(7, "Text 7", "en", "s")] * 600
    got = manifest.verify_manifest(frame(spark, rows).repartition(5))
    assert plain(got) == brute_manifest(rows)
    assert {r["verified"] for r in got.collect()} == {True, False}


def test_manifest_order_survives_many_partitions(spark):
    rows = [(k, "a", "en", "s") for k in (3, 1, 2, 1)] + [(None, "b", None, None)]
    assert plain(manifest.verify_manifest(frame(spark, rows))) == brute_manifest(rows)
    assert manifest.verify_manifest(frame(spark, []).limit(0)).count() == 0


def brute_rules(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_rules(spark, docs):
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(4, 84)] + [(None, 1, 1), (3, None, 1)], "doc_id long, quality int, text string")
    got = rules.judge_quality(docs, labels)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert plain(got.select("doc_id", *names)) == sorted(((i, *brute_rules(t)) for i, t, _, _ in rows_of(docs)), key=repr)
    assert got.where("base_failed and kept").count() == 0
    assert got.where("not base_failed").agg(F.min("score"), F.max("score")).first()[0] > 0


def test_rules_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.judge_quality(docs, none).where("kept = base_failed").count() == 0
    assert rules.judge_quality(docs.limit(0), none).count() == 0


def test_rules_find_symbols(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "house", "of", "green", "windows", "stands", "here"]) + str(rng.randrange(9000)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(60))
    rows = [(k, good(), "en", "s") for k in range(300)]
    rows += [(1000 + k, " ".join(w + "***" for w in good().split()), "en", "s") for k in range(40)] + [(2000 + k, good().upper() + "!!", "en", "s") for k in range(40)]
    labels = spark.createDataFrame([(k, 1) for k in range(0, 300, 2)], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in rules.judge_quality(frame(spark, rows), labels).collect()}
    assert not any(got[k] for k in got if k >= 1000)
    assert sum(got[k] for k in got if k < 1000) >= 295


def test_forest_walks_its_trees():
    """Scores from the arrays equal a walk of each tree, and splits leave no side empty."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(200, 3)), np.full((60, 3), 0.5)])
    f = rules.grow(x, 7, 64, 3)

    def path(k, row):
        while f.feature[k] >= 0:
            k = f.left[k] + int(row[f.feature[k]] >= f.value[k])
        return f.path[k]

    c = 2 * (np.log(63) + np.euler_gamma) - 2 * 63 / 64
    want = [2 ** -(np.mean([path(r, row) for r in f.roots]) / c) for row in x]
    assert np.allclose(f.scores(x), want)
    far = f.scores(np.array([[9.0, -9.0, 9.0]]))[0]
    assert far > np.quantile(want, 0.95)
    assert f.path[f.feature < 0].min() > 0


def test_forest_is_grown_over_all_rows(spark):
    """Trees hold every good row of their half and its copy, whatever the partitions; the threshold is exact over all."""
    rng = np.random.default_rng(4)
    rows = [(k, 100, *(int(v) for v in rng.integers(1, 90, len(rules.COUNTS) - 1))) for k in range(1500)]
    stats = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{c} long" for c in rules.COUNTS)).withColumn("n_repeat_words", F.lit(0).cast("long"))
    labels = stats.select("doc_id", F.lit(1).alias("quality"))
    forest, threshold = rules.fit_forest(stats, labels, trees=5)
    again, same = rules.fit_forest(stats.repartition(7, "n_upper"), labels, trees=5)
    assert len(forest.tree_rows) == 5 and forest.tree_rows[:2].sum() == 2 * 1500
    assert threshold == same and all(np.array_equal(getattr(forest, c), getattr(again, c)) for c in ("feature", "value", "left", "path"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")
    scores = sorted(r["score"] for r in rules.with_scores(stats.withColumn("_half", half), forest).collect())
    assert threshold == scores[1500 - 1 - 7]


def test_value_at_a_rank(spark):
    rng = random.Random(3)
    values = [rng.choice([0.5, rng.random(), rng.random() ** 9]) for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for rank in (0, 1499, 2984, 2999):
        assert rules.at_rank(rows, "v", rank, steps=16, most=20) == sorted(values)[rank]


def brute_divergence(rows, least=3, most=200):
    cells = [(lang or "", src or "", re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().lower())) for _, t, lang, src in rows]
    groups, out = sorted({(a, b) for a, b, _ in cells}), []
    counts = collections.Counter((a, b, t) for a, b, ts in cells for t in ts)
    for lang in {a for a, _ in groups}:
        seen = collections.Counter(t for a, _, ts in cells if a == lang for t in set(ts))
        kept = [t for t, k in seen.items() if k >= least]
        sources = [b for a, b in groups if a == lang]
        p = lambda n, total, v=len(kept): 1 + 10**9 * (n + 1) // (total + v)
        per = {s: {t: p(counts[lang, s, t], sum(counts[lang, s, x] for x in kept)) for t in kept} for s in sources}
        every = {t: sum(counts[lang, s, t] for s in sources) for t in kept}
        whole = {t: p(every[t], sum(every.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted((-sum(f(per[s][t], per[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(per[s][t], whole[t]), t) for t in kept if counts[lang, s, t] and per[s][t] > whole[t])[:most]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "most"), [(3, 200), (1, 4)])
def test_divergence(docs, least, most):
    assert plain(divergence.source_divergence(docs.repartition(3), least, most)) == brute_divergence(rows_of(docs), least, most)


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(frame(spark, []).limit(0)).count() == 0
    lonely = frame(spark, [(1, "one of a kind", "en", "a"), (2, None, "en", "b")])
    assert plain(divergence.source_divergence(lonely)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_refinement_discards(spark):
    """A rare prefix is not extended: of 300 long terms only those with a shared prefix reach the second level."""
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)}qqunique{'z' * (k % 9)} sharedprefixterm", "en", "a") for k in range(300)]
    lists = divergence.term_lists(frame(spark, rows))
    assert divergence.refine(lists, 4, 0, None, 1).where("prefix is not null").count() == 301
    first = divergence.refine(lists, 4, 0, None, 3)
    kept = divergence.bit_map(first.where("prefix is not null"))
    assert bin(int(np.bitwise_or.reduce(kept))).count("1") == 1
    assert divergence.refine(lists, 8, 4, kept, 1).where("prefix is not null").count() == 1
    assert [bytes(r["term"]) for r in divergence.kept_terms(frame(spark, rows)).collect()] == [b"sharedprefixterm"]


def test_chunks_of_lists(monkeypatch):
    """Whatever the chunks, each list is taken once; a long one stands alone."""
    import pyarrow as pa

    monkeypatch.setattr(divergence, "CHUNK_TERMS", 5)
    monkeypatch.setattr(divergence, "BUFFER_TERMS", 12)
    sizes = [0, 2, 3, 9, 0, 1, 1, 1, 4, 0, 15, 2]
    rows = [(f"l{k % 2}", f"s{k % 3}", [b"%d" % k] * n) for k, n in enumerate(sizes)]
    types = {"lang": pa.string(), "source": pa.string(), "terms": pa.list_(pa.binary())}
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types.values(), strict=True)], list(types))
    got = [c.to_pylist() for c in divergence.chunks_of_lists([batch(rows[:4]), batch(rows[4:])])]
    assert sorted(repr(r) for c in got for r in c if r["terms"]) == sorted(repr(dict(zip(types, r, strict=True))) for r in rows if r[2])
    for chunk in got:
        lengths = [len(r["terms"]) for r in chunk]
        assert sum(lengths) <= 5 or lengths.count(0) == len(lengths) - 1
        groups = [(r["lang"], r["source"]) for r in chunk]
        assert sum(a != b for a, b in zip(groups, groups[1:], strict=False)) == len(set(groups)) - 1


def test_refinement_sends_packed_rows(spark):
    """Tasks send a row for a bucket and chunk of lists, not one for a term; documents and sources are told apart all the same."""
    rows = [(k, " ".join(f"t{chr(97 + j % 26)}{chr(97 + j // 26)} longterm{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(k % 7, 300)) + " twice twice", "en" if k % 2 else "de", f"s{k % 3}") for k in range(60)]
    lists = divergence.term_lists(frame(spark, rows).coalesce(1))
    assert not [f for f in lists.dtypes if "array" in f[1]]
    shared = spark.sparkContext.broadcast((None, divergence.group_names(lists)))
    assert 1 <= divergence.sent(lists, 4, 0, shared, 2).count() <= 4
    for bits in (1, 2, divergence.LEAST_BITS):
        got = divergence.refine(lists, 8, 0, None, 20, bits=bits).where("term is not null").collect()
        docs = {(lang, t): [r for r in rows if r[2] == lang and t in r[1].split()] for lang in ("de", "en") for t in {w for r in rows for w in r[1].split() if len(w) <= 8}}
        want = {(lang, t.encode(), tuple((s, sum(r[1].split().count(t) for r in d if r[3] == s)) for s in sorted({r[3] for r in d}))) for (lang, t), d in docs.items() if len(d) >= 20}
        assert {(r["lang"], bytes(r["term"]), tuple(tuple(x) for x in r["held"])) for r in got} == want
        assert all(r["n"] == sum(x["n"] for x in r["held"]) for r in got)
