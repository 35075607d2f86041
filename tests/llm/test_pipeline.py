"""The pipeline stage by stage on the smallest table."""

import numpy as np

import corpus_pipeline
from cohortloom.llm import shared as S


def test_stages(spark, data):
    docs = S.table(spark, data, "documents")
    first, seen = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = S.written(stage(spark, docs, data), name)
        if name != "mixing":
            assert out.columns == first and 0 < out.count() <= seen
            assert out.select("doc_id").distinct().count() == out.count()
            docs, seen = out, out.count()
    bench = [r["text"] for r in S.table(spark, data, "benchmark").collect()]
    assert not any(b in (r["text"] or "") for r in docs.collect() for b in bench)
    assert out.join(docs, "doc_id", "left_anti").count() == 0
    assert corpus_pipeline.run(spark, data).count() == out.count()


def test_stages_against_brute_force(spark, data):
    """Near duplicates, repeats and leaks on the smallest table, each on the stage's own input, against plain Python."""
    from test_operators import exact_set, linked

    from cohortloom.llm import decontaminate

    docs = S.table(spark, data, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {i: exact_set(t or "", 5) for i, t in rows.items()}
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in rows:
        for b in rows:
            if a < b and linked(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = S.written(corpus_pipeline.near_duplicates(spark, docs, data), "kept")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in rows if find(i) == i)

    seen, want = set(), {}
    for i in sorted(r["doc_id"] for r in kept.collect()):
        raw = (rows[i] or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            else:
                seen.add(w)
        # A character goes with any of its bytes.
        left, at = "", 0
        for ch in rows[i] or "":
            n = len(ch.encode())
            left += "" if any(gone[at : at + n]) else ch
            at += n
        if left or not rows[i]:
            want[i] = left or rows[i]
    cut = S.written(corpus_pipeline.repeats(spark, kept, data), "cut")
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == want

    items = {r["item_id"]: r["text"] for r in S.table(spark, data, "benchmark").collect()}
    words = {i: decontaminate.word_hashes(t or "") for i, t in want.items()}
    index = decontaminate.Index(sorted(items.items()), 0.7)
    span = max(128, 2 * index.longest)
    leaky = set()
    for i, w in words.items():
        for lo in range(0, len(w) + 1, span // 2):
            mine = w[lo : lo + span]
            have = np.unique(mine)
            leaky |= {i for at in range(len(index.ids)) if len(mine) and index.score(have, at) >= 0.7 - 1e-9 and index.overlaps(mine, at)}
    clean = corpus_pipeline.decontaminate(spark, cut, data)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(set(want) - leaky)


def test_oracles(spark, data):
    import compare

    from cohortloom.llm import registry

    db = compare.connect(data)
    for name, sql in registry.ORACLES.items():
        assert compare.spark_rows(registry.QUERIES[name](spark, data)) == compare.oracle_rows(db, sql), name
