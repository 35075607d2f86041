"""License scan: exact set-similarity join of text blocks with license templates, in DataFrame operations only.

Two parts over one pass of the texts. Base: places where the words of a phrase
stand consecutively. Join: a block (line) matches a template if it holds at
least ``threshold`` of the template's distinct words. Template words are put in
global order of how many blocks hold them, rarest first; a matching block must
hold one of a template's first size - need + 1 words (prefix filter), hold at
least ``need`` template words at all (length filter), and have enough of them
left from the place of the shared word on (positional filter). Candidates are
verified on their word sets. No document text is shuffled.

Wrapped notices: a template also matches a run of consecutive words, across line
ends, of its own length over ``threshold`` (so that words between its lines, as
comment marks are, do not lose it). Runs are looked for in the texts that hold
``threshold`` of the template's distinct words at all, from each of its words on.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased. Phrases
must not overlap themselves.

Edges: null and empty texts have no words, no label and score 0; repeated rows
are scanned each, whatever their ids; extra columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.shared import written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Label and words of the notices looked for.
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "this text is available under cc by 4 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def _spaced(words: str) -> str:
    """Every word between two blanks, so that neighbouring places share no character."""
    return "".join(f" {w} " for w in words.split())


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): one row per document row.

    score is the best containment of a template in a block or run of words, 1 with a base place.
    """
    spark = docs.sparkSession
    phrases = PHRASES if phrases is None else phrases
    sets = [(k, label, sorted(set(words.split()))) for k, (label, words) in enumerate(TEMPLATES if templates is None else templates)]
    vocabulary = sorted({w for _, _, words in sets for w in words})

    low = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase).alias("low"))
    # One pass cuts words but keeps line ends.
    lined = low.select("row", "doc_id", F.regexp_replace("low", r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " ").alias("lined"))
    both = lined.select("row", "doc_id", "lined", F.trim(F.regexp_replace("lined", r"[ \n]+", "  ")).alias("flat"))
    both = both.select("row", "doc_id", "lined", F.concat(F.lit(" "), F.col("flat"), F.lit(" ")).alias("flat"), F.when(F.col("flat") == "", 0).otherwise(F.expr("(length(flat) - length(replace(flat, ' ', ''))) / 2 + 1")).cast("long").alias("n_words"))
    count = lambda text: F.floor((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / 2)
    places, firsts, lasts, marks = [], [], [], []
    for words, label in sorted(phrases.items()):
        spaced = _spaced(words)
        here = F.contains("flat", F.lit(spaced))
        places.append(F.when(here, F.floor((F.length("flat") - F.length(F.replace(F.col("flat"), F.lit(spaced), F.lit("")))) / len(spaced))).otherwise(0))
        firsts.append(F.when(here, count(F.substring_index("flat", spaced, 1))))
        lasts.append(F.when(here, F.col("n_words") - count(F.substring_index("flat", spaced, -1)) - len(words.split())))
        marks.append(F.when(here, F.lit(label)))
    none = F.lit(None).cast("long")
    pad = lambda cols: [*cols, none, none]  # noqa: E731  least and greatest take two columns at least
    lines = F.split("lined", "\n")
    block = lambda line: F.array_intersect(F.split(line, " "), F.array(*map(F.lit, vocabulary)))
    least = min((math.ceil(threshold * len(w) - 1e-9) for _, _, w in sets), default=1)
    # Which templates a whole text could hold, before its runs of words are looked at.
    cut = both.withColumn("cut", F.transform(lines, block) if vocabulary else F.array().cast("array<array<string>>")).withColumn("every", F.array_distinct(F.flatten("cut")))
    known = [F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, words)).alias("words"), F.lit(math.ceil(threshold * len(words) - 1e-9)).alias("need"), F.lit(math.ceil(len(text.split()) / threshold - 1e-9)).alias("span")) for (_, label, words), (_, text) in zip(sets, TEMPLATES if templates is None else templates, strict=True)]
    no_runs = F.array().cast("array<struct<label:string,share:double>>")
    if known:
        could = F.when(F.size("every") >= least, F.filter(F.array(*known), lambda t: F.size(F.array_intersect("every", t["words"])) >= t["need"]))
        cut = cut.withColumn("could", F.when(F.size(could) > 0, could))
        # One-element arrays bind a value once; a lambda would cut the text again for each of its words.
        once = lambda value, f: F.transform(F.array(value), f)[0]
        words_at = lambda ws, t: F.filter(F.transform(ws, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: F.array_contains(t["words"], x["w"]))
        ahead = lambda hits, h, a, t: F.array_distinct(F.transform(F.filter(F.slice(hits, a + 1, t["span"]), lambda x: x["i"] < h["i"] + t["span"]), lambda x: x["w"]))
        best = lambda ws, t: once(words_at(ws, t), lambda hits: F.array_max(F.transform(hits, lambda h, a: F.size(ahead(hits, h, a, t)))))
        share = lambda ws, t: once(best(ws, t), lambda n: F.when(n >= t["need"], n / F.size(t["words"])))
        runs = once(F.split(F.trim("flat"), "  "), lambda ws: F.transform("could", lambda t: F.struct(t["label"].alias("label"), share(ws, t).alias("share"))))
        runs = F.coalesce(F.when(F.col("could").isNotNull(), F.filter(runs, lambda x: x["share"].isNotNull())), no_runs)
    read = cut.select(
        "row", "doc_id", "n_words", (runs if known else no_runs).alias("runs"),
        sum(places, F.lit(0)).cast("long").alias("n_base"),
        F.least(*pad(firsts)).cast("long").alias("first_word"),
        F.greatest(*pad(lasts)).cast("long").alias("last_word"),
        F.array_distinct(F.array_compact(F.array(*marks, F.lit(None).cast("string")))).alias("base"),
        F.filter("cut", lambda b: F.size(b) >= least).alias("blocks"),
    )
    read = written(read, "license-blocks")

    # Global order of the template words: rarest first, then by word.
    blocks = read.select("row", F.posexplode("blocks").alias("block", "held"))
    seen = {r["w"]: r["n"] for r in blocks.select(F.explode("held").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    index = []
    for k, label, words in sets:
        need = math.ceil(threshold * len(words) - 1e-9)
        ordered = sorted(words, key=rank.get)
        index += [(w, k, label, need, len(words), ordered) for w in ordered[: len(words) - need + 1]]
    prefix = spark.createDataFrame(index, "w string, template int, label string, need int, size int, words array<string>")
    ranks = F.create_map(*[x for w, k in rank.items() for x in (F.lit(w), F.lit(k))]) if rank else F.create_map(F.lit(""), F.lit(0))
    prefix_words = F.array(*map(F.lit, sorted({x[0] for x in index} or {""})))
    keyed = blocks.where(F.arrays_overlap("held", prefix_words)).select(
        "row", "block", "held", F.transform(F.array_sort(F.transform("held", lambda w: F.struct(ranks[w].alias("k"), w.alias("w")))), lambda s: s["w"]).alias("ordered")
    )
    tokens = keyed.select("row", "block", "held", F.posexplode("ordered").alias("place", "w"))
    # Templates are a parameter of bounded size, held by every task.
    pairs = tokens.join(F.broadcast(prefix), "w").where((F.size("held") >= F.col("need")) & (F.size("held") - F.col("place") >= F.col("need")))
    shared = F.size(F.array_intersect("held", "words"))
    matched = pairs.where(shared >= F.col("need")).select("row", "label", (shared / F.col("size")).alias("share"))
    by_row = matched.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    joined = read.drop("blocks").join(by_row, "row", "left")
    empty = F.array().cast("array<string>")
    text = lambda labels: F.array_join(F.array_sort(labels), ",")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        text("base").alias("base_labels"),
        text(F.array_union(F.array_union("base", F.coalesce("more", empty)), F.transform("runs", lambda x: x["label"]))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.greatest(F.coalesce("share", F.lit(0.0)), F.coalesce(F.array_max(F.transform("runs", lambda x: x["share"])), F.lit(0.0)))).alias("score"),
    )
