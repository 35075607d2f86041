"""Mixing sources to target weights by temperature, in DataFrame operations only.

A source's weight is its token share to the power x, normalised; x = 1 keeps
the natural mixture, x = 0 makes it uniform and x above 1 sharpens it. The
entropy falls as x grows; the largest repetition of a source falls up to x = 1
and grows from there. The exponent is found by narrowing a bracket: each round
evaluates a row of exponents in one aggregation over the sources and keeps the
step that holds the target, which is bisection with more than two parts. The
target is a share of the largest entropy; the exponent is the largest that
reaches it. A repetition limit then moves the exponent towards 1 until no source
is repeated more often; a budget above the limit has no exponent and is an
error.

Weights become token budgets. A source's budget is spent in epochs; every epoch
permutes the source's blocks of documents and the documents inside each block
by hashes, so an order can be made again from the seed. Offsets come from sums of
groups of blocks, of blocks inside one group and of documents inside one block,
and sources meet their plan by source and salt: a source with a third of all
rows is many small windows and keys. The last epoch stops before its budget
would be passed.

Edges: null sources are the source ''; null and empty texts hold no token and
are not placed; an empty table gives no row; repeated rows are placed each; one
source keeps weight 1; where sources of the same size keep the entropy above the
target at every exponent, the natural mixture stays and ``target_met`` is false;
extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.shared import written

STEPS, ROUNDS = 16, 10
#: Exponents above this leave nothing but the largest sources.
HIGHEST = 64.0
SALTS = 64


def _sums(sources: DataFrame, xs: list[float]) -> list[tuple]:
    """For each exponent: (x, sum of powers, sum of powers times log share, smallest and largest share, number of sources)."""
    power = [F.exp(F.lit(x) * F.log("share")) for x in xs]
    sums = [F.sum(p) for p in power] + [F.sum(p * F.log("share")) for p in power] + [F.min("share"), F.max("share"), F.count("*")]
    row = sources.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()
    return [(x, row[k], row[k + len(xs)], *row[-3:]) for k, x in enumerate(xs)]


def _bracket(sources: DataFrame, holds, low: float, high: float) -> float | None:
    """The end of a bracket of exponents at which holds(...) becomes true on the way from low to high; None if it does not at high."""
    for _ in range(ROUNDS):
        xs = [low + (high - low) * k / STEPS for k in range(STEPS + 1)]
        ok = [holds(*s) for s in _sums(sources, xs)]
        if not ok[-1]:
            return None
        k = ok.index(True)
        if k == 0:
            return xs[0]
        low, high = xs[k - 1], xs[k]
    return high


def find_exponent(sources: DataFrame, target_entropy: float | None, max_repetition: float | None, budget: float) -> tuple[float, bool]:
    """(exponent, whether the target is met) for sources with a share."""

    def below(x, z, zl, least, most, n):
        return math.log(z) - x * zl / z < target_entropy * math.log(n)

    def within(x, z, zl, least, most, n):
        return budget * max(math.exp((x - 1) * math.log(s)) for s in (least, most)) / z <= max_repetition * (1 + 1e-9)

    exponent, met = 1.0, True
    if target_entropy is not None and sources.count() > 1:
        found = _bracket(sources, below, 0.0, 1.0)
        found = _bracket(sources, below, 1.0, HIGHEST) if found is None else found
        exponent, met = (1.0, False) if found is None else (found, True)
    elif target_entropy is None and max_repetition is not None:
        exponent = 0.0
    if max_repetition is not None:
        if not within(*_sums(sources, [1.0])[0]):
            raise ValueError(f"no exponent keeps every source within {max_repetition} uses at a budget of {budget}")
        limited = _bracket(sources, within, exponent, 1.0)
        met &= limited == exponent or target_entropy is None
        exponent = limited
    return exponent, met


def source_weights(docs: DataFrame, target_entropy: float | None, max_repetition: float | None, budget: float) -> DataFrame:
    """docs (source, n_tokens) → (source, tokens, docs, share, weight, spend, exponent, target_met)."""
    sources = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    total = sources.agg(F.sum("tokens").alias("all"))
    sources = written(sources.crossJoin(F.broadcast(total)).select("source", "tokens", "docs", "all", (F.col("tokens") / F.col("all")).alias("share")), "sources")
    exponent, met = find_exponent(sources, target_entropy, max_repetition, budget) if not sources.isEmpty() else (1.0, True)
    power = F.exp(F.lit(exponent) * F.log("share"))
    weighted = sources.crossJoin(F.broadcast(sources.agg(F.sum(power).alias("z")))).withColumn("weight", power / F.col("z"))
    spend = F.round(F.col("weight") * F.col("all") * budget).cast("long")
    return weighted.select("source", "tokens", "docs", "share", "weight", spend.alias("spend"), F.lit(float(exponent)).alias("exponent"), F.lit(bool(met)).alias("target_met"))


def mix_sources(
    docs: DataFrame, target_entropy: float | None = 0.95, max_repetition: float | None = 4.0, budget: float = 1.0, block_docs: int = 256, group_blocks: int = 256, seed: int = 11
) -> DataFrame:
    """(doc_id, source, epoch, block, token_start, n_tokens, weight, exponent, target_met): one row for each time a document is used.

    budget is in multiples of the corpus's tokens; token_start is the offset
    inside the source's epoch, whose order it gives. A source has groups of about
    group_blocks blocks of about block_docs documents.
    """
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), words.alias("n_tokens"))
    rows = written(rows.where("n_tokens > 0"), "token-counts")
    plan = source_weights(rows, target_entropy, max_repetition, budget)
    plan = plan.select("source", "weight", "exponent", "target_met", "tokens", "spend", F.floor(F.col("spend") / F.col("tokens")).cast("int").alias("full"), F.ceil(F.col("docs") / block_docs).alias("blocks"))
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    spread = F.xxhash64(F.lit(seed), "doc_id", "n_tokens")
    used = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["source", "salt"]).drop("salt")
    used = used.withColumn("block", F.pmod(spread, F.col("blocks"))).withColumn("epoch", F.explode(F.sequence(F.lit(0), "full")))
    # The block's place is a number below 2^32; groups are equal ranges of it, so all blocks of an earlier group come first.
    place = F.pmod(F.xxhash64(F.lit(seed), "epoch", "source", "block"), F.lit(1 << 32))
    parts = F.ceil(F.col("blocks") / group_blocks)
    used = used.withColumn("place", place).withColumn("group", F.floor(F.col("place") * parts / F.lit(1 << 32)))
    epoch, before = ["source", "epoch"], (Window.unboundedPreceding, 0)
    blocks = used.groupBy(*epoch, "group", "place", "block").agg(F.sum("n_tokens").alias("held"))
    groups = blocks.groupBy(*epoch, "group").agg(F.sum("held").alias("held"))
    ahead = F.sum("held").over(Window.partitionBy(*epoch).orderBy("group").rowsBetween(*before)) - F.col("held")
    groups = groups.select(*epoch, "group", ahead.alias("group_start"))
    ahead = F.sum("held").over(Window.partitionBy(*epoch, "group").orderBy("place", "block").rowsBetween(*before)) - F.col("held")
    blocks = blocks.withColumn("ahead", ahead).join(groups, [*epoch, "group"])
    blocks = blocks.select(*epoch, "group", "block", (F.col("group_start") + F.col("ahead")).alias("block_start"))
    inside = Window.partitionBy(*epoch, "group", "block").orderBy(F.xxhash64(F.lit(seed), "epoch", "doc_id"), "doc_id", "n_tokens").rowsBetween(*before)
    placed = used.join(blocks, [*epoch, "group", "block"])
    placed = placed.withColumn("token_start", F.col("block_start") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    rest = F.col("spend") - F.col("full").cast("long") * F.col("tokens")
    placed = placed.where((F.col("epoch") < F.col("full")) | (F.col("token_start") + F.col("n_tokens") <= rest))
    return placed.select("doc_id", "source", "epoch", "block", "token_start", "n_tokens", "weight", "exponent", "target_met")
