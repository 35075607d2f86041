"""Greedy matching on a score, part by part of the sorted people.

Exposed people go by ascending score, each to the nearest free comparator. What a
part of them may take depends on what earlier parts have taken, so all parts are
solved at once against the latest pairs of the earlier ones, and those that can see a
change are solved again until nothing changes. The first part never depends on
another, so each round settles one part more at least; where comparators are not
scarce, changes die out within a few parts and so do the rounds.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.operators.compare import running_totals
from cohortloom.sources.tables import written

FOUND = "part long, exposed_id long, comparator_id long, short_left boolean, short_right boolean"


def greedy(ids: np.ndarray, treated: np.ndarray, x: np.ndarray, caliper: float) -> tuple[list[tuple[int, int]], bool, bool]:
    """(pairs, whether an exposed person found no free comparator below, and above): ties by the smaller id."""
    order = np.lexsort((ids, x))
    ids, treated, x = ids[order], treated[order], x[order]
    free_id, free_x = ids[treated == 0], x[treated == 0]
    n = len(free_id)
    below, above = list(range(n + 1)), list(range(n + 1))  # places shifted by one for below: 0 is none

    def find(links: list[int], k: int) -> int:
        root = k
        while links[root] != root:
            root = links[root]
        while links[k] != root:
            links[k], k = root, links[k]
        return root

    pairs, no_left, no_right = [], False, False
    for i, at, k in zip(ids[treated == 1], x[treated == 1], np.searchsorted(free_x, x[treated == 1]), strict=True):
        left, right = find(below, int(k)) - 1, find(above, int(k))
        no_left, no_right = no_left or left < 0, no_right or right == n
        near = []
        if left >= 0:  # of equal scores the smallest free id
            near.append(find(above, int(np.searchsorted(free_x, free_x[left]))))
        if right < n:
            near.append(right)
        if not near:
            continue
        best = min(near, key=lambda j: (abs(free_x[j] - at), free_id[j]))
        if abs(free_x[best] - at) <= caliper:
            pairs.append((int(i), int(free_id[best])))
            below[best + 1], above[best] = best, best + 1
    return pairs, no_left, no_right


def match(scored: DataFrame, scale: float = 0.2, part_rows: int = 50_000) -> DataFrame:
    """(exposed_id, comparator_id): greedy 1:1 matching without replacement inside the caliper (``scale`` deviations of the logit).

    A part is ``part_rows`` people next to each other; it is solved with the nearest
    free comparators on either side, at most as many as it has people, which bounds
    a group to three times that. The result is that of one pass over all people. The
    driver holds one row per part.
    """
    spark = scored.sparkSession
    logit = F.log(F.col("propensity_score") / (1 - F.col("propensity_score")))
    rows = scored.select(F.col("person_id").cast("long").alias("person_id"), F.col("treated").cast("int").alias("treated"), logit.alias("logit"))
    caliper = (rows.agg(F.stddev_samp("logit")).first()[0] or 0.0) * scale
    placed = running_totals(rows.withColumn("key", F.struct("logit", "person_id")).withColumn("one", F.lit(1)), "key", ["one"])
    people = written(placed.select("person_id", "treated", "logit", F.floor(F.col("one_before") / part_rows).alias("part")), "matching")
    exposed = F.col("treated") == 1
    edges = people.groupBy("part").agg(F.min("logit").alias("low"), F.max("logit").alias("high"), F.min(F.when(exposed, F.col("logit"))).alias("first"), F.max(F.when(exposed, F.col("logit"))).alias("last")).orderBy("part").collect()
    low, high = np.array([r["low"] for r in edges]), np.array([r["high"] for r in edges])
    # the parts that hold anybody inside the caliper of a part's exposed people
    span = {r["part"]: (int(np.searchsorted(high, r["first"] - caliper)), int(np.searchsorted(low, r["last"] + caliper, "right")) - 1) for r in edges if r["first"] is not None}
    reach = dict.fromkeys(span, 1)
    seen = lambda p: (max(span[p][0], p - reach[p]), min(span[p][1], p + reach[p]))
    taken_from = lambda p: (min(seen(p)[0], p), max(seen(p)[1], p))
    rounds, latest, known, active = [], {}, {}, sorted(span)  # what was found, and the round that a part was solved in last

    def pairs_of(parts):
        by_round = {k: [p for p in parts if latest[p] == k] for k in sorted({latest[p] for p in parts})}
        frames = [rounds[k].where(F.col("part").isin(mine) & F.col("exposed_id").isNotNull()).select("exposed_id", "comparator_id", "part") for k, mine in by_round.items()]
        return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], "exposed_id long, comparator_id long, part long")

    while active:
        links = [(q, p, (q > p) - (q < p)) for p in active for q in range(taken_from(p)[0], taken_from(p)[1] + 1)]
        # before the end two parts may want one comparator: the earlier one has it
        # a round reads the parts that it looks at, and the pairs of parts that may hold comparators of those
        sources = np.array(sorted({q for q, _, _ in links}))
        touching = [p for p in latest if np.searchsorted(sources, taken_from(p)[0]) < np.searchsorted(sources, taken_from(p)[1], "right")]
        takers = pairs_of(touching).groupBy(F.col("comparator_id").alias("person_id")).agg(F.min("part").alias("taker"))
        near = people.where(F.col("part").isin(sources.tolist())) if len(sources) < len(edges) else people
        joined = near.join(takers, "person_id", "left")
        dealt = joined.join(spark.createDataFrame(links, "part long, into long, side int"), "part").where((F.col("side") == 0) | ~exposed)
        free = dealt.where(exposed | F.col("taker").isNull() | (F.col("taker") >= F.col("into")))
        nearest = Window.partitionBy("into", "side").orderBy(F.col("logit") * F.col("side"), "person_id")
        around = free.where("side <> 0").withColumn("k", F.row_number().over(nearest)).where(F.col("k") <= part_rows).drop("k")
        # whether comparators inside the caliper lie beyond those that a part is given
        more = {p: (seen(p)[0] > span[p][0], seen(p)[1] < span[p][1]) for p in active}

        def solve(key, table):  # noqa: B023 (run before the next round)
            part = key[0].as_py()
            ids, treated, x, side = (table.column(c).to_numpy() for c in ("person_id", "treated", "logit", "side"))
            got, no_left, no_right = greedy(ids, treated, x, caliper)
            given = [int((side == s).sum()) < part_rows for s in (-1, 1)]
            flags = (no_left and more[part][0] and given[0], no_right and more[part][1] and given[1])
            a, b = [p[0] for p in got] + [None], [p[1] for p in got] + [None]
            n = len(got)
            return pa.table({"part": pa.array([part] * (n + 1), pa.int64()), "exposed_id": pa.array(a, pa.int64()), "comparator_id": pa.array(b, pa.int64()), "short_left": pa.array([None] * n + [flags[0]], pa.bool_()), "short_right": pa.array([None] * n + [flags[1]], pa.bool_())})

        found = written(free.where("side = 0").unionByName(around).groupBy("into").applyInArrow(solve, FOUND), "pairs-found")
        told = found.groupBy("part").agg(F.bool_or(F.coalesce(F.col("short_left") | F.col("short_right"), F.lit(False))).alias("short"), F.count("exposed_id").alias("n"), F.coalesce(F.bit_xor(F.when(F.col("exposed_id").isNotNull(), F.xxhash64("exposed_id", "comparator_id"))), F.lit(0)).alias("sum")).collect()
        short = [r["part"] for r in told if r["short"]]
        changed = [r["part"] for r in told if known.get(r["part"], (0, 0)) != (r["n"], r["sum"])]
        known |= {r["part"]: (r["n"], r["sum"]) for r in told}
        rounds.append(found)
        latest |= dict.fromkeys(active, len(rounds) - 1)
        for p in short:
            reach[p] *= 2
        touched = {q: seen(q)[1] for q in changed}
        active = sorted({p for p in span if any(q < p and far >= seen(p)[0] for q, far in touched.items())} | set(short))
    return written(pairs_of(sorted(latest)).select("exposed_id", "comparator_id"), "pairs")
