"""Bootstrap of aggregates: Poisson resampling of counted cells and of people.

A resample gives each person a Poisson(1) weight. The weights of the c people in
one cell of an aggregate add up to a Poisson(c) draw, so an aggregate with few
cells is resampled from its counts alone; replicates are dealt to tasks in blocks
and every block reads the cells once. Draws depend on seed and block only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 50


def replicate_cells(cells: DataFrame, keys: list[str], run: Callable[[dict, np.ndarray], np.ndarray], replicates: int, seed: int, count: str = "n", draw: Callable | None = None) -> DataFrame:
    """(rep, x): run(columns by name, counts drawn as (replicates, cells)) for every block of replicates.

    cells must be an aggregate of bounded size, as each task of a block holds it.
    draw(generator, counts, replicates) replaces the Poisson draw.
    Cells are ordered by keys first, so that draws do not depend on partitions.
    """

    def block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lo = int(key[0].as_py()) * BLOCK
        reps = np.arange(lo, min(lo + BLOCK, replicates))
        table = table.sort_by([(k, "ascending") for k in keys])
        columns = {k: table.column(k).to_numpy(zero_copy_only=False) for k in table.column_names if k not in ("block", count)}
        generator, counts = np.random.default_rng([seed, lo]), table.column(count).to_numpy()
        draws = draw(generator, counts, len(reps)) if draw else generator.poisson(counts, (len(reps), len(counts)))
        return pa.table({"rep": pa.array(reps), "x": pa.array(np.asarray(run(columns, draws), float), from_pandas=True)})

    blocks = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(replicates / BLOCK) - 1)))
    return cells.withColumn("block", blocks).groupBy("block").applyInArrow(block, "rep long, x double")


def percentile_limits(reps: DataFrame, replicates: int, level: float = 0.95) -> tuple[float, float]:
    """Percentile limits of x; refused when over half of the replicates (or all but 50) gave no number."""
    tail = (1 - level) / 2
    row = reps.where("x is not null and not isnan(x)").agg(F.count("*"), F.percentile("x", F.lit(tail)), F.percentile("x", F.lit(1 - tail))).first()
    if row[0] < max(min(50, replicates), replicates // 2):
        raise ValueError("too many replicates failed")
    return float(row[1]), float(row[2])


#: Upper ends of the weights 0, 1, ... among uniform numbers; the weight of every 1/65536 of them that holds no end, else -1.
STEPS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
_ENDS = [np.searchsorted(STEPS, (np.arange(1 << 16) + more) / (1 << 16) - less, "right") for more, less in ((0, 0.0), (1, 2.0**-53))]
WEIGHTS = np.where(_ENDS[0] == _ENDS[1], _ENDS[0], -1).astype(float)


def person_weights(ids: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """(people, replicates) Poisson(1) weights from a hash of (seed, replicate, person)."""
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + reps.astype(np.uint64)[None] * np.uint64(0xBF58476D1CE4E5B9) + np.uint64((seed * 0x94D049BB133111EB) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    out = WEIGHTS[(x >> np.uint64(48)).astype(np.int64)]
    near = out < 0
    out[near] = np.searchsorted(STEPS, (x[near] >> np.uint64(11)).astype(float) / (1 << 53), "right")
    return out
