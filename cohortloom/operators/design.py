"""Model designs: numbers as they are, categories as dummies, constants dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

MAX_LEVELS = 100


def design(frame: DataFrame, covariates: list[str], missing: str = "drop", prefix: str = "_x_") -> tuple[DataFrame, dict[str, str]]:
    """(frame with design columns, {design column: term}).

    Text and boolean covariates become 0/1 columns of their sorted levels but the
    first; more than MAX_LEVELS levels are refused, as the levels are named in
    the plan. missing: ``drop`` leaves incomplete rows out; ``flag`` fills numbers
    with their median beside a 0/1 flag and makes ``Missing`` a level. Columns
    without variation are dropped; a design without any is refused.
    """
    types = {f.name: f.dataType for f in frame.schema}
    numbers = [c for c in covariates if isinstance(types[c], NumericType)]
    categories = [c for c in covariates if c not in numbers]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("Missing")) if missing == "flag" else F.col(c).cast("string")
    rows = frame if missing == "flag" else frame.dropna(subset=covariates) if covariates else frame
    facts = rows.agg(
        F.count("*").alias("n"),
        *[e.alias(f"{k}_{c}") for c in numbers for k, e in (("nulls", F.count_if(F.col(c).isNull())), ("lo", F.min(c)), ("hi", F.max(c)))],
        *[F.approx_count_distinct(text(c)).alias(f"levels_{c}") for c in categories],
    ).first()
    wide = [c for c in categories if facts[f"levels_{c}"] > 2 * MAX_LEVELS]
    if wide:
        raise ValueError(f"too many levels: {', '.join(wide)}")
    # an exact median gathers all distinct values in one task: only of columns that have something to fill
    gaps = [c for c in numbers if 0 < facts[f"nulls_{c}"] < facts["n"]]
    medians = rows.agg(*[F.percentile(F.col(c).cast("double"), F.lit(0.5)).alias(c) for c in gaps]).first().asDict() if gaps else {}
    columns: dict[str, tuple] = {}
    for c in covariates:
        if c in numbers:
            x, filled = F.col(c).cast("double"), medians.get(c)
            if missing == "flag":
                x = F.coalesce(x, F.lit(filled if filled is not None else 0.0))
                if 0 < facts[f"nulls_{c}"] < facts["n"]:
                    columns[f"{c}_missing"] = (F.col(c).isNull().cast("double"), f"{c}_missing")
            varies = facts[f"lo_{c}"] is not None and (facts[f"lo_{c}"] != facts[f"hi_{c}"] or (missing == "flag" and facts[f"nulls_{c}"] and filled != facts[f"lo_{c}"]))
            if varies:
                columns[c] = (x, c)
            continue
        levels = [r[0] for r in rows.select(text(c).alias("v")).distinct().orderBy("v").limit(MAX_LEVELS + 1).collect()]
        if len(levels) > MAX_LEVELS:
            raise ValueError(f"too many levels: {c}")
        columns |= {f"{c}_{k}": ((text(c) == level).cast("double"), f"{c}_{level}") for k, level in enumerate(levels) if k}
    if covariates and not columns:
        raise ValueError("no covariate varies")
    return rows.withColumns({prefix + k: e for k, (e, _) in columns.items()}), {prefix + k: term for k, (_, term) in columns.items()}
