"""Runs a query and its oracle on one data folder and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

from cohortloom.testbed import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return db


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rounded(value):
    """What rows are sorted by: floats roughly, so that the last digits do not change the order."""
    if isinstance(value, float):
        return float(f"{value:.6g}") + 0.0
    return tuple(map(rounded, value)) if isinstance(value, tuple) else value


def same(a, b):
    """Equal values; floats within a billionth of the greater, or 1e-6 of nothing."""
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6)
    return a == b


class Table:
    """Rows without order; sums of floats may differ in their last digits."""

    def __init__(self, columns, rows):
        self.columns, self.rows = columns, rows

    def __eq__(self, other):
        return self.columns == other.columns and not self.differences(other)

    def differences(self, other, most=5):
        """The first rows without a partner."""
        if len(self.rows) != len(other.rows):
            mine, theirs = ({repr(rounded(r)) for r in t.rows} for t in (self, other))
            return [f"{len(self.rows)} and {len(other.rows)} rows", sorted(mine - theirs)[:most], sorted(theirs - mine)[:most]]
        return [(a, b) for a, b in zip(self.rows, other.rows, strict=True) if not same(a, b)][:most]


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cells = [tuple(plain(r[k]) for k in order) for r in rows]
    key = lambda r: (repr([v for v in r if not isinstance(v, float)]), repr(rounded(r)))
    return Table(sorted(columns), sorted(cells, key=key))


def spark_rows(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(db, sql):
    got = db.execute(sql)
    return table([c[0] for c in got.description], got.fetchall())
