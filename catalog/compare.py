"""Comparison of a Spark result with its SQL twin."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _kind(series: pd.Series) -> str:
    return {"i": "int", "u": "int", "f": "float", "b": "bool"}.get(series.dtype.kind, "other")


def same(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None if both hold the same rows in any order, otherwise the first difference found."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    cols = sorted(got.columns)
    got, want = got[cols], want[cols]
    for c in cols:
        if len(got) and got[c].notna().all() and want[c].notna().all() and _kind(got[c]) != _kind(want[c]):
            return f"type of {c}: {got[c].dtype} != {want[c].dtype}"

    def rows(df):
        return sorted(tuple("NULL" if pd.isna(x) else repr(float(x)) if isinstance(x, float) else str(x) for x in r)
                      for r in df.itertuples(index=False, name=None))

    for a, b in zip(rows(got), rows(want)):
        if a != b:
            return f"values {dict(zip(cols, a))} != {dict(zip(cols, b))}"
    return None
