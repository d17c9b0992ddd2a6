"""Compare a registered query with its SQL twin."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

DATA = Path("/root/testdata")
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object)
    out = df.map(lambda v: None if pd.isna(v) else v.item() if hasattr(v, "item") else v).astype(object)
    out = out.where(out.notna(), None)
    return out.sort_values(list(out.columns), key=lambda s: s.map(repr)).reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> list[str]:
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"]
    a, b = _plain(got), _plain(want)
    out = []
    for c in a.columns:
        unequal = [(x, y) for x, y in zip(a[c], b[c]) if x != y]
        if unequal:
            out.append(f"{c}: {len(unequal)} differ, such as {unequal[:2]}")
        kinds = ({type(v) for v in a[c]} - {type(None)}, {type(v) for v in b[c]} - {type(None)})
        if kinds[0] != kinds[1]:
            out.append(f"{c}: types {kinds}")
    return out
