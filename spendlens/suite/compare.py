"""Order-insensitive comparison of a Spark result with a DuckDB oracle result
(both as pandas frames): same column names, same multiset of rows after
normalising nulls/NaN, numbers and timestamps."""

from __future__ import annotations

import collections
import math

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return norm(v.item())
        except Exception:  # noqa: BLE001
            pass
    if hasattr(v, "isoformat"):
        return str(v)[:19].replace("T", " ")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(norm(x) for x in v.tolist())
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if v is getattr(__import__("pandas"), "NaT", object()):
        return None
    return v


def rows(pdf):
    cols = sorted(pdf.columns)
    out = collections.Counter()
    for rec in pdf[cols].itertuples(index=False):
        out[repr(tuple(norm(x) for x in rec))] += 1
    return cols, out


def compare(spark_pdf, oracle_pdf) -> str | None:
    """None when equal, else a short description of the difference."""
    sc, sr = rows(spark_pdf)
    oc, orr = rows(oracle_pdf)
    if sc != oc:
        return f"columns spark={sc} oracle={oc}"
    if sr != orr:
        return (f"rows spark={len(spark_pdf)} oracle={len(oracle_pdf)} "
                f"spark-only={list((sr - orr).elements())[:3]} oracle-only={list((orr - sr).elements())[:3]}")
    return None


def duck_connection(sf_dir: str):
    import os

    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con
