"""Repeatable uniform draws from md5, computable identically in SQL.

u = int(first 13 hex digits of md5(parts joined by '-')) / 2**52, in [0, 1).
DuckDB: CAST('0x' || substr(md5(...), 1, 13) AS BIGINT) / 4503599627370496.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2 ** 52)


def md5_uniform(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    h = F.md5(F.concat_ws("-", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint").cast("double") / TWO_52


def md5_uniform_sql(*parts: str) -> str:
    inner = " || '-' || ".join(parts)
    return f"(CAST('0x' || substr(md5({inner}), 1, 13) AS BIGINT) / 4503599627370496e0)"
