"""Query registry: name -> (Spark builder, oracle SQL, output schema).

Every query declares its output columns once. The Spark result is cast to
that schema and doubles are rounded to ``DIGITS`` places; the SQL text is
wrapped the same way, so both engines hand back identical types and
comparable values.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 6
SCALE = float(10 ** DIGITS)
_SQL_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER",
              "double": "DOUBLE", "boolean": "BOOLEAN"}


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    schema: list[tuple[str, str]]
    sql: str | None
    ops: tuple = ()

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        cols = []
        for n, t in self.schema:
            c = F.col(f"`{n}`").cast(t)
            if t == "double":
                # round(x * 10^d) / 10^d rounds the same way in both engines
                c = F.round(c * SCALE, 0) / SCALE
            cols.append(c.alias(n))
        return df.select(*cols)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = []
        for n, t in self.schema:
            c = f'CAST(q."{n}" AS {_SQL_TYPES[t]})'
            if t == "double":
                c = f"round({c} * {SCALE!r}) / {SCALE!r}"
            cols.append(f'{c} AS "{n}"')
        return f"SELECT {', '.join(cols)}\nFROM (\n{self.sql}\n) q"


QUERIES: dict[str, Query] = {}


def parse_schema(s: str) -> list[tuple[str, str]]:
    out = []
    for part in s.split(","):
        n, t = part.strip().rsplit(" ", 1)
        out.append((n.strip(), t.strip()))
    return out


def register(name: str, schema: str, sql: str | None = None, ops: tuple = ()):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, parse_schema(schema), sql, ops)
        return fn
    return deco
