"""Registry of named queries and their oracle SQL.

Each query is a callable ``(spark, sf_dir) -> DataFrame``. Its SQL twin (if
the operator is SQL-expressible) is written against a ``clients`` CTE that
mirrors :func:`callsheet.sources.clients.clients`. Doubles listed in ``rnd``
are rounded to 6 places on both sides so float summation order does not
change the value hash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsheet.sources.clients import clients_sql


@dataclass
class Spec:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    rnd: tuple[str, ...] = field(default_factory=tuple)
    digits: int = 6


REGISTRY: dict[str, Spec] = {}


def query(name: str, sql: str | None = None, rnd: tuple[str, ...] | list[str] = (), digits: int = 6):
    def deco(fn):
        REGISTRY[name] = Spec(fn, sql, tuple(rnd), digits)
        return fn
    return deco


def _round_cols(df: DataFrame, cols: tuple[str, ...], digits: int = 6) -> DataFrame:
    if not cols:
        return df
    return df.select(*[F.round(F.col(c).cast("double"), digits).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for name, spec in REGISTRY.items():
        def run(spark, sf_dir, _spec=spec):
            return _round_cols(_spec.fn(spark, sf_dir), _spec.rnd, _spec.digits)
        out[name] = run
    return out


def oracle_sqls() -> dict[str, str]:
    out = {}
    for name, spec in REGISTRY.items():
        if spec.sql is None:
            continue
        if spec.rnd:
            repl = ", ".join(f"round(CAST({c} AS DOUBLE), {spec.digits}) AS {c}" for c in spec.rnd)
            body = f"SELECT * REPLACE ({repl}) FROM ({spec.sql}) AS _q"
        else:
            body = f"SELECT * FROM ({spec.sql}) AS _q"
        out[name] = f"WITH clients AS ({clients_sql()}) {body}"
    return out


# --------------------------------------------------------------------------
# SQL text helpers for the oracle side
# --------------------------------------------------------------------------

def long_sql(src: str, cols, keep=(), as_text=True) -> str:
    """(keep..., feature, value) as UNION ALL of one SELECT per column."""
    vtype = "VARCHAR" if as_text else "DOUBLE"
    k = "".join(f"{c}, " for c in keep)
    return " UNION ALL ".join(
        f"SELECT {k}'{c}' AS feature, CAST({c} AS {vtype}) AS value FROM {src}" for c in cols)


def typed_long_sql(src: str, cols, numeric, keep=()) -> str:
    k = "".join(f"{c}, " for c in keep)
    parts = []
    for c in cols:
        if c in numeric:
            parts.append(f"SELECT {k}'{c}' AS feature, CAST({c} AS DOUBLE) AS num_value, "
                         f"CAST(NULL AS VARCHAR) AS str_value FROM {src}")
        else:
            parts.append(f"SELECT {k}'{c}' AS feature, CAST(NULL AS DOUBLE) AS num_value, "
                         f"CAST({c} AS VARCHAR) AS str_value FROM {src}")
    return " UNION ALL ".join(parts)
