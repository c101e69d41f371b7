"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def recode(c: str | Column, mapping: Mapping, default=None, keep_unmapped: bool = True) -> Column:
    """Map values in one pass (a swap {2: 1, 1: 2} is applied simultaneously).

    Unmapped values are kept (``keep_unmapped``) or replaced by ``default``.
    """
    c = col_of(c)
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    if expr is None:
        return c
    return expr.otherwise(c if keep_unmapped else F.lit(default))


def yes_no(c: str | Column, positive: str = "yes") -> Column:
    """Label text to 1/0 (null stays null)."""
    c = col_of(c)
    return F.when(c.isNull(), F.lit(None).cast("int")).when(c == positive, 1).otherwise(0)


def binarize(c: str | Column, threshold: float = 0.5) -> Column:
    """``score >= threshold`` as 0/1; a no-op on hard 0/1 labels."""
    return (col_of(c) >= F.lit(threshold)).cast("int")


def safe_div(num: Column, den: Column) -> Column:
    """Division that gives 0.0 when the denominator is 0 (ratios of counts)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def stars(p: str | Column) -> Column:
    """Significance marks at the 0.1 / 0.05 / 0.01 levels."""
    p = col_of(p)
    return (F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise(""))


def seeded_hash(id_col: str | Column, seed: int) -> Column:
    """Deterministic pseudo-random order key: hex md5 of ``id || seed``.

    md5 text is identical across engines, so a split made with it can be
    reproduced by plain SQL.
    """
    return F.md5(F.concat(col_of(id_col).cast("string"), F.lit(str(seed))))


@dataclass(frozen=True)
class Levels:
    """The 0/1 columns of a text column, one per level, taken as features
    without being written out; all are 0 for a null or unknown value."""
    column: str
    levels: tuple[str, ...]

    def number(self) -> Column:
        """The number of a row's level, from 1; 0 for none of them."""
        known = F.array(*[F.lit(v) for v in self.levels])
        return F.coalesce(F.array_position(known, F.col(self.column)), F.lit(0))


def rounded(c: str | Column, digits: int = 6) -> Column:
    return F.round(col_of(c).cast("double"), digits)
