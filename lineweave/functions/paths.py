"""Access paths as columns: base variable and fields of an expression such as `a.b`, `p->f`, `buf[i]`, `(*p).f`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(expression: Column) -> Column:
    """The path with `.` between its steps; any subscript is the step `[]`, and a dereference is dropped."""
    e = F.regexp_replace(F.trim(expression), r"^[*&]+|[()]|(?<=\()\*", "")
    e = F.regexp_replace(F.regexp_replace(e, r"^\*+", ""), r"->", ".")
    return F.regexp_replace(F.regexp_replace(e, r"\[[^\]]*\]", ".[]"), r"\s+", "")


def base(expression: Column) -> Column:
    return F.element_at(F.split(normal(expression), r"\."), 1)


def fields(expression: Column) -> Column:
    parts = F.split(normal(expression), r"\.")
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def compatible(a: Column, b: Column) -> Column:
    """Equal paths, or equal bases where one of them has no fields."""
    return F.when((F.size(fields(a)) > 0) & (F.size(fields(b)) > 0), normal(a) == normal(b)).otherwise(base(a) == base(b))
