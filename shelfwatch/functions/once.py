"""A value used more than once in an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is computed once however often f names it: branches and array functions repeat their arguments."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
