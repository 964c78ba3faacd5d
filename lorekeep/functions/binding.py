"""Name an intermediate value inside an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``; keeps long expressions from repeating their input."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
