"""A value that several parts of an expression need, computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``value`` is computed once per row however often ``use`` mentions it.

    Branches of a CASE share nothing that Spark computes; a lambda's argument is a value already.  Long chains also stay
    out of the one method that Spark generates for a stage, which the JVM does not compile beyond 8,000 bytes.
    """
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))
