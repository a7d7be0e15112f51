"""Output rounding that two engines agree on.

Spark's ``round`` rounds the shortest decimal form half-up (0.575 -> 0.58);
DuckDB and numpy scale the binary value and round it (0.575 -> 0.57).  Both
engines compute ``x * 10**d`` identically (one IEEE multiplication), so
rounding that product half-even and dividing back gives the same double in
Spark (``rint``) and DuckDB (``round_even``).  It is also numpy's rounding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rround(x, digits: int = 6) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    scale = float(10 ** digits)
    return F.rint(c.cast("double") * F.lit(scale)) / F.lit(scale)
