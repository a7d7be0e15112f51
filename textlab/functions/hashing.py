"""Keyed pseudo-randomness.

``F.rand(seed)`` depends on how rows fall into partitions, so a re-run after an
executor loss or a different partitioning can give other rows.  Every random
choice here is a pure function of (seed, row key, position):

    u = int(first 8 hex digits of md5("seed:key:...")) / 2**32   in [0, 1)

which DuckDB reproduces exactly with ``md5`` and a hex cast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def hash_key(seed, *parts) -> Column:
    """md5 hex of 'seed:part1:part2...'; columns or literals."""
    cols = [F.lit(str(seed))] + [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def hash_uniform(seed, *parts) -> Column:
    """Uniform double in [0, 1) from the key (see module doc)."""
    return F.conv(F.substring(hash_key(seed, *parts), 1, 8), 16, 10).cast("double") / TWO_32
