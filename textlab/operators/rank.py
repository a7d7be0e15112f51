"""Exact global ranks without a single-partition window.

``row_number().over(Window.orderBy(...))`` moves every row into one task.
Instead rows get a *bucket* that is monotone in the sort order; buckets are
counted (partial aggregation), a running sum over the small bucket table gives
each bucket's offset, and ``row_number`` runs only inside a bucket:

    rank = offset(bucket) + row_number() over (partition by bucket order by ...)

The bucket table has at most ``2**20`` rows (hash order) or ``n_buckets``
rows (key order), so it is broadcast with a proven size bound.  Ranks are a
pure function of the data: repartitioning or re-running a lost task gives the
same ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from ..session import ensure_checkpoint_dir as ensure_checkpoint  # noqa: F401

# 20 bits -> at most 1,048,576 hash buckets: ~1M rows per bucket at 10^12
# rows, while the bucket-offset table stays under 1,048,576 rows (~25 MB),
# a proven bound for its broadcast.
HASH_BUCKET_HEX = 5
MAX_BROADCAST_BUCKETS = 1 << 20


def hash_order_col(seed, key: str | Column) -> Column:
    """md5 hex of 'seed:key' - the shuffle order used by every split."""
    return hash_key(seed, F.col(key) if isinstance(key, str) else key)


def hash_bucket(order_hex: Column, hex_digits: int = HASH_BUCKET_HEX) -> Column:
    """Leading hex digits of the order hash: monotone in the hash order."""
    return F.conv(F.substring(order_hex, 1, hex_digits), 16, 10).cast("int")


def _ranked(df: DataFrame, bucket, order: Sequence[Column], rank_col: str,
            partition_by: Sequence[str] = (), bounded_buckets: int | None = None) -> DataFrame:
    """Rank rows by ``order`` given bucket column(s) that are monotone in it.

    ``bucket`` is one Column (ascending) or a list of (Column, ascending)
    pairs compared lexicographically.
    """
    parts = list(partition_by)
    specs = [(bucket, True)] if isinstance(bucket, Column) else list(bucket)
    names = [f"__bucket{i}" for i in range(len(specs))]
    b = df
    for name, (expr, _) in zip(names, specs):
        b = b.withColumn(name, expr)
    sort = [F.col(n).asc() if asc else F.col(n).desc() for n, (_, asc) in zip(names, specs)]
    counts = b.groupBy(*parts, *names).agg(F.count(F.lit(1)).alias("__n"))
    w_off = Window.partitionBy(*parts).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*parts, *names, F.coalesce(F.sum("__n").over(w_off), F.lit(0)).alias("__offset"))
    if not parts and bounded_buckets is not None and bounded_buckets <= MAX_BROADCAST_BUCKETS:
        # at most ``bounded_buckets`` rows of (int, long): a proven bound
        offsets = F.broadcast(offsets)
    # otherwise the table grows with the group / bucket cardinality; AQE
    # broadcasts it at run time only when it is under the size threshold.
    j = b.join(offsets, [*parts, *names])
    w = Window.partitionBy(*parts, *names).orderBy(*order)
    return j.withColumn(rank_col, (F.col("__offset") + F.row_number().over(w)).cast("long")) \
            .drop(*names, "__offset")


def with_quantile_bucket(df: DataFrame, col: str, out: str, n_buckets: int = 1024,
                         rel_err: float = 1e-4) -> DataFrame:
    """Add ``out``: bucket id of numeric ``col`` by approximate quantiles.

    The quantile sketch is a distributed aggregate; only ``n_buckets`` bounds
    reach the driver.  ``Bucketizer`` finds the bucket by binary search in the
    JVM.  Equal values always share a bucket, so the bucket is monotone in
    ``col``.
    """
    if n_buckets < 2:
        return df.withColumn(out, F.lit(0))
    probs = [i / n_buckets for i in range(1, n_buckets)]
    bounds = df.select(F.col(col).cast("double").alias("k")).approxQuantile("k", probs, rel_err)
    splits = [float("-inf")] + sorted(set(b for b in bounds if b is not None)) + [float("inf")]
    if len(splits) < 3:       # empty table or a single value: one bucket
        return df.withColumn(out, F.lit(0))
    kd = df.withColumn("__qk", F.col(col).cast("double"))
    kd = Bucketizer(splits=splits, inputCol="__qk", outputCol="__qb", handleInvalid="keep").transform(kd)
    return kd.withColumn(out, F.col("__qb").cast("int")).drop("__qk", "__qb")


def running_total(df: DataFrame, order: str, value: str, out: str, descending: bool = False,
                  n_buckets: int = 256) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in ``order``
    (numeric, unique), in two levels: within key ranges, and over the ranges' sums."""
    b = with_quantile_bucket(df, order, "__rb", n_buckets, 1e-3)
    def by(c):
        return F.col(c).desc() if descending else F.col(c).asc()

    sums = b.groupBy("__rb").agg(F.sum(value).alias("__s"))           # at most n_buckets rows
    w = Window.orderBy(by("__rb")).rowsBetween(Window.unboundedPreceding, -1)
    sums = F.broadcast(sums.select("__rb", F.coalesce(F.sum("__s").over(w), F.lit(0)).alias("__base")))
    inner = Window.partitionBy("__rb").orderBy(by(order)).rowsBetween(Window.unboundedPreceding, -1)
    return (b.withColumn("__inner", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(sums, "__rb")
            .withColumn(out, F.col("__base") + F.col("__inner")).drop("__rb", "__inner", "__base"))


def hash_rank(df: DataFrame, key: str, seed, rank_col: str = "rank",
              partition_by: Sequence[str] = ()) -> DataFrame:
    """1..n rank in seeded-permutation order (md5('seed:key'), key).

    ``key`` must be unique (within ``partition_by``).  With ``partition_by``
    the rank restarts per group, still without putting a hot group in one
    task: each group is split into up to 1,048,576 hash buckets.
    """
    h = hash_order_col(seed, key)
    return _ranked(df.withColumn("__h", h), hash_bucket(F.col("__h")), [F.col("__h"), F.col(key)],
                   rank_col, partition_by, bounded_buckets=1 << (4 * HASH_BUCKET_HEX)).drop("__h")


def key_rank(df: DataFrame, key: str, rank_col: str = "rank", n_buckets: int = 4096,
             rel_err: float = 1e-4) -> DataFrame:
    """1..n rank in ``key`` order (stored order).  ``key`` must be numeric and
    unique.  Buckets are key ranges from approximate quantiles, so each holds
    about n / n_buckets rows; the bucket table has at most n_buckets rows."""
    kd = with_quantile_bucket(df, key, "__kb", n_buckets, rel_err)
    return _ranked(kd, F.col("__kb"), [F.col(key)], rank_col, bounded_buckets=n_buckets).drop("__kb")


def with_count(df: DataFrame, name: str = "__total", partition_by: Sequence[str] = ()) -> DataFrame:
    """Attach the row count (of the whole table, or per group) as a column.

    Whole table: a scalar subquery.  Per group: an aggregate joined back on the
    group keys (AQE picks broadcast when the group table is small).
    """
    if not partition_by:
        return df.withColumn(name, df.agg(F.count(F.lit(1))).scalar())
    counts = df.groupBy(*partition_by).agg(F.count(F.lit(1)).alias(name))
    return df.join(counts, list(partition_by))


#: Buckets whose sizes are added up in one task before the sums of those runs are.
RUN = 1 << 10


def _cut_rows(keys: DataFrame, order: Sequence[str], wanted: Sequence, total: Column) -> Column:
    """Map i -> order value (a struct) of the row with the i-th wanted rank, from one plan
    (a scalar subquery; a rank of 0 has no entry).

    ``keys`` has ``__b`` (a bucket monotone in the order) and the order columns.
    Buckets are counted, those that hold a wanted rank are found on that bounded
    table (running sums in two levels), and only their keys are ranked.  No other
    column moves.
    """
    counts = keys.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")).withColumn("__run", F.floor(F.col("__b") / RUN))
    runs = counts.groupBy("__run").agg(F.sum("__n").alias("__s"))     # at most MAX_BROADCAST_BUCKETS / RUN rows
    earlier = Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = F.broadcast(runs.select("__run", F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__base")))
    inside = Window.partitionBy("__run").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__base") + F.coalesce(F.sum("__n").over(inside), F.lit(0))
    table = counts.join(runs, "__run").select("__b", "__n", before.alias("__before"))
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.greatest(size(total).cast("long"), F.lit(0)).alias("place")) for i, size in enumerate(wanted)])
    hits = table.select("__b", "__n", "__before", F.explode(places).alias("__w")).where(
        (F.col("__before") < F.col("__w.place")) & (F.col("__w.place") <= F.col("__before") + F.col("__n")))
    hits = hits.select("__b", F.col("__w.i").alias("__i"), (F.col("__w.place") - F.col("__before")).alias("__at"))  # one row a wanted rank, none for rank 0
    held = keys.join(F.broadcast(hits.select("__b").distinct()), "__b")
    ranked = held.withColumn("__rn", F.row_number().over(Window.partitionBy("__b").orderBy(*order)))
    found = ranked.join(F.broadcast(hits.withColumnRenamed("__b", "__hb")), (F.col("__b") == F.col("__hb")) & (F.col("__rn") == F.col("__at")))
    return found.agg(F.map_from_entries(F.collect_list(F.struct("__i", F.struct(*order)))).alias("cuts")).scalar()


def hash_cuts(df: DataFrame, key: str, seed, *wanted, total: Column) -> tuple[Column, list[Column]]:
    """(order, cuts): a row's place in the seeded order, as a comparable struct, and
    for each ``wanted`` (a function of the row count) the struct of the row with
    that rank: exactly that many rows have ``order <= cut`` (null cut: none).

    A split is then a comparison with one value; rows are neither ranked nor moved.
    """
    keys = df.select(hash_order_col(seed, key).alias("__h"), F.col(key).alias("__k"))
    cuts = _cut_rows(keys.withColumn("__b", hash_bucket(F.col("__h"))), ["__h", "__k"], wanted, total)
    return F.struct(hash_order_col(seed, key).alias("__h"), F.col(key).alias("__k")), [cuts[F.lit(i)] for i in range(len(wanted))]


def group_cuts(df: DataFrame, key: str, group: str, seed, wanted) -> tuple[Column, DataFrame]:
    """(order, cuts): as ``hash_cuts``, one cut for each group: cuts has (__g, cut), where
    ``wanted`` is a function of the group's row count.  A large group is counted in many
    buckets, of which one is ranked; cuts has a row a group (none for a wanted rank of 0)."""
    keys = df.select(F.col(group).alias("__g"), hash_order_col(seed, key).alias("__h"), F.col(key).alias("__k"))
    keys = keys.withColumn("__b", hash_bucket(F.col("__h")))
    counts = keys.groupBy("__g", "__b").agg(F.count(F.lit(1)).alias("__n"))
    every = Window.partitionBy("__g")
    table = counts.select("__g", "__b", "__n", F.coalesce(F.sum("__n").over(every.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
                          wanted(F.sum("__n").over(every)).cast("long").alias("__place"))
    hit = table.where((F.col("__before") < F.col("__place")) & (F.col("__place") <= F.col("__before") + F.col("__n"))).select(
        F.col("__g").alias("__hg"), F.col("__b").alias("__hb"), (F.col("__place") - F.col("__before")).alias("__at"))
    inside = keys.join(hit, F.col("__g").eqNullSafe(F.col("__hg")) & (F.col("__b") == F.col("__hb")))
    ranked = inside.withColumn("__rn", F.row_number().over(Window.partitionBy("__g", "__b").orderBy("__h", "__k")))
    cuts = ranked.where(F.col("__rn") == F.col("__at")).select("__g", F.struct("__h", "__k").alias("cut"))
    return F.struct(hash_order_col(seed, key).alias("__h"), F.col(key).alias("__k")), cuts


def _key_cut_map(df: DataFrame, key: str, wanted: Sequence, total: Column, n_buckets: int) -> tuple[Column, Column]:
    keys = with_quantile_bucket(df.select(F.col(key).alias("__k")), "__k", "__b", n_buckets)
    return F.struct(F.col(key).alias("__k")), _cut_rows(keys, ["__k"], wanted, total)


def key_cuts(df: DataFrame, key: str, *wanted, total: Column, n_buckets: int = 4096) -> tuple[Column, list[Column]]:
    """As ``hash_cuts``, in the order of the (numeric, unique) key."""
    order, cuts = _key_cut_map(df, key, wanted, total, n_buckets)
    return order, [cuts[F.lit(i)] for i in range(len(wanted))]


def key_cuts_passed(df: DataFrame, key: str, *wanted, total: Column, n_buckets: int = 4096) -> Column:
    """How many of the ``wanted`` cuts a row lies behind, in the order of the key; the cuts
    stand in the plan once, however many there are."""
    order, cuts = _key_cut_map(df, key, wanted, total, n_buckets)
    place = F.array_position(F.sort_array(F.concat(F.map_values(cuts), F.array(order))), order) - 1  # among the cuts
    return place + len(wanted) - F.size(cuts)


def up_to(order: Column, cut: Column) -> Column:
    return F.coalesce(order <= cut, F.lit(False))
