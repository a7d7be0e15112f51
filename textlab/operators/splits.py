"""Exact, seeded, partition-independent sampling and splitting.

A split of the whole table compares each row's place in the order with the
place of one row, found by counting (``rank.hash_cuts`` for shuffled order,
``key_cuts`` for stored order), so no row is moved.  Where every row needs its
rank it is ``rank.hash_rank`` or ``key_rank``.
Sizes are exact (``randomSplit``/``sample`` are only approximate), disjoint and
complete, and a re-run on any partitioning gives the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform
from ..sources.files import stored
from . import rank as R


def _n(df: DataFrame) -> Column:
    return F.lit(df.agg(F.count(F.lit(1))).scalar())


def shuffle(df: DataFrame, key: str, seed=42, rank_col: str = "rank") -> DataFrame:
    """Seeded permutation: ``rank`` is the row's position after shuffling."""
    return R.hash_rank(df, key, seed, rank_col)


def sample_frac(df: DataFrame, key: str, frac: float, seed=42) -> DataFrame:
    """Exactly round-half-even(frac * n) rows without replacement."""
    order, (cut,) = R.hash_cuts(df, key, seed, lambda n: F.bround(n * F.lit(frac), 0), total=_n(df))
    return df.where(R.up_to(order, cut))


def holdout_split(df: DataFrame, key: str, ratio: float, seed=42, split_col: str = "split") -> DataFrame:
    """Shuffle; the first int(n * ratio) rows validate, the others train."""
    order, (cut,) = R.hash_cuts(df, key, seed, lambda n: F.floor(n * F.lit(ratio)), total=_n(df))
    return df.withColumn(split_col, F.when(R.up_to(order, cut), "val").otherwise("train"))


def split_frac(df: DataFrame, key: str, train_frac: float = 0.8, seed=42, rounding: str = "floor",
               split_col: str = "split") -> DataFrame:
    """Train is int(train_frac * n) (or round-half-even) shuffled rows, rest validate."""
    size = (lambda n: F.floor(n * F.lit(train_frac))) if rounding == "floor" else (lambda n: F.bround(n * F.lit(train_frac), 0))
    order, (cut,) = R.hash_cuts(df, key, seed, size, total=_n(df))
    return df.withColumn(split_col, F.when(R.up_to(order, cut), "train").otherwise("val"))


def split_ceil(df: DataFrame, key: str, test_frac: float, seed=42, split_col: str = "split") -> DataFrame:
    """Test is the first ceil(n * t) shuffled rows (sklearn train_test_split)."""
    order, (cut,) = R.hash_cuts(df, key, seed, lambda n: F.ceil(n * F.lit(test_frac)), total=_n(df))
    return df.withColumn(split_col, F.when(R.up_to(order, cut), "test").otherwise("train"))


def split_many(df: DataFrame, key: str, test_frac: float, seeds: Mapping[str, object]) -> DataFrame:
    """One ``split_ceil`` column for each of ``seeds`` (column name -> seed).  Every cut is
    found on the keys of ``df`` alone, which should be stored."""
    keys = df.select(key)
    out = df
    for name, seed in seeds.items():
        order, (cut,) = R.hash_cuts(keys, key, seed, lambda n: F.ceil(n * F.lit(test_frac)), total=_n(keys))
        out = out.withColumn(name, F.when(R.up_to(order, cut), "test").otherwise("train"))
    return out


def split_70_15_15(df: DataFrame, key: str, seed=42, split_col: str = "split") -> DataFrame:
    """70 % sample train; half of the remainder valid; the rest test."""
    def n_train(n):
        return F.bround(n * F.lit(0.7), 0)

    order, (train, valid) = R.hash_cuts(df, key, seed, n_train,
                                        lambda n: n_train(n) + F.bround((n - n_train(n)) * F.lit(0.5), 0), total=_n(df))
    return df.withColumn(split_col, F.when(R.up_to(order, train), "train").when(R.up_to(order, valid), "valid").otherwise("test"))


def split_tail(df: DataFrame, key: str, val_frac: float = 0.2, split_col: str = "split") -> DataFrame:
    """Keras validation_split: the last rows in stored (key) order validate."""
    order, (cut,) = R.key_cuts(df, key, lambda n: F.floor(n * F.lit(1.0 - val_frac)), total=_n(df))
    return df.withColumn(split_col, F.when(R.up_to(order, cut), "train").otherwise("val"))


def stratified_split(df: DataFrame, key: str, label: str, test_frac: float, seed=42,
                     split_col: str = "split") -> DataFrame:
    """Same ratio inside each label: per label the first ceil(n_label * t) shuffled rows
    are test.  A row is compared with its label's cut; rows are neither ranked nor
    moved (the cuts, a row a label, are broadcast by AQE when they are small)."""
    order, cuts = R.group_cuts(df, key, label, seed, lambda n: F.ceil(n * F.lit(test_frac)))
    j = df.join(cuts, F.col(label).eqNullSafe(F.col("__g")), "left")
    return j.withColumn(split_col, F.when(R.up_to(order, F.col("cut")), "test").otherwise("train")).select(*df.columns, split_col)


def kfold_contiguous(df: DataFrame, key: str, k: int = 10, fold_col: str = "fold") -> DataFrame:
    """KFold without shuffle over stored order; the first n % k folds get one
    row more.  Training rows of fold i are those with fold != i."""
    def first_rows(i):   # rows in the folds before fold i
        return lambda n: F.floor(n / k) * i + F.least(n % k, F.lit(i))

    return df.withColumn(fold_col, R.key_cuts_passed(df, key, *[first_rows(i) for i in range(1, k)], total=_n(df)).cast("long"))


def split_halves(df: DataFrame, key: str, test_frac: float, seed=42, split_col: str = "split") -> DataFrame:
    """File = originals then their copies.  Split at n//2 in stored order and
    split both halves with the same seed on the position inside the half, so
    row i and row n//2 + i fall on the same side when the halves are equal."""
    n = _n(df)
    half = F.floor(n / 2)
    r = R.key_rank(df, key, "__r")
    r = r.withColumn("__half", F.when(F.col("__r") <= half, 0).otherwise(1)) \
         .withColumn("__pos", F.when(F.col("__r") <= half, F.col("__r")).otherwise(F.col("__r") - half))
    r = R.hash_rank(r, "__pos", seed, "__hr", partition_by=["__half"])
    r = R.with_count(r, "__nh", partition_by=["__half"])
    return r.withColumn(split_col, F.when(F.col("__hr") <= F.ceil(F.col("__nh") * F.lit(test_frac)), "test")
                        .otherwise("train")).drop("__r", "__half", "__pos", "__hr", "__nh")


def split_pairs(df: DataFrame, pair_key: str, test_frac: float, seed=42, split_col: str = "split") -> DataFrame:
    """Split by pair: the first ceil(n_pairs * t) shuffled pairs are test, and
    every row of a pair follows it (no original/copy straddles the split)."""
    pairs = df.select(pair_key).distinct()
    n = _n(pairs)
    pr = R.hash_rank(pairs, pair_key, seed, "__r")
    side = pr.select(pair_key, F.when(F.col("__r") <= F.ceil(n * F.lit(test_frac)), "test")
                     .otherwise("train").alias(split_col))
    return df.join(side, pair_key)   # shuffle join: both sides grow with the data


def bootstrap_draws(df: DataFrame, key: str, rounds: int = 10, n_draws: int | None = None, seed0: int = 0) -> DataFrame:
    """(round, key, times_drawn) of the rows that a round drew, with replacement.

    Round i is seeded by seed0 + i.  Draws are generated with ``spark.range``
    (distributed) as rank targets 1 + floor(u * n) and counted (partial aggregation)
    before they meet the rows; a round has about 0.63 n rows where n are drawn.
    """
    n_rows = df.count()
    per_round = n_rows if n_draws is None else n_draws
    ranked = R.hash_rank(df.select(key), key, "bootstrap-order", "__r")
    d = df.sparkSession.range(rounds * per_round).select(
        (F.floor(F.col("id") / per_round) + seed0).cast("long").alias("round"), (F.col("id") % per_round).alias("__j"))
    d = d.select("round", (F.floor(hash_uniform("draw", F.col("round"), F.col("__j")) * n_rows) + 1).cast("long").alias("__r"))
    drawn = d.groupBy("round", "__r").agg(F.count(F.lit(1)).alias("times_drawn"))
    return drawn.join(ranked, "__r").select("round", key, "times_drawn")


def bootstrap_oob(df: DataFrame, key: str, rounds: int = 10, n_draws: int | None = None,
                  seed0: int = 0) -> DataFrame:
    """(round, key, times_drawn) for every row and round: ``bootstrap_draws`` with the
    rows that a round never drew (its out-of-bag test set) as zeros."""
    drawn = bootstrap_draws(df, key, rounds, n_draws, seed0)
    every = F.sequence(F.lit(seed0).cast("long"), F.lit(seed0 + rounds - 1).cast("long"))
    rows = df.select(key, F.explode(every).alias("round"))
    out = rows.join(drawn, ["round", key], "left")
    return out.select("round", key, F.coalesce("times_drawn", F.lit(0)).cast("long").alias("times_drawn"))


def leaked_rows(df: DataFrame, key: str, text: str, clean, split: str = "split", train: str = "train", val: str = "val") -> DataFrame:
    """Keys of validation rows whose cleaned text also occurs in training, from one
    table of both.  Texts are cleaned once: (key, split, hash) is stored, and the
    validation part is semi-joined to the other; hashes that training cannot hold
    are told by a Bloom filter that Spark builds where it pays."""
    hashed = stored(df.select(key, split, F.unhex(F.md5(clean(F.col(text)))).alias("__h")), "clean-hashes")
    return hashed.where(F.col(split) == val).join(hashed.where(F.col(split) == train).select("__h"), "__h", "left_semi").select(key)


def leak_check(train: DataFrame, val: DataFrame, text: str, clean) -> DataFrame:
    """Validation rows whose cleaned text also occurs in train (exact match on
    a hash of the cleaned text, semi join)."""
    t = train.select(F.md5(clean(F.col(text))).alias("__h")).distinct()
    v = val.withColumn("__h", F.md5(clean(F.col(text))))
    return v.join(t, "__h", "left_semi").drop("__h")


def nested_prefixes(df: DataFrame, key: str, cells: Mapping[str, Column], top: int, seed="grid") -> DataFrame:
    """``df`` with (cell, rank) for each cell's first ``top`` rows in its own seeded order.

    ``cells``: name -> condition for rows of the cell.  The order starts with u, the
    first 8 hex digits of an MD5 over 2**32, so the rows with u <= t are a prefix of
    every cell's order.  One scan gives each row the cells where it is in the
    prefix; t leaves about ``top`` rows a cell, by eight standard deviations more
    than ``top``.  Should a cell with enough rows have kept fewer all the same, all
    its rows are ranked: the result is exact in any case.
    """
    sizes = df.agg(*[F.count(F.when(c, 1)).alias(f"c{i}") for i, c in enumerate(cells.values())]).first()
    sizes = dict(zip(cells, sizes)) if cells else {}
    share = {c: min(1.0, (top + 8.0 * math.sqrt(top) + 64.0) / n) if n else 1.0 for c, n in sizes.items()}

    def kept(shares):
        marks = [F.when(where & (hash_uniform(seed, F.lit(c), F.col(key)) <= F.lit(shares[c])), F.lit(c)) for c, where in cells.items()]
        return df.withColumn("cell", F.explode(F.filter(F.array(*marks), lambda c: c.isNotNull())))

    rows = stored(kept(share), "prefixes")
    have = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a cell
    short = {c for c in cells if have.get(c, 0) < min(top, sizes[c])}
    if short:
        rows = kept({c: 1.0 if c in short else share[c] for c in cells})
    ranked = rows.withColumn("__k", F.concat_ws(":", "cell", F.col(key).cast("string")))
    return R.hash_rank(ranked, "__k", seed, "rank", partition_by=["cell"]).where(F.col("rank") <= top).drop("__k")


def size_grid_counts(df: DataFrame, key: str, label: str, sizes: Sequence[int],
                     splits: Sequence[int], iterations: Sequence[int], seed="grid") -> DataFrame:
    """Learning-curve grid: for every (split, iteration) cell and size the
    label mix of the nested training subset ``rank <= size`` (rank in the
    cell's own seeded order, see ``nested_prefixes``)."""
    sizes = sorted(sizes)
    cells = {f"{s}-{i}": F.lit(True) for s in splits for i in iterations}
    rep = nested_prefixes(df.select(key, label), key, cells, sizes[-1], seed)
    size_arr = F.array(*[F.lit(s) for s in sizes])
    part = F.split("cell", "-")
    rep = rep.select(part[0].cast("int").alias("split_no"), part[1].cast("int").alias("iteration"), label,
                     F.element_at(F.filter(size_arr, lambda s: s >= F.col("rank")), 1).alias("size"))
    cnt = rep.groupBy("split_no", "iteration", label, "size").agg(F.count(F.lit(1)).alias("__c"))
    grid = cnt.select("split_no", "iteration", label).distinct() \
              .select("split_no", "iteration", label, F.explode(size_arr).alias("size"))
    full = grid.join(cnt, ["split_no", "iteration", label, "size"], "left")
    w = Window.partitionBy("split_no", "iteration", label).orderBy("size") \
              .rowsBetween(Window.unboundedPreceding, 0)
    return full.select("split_no", "iteration", "size", label,
                       F.sum(F.coalesce("__c", F.lit(0))).over(w).cast("long").alias("n"))
