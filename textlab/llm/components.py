"""Links within key groups, and connected components of a link table.

Within a group only links that span its components are made, by trying partners
in an order that bounds how far they can be; a very large group is dealt into
blocks whose pairs are groups of their own, so no task holds a large group whole.

Components come from alternating star contractions.

Each round points the larger neighbours of a node at its smallest neighbour
(large star), then its smaller ones (small star); the links end as one star per
component.  Every round is two joins on link tables with partial aggregation;
nothing is gathered per component, and nothing reaches the driver but a count
and a checksum.  Rounds are cut by reliable checkpoints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

ROUNDS = 64


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """Links joined to (u, m); the second key makes both sides shuffles of their own,
    so that Spark can split a node of very many links."""
    fold = F.pmod(F.xxhash64("u"), F.lit(1009)).alias("f")
    return links.select("*", fold).join(least.select("*", fold), ["u", "f"]).drop("f")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    others = _with_least(links, least).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that is not the smallest of its component;
    component is that smallest node.  Loops, repeats and both directions of a link
    are allowed; null ends are ignored; no links: no rows."""
    ensure_checkpoint_dir(links.sparkSession)
    stars = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull()).where("u > v").distinct().checkpoint()
    mark = None
    for _ in range(ROUNDS):
        stars = _small_star(_large_star(stars)).checkpoint()
        now = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now
    raise ValueError(f"components did not settle in {ROUNDS} rounds")


def spanning_links(group: np.ndarray, first: np.ndarray, width: int,
                   near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of links that span the components of ``near`` within each group.

    Rows are in order of group and ``first``, and near rows differ by ``width`` at
    most there.  Partners further on are tried one step at a time while ``first``
    allows any; pairs that are connected already are passed over.
    """
    n = len(group)
    label = np.arange(n)
    live, step, held = np.arange(n), 1, []

    def merge():
        """Hooks roots to smaller roots until no held pair is apart; labels are roots before and after."""
        nonlocal label
        a, b = (np.concatenate(x) for x in zip(*held))
        held.clear()
        while True:
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            apart = low < high
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(label, high[apart], low[apart])
            while (label[label] != label).any():
                label = label[label]

    while True:
        live = live[live < n - step]
        live = live[(group[live] == group[live + step]) & (first[live + step] - first[live] <= width)]
        if not len(live):
            break
        a = live[label[live] != label[live + step]]
        if len(a):
            a = a[near(a, a + step)]
        if len(a):
            held.append((a, a + step))
        if held and (step % 16 == 0 or step < 4 or sum(len(x) for x, _ in held) > 1 << 14):
            merge()
        step += 1
    if held:
        merge()
    member = np.flatnonzero(label != np.arange(n))
    return label[member], member


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], links) -> Iterator[pa.RecordBatch]:
    """Calls ``links(rows, group)`` on the rows of whole groups; rows come in order of ``keys``."""
    def groups(rows):
        new = np.zeros(rows.num_rows, bool)
        for name in keys:
            v = rows.column(name).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.cumsum(new)

    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
        if rows.num_rows:
            group = groups(rows)
            cut = int(np.searchsorted(group, group[-1], "left"))
            rest = rows.slice(cut)
            if cut:
                yield from links(rows.slice(0, cut), group[:cut])
    if rest is not None and rest.num_rows:
        yield from links(rest, groups(rest))


def links_within(rows: DataFrame, keys: Sequence[str], member: str, block: int, first: Column, links, schema: str) -> DataFrame:
    """Distinct links that ``links`` finds among rows with equal ``keys`` (numbers).

    ``first`` orders the rows of a group.  Groups of more than ``block`` rows are
    dealt by ``member`` into b blocks; blocks i <= j meet in a group of their own,
    so every pair meets, and no task holds more than about two blocks.
    """
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > block)
    if hot.limit(1).count():
        parts = F.ceil(F.coalesce("__n", F.lit(1)) / F.lit(block)).cast("int")
        own = F.pmod(F.xxhash64(member), F.col("__parts")).cast("int")
        rows = rows.join(hot, list(keys), "left").withColumn("__parts", parts).withColumn("__own", own)
        rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
        rows = rows.withColumn("part", F.least("__own", "__other") * F.col("__parts") + F.greatest("__own", "__other"))
        rows = rows.drop("__n", "__parts", "__own", "__other")
    else:
        rows = rows.withColumn("part", F.lit(0))
    order = [*keys, "part"]
    dealt = rows.repartition(*order).sortWithinPartitions(*order, first)
    return dealt.mapInArrow(lambda batches: _whole_groups(batches, order, links), schema).distinct()
