"""Approximate nearest neighbours: NN-descent graph, greedy graph search.

Index.  Distinct vectors are dealt into leaves by random hyperplanes (several
times); neighbours within a leaf start the graph.  Then, round after round, a
neighbour of a neighbour is tried as a neighbour: edges and the best reverse
edges meet at each node, its neighbours' vectors are joined to them, all pairs
of which one is new are scored there, and pairs that beat what a node has are
kept.  Everything is rows of (node, neighbour, score) in Spark joins and windows.

Search.  A query starts at its own neighbours and expands, in a few rounds for all
queries at once, the best nodes it has not expanded; what it has met last is
scored anew with the original vectors in double precision.

Vectors travel as eight-bit codes with a scale; the final scores do not use them.
Measured recall is in the README.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import stored
from .components import _whole_groups

#: Neighbours and reverse neighbours of a node; vectors of a leaf; trees; rounds.
DEGREE, REVERSE, LEAF, TREES, ROUNDS = 32, 16, 512, 4, 4
#: Candidates that a node takes from one meeting; neighbours it takes from one leaf.
OFFERS, LEAF_NEAREST = 8, 20
#: Nodes that a query expands in a round; rounds; reverse neighbours it may go to; candidates scored exactly.
EXPAND, SEARCH_ROUNDS, SEARCH_REVERSE, FINAL = 48, 6, 32, 64
_PAIR = "v long, u long, score float"


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, no null and no non-finite component."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    return (vector.isNotNull() & F.coalesce(F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
            & F.coalesce(F.exists(wide, lambda x: x != 0.0), F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a float matrix; lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _codes(x: np.ndarray) -> pa.Array:
    """Eight-bit codes and the scale of each row, as binary."""
    scale = (np.abs(x).max(1) / 127).astype(np.float32)
    code = np.rint(x / scale[:, None]).astype(np.int8)
    both = np.concatenate([scale[:, None].view(np.uint8), code.view(np.uint8)], 1)
    return pa.array([r.tobytes() for r in both], pa.binary())


def _vectors(column) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return raw[:, 4:].view(np.int8) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


def _leaves(batches, trees: int, bits: int):
    """(v, code, tree, leaf, line): leaf is the side of ``bits`` hyperplanes, line a position along one more."""
    for batch in batches:
        x = _matrix(batch.column("x"))
        if not len(x):
            continue
        codes = _codes(x)
        for t in range(trees):
            planes = np.random.default_rng(1000 + t).normal(size=(x.shape[1], bits + 1))
            side = x @ planes
            leaf = (side[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("v"), codes, pa.array(np.full(len(x), t, np.int32)), pa.array(leaf), pa.array(side[:, bits])],
                                             ["v", "code", "tree", "leaf", "line"])


def _nearest(v: np.ndarray, x: np.ndarray, k: int):
    """The k best partners of every row, as (v, u, score)."""
    k = min(k, len(v) - 1)
    if k < 1:
        return None
    s = (x @ x.T).astype(np.float32)
    np.fill_diagonal(s, -np.inf)
    best = np.argpartition(-s, k - 1, 1)[:, :k]
    return np.repeat(v, k), v[best].ravel(), np.take_along_axis(s, best, 1).ravel()


def _pairs(parts) -> pa.RecordBatch | None:
    parts = [p for p in parts if p is not None]
    if not parts:
        return None
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["v", "u", "score"])


def _leaf_links(rows: pa.Table, group: np.ndarray, leaf: int, k: int):
    """Neighbours within each leaf; longer leaves in pieces along their line."""
    v, x = rows.column("v").to_numpy(), _vectors(rows.column("code"))
    heads = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(v)]])
    out = []
    for a, b in zip(heads.tolist(), heads[1:].tolist()):
        n = max(1, -(-(b - a) // (2 * leaf)))
        cuts = [a + (b - a) * i // n for i in range(n + 1)]
        out += [_nearest(v[c:d], x[c:d], k) for c, d in zip(cuts, cuts[1:])]
    found = _pairs(out)
    if found is not None:
        yield found


def _meet(rows: pa.Table, group: np.ndarray, offers: int):
    """At each node: its neighbours offer themselves to each other if one of the two is new and the offer beats what is there."""
    v, x = rows.column("u").to_numpy(), _vectors(rows.column("code"))
    new, bar = rows.column("is_new").to_numpy(), rows.column("bar").to_numpy()
    heads = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(v)]])
    out = []
    for a, b in zip(heads.tolist(), heads[1:].tolist()):
        if b - a < 2 or not new[a:b].any():
            continue
        s = (x[a:b] @ x[a:b].T).astype(np.float32)
        s[~(new[a:b, None] | new[None, a:b])] = -np.inf
        np.fill_diagonal(s, -np.inf)
        s[s <= bar[a:b, None]] = -np.inf
        k = min(offers, b - a - 1)
        best = np.argpartition(-s, k - 1, 1)[:, :k]
        score = np.take_along_axis(s, best, 1).ravel()
        good = np.flatnonzero(score > -np.inf)
        out.append((np.repeat(v[a:b], k)[good], v[a:b][best].ravel()[good], score[good]))
    found = _pairs(out)
    if found is not None:
        yield found


def _grouped(rows: DataFrame, key: str, step, schema: str) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(lambda b: _whole_groups(b, [key], step), schema)


def _best(edges: DataFrame, degree: int) -> DataFrame:
    """Each node's best edges; of one edge met twice the older."""
    one = edges.where("u <> v").groupBy("v", "u").agg(F.max("score").alias("score"), F.min("is_new").alias("is_new"))
    w = Window.partitionBy("v").orderBy(F.desc("score"), "u")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= degree)


def _both_ways(edges: DataFrame, reverse: int) -> DataFrame:
    """(v, u, is_new): edges, and each node's best reverse edges."""
    w = Window.partitionBy("u").orderBy(F.desc("score"), "v")
    back = edges.withColumn("back", F.row_number().over(w)).where(F.col("back") <= reverse).select(F.col("u").alias("v"), F.col("v").alias("u"), "is_new")
    return edges.select("v", "u", "is_new").union(back).groupBy("v", "u").agg(F.max("is_new").alias("is_new"))


def build_graph(vectors: DataFrame, n: int, degree: int = DEGREE, reverse: int = REVERSE, rounds: int = ROUNDS,
                leaf: int = LEAF, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """(edges, codes) of the neighbour graph over distinct usable vectors (v, x); n: their number."""
    bits = max(0, int(np.log2(max(n, 1) / leaf)))
    dealt = stored(vectors.mapInArrow(lambda b: _leaves(b, trees, bits), "v long, code binary, tree int, leaf long, line double"), "ann-leaves")
    codes = dealt.where("tree = 0").select("v", "code")
    sorted_ = dealt.repartitionByRange("tree", "leaf", "line").sortWithinPartitions("tree", "leaf", "line")
    start = sorted_.mapInArrow(lambda b: _whole_groups(b, ["tree", "leaf"], lambda rows, group: _leaf_links(rows, group, leaf, LEAF_NEAREST)), _PAIR)
    edges = stored(_best(start.withColumn("is_new", F.lit(True)), degree), "ann-edges")
    for _ in range(rounds):
        bars = edges.groupBy("v").agg(F.when(F.count(F.lit(1)) >= degree, F.min("score")).otherwise(F.lit(float("-inf")).cast("float")).alias("bar"))
        known = codes.join(bars, "v").withColumnRenamed("v", "u")
        met = _both_ways(edges, reverse).join(known, "u")
        offers = _grouped(met, "v", lambda rows, group: _meet(rows, group, OFFERS), _PAIR).withColumn("is_new", F.lit(True))
        old = edges.select("v", "u", "score", F.lit(False).alias("is_new"))
        edges = stored(_best(old.unionByName(offers), degree), "ann-edges")
    return edges, codes


def _scored(rows: pa.Table, group: np.ndarray):
    """(q, u, score) of the rows of each query; the query's own vector comes with its row (u = q)."""
    q, u, x = rows.column("q").to_numpy(), rows.column("u").to_numpy(), _vectors(rows.column("code"))
    heads = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(q)]])
    score = np.zeros(len(q), np.float32)
    for a, b in zip(heads.tolist(), heads[1:].tolist()):
        own = a + int(np.argmax(u[a:b] == q[a]))
        score[a:b] = x[a:b] @ x[own]
    keep = q != u
    yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(u[keep]), pa.array(score[keep])], ["q", "u", "score"])


def search(queries: DataFrame, edges: DataFrame, codes: DataFrame, reverse: int = SEARCH_REVERSE, expand: int = EXPAND,
           rounds: int = SEARCH_ROUNDS, final: int = FINAL) -> DataFrame:
    """(q, u): the best nodes that each query (q, a node of the graph) has met."""
    paths = stored(_both_ways(edges, reverse).select(F.col("v").alias("at"), F.col("u").alias("next")), "ann-paths")
    seen = edges.join(queries.select(F.col("q").alias("v")), "v", "left_semi").select(F.col("v").alias("q"), "u", "score", F.lit(False).alias("open"))
    own = queries.select("q", F.col("q").alias("u"))
    for _ in range(rounds):
        w = Window.partitionBy("q").orderBy("open", F.desc("score"), "u")  # not expanded ones first
        ranked = stored(seen.withColumn("rank", F.row_number().over(w)), "ann-seen")
        now = ranked.where(~F.col("open") & (F.col("rank") <= expand))
        fresh = (now.join(paths, F.col("u") == F.col("at")).select("q", F.col("next").alias("u")).where("q <> u").distinct()
                 .join(ranked.select("q", "u"), ["q", "u"], "left_anti"))
        met = _grouped(fresh.union(own).join(codes.withColumnRenamed("v", "u"), "u"), "q", _scored, "q long, u long, score float")
        seen = ranked.select("q", "u", "score", (F.col("open") | (F.col("rank") <= expand)).alias("open")).union(met.withColumn("open", F.lit(False)))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "u")
    return seen.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= final).select("q", "u")


def _fold(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(1009))


def nearest(rows: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", **graph) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, by inner
    product in double precision, ties to the smaller key; a row is not its own neighbour.

    Null, zero and non-finite vectors take no part, nor do null keys.  Equal
    vectors are one node of the graph; their rows are all candidates.  Fewer than
    k candidates: all of them.  A key that is repeated is one row (its largest
    vector counts).  Vectors of one table have one length.  Empty: no rows.
    """
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("e"), x.alias("x"), is_query.alias("is_query")).where(F.col("id").isNotNull() & usable(F.col(vector)))
    own = own.groupBy("id").agg(F.max("x").alias("x"), F.max("is_query").alias("is_query"))
    # equal vectors: the smallest id stands for all; the k + 1 smallest ids can matter
    # (fold keys make both sides of a join shuffles of their own, so that Spark can split a vector that very many rows hold)
    by_vector = own.groupBy("x").agg(F.min("id").alias("v")).withColumn("fold", _fold("x"))
    named = stored(own.withColumn("fold", _fold("x")).join(by_vector, ["x", "fold"]).select("id", "v", "is_query", F.when(F.col("id") == F.col("v"), F.col("x")).alias("x")), "ann-rows")
    first = Window.partitionBy("v", F.pmod("id", F.lit(64))).orderBy("id")
    then = Window.partitionBy("v").orderBy("id")
    members = (named.select("v", "id").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
               .withColumn("r", F.row_number().over(then)).where(F.col("r") <= k + 1).select(F.col("v").alias("u"), F.col("id").alias("vec_id")))
    vectors = named.where(F.col("x").isNotNull()).select("v", "x")
    n = vectors.count()
    edges, codes = build_graph(vectors, n, **graph)
    queries = named.where("is_query").select(F.col("v").alias("q")).distinct()
    found = search(queries, edges, codes).union(queries.select("q", F.col("q").alias("u")))
    score = F.aggregate(F.zip_with("a", "b", lambda p, r: p * r), F.lit(0.0), lambda s, p: s + p)
    exact = (found.join(vectors.select(F.col("v").alias("u"), F.col("x").alias("b")), "u")
             .join(vectors.select(F.col("v").alias("q"), F.col("x").alias("a")), "q").select("q", "u", score.alias("score")))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top_nodes = Window.partitionBy("q").orderBy(F.desc("score"), "u")
    # own node and the k best others hold the k + 1 best rows
    lists = (exact.withColumn("r", F.row_number().over(top_nodes)).where((F.col("r") <= k + 1) | (F.col("u") == F.col("q")))
             .join(members, "u").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("q", "vec_id", "score"))
    asked = named.where("is_query").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (asked.withColumn("fold", _fold("q")).join(lists.withColumn("fold", _fold("q")), ["q", "fold"]).where("query_id <> vec_id").withColumn("rank", F.row_number().over(final))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
