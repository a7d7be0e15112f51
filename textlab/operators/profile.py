"""Profiling aggregates (label distribution, histograms, describe, correlation).

Each is one or two aggregations with partial (map-side) aggregation; none
collects rows.  Per-label work is one ``groupBy(label)``, never a loop over
labels.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..functions.numeric import rround

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def text_meta_features(df: DataFrame, text_col: str, stopwords: Iterable[str],
                       keep: Sequence[str] = ()) -> DataFrame:
    """Append the eight meta features of ``text_col`` (computed on raw text).

    The whitespace tokens are computed once in a projection below the
    features (Catalyst keeps it: the token array is read several times)."""
    t = df.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"),
                  TX.tokenize_ws(text_col).alias("__tok"))
    return t.select(*[F.col(c) for c in keep], *TX.meta_feature_columns("__text", stopwords, tokens="__tok"))


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*[f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)])


def mean_by_label(df: DataFrame, label: str, cols: Sequence[str], digits: int = 6) -> DataFrame:
    return df.groupBy(label).agg(*[rround(F.avg(c), digits).alias(f"mean_{c}") for c in cols])


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: rows, non-null count, type.  One pass."""
    counts = df.agg(F.count(F.lit(1)).alias("__rows"),
                    *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    types = F.create_map(*[x for f in df.schema.fields
                           for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    return (counts.selectExpr("__rows AS n_rows", f"stack({len(df.columns)}, {stack}) AS (column_name, non_null)")
            .withColumn("dtype", types[F.col("column_name")]))


def head_rows(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """First n rows in key order (a top-n: Spark plans TakeOrderedAndProject)."""
    return df.orderBy(key).limit(n)


def distinct_labels(df: DataFrame, label: str) -> DataFrame:
    return df.select(label).distinct()


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows per label and share of all rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()  # scalar subquery, computed once
    return counts.withColumn("share", rround(F.col("n") / total, 6))


def hist_by_label(df: DataFrame, label: str, x: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram of ``x`` per label over that label's own min..max.

    Every label has all its bins, empty ones too.  The last bin is closed; a
    constant label uses [x-0.5, x+0.5] like numpy.
    """
    rng = df.groupBy(label).agg(F.min(x).alias("lo0"), F.max(x).alias("hi0"))
    rng = rng.select(
        label,
        F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
        F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"),
    )
    # one row per label: AQE broadcasts it at run time when it is small
    j = df.select(label, x).where(F.col(x).isNotNull()).join(rng, label)
    b = F.least(F.floor((F.col(x) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    counts = j.groupBy(label, b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = rng.where(F.col("lo").isNotNull()).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return every.join(counts, [label, "bin"], "left").select(
        label, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        rround(F.col("lo") + (F.col("bin") * (F.col("hi") - F.col("lo")) / bins), 6).alias("bin_lo"))


#: Accuracy of the quantile sketch: its ranks are off by one of so many rows at most.
SKETCH = 20_000


def exact_quantiles(df: DataFrame, group: str, cols: Sequence[str], probs: Sequence[float], accuracy: int = SKETCH) -> DataFrame:
    """(group, col, p, q): exact percentiles with linear interpolation (pandas /
    ``quantile_cont``) of all columns at once; nulls do not count.

    1. One aggregation makes a mergeable quantile sketch of every column and group.
       It brackets each wanted rank: the value at that rank lies between two values
       of the sketch, with about 6 / ``accuracy`` of the rows between them (more in a
       group of fewer than about 2 ``accuracy`` rows).
    2. One pass counts the rows below each bracket and the values inside, by value,
       so a hot value collapses in partial aggregation.  The rank is then found
       among the bracket's values.

    ``df`` is read twice, whatever the number of columns.  Spark's ``percentile``
    keeps every distinct value of a group in one aggregation buffer instead.
    """
    wide = [F.col(c).cast("double") for c in cols]
    # a ladder of brackets, ever wider: a group takes the first that is sure to hold its rank
    margins = [3.0 / accuracy]
    while margins[-1] < 1.0:
        margins.append(margins[-1] * 8)
    edges = [e for p in probs for m in margins for e in (max(p - m, 0.0), min(p + m, 1.0))]
    sketch = df.groupBy(group).agg(*[F.struct(F.count(x).alias("n"), F.percentile_approx(x, edges, accuracy).alias("at")).alias(f"__{i}")
                                     for i, x in enumerate(wide)])

    def bracket(i, k):
        n, at, step = F.col(f"__{i}.n"), F.col(f"__{i}.at"), F.lit(len(margins) - 1)
        for j in reversed(range(len(margins) - 1)):
            step = F.when((F.lit(margins[j]) - 2.0 / accuracy) * n >= 2, j).otherwise(step)
        place = (step + k * len(margins)) * 2
        return n.alias("n"), F.get(at, place).alias("lo"), F.get(at, place + 1).alias("hi")

    wanted = [F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), *bracket(i, k)) for i in range(len(cols)) for k, p in enumerate(probs)]
    # a row a group, as wide as the wanted ranks: joined to the rows, AQE broadcasts it when it is small
    brackets = sketch.select(F.col(group).alias("__g"), F.filter(F.array(*wanted), lambda w: w["n"] > 0).alias("__w"))
    values = F.array(*wide)
    rows = df.select(group, values.alias("__v")).join(brackets, F.col(group).eqNullSafe(F.col("__g")))
    # of each bracket a row matters if it is not above: below it as a count, inside by its value
    own = F.transform("__w", lambda w: F.struct(w["i"].alias("i"), w["p"].alias("p"), w["n"].alias("n"), w["lo"].alias("lo"), w["hi"].alias("hi"),
                                                F.col("__v")[w["i"]].alias("v")))
    near = rows.select(group, F.explode(F.filter(own, lambda x: x["v"] <= x["hi"])).alias("x")).select(
        group, "x.i", "x.p", "x.n", F.when(F.col("x.v") >= F.col("x.lo"), F.col("x.v")).alias("v"))
    counts = near.groupBy(group, "i", "p", "n", "v").agg(F.count(F.lit(1)).alias("c"))
    # null, the rows below, comes first; a bracket's values are few
    upto = F.sum("c").over(Window.partitionBy(group, "i", "p").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    h = (F.col("n") - 1) * F.col("p")
    held = counts.withColumn("upto", upto).where(F.col("v").isNotNull())
    at = [F.min(F.when(F.col("upto") >= rank + 1, F.col("v"))).alias(name) for rank, name in ((F.floor(h), "a"), (F.ceil(h), "b"))]
    found = held.groupBy(group, "i", "p", "n").agg(*at, F.min(F.col("upto") - F.col("c")).alias("below"), F.max("upto").alias("to"))
    # a sketch that is worse than it promises would show here; it never gives a wrong value
    held_in = (F.col("below") <= F.floor(h)) & (F.col("to") > F.ceil(h))
    q = F.when(held_in, F.col("a") + (h - F.floor(h)) * (F.col("b") - F.col("a"))).otherwise(F.raise_error(F.lit("rank outside its bracket")).cast("double"))
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("i") + 1)
    return found.select(group, name.alias("col"), "p", q.alias("q"))


def exact_percentiles(df: DataFrame, group: str, value: str, probs: Sequence[float], accuracy: int = SKETCH) -> DataFrame:
    """(group, p, q): ``exact_quantiles`` of one column."""
    return exact_quantiles(df, group, [value], probs, accuracy).drop("col")


def _quartiles(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """(group, <col>_p25, <col>_p50, <col>_p75 of every column): one row a group."""
    q = exact_quantiles(df, group, cols, [0.25, 0.5, 0.75])
    picked = [F.max(F.when((F.col("col") == c) & (F.col("p") == p), F.col("q"))).alias(f"{c}_{n}")
              for c in cols for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    return q.groupBy(F.col(group).alias("__g")).agg(*picked)


def describe_by_label(df: DataFrame, label: str, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 % (linear interpolation), max.

    Moments are one aggregation; the quartiles of all columns come from
    ``exact_quantiles`` and are joined on the label."""
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(f"{c}_count"), F.avg(c).alias(f"{c}_mean"),
                 F.stddev_samp(c).alias(f"{c}_std"), F.min(c).cast("double").alias(f"{c}_min"),
                 F.max(c).cast("double").alias(f"{c}_max")]
    out = df.groupBy(label).agg(*aggs).join(_quartiles(df, label, cols), F.col(label).eqNullSafe(F.col("__g")), "left")
    sel = [F.col(label)]
    for c in cols:
        sel += [F.col(f"{c}_count").cast("long").alias(f"{c}_count"),
                *[rround(f"{c}_{n}", digits).alias(f"{c}_{n}") for n in ("mean", "std", "min", "p25", "p50", "p75", "max")]]
    return out.select(*sel)


def corr_matrix(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Pearson correlation of every ordered pair in one aggregation pass; each
    unordered pair is computed once."""
    pairs = [(a, b) for a in cols for b in cols]
    once = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in once])
    name = {(a, b): f"{a}__{b}" for a, b in once} | {(b, a): f"{a}__{b}" for a, b in once}
    stack = ", ".join(f"'{a}', '{b}', `{name[a, b]}`" for a, b in pairs)
    return (row.selectExpr(f"stack({len(pairs)}, {stack}) AS (col_a, col_b, r)")
            .withColumn("r", rround("r", digits)))


def top_words_by_label(df: DataFrame, label: str, text: str, stopwords: Iterable[str],
                       k: int = 200, buckets: int = 256) -> DataFrame:
    """Most frequent lower-cased words per label, stop words removed; ties by word.

    Words are runs of word characters (apostrophes inside stay), as a word cloud
    of the joined texts reads them: other punctuation is never part of one.

    explode -> groupBy(label, word) with partial aggregation (a hot word is
    pre-counted per task).  The top-k is two-phase so a label with a huge
    vocabulary is never ranked in one task: top-k inside (label, hash bucket
    of the word), then top-k per label over at most buckets * k candidates.
    """
    sw = TX.sw_array(stopwords)
    words = TX.explode_tokens(df, [label], F.filter(TX.tokenize_cloud(F.lower(F.col(text))),
                                                    lambda t: ~F.array_contains(sw, t)), "word")
    counts = words.groupBy(label, "word").agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.asc("word")]
    b = F.pmod(F.xxhash64("word"), F.lit(buckets))
    w1 = Window.partitionBy(label, b).orderBy(*order)
    cand = counts.withColumn("__r1", F.row_number().over(w1)).where(F.col("__r1") <= k).drop("__r1")
    w2 = Window.partitionBy(label).orderBy(*order)
    return cand.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k) \
               .withColumn("rank", F.col("rank").cast("long"))


def grouped_boxplot(df: DataFrame, group: str, value: str, digits: int = 6, whisker: float = 1.5) -> DataFrame:
    """Box-plot data per group: min, quartiles, max; the whiskers (the furthest
    values within ``whisker`` times the quartile distance of the box) and the number
    of values beyond them."""
    q = _quartiles(df, group, [value])
    box = q.select(F.col("__g").alias(group), F.col(f"{value}_p25").alias("q1"), F.col(f"{value}_p50").alias("median"), F.col(f"{value}_p75").alias("q3"))
    reach = F.lit(whisker) * (F.col("q3") - F.col("q1"))
    v = F.col(value).cast("double")
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    out = df.select(group, value).join(box, group).groupBy(group, "q1", "median", "q3").agg(
        F.min(v).alias("vmin"), F.max(v).alias("vmax"), F.min(F.when(inside, v)).alias("whisker_lo"),
        F.max(F.when(inside, v)).alias("whisker_hi"), F.count(F.when(~inside, v)).cast("long").alias("n_outliers"))
    return out.select(group, *[rround(c, digits).alias(c) for c in ("vmin", "whisker_lo", "q1", "median", "q3", "whisker_hi", "vmax")], "n_outliers")


def boxplot_outliers(df: DataFrame, group: str, value: str, whisker: float = 1.5) -> DataFrame:
    """The rows of ``df`` whose value lies beyond the whiskers of its group."""
    q = _quartiles(df, group, [value]).select(F.col("__g").alias(group), F.col(f"{value}_p25").alias("__q1"), F.col(f"{value}_p75").alias("__q3"))
    reach = F.lit(whisker) * (F.col("__q3") - F.col("__q1"))
    j = df.join(q, group)
    return j.where((F.col(value) < F.col("__q1") - reach) | (F.col(value) > F.col("__q3") + reach)).select(*df.columns)


def vocab_stats(tokens_df: DataFrame, tokens: str) -> DataFrame:
    """Vocabulary size (distinct tokens) and the longest token sequence."""
    exploded = tokens_df.select(F.size(tokens).alias("s"), F.explode_outer(tokens).alias("t"))
    return exploded.agg(F.count_distinct("t").alias("vocab_size"),
                        F.max("s").cast("long").alias("max_len"))
