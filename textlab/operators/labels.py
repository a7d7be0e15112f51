"""Label encoding: dictionary maps, alphabetical indices, one-hot vectors.

A fixed label dictionary is a literal ``map`` expression (no join at all).
Alphabetical indices come from a scalar subquery that returns the sorted
distinct labels as one small array (bounded by the class count).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX


def _map_literal(mapping: Mapping) -> Column:
    return F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])


def map_label(df: DataFrame, label: str, mapping: Mapping[str, int], out: str = "label_idx",
              strict: bool = False) -> DataFrame:
    """Dictionary map label -> index; unknown labels become null.

    ``strict=True`` fails the job on an unknown (non-null) label, like a
    Python dict lookup would.
    """
    idx = _map_literal(mapping)[F.col(label)]
    if strict:
        idx = F.when(F.col(label).isNull() | idx.isNotNull(), idx) \
               .otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.col(label))))
    return df.withColumn(out, idx.cast("int"))


def unmap_label(df: DataFrame, idx: str, mapping: Mapping[str, int], out: str = "label_name") -> DataFrame:
    inverse = {v: k for k, v in mapping.items()}
    return df.withColumn(out, _map_literal(inverse)[F.col(idx)])


def encode_label_alpha(df: DataFrame, label: str, out: str = "label_idx") -> DataFrame:
    """Index = rank of the label among the sorted distinct labels (0-based).

    The sorted label array is a scalar subquery (one row, one small array), so
    the encoding is a lookup with no join and is fitted once for all splits.  More
    than ``MAX_CLASSES`` labels, as in a wrongly chosen column, are an error.
    """
    few = df.select(F.col(label).alias("__l")).where(F.col("__l").isNotNull()).distinct().orderBy("__l").limit(MAX_CLASSES + 1)
    classes = few.agg(F.array_sort(F.collect_list("__l"))).scalar()
    place = (F.array_position(classes, F.col(label)) - 1).cast("int")
    return df.withColumn(out, F.when(F.size(classes) <= MAX_CLASSES, place).otherwise(F.raise_error(F.lit(f"more than {MAX_CLASSES} labels")).cast("int")))


#: Most classes that a label column may have.
MAX_CLASSES = 10_000


def one_hot(idx, k: int) -> Column:
    """Indicator array of length k for a 0-based index column."""
    c = F.col(idx) if isinstance(idx, str) else idx
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == c).cast("int"))


def detect_base_model(name) -> Column:
    """Base model from a checkpoint file name: first rule whose key occurs in the
    lower-cased name wins ("tweet" before "base"), default the base model."""
    n = F.lower(F.col(name) if isinstance(name, str) else name)
    from ..functions.constants import BASE_MODEL_RULES, BASE_MODEL_DEFAULT
    expr = None
    for key, model in BASE_MODEL_RULES:
        expr = F.when(n.contains(key), F.lit(model)) if expr is None else expr.when(n.contains(key), F.lit(model))
    return expr.otherwise(F.lit(BASE_MODEL_DEFAULT))


def safe_map_text(text, mapped) -> Column:
    """Null/blank text -> '', else the mapped text, else (failed map) the original."""
    t = F.col(text) if isinstance(text, str) else text
    m = F.col(mapped) if isinstance(mapped, str) else mapped
    return F.when(F.trim(F.coalesce(t, F.lit(""))) == "", F.lit("")).otherwise(F.coalesce(m, t))


def scan_validated(df: DataFrame, text: str, label: str, known: Mapping[str, int],
                   stopwords: Iterable[str] = ()) -> DataFrame:
    """Clean first (stop words dropped, white space squeezed and stripped; null
    text counts as empty), then keep rows whose cleaned text is non-empty and
    whose lower(trim(label)) is known.  The cleaned text is returned."""
    norm = F.lower(F.trim(F.col(label)))
    lookup = _map_literal(known)[norm]
    return (df.withColumn(text, TX.remove_stopwords(F.coalesce(F.col(text), F.lit("")), stopwords))
              .withColumn(label, norm)
              .where((F.col(text) != "") & lookup.isNotNull())
              .withColumn("label_idx", lookup.cast("int")))
