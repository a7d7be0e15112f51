"""Registered queries (Spark + DuckDB oracle) built from the operators."""

from . import augment_queries, eval_queries, feature_queries, model_queries, source_queries, split_queries, stream_queries, table_queries, text_queries, vocab_queries  # noqa: F401  (register on import)
from .registry import ORACLE, QUERIES  # noqa: F401
