"""Registered queries: stateless operators on a stream."""

from __future__ import annotations

from ..functions import constants as K
from ..streaming import stateless as ST
from . import duck as D
from .registry import register


@register("stream_clean_features",
          f"SELECT doc_id, {D.clean_text('text')} AS clean, {D.meta_features('text', K.TEST_STOPWORDS)} FROM documents")
def q_stream_clean_features(spark, sf_dir):
    """documents read as a file stream, cleaned and featurised per micro-batch;
    the result must equal the batch computation."""
    s = ST.clean_features(ST.documents_stream(spark, sf_dir), "doc_id", "text", K.TEST_STOPWORDS)
    return ST.stream_to_table(spark, s, "stream-features")
