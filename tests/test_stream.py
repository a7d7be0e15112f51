"""Stateless operators on a stream give the batch results."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from textlab.functions import constants as K
from textlab.operators import labels as L
from textlab.operators import models as M
from textlab.streaming import stateless as ST

from conftest import SF001


def test_stream_features_equal_batch(spark):
    stream = ST.clean_features(ST.documents_stream(spark, SF001), "doc_id", "text", K.TEST_STOPWORDS)
    got = ST.stream_to_table(spark, stream, "t-features")
    batch = ST.clean_features(spark.read.parquet(f"{SF001}/documents.parquet"), "doc_id", "text", K.TEST_STOPWORDS)
    assert got.count() == batch.count()
    assert got.exceptAll(batch.select(*got.columns)).count() == 0


def test_stream_scoring_equals_batch(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "lang", "text")
    docs = L.encode_label_alpha(docs, "lang", "label").withColumn("label", F.col("label").cast("double"))
    model = M.text_pipeline(M.logreg(max_iter=20), 200).fit(docs)
    scored_stream = ST.score(ST.documents_stream(spark, SF001), model).select("doc_id", "prediction")
    got = ST.stream_to_table(spark, scored_stream, "t-score")
    batch = model.transform(docs).select("doc_id", "prediction")
    assert got.count() == batch.count()
    assert got.exceptAll(batch).count() == 0


def test_stream_reads_a_table_of_many_files(spark, tmp_path):
    rows = [(i, f"Text {i} with <b>tags</b> and http://x.y/{i}", "en", "web", 30) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = E.queries()["stream_clean_features"](spark, str(tmp_path))
    batch = ST.clean_features(docs, "doc_id", "text", K.TEST_STOPWORDS)
    assert got.count() == 50
    assert got.exceptAll(batch.select(*got.columns)).count() == 0
