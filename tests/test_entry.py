"""Driver contract, flagship query, oracle agreement on a fast subset, streaming."""

import duckdb

import __spark_entry__ as E
from textlab.sources.tables import TABLES

from conftest import SF001

SUBSET = ["mean_by_label", "clean_text", "text_meta_features", "build_vocab", "tfidf", "stratified_split",
          "kfold_contiguous", "aug_swap", "back_translate_1p", "class_report", "confusion_raw", "scan_csv",
          "parse_report_text", "top_words_by_label", "size_grid", "anti_join_natural", "stream_clean_features"]


def test_registry_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 130


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "mean_num_words" in df.columns


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def test_oracle_subset(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    q, s = E.queries(), E.oracle_sql()
    for name in SUBSET:
        sdf = q[name](spark, SF001)
        cur = con.execute(s[name])
        dcols = [d[0] for d in cur.description]
        assert sorted(sdf.columns) == sorted(dcols), name
        assert _norm([tuple(r) for r in sdf.collect()], sdf.columns) == _norm(cur.fetchall(), dcols), name
