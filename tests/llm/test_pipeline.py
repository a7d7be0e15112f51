"""Every stage of the pipeline on its own input, against brute force."""

import corpus_pipeline as C
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF001
from tests.llm import test_line_dedup, test_packing, test_secret_scan, test_simhash
from textlab.llm import secret_scan


def masked(text):
    spans = [(int(a), int(b)) for _, a, b in (s.split(":") for s in test_secret_scan.brute(text))]
    spans += [m.span() for k in ("pem", "jwt") for m in secret_scan.re.compile(secret_scan.RULES[k][1]).finditer(text or "")]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns = docs.columns
    seen = {}
    for i, (name, stage) in enumerate(C.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF001).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        seen[name] = len(rows)
        if name != "packing":
            assert docs.columns == columns and len({r.doc_id for r in rows}) == len(rows)
            assert all(r.n_chars == len(r.text) for r in rows if name in ("line_dedup", "secrets"))
        after = {r.doc_id: r.text for r in rows} if name != "packing" else None
        texts = {k: r.text for k, r in before.items()}
        if name == "quality":
            labels = {r.doc_id: r for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
            good = [k for k, r in labels.items() if r.quality == 1 and not r.toxic]
            assert sum(k in after for k in good) >= 0.95 * len(good) and len(after) < len(before)
            assert all(after[k] == texts[k] for k in after)
        elif name == "line_dedup":
            assert after == test_line_dedup.brute(list(texts.items()))
        elif name == "near_dedup":
            keys = list(texts)
            groups = test_simhash.plain_groups(keys, [test_simhash.plain_fingerprint(texts[k]) for k in keys])
            assert after == {k: texts[k] for k, g in zip(keys, groups) if k == g}
        elif name == "secrets":
            assert after == {k: masked(t) for k, t in texts.items()}
        else:
            test_packing.check(rows, texts)
    assert seen["packing"] >= seen["secrets"] > 0


def test_run_is_registered(spark):
    assert E.queries()["pipeline"] is C.run
    assert len(C.STAGES) == 5 and C.ORACLE_SQL is None
    out = C.run(spark, SF001)
    assert out.select(F.countDistinct("doc_id")).first()[0] > 0
