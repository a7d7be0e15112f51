"""Secret scans with an incremental blob ledger.

Every version of every text is addressed by the SHA-256 of its content.  The
ledger holds one row per blob: the rules (name@version) it was scanned with and
their findings.  A run scans only the pairs of blob and rule version that the
ledger lacks, appends them, and joins the findings back to every row (path,
version) that holds the blob.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import map_text, texts

#: A private key from its BEGIN line to the END line before the next BEGIN; without one,
#: to the end of the base64 text (one more word after long ones may be its last line).
#: Possessive throughout: one pass, however many BEGIN lines have no END.
PEM = (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
       r"(?:[^-]*+(?:-(?!----(?:BEGIN |END [A-Z ]{0,40}PRIVATE KEY-----))[^-]*+)*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
       r"|(?:(?:\s|\\[rn])*+(?:Proc-Type|DEK-Info):[^\n]*+)*+(?:(?:\s|\\[rn])*+[A-Za-z0-9+/=]{16,}+)++(?:(?:\s|\\[rn])++[A-Za-z0-9+/=]++(?!\S))?)?")
#: The base kinds in their order, then the kinds added here.
#: kind -> (version, pattern, group whose length counts, least length)
RULES = {
    "assign": (1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (1, r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (1, r"[0-9a-f]{16,}", 0, 16),
    "pem": (2, PEM, 0, 0),
    "jwt": (1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
}
BASE = ("assign", "access", "hex")
#: A text without any of these (lower-cased) has no span of that kind.
HINTS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",),
         "pem": ("private key",), "jwt": ("eyj",)}
SPAN = "array<struct<kind:string,start:int,stop:int>>"


def rule_names(rules=RULES) -> list[str]:
    return [f"{kind}@{rule[0]}" for kind, rule in rules.items()]


def find(text: str, kinds, rules) -> list[tuple[int, int, int]]:
    """(start, place of the kind, stop) of every span, in order of start, then kind."""
    out, low = [], text.lower()
    for place, kind in enumerate(rules):
        if kind not in kinds or kind in HINTS and not any(h in low for h in HINTS[kind]):
            continue
        pattern, group, least = rules[kind]
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), place, m.end()))
    return sorted(out)


def blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, scanned, findings) from (blob, text, wanted): each text is scanned
    with the rules named in its ``wanted``."""
    names = list(rules)
    compiled = {kind: (re.compile(p, re.ASCII | (re.IGNORECASE if kind == "assign" else 0)), g, n) for kind, (_, p, g, n) in rules.items()}
    if "assign" in compiled:  # only the names ignore case, the value's class has both anyway
        assert compiled["assign"][0].groups == 2

    def step(batch):
        wanted = batch.column("wanted").to_pylist()
        rows = [find(t.decode(), {w.split("@")[0] for w in want}, compiled) for t, want in zip(texts(batch.column("text")), wanted)]
        at = np.cumsum([0, *map(len, rows)], dtype=np.int32)
        flat = [s for r in rows for s in r]
        spans = pa.StructArray.from_arrays([pa.array([names[p] for _, p, _ in flat], pa.string()), pa.array([a for a, _, _ in flat], pa.int32()),
                                            pa.array([b for _, _, b in flat], pa.int32())], ["kind", "start", "stop"])
        return pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("wanted"), pa.ListArray.from_arrays(pa.array(at), spans)], ["blob", "scanned", "findings"])

    return map_text(blobs, ["blob", "text", "wanted"], "text", f"blob binary, scanned array<string>, findings {SPAN}", step)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows, several per blob if rules were added between runs."""
    return spark.read.schema(f"blob binary, scanned array<string>, findings {SPAN}").parquet(path)


def update_ledger(docs: DataFrame, path: str, text: str = "text", rules=RULES, first: bool = False) -> None:
    """Scan what the ledger at ``path`` lacks and append it.  ``first``: there is no ledger yet.

    Equal texts are scanned once: rows are made distinct by blob and text
    before the scan (each task's copies first), so a text held by a third of
    all rows costs one scan.  Null text: the empty text.
    """
    spark = docs.sparkSession
    names = rule_names(rules)
    blobs = docs.select(blob(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    if first:
        unseen = blobs.withColumn("wanted", F.array(*map(F.lit, names)))
    else:
        seen = read_ledger(spark, path).groupBy("blob").agg(F.flatten(F.collect_set("scanned")).alias("seen"))
        unseen = (blobs.join(seen, "blob", "left")
                  .withColumn("wanted", F.array_except(F.array(*map(F.lit, names)), F.coalesce("seen", F.array().cast("array<string>"))))
                  .where(F.size("wanted") > 0))
    scan_blobs(unseen, rules).write.mode("append").parquet(path)


def _blob_findings(spark: SparkSession, path: str, rules) -> DataFrame:
    """(blob, findings) of every blob with findings; only the current rule versions count."""
    order = F.create_map(*[x for i, kind in enumerate(rules) for x in (F.lit(kind), F.lit(i))])
    current = F.create_map(*[x for kind, name in zip(rules, rule_names(rules)) for x in (F.lit(kind), F.lit(name))])
    own = F.filter("findings", lambda s: F.array_contains("scanned", current[s.kind]))  # of a rule's older versions: none
    have = (read_ledger(spark, path).select("blob", own.alias("findings")).where(F.size("findings") > 0)
            .groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("f")))
    return have.where(F.size("f") > 0).select("blob", F.transform(
        F.array_sort(F.transform("f", lambda s: F.struct(s.start.alias("start"), order[s.kind].alias("place"), s.stop.alias("stop"), s.kind.alias("kind")))),
        lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.stop.alias("stop"))).alias("findings"))


def _fold(blob_: Column) -> Column:
    """A second key makes both sides of a join shuffles of their own, so that Spark can split a blob of very many rows."""
    return F.pmod(F.xxhash64(blob_), F.lit(1009))


def findings(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """(key, findings) of every row of ``docs``, from the ledger; only the current
    rule versions count.  Findings are ordered by start, then by the rules' order;
    offsets are code points, ends exclusive.  No finding, null and empty texts:
    an empty list.  Repeated rows and null keys keep their rows."""
    fold = _fold(F.col("blob")).alias("fold")
    have = _blob_findings(docs.sparkSession, path, rules)
    paths = docs.select(key, blob(F.col(text)).alias("blob")).select(key, "blob", fold)
    return paths.join(have.select("*", fold), ["blob", "fold"], "left").select(key, F.coalesce("findings", F.array().cast(SPAN)).alias("findings"))


def _masked(text: str, mask: str) -> Column:
    """The text with the spans of ``__spans``, in order of start, replaced by ``mask``."""
    # pieces between the spans, each from the furthest stop so far
    return F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda s, x: F.struct(
        F.greatest(s["at"], x["stop"]).alias("at"),
        F.when(x["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mask))).alias("out")),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def redact(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding's span replaced by ``mask`` (overlapping spans as one);
    ``found``: (key, findings), one row for each key.  Where keys are null or repeated,
    use ``redact_blobs``."""
    spans = found.where(F.size("findings") > 0).select(F.col(key).alias("__key"), F.col("findings").alias("__spans"))
    joined = docs.join(spans, F.col(key) == F.col("__key"), "left")
    return joined.withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(_masked(text, mask))).select(*docs.columns)


def redact_blobs(docs: DataFrame, path: str, text: str = "text", rules=RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding of the ledger replaced by ``mask`` (overlapping spans
    as one).  Rows meet their findings by content address: every row stays one row,
    whatever its key, and is cut at its own text's offsets."""
    have = _blob_findings(docs.sparkSession, path, rules).select(
        F.col("blob").alias("__b"), _fold(F.col("blob")).alias("__f"), F.col("findings").alias("__spans"))
    rows = docs.withColumn("__blob", blob(F.col(text)))
    joined = rows.join(have, (F.col("__blob") == F.col("__b")) & (_fold(F.col("__blob")) == F.col("__f")), "left")
    return joined.withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(_masked(text, mask))).select(*docs.columns)
