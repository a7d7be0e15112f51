"""Registered queries of the corpus operators (Spark callable + DuckDB twin where SQL can express it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch_path
from ..sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


@register("op1_exact_dedup", r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
       doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from t""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups
    return exact_groups(read_table(spark, sf_dir, "documents"))


@register("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@register("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing
    cut = packing.pieces(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packing.pack(cut)


@register("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan as S
    docs, path = read_table(spark, sf_dir, "documents"), scratch_path(spark, "blob-ledger")
    S.update_ledger(docs, path, first=True)
    found = S.findings(docs, path)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind):
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("findings", lambda s: s["kind"].isin(*S.BASE))
    return found.select("doc_id", *map(count, S.BASE),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


@register("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash
    found = simhash.near_groups(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@register("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@register("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(*toxicity.training_sample(docs, read_table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@register("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit_rows(quality.graded_rows(docs, read_table(spark, sf_dir, "labels")))
    return quality.score(docs, model).withColumn("kept", F.col("tail_probability") >= quality.KEEP_TAIL)


@register("op10_line_dedup")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_repeated_lines
    out = drop_repeated_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@register("op7_nearest_neighbours")
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@register("op13_token_store")
def op13_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_store
    docs, folder = read_table(spark, sf_dir, "documents"), scratch_path(spark, "token-ids")
    token_store.write(docs, folder, tokenizer_path("byte_bpe_50k.json"))
    return token_store.checksums(spark, folder).withColumnRenamed("key", "doc_id")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by a hash of conversation and turn."""
    def known(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    return conversations.where(fate != 0).select("conv_id", "turn", F.when(fate == 4, "user").otherwise(known("role")).alias("role"),
                                                 text.alias("text"), F.when(fate == 3, 2).otherwise(1).alias("copies"))


@register("op12_dialogue_repair")
def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import dialogue_repair as R
    conversations = read_table(spark, sf_dir, "conversations")
    rows = damaged(conversations)
    parsed = R.parse(rows, copies="copies")
    hashed = R.repaired_sha256(rows, parsed, copies="copies").withColumnRenamed("conv_id", "h")
    every = conversations.select(F.col("conv_id").alias("c")).distinct()
    found = every.join(parsed, F.col("c").eqNullSafe(F.col("conv_id")), "left").join(hashed, F.col("c").eqNullSafe(F.col("h")), "left")
    zeros = [F.coalesce(x, F.lit(0)).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("c").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@register("op11_collocations", r"""
with d as (select coalesce(lang, 'und') as lang, doc_id, row_number() over () as doc,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
s as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w),
f1 as (select lang, ws[i] as phrase, count(*) as f from s group by all),
f2 as (select lang, ws[i] || ' ' || ws[i+1] as phrase, ws[i] as x, ws[i+1] as y, count(*) as f from s where i < len(ws) group by all having count(*) >= 10),
f3 as (select lang, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] as phrase, ws[i] as x, ws[i+1] as y, ws[i+2] as z, count(*) as f
       from s where i + 1 < len(ws) group by all having count(*) >= 10),
cuts as (
  select b.lang, b.phrase, b.f as a, 1 as k, l.f as l, r.f as r
  from f2 b join f1 l on l.lang = b.lang and l.phrase = b.x join f1 r on r.lang = b.lang and r.phrase = b.y
  union all
  select b.lang, b.phrase, b.f, 1, l.f, r.f
  from f3 b join f1 l on l.lang = b.lang and l.phrase = b.x join f2 r on r.lang = b.lang and r.phrase = b.y || ' ' || b.z
  union all
  select b.lang, b.phrase, b.f, 2, l.f, r.f
  from f3 b join f2 l on l.lang = b.lang and l.phrase = b.x || ' ' || b.y join f1 r on r.lang = b.lang and r.phrase = b.z),
scored as (select *, (1000000::hugeint * a * a) // (l::hugeint * r) as score from cuts),
weakest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
covered as (select lang, phrase, max(f) as over from (select lang, x || ' ' || y as phrase, f from f3 union all select lang, y || ' ' || z, f from f3) group by all),
left_over as (select k.* from weakest k left join covered c on c.lang = k.lang and c.phrase = k.phrase where not coalesce(100 * c.over >= 50 * k.a, false)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from left_over),
n as (select lang, sum(f) as n from f1 group by lang)
select lang, rank::int as rank, phrase, a, l, r, n::bigint as n, score::bigint as score from ranked join n using (lang) where rank <= 2000""")
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations
    return collocations(read_table(spark, sf_dir, "documents"))
