"""Corpus features: term counts, sklearn-style TF-IDF, scaling, LSA.

Two representations:

* **long form** ``(doc, term, weight)`` - exact for any vocabulary size.  ``tfidf``
  counts and weighs in blocks of documents whose distinct terms meet in buckets;
  the others are aggregates and joins: skewed (very frequent) terms are pre-aggregated
  before the shuffle and AQE splits skewed join partitions.
* **ML vectors** for a vocabulary of at most ``k`` terms (top-k by count):
  ``CountVectorizerModel.from_vocabulary`` + ``ElementwiseProduct`` (idf) +
  ``Normalizer`` are row-local JVM transformers; only the k-term vocabulary
  and k idf values pass through the driver (a bound set by the caller).

sklearn's smooth idf is ``ln((1 + N) / (1 + df)) + 1`` with raw counts as tf
and an L2 norm per row; MLlib's ``IDF`` lacks the ``+ 1`` and the norm.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..functions.numeric import rround
from ..sources.files import scratch_path, stored
from .passes import summed


def tf_count(docs: DataFrame, key: str, tokens: str | Column) -> DataFrame:
    """(key, term, tf): term counts per document.

    Documents are hash-partitioned by key *before* exploding: a token array is
    smaller than its exploded (key, term) rows, and the partitioning then
    satisfies both the per-document count and the per-document L2 window, so
    neither needs a shuffle of term pairs.  Keys are unique, so the
    partitioning is balanced.
    """
    t = TX.explode_tokens(docs.repartition(key), [key], tokens, "term")
    return t.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def idf_table(tf: DataFrame, key: str, n_docs: Column | None = None) -> DataFrame:
    """(term, df, idf) with sklearn's smooth idf.  ``n_docs`` defaults to the
    number of documents with at least one term in ``tf``."""
    n = n_docs if n_docs is not None else F.lit(tf.agg(F.count_distinct(key)).scalar())
    # counting through ``tf`` (not count(*)) keeps the tf aggregate below
    # unchanged, so Spark reuses its exchange instead of re-tokenising for a
    # separate distinct
    df = tf.groupBy("term").agg(F.count(F.when(F.col("tf") > 0, F.lit(1))).alias("df"))
    return df.withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))


def _l2(weighted: DataFrame, key: str, digits: int | None) -> DataFrame:
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    out = weighted.withColumn("weight", F.col("w") / norm).drop("w")
    return out.withColumn("weight", rround("weight", digits)) if digits is not None else out


def tfidf_transform(tf: DataFrame, key: str, idf: DataFrame, digits: int | None = None) -> DataFrame:
    """Apply a fitted idf table: unseen terms are dropped, then L2 per document
    over the remaining terms (the norm window holds one document's terms)."""
    w = tf.join(idf.select("term", "idf"), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    return _l2(w, key, digits)


#: Terms of the documents that one task encodes at once, about, and most parts that the distinct terms are dealt into.
BLOCK_TERMS, BUCKETS = 1 << 21, 4096


def _lists(ends: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, pa.int32()))


def _flat(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays([c.flatten() for c in table.column(name).chunks])


def _with_pairs(row: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code, terms) of words and of pairs of neighbours in a row, joined by one space."""
    coded = words.dictionary_encode()
    word, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    at = np.flatnonzero(row[1:] == row[:-1])
    pairs, pair = np.unique(word[at] * len(known) + word[at + 1], return_inverse=True)
    joined = pc.binary_join_element_wise(known.take(pa.array(pairs // len(known))), known.take(pa.array(pairs % len(known))), " ")
    row, code, terms = np.concatenate([row, row[at]]), np.concatenate([word, len(known) + pair]), pa.concat_arrays([known, joined])
    if pc.any(pc.match_substring(known, " ")).as_py():   # a word may then be a pair, too
        again = terms.dictionary_encode()
        code, terms = again.indices.to_numpy()[code], again.dictionary
    return row, code, terms


def _encoded(table: pa.Table, buckets: int, pairs: bool) -> pa.Table | None:
    """A row for each bucket that the (key, tokens) rows of a block have terms of: its distinct
    terms, for each the number ``n`` of documents it is in, and for each of these the
    document's place in the block and the count.  The first row holds the keys of the
    documents.  Terms are in an order that does not depend on that of the rows."""
    table = table.combine_chunks()
    keys, lists = (table.column(i).chunk(0) for i in range(2))
    row, flat = _owners(lists)
    if not len(flat):
        return None
    if pairs:
        row, code, known = _with_pairs(row, flat)
    else:
        coded = flat.dictionary_encode()
        code, known = coded.indices.to_numpy(), coded.dictionary
    own = keys.dictionary_encode("encode")   # rows of one key are one document
    doc, docs = own.indices.to_numpy()[row], len(own.dictionary)
    hashed = pd.util.hash_array(known.to_numpy(zero_copy_only=False), categorize=False)
    bucket = (hashed % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((hashed, bucket))
    if (hashed[order][1:] == hashed[order][:-1]).any():
        order = np.array(sorted(order.tolist(), key=lambda i: (bucket[i], hashed[i], known[i].as_py())))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    found, tf = np.unique(place[code] * docs + doc, return_counts=True)
    n = np.bincount(found // docs, minlength=len(order))
    held, first = np.unique(bucket[order], return_index=True)
    terms = np.append(first, len(order))
    entries = np.concatenate([[0], np.cumsum(n)])[terms]
    return pa.table([pa.array(held), _lists(np.where(np.arange(len(held) + 1) > 0, docs, 0), own.dictionary), _lists(terms, known.take(pa.array(order))),
                     _lists(terms, n), _lists(entries, found % docs), _lists(entries, tf)], ["bucket", "keys", "terms", "n", "doc", "tf"])


def _squeezed(terms: pa.Array) -> bytes:
    """Strings, none of them null, as compressed bytes."""
    terms = pa.concat_arrays([terms])
    ends = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset:terms.offset + len(terms) + 1]
    raw = np.diff(ends).astype(np.int32).tobytes() + (terms.buffers()[2] or b"")[ends[0]:ends[-1]]
    return np.array([len(terms), len(raw)], np.int64).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unsqueezed(data: bytes) -> pa.Array:
    n, size = np.frombuffer(data, np.int64, 2).tolist()
    raw = pa.decompress(data[16:], size, "zstd")
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int32, n))]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(ends), raw.slice(4 * n)])


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, docs): the (key, tokens) rows of a batch that are of one block, compressed as one value."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        block = batch.column(2).to_numpy()
        order, (blocks, first) = np.argsort(block, kind="stable"), np.unique(np.sort(block), return_index=True)
        made = []
        for at in np.split(order, first[1:]) if len(block) else ():
            own, out = batch.select([0, 1]).take(pa.array(at)), pa.BufferOutputStream()
            with pa.ipc.new_stream(out, own.schema, options=options) as stream:
                stream.write_batch(own)
            made.append(out.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(made, pa.binary())], ["block", "docs"])


def _unbundled(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("docs")])


def _with_df(table: pa.Table) -> pa.Table:
    """(block, bucket, df) of a bucket's rows: the document frequency of each of their terms, in their order."""
    terms = [_unsqueezed(x.as_py()) for x in table.column("terms")]
    n, coded = _flat(table, "n").to_numpy(), pa.concat_arrays(terms).dictionary_encode().indices.to_numpy()
    df = np.bincount(coded, n)[coded]
    sizes = [len(t) for t in terms]
    return table.select(["block", "bucket"]).append_column("df", _lists(np.concatenate([[0], np.cumsum(sizes)]), df.astype(np.int32)))


def tfidf(docs: DataFrame, key: str, tokens: str | Column, digits: int | None = None,
          n_docs: Column | None = None, pairs: bool = False) -> DataFrame:
    """(key, term, weight) sklearn TfidfVectorizer weights, fitted on ``docs``.  ``pairs``: pairs
    of neighbouring tokens, joined by one space, are terms too (``ngram_range=(1, 2)``).

    Documents are dealt into blocks of about ``BLOCK_TERMS`` terms by their keys.  The
    distinct terms of the blocks meet in buckets, by their hash, where their document
    frequencies are summed; only these return.  A block is encoded a second time to use
    them, from the same shuffle of its tokens: no row of a term is shuffled, and no
    document's counts.  A task holds one block, or one bucket of terms (at most 16
    documents' share, beyond that one of ``BUCKETS`` parts of all).
    """
    spark = docs.sparkSession
    own = docs.select(key, (F.col(tokens) if isinstance(tokens, str) else tokens).alias("__tokens"))
    rows, words = own.agg(F.count(F.lit(1)), F.sum(F.size("__tokens").cast("long"))).first()
    n = rows if n_docs is None else spark.range(1).select(n_docs).first()[0]
    cores = spark.sparkContext.defaultParallelism
    buckets, blocks = min(BUCKETS, max(cores, -(-rows // 16))), max(cores, -(-max(words or 0, 0) * (1 + pairs) // BLOCK_TERMS))
    kind = own.schema[key].dataType
    own = own.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks))).mapInArrow(_bundled, "block long, docs binary")
    ints = T.ArrayType(T.IntegerType())
    row = [("block", T.LongType()), ("bucket", T.IntegerType()), ("terms", T.BinaryType()), ("n", ints), ("df", ints)]

    def encode(table):
        made = _encoded(_unbundled(table), buckets, pairs)
        if made is None:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.binary()), pa.array([], pa.list_(pa.int32()))], names[:4])
        made = made.set_column(2, "terms", pa.array([_squeezed(x.values) for x in made.column("terms")], pa.binary()))
        return made.add_column(0, "block", pa.array(np.full(made.num_rows, table.column("block")[0].as_py(), np.int64))).select(names[:4])

    def weigh(table, known):
        made = _encoded(docs := _unbundled(table), buckets, pairs)
        if made is None:
            return pa.table([docs.column(0).slice(0, 0), pa.array([], pa.string()), pa.array([], pa.float64())], [key, "term", "weight"])
        known = known.sort_by("bucket")   # as the buckets of the block are
        term = np.repeat(np.arange(len(terms := _flat(made, "terms"))), _flat(made, "n").to_numpy())
        idf = np.log((1.0 + n) / (1.0 + _flat(known, "df").to_numpy())) + 1.0
        doc, w = _flat(made, "doc").to_numpy(), _flat(made, "tf").to_numpy() * idf[term]
        weight = w / np.sqrt(np.bincount(doc, w * w))[doc]
        return pa.table([_flat(made, "keys").take(pa.array(doc)), terms.take(pa.array(term)), pa.array(weight)], [key, "term", "weight"])

    def schema(*of):
        return T.StructType([T.StructField(c, t) for c, t in of])

    names = [c for c, _ in row]
    coded = own.groupBy("block").applyInArrow(encode, schema(*row[:4]))
    known = coded.groupBy("bucket").applyInArrow(_with_df, schema(row[0], row[1], row[4]))
    out = own.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(weigh, schema((key, kind), ("term", T.StringType()), ("weight", T.DoubleType())))
    return out.withColumn("weight", rround("weight", digits)) if digits is not None else out


def top_terms(tf: DataFrame, k: int) -> DataFrame:
    """(term, total, term_idx): the k terms with the largest total count, ties
    alphabetical.  ``orderBy().limit(k)`` is a top-k (each task keeps k rows)."""
    totals = tf.groupBy("term").agg(F.sum("tf").alias("total"))
    top = totals.orderBy(F.desc("total"), F.asc("term")).limit(k)
    w = Window.orderBy(F.desc("total"), F.asc("term"))   # over <= k rows
    return top.withColumn("term_idx", (F.row_number().over(w) - 1).cast("int"))


def tfidf_topk(docs: DataFrame, key: str, tokens: str | Column, k: int, digits: int | None = None) -> DataFrame:
    """TF-IDF over the k most frequent terms (sklearn ``max_features``): the
    vocabulary is restricted first (broadcast semi join, k rows), then idf and
    the L2 norm are computed over the kept terms."""
    return tfidf_topk_of(tf_count(docs, key, tokens), key, k, F.lit(docs.agg(F.count(F.lit(1))).scalar()), digits)


def tfidf_topk_of(tf: DataFrame, key: str, k: int, n_docs: Column, digits: int | None = None) -> DataFrame:
    """``tfidf_topk`` of counted terms; the k idf values are broadcast, so counts that are
    partitioned by document stay where they are."""
    keep = F.broadcast(top_terms(tf, k).select("term"))
    tfk = tf.join(keep, "term", "left_semi")
    return tfidf_transform(tfk, key, F.broadcast(idf_table(tfk, key, n_docs).select("term", "idf")), digits)


# --- scaling -------------------------------------------------------------------

def _stats(src: DataFrame, cols: Sequence[str], fns) -> dict:
    """All statistics of all columns in ONE aggregation pass; the result is a
    single row of 2 x len(cols) numbers (a fitted scaler's parameters)."""
    row = src.agg(*[fn(F.col(c).cast("double")).alias(f"{name}__{c}") for c in cols for name, fn in fns]).first()
    return row.asDict()


def standard_scale(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None,
                   digits: int | None = None, suffix: str = "_z") -> DataFrame:
    """(x - mean) / population std, a constant column scaled by 1.  Mean and
    std of every column come from one aggregation over ``fit_on`` (default
    ``df``); applying them is a projection."""
    st = _stats(fit_on if fit_on is not None else df, cols, [("mu", F.avg), ("sd", F.stddev_pop)])
    out = df
    for c in cols:
        mu, sd = st[f"mu__{c}"], st[f"sd__{c}"]
        scale = 1.0 if sd is None or sd == 0 else sd
        z = (F.col(c) - F.lit(mu)) / F.lit(scale)
        out = out.withColumn(c + suffix, rround(z, digits) if digits is not None else z)
    return out


def minmax_scale(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None,
                 digits: int | None = None, suffix: str = "_mm") -> DataFrame:
    """(x - min) / (max - min) with min / max from ``fit_on`` (train only, no
    leak) in one aggregation; a constant column maps to 0 (MLlib's
    MinMaxScaler gives 0.5)."""
    st = _stats(fit_on if fit_on is not None else df, cols, [("lo", F.min), ("hi", F.max)])
    out = df
    for c in cols:
        lo, hi = st[f"lo__{c}"], st[f"hi__{c}"]
        z = F.lit(0.0) if lo == hi else (F.col(c) - F.lit(lo)) / F.lit(hi - lo)
        out = out.withColumn(c + suffix, rround(z, digits) if digits is not None else z)
    return out


# --- ML vector form -------------------------------------------------------------

def tfidf_vectors(docs: DataFrame, key: str, tokens: str, k: int, out: str = "tfidf",
                  fit_on: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Row-local TF-IDF vectors over the top-k terms of ``fit_on`` (default
    ``docs``), equal to sklearn ``TfidfVectorizer(max_features=k)``.

    Returns (DataFrame with ``out``, vocabulary).  Only k terms and k idf
    values are collected, a bound fixed by ``k``.
    """
    src = fit_on if fit_on is not None else docs
    n = src.count()
    # totals and document frequencies come from one pass over the counted terms
    both = tf_count(src, key, tokens).groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    stats = both.orderBy(F.desc("total"), F.asc("term")).limit(k).collect()   # <= k rows
    stats.sort(key=lambda r: (-r["total"], r["term"].encode()))
    vocab = [r["term"] for r in stats]
    import math
    idf = [math.log((1.0 + n) / (1.0 + r["df"])) + 1.0 for r in stats]
    cv = CountVectorizerModel.from_vocabulary(vocab, inputCol=tokens, outputCol="__tf")
    x = cv.transform(docs)
    x = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="__tf", outputCol="__tfidf").transform(x)
    x = Normalizer(p=2.0, inputCol="__tfidf", outputCol=out).transform(x)
    return x.drop("__tf", "__tfidf"), vocab


def assemble_features(df: DataFrame, inputs: Sequence[str], out: str = "features") -> DataFrame:
    """Concatenate named vector / numeric blocks in the given order."""
    return VectorAssembler(inputCols=list(inputs), outputCol=out, handleInvalid="keep").transform(df)


#: Passes of the subspace iteration over the rows, and extra directions it carries.
LSA_PASSES, LSA_EXTRA = 5, 10
#: Entries of rows that one vectorised step multiplies.
LSA_STEP = 1 << 16


#: Words that a task looks up; where more are as frequent as the k-th, terms are rows instead.
FREQUENT = 1 << 20


def _owners(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, value) of the values of lists that are not null."""
    row, flat = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
    if flat.null_count:
        row, flat = row[flat.is_valid().to_numpy(zero_copy_only=False)], flat.drop_null()
    return row, flat


def _word_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = _owners(batch.column(0))[1].value_counts()
        yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["term", "n"])


def _neighbours(row: np.ndarray, code: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, a * known + b) of neighbouring words a, b of a row that are both known."""
    at = np.flatnonzero((row[1:] == row[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0))
    return row[at], code[at].astype(np.int64) * known + code[at + 1]


def _top_pairs(coded: DataFrame, words: Sequence[str], least: int, k: int) -> list[tuple[str, int, int]]:
    """(term, total, a * number of words + b): the k pairs of neighbours with the largest totals, none below ``least``."""
    known = len(words)

    def count(batches):
        for batch in batches:
            row, code = _owners(batch.column(0))
            pairs, n = np.unique(_neighbours(row, code.to_numpy(), known)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    def name(batches):
        for batch in batches:
            pair = batch.column(0).to_numpy()
            terms = pc.binary_join_element_wise(held.take(pa.array(pair // known)), held.take(pa.array(pair % known)), " ")
            yield pa.RecordBatch.from_arrays([terms, batch.column(1), batch.column(0)], ["term", "total", "pair"])

    held = pa.array(words, pa.string())
    totals = coded.select("codes").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    rows = totals.mapInArrow(name, "term string, total long, pair long").orderBy(F.desc("total"), F.asc("term")).limit(k).collect()   # <= k
    return [(r["term"], r["total"], r["pair"]) for r in rows]


def tfidf_rows(docs: DataFrame, key: str, tokens: str, k: int, fit_on: DataFrame | Column | None = None, pairs: bool = False,
               keep: Sequence[str] = ()) -> DataFrame:
    """(key, keep..., idx array<int>, val array<double>): TF-IDF over the top-k terms of ``fit_on`` (a
    condition or a table; default ``docs``), as sparse rows, idx in ascending order.  Every document is kept.

    ``pairs``: pairs of neighbouring words, joined by one space, are terms too (words hold
    no space).  A pair is at most as frequent as its words, so only pairs of words that
    occur as often as the k-th word are counted.  Documents are stored once as the codes of
    such words; no term is a row, and only totals are shuffled.
    """
    flagged = isinstance(fit_on, Column)
    fit = F.coalesce(fit_on, F.lit(False)) if flagged else F.lit(fit_on is None)
    src = docs.where(fit_on) if flagged else fit_on if fit_on is not None else docs
    totals = stored(src.select(tokens).mapInArrow(_word_totals, "term string, n long").groupBy("term").agg(F.sum("n").alias("total")), "word-totals")
    top = [(r["term"], r["total"], None) for r in totals.orderBy(F.desc("total"), F.asc("term")).limit(k).collect()]   # <= k rows
    least = top[-1][1] if len(top) == k and k else 1
    frequent = totals.where(F.col("total") >= least)
    if pairs and frequent.count() > FREQUENT:
        both = docs.withColumn(tokens, TX.ngrams_1_2(tokens))
        fit_both = both.where(fit_on) if flagged else fit_on.withColumn(tokens, TX.ngrams_1_2(tokens)) if fit_on is not None else None
        rows = _tfidf_rows_joined(both, key, tokens, k, fit_both)
        return rows.join(docs.select(key, *keep), key) if keep else rows
    words = [r["term"] for r in frequent.select("term").collect()] if pairs else [t for t, _, _ in top]
    kinds = [*(docs.schema[c] for c in [key, *keep]), T.StructField("fit", T.BooleanType()), T.StructField("codes", T.ArrayType(T.IntegerType()))]
    names = [f.name for f in kinds]

    def code(batches):
        known = pa.array(words, pa.string())
        for batch in batches:
            row, flat = _owners(batch.column(len(names) - 1))
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(ends, pc.fill_null(pc.index_in(flat, value_set=known), -1))], names)

    def coded(df, flag):
        return df.select(key, *keep, flag.alias("fit"), tokens).mapInArrow(code, T.StructType(kinds))

    held = stored(coded(docs, fit), "word-codes")
    own = coded(src, F.lit(True)) if fit_on is not None and not flagged else held.where("fit")
    if pairs:
        top = sorted([*top, *_top_pairs(own, words, least, k)], key=lambda t: (-t[1], t[0].encode()))[:k]
    place, at = {w: i for i, w in enumerate(words)}, np.full(len(words) + 1, -1)
    for i, (term, _, pair) in enumerate(top):
        if pair is None:
            at[place[term]] = i
    pair_codes = np.array([p for _, _, p in top if p is not None], np.int64)
    pair_at = np.array([i for i, t in enumerate(top) if t[2] is not None], np.int64)
    order = np.argsort(pair_codes)
    pair_codes, pair_at, known = pair_codes[order], pair_at[order], len(words)

    def count(batches):
        for batch in batches:
            row, codes = _owners(batch.column(len(names) - 1))
            codes = codes.to_numpy()
            idx = at[codes]   # -1, no such word, is the last entry
            row, idx, of = row[idx >= 0], idx[idx >= 0], (row, codes)
            if len(pair_codes):
                row2, pair = _neighbours(*of, known)
                found = np.minimum(np.searchsorted(pair_codes, pair), len(pair_codes) - 1)
                hit = pair_codes[found] == pair
                row, idx = np.concatenate([row, row2[hit]]), np.concatenate([idx, pair_at[found[hit]]])
            entries, n = np.unique(row * np.int64(k) + idx, return_counts=True)
            ends = np.searchsorted(entries // k, np.arange(batch.num_rows + 1)) if k else np.zeros(batch.num_rows + 1, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(ends, (entries % k if k else entries).astype(np.int32)), _lists(ends, n.astype(np.int32))],
                                             [*names[:-1], "idx", "tf"])

    ints = T.ArrayType(T.IntegerType())
    counted_kinds = T.StructType([*kinds[:-1], T.StructField("idx", ints), T.StructField("tf", ints)])

    def counted(df):
        return df.mapInArrow(count, counted_kinds)

    def merged(df):
        """Rows of one key are one document."""
        each = counted(df).select(key, F.explode(F.arrays_zip("idx", "tf")).alias("e")).groupBy(key, "e.idx").agg(F.sum("e.tf").cast("int").alias("tf"))
        both = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "tf"))).alias("e"))
        return both.select(key, F.col("e.idx").alias("idx"), F.col("e.tf").alias("tf"))

    def repeats(df):
        return df.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).limit(1).count() > 0

    again = repeats(held) or (own is not held and repeats(own))
    df = np.zeros(len(top))
    for r in (merged if again else counted)(own).select(F.explode("idx").alias("idx")).groupBy("idx").count().collect():   # <= k rows
        df[r["idx"]] = r["count"]
    idf = np.log((1.0 + src.count()) / (1.0 + df)) + 1.0
    if again:
        none = F.array().cast("array<int>")
        rows = held.select(key).join(merged(held), key, "left").select(key, F.coalesce("idx", none).alias("idx"), F.coalesce("tf", none).alias("tf"))
        rows = rows.join(held.select(key, *keep), key).select(key, *keep, "idx", "tf") if keep else rows
    else:
        rows = counted(held).drop("fit")

    def weigh(batches):
        for batch in batches:
            row, idx = _owners(batch.column(batch.num_columns - 2))
            w = _owners(batch.column(batch.num_columns - 1))[1].to_numpy() * idf[idx.to_numpy()]
            w = w / np.sqrt(np.bincount(row, w * w, batch.num_rows))[row]
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], _lists(ends, idx), _lists(ends, pa.array(w))], [*names[:-2], "idx", "val"])

    return rows.mapInArrow(weigh, T.StructType([*kinds[:-2], T.StructField("idx", ints), T.StructField("val", T.ArrayType(T.DoubleType()))]))


def _tfidf_rows_joined(docs: DataFrame, key: str, tokens: str, k: int, fit_on: DataFrame | None = None) -> DataFrame:
    """``tfidf_rows`` where the words are too many to look up: every term is a row."""
    src = fit_on if fit_on is not None else docs
    fitted = tf_count(src, key, tokens)
    top = F.broadcast(top_terms(fitted, k).select("term", "term_idx"))   # k rows
    idf = idf_table(fitted.join(top.select("term"), "term", "left_semi"), key, F.lit(src.count()))
    weights = tfidf_transform(tf_count(docs, key, tokens).join(top.select("term"), "term", "left_semi"), key, idf).join(top, "term")
    rows = weights.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term_idx", "weight"))).alias("__own"))
    none = F.array().cast("array<struct<term_idx:int,weight:double>>")
    own = docs.select(key).join(rows, key, "left").select(key, F.coalesce("__own", none).alias("__own"))
    return own.select(key, F.col("__own.term_idx").alias("idx"), F.col("__own.weight").alias("val"))


def _entries(batch: pa.RecordBatch):
    """(rows, owner, index, value) of the entries of some sparse rows, ``LSA_STEP`` entries (or one row) at a time."""
    idx, val = batch.column("idx"), batch.column("val")
    at = idx.offsets.to_numpy().astype(np.int64)
    at, index, value = at - at[0], idx.flatten().to_numpy(), val.flatten().to_numpy()
    a, n = 0, batch.num_rows
    while a < n:
        b = max(int(np.searchsorted(at, at[a] + LSA_STEP, "right")) - 1, a + 1)
        yield slice(a, b), np.repeat(np.arange(b - a), np.diff(at[a:b + 1])), index[at[a]:at[b]], value[at[a]:at[b]]
        a = b


def _times(owner, index, value, v: np.ndarray, rows: int) -> np.ndarray:
    """X V of some sparse rows."""
    out = np.zeros((rows, v.shape[1]))
    if len(owner):
        head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[head]] = np.add.reduceat(v[index] * value[:, None], head)
    return out


def _gram_product(rows: DataFrame, v: np.ndarray) -> np.ndarray:
    """X'(X v) of the sparse rows: every task adds up its own part, a (columns x directions) matrix."""
    def product(batches):
        total = np.zeros(v.shape)
        for batch in batches:
            for part, owner, index, value in _entries(batch):
                y = _times(owner, index, value, v, part.stop - part.start)
                order = np.argsort(index, kind="stable")
                if len(order):
                    col = index[order]
                    head = np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1]]))
                    total[col[head]] += np.add.reduceat(y[owner[order]] * value[order][:, None], head)
        return [total]

    return summed(rows, product, [v.shape])[0]


def lsa(rows: DataFrame, key: str, k: int, fit_on: Column | None = None, out: str = "lsa") -> tuple[DataFrame, list[float]]:
    """Truncated SVD (uncentred, like sklearn TruncatedSVD) of sparse rows (key, idx, val):
    the rows of U S as ``out`` array<double>, with all other columns, and the singular values.

    Randomised subspace iteration: ``LSA_PASSES`` + 1 passes over the rows, which are
    written once below the checkpoint folder and are never dense.  A pass
    multiplies a (columns x (k + ``LSA_EXTRA``)) block by X'X; the block is all that
    reaches the driver, bounded by the vocabulary cap.  ``fit_on``: the rows (a
    condition) that the directions come from; all rows are projected.  Each direction
    points to where its largest entry (the first of equal ones) is positive.
    """
    path = scratch_path(rows.sparkSession, "lsa-rows")
    rows.write.parquet(path)
    rows = rows.sparkSession.read.parquet(path)
    fitted = rows.where(fit_on) if fit_on is not None else rows
    n = (fitted.agg(F.max(F.array_max("idx"))).first()[0] or 0) + 1
    kept = fitted.select("idx", "val")
    v = np.linalg.qr(np.random.default_rng(42).normal(size=(n, min(n, k + LSA_EXTRA))))[0]
    for _ in range(LSA_PASSES):
        v = np.linalg.qr(_gram_product(kept, v))[0]
    values, turn = np.linalg.eigh(v.T @ _gram_product(kept, v))
    best = np.argsort(-values)[:k]
    v, singular = v @ turn[:, best], np.sqrt(np.maximum(values[best], 0))
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)

    def project(batches):
        for batch in batches:
            parts = []
            for part, owner, index, value in _entries(batch):
                known = index < n
                parts.append(_times(owner[known], index[known], value[known], v, part.stop - part.start))
            y = np.concatenate(parts) if parts else np.zeros((0, v.shape[1]))
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(y) + 1) * v.shape[1]).astype(np.int32)), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists], [*names, out])

    names = [c for c in rows.columns if c not in ("idx", "val")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    return rows.mapInArrow(project, f"{schema}, `{out}` array<double>"), singular.tolist()
