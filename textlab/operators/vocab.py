"""Vocabulary, token-id sequences, padding, embedding lookup and pooling.

Words are counted per batch of documents before the shuffle, so a very frequent word
is pre-counted in every task.  A vocabulary capped at ``n_words`` entries is a bounded
dimension: every task looks its tokens up, and documents travel as arrays of ids.
With the uncapped one, token work is ``posexplode`` -> join -> ordered re-collect.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from . import rank as R


def build_vocab(docs: DataFrame, key: str, tokens: str | Column) -> DataFrame:
    """word -> (n, idx): idx 1.. by count descending, ties by first appearance
    (document key, then position), like Keras ``Tokenizer.fit_on_texts``.

    ``key`` is an integer.  The first appearance is one decimal number
    (key * 2**31 + position), so words are counted by hash aggregation.  The rank
    over the distinct words runs in ranges of (count, first appearance): words of
    one count are cut into ranges of about ``RANGE`` words at approximate quantiles
    of their first appearance, the ranges are numbered in two levels, and
    ``row_number`` runs inside a range.
    """
    d = docs.select(F.col(key).cast("long").alias(key), tokens if isinstance(tokens, Column) else F.col(tokens))
    return _ranked_words(d.mapInArrow(_word_counts, T.StructType([
        T.StructField(key, T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("token", T.StringType()),
        T.StructField("n", T.LongType())])), key, F.sum("n"))


def vocab_of(t: DataFrame, key: str) -> DataFrame:
    """``build_vocab`` of tokens that are rows already: (key, pos, token)."""
    return _ranked_words(t, key, F.count(F.lit(1)))


def _word_counts(batches):
    """(key, pos, token, n): the words of each batch of (key, tokens), with their number and
    first place in it.  Rows without a key count, but have no place."""
    for batch in batches:
        known = pc.is_valid(batch.column(0))
        for rows in (batch.filter(known), batch.filter(pc.invert(known))):
            rows = rows.filter(pc.is_valid(rows.column(1)))
            if not rows.num_rows:
                continue
            with_key = not rows.column(0).null_count
            if with_key:
                rows = rows.take(pc.sort_indices(rows.column(0)))
            lists = rows.column(1)
            at = lists.offsets.to_numpy().astype(np.int64)
            at, flat = at - at[0], lists.flatten()
            owner = np.repeat(np.arange(rows.num_rows), np.diff(at))
            place = np.flatnonzero(flat.is_valid().to_numpy(zero_copy_only=False))
            keys = rows.column(0).to_numpy() if with_key else np.zeros(rows.num_rows, np.int64)
            if (keys[1:] == keys[:-1]).any():   # rows of one key: the least position comes first
                place = place[np.lexsort(((place - at[owner[place]]), keys[owner[place]]))]
            coded = flat.take(pa.array(place)).dictionary_encode()
            codes, words = coded.indices.to_numpy(), coded.dictionary
            first = np.zeros(len(words), np.int64)
            first[codes[::-1]] = place[::-1]    # the first of each word is written last
            lead = pa.array(keys[owner[first]]) if with_key else pa.nulls(len(words), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [lead, pa.array((first - at[owner[first]]).astype(np.int32)), words.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(words)).astype(np.int64))],
                [batch.schema.names[0], "pos", "token", "n"])


def _ranked_words(t: DataFrame, key: str, n: Column) -> DataFrame:
    place = (F.col(key).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos")).cast("decimal(38,0)")
    counts = t.groupBy("token").agg(n.alias("n"), F.min(place).alias("first"))
    # The word table is read several times below; it is materialised once with a
    # reliable checkpoint instead of re-exploding every document each time.
    R.ensure_checkpoint(t.sparkSession)
    counts = counts.checkpoint(eager=True)
    n_ranges = max(1, counts.count() // RANGE)
    counts = R.with_quantile_bucket(counts, "first", "__range", min(n_ranges, MAX_RANGES), 1.0 / (4 * min(n_ranges, MAX_RANGES)))
    # level 1: words per count (few distinct counts per task, ranked in key order by count);
    # level 2: within a count, words per range
    per_range = counts.groupBy("n", "__range").agg(F.count(F.lit(1)).alias("__c"))
    per_count = per_range.groupBy("n").agg(F.sum("__c").alias("__c"))
    before_count = R.running_total(per_count, "n", "__c", "__before", descending=True)
    w = Window.partitionBy("n").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.withColumn("__in", F.coalesce(F.sum("__c").over(w), F.lit(0))).join(before_count, "n") \
                       .select("n", "__range", (F.col("__before") + F.col("__in")).alias("__offset"))
    inside = Window.partitionBy("n", "__range").orderBy("first")
    ranked = counts.join(offsets, ["n", "__range"]).withColumn("idx", F.col("__offset") + F.row_number().over(inside))
    return ranked.select("token", F.col("n").cast("long").alias("n"), F.col("idx").cast("long").alias("idx"))


#: Words of one range, about; most ranges (their bounds pass through the driver).
RANGE, MAX_RANGES = 50_000, 4096

#: A side is broadcast only if its rows, at these bytes each, stay below the bound.
MAX_BROADCAST_BYTES, WORD_BYTES = 64 << 20, 128


def capped_vocab(vocab: DataFrame, n_words: int | None) -> DataFrame:
    """Entries usable as ids: Keras drops ids >= num_words.  The cap bounds the
    rows, and at ``WORD_BYTES`` a word the bytes: the broadcast hint is given only
    below ``MAX_BROADCAST_BYTES``; otherwise (or uncapped) AQE plans the join."""
    if n_words is None:
        return vocab
    capped = vocab.where(F.col("idx") < n_words)
    return F.broadcast(capped) if n_words * WORD_BYTES <= MAX_BROADCAST_BYTES else capped


def _positions(docs: DataFrame, key: str, tokens: str | Column) -> DataFrame:
    """(key, pos, token), one row for each token; a document without tokens keeps one row of nulls."""
    return docs.select(key, F.posexplode_outer(tokens).alias("pos", "token"))


def _looked_up(docs: DataFrame, key: str, tokens: str | Column, vocab: DataFrame, n_words: int | None, value: str, out: str) -> DataFrame:
    """``_ordered`` of whole documents.  Below ``MAX_BROADCAST_BYTES`` the capped vocabulary goes
    to every task, which replaces a document's tokens where they lie; what crosses the
    network is one array a document (tokens that are not in the vocabulary are nulls until
    the rows of a key are together, so that several keep the order of their positions)."""
    def by_join():
        return _ordered(_positions(docs, key, tokens), key, capped_vocab(vocab, n_words), value, out)

    if n_words is None or n_words * WORD_BYTES > MAX_BROADCAST_BYTES:
        return by_join()
    entries = [r for r in vocab.where(F.col("idx") < n_words).select("token", F.col(value).alias("v")).collect() if r["token"] is not None]
    if len({r["token"] for r in entries}) < len(entries):
        return by_join()
    kind, arrow = (T.LongType(), pa.int64()) if value == "idx" else (T.StringType(), pa.string())
    held = docs.sparkSession.sparkContext.broadcast(([r["token"] for r in entries], [r["v"] for r in entries]))

    def look_up(batches):
        words, values = pa.array(held.value[0], pa.string()), pa.array(held.value[1], arrow)
        for batch in batches:
            lists = batch.column(1)
            at = lists.offsets.to_numpy()
            found = values.take(pc.index_in(lists.flatten(), value_set=words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), found)], [key, "__v"])

    d = docs.select(key, tokens if isinstance(tokens, Column) else F.col(tokens))
    rows = d.mapInArrow(look_up, T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("__v", T.ArrayType(kind))]))
    own = rows.groupBy(key).agg(F.collect_list("__v").alias("__l"))
    placed = F.array_sort(F.flatten(F.transform("__l", lambda a: F.transform(a, lambda x, i: F.struct(i.alias("pos"), x.alias("x"))))))
    one = F.when(F.size("__l") == 1, F.col("__l")[0]).otherwise(F.transform(placed, lambda s: s["x"]))
    return own.select(key, F.array_compact(one).alias(out))


def _ordered(t: DataFrame, key: str, vocab: DataFrame, value: str, out: str) -> DataFrame:
    """Per document the vocabulary's ``value`` of its tokens, in order; tokens that are not in
    it are left out.  The row of nulls keeps empty documents, so nothing is joined back."""
    j = t.join(vocab.select(F.col("token").alias("__t"), F.col(value).alias("__v")), F.col("token") == F.col("__t"), "left")
    own = F.array_sort(F.collect_list(F.when(F.col("__v").isNotNull(), F.struct("pos", "__v"))))
    return j.groupBy(key).agg(own.alias("__s")).select(key, F.transform("__s", lambda x: x["__v"]).alias(out))


def texts_to_sequences(docs: DataFrame, key: str, tokens: str, vocab: DataFrame,
                       n_words: int | None = None, out: str = "seq") -> DataFrame:
    """Token arrays -> id arrays in order; OOV and ids >= n_words dropped.
    Every document is kept (empty sequence when nothing survives); keys are unique."""
    return _looked_up(docs, key, tokens, vocab, n_words, "idx", out)


def custom_tokenizer(docs: DataFrame, key: str, tokens: str, vocab: DataFrame,
                     n_words: int | None = None, out: str = "kept") -> DataFrame:
    """Keep in-vocabulary tokens as strings, order kept."""
    return _looked_up(docs, key, tokens, vocab, n_words, "token", out)


# --- a token table that keeps its partitioning ---

def save_tokens(docs: DataFrame, key: str, tokens: str | Column, name: str, path: str, buckets: int) -> DataFrame:
    """Saves (key, pos, token) as table ``name`` at ``path``, bucketed and sorted by key.

    The tokens cross the network once, here.  Whatever groups, windows or joins by
    document then reads them as they lie, without an exchange, in any later job of
    the catalogue that holds the table."""
    rows = _positions(docs.repartition(buckets, key), key, tokens)
    rows.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return docs.sparkSession.table(name)


def saved_tf(table: DataFrame, key: str) -> DataFrame:
    """(key, term, tf) of a saved token table."""
    return table.where(F.col("token").isNotNull()).groupBy(key, F.col("token").alias("term")).agg(F.count(F.lit(1)).alias("tf"))


def saved_sequences(table: DataFrame, key: str, vocab: DataFrame, n_words: int | None, value: str = "idx", out: str = "seq") -> DataFrame:
    """As ``texts_to_sequences`` (``value`` idx) or ``custom_tokenizer`` (token), of a saved token table."""
    return _ordered(table, key, capped_vocab(vocab, n_words), value, out)


def pad_pre(df: DataFrame, seq: str, maxlen: int | None = None, out: str = "padded") -> DataFrame:
    """Keras ``pad_sequences``: left-pad with 0 to ``maxlen`` (default: the
    longest sequence, a scalar subquery); longer sequences keep their tail.
    The zeros are of the ids' own type."""
    L = F.lit(maxlen) if maxlen is not None else F.lit(df.agg(F.max(F.size(seq))).scalar())
    s = F.col(seq)
    tail = F.when(F.size(s) > L, F.slice(s, F.size(s) - L + 1, L)).otherwise(s)
    pad = F.array_repeat(F.lit(0).cast(df.schema[seq].dataType.elementType), F.greatest(L - F.size(tail), F.lit(0)))
    return df.withColumn(out, F.concat(pad, tail))


def encode_fixed(df: DataFrame, seq: str, max_len: int = 128, ids_out: str = "input_ids",
                 mask_out: str = "attention_mask") -> DataFrame:
    """Right-pad / truncate to ``max_len`` with an attention mask of 1/0."""
    s = F.col(seq)
    ids = F.slice(F.concat(s, F.array_repeat(F.lit(0).cast("long"), max_len)), 1, max_len)
    mask = F.transform(F.sequence(F.lit(1), F.lit(max_len)), lambda i: F.when(i <= F.size(s), 1).otherwise(0))
    return df.withColumn(ids_out, ids).withColumn(mask_out, mask)


def batch_rows(df: DataFrame, key: str, batch_size: int, seed=None, out: str = "batch") -> DataFrame:
    """Minibatch id floor((rank - 1) / B) in stored order, or shuffled with a seed."""
    r = R.key_rank(df, key, "__r") if seed is None else R.hash_rank(df, key, seed, "__r")
    return r.withColumn(out, F.floor((F.col("__r") - 1) / batch_size).cast("long")).drop("__r")


def pad_dynamic(df: DataFrame, key: str, seq: str, batch_size: int, seed=None,
                out: str = "padded_len") -> DataFrame:
    """Pad each batch to its own longest sequence (window over a batch of B rows)."""
    b = batch_rows(df, key, batch_size, seed)
    return b.withColumn(out, F.max(F.size(seq)).over(Window.partitionBy("batch")).cast("long"))


def embedding_lookup(vocab: DataFrame, vectors: DataFrame, key: str, vec: str, dim: int,
                     n_words: int | None = None) -> DataFrame:
    """Vocabulary rows (idx < n_words) get their vector, unmatched get zeros.

    Vectors are first semi-joined to the capped vocabulary; the matched ones, at
    most ``n_words`` of ``dim`` floats, are broadcast back below ``MAX_BROADCAST_BYTES``.
    """
    v = capped_vocab(vocab, n_words)
    matched = vectors.join(v.select(key), key, "left_semi")
    if n_words is not None and n_words * dim * 4 <= MAX_BROADCAST_BYTES:
        matched = F.broadcast(matched)
    out = v.join(matched.select(key, F.col(vec).alias("__v")), key, "left")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return out.withColumn("has_vector", F.col("__v").isNotNull().cast("int")) \
              .withColumn(vec, F.coalesce(F.col("__v"), zeros)).drop("__v")


def pool_max(df: DataFrame, group: str, vec: str) -> DataFrame:
    """Element-wise max of the vectors in each group (pads are not masked).

    posexplode the vector and aggregate (group, dim) with partial aggregation,
    then re-collect D values in dimension order: no per-group list of vectors.
    """
    e = df.select(group, F.posexplode(vec).alias("dim", "x"))
    m = e.groupBy(group, "dim").agg(F.max("x").alias("x"))
    coll = m.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("__s"))
    return coll.select(group, F.transform("__s", lambda s: s["x"]).alias(vec))


def pool_first(df: DataFrame, group: str, order: str, vec: str) -> DataFrame:
    """Vector of the first row (by ``order``) of each group (the CLS position).

    The least order value of each group comes from a hash aggregate over two narrow
    columns; the vectors of those rows alone are fetched then."""
    first = df.groupBy(F.col(group).alias("__g")).agg(F.min(order).alias("__o"))
    own = df.join(first, F.col(group).eqNullSafe(F.col("__g")) & (F.col(order) == F.col("__o")), "left_semi")
    return own.select(group, vec)


def synonym_lookup(words: DataFrame, word: str, synonyms: DataFrame, synset: str = "synset",
                   lemma: str = "lemma", out: str = "synonyms") -> DataFrame:
    """All distinct lemma names of all synsets holding the word.

    Members are collected once per synset (not per pair of lemmas); a word in
    several synsets unions their member lists.
    """
    members = synonyms.groupBy(synset).agg(F.collect_set(lemma).alias("__m"))
    w2s = words.select(word).distinct().join(synonyms.select(F.col(lemma).alias(word), synset), word)
    j = w2s.join(members, synset)
    return j.groupBy(word).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__m")))).alias(out))
