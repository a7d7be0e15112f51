"""Training-data enlargement: seeded word edits and dictionary back-translation.

Word edits run inside higher-order array functions (``filter``/``transform``
over the word array) with randomness keyed by (seed, row key, edit, position),
so a re-run of a lost task, or any partitioning, gives the same copies.

Translation deals the texts into blocks of bounded size.  The distinct words of a
block, not its tokens, are joined with the composed lexicon legs, and what was found
returns to the block, where one task applies it to the block's texts.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..functions.hashing import hash_uniform
from . import joins as J
from . import splits as S


def _u(seed, key: Column, *parts) -> Column:
    return hash_uniform(seed, key, *parts)


def aug_delete(words: Column, key: Column, seed, p: float = 0.2) -> Column:
    """Keep each word with u > p; a one-word text is kept; may delete all.
    ``words`` should be a column reference (it is read once per element)."""
    kept = F.filter(words, lambda w, i: _u(seed, key, "d", i) > F.lit(p))
    return F.when(F.size(words) == 1, words).otherwise(kept)


def _swap_expr(words: Column, i: Column, j: Column) -> Column:
    return F.transform(words, lambda w, pos: F.when(pos == i, F.element_at(words, j + 1))
                       .when(pos == j, F.element_at(words, i + 1)).otherwise(w))


def _insert_expr(words: Column, src: Column, pos: Column) -> Column:
    size = F.size(words)
    return F.concat(F.slice(words, 1, pos), F.array(F.element_at(words, src + 1)),
                    F.slice(words, pos + 1, F.greatest(size - pos, F.lit(0))))


def with_aug_swap(df: DataFrame, words: str, key: str, seed, out: str, n: int = 1) -> DataFrame:
    """Swap two distinct positions, n times; fewer than two words: unchanged.

    The word array and the drawn positions are materialised as columns before
    the element-wise ``transform`` reads them, so each element costs O(1)
    instead of re-deriving the array.
    """
    cur = words
    for k in range(n):
        size = F.size(F.col(cur))
        df = (df.withColumn("__si", F.floor(_u(seed, F.col(key), "s1", k) * size).cast("int"))
                .withColumn("__sj0", F.floor(_u(seed, F.col(key), "s2", k) * (size - 1)).cast("int"))
                .withColumn("__sj", F.when(F.col("__sj0") >= F.col("__si"), F.col("__sj0") + 1).otherwise(F.col("__sj0"))))
        nxt = f"__swap{k}"
        df = df.withColumn(nxt, F.when(size < 2, F.col(cur))
                           .otherwise(_swap_expr(F.col(cur), F.col("__si"), F.col("__sj"))))
        cur = nxt
    return df.withColumn(out, F.col(cur)).drop("__si", "__sj0", "__sj", *[f"__swap{k}" for k in range(n)])


def with_aug_insert(df: DataFrame, words: str, key: str, seed, out: str, n: int = 1) -> DataFrame:
    """Copy a random word of the text to a random position 0..len, n times;
    an empty text is unchanged."""
    cur = words
    for k in range(n):
        size = F.size(F.col(cur))
        df = (df.withColumn("__is", F.floor(_u(seed, F.col(key), "i1", k) * size).cast("int"))
                .withColumn("__ip", F.floor(_u(seed, F.col(key), "i2", k) * (size + 1)).cast("int")))
        nxt = f"__ins{k}"
        df = df.withColumn(nxt, F.when(size == 0, F.col(cur))
                           .otherwise(_insert_expr(F.col(cur), F.col("__is"), F.col("__ip"))))
        cur = nxt
    return df.withColumn(out, F.col(cur)).drop("__is", "__ip", *[f"__ins{k}" for k in range(n)])


def with_augment_text(df: DataFrame, text: str, key: str, seed, out: str,
                      one_word_guard: bool = True) -> DataFrame:
    """Whitespace-split ``text``, apply one of delete / swap / insert chosen by
    floor(3u), join by one space.  A one-word text is returned unchanged
    (original spacing) when the guard is on."""
    d = df.withColumn("__w", TX.tokenize_ws(text))
    d = with_aug_swap(d, "__w", key, seed, "__sw")
    d = with_aug_insert(d, "__w", key, seed, "__in")
    choice = F.floor(_u(seed, F.col(key), "c") * 3)
    words = (F.when(choice == 0, F.filter(F.col("__w"), lambda w, i: _u(seed, F.col(key), "d", i) > F.lit(0.2)))
              .when(choice == 1, F.col("__sw")).otherwise(F.col("__in")))
    joined = F.array_join(words, " ")
    res = F.when(F.size("__w") == 1, F.col(text)).otherwise(joined) if one_word_guard else joined
    return d.withColumn(out, res).drop("__w", "__sw", "__in")


def augment_dataset(df: DataFrame, key: str, text: str, label: str, frac: float, seed=42,
                    sample_seed=42) -> DataFrame:
    """Exact sample of ``frac`` rows, augment each, union with the originals.

    Output keeps provenance: ``src_id`` (original key) and ``variant``
    ('original' / 'augmented').
    """
    orig = df.select(F.col(key).alias("src_id"), F.lit("original").alias("variant"), label, text)
    sampled = S.sample_frac(df.select(key, label, text), key, frac, sample_seed)
    aug = with_augment_text(sampled, text, key, seed, "__aug") \
        .select(F.col(key).alias("src_id"), F.lit("augmented").alias("variant"), label, F.col("__aug").alias(text))
    return orig.unionByName(aug)


# --- dictionary translation ---------------------------------------------------

def compose_lexicons(lexicons: Sequence[DataFrame], lower_lookup: bool = True) -> DataFrame:
    """Fold a chain of lexicon legs into one (src, dst) table on the dictionary
    side.

    Leg i looks up the (lower-cased) output of leg i-1.  Until some leg hits,
    the word is unchanged, so every probe is the lower-cased source word; after
    the first hit the word is a lexicon output.  The chain's result therefore
    depends only on the lower-cased word (or is 'unchanged' when no leg hits),
    and the composition is exact.  Only the small lexicons are joined here;
    the token stream is then joined once.
    """
    keys = None
    for lex in lexicons:
        k = lex.select(F.col("src").alias("__p"))
        keys = k if keys is None else keys.unionByName(k)
    cur = keys.distinct().withColumn("__v", F.lit(None).cast("string"))
    for i, lex in enumerate(lexicons):
        probe = F.coalesce(F.lower("__v") if lower_lookup else F.col("__v"), F.col("__p"))
        lx = lex.select(F.col("src").alias(f"__s{i}"), F.col("dst").alias(f"__d{i}"))
        cur = cur.withColumn(f"__k{i}", probe).join(lx, F.col(f"__k{i}") == F.col(f"__s{i}"), "left") \
                 .select("__p", F.coalesce(F.col(f"__d{i}"), F.col("__v")).alias("__v"))
    return cur.where(F.col("__v").isNotNull()).select(F.col("__p").alias("src"), F.col("__v").alias("dst"))


#: Characters of the texts of one block, about.  A task holds the distinct words of a block with
#: their translations, whatever the size of the corpus or of the lexicons.
BLOCK_CHARS = 1 << 23
#: Distinct words that a task holds before it passes them on.
HELD_WORDS = 1 << 20
#: Rows of words in one Arrow batch.
WORD_ROWS = 1 << 16


def distinct_words(df: DataFrame, text: str, out: str = "w") -> DataFrame:
    """(out): the distinct lower-cased words of all texts.  A task passes on its own distinct
    words (``HELD_WORDS`` at a time), so the shuffle carries them and not the tokens."""
    def own(batches):
        seen: set = set()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t is not None:
                    seen.update(t.split())
                if len(seen) >= HELD_WORDS:
                    yield from _word_batches([], list(seen), out)
                    seen = set()
        yield from _word_batches([], list(seen), out)

    return df.select(text).mapInArrow(own, f"`{out}` string").select(F.lower(out).alias(out)).distinct()


def _word_batches(lead: list, words: list, name: str) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(words), WORD_ROWS):
        part = words[a:a + WORD_ROWS]
        yield pa.RecordBatch.from_arrays([*(pa.array([v] * len(part), pa.int32()) for v in lead), pa.array(part, pa.string())],
                                         [*(["__block"] if lead else []), name])


def _block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(__block, __w): the distinct words of each block; a block lies in one partition."""
    seen: dict = {}
    for batch in batches:
        for block, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if t is not None:
                seen.setdefault(block, set()).update(t.split())
    for block, words in seen.items():
        yield from _word_batches([block], list(words), "__w")


class _Dictionary:
    """The translations of a block's words by one chain of legs.  A word that the lexicon holds
    several times becomes all of its translations, in ascending order."""

    def __init__(self):
        self.one: dict = {}
        self.many: dict = {}

    def add(self, word: str, dst: str):
        if word in self.one:
            self.many.setdefault(word, [self.one[word]]).append(dst)
        else:
            self.one[word] = dst

    def all(self, word: str) -> list:
        return self.many.get(word) or [self.one.get(word, word)]

    def text(self, texts: list) -> str:
        """The translated words of the texts of one key, which is one text where keys are unique;
        of several, the words are in order of position, then ascending."""
        if len(texts) == 1 and not self.many:
            get = self.one.get
            return " ".join([get(w, w) for w in (texts[0] or "").split()])
        placed = [(i, x) for t in texts if t is not None for i, w in enumerate(t.split()) for x in self.all(w)]
        return " ".join([x for _, x in sorted(placed)])


def _translated(df: DataFrame, key: str, text: str, chains: Mapping[str, Sequence[DataFrame]], lower_lookup: bool, rows: bool) -> DataFrame:
    """``translations`` by several chains of legs (out -> lexicons) at once.  ``rows``: every row of ``df``
    that has a key, with all its columns; otherwise one row a key."""
    own = df.select(key, *[c for c in df.columns if rows and c != key or c == text])
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-chars // BLOCK_CHARS))
    docs = own.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    words = docs.select("__block", text).repartitionById(n, "__block").mapInArrow(_block_words, "__block int, __w string")
    legs = None
    for i, lexicons in enumerate(chains.values()):
        lex = lexicons[0] if len(lexicons) == 1 else compose_lexicons(lexicons, lower_lookup)
        lex = lex.select(F.col("src").alias("__src"), F.col("dst").alias("__dst"), F.lit(i).alias("__chain"))
        legs = lex if legs is None else legs.unionByName(lex)
    probe = F.lower("__w") if lower_lookup else F.col("__w")
    found = words.join(legs, probe == F.col("__src")).select("__block", "__w", F.coalesce("__dst", "__w").alias("__dst"), "__chain")
    every = found.unionByName(docs, allowMissingColumns=True).repartitionById(n, "__block")
    # of a block its dictionary comes first, then its texts in order of the key
    every = every.sortWithinPartitions("__block", F.col("__w").isNull(), key)
    outs, kept = list(chains), [c for c in own.columns if rows or c == key]

    def run(table: pa.Table, starts: list, known: list) -> pa.RecordBatch:
        texts, ends = table.column(text).to_pylist(), [*starts[1:], table.num_rows]
        made = [[d.text(texts[a:b]) for a, b in zip(starts, ends)] for d in known]
        if rows:
            made = [[v for v, a, b in zip(m, starts, ends) for _ in range(b - a)] for m in made]
        else:
            table = table.take(starts)
        out = table.select(kept)
        for name, m in zip(outs, made):
            out = out.append_column(name, pa.array(m, pa.string()))
        return out.combine_chunks().to_batches()

    def apply(batches):
        block, known, rest = None, [], None
        for batch in batches:
            at, blocks = 0, batch.column("__block").to_pylist()
            while at < len(blocks):
                end = at
                while end < len(blocks) and blocks[end] == blocks[at]:
                    end += 1
                if blocks[at] != block:
                    if rest is not None:
                        yield from run(rest, [0], known)
                    block, known, rest = blocks[at], [_Dictionary() for _ in outs], None
                part = batch.slice(at, end - at)
                at = end
                w = part.column("__w")
                n_words = len(w) - w.null_count
                for x, dst, chain in zip(w.slice(0, n_words).to_pylist(), part.column("__dst").slice(0, n_words).to_pylist(),
                                         part.column("__chain").slice(0, n_words).to_pylist()):
                    known[chain].add(x, dst)
                if n_words == part.num_rows:
                    continue
                table = pa.Table.from_batches([part.slice(n_words)])
                if rest is not None:
                    table = pa.concat_tables([rest, table])
                keys = table.column(key).to_pylist()
                starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])]
                if len(starts) > 1:
                    yield from run(table.slice(0, starts[-1]), starts[:-1], known)
                rest = table.slice(starts[-1])   # more rows of this key may follow
        if rest is not None:
            yield from run(rest, [0], known)

    schema = T.StructType([*(T.StructField(c, own.schema[c].dataType) for c in kept), *(T.StructField(c, T.StringType()) for c in outs)])
    out = every.mapInArrow(apply, schema)
    return out.where(F.col(key).isNotNull()) if rows else out


def translations(df: DataFrame, key: str, text: str, lexicons: Sequence[DataFrame],
                 out: str = "translated", lower_lookup: bool = True) -> DataFrame:
    """(key, out): per-word substitution through one or more lexicons (src, dst) applied in
    order; unknown words are kept, word order is kept, words are re-joined by one
    space.  A text without words becomes ''.

    Several legs are composed on the dictionary side first.  Texts are dealt into blocks
    of about ``BLOCK_CHARS`` characters by their keys; the distinct words of each block
    are joined with the lexicon (a plain join, however large it is), and a block's task
    applies what was found for it.  Tokens are never rows.
    """
    return _translated(df, key, text, {out: lexicons}, lower_lookup, rows=False)


def lexicon_translate(df: DataFrame, key: str, text: str, lexicons: Sequence[DataFrame],
                      out: str = "translated", lower_lookup: bool = True) -> DataFrame:
    """``df`` with its texts' ``translations``; keys are unique."""
    return _translated(df, key, text, {out: lexicons}, lower_lookup, rows=True)


def parallel_translate(df: DataFrame, key: str, text: str, chains: Mapping[str, Sequence[DataFrame]]) -> DataFrame:
    """``df`` with its texts' ``translations`` by several chains of legs (out -> lexicons): the
    texts are dealt out and cut into words once for all of them."""
    return _translated(df, key, text, chains, True, rows=True)


def back_translate(df: DataFrame, key: str, text: str, legs: Sequence[DataFrame],
                   out: str = "bt_text") -> DataFrame:
    """Back-translation as a chain of lexicon legs (1-phase: id->en->id with two
    legs; 2-phase: id->en->he->id with three or more)."""
    return lexicon_translate(df, key, text, legs, out)


def stack_bt(df: DataFrame, key: str, text: str, bt: str, label: str) -> DataFrame:
    """Originals then their back-translations, label repeated, with pair_id."""
    o = df.select(F.col(key).alias("pair_id"), F.lit("original").alias("variant"), label, F.col(text).alias("text"))
    b = df.select(F.col(key).alias("pair_id"), F.lit("back_translated").alias("variant"), label,
                  F.col(bt).alias("text"))
    return o.unionByName(b)


_DIVERSITY = T.StructType([T.StructField("jaccard", T.DoubleType()), T.StructField("changed", T.DoubleType())])


def _diversity(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = []
    for x, y in zip(a, b):
        if x is None or y is None:
            known = x if x is not None else y
            rows.append((None, 0.0 if known is not None and not known.split() else None))
            continue
        ta, tb = x.split(), y.split()
        sa, sb = set(ta), set(tb)
        inter, longest = len(sa & sb), max(len(ta), len(tb))
        union = len(sa) + len(sb) - inter
        diff = longest - min(len(ta), len(tb)) + sum(map(operator.ne, ta, tb))
        rows.append((inter / union if union else 1.0, diff / longest if longest else 0.0))
    return pd.DataFrame(rows, columns=["jaccard", "changed"], dtype="float64")


def bt_diversity(a: Column, b: Column) -> tuple[Column, Column]:
    """(token Jaccard, share of positions changed) between original and copy.  Both come from
    one call, which splits each text once.  Without one of the texts there is no Jaccard,
    and a share (0) only if the other has no words."""
    both = F.pandas_udf(_diversity, _DIVERSITY)(a, b)
    return both["jaccard"], both["changed"]


#: Training styles and the variants of the training texts that each one holds.
STYLE_VARIANTS = {"natural": ("original",), "augment": ("original", "augmented"), "1pBT": ("original", "bt_1p"), "2pBT": ("original", "bt_2p")}
STYLES = tuple(STYLE_VARIANTS)


def variants(par: DataFrame, key: str, label: str, val_frac: float = 0.2, seed=42, aug_frac: float = 0.49, aug_seed=42) -> DataFrame:
    """Every text of every style once: (split, src_id, variant, label, text).

    ``par`` has (key, label, text, bt1, bt2): originals and their 1-phase / 2-phase
    back-translations.  Validation rows are originals only (no copy of a validation
    text enters training).  A row's variants come from one reading of it.
    """
    s = S.holdout_split(par, key, val_frac, seed)
    train = F.col("split") == "train"

    def variant(name, col):
        return F.struct(F.lit(name).alias("variant"), F.col(col).alias("text"))

    kinds = F.when(train, F.array(variant("original", "text"), variant("bt_1p", "bt1"), variant("bt_2p", "bt2"))).otherwise(
        F.array(variant("original", "text")))
    own = s.select("split", F.col(key).alias("src_id"), label, F.explode(kinds).alias("v")).select("split", "src_id", "v.variant", label, "v.text")
    aug = with_augment_text(S.sample_frac(s.where(train).select(key, label, "text"), key, aug_frac, aug_seed), "text", key, aug_seed, "__aug")
    return own.unionByName(aug.select(F.lit("train").alias("split"), F.col(key).alias("src_id"), F.lit("augmented").alias("variant"), label,
                                      F.col("__aug").alias("text")))


def adjust_data(par: DataFrame, key: str, label: str, val_frac: float = 0.2, seed=42,
                aug_frac: float = 0.49, aug_seed=42) -> DataFrame:
    """One table holding every style's training set and the shared validation set:
    (style, split, src_id, variant, label, text).  A variant names the styles that
    hold it; rows are read once, not once per style."""
    of = F.create_map(*[x for v in {v for vs in STYLE_VARIANTS.values() for v in vs}
                        for x in (F.lit(v), F.array(*[F.lit(s) for s, vs in STYLE_VARIANTS.items() if v in vs]))])
    rows = variants(par, key, label, val_frac, seed, aug_frac, aug_seed)
    return rows.select(F.explode(of[F.col("variant")]).alias("style"), "split", "src_id", "variant", label, "text")


def style_grid(adjusted: DataFrame, label: str) -> DataFrame:
    """Sizes and label mix of every (style, split) in one aggregation."""
    return adjusted.groupBy("style", "split", label).agg(F.count(F.lit(1)).alias("n"))
