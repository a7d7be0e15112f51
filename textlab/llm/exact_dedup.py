"""Exact duplicates by content-defined chunk recipes.

Texts are cut where their own content says so, so equal passages give equal
chunks wherever they stand.  Every chunk gets an identifier (a digest) that is
verified: the distinct (identifier, chunk text) pairs are gathered once, and an
identifier that stands for two texts sends the whole step to another digest.
A document is then its recipe, the ordered list of identifiers, 16 bytes for
each chunk instead of some hundred characters.  Texts are cut once, into a stored
table.  Only recipes are grouped and joined: a long text crosses the network
once, as chunks that each task has already made distinct.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch_path

#: Shortest and longest chunk in characters.
MIN_CHUNK, MAX_CHUNK = 256, 2048
ROUNDS = 4


def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space; null as the empty text.

    Lone spaces, by far the most frequent case, already are what they become,
    so the pattern passes over them."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\x20?[\x09-\x0D][\x20\x09-\x0D]*|\x20{2}[\x20\x09-\x0D]*", " ")


def _boundary_class() -> str:
    """Characters (about one of eight) that may end a chunk, by a multiplicative hash of the code point."""
    return "".join(f"\\x{{{c:x}}}" for c in range(0x20, 0x180) if (c * 2654435761 >> 13) & 7 == 3)


def chunk_pattern(shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK) -> str:
    """A chunk ends at the first place past ``shortest`` characters where two
    characters in a row are of the boundary class, or after ``longest``."""
    c = _boundary_class()
    return f"(?s).{{{shortest},{longest}}}?(?<=[{c}][{c}])|.{{1,{longest}}}"


def chunks(text: Column) -> Column:
    """Ordered chunks of a normalised text (none for the empty text)."""
    return F.regexp_extract_all(text, F.lit(chunk_pattern()), F.lit(0))


def digest(chunk: Column, round_no: int) -> Column:
    """128-bit identifier of a chunk; each round is another function."""
    return F.unhex(F.md5(chunk if round_no == 0 else F.concat(F.lit(f"{round_no}:"), chunk)))


def _recipes(texts: DataFrame, round_no: int, identify) -> DataFrame:
    """(__key, text_sha256, __recipe, __chunks), written once: texts are cut in one pass."""
    path = scratch_path(texts.sparkSession, "recipes")
    cut = texts.select("__key", F.sha2("__text", 256).alias("text_sha256"), chunks(F.col("__text")).alias("__chunks"))
    cut.select("__key", "text_sha256", F.transform("__chunks", lambda c: identify(c, round_no)).alias("__recipe"), "__chunks").write.parquet(path)
    return texts.sparkSession.read.parquet(path)


def _verified(recipes: DataFrame) -> bool:
    """True if no identifier stands for two different chunks anywhere."""
    pairs = recipes.select(F.explode(F.arrays_zip("__recipe", "__chunks")).alias("c")).select(
        F.col("c.__recipe").alias("id"), F.col("c.__chunks").alias("chunk")).distinct()
    return pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() == 0


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", identify=digest) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are.  The row with the smallest
    key of its group stays.  Null text: the empty text.  Null key: sorts after
    all keys, so it stays only in a group without keys.  A row that is repeated
    with its key counts in ``group_size`` and gets the same verdict each time.
    An empty table gives an empty table; other columns are not read.
    """
    texts = docs.select(F.col(key).alias("__key"), normalised(F.col(text)).alias("__text"))
    for round_no in range(ROUNDS):
        recipes = _recipes(texts, round_no, identify)
        if _verified(recipes):
            break
    else:
        raise ValueError(f"no verified identifiers in {ROUNDS} rounds")
    # only identifiers are read from here on; the second key makes both sides shuffles of
    # their own, so that Spark can split a very large group
    recipes = recipes.select("__key", "text_sha256", "__recipe", F.pmod(F.xxhash64("__recipe"), F.lit(1009)).alias("__fold"))
    groups = recipes.groupBy("__recipe").agg(F.min("__key").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).select(
        "*", F.pmod(F.xxhash64("__recipe"), F.lit(1009)).alias("__fold"))
    return recipes.join(groups, ["__recipe", "__fold"]).select(
        F.col("__key").alias(key), "keep_id", "group_size",
        F.col("__key").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
