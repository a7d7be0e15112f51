"""Repair of conversation structure by weighted interval parsing (CYK).

A conversation should read as an optional system turn and then pairs of a user's
and an assistant's turn.  The repair grammar, in Chomsky normal form, has one
nonterminal for each pair of places p -> q in that pattern:

    (p, q) -> (p, r) (r, q)           two neighbouring spans
    (p, q) -> one row                 kept, reroled or deleted
    (p, q) -> nothing                 turns inserted to get from p to q

A cell holds the cheapest (cost, audit) by which a span of rows leads from p to
q; an audit lists the edits' initials (Delete, Insert, Keep, Rerole), and of
equally cheap ones the ASCII-least counts.  Cells are closed under insertion at
both ends, and combined bottom-up by span length over every split.  The cost
follows from the audit and the rows, so of two equally cheap audits of a span none
begins with the other, and the least of a span is made of the least of its parts.

Charts span up to ``SPAN`` rows, many conversations of one length at once: cost and
audit are one 64-bit number there, whose order is theirs.  Longer conversations
are parsed in charts whose tokens are the spans below them.  That also holds across
tasks: rows are sorted over the cluster, each task parses the spans it holds, and
the spans of a conversation that lies on several tasks are combined by a last chart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import stored

#: Rows (or spans) in one chart.
SPAN = 12
#: Places of the pattern are 0 (nothing yet), 1 (after the system turn),
#: 2 (after a user's turn) and 3 (after an assistant's); a conversation ends at 0 or 3.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LETTERS = b"DIKR"  # in ASCII order, two bits each
ROLES = {"u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\x0c\r"

Cell = tuple[int, bytes]


def _reachable() -> list[tuple[int, int]]:
    pairs = {(p, p) for p in range(4)}
    while True:
        more = pairs | {(p, q) for p, r in pairs for (x, _), q in STEPS.items() if x == r}
        if more == pairs:
            return sorted(pairs)
        pairs = more


#: Nonterminals, and the rules (left part, right part) of each, in its order.
PAIRS = _reachable()
RULES = [[(PAIRS.index((p, r)), PAIRS.index((r, q))) for r in range(4) if (p, r) in PAIRS and (r, q) in PAIRS] for p, q in PAIRS]
_LEFT = np.array([a for rules in RULES for a, _ in rules])
_RIGHT = np.array([b for rules in RULES for _, b in rules])
_FIRST = np.cumsum([0, *map(len, RULES)])[:-1]


# --- cells as (cost, audit) ---

def joined(left: list[Cell | None], right: list[Cell | None]) -> list[Cell | None]:
    """Cells of two neighbouring spans as one."""
    out = []
    for rules in RULES:
        best = None
        for a, b in rules:
            x, y = left[a], right[b]
            if x is not None and y is not None and (best is None or x[0] + y[0] <= best[0]):
                cell = (x[0] + y[0], x[1] + y[1])
                if best is None or cell < best:
                    best = cell
        out.append(best)
    return out


def least(options: list[list[Cell | None]]) -> list[Cell | None]:
    return [min((c for c in cells if c is not None), default=None) for cells in zip(*options)]


def _inserted() -> list[Cell | None]:
    """Cells of the empty span: the fewest insertions from one place to another."""
    steps = {(x, y) for (x, role), y in STEPS.items() if role in ROLES}
    cells = {(p, p): (0, b"") for p in range(4)}
    for _ in range(4):
        for x, y in steps:
            for p in range(4):
                if (p, x) in cells:
                    cost, audit = cells[p, x]
                    cells[p, y] = min(cells.get((p, y), (99, b"")), (cost + INSERT, audit + b"I"))
    return [cells.get(pair) for pair in PAIRS]


EMPTY = _inserted()


def deleted(n: int) -> list[Cell | None]:
    """Cells of ``n`` rows that have to go."""
    return joined([(DELETE * n, b"D" * n) if p == q else None for p, q in PAIRS], EMPTY)  # D is before I


def row_cells(role: str, kind: int) -> list[Cell | None]:
    """Cells of one row by its role's initial and kind: 0 sound, 1 truncated, 2 to be deleted."""
    cells: dict[tuple[int, int], Cell] = {(p, p): (DELETE, b"D") for p in range(4)}
    if kind < 2:
        for (p, letter), q in STEPS.items():
            if letter == role:
                option = (KEEP + TRUNCATED * kind, b"K")
            elif letter in ROLES:
                option = (REROLE + TRUNCATED * kind, b"R")
            else:
                continue
            cells[p, q] = min(cells.get((p, q), option), option)
    return joined(joined(EMPTY, [cells.get(pair) for pair in PAIRS]), EMPTY)


def chart(spans: list[list[Cell | None]]) -> list[Cell | None]:
    """Cells of the whole of at most a few neighbouring spans: every span length, every split."""
    table = {(i, 1): cells for i, cells in enumerate(spans)}
    for size in range(2, len(spans) + 1):
        for i in range(len(spans) - size + 1):
            table[i, size] = least([joined(table[i, k], table[i + k, size - k]) for k in range(1, size)])
    return table[0, len(spans)] if spans else EMPTY


class Tower:
    """Cells of a growing row of spans: charts of ``SPAN`` spans, charts of those, and so on."""

    def __init__(self):
        self.levels: list[list] = []

    def add(self, cells: list[Cell | None], level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(cells)
        if len(self.levels[level]) == SPAN:
            whole = chart(self.levels[level])
            self.levels[level] = []
            self.add(whole, level + 1)

    def cells(self) -> list[Cell | None]:
        parts = [cells for level in reversed(self.levels) for cells in level]
        while len(parts) > 1:
            parts = [chart(parts[a:a + SPAN]) for a in range(0, len(parts), SPAN)]
        return parts[0] if parts else EMPTY


def best(cells: list[Cell | None]) -> Cell:
    """The cheapest whole parse."""
    return min(cells[PAIRS.index((0, q))] for q in ENDS if cells[PAIRS.index((0, q))] is not None)


# --- cells as numbers: cost above 54 bits of letters, first letter highest ---

_BITS = 54  # 27 letters: SPAN rows and at most one insertion around each
_AUDIT = np.int64((1 << _BITS) - 1)
_NONE = np.int64(200) << _BITS
_ODD = np.int64(sum(1 << b for b in range(0, _BITS, 2)))


def _packed(cells: list[Cell | None]) -> list[int]:
    return [int(_NONE) if c is None else c[0] << _BITS | sum(LETTERS.index(x) << _BITS - 2 - 2 * i for i, x in enumerate(c[1])) for c in cells]


KINDS = 3
INITIALS = "sua"  # any other initial is numbered after them
_ROWS = np.array([_packed(row_cells(role, kind)) for role in (*INITIALS, "?") for kind in range(KINDS)], np.int64)


def _lengths(cells: np.ndarray, rows: int) -> np.ndarray:
    """Letters of each audit: its rows and its insertions (the letter 01)."""
    return np.where(cells < _NONE, rows + np.bitwise_count(cells & _ODD & ~(cells >> 1)).astype(np.int64), 0)


def charts(rows: np.ndarray) -> np.ndarray:
    """Cells of whole spans of equal length; rows: (spans, length) of row numbers (initial x KINDS + kind)."""
    n = rows.shape[1]
    table = {(i, 1): _ROWS[rows[:, i]] for i in range(n)}
    length = {k: _lengths(c, 1) for k, c in table.items()}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            cells = None
            for k in range(1, size):
                right = table[i + k, size - k]
                both = table[i, k][:, _LEFT] + (right & ~_AUDIT)[:, _RIGHT]
                both += (right & _AUDIT)[:, _RIGHT] >> (2 * length[i, k][:, _LEFT])
                both = np.minimum.reduceat(both, _FIRST, axis=1)
                cells = both if cells is None else np.minimum(cells, both)
            table[i, size] = np.minimum(cells, _NONE)
            length[i, size] = _lengths(table[i, size], size)
    return table[0, n]


def _unpacked(cells: np.ndarray, rows: int) -> list[list[Cell | None]]:
    """Numbers as (cost, audit)."""
    letters = np.frombuffer(LETTERS, np.uint8)[(cells[..., None] >> np.arange(_BITS - 2, -1, -2)) & 3]
    text, size, cost = letters.tobytes(), _lengths(cells, rows).ravel().tolist(), (cells >> _BITS).ravel().tolist()
    wide = _BITS // 2
    flat = [(c, text[k * wide:k * wide + s]) if c < 200 else None for k, (c, s) in enumerate(zip(cost, size))]
    each = cells.shape[1]
    return [flat[a:a + each] for a in range(0, len(flat), each)]


# --- rows ---

def _stripped(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def row_kinds(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
              copies: str | None = None) -> DataFrame:
    """One row for each different row of a conversation, with its multiplicity:
    (conv, turn, role, id, n, initial, blank, truncated).  ``id`` stands for the text
    (16 bytes of its SHA-256).  Equal rows follow each other, and all but the first are
    duplicates, so a number says as much as the rows themselves."""
    words = F.coalesce(F.col(text), F.lit(" "))
    tail = _stripped(words)
    light = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                        text_id(words).alias("id"), (F.col(copies) if copies else F.lit(1)).cast("long").alias("n"),
                        (tail == "").alias("blank"), (~F.substring(tail, -1, 1).isin(".", "!", "?")).alias("truncated"))
    return light.groupBy("conv", "turn", "role", "id").agg(F.sum("n").alias("n"), F.first("blank").alias("blank"),
                                                           F.first("truncated").alias("truncated"))


def text_id(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _faults(kinds: DataFrame) -> DataFrame:
    """Adds ``again`` (role and text seen at an earlier turn), and counts what else holds."""
    # the fold key makes both sides shuffles of their own, so that Spark can split a conversation of one repeated row
    fold = F.pmod(F.xxhash64("conv", "role", "id"), F.lit(1009)).alias("fold")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = kinds.groupBy("conv", "role", "id").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    first = first.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("id").alias("i"), "first", fold.alias("f"))
    met = kinds.select("*", fold).join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                                       & (F.col("id") == F.col("i")) & (F.col("fold") == F.col("f")), "left")
    again = F.coalesce(F.col("first") < place, F.lit(False))
    return met.withColumn("again", again).select(
        "conv", "turn", "role", "id", "n", F.substring("role", 1, 1).alias("initial"), "blank", (~F.col("blank") & F.col("again")).alias("again"),
        (~F.col("blank") & ~F.col("again") & F.col("truncated")).alias("truncated"))


# --- spans of sorted rows ---

class _Open:
    """The conversation at the end of what was read: the spans so far, and rows that fill no chart yet."""

    def __init__(self, conv, initial: str):
        self.conv, self.first, self.last, self.illegal = conv, initial, None, 0
        self.tower, self.waiting = Tower(), []


LEGAL = {"su", "ua", "au"}
RUN = ("conv {kind}, part int, at int, illegal long, first string, last string, cost long, audit string, "
       "cells array<struct<cost:long,audit:string>>")
CELLS = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of one conversation as (conv, illegal, first initial, last initial, cells)."""
    held: _Open | None = None

    def flush(run: _Open, rows: int) -> None:
        part, run.waiting = run.waiting[:rows], run.waiting[rows:]
        run.tower.add(_unpacked(charts(np.array([part])), len(part))[0])

    def closed(run: _Open):
        if run.waiting:
            flush(run, SPAN)
        return run.conv, run.illegal, run.first, run.last, run.tower.cells()

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv, initial, copies, truncated = (batch.column(c).to_pylist() for c in ("conv", "initial", "n", "truncated"))
        gone = pc.or_(batch.column("blank"), batch.column("again")).to_pylist()
        code = [KINDS * (INITIALS.index(x) if x and x in INITIALS else len(INITIALS)) for x in initial]
        cut = [0, *(i for i in range(1, n) if conv[i] != conv[i - 1]), n]
        short: dict[int, list] = {}  # whole conversations of one chart, by length
        out: list = []
        for a, b in zip(cut, cut[1:]):
            if held is None or a or held.conv != conv[a]:
                if held is not None:
                    out.append(closed(held))
                held = _Open(conv[a], initial[a])
            run = held
            for i in range(a, b):
                more = copies[i] - 1
                run.illegal += more + (run.last is not None and run.last + initial[i] not in LEGAL)  # a role never follows itself
                run.last = initial[i]
                run.waiting.append(code[i] + (2 if gone[i] else int(truncated[i])))
                if more < SPAN:
                    run.waiting += [code[i] + 2] * more
                while len(run.waiting) > SPAN:
                    flush(run, SPAN)
                if more >= SPAN:
                    flush(run, SPAN)
                    run.tower.add(deleted(more))
            if a and b < n and not run.tower.levels:  # begun and ended here, one chart: goes with others of its length
                short.setdefault(len(run.waiting), []).append((len(out), run))
                out.append(None)
                held = None
        for size, runs in short.items():
            cells = _unpacked(charts(np.array([r.waiting for _, r in runs])), size)
            for (place, r), c in zip(runs, cells):
                out[place] = (r.conv, r.illegal, r.first, r.last, c)
        if out:
            yield out
    if held is not None:
        yield [closed(held)]


def _parse_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every run; the first and the last of a task keep their cells, for they may go on elsewhere."""
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    schema = None

    def rows(runs, at):
        made = []
        for conv, illegal, first, last, cells in runs:
            row = {"conv": conv, "part": part, "at": at, "illegal": illegal, "first": first, "last": last}
            if at == 1:
                cost, audit = best(cells)
                made.append(row | {"cost": cost, "audit": audit.decode()})
            else:
                made.append(row | {"cells": [None if c is None else {"cost": c[0], "audit": c[1].decode()} for c in cells]})
        return pa.RecordBatch.from_pylist(made, schema=schema)

    def typed():
        nonlocal schema
        for batch in batches:
            schema = schema or pa.schema([("conv", batch.column("conv").type), ("part", pa.int32()), ("at", pa.int32()), ("illegal", pa.int64()),
                                          ("first", pa.string()), ("last", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("cells", CELLS)])
            yield batch

    before, begun = None, False
    for runs in _runs(typed()):
        runs = runs if before is None else [before, *runs]
        before = runs.pop()
        if runs and not begun:
            yield rows(runs[:1], 0)
            runs, begun = runs[1:], True
        if runs:
            yield rows(runs, 1)
    if before is not None:
        yield rows([before], 2 if begun else 0)


def _across(pdf):
    """One conversation's runs on several tasks, in order, as one parse."""
    import pandas as pd
    pdf = pdf.sort_values(["part", "at"])
    tower, illegal, last = Tower(), 0, None
    for row in pdf.itertuples():
        illegal += row.illegal + (last is not None and last + row.first not in LEGAL)
        last = row.last
        tower.add([None if c is None else (c["cost"], c["audit"].encode()) for c in row.cells])
    cost, audit = best(tower.cells())
    return pd.DataFrame({"conv": pdf["conv"].iloc[:1].values, "illegal": [illegal], "cost": [cost], "audit": [audit.decode()]})


def parse(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
          copies: str | None = None) -> DataFrame:
    """One row a conversation: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit).

    Rows follow by turn (nulls first), then role and the text's SHA-256; equal rows
    follow each other, as do ``copies`` of one.  Null roles and texts count as one space.
    A row is blank (no character but white space), else a duplicate (its role and text
    came earlier in the conversation), else truncated (its last such character is none of
    ``.!?``), else sound.  gaps: turns missing between the least and the greatest.  A
    null conversation is one of its own.  Other columns are not read.  No rows: none.
    """
    kind = rows.schema[conv].dataType.simpleString()
    kinds = stored(_faults(row_kinds(rows, conv, turn, role, text, copies)), "dialogue-rows")
    by_turn = kinds.groupBy("conv", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("again"), F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"),
        F.sum(F.col("truncated").cast("long")).alias("truncated"))
    counts = by_turn.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    light = kinds.select("conv", "turn", "role", "id", "n", "initial", "blank", "again", "truncated")
    ordered = light.repartitionByRange("conv", "turn", "role", "id").sortWithinPartitions("conv", "turn", "role", "id")
    runs = stored(ordered.mapInArrow(_parse_part, RUN.format(kind=kind)), "dialogue-spans")
    done = runs.where("cells is null").select("conv", "illegal", "cost", "audit")
    # at most two runs a task
    edges = runs.where("cells is not null").groupBy("conv").applyInPandas(_across, f"conv {kind}, illegal long, cost long, audit string")
    parsed = done.unionByName(edges).withColumnRenamed("conv", "c")
    return counts.join(parsed, F.col("conv").eqNullSafe(F.col("c"))).select(
        F.col("conv").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


# --- the repaired conversation ---

class _Player:
    """Plays an audit over the rows of a conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place = audit, 0, 0

    def _turn(self, role: str | None = None) -> str | None:
        letter = role[:1] if role is not None else ("a" if self.place == 2 else "u")
        self.place = STEPS[self.place, letter]
        return role if role is not None else ROLES[letter]

    def inserted(self) -> list[str]:
        """Roles of the turns inserted before the next row (or at the end)."""
        out = []
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            out.append(self._turn())
        return out

    def row(self, role: str) -> str | None:
        """The row's role after repair; None if it goes."""
        letter = self.audit[self.at]
        self.at += 1
        return None if letter == "D" else self._turn(role) if letter == "K" else self._turn()


def _in_order(rows: DataFrame, parsed: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    """Every conversation's audit, then its rows in order.  What follows reads them as a
    stream: a task holds a batch, however long the conversation."""
    words = F.coalesce(F.col(text), F.lit(" "))
    turns = rows.schema[turn].dataType.simpleString()
    heads = parsed.select(F.col(conv).alias("conv"), F.lit(0).alias("kind"), F.lit(None).cast(turns).alias("turn"), F.lit("").alias("role"),
                          F.lit(None).cast("binary").alias("id"), F.lit(0).cast("long").alias("n"), F.col("audit").alias("text"))
    body = rows.select(F.col(conv).alias("conv"), F.lit(1).alias("kind"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                       text_id(words).alias("id"), (F.col(copies) if copies else F.lit(1)).cast("long").alias("n"), words.alias("text"))
    return heads.unionByName(body).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "id")


def _played(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], pa.DataType]]:
    """Per batch: (conv, place, role, text) of repaired turns, and (conv, None, None, None)
    where a conversation begins; with the type of conv."""
    player, place, conv, conv_type = None, 0, None, None

    def ended():
        nonlocal place
        out = []
        for r in player.inserted() if player else []:
            out.append((conv, place, r, ""))
            place += 1
        return out

    for batch in batches:
        out, conv_type = [], batch.column("conv").type
        for c, kind, role, n, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "kind", "role", "n", "text"))):
            if kind == 0:
                out += ended()
                player, place, conv = _Player(text), 0, c
                out.append((conv, None, None, None))
                continue
            for _ in range(n):
                out += ended()
                kept = player.row(role)
                if kept is not None:
                    out.append((conv, place, kept, text))
                    place += 1
        yield out, conv_type
    if player is not None:
        yield ended(), conv_type


def repaired(rows: DataFrame, parsed: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             copies: str | None = None) -> DataFrame:
    """The repaired conversations: (conv, place, role, text), places from 0.  ``parsed``:
    what ``parse`` returned for ``rows``."""
    kind = rows.schema[conv].dataType.simpleString()
    out = f"conv {kind}, place long, role string, text string"

    def run(batches):
        for made, conv_type in _played(batches):
            made = [r for r in made if r[1] is not None]
            kinds = (conv_type, pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], t) for k, t in enumerate(kinds)], ["conv", "place", "role", "text"])

    ordered = _in_order(rows, parsed, conv, turn, role, text, copies)
    return ordered.mapInArrow(run, out).withColumnRenamed("conv", conv)


def repaired_sha256(rows: DataFrame, parsed: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                    copies: str | None = None) -> DataFrame:
    """(conv, repaired_sha256): SHA-256 of the repaired ``role:text``, joined by newlines.
    The hash of a conversation is sequential, so one task streams it."""
    kind = rows.schema[conv].dataType.simpleString()
    out = f"conv {kind}, repaired_sha256 string"

    def run(batches):
        digest, current, conv_type = None, None, None

        def rows(done):
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], conv_type), pa.array([h for _, h in done], pa.string())],
                                              ["conv", "repaired_sha256"])
        for made, conv_type in _played(batches):
            done = []
            for c, place, r, t in made:
                if place is None:
                    if digest is not None:
                        done.append((current, digest.hexdigest()))
                    digest, current = hashlib.sha256(), c
                else:
                    digest.update(f"{chr(10) if place else ''}{r}:{t}".encode())
            yield rows(done)
        if digest is not None:
            yield rows([(current, digest.hexdigest())])

    ordered = _in_order(rows, parsed, conv, turn, role, text, copies)
    return ordered.mapInArrow(run, out).withColumnRenamed("conv", conv)
