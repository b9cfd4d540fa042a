"""Repair of conversations whose turns do not alternate.

A conversation shall read user, assistant, user, assistant..., after one system turn or none, or be empty. Its
turns are aligned with every string of roles of that grammar by Wagner-Fischer: the table's rows
are turns, its columns how many roles of the string are left, so strings of all lengths (they differ in their beginnings
only) share one table. Ukkonen's band is what the incumbent leaves of a row: a cell that costs more than the cheapest
known way to finish with the same next role cannot be on a cheapest path for any length. What remains
costs the same, so a band is a few costs and bitsets of lengths, and a row is made by shifting the bitsets of the
row after it. The cheapest lengths are traced back together, letter by letter, and the least audit wins.

Alignment needs one byte a turn, the first letter of its role and its fault, never its text. So first the
turns' codes, without texts, are sorted by conversation and aligned; then texts and audits are sorted together and
each audit is carried out while its turns stream by. A task holds the codes of one conversation, as many bytes as
half of its audit, and one record batch; a conversation with a third of all rows is streamed like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
USER, ASSISTANT, SYSTEM, OTHER = range(4)
NONE, BLANK, DUPLICATE, CUT_OFF = range(4)
#: Rows of the table that are held at once; others are made again from every so many.
BLOCK = 1024

SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


# ---- alignment
#
# A row's band: for each role that may come next, or none, the incumbent cost and, as a bitset, how many roles are left in
# the cells that cost no more. After the system turn a user turn must come, before it nothing.

AT_END, TO_ASSISTANT, TO_USER, TO_SYSTEM = range(4)
Band = list[tuple[int, int]]
FAR = 1 << 60


def _merge(band: Band, at: int, cost: int, bits: int) -> None:
    known, held = band[at]
    if bits and cost <= known:
        band[at] = (cost, bits | held if cost == known else bits)


def _inserted(band: Band) -> Band:
    _merge(band, TO_ASSISTANT, band[AT_END][0] + INSERT, band[AT_END][1] << 1)
    _merge(band, TO_ASSISTANT, band[TO_USER][0] + INSERT, band[TO_USER][1] << 1)
    _merge(band, TO_USER, band[TO_ASSISTANT][0] + INSERT, band[TO_ASSISTANT][1] << 1)
    return band


def _row(code: int, after: Band) -> Band:
    """A turn's row from the row after it."""
    role, fault = code & 3, code >> 2
    band = [(cost + DELETE, bits) for cost, bits in after]
    if fault not in (BLANK, DUPLICATE):
        kept = TRUNCATED if fault == CUT_OFF else 0
        as_assistant, as_user = (kept + (0 if role == wanted else REROLE) for wanted in (ASSISTANT, USER))
        _merge(band, TO_ASSISTANT, after[AT_END][0] + as_assistant, after[AT_END][1] << 1)
        _merge(band, TO_ASSISTANT, after[TO_USER][0] + as_assistant, after[TO_USER][1] << 1)
        _merge(band, TO_USER, after[TO_ASSISTANT][0] + as_user, after[TO_ASSISTANT][1] << 1)
        if role == SYSTEM:
            _merge(band, TO_SYSTEM, after[TO_USER][0] + kept, after[TO_USER][1] << 1)
    return _inserted(band)


def _moves(code: int | None, cells: list[int], now: Band, after: Band | None) -> dict[str, list[int]]:
    """By letter, the cells that cheapest paths through ``cells`` (a bitset for each next role) go on to."""
    moves: dict[str, list[int]] = {}

    def go(letter: str, paid: int, source: int, row: Band, to: int, shift: int) -> None:
        if row[to][0] + paid == now[source][0] and (reached := cells[source] >> shift & row[to][1]):
            moves.setdefault(letter, [0] * 4)[to] |= reached

    for source, to in ((TO_ASSISTANT, AT_END), (TO_ASSISTANT, TO_USER), (TO_USER, TO_ASSISTANT)):
        go("I", INSERT, source, now, to, 1)
    if code is None or after is None:
        return moves
    role, fault = code & 3, code >> 2
    for source in range(4):
        go("D", DELETE, source, after, source, 0)
    if fault not in (BLANK, DUPLICATE):
        kept = TRUNCATED if fault == CUT_OFF else 0
        for wanted, source, to in ((ASSISTANT, TO_ASSISTANT, AT_END), (ASSISTANT, TO_ASSISTANT, TO_USER), (USER, TO_USER, TO_ASSISTANT)):
            go("K" if role == wanted else "R", kept + (0 if role == wanted else REROLE), source, after, to, 1)
        if role == SYSTEM:
            go("K", kept, TO_SYSTEM, after, TO_USER, 1)
    return moves


def align(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of turns with the given codes (role + 4 * fault); of several, the least audit."""
    n = len(codes)
    row = _inserted([(0, 1), (FAR, 0), (FAR, 0), (FAR, 0)])
    held = {n: row}
    for i in range(n - 1, -1, -1):
        row = _row(codes[i], row)
        if i % BLOCK == 0:
            held[i] = row
    # strings of every length begin with user or system, or are empty
    begins = (AT_END, TO_USER, TO_SYSTEM)
    cost = min(row[b][0] for b in begins)
    cells = [row[b][1] if b in begins and row[b][0] == cost else 0 for b in range(4)]
    audit = bytearray()
    for start in range(0, max(n, 1), BLOCK):
        stop = min(start + BLOCK, n)
        rows = [held[stop]]
        for i in range(stop - 1, start - 1, -1):
            rows.append(_row(codes[i], rows[-1]))
        rows.reverse()
        i = start
        while i < stop or (i == n and not cells[AT_END]):
            moves = _moves(codes[i] if i < n else None, cells, rows[i - start], rows[i + 1 - start] if i < n else None)
            letter = min(moves)
            cells = moves[letter]
            audit += letter.encode()
            i += letter != "I"
    return cost, audit.decode()


# ---- faults


def _coded(turns: DataFrame) -> DataFrame:
    """Turns in the form that sorts them: conv_id, turn, role, head, digest (of the text) and text."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    return turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        role.alias("role"),
        # equal turns of a conversation come by role and text, whose beginning nearly always tells
        F.substring(text, 1, 32).alias("head"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"),
        text.alias("text"),
    )


ORDER = ["conv_id", "turn", "role", "head", "digest"]


def _codes(turns: DataFrame) -> DataFrame:
    """conv_id, turn and code of each turn, sorted by conversation in tasks; no texts."""
    kept = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    letter = F.substring("role", 1, 1)
    role: Column = F.when(letter == "u", USER).when(letter == "a", ASSISTANT).when(letter == "s", SYSTEM).otherwise(OTHER)
    bare = _coded(turns).select(*ORDER, (kept == "").alias("blank"), F.right(kept, F.lit(1)).isin(".", "!", "?").alias("ended"), role.alias("code"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("turn")) > 1
    fault = F.when(F.col("blank"), BLANK).when(F.col("seen"), DUPLICATE).when(~F.col("ended"), CUT_OFF).otherwise(NONE)
    # both sorts use one exchange
    flagged = bare.repartition("conv_id").withColumn("seen", seen)
    return flagged.sortWithinPartitions(*ORDER).select("conv_id", "turn", (F.col("code") + 4 * fault).cast("byte").alias("code"))


def audits(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, counts of gaps and first faults, illegal neighbours, cost and audit."""
    legal = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
    allowed = np.array([[(a, b) in legal for b in range(4)] for a in range(4)])

    def one(conv_id: int | None, turn: list[np.ndarray], codes: list[np.ndarray]) -> tuple:
        code = np.concatenate(codes)
        known = np.concatenate(turn)  # sorted, without nulls
        gaps = int(known[-1] - known[0]) - int(np.count_nonzero(np.diff(known))) if len(known) else 0
        role, fault = code & 3, code >> 2
        cost, audit = align(code.tobytes())
        return (conv_id, gaps, *(int(np.count_nonzero(fault == f)) for f in (BLANK, DUPLICATE, CUT_OFF)), int(np.count_nonzero(~allowed[role[:-1], role[1:]])), cost, audit)

    types = [pa.int64()] * 7 + [pa.string()]
    names = ["conv_id", *(f.split()[0] for f in SUMMARY.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, turn, codes, done = None, [], [], []

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            code = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            number = batch.column(1).fill_null(0).to_numpy()
            changes = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
            for a, b in zip(changes, changes[1:], strict=False):
                if codes and ids[a] != current:
                    done.append(one(current, turn, codes))
                    turn, codes = [], []
                current = ids[a]
                turn.append(number[a:b][known[a:b]])
                codes.append(code[a:b])
            if len(done) >= 1024:
                yield flushed()
                done = []
        if codes:
            done.append(one(current, turn, codes))
        if done:
            yield flushed()

    return _codes(turns).mapInArrow(run, f"conv_id long, {SUMMARY}")


# ---- carrying out


def _with_audits(turns: DataFrame) -> DataFrame:
    """Turns with their texts, and each conversation's audit row before its first turn, sorted in tasks."""
    texts = _coded(turns).withColumns({"first": F.lit(1), "summary": F.lit(None).cast("struct<" + SUMMARY.replace(" ", ":").replace(",:", ",") + ">")})
    marks = audits(turns).select(
        "conv_id",
        F.lit(None).cast("long").alias("turn"),
        *(F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("head", "string"), ("digest", "binary"), ("text", "string"))),
        F.lit(0).alias("first"),
        F.struct(*(f.split()[0] for f in SUMMARY.split(", "))).alias("summary"),
    )
    rows = texts.unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", "first", *ORDER[1:])
    return rows.select("conv_id", "first", "turn", "role", "text", "summary")


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, summary, letter, turn, role, text) of each edit; letter is None before a conversation's first and after its last edit, then with the summary and without it."""
    conv_id, audit, at, made, system = None, "", 0, 0, False

    def next_role() -> str:
        return ("user", "assistant")[(made - system) % 2]

    def inserts() -> Iterator[tuple]:
        nonlocal at, made
        while at < len(audit) and audit[at] == "I":
            yield conv_id, None, "I", None, next_role(), ""
            at, made = at + 1, made + 1

    opened = False
    for batch in batches:
        for row_id, first, turn, role, text, summary in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not first:
                if opened:
                    yield from inserts()
                    yield conv_id, None, None, None, None, None
                conv_id, audit, at, made, opened = row_id, summary["audit"], 0, 0, True
                system = (len(audit) - audit.count("D")) % 2 == 1
                yield conv_id, summary, None, None, None, None
                continue
            yield from inserts()
            letter = audit[at]
            yield conv_id, None, letter, turn, next_role() if letter == "R" else role, text
            at, made = at + 1, made + (letter != "D")
    if opened:
        yield from inserts()
        yield conv_id, None, None, None, None, None


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, str))
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """Every edit of every conversation of ``turns`` (conv_id, turn, role, text), in order: conv_id, step, edit (D, I, K, R), turn, role, text.

    The rows that are not D are the repaired conversation. Turns come by number, nulls first, equal ones by role and text; an inserted
    turn has no number and an empty text. A null role or text counts as one space; a null conv_id is one conversation;
    a repeated row is a duplicate; other columns are ignored; an empty table gives no rows; texts of any length go through whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            step = 0
            for conv_id, summary, letter, turn, role, text in _edits(batches):
                if letter is None:
                    step = 0 if summary else step
                    continue
                yield conv_id, step, letter, turn, role, text
                step += 1

        return _batches(rows(), ["conv_id", "step", "edit", "turn", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()])

    return _with_audits(turns).mapInArrow(run, "conv_id long, step long, edit string, turn long, role string, text string")


def repaired_conversations(turns: DataFrame) -> DataFrame:
    """The conversations of ``audits`` with ``repaired_sha256``, the hash of the repaired turns as lines ``role:text``. Nulls and the like as in ``repaired_turns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            digest, some, known = hashlib.sha256(), False, {}
            for conv_id, summary, letter, _, role, text in _edits(batches):
                if summary:
                    digest, some, known = hashlib.sha256(), False, summary
                elif letter is None:
                    yield conv_id, *known.values(), digest.hexdigest()
                elif letter != "D":
                    digest.update(f"{'\n' if some else ''}{role}:{text}".encode())
                    some = True

        return _batches(rows(), ["conv_id", *(f.split()[0] for f in SUMMARY.split(", ")), "repaired_sha256"], [pa.int64()] * 7 + [pa.string()] * 2)

    return _with_audits(turns).mapInArrow(run, f"conv_id long, {SUMMARY}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults made by a hash of conv_id and turn: of 20 values, 0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's. Nulls count as one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
