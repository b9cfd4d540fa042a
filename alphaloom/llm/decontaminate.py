"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may occur with up to k = floor(error_rate * n) edits. Cut into
k + 1 pieces, one piece at least must then occur unchanged. An automaton over all pieces
finds those hits in one walk over a text; each hit says where the item would lie, and Myers'
bit-parallel algorithm gives the item's least edit distance to any substring there.

Items under 24 characters occur without edits only, as whole words: their one piece is all of them.

Items and texts are compared as lower-case words with single spaces. The items go to the
tasks in blocks of bounded size, one pass over the documents each; documents are not moved. A
block's result is written before the next block is read, so the driver and the tasks hold one block at a
time, however large the benchmark is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, map_batches, written

#: Characters of test items in one block: what a task's automaton is built of.
BLOCK_CHARS = 4 << 20
#: Items with fewer characters must occur exactly, as whole words.
MIN_CHARS = 24
#: Letters of scripts that put no spaces between words: Thai to Myanmar, Khmer, kana and ideographs.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normal(text: str | None) -> str:
    return " ".join(WORD.findall((text or "").lower()))


def whole_words(text: str, start: int, end: int) -> bool:
    """No word of a normal text is cut at start or end; scripts without spaces are cut anywhere."""
    left = start == 0 or text[start - 1] == " " or UNSPACED.match(text[start]) is not None
    return left and (end == len(text) or text[end] == " " or UNSPACED.match(text[end - 1]) is not None)


def cut_pieces(n: int, k: int) -> list[tuple[int, int]]:
    """(start, end) of k + 1 pieces of n characters, as equal as can be."""
    return [(n * i // (k + 1), n * (i + 1) // (k + 1)) for i in range(k + 1)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any substring of text, the end of the first one that has it)."""
    m = len(pattern)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    equal: dict[str, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    plus, minus, score, best, end = mask, 0, m, m, 0
    get = equal.get
    for at, c in enumerate(text, 1):
        eq = get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (mask & ~(horizontal | plus))
        down = plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
            if score < best:
                best, end = score, at
        up = up << 1 & mask
        plus = (down << 1 & mask) | (mask & ~(vertical | up))
        minus = up & vertical
    return best, end


class Matcher:
    """Finds one block of items in texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float) -> None:
        self.items = [(i, s, math.floor(error_rate * len(s)) if len(s) >= MIN_CHARS else 0) for i, s in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, s, k) in enumerate(self.items):
            for a, b in cut_pieces(len(s), k):
                where.setdefault(s[a:b], []).append((n, b))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, places)
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of each item's best occurrence in a normal text, where that is in its budget."""
        starts: dict[int, set[int]] = {}
        for last, places in self.automaton.iter(text):
            for n, b in places:
                if len(self.items[n][1]) < MIN_CHARS and not whole_words(text, last + 1 - b, last + 1):
                    continue
                starts.setdefault(n, set()).add(last + 1 - b)
        out = []
        for n, found in sorted(starts.items()):
            item, s, k = self.items[n]
            best = None
            for low, high in _joined(sorted(found), 2 * k):
                if low == high and text.startswith(s, low) and low >= 0:
                    hit = (0, low, low + len(s))
                else:
                    a, b = max(0, low - k), high + len(s) + k
                    distance, end = myers(s, text[a:b])
                    if distance > k:
                        continue
                    # backwards from its end, the occurrence ends where it started
                    back = text[max(a, a + end - len(s) - k) : a + end][::-1]
                    hit = (distance, a + end - myers(s[::-1], back)[1], a + end)
                if best is None or hit < best:
                    best = hit
            if best:
                out.append((item, *best))
        return out


def _joined(starts: list[int], gap: int) -> Iterator[tuple[int, int]]:
    low = high = starts[0]
    for x in starts[1:]:
        if x - high > gap:
            yield low, high
            low = x
        high = x
    yield low, high


def item_blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items' ids and normal texts, a bounded block at a time."""
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = math.ceil(total / block_chars)
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        if kept := [(r["item_id"], s) for r in own if (s := normal(r["text"]))]:
            yield sorted(kept)


def find_leaks(docs: DataFrame, items: DataFrame, *, error_rate: float = 0.08, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance and the span start, end_ in the text's normal form: the best occurrence of each
    test item in each document that holds it within its budget of edits.

    Null and empty texts and items match nothing; items of fewer than MIN_CHARS characters occur
    as whole words without edits; repeated documents give repeated rows; of items with equal ids each different text is an
    item; an empty table on either side gives no rows. Texts of any length are read whole; of equally good
    occurrences the first counts; other columns, whatever their names, are ignored.
    """
    schema = "doc_id long, item_id long, distance int, start long, end_ long"
    names = ["doc_id", "item_id", "distance", "start", "end_"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def finder(block: list[tuple[int, str]]) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        made: list[Matcher] = []

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            if not made:
                made.append(Matcher(block, error_rate))
            found = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in made[0].find(normal(t))]
            columns = list(zip(*found, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        return run

    out, last = None, None
    for block in item_blocks(items, block_chars):
        if last is not None:
            done = written(last, "leaks")
            out = done if out is None else out.unionByName(done)
        last = map_batches(rows, finder(block), schema)
    if last is None:
        return docs.sparkSession.createDataFrame([], schema)
    return last if out is None else out.unionByName(last)


def without_leaks(docs: DataFrame, items: DataFrame, *, error_rate: float = 0.08, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, in which no test item occurs within its budget."""
    at = docs.columns.index("text")

    def keeper(block: list[tuple[int, str]]) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        made: list[Matcher] = []

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            if not made:
                made.append(Matcher(block, error_rate))
            return batch.filter(pa.array([not made[0].find(normal(t)) for t in batch.column(at).to_pylist()]))

        return run

    for n, block in enumerate(item_blocks(items, block_chars)):
        docs = map_batches(docs if n == 0 else written(docs, "clean"), keeper(block), docs.schema)
    return docs
