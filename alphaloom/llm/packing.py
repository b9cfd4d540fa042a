"""Best-fit packing of documents into fixed-length token sequences.

Bounded-space online best-fit. Each task walks its documents once and keeps at most
``open_bins`` unfinished sequences. A bitset (one Python integer) has bit f set when some
open sequence has f tokens free, so the tightest fit for a piece of n tokens is the lowest
set bit at or above n. When one bin too many is open, the fullest is closed first: the
bin that has least room is the one that later pieces could use least.

Memory does not grow with the input: a task holds the open bins (three integers each) and one
record batch. A lost task packs its own documents again and gives the same sequence numbers,
since these are made of the partition's number and a count within it.

What tasks leave unfinished is packed again: a task gives out a sequence's pieces when it is closed, and at its end those of
the open ones, marked. The first pass is written, and a second, smaller best-fit takes the marked pieces,
longest first, a hundred thousand to a task; only they are moved, and their ids only to be joined to their new places. So the number of sequences hardly depends on the
number of tasks that the documents came in.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, written

#: Pieces that one task of the second pass takes, on average, and how many sequences it may have open.
AGAIN_A_TASK = 100_000
OPEN_AGAIN = 1 << 17

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class BestFit:
    """Online best-fit with a bounded number of open bins.

    ``place(n)`` returns (bin, offset) for an item of n, 1 <= n <= capacity. Bins are numbered
    from ``first``. Ties between bins with equal room go to the one opened last.
    """

    def __init__(self, capacity: int, open_bins: int, first: int = 0) -> None:
        self.capacity, self.open_bins, self.next = capacity, open_bins, first
        self.bits = 0
        self.at: dict[int, list[int]] = {}
        self.count = 0
        #: Bins closed since somebody last emptied this list.
        self.closed: list[int] = []

    def _take(self, free: int) -> int:
        bins = self.at[free]
        out = bins.pop()
        if not bins:
            del self.at[free]
            self.bits ^= 1 << free
        self.count -= 1
        return out

    def place(self, n: int) -> tuple[int, int]:
        fits = self.bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            target = self._take(free)
        else:
            free, target = self.capacity, self.next
            self.next += 1
        rest = free - n
        if rest:
            self.at.setdefault(rest, []).append(target)
            self.bits |= 1 << rest
            self.count += 1
            if self.count > self.open_bins:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
        else:
            self.closed.append(target)
        return target, self.capacity - free


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit integers.

    The ids are those of the tokenizer file. The vocabulary's rank form gives the same ids in a
    fifth of the time; what it cannot do goes to the file itself: a text that holds a special
    token's string, one with a long run of white space (its look-ahead needs stack for each
    character of the run), and any text that it fails on. The vocabulary's pattern looks ahead only
    to split runs of white space. In a text without such runs (the usual case) the pattern
    without look-ahead cuts the same pre-tokens, and in half the time.
    """

    RUNS = r"\s+(?!\S)|\s+"
    LONG_RUN = re.compile(r"\s{1000}")

    def __init__(self, json_path: str, ranks_path: str, pattern: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        assert pattern.endswith(self.RUNS)
        simple = pattern.removesuffix(self.RUNS) + r"\s"
        self.exact = tiktoken.Encoding("exact", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.even = tiktoken.Encoding("even", pat_str=simple, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.full = Tokenizer.from_file(json_path)
        special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self.ids(text), "<u4")

    def ids(self, text: str) -> list[int]:
        if self.special and self.special.search(text):
            return self.by_file(text)
        try:
            if " ".join(text.split()) == text.replace("\n", " "):
                return self.even(text)
            if not self.LONG_RUN.search(text):
                return self.exact(text)
        except (RuntimeError, ValueError):
            pass
        return self.by_file(text)

    def by_file(self, text: str) -> list[int]:
        return self.full.encode_batch([text], add_special_tokens=False)[0].ids


@functools.lru_cache(maxsize=1)
def _encoder(json_path: str, ranks_path: str, pattern: str) -> Encoder:
    """One for all tasks of a worker process: its tables take some hundred megabytes."""
    return Encoder(json_path, ranks_path, pattern)


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, and before them the rest, if any."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    cuts = ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]
    return cuts


def pack(
    docs: DataFrame,
    *,
    capacity: int = 2048,
    end_id: int = 0,
    open_bins: int = 1024,
    tokenizer: str | None = None,
    ranks: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """Packs every document of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, unless
    with_ids is false, ids. A null or empty text is the single token ``end_id``; a null doc_id stays
    null; equal rows are packed once each; other columns are ignored; an empty table gives no rows.
    Texts of any length and with any runs of white space are encoded whole.
    ``tokenizer`` and ``ranks`` are the paths of the vocabulary's two files.
    """
    import public_tokenizers as files

    json_path = tokenizer or files.path("byte_bpe_50k.json")
    ranks_path = ranks or files.path("byte_bpe_50k.tiktoken")
    pattern = files.PATTERN
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    out_schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def record(rows: list[tuple], unfinished: bool) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=False)]
        if with_ids:
            ends = np.cumsum([0] + [len(x) for x in columns[-1]]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(columns[-1]))))
        return pa.RecordBatch.from_arrays([*arrays, pa.array([unfinished] * len(rows))], schema=out_schema.append(pa.field("unfinished", pa.bool_())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(json_path, ranks_path, pattern)
        bins = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 32)
        # pieces of open sequences, at most as many tokens as these can hold
        held: dict[int, list[tuple]] = {}
        rows: list[tuple] = []
        for batch in sliced(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.append(encode(text or ""), np.uint32(end_id)).tobytes()
                for k, (start, length) in enumerate(pieces(len(data) // 4, capacity)):
                    own = data[4 * start : 4 * (start + length)]
                    target, offset = bins.place(length)
                    row = (doc_id, k, start, length, zlib.crc32(own), target, offset)
                    held.setdefault(target, []).append((*row, np.frombuffer(own, "<i4")) if with_ids else row)
                    for b in bins.closed:
                        rows += held.pop(b)
                    bins.closed.clear()
                if len(rows) >= 1024:
                    yield record(rows, False)
                    rows = []
        if rows:
            yield record(rows, False)
        rest = [r for own in held.values() for r in own]
        for i in range(0, len(rest), 4096):
            yield record(rest[i : i + 4096], True)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    first = written(rows.mapInArrow(run, f"{schema}, unfinished boolean"), "pieces", compression="zstd" if with_ids else "snappy")
    return first.where("not unfinished").drop("unfinished").unionByName(packed_again(first.where("unfinished").drop("unfinished"), capacity))


def packed_again(pieces: DataFrame, capacity: int) -> DataFrame:
    """The pieces, longest first, in new sequences. Only their places and lengths are dealt to tasks and go through Python, never their ids."""
    parts = max(1, -(-pieces.count() // AGAIN_A_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # numbers that no first pass has
        bins = BestFit(capacity, OPEN_AGAIN, (1 << 62) + (TaskContext.get().partitionId() << 32))
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(0).to_pylist()]
            bins.closed.clear()
            new = [pa.array(c, pa.int64()) for c in zip(*placed, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], names=["_sequence", "_offset", "sequence_id", "offset"])

    # dealt at random, so that every task has pieces of all lengths
    places = pieces.select("length", "sequence_id", "offset").repartition(parts, F.xxhash64("sequence_id", "offset")).sortWithinPartitions(F.desc("length"), "sequence_id", "offset")
    new = places.mapInArrow(run, "_sequence long, _offset long, sequence_id long, offset long")
    old = pieces.withColumnsRenamed({"sequence_id": "_sequence", "offset": "_offset"})
    return old.join(new, ["_sequence", "_offset"]).select(pieces.columns)
