"""Packing into fixed-length token sequences whose sources keep target proportions.

Every source is a queue of tokens. Deficit round-robin fills each window: a queue's deficit
grows by its share of the window, the queues are served in turn for as many whole tokens as they
are owed, and what a queue is still owed is carried to the next window. Documents are cut where
a turn ends, so that every window but the last is full and within a few tokens of the targets; the last one is cut into
sequences whose lengths are powers of two, which need no padding.

That runs in many tasks because deficits at any window can be had without the windows before
it: a queue of weight p has been served floor(p t) tokens at the time t at which all queues together
have been served as many as those windows hold, and is owed the fraction. Windows are dealt in groups of
``group`` windows; each group starts with the deficits that the group before it ends with.

Texts are encoded once, into a written table; only counts by part and source are aggregated, and the queue places of a part's
documents follow from running sums over parts. One shuffle then brings the ids of a group together, at
most ``group`` windows of tokens however large a document or source is. At most ``queues`` sources
have a queue of their own; the smaller ones share one more, so nothing that tasks are sent grows with the data.
"""

from __future__ import annotations

import functools
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, source string, sequence_id long, offset long"


# ---- encoding


class Recent:
    """The last ``limit`` to 2 * ``limit`` results by key."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.keep(key, found)
        return found

    def keep(self, key: str, value: bytes) -> bytes:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value


class WordEncoder:
    """Token ids of a text by a tokenizer file that cuts words at white space and merges within words.

    A text's ids are those of its white-space separated chunks, and a chunk's those of its words, so both are encoded once and remembered for a while.
    The ids are the tokenizer's own: its model merges the words of chunks of Latin letters, and it encodes other chunks itself. Texts
    that hold a special token's string, or control characters that only Python takes for white space, go to it whole.
    """

    LONGEST = 64
    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    LATIN = regex.compile("[\x21-\u024f]*")

    def __init__(self, json_path: str) -> None:
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(json_path)
        self.model = self.full.model
        self.dtype = np.dtype("<u2") if self.full.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.as_bytes = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.full.get_vocab_size())]
        self.odd = [*"\x1c\x1d\x1e\x1f", *(t.content for t in self.full.get_added_tokens_decoder().values())]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.visible = dict(zip([b for b in range(256) if b not in shown], range(256, 512), strict=False))
        self.chunks, self.words = Recent(400_000), Recent(200_000)

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned integers of ``dtype``."""
        if any(o in text for o in self.odd):
            return self._whole(text)
        chunks = text.split()
        found = list(map(self.chunks.young.get, chunks))
        if None in found:
            found = [self._chunk(c) if f is None else f for c, f in zip(chunks, found, strict=True)]
        return b"".join(found)

    def _whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if (known := self.chunks.find(chunk)) is not None:
            return known
        low = chunk.lower()
        if not chunk.isascii() and not self.LATIN.fullmatch(chunk):
            ids = self._whole(chunk)
        elif low.isalpha():
            ids = self._word(low)
        elif low[:-1].isalpha() and low[-1] in ".,":
            ids = self._word(low[:-1]) + self._word(low[-1])
        else:
            ids = b"".join(map(self._word, self.PATTERN.findall(low)))
        return self.chunks.keep(chunk, ids) if len(chunk) <= self.LONGEST else ids

    def _word(self, word: str) -> bytes:
        if (known := self.words.find(word)) is not None:
            return known
        shown = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.visible)
        ids = b"".join([self.as_bytes[t.id] for t in self.model.tokenize(shown)])
        return self.words.keep(word, ids) if len(word) <= self.LONGEST else ids


@functools.lru_cache(maxsize=1)
def _encoder(json_path: str) -> WordEncoder:
    """One for all tasks of a worker process."""
    return WordEncoder(json_path)


def encoded(docs: DataFrame, json_path: str, end_id: int) -> DataFrame:
    """doc_id, source, part, at (tokens of its source before it in its part), n and ids of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(json_path)
        end = np.array([end_id], encode.dtype).tobytes()
        part, served = TaskContext.get().partitionId(), {}
        for batch in batches:
            for cut in range(0, batch.num_rows, 256):
                piece = batch.slice(cut, 256)
                ids = [encode(t or "") + end for t in piece.column(2).to_pylist()]
                n = [len(x) // encode.dtype.itemsize for x in ids]
                at = []
                for source, size in zip(piece.column(1).to_pylist(), n, strict=True):
                    at.append(served.get(source, 0))
                    served[source] = at[-1] + size
                columns = [piece.column(0), piece.column(1), pa.array([part] * len(n), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "part", "at", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, source string, part int, at long, n long, ids binary")


# ---- the schedule


class Schedule:
    """What each queue has been served when all together have been served ``k`` tokens.

    ``sizes`` are the queues' tokens and ``weights`` their integer shares. A queue's tokens served by tick t are floor(weight t / sum of
    weights), until it is empty.
    """

    def __init__(self, sizes: list[int], weights: list[int]) -> None:
        self.sizes, self.weights, self.total = sizes, weights, sum(weights)
        self.last = max((-(-n * self.total // w) for n, w in zip(sizes, weights, strict=True)), default=0)

    def at_tick(self, t: int) -> list[int]:
        return [min(n, w * t // self.total) for n, w in zip(self.sizes, self.weights, strict=True)]

    def served(self, k: int) -> tuple[list[int], int]:
        """(tokens of each queue, tick): the last tick that serves at most k, and what is left to the queues that come next."""
        low, high = 0, self.last
        while low < high:
            mid = (low + high + 1) // 2
            if sum(self.at_tick(mid)) <= k:
                low = mid
            else:
                high = mid - 1
        out, after = self.at_tick(low), self.at_tick(low + 1)
        left = k - sum(out)
        for i in range(len(out)):
            more = min(left, after[i] - out[i])
            out[i] += more
            left -= more
        return out, low

    def tick_of(self, queue: int, token: int) -> int:
        """The tick that serves the queue's ``token``-th token, counted from 0."""
        return -(-(token + 1) * self.total // self.weights[queue])


def round_robin(windows: list[int], left: list[int], weights: list[int], owed: list[int]) -> Iterator[list[tuple[int, int]]]:
    """For each window's size, the turns (queue, tokens) that fill it.

    ``left`` are the queues' tokens, ``owed`` their deficits in tokens times the sum of weights; both are
    changed. Each round a queue that has tokens is owed its share of the window and served what is whole of that.
    """
    total, turn = sum(weights), 0
    queues = len(weights)
    for size in windows:
        room, turns = size, []
        while room:
            # the shares of empty queues go to the others
            active = sum(w for w, n in zip(weights, left, strict=True) if n)
            for step in range(queues):
                i = (turn + step) % queues
                if not left[i]:
                    continue
                if owed[i] < total:
                    owed[i] += size * weights[i] * total // active
                n = min(owed[i] // total, left[i], room)
                if n:
                    owed[i] -= n * total
                    left[i] -= n
                    room -= n
                    turns.append((i, n))
                if not room:
                    # who is still owed whole tokens is served first in the next window
                    turn = i if owed[i] >= total and left[i] else (i + 1) % queues
                    break
        yield turns


def sequence_sizes(tokens: int, capacity: int) -> list[int]:
    """Full windows, then the rest as powers of two."""
    full, rest = divmod(tokens, capacity)
    return [capacity] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


# ---- packing


def pack_mixture(
    docs: DataFrame,
    *,
    capacity: int = 2048,
    end_id: int = 1,
    targets: dict[str | None, float] | None = None,
    queues: int = 256,
    group: int = 256,
    tokenizer: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """Packs every document of ``docs`` (doc_id, source, text) into sequences of ``capacity`` tokens, each with the sources' target shares.

    One row a piece: doc_id, start (its document's tokens before it), length, ids_crc32, doc_tokens, source, sequence_id, offset
    and, unless with_ids is false, ids. ``targets`` are the shares of sources; a source that has none, or no target at all, has
    its own share of all tokens, so that all queues end together. When a queue is empty the others fill its room.

    A null or empty text is the single token ``end_id``; a null source is a source; a null doc_id stays null; equal rows
    are packed once each; texts of any length are cut where a turn ends; other columns are ignored; an empty table gives no rows.
    """
    import public_tokenizers as files

    spark = docs.sparkSession
    tokens = written(encoded(docs, tokenizer or files.path("word_bpe_49k.json"), end_id), "tokens", compression="zstd")
    sums = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    largest = [(r["source"], r["n"]) for r in sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("source")).limit(queues).collect()]
    everything = tokens.agg(F.sum("n")).first()[0] or 0
    sizes = [n for _, n in largest]
    if rest := everything - sum(sizes):
        sizes.append(rest)
    shares = [(targets or {}).get(s) for s, _ in largest] + [None] * (len(sizes) - len(largest))
    weights = sizes if not targets else [max(1, round((n / everything if s is None else s) * (1 << 40))) for s, n in zip(shares, sizes, strict=True)]
    schedule = Schedule(sizes, weights)
    span = group * capacity
    out_schema = FIELDS + (", ids array<int>" if with_ids else "")

    names = [s for s, _ in largest if s is not None]
    known = F.create_map(*[F.lit(x) for i, (s, _) in enumerate(largest) if s is not None for x in (s, i)]) if names else None
    null_queue = next((i for i, (s, _) in enumerate(largest) if s is None), len(largest))
    queue_of = F.when(F.col("source").isNull(), null_queue).otherwise(F.coalesce(F.element_at(known, F.col("source")), F.lit(len(largest))) if names else F.lit(len(largest)))

    # where each part's tokens of a source begin in their queue
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_part = sums.withColumn("queue", queue_of).withColumn("within", before(Window.partitionBy("queue", "part").orderBy("source")))
    across = by_part.groupBy("queue", "part").agg(F.sum("n").alias("n")).withColumn("across", before(Window.partitionBy("queue").orderBy("part"))).drop("n")
    base = by_part.join(across, ["queue", "part"]).select(F.col("source").alias("s"), F.col("part").alias("p"), "queue", (F.col("within") + F.col("across")).alias("base"))
    # as a table its size is known before the join is planned: the ids are not moved for it while it is small
    base = written(base, "bases")
    placed = tokens.join(base, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "queue", (F.col("base") + F.col("at")).alias("place"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's tokens by the group of windows that its queue gives them to."""
        bounds: dict[int, list[int]] = {}

        def bound(g: int) -> list[int]:
            if g not in bounds:
                if len(bounds) > 4096:
                    bounds.clear()
                bounds[g] = schedule.served(min(g * span, everything))[0]
            return bounds[g]

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows: list[tuple] = []
                for doc_id, source, q, place, n, ids in zip(*(c.to_pylist() for c in batch.slice(lo, 512).columns), strict=True):
                    wide, done = len(ids) // n, 0
                    g = max(0, sum(schedule.at_tick(schedule.tick_of(q, place) - 1)) // span)
                    while g and bound(g)[q] > place:
                        g -= 1
                    while done < n:
                        while bound(g + 1)[q] <= place + done:
                            g += 1
                        take = min(n - done, bound(g + 1)[q] - place - done)
                        rows.append((g, q, place + done, doc_id, source, done, n, ids[wide * done : wide * (done + take)]))
                        done += take
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), slice_types, strict=True)], slice_names)

    slice_names = ["g", "queue", "place", "doc_id", "source", "start", "doc_tokens", "ids"]
    slice_types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of one group after another; rows come sorted by group, queue and place."""
        held: list[dict] = []
        for batch in batches:
            g = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for a, b in zip(edges, edges[1:], strict=False):
                if held and held[0].column(0)[0].as_py() != int(g[a]):
                    yield from filled(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from filled(held)

    def filled(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = held[0].column(0)[0].as_py()
        (start, tick), (stop, _) = schedule.served(g * span), schedule.served(min((g + 1) * span, everything))
        waiting: list[deque] = [deque() for _ in sizes]
        for batch in held:
            for _, q, _, doc_id, source, begin, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting[q].append((doc_id, source, begin, n, np.frombuffer(ids, width).astype("<u4")))
        left = [b - a for a, b in zip(start, stop, strict=True)]
        owed = [w * tick - s * schedule.total for w, s in zip(weights, start, strict=True)]
        head = [0] * len(sizes)
        rows: list[tuple] = []
        windows = sequence_sizes(sum(left), capacity)
        for k, turns in enumerate(round_robin(windows, left, weights, owed)):
            offset = 0
            for q, n in turns:
                while n:
                    doc_id, source, begin, doc_tokens, ids = waiting[q][0]
                    take = min(n, len(ids) - head[q])
                    own = ids[head[q] : head[q] + take]
                    row = (doc_id, begin + head[q], take, zlib.crc32(own.tobytes()), doc_tokens, source, g * group + k, offset)
                    rows.append((*row, own.astype(np.int32)) if with_ids else row)
                    offset += take
                    n -= take
                    head[q] += take
                    if head[q] == len(ids):
                        waiting[q].popleft()
                        head[q] = 0
            if len(rows) >= 4096:
                yield pieces(rows)
                rows = []
        if rows:
            yield pieces(rows)

    piece_types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    piece_names = [f.split()[0] for f in out_schema.split(", ")]

    def pieces(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), piece_types, strict=False)], piece_names)

    if not everything:
        return spark.createDataFrame([], out_schema)
    width = _encoder(tokenizer or files.path("word_bpe_49k.json")).dtype
    slices = placed.mapInArrow(cut, "g long, queue int, place long, doc_id long, source string, start long, doc_tokens long, ids binary")
    return slices.repartition("g").sortWithinPartitions("g", "queue", "place").mapInArrow(fill, out_schema)
