"""Importance resampling towards a target's distribution of hashed n-grams.

A feature is a word or two words in a row; its bucket is a hash. The gain of a bucket is the
logarithm of how much more frequent it is in the target than in the documents, as an
integer, and a document's weight is the mean gain of its features. With Gumbel noise that
depends on the id alone, the highest scores are a draw without replacement in proportion to
the weights.

Two passes over the texts: one counts buckets, one scores with the array of gains, which is
all that the tasks are sent, as long as ``buckets`` however large the tables are. Scores are
written to the shared folder. The cutoff of the draw is found by bisection: each job counts
exactly how many rows reach each of some trial cutoffs, first of the score, then of doc_id among the rows that tie at it,
then of the row's place among rows repeated at both; nothing is sorted for that and
only counts reach the driver. The drawn rows alone are range-partitioned and numbered, each
range after the rows of the ranges before it.

Words are cut from the UTF-8 bytes, and the hashes of all words of a block are made together in
numpy; the hash of two words in a row follows from theirs, since CRC-32 is linear.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bytes of text that are cut into words at a time.
BLOCK = 1 << 20
#: Words of more bytes are hashed one by one.
LONG = 48
#: Trial cutoffs of one count job.
CUTS = 15

_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_IN_WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)


def _byte_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _byte_table()


def _shift_tables() -> np.ndarray:
    """For each length up to LONG, what a CRC becomes when so many bytes follow, by its four bytes."""
    out = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
    for _ in range(LONG):
        out.append(_CRC[out[-1] & 255] ^ (out[-1] >> 8))
    return np.stack(out)


_SHIFT = _shift_tables()
_SPACE = np.uint32(zlib.crc32(b" "))


def _shifted(crc: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    return _SHIFT[length, 0, crc & 255] ^ _SHIFT[length, 1, (crc >> 8) & 255] ^ _SHIFT[length, 2, (crc >> 16) & 255] ^ _SHIFT[length, 3, crc >> 24]


def _word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, all words of a block at once, byte by byte."""
    capped = np.minimum(lengths, LONG + 1).astype(np.uint8)
    order = np.argsort(capped, kind="stable")[::-1]
    begin, size = starts[order], capped[order]
    # how many words have more than k bytes
    longer = len(size) - np.cumsum(np.bincount(capped, minlength=LONG + 2))
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(min(int(size[0]), LONG)):
        n = longer[k]
        state[:n] = _CRC[(state[:n] ^ data[begin[:n] + k]) & 255] ^ (state[:n] >> 8)
    out = np.empty_like(state)
    out[order] = ~state
    for i in order[: longer[LONG]]:
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]].tobytes())
    return out


def features(texts: pa.StringArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of the texts' bytes: the row of each word, the row of each feature, and each feature's CRC-32.

    Blocks end between words, so a text of any length takes the memory of a block.
    """
    _, where, held = texts.buffers()
    bounds = np.frombuffer(where, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    at, end = int(bounds[0]), int(bounds[-1])
    last: tuple[int, np.uint32] | None = None
    while at < end:
        to = min(at + BLOCK, end)
        while to < end and _IN_WORD[_LOWER[raw[to]]]:
            run = ~_IN_WORD[_LOWER[raw[to : to + BLOCK]]]
            to = to + int(run.argmax()) if run.any() else min(to + BLOCK, end)
        data = _LOWER[raw[at:to]]
        inside = _IN_WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, to, "right")] - at] = True
        edge[0] = edge[-1] = True
        starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
        if len(starts):
            lengths = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1 - starts
            row = np.searchsorted(bounds, starts + at, "right") - 1
            crc = _word_hashes(data, starts, lengths)
            before_row, before = np.concatenate([[last[0] if last else -1], row[:-1]]), np.concatenate([[last[1] if last else 0], crc[:-1]]).astype(np.uint32)
            paired = before_row == row
            lead, size = _shifted(before[paired], 1) ^ _SPACE, lengths[paired]
            both = _shifted(lead, np.minimum(size, LONG)) ^ crc[paired]
            for i in np.flatnonzero(size > LONG):
                s = starts[paired][i]
                both[i] = zlib.crc32(data[s : s + size[i]].tobytes(), int(lead[i]))
            yield row, np.concatenate([row, row[paired]]), np.concatenate([crc, both])
            last = (int(row[-1]), crc[-1])
        at = to


def bucket_counts(df: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all texts of ``df`` (text) each bucket holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, crc in features(batch.column(0)):
                held += np.bincount(crc % buckets, minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], ["bucket", "n"])

    counted = df.select(F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():  # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains_of(own: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """Each bucket's logarithm of its share in the target over its share in the documents, scaled and floored; every count is one more than it is."""
    n = len(own)
    ratio = (target + 1.0) * float(own.sum() + n) / ((own + 1.0) * float(target.sum() + n))
    return np.floor(scale * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document: the floored mean of its features' gains, 0 without any."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words, n_features, sums = (np.zeros(n, np.int64) for _ in range(3))
            for word_row, row, crc in features(batch.column(1)):
                n_words += np.bincount(word_row, minlength=n)
                n_features += np.bincount(row, minlength=n)
                order = np.argsort(row, kind="stable")
                first = np.flatnonzero(np.diff(row[order], prepend=-1))
                sums[row[order][first]] += np.add.reduceat(gains[crc % buckets][order], first)
            weight = np.where(n_features > 0, sums // np.maximum(n_features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int, scale: int = 1000) -> Column:
    """Noise that depends on the seed and doc_id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _least(rows: DataFrame, key: Column, need: int) -> int:
    """The least value v such that at least ``need`` of ``rows`` have key <= v (1 <= need <= count of rows).

    Each job counts the rows at or below some trial values between the bounds, which close in.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    while low < high:
        step = max(1, -(-(high - low) // (CUTS + 1)))
        trials = list(range(low, high, step))
        counts = rows.agg(*[F.count(F.when(key <= F.lit(t).cast("long"), 1)) for t in trials]).first()
        reached = [t for t, n in zip(trials, counts, strict=True) if n >= need]
        missed = [t for t, n in zip(trials, counts, strict=True) if n < need]
        high = min([high, *reached])
        low = max([low, *(t + 1 for t in missed)])
    return low


def _drawn(scores: DataFrame, wanted: int) -> Column:
    """Whether a row of ``scores`` is among the ``wanted`` first by score, doc_id and place."""
    able, down = scores.where("able"), -F.col("score")
    # a null id comes after all others
    id_key, place = F.col("doc_id"), F.col("place")
    c = _least(able, down, wanted)
    taken = down < c
    tied = able.where(down == c)
    need = wanted - able.where(taken).count()
    known = tied.where(id_key.isNotNull())
    n_known = known.count()
    if need > n_known:
        named = id_key.isNotNull()
        last = tied.where(id_key.isNull())
        need -= n_known
        at_last = id_key.isNull()
    else:
        d = _least(known, id_key, need)
        named = id_key < d
        need -= known.where(named).count()
        at_last = id_key == d
        last = known.where(at_last)
    p = _least(last, place, need)
    return F.col("able") & (taken | ((down == c) & (F.coalesce(named, F.lit(False)) | (F.coalesce(at_last, F.lit(False)) & (place <= p)))))


def ranked(rows: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, 3...) in the given order, without bringing them into one task: a written table of sorted ranges, and each range's offset."""
    ranges = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    nth = F.monotonically_increasing_id()
    table = written(ranges.withColumns({"range": F.shiftright(nth, 33), "nth": nth.bitwiseAND((1 << 33) - 1)}), "ranges")
    sizes = sorted((r["range"], r["n"]) for r in table.groupBy("range").agg(F.count("*").alias("n")).collect())  # one number a task
    if not sizes:
        return table.select(*rows.columns, F.lit(None).cast("long").alias("rank"))
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])[:-1]]).tolist()
    offset = F.element_at(F.create_map(*[F.lit(x) for (k, _), b in zip(sizes, before, strict=True) for x in (k, b)]), F.col("range"))
    return table.select(*rows.columns, (offset + F.col("nth") + 1).cast("long").alias("rank"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    buckets: int = 10_000,
    percent: int = 25,
    min_words: int = 20,
    seed: int = 7,
) -> DataFrame:
    """Draws ``percent`` of 100 of the documents with at least ``min_words`` words, likelier the more they look like ``target`` (text).

    One row a document of ``docs`` (doc_id, text): doc_id, n_features, weight, score, and rank (1, 2, 3... by
    falling score, then rising doc_id; null if not drawn).

    A null or empty text has no features and the weight 0; a null doc_id stays null, has the noise of an empty id and ranks after
    others of its score; equal rows are drawn one by one; an empty target makes all common buckets dear; an empty table gives no
    rows; texts of any length are read whole; other columns are ignored, whatever their names.
    """
    gains = gains_of(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    weighed = weigh(docs, gains)
    scores = written(
        weighed.select(
            "doc_id",
            "n_features",
            "weight",
            (F.col("weight") + gumbel(seed)).alias("score"),
            (F.col("n_words") >= min_words).alias("able"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "scores",
    )
    wanted = scores.where("able").count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return scores.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = _drawn(scores, wanted)
    parts = scores.sparkSession.sparkContext.defaultParallelism + wanted // 1_000_000
    top = ranked(scores.where(drawn).select(*columns, "place"), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")], parts)
    rest = scores.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank"))
    return top.select(*columns, "rank").unionByName(rest)
