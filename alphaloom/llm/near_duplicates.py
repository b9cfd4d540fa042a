"""Near-duplicate classes of documents by ProbMinHash, banding and exact verification.

Shingles are five words; one that occurs c times weighs 1 + ln(c). In ProbMinHash every shingle starts a
Poisson process whose rate is its weight; an arrival falls on a random register, and each register keeps the
shingle that arrived first. Registers of two documents then agree with the probability
Jaccard similarity of their weighted shingles. That is also the similarity that verification
computes, exactly and from the same weights; of texts that repeat nothing it is the Jaccard
similarity of the sets. A document's processes stop as soon as the next arrivals come later than all
its registers hold. The registers' bands are bucket keys.

Texts that are equal are one node from the start, so groups of copies cost one row. Within a
bucket no list of pairs is made:

1. every node is compared with the bucket's first node (a star: as many pairs as rows);
2. connected components are found from the pairs at or above the similarity;
3. buckets whose nodes are all in one component are done. In the others, the nodes outside
   the bucket's largest component are dealt in blocks of bounded size, and each block is compared within
   itself, with every other such block, and with blocks of the largest component, whose nodes are not
   compared with each other; a task returns a spanning forest, not pairs.

So a bucket costs rows in proportion to its size times the blocks outside its largest component: one, where a
large class has a few strangers in its bucket. A pair that shares a bucket is left out only if its two nodes are
connected already: the classes are those that all verified pairs would give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import WORD, discard, map_batches, sliced, written

#: Shingle length, registers as bands x rows, and nodes in one block of an unresolved bucket.
WORDS, BANDS, ROWS, BLOCK = 5, 21, 6, 256
#: Bytes of shingles in one block, on average at most.
BLOCK_BYTES = 16 << 20
#: Shingles whose processes run side by side.
SIDE_BY_SIDE = 100_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_ODD = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 for i in range(16)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that looks random."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """A hash for each run of ``words`` words of the text; of all its words, if they are fewer."""
    found = WORD.findall(text.lower())
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    if len(h) < words:
        return _mixed((h * _ODD[: len(h)]).sum(keepdims=True) + np.uint64(len(h))) if len(h) else h
    out = np.zeros(len(h) - words + 1, np.uint64)
    for i in range(words):
        out += h[i : len(h) - words + 1 + i] * _ODD[i]
    return _mixed(out)


def weighted_shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes in order, how often each occurs)."""
    return np.unique(shingles(text, words), return_counts=True)


def weights_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def prob_jaccard(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> float:
    """The probability Jaccard similarity of two sorted sets with weights: the sum, over the common ones, of
    1 / sum over all of max(wx[j] / wx[i], wy[j] / wy[i])."""
    common, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    a, b = wx[i], wy[j]
    order = np.argsort(b / a, kind="stable")
    a, b = a[order], b[order]
    # of those with a smaller ratio of weights the first term is the maximum, of the others the second
    first = wx.sum() - a.sum() + np.cumsum(a)
    second = wy.sum() - np.cumsum(b)
    return float((1 / (first / a + second / b)).sum())


def prob_minhash(values: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Registers (n_docs x m) of documents given as distinct (doc, value) with weights above 0; every document has some."""
    first = np.full(n_docs * m, np.inf)
    held = np.zeros(n_docs * m, np.uint64)
    state, time = values, np.zeros(len(values))
    while len(values):
        state = state + _MIX[0]
        bits = _mixed(state)
        time = time - np.log(((bits >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weights
        at = doc * m + (_mixed(bits ^ _MIX[1]) % np.uint64(m)).astype(np.int64)
        early = np.flatnonzero(time < first[at])
        np.minimum.at(first, at[early], time[early])
        won = early[time[early] == first[at[early]]]
        held[at[won]] = values[won]
        last = first.reshape(n_docs, m).max(axis=1)
        keep = np.flatnonzero(time < last[doc])
        values, weights, doc, state, time = values[keep], weights[keep], doc[keep], state[keep], time[keep]
    return held.reshape(n_docs, m)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key a band (n x bands)."""
    parts = registers[:, : bands * rows].reshape(-1, bands, rows)
    keys = _mixed((_mixed(parts) * _ODD[:rows]).sum(axis=2) + np.arange(bands, dtype=np.uint64) * _MIX[2])
    return keys.view(np.int64)


def sketch(texts: list[str], words: int, bands: int, rows: int) -> list[np.ndarray | None]:
    """The band keys of each text; None for one without words."""
    out: list[np.ndarray | None] = [None] * len(texts)
    group: list[tuple[int, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        if group:
            sizes = [len(v) for _, v, _ in group]
            doc = np.repeat(np.arange(len(group)), sizes)
            weights = weights_of(np.concatenate([c for _, _, c in group]))
            registers = prob_minhash(np.concatenate([v for _, v, _ in group]), weights, doc, len(group), bands * rows)
            for (i, _, _), keys in zip(group, band_keys(registers, bands, rows), strict=True):
                out[i] = keys
            group.clear()

    total = 0
    for i, text in enumerate(texts):
        values, counts = weighted_shingles(text, words)
        if len(values) == 1:
            out[i] = band_keys(np.full((1, bands * rows), values[0]), bands, rows)[0]
        elif len(values):
            group.append((i, values, counts))
            total += len(values)
            if total > SIDE_BY_SIDE:
                flush()
                total = 0
    flush()
    return out


def node_of(text: Column) -> Column:
    """What stands for all equal texts, half of their SHA-256; null for a null or empty one."""
    return F.when(F.length(text) > 0, F.substring(F.unhex(F.sha2(text, 256)), 1, 16))


def least_nodes(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(node, bands) of each different text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = sketch(batch.column(1).to_pylist(), words, bands, rows)
        keys = [k for k in found if k is not None]
        ends = np.cumsum([0] + [0 if k is None else len(k) for k in found]).astype(np.int32)
        column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.array([], np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0), column], names=["node", "bands"])

    sketched = map_batches(docs.select(node_of(F.col("text")).alias("node"), "text").where("node is not null"), run, "node binary, bands array<long>")
    return sketched.groupBy("node").agg(F.first("bands").alias("bands"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles, counts) for the wanted nodes: the sorted distinct hashes as bytes, and how often they occur (nothing, if once each)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [weighted_shingles(t, words) for t in batch.column(1).to_pylist()]
        values = pa.array([v.tobytes() for v, _ in sets], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), values, pa.array([c.astype(np.uint32).tobytes() if (c > 1).any() else b"" for _, c in sets], pa.binary())], names=["node", "shingles", "counts"])

    texts = docs.select(node_of(F.col("text")).alias("node"), "text").where("node is not null").groupBy("node").agg(F.first("text").alias("text"))
    return map_batches(texts.join(wanted, "node", "left_semi"), run, "node binary, shingles binary, counts binary")


def read_set(shingles_: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """(hashes, weights), None for weights that are all 1."""
    return np.frombuffer(shingles_, np.uint64), weights_of(np.frombuffer(counts, np.uint32)) if counts else None


def is_similar(one: tuple[np.ndarray, np.ndarray | None], two: tuple[np.ndarray, np.ndarray | None], similarity: float) -> bool:
    (x, wx), (y, wy) = one, two
    if wx is None and wy is None:
        if min(len(x), len(y)) < similarity * max(len(x), len(y)):
            return False
        both = len(x) + len(y) - len(np.union1d(x, y))
        return both >= similarity * (len(x) + len(y) - both)
    return prob_jaccard(x, np.ones(len(x)) if wx is None else wx, y, np.ones(len(y)) if wy is None else wy) >= similarity - 1e-12


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows (a, b) of pairs whose weighted sets have that probability Jaccard similarity."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [is_similar(read_set(x, cx), read_set(y, cy), similarity) for x, cx, y, cy in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"), F.col("counts").alias("cx")), "a")
    both = own.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"), F.col("counts").alias("cy")), "b").select("a", "b", "x", "cx", "y", "cy")
    return map_batches(both, run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node of its component.

    Alternates two star operations until nothing changes: each node's larger neighbours are linked
    to its least neighbour, then each node and its smaller neighbours to the least of them.
    Each round's edges are a table, at most as many as before; a hub's edges are never one row.
    """
    # counted while they are written
    counted = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))

    def kept(df: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        return written(df.observe(seen, *counted), "edges"), seen.get

    now, seen = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a table of its own has an exchange of its own in the join, which can then be split where a hub has many links
        least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # every edge points from the larger node a to the smaller b
        large = written(large, "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        before, last = seen, now
        now, seen = kept(small.where("a <> b").distinct())
        discard(last, least, large, low)
        if before == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def block_forest(nodes: list[bytes], roots: list[bytes], sides: list[int], sets: list[tuple[np.ndarray, np.ndarray | None]], similarity: float) -> list[tuple[bytes, bytes]]:
    """Links between similar nodes of different components; none between two that are connected by then.

    A node of side 0 is compared with all others; of nodes of side 1 no two are.
    """
    number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    group = np.array([number[r] for r in roots])
    sizes = np.array([len(v) for v, _ in sets])
    weights = np.concatenate([np.ones(len(v)) if w is None else w for v, w in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    total = np.bincount(row, weights, minlength=len(sets))
    values, place = np.unique(np.concatenate([v for v, _ in sets]), return_inverse=True)
    order = np.argsort(place, kind="stable")
    holders, held_weight, starts = row[order], weights[order], np.searchsorted(place[order], np.arange(len(values) + 1))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    side = np.array(sides)
    out = []
    for i in np.flatnonzero(side == 0):
        other = group != group[i]
        if not other.any():
            continue
        held = place[begins[i] : begins[i + 1]]
        runs = [slice(starts[p], starts[p + 1]) for p in held]
        who = np.concatenate([holders[r] for r in runs])
        theirs = np.bincount(who, np.concatenate([held_weight[r] for r in runs]), minlength=len(sets))
        mine = np.bincount(who, np.repeat(weights[begins[i] : begins[i + 1]], [r.stop - r.start for r in runs]), minlength=len(sets))
        # the similarity is no more than the share of weight that either has in common with the other
        may = np.flatnonzero(other & (np.minimum(theirs / total, mine / total[i]) >= similarity - 1e-9))
        for j in may:
            if group[j] != group[i] and is_similar(sets[i], sets[j], similarity):
                out.append((nodes[i], nodes[j]))
                group[group == group[j]] = group[i]
    return out


def unresolved_links(members: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links (a, b) that buckets (key, node) still need: between similar nodes that are not yet in one component."""
    labelled = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    open_keys = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    sizes = sets.select("node", F.octet_length("shingles").alias("bytes"))
    rows = written(labelled.join(open_keys, "key").join(sizes, "node"), "open")
    # one row a component of a bucket, then one a bucket: its largest component, and the blocks in and outside that
    parts_of = rows.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    whole = parts_of.groupBy("key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "root", "bytes")).alias("big"))
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / block), F.ceil(size / F.lit(BLOCK_BYTES))).cast("int")
    plan = written(
        whole.select(
            "key",
            F.col("big.root").alias("big"),
            blocks(F.col("n") - F.col("big.n"), F.col("bytes") - F.col("big.bytes")).alias("out_blocks"),
            blocks(F.col("big.n"), F.col("big.bytes")).alias("big_blocks"),
        ),
        "plan",
    )
    placed = rows.join(plan, "key").select("*", (F.col("root") == F.col("big")).alias("inside"))
    mine = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("big_blocks")).otherwise(F.col("out_blocks"))).cast("int"))
    # A task is (outer block, other outer block or none, inner block or none).
    each = lambda n: F.sequence(F.lit(0), n - 1)
    with_inner = F.transform(each(F.col("big_blocks")), lambda j: F.struct(F.col("own").alias("x"), F.lit(-1).alias("y"), j.alias("z")))
    with_outer = F.transform(F.filter(each(F.col("out_blocks")), lambda j: j != F.col("own")), lambda j: F.struct(F.least("own", j).alias("x"), F.greatest("own", j).alias("y"), F.lit(-1).alias("z")))
    of_inner = F.transform(each(F.col("out_blocks")), lambda j: F.struct(j.alias("x"), F.lit(-1).alias("y"), F.col("own").alias("z")))
    # the shingles come before the dealing: a node is in a few buckets, but may be dealt to many blocks
    dealt = mine.join(sets, "node").withColumn("at", F.explode(F.when(F.col("inside"), of_inner).otherwise(F.concat(with_inner, with_outer))))
    # two outer blocks are compared with each other only
    side = F.when(F.col("inside") | ((F.col("at.y") >= 0) & (F.col("own") == F.col("at.y"))), 1).otherwise(0)
    named = dealt.select(F.xxhash64("key", "at.x", "at.y", "at.z").alias("task"), "node", "root", side.alias("side"), "shingles", "counts")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        found: list[tuple[bytes, bytes]] = []

        def finish() -> None:
            if len({r for _, _, r, *_ in held}) > 1:
                _, nodes, roots_, sides, shingles_, counts = zip(*held, strict=True)
                found.extend(block_forest(list(nodes), list(roots_), list(sides), [read_set(s, c) for s, c in zip(shingles_, counts, strict=True)], similarity))
            held.clear()

        def out() -> pa.RecordBatch:
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        for batch in sliced(batches):
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != line[0]:
                    finish()
                held.append(line)
            yield out()
            found.clear()
        finish()
        yield out()

    spread = named.repartition(parts, "task").sortWithinPartitions("task", "node")
    return spread.mapInArrow(run, "a binary, b binary")


def near_duplicate_nodes(docs: DataFrame, *, words: int = WORDS, similarity: float = 0.8, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(node, root) of every text that is similar to another one."""
    sketches = written(least_nodes(docs, words, bands, rows), "sketch")
    members = sketches.select(F.explode("bands").alias("key"), "node")
    buckets = members.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("hi")).where("lead <> hi").select("key", "lead")
    filled = written(members.join(buckets, "key"), "buckets")
    star = filled.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    sets = written(shingle_sets(docs, filled.select("node").distinct(), words), "shingles")
    first = components(similar_pairs(star, sets, similarity))
    more = written(unresolved_links(filled.select("key", "node"), first, sets, similarity, block), "links")
    # the stars of the first components stand for their links, so no node is renamed by a join on its root
    nodes = components(more.unionByName(first.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))))
    discard(sketches, filled, sets, more)
    return nodes


def _with_node(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), node_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("node"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def near_duplicate_classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id and class_id, one row a document: class_id is the least doc_id of the documents that are connected to it
    by similar pairs, its own if there are none.

    Equal texts are similar; a text of fewer words than a shingle is one shingle; null and empty texts
    are alone. Repeated rows give repeated rows; a null doc_id counts as larger than others, and a class
    of such documents has a null class_id; other columns are ignored; an empty table gives no rows.
    """
    nodes = near_duplicate_nodes(_texts(docs), **options)
    named = _with_node(docs)
    # One row a different text, then one a class.
    least = named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = least.join(nodes, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    # a table of its own: a join of two exchanges is one that a large class can be split in
    by_root = written(rooted.groupBy("root").agg(F.min("least").alias("class_id")), "roots")
    class_of = written(rooted.join(by_root, "root").select("node", "class_id"), "classes")
    out = named.where("node is not null").join(class_of, "node").select("doc_id", "class_id")
    return out.unionByName(named.where("node is null").select("doc_id", F.col("doc_id").alias("class_id")))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, without near-duplicates: of each class the row of its least doc_id
    (null last, then by text); of several rows with that doc_id and text, one. Null and empty texts stay."""
    nodes = near_duplicate_nodes(_texts(docs), **options)
    named = _with_node(docs)
    best = named.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("best"))
    rooted = best.join(nodes, "node", "left").select(F.coalesce("root", "node").alias("root"), F.struct("best", "node").alias("best"))
    kept = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.node").alias("_node"), F.coalesce("best.best.doc_id", F.lit(-1)).alias("_id"), F.col("best.best.no_id").alias("_none"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), node_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_node"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_id"), F.col("doc_id").isNull().alias("_none"))
    chosen = whole.where("_node is not null").join(written(kept, "kept"), ["_node", "_id", "_none"]).dropDuplicates(["_node", "_id", "_none"])
    return chosen.select("_row.*").unionByName(whole.where("_node is null").select("_row.*"))
