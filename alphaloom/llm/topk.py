"""Exact top-k search by term-at-a-time accumulation.

Vectors are quantised to integers and used as sparse rows: a term is a dimension, a posting a
candidate with a non-zero weight there. For a block of candidates the postings of each term are
built once; every query of a block scatters weight times weight into one dense array of scores,
a partition selects its k best, and the selections of all candidate blocks are merged.

Each pair of a query block and a candidate block is one group of a shuffle. Queries are a
stated set against all rows, in blocks: the smaller side, the queries, is copied to every
candidate block, the candidates to every query block. Blocks are dealt by a hash of the row,
so equal vectors spread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of components in one block of candidates, and of queries: what a task holds, a few times over.
CANDIDATE_BYTES, QUERY_BYTES = 32 << 20, 16 << 20
#: Rows of a block of candidates where smaller blocks are needed to give every core one.
FEW = 8192


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, a whole number as double; null for a vector that is null, holds a null
    or a component that is not finite (or is not when multiplied)."""
    value = lambda x: x.cast("double") * scale
    finite = F.forall(embedding, lambda x: F.coalesce(~F.isnan(value(x)) & (F.abs(value(x)) < float("inf")), F.lit(False)))
    # a double of 2**53 or more is whole; floor() of it would not fit a long
    whole = lambda x: F.when(F.abs(value(x)) < float(1 << 53), F.floor(value(x)).cast("double")).otherwise(value(x))
    return F.transform(F.when(finite, embedding), whole)


def whole_numbers(vectors: list[np.ndarray], other: list[np.ndarray]) -> list[np.ndarray]:
    """The vectors as int64 if no inner product with another one can leave that range, else as Python's integers."""
    largest = [max((float(np.abs(v).max()) for v in vs if len(v)), default=0.0) for vs in (vectors, other)]
    width = max(map(len, vectors))
    if max(largest) < 2.0**62 and largest[0] * largest[1] * max(width, 1) < 2.0**62:
        return [v.astype(np.int64) for v in vectors]
    return [np.array([int(x) for x in v], object) for v in vectors]


def scatter_block(queries: list[np.ndarray], candidates: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each query its dense array of scores against the block's candidates."""
    width = max(map(len, candidates))
    lengths = np.array([len(c) for c in candidates])
    dense = np.zeros((len(candidates), width), candidates[0].dtype)
    dense[np.arange(width) < lengths[:, None]] = np.concatenate(candidates)
    postings = []
    for term in range(width):
        rows = np.flatnonzero(dense[:, term])
        postings.append((rows if len(rows) < len(candidates) else slice(None), dense[rows, term]))
    for query in queries:
        scores = np.zeros(len(candidates), dense.dtype)
        for term in np.flatnonzero(query[:width]):
            rows, weights = postings[term]
            scores[rows] += query[term] * weights
        yield scores


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, without the rows that bear the id ``own``."""
    others = np.flatnonzero(ids != own)
    if len(others) > k:
        own_scores = scores[others]
        least = np.partition(own_scores, len(others) - k)[len(others) - k]
        others = others[own_scores >= least]
    if scores.dtype == object:
        return np.array(sorted(others, key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return others[np.lexsort((ids[others], -scores[others]))[:k]]


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query with all other rows.

    A query's own row, and any row with the same id, is no candidate of it. Vectors that are null or
    hold null or non-finite components, and rows with a null id, take no part; vectors of unequal
    length meet on the components both have. Components of any size are multiplied exactly; a score
    beyond the range of long ranks by its true value and is shown as the end of that range. Repeated
    rows count apart, with equal scores in any order; repeated query ids are one query for each
    different vector. Fewer candidates than k give fewer rows; an empty table gives none; other
    columns, whatever their names, are ignored.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), quantised(F.col(f"`{vec_col}`"), scale).alias("vec"), is_query.alias("q")).where("id is not null and vec is not null")
    n_rows, n_queries, width = rows.agg(F.count("*"), F.count_if("q"), F.max(F.size("vec"))).first()
    row_bytes = 8 * max(1, width or 0)
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n_cand = max(1, math.ceil(n_rows * row_bytes / CANDIDATE_BYTES), min(2 * cores, math.ceil(n_rows / FEW)))
    n_query = max(1, math.ceil(n_queries * row_bytes / QUERY_BYTES))
    block = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id", F.hash("vec")), F.lit(n)).cast("int")
    queries = rows.where("q").select("id", "vec").distinct().select(block(n_query, 1).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_cand - 1))).alias("cb"), "id", "vec")
    candidates = rows.select(F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("qb"), block(n_cand, 2).alias("cb"), F.col("id").alias("vec_id"), F.col("vec").alias("weights"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "true": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "int64", "true": "str"})
        ids, out = right["vec_id"].to_numpy(), []
        own_vectors, others = list(left["vec"]), list(right["weights"])
        lists = whole_numbers(own_vectors, others), whole_numbers(others, own_vectors)
        for own, scores in zip(left["id"], scatter_block(*lists), strict=True):
            for i in best(scores, ids, own, k):
                exact = int(scores[i])
                shown = min(max(exact, -(1 << 63)), (1 << 63) - 1)
                out.append((own, ids[i], shown, None if shown == exact else str(exact)))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "true"])

    found = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInPandas(search, "query_id long, vec_id long, score long, true string")
    # of scores beyond long, the longer number of digits is the higher (the lower, if negative)
    sign = F.when(F.col("score") < 0, -1).otherwise(1)
    beyond = [F.desc(sign * F.coalesce(F.length("true"), F.lit(0))), F.when(F.col("score") < 0, F.col("true")).asc(), F.desc("true")]
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), *beyond, "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
