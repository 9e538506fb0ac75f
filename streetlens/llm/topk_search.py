"""Exact top-k search by inner product: MaxScore over shards of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streetlens.session import scratch_path, stage_table

#: Vectors of one shard, and query vectors of one block (a block is what the driver sends at once).
SHARD_ROWS, BLOCK_QUERIES = 8192, 4096


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """``id``, ``terms``: each component x as ``floor(scale * x)``; unusable vectors are left out.

    Left out: a null id or vector, and vectors with a null or non-finite component.
    """
    x = F.col(vector_column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    terms = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("bigint"))
    usable = vectors.filter(F.col(id_column).isNotNull() & x.isNotNull() & ~bad)
    return usable.select(F.col(id_column).cast("bigint").alias("id"), terms.alias("terms"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of terms, ``width`` columns; a missing term is 0."""
    lengths = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), width), np.int64)
    flat = np.asarray(column.flatten(), dtype=np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keep = at < width
    out[row[keep], at[keep]] = flat[keep]
    return out


def exact_kind(queries: np.ndarray, shard: np.ndarray) -> type:
    """The fastest numbers in which every sum of products of a query and a vector of the shard is exact.

    Doubles hold whole numbers up to 2**53, longs up to 2**63, Python's own any; the margins cover the rounding
    of the bound itself.
    """
    most = np.abs(queries.astype(float)) @ np.abs(shard.astype(float)).max(axis=0, initial=0)
    bound = most.max(initial=0)
    return float if bound < 2**52 else np.int64 if bound < 2**62 else object


class Best:
    """The k best (score, id) of each query so far: higher score first, then smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = [np.zeros(0, np.int64)] * queries
        self.ids = [np.zeros(0, np.int64)] * queries
        #: The k-th best score, a whole number once there are k.
        self.floor: list[float | int] = [-np.inf] * queries

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if scores.dtype == object and not all(-2**63 <= s < 2**63 for s in scores):
            raise OverflowError("an inner product among the best does not fit a long; take a smaller scale")
        scores, ids = np.concatenate((self.scores[q], scores.astype(np.int64))), np.concatenate((self.ids[q], ids))
        if len(scores) > 8 * self.k:
            keep = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[keep], ids[keep]
        order = np.lexsort((ids, ~scores))[:self.k]
        self.scores[q], self.ids[q] = scores[order], ids[order]
        if len(order) == self.k:
            self.floor[q] = int(scores[order[-1]])


def search_shard(best: Best, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, shard: np.ndarray) -> int:
    """MaxScore of every query over one shard; returns how many single products were computed.

    A term's bound is the most it can add in this shard: postings of the other sign only take away.
    Terms are non-essential while the sum of their bounds stays below the k-th best score: a vector
    that has nothing in the essential terms cannot win. The essential postings are scored for the whole
    shard; vectors whose score with all remaining bounds is still competitive are probed in the
    non-essential terms, largest bound first.
    """
    kind = exact_kind(queries, shard)
    queries, lists = queries.astype(kind), np.ascontiguousarray(shard.T.astype(kind))
    high, low = np.maximum(lists.max(axis=1), 0), np.minimum(lists.min(axis=1), 0)
    bounds = np.where(queries > 0, queries * high, queries * low)
    products = 0
    for q, reachable in enumerate(bounds.sum(axis=1)):
        if reachable < best.floor[q]:
            continue
        order = np.argsort(bounds[q])
        reach = np.cumsum(bounds[q][order])
        split = int(np.searchsorted(reach, best.floor[q], "left"))
        essential, rest = order[split:], order[:split]
        partial = queries[q][essential] @ lists[essential]
        products += len(essential) * len(ids)
        left = reach[split - 1] if split else 0
        alive = np.flatnonzero((partial + left >= best.floor[q]) & (ids != query_ids[q]))
        score = partial[alive]
        for t in rest[::-1]:
            if not len(alive):
                break
            left -= bounds[q][t]
            score = score + queries[q][t] * lists[t][alive]
            products += len(alive)
            keep = score + left >= best.floor[q]
            alive, score = alive[keep], score[keep]
        if len(alive):
            best.add(q, score, ids[alive])
    return products


def searcher(block, k: int, shard_rows: int):
    """Task: the k best of its rows for every query of the block that the driver has sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = block.value
        best = Best(len(query_ids), k)
        held, rows = [], 0

        def search():
            table = pa.Table.from_batches(held)
            ids = table.column("id").to_numpy()
            terms = table.column("terms").combine_chunks()
            search_shard(best, query_ids, queries, ids, matrix(terms, queries.shape[1]))

        for batch in batches:
            for start in range(0, batch.num_rows, shard_rows):
                piece = batch.slice(start, shard_rows)
                if rows and rows + piece.num_rows > shard_rows:
                    search()
                    held, rows = [], 0
                held.append(piece)
                rows += piece.num_rows
        if rows:
            search()
        counts = [len(x) for x in best.ids]
        if sum(counts):
            yield pa.RecordBatch.from_pydict({
                "query_id": np.repeat(query_ids, counts), "vec_id": np.concatenate(best.ids),
                "score": np.concatenate(best.scores)})

    return run


def max_score_search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256, id_column: str = "vec_id",
    vector_column: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The ``k`` vectors with the highest integer inner product for every query: exact.

    Result: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ties go to the smaller id, fewer than
    ``k`` rows where there are fewer vectors. A query never finds rows of its own id. Vectors that are
    null or hold a null or non-finite component take no part, on either side. Vectors of different
    length are compared over the terms both have. A vector that stands in the table twice takes two
    ranks; of a repeated query id the smallest vector is searched. Other columns are ignored. Scores are exact
    as long as they fit a long; where one among the best does not, the search ends with an error. Components
    beyond a long count as the nearest long.

    The query set is sent to the tasks in blocks of about ``block_queries`` vectors, whatever its size;
    every block passes over all vectors once, without a shuffle of them. Where there are several, one is
    worked off before the next is read, so that the driver holds a single block. Tasks keep ``k`` rows per
    query and only those are merged.
    """
    spark = vectors.sparkSession
    candidates = quantised(vectors, id_column, vector_column, scale)
    asked = quantised(queries, id_column, vector_column, scale).groupBy("id").agg(F.min("terms").alias("terms"))
    blocks = max(1, -(-asked.count() // block_queries))
    if blocks > 1:
        asked = stage_table(asked, "queries")

    def part(number: int) -> tuple[DataFrame, Broadcast]:
        block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).toArrow()
        terms = block.column("terms").combine_chunks()
        width = int(np.diff(np.asarray(terms.offsets)).max(initial=0)) if len(terms) else 0
        sent = spark.sparkContext.broadcast((block.column("id").to_numpy(), matrix(terms, width)))
        return candidates.mapInArrow(searcher(sent, k, shard_rows), "query_id bigint, vec_id bigint, score bigint"), sent

    found, sent = part(0)
    if blocks > 1:
        folder = scratch_path(spark, "found")
        for number in range(blocks):
            if number:
                found, sent = part(number)
            found.write.mode("append").parquet(folder)
            sent.destroy()
        found = spark.read.schema(found.schema).parquet(folder)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
