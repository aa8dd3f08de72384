"""Exact top-k inner products: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors are dealt into blocks by descending length. One eigendecomposition of the matrix of second moments (d x d sums
over all vectors, so its size is the dimension's alone) rotates vectors so that leading components carry most of
their length. The longest vectors, at most ``HEAD`` of them, give every query a first k-th score; a block then gets a
query only if the product of both lengths can reach that score. In a task a group of queries meets a block, again
longest first: partial sums over leading rotated components plus the product of the lengths of what is left bound each
score from above, stage by stage; pairs that stay are scored in exact integers, and each query's k-th score
rises as it goes. Bounds carry a slack far above the rounding of floating point, so only the exact scores decide, ties included.

Queries and candidates meet in a grid of groups of bounded size, each a row of a shuffle for the other side's groups;
no group depends on a vector's value, so equal vectors are no hot key. Up to ``GROUPS`` groups a side have fixed size;
beyond that they grow with the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Scratch
from .vectors import exact, held, matrix, padded, whole_numbers

#: Vectors that give first scores; rows of a block; queries of a group; groups of either side; vectors in a step of a task.
HEAD, BLOCK, ASKED, GROUPS, STEP = 4096, 4096, 1024, 4096, 512
#: Share of the product of both lengths, and more, that bounds allow for rounding.
SLACK = 1e-9

ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def _floor(scores: np.ndarray) -> np.ndarray:
    """k-th scores as floats that no equal score's bound falls below; none where the score is the least of all."""
    low = scores.astype(float)
    return np.where(scores == -(1 << 63), -np.inf, low - SLACK * np.abs(low))


class _Bounds:
    """What tasks share: dimension, rotation, where partial sums stop, and whether 64-bit floats hold every score exactly."""

    def __init__(self, dims: int, k: int, turn: np.ndarray, largest: float):
        self.dims, self.k, self.turn = dims, k, turn
        self.stops = sorted({max(1, dims * i // 4) for i in range(1, 4)} | {dims})
        self.small = dims * largest * largest < 2.0**53

    def rotated(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rotated vectors, and the length of what stands behind each stop (column 0: of the whole)."""
        y = x.astype(float) @ self.turn
        squares = np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1]
        tail = np.column_stack([squares, np.zeros(len(y))])[:, [0, *self.stops]]
        return y, np.sqrt(np.maximum(tail, 0))

    def scores(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Exact scores of rows paired one to one, at the ends of 64 bits where they lie beyond."""
        if self.small:
            return np.einsum("ij,ij->i", q, c)
        return held((exact(q, False) * exact(c, False)).sum(axis=1))

    def best(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Positions of each one's k best pairs, in order."""
        order = np.lexsort((ids, ~scores, who))  # ~ turns the order round and never overflows
        sorted_ = who[order]
        first = np.searchsorted(sorted_, sorted_)
        return order[np.arange(len(order)) - first < self.k]

    def search(self, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, c_ids: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position of the query, id, score) of at least those candidates that are among each query's k best; floor: a known k-th score or -inf."""
        qy, q_tail = self.rotated(q)
        cy, c_tail = self.rotated(c)
        longest = np.argsort(-c_tail[:, 0], kind="stable")
        floor = floor.astype(float).copy()
        who, ids, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for at in range(0, len(c), STEP):
            step = longest[at : at + STEP]
            reach = q_tail[:, 0] * c_tail[step[0], 0]
            rows = np.flatnonzero(reach * (1 + SLACK) + SLACK >= floor)  # vectors still to come are no longer than the first of this step
            if not len(rows):
                break
            left, right = self._open(qy, q_tail, floor, rows, cy, c_tail, step)
            other = q_ids[left] != c_ids[right]
            left, right = left[other], right[other]
            if not len(left):
                continue
            got = self.scores(q[left], c[right])
            sure = got.astype(float) + SLACK * (np.abs(got.astype(float)) + 1) >= floor[left]
            who, ids, scores = np.concatenate([who, left[sure]]), np.concatenate([ids, c_ids[right[sure]]]), np.concatenate([scores, got[sure]])
            keep = self.best(who, ids, scores)
            who, ids, scores = who[keep], ids[keep], scores[keep]
            last = np.flatnonzero(np.arange(len(who)) - np.searchsorted(who, who) == self.k - 1)
            floor[who[last]] = np.maximum(floor[who[last]], _floor(scores[last]))
        return who, ids, scores

    def _open(self, qy, q_tail, floor, rows, cy, c_tail, cols):
        """Pairs whose bound reaches the query's floor at every stop."""
        sums, begin, allow = np.zeros((len(rows), len(cols))), 0, SLACK
        for n, stop in enumerate(self.stops, 1):
            sums += qy[rows, begin:stop] @ cy[cols, begin:stop].T
            whole = q_tail[rows, :1] * c_tail[cols, 0]
            open_ = sums + q_tail[rows, n : n + 1] * c_tail[cols, n] + SLACK * whole + allow >= floor[rows, None]
            begin = stop
            if stop == self.dims:
                break
            some_rows, some_cols = open_.any(axis=1), open_.any(axis=0)
            if not some_rows.any():
                return np.empty(0, np.int64), np.empty(0, np.int64)
            rows, cols, sums = rows[some_rows], cols[some_cols], sums[np.ix_(some_rows, some_cols)]
        left, right = np.nonzero(open_)
        return rows[left], cols[right]


def top_inner_products(vectors: DataFrame, asks: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k greatest inner products with all other rows, ties to the smaller vec_id.

    ``vectors`` needs vec_id and embedding; other columns are ignored, whatever their names. ``asks`` is a condition on
    vec_id that picks the queries. Components become floor(scale * x). Vectors that are null or hold null or components
    that aren't finite take no part, nor do rows with a null vec_id. Shorter vectors count as with zeros behind them, an empty
    one as zeros alone. Rows repeated under one vec_id are candidates each, but none of them of a query with that id; a
    repeated query is asked once, by its smallest vector. A query has fewer rows where there are fewer candidates. Scores
    beyond 64 bits count as the ends of that range. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding"), scale).alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    rows = rows.select("vec_id", "x", asks.alias("asks"), F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("length"))
    rows = scratch.cut(rows, "vectors")
    size = F.size("x")
    about = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("asked"), F.max(size).alias("dims"), F.max(F.greatest(F.abs(F.array_max("x").cast("double")), F.abs(F.array_min("x").cast("double")))).alias("largest")).first()
    schema = "query_id long, vec_id long, score long"
    if not about["asked"] or about["n"] < 2:
        scratch.drop_all()
        return _ranked(spark.createDataFrame([], schema), k)
    dims = max(1, about["dims"])
    bounds = _Bounds(dims, k, _rotation(rows, dims), about["largest"] or 0.0)

    n_blocks = min(GROUPS, max(-(-about["n"] // BLOCK), min(2 * spark.sparkContext.defaultParallelism, -(-about["n"] // STEP))))
    blocks = padded(rows, dims).repartitionByRange(n_blocks, F.desc("length"), "vec_id").withColumn("h", F.spark_partition_id())
    blocks = scratch.cut(blocks, "blocks")
    tops = dict(blocks.groupBy("h").agg(F.max("length")).collect())  # at most one number a block, of which there are GROUPS at most
    reach = np.array([max((v for h, v in tops.items() if h >= i), default=0.0) for i in range(max(tops) + 1)])

    head = blocks.orderBy(F.desc("length"), "vec_id").limit(HEAD).select("vec_id", "x").toArrow()
    head_ids, head_x = head.column("vec_id").to_numpy(), matrix(head.column("x"), dims)

    def first_scores(batches):
        for b in batches:
            ids, x = b.column("vec_id").to_numpy(), matrix(b.column("x"), dims)
            floor, last = np.full(len(ids), -np.inf), []
            for at in range(0, len(ids), ASKED):
                part = slice(at, at + ASKED)
                who, _, scores = bounds.search(ids[part], x[part], floor[part], head_ids, head_x)
                full = np.flatnonzero(np.arange(len(who)) - np.searchsorted(who, who) == k - 1)
                floor[at + who[full]] = _floor(scores[full])
            length = np.sqrt((x.astype(float) ** 2).sum(axis=1))
            for own, low in zip(length, floor, strict=True):
                last.append(int(np.count_nonzero(own * reach * (1 + SLACK) + SLACK >= low)) - 1)  # reach falls, so these are the leading blocks
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(floor), pa.array(last, pa.int32())], ["vec_id", "x", "low", "last"])

    asked = blocks.where("asks").groupBy("vec_id").agg(F.min("x").alias("x"))
    n_groups = min(GROUPS, -(-about["asked"] // ASKED))
    asked = asked.mapInArrow(first_scores, "vec_id long, x array<long>, low double, last int").withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(n_groups)).cast("int"))
    asked = scratch.cut(asked, "asked")
    lasts = dict(asked.groupBy("g").agg(F.max("last")).collect())  # a number a group of queries, GROUPS at most
    needed = F.lit([lasts.get(g, -1) for g in range(n_groups)])
    left = asked.where("last >= 0").select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("h"))
    right = blocks.select("vec_id", "x", "h", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_groups - 1)), lambda g: F.get(needed, g) >= F.col("h"))).alias("g"))

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        got = [np.empty(0, np.int64)] * 3
        if q.num_rows and c.num_rows:
            ids = q.column("vec_id").to_numpy()
            who, found, scores = bounds.search(ids, matrix(q.column("x"), dims), q.column("low").to_numpy(), c.column("vec_id").to_numpy(), matrix(c.column("x"), dims))
            got = [ids[who], found, scores]
        return pa.table([pa.array(v, pa.int64()) for v in got], ["query_id", "vec_id", "score"])

    found = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(meet, schema)
    found = scratch.cut(found, "found")
    scratch.drop("vectors", "blocks", "asked")
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rotation(rows: DataFrame, dims: int) -> np.ndarray:
    """Eigenvectors of the sum of all outer products, by descending share of the lengths."""

    def moments(batches):
        total = np.zeros((dims, dims))
        for b in batches:
            x = matrix(b.column("x"), dims).astype(float)
            total += x.T @ x
        i, j = np.divmod(np.arange(dims * dims), dims)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])

    found = padded(rows, dims).select("x").mapInArrow(moments, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros((dims, dims))
    total[found.column("i").to_numpy(), found.column("j").to_numpy()] = found.column("v").to_numpy()
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1]


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 greatest inner products of every 50th vector with all others."""
    return top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
