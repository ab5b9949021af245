"""Exact nearest-vector search: scores in one scan, the best k by a bounded top-k.

Many queries are broadcast in blocks of about ``BLOCK``, with one scan of the vectors for each. A task holds the best k of each query of
its block; a product of matrices finds who may be among them, and the scores of those are summed anew, alike for equal vectors.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkset.plans.order import POS

METRICS = ("cosine", "l2", "inner_product")
#: Least length that cosine divides by.
FLOOR = 1e-10
#: Queries that are broadcast at once.
BLOCK = 4096
#: Scores, and pairs of vectors, that a task holds at once.
SCORES, PAIRS = 1 << 22, 1 << 16


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _unit(v: Column) -> Column:
    norm = F.greatest(F.sqrt(_dot(v, v)), F.lit(FLOOR))
    return F.transform(v, lambda x: x / norm)


def score(v: Column, query: Sequence[float], metric: str) -> Column:
    """Similarity of a vector column to a query: cosine, inner product, or the negated squared distance."""
    q = F.array(*[F.lit(float(x)) for x in query])
    if metric == "l2":
        return -F.aggregate(F.zip_with(v, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) + F.lit(0.0)
    if metric == "inner_product":
        return _dot(v, q)
    # the query's own length is known here, the vector's needs one more pass over it
    length = max(sum(float(x) ** 2 for x in query) ** 0.5, FLOOR)
    return _dot(v, q) / (F.greatest(F.sqrt(_dot(v, v)), F.lit(FLOOR)) * length)


def top_k(df: DataFrame, column: str, query: Sequence[float], k: int = 10, metric: str = "cosine", tie: str = POS) -> DataFrame:
    """The rows with the k best scores, in a column ``score``; ties go to the smaller ``tie``. Null vectors don't count."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    v = F.col(f"`{column}`").cast("array<double>")
    rows = df.where(F.col(f"`{column}`").isNotNull())
    return rows.withColumn("score", score(v, query, metric)).orderBy(F.desc("score"), F.col(f"`{tie}`")).limit(k)


def _exact(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Scores of the rows of ``q`` with the same rows of ``v``."""
    if metric == "l2":
        return -((v - q) ** 2).sum(axis=1) + 0.0
    dots = (q * v).sum(axis=1)
    if metric == "inner_product":
        return dots
    return dots / (np.maximum(np.sqrt((v * v).sum(axis=1)), FLOOR) * np.maximum(np.sqrt((q * q).sum(axis=1)), FLOOR))


class _Best:
    """The k best rows of each query among those seen: parallel arrays of query, score and tie, sorted."""

    def __init__(self, queries: np.ndarray, k: int, metric: str) -> None:
        self.queries, self.k, self.metric = queries, k, metric
        self.at, self.score, self.tie = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.least = np.full(len(queries), -np.inf)
        self.lengths = np.maximum(np.sqrt((queries * queries).sum(axis=1)), FLOOR)

    def add(self, vectors: np.ndarray, ties: np.ndarray) -> None:
        step = max(1, SCORES // len(self.queries))
        for i in range(0, len(vectors), step):
            self._add(vectors[i : i + step], ties[i : i + step])

    def _add(self, v: np.ndarray, ties: np.ndarray) -> None:
        lengths = np.sqrt((v * v).sum(axis=1))
        near = self.queries @ v.T
        error = 1e-9
        if self.metric == "cosine":
            near /= self.lengths[:, None] * np.maximum(lengths, FLOOR)
        elif self.metric == "l2":
            near = 2 * near - self.lengths[:, None] ** 2 - lengths**2
            error *= 1 + (self.lengths + np.nanmax(lengths, initial=0)) ** 2
        else:
            error *= 1 + self.lengths * np.nanmax(lengths, initial=0)
        near[np.isnan(near)] = -np.inf
        floor = self.least
        if near.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(near, near.shape[1] - self.k, axis=1)[:, near.shape[1] - self.k])
        at, row = np.nonzero((near >= (floor - error)[:, None]) & (near > -np.inf))
        if not len(at):
            return
        score = np.concatenate([_exact(self.queries[at[j : j + PAIRS]], v[row[j : j + PAIRS]], self.metric) for j in range(0, len(at), PAIRS)])
        at, score, tie = np.concatenate((self.at, at)), np.concatenate((self.score, score)), np.concatenate((self.tie, ties[row]))
        order = np.lexsort((tie, -score, at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        kept = place < self.k
        self.at, self.score, self.tie = at[kept], score[order][kept], tie[order][kept]
        full = place[kept] == self.k - 1
        self.least[self.at[full]] = self.score[full]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if len(column) and pa.compute.any(pa.compute.not_equal(pa.compute.list_value_length(column), width)).as_py():
        raise ValueError(f"vectors of other lengths than {width}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def top_k_many(df: DataFrame, column: str, queries: DataFrame, query_id: str, query_column: str, k: int = 10, metric: str = "cosine", tie: str = POS, block: int = BLOCK) -> DataFrame:
    """For each row of ``queries`` the k best rows of ``df``: ``query_id``, ``rank`` (from 1), ``tie`` and ``score``.

    Ties go to the smaller ``tie``, an integer column that names the row. Every row of both is used; null vectors, and ones with
    null elements, don't count. Ids of queries must be unique integers. Vectors of differing lengths raise an error.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    spark = df.sparkSession
    asked = queries.where(F.col(f"`{query_column}`").isNotNull()).select(F.col(f"`{query_id}`").cast("long").alias("query_id"), F.col(f"`{query_column}`").cast("array<double>").alias("vector"))
    rows = df.where(F.col(f"`{column}`").isNotNull()).select(F.col(f"`{tie}`").cast("long").alias("tie"), F.col(f"`{column}`").cast("array<double>").alias("vector"))
    blocks = max(1, -(-asked.count() // block))
    found = []
    for b in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not held.num_rows:
            continue
        lists = held.column("vector").combine_chunks()
        sent = spark.sparkContext.broadcast((held.column("query_id").to_numpy(), _matrix(lists, len(lists[0]))))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, matrix = sent.value
            best = _Best(matrix, k, metric)
            for batch in batches:
                best.add(_matrix(batch.column(1), matrix.shape[1]), batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.at]), pa.array(best.tie), pa.array(best.score)], names=["query_id", "tie", "score"])

        found.append(rows.mapInArrow(run, "query_id long, tie long, score double"))
    if not found:
        found.append(spark.createDataFrame([], "query_id long, tie long, score double"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "tie"))
    out = reduce(DataFrame.unionAll, found).withColumn("rank", place.cast("long")).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("tie").alias(tie), "score")


@dataclasses.dataclass(frozen=True)
class VectorIndex:
    """Positions and vectors (double, of unit length for cosine) of a dataset as it was when the index was built."""

    vectors: DataFrame
    metric: str

    @classmethod
    def build(cls, frame: DataFrame, column: str, metric: str = "cosine") -> VectorIndex:
        if metric not in METRICS:
            raise ValueError(f"unknown metric: {metric}")
        v = F.col(f"`{column}`").cast("array<double>")
        return cls(frame.where(v.isNotNull()).select(POS, (_unit(v) if metric == "cosine" else v).alias("vector")), metric)

    def add(self, frame: DataFrame, column: str) -> VectorIndex:
        """This index and the vectors of more rows, whose positions must not be in it yet."""
        more = VectorIndex.build(frame, column, self.metric)
        return dataclasses.replace(self, vectors=self.vectors.unionByName(more.vectors))

    def search(self, query: Sequence[float], k: int = 10) -> list[tuple[int, float]]:
        """Positions and scores of the k nearest, best first."""
        metric = "inner_product" if self.metric == "cosine" else self.metric
        if self.metric == "cosine":
            norm = max(sum(float(x) ** 2 for x in query) ** 0.5, FLOOR)
            query = [float(x) / norm for x in query]
        return [(r[POS], r["score"]) for r in top_k(self.vectors, "vector", query, k, metric).collect()]

    def search_many(self, queries: DataFrame, query_id: str, column: str, k: int = 10) -> DataFrame:
        """query_id, rank, position and score of the k nearest of each query."""
        return top_k_many(self.vectors, "vector", queries, query_id, column, k, self.metric)

    def save(self, path: str) -> None:
        self.vectors.withMetadata("vector", {"metric": self.metric}).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        df = spark.read.parquet(path)
        return cls(df, json.loads(df.schema["vector"].json())["metadata"]["metric"])
