"""Exact top-k search by inner product: an impact-ordered index, processed score at a time.

A block of vectors is indexed by posting segments: a dimension's values, less their least, are written in
digits of BITS bits, and each (dimension, digit) is a segment that holds every row's quantised value. A
query meets the segments by descending impact (its weight times the digit's place and greatest value), and
each adds its part to all rows' scores. What the segments still to come can add or take away bounds every
row from both sides; the query stops when few enough rows can still belong to the answer, or when nothing
is left, and those rows are rescored exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.llm.common import stored

#: Bits of a digit, that is, quantisation levels of a segment: 2**BITS.
BITS = 3
#: Rows of an index block and of a query block.
BLOCK = 4096
QUERY_BLOCK = 2048
#: A query's bounds are looked at after every so many segments; it stops with at most LEFT rows possible.
EVERY, LEFT = 16, 48
_LEAST = -(1 << 63)


class ImpactIndex:
    """Posting segments of a block of integer vectors (rows x dimensions)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.greatest = max(abs(int(vectors.min())), abs(int(vectors.max())))
        if self.greatest >= 1 << 61:
            return  # only whole numbers of any size will do
        self.vectors = vectors = vectors.astype(np.int64)
        self.low = vectors.min(axis=0)
        above = vectors - self.low
        places = range(0, max(1, int(above.max()).bit_length()), BITS)
        digits = [(above >> place) & ((1 << BITS) - 1) for place in places]
        self.segments = np.concatenate(digits, axis=1).T.astype(np.int32)  # a row a segment
        self.dim = np.tile(np.arange(vectors.shape[1]), len(digits))
        self.place = np.repeat([1 << place for place in places], vectors.shape[1])
        self.most = self.segments.max(axis=1)

    def search(self, query: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k rows of greatest inner product, ties to the smaller id."""
        usable = np.ones(len(self.ids), bool) if own is None else self.ids != own
        size = int(usable.sum())
        if self.greatest * sum(abs(int(x)) for x in query) >= 1 << 62:
            # sums may not fit 64 bits: whole numbers of any size, cut to 64 bits in the end
            rows = np.flatnonzero(usable)
            exact = self.vectors[rows].astype(object) @ query.astype(object)
            exact = np.array([min(max(int(x), _LEAST), -_LEAST - 1) for x in exact], np.int64)
            best = sorted(range(len(rows)), key=lambda r: (-int(exact[r]), int(self.ids[rows[r]])))[:k]
            return self.ids[rows][best], exact[best]
        query = query.astype(np.int64)
        if size > k:
            weight = query[self.dim] * self.place
            impact = np.abs(weight) * self.most
            order = np.argsort(-impact, kind="stable")[: int((impact > 0).sum())]
            open_ = int(impact.sum())  # greatest less least sum of what is still to come
            score = np.zeros(len(self.ids), np.int32 if open_ < 1 << 30 else np.int64)
            part = np.empty_like(score)
            for step, s in enumerate(order.tolist(), 1):
                np.multiply(self.segments[s], score.dtype.type(weight[s]), out=part)
                score += part
                open_ -= int(impact[s])
                if step % EVERY == 0 or step == len(order):
                    bound = int(np.partition(score[usable], size - k)[size - k]) - open_
                    possible = usable & (score >= bound)
                    if int(possible.sum()) <= LEFT:
                        break
            if len(order):
                usable = possible
        rows = np.flatnonzero(usable)
        exact = self.vectors[rows] @ query
        best = np.lexsort((self.ids[rows], -exact))[:k]
        return self.ids[rows][best], exact[best]


def finite(embedding: Column) -> Column:
    """The components as doubles; null if the vector or a component is null or not finite."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), x)


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) of every component: 64-bit integers where all fit with room for sums, else whole numbers of any size."""
    if not x.size or np.abs(x).max() < 2.0**53:
        return np.floor(x * 256).astype(np.int64)
    return np.array([[math.floor(v * 256) if abs(v) < 2.0**1000 else int(v) * 256 for v in row] for row in x.tolist()], object)


def search(self, query: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k rows of greatest inner product, ties to the smaller id."""
        usable = np.ones(len(self.ids), bool) if own is None else self.ids != own
        size = int(usable.sum())
        if self.greatest * sum(abs(int(x)) for x in query) >= 1 << 62:
            # sums may not fit 64 bits: whole numbers of any size, cut to 64 bits in the end
            rows = np.flatnonzero(usable)
            exact = self.vectors[rows].astype(object) @ query.astype(object)
            exact = np.array([min(max(int(x), _LEAST), -_LEAST - 1) for x in exact], np.int64)
            best = sorted(range(len(rows)), key=lambda r: (-int(exact[r]), int(self.ids[rows[r]])))[:k]
            return self.ids[rows][best], exact[best]
        query = query.astype(np.int64)
        if size > k:
            weight = query[self.dim] * self.place
            impact = np.abs(weight) * self.most
            order = np.argsort(-impact, kind="stable")[: int((impact > 0).sum())]
            open_ = int(impact.sum())  # greatest less least sum of what is still to come
            score = np.zeros(len(self.ids), np.int32 if open_ < 1 << 30 else np.int64)
            part = np.empty_like(score)
            for step, s in enumerate(order.tolist(), 1):
                np.multiply(self.segments[s], score.dtype.type(weight[s]), out=part)
                score += part
                open_ -= int(impact[s])
                if step % EVERY == 0 or step == len(order):
                    bound = int(np.partition(score[usable], size - k)[size - k]) - open_
                    possible = usable & (score >= bound)
                    if int(possible.sum()) <= LEFT:
                        break
            if len(order):
                usable = possible
        rows = np.flatnonzero(usable)
        exact = self.vectors[rows] @ query
        best = np.lexsort((self.ids[rows], -exact))[:k]
        return self.ids[rows][best], exact[best]


def whole(embedding: Column) -> Column:
    """floor(256 * x) of every component, as integers; null if the vector or a component is null, not finite or beyond 64 bits."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= 2.0**55))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * 256).cast("long")))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows of vectors, by exact integer inner product.

    vectors: vec_id, v (array<double>, finite); queries: query_id, v. A component x counts as floor(256 * x). A row with the query's own id is no candidate, nor
    is one of another length than the query's: lengths are searched apart. Queries are a stated set; they meet the vectors block by block: every index block
    with every query block, in tasks of bounded size. Repeated vector rows are candidates of their own;
    repeated queries (same id and vector) count once. Ties go to the smaller vec_id; scores beyond 64 bits
    are the nearest number of 64 bits, and tie.
    """
    n, q = vectors.count(), queries.count()
    parts, sets = max(1, -(-n // BLOCK)), max(1, -(-q // QUERY_BLOCK))
    left = vectors.select("vec_id", "v", F.size("v").alias("length"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("set"))
    right = queries.distinct().select("query_id", "v", F.size("v").alias("length"), F.pmod(F.xxhash64("query_id"), F.lit(sets)).cast("int").alias("set"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def run(_: tuple, block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(block) and len(asked):
            index = ImpactIndex(block["vec_id"].to_numpy(np.int64), scaled(np.stack(block["v"].to_list())))
            for name, v in zip(asked["query_id"].tolist(), scaled(np.stack(asked["v"].to_list())), strict=True):
                ids, scores = index.search(v, k, name)
                out += [(name, int(i), int(s)) for i, s in zip(ids, scores, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("part", "set", "length").cogroup(right.groupBy("part", "set", "length")).applyInPandas(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_neighbours(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k best rows for each row whose vec_id is divisible by `every`, against all rows.

    Rows with a null id, a null or empty vector, or a null or non-finite component take no part. Candidates have
    the query's length. Fewer than k candidates: all of them.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), finite(F.col("embedding")).alias("v")).where("vec_id is not null and size(v) > 0")
    rows = stored(rows, "vectors")
    return search(rows, rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v"), k)


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
