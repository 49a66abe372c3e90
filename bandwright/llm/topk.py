"""Exact top-k inner-product search by pivot-table elimination."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, scratch

SCALE = 1024
PIVOTS = 64
SAMPLE = 2048  # rows that pivots are chosen from
BLOCK = 32_768  # candidates whose pivot table a task holds at once
QUERIES = 8192  # queries that are sent to all tasks at once


def vectors(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, floor(SCALE * x) as int64) of the vectors that take part: not null, all components finite.

    Vectors of another length than the first one's raise an error: their inner product has no meaning.
    """
    flat = col.flatten()
    if len(col) and not col.null_count and not flat.null_count and len(set(np.diff(col.offsets.to_numpy()).tolist())) == 1:
        x = flat.to_numpy().astype(np.float64).reshape(len(col), -1)
        at = np.flatnonzero(np.isfinite(x).all(1))
        return at, np.floor(x[at] * SCALE).astype(np.int64)
    kept = [(i, v) for i, v in enumerate(col.to_pylist()) if v is not None and None not in v]
    if not kept:
        return np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
    if len({len(v) for _, v in kept}) > 1:
        raise ValueError("vectors differ in length")
    x = np.array([v for _, v in kept], np.float64)
    good = np.isfinite(x).all(1)
    return np.array([i for i, _ in kept], np.int64)[good], np.floor(x[good] * SCALE).astype(np.int64)


def lifted(x: np.ndarray, most: int) -> np.ndarray:
    """x' = (x, sqrt(most - |x|^2)) of each row."""
    y = x.astype(np.float64)
    return np.column_stack([y, np.sqrt(np.maximum(most - (y * y).sum(1), 0))])


def far_apart(full: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Pivots far from one another: each next one is the row farthest from those chosen."""
    at, near = [0], np.full(len(full), np.inf)
    for _ in range(min(pivots, len(full)) - 1):
        near = np.minimum(near, ((full - full[at[-1]]) ** 2).sum(1))
        at.append(int(near.argmax()))
    return full[at]


class PivotTable:
    """Distances of candidates to pivots, in the space where a larger inner product is a smaller distance.

    With M the largest squared length of a candidate, x' = (x, sqrt(M - |x|^2)) and q' = (q, 0) have
    |q' - x'|^2 = |q|^2 + M - 2 <q, x>.  By the triangle inequality max over pivots p of | |q' - p| - |x' - p| | bounds that
    distance from below, and so the score from above.
    """

    def __init__(self, x: np.ndarray, pivots: np.ndarray | None = None, most: int | None = None):
        self.x = x
        self.most = int((x * x).sum(1).max()) if most is None else most
        self.full = lifted(x, self.most)
        self.pivots = far_apart(self.full) if pivots is None else pivots
        # products of whole numbers below 2**53 are exact in doubles, in any order of summing
        self.exact = self.full[:, :-1]
        square = (self.full * self.full).sum(1)[None, :] + (self.pivots * self.pivots).sum(1)[:, None]
        self.table = np.sqrt(np.maximum(square - 2 * (self.pivots @ self.full.T), 0))

    def upper(self, q: np.ndarray) -> np.ndarray:
        """For each candidate a number that its score doesn't exceed."""
        to = np.sqrt(((np.append(q.astype(np.float64), 0.0) - self.pivots) ** 2).sum(1))
        low = np.abs(self.table - to[:, None]).max(0)
        square = float(q @ q) + self.most
        return (square - low * low) / 2 + 1e-6 * square + 1  # the slack covers rounding

    def top(self, q: np.ndarray, ids: np.ndarray, own: int, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of up to k best candidates but `own`; scores below floor may be left out.

        Candidates are evaluated in order of their bounds, in growing chunks, until the bound of the next
        is below the k-th best score so far: then no other can enter, nor tie.
        """
        bound = self.upper(q)
        best_s, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        left = np.arange(len(ids)) if floor is None else np.flatnonzero(bound >= floor)
        take = 256
        while len(left):
            if len(left) > take:
                split = np.argpartition(-bound[left], take)
                now, left = left[split[:take]], left[split[take:]]
            else:
                now, left = left, left[:0]
            now = now[ids[now] != own]
            s = np.concatenate([best_s, (self.exact[now] @ q).astype(np.int64)])
            i = np.concatenate([best_i, ids[now]])
            order = np.lexsort((i, -s))[:k]
            best_s, best_i = s[order], i[order]
            if len(best_s) == k:
                left = left[bound[left] >= best_s[-1]]
            take *= 2
        return best_s, best_i


def top_k(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each query row the k candidates with the largest integer inner product.

    Components become floor(1024 * x).  Candidates are all rows but those with the query's id; ties go to the
    smaller id; fewer candidates give fewer rows.  Vectors that are null, or hold null or non-finite
    components, and null ids take no part.  A query id that repeats is one query (its smallest vector); repeated
    candidate rows are ranked each.  Empty tables give no rows.

    Vectors of different lengths raise an error, as do components so large that a squared length reaches 2**53.

    PIVOTS pivots are chosen once, from SAMPLE rows with the least hashes of their ids; each task works out its candidates'
    distances to them once a block of candidates.  Queries are taken in blocks of about QUERIES, each sent to all
    tasks and met with every candidate where it is read; a task keeps k rows a query, and those meet in one
    shuffle by query.  With several blocks each one's rows are written to the shared folder before the next is sent, so
    that one block at a time is held.
    """
    spark = table.sparkSession
    rows = table.select(table[id_col].cast("long").alias("id"), table[vector_col].cast("array<double>").alias("v"), is_query.alias("q")).where("id is not null and v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = F.transform("v", lambda x: F.floor(x * SCALE).cast("double"))
    square = F.aggregate(whole, F.lit(0.0), lambda s, x: s + x * x)
    seen = rows.agg(F.max(square).alias("most"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if seen["low"] != seen["high"]:
        raise ValueError("vectors differ in length")
    if (seen["most"] or 0) >= 2**53:
        raise ValueError("components are too large for exact products")
    most = int(seen["most"] or 0)
    some = vectors(rows.select("id", "v").orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks())[1]
    pivots = far_apart(lifted(some, most)) if len(some) else None
    asked = rows.where("q").groupBy("id").agg(F.min("v").alias("v"))
    n = max(1, -(-asked.count() // QUERIES))
    root = scratch(spark, "top") if n > 1 else None
    for b in range(n):
        part = (asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b) if n > 1 else asked).toArrow()
        at, q = vectors(part.column("v").combine_chunks())
        sent = spark.sparkContext.broadcast((part.column("id").to_numpy()[at], q))
        found = _ranked(map_arrow(rows.select("id", "v"), _searcher(sent, pivots, most, k), "query_id long, id long, score long"), k)
        if n == 1:
            return found
        found.write.parquet(f"{root}/block={b}")
        sent.unpersist(blocking=False)
    return spark.read.schema("query_id long, rank int, id long, score long").parquet(f"{root}/*")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _searcher(sent: Broadcast, pivots: np.ndarray | None, most: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(names)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def search() -> None:
            ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            pivot = PivotTable(x, pivots, most)
            for j, (name, (s, i)) in enumerate(zip(names.tolist(), best, strict=True)):
                s2, i2 = pivot.top(q[j], ids, name, k, int(s[-1]) if len(s) == k else None)
                s, i = np.concatenate([s, s2]), np.concatenate([i, i2])
                order = np.lexsort((i, -s))[:k]
                best[j] = s[order], i[order]

        for batch in batches:
            at, x = vectors(batch.column(1))
            if len(at) and len(names):
                held.append((batch.column(0).to_numpy()[at], x))
                if sum(len(h[0]) for h in held) >= BLOCK:
                    search()
        if held:
            search()
        size = [len(s) for s, _ in best]
        if sum(size):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, size)), pa.array(np.concatenate([i for _, i in best])), pa.array(np.concatenate([s for s, _ in best]))], names=["query_id", "id", "score"])

    return run
