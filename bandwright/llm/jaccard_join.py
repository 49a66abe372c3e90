"""N-gram Jaccard join by PartEnum signatures, and the classes of linked documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Recent, U64, cut, drop, map_arrow, mix64, raw, release, scratch, small_batches, span_hashes, word_spans
from .components import BitMap, Signed, alone, connected_components, link_groups, shared_edges

_MIX = [U64(x) for x in np.random.default_rng(7).integers(0, 2**63, 64).tolist()]


def shingles(text: bytes | None, n: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-word shingles: A-Z lower-cased, words between ASCII white space.

    A text with fewer words has one shingle, of all its words; without words, or null, none.
    """
    if not text:
        return np.zeros(0, np.uint64)
    data = LOWER[np.frombuffer(text, np.uint8)]
    start, end = word_spans(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    word = span_hashes(data, start, end)
    k = min(n, len(word))
    total = np.zeros(len(word) - k + 1, np.uint64)
    for i in range(k):
        total = mix64(total + word[i : len(word) - k + 1 + i] + U64(i + 1))
    return np.unique(total + U64(k < n) * _MIX[0])


def set_id(s: np.ndarray) -> int:
    """A 64-bit name of a set: equal for equal sets, as a signed long."""
    if not len(s):
        return 0
    x = mix64(np.array([np.add.reduce(mix64(s ^ _MIX[1])) + U64(len(s))], np.uint64))
    return int(x.view(np.int64)[0])


def bands(width: float = 1.4) -> Iterator[tuple[int, int]]:
    """Consecutive size bands [low, high] without end."""
    low = 1
    while True:
        high = max(low, int(low * width))
        yield low, high
        low = high + 1


class PartEnum:
    """Signatures such that two sets with den * |common| >= num * |union| share one.

    Sizes are cut into bands.  A set signs for its own band and for every larger one in which a set could
    still link with it.  In a band whose sets have at most `high` elements, linked sets differ in at
    most k = (den - num) * 2 * high / (den + num) elements.  The domain is cut into n1 parts of n2 cells each, and
    n1 is such that over `spare` parts differ in at most k2 elements: there some n2 - k2 cells are equal.  The
    signatures are the hashes of all subsets of n2 - k2 cells of all parts.  Small sets, of which a shared
    passage is a large share, have subsets of about ten elements (k2 = 2, n2 = 5), large ones fewer signatures
    (k2 = 1, n2 = 3); the smallest have one part and k2 = k.
    Empty subsets would be shared by chance; a part with one counts as bad, and `spare` covers what sets of the
    band have of these but for one in thousands.  A set with at most `spare` bad
    parts leaves out its empty subsets: with a linked set it still has a good part in common.  Any other
    set signs with them too.  Where k is 0, linked sets are equal and need no signature.
    """

    SMALL = 160

    def __init__(self, num: int = 85, den: int = 100):
        if not 0 < num <= den:
            raise ValueError("the similarity must lie above 0 and not above 1")
        self.num, self.den = num, den
        self._bands = []
        self._more = bands()
        self._plans: dict[int, tuple] = {}

    def plan(self, g: int) -> tuple | None:
        """(parts, cells a part, subsets x cells as 0/1, spare) of a band."""
        if g not in self._plans:
            high = self._bands[g][1]
            k = (self.den - self.num) * 2 * high // (self.den + self.num)
            k2, n2 = (k, k + 3) if k <= 2 else (2, 5) if high <= self.SMALL else (1, 3)
            # bad parts by chance in the smallest set that signs for the band: `spare` lies 3 deviations above
            # their mean, or as far as more parts, which are smaller, bring it
            least, base = self.num * self._bands[g][0] // self.den, k // (k2 + 1) + 1
            best = (0.0, base)
            for n1 in range(base + 1, 2 * base + 8) if k > k2 else ():
                bad = n1 * comb(n2, k2) * (1 - (n2 - k2) / (n1 * n2)) ** least
                if (z := min(3.0, (n1 - base - bad) / sqrt(bad + 1e-9))) > best[0]:
                    best = (z, n1)
            n1, spare = best[1], best[1] - base
            subsets = np.array([[c in chosen for c in range(n2)] for chosen in combinations(range(n2), n2 - k2)], np.uint64)
            self._plans[g] = (n1, n2, subsets, spare) if k else None
        return self._plans[g]

    def band(self, m: int) -> int:
        while not self._bands or self._bands[-1][1] < m:
            self._bands.append(next(self._more))
        lo, hi = 0, len(self._bands) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self._bands[mid][1] >= m else (mid + 1, hi)
        return lo

    def _for_band(self, s: np.ndarray, g: int) -> np.ndarray:
        plan = self.plan(g)
        if plan is None:
            return np.zeros(0, np.uint64)
        n1, n2, subsets, spare = plan
        cell = ((s >> U64(32)) * U64(n1 * n2)) >> U64(32)
        edge = np.searchsorted(cell, np.arange(n1 * n2 + 1, dtype=np.uint64))
        total = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(mix64(s ^ _MIX[2]), out=total[1:])
        sums = (total[edge[1:]] - total[edge[:-1]]).reshape(n1, n2)
        sums = sums @ subsets.T if len(subsets) > n2 else sums.sum(1, dtype=np.uint64)[:, None] - sums[:, ::-1]
        empty = np.diff(edge).reshape(n1, n2).astype(np.uint64) @ subsets.T == 0
        names = np.arange(sums.size, dtype=np.uint64).reshape(sums.shape) + (U64(g + 1) << U64(40))
        sign = mix64(sums + mix64(names ^ _MIX[3]))
        return sign.ravel() if empty.any(1).sum() > spare else sign[~empty]

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """All signatures of a sorted set of 64-bit hashes, as signed longs."""
        m = len(s)
        if not m:
            return np.zeros(0, np.int64)
        last = self.band(self.den * m // self.num)
        return np.concatenate([self._for_band(s, g) for g in range(self.band(m), last + 1)]).view(np.int64)


def link_documents(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, doc_col: str = "doc_id", text_col: str = "text", most_bytes: int = 16 << 20, most_rows: int = 4096) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents whose sets of n-word shingles have Jaccard >= num / den are linked.

    component_id is the smallest doc_id that links reach.  Exact, but for sets being told apart by 64-bit hashes.
    A text without words or null: n_shingles 0, linked with nothing.  A null doc_id has a null component and
    links with nothing.  Rows with one doc_id are one document: repeated rows each give a row, and their sets
    share a component.  Empty table: no rows.

    Plan: (1) one scan gives each document the name of its set, so that copies of any number become one node.
    (2) One scan counts, over a fixed share of all shingles, those that no other set has; a set with more of them
    than a link leaves room for links with nothing, as most texts do.
    (3) One scan signs each set left once a task; equal signatures meet in a shuffle of packed signatures.
    (4) Only nodes that share a signature get their text again, each once, and are linked exactly, in
    groups of up to most_bytes and most_rows a task.
    """
    spark = docs.sparkSession
    d = docs.select(docs[doc_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    named = cut(map_arrow(d, _digests(n), "doc_id long, node long, n long"))
    rows = d.where("doc_id is not null").select("text")
    sizes = named.where("n > 0 and doc_id is not null").groupBy("node").agg(F.max("n").alias("n"))
    # a set of n elements of which more than (1 - num / den) * n are in no other set shares less than num / den * n with any
    left = sizes.join(alone(rows, _elements(n, num, den)), "node", "left").where(F.coalesce("alone", F.lit(0)) * den <= (den - num) * F.col("n"))
    left = cut(left.select("node"))
    release(spark)
    may = BitMap(left)

    def sign(batches: Iterator[pa.RecordBatch]) -> Signed:
        enum, recent, is_in = PartEnum(num, den), Recent(), may.test()
        for batch in small_batches(batches, "text"):
            sets = [shingles(t, n) for t in raw(batch.column(0))]
            nodes = np.array([set_id(s) for s in sets], np.int64)
            at = recent.first(nodes)
            for i in at[is_in(nodes[at])].tolist():
                keys = enum.signatures(sets[i])
                yield keys, np.full(len(keys), nodes[i])

    edges = cut(shared_edges(rows, sign))
    release(spark)

    def texts(nodes: DataFrame) -> DataFrame:
        # of each candidate set one document's text is enough
        low = named.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
        wanted = BitMap(low.join(nodes, "node").select(F.xxhash64("doc_id").alias("h")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            recent, is_in = Recent(), wanted.test()
            for batch in small_batches(batches, "text"):
                batch = batch.filter(pa.array(is_in(batch.column(0).to_numpy())))
                found = raw(batch.column(1))
                node = np.array([set_id(shingles(t, n)) for t in found], np.int64)
                at = recent.first(node)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array([found[i] or b"" for i in at.tolist()], pa.binary())], names=["node", "payload"])

        out = map_arrow(d.where("doc_id is not null").select(F.xxhash64("doc_id").alias("h"), "text"), run, "node long, payload binary")
        return out.join(nodes, "node", "left_semi") if wanted.full else out

    root = scratch(spark, "links")
    linked = cut(link_groups(edges, texts, lambda t: shingles(t, n), num, den, root, most_bytes, most_rows).where("node <> component"))
    drop(spark, root)
    return _components(named, linked)


def _digests(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sets = [shingles(t, n) for t in raw(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "node", "n"])

    return run


def _elements(n: int, num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Signed]:
    """The shingles of each set that count for alone(): those of a share of all hashes, twice what a link leaves to differ.

    Elements of that share alone prove that a set links with nothing; the others need not be counted.
    """
    share = min(2**64 - 1, 2 * (den - num) * 2**64 // den) if num < den else 2**61

    def run(batches: Iterator[pa.RecordBatch]) -> Signed:
        recent = Recent()
        for batch in small_batches(batches, "text"):
            sets = [shingles(t, n) for t in raw(batch.column(0))]
            nodes = np.array([set_id(s) for s in sets], np.int64)
            for i in recent.first(nodes).tolist():
                keys = mix64(sets[i][: np.searchsorted(sets[i], U64(share), "right")])
                yield keys.view(np.int64), np.full(len(keys), nodes[i])

    return run


def _components(named: DataFrame, linked: DataFrame) -> DataFrame:
    """Components of documents from their nodes and the nodes that link to another.

    Groups of copies of any size are summed before they are shuffled; only those that link are joined back.
    """
    own = named.where("n > 0 and doc_id is not null")
    label = own.groupBy("node").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    # one doc_id with several sets makes them one document
    label = label.join(linked, "node", "left").withColumn("label", F.coalesce("component", "node"))
    twice = own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    if not twice.isEmpty():
        pairs = own.join(twice.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b"))
        pairs = pairs.union(linked.select(F.col("node").alias("a"), F.col("component").alias("b")))
        label = label.drop("component", "label").join(connected_components(pairs), "node", "left").withColumn("label", F.coalesce("component", "node"))
    reach = label.groupBy("label").agg(F.min("low").alias("component_id"), F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h")
    many = label.join(reach, "label").select("node", "component_id")
    # a set that many documents have is a skewed key of this join alone, of which Spark splits such partitions
    out = named.join(many, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
