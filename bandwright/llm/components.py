"""Distributed union-find, and exact linking inside groups of candidates.

Both work on DataFrames alone: neither edges nor members of a group come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Recent, cut, drop, map_arrow, mix64, n_parts, release


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a long, b long); component is its smallest reachable node.

    Alternates large-star and small-star steps, which keep the edges' number and end after about the
    logarithm of the longest path's length.  Each round is cut by a checkpoint.  Self-loops and repeated
    edges do no harm; a null end drops the edge; no edges give no rows.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e)
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", F.col("a")).alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = cut(small.where("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def local_links(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """The component (smallest position) of each set, linking those with den * |common| >= num * |union|.

    Exact: sets are taken by size; a link needs a common element among the first ones of each set in
    order of rarity (prefix filter), and each such pair not yet joined is counted in full.
    """
    n = len(sets)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    if n < 2:
        return np.zeros(n, np.int64)
    size = [len(s) for s in sets]
    # only elements that several sets have get a number: of all others no more than a sorted copy is ever held
    every = np.concatenate(sets)
    every.sort()
    same = np.zeros(len(every) + 1, bool)
    same[1:-1] = every[1:] == every[:-1]
    head = np.flatnonzero(same[1:] & ~same[:-1])
    count = np.flatnonzero(same[:-1] & ~same[1:]) - head + 1
    shared = every[head]
    del every, same, head
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    ranks = []
    for s in sets:
        at = np.searchsorted(shared, s)
        at[at == len(shared)] = 0
        ranks.append(np.sort(rank[at[shared[at] == s]]) if len(shared) else rank)
    mark = np.zeros(len(count), bool)
    seen: dict[int, list[int]] = {}
    for i in np.argsort(size, kind="stable").tolist():
        m = size[i]
        if not m:
            continue
        # at least this many elements are shared with any linked set, so one of the first m - least + 1 is; the rarest are its own
        least = -(-num * m // den)
        near: dict[int, None] = {}
        for e in ranks[i][: max(0, len(ranks[i]) - least + 1)].tolist():
            near.update(dict.fromkeys(seen.get(e, ())))
            seen.setdefault(e, []).append(i)
        mark[ranks[i]] = True
        a = find(i)
        for j in near:
            b = find(j)
            if a == b or den * size[j] < num * m:
                continue
            common = int(np.count_nonzero(mark[ranks[j]]))
            if den * common >= num * (m + size[j] - common):
                root[max(a, b)] = a = min(a, b)
        mark[ranks[i]] = False
    return np.array([find(i) for i in range(n)], np.int64)


def group_links(group: np.ndarray, sets: list[np.ndarray], num: int, den: int, small: int = 48) -> np.ndarray:
    """local_links() in each run of equal numbers in `group`; positions are over all sets.

    Groups of up to `small` sets are taken together, in rounds: in each group the next set that has not been
    compared yet is compared with all such sets outside its component, so that copies of one another take one
    round and no pair is counted twice.
    """
    n = len(sets)
    root = np.arange(n)
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    count = np.diff(np.append(head, n))
    for a, k in zip(head[count > small].tolist(), count[count > small].tolist(), strict=True):
        root[a : a + k] = a + local_links(sets[a : a + k], num, den)
    of = np.repeat(np.arange(len(head)), count)
    left = np.flatnonzero((count[of] > 1) & (count[of] <= small))  # sets that are still to be compared with others
    if not len(left):
        return root
    size = np.array([len(s) for s in sets], np.int64)
    first = np.zeros(n, np.int64)
    first[left] = np.cumsum(size[left]) - size[left]
    names = np.repeat(mix64(of[left].astype(np.uint64) + np.uint64(1)), size[left])
    _, code = np.unique(np.concatenate([sets[i] for i in left.tolist()]) ^ names, return_inverse=True)
    mark = np.zeros(int(code.max()) + 1 if len(code) else 0, np.int32)

    def elements(at: np.ndarray) -> np.ndarray:
        k = size[at]
        return code[np.arange(k.sum()) + np.repeat(first[at] - (np.cumsum(k) - k), k)]

    turn = 0
    while len(left):
        turn += 1
        begin = np.flatnonzero(np.concatenate([[True], of[left][1:] != of[left][:-1]]))
        run = np.diff(np.append(begin, len(left)))
        r = root[left]
        # a group goes on while two of its sets left lie in different components
        keep = np.repeat(np.minimum.reduceat(r, begin) != np.maximum.reduceat(r, begin), run)
        pivot = np.repeat(left[begin], run)[keep]
        left = left[keep]
        if not len(left):
            break
        pivots = np.unique(pivot)
        mark[elements(pivots)] = turn
        big, less = np.maximum(size[left], size[pivot]), np.minimum(size[left], size[pivot])
        at = np.flatnonzero((root[left] != root[pivot]) & (den * less >= num * big) & (less > 0))
        if len(at):
            hit = mark[elements(left[at])] == turn
            k = size[left[at]]
            common = np.add.reduceat(hit, np.cumsum(k) - k, dtype=np.int64)
            at = at[den * common >= num * (size[left[at]] + size[pivot[at]] - common)]
        if len(at):
            # all components that the pivot meets become one, of the smallest position
            met = np.zeros(n, bool)
            met[root[left[at]]] = met[root[pivot[at]]] = True
            member = np.flatnonzero(met[root])
            low = np.full(len(head), n)
            np.minimum.at(low, of[member], root[member])
            root[member] = low[of[member]]
        left = left[left != pivot]
    return root


FLUSH = 1 << 20  # signatures that a task packs at once
ROUND = 1 << 22  # signatures that a task compares at once

Signed = Iterator[tuple[np.ndarray, np.ndarray]]  # keys and the nodes that have them, those of one node together


def _places(spark: SparkSession, parts: int) -> np.ndarray:
    """For each of `parts` partitions a number that Spark's partitioning by hash puts there."""
    place = spark.range(32 * parts).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p"), F.col("id").cast("int").alias("v"))
    at = np.zeros(parts, np.int32)
    for r in place.groupBy("p").agg(F.min("v").alias("v")).collect():
        at[r["p"]] = r["v"]
    return at


def shared_edges(rows: DataFrame, sign: Callable[[Iterator[pa.RecordBatch]], Signed]) -> DataFrame:
    """(a, b): each node that shares a key with others, with the smallest of them; mostly without repeats.

    sign: from batches of rows to keys (64-bit hashes) and nodes.  Keys that meet in a task are joined there and go on
    once, so that a key of very many nodes comes to its place once a task at most.  What is shuffled are packed
    blocks, one for each target and some million signatures: nodes once a run, and 40 bits of each key (keys
    that agree in these by chance give a candidate more, never less).
    """
    parts = n_parts(rows.sparkSession)
    at = _places(rows.sparkSession, parts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for got in sign(batches):
            held.append(got)
            n += len(got[0])
            if n >= FLUSH:
                yield _packed(held, at)
                held, n = [], 0
        if n:
            yield _packed(held, at)

    return map_arrow(map_arrow(rows, pack, "v int, edges boolean, data binary").repartition(parts, "v"), _shared, "a long, b long")


def _packed(held: list[tuple[np.ndarray, np.ndarray]], place: np.ndarray) -> pa.RecordBatch:
    """Blocks (v, edges, data) of signatures for each partition, and of the edges between nodes whose keys met here."""
    key, node = (np.concatenate(x) for x in zip(*held, strict=True))
    key = key.view(np.uint64)
    low = np.uint64((1 << max(1, (len(key) - 1).bit_length())) - 1)
    order = (np.sort((key & ~low) | np.arange(len(key), dtype=np.uint64)) & low).astype(np.int64)
    k = key[order]
    same = np.flatnonzero(k[1:] == k[:-1])
    keep = np.ones(len(key), bool)
    values, edge, blocks = [], [], []
    if len(same):
        # of each run of equal keys the first place goes on, for the node there; the others are joined to it
        head = np.ones(len(key), bool)
        head[same + 1] = False
        first = order[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
        other = order[~head]
        keep[other] = False
        a, b = node[other], node[first[~head]]
        real = np.flatnonzero(a != b)
        _, once = np.unique(mix64(a[real].view(np.uint64) ^ mix64(b[real].view(np.uint64))), return_index=True)
        real = real[once]
        if len(real):
            values.append(place[int(key[0] % np.uint64(len(place)))])
            edge.append(True)
            blocks.append(np.stack([a[real], b[real]]).astype("<i8").tobytes())
        key, node = key[keep], node[keep]
    for v, data in _runs(key, node, place):
        values.append(v)
        edge.append(False)
        blocks.append(data)
    return pa.RecordBatch.from_arrays([pa.array(values, pa.int32()), pa.array(edge, pa.bool_()), pa.array(blocks, pa.binary())], names=["v", "edges", "data"])


def _runs(key: np.ndarray, node: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(v, data) of a block for each partition: its nodes once a run, and the keys."""
    part = (((key >> np.uint64(32)) * np.uint64(len(place))) >> np.uint64(32)).astype(np.int16 if len(place) < 1 << 15 else np.int32)
    order = np.argsort(part, kind="stable")
    key, node, part = key[order], node[order], part[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
        run = np.flatnonzero(np.concatenate([[True], node[a + 1 : b] != node[a : b - 1]]))
        sizes = np.diff(np.append(run, b - a))
        yield place[part[a]], b"".join(x.tobytes() for x in (np.array([b - a, len(run)], "<u4"), node[a:b][run].astype("<i8"), sizes.astype("<u4"), (key[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4"), ((key[a:b] >> np.uint64(32)) & np.uint64(255)).astype(np.uint8)))


def _unpacked(data: bytes, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, nodes) of a block whose keys' upper 8 bits lie from low to high - 1."""
    n, runs = np.frombuffer(data, "<u4", 2).tolist()
    node = np.frombuffer(data, "<i8", runs, 8)
    size = np.frombuffer(data, "<u4", runs, 8 + 8 * runs)
    lower = np.frombuffer(data, "<u4", n, 8 + 12 * runs)
    upper = np.frombuffer(data, np.uint8, n, 8 + 12 * runs + 4 * n)
    key, node = (upper.astype(np.uint64) << np.uint64(32)) | lower, np.repeat(node, size)
    if high - low == 256:
        return key, node
    at = np.flatnonzero((upper >= low) & (upper < high))
    return key[at], node[at]


def _by_key(blocks: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, nodes) of blocks in order of the keys, equal ones together."""
    # blocks stay packed; where there are many, keys are compared in rounds by their upper bits
    step = max(1, 256 * ROUND // max(1, sum(int.from_bytes(x[:4], "little") for x in blocks)))
    for low in range(0, 256, step) if blocks else ():
        key, node = (np.concatenate(x) for x in zip(*(_unpacked(x, low, min(256, low + step)) for x in blocks), strict=True))
        bits = max(1, (len(key) - 1).bit_length())
        if bits <= 24:
            order = np.sort((key << np.uint64(bits)) | np.arange(len(key), dtype=np.uint64))
            order = (order & np.uint64((1 << bits) - 1)).astype(np.int64)
        else:
            order = np.argsort(key)
        yield key[order], node[order]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    recent = Recent()

    def edges(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = recent.first(mix64(a.view(np.uint64) ^ mix64(b.view(np.uint64))).view(np.int64))
        for k in range(0, len(at), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(x[at[k : k + (1 << 17)]]) for x in (a, b)], names=["a", "b"])

    blocks: list[bytes] = []
    for batch in batches:
        for edge, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if edge:
                yield from edges(*np.frombuffer(data, "<i8").reshape(2, -1))
            else:
                blocks.append(data)
    for key, node in _by_key(blocks):
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        both = same.copy()
        both[:-1] |= same[1:]
        node, head = node[both], np.flatnonzero(~same[both])
        if len(node):
            least = np.repeat(np.minimum.reduceat(node, head), np.diff(np.append(head, len(node))))
            off = node != least
            yield from edges(node[off], least[off])


def alone(rows: DataFrame, elements: Callable[[Iterator[pa.RecordBatch]], Signed]) -> DataFrame:
    """(node, alone): how many of a node's elements no other node has; nodes without any such may be missing.

    elements: as `sign` of shared_edges(); a node may come in several tasks.  Of an element that several nodes of a
    task have, two go on, which is enough to tell that it isn't alone: a common one has two entries a task.
    Elements that agree in 40 bits and their partition count as one, so that counts may be too low, never too high.
    Few partitions get the elements, since each costs a node's name; sums go back packed.
    """
    spark = rows.sparkSession
    parts = n_parts(spark)
    some = max(min(parts, 16), parts // 4)
    to, back = _places(spark, some), _places(spark, parts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for got in elements(batches):
            held.append(got)
            n += len(got[0])
            if n >= FLUSH:
                yield _boxed(_runs(*_two_each(held), to))
                held, n = [], 0
        if n:
            yield _boxed(_runs(*_two_each(held), to))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for key, of in _by_key([x for b in batches for x in b.column(1).to_pylist()]):
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            least = np.minimum.reduceat(of, head)
            own, k = np.unique(least[least == np.maximum.reduceat(of, head)], return_counts=True)
            node, n = _summed(np.concatenate([node, own]), np.concatenate([n, k]))
        part = (((node.view(np.uint64) >> np.uint64(32)) * np.uint64(len(back))) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
        for at in np.split(order, cuts[1:]) if len(order) else ():
            yield _boxed([(back[part[at[0]]], node[at].astype("<i8").tobytes() + n[at].astype("<u4").tobytes())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[bytes] = []
        for b in batches:
            held += b.column(1).to_pylist()
            if sum(map(len, held)) >= 12 * FLUSH:
                node, n = _added(node, n, held)
                held = []
        node, n = _added(node, n, held)
        if len(node):
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n)], names=["node", "alone"])

    sent = map_arrow(rows, pack, "v int, data binary").repartition(some, "v")
    return map_arrow(map_arrow(sent, count, "v int, data binary").repartition(parts, "v"), add, "node long, alone long")


def _boxed(blocks: Iterable[tuple[int, bytes]]) -> pa.RecordBatch:
    v, data = zip(*blocks, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int32()), pa.array(data, pa.binary())], names=["v", "data"])


def _two_each(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and nodes, of each key one node and another one that has it."""
    key, node = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(key, kind="stable")
    k, of = key[order], node[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    run = np.cumsum(new) - 1
    other = np.flatnonzero(of != of[new][run])
    _, first = np.unique(run[other], return_index=True)
    new[other[first]] = True
    at = np.sort(order[new])
    return key[at].view(np.uint64), node[at]


def _summed(node: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    node, at = np.unique(node, return_inverse=True)
    return node, np.bincount(at, n, len(node)).astype(np.int64)


def _added(node: np.ndarray, n: np.ndarray, blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    k = [len(x) // 12 for x in blocks]
    node = np.concatenate([node, *(np.frombuffer(x, "<i8", m) for x, m in zip(blocks, k, strict=True))])
    return _summed(node, np.concatenate([n, *(np.frombuffer(x, "<u4", m, 8 * m) for x, m in zip(blocks, k, strict=True))]))


class BitMap:
    """A map of hashed names (signed longs) that goes to the tasks: 16 bits a name, but at most 8 MB whatever the input.

    It lets through all names that are in it and few others; full: so many names that it lets through too many others.
    """

    def __init__(self, names: DataFrame, most_bits: int = 26):
        n = names.count()
        self.bits = min(max(16, (16 * n).bit_length()), most_bits)
        self.full = 8 * n > 1 << self.bits
        name = names.columns[0]
        words = names.select(F.shiftrightunsigned(name, 64 - self.bits).alias("b")).groupBy(F.shiftright("b", 6).alias("w"))
        got = words.agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("x")).toArrow()
        table = np.zeros(1 << (self.bits - 6), np.int64)
        table[got.column("w").to_numpy()] = got.column("x").to_numpy()
        self.sent = names.sparkSession.sparkContext.broadcast(table.tobytes())

    def test(self) -> Callable[[np.ndarray], np.ndarray]:
        """In a task: the function that tells which names are let through."""
        return partial(_is_in, np.frombuffer(self.sent.value, np.uint8), np.uint64(64 - self.bits))

    def __getstate__(self):
        return {"bits": self.bits, "sent": self.sent, "full": self.full}


def _is_in(table: np.ndarray, shift: np.uint64, names: np.ndarray) -> np.ndarray:
    at = (names.view(np.uint64) >> shift).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def rare_edges(items: DataFrame, shingles: Callable[[bytes], np.ndarray], num: int, den: int, bits: int = 24) -> DataFrame:
    """shared_edges() of (node, component, payload) by the rarest elements of each set, within its component.

    In any common order of elements, linked sets share one among the first m - ceil(num * m / den) + 1 of
    each.  The order here is by counts in 2**bits hash buckets, then by hash: passages that many sets share
    come last, and an element whose bucket one set alone has is in no other set and needs no signature.  The
    counts stop at 255 and are one byte each: a table of 16 MB goes to the tasks, whatever the input.
    """
    sent = items.sparkSession.sparkContext.broadcast(_counts(items, shingles, bits))

    def rarest(batches: Iterator[pa.RecordBatch]) -> Signed:
        for b in batches:
            for node, comp, p in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                s = shingles(p)
                m = len(s)
                n = sent.value[(s >> np.uint64(64 - bits)).astype(np.int64)]
                first = np.argsort((n.astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8)), kind="stable")[: m - -(-num * m // den) + 1]
                first = first[n[first] > 1]
                if len(first):
                    yield mix64(s[first] ^ np.uint64(comp & (2**64 - 1))), np.full(len(first), node, np.int64)

    return shared_edges(items.select("node", "component", "payload"), rarest)


def _counts(items: DataFrame, shingles: Callable[[bytes], np.ndarray], bits: int) -> np.ndarray:
    """How many sets have an element of each hash bucket, at most 255; each task's table is added up by blocks of it."""
    block = 1 << max(0, bits - 6)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << bits, np.uint8)
        for b in batches:
            for p in b.column(0).to_pylist():
                at = (shingles(p) >> np.uint64(64 - bits)).astype(np.int64)
                n[at] = np.minimum(n[at], 254) + 1
        yield from _blocks({k: x for k, x in enumerate(n.reshape(-1, block)) if x.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(pa.decompress(data, block, "zstd"), np.uint8).astype(np.uint16)
                of[k] = np.minimum(of.get(k, 0) + x, 255)
        yield from _blocks(of)

    got = map_arrow(map_arrow(items.select("payload"), count, "k int, data binary").repartition(n_parts(items.sparkSession), "k"), add, "k int, data binary")
    table = np.zeros((1 << bits) // block * block, np.uint8).reshape(-1, block)
    for r in got.collect():
        table[r["k"]] = np.frombuffer(pa.decompress(bytes(r["data"]), block, "zstd"), np.uint8)
    return table.ravel()


def _blocks(of: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, x in of.items():
        data = pa.compress(x.astype(np.uint8).tobytes(), "zstd", asbytes=True)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], names=["k", "data"])


def link_groups(edges: DataFrame, items: Callable[[DataFrame], DataFrame], shingles: Callable[[bytes], np.ndarray], num: int, den: int, root: str, most_bytes: int = 16 << 20, most_rows: int = 4096) -> DataFrame:
    """(node, component) for the nodes that link, exactly, among those that edges join, and so on transitively.

    edges: (a, b), candidates from shared_edges().  items: from a DataFrame of nodes to (node, payload binary), in which
    a node may repeat and others may come.  Union-find over the edges forms loose components; a loose
    component's payloads meet once in one task, which links them in full.  Loose components of over most_bytes or
    most_rows are split first: by their rarest elements, one of which linked sets share as well, again and again
    while that takes away at least half.  What is then still over them is dealt out in blocks of which each pair
    meets in one task.
    Payloads are written to tables under the path root, which can be deleted once the result is.
    """
    spark = edges.sparkSession
    loose = cut(connected_components(edges))
    path = f"{root}/items"
    items(loose.select("node")).write.parquet(path)
    found = spark.read.parquet(path)
    linked, heavy = _link_small(found, loose, shingles, num, den, most_bytes, most_rows)
    before, left = None, heavy.count()
    # counts of fewer sets tell more elements apart: what is still large is split again while that leaves half of it or less
    while left and (before is None or 2 * left <= before):
        large = f"{root}/large-{left}"
        found.join(heavy.select("node", "component"), "node").dropDuplicates(["node"]).write.parquet(large)
        drop(spark, path)
        path = large
        found = spark.read.parquet(path)
        loose = cut(connected_components(rare_edges(found, shingles, num, den)))
        release(spark)
        found = found.drop("component")
        split, heavy = _link_small(found, loose, shingles, num, den, most_bytes, most_rows)
        linked = linked.union(split)
        before, left = left, heavy.count()
    if not left:
        return linked
    return linked.union(_link_blocks(found, heavy, shingles, num, den, most_bytes, most_rows))


def _linked(rows: DataFrame, parts: int, shingles: Callable[[bytes], np.ndarray], num: int, den: int) -> DataFrame:
    """(node, component) from rows (g, node, payload): links inside each g, whose distinct nodes a task holds at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
        sets: list[np.ndarray] = []

        def link(n: int) -> pa.RecordBatch:
            root = group_links(group[:n], sets[:n], num, den)
            return pa.RecordBatch.from_arrays([pa.array(node[:n]), pa.array(node[root])], names=["node", "component"])

        for b in batches:
            g, x = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(g):
                continue
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
            if len(group):
                new[0] = (g[0] != group[-1]) | (x[0] != node[-1])
            at = np.flatnonzero(new)
            payload = b.column(2)
            sets += [shingles(payload[i].as_py()) for i in at.tolist()]
            group, node = np.concatenate([group, g[at]]), np.concatenate([node, x[at]])
            if group[0] != group[-1]:
                whole = int(np.flatnonzero(group != group[-1])[-1]) + 1
                yield link(whole)
                group, node, sets = group[whole:], node[whole:], sets[whole:]
        if len(group):
            yield link(len(group))

    return map_arrow(rows.select("g", "node", "payload").repartition(parts, "g").sortWithinPartitions("g", "node"), run, "node long, component long")


def _link_small(found: DataFrame, loose: DataFrame, shingles: Callable[[bytes], np.ndarray], num: int, den: int, most_bytes: int, most_rows: int) -> tuple[DataFrame, DataFrame]:
    """Links inside loose components up to the limits, and (node, component) of the nodes of larger ones."""
    size = found.groupBy("node").agg(F.max(F.octet_length("payload")).alias("w"))
    loose = cut(loose.join(size, "node"))
    total = loose.groupBy("component").agg(F.sum("w").alias("bytes"), F.count("*").alias("rows"))
    over = cut(total.where((F.col("bytes") > most_bytes) | (F.col("rows") > most_rows)).select("component"))
    heavy = loose.join(over, "component", "left_semi").select("node", "component")
    light = loose.join(over, "component", "left_anti").select("node", F.col("component").alias("g"))
    linked = cut(_linked(found.join(light, "node"), n_parts(found.sparkSession), shingles, num, den).where("node <> component"))
    heavy = cut(heavy)
    release(found.sparkSession)
    return linked, heavy


def _link_blocks(found: DataFrame, heavy: DataFrame, shingles: Callable[[bytes], np.ndarray], num: int, den: int, most_bytes: int, most_rows: int) -> DataFrame:
    """(node, component) of the nodes in `heavy` (node, component) that link inside their component.

    A component is cut by size of set into bands, of which linked sets lie in the same or in neighbouring
    ones, and a band by hash into blocks of half the limits.  Any two blocks that can link meet in one task.
    """
    width = math.log(den / num * 1.0001)

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.array([max(1, len(shingles(p))) for p in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((np.log(m) / width).astype(np.int32))], names=["node", "component", "payload", "band"])

    rows = map_arrow(found.join(heavy, "node").select("node", "component", "payload"), banded, "node long, component long, payload binary, band int")
    half = F.greatest(F.ceil(F.sum(F.octet_length("payload")) / max(1, most_bytes // 2)), F.ceil(F.count("*") / max(1, most_rows // 2)), F.lit(1)).cast("int")
    blocks = rows.groupBy("component", "band").agg(half.alias("n"))
    blocks = blocks.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("band", "n"))).alias("of"))
    rows = rows.join(cut(blocks), "component")
    own = F.pmod(F.xxhash64("node"), F.try_element_at("of", F.col("band"))).cast("int")

    def pairs(up: int) -> Column:
        """The pairs with the blocks of the band `up` above."""
        n = F.coalesce(F.try_element_at("of", F.col("band") + up), F.lit(0))
        other = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda j: j < n)
        if not up:
            return F.transform(other, lambda j: F.struct(F.col("band").alias("b"), F.lit(0).alias("d"), F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
        i, j = (F.col("own"), None) if up > 0 else (None, F.col("own"))
        return F.transform(other, lambda k: F.struct((F.col("band") + min(up, 0)).alias("b"), F.lit(1).alias("d"), (k if i is None else i).alias("i"), (k if j is None else j).alias("j")))

    rows = rows.withColumn("own", own).select("node", "payload", "component", F.explode(F.concat(pairs(0), pairs(1), pairs(-1))).alias("p"))
    rows = rows.select(F.xxhash64("component", "p").alias("g"), "node", "payload")
    links = _linked(rows, n_parts(found.sparkSession), shingles, num, den).where("node <> component")
    return connected_components(links.select(F.col("node").alias("a"), F.col("component").alias("b")))
