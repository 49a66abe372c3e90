"""Token-id files compressed by a Re-Pair grammar per shard, with random access to documents.

A shard is one binary value:

    magic "RPG1", then seven little-endian uint64: terminals, rules, symbols, documents, ids, step, null documents
    rules       2 x uint32 each    left and right symbol; rule k stands for symbol terminals + k
    lengths     uint32 each        ids that a rule expands to
    symbols     uint32 or uint16 (where terminals + rules <= 65536)
    index       uint64 each        ids before symbols 0, step, 2 * step, ...
    ends        uint64 each        ids up to each document's end
    doc ids     int64 each
    nulls       uint64 each        positions of documents whose id is null
    crc         uint32             of all before it

The container is a Parquet table (part, shard, documents, ids, data), so that Spark can write and read it in
any store; parts and shards are in order of doc_id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, n_parts, small_batches
from .tokens import encoder

MAGIC = b"RPG1"
STEP = 4096


def repair(ids: np.ndarray, terminals: int, least: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, lengths): frequent pairs get nonterminals until no pair of symbols occurs `least` times.

    Occurrences are those that don't overlap another of the same pair.  In each round every place takes the most
    frequent of the pairs there, so that the most frequent pair of all is replaced everywhere, and many others with
    it.  With least = 2 the grammar is complete; rules that occur less often than a few times cost more
    bytes than they save.
    """
    seq = ids.astype(np.uint32)
    rules, lengths, top = [], [], terminals
    size = np.zeros(0, np.int64)
    turn = 0
    # places whose pair may occur often enough: a pair that doesn't never will again, but for those with a new symbol
    open_ = np.ones(len(seq), bool)
    none = np.iinfo(np.int32).max
    best = np.full(len(seq) + 2, none, np.int32)  # the rank of the pair at the place before, within a round
    while len(seq) > 1:
        turn += 1
        n = len(seq)
        spot = np.flatnonzero(open_[:-1])
        if 2 * len(spot) > n:
            key = seq[:-1].astype(np.uint64)
            key <<= np.uint64(32)
            key |= seq[1:]
            key = key if len(spot) == n - 1 else key[spot]
        else:
            key = (seq[spot].astype(np.uint64) << np.uint64(32)) | seq[spot + 1]
        # only pairs in well-filled buckets are counted; another hash each round, as its ties hide a pair
        h = key * np.uint64((0x9E3779B97F4A7C15 * (2 * turn + 1)) & (2**64 - 1))
        wide = min(20, max(8, len(spot).bit_length()))
        bucket = (h >> np.uint64(64 - wide)).astype(np.int64)
        full = np.flatnonzero((np.bincount(bucket, minlength=1 << wide) >= least)[bucket])
        low = np.uint64((1 << max(1, (len(full) - 1).bit_length())) - 1) if len(full) else np.uint64(0)
        order = h[full]
        order &= ~low
        order |= np.arange(len(full), dtype=np.uint64)
        order.sort()
        order &= low
        full = full[order.view(np.int64)]  # by pair, then by place
        at, k = full if len(spot) == n - 1 else spot[full], key[full]
        open_[spot] = False
        twin = np.flatnonzero((k >> np.uint64(32)) == (k & np.uint64(0xFFFFFFFF)))  # only a pair of one symbol can overlap itself
        if len(twin):
            a, x, place = at[twin], k[twin], np.arange(len(twin))
            head = np.concatenate([[True], (x[1:] != x[:-1]) | (a[1:] != a[:-1] + 1)])
            over = twin[(place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 1]  # every second one in a run
            open_[at[over]] = True
            free = np.ones(len(at), bool)
            free[over] = False
            at, k = at[free], k[free]
        head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])[: len(k)])
        count = np.diff(np.append(head, len(k)))
        good = np.flatnonzero(count >= least)
        if not len(good):
            break
        good = good[np.argsort(-count[good], kind="stable")]
        rank = np.full(len(count), len(good), np.int64)
        rank[good] = np.arange(len(good))
        own = np.repeat(rank, count)
        at, own = at[own < len(good)], own[own < len(good)]
        near = best[: n + 2]
        near[at + 1] = own
        if 8 * len(at) > n:  # neighbours are compared in order of place, which memory likes better
            mid = near[1:-1]
            chosen = np.flatnonzero((mid < near[:-2]) & (mid < near[2:]))
            which = mid[chosen]
            near[:] = none
        else:
            won = (own < best[at]) & (own < best[at + 2])
            best[at + 1] = none
            chosen, which = at[won], own[won]
        live = np.flatnonzero(np.bincount(which, minlength=len(good)) >= least)
        number = np.full(len(good), -1, np.int64)
        number[live] = np.arange(len(live))
        new = number[which]
        chosen, new = chosen[new >= 0], new[new >= 0]
        seq[chosen] = top + new
        open_[at] = True
        open_[chosen] = open_[chosen - 1] = True
        keep = np.ones(n, bool)
        keep[chosen + 1] = False
        seq, open_ = seq[keep], open_[keep]
        pair = k[head[good[live]]]
        rule = np.stack([pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        both = np.ones(rule.shape, np.int64)
        both[rule >= terminals] = size[rule[rule >= terminals] - terminals]
        lengths.append(both.sum(1))
        rules.append(rule)
        size = np.concatenate([size, lengths[-1]])
        top += len(live)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), size


def expand(symbols: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    """The ids that symbols stand for."""
    seq = symbols.astype(np.uint32)
    while len(big := np.flatnonzero(seq >= terminals)):
        width = np.ones(len(seq), np.int64)
        width[big] = 2
        start = np.cumsum(width) - width
        out = np.empty(len(seq) + len(big), np.uint32)
        out[start] = seq
        rule = rules[seq[big] - terminals]
        out[start[big]], out[start[big] + 1] = rule[:, 0], rule[:, 1]
        seq = out
    return seq


def expand_all(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, terminals: int) -> np.ndarray:
    """expand() of a whole shard: each rule is expanded once, from earlier ones, and then copied."""
    size = lengths.astype(np.int64)
    if not len(rules) or size.sum() > 4 * len(symbols) + (1 << 20):  # rules that are too long to be held
        return expand(symbols, rules, terminals)
    # what each symbol stands for, one after another: a terminal for itself
    begin = terminals + np.cumsum(size) - size
    flat = np.empty(terminals + int(size.sum()), np.uint32)
    flat[:terminals] = np.arange(terminals)
    starts, ends = begin.tolist(), (begin + size).tolist()
    for i, (left, right) in enumerate(rules.tolist()):
        a, b = starts[i], ends[i]
        if left < terminals:
            flat[a] = left
            a += 1
        else:
            j = left - terminals
            n = ends[j] - starts[j]
            flat[a : a + n] = flat[starts[j] : ends[j]]
            a += n
        if right < terminals:
            flat[a] = right
        else:
            j = right - terminals
            flat[a:b] = flat[starts[j] : ends[j]]
    width = np.concatenate([np.ones(terminals, np.int64), size])[symbols]
    begin = np.concatenate([np.arange(terminals), begin])[symbols]
    ends = np.cumsum(width)
    return flat[np.repeat(begin - ends + width, width) + np.arange(ends[-1] if len(ends) else 0)]


def encode_shard(docs: list[int | None], ids: list[np.ndarray], terminals: int, least: int = 8) -> bytes:
    """One shard's bytes; ids has an array for each document."""
    symbols, rules, lengths = repair(np.concatenate(ids), terminals, least)
    width = np.ones(len(symbols), np.int64)
    width[symbols >= terminals] = lengths[symbols[symbols >= terminals].astype(np.int64) - terminals]
    before = np.cumsum(width) - width
    nulls = [i for i, d in enumerate(docs) if d is None]
    ends = np.cumsum([len(x) for x in ids])
    body = MAGIC + struct.pack("<7Q", terminals, len(rules), len(symbols), len(docs), int(ends[-1]), STEP, len(nulls))
    small = terminals + len(rules) <= 1 << 16
    body += b"".join(a.tobytes() for a in (rules.astype("<u4"), lengths.astype("<u4"), symbols.astype("<u2" if small else "<u4"), before[::STEP].astype("<u8"), ends.astype("<u8"), np.array([d or 0 for d in docs], "<i8"), np.array(nulls, "<u8")))
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A shard's bytes, opened; ids(i) decodes one document alone, all_ids() the whole."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a shard, or a damaged one")
        self.terminals, n_rules, n_symbols, n_docs, self.n_ids, self.step, n_nulls = struct.unpack_from("<7Q", data, 4)
        at = 60

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u4", n_rules)
        self.symbols = take("<u2" if self.terminals + n_rules <= 1 << 16 else "<u4", n_symbols)
        self.index = take("<u8", -(-n_symbols // self.step))
        self.ends = take("<u8", n_docs).astype(np.int64)
        docs = take("<i8", n_docs).tolist()
        for i in take("<u8", n_nulls).tolist():
            docs[i] = None
        self.docs: list[int | None] = docs

    def all_ids(self) -> np.ndarray:
        return expand_all(self.symbols, self.rules, self.lengths, self.terminals)

    def ids(self, i: int) -> np.ndarray:
        """Document i's ids: from the symbol in which it begins to that in which it ends, of which the parts outside are not expanded."""
        start, end = int(self.ends[i - 1]) if i else 0, int(self.ends[i])
        if start == end:
            return np.zeros(0, np.uint32)
        first = (int(np.searchsorted(self.index, start, "right")) - 1) * self.step
        last = int(np.searchsorted(self.index, end, "left")) * self.step
        symbols = self.symbols[first:last].astype(np.int64)
        before = int(self.index[first // self.step]) + np.concatenate([[0], np.cumsum(self._width(symbols))])
        a, b = int(np.searchsorted(before, start, "right")) - 1, int(np.searchsorted(before, end, "left"))
        parts = symbols[a:b].tolist()
        tail = self._head(parts.pop(), end - int(before[b - 1]))
        if parts:
            parts = self._tail(parts[0], start - int(before[a])) + parts[1:] + tail
        else:  # one symbol holds the whole document
            parts, skip = tail, start - int(before[a])
            width = self._width(np.array(parts, np.int64)).tolist()
            while skip >= width[0]:
                skip -= width.pop(0)
                parts.pop(0)
            parts = self._tail(parts[0], skip) + parts[1:]
        return expand(np.array(parts, np.uint32), self.rules, self.terminals)

    def _width(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        big = symbols >= self.terminals
        out[big] = self.lengths[symbols[big] - self.terminals]
        return out

    def _halves(self, symbol: int) -> tuple[int, int, int]:
        left, right = self.rules[symbol - self.terminals].tolist()
        return left, right, 1 if left < self.terminals else int(self.lengths[left - self.terminals])

    def _tail(self, symbol: int, skip: int) -> list[int]:
        """Symbols for what a symbol stands for but the first `skip` ids, by the rules' lengths."""
        out = []
        while skip:
            left, right, n = self._halves(symbol)
            if skip < n:
                out.append(right)
                symbol = left
            else:
                symbol, skip = right, skip - n
        return [symbol, *reversed(out)]

    def _head(self, symbol: int, take: int) -> list[int]:
        """Symbols for the first `take` ids that a symbol stands for."""
        out = []
        while take < (1 if symbol < self.terminals else int(self.lengths[symbol - self.terminals])):
            left, right, n = self._halves(symbol)
            if take <= n:
                symbol = left
            else:
                out.append(left)
                symbol, take = right, take - n
        return [*out, symbol]


def write_token_files(docs: DataFrame, path: str, vocabulary: str, kind: str = "word", end_id: int = 1, shard_ids: int = 1 << 20, least: int = 8, doc_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text (null: empty), end each with end_id, and write shards in ascending doc_id order to path.

    Documents are dealt out by ranges of doc_id and sorted inside each; a task streams, holding one shard of
    about shard_ids ids, of which every pair that occurs `least` times is replaced (2: all that repeat).  Null doc_ids come first; rows with an equal doc_id follow each other in order of
    text; an empty table writes an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, kind)
        terminals = max(enc.whole.get_vocab_size(), end_id + 1)
        part, made = TaskContext.get().partitionId(), 0
        names, ids, held = [], [], 0
        end = np.array([end_id], np.int32)

        def shard() -> pa.RecordBatch:
            nonlocal made, held
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([made], pa.int32()), "documents": pa.array([len(names)], pa.int64()), "ids": pa.array([held], pa.int64()), "data": pa.array([encode_shard(names, ids, terminals, least)], pa.binary())})
            names.clear()
            ids.clear()
            made, held = made + 1, 0
            return out

        for batch in small_batches(batches, "text"):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.concatenate([enc.ids(text), end]) if text else end
                names.append(doc)
                ids.append(got)
                held += len(got)
                if held >= shard_ids:
                    yield shard()
        if names:
            yield shard()

    rows = docs.select(docs[doc_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    rows = rows.repartitionByRange(n_parts(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    map_arrow(rows, run, "part int, shard int, documents long, ids long, data binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of token files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, unless with_ids is False, ids.

    Each shard's start comes from sums by part and then inside the part, so that no task sees all shards.
    """
    table = spark.read.parquet(path)
    parts = table.groupBy("part").agg(F.sum("ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("base"))
    inside = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = table.select("part", "shard", "ids").withColumn("inside", inside).join(parts, "part").select("part", "shard", (F.col("base") + F.col("inside")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = Shard(data)
                ids = s.all_ids().astype("<u4")
                first = np.concatenate([[0], s.ends[:-1]]).astype(np.int64)
                own = [ids[a:b] for a, b in zip(first.tolist(), s.ends.tolist(), strict=True)]
                out = {"part": pa.array([part] * len(own), pa.int32()), "shard": pa.array([shard] * len(own), pa.int32()), "doc_id": pa.array(s.docs, pa.int64()), "first": pa.array(first, pa.int64()), "n_tokens": pa.array(s.ends - first, pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())}
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(own, pa.list_(pa.int32()))} if with_ids else {}))

    # the data is decoded where it is read; only the documents' few numbers meet their shard's start
    decoded = map_arrow(table.select("part", "shard", "data"), run, "part int, shard int, doc_id long, first long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return decoded.join(starts, ["part", "shard"]).select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
