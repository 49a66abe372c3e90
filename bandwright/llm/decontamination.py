"""Benchmark decontamination by one Aho-Corasick automaton over normalised item windows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import add_columns, carried, kept, map_arrow, raw, scratch, shown, small_batches

#: A word, as a pattern: characters other than ASCII ones that are no letter or digit.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A-Z become a-z; digits, letters and all bytes of non-ASCII characters stay; every other byte is a blank.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Words of a text: runs of characters other than ASCII ones that are no letter or digit, A-Z lower-cased."""
    return text.translate(_NORMAL).split()


def windows(item: list[str], n: int) -> list[str]:
    """The windows of n of an item's words, as symbols (one, of all, where there are fewer; none without words)."""
    return ["".join(item[i : i + n]) for i in range(max(1, len(item) - n + 1))] if item else []


class Matcher:
    """Finds windows in texts with one scan.  items: the texts of benchmark items by id.

    The automaton reads two symbols a word, the number of the word among those of the items, so that its size
    depends on the words and not on their letters; words that no item has are a symbol of their own.
    """

    NONE = "\0\0"

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.vocabulary: dict[bytes, str] = {}
        found: dict[str, set[str]] = {}
        for name, text in items:
            own = [self._symbols(w) for w in words(text)]
            for w in windows(own, n):
                found.setdefault(w, set()).add(name)
        self.automaton = ahocorasick.Automaton()
        for w, names in found.items():
            self.automaton.add_word(w, (len(w) // 2, tuple(names)))
        self.any = bool(found)
        if found:
            self.automaton.make_automaton()

    def _symbols(self, word: bytes) -> str:
        k = len(self.vocabulary)
        # first symbols from U+0200 on, second ones below: matches begin and end with words
        return self.vocabulary.setdefault(word, chr(0x200 + (k >> 8)) + chr(0x100 + (k & 255)))

    def scan(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans [first, end) of hit words, and the items whose windows occur."""
        if not self.any or not own:
            return [], set()
        spans, names = [], set()
        for end, (k, which) in self.automaton.iter("".join(map(self.vocabulary.get, own, repeat(self.NONE)))):
            names.update(which)
            spans.append(((end + 1) // 2 - k, (end + 1) // 2))
        return merged(spans), names


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def matcher(items: list[tuple[str, bytes]], n: int, name: int) -> Matcher:
    """The worker's automaton of a block of items, kept between tasks; one at a time."""
    return kept(("matcher", name, n), lambda: Matcher(items, n))


def original_offsets(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the text of spans of words."""
    data = np.frombuffer(b" " + text.translate(_NORMAL) + b" ", np.uint8) != 32
    edge = np.flatnonzero(data[1:] != data[:-1])
    return [(len(text[: edge[2 * a]].decode()), len(text[: edge[2 * b - 1]].decode())) for a, b in spans]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, most_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's items in blocks of about most_words words, of which the driver holds one.

    The number of blocks comes from the table's words; items go to blocks by a hash, so a block's size is near
    its share.  Items without an id or words take no part.
    """
    b = benchmark.select(benchmark[id_col].cast("string").alias("i"), benchmark[text_col].alias("t")).where("i is not null and t is not null")
    total = b.agg(F.sum(F.regexp_count("t", F.lit(WORD)))).first()[0] or 0
    n = max(1, -(-total // most_words))
    for k in range(n):
        part = b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else b
        yield [(r.i, r.t.encode()) for r in part.toLocalIterator()]


ADDED = ["n_words", "n_hit", "n_items", "items", "contaminated"]
_SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
_MADE = [StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("n_items", LongType()), StructField("items", ArrayType(StringType())), StructField("contaminated", BooleanType())]


def _columns(texts: list[bytes | None], own: list[list[bytes]], found: list[tuple[list[tuple[int, int]], set[str]]], with_spans: bool) -> list[pa.Array]:
    hit = [sum(b - a for a, b in s) for s, _ in found]
    out = [pa.array([len(w) for w in own], pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for _, x in found], pa.int64()), pa.array([sorted(x) for _, x in found], pa.list_(pa.string())), pa.array([x > 0 for x in hit], pa.bool_())]
    if with_spans:
        at = [original_offsets(t, s) if s else [] for t, (s, _) in zip(texts, found, strict=True)]
        out.append(pa.array([[{"start": a, "end": b} for a, b in s] for s in at], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", with_spans: bool = True, keep: list[str] | None = None, most_words: int = 150_000) -> DataFrame:
    """decontaminate()'s rows with docs' columns as c0, c1, ..., whatever their names."""
    spark = docs.sparkSession
    blocks = item_blocks(benchmark, item_col, item_text_col, most_words)
    first, second = next(blocks), next(blocks, None)
    made = _MADE + [StructField("spans", _SPANS)] * with_spans
    name = uuid.uuid4().int

    def one(batches: Iterator[list[bytes | None]]) -> Iterator[list[pa.Array]]:
        m = matcher(sent.value, n, name)
        for texts in batches:
            own = [words(t) if t else [] for t in texts]
            yield _columns(texts, own, [m.scan(w) for w in own], with_spans)

    if second is None:
        sent = spark.sparkContext.broadcast(first)
        return add_columns(docs, text_col, one, made, keep)
    # one pass for each block writes the few texts that it hits; a text is named by two hashes and its length
    root = scratch(spark, "hits")
    d = docs.select(docs[text_col].alias("text")).where("text is not null")
    key = [F.xxhash64("text").alias("h1"), F.crc32(F.col("text").cast("binary")).alias("h2"), F.octet_length("text").alias("h3")]
    for k, block in enumerate(chain([first, second], blocks)):
        sent = spark.sparkContext.broadcast(block)
        _hits(d.select(*key, "text"), sent, n, uuid.uuid4().int).write.parquet(f"{root}/block={k}")
        sent.unpersist(blocking=False)
    hits = spark.read.schema("h1 long, h2 long, h3 int, found array<struct<start:int,end:int>>, names array<string>").parquet(f"{root}/*")
    hits = hits.groupBy("h1", "h2", "h3").agg(F.flatten(F.collect_set("found")).alias("found"), F.array_distinct(F.flatten(F.collect_set("names"))).alias("names"))
    at = docs.columns.index(text_col)
    rows = carried(docs).withColumns({"h1": F.xxhash64(f"c{at}"), "h2": F.crc32(F.col(f"c{at}").cast("binary")), "h3": F.octet_length(f"c{at}")})
    rows = rows.join(hits, ["h1", "h2", "h3"], "left").select(*(f"c{i}" for i in range(len(docs.columns))), "found", "names")
    kept = [f for i, f in enumerate(rows.schema.fields[:-2]) if keep is None or docs.columns[i] in keep]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, f"c{at}"):
            texts = raw(batch.column(at))
            found = [(merged([(x["start"], x["end"]) for x in s or []]), set(i or [])) for s, i in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            out = _columns(texts, [words(t) if t else [] for t in texts], found, with_spans)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *out], names=[f.name for f in [*kept, *made]])

    return map_arrow(rows, finish, StructType([*kept, *made]))


def _hits(texts: DataFrame, sent: Broadcast, n: int, name: int) -> DataFrame:
    """(h1, h2, h3, found, names) of the texts in which a window of a block of items occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(sent.value, n, name)
        for batch in small_batches(batches, "text"):
            found = [m.scan(words(t)) for t in raw(batch.column(3))]
            at = [i for i, (s, _) in enumerate(found) if s]
            if at:
                spans = pa.array([[{"start": a, "end": b} for a, b in found[i][0]] for i in at], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                names = pa.array([sorted(found[i][1]) for i in at], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at)) for k in range(3)), spans, names], names=["h1", "h2", "h3", "found", "names"])

    return map_arrow(texts, run, "h1 long, h2 long, h3 int, found array<struct<start:int,end:int>>, names array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", with_spans: bool = True, keep: list[str] | None = None, most_words: int = 150_000) -> DataFrame:
    """docs' columns (or those in keep) with what each text has of the benchmark's windows of n words.

    Adds n_words, n_hit (words inside any occurrence), n_items, items (sorted as strings), contaminated, and
    with_spans: spans, an array of (start, end) character offsets into the text as it is.  A null or empty
    text has no words; an empty benchmark hits nothing; repeated rows give repeated rows, an empty table none.
    Columns with the names of added ones are replaced, all others stay, whatever their names.
    A benchmark of up to most_words is one automaton (about 1 KB a word for n = 10), made once a worker, and documents are
    scanned where they are read, without a shuffle.  A larger one goes in blocks of that size, each
    one pass that writes its hits; these few rows then meet the documents by a hash of the text.
    """
    out = scan(docs, benchmark, n, text_col, item_col, item_text_col, with_spans, keep, most_words)
    return shown(out, docs.columns, ADDED + ["spans"] * with_spans, keep)


def items_sha256(items: str = "items") -> Column:
    """Lower-case hex SHA-256 of the sorted item ids, comma-joined, as a column."""
    return F.sha2(F.concat_ws(",", F.array_sort(items)), 256)
