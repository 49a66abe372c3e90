"""Fuzzy line deduplication: MinHash bands, exact Jaccard, union-find, one line kept of each class."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, Recent, carried, cut, drop, map_arrow, mix64, raw, release, scratch, small_batches, span_hashes
from .components import BitMap, Signed, link_groups, shared_edges

K = 8  # characters of a shingle
BANDS, ROWS = 16, 5  # at Jaccard 0.8 a pair shares a band with probability 0.998, at 0.85 over 0.9998
NUM, DEN = 4, 5
SMALL = 1 << 20  # bytes of text that are worked on at once
CHUNK = 1 << 17  # windows whose minima are taken at once
_A = np.random.default_rng(11).integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_STEP = U64(0x9E3779B97F4A7C15)
_LOWER = LOWER.tobytes()
_BLANKS = re.compile(rb"[ \t\r\f\v]{2,}|[\t\r\f\v]")
_ENDS = re.compile(rb" ?\n ?")


class Lines:
    """The lines of many texts, normalised: A-Z lower-cased, ASCII white space collapsed and trimmed.

    data holds them one after another; line i is data[start[i]:end[i]], of text owner[i], number[i] from 0 there,
    and named by the 64-bit id[i]; full[i] if it is not blank, long[i] if it has K bytes.  A line of fewer has one
    shingle that only its copies have, which bear the same id: it needs no bands.  Null and empty texts have no lines.
    """

    def __init__(self, texts: list[bytes | None]):
        kept = [i for i, t in enumerate(texts) if t]
        data = b"\n".join(texts[i] for i in kept).translate(_LOWER)
        count = np.array([texts[i].count(b"\n") + 1 for i in kept], np.int64)
        if any(x in data for x in (b"  ", b"\t", b"\r", b"\f", b"\v")):
            data = _BLANKS.sub(b" ", data)
        if b" \n" in data or b"\n " in data or data[:1] == b" " or data[-1:] == b" ":
            data = _ENDS.sub(b"\n", data).strip(b" ")
        self.data = np.frombuffer(data, np.uint8)
        edge = np.flatnonzero(self.data == 10)
        self.start = np.concatenate([[0], edge + 1]) if kept else np.zeros(0, np.int64)
        self.end = np.append(edge, len(data)) if kept else np.zeros(0, np.int64)
        self.owner = np.repeat(np.array(kept, np.int64), count)
        self.number = np.arange(len(self.owner)) - np.repeat(np.cumsum(count) - count, count)
        self.id = span_hashes(self.data, self.start, self.end).view(np.int64)
        self.full = self.end > self.start
        self.long = self.end - self.start >= K

    def line(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, begin, size): line at[i] has the K-character windows hashes[begin[i] : begin[i] + size[i]] (shorter: itself)."""
        first = (self.data & 0xC0) != 0x80  # bytes that begin a character
        if first.all():
            chars, start, end = self.data, self.start[at], self.end[at]
        else:
            chars = np.frombuffer(self.data.tobytes().decode().encode("utf-32-le"), np.uint32)
            place = np.concatenate([[0], np.cumsum(first)])
            start, end = place[self.start[at]], place[self.end[at]]
        hashes = _rolled(np.concatenate([chars, np.zeros(K, chars.dtype)]), K) >> U64(32)
        hashes = hashes.astype(np.uint32)
        for i in np.flatnonzero(end - start < K).tolist():
            hashes[start[i]] = np.uint32(int(_rolled(chars[start[i] : end[i]], int(end[i] - start[i]))[0]) >> 32)
        return hashes, start, np.maximum(end - start - K + 1, 1)


def _rolled(chars: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k characters in a row."""
    n = len(chars) - k + 1
    c = chars.astype(np.uint64)
    c += U64(1)
    if k == K and n > 0:  # two, four and then eight in a row: the same sums by fewer passes
        for width in (1, 2, 4):
            both = c[:-width] * U64(pow(int(_STEP), width, 2**64))
            both += c[width:]
            c = both
        return mix64(c)
    total = c[:n].copy()
    for i in range(1, k):
        total *= _STEP
        total += c[i : i + n]
    return mix64(total)


def shingles(line: bytes) -> np.ndarray:
    """Sorted distinct hashes of a normalised line's K-character shingles; of the whole line where it is shorter."""
    chars = np.frombuffer(line, np.uint8) if line.isascii() else np.frombuffer(line.decode().encode("utf-32-le"), np.uint32)
    if not len(chars):
        return np.zeros(0, np.uint64)
    out = np.sort(_rolled(chars, min(K, len(chars))))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def band_keys(hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(lines, BANDS) signed longs: the band hashes of the MinHash signatures of lines given as by Lines.windows()."""
    order = np.argsort(size, kind="stable")
    least = np.empty((BANDS * ROWS, len(size)), np.uint32)
    at = 0
    while at < len(order):
        # lines of about one length, side by side; the shorter ones repeat their last window, which changes no minimum
        low = int(size[order[at]])
        most = low + (low >> 1) + 8
        n = min(int(np.searchsorted(size[order[at:]], most, "right")), max(1, CHUNK // most))
        own = order[at : at + n]
        places = np.minimum(np.arange(int(size[own[-1]]))[:, None], size[own] - 1) + begin[own]
        x = hashes[places]
        turned = np.empty_like(x)
        for row in range(BANDS * ROWS):
            np.multiply(x, _A[row], out=turned)
            least[row, own] = turned.min(0)
        at += n
    out = np.empty((len(size), BANDS), np.uint64)
    for band in range(BANDS):
        total = np.full(len(size), band + 1, np.uint64)
        for row in range(band * ROWS, (band + 1) * ROWS):
            total = mix64(total + least[row])
        out[:, band] = total
    return out.view(np.int64)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text", SMALL):
        x = Lines(raw(batch.column(2)))
        of = pa.array(x.owner)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(x.number), pa.array(x.id, mask=~x.full)], names=["doc_id", "version", "line_no", "node"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Signed:
    recent = Recent()
    for batch in small_batches(batches, "text", SMALL):
        x = Lines(raw(batch.column(0)))
        at = np.flatnonzero(x.long)
        at = at[recent.first(x.id[at])]
        if len(at):
            yield band_keys(*x.windows(at)).ravel(), np.repeat(x.id[at], BANDS)


def _classes(docs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """(doc_id, version, line_no, kept, first_doc_id, first_line_no) of every line; version: a hash of the document's text."""
    spark = docs.sparkSession
    text = docs[text_col]
    d = docs.select(docs[doc_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    # the bands of every distinct line; equal bands meet
    own = d.where("doc_id is not null").select("text")
    edges = cut(shared_edges(own, _bands))
    release(spark)

    def texts(nodes: DataFrame) -> DataFrame:
        wanted = BitMap(nodes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            recent, is_in = Recent(), wanted.test()
            for batch in small_batches(batches, "text", SMALL):
                x = Lines(raw(batch.column(0)))
                at = np.flatnonzero(x.long & is_in(x.id))
                at = at[recent.first(x.id[at])]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(x.id[at]), pa.array([x.line(i) for i in at.tolist()], pa.binary())], names=["node", "payload"])

        out = map_arrow(own, run, "node long, payload binary")
        return out.join(nodes, "node", "left_semi") if wanted.full else out

    root = scratch(spark, "links")
    # a line's set is eight times as large as the line
    linked = cut(link_groups(edges, texts, shingles, NUM, DEN, root, most_bytes=4 << 20).where("node <> component"))
    drop(spark, root)
    occ = cut(map_arrow(d, _occurrences, "doc_id long, version long, line_no long, node long"))
    place = F.struct("doc_id", "line_no", "version")
    # copies are summed where they lie; only classes of more than one line are joined back.  A line that many documents
    # have is a skewed key of that join alone, of which Spark splits such partitions
    by_node = occ.where("doc_id is not null and node is not null").groupBy("node").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    label = by_node.join(linked, "node", "left").withColumn("label", F.coalesce("component", "node"))
    many = label.groupBy("label").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
    many = label.select("node", "label").join(many, "label").select("node", "low")
    out = occ.join(many, "node", "left")
    first = F.when(F.col("doc_id").isNotNull() & F.col("low").isNotNull(), F.col("low")).otherwise(place)
    return out.select("doc_id", "version", "line_no", (first.eqNullSafe(place)).alias("kept"), first["doc_id"].alias("first_doc_id"), first["line_no"].alias("first_line_no"))


def line_classes(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a line: doc_id, line_no (from 0), kept, first_doc_id and first_line_no of its class.

    Lines are classed with those whose K-character shingles have Jaccard >= 0.8, and so on transitively; the
    line with the smallest (doc_id, line_no) of each class is kept.  A line of fewer than K characters is one
    shingle, so it is classed with its copies.  Blank lines are kept and in no class but their own.  Null and empty texts have no
    lines.  A null doc_id's lines are kept and stand outside all classes.  Repeated rows (one doc_id, one text) are one
    document, whose lines come once a row; of rows with one doc_id and different texts each has its own lines, and
    of two lines with one number one is kept.  An empty table gives no rows.
    """
    return _classes(docs, doc_col, text_col).drop("version")


def dedup_lines(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each text's repeated lines taken out; a document of which nothing but blank lines remains goes.

    Columns stay as they are, whatever their names.  Documents that lose no line, and those with a null doc_id or
    text, stay untouched; an empty text stays too.  Rows with one doc_id and different texts lose lines each by its
    own; rows with one doc_id and one text are one document, of which each row loses the same lines.
    """
    lost = _classes(docs, doc_col, text_col).where("not kept").groupBy("doc_id", "version").agg(F.collect_set(F.col("line_no").cast("int")).alias("lost"))
    i, k = docs.columns.index(doc_col), docs.columns.index(text_col)
    text = F.col(f"c{k}")
    rows = carried(docs).withColumn("doc_id", F.col(f"c{i}").cast("long")).withColumn("version", F.xxhash64(text))
    rows = rows.join(lost, ["doc_id", "version"], "left")
    # numbers of the lines left, by a set difference, and then the lines by number: linear in the lines
    lines = F.split(text, "\n", -1)
    rows = rows.withColumn("lines", F.when(F.col("lost").isNotNull(), lines))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")
    rest = F.array_join(F.transform(left, lambda j: F.get("lines", j)), "\n")
    rows = rows.withColumn("rest", F.when(F.col("lost").isNull(), text).otherwise(rest)).where(F.col("lost").isNull() | F.col("rest").rlike(r"[^ \t\n\x0B\f\r]"))
    return rows.select(*("rest" if c == k else f"c{c}" for c in range(len(docs.columns)))).toDF(*docs.columns)
