"""Flat band-interleaved binary images as a Spark data source: format "bip".

    spark.read.format("bip").option("header", "image.json").load()

Reading plans byte ranges of whole lines; comparisons of `line` with literals cut the ranges that are
read.  write_bip deals pixels out by ranges, which tasks write to their places in one file.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..errors import FileMissing, InvalidArgs, IoFailure
from .header import ImageHeader

SCHEMA = "pixel_id long, line int, sample int, bands array<float>"
SPLIT = 64 << 20
BATCH = 4 << 20


@dataclass
class Lines(InputPartition):
    first: int
    end: int


@dataclass
class Part(WriterCommitMessage):
    first: int
    n: int


def _header(options: dict) -> ImageHeader:
    if "image" in options:
        return ImageHeader(**json.loads(options["image"]))
    if "header" in options:
        return ImageHeader.load(options["header"])
    raise InvalidArgs('format "bip" needs the option header')


class BipReader(DataSourceReader):
    def __init__(self, header: ImageHeader, split: int):
        if header.format != "Bip":
            raise InvalidArgs(f"only Bip images can be scanned by pixel, not {header.format}")
        header.check_file()
        self.header, self.split = header, split
        self.first, self.end = 0, header.all_lines

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == ("line",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(f.value, int):
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    self.end = min(self.end, f.value + (not isinstance(f, LessThan)))
            else:
                yield f

    def partitions(self) -> list[Lines]:
        step = max(1, self.split // (self.header.pixels * self.header.pixel_bytes))
        return [Lines(a, min(a + step, self.end)) for a in range(self.first, self.end, step)]

    def read(self, partition: Lines | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        h = self.header
        at, end = partition.first * h.pixels, min(partition.end * h.pixels, h.n_pixels)
        step = max(1, BATCH // h.pixel_bytes)
        with open(h.path, "rb") as f:
            f.seek(at * h.pixel_bytes)
            while at < end:
                n = min(step, end - at)
                data = np.frombuffer(f.read(n * h.pixel_bytes), "<f4")
                if len(data) != n * h.channels:
                    raise IoFailure(f"{h.path} ended early")
                pixel = np.arange(at, at + n, dtype=np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(data) + 1, h.channels, dtype=np.int32)), pa.array(data))
                yield pa.RecordBatch.from_arrays([pa.array(pixel), pa.array((pixel // h.pixels).astype(np.int32)), pa.array((pixel % h.pixels).astype(np.int32)), bands], names=["pixel_id", "line", "sample", "bands"])
                at += n


class BipWriter(DataSourceArrowWriter):
    """Tasks write their pixels at their places in one new file, all at once; the commit puts it in place of the old one.

    A repeated attempt writes the same bytes to the same places, so an attempt that died does no harm.
    """

    def __init__(self, header: ImageHeader, header_path: str | None):
        self.header, self.header_path = header, header_path
        self.file = f"{header.path}.new-{uuid.uuid4().hex}"
        try:
            with open(self.file, "wb") as f:
                f.truncate(header.size)
        except OSError as e:
            raise IoFailure(str(e)) from e

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        first, n = -1, 0
        with open(self.file, "r+b") as f:
            for b in iterator:
                if not b.num_rows:
                    continue
                pixel = b.column(b.schema.get_field_index("pixel_id")).to_numpy()
                bands = b.column(b.schema.get_field_index("bands"))
                values = bands.flatten()
                if bands.null_count or values.null_count or len(values) != b.num_rows * self.header.channels or (np.diff(bands.offsets.to_numpy()) != self.header.channels).any():
                    raise IoFailure(f"a pixel has not {self.header.channels} values")
                if first < 0:
                    first = int(pixel[0])
                    if not 0 <= first < self.header.n_pixels:
                        raise IoFailure(f"no pixel {first} in an image of {self.header.n_pixels}")
                    f.seek(first * self.header.pixel_bytes)
                if not np.array_equal(pixel, np.arange(first + n, first + n + len(pixel))):
                    raise IoFailure("pixels are not in one gapless order; use write_bip")
                if first + n + b.num_rows > self.header.n_pixels:
                    raise IoFailure(f"more pixels than {self.header.n_pixels}")
                f.write(values.to_numpy().astype("<f4").tobytes())
                n += b.num_rows
            f.flush()
            os.fsync(f.fileno())
        return Part(first, n)

    def commit(self, messages: list[Part | None]) -> None:
        at = 0
        for p in sorted((m for m in messages if m and m.n), key=lambda m: m.first):
            if p.first != at:
                self.abort(messages)
                raise IoFailure(f"pixel {at} is missing or repeated")
            at += p.n
        if at != self.header.n_pixels:
            self.abort(messages)
            raise IoFailure(f"{at} pixels; the header says {self.header.n_pixels}")
        os.replace(self.file, self.header.path)
        if self.header_path:
            self.header.save(self.header_path)

    def abort(self, messages: list[Part | None]) -> None:
        with contextlib.suppress(FileNotFoundError):
            os.remove(self.file)


class BipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BipReader:
        return BipReader(_header(self.options), int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> BipWriter:
        return BipWriter(ImageHeader(**json.loads(self.options["image"])), self.options.get("header"))


def register(spark: SparkSession) -> None:
    """Make format "bip" known to a session, and let its reader be told of filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BipSource)


def read_bip(spark: SparkSession, header: str | ImageHeader, split: int = SPLIT) -> DataFrame:
    """The image of a header (or its file) as a cube: pixel_id, line, sample, bands."""
    register(spark)
    reader = spark.read.format("bip").option("split", split)
    if isinstance(header, ImageHeader):
        header.check_file()
        return reader.option("image", json.dumps(asdict(header))).load()
    return reader.option("header", header).load()


def read_bip_records(spark: SparkSession, header: ImageHeader, path: str | None = None, split: int = SPLIT) -> DataFrame:
    """The same from any store that Spark's file systems reach (path: a URI), by byte ranges of whole lines.

    Each task opens the file through Hadoop's file systems in its own JVM as one record a line (fixed-length records);
    an image whose last line is unfinished is read in records of as many pixels, up to 4 MB, as part it evenly.
    A file of another length than the header says raises a typed error.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path or header.path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        raise FileMissing(path or header.path)
    if (found := store.getFileStatus(at).getLen()) != header.size:
        raise IoFailure(f"{path or header.path} has {found} bytes; {header.channels} x {header.n_pixels} values need {header.size}")
    n, most = header.pixels, max(1, BATCH // header.pixel_bytes)
    if header.rest:
        n = next(k for k in range(min(header.n_pixels, most), 0, -1) if header.n_pixels % k == 0)
    width = n * header.pixel_bytes
    if width >= 1 << 31:
        raise InvalidArgs("a line of 2 GB and more can't be read as one record")
    rows = spark.sparkContext.binaryRecords(path or header.path, width).zipWithIndex()
    raw = rows.map(_record).toDF("at long, data binary")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, data, step = b.column(0).to_numpy(), b.column(1), max(1, most // n)
            for k in range(0, len(at), step):
                values = np.frombuffer(b"".join(data.slice(k, step).to_pylist()), "<f4")
                pixel = (at[k : k + step, None] * n + np.arange(n)).ravel()
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, header.channels, dtype=np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(pixel), pa.array((pixel // header.pixels).astype(np.int32)), pa.array((pixel % header.pixels).astype(np.int32)), bands], names=["pixel_id", "line", "sample", "bands"])

    return raw.mapInArrow(decode, SCHEMA)


def _record(row: tuple[bytes, int]) -> tuple[int, bytearray]:
    return row[1], bytearray(row[0])


def write_bip(cube: DataFrame, header: ImageHeader, header_path: str | None = None, parts: int | None = None) -> None:
    """Write a cube as a Bip file and its header (where a path is given).  Pixels must be 0 to header.n_pixels - 1, each once.

    Values are narrowed to the file's 32-bit floats.  Every task writes its range of pixels straight to its place,
    so the file's folder must be one that all executors and the driver see.
    """
    spark = cube.sparkSession
    register(spark)
    n = parts or max(1, min(header.n_pixels, -(-header.size // SPLIT)))
    # equal ranges of pixels: no sampling is needed
    width = -(-header.n_pixels // n)
    dealt = cube.select("pixel_id", "bands").withColumn("__part", F.expr(f"pixel_id div {width}")).repartitionByRange(n, "__part").sortWithinPartitions("pixel_id").drop("__part")
    out = dealt.write.format("bip").mode("append").option("image", json.dumps(asdict(header)))
    (out.option("header", header_path) if header_path else out).save()
