"""Cubes: DataFrames of pixels (pixel_id, line, sample, bands), and other layouts of the same image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgs

BLOCK = 65_536  # pixels of a band that one row of the band-sequential layout holds


def cube_of(table: DataFrame, id_col: str, bands_col: str, pixels: int) -> DataFrame:
    """A table with one array of bands a row as an image of `pixels` samples a line."""
    if pixels < 1:
        raise InvalidArgs("pixels must be at least 1")
    at = F.col(id_col).cast("long")
    return table.select(at.alias("pixel_id"), F.expr(f"cast({id_col} div {pixels} as int)").alias("line"), (at % pixels).cast("int").alias("sample"), F.col(bands_col).alias("bands"))


def cube_of_columns(table: DataFrame, columns: list[str]) -> DataFrame:
    """An image without places, one band a column: for statistics, that need no order."""
    return table.select(F.array(*(F.col(c) for c in columns)).alias("bands"))


def channels_of(cube: DataFrame) -> int:
    """The number of bands, the same in every pixel; a pixel with another number or a null raises."""
    first = cube.select(F.size("bands").alias("n")).first()
    if first is None:
        raise InvalidArgs("an image without pixels")
    return first["n"]


def checked(cube: DataFrame, channels: int) -> DataFrame:
    """cube whose scan raises at a pixel that has not `channels` values, none null."""
    bad = F.col("bands").isNull() | (F.size("bands") != channels) | F.exists("bands", lambda x: x.isNull())
    return cube.withColumn("bands", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit(f"a pixel has not {channels} values"))).otherwise(F.col("bands")))


def to_long(cube: DataFrame) -> DataFrame:
    """(pixel_id, band, value)."""
    return cube.select("pixel_id", F.posexplode("bands").alias("band", "value")).select("pixel_id", F.col("band").cast("long").alias("band"), F.col("value").cast("double").alias("value"))


def to_bsq(cube: DataFrame, block: int = BLOCK) -> DataFrame:
    """(band, block, values): the band-sequential layout, `block` pixels in order of pixel_id a row.

    Whole pixels are dealt out by block, so that as many rows move as the image has pixels; a task transposes one
    block at a time.  The block bounds what a row and a task hold, whatever the image's size.
    """
    kind = cube.schema["bands"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _blocks(batches):
            bands = pa.concat_arrays([r.column(2) for r in rows])
            width = len(bands[0]) if len(bands) else 0
            flat = bands.flatten()
            if bands.null_count or len(flat) != width * len(bands) or (np.diff(bands.offsets.to_numpy()) != width).any():
                raise ValueError(f"a pixel has not {width} values")
            # an order of positions keeps nulls and the type as they are
            at = np.arange(len(flat)).reshape(-1, width).T.ravel() if width else np.zeros(0, np.int64)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(bands), dtype=np.int32)), flat.take(pa.array(at))) if width else pa.array([], bands.type)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int64)), pa.array(np.full(width, b, np.int64)), values], names=["band", "block", "values"])

    rows = cube.select(F.expr(f"pixel_id div {block}").alias("block"), "pixel_id", "bands")
    return rows.repartition("block").sortWithinPartitions("block", "pixel_id").mapInArrow(run, f"band long, block long, values array<{kind.simpleString()}>")


def from_bsq(bsq: DataFrame, pixels: int, block: int = BLOCK) -> DataFrame:
    """The cube of a band-sequential image; a task transposes one block at a time."""
    kind = bsq.schema["values"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _blocks(batches):
            values = pa.concat_arrays([r.column(2) for r in rows])
            n, width = len(values[0]), len(values)
            flat = values.flatten()
            if len(flat) != n * width:
                raise ValueError(f"the bands of block {b} differ in length")
            at = np.arange(len(flat)).reshape(width, n).T.ravel()
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), flat.take(pa.array(at)))
            yield pa.RecordBatch.from_arrays([pa.array(b * block + np.arange(n, dtype=np.int64)), bands], names=["pixel_id", "bands"])

    rows = bsq.select("block", "band", "values").repartition("block").sortWithinPartitions("block", "band")
    return cube_of(rows.mapInArrow(run, f"pixel_id long, bands array<{kind.simpleString()}>"), "pixel_id", "bands", pixels)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(block, its rows) from rows sorted by block, their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(block)], strict=True):
            if held and held[0].column(0)[0].as_py() != int(block[a]):
                yield held[0].column(0)[0].as_py(), held
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column(0)[0].as_py(), held
