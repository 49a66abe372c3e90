"""Rectangles of an image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgs

Range = tuple[int, int]


def _check(name: str, r: Range | None, most: int | None) -> None:
    if r is not None and (r[0] < 0 or r[1] < r[0] or (most is not None and r[1] > most)):
        raise InvalidArgs(f"{name} {r} is no range within {most}")


def crop(cube: DataFrame, rows: Range | None = None, cols: Range | None = None, lines: int | None = None, pixels: int | None = None) -> DataFrame:
    """The pixels with rows[0] <= line < rows[1] and cols[0] <= sample < cols[1], placed anew from 0.

    An absent range keeps all.  lines and pixels, the image's size where known, are checked against.  The
    comparisons are plain, so that a scan can prune by them.  pixels is needed if cols is absent, as the
    new pixel_id counts by the new width.
    """
    _check("rows", rows, lines)
    _check("cols", cols, pixels)
    if cols is None and pixels is None:
        raise InvalidArgs("without cols the image's pixels must be given")
    r0, c0 = (rows or (0, 0))[0], (cols or (0, 0))[0]
    width = cols[1] - cols[0] if cols else pixels
    out = cube
    if rows:
        out = out.where((F.col("line") >= rows[0]) & (F.col("line") < rows[1]))
    if cols:
        out = out.where((F.col("sample") >= cols[0]) & (F.col("sample") < cols[1]))
    line, sample = F.col("line") - r0, F.col("sample") - c0
    return out.select((line.cast("long") * width + sample).alias("pixel_id"), line.cast("int").alias("line"), sample.cast("int").alias("sample"), "bands")
