"""RGB rasters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgs, IoFailure
from ..plans.cube import channels_of
from .moments import matrix


def rgb_linear(cube: DataFrame, bands: tuple[int, int, int], low: float, high: float) -> DataFrame:
    """(pixel_id, r, g, b): three bands scaled so that low is 0 and high 255, rounded half up and clipped."""
    c = channels_of(cube)
    if not high > low or any(not 0 <= b < c for b in bands):
        raise InvalidArgs("bands or limits out of range")

    def level(i: int) -> Column:
        x = (F.col("bands")[i].cast("double") - low) / (high - low)
        return F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(x * 255.0 + 0.5).cast("double"))).cast("int")

    return cube.select("pixel_id", *(level(i).alias(n) for i, n in zip(bands, "rgb", strict=True)))


def rgb_batched(cube: DataFrame, colormap: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(pixel_id, r, g, b) by a user's function from pixels x bands to pixels x 3 levels of 0 to 255."""
    c = channels_of(cube)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = np.asarray(colormap(matrix(b.column(1), c)))
            if y.shape != (b.num_rows, 3) or y.size and (y.min() < 0 or y.max() > 255):
                raise InvalidArgs(f"the colormap gave shape {y.shape} for {b.num_rows} pixels, or levels beyond 0 to 255")
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(y[:, k].astype(np.int32)) for k in range(3))], names=["pixel_id", "r", "g", "b"])

    return cube.select("pixel_id", "bands").mapInArrow(run, "pixel_id long, r int, g int, b int")


def save_ppm(raster: DataFrame, path: str, lines: int, pixels: int) -> None:
    """Write a raster as a binary PPM, streaming it in order of pixel_id; tasks make the bytes, the driver joins them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pixel = b.column(0).to_numpy()
            if not len(pixel):
                continue
            if (np.diff(pixel) != 1).any():
                raise IoFailure(f"a pixel after {pixel[0]} is missing or repeated")
            data = np.column_stack([b.column(k).to_numpy() for k in (1, 2, 3)]).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_pydict({"first": pa.array([int(pixel[0])]), "n": pa.array([len(pixel)]), "data": pa.array([data], pa.binary())})

    at = 0
    with open(path, "wb") as f:
        f.write(f"P6\n{pixels} {lines}\n255\n".encode())
        for r in raster.select("pixel_id", "r", "g", "b").orderBy("pixel_id").mapInArrow(run, "first long, n long, data binary").toLocalIterator(prefetchPartitions=True):
            if r["first"] != at:
                raise IoFailure(f"pixel {at} is missing or repeated")
            f.write(r["data"])
            at += r["n"]
    if at != lines * pixels:
        raise IoFailure(f"{at} pixels for {lines} x {pixels}")
