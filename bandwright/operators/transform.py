"""Maps over pixels: standardising, linear transforms, and a user's function of batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgs
from ..functions.arithmetic import doubles, ieee_div
from ..plans.cube import channels_of
from .moments import matrix

WIDE = 4096  # products a pixel up to which a linear transform is a Catalyst expression


def _standardised(channels: int, means: Sequence[float] | None, std_devs: Sequence[float] | None) -> Column:
    z = F.transform("bands", lambda x: x.cast("double"))
    for name, v in (("means", means), ("std_devs", std_devs)):
        if v is not None and len(v) != channels:
            raise InvalidArgs(f"{len(v)} {name} for {channels} bands")
    if means is not None:
        z = F.zip_with(z, doubles(means), lambda x, m: x - m)
    if std_devs is not None:
        z = F.zip_with(z, doubles(std_devs), ieee_div)
    return z


def standardize(cube: DataFrame, means: Sequence[float] | None = None, std_devs: Sequence[float] | None = None) -> DataFrame:
    """cube with bands (x - mean) / std_dev in double precision; each step only where its statistics are given."""
    return cube.withColumn("bands", _standardised(channels_of(cube), means, std_devs))


def linear_transform(cube: DataFrame, weights: Sequence[Sequence[float]], means: Sequence[float] | None = None, std_devs: Sequence[float] | None = None) -> DataFrame:
    """cube with bands W z, z being the standardised pixel and W a k x channels matrix: k bands come out."""
    w = np.asarray(weights, np.float64)
    c = channels_of(cube)
    if w.ndim != 2 or w.shape[1] != c:
        raise InvalidArgs(f"a transform of shape {w.shape} for {c} bands")
    z = _standardised(c, means, std_devs)
    if w.size <= WIDE:
        out = cube.withColumn("__z", z)
        rows = F.array(*(doubles(r.tolist()) for r in w))
        return out.withColumn("bands", F.transform(rows, lambda r: F.aggregate(F.zip_with(r, F.col("__z"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))).drop("__z")
    return map_batches(cube.withColumn("bands", z), lambda x: x @ w.T)


def map_batches(cube: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """cube with bands f(batch), f taking and giving matrices of pixels x bands; Arrow batches, no shuffle."""
    c = channels_of(cube)
    names = [n for n in cube.columns if n != "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = np.asarray(f(matrix(b.column(b.num_columns - 1), c)), np.float64)
            if y.ndim != 2 or len(y) != b.num_rows:
                raise InvalidArgs(f"the function gave shape {y.shape} for {b.num_rows} pixels")
            offsets = np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(y.ravel()))], names=[*names, "bands"])

    kinds = dict(cube.dtypes)
    return cube.select(*names, "bands").mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", bands array<double>")
