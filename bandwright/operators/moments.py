"""One-pass moments of wide images: Arrow batches, BLAS per partition, a small sum over partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgs
from ..plans.cube import channels_of


def matrix(col: pa.Array, channels: int) -> np.ndarray:
    """A column of arrays as rows of doubles; raises where one has not `channels` values."""
    flat = col.flatten()
    if col.null_count or flat.null_count or len(flat) != len(col) * channels or (np.diff(col.offsets.to_numpy()) != channels).any():
        raise InvalidArgs(f"a pixel has not {channels} values")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, channels)


@dataclass
class Moments:
    """n pixels, the sum and the Gram matrix of (x - shift)."""

    n: int
    total: np.ndarray
    gram: np.ndarray
    shift: np.ndarray

    @property
    def means(self) -> np.ndarray:
        return self.shift + self.total / self.n

    def about(self, center: np.ndarray) -> np.ndarray:
        """The mean of (x - center)(x - center)'."""
        d = self.shift - center
        m = self.total / self.n
        return self.gram / self.n + np.outer(m, d) + np.outer(d, m) + np.outer(d, d)

    @property
    def covariance(self) -> np.ndarray:
        m = self.total / self.n
        return self.gram / self.n - np.outer(m, m)


def moments(cube: DataFrame, shift: np.ndarray | None = None) -> Moments:
    """Moments of a cube about a shift (default: its first pixel, so that large means cost no digits).

    Each partition folds its batches into one Gram matrix; the rows of those are summed by index over the cluster,
    and only channels * (channels + 2) numbers come to the driver.
    """
    c = channels_of(cube)
    if shift is None:
        shift = np.asarray(cube.select("bands").first()["bands"], np.float64)
        shift = np.where(np.isfinite(shift), shift, 0.0)
    if len(shift) != c:
        raise InvalidArgs(f"{len(shift)} shifts for {c} bands")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gram = 0, np.zeros(c), np.zeros((c, c))
        for b in batches:
            x = matrix(b.column(0), c) - shift
            n += len(x)
            total += x.sum(0)
            gram += x.T @ x
        if n:
            rows = np.column_stack([np.full(c, float(n)), total, gram])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(c, dtype=np.int32)), pa.array(list(rows), pa.list_(pa.float64()))], names=["i", "row"])

    def add(table: pa.Table) -> pa.Table:
        x = np.stack(table.column("row").to_numpy())
        return pa.table({"i": table.column("i").slice(0, 1), "row": pa.array([x.sum(0)], pa.list_(pa.float64()))})

    parts = cube.select("bands").mapInArrow(fold, "i int, row array<double>")
    found = parts.groupBy("i").applyInArrow(add, "i int, row array<double>").orderBy("i").toArrow()
    x = np.stack(found.column("row").to_numpy())
    return Moments(int(x[0, 0]), x[:, 1], x[:, 2:], np.asarray(shift, np.float64))


def fold_batched(cube: DataFrame, zero: Callable[[], object], step: Callable[[np.ndarray, object], object], merge: Callable[[object, object], object], pack: Callable[[object], bytes], unpack: Callable[[bytes], object], width: int = 16):
    """A user's fold over batches of pixels (rows x bands), with a merge, in any order.

    step(batch, state) -> state runs by partition; states meet first in `width` groups, then on the driver, so the
    driver gets at most `width` of them.  pack and unpack make them bytes and back.  No pixels: zero().
    """
    c = channels_of(cube)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, seen = zero(), False
        for b in batches:
            if b.num_rows:
                state, seen = step(matrix(b.column(0), c), state), True
        if seen:
            yield pa.RecordBatch.from_pydict({"state": pa.array([pack(state)], pa.binary())})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            for x in b.column(0).to_pylist():
                state = unpack(x) if state is None else merge(state, unpack(x))
        if state is not None:
            yield pa.RecordBatch.from_pydict({"state": pa.array([pack(state)], pa.binary())})

    parts = cube.select("bands").mapInArrow(run, "state binary").repartition(width, F.xxhash64("state"))
    out = None
    for r in parts.mapInArrow(join, "state binary").collect():
        x = unpack(bytes(r["state"]))
        out = x if out is None else merge(out, x)
    return zero() if out is None else out
