"""Band means, population standard deviations, and covariance in its four modes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgs
from ..functions.arithmetic import ieee_div
from ..plans.cube import channels_of, checked
from .moments import moments

NARROW = 128  # bands up to which means and deviations are Catalyst aggregates
NARROW_PAIRS = 16  # bands up to which covariances are


def _band(i: int) -> Column:
    return F.col("bands")[i].cast("double")


def _vector(values: Sequence[float] | None, channels: int, what: str) -> np.ndarray | None:
    if values is None:
        return None
    out = np.asarray(values, np.float64)
    if out.shape != (channels,):
        raise InvalidArgs(f"{what} has shape {out.shape}, not ({channels},)")
    return out


def _spread(row: DataFrame) -> DataFrame:
    """(band, value) of a one-row DataFrame with an array v."""
    return row.select(F.posexplode("v").alias("band", "value")).select(F.col("band").cast("long").alias("band"), "value")


def _given(spark: SparkSession, values: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "band long, value double")


def band_means(cube: DataFrame) -> DataFrame:
    """(band, value): the mean of each band, summed in double precision."""
    c = channels_of(cube)
    if c > NARROW:
        return _given(cube.sparkSession, moments(cube).means)
    return _spread(checked(cube, c).agg(F.array(*(F.avg(_band(i)) for i in range(c))).alias("v")))


def band_stddevs(cube: DataFrame, means: Sequence[float] | None = None) -> DataFrame:
    """(band, value): population standard deviations, about the bands' own means or about given ones."""
    c = channels_of(cube)
    mu = _vector(means, c, "means")
    if c > NARROW:
        m = moments(cube, mu)
        var = np.diag(m.covariance if mu is None else m.about(mu))
        return _given(cube.sparkSession, np.sqrt(np.maximum(var, 0.0)))
    one = F.stddev_pop
    cells = [one(_band(i)) if mu is None else F.sqrt(F.avg((_band(i) - float(mu[i])) * (_band(i) - float(mu[i])))) for i in range(c)]
    return _spread(checked(cube, c).agg(F.array(*cells).alias("v")))


def covariance(cube: DataFrame, means: Sequence[float] | None = None, std_devs: Sequence[float] | None = None) -> DataFrame:
    """(i, j, value): the mean of z_i * z_j with z = (x - mean) / std_dev.

    Absent means stand for 0 and absent deviations for 1; neither is computed here.  So: raw second moments,
    covariance, scaled second moments or correlation.  A zero deviation gives NaN or infinity by IEEE rules.
    """
    c = channels_of(cube)
    mu, sd = _vector(means, c, "means"), _vector(std_devs, c, "std_devs")
    if c > NARROW_PAIRS:
        m = moments(cube, mu)
        g = m.about(np.zeros(c) if mu is None else mu)
        if sd is not None:
            with np.errstate(divide="ignore", invalid="ignore"):
                g = g / np.outer(sd, sd)
        return matrix_rows(cube.sparkSession, g)
    z = [_band(i) if mu is None else _band(i) - float(mu[i]) for i in range(c)]
    cells = {(i, j): F.avg(z[i] * z[j]) for i in range(c) for j in range(i, c)}
    row = checked(cube, c).agg(*(v.alias(f"c{i}_{j}") for (i, j), v in cells.items()))

    def cell(i: int, j: int) -> Column:
        v = F.col(f"c{min(i, j)}_{max(i, j)}")
        return v if sd is None else ieee_div(v, F.lit(float(sd[i] * sd[j])))

    out = row.select(F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), cell(i, j).alias("value")) for i in range(c) for j in range(c)))).alias("x"))
    return out.select("x.i", "x.j", "x.value")


def covariance_own(cube: DataFrame) -> DataFrame:
    """(i, j, value): population covariance about the bands' own means, in one pass."""
    c = channels_of(cube)
    if c > NARROW_PAIRS:
        return matrix_rows(cube.sparkSession, moments(cube).covariance)
    row = checked(cube, c).agg(*(F.covar_pop(_band(i), _band(j)).alias(f"c{i}_{j}") for i in range(c) for j in range(i, c)))
    out = row.select(F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.col(f"c{min(i, j)}_{max(i, j)}").alias("value")) for i in range(c) for j in range(c)))).alias("x"))
    return out.select("x.i", "x.j", "x.value")


def matrix_rows(spark: SparkSession, m: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i long, j long, value double")


def as_vector(df: DataFrame) -> np.ndarray:
    """A band vector on the driver: one number a band."""
    t = df.orderBy("band").toArrow()
    return t.column("value").to_numpy()


def as_matrix(df: DataFrame) -> np.ndarray:
    """A band matrix on the driver."""
    t = df.orderBy("i", "j").toArrow()
    v = t.column("value").to_numpy()
    n = int(round(len(v) ** 0.5))
    return v.reshape(n, n)
