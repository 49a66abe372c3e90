"""Kernels over the band-sequential layout (band, block, values): sums by block, then by band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arithmetic import ieee_div


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))


def _per_band(bsq: DataFrame, value: Column, finish=lambda x: x) -> DataFrame:
    n = F.sum(F.size("values").cast("double"))
    return bsq.groupBy("band").agg(finish(F.try_divide(F.sum(value), n)).alias("value"))


def channel_means(bsq: DataFrame) -> DataFrame:
    """(band, value): sum over length, the length being that of the channel itself."""
    return _per_band(bsq, _sum(F.col("values")))


def channel_stddevs(bsq: DataFrame, means: DataFrame) -> DataFrame:
    """(band, value): population deviations about given means (band, value)."""
    x = bsq.join(means.withColumnRenamed("value", "mu"), "band")
    return _per_band(x, _sum(F.transform("values", lambda v: (v.cast("double") - F.col("mu")) * (v.cast("double") - F.col("mu")))), F.sqrt)


def standardize_channels(bsq: DataFrame, means: DataFrame, std_devs: DataFrame) -> DataFrame:
    """bsq with values (x - mean) / std_dev."""
    x = bsq.join(means.withColumnRenamed("value", "mu"), "band").join(std_devs.withColumnRenamed("value", "sd"), "band")
    return x.select("band", "block", F.transform("values", lambda v: ieee_div(v.cast("double") - F.col("mu"), F.col("sd"))).alias("values"))


def channel_covariance(standardised: DataFrame, i: int, raw: DataFrame, j: int, mean: float, std_dev: float) -> DataFrame:
    """One row (value): the mean of x * (y - mean) / std_dev, x of channel i standardised, y of channel j raw.

    The shorter channel ends the sum; the divisor is the length of x.
    """
    x = standardised.where(F.col("band") == i).select("block", F.col("values").alias("x"))
    y = raw.where(F.col("band") == j).select("block", F.col("values").alias("y"))
    both = x.join(y, "block", "left").withColumn("k", F.least(F.size("x"), F.coalesce(F.size("y"), F.lit(0))))
    product = F.zip_with(F.slice("x", 1, F.col("k")), F.slice("y", 1, F.col("k")), lambda a, b: a * ieee_div(b.cast("double") - float(mean), F.lit(float(std_dev))))
    return both.agg(F.try_divide(F.sum(F.when(F.col("k") > 0, _sum(product)).otherwise(0.0)), F.sum(F.size("x").cast("double"))).alias("value"))


def channel_variance(standardised: DataFrame) -> DataFrame:
    """(band, value): the mean of squares, which is the variance if the mean is 0."""
    return _per_band(standardised, _sum(F.transform("values", lambda v: v.cast("double") * v.cast("double"))))
