"""The engine's queries over the driver's tables: `embeddings` as an image of 25 samples a line, `lineitem` as four bands."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgs
from ..functions.arithmetic import tidy
from ..operators import bsq as kernels
from ..operators import crop as cropping
from ..operators import moments as wide
from ..operators import pca as components
from ..operators import render, stats
from ..operators import transform as maps
from ..sources import bip, stats_json
from ..sources.header import ImageHeader
from . import cube as layout

PIXELS = 25
BANDS = 64
COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
GIVEN = [0.01 * (i % 5) for i in range(BANDS)]
DEVS = [0.1 + 0.01 * (i % 7) for i in range(BANDS)]
WEIGHTS = [[((k + 1) * (i % 7) - 3) / 8 for i in range(BANDS)] for k in range(3)]


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.cube_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", PIXELS)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.cube_of_columns(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), COLUMNS)


def _values(df: DataFrame, digits: int) -> DataFrame:
    return df.withColumn("value", tidy(F.col("value"), digits))


def _bands(df: DataFrame, digits: int = 6) -> DataFrame:
    return layout.to_long(df).withColumn("value", tidy(F.col("value"), digits))


def _size(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Whole lines of the image, and samples of an unfinished last one."""
    return divmod(spark.read.parquet(f"{sf_dir}/embeddings.parquet").count(), PIXELS)


def band_means_embeddings(spark, sf_dir):
    return _values(stats.band_means(image(spark, sf_dir)), 6)


def band_stddevs_embeddings(spark, sf_dir):
    return _values(stats.band_stddevs(image(spark, sf_dir)), 6)


def band_stddevs_given_means(spark, sf_dir):
    return _values(stats.band_stddevs(image(spark, sf_dir), GIVEN), 6)


def band_means_lineitem(spark, sf_dir):
    return _values(stats.band_means(items(spark, sf_dir)), 2)


def band_stddevs_lineitem(spark, sf_dir):
    return _values(stats.band_stddevs(items(spark, sf_dir)), 2)


def band_means_events(spark, sf_dir):
    return _values(stats.band_means(layout.cube_of_columns(spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null"), ["value"])), 6)


def second_moment_lineitem(spark, sf_dir):
    return _values(stats.covariance(items(spark, sf_dir)), 2)


def cov_lineitem(spark, sf_dir):
    return _values(stats.covariance_own(items(spark, sf_dir)), 2)


def cov_given_means_lineitem(spark, sf_dir):
    return _values(stats.covariance(items(spark, sf_dir), [25.0, 1000.0, 0.05, 0.04]), 2)


def scaled_moment_lineitem(spark, sf_dir):
    return _values(stats.covariance(items(spark, sf_dir), None, [15.0, 2000.0, 0.03, 0.02]), 2)


def corr_lineitem(spark, sf_dir):
    cube = items(spark, sf_dir)
    # one scan gives both statistics that the second one uses
    row = spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(*(f(c) for f in (F.avg, F.stddev_pop) for c in COLUMNS)).first()
    return _values(stats.covariance(cube, row[:4], row[4:]), 6)


def cov_embeddings(spark, sf_dir):
    return _values(stats.covariance_own(image(spark, sf_dir)), 6)


def cov_embeddings_arrow(spark, sf_dir):
    m = wide.moments(image(spark, sf_dir), np.zeros(BANDS))
    return _values(stats.matrix_rows(spark, m.covariance), 6)


def crop_rect(spark, sf_dir):
    return _bands(cropping.crop(image(spark, sf_dir), (2, 9), (3, 11), None, PIXELS))


def crop_rows(spark, sf_dir):
    return _bands(cropping.crop(image(spark, sf_dir), (4, 8), None, None, PIXELS))


def crop_cols(spark, sf_dir):
    return _bands(cropping.crop(image(spark, sf_dir), None, (20, 25), None, PIXELS))


def crop_none(spark, sf_dir):
    return _bands(cropping.crop(image(spark, sf_dir), None, None, None, PIXELS))


def crop_empty(spark, sf_dir):
    return _bands(cropping.crop(image(spark, sf_dir), (3, 3), None, None, PIXELS))


def crop_then_means(spark, sf_dir):
    return _values(stats.band_means(cropping.crop(image(spark, sf_dir), (2, 9), (3, 11), None, PIXELS)), 6)


def standardize_embeddings(spark, sf_dir):
    return _bands(maps.standardize(image(spark, sf_dir), GIVEN, DEVS))


def transform_k3(spark, sf_dir):
    return _bands(maps.linear_transform(image(spark, sf_dir), WEIGHTS))


def transform_k3_standardized(spark, sf_dir):
    return _bands(maps.linear_transform(image(spark, sf_dir), WEIGHTS, GIVEN, DEVS))


def transform_k3_batches(spark, sf_dir):
    w = np.array(WEIGHTS)
    return _bands(maps.map_batches(image(spark, sf_dir), lambda x: x @ w.T))


def rgb_linear(spark, sf_dir):
    return render.rgb_linear(image(spark, sf_dir), (5, 17, 40), -0.25, 0.25)


def rgb_batched(spark, sf_dir):
    return render.rgb_batched(image(spark, sf_dir), lambda x: np.clip(np.floor((x[:, [5, 17, 40]] + 0.25) / 0.5 * 255.0 + 0.5), 0, 255))


def bsq_transpose(spark, sf_dir):
    b = layout.to_bsq(image(spark, sf_dir))
    return b.select("band", "block", F.array_join(F.transform("values", lambda x: F.round(x.cast("double") * 1e6).cast("long").cast("string")), ",").alias("values"))


def bsq_mean(spark, sf_dir):
    return _values(kernels.channel_means(layout.to_bsq(image(spark, sf_dir))), 6)


def bsq_stddev(spark, sf_dir):
    b = layout.to_bsq(image(spark, sf_dir))
    return _values(kernels.channel_stddevs(b, stats._given(spark, np.array(GIVEN))), 6)


def _standardised(spark, sf_dir):
    b = layout.to_bsq(image(spark, sf_dir))
    return b, kernels.standardize_channels(b, stats._given(spark, np.array(GIVEN)), stats._given(spark, np.array(DEVS)))


def bsq_variance(spark, sf_dir):
    return _values(kernels.channel_variance(_standardised(spark, sf_dir)[1]), 6)


def bsq_covariance(spark, sf_dir):
    b, z = _standardised(spark, sf_dir)
    return _values(kernels.channel_covariance(z, 3, b, 8, GIVEN[8], DEVS[8]), 6)


def pca_eigenvalues_2band(spark, sf_dir):
    cube = layout.cube_of_columns(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_discount", "l_tax"])
    m = wide.moments(cube)
    sd = np.sqrt(np.diag(m.covariance))
    values, _ = components.pca(m.covariance / np.outer(sd, sd))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "component long, value double").withColumn("value", tidy(F.col("value"), 6))


def pca_explained_embeddings(spark, sf_dir):
    values, _ = components.pca(wide.moments(image(spark, sf_dir)).covariance, 8)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "component long, value double")


def pca_scores_embeddings(spark, sf_dir):
    m = wide.moments(image(spark, sf_dir))
    _, w = components.pca(m.covariance, 3)
    return maps.linear_transform(image(spark, sf_dir), w, m.means)


def pca_trace_embeddings(spark, sf_dir):
    values, _ = components.pca(wide.moments(image(spark, sf_dir)).covariance)
    return spark.createDataFrame([(float(values.sum()),)], "value double").withColumn("value", tidy(F.col("value"), 6))


def pca_residuals_embeddings(spark, sf_dir):
    """The largest entry of C w - lambda w for each of the 8 first components, and of w w' - 1."""
    c = wide.moments(image(spark, sf_dir)).covariance
    values, w = components.pca(c, 8)
    off = np.maximum(np.abs(w @ c - values[:, None] * w).max(1), np.abs(w @ w.T - np.eye(8)).max(1))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(off)], "component long, value double").withColumn("value", tidy(F.col("value"), 6))


def pca_score_covariance(spark, sf_dir):
    """The scores' covariance over the eigenvalues' geometric means: ones for a component with itself, else zeros."""
    m = wide.moments(image(spark, sf_dir))
    values, w = components.pca(m.covariance, 3)
    own = wide.moments(maps.linear_transform(image(spark, sf_dir), w, m.means)).covariance
    return _values(stats.matrix_rows(spark, own / np.sqrt(np.outer(values, values))), 6)


def _folder(spark) -> str:
    """A new folder in the place that driver and executors share."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        if not spark.sparkContext.master.startswith("local["):
            raise InvalidArgs("set spark.checkpoint.dir to a folder that driver and executors share")
        return tempfile.mkdtemp(prefix="images-")
    path = os.path.join(urlparse(given).path, f"images-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def _file(spark, sf_dir) -> ImageHeader:
    """The embeddings written as a Bip file with its header file, which is read back."""
    folder, cube = _folder(spark), image(spark, sf_dir)
    at = f"{folder}/image.json"
    lines, rest = _size(spark, sf_dir)
    bip.write_bip(cube, ImageHeader(BANDS, lines, PIXELS, f"{folder}/image.bip", rest=rest), at, parts=3)
    return ImageHeader.load(at)


def bip_roundtrip(spark, sf_dir):
    return _bands(bip.read_bip(spark, _file(spark, sf_dir)))


def bip_records_roundtrip(spark, sf_dir):
    return _bands(bip.read_bip_records(spark, _file(spark, sf_dir)))


def bip_places(spark, sf_dir):
    h = _file(spark, sf_dir)
    # some ranges of a small image, not thousands of a large one
    return bip.read_bip(spark, h, split=max(20_000, min(bip.SPLIT, h.size // 64))).select("pixel_id", "line", "sample", F.size("bands").alias("n"))


def bip_means(spark, sf_dir):
    return _values(stats.band_means(bip.read_bip(spark, _file(spark, sf_dir))), 6)


def bip_stddevs(spark, sf_dir):
    return _values(stats.band_stddevs(bip.read_bip(spark, _file(spark, sf_dir))), 6)


def bip_stddevs_given_means(spark, sf_dir):
    """Means go by way of their JSON file, as on the command line."""
    h = _file(spark, sf_dir)
    at = f"{os.path.dirname(h.path)}/means.json"
    stats_json.save(at, np.array(GIVEN))
    return _values(stats.band_stddevs(bip.read_bip(spark, h), stats_json.load(at, BANDS)), 6)


def bip_covariance(spark, sf_dir):
    return _values(stats.covariance_own(bip.read_bip(spark, _file(spark, sf_dir))), 6)


def bip_crop(spark, sf_dir):
    h = _file(spark, sf_dir)
    return _bands(cropping.crop(bip.read_bip(spark, h), (2, 9), (3, 11), h.all_lines, h.pixels))


def bip_crop_file(spark, sf_dir):
    """The crop written as a file of its own and read back."""
    h = _file(spark, sf_dir)
    out = h.cropped((2, 9), (3, 11), f"{os.path.dirname(h.path)}/crop.bip")
    bip.write_bip(cropping.crop(bip.read_bip(spark, h), (2, 9), (3, 11), h.all_lines, h.pixels), out, parts=2)
    return _bands(bip.read_bip(spark, out))


def bip_map_file(spark, sf_dir):
    """A batched transform written as a file and read back (values narrowed to 32 bits)."""
    h, w = _file(spark, sf_dir), np.array(WEIGHTS)
    out = ImageHeader(3, h.lines, h.pixels, f"{os.path.dirname(h.path)}/map.bip", rest=h.rest)
    bip.write_bip(maps.map_batches(bip.read_bip(spark, h), lambda x: x @ w.T), out, parts=2)
    return _bands(bip.read_bip(spark, out), 4)


def header_roundtrip(spark, sf_dir):
    h = _file(spark, sf_dir)
    rows = [(h.channels, h.lines, h.pixels, h.format, os.path.getsize(h.path), h.pixel_offset(1, 2), h.channel_offset(3))]
    return spark.createDataFrame(rows, "channels long, lines long, pixels long, format string, bytes long, offset_1_2 long, channel_3 long")


def stats_json_roundtrip(spark, sf_dir):
    at = f"{_folder(spark)}/means.json"
    stats_json.save(at, stats.as_vector(stats.band_means(image(spark, sf_dir))))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(stats_json.load(at, BANDS))], "band long, value double").withColumn("value", tidy(F.col("value"), 6))


def fold_embeddings(spark, sf_dir):
    """Least and largest value and sum of squares of each band by a user's fold."""

    def step(x, s):
        return np.stack([np.minimum(s[0], x.min(0)), np.maximum(s[1], x.max(0)), s[2] + (x * x).sum(0)])

    def merge(a, b):
        return np.stack([np.minimum(a[0], b[0]), np.maximum(a[1], b[1]), a[2] + b[2]])

    zero = np.stack([np.full(BANDS, np.inf), np.full(BANDS, -np.inf), np.zeros(BANDS)])
    low, high, square = wide.fold_batched(image(spark, sf_dir), lambda: zero, step, merge, lambda s: s.tobytes(), lambda b: np.frombuffer(b).reshape(3, BANDS))
    rows = [(i, *(float(x[i]) for x in (low, high, square))) for i in range(BANDS)]
    return spark.createDataFrame(rows, "band long, low double, high double, square double").select("band", *(tidy(F.col(c), 6).alias(c) for c in ("low", "high", "square")))


def bsq_roundtrip(spark, sf_dir):
    return _bands(layout.from_bsq(layout.to_bsq(image(spark, sf_dir), 64), PIXELS, 64))


def queries():
    skip = {"image", "items", "queries"}
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and k[0] != "_" and k not in skip}
