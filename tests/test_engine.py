"""Operators against numpy in double precision, on the synthetic cubes of FIXTURES.md."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from bandwright.errors import FileMissing, InvalidArgs, InvalidHeader, IoFailure
from bandwright.operators import bsq, moments, pca, render, stats
from bandwright.operators.crop import crop
from bandwright.operators.transform import linear_transform, map_batches, standardize
from bandwright.plans import cube as layout
from bandwright.plans import queries
from bandwright.sources import bip, stats_json
from bandwright.sources.header import ImageHeader

RNG = np.random.default_rng(3)
CUBES = {
    "one_pixel": (5, 1, 1),
    "sub_batch": (5, 7, 11),
    "exact_batch": (5, 32, 32),
    "batch_plus_one": (5, 25, 41),
    "single_band": (1, 20, 20),
    "wide": (394, 6, 7),
}


def values(c, lines, pixels, mean=0.0):
    return (RNG.normal(mean, 1.0, (lines * pixels, c))).astype(np.float32)


def ramp():
    return (np.arange(30)[:, None] * 3 + np.arange(3)).astype(np.float32)


def cube(spark, x, pixels):
    rows = [(i, i // pixels, i % pixels, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, bip.SCHEMA)


def bands(df):
    return np.array([r["bands"] for r in df.orderBy("pixel_id").collect()])


@pytest.mark.parametrize("name", CUBES)
def test_statistics(spark, name):
    c, lines, pixels = CUBES[name]
    x = values(c, lines, pixels)
    d = cube(spark, x, pixels)
    x = x.astype(np.float64)
    mu, other = x.mean(0), np.full(c, 0.25)
    assert np.allclose(stats.as_vector(stats.band_means(d)), mu, atol=1e-12)
    assert np.allclose(stats.as_vector(stats.band_stddevs(d)), x.std(0), atol=1e-12)
    assert np.allclose(stats.as_vector(stats.band_stddevs(d, other)), np.sqrt(((x - other) ** 2).mean(0)), atol=1e-12)
    if c > 20:
        m = moments.moments(d)
        assert np.allclose(m.covariance, np.cov(x.T, bias=True), atol=1e-12)
        return
    sd = np.full(c, 2.0)
    for means in (None, mu, other):
        for devs in (None, sd):
            z = (x - (0 if means is None else means)) / (1 if devs is None else devs)
            assert np.allclose(stats.as_matrix(stats.covariance(d, means, devs)), z.T @ z / len(z), atol=1e-12)


def test_large_offset_costs_no_digits(spark):
    x = RNG.normal(1e6, 1.0, (400, 3))
    d = spark.createDataFrame([([float(v) for v in r],) for r in x], "bands array<double>")
    assert np.allclose(moments.moments(d).covariance, np.cov(x.T, bias=True), rtol=1e-8)
    assert np.allclose(stats.as_matrix(stats.covariance_own(d)), np.cov(x.T, bias=True), rtol=1e-8)


def test_paths_and_partitions_agree(spark):
    d = cube(spark, values(6, 10, 10), 10)
    a = stats.as_matrix(stats.covariance_own(d))
    assert np.allclose(a, moments.moments(d).covariance, atol=1e-13)
    assert np.allclose(a, moments.moments(d.repartition(7)).covariance, atol=1e-13)
    assert np.allclose(a, a.T) and np.linalg.eigvalsh(a).min() > -1e-12
    assert np.allclose(np.sqrt(np.diag(a)), stats.as_vector(stats.band_stddevs(d)))


def test_zero_deviation_and_non_finite(spark):
    x = values(3, 10, 10)
    x[:, 1] = 4
    d = cube(spark, x, 10)
    z = bands(standardize(d, [0.0, 4.0, 0.0], [1.0, 0.0, 1.0]))
    assert np.isnan(z[:, 1]).all() and np.isfinite(z[:, [0, 2]]).all()
    x[0, 0], x[1, 2] = np.nan, np.inf
    got = stats.as_vector(stats.band_means(cube(spark, x, 10)))
    assert np.isnan(got[0]) and got[1] == 4 and np.isinf(got[2])


def test_bad_pixels_raise(spark):
    d = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "bands array<float>")
    with pytest.raises(Exception, match="has not 2 values"):
        stats.band_means(d).collect()
    with pytest.raises(InvalidArgs):
        stats.band_means(d.limit(0))


CROPS = [(None, None), ((2, 4), None), (None, (1, 3)), ((2, 4), (1, 3)), ((0, 6), (0, 5)), ((2, 2), None)]


@pytest.mark.parametrize("rows,cols", CROPS)
def test_crop(spark, rows, cols):
    x = ramp()
    got = crop(cube(spark, x, 5), rows, cols, 6, 5)
    r, c = rows or (0, 6), cols or (0, 5)
    want = x.reshape(6, 5, 3)[r[0] : r[1], c[0] : c[1]].reshape(-1, 3)
    assert np.array_equal(bands(got).reshape(-1, 3), want)
    assert [r["pixel_id"] for r in got.orderBy("pixel_id").collect()] == list(range(len(want)))


@pytest.mark.parametrize("rows,cols", [((4, 2), None), ((0, 7), None), (None, (-1, 2)), (None, (0, 6))])
def test_crop_errors(spark, rows, cols):
    with pytest.raises(InvalidArgs):
        crop(cube(spark, ramp(), 5), rows, cols, 6, 5)


def test_transform(spark):
    x = values(5, 4, 6)
    d = cube(spark, x, 6)
    w, mu, sd = RNG.normal(size=(2, 5)), RNG.normal(size=5), RNG.uniform(1, 2, 5)
    assert np.allclose(bands(linear_transform(d, w, mu, sd)), (x.astype(float) - mu) / sd @ w.T)
    assert np.allclose(bands(linear_transform(d, np.eye(5))), x)
    assert np.allclose(bands(map_batches(d, lambda m: m * 2)), x.astype(float) * 2)
    wide = cube(spark, values(394, 3, 3), 3)
    w = RNG.normal(size=(20, 394))
    assert np.allclose(bands(linear_transform(wide, w)), bands(wide) @ w.T)
    with pytest.raises(InvalidArgs):
        linear_transform(d, np.eye(4))


def test_fold_batched(spark):
    x = values(3, 8, 9)
    d = cube(spark, x, 9).repartition(5)
    got = moments.fold_batched(d, lambda: -np.inf, lambda b, s: max(s, b.max()), max, lambda s: np.float64(s).tobytes(), lambda b: float(np.frombuffer(b)[0]))
    assert got == float(x.max())


def test_pca(spark):
    q, _ = np.linalg.qr(RNG.normal(size=(4, 4)))
    cov = q @ np.diag([100.0, 10.0, 1.0, 0.1]) @ q.T
    v, w = pca.pca(cov, 2)
    assert np.allclose(v, [100, 10]) and np.allclose(np.abs(w @ q[:, :2]), np.eye(2), atol=1e-9)
    assert np.isclose(pca.pca(cov)[0].sum(), np.trace(cov)) and (w[np.arange(2), np.abs(w).argmax(1)] > 0).all()
    with pytest.raises(InvalidArgs):
        pca.pca(cov, 5)


def test_render(spark, tmp_path):
    d = cube(spark, ramp(), 5)
    a = render.rgb_linear(d, (0, 1, 2), 0.0, 80.0)
    want = np.clip(np.floor(ramp().astype(float) / 80 * 255 + 0.5), 0, 255).astype(np.uint8)
    assert np.array_equal(np.array([(r.r, r.g, r.b) for r in a.orderBy("pixel_id").collect()]), want)
    b = render.rgb_batched(d, lambda x: np.clip(np.floor(x / 80 * 255 + 0.5), 0, 255))
    assert a.exceptAll(b).isEmpty()
    render.save_ppm(a.repartition(3), str(tmp_path / "x.ppm"), 6, 5)
    assert (tmp_path / "x.ppm").read_bytes() == b"P6\n5 6\n255\n" + want.tobytes()
    with pytest.raises(Exception, match="colormap"):
        render.rgb_batched(d, lambda x: x[:, :2]).collect()


def test_bsq(spark):
    x = values(3, 6, 5)
    d = cube(spark, x, 5).repartition(4)
    b = layout.to_bsq(d, block=7)
    assert np.allclose(bands(layout.from_bsq(b, 5, block=7)), x)
    x = x.astype(float)
    mu, sd = x.mean(0), x.std(0)
    assert np.allclose(stats.as_vector(bsq.channel_means(b)), mu)
    m, s = (stats._given(spark, v) for v in (mu, sd))
    assert np.allclose(stats.as_vector(bsq.channel_stddevs(b, m)), sd)
    z = bsq.standardize_channels(b, m, s)
    assert np.allclose(stats.as_vector(bsq.channel_variance(z)), 1)
    zx = (x - mu) / sd
    assert np.isclose(bsq.channel_covariance(z, 0, b, 2, mu[2], sd[2]).first()[0], (zx[:, 0] * zx[:, 2]).mean())
    # a shorter second channel ends the sum, the first one's length divides
    short = layout.to_bsq(d.where("pixel_id < 20"), block=7)
    assert np.isclose(bsq.channel_covariance(z, 0, short, 2, mu[2], sd[2]).first()[0], (zx[:20, 0] * zx[:20, 2]).sum() / 30)


def test_bip_round_trip(spark, tmp_path):
    x = ramp()
    h = ImageHeader(3, 6, 5, str(tmp_path / "image"))
    bip.write_bip(cube(spark, x, 5).repartition(4), h, str(tmp_path / "image.json"), parts=3)
    assert (tmp_path / "image").read_bytes() == x.astype("<f4").tobytes()
    assert ImageHeader.load(str(tmp_path / "image.json")) == h
    d = bip.read_bip(spark, str(tmp_path / "image.json"), split=60)
    assert d.rdd.getNumPartitions() == 6 and np.array_equal(bands(d), x)
    some = d.where("line >= 2 and line < 4")
    assert some.rdd.getNumPartitions() == 2 and np.array_equal(bands(some), x[10:20])
    assert np.array_equal(bands(bip.read_bip_records(spark, h)), x)


def test_bip_errors(spark, tmp_path):
    (tmp_path / "short").write_bytes(ramp().tobytes()[:-4])
    with pytest.raises(IoFailure):
        ImageHeader(3, 6, 5, str(tmp_path / "short")).check_file()
    (tmp_path / "image").write_bytes(ramp().tobytes())
    with pytest.raises(IoFailure):
        ImageHeader(3, 7, 5, str(tmp_path / "image")).check_file()
    with pytest.raises(FileMissing):
        ImageHeader(3, 7, 5, str(tmp_path / "none")).check_file()
    with pytest.raises(InvalidArgs):
        ImageHeader(0, 7, 5, "x")
    with pytest.raises(InvalidArgs):
        bip.BipReader(ImageHeader(3, 6, 5, str(tmp_path / "image"), "Bsq"), 100)
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(InvalidHeader):
        ImageHeader.load(str(tmp_path / "bad.json"))
    with pytest.raises(Exception, match="gapless|is missing|the header says"):
        bip.write_bip(cube(spark, ramp(), 5).where("pixel_id <> 7"), ImageHeader(3, 6, 5, str(tmp_path / "gap")), str(tmp_path / "gap.json"))
    assert not (tmp_path / "gap").exists()


def test_stats_json(tmp_path):
    p = str(tmp_path / "m.json")
    stats_json.save(p, np.eye(2))
    assert np.array_equal(stats_json.load(p), np.eye(2))
    (tmp_path / "l.json").write_text("[1, 2.5]")
    assert stats_json.load(str(tmp_path / "l.json"), 2).tolist() == [1, 2.5]
    with pytest.raises(InvalidArgs):
        stats_json.load(str(tmp_path / "l.json"), 3)


def test_command_line(spark, tmp_path):
    from bandwright.cli import main

    x = ramp()
    (tmp_path / "image").write_bytes(x.tobytes())
    h, o = str(tmp_path / "h.json"), str(tmp_path / "o.json")
    assert main(["--backend", "mmap", "new-header", "-o", h, "-d", str(tmp_path / "image"), "-c", "3", "-l", "6", "-p", "5"]) == 0
    assert main(["means", "--header", h, "-o", o]) == 0
    x = x.astype(float)
    assert np.allclose(stats_json.load(o), x.mean(0))
    d = str(tmp_path / "d.json")
    assert main(["standard-deviations", "--header", h, "-o", d]) == 0
    assert np.allclose(stats_json.load(d), x.std(0))
    assert main(["covariances", "--header", h, "-o", str(tmp_path / "c.json"), "-m", o, "-s", d]) == 0
    assert np.allclose(stats_json.load(str(tmp_path / "c.json")), np.corrcoef(x.T))
    assert main(["covariances", "--header", h, "-o", str(tmp_path / "c.json")]) == 0
    assert np.allclose(stats_json.load(str(tmp_path / "c.json")), x.T @ x / 30)
    assert main(["crop", "--header", h, "-o", str(tmp_path / "cut"), "-r", "1", "3", "-c", "2", "4"]) == 0
    assert np.array_equal(np.fromfile(tmp_path / "cut", "<f4"), x.reshape(6, 5, 3)[1:3, 2:4].ravel())
    assert main(["means", "--header", str(tmp_path / "none.json"), "-o", o]) == 1
    assert main(["crop", "--header", h, "-o", str(tmp_path / "cut"), "-r", "1", "9"]) == 1


def test_stream(spark, tmp_path):
    from bandwright.streaming.statistics import read_statistics, run_statistics

    x = values(3, 6, 5)
    d = cube(spark, x, 5)
    for k in range(3):
        d.where(f"pixel_id % 3 = {k}").write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run_statistics(stream, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination(120)
    got = read_statistics(spark, str(tmp_path / "state")).orderBy("band").collect()
    assert [r["n"] for r in got] == [30] * 3
    assert np.allclose([r["mean"] for r in got], x.astype(float).mean(0)) and np.allclose([r["std_dev"] for r in got], x.astype(float).std(0))


def test_a_given_header_is_obeyed_and_nothing_is_written_beside_the_data(spark, tmp_path):
    x = ramp()
    path = str(tmp_path / "r.bip")
    x.tofile(path)
    ImageHeader(3, 6, 5, path).save(f"{path}.json")  # another reading of the same bytes lies beside the file
    got = bands(bip.read_bip(spark, ImageHeader(1, 9, 10, path)))
    assert got.shape == (90, 1) and np.array_equal(got.ravel(), x.ravel())
    assert np.array_equal(bands(bip.read_bip(spark, f"{path}.json")), x)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["r.bip", "r.bip.json"]
    assert np.array_equal(bands(bip.read_bip_records(spark, ImageHeader(1, 9, 10, path))).ravel(), x.ravel())
    with pytest.raises(IoFailure):
        bip.read_bip_records(spark, ImageHeader(1, 9, 11, path))


def test_a_failed_write_leaves_the_old_file(spark, tmp_path):
    path = str(tmp_path / "r.bip")
    h = ImageHeader(3, 6, 5, path)
    bip.write_bip(cube(spark, ramp(), 5), h, parts=4)
    for bad in (cube(spark, ramp(), 5).where("pixel_id <> 7"), cube(spark, ramp(), 5).union(cube(spark, ramp()[:1], 5)), cube(spark, ramp()[:20], 5)):
        with pytest.raises(Exception):  # noqa: B017
            bip.write_bip(bad, h, parts=2)
    assert np.array_equal(bands(bip.read_bip(spark, h)), ramp())
    assert [p.name for p in tmp_path.iterdir()] == ["r.bip"]


def test_bsq_blocks(spark):
    x = values(3, 10, 10)
    d = cube(spark, x, 10).repartition(4)
    b = layout.to_bsq(d, 16)
    got = {(r["band"], r["block"]): r["values"] for r in b.collect()}
    assert set(got) == {(i, k) for i in range(3) for k in range(7)}
    assert np.array_equal(np.concatenate([got[1, k] for k in range(7)]).astype(np.float32), x[:, 1])
    assert np.array_equal(bands(layout.from_bsq(b, 10, 16)), x)
    assert layout.to_bsq(d.limit(0)).isEmpty()


def _by_pixel(x):
    return [(i, b, v) for i, r in enumerate(x) for b, v in enumerate(r)]


def _cut(x):
    return _by_pixel(x[[line * 25 + sample for line in range(2, 9) for sample in range(3, 11)]])


#: What each query gives for the embeddings x, a multiple of 25 rows or not.
UNFINISHED = {
    "bip_covariance": lambda x: _by_pixel(np.cov(x.T, bias=True)),
    "bip_crop": _cut,
    "bip_crop_file": _cut,
    "bip_map_file": lambda x: _by_pixel(x @ np.array(queries.WEIGHTS).T),
    "bip_means": lambda x: list(enumerate(x.mean(0))),
    "bip_places": lambda x: [(i, i // 25, i % 25, 64) for i in range(len(x))],
    "bip_records_roundtrip": _by_pixel,
    "bip_roundtrip": _by_pixel,
    "bip_stddevs": lambda x: list(enumerate(x.std(0))),
    "bip_stddevs_given_means": lambda x: list(enumerate(np.sqrt(((x - queries.GIVEN) ** 2).mean(0)))),
    "header_roundtrip": lambda x: [(64, len(x) // 25, 25, len(x) * 256, 27 * 256, 3 * len(x))],
}


@pytest.mark.parametrize("name", UNFINISHED)
def test_queries_of_an_image_with_an_unfinished_last_line(spark, tmp_path, name):
    x = values(64, 227, 1)
    pq.write_table(pa.table({"vec_id": pa.array(range(227), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    got = sorted(tuple(v for v in r if not isinstance(v, str)) for r in queries.queries()[name](spark, str(tmp_path)).collect())
    want = UNFINISHED[name](x.astype(float))
    assert len(got) == len(want) and np.allclose(got, want, atol=1e-4)


def test_headers_of_unfinished_lines(spark, tmp_path):
    from bandwright.cli import main

    x = ramp()[:28]
    h = ImageHeader(3, 5, 5, str(tmp_path / "image"), rest=3)
    for bad in ({"rest": 5}, {"rest": -1}, {"rest": 0, "lines": 0}):
        with pytest.raises(InvalidArgs):
            ImageHeader(**{"channels": 3, "lines": 5, "pixels": 5, "path": "x", **bad})
    assert ImageHeader(3, 0, 5, "x", rest=2).n_pixels == 2
    bip.write_bip(cube(spark, x, 5).repartition(4), h, str(tmp_path / "image.json"), parts=3)
    assert (tmp_path / "image").read_bytes() == x.tobytes() and ImageHeader.load(str(tmp_path / "image.json")) == h
    d = bip.read_bip(spark, str(tmp_path / "image.json"), split=60)
    assert d.rdd.getNumPartitions() == 6 and np.array_equal(bands(d), x) and np.array_equal(bands(d.where("line >= 5")), x[25:])
    assert np.array_equal(bands(bip.read_bip_records(spark, h)), x)
    for rows, cols, at in ((None, None, range(28)), ((4, 6), (1, 3), [21, 22, 26, 27]), ((4, 6), (2, 4), [22, 23, 27]), (None, (3, 5), [i + s for i in range(0, 25, 5) for s in (3, 4)]), ((1, 3), None, range(5, 15))):
        limits = [f for k, r in (("-r", rows), ("-c", cols)) if r for f in (k, *map(str, r))]
        assert main(["crop", "--header", str(tmp_path / "image.json"), "-o", str(tmp_path / "cut"), *limits]) == 0
        assert (tmp_path / "cut").read_bytes() == x[list(at)].tobytes()
        assert np.array_equal(bands(bip.read_bip(spark, str(tmp_path / "cut.json"))), x[list(at)])
    assert main(["crop", "--header", str(tmp_path / "image.json"), "-o", str(tmp_path / "cut"), "-r", "1", "7"]) == 1
