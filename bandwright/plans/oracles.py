"""The same results in DuckDB SQL."""

from .queries import COLUMNS, DEVS, GIVEN, WEIGHTS

_P = "with p as (select vec_id, generate_subscripts(embedding, 1)::bigint - 1 as band, unnest(embedding)::double as x from embeddings)"


def _table(name: str, values: list[float]) -> str:
    return f"{name}(band, {name}v) as (values {', '.join(f'({i}::bigint, {v!r}::double)' for i, v in enumerate(values))})"


_G, _D = _table("g", GIVEN), _table("d", DEVS)
_W = "w(k, band, wv) as (values " + ", ".join(f"({k}::bigint, {i}::bigint, {v!r}::double)" for k, r in enumerate(WEIGHTS) for i, v in enumerate(r)) + ")"


def _r(x: str, digits: int = 6, name: str = "value") -> str:
    return f"round({x}, {digits}) + 0.0::double as {name}"


def _pairs(cell, digits: int) -> str:
    rows = [f"select {i}::bigint as i, {j}::bigint as j, {_r(cell(i, j), digits)} from lineitem" for i in range(4) for j in range(4)]
    return " union all ".join(rows)


def _crop(r: tuple[int, int] | None, c: tuple[int, int] | None) -> str:
    r0, c0 = (r or (0, 0))[0], (c or (0, 0))[0]
    width = c[1] - c[0] if c else 25
    keep = " and ".join(["true"] + ([f"vec_id // 25 >= {r[0]} and vec_id // 25 < {r[1]}"] if r else []) + ([f"vec_id % 25 >= {c[0]} and vec_id % 25 < {c[1]}"] if c else []))
    return f"{_P} select ((vec_id // 25 - {r0}) * {width} + vec_id % 25 - {c0})::bigint as pixel_id, band, {_r('x')} from p where {keep}"


def _bsq_z() -> str:
    return f"{_P}, {_G}, {_D}, z as (select vec_id, band, x, (x - gv) / dv as zx from p join g using (band) join d using (band))"


_MU, _SD = [25.0, 1000.0, 0.05, 0.04], [15.0, 2000.0, 0.03, 0.02]
_RGB = ", ".join(f"greatest(0.0, least(255.0, floor((embedding[{b + 1}]::double + 0.25) / 0.5 * 255.0 + 0.5)))::integer as {n}" for b, n in ((5, "r"), (17, "g"), (40, "b")))
_COV = f"{_P} select a.band as i, b.band as j, {_r('covar_pop(a.x, b.x)')} from p a join p b using (vec_id) group by 1, 2"
_TRANSFORM = f"{_P}, {_W} select vec_id as pixel_id, k as band, {_r('sum(x * wv)')} from p join w using (band) group by 1, 2"

ORACLES = {
    "band_means_embeddings": f"{_P} select band, {_r('avg(x)')} from p group by band",
    "band_stddevs_embeddings": f"{_P} select band, {_r('stddev_pop(x)')} from p group by band",
    "band_stddevs_given_means": f"{_P}, {_G} select band, {_r('sqrt(avg((x - gv) * (x - gv)))')} from p join g using (band) group by band",
    "band_means_lineitem": " union all ".join(f"select {i}::bigint as band, {_r(f'avg({c})', 2)} from lineitem" for i, c in enumerate(COLUMNS)),
    "band_stddevs_lineitem": " union all ".join(f"select {i}::bigint as band, {_r(f'stddev_pop({c})', 2)} from lineitem" for i, c in enumerate(COLUMNS)),
    "band_means_events": f"select 0::bigint as band, {_r('avg(value)')} from events where value is not null",
    "second_moment_lineitem": _pairs(lambda i, j: f"avg({COLUMNS[i]} * {COLUMNS[j]})", 2),
    "cov_lineitem": _pairs(lambda i, j: f"covar_pop({COLUMNS[i]}, {COLUMNS[j]})", 2),
    "cov_given_means_lineitem": _pairs(lambda i, j: f"avg(({COLUMNS[i]} - {_MU[i]}::double) * ({COLUMNS[j]} - {_MU[j]}::double))", 2),
    "scaled_moment_lineitem": _pairs(lambda i, j: f"avg({COLUMNS[i]} * {COLUMNS[j]}) / ({_SD[i]}::double * {_SD[j]}::double)", 2),
    "corr_lineitem": _pairs(lambda i, j: f"covar_pop({COLUMNS[i]}, {COLUMNS[j]}) / (stddev_pop({COLUMNS[i]}) * stddev_pop({COLUMNS[j]}))", 6),
    "cov_embeddings": _COV,
    "cov_embeddings_arrow": _COV,
    "crop_rect": _crop((2, 9), (3, 11)),
    "crop_rows": _crop((4, 8), None),
    "crop_cols": _crop(None, (20, 25)),
    "crop_none": _crop(None, None),
    "crop_empty": _crop((3, 3), None),
    "crop_then_means": f"{_P} select band, {_r('avg(x)')} from p where vec_id // 25 >= 2 and vec_id // 25 < 9 and vec_id % 25 >= 3 and vec_id % 25 < 11 group by band",
    "standardize_embeddings": f"{_P}, {_G}, {_D} select vec_id as pixel_id, band, {_r('(x - gv) / dv')} from p join g using (band) join d using (band)",
    "transform_k3": _TRANSFORM,
    "transform_k3_batches": _TRANSFORM,
    "transform_k3_standardized": f"{_P}, {_W}, {_G}, {_D} select vec_id as pixel_id, k as band, {_r('sum((x - gv) / dv * wv)')} from p join w using (band) join g using (band) join d using (band) group by 1, 2",
    "rgb_linear": f"select vec_id as pixel_id, {_RGB} from embeddings",
    "rgb_batched": f"select vec_id as pixel_id, {_RGB} from embeddings",
    "bsq_transpose": f"{_P} select band, vec_id // 65536 as block, string_agg(round(x * 1e6)::bigint::varchar, ',' order by vec_id) as values from p group by 1, 2",
    "bsq_mean": f"{_P} select band, {_r('avg(x)')} from p group by band",
    "bsq_stddev": f"{_P}, {_G} select band, {_r('sqrt(avg((x - gv) * (x - gv)))')} from p join g using (band) group by band",
    "bsq_variance": f"{_bsq_z()} select band, {_r('avg(zx * zx)')} from z group by band",
    "bsq_covariance": f"{_bsq_z()} select {_r('avg(a.zx * b.zx)')} from z a join z b using (vec_id) where a.band = 3 and b.band = 8",
    "pca_eigenvalues_2band": f"select 0::bigint as component, {_r('1 + abs(corr(l_discount, l_tax))')} from lineitem union all select 1::bigint, {_r('1 - abs(corr(l_discount, l_tax))')} from lineitem",
}

_LONG = f"{_P} select vec_id as pixel_id, band, {_r('x')} from p"
ORACLES |= {
    "pca_trace_embeddings": f"{_P} select {_r('sum(v)')} from (select band, var_pop(x) as v from p group by band)",
    "pca_residuals_embeddings": "select i::bigint as component, 0.0::double as value from range(8) t(i)",
    "pca_score_covariance": "select a.i::bigint as i, b.j::bigint as j, (case when a.i = b.j then 1.0 else 0.0 end)::double as value from range(3) a(i), range(3) b(j)",
    "bip_roundtrip": _LONG,
    "bip_records_roundtrip": _LONG,
    "bsq_roundtrip": _LONG,
    "bip_places": "select vec_id as pixel_id, (vec_id // 25)::integer as line, (vec_id % 25)::integer as sample, len(embedding)::integer as n from embeddings",
    "bip_means": ORACLES["band_means_embeddings"],
    "stats_json_roundtrip": ORACLES["band_means_embeddings"],
    "bip_stddevs": ORACLES["band_stddevs_embeddings"],
    "bip_stddevs_given_means": ORACLES["band_stddevs_given_means"],
    "bip_covariance": _COV,
    "bip_crop": _crop((2, 9), (3, 11)),
    "bip_crop_file": _crop((2, 9), (3, 11)),
    "bip_map_file": f"{_P}, {_W} select vec_id as pixel_id, k as band, {_r('sum(x * wv)::float::double', 4)} from p join w using (band) group by 1, 2",
    "header_roundtrip": "select 64::bigint as channels, (count(*) // 25)::bigint as lines, 25::bigint as pixels, 'Bip' as format, (count(*) * 64 * 4)::bigint as bytes, ((25 + 2) * 64 * 4)::bigint as offset_1_2, (3 * count(*))::bigint as channel_3 from embeddings",
    "fold_embeddings": f"{_P} select band, {_r('min(x)', name='low')}, {_r('max(x)', name='high')}, {_r('sum(x * x)', name='square')} from p group by band",
}
