"""Queries over whole tables: no event is left out, whatever the count."""

import math

import duckdb
import numpy as np
import pytest

from gridloom.plans.queries import QUERIES
from gridloom.sources.tables import even_shape, event_lattice


@pytest.fixture(scope="module")
def events(sf_dir):
    return duckdb.sql(f"SELECT CAST(round(value * 100) AS BIGINT) AS f, CAST(json_extract_string(props, '$.k') AS INT) AS g FROM '{sf_dir}/events.parquet' ORDER BY event_id").fetchnumpy()


def test_even_shape():
    assert [even_shape(n) for n in (1000, 10_000, 100_000)] == [(10, 10, 10), (10, 20, 50), (40, 50, 50)]
    for n in (1, 7, 9, 997, 32_771, 1_000_003):
        shape = even_shape(n)
        assert math.prod(shape) >= n and not any(x % 2 for x in shape) and max(shape) <= 5 * min(shape)


@pytest.mark.parametrize("n", [1000, 997])
def test_no_event_is_left_out(spark, sf_dir, tmp_path, n):
    spark.read.parquet(f"{sf_dir}/events.parquet").where(f"event_id < {n}").write.parquet(f"{tmp_path}/events.parquet")
    cells, lattice = event_lattice(spark, str(tmp_path))
    assert cells.select("i", "j", "k").distinct().count() == cells.count() == lattice.cells == 1000
    total = spark.read.parquet(f"{tmp_path}/events.parquet").selectExpr("sum(cast(round(value * 100) as bigint))").first()[0]
    assert cells.agg({"f": "sum"}).first()[0] == total


def test_modes_of_all_events(spark, sf_dir, events):
    wanted = np.fft.rfftn(events["f"].astype(float).reshape(10, 10, 10))
    rows = QUERIES["dft_r2c"](spark, sf_dir).collect()
    assert len(rows) == wanted.size
    for r in rows:
        assert abs(wanted[r.kx, r.ky, r.kz] - complex(r.f_re, r.f_im)) < 1


def test_statistics_of_all_events(spark, sf_dir, events):
    assert QUERIES["field_stats"](spark, sf_dir).first().mean == pytest.approx(events["f"].mean(), abs=1e-5)
    assert sum(r.linear for r in QUERIES["hist_linear"](spark, sf_dir).collect()) == len(events["f"])


def test_products_cover_every_line(spark, sf_dir, events):
    wanted = (1 + events["g"].astype(float) / 100).reshape(10, 10, 10).prod(axis=2)
    rows = QUERIES["reduce_prod"](spark, sf_dir).collect()
    assert len(rows) == 100
    for r in rows:
        assert r.p_0 == pytest.approx(wanted[r.i, r.j] / 10.0 ** math.floor(math.log10(wanted[r.i, r.j])), abs=1e-7)


def test_zeroed_corners_and_no_other_mode(spark, sf_dir, events):
    wanted = np.fft.rfftn(events["f"].astype(float).reshape(10, 10, 10))
    rows = QUERIES["zero_corner"](spark, sf_dir).collect()
    assert len(rows) == wanted.size
    for r in rows:
        corner = all(k % 5 == 0 for k in (r.kx, r.ky, r.kz))
        assert abs(complex(r.f_re, r.f_im) - (0 if corner else wanted[r.kx, r.ky, r.kz])) < 1


def test_parts_of_every_mode(spark, sf_dir, events):
    f, g = (events[c].astype(float).reshape(10, 10, 10) for c in "fg")
    fields = np.stack([np.fft.rfftn(x) for x in (f, g, f - g)])
    rows = QUERIES["decompose_vector"](spark, sf_dir).collect()
    assert len(rows) == fields[0].size
    for r in rows:
        v = fields[:, r.kx, r.ky, r.kz]
        # The eigenvalue of the first difference over two cells; cells are one apart.
        k = np.array([0.0 if abs(n) in (0, 5) else math.sin(2 * math.pi * n / 10) for n in (r.kx, r.ky, r.kz)])
        size, flat = np.linalg.norm(k), math.hypot(k[0], k[1])
        if size == 0:
            eps, lng = np.zeros(3), 0
        else:
            lng = -1j * (k @ v) / size**2
            if flat == 0:
                eps = np.array([1, 1j, 0]) / math.sqrt(2)
            else:
                eps = np.array([k[0] * k[2] / size - 1j * k[1], k[1] * k[2] / size + 1j * k[0], -(flat**2) / size]) / flat / math.sqrt(2)
        found = [complex(r.plus_re, r.plus_im), complex(r.minus_re, r.minus_im), complex(r.lng_re, r.lng_im)]
        assert np.allclose(found, [v @ eps.conj(), v @ eps, lng], atol=0.02)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf_dir):
    """What isn't wanted isn't read; cell numbers stay integers; random vectors need no join."""
    lap = plan_of(QUERIES["laplacian_h1"](spark, sf_dir))
    assert "props" not in lap and "FLOOR" not in lap and lap.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan_of(QUERIES["random_vector_pol"](spark, sf_dir))
