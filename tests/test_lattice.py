import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import Field, call, shift_fields
from gridloom.operators import decomp
from gridloom.operators.decomp import DomainDecomposition
from gridloom.operators.histogram import FieldHistogrammer, Histogrammer
from gridloom.operators.lattice import Lattice
from gridloom.operators.maps import ElementWiseMap
from gridloom.operators.reduction import FieldStatistics, Reduction
from gridloom.operators.stencil import FiniteDifferencer, FirstCenteredDifference, SecondCenteredDifference, Stencil, StreamingStencil

f, g = Field("f"), Field("g")
SHAPE = (8, 4, 6)


@pytest.fixture(scope="module")
def field(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random(SHAPE), rng.random(SHAPE) - 0.3
    lattice = Lattice(SHAPE, (3.0, 5.0, 7.0))
    df = DomainDecomposition.scatter_array(spark, a, lattice, "f").join(DomainDecomposition.scatter_array(spark, b, lattice, "g"), ["i", "j", "k"]).cache()
    return df, lattice, a, b


def array(df, lattice, column):
    return DomainDecomposition.gather_array(df, lattice, column)


def test_map_order(field):
    df, lattice, a, b = field
    t = call("exp", f)
    out = ElementWiseMap([(f, f + 1), (g, g * f)], tmp_instructions=[("t", t)])(df)
    assert np.allclose(array(out, lattice, "f"), a + 1) and np.allclose(array(out, lattice, "g"), b * (a + 1))
    with pytest.raises(ValueError):
        ElementWiseMap({f: shift_fields(f, (1, 0, 0))})(df)


def test_linear_and_nonlinear_stencils(field):
    df, lattice, a, b = field
    up = lambda x, axis, s: np.roll(x, -s, axis)
    linear = Stencil({"y": shift_fields(f, (1, 0, 0)) * 2 - shift_fields(g, (0, -1, 2)) / 4}, 2)(df, lattice)
    assert np.allclose(array(linear, lattice, "y"), 2 * up(a, 0, 1) - up(up(b, 1, -1), 2, 2) / 4)
    assert np.allclose(array(linear, lattice, "f"), a)
    product = StreamingStencil({"y": shift_fields(f, (0, 0, -1)) * f**2}, 1, prefetch_args=["f"])(df, lattice)
    assert np.allclose(array(product, lattice, "y"), up(a, 2, -1) * a**2)
    with pytest.raises(ValueError):
        Stencil({"y": shift_fields(f, (2, 0, 0))}, 1)
    with pytest.raises(NotImplementedError):
        StreamingStencil({}, 1, prefetch_args=["f", "g"])


@pytest.mark.parametrize("h", [1, 2, 3, 4])
def test_plane_wave_eigenvalues(spark, h):
    lattice = Lattice((16, 16, 16), (3.0, 5.0, 7.0))
    modes = np.array([-5, 4, -3])
    k = 2 * np.pi * modes / np.array(lattice.lengths)
    x = np.indices(lattice.shape) * np.array(lattice.spacing)[:, None, None, None]
    phase = np.tensordot(k, x, 1)
    df = DomainDecomposition.scatter_array(spark, np.sin(phase), lattice, "f")
    out = FiniteDifferencer(lattice, h)(df, "f", lap="lap", grd=("dx", "dy", "dz"))
    for axis, name in enumerate(("dx", "dy", "dz")):
        eigen = FirstCenteredDifference(h).get_eigenvalues(k[axis], lattice.spacing[axis])
        assert np.allclose(array(out, lattice, name), eigen * np.cos(phase), atol=1e-9)
    eigen = sum(SecondCenteredDifference(h).get_eigenvalues(k[a], lattice.spacing[a]) for a in range(3))
    assert np.allclose(array(out, lattice, "lap"), eigen * np.sin(phase), atol=1e-9)
    assert abs(FirstCenteredDifference(h).get_eigenvalues(0.01, 1.0) - 0.01) < 1e-6


def test_reductions(field):
    df, lattice, a, b = field
    r = Reduction(lattice, {"x": [f, (f * g, "sum")], "y": [(f, "max"), (g, "min"), (1 + f, "prod")]})(df)
    assert np.allclose(r["x"], [a.mean(), (a * b).sum()]) and np.allclose(r["y"], [a.max(), b.min(), np.prod(1 + a)])
    s = FieldStatistics(lattice, max_min=True)(df, "g")[0]
    assert np.allclose([s["mean"], s["variance"], s["max"], s["min"], s["abs_max"], s["abs_min"]], [b.mean(), b.var(), b.max(), b.min(), abs(b).max(), abs(b).min()])
    with pytest.raises(NotImplementedError):
        Reduction(lattice, {"x": [(f, "median")]})


def test_histograms(field, spark):
    df, lattice, a, b = field
    rows = sorted(Histogrammer(lattice, {"n": (f * 10, 1), "w": (f * 10, g)}, 12)(df).collect())
    assert [r.n for r in rows] == np.histogram(a, 12, (0, 1.2))[0].tolist()
    assert np.allclose([r.w for r in rows], np.histogram(a, 12, (0, 1.2), weights=b)[0])
    rows = sorted(FieldHistogrammer(lattice, 7)(df, "g").collect())
    assert [r.linear for r in rows] == np.histogram(b, 7)[0].tolist() and sum(r.log for r in rows) == b.size
    flat = df.selectExpr("i", "j", "k", "0.0d as f")
    rows = sorted(FieldHistogrammer(lattice, 3)(flat, "f").collect())
    assert [r.linear for r in rows] == [b.size, 0, 0] and [r.log for r in rows] == [0, 0, 0]
    assert FieldHistogrammer(lattice, 3)(flat.limit(0), "f").count() == 3


def test_outer_keys_keep_fields_apart(spark):
    rng = np.random.default_rng(5)
    a = rng.random((2, 4, 4, 4))
    lattice = Lattice((4, 4, 4), outer=("c",))
    one = Lattice((4, 4, 4))
    df = None
    for c in range(2):
        part = DomainDecomposition.scatter_array(spark, a[c], one, "f").selectExpr(f"{c} as c", "*")
        df = part if df is None else df.unionByName(part)
    out = FiniteDifferencer(lattice, 1)(df, "f", lap="lap")
    for c in range(2):
        wanted = sum(np.roll(a[c], s, x) for x in range(3) for s in (1, -1)) - 6 * a[c]
        assert np.allclose(array(out.where(f"c = {c}"), one, "lap"), wanted)
    stats = {r.c: r.mean for r in FieldStatistics(lattice).frame(df, "f").collect()}
    assert np.allclose([stats[0], stats[1]], a.mean(axis=(1, 2, 3)))


def test_uneven_blocks_and_halos(spark):
    lattice = Lattice((7, 5, 3))
    d = DomainDecomposition((3, 2, 1), (2, 0, 1), lattice.shape)
    assert [d.get_rank_shape_start((r, 0, 0)) for r in range(3)] == [((3, 3, 3), (0, 0, 0)), ((2, 3, 3), (3, 0, 0)), ((2, 3, 3), (5, 0, 0))]
    assert d.rankID(-1, 2, 0) == d.rankID(2, 0) == 4 and d.rank_tuple(4) == (2, 0, 0)
    a = np.random.default_rng(1).random(lattice.shape)
    df = d.scatter_array(spark, a, lattice, "f")
    padded = d.share_halos(df, lattice)
    for r in padded.collect():
        bi, bj, bk = d.rank_tuple(r.block)
        _, start = d.get_rank_shape_start((bi, bj, bk))
        assert a[(r.i + start[0]) % 7, (r.j + start[1]) % 5, (r.k + start[2]) % 3] == r.f
    shapes = [d.get_rank_shape_start(d.rank_tuple(b))[0] for b in range(6)]
    assert padded.count() == sum((x + 4) * y * (z + 2) for x, y, z in shapes)
    assert np.array_equal(array(d.remove_halos(padded, lattice), lattice, "f"), a)
    assert d.restore_halos(df, lattice).where("f is null").count() == padded.count() - a.size
    with pytest.raises(NotImplementedError):
        DomainDecomposition((1, 1, 2), 0, (4, 4, 4))
    with pytest.raises(ValueError):
        DomainDecomposition((1, 1, 1), 0)


@pytest.mark.parametrize("most_held", [1 << 24, 0])
def test_arrays_pass_the_driver_in_parts(spark, monkeypatch, most_held):
    """Integers beyond a double's precision and cells without a value go there and back, a bounded number at a time."""
    monkeypatch.setattr(decomp, "PART", 64)
    monkeypatch.setattr(decomp, "RUN", 16)
    monkeypatch.setattr(decomp, "MOST_HELD", most_held)
    sent, create = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: sent.append(data) or create(self, data, *a, **k))
    lattice = Lattice(SHAPE)
    df = lattice.grid(spark).withColumn("v", F.when(F.col("k") != 5, F.lit(1 << 60) + lattice.cell_id()))
    wanted = {(r.i, r.j, r.k): r.v for r in df.collect()}
    cells = DomainDecomposition.gather_array(df.where("k <> 4"), lattice, "v")
    assert cells.dtype == np.int64 and np.array_equal(np.ma.getmaskarray(cells), np.broadcast_to(np.arange(6) >= 4, SHAPE))
    back = DomainDecomposition.scatter_array(spark, cells, lattice, "v")
    assert {(r.i, r.j, r.k): r.v for r in back.collect()} == {at: v if at[2] < 4 else None for at, v in wanted.items()}
    assert len(sent) == 3 and max(sum(map(len, part["data"].to_pylist())) for part in sent) <= 64 * 8
    with pytest.raises(ValueError):
        DomainDecomposition.gather_array(df.unionByName(df.where("i = 0 and k < 2")), lattice, "v")
