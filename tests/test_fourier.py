import numpy as np
import pytest

from gridloom.operators.decomp import DomainDecomposition as D
from gridloom.operators.fourier import DFT, PowerSpectra, Projector, RayleighGenerator, SpectralCollocator, SpectralPoissonSolver, make_hermitian
from gridloom.operators.lattice import Lattice
from gridloom.operators.stencil import FiniteDifferencer, SecondCenteredDifference

SHAPE = (8, 6, 4)


@pytest.fixture(scope="module")
def setup(spark):
    lattice = Lattice(SHAPE, (10.0, 8.0, 11.5))
    rng = np.random.default_rng(7)
    arrays = {n: rng.random(SHAPE) for n in "abc"}
    df = None
    for n, x in arrays.items():
        one = D.scatter_array(spark, x, lattice, n)
        df = one if df is None else df.join(one, ["i", "j", "k"])
    return df.cache(), lattice, arrays, DFT(lattice)


def modes_of(frame, name, shape):
    rows = frame.toPandas()
    out = np.zeros(shape, complex)
    place = tuple(rows[m].to_numpy() % n for m, n in zip(("kx", "ky", "kz"), SHAPE, strict=True))
    out[place] = rows[f"{name}_re"] + 1j * rows[f"{name}_im"]
    return out


def test_transforms_match_numpy(setup, spark):
    df, lattice, x, fft = setup
    modes = fft.dft(df, "a", "b").cache()
    for n in "ab":
        assert np.allclose(modes_of(modes, n, fft.mode_shape), np.fft.rfftn(x[n]))
    back = fft.idft(modes, "a")
    assert np.allclose(D.gather_array(back, lattice, "a"), x["a"] * lattice.cells)
    z = DFT(lattice, is_real=False)
    both = df.selectExpr("i", "j", "k", "a as z_re", "b as z_im")
    assert np.allclose(modes_of(z.dft(both, "z"), "z", SHAPE), np.fft.fftn(x["a"] + 1j * x["b"]))
    assert np.allclose(D.gather_array(z.idft(z.dft(both, "z"), "z"), lattice, "z_im"), x["b"] * lattice.cells)
    with pytest.raises(ValueError):
        DFT(Lattice((5, 4, 4)))


def test_spectra(setup):
    df, lattice, x, fft = setup
    s = PowerSpectra(fft)
    rows = sorted(s(df, "a").collect())
    k = np.sqrt(sum((d * q) ** 2 for d, q in zip(fft.dk, np.meshgrid(*[np.where(np.arange(n) <= n // 2, np.arange(n), np.arange(n) - n) for n in SHAPE], indexing="ij"), strict=True)))
    p = abs(np.fft.fftn(x["a"])) ** 2 * k**3
    edges = (np.arange(s.num_bins + 1) - 0.5) * s.bin_width
    counts, power = np.histogram(k, edges)[0], np.histogram(k, edges, weights=p)[0]
    assert [r.modes for r in rows] == counts[counts > 0].tolist()
    assert np.allclose([r.a for r in rows], power[counts > 0] / counts[counts > 0] * s.norm)


@pytest.mark.parametrize("h", [0, 2])
def test_vector_projections(setup, h):
    df, lattice, x, fft = setup
    v = ("a", "b", "c")
    p = Projector(fft, h)
    modes = fft.zero_corner_modes(fft.dft(df, *v), *v).cache()
    flat = p.transversify(modes, v)
    k = [np.array(fft_k) for fft_k in momenta(fft, p)]
    div = sum(k[n] * modes_of(flat, v[n], fft.mode_shape) for n in range(3))
    assert abs(div).max() < 1e-11
    back = p.pol_to_vec(p.vec_to_pol(flat, v), v)
    for n in v:
        assert np.allclose(modes_of(back, n, fft.mode_shape), modes_of(flat, n, fft.mode_shape), atol=1e-11)
    some = (abs(k[0]) + abs(k[1]) + abs(k[2])) > 1e-12
    for flag in (False, True):
        whole = p.decomp_to_vec(p.decompose_vector(modes, v, flag), v, flag)
        for n in v:
            assert np.allclose(modes_of(whole, n, fft.mode_shape)[some], modes_of(modes, n, fft.mode_shape)[some], atol=1e-10)


def momenta(fft, p):
    from gridloom.operators.stencil import FirstCenteredDifference

    out = []
    for axis, (n, dk, dx) in enumerate(zip(fft.lattice.shape, fft.dk, fft.lattice.spacing, strict=True)):
        q = np.where(np.arange(n) <= n // 2, np.arange(n), np.arange(n) - n)
        k = FirstCenteredDifference(p.effective_k).get_eigenvalues(dk * q, dx) if p.effective_k else dk * q.astype(float)
        k = np.where((abs(q) == n // 2) | (q == 0), 0.0, k)[: fft.mode_shape[axis]]
        out.append(k.reshape([-1 if a == axis else 1 for a in range(3)]) * np.ones(fft.mode_shape))
    return out


def test_tensor_projection(setup):
    df, lattice, x, fft = setup
    names = tuple(f"h{n}" for n in range(6))
    df = df.selectExpr("i", "j", "k", "a as h0", "b as h1", "c as h2", "a - b as h3", "b * c as h4", "a * c as h5")
    p = Projector(fft)
    flat = p.transverse_traceless(fft.dft(df, *names), names).cache()
    h = [modes_of(flat, n, fft.mode_shape) for n in names]
    k = momenta(fft, p)
    assert abs(h[0] + h[3] + h[5]).max() < 1e-11
    for row in ((0, 1, 2), (1, 3, 4), (2, 4, 5)):
        assert abs(sum(k[m] * h[c] for m, c in enumerate(row))).max() < 1e-10
    back = p.pol_to_tensor(p.tensor_to_pol(flat, names), names)
    for n, wanted in zip(names, h, strict=True):
        assert np.allclose(modes_of(back, n, fft.mode_shape), wanted, atol=1e-10)
    s = PowerSpectra(fft)
    total = {r.bin: r.gw for r in s.gw(df, names, p, 2.0).collect()}
    parts = {r.bin: r.plus + r.minus for r in s.gw_polarization(df, names, p, 2.0).collect()}
    assert all(np.isclose(total[b], parts[b], rtol=1e-8, atol=1e-14) for b in total)
    vector = {r.bin: r for r in s.vector_decomposition(df, names[:3], p).collect()}
    pol = {r.bin: r for r in s.polarization(df, names[:3], p).collect()}
    assert all(np.isclose(vector[b].plus, pol[b].plus) for b in pol)


def test_collocation(spark):
    lattice = Lattice((8, 8, 8), (3.0, 5.0, 7.0))
    k = 2 * np.pi * np.array([2, -3, 1]) / np.array(lattice.lengths)
    phase = np.tensordot(k, np.indices(lattice.shape) * np.array(lattice.spacing)[:, None, None, None], 1)
    df = D.scatter_array(spark, np.sin(phase), lattice, "f")
    out = SpectralCollocator(DFT(lattice))(df, "f", lap="lap", grd=("dx", "dy", "dz")).cache()
    for n, name in enumerate(("dx", "dy", "dz")):
        assert np.allclose(D.gather_array(out, lattice, name), k[n] * np.cos(phase))
    assert np.allclose(D.gather_array(out, lattice, "lap"), -(k**2).sum() * np.sin(phase))
    v = SpectralCollocator(DFT(lattice)).divergence(out, ("dx", "dy", "dz"), "div")
    assert np.allclose(D.gather_array(v, lattice, "div"), D.gather_array(out, lattice, "lap"))


@pytest.mark.parametrize("m2", [0.0, 1.2])
def test_poisson_residual(setup, m2):
    df, lattice, x, fft = setup
    rho = x["a"] - x["a"].mean()
    source = D.scatter_array(df.sparkSession, rho, lattice, "rho")
    solved = SpectralPoissonSolver(fft, SecondCenteredDifference(2).get_eigenvalues)(source, "rho", "f", m2)
    lap = FiniteDifferencer(lattice, 2)(solved, "f", lap="lap")
    residual = D.gather_array(lap, lattice, "lap") - m2 * D.gather_array(lap, lattice, "f") - rho
    assert abs(residual).max() < 1e-11


def test_random_fields(spark):
    from pyspark.sql import functions as F

    lattice = Lattice((16, 16, 16), (5.0, 5.0, 5.0))
    fft = DFT(lattice)
    r = RayleighGenerator(spark, fft, 5123)
    modes = r.generate("r", lambda k: F.pow(k, F.lit(-2.0))).cache()
    again = r.generate("r", lambda k: F.pow(k, F.lit(-2.0))).repartition(5)
    key = ["kx", "ky", "kz", "r_re", "r_im"]
    assert sorted(modes.select(key).collect()) == sorted(again.select(key).collect())
    fixed = make_hermitian(modes, fft, "r")
    assert sorted((x.kx, x.ky, x.kz, round(x.r_re, 12), round(x.r_im, 12) + 0.0) for x in fixed.collect()) == sorted((x.kx, x.ky, x.kz, round(x.r_re, 12), round(x.r_im, 12) + 0.0) for x in modes.collect())
    spectrum = [x for x in sorted(PowerSpectra(fft)(fft.idft(modes, "r"), "r").collect()) if 3 <= x.bin <= 7]
    # P = 1 / (V k^2) a mode: the dimensionless spectrum is k / (2 pi^2).
    for x in spectrum:
        assert x.r == pytest.approx(x.bin * fft.dk[0] / (2 * np.pi**2), rel=0.3)
    wkb = r.init_WKB_fields("u", "dudt", lambda k: 1 / k, lambda k: k, hubble=0.1)
    assert wkb.count() == lattice.cells
    flat = r.init_transverse_vector(Projector(fft), ("x", "y", "z"), lambda k: 1 / k)
    div = SpectralCollocator(fft).divergence(flat, ("x", "y", "z"), "d")
    assert abs(D.gather_array(div, lattice, "d")).max() < 1e-10


def test_momenta_are_formulas(spark):
    """Effective momenta equal their tables, and only a callable puts a table into the plan."""
    from gridloom.operators.stencil import FirstCenteredDifference, SecondCenteredDifference

    fft = DFT(Lattice((4, 6, 8), (1.0, 2.0, 3.0)))
    modes = fft.grid(spark)
    for known, table in ((0, lambda k, dx: k), (2, lambda k, dx: FirstCenteredDifference(2).get_eigenvalues(k, dx)), (SecondCenteredDifference(1).get_eigenvalues, lambda k, dx: SecondCenteredDifference(1).get_eigenvalues(k, dx))):
        for zero in (True, False):
            formulas = fft.effective(known, zero)
            assert not any("array(" in str(c) for c in formulas)
            rows = modes.select(*[c.alias(f"a{n}") for n, c in enumerate(formulas)], *[c.alias(f"b{n}") for n, c in enumerate(fft.effective(table, zero))]).collect()
            assert len(rows) == 4 * 6 * 5 and all(abs(r[n] - r[n + 3]) < 1e-12 for r in rows for n in range(3))
