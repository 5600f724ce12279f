import math

import numpy as np
import pytest

from gridloom.functions import Field, Param, shift_fields
from gridloom.operators.decomp import DomainDecomposition as D
from gridloom.operators.lattice import Lattice
from gridloom.plans.queries import QUERIES
from gridloom.operators.models import Expansion, ScalarSector, TensorPerturbationSector, get_rho_and_p
from gridloom.operators.multigrid import CubicInterpolation, FullApproximationScheme, FullWeighting, Injection, JacobiIterator, LinearInterpolation, MultiGridSolver, NewtonIterator, f_cycle, v_cycle, w_cycle
from gridloom.operators.reduction import Reduction
from gridloom.operators.stencil import SecondCenteredDifference
from gridloom.operators.step import LowStorageRK54, LowStorageRKStepper, RungeKutta4, all_steppers, more_steppers

f, rho = Field("f"), Field("rho")


def laplacian(field):
    total = None
    for d in (1, 2, 3):
        part = SecondCenteredDifference(1)(field, d)
        total = part if total is None else total + part
    return total / Param("dx") ** 2


@pytest.mark.parametrize("kind", all_steppers + more_steppers)
@pytest.mark.parametrize("n", [-1.0, -2.0, -3.0])
def test_order(kind, n):
    """y' = y^n from 1: halving the step divides the error by 2^order."""
    order = 2 if kind.__name__ in ("LowStorageRK3Symmetric", "LowStorageRK3PredictorCorrector") else kind.expected_order
    y = Field("y")
    errors = []
    for dt in (1 / 20, 1 / 40):
        state, stepper = {"y": 1.0}, kind({y: y**n})
        for _ in range(round(1 / dt)):
            state = stepper.step_array(state, dt=dt)
        errors.append(abs(state["y"] / ((1 - n) + 1) ** (1 / (1 - n)) - 1))
    assert errors[0] / errors[1] > 0.85 * 2**order


def test_step_frame_matches_arrays(spark):
    a, b = Field("a"), Field("b")
    df = spark.createDataFrame([(1.0, 2.0), (0.5, -1.0)], "a double, b double")
    for kind in (RungeKutta4, LowStorageRK54):
        stepper = kind({a: b * a, b: -1 * a + Param("c")})
        rows = stepper.step(df, dt=0.1, c=0.3).collect()
        for start, found in zip(df.collect(), rows, strict=True):
            wanted = stepper.step_array({"a": start.a, "b": start.b}, dt=0.1, c=0.3)
            assert found.a == pytest.approx(wanted["a"]) and found.b == pytest.approx(wanted["b"])
    with pytest.raises(ValueError):
        RungeKutta4({"a": 1})
    assert LowStorageRK54.times()[1] == pytest.approx(1432997174477 / 9575080441755)
    assert issubclass(LowStorageRK54, LowStorageRKStepper)


def test_cycles():
    assert v_cycle(10, 20, 3) == [(0, 10), (1, 10), (2, 10), (3, 20), (2, 20), (1, 20), (0, 20)]
    levels = [i for i, _ in w_cycle(10, 20, 3)]
    assert levels == [0, 1, 2, 3, 2, 3, 2, 1, 2, 3, 2, 3, 2, 1, 0]
    assert f_cycle(10, 20, 3) == [(0, 10), (1, 10), (2, 10), (3, 20), (2, 20), (3, 20), (2, 20), (1, 20), (2, 10), (3, 20), (2, 20), (1, 20), (0, 20)]


def test_transfers(spark):
    lattice = Lattice((8, 8, 8))
    a = np.random.default_rng(2).random(lattice.shape)
    df = D.scatter_array(spark, a, lattice, "f")
    coarse = lattice.coarser()
    assert np.array_equal(D.gather_array(Injection()(df, lattice, "f"), coarse, "f"), a[::2, ::2, ::2])
    w = a
    for axis in range(3):
        w = w / 2 + (np.roll(w, 1, axis) + np.roll(w, -1, axis)) / 4
    assert np.allclose(D.gather_array(FullWeighting()(df, lattice, "f"), coarse, "f"), w[::2, ::2, ::2])
    for kind, taps in ((LinearInterpolation, {-1: 0.5, 1: 0.5}), (CubicInterpolation, {-3: -1 / 16, -1: 9 / 16, 1: 9 / 16, 3: -1 / 16})):
        up = np.zeros(lattice.shape)
        up[::2, ::2, ::2] = a[::2, ::2, ::2]
        for axis in range(3):
            up = up + sum(c * np.roll(up, -d, axis) for d, c in taps.items())
        found = kind()(Injection()(df, lattice, "f"), lattice, "f")
        assert np.allclose(D.gather_array(found, lattice, "f"), up)


def test_relaxation_reduces_residual(spark):
    lattice = Lattice((8, 8, 8))
    a = np.random.default_rng(4).random(lattice.shape)
    df = D.scatter_array(spark, a - a.mean(), lattice, "rho").selectExpr("*", "0.0d as f")
    for solver in (JacobiIterator({f: (laplacian(f) - f, rho)}, omega=0.7), NewtonIterator({f: (laplacian(f) - f - f**3, rho)}, omega=0.7)):
        before = solver.get_error(df, lattice)["f"][1]
        after = solver.get_error(solver(df, lattice, iterations=5), lattice)["f"][1]
        assert after < 0.2 * before


@pytest.mark.parametrize("kind", [FullApproximationScheme, MultiGridSolver])
def test_multigrid_cycle(spark, kind):
    lattice = Lattice((8, 8, 8))
    a = np.random.default_rng(4).random(lattice.shape)
    df = D.scatter_array(spark, a - a.mean(), lattice, "rho").selectExpr("*", "0.0d as f")
    scheme = kind(JacobiIterator({f: (laplacian(f) - 0.2 * f, rho)}, omega=0.8))
    _, errors = scheme(df, lattice, v_cycle(2, 4, 1))
    assert errors[-1][1]["f"][1] < 0.05 * errors[0][1]["f"][1]
    with pytest.raises(ValueError):
        scheme(df, lattice, [(0, 1), (2, 1)])


@pytest.mark.parametrize("w", [0, 1 / 3, 1 / 2, 1, -1 / 4])
@pytest.mark.parametrize("kind", all_steppers)
def test_expansion_keeps_the_order(kind, w):
    """A fluid of pressure w rho follows its power law, and the constraint holds, to dt ** order at time 10."""
    energy, dt, t = (lambda a: a ** (-3 - 3 * w)), 0.005, 0.0
    x = Expansion(energy(1.0), kind, mpl=math.sqrt(8 * math.pi))
    while t <= 10 - dt:
        x.step_through(energy, lambda a: w * energy(a), dt)
        t += dt
    power = 1 + 3 * w
    exact = (power * (t / math.sqrt(3) + 2 / power) / 2) ** (2 / power)
    assert x.a == pytest.approx(exact, rel=dt**kind.expected_order)
    assert x.constraint(energy(x.a)) < dt**kind.expected_order


def test_expansion_of_a_constant_density():
    x, t = Expansion(3.0, RungeKutta4, mpl=math.sqrt(8 * math.pi)), 0.0
    for _ in range(40):
        x.step_through(lambda a: 3.0, lambda a: -3.0, 0.005)
        t += 0.005
    assert x.a == pytest.approx(1 / (1 - t), rel=1e-8) and x.constraint(3.0) < 1e-8


def test_preheating_obeys_the_constraint(spark, sf_dir):
    """Fields and background stepped together keep the first Friedmann equation to the stepper's order."""
    rows = sorted(QUERIES["preheating"](spark, sf_dir).collect())
    assert [r.step for r in rows] == [0, 1] and rows[0].a < rows[1].a and rows[0].energy > rows[1].energy
    assert all(r.miss < 1e-5 for r in rows)


def test_expansion_takes_stages_in_order():
    x = Expansion(1.0, RungeKutta4)
    x.step(0, 1.0, 0.0, 0.1)
    with pytest.raises(ValueError):
        x.step(2, 1.0, 0.0, 0.1)


def test_scalar_energy(spark):
    lattice = Lattice((4, 4, 4))
    rng = np.random.default_rng(9)
    names = ["f_0", "f_1", "dfdt_0", "dfdt_1", "lap_f_0", "lap_f_1"]
    arrays, df = {n: rng.random(lattice.shape) for n in names}, None
    for n, x in arrays.items():
        one = D.scatter_array(spark, x, lattice, n)
        df = one if df is None else df.join(one, ["i", "j", "k"])
    sector = ScalarSector(2, potential=lambda y: y[0] ** 2 * y[1] ** 2 / 2)
    found = Reduction(lattice, [sector], callback=get_rho_and_p)(df, a=1.3)
    kinetic = [(arrays[f"dfdt_{n}"] ** 2).mean() / 2 / 1.69 for n in (0, 1)]
    potential = (arrays["f_0"] ** 2 * arrays["f_1"] ** 2 / 2).mean()
    gradient = [-(arrays[f"f_{n}"] * arrays[f"lap_f_{n}"]).mean() / 2 / 1.69 for n in (0, 1)]
    assert np.allclose(found["kinetic"], kinetic) and np.allclose(found["gradient"], gradient)
    assert found["total"] == pytest.approx(sum(kinetic) + potential + sum(gradient))
    assert found["pressure"] == pytest.approx(sum(kinetic) - potential - sum(gradient) / 3)
    assert len(TensorPerturbationSector([sector]).rhs_dict) == 12


@pytest.mark.parametrize("outer", [(), ("run",)])
def test_sweeps_by_lines_equal_sweeps_by_cells(spark, outer):
    """Uneven axes, a nonlinear operator with reads across two axes and two cells, outer keys, and a column that isn't a number."""
    from pyspark.sql import functions as F

    from gridloom.operators import lines

    lattice = Lattice((2, 4, 6), outer=outer)
    i, j, k = (F.col(a) for a in "ijk")
    df = lattice.grid(spark).select("i", "j", "k", F.sin(i + 2 * j + 3 * k).alias("f"), (i * j - k).cast("int").alias("g"), F.concat(F.lit("c"), k).alias("label"))
    if outer:
        df = df.crossJoin(spark.range(2).withColumnRenamed("id", "run")).withColumn("f", F.col("f") + F.col("run"))
    f, g = Field("f"), Field("g")
    lhs = shift_fields(f, (1, 0, 0)) + shift_fields(f, (-1, 0, 0)) + shift_fields(f, (0, 1, -1)) + shift_fields(f, (0, 0, 2)) * 0.5 - 6 * f - f**3
    solver = NewtonIterator({f: (lhs, g)}, omega=0.5, halo_shape=2)
    assert lines.fits({"f": lhs}, {"omega": 0.5}) and not lines.fits({"f": f + Field("c", indices=())}, {}) and not lines.fits({"f": f}, {"a": F.lit(1)})
    found = solver(df, lattice, iterations=2)
    assert found.columns == df.columns and [t for _, t in found.dtypes] == [t for _, t in df.dtypes]
    cells = solver.sweep(solver.sweep(df, lattice), lattice)
    key = lambda r: tuple(r[c] for c in lattice.keys)
    wanted = {key(r): r for r in cells.collect()}
    rows = found.collect()
    assert len(rows) == len(wanted) == lattice.cells * (2 if outer else 1)
    for r in rows:
        assert r.f == pytest.approx(wanted[key(r)].f, rel=1e-12, abs=1e-12) and (r.g, r.label) == (wanted[key(r)].g, f"c{r.k}")


def test_lines_without_a_cell_raise(spark):
    from gridloom.operators import lines

    lattice = Lattice((2, 2, 4))
    holed = lattice.grid(spark).where("not (i = 1 and j = 1 and k = 2)").selectExpr("i", "j", "k", "1.0d as f")
    with pytest.raises(Exception, match="reshape"):
        lines.sweep(lines.pack(holed, lattice), lattice, {"f": Field("f") * 2}, {}).collect()


def test_cycle_without_errors(spark):
    lattice = Lattice((4, 4, 4))
    df = lattice.grid(spark).selectExpr("i", "j", "k", "0.0d as f", "cos(i) as g")
    f = Field("f")
    lap = sum((shift_fields(f, tuple(s * (a == n) for n in range(3))) for a in range(3) for s in (1, -1)), -6 * f)
    kinds = [MultiGridSolver(JacobiIterator({f: (lap / Param("dx") ** 2 - f, Field("g"))}, omega=0.75), log_errors=log) for log in (True, False)]
    (a, errors), (b, none) = (kind(df, lattice, v_cycle(2, 2, 1)) for kind in kinds)
    assert len(errors) == 6 and none == []
    assert {(r.i, r.j, r.k): round(r.f, 9) for r in a.collect()} == {(r.i, r.j, r.k): round(r.f, 9) for r in b.collect()}
