"""Queries over the lattices of the test tables, one or more for each operator."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import Compare, Field, If, LogicalAnd, Param, call, diff, field_args, index_fields, loop_domain, lower, shift_fields, simplify, substitute
from ..operators.decomp import DomainDecomposition
from ..operators.fourier import DFT, PowerSpectra, Projector, RayleighGenerator, SpectralCollocator, SpectralPoissonSolver, make_hermitian
from ..operators.histogram import FieldHistogrammer, Histogrammer
from ..operators.lattice import Lattice
from ..operators.maps import ElementWiseMap
from ..operators.lineage import cut
from ..operators.models import Expansion, ScalarSector, TensorPerturbationSector, get_rho_and_p
from ..operators.multigrid import CubicInterpolation, FullApproximationScheme, FullWeighting, Injection, JacobiIterator, LinearInterpolation, MultiGridSolver, NewtonIterator, f_cycle, v_cycle, w_cycle
from ..operators.reduction import FieldStatistics, Reduction
from ..operators.stencil import FiniteDifferencer, SecondCenteredDifference, Stencil, StreamingStencil
from ..operators.step import LowStorageRK54, Stepper, all_steppers, more_steppers
from ..sources import OutputFile, embedding_lattice, event_lattice

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
f, g = Field("f"), Field("g")


def query(name: str):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


def _r(column: str | Column, digits: int, name: str | None = None) -> Column:
    """Rounded, with no negative zero: sums of doubles differ in their last bits by the order of addition."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.round(c.cast("double"), digits) + F.lit(0.0)).alias(name or column)


def _off(column: str, digits: int) -> Column:
    """Rounded after a small shift: values that are short decimals would lie on the edge between two roundings."""
    return (F.round(F.col(column) + F.lit(0.37 * 10.0 ** -(digits + 1)), digits) + F.lit(0.0)).alias(column)


def _mantissa(column: str, digits: int = 8) -> Column:
    """A number's leading digits, of whatever size it is."""
    c = F.col(column)
    some = F.when(c > 1e-300, c)
    return F.coalesce(F.round(some / F.pow(F.lit(10.0), F.floor(F.log10(some))), digits), F.lit(0.0)).alias(column)


# --- stencils


def _laplacian(h: int = 1, field: Field = f):
    total = None
    for d in (1, 2, 3):
        part = SecondCenteredDifference(h)(field, d)
        total = part if total is None else total + part
    return total


@query("laplacian_h1")
def laplacian_h1(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    return Stencil({"lap": _laplacian()}, 1)(df, lattice, keep=[]).select("i", "j", "k", "lap")


@query("lap_summary")
def lap_summary(spark, sf_dir):
    lap = Stencil({"lap": _laplacian()}, 1)(*event_lattice(spark, sf_dir), keep=[])
    return lap.agg(F.sum("lap").alias("total"), F.min("lap").alias("least"), F.max("lap").alias("most"), F.sum(F.abs("lap")).alias("size"))


@query("streaming_stencil")
def streaming_stencil(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    s = StreamingStencil({"y": shift_fields(f, (1, 0, 0)) + 2 * shift_fields(f, (0, -1, 0)) + 3 * shift_fields(g, (0, 0, 2))}, 2, prefetch_args=["f"])
    return s(df, lattice, keep=[]).select("i", "j", "k", "y")


@query("stencil_nonlinear")
def stencil_nonlinear(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    s = Stencil({"y": shift_fields(f, (1, 0, 0)) * shift_fields(g, (-1, 0, 0)) + shift_fields(g, (0, 1, 1)) * f}, 1)
    return s(df, lattice, keep=[]).select("i", "j", "k", "y")


def _gradient(h: int) -> Query:
    def run(spark, sf_dir):
        df, lattice = event_lattice(spark, sf_dir)
        found = FiniteDifferencer(lattice, h)(df, "f", grd=("dx", "dy", "dz"), keep=[])
        return found.select("i", "j", "k", _r("dx", 4), _r("dy", 4), _r("dz", 4))

    return run


def _lap(h: int) -> Query:
    def run(spark, sf_dir):
        df, lattice = event_lattice(spark, sf_dir)
        return FiniteDifferencer(lattice, h)(df, "f", lap="lap", keep=[]).select("i", "j", "k", _r("lap", 4))

    return run


for _h in (1, 2, 3, 4):
    QUERIES[f"grad_h{_h}"] = _gradient(_h)
    if _h > 1:
        QUERIES[f"lap_h{_h}"] = _lap(_h)


@query("gradlap")
def gradlap(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    found = FiniteDifferencer(lattice, 2)(df, "f", lap="lap", grd=("dx", "dy", "dz"), keep=[])
    return found.select("i", "j", "k", _r("lap", 4), _r("dx", 4), _r("dy", 4), _r("dz", 4))


@query("divergence")
def divergence(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    df = df.withColumn("u", F.col("f") - F.col("g"))
    return FiniteDifferencer(lattice, 1).divergence(df, ("f", "g", "u"), "div", keep=[]).select("i", "j", "k", _r("div", 4))


@query("lap_outer")
def lap_outer(spark, sf_dir):
    df, lattice = embedding_lattice(spark, sf_dir)
    return FiniteDifferencer(lattice, 1)(df, "e", lap="lap", keep=[]).select("vec_id", "i", "j", "k", _r("lap", 6))


# --- maps and expressions


@query("map_tmp")
def map_tmp(spark, sf_dir):
    df, _ = event_lattice(spark, sf_dir)
    t = Param("t")
    m = ElementWiseMap([(f, f + t), (g, f * 2 + g - t)], tmp_instructions=[(t, f * g + 1)])
    return m(df).select("i", "j", "k", "f", "g")


@query("map_if")
def map_if(spark, sf_dir):
    df, _ = event_lattice(spark, sf_dir)
    inside = LogicalAnd(Compare(g, ">", 20), Compare(g, "<=", 60))
    return ElementWiseMap({"y": If(inside, f * g, -1 * f)})(df).select("i", "j", "k", "y")


@query("map_single")
def map_single(spark, sf_dir):
    df, _ = event_lattice(spark, sf_dir)
    m = ElementWiseMap({"y": 3 * f - g**2 + Param("c")})
    return m(df, filter_args=True, keys=["i", "j", "k"], c=7).select("i", "j", "k", F.col("y").cast("bigint").alias("y"))


@query("map_functions")
def map_functions(spark, sf_dir):
    df, _ = event_lattice(spark, sf_dir)
    x = g / 100
    m = ElementWiseMap({
        "a": call("sqrt", x) + call("exp", x) - call("log", x + 1),
        "b": call("sin", x) * call("cos", x) + call("tanh", x),
        "c": call("min", g, 50) + call("max", g, 50) * 3,
        "d": call("floor", g / 7) + call("round", g / 7) + g % 7 + g // 7,
        "e": call("fabs", g - 50) + call("sign", g - 50) + abs(g - 10),
    })
    return m(df).select("i", "j", "k", _r("a", 9), _r("b", 9), _r("c", 0), _r("d", 0), _r("e", 0))


@query("potential_diff")
def potential_diff(spark, sf_dir):
    df, _ = event_lattice(spark, sf_dir)
    v = g**4 / 4 - 5 * g**2 * f + f**2 / 2
    m = ElementWiseMap({"dg": diff(v, g), "df": diff(v, f), "dgf": diff(v, g, f)})
    return m(df).select("i", "j", "k", _r("dg", 0), _r("df", 0), _r("dgf", 0))


@query("expr_rewrite")
def expr_rewrite(spark, sf_dir):
    """Substitution and indexing: the expression after its fields were exchanged, and how it is spelt."""
    df, _ = event_lattice(spark, sf_dir)
    e = substitute(f * 2 + Param("c"), {f: g - f, "c": 5})
    return df.select("i", "j", "k", lower(e).cast("bigint").alias("y"), F.lit(str(index_fields(shift_fields(f, (1, 0, -1)), ("q",)))).alias("spelt"))


# --- reductions


@query("field_layout")
def field_layout(spark, sf_dir):
    """The arrays behind a set of maps, and the cells that they run over."""
    h = Field("h", offset=1, shape=(3, "a"))
    maps = {Field("y", offset="p"): shift_fields(h[0, 1], (1, 0, 0)) + Field("m", indices=()), Field("line", indices=("k",)): f * Field("w", ignore_prepends=True)}
    domain = ", ".join(f"{first} <= {x} < {end}" for x, (first, end) in loop_domain(maps).items())
    rows = [(arg.name, "(" + ", ".join(map(str, arg.shape)) + ")", domain) for arg in field_args(maps, prepend_with=("q",))]
    return spark.createDataFrame(rows, "name string, shape string, domain string")


@query("expr_simplify")
def expr_simplify(spark, sf_dir):
    """A simplified expression has the same value and is spelt without its neutral parts."""
    df, _ = event_lattice(spark, sf_dir)
    e = simplify(0 * f + 1 * g + (f - 0) / 1 + 2 * (3 * f) + g**0 + call("abs", f * 1) ** 1)
    return df.select("i", "j", "k", lower(e).cast("bigint").alias("y"), F.lit(str(e)).alias("spelt"))


def _reduce(op: str, expr, digits: int = 6) -> Query:
    def run(spark, sf_dir):
        df, lattice = event_lattice(spark, sf_dir)
        return Reduction(lattice, {"f": [(expr, op)], "g": [(g, op)]}).frame(df).select(_r("f_0", digits), _r("g_0", digits))

    return run


QUERIES["reduce_avg"] = _reduce("avg", f * g)
QUERIES["reduce_sum"] = _reduce("sum", f * g, 0)
QUERIES["reduce_max"] = _reduce("max", f - g, 0)
QUERIES["reduce_min"] = _reduce("min", f - g, 0)


@query("reduce_prod")
def reduce_prod(spark, sf_dir):
    """A product for each line of cells along k: one over all cells would leave the range of doubles."""
    df, lattice = event_lattice(spark, sf_dir)
    lines = Lattice((1, 1, lattice.shape[2]), outer=("i", "j"))
    return Reduction(lines, {"p": [(1 + g / 100, "prod")]}).frame(df).select("i", "j", _mantissa("p_0"))


@query("reduce_lineitem")
def reduce_lineitem(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price, discount = Field("l_extendedprice"), Field("l_discount")
    r = Reduction(Lattice((1, 1, 1), outer=("l_returnflag", "l_linestatus")), {"net": [(price * (1 - discount), "sum"), (price, "max"), (price, "min")], "q": [(Field("l_quantity"), "sum")]})
    return r.frame(rows).select("l_returnflag", "l_linestatus", _r("net_0", 2), _r("net_1", 2), _r("net_2", 2), _r("q_0", 2))


@query("field_stats")
def field_stats(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    return FieldStatistics(lattice, max_min=True).frame(df, "f").select(_r("mean", 6), _mantissa("variance"), _r("max", 0), _r("min", 0), _r("abs_max", 0), _r("abs_min", 0))


@query("field_stats_outer")
def field_stats_outer(spark, sf_dir):
    df, lattice = embedding_lattice(spark, sf_dir)
    return FieldStatistics(lattice, max_min=True).frame(df, "e").select("vec_id", _r("mean", 9), _r("variance", 9), _r("max", 6), _r("min", 6), _r("abs_max", 6), _r("abs_min", 6))


@query("reduce_callback")
def reduce_callback(spark, sf_dir):
    """A reduction whose callback makes one number, the standard deviation, of its two averages."""
    df, lattice = event_lattice(spark, sf_dir)
    spread = Reduction(lattice, {"mean": [g], "square": [g * g]}, callback=lambda found: math.sqrt(found["square"][0] - found["mean"][0] ** 2))
    return spark.createDataFrame([(round(spread(df), 9),)], "spread double")


@query("allreduce")
def allreduce(spark, sf_dir):
    """One number over all blocks, by each operation."""
    df, _ = event_lattice(spark, sf_dir)
    rows = [(op, float(DomainDecomposition.allreduce(df.withColumn("x", F.col("g") - 50), "x", op))) for op in ("sum", "max", "min")]
    return spark.createDataFrame(rows, "op string, value double")


@query("rho_and_p")
def rho_and_p(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    energy = Reduction(lattice, {"kinetic": [f**2 / 2, g**2 / 2], "potential": [f * g], "gradient": [-1 * f * g / 2]}, callback=get_rho_and_p)(df)
    return spark.createDataFrame([(float(round(energy["total"], 3)), float(round(energy["pressure"], 3)))], "total double, pressure double")


# --- histograms


@query("hist_count")
def hist_count(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    return Histogrammer(lattice, {"n": (g / 10, 1), "m": (f % 7, 1)}, 12)(df)


@query("hist_weighted")
def hist_weighted(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    return Histogrammer(lattice, {"w": (g, f)}, 123)(df)


@query("hist_linear")
def hist_linear(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    return FieldHistogrammer(lattice, 64)(df, "f").select("bin", "linear", _r("linear_edge", 4))


@query("hist_log")
def hist_log(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    return FieldHistogrammer(lattice, 32)(df, "f").select("bin", "log", _r("log_edge", 3))


@query("hist_outer")
def hist_outer(spark, sf_dir):
    df, lattice = embedding_lattice(spark, sf_dir)
    return FieldHistogrammer(lattice, 8)(df, "e").select("vec_id", "bin", "linear")


# --- decomposition


@query("block_shape")
def block_shape(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    d = DomainDecomposition((3, 2, 1), 0, lattice.shape)
    return d.with_block(df, lattice).groupBy("block").agg(F.count("*").alias("cells"), F.sum("f").alias("f"))


@query("halo_pad")
def halo_pad(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    return DomainDecomposition((2, 2, 1), (1, 0, 2), lattice.shape).share_halos(df.drop("g"), lattice).select("block", "i", "j", "k", "f")


@query("halo_remove")
def halo_remove(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    d = DomainDecomposition((3, 2, 1), 1, lattice.shape)
    return d.remove_halos(d.share_halos(df, lattice), lattice).select("i", "j", "k", "f", "g")


@query("halo_restore")
def halo_restore(spark, sf_dir):
    """Blocks with padding that holds nothing."""
    df, lattice = event_lattice(spark, sf_dir)
    return DomainDecomposition((2, 2, 1), (1, 0, 2), lattice.shape).restore_halos(df.drop("g"), lattice).select("block", "i", "j", "k", "f")


@query("block_numbers")
def block_numbers(spark, sf_dir):
    """Every event's block, its coordinates, and the block's neighbours before and behind along each axis."""
    df, lattice = event_lattice(spark, sf_dir)
    d = DomainDecomposition((4, 2, 1), 0, lattice.shape)
    blocks = []
    for number in range(8):
        bi, bj, bk = d.rank_tuple(number)
        blocks.append((number, bi, bj, d.rankID(bi - 1, bj, bk), d.rankID(bi + 1, bj, bk), d.rankID(bi, bj + 1, bk + 1)))
    named = spark.createDataFrame(blocks, "block int, bi int, bj int, before int, behind int, beside int")
    cells = d.with_block(df, lattice).groupBy("block").agg(F.count("*").alias("cells"))
    return cells.join(d.bcast(named), "block").select(*named.columns, "cells")


@query("gather_roundtrip")
def gather_roundtrip(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    array = DomainDecomposition.gather_array(df, lattice, "f")
    back = DomainDecomposition.scatter_array(spark, array, lattice, "f")
    return back.select("i", "j", "k", F.col("f").cast("bigint").alias("f"))


# --- Fourier space


@query("dft_r2c")
def dft_r2c(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    return DFT(lattice).dft(df, "f").select("kx", "ky", "kz", _r("f_re", 0), _r("f_im", 0))


@query("dft_c2c")
def dft_c2c(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    df = df.select("i", "j", "k", F.col("f").alias("z_re"), (F.col("g") * 100).alias("z_im"))
    return DFT(lattice, is_real=False).dft(df, "z").select("kx", "ky", "kz", _r("z_re", 0), _r("z_im", 0))


@query("idft_roundtrip")
def idft_roundtrip(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    fft = DFT(lattice)
    return fft.idft(fft.dft(df, "f", "g"), "f", "g").select("i", "j", "k", _r(F.col("f") / lattice.cells, 0, "f"), _r(F.col("g") / lattice.cells, 0, "g"))


@query("zero_corner")
def zero_corner(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    fft = DFT(lattice)
    return fft.zero_corner_modes(fft.dft(df, "f"), "f").select("kx", "ky", "kz", _r("f_re", 0), _r("f_im", 0))


@query("power_spectrum")
def power_spectrum(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    return PowerSpectra(DFT(lattice))(df, "f").select("bin", "modes", _mantissa("f"))


@query("mode_counts")
def mode_counts(spark, sf_dir):
    _, lattice = event_lattice(spark, sf_dir)
    fft = DFT(lattice)
    s = PowerSpectra(fft)
    modes = fft.grid(spark).withColumns({"u_re": F.lit(1.0), "u_im": F.lit(0.0)})
    return s.bin_power(modes, "u", k_power=0).select("bin", "modes", _r("u", 9))


def _vector(spark, sf_dir) -> tuple[DataFrame, Lattice]:
    df, lattice = event_lattice(spark, sf_dir)
    return df.withColumn("u", F.col("f") - F.col("g")), lattice


VECTOR = ("f", "g", "u")


@query("transversify")
def transversify(spark, sf_dir):
    df, lattice = _vector(spark, sf_dir)
    fft = DFT(lattice)
    found = Projector(fft).transversify(fft.dft(df, *VECTOR), VECTOR)
    return found.select("kx", "ky", "kz", *[_off(f"{v}_{p}", 0) for v in VECTOR for p in ("re", "im")])


def _parts(modes: DataFrame, back: DataFrame, names: list[str], again: list[str]) -> DataFrame:
    """Parts of modes and what they make when put together again, by mode."""
    columns = lambda named: [_off(f"{n}_{p}", 2) for n in named for p in ("re", "im")]
    keys = ["kx", "ky", "kz"]
    return modes.select(*keys, *columns(names)).join(back.select(*keys, *columns(again)), keys)


@query("vec_pol")
def vec_pol(spark, sf_dir):
    """To polarisations, and back, which leaves the transverse part."""
    df, lattice = _vector(spark, sf_dir)
    fft = DFT(lattice)
    p = Projector(fft, 2)
    modes = p.vec_to_pol(fft.dft(df, *VECTOR), VECTOR)
    return _parts(modes, p.pol_to_vec(modes, VECTOR), ["plus", "minus"], list(VECTOR))


@query("decompose_vector")
def decompose_vector(spark, sf_dir):
    """The parts of all modes, 0 where every effective momentum is 0; and the vector that they make."""
    df, lattice = _vector(spark, sf_dir)
    fft = DFT(lattice)
    p = Projector(fft, 1)
    modes = p.decompose_vector(fft.dft(df, *VECTOR), VECTOR)
    return _parts(modes, p.decomp_to_vec(modes, VECTOR), ["plus", "minus", "lng"], list(VECTOR))


def _tensor(spark, sf_dir) -> tuple[DataFrame, Lattice, tuple[str, ...]]:
    df, lattice = event_lattice(spark, sf_dir)
    columns = [F.col("f"), F.col("g"), F.col("f") - F.col("g"), F.col("g") * 2, F.col("f") + F.col("g"), F.col("f") * 2]
    names = tuple(f"h_{n}" for n in range(6))
    return df.select("i", "j", "k", *[c.cast("double").alias(n) for c, n in zip(columns, names, strict=True)]), lattice, names


@query("tt_project")
def tt_project(spark, sf_dir):
    df, lattice, names = _tensor(spark, sf_dir)
    fft = DFT(lattice)
    found = Projector(fft).transverse_traceless(fft.dft(df, *names), names)
    return found.select("kx", "ky", "kz", *[_off(f"{n}_{p}", 2) for n in names for p in ("re", "im")])


@query("tensor_pol")
def tensor_pol(spark, sf_dir):
    """To polarisations, and back, which leaves the transverse and traceless part."""
    df, lattice, names = _tensor(spark, sf_dir)
    fft = DFT(lattice)
    p = Projector(fft)
    modes = p.tensor_to_pol(fft.dft(df, *names), names)
    return _parts(modes, p.pol_to_tensor(modes, names), ["plus", "minus"], list(names))


@query("gw")
def gw(spark, sf_dir):
    df, lattice, names = _tensor(spark, sf_dir)
    fft = DFT(lattice)
    return PowerSpectra(fft).gw(df, names, Projector(fft), 1.5).select("bin", "modes", _mantissa("gw", 6))


@query("gw_polarization")
def gw_polarization(spark, sf_dir):
    df, lattice, names = _tensor(spark, sf_dir)
    fft = DFT(lattice)
    return PowerSpectra(fft).gw_polarization(df, names, Projector(fft), 1.5).select("bin", "modes", _mantissa("plus", 6), _mantissa("minus", 6))


@query("pol_spectra")
def pol_spectra(spark, sf_dir):
    df, lattice = _vector(spark, sf_dir)
    fft = DFT(lattice)
    return PowerSpectra(fft).polarization(df, VECTOR, Projector(fft)).select("bin", "modes", _mantissa("plus", 6), _mantissa("minus", 6))


@query("vector_decomposition")
def vector_decomposition(spark, sf_dir):
    df, lattice = _vector(spark, sf_dir)
    fft = DFT(lattice)
    return PowerSpectra(fft).vector_decomposition(df, VECTOR, Projector(fft)).select("bin", "modes", _mantissa("plus", 6), _mantissa("minus", 6), _mantissa("lng", 6))


@query("spectral_derivs")
def spectral_derivs(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    found = SpectralCollocator(DFT(lattice))(df, "f", lap="lap", grd=("dx", "dy", "dz"))
    return found.select("i", "j", "k", _r("lap", 2), _r("dx", 2), _r("dy", 2), _r("dz", 2))


@query("spectral_divergence")
def spectral_divergence(spark, sf_dir):
    df, lattice = _vector(spark, sf_dir)
    return SpectralCollocator(DFT(lattice)).divergence(df, VECTOR, "div").select("i", "j", "k", _r("div", 2))


@query("poisson")
def poisson(spark, sf_dir):
    """The residual of the solution under the stencil it was solved for: the source's mean, everywhere."""
    df, lattice = event_lattice(spark, sf_dir)
    solved = SpectralPoissonSolver(DFT(lattice), SecondCenteredDifference(1).get_eigenvalues)(df, "f", "s", 1.2)
    lap = Stencil({"lap": _laplacian(1, Field("s"))}, 1)(solved, lattice)
    both = lap.join(df.select("i", "j", "k", "f"), ["i", "j", "k"])
    return both.select("i", "j", "k", _r(F.col("f") - (F.col("lap") - 1.2 * F.col("s")), 3, "mean"))


@query("random_field_spectrum")
def random_field_spectrum(spark, sf_dir):
    _, lattice = event_lattice(spark, sf_dir)
    fft = DFT(lattice)
    field = RayleighGenerator(spark, fft, 5123).init_field("r", lambda k: F.pow(k, F.lit(-2.0)))
    return PowerSpectra(fft)(field, "r").select("bin", "modes", _mantissa("r", 6))


@query("random_amplitudes")
def random_amplitudes(spark, sf_dir):
    """Without random amplitudes a mode's power is the one asked for, whatever its phase; the modes at 0 or n / 2 on every axis, which are real, are set to 0."""
    _, lattice = event_lattice(spark, sf_dir)
    fft = DFT(lattice)
    modes = RayleighGenerator(spark, fft, 5123).generate("r", lambda k: F.pow(k, F.lit(-2.0)), random=False, norm=1e6)
    return fft.zero_corner_modes(modes, "r").select("kx", "ky", "kz", _r(F.col("r_re") * F.col("r_re") + F.col("r_im") * F.col("r_im"), 6, "power"))


@query("random_wkb")
def random_wkb(spark, sf_dir):
    _, lattice = event_lattice(spark, sf_dir)
    fft = DFT(lattice)
    fields = RayleighGenerator(spark, fft).init_WKB_fields("r", "drdt", lambda k: 1 / (2 * k), lambda k: k, hubble=0.5)
    return fields.select("i", "j", "k", _r("r", 6), _r("drdt", 6))


@query("random_vector")
def random_vector(spark, sf_dir):
    """A transverse field: no divergence, and not 0 itself."""
    _, lattice = event_lattice(spark, sf_dir)
    fft = DFT(lattice)
    fields = RayleighGenerator(spark, fft).init_transverse_vector(Projector(fft), ("a", "b", "c"), lambda k: 1 / k)
    div = SpectralCollocator(fft).divergence(fields, ("a", "b", "c"), "div")
    lives = fields.select("i", "j", "k", (F.greatest(F.abs("a"), F.abs("b"), F.abs("c")) > 1e-9).alias("lives"))
    return div.join(lives, ["i", "j", "k"]).select("i", "j", "k", _r("div", 6), "lives")


@query("random_vector_pol")
def random_vector_pol(spark, sf_dir):
    """Without random amplitudes the components' power is that of both polarisations; modes without an effective momentum or at 0 or n / 2 on every axis are 0."""
    _, lattice = event_lattice(spark, sf_dir)
    fft, names = DFT(lattice), ("a", "b", "c")
    fields = RayleighGenerator(spark, fft).init_vector_from_pol(Projector(fft), names, lambda k: 1 / k, lambda k: 2 / k, random=False, norm=1e6)
    modes = fft.zero_corner_modes(fft.dft(fields, *names), *names)
    power = sum((F.col(f"{n}_{p}") * F.col(f"{n}_{p}") for n in names for p in ("re", "im")), F.lit(0.0))
    return modes.select("kx", "ky", "kz", _r(power / lattice.cells**2, 5, "power"))


@query("hermitian")
def hermitian(spark, sf_dir):
    """Modes that no real field has, made those of one."""
    df, lattice = event_lattice(spark, sf_dir)
    fft = DFT(lattice)
    modes = fft.dft(df, "f").withColumns({"f_re": F.col("f_re") + 1000 * F.col("kx"), "f_im": F.col("f_im") + 70 * F.col("ky") + 3})
    return make_hermitian(modes, fft, "f").select("kx", "ky", "kz", _r("f_re", 0), _r("f_im", 0))


# --- time steps


def _step(kind: type[Stepper]) -> Query:
    def run(spark, sf_dir):
        df, _ = event_lattice(spark, sf_dir)
        df = df.select("i", "j", "k", (F.col("f") / 1000.0).alias("f"), (F.col("g") / 10.0).alias("g"))
        found = kind({f: g, g: -1 * f - g / 10}, dt=0.1).step(df)
        return found.select("i", "j", "k", _off("f", 7), _off("g", 7))

    return run


for _kind in (*all_steppers, *more_steppers):
    QUERIES[f"step_{_kind.__name__}"] = _step(_kind)


@query("wave_step")
def wave_step(spark, sf_dir):
    """A step of the wave equation: the Laplacian is recomputed before each stage."""
    df, lattice = event_lattice(spark, sf_dir)
    df = df.select("i", "j", "k", (F.col("f") / 1000.0).alias("f"), (F.col("g") / 10.0).alias("g"))
    lap = FiniteDifferencer(lattice, 1)
    stepper = next(s for s in all_steppers if s.__name__ == "RungeKutta2Midpoint")({f: g, g: Field("lap")}, dt=0.1)

    def before(state):
        name = "__f_1" if "__f_1" in state.columns else "f"
        return lap(state.drop("lap"), name, lap="lap")

    return stepper.step(df, before_stage=before).select("i", "j", "k", _r("f", 6), _r("g", 6))


# --- multigrid


@query("inject")
def inject(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    return Injection()(df, lattice, "f").select("i", "j", "k", F.col("f").cast("double").alias("f"))


@query("full_weighting")
def full_weighting(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    return FullWeighting()(df, lattice, "f").select("i", "j", "k", _r("f", 6))


@query("restrict_correct")
def restrict_correct(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    coarse = Injection()(df, lattice, "f")
    return FullWeighting().correct(df, coarse, lattice, "f").select("i", "j", "k", _r("f", 6))


def _interpolate(kind) -> Query:
    def run(spark, sf_dir):
        df, lattice = event_lattice(spark, sf_dir)
        return kind()(Injection()(df, lattice, "f"), lattice, "f").select("i", "j", "k", _r("f", 6))

    return run


QUERIES["interp_linear"] = _interpolate(LinearInterpolation)
QUERIES["interp_cubic"] = _interpolate(CubicInterpolation)


@query("interp_correct")
def interp_correct(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    return LinearInterpolation().correct(Injection()(df, lattice, "f"), df, lattice, "f").select("i", "j", "k", _r("f", 6))


rho = Field("g")


@query("jacobi_sweep")
def jacobi_sweep(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    df = df.select("i", "j", "k", F.col("f").cast("double").alias("f"), F.col("g").cast("double").alias("g"))
    return JacobiIterator({f: (_laplacian() - f, rho)}, omega=0.5).sweep(df, lattice).select("i", "j", "k", _r("f", 6))


@query("newton_sweep")
def newton_sweep(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    df = df.select("i", "j", "k", (F.col("f") / 10000.0).alias("f"), (F.col("g") / 100.0).alias("g"))
    return NewtonIterator({f: (_laplacian() - f**3 - f, rho)}, omega=0.5).sweep(df, lattice).select("i", "j", "k", _r("f", 8))


@query("residual_norms")
def residual_norms(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    df = df.select("i", "j", "k", F.col("f").cast("double").alias("f"), F.col("g").cast("double").alias("g"))
    return JacobiIterator({f: (_laplacian() - f, rho)}).errors(df, lattice).select(_r("max_f", 3), _r("rms_f", 3))


@query("lhs_correction")
def lhs_correction(spark, sf_dir):
    df, lattice = event_lattice(spark, sf_dir)
    df = df.select("i", "j", "k", F.col("f").cast("double").alias("f"), F.col("g").cast("double").alias("g"), F.lit(2.0).alias("r_f"))
    return JacobiIterator({f: (_laplacian() - f, rho)}).lhs_correction(df, lattice).select("i", "j", "k", _r("g", 3))


@query("cycles")
def cycles(spark, sf_dir):
    """The levels of each kind of cycle and the sweeps on them, in order."""
    rows = [(kind.__name__, depth, n, level, sweeps) for kind in (v_cycle, w_cycle, f_cycle) for depth in (1, 2, 3) for n, (level, sweeps) in enumerate(kind(10, 20, depth))]
    return spark.createDataFrame(rows, "kind string, depth int, place int, level int, sweeps int")


def _cycle(kind) -> Query:
    def run(spark, sf_dir):
        df, lattice = event_lattice(spark, sf_dir)
        df = df.select("i", "j", "k", F.lit(0.0).alias("f"), (F.col("g") - 49.5).alias("g"))
        scheme = kind(JacobiIterator({f: (_laplacian() / Param("dx") ** 2 - f, rho)}, omega=0.75), log_errors=False)
        found, _ = scheme(df, lattice, [(0, 2), (1, 4), (0, 2)])
        return found.select("i", "j", "k", _r("f", 6))

    return run


QUERIES["fas_vcycle"] = _cycle(FullApproximationScheme)
QUERIES["linear_vcycle"] = _cycle(MultiGridSolver)


# --- models and output


def _scalar_state(spark, sf_dir) -> tuple[DataFrame, Lattice]:
    df, lattice = event_lattice(spark, sf_dir)
    c = F.col
    df = df.select("i", "j", "k", (c("f") / 10000.0).alias("f_0"), (c("g") / 100.0).alias("f_1"), (c("g") / 50.0).alias("dfdt_0"), (c("f") / 20000.0).alias("dfdt_1"), ((c("f") - c("g")) / 10000.0).alias("lap_f_0"), (c("g") / 200.0).alias("lap_f_1"))
    return df, lattice


def _potential(field):
    return field[0] ** 2 / 2 + field[0] ** 2 * field[1] ** 2


@query("scalar_energy")
def scalar_energy(spark, sf_dir):
    df, lattice = _scalar_state(spark, sf_dir)
    found = Reduction(lattice, ScalarSector(2, potential=_potential)).frame(df, a=1.5)
    return found.select(*[_r(c, 9) for c in found.columns])


@query("scalar_rhs")
def scalar_rhs(spark, sf_dir):
    df, _ = _scalar_state(spark, sf_dir)
    rhs = ScalarSector(2, potential=_potential).rhs_dict
    named = {f"rhs_{k.column}": e for k, e in rhs.items()}
    found = ElementWiseMap(list(named.items()))(df, hubble=0.3, a=1.5)
    return found.select("i", "j", "k", *[_off(n, 8) for n in named])


@query("stress_tensor")
def stress_tensor(spark, sf_dir):
    df, _ = _scalar_state(spark, sf_dir)
    c = F.col
    df = df.withColumns({f"dfdx_{n}_{m}": c(f"f_{n}") * (m + 1) for n in range(2) for m in range(3)})
    s = ScalarSector(2, potential=_potential)
    found = ElementWiseMap({"t00": s.stress_tensor(0, 0), "t01": s.stress_tensor(0, 1), "t22": s.stress_tensor(2, 2), "s12": s.stress_tensor(1, 2, drop_trace=True)})(df, a=1.5)
    tensor = TensorPerturbationSector([s])
    found = found.withColumns({f"lap_hij_{n}": F.lit(0.5 + n) for n in range(6)} | {f"dhijdt_{n}": F.lit(0.25 * n) for n in range(6)})
    rates = {f"rhs_{k.column}": e for k, e in tensor.rhs_dict.items()}
    found = ElementWiseMap(list(rates.items()))(found, hubble=0.3)
    return found.select("i", "j", "k", *[_off(n, 7) for n in ("t00", "t01", "t22", "s12", *rates)])


@query("expansion")
def expansion(spark, sf_dir):
    """The scale factor after time 1 of a fluid for each type of event: density 1 and its mean value in hundreds, pressure by its place among the types."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg((1 + F.avg("value") / 100).alias("rho")).orderBy("event_type").collect()  # a row a type
    found = []
    for n, r in enumerate(rows):
        w = (0.0, 1 / 3, 1 / 2, 1.0, -1 / 4)[n % 5]
        energy = lambda a, rho=r.rho, w=w: rho * a ** (-3 - 3 * w)
        x = Expansion(energy(1.0), LowStorageRK54, mpl=math.sqrt(8 * math.pi))
        for _ in range(200):
            x.step_through(energy, lambda a, w=w, energy=energy: w * energy(a), 0.005)
        found.append((r.event_type, round(x.a, 6), round(x.hubble, 6)))
    return spark.createDataFrame(found, "event_type string, a double, hubble double")


@query("preheating")
def preheating(spark, sf_dir):
    """Two coupled scalar fields and the scale factor, two steps of five stages: energy and pressure are averaged anew at each stage."""
    df, lattice = event_lattice(spark, sf_dir)
    c = F.col
    state = df.select("i", "j", "k", (0.193 + c("f") / 1e9).alias("f_0"), (c("g") / 1e5).alias("f_1"), F.lit(-0.142).alias("dfdt_0"), F.lit(0.0).alias("dfdt_1"))
    sector = ScalarSector(2, potential=lambda f: f[0] ** 2 / 2 + 2 * f[0] ** 2 * f[1] ** 2)
    laplacians = Stencil({f"lap_f_{n}": _laplacian(1, Field(f"f_{n}")) for n in (0, 1)}, 1)
    reduction = Reduction(lattice, sector, callback=get_rho_and_p)
    stepper, dt, found = LowStorageRK54(sector.rhs_dict), 0.1, []
    now = laplacians(state, lattice)
    energy = reduction(now, a=1.0)
    universe = Expansion(energy["total"], LowStorageRK54)
    for step in range(2):
        now = stepper.start(now)
        for stage in range(stepper.num_stages):
            moved = stepper(stage, now, dt=dt, a=universe.a, hubble=universe.hubble)
            universe.step(stage, energy["total"], energy["pressure"], dt)
            now = cut(laplacians(moved.drop("lap_f_0", "lap_f_1"), lattice))
            energy = reduction(now, a=universe.a)
        now = stepper.finish(now)
        found.append((step, universe.a, universe.hubble, float(energy["total"]), float(universe.constraint(energy["total"]))))
    return spark.createDataFrame(found, "step int, a double, hubble double, energy double, miss double")


@query("output_append")
def output_append(spark, sf_dir):
    """Two records of statistics appended to a group and read back."""
    from ..sources.session import shared_folder

    df, lattice = event_lattice(spark, sf_dir)
    out = OutputFile(spark, shared_folder(spark), "run")
    for t in (0, 1):
        row = FieldStatistics(lattice).frame(df.withColumn("h", F.col("g") + t), "h").first()
        out.output("statistics", t=t, mean=row.mean)
    return out.read("statistics").select(F.col("t").cast("bigint").alias("t"), _r("mean", 9))


__all__ = ["QUERIES"]
