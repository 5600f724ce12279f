"""Stencils: expressions that read neighbouring cells.

Linear ones scatter: a cell is sent once to each cell that reads it, as its part of
the sums there. One explode and one aggregate serve every output of the stencil, and
since partial aggregation adds up what meets within a task, a table dealt by
slabs (see ``decomp``) shuffles little more than the cells on slab faces.

Others gather: each neighbour that is read arrives as a column of its own in one
group-by, and the expression is evaluated on them.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Const, Expr, Field, Op, fields_of, lower, shift_fields, simplify, walk, wrap
from .lattice import Lattice
from .maps import _pairs, name_of

Offset = tuple[int, int, int]


def expand_stencil(f: Expr, coefs: Mapping[Offset, Any]) -> Expr:
    """Sum of ``c * f`` read at each offset."""
    total: Expr = Const(0)
    for offset, c in coefs.items():
        total = total + wrap(c) * shift_fields(f, offset)
    return simplify(total)


def centered_diff(f: Expr, coefs: Mapping[int, Any], direction: int, order: int) -> Expr:
    """A centred difference along axis ``direction`` (1, 2 or 3) from the coefficients of offsets 0 and up.

    Opposite offsets have the same coefficient for even ``order`` and the negative for odd;
    the centre has none for odd order.
    """
    spread: dict[Offset, Any] = {}
    for step, c in coefs.items():
        at = lambda s: tuple(s if axis == direction - 1 else 0 for axis in range(3))
        if step == 0:
            if order % 2 == 0:
                spread[at(0)] = c
            continue
        spread[at(step)] = c
        spread[at(-step)] = c if order % 2 == 0 else -c
    return expand_stencil(f, spread)


def linear_terms(expr: Expr) -> dict[tuple[str, Offset], Expr] | None:
    """{(column, offset): coefficient} of an expression linear in its fields with constant coefficients, else None."""
    terms: dict[tuple[str, Offset], Expr] = {}

    def has_field(e: Expr) -> bool:
        return any(isinstance(n, Field) for n in walk(e))

    def collect(e: Expr, by: Expr) -> bool:
        match e:
            case Field():
                key = (e.column, e.shifted())
                terms[key] = simplify(terms.get(key, Const(0)) + by)
                return True
            case Op("+", a, b):
                return collect(a, by) and collect(b, by)
            case Op("-", a, b):
                return collect(a, by) and collect(b, simplify(-by))
            case Op("*", a, b) if not has_field(a):
                return collect(b, simplify(a * by))
            case Op("*", a, b) if not has_field(b):
                return collect(a, simplify(b * by))
            case Op("/", a, b) if not has_field(b):
                return collect(a, simplify(by / b))
            case Const(0):
                return True
        return False

    return terms if collect(wrap(expr), Const(1)) else None


def scatter(df: DataFrame, lattice: Lattice, outputs: Mapping[str, Mapping[tuple[str, Offset], Any]], keep: list[str] = (), params: Mapping[str, Any] | None = None) -> DataFrame:
    """Keys, ``keep`` columns and each output: sums of coefficient times column at an offset, periodic."""
    offsets = sorted({o for terms in outputs.values() for _, o in terms} | ({(0, 0, 0)} if keep else set()))
    parts = []
    for offset in offsets:
        columns = []
        for name, terms in outputs.items():
            mine = [lower(c, params=params) * F.col(column) for (column, o), c in terms.items() if o == offset]
            value = mine[0] if mine else F.lit(None)
            for more in mine[1:]:
                value = value + more
            columns.append(value.alias(name))
        columns += [(F.col(c) if offset == (0, 0, 0) else F.lit(None)).alias(c) for c in keep]
        # The cell that reads this one at ``offset`` lies the other way.
        to = [F.pmod(F.col(a) - o, F.lit(n)).alias(a) for a, o, n in zip(lattice.axes, offset, lattice.shape, strict=True)]
        parts.append(F.struct(*to, *columns))
    sent = df.select(*lattice.outer, F.inline(F.array(*parts)))
    sums = [F.sum(name).alias(name) for name in outputs] + [F.first(c, ignorenulls=True).alias(c) for c in keep]
    return sent.groupBy(*lattice.keys).agg(*sums)


def gather(df: DataFrame, lattice: Lattice, reads: list[tuple[str, Offset]], keep: list[str] = ()) -> tuple[DataFrame, dict[tuple[str, Offset], str]]:
    """Keys, ``keep`` columns and a column for each (column, offset) read; and the names of those."""
    offsets = sorted({o for _, o in reads} | {(0, 0, 0)})
    names = {(c, o): f"{c}__{n}" for n, (c, o) in enumerate(reads)}
    parts = []
    for offset in offsets:
        to = [F.pmod(F.col(a) - o, F.lit(n)).alias(a) for a, o, n in zip(lattice.axes, offset, lattice.shape, strict=True)]
        mine = [(F.col(c) if o == offset else F.lit(None)).alias(names[c, o]) for c, o in reads]
        mine += [(F.col(c) if offset == (0, 0, 0) else F.lit(None)).alias(c) for c in keep]
        parts.append(F.struct(*to, *mine))
    sent = df.select(*lattice.outer, F.inline(F.array(*parts)))
    found = [F.first(n, ignorenulls=True).alias(n) for n in [*names.values(), *keep]]
    return sent.groupBy(*lattice.keys).agg(*found), names


class Stencil:
    """Assignments ``{field: expression}`` whose fields may be shifted; all read the old values.

    ``halo_shape`` (one number or one an axis) bounds how far they read; ``prefetch_args`` is accepted, as Spark decides
    what stays in memory.
    """

    def __init__(self, map_instructions, halo_shape: int | Offset, *, prefetch_args=(), params: Mapping[str, Any] | None = None):
        self.assignments = _pairs(map_instructions)
        halo = halo_shape if isinstance(halo_shape, tuple) else (halo_shape,) * 3
        for f in fields_of(*[e for _, e in self.assignments]):
            if any(abs(o) > h for o, h in zip(f.shifted(), halo, strict=True)):
                raise ValueError(f"{f} reads beyond the halo {halo}")
        self.prefetch_args, self.params = list(prefetch_args), dict(params or {})
        self.linear = [(name_of(k), linear_terms(e)) for k, e in self.assignments]

    def __call__(self, df: DataFrame, lattice: Lattice, *, keep: list[str] | None = None, **params: Any) -> DataFrame:
        """The outputs with the columns ``keep``, all others unless told. Columns that aren't kept or read don't travel, and aren't read from the source."""
        params = self.params | params
        written = [name_of(k) for k, _ in self.assignments]
        keep = [c for c in lattice.values(df) if c not in written and (keep is None or c in keep)]
        if all(terms for _, terms in self.linear):
            return scatter(df, lattice, dict(self.linear), keep, params)
        reads = sorted({(f.column, f.shifted()) for f in fields_of(*[e for _, e in self.assignments])})
        near, names = gather(df, lattice, reads, keep)
        column = lambda f: F.col(names[f.column, f.shifted()])
        done = near.withColumns({name_of(k): lower(e, column, params) for k, e in self.assignments})
        return done.drop(*names.values())


class StreamingStencil(Stencil):
    """A stencil that names the one field worth prefetching plane by plane; its results are those of Stencil."""

    def __init__(self, map_instructions, halo_shape, *, prefetch_args=(), params=None):
        if len(prefetch_args) > 1:
            raise NotImplementedError("streaming prefetches one array")
        super().__init__(map_instructions, halo_shape, prefetch_args=prefetch_args, params=params)


# Coefficients of centred differences for halos 1 to 4, offsets 0 and up.
FIRST_COEFS = {
    1: {1: 1 / 2},
    2: {1: 8 / 12, 2: -1 / 12},
    3: {1: 45 / 60, 2: -9 / 60, 3: 1 / 60},
    4: {1: 672 / 840, 2: -168 / 840, 3: 32 / 840, 4: -3 / 840},
}
SECOND_COEFS = {
    1: {0: -2, 1: 1},
    2: {0: -30 / 12, 1: 16 / 12, 2: -1 / 12},
    3: {0: -490 / 180, 1: 270 / 180, 2: -27 / 180, 3: 2 / 180},
    4: {0: -14350 / 5040, 1: 8064 / 5040, 2: -1008 / 5040, 3: 128 / 5040, 4: -9 / 5040},
}


class CenteredDifference:
    """A difference of truncation order 2h; ``get_eigenvalues(k, dx)`` gives what it does to a plane wave (k for the first one, up to i)."""

    def __init__(self, coefs: Mapping[int, float], order: int):
        self.coefs, self.order, self.is_centered = dict(coefs), order, True
        self.truncation_order = 2 * max(coefs)

    def __call__(self, f: Expr, direction: int) -> Expr:
        return centered_diff(f, self.coefs, direction, self.order)

    def get_eigenvalues(self, k, dx):
        import numpy as np

        wave = np.sin if self.order == 1 else np.cos
        total = 0.0
        for step, c in self.coefs.items():
            total = total + (c if step == 0 else 2 * c * wave(step * np.asarray(k) * dx))
        return total / dx**self.order

    def eigenvalue(self, k: Column, dx: float) -> Column:
        """``get_eigenvalues`` of a column of momenta."""
        wave = F.sin if self.order == 1 else F.cos
        total = F.lit(0.0)
        for step, c in self.coefs.items():
            total = total + (F.lit(float(c)) if step == 0 else 2.0 * c * wave(k * (step * float(dx))))
        return total / float(dx**self.order)


class FirstCenteredDifference(CenteredDifference):
    def __init__(self, h: int):
        super().__init__(FIRST_COEFS[h], 1)


class SecondCenteredDifference(CenteredDifference):
    def __init__(self, h: int):
        super().__init__(SECOND_COEFS[h], 2)


class FiniteDifferencer:
    """Gradient, Laplacian and divergence of fields; all outputs of a call share one pass.

    ``first_stencil`` and ``second_stencil`` are callables (field, direction) that replace the centred ones.
    """

    def __init__(self, lattice: Lattice, halo: int, dx: tuple[float, float, float] | float | None = None, *, first_stencil=None, second_stencil=None):
        self.lattice = lattice
        dx = lattice.spacing if dx is None else dx
        self.dx = dx if isinstance(dx, tuple) else (dx,) * 3
        self.first = first_stencil or FirstCenteredDifference(halo)
        self.second = second_stencil or SecondCenteredDifference(halo)

    def gradient(self, name: str, direction: int) -> Expr:
        return self.first(Field(name), direction) / self.dx[direction - 1]

    def laplacian(self, name: str) -> Expr:
        total = None
        for direction in (1, 2, 3):
            part = self.second(Field(name), direction) / self.dx[direction - 1] ** 2
            total = part if total is None else total + part
        return total

    def __call__(self, df: DataFrame, fx: str, *, lap: str | None = None, pdx: str | None = None, pdy: str | None = None, pdz: str | None = None, grd: tuple[str, str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
        """Add the wanted columns to those that are kept, all unless told. Outer keys of the lattice keep their fields apart."""
        if grd is not None and (pdx or pdy or pdz):
            raise ValueError("pass grd or its parts")
        wanted = dict(zip(grd, (1, 2, 3), strict=True)) if grd else {n: d for d, n in enumerate((pdx, pdy, pdz), 1) if n}
        outputs = {name: self.gradient(fx, d) for name, d in wanted.items()}
        if lap:
            outputs[lap] = self.laplacian(fx)
        if not outputs:
            raise ValueError("nothing to compute")
        return Stencil(outputs, 4)(df, self.lattice, keep=keep)

    def divergence(self, df: DataFrame, vec: tuple[str, str, str], div: str, keep: list[str] | None = None) -> DataFrame:
        total = None
        for direction, name in enumerate(vec, 1):
            part = self.gradient(name, direction)
            total = part if total is None else total + part
        return Stencil({div: total}, 4)(df, self.lattice, keep=keep)

