"""Relaxation: sweeps that each read only the state before them."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.expr import Expr, Field, Param, diff, simplify, wrap
from .. import lines
from ..lattice import Lattice
from ..lineage import cut
from ..stencil import Stencil


class RelaxationBase:
    """``lhs_dict``: {unknown field: (left-hand side L(f), source field)} of L(f) = rho.

    Calling runs ``iterations`` sweeps, rounded up to an even number. A parameter ``dx`` of the
    expressions is the lattice's spacing (of its first axis) unless given.
    """

    def __init__(self, lhs_dict: Mapping[Field, tuple[Any, Field]], *, halo_shape: int = 1, omega: float = 1.0, checkpoint_every: int = 2, **params: Any):
        self.lhs = {f: (wrap(lhs), rho) for f, (lhs, rho) in lhs_dict.items()}
        self.f_to_rho = {f.column: rho.column for f, (_, rho) in self.lhs.items()}
        self.halo, self.omega, self.checkpoint_every, self.params = halo_shape, omega, checkpoint_every, params

    def step_operator(self, f: Field, lhs: Expr, rho: Field) -> Expr:
        raise NotImplementedError

    def _given(self, lattice: Lattice, params: Mapping[str, Any]) -> dict[str, Any]:
        return {"dx": lattice.spacing[0], "omega": self.omega} | self.params | dict(params)

    def sweep(self, df: DataFrame, lattice: Lattice, **params: Any) -> DataFrame:
        """One simultaneous update of all unknowns."""
        return Stencil({f: self.step_operator(f, lhs, rho) for f, (lhs, rho) in self.lhs.items()}, self.halo)(df, lattice, **self._given(lattice, params))

    def __call__(self, df: DataFrame, lattice: Lattice, iterations: int = 100, **params: Any) -> DataFrame:
        columns, sweeps = df.columns, iterations + iterations % 2
        steps = {f.column: self.step_operator(f, lhs, rho) for f, (lhs, rho) in self.lhs.items()}
        given = self._given(lattice, params)
        # Lines pay for being packed from the second sweep on; every iterated call has two.
        by_lines = sweeps > 0 and lines.fits(steps, given)
        if by_lines:
            df = lines.pack(df, lattice)
        for n in range(sweeps):
            df = lines.sweep(df, lattice, steps, given) if by_lines else self.sweep(df, lattice, **params)
            if (n + 1) % self.checkpoint_every == 0:
                df = cut(df)
        return (lines.unpack(df, lattice) if by_lines else df).select(*columns)

    def residual(self, df: DataFrame, lattice: Lattice, **params: Any) -> DataFrame:
        """Add columns r_{f} = rho - L(f)."""
        return Stencil({f"r_{f.column}": simplify(rho - lhs) for f, (lhs, rho) in self.lhs.items()}, self.halo)(df, lattice, **self._given(lattice, params))

    def lhs_correction(self, df: DataFrame, lattice: Lattice, **params: Any) -> DataFrame:
        """Set each source to r_{f} + L(f)."""
        return Stencil({rho: Field(f"r_{f.column}") + lhs for f, (lhs, rho) in self.lhs.items()}, self.halo)(df, lattice, **self._given(lattice, params))

    def get_error(self, df: DataFrame, lattice: Lattice, **params: Any) -> dict[str, tuple[float, float]]:
        """{f: (max |r|, sqrt of the mean of r^2)}."""
        row = self.errors(df, lattice, **params).first()
        return {f: (row[f"max_{f}"], row[f"rms_{f}"]) for f in self.f_to_rho}

    def errors(self, df: DataFrame, lattice: Lattice, **params: Any) -> DataFrame:
        found = self.residual(df, lattice, **params)
        parts = []
        for f in self.f_to_rho:
            r = F.col(f"r_{f}")
            parts += [F.max(F.abs(r)).alias(f"max_{f}"), F.sqrt(F.sum(r * r) / lattice.cells).alias(f"rms_{f}")]
        return found.agg(*parts)


class JacobiIterator(RelaxationBase):
    """(1 - omega) f + omega (rho - (L - D) f) / D for linear L, D the derivative of L by f in the cell itself."""

    def step_operator(self, f: Field, lhs: Expr, rho: Field) -> Expr:
        d = diff(lhs, f)
        omega = Param("omega")
        rest = lhs - d * f
        return (1 - omega) * f + omega * (rho - rest) / d


class NewtonIterator(RelaxationBase):
    """f - omega (L(f) - rho) / (dL / df)."""

    def step_operator(self, f: Field, lhs: Expr, rho: Field) -> Expr:
        return f - Param("omega") * (lhs - rho) / diff(lhs, f)


