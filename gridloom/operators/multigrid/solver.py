"""Multigrid: relaxation on lattices of halved resolution, as a driver loop over plans."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lattice import Lattice
from ..lineage import cut
from .relax import RelaxationBase
from .transfer import FullWeighting, LinearInterpolation

Cycle = list[tuple[int, int]]


def mu_cycle(mu: int, i: int, nu1: int, nu2: int, depth: int) -> Cycle:
    """(level, iterations): go down to ``depth`` and back, visiting each coarser level ``mu`` times."""
    if i == depth:
        return [(i, nu2)]
    below: Cycle = []
    for _ in range(mu):
        part = mu_cycle(mu, i + 1, nu1, nu2, depth)
        below += part[1:] if below and part and below[-1][0] == part[0][0] else part
    return [(i, nu1), *below, (i, nu2)]


def v_cycle(nu1: int, nu2: int, depth: int) -> Cycle:
    return mu_cycle(1, 0, nu1, nu2, depth)


def w_cycle(nu1: int, nu2: int, depth: int) -> Cycle:
    return mu_cycle(2, 0, nu1, nu2, depth)


def f_cycle(nu1: int, nu2: int, depth: int) -> Cycle:
    """Down once; then reach each finer level by a V over the levels below it."""
    out = [(i, nu1) for i in range(depth)] + [(depth, nu2)] + [(i, nu2) for i in range(depth - 1, depth - 2, -1) if i >= 0]
    for goal in reversed(range(depth - 1)):
        out += [(i, nu1) for i in range(goal + 2, depth)] + [(i, nu2) for i in range(depth, goal - 1, -1)]
    return out


class FullApproximationScheme:
    """Nonlinear multigrid. ``solver`` is a relaxation; fields move between levels by ``Restrictor`` and ``Interpolator``.

    A level's state is a DataFrame with unknowns, sources and auxiliary columns. In both transfers the
    level named is the one that is entered. Errors cost two passes over a level a visit; without ``log_errors`` none are taken.
    """

    def __init__(self, solver: RelaxationBase, Restrictor: Any = FullWeighting, Interpolator: Any = LinearInterpolation, *, log_errors: bool = True):  # noqa: N803
        self.solver, self.restrict, self.interpolate, self.log_errors = solver, Restrictor(), Interpolator(), log_errors
        self.unknowns, self.sources = list(solver.f_to_rho), list(solver.f_to_rho.values())

    def setup(self, df: DataFrame, lattice: Lattice, depth: int) -> None:
        """Levels of halved lattices; auxiliary columns are restricted, unknowns and sources come with the first transfer."""
        self.lattices, self.states = [lattice], [df]
        auxiliary = [c for c in lattice.values(df) if c not in (*self.unknowns, *self.sources)]
        for level in range(1, depth + 1):
            finer = self.lattices[-1]
            self.lattices.append(finer.coarser())
            # A level may be set up without auxiliary columns; its state is then made on entry.
            self.states.append(self.restrict(self.states[-1], finer, *auxiliary) if auxiliary else None)

    def transfer_down(self, i: int, **params: Any) -> None:
        fine, finer = self.states[i - 1], self.lattices[i - 1]
        moved = self.restrict(self.solver.residual(fine, finer, **params), finer, *self.unknowns, *[f"r_{f}" for f in self.unknowns])
        before = self.states[i]
        state = moved if before is None else moved.join(before.drop(*self.unknowns, *self.sources, *[f"r_{f}" for f in self.unknowns]), finer.keys)
        state = state.withColumns({rho: F.lit(0.0) for rho in self.sources})
        self.states[i] = cut(self.solver.lhs_correction(state, self.lattices[i], **params).drop(*[f"r_{f}" for f in self.unknowns]))

    def transfer_up(self, i: int, **params: Any) -> None:
        finer = self.lattices[i]
        change = self.restrict.correct(self.states[i], self.states[i + 1], finer, *self.unknowns).select(*finer.keys, *self.unknowns)
        self.states[i] = cut(self.interpolate.correct(change, self.states[i], finer, *self.unknowns))

    def smooth(self, i: int, nu: int, **params: Any) -> list[tuple[int, dict]]:
        """Errors before and after ``nu`` sweeps on a level."""
        error = lambda: [(i, self.solver.get_error(self.states[i], self.lattices[i], **params))] if self.log_errors else []
        before = error()
        self.states[i] = self.solver(self.states[i], self.lattices[i], iterations=nu, **params)
        return before + error()

    def __call__(self, df: DataFrame, lattice: Lattice, cycle: Cycle | None = None, **params: Any) -> tuple[DataFrame, list[tuple[int, dict]]]:
        """The state after a cycle, V(25, 50) to lattices of 8 cells by default, and the errors along it."""
        if cycle is None:
            cycle = v_cycle(25, 50, int(math.log2(min(lattice.shape) / 8)))
        if cycle[0][0] != 0 or any(abs(a - b) != 1 for (a, _), (b, _) in zip(cycle, cycle[1:], strict=False)):
            raise ValueError("consecutive levels must be spaced by one")
        self.setup(df, lattice, max(i for i, _ in cycle))
        errors = self.smooth(0, cycle[0][1], **params)
        for (last, _), (i, nu) in zip(cycle, cycle[1:], strict=False):
            (self.transfer_down if i > last else self.transfer_up)(i, **params)
            errors += self.smooth(i, nu, **params)
        return self.states[0], errors


class MultiGridSolver(FullApproximationScheme):
    """Linear multigrid: coarse levels solve for the error, with the residual as their source, from 0."""

    def transfer_down(self, i: int, **params: Any) -> None:
        fine, finer = self.states[i - 1], self.lattices[i - 1]
        moved = self.restrict(self.solver.residual(fine, finer, **params), finer, *[f"r_{f}" for f in self.unknowns])
        moved = moved.select(*finer.keys, *[F.col(f"r_{f}").alias(rho) for f, rho in self.solver.f_to_rho.items()], *[F.lit(0.0).alias(f) for f in self.unknowns])
        before = self.states[i]
        self.states[i] = cut(moved if before is None else moved.join(before.drop(*self.unknowns, *self.sources), finer.keys))

    def transfer_up(self, i: int, **params: Any) -> None:
        finer = self.lattices[i]
        self.states[i] = cut(self.interpolate.correct(self.states[i + 1].select(*finer.keys, *self.unknowns), self.states[i], finer, *self.unknowns))
