"""Relaxation and multigrid solvers of boundary-value problems on periodic lattices."""

from .relax import JacobiIterator, NewtonIterator, RelaxationBase
from .solver import FullApproximationScheme, MultiGridSolver, f_cycle, mu_cycle, v_cycle, w_cycle
from .transfer import CubicInterpolation, FullWeighting, Injection, LinearInterpolation

__all__ = [
    "CubicInterpolation", "FullApproximationScheme", "FullWeighting", "Injection", "JacobiIterator", "LinearInterpolation",
    "MultiGridSolver", "NewtonIterator", "RelaxationBase", "f_cycle", "mu_cycle", "v_cycle", "w_cycle",
]
