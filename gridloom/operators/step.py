"""Runge-Kutta time steppers: a stage is one projection; the driver loops over stages."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Field, evaluate, lower, wrap
from .lineage import cut
from .maps import name_of


def merged_rhs(source: Any) -> dict[Any, Any]:
    """The right-hand sides of a dict, a sector or a list of sectors."""
    if isinstance(source, Mapping):
        return dict(source)
    if isinstance(source, (list, tuple)):
        out: dict[Any, Any] = {}
        for one in source:
            out |= merged_rhs(one)
        return out
    return dict(source.rhs_dict)


class Stepper:
    """``stepper(stage, df, dt=...)`` runs one stage on the columns of ``df``; ``step`` runs all of them.

    The right-hand sides of a stage are all evaluated on the state before it. Terms of other
    cells, such as Laplacians, are columns that the caller computes before each stage.
    """

    num_stages = 0
    expected_order = 0

    def __init__(self, input: Any, *, dt: float | None = None, params: Mapping[str, Any] | None = None):
        self.rhs = {k: wrap(v) for k, v in merged_rhs(input).items()}
        for k in self.rhs:
            if not isinstance(k, Field):
                raise ValueError(f"{k} isn't a field")
        self.names = [name_of(k) for k in self.rhs]
        self.dt, self.params = dt, dict(params or {})

    def start(self, df: DataFrame) -> DataFrame:
        """Add the columns that the method needs."""
        raise NotImplementedError

    def __call__(self, stage: int, df: DataFrame, *, dt: float | None = None, **params: Any) -> DataFrame:
        raise NotImplementedError

    def finish(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def step(self, df: DataFrame, *, dt: float | None = None, before_stage=None, checkpoint: bool = True, **params: Any) -> DataFrame:
        """A whole step. ``before_stage(df)`` recomputes terms of other cells; the state is then cut off its history, as plans would grow without end."""
        df = self.start(df)
        for stage in range(self.num_stages):
            if before_stage is not None:
                df = before_stage(df)
            df = self(stage, df, dt=dt, **params)
            if before_stage is not None and checkpoint:
                df = cut(df)
        return self.finish(df)

    def registers(self, state: dict[str, Any]) -> list[dict[str, Any]]:
        """The values that the stages of a step pass on, from those at its start: numbers or numpy arrays, for small systems on the driver."""
        raise NotImplementedError

    def current(self, registers: list[dict[str, Any]], stage: int) -> dict[str, Any]:
        """What the right-hand side reads in a stage; for stage ``num_stages`` the values at the step's end."""
        raise NotImplementedError

    def advance(self, registers: list[dict[str, Any]], stage: int, *, dt: float, **params: Any) -> None:
        """One stage, in place."""
        raise NotImplementedError

    def _slopes(self, now: dict[str, Any], params: dict[str, Any]) -> dict[str, Any]:
        return {n: evaluate(e, lambda f: now[f.column], self.params | params) for n, e in zip(self.names, self.rhs.values(), strict=True)}

    def step_array(self, state: dict[str, Any], *, dt: float, **params: Any) -> dict[str, Any]:
        """A whole step."""
        registers = self.registers(state)
        for stage in range(self.num_stages):
            self.advance(registers, stage, dt=dt, **params)
        return self.current(registers, self.num_stages)


class RungeKuttaStepper(Stepper):
    """Classical steppers: copies of each unknown, ``stages[s]`` lists (copy written, weights of copies, weight of dt * rhs) in order.

    The right-hand side reads copy 0 in stage 0 and copy 1 after.
    """

    num_copies = 0
    stages: tuple = ()

    def _copy(self, name: str, q: int) -> str:
        return name if q == 0 else f"__{name}_{q}"

    def start(self, df):
        return df

    def finish(self, df):
        return df.drop(*[self._copy(n, q) for n in self.names for q in range(1, self.num_copies)])

    def __call__(self, stage, df, *, dt=None, **params):
        dt = self.dt if dt is None else dt
        read = 0 if stage == 0 else 1
        column = lambda f: F.col(self._copy(f.column, read) if f.column in self.names else f.column)
        given = self.params | params | {"dt": dt}
        df = df.withColumns({f"__rhs_{n}": lower(e, column, given) for n, e in enumerate(self.rhs.values())})
        for to, copies, weight in self.stages[stage]:
            found = {}
            for n, name in enumerate(self.names):
                value = dt * weight * F.col(f"__rhs_{n}")
                for q, c in copies.items():
                    value = value + (F.col(self._copy(name, q)) if c == 1 else c * F.col(self._copy(name, q)))
                found[self._copy(name, to)] = value
            df = df.withColumns(found)
        return df.drop(*[f"__rhs_{n}" for n in range(len(self.names))])

    def registers(self, state):
        return [dict(state) for _ in range(self.num_copies)]

    def current(self, registers, stage):
        return registers[0 if stage in (0, self.num_stages) else 1]

    def advance(self, registers, stage, *, dt, **params):
        slopes = self._slopes(self.current(registers, stage), params)
        for to, weights, weight in self.stages[stage]:
            registers[to] |= {n: dt * weight * slopes[n] + sum(c * registers[q][n] for q, c in weights.items()) for n in self.names}


class RungeKutta4(RungeKuttaStepper):
    num_stages, expected_order, num_copies = 4, 4, 3
    stages = (
        ((1, {0: 1}, 1 / 2), (2, {0: 1}, 1 / 6)),
        ((1, {0: 1}, 1 / 2), (2, {2: 1}, 1 / 3)),
        ((1, {0: 1}, 1), (2, {2: 1}, 1 / 3)),
        ((0, {2: 1}, 1 / 6),),
    )


class RungeKutta3Heun(RungeKuttaStepper):
    num_stages, expected_order, num_copies = 3, 3, 3
    stages = (((1, {0: 1}, 1 / 3), (2, {0: 1}, 1 / 4)), ((1, {0: 1}, 2 / 3),), ((0, {2: 1}, 3 / 4),))


class RungeKutta3Nystrom(RungeKuttaStepper):
    num_stages, expected_order, num_copies = 3, 3, 3
    stages = (((1, {0: 1}, 2 / 3), (2, {0: 1}, 2 / 8)), ((1, {0: 1}, 2 / 3), (2, {2: 1}, 3 / 8)), ((0, {2: 1}, 3 / 8),))


class RungeKutta3Ralston(RungeKuttaStepper):
    num_stages, expected_order, num_copies = 3, 3, 3
    stages = (((1, {0: 1}, 1 / 2), (2, {0: 1}, 2 / 9)), ((1, {0: 1}, 3 / 4), (2, {2: 1}, 1 / 3)), ((0, {2: 1}, 4 / 9),))


class RungeKutta3SSP(RungeKuttaStepper):
    num_stages, expected_order, num_copies = 3, 3, 2
    stages = (((1, {0: 1}, 1),), ((1, {0: 3 / 4, 1: 1 / 4}, 1 / 4),), ((0, {0: 1 / 3, 1: 2 / 3}, 2 / 3),))


class RungeKutta2Midpoint(RungeKuttaStepper):
    num_stages, expected_order, num_copies = 2, 2, 2
    stages = (((1, {0: 1}, 1 / 2),), ((0, {0: 1}, 1),))


class RungeKutta2Heun(RungeKuttaStepper):
    """May lose an order."""

    num_stages, expected_order, num_copies = 2, 2, 2
    stages = (((1, {0: 1}, 1), (0, {0: 1}, 1 / 2)), ((0, {0: 1}, 1 / 2),))


class RungeKutta2Ralston(RungeKuttaStepper):
    num_stages, expected_order, num_copies = 2, 2, 2
    stages = (((1, {0: 1}, 2 / 3), (0, {0: 1}, 1 / 4)), ((0, {0: 1}, 3 / 4),))


class LowStorageRKStepper(Stepper):
    """Two registers: k = A k + dt rhs, then f = f + B k. Subclasses give A and B of each stage; C, the times, follow from them."""

    A: tuple[float, ...] = ()
    B: tuple[float, ...] = ()

    @classmethod
    def times(cls) -> list[float]:
        """C: the share of the step that has passed at each stage."""
        out, k, f = [], 0.0, 0.0
        for a, b in zip(cls.A, cls.B, strict=True):
            out.append(f)
            k = a * k + 1
            f += b * k
        return out

    def _tmp(self, name: str) -> str:
        return f"__{name}_tmp"

    def start(self, df):
        return df.withColumns({self._tmp(n): F.lit(0.0) for n in self.names})

    def finish(self, df):
        return df.drop(*map(self._tmp, self.names))

    def __call__(self, stage, df, *, dt=None, **params):
        dt = self.dt if dt is None else dt
        given = self.params | params | {"dt": dt}
        df = df.withColumns({f"__rhs_{n}": lower(e, params=given) for n, e in enumerate(self.rhs.values())})
        df = df.withColumns({self._tmp(name): self.A[stage] * F.col(self._tmp(name)) + dt * F.col(f"__rhs_{n}") for n, name in enumerate(self.names)})
        df = df.withColumns({name: F.col(name) + self.B[stage] * F.col(self._tmp(name)) for name in self.names})
        return df.drop(*[f"__rhs_{n}" for n in range(len(self.names))])

    def registers(self, state):
        return [dict(state), dict.fromkeys(self.names, 0.0)]

    def current(self, registers, stage):
        return registers[0]

    def advance(self, registers, stage, *, dt, **params):
        now, tmp = registers
        slopes = self._slopes(now, params)
        tmp |= {n: self.A[stage] * tmp[n] + dt * slopes[n] for n in self.names}
        now |= {n: now[n] + self.B[stage] * tmp[n] for n in self.names}


class LowStorageRK54(LowStorageRKStepper):
    num_stages, expected_order = 5, 4
    # Carpenter and Kennedy, NASA TM 109112 (1994).
    A = (
        0,
        -567301805773 / 1357537059087,
        -2404267990393 / 2016746695238,
        -3550918686646 / 2091501179385,
        -1275806237668 / 842570457699,
    )
    B = (
        1432997174477 / 9575080441755,
        5161836677717 / 13612068292357,
        1720146321549 / 2090206949498,
        3134564353537 / 4481467310338,
        2277821191437 / 14882151754819,
    )


class LowStorageRK144(LowStorageRKStepper):
    num_stages, expected_order = 14, 4
    # Niegemann, Diehl and Busch, J. Comput. Phys. 231 (2012) 364.
    A = (
        0,
        -0.7188012108672410,
        -0.7785331173421570,
        -0.0053282796654044,
        -0.8552979934029281,
        -3.9564138245774565,
        -1.5780575380587385,
        -2.0837094552574054,
        -0.7483334182761610,
        -0.7032861106563359,
        0.0013917096117681,
        -0.0932075369637460,
        -0.9514200470875948,
        -7.1151571693922548,
    )
    B = (
        0.0367762454319673,
        0.3136296607553959,
        0.1531848691869027,
        0.0030097086818182,
        0.3326293790646110,
        0.2440251405350864,
        0.3718879239592277,
        0.6204126221582444,
        0.1524043173028741,
        0.0760894927419266,
        0.0077604214040978,
        0.0024647284755382,
        0.0780348340049386,
        5.5059777270269628,
    )


class LowStorageRK134(LowStorageRKStepper):
    num_stages, expected_order = 13, 4
    # Fixed values, from the same paper. All A are negative there; with the other sign the method loses its order.
    A = (
        0,
        -0.6160178650170565,
        -0.4449487060774118,
        -1.0952033345276178,
        -1.2256030785959187,
        -0.2740182222332805,
        -0.0411952089052647,
        -0.179708489915356,
        -1.1771530652064288,
        -0.4078831463120878,
        -0.8295636426191777,
        -4.789597058425229,
        -0.6606671432964504,
    )
    B = (
        0.0271990297818803,
        0.1772488819905108,
        0.0378528418949694,
        0.6086431830142991,
        0.21543139743161,
        0.2066152563885843,
        0.0415864076069797,
        0.0219891884310925,
        0.9893081222650993,
        0.0063199019859826,
        0.3749640721105318,
        1.6080235151003195,
        0.0961209123818189,
    )


class LowStorageRK124(LowStorageRKStepper):
    num_stages, expected_order = 12, 4
    # Fixed values, from the same paper. All A are negative there; with the other sign the method loses its order.
    A = (
        0,
        -0.0923311242368072,
        -0.9441056581158819,
        -4.327127324757639,
        -2.155777132902607,
        -0.9770727190189062,
        -0.7581835342571139,
        -1.79775254708255,
        -2.691566797270077,
        -4.646679896026814,
        -0.1539613783825189,
        -0.5943293901830616,
    )
    B = (
        0.0650008435125904,
        0.0161459902249842,
        0.5758627178358159,
        0.1649758848361671,
        0.3934619494248182,
        0.0443509641602719,
        0.2074504268408778,
        0.6914247433015102,
        0.3766646883450449,
        0.0757190350155483,
        0.2027862031054088,
        0.2167029365631842,
    )


class LowStorageRK3Williamson(LowStorageRKStepper):
    num_stages, expected_order = 3, 3
    A, B = (0, -5 / 9, -153 / 128), (1 / 3, 15 / 16, 8 / 15)


class LowStorageRK3Inhomogeneous(LowStorageRKStepper):
    num_stages, expected_order = 3, 3
    A, B = (0, -17 / 32, -32 / 27), (1 / 4, 8 / 9, 3 / 4)


class LowStorageRK3Symmetric(LowStorageRKStepper):
    """May lose an order."""

    num_stages, expected_order = 3, 3
    A, B = (0, -2 / 3, -1), (1 / 3, 1, 1 / 2)


class LowStorageRK3PredictorCorrector(LowStorageRKStepper):
    """May lose an order."""

    num_stages, expected_order = 3, 3
    A, B = (0, -1 / 4, -4 / 3), (1 / 2, 2 / 3, 1 / 2)


def third_order(c2: float, c3: float) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """A and B of the three-stage, third-order low-storage method whose stages lie at 0, c2 and c3.

    Third order asks b2 c2 + b3 c3 = 1/2, b2 c2^2 + b3 c3^2 = 1/3 and b1 + b2 + b3 = 1. With B1 = c2 the
    registers give c3 = c2 + B2 (1 + A2), b3 = B3, b2 = B2 + A3 B3 and b1 = B1 + A2 b2.
    """
    b2, b3 = np.linalg.solve([[c2, c3], [c2 * c2, c3 * c3]], [1 / 2, 1 / 3])
    a2 = (1 - b2 - b3 - c2) / b2
    second = (c3 - c2) / (1 + a2)
    return (0, float(a2), float((b2 - second) / b3)), (c2, float(second), float(b3))


def _ssp_stage(c2: float) -> float:
    """The c3 for which the method of ``third_order`` also meets b3 a32 c2 = 1/6, by bisection."""

    def miss(c3: float) -> float:
        (_, _, _), (_, second, b3) = third_order(c2, c3)
        return b3 * second * c2 - 1 / 6

    low, high = 0.25, 0.6
    for _ in range(200):
        middle = (low + high) / 2
        if miss(low) * miss(middle) <= 0:
            high = middle
        else:
            low = middle
    return (low + high) / 2


class LowStorageRK3SSP(LowStorageRKStepper):
    """Strong-stability preserving, of the one-parameter family at c2 = 0.924574."""

    num_stages, expected_order = 3, 3
    A, B = third_order(0.924574, _ssp_stage(0.924574))


all_steppers = [
    RungeKutta4, RungeKutta3SSP, RungeKutta3Heun, RungeKutta3Nystrom, RungeKutta3Ralston, RungeKutta2Midpoint, RungeKutta2Ralston,
    LowStorageRK54, LowStorageRK144, LowStorageRK3Williamson, LowStorageRK3Inhomogeneous, LowStorageRK3SSP,
]
#: These are usable but not part of the list above.
more_steppers = [RungeKutta2Heun, LowStorageRK134, LowStorageRK124, LowStorageRK3Symmetric, LowStorageRK3PredictorCorrector]

