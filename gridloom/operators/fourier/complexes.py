"""Complex numbers as pairs of columns; Spark has no complex type."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


@dataclass(frozen=True)
class Z:
    re: Any
    im: Any = 0.0

    @classmethod
    def of(cls, name: str) -> Z:
        return cls(F.col(f"{name}_re"), F.col(f"{name}_im"))

    @classmethod
    def wrap(cls, x: Any) -> Z:
        if isinstance(x, Z):
            return x
        return cls(x.real, x.imag) if isinstance(x, complex) else cls(x, 0.0)

    def __add__(self, o):
        o = Z.wrap(o)
        return Z(_plus(self.re, o.re), _plus(self.im, o.im))

    __radd__ = __add__

    def __neg__(self):
        return Z(_times(-1.0, self.re), _times(-1.0, self.im))

    def __sub__(self, o):
        return self + -Z.wrap(o)

    def __mul__(self, o):
        o = Z.wrap(o)
        return Z(_plus(_times(self.re, o.re), _times(-1.0, _times(self.im, o.im))), _plus(_times(self.re, o.im), _times(self.im, o.re)))

    __rmul__ = __mul__

    def conj(self) -> Z:
        return Z(self.re, _times(-1.0, self.im))

    def abs2(self) -> Column:
        return _column(self.re) * _column(self.re) + _column(self.im) * _column(self.im)

    def where(self, condition: Column, other: Any = 0.0) -> Z:
        """This number where the condition holds, else the other."""
        o = Z.wrap(other)
        return Z(F.when(condition, _column(self.re)).otherwise(_column(o.re)), F.when(condition, _column(self.im)).otherwise(_column(o.im)))

    def named(self, name: str) -> dict[str, Column]:
        return {f"{name}_re": _column(self.re), f"{name}_im": _column(self.im)}


def _zero(x: Any) -> bool:
    return not isinstance(x, Column) and x == 0


def _plus(a: Any, b: Any) -> Any:
    return b if _zero(a) else a if _zero(b) else a + b


def _times(a: Any, b: Any) -> Any:
    if _zero(a) or _zero(b):
        return 0.0
    return b if not isinstance(a, Column) and a == 1 else a * b
