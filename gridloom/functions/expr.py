"""A small expression tree over lattice fields.

Spark's Column is opaque in Python, so it can't be differentiated or shifted. An Expr
can; it is lowered to a Column (or evaluated with numpy) once no rewrite is left to do.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("i", "j", "k")


class Expr:
    """Base of all nodes; arithmetic builds new nodes."""

    def __add__(self, o):
        return _op("+", self, o)

    def __radd__(self, o):
        return _op("+", o, self)

    def __sub__(self, o):
        return _op("-", self, o)

    def __rsub__(self, o):
        return _op("-", o, self)

    def __mul__(self, o):
        return _op("*", self, o)

    def __rmul__(self, o):
        return _op("*", o, self)

    def __truediv__(self, o):
        return _op("/", self, o)

    def __rtruediv__(self, o):
        return _op("/", o, self)

    def __pow__(self, o):
        return _op("**", self, o)

    def __rpow__(self, o):
        return _op("**", o, self)

    def __floordiv__(self, o):
        return _op("//", self, o)

    def __mod__(self, o):
        return _op("%", self, o)

    def __neg__(self):
        return _op("*", -1, self)

    def __abs__(self):
        return Call("abs", (self,))

    def children(self) -> tuple[Expr, ...]:
        return ()

    def rebuilt(self, children: tuple[Expr, ...]) -> Expr:
        return self


@dataclass(frozen=True)
class Const(Expr):
    value: float

    def __str__(self):
        return str(self.value)


@dataclass(frozen=True)
class Param(Expr):
    """A scalar given when the expression is lowered."""

    name: str

    def __str__(self):
        return self.name


@dataclass(frozen=True)
class Field(Expr):
    """A named lattice array.

    ``offset`` is the place read relative to the cell; ``base_offset`` is padding that shifts
    never change; a scalar holds for all axes. ``shape`` gives the outer axes, which are chosen by
    subscripts and become part of the column's name: ``f[0, 1]`` is column f_0_1. ``indices``
    may be fewer than three; none make it a scalar. Extents and padding that are known by name only are strings.
    """

    child: str
    offset: Any = 0
    shape: tuple[int | str, ...] = ()
    indices: tuple[str, ...] = AXES
    ignore_prepends: bool = False
    base_offset: Any = None
    dtype: str | None = None
    outer: tuple[int, ...] = ()

    def __post_init__(self):
        for name in ("offset", "base_offset"):
            value = getattr(self, name)
            value = self.offset if value is None else value
            if not isinstance(value, tuple):
                value = (value,) * len(self.indices)
            if len(value) != len(self.indices):
                raise ValueError(f"{name} of {self.child} has {len(value)} parts for {len(self.indices)} indices")
            object.__setattr__(self, name, value)

    def __getitem__(self, index) -> Field:
        index = index if isinstance(index, tuple) else (index,)
        if len(self.outer) + len(index) > len(self.shape):
            raise IndexError(f"{self.child} has {len(self.shape)} outer axes")
        axes = self.shape[len(self.outer) :]
        if any(isinstance(n, int) and not 0 <= i < n for i, n in zip(index, axes, strict=False)):
            raise IndexError(f"{index} is outside of {axes}")
        return replace(self, outer=self.outer + index)

    @property
    def column(self) -> str:
        return "_".join([self.child, *map(str, self.outer)])

    def shifted(self) -> tuple[int, ...]:
        """The read place relative to the cell, without padding."""
        return tuple(0 if o == b else o - b for o, b in zip(self.offset, self.base_offset, strict=True))

    def __str__(self):
        return str(index_fields(self))


class DynamicField(Field):
    """A field with linked columns: its rate ``dot`` (d{f}dt), its Laplacian ``lap`` (lap_{f}) and its gradient ``pd`` (d{f}dx, last axis 3)."""

    @property
    def dot(self) -> Field:
        return Field(f"d{self.child}dt", self.offset, self.shape, self.indices, self.ignore_prepends, self.base_offset, self.dtype, self.outer)

    @property
    def lap(self) -> Field:
        return Field(f"lap_{self.child}", 0, self.shape, self.indices, self.ignore_prepends, None, self.dtype, self.outer)

    @property
    def pd(self) -> Field:
        return Field(f"d{self.child}dx", 0, (*self.shape, 3), self.indices, self.ignore_prepends, None, self.dtype, self.outer)

    def d(self, *index: int) -> Field:
        """``d(*outer, mu)``: the rate for mu = 0, else derivative mu - 1."""
        *outer, mu = index
        base = self[tuple(outer)] if outer else self
        return base.dot if mu == 0 else base.pd[mu - 1]


@dataclass(frozen=True)
class Op(Expr):
    op: str
    a: Expr
    b: Expr

    def children(self):
        return self.a, self.b

    def rebuilt(self, children):
        return _op(self.op, *children)

    def __str__(self):
        return f"({self.a} {self.op} {self.b})"


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]

    def children(self):
        return self.args

    def rebuilt(self, children):
        return Call(self.name, tuple(children))

    def __str__(self):
        return f"{self.name}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Compare(Expr):
    a: Expr
    op: str
    b: Expr

    def __post_init__(self):
        for name in ("a", "b"):
            object.__setattr__(self, name, wrap(getattr(self, name)))

    def children(self):
        return self.a, self.b

    def rebuilt(self, children):
        return Compare(children[0], self.op, children[1])

    def __str__(self):
        return f"{self.a} {self.op} {self.b}"


@dataclass(frozen=True)
class Logical(Expr):
    op: str
    parts: tuple[Expr, ...]

    def children(self):
        return self.parts

    def rebuilt(self, children):
        return Logical(self.op, tuple(children))

    def __str__(self):
        return f" {self.op} ".join(map(str, self.parts))


def LogicalAnd(*parts: Expr) -> Logical:  # noqa: N802  reads as a node
    return Logical("and", parts)


def LogicalOr(*parts: Expr) -> Logical:  # noqa: N802
    return Logical("or", parts)


@dataclass(frozen=True)
class If(Expr):
    condition: Expr
    then: Expr
    otherwise: Expr

    def __post_init__(self):
        for name in ("then", "otherwise"):
            object.__setattr__(self, name, wrap(getattr(self, name)))

    def children(self):
        return self.condition, self.then, self.otherwise

    def rebuilt(self, children):
        return If(*children)

    def __str__(self):
        return f"({self.then} if {self.condition} else {self.otherwise})"


def wrap(x: Any) -> Expr:
    if isinstance(x, Expr):
        return x
    if isinstance(x, str):
        return parse(x)
    return Const(x)


def _op(op: str, a: Any, b: Any) -> Expr:
    return Op(op, wrap(a), wrap(b))


def call(name: str, *args: Any) -> Call:
    return Call(name, tuple(map(wrap, args)))


def parse(text: str) -> Expr:
    """A formula in Python's notation; its names are parameters."""
    ops = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "**", ast.FloorDiv: "//", ast.Mod: "%"}
    compares = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "==", ast.NotEq: "!="}

    def build(node) -> Expr:
        match node:
            case ast.Expression(body=body):
                return build(body)
            case ast.Constant(value=value):
                return Const(value)
            case ast.Name(id=name):
                return Param(name)
            case ast.BinOp(left=a, op=op, right=b):
                return _op(ops[type(op)], build(a), build(b))
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return -build(a)
            case ast.Call(func=ast.Name(id=name), args=args):
                return Call(name, tuple(map(build, args)))
            case ast.IfExp(test=test, body=a, orelse=b):
                return If(build(test), build(a), build(b))
            case ast.Compare(left=a, ops=[op], comparators=[b]):
                return Compare(build(a), compares[type(op)], build(b))
        raise ValueError(f"can't read {ast.unparse(node)}")

    return build(ast.parse(text, mode="eval"))


def walk(expr: Expr) -> Iterator[Expr]:
    yield expr
    for child in expr.children():
        yield from walk(child)


def transform(expr: Expr, change: Callable[[Expr], Expr | None]) -> Expr:
    """Rebuild a tree; ``change`` returns a replacement for a node, or None to go on below it."""
    found = change(expr)
    if found is not None:
        return found
    children = expr.children()
    return expr.rebuilt(tuple(transform(c, change) for c in children)) if children else expr


def fields_of(*exprs: Any) -> list[Field]:
    """The distinct fields of expressions, by name. Two fields of one name must agree in shape."""
    found: dict[tuple, Field] = {}
    shapes: dict[str, tuple] = {}
    for e in exprs:
        for node in walk(wrap(e)):
            if isinstance(node, Field):
                if shapes.setdefault(node.child, node.shape) != node.shape:
                    raise ValueError(f"{node.child} has shapes {shapes[node.child]} and {node.shape}")
                found.setdefault((node.column, node.shifted()), node)
    return [found[k] for k in sorted(found, key=str)]


@dataclass(frozen=True)
class FieldArg:
    """The array that a field's name stands for: its whole shape, padding included. Without a shape it is a scalar."""

    name: str
    shape: tuple[int | str, ...]
    dtype: str | None = None


def _trees(exprs: Any) -> Iterator[Expr]:
    """The expressions in nested mappings (keys and values) and sequences."""
    if isinstance(exprs, Mapping):
        for pair in exprs.items():
            yield from _trees(pair)
    elif isinstance(exprs, (list, tuple, set)):
        for one in exprs:
            yield from _trees(one)
    else:
        yield wrap(exprs)


def _fields_in(exprs: Any) -> Iterator[Field]:
    return (node for tree in _trees(exprs) for node in walk(tree) if isinstance(node, Field))


def _padded(cells: int | str, halo: int | str) -> int | str:
    """An extent with padding at both ends."""
    if isinstance(cells, int) and isinstance(halo, int):
        return cells + 2 * halo
    if halo == 0:
        return cells
    return f"{cells}+{2 * halo}" if isinstance(halo, int) else f"{cells}+2*{halo}"


def field_args(exprs: Any, cells: tuple[int | str, ...] = ("Nx", "Ny", "Nz"), prepend_with: tuple[int | str, ...] = ()) -> list[FieldArg]:
    """The arrays that expressions (one, or nested mappings and sequences of them) read and write, by name.

    A shape is ``prepend_with`` (unless the field ignores it), the outer axes, and ``cells`` padded by the field's own
    ``base_offset``; extents may be names. Fields of one name whose shapes differ raise ValueError.
    """
    found: dict[str, FieldArg] = {}
    for f in _fields_in(exprs):
        extent = dict(zip(AXES, cells, strict=True))
        spatial = [_padded(extent.get(x, f"N{x}"), h) for x, h in zip(f.indices, f.base_offset, strict=True)]
        arg = FieldArg(f.child, (*(() if f.ignore_prepends else prepend_with), *f.shape, *spatial), f.dtype)
        if found.setdefault(f.child, arg).shape != arg.shape:
            raise ValueError(f"{f.child} has shapes {found[f.child].shape} and {arg.shape}")
    return [found[name] for name in sorted(found)]


def field_indices(exprs: Any) -> list[str]:
    """The spatial indices that any field of the expressions has, sorted."""
    return sorted({x for f in _fields_in(exprs) for x in f.indices})


def loop_domain(exprs: Any) -> dict[str, tuple[int, str]]:
    """The cells that the expressions run over: {index: (first, the name of the end)}; in a frame these are its keys."""
    return {x: (0, f"N{x}") for x in field_indices(exprs)}


def parameters_of(*exprs: Any) -> list[str]:
    return sorted({n.name for e in exprs for n in walk(wrap(e)) if isinstance(n, Param)})


def shift_fields(expr: Expr, shift: tuple[int, ...]) -> Expr:
    """Every field read ``shift`` cells away."""

    def change(node):
        if isinstance(node, Field) and node.indices:
            return replace(node, offset=tuple(_plus(o, s) for o, s in zip(node.offset, shift, strict=True)))
        return None

    return transform(wrap(expr), change)


def _plus(offset: Any, shift: int) -> Any:
    return offset + shift if not isinstance(offset, str) else (f"{offset} + {shift}" if shift else offset)


def substitute(expr: Expr, replacements: Mapping[Expr | str, Any]) -> Expr:
    """Replace sub-expressions; a string key stands for the parameter of that name."""
    table = {Param(k) if isinstance(k, str) else k: wrap(v) for k, v in replacements.items()}
    return transform(wrap(expr), lambda node: table.get(node))


@dataclass(frozen=True)
class Access(Expr):
    """An array element: prepended, outer and spatial subscripts in that order."""

    name: str
    subscripts: tuple[str, ...] = field(default=())

    def __str__(self):
        return f"{self.name}[{', '.join(self.subscripts)}]" if self.subscripts else self.name


def index_fields(expr: Expr, prepend_with: tuple | None = None) -> Expr:
    """Fields as array elements: prepended subscripts first (unless a field ignores them), then outer ones, then indices with offsets."""

    def change(node):
        if not isinstance(node, Field):
            return None
        before = () if node.ignore_prepends else tuple(map(str, prepend_with or ()))
        spatial = tuple(i if o == 0 else f"{i} + {o}" for i, o in zip(node.indices, node.offset, strict=True))
        return Access(node.child, (*before, *map(str, node.outer), *spatial))

    return transform(wrap(expr), change)


# --- calculus

_DERIVATIVES: dict[str, Callable[..., Expr]] = {
    "sqrt": lambda x: 1 / (2 * Call("sqrt", (x,))),
    "exp": lambda x: Call("exp", (x,)),
    "expm1": lambda x: Call("exp", (x,)),
    "log": lambda x: 1 / x,
    "sin": lambda x: Call("cos", (x,)),
    "cos": lambda x: -Call("sin", (x,)),
    "tan": lambda x: 1 + Call("tan", (x,)) ** 2,
    "sinh": lambda x: Call("cosh", (x,)),
    "cosh": lambda x: Call("sinh", (x,)),
    "tanh": lambda x: 1 - Call("tanh", (x,)) ** 2,
}
_NONSMOOTH: dict[str, tuple[str, Callable[..., Expr]]] = {
    "abs": ("continuous", lambda x: Call("sign", (x,))),
    "fabs": ("continuous", lambda x: Call("sign", (x,))),
    "sign": ("discontinuous", lambda x: Const(0)),
    "floor": ("discontinuous", lambda x: Const(0)),
    "round": ("discontinuous", lambda x: Const(0)),
}
_SMOOTHNESS = ("none", "continuous", "discontinuous")


def diff(f: Any, *xs: Any, allowed_nonsmoothness: str = "discontinuous") -> Expr:
    """Derivatives by each of ``xs`` in turn; ``t``, ``x``, ``y``, ``z`` give a DynamicField's linked columns.

    ``allowed_nonsmoothness`` is none, continuous or discontinuous: functions beyond it
    raise ValueError. A condition's branches are differentiated, the condition isn't.
    """
    expr = wrap(f)
    for x in xs:
        expr = simplify(_diff(expr, wrap(x), _SMOOTHNESS.index(allowed_nonsmoothness)))
    return expr


def _diff(e: Expr, x: Expr, allowed: int) -> Expr:
    d = lambda y: _diff(y, x, allowed)
    if e == x:
        return Const(1)
    match e:
        case DynamicField() if isinstance(x, Param) and x.name in ("t", "x", "y", "z"):
            return e.d(("t", "x", "y", "z").index(x.name))
        case Const() | Param() | Field() | Access():
            return Const(0)
        case Op("+", a, b):
            return d(a) + d(b)
        case Op("-", a, b):
            return d(a) - d(b)
        case Op("*", a, b):
            return d(a) * b + a * d(b)
        case Op("/", a, b):
            return d(a) / b - a * d(b) / b**2
        case Op("**", a, Const(n)):
            return n * a ** (n - 1) * d(a)
        case Op("**", a, b):
            return e * (d(b) * Call("log", (a,)) + b * d(a) / a)
        case Call(name, (a,)) if name in _DERIVATIVES:
            return _DERIVATIVES[name](a) * d(a)
        case Call(name, (a,)) if name in _NONSMOOTH:
            kind, rule = _NONSMOOTH[name]
            if _SMOOTHNESS.index(kind) > allowed:
                raise ValueError(f"{name} isn't smooth")
            return rule(a) * d(a)
        case Call(("min" | "max") as name, (a, b)):
            if allowed < 1:
                raise ValueError(f"{name} isn't smooth")
            return If(Compare(a, "<=" if name == "min" else ">=", b), d(a), d(b))
        case If(c, a, b):
            if allowed < 2:
                raise ValueError("a condition isn't smooth")
            return If(c, d(a), d(b))
    raise ValueError(f"can't differentiate {e}")


def simplify(expr: Any) -> Expr:
    """Fold constants and drop neutral elements."""
    e = wrap(expr)
    children = e.children()
    if children:
        e = e.rebuilt(tuple(map(simplify, children)))
    match e:
        case Op(op, Const(a), Const(b)) if not (op in ("/", "//", "%") and b == 0):
            return Const(_NUMPY_OPS[op](a, b))
        case Op("+", Const(0), x) | Op("+", x, Const(0)) | Op("-", x, Const(0)):
            return x
        case Op("*", Const(0), _) | Op("*", _, Const(0)) | Op("/", Const(0), _):
            return Const(0)
        case Op("*", Const(1), x) | Op("*", x, Const(1)) | Op("/", x, Const(1)) | Op("**", x, Const(1)):
            return x
        case Op("**", _, Const(0)):
            return Const(1)
        case Op("*", Const(a), Op("*", Const(b), x)):
            return simplify(Const(a * b) * x)
        case If(_, a, b) if a == b:
            return a
    return e


# --- lowering

_NUMPY_OPS = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a / b,
    "**": lambda a, b: a**b,
    "//": lambda a, b: np.floor_divide(a, b) if isinstance(a, np.ndarray) else a // b,
    "%": lambda a, b: a % b,
}
_COLUMN_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    # IEEE division: by zero it gives an infinity or NaN, where Spark would raise.
    "/": lambda a, b: F.when(b.cast("double") != 0, a / F.when(b.cast("double") != 0, b)).otherwise(
        F.when((a.cast("double") == 0) | F.isnan(a.cast("double")) | F.isnan(b.cast("double")), F.lit(math.nan)).otherwise(F.signum(a.cast("double")) * F.lit(math.inf))
    ),
    "**": lambda a, b: F.pow(a, b),
    "//": lambda a, b: F.floor(a / b),
    "%": lambda a, b: F.pmod(a, b),
}
_COLUMN_CALLS: dict[str, Callable[..., Column]] = {
    "sqrt": F.sqrt,
    "exp": F.exp,
    # ln is null at 0 in Spark; here as elsewhere it is minus infinity, and NaN below.
    "log": lambda x: F.when(x > 0, F.ln(x)).otherwise(F.when(x == 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))),
    "fabs": F.abs,
    "abs": F.abs,
    "floor": F.floor,
    "round": F.round,
    "min": F.least,
    "max": F.greatest,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "expm1": F.expm1,
    # As copysign(1, x): 1 at 0.
    "sign": lambda x: F.when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0)),
}
_NUMPY_CALLS: dict[str, Callable[..., Any]] = {
    **{n: getattr(np, n) for n in ("sqrt", "exp", "log", "floor", "sin", "cos", "tan", "sinh", "cosh", "tanh", "expm1")},
    "fabs": np.abs,
    "abs": np.abs,
    "round": lambda x: np.copysign(np.floor(np.abs(x) + 0.5), x),
    "min": np.minimum,
    "max": np.maximum,
    "sign": lambda x: np.copysign(1.0, x),
}
_COMPARES: dict[str, Callable[[Any, Any], Any]] = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def lower(expr: Any, field_column: Callable[[Field], Column] | None = None, params: Mapping[str, Any] | None = None) -> Column:
    """The expression as a Column. ``field_column`` tells where a field's value is; by default in the column of its name."""
    params = params or {}

    def of(e: Expr) -> Column:
        match e:
            case Const(value):
                return F.lit(value)
            case Param(name):
                value = params[name] if name in params else F.col(name)
                return value if isinstance(value, Column) else F.lit(value)
            case Field():
                if field_column is not None:
                    return field_column(e)
                if any(e.shifted()):
                    raise ValueError(f"{e} reads another cell; use a stencil")
                return F.col(e.column)
            case Op("**", a, Const(2)):
                return of(a) * of(a)
            case Op(op, a, b):
                return _COLUMN_OPS[op](of(a), of(b))
            case Call(name, args):
                return _COLUMN_CALLS.get(name, lambda *a: F.call_function(name, *a))(*map(of, args))
            case Compare(a, op, b):
                return _COMPARES[op](of(a), of(b))
            case Logical(op, parts):
                found = of(parts[0])
                for p in parts[1:]:
                    found = found & of(p) if op == "and" else found | of(p)
                return found
            case If(c, a, b):
                return F.when(of(c), of(a)).otherwise(of(b))
        raise TypeError(f"can't lower {e!r}")

    return of(wrap(expr))


def evaluate(expr: Any, value: Callable[[Field], Any], params: Mapping[str, Any] | None = None) -> Any:
    """The expression over numpy arrays; ``value`` gives a field's array, shifted as the field is."""
    params = params or {}

    def of(e: Expr) -> Any:
        match e:
            case Const(v):
                return v
            case Param(name):
                return params[name]
            case Field():
                return value(e)
            case Op(op, a, b):
                with np.errstate(divide="ignore", invalid="ignore"):
                    return _NUMPY_OPS[op](of(a), of(b))
            case Call(name, args):
                with np.errstate(divide="ignore", invalid="ignore"):
                    return _NUMPY_CALLS[name](*map(of, args))
            case Compare(a, op, b):
                return _COMPARES[op](of(a), of(b))
            case Logical(op, parts):
                return (np.logical_and if op == "and" else np.logical_or).reduce([of(p) for p in parts])
            case If(c, a, b):
                return np.where(of(c), of(a), of(b))
        raise TypeError(f"can't evaluate {e!r}")

    return of(wrap(expr))
