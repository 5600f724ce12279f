import numpy as np
import pytest

from gridloom.functions import Compare, Const, DynamicField, Field, If, LogicalAnd, Param, call, diff, evaluate, field_args, field_indices, fields_of, index_fields, loop_domain, parameters_of, parse, shift_fields, simplify, substitute

f, g = Field("f"), Field("g")


def at(expr, **values):
    return evaluate(expr, lambda x: values[x.column], {k: v for k, v in values.items()})


def test_index_order_and_offsets():
    h = Field("h", offset=2, shape=(2, 3))
    assert str(index_fields(h[1, 2], ("q",))) == "h[q, 1, 2, i + 2, j + 2, k + 2]"
    assert str(index_fields(Field("h", ignore_prepends=True), ("q",))) == "h[i, j, k]"
    assert str(index_fields(Field("a", indices=()))) == "a"
    with pytest.raises(ValueError):
        Field("h", offset=(1, 2))
    with pytest.raises(IndexError):
        h[2, 0]


def test_shift_leaves_padding():
    h = Field("h", offset=1)
    assert shift_fields(h, (1, 0, -1)).offset == (2, 1, 0)
    assert shift_fields(h, (1, 0, -1)).base_offset == (1, 1, 1)
    assert shift_fields(h * f, (1, 0, 0)).b.shifted() == (1, 0, 0)


def test_field_args_infer_shapes():
    padded = Field("f", offset="h")
    args = field_args({padded: Field("g", shape=(3, "a"), offset=1)[0, 0] + 1})
    assert [(a.name, a.shape) for a in args] == [("f", ("Nx+2*h", "Ny+2*h", "Nz+2*h")), ("g", (3, "a", "Nx+2", "Ny+2", "Nz+2"))]
    args = field_args([f + Field("w", ignore_prepends=True), Field("c", indices=())], (4, 6, 8), prepend_with=(2,))
    assert [(a.name, a.shape) for a in args] == [("c", (2,)), ("f", (2, 4, 6, 8)), ("w", (4, 6, 8))]
    # Shifts move the place that is read, not the padding.
    assert field_args(shift_fields(Field("f", offset=1), (1, 0, 0)), (4, 4, 4))[0].shape == (6, 6, 6)
    with pytest.raises(ValueError):
        field_args(Field("h", shape=(2,)) + Field("h", shape=(3,)))
    with pytest.raises(ValueError):
        field_args(Field("h", offset=1) * Field("h", offset=2))


def test_loop_domain():
    assert field_indices(f * Field("line", indices=("k",))) == ["i", "j", "k"]
    assert loop_domain({Field("line", indices=("k",)): 1}) == {"k": (0, "Nk")}
    assert loop_domain(Param("a")) == {}


def test_derivatives_match_differences():
    e = f**3 / g + call("exp", f) * call("sin", g) + call("sqrt", f) - call("log", g) + 2**f + call("tanh", f * g) + If(Compare(f, ">", 1), f**2, f)
    d, eps = diff(e, f), 1e-6
    for a, b in ((1.3, 2.1), (0.7, 0.4)):
        wanted = (at(e, f=a + eps, g=b) - at(e, f=a - eps, g=b)) / (2 * eps)
        assert at(d, f=a, g=b) == pytest.approx(wanted, rel=1e-6)
    assert diff(f**3, f, f) == simplify(6 * f) or at(diff(f**3, f, f), f=2.0) == 12
    with pytest.raises(ValueError):
        diff(call("abs", f), f, allowed_nonsmoothness="none")


def test_dynamic_field_links():
    y = DynamicField("y", shape=(2,))
    assert y.dot[1].column == "dydt_1" and y.lap[0].column == "lap_y_0" and y.pd[1, 2].column == "dydx_1_2"
    assert y.d(1, 0).column == "dydt_1" and y.d(1, 3).column == "dydx_1_2"
    z = DynamicField("z")
    assert diff(z, Param("t")).column == "dzdt" and diff(z, Param("y")).column == "dzdx_1"


def test_substitute_collect_parse():
    e = substitute(f * Param("c") + g, {f: g + 1, "c": 3})
    assert at(e, g=2.0) == 11
    assert [x.column for x in fields_of(f + g * f)] == ["f", "g"]
    assert parameters_of(f * Param("b") + Param("a")) == ["a", "b"]
    with pytest.raises(ValueError):
        fields_of(Field("h", shape=(2,)), Field("h", shape=(3,)))
    assert at(parse("a * (b + 2) ** 2 if a > 1 else -a"), a=2.0, b=1.0) == 18
    assert simplify(parse("0 * a + 1 * b + 2 * 3")) == Param("b") + Const(6)


def test_division_by_zero_and_log_follow_ieee(spark):
    from pyspark.sql import functions as F

    from gridloom.functions import lower

    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (1.0, 2.0)], "f double, g double")
    rows = df.select(lower(f / g).alias("q"), lower(call("log", f)).alias("l"), lower(call("sign", g)).alias("s")).collect()
    assert rows[0].q == np.inf and np.isnan(rows[1].q) and rows[2].q == -np.inf and rows[3].q == 0.5
    assert rows[1].l == -np.inf and np.isnan(rows[2].l) and rows[0].s == 1.0
    assert df.where(lower(LogicalAnd(Compare(f, ">", 0), Compare(g, ">", 0)))).agg(F.count("*")).first()[0] == 1
