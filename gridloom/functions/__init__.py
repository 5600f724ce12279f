"""The expression language: symbolic fields, calculus on them, and lowering to Spark columns."""

from .expr import (
    Call,
    Compare,
    Const,
    DynamicField,
    Expr,
    Field,
    FieldArg,
    If,
    LogicalAnd,
    LogicalOr,
    Param,
    call,
    diff,
    evaluate,
    field_args,
    field_indices,
    fields_of,
    index_fields,
    loop_domain,
    lower,
    parameters_of,
    parse,
    shift_fields,
    simplify,
    substitute,
)

__all__ = [
    "Call", "Compare", "Const", "DynamicField", "Expr", "Field", "FieldArg", "If", "LogicalAnd", "LogicalOr", "Param", "call", "diff",
    "evaluate", "field_args", "field_indices", "fields_of", "index_fields", "loop_domain", "lower", "parameters_of", "parse", "shift_fields", "simplify", "substitute",
]
