"""Element-wise maps: projections that follow the order of their instructions."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Field, Param, fields_of, lower, parameters_of, wrap


def _pairs(instructions) -> list[tuple[Any, Any]]:
    items = instructions.items() if isinstance(instructions, Mapping) else instructions
    return [(k, wrap(v)) for k, v in items or ()]


def name_of(assignee: Any) -> str:
    if isinstance(assignee, Field):
        return assignee.column
    return assignee.name if isinstance(assignee, Param) else str(assignee)


class ElementWiseMap:
    """Assignments ``{field: expression}`` over the columns of one DataFrame.

    Temporaries are all computed from the old values and dropped at the end. Assignments
    run in order, and a later one sees what an earlier one wrote. Catalyst
    collapses the chain to one projection.
    """

    def __init__(self, map_instructions, *, tmp_instructions=(), params: Mapping[str, Any] | None = None):
        self.assignments, self.temporaries = _pairs(map_instructions), _pairs(tmp_instructions)
        self.params = dict(params or {})
        self.reads = fields_of(*[e for _, e in (*self.temporaries, *self.assignments)])
        self.parameters = parameters_of(*[e for _, e in (*self.temporaries, *self.assignments)])

    def __call__(self, df: DataFrame, *, filter_args: bool = False, keys: list[str] | None = None, **params: Any) -> DataFrame:
        """``filter_args`` keeps of ``df`` only the keys and what the map reads or writes."""
        params = self.params | params
        wanted = df.columns
        if filter_args:
            used = {f.column for f in self.reads} | {name_of(k) for k, _ in self.assignments} | set(keys or ())
            wanted = [c for c in df.columns if c in used]
        names = {name_of(k): f"__tmp_{n}" for n, (k, _) in enumerate(self.temporaries)}

        def column(f: Field):
            if any(f.shifted()):
                raise ValueError(f"{f} reads another cell; use a stencil")
            return F.col(names.get(f.column, f.column))

        given = params | {n: F.col(t) for n, t in names.items() if n not in params}
        out = df.select(*wanted)
        if self.temporaries:
            # Each temporary may use those before it.
            done: dict[str, Any] = {}
            for k, e in self.temporaries:
                now = {n: F.col(names[n]) for n in done}
                out = out.withColumn(names[name_of(k)], lower(e, lambda f, d=done: F.col(names[f.column] if f.column in d else f.column), params | now))
                done[name_of(k)] = True
        for k, e in self.assignments:
            out = out.withColumn(name_of(k), lower(e, column, given))
        return out.drop(*names.values())
