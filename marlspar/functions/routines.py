"""Functions written in the dialect, as Columns.

A body without loops is run symbolically: assignments bind Columns, IF becomes CASE WHEN, and
Catalyst sees one expression.  A body with WHILE, or with too many branches, runs in an Arrow UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import semantics as S
from ..plans import ast as A
from ..plans.parser import SqlError

DEFAULTS = {"INT": 0, "TEXT": "", "BOOL": False, "JSON": "null"}
#: Branches of a body that one expression may have; a larger one is the same function, run in Arrow batches.
_BRANCHES = 64


class Ended(SqlError):
    pass


def interpret(r: A.Routine, args: list, lookup) -> object:
    """The value of one call."""
    env = {p.name: v for p, v in zip(r.params, args, strict=True)}

    def call(name, values):
        return interpret(lookup(name), values, lookup)

    class Done(Exception):
        pass

    def run(body):
        for s in body:
            match s:
                case A.Return(v):
                    raise Done(S.evaluate(v, env, call))
                case A.Declare(n, t):
                    env[n] = DEFAULTS[t]
                case A.SetVar(n, v):
                    if n not in env:
                        raise SqlError(f"unknown variable '{n}'")
                    env[n] = S.evaluate(v, env, call)
                case A.If(c, then, other):
                    run(then if S.holds(c, env, call) else other)
                case A.While(c, inner):
                    while S.holds(c, env, call):
                        run(inner)
                case _:
                    raise SqlError(f"statement not allowed in function '{r.name}'")

    try:
        run(r.body)
    except Done as d:
        return d.args[0]
    raise Ended(f"function '{r.name}' ended without RETURN")


def _branches(body) -> int:
    n = 1
    for s in body:
        if isinstance(s, A.If):
            n *= _branches(s.then) + _branches(s.otherwise)
        elif isinstance(s, A.While):
            return _BRANCHES + 1
    return n


def _symbolic(r: A.Routine, args: list[S.Typed], call) -> S.Typed:
    def go(body, env: dict[str, S.Typed]) -> S.Typed:
        if not body:
            return S.Typed(F.raise_error(F.lit(f"function '{r.name}' ended without RETURN")), "NULL")

        def resolve(name):
            if name not in env:
                raise SqlError(f"unknown variable '{name}'")
            return env[name]

        s, rest, scope = body[0], body[1:], S.Scope(resolve, call)
        match s:
            case A.Return(v):
                return S.value(v, scope)
            case A.Declare(n, t):
                return go(rest, {**env, n: S.Typed(F.lit(DEFAULTS[t]).cast(S.SPARK[t]), t)})
            case A.SetVar(n, v):
                resolve(n)
                return go(rest, {**env, n: S.value(v, scope)})
            case A.If(c, then, other):
                yes, no = go((*then, *rest), env), go((*other, *rest), env)
                return S.Typed(F.when(S.predicate(c, scope, True), yes.column.cast(S.SPARK[r.returns])).otherwise(no.column.cast(S.SPARK[r.returns])), r.returns)
        raise SqlError(f"statement not allowed in function '{r.name}'")

    return go(r.body, {p.name: a for p, a in zip(r.params, args, strict=True)})


def as_column(r: A.Routine, args: list[S.Typed], lookup, call) -> S.Typed:
    if len(args) != len(r.params):
        raise SqlError(f"function '{r.name}' expects {len(r.params)} argument(s), got {len(args)}")
    args = [S.Typed(a.column.cast(S.SPARK[p.type]), p.type) for a, p in zip(args, r.params, strict=True)]
    if _branches(r.body) <= _BRANCHES:
        out = _symbolic(r, args, call)
        return S.Typed(out.column.cast(S.SPARK[r.returns]), r.returns)
    known = _closure(r, lookup)
    size = len(args)

    def run(columns: pd.DataFrame) -> pd.Series:
        kinds = [p.type for p in r.params]
        clean = lambda v, k: None if v is None or v != v else bool(v) if k == "BOOL" else int(v) if k == "INT" else v
        rows = columns.itertuples(index=False) if size else [()] * len(columns)
        return pd.Series([interpret(r, [clean(v, k) for v, k in zip(row, kinds, strict=True)], known.__getitem__) for row in (x[:size] for x in rows)], dtype=object)

    run.__annotations__ = {"columns": pd.DataFrame, "return": pd.Series}
    packed = F.struct(*[a.column.alias(f"a{i}") for i, a in enumerate(args)], F.lit(0).alias("row"))
    return S.Typed(F.pandas_udf(run, S.SPARK[r.returns])(packed), r.returns)


def _closure(r: A.Routine, lookup) -> dict[str, A.Routine]:
    """The function and all that it calls."""
    out, todo = {}, [r]
    while todo:
        f = todo.pop()
        if f.name in out:
            continue
        out[f.name] = f
        todo += [lookup(n.name) for n in A.walk(f.body) if isinstance(n, A.Call)]
    return out
