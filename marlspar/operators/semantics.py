"""The dialect's values and two-valued predicates as Columns.

NULL is a value: it equals itself, differs from all others, and is ordered with none, so that predicates
are never unknown.  Polarity matters: under AND and OR a filter drops unknown rows anyway, and a bare comparison
can be pushed down to the scan; under NOT, or where the result is a value, it is made false explicitly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import jsonfn
from ..plans import ast as A
from ..plans.parser import SqlError

NUMBERS = ("INT", "DOUBLE")
SPARK = {"INT": "bigint", "TEXT": "string", "BOOL": "boolean", "JSON": "string", "DOUBLE": "double", "NULL": "void"}


def logical(spark_type: str) -> str:
    """The dialect's type of a Spark type (types beyond the dialect keep their own names)."""
    if spark_type in ("bigint", "int", "smallint", "tinyint"):
        return "INT"
    if spark_type in ("double", "float") or spark_type.startswith("decimal"):
        return "DOUBLE"
    return {"string": "TEXT", "boolean": "BOOL", "void": "NULL"}.get(spark_type, spark_type.upper())


def literal_type(value) -> str:
    if value is None:
        return "NULL"
    return "BOOL" if isinstance(value, bool) else "INT" if isinstance(value, int) else "TEXT"


@dataclass
class Typed:
    """A Column and its type; a JSON_EXTRACT's type is that of each row."""

    column: Column
    type: str
    json: tuple[Column, str] | None = None


@dataclass
class Scope:
    """Names that expressions see.  ``resolve`` gives a name's Column and type, or raises."""

    resolve: Callable[[str], Typed]
    call: Callable[[str, list[Typed]], Typed] | None = None
    flags: dict[A.Node, Column] = field(default_factory=dict)  # IN-subqueries outside of semi-joins


def comparable(a: str, b: str) -> bool:
    text = ("TEXT", "JSON")
    times = ("TIMESTAMP", "DATE", "TIMESTAMP_NTZ")
    return a == b or (a in NUMBERS and b in NUMBERS) or (a in text and b in text) or (a in times and b in (*text, *times)) or (b in times and a in text)


def value(e: A.Node, s: Scope) -> Typed:
    match e:
        case A.Lit(None):
            return Typed(F.lit(None), "NULL")
        case A.Lit(v):
            t = literal_type(v)
            return Typed(F.lit(v).cast(SPARK[t]) if t == "INT" else F.lit(v), t)
        case A.Col(name):
            return s.resolve(name)
        case A.JsonExtract(c, path):
            doc = value(c, s).column
            return Typed(jsonfn.extract(doc, path), "TEXT", (doc, path))
        case A.JsonSet(c, path, v):
            return Typed(jsonfn.put(value(c, s).column, path, jsonfn.encode(value(v, s))), "TEXT")
        case A.Case(whens, default):
            parts = [(predicate(c, s, True), value(v, s)) for c, v in whens]
            last = value(default, s) if default is not None else Typed(F.lit(None), "NULL")
            kinds = {v.type for _, v in parts} | {last.type}
            kinds.discard("NULL")
            if len(kinds) > 1 and not kinds <= set(NUMBERS) and not kinds <= {"TEXT", "JSON"}:
                raise SqlError(f"CASE results have different types: {', '.join(sorted(kinds))}")
            kind = "DOUBLE" if len(kinds) > 1 and kinds <= set(NUMBERS) else next(iter(kinds), "NULL")
            out = None
            for c, v in parts:
                out = F.when(c, v.column) if out is None else out.when(c, v.column)
            return Typed(out.otherwise(last.column), kind)
        case A.Call(name, args):
            if s.call is None:
                raise SqlError(f"function '{name}' does not exist")
            return s.call(name, [value(a, s) for a in args])
        case A.Param(i):
            raise SqlError(f"placeholder ${i} is not bound")
        case A.Agg() | A.Win():
            return s.resolve(A.render(e))
    raise SqlError(f"unsupported expression {A.render(e)}")


def equal(a: Typed, b: Typed) -> Column:
    """Equality that a join can use as its key: NULLs match each other whatever the types, values only those of like types."""
    for x, y in ((a, b), (b, a)):
        if x.json and not y.json and y.type in ("INT", "BOOL", "TEXT", "JSON"):
            typed = _typed_json(x, y.type if y.type in ("INT", "BOOL") else "TEXT").column
            return F.struct(x.column.isNull(), typed).eqNullSafe(F.struct(y.column.isNull(), y.column))
    if comparable(a.type, b.type):
        return a.column.eqNullSafe(b.column)
    return F.when(a.column.isNull(), 1) == F.when(b.column.isNull(), 1)


def _typed_json(t: Typed, other: str) -> Typed:
    """A JSON_EXTRACT next to a value of a type: the rows of that type, the others NULL."""
    doc, path = t.json
    return Typed(jsonfn.extract_as(doc, path, other), other)


def _ordered(a: Column, op: str, b: Column) -> Column:
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def compare(left: Typed, op: str, right: Typed, positive: bool) -> Column:
    """Two-valued comparison; in positive places unknown may stand for false."""
    for a, b in ((left, right), (right, left)):
        if a.json and not b.json and b.type in ("INT", "BOOL", "TEXT", "JSON"):
            typed = _typed_json(a, b.type if b.type in ("INT", "BOOL") else "TEXT")
            left, right = (typed, right) if a is left else (left, typed)
            if op in ("=", "!="):  # a row of another type is no NULL
                same = F.when(b.column.isNull(), a.column.isNull()).otherwise(typed.column.eqNullSafe(b.column))
                return same if op == "=" else ~same
            break
    if left.json and right.json:
        kinds = [jsonfn.kind(*t.json) for t in (left, right)]
        alike = kinds[0].eqNullSafe(kinds[1])
        if op in ("=", "!="):
            same = alike & left.column.eqNullSafe(right.column)
            return same if op == "=" else ~same
        numbers = [jsonfn.extract_as(*t.json, "INT") for t in (left, right)]
        c = alike & F.when(kinds[0] == "INT", _ordered(numbers[0], op, numbers[1])).otherwise(_ordered(left.column, op, right.column))
        return c if positive else F.coalesce(c, F.lit(False))
    a, b = left.column, right.column
    null = "NULL" in (left.type, right.type)
    if null or not comparable(left.type, right.type):
        if op not in ("=", "!="):
            return F.lit(False)
        same = a.isNull() & b.isNull()
        return same if op == "=" else ~same
    if op == "=":
        return a.eqNullSafe(b)
    if op == "!=":
        return ~a.eqNullSafe(b)
    c = _ordered(a, op, b)
    return c if positive else F.coalesce(c, F.lit(False))


def like(t: Typed, pattern: str, positive: bool) -> Column:
    """%x, x%, %x% and exact text only: other wildcards are ordinary characters."""
    if t.type not in ("TEXT", "JSON"):
        return F.lit(False)
    lead, trail = pattern.startswith("%"), pattern.endswith("%")
    if len(pattern) >= 2 and lead and trail:
        c = t.column.contains(pattern[1:-1])
    elif lead:
        c = t.column.endswith(pattern[1:])
    elif trail:
        c = t.column.startswith(pattern[:-1])
    else:
        return t.column.eqNullSafe(F.lit(pattern))
    return c if positive else F.coalesce(c, F.lit(False))


def predicate(p: A.Node, s: Scope, positive: bool = True) -> Column:
    match p:
        case A.And(a, b):
            return predicate(a, s, positive) & predicate(b, s, positive)
        case A.Or(a, b):
            return predicate(a, s, positive) | predicate(b, s, positive)
        case A.Not(q):
            return ~predicate(q, s, False)
        case A.Cmp(a, op, b):
            return compare(value(a, s), op, value(b, s), positive)
        case A.Between(v, lo, hi):
            x = value(v, s)
            return compare(x, ">=", value(lo, s), positive) & compare(x, "<=", value(hi, s), positive)
        case A.Like(v, pattern):
            return like(value(v, s), pattern, positive)
        case A.IsNull(v, neg):
            c = value(v, s).column
            return c.isNotNull() if neg else c.isNull()
        case A.In():
            if p not in s.flags:
                raise SqlError("IN (SELECT ...) is not supported here")
            return F.coalesce(s.flags[p], F.lit(False))
    raise SqlError(f"not a predicate: {A.render(p)}")


# ---- the same semantics on plain values, for procedures, loops in functions, and tests


def _kind(v) -> str:
    return literal_type(v)


def compare_values(a, op: str, b) -> bool:
    if op in ("=", "!="):
        return (_kind(a) == _kind(b) and a == b) == (op == "=")
    if a is None or b is None or _kind(a) != _kind(b):
        return False
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def evaluate(e: A.Node, env: dict, call=None):
    match e:
        case A.Lit(v):
            return v
        case A.Col(name):
            if name not in env:
                raise SqlError(f"unknown variable '{name}'")
            return env[name]
        case A.Case(whens, default):
            for c, v in whens:
                if holds(c, env, call):
                    return evaluate(v, env, call)
            return evaluate(default, env, call) if default is not None else None
        case A.JsonExtract(c, path):
            return jsonfn.extract_value(evaluate(c, env, call), path)
        case A.JsonSet(c, path, v):
            return jsonfn.put_value(evaluate(c, env, call), path, evaluate(v, env, call))
        case A.Call(name, args) if call is not None:
            return call(name, [evaluate(a, env, call) for a in args])
    raise SqlError(f"cannot evaluate {A.render(e)}")


def holds(p: A.Node, env: dict, call=None) -> bool:
    match p:
        case A.And(a, b):
            return holds(a, env, call) and holds(b, env, call)
        case A.Or(a, b):
            return holds(a, env, call) or holds(b, env, call)
        case A.Not(q):
            return not holds(q, env, call)
        case A.Cmp(a, op, b):
            return compare_values(evaluate(a, env, call), op, evaluate(b, env, call))
        case A.Between(v, lo, hi):
            x = evaluate(v, env, call)
            return compare_values(x, ">=", evaluate(lo, env, call)) and compare_values(x, "<=", evaluate(hi, env, call))
        case A.Like(v, pattern):
            x = evaluate(v, env, call)
            if not isinstance(x, str):
                return False
            if len(pattern) >= 2 and pattern[0] == pattern[-1] == "%":
                return pattern[1:-1] in x
            return x.endswith(pattern[1:]) if pattern[:1] == "%" else x.startswith(pattern[:-1]) if pattern[-1:] == "%" else x == pattern
        case A.IsNull(v, neg):
            return (evaluate(v, env, call) is None) != neg
    raise SqlError("IN (SELECT ...) is not supported here")
