"""From a query's syntax tree to a DataFrame.

Everything stays declarative: Catalyst pushes filters down, prunes columns and picks join strategies.  The
builder adds only what differs from Spark: names, two-valued predicates, null order, and defaults."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import recursive
from ..operators.semantics import Scope, Typed, comparable, equal, logical, predicate, value
from . import ast as A
from .parser import SqlError

_numbers = itertools.count()
PART = "__part"


@dataclass(frozen=True)
class Field:
    quals: tuple[str, ...]  # names that may stand before the dot
    name: str
    type: str
    at: str  # the DataFrame's column


@dataclass
class Relation:
    df: DataFrame
    fields: list[Field]
    joined: bool = False
    ranges: tuple | None = None  # (column, partitions) of a table partitioned by range

    def find(self, name: str) -> Field:
        qual, _, bare = name.rpartition(".")
        found = [f for f in self.fields if f.name == bare and (not qual or qual in f.quals)]
        if len(found) == 1:
            return found[0]
        if len(found) > 1 or self.joined:
            raise SqlError(f"unknown or ambiguous column '{name}'")
        raise SqlError(f"unknown column '{name}'")

    def resolve(self, name: str) -> Typed:
        f = self.find(name)
        return Typed(F.col(f"`{f.at}`"), f.type)


@dataclass
class Built:
    """A query's DataFrame with its headers and types; ``df`` has the headers as column names."""

    df: DataFrame
    headers: list[str]
    types: list[str]


class Tables(Protocol):
    """What the builder asks of the engine."""

    def relation(self, name: str) -> Relation | None: ...
    def call(self, name: str, args: list[Typed]) -> Typed: ...
    def one_row(self) -> DataFrame: ...
    def keep(self, df: DataFrame) -> DataFrame: ...
    @property
    def spark(self) -> SparkSession: ...


def fields_of(df: DataFrame, types: list[str] | None, *quals: str) -> list[Field]:
    kinds = types or [logical(t) for _, t in df.dtypes]
    return [Field(tuple(quals), n, t, n) for n, t in zip(df.columns, kinds, strict=True)]


def null_order(c: Column, asc: bool) -> Column:
    """NULLs last when ascending, first when descending."""
    return c.asc_nulls_last() if asc else c.desc_nulls_first()


class Builder:
    def __init__(self, tables: Tables, scope: dict[str, Relation] | None = None):
        self.tables, self.ctes = tables, dict(scope or {})

    # ---- queries

    def build(self, q: A.Node) -> Built:
        if getattr(q, "ctes", ()):
            inner = Builder(self.tables, self.ctes)
            for c in q.ctes:
                if c.recursive:
                    built = recursive.run(inner, c)
                else:
                    built = inner.build(c.query)
                inner.ctes[c.name] = Relation(built.df, fields_of(built.df, built.types, c.name))
            import dataclasses

            return inner.build(dataclasses.replace(q, ctes=()))
        if isinstance(q, A.Union):
            left, right = self.build(q.left), self.build(q.right)
            if len(left.headers) != len(right.headers):
                raise SqlError(f"UNION expected {len(left.headers)} columns on right side, got {len(right.headers)}")
            for a, b in zip(left.types, right.types, strict=True):
                if "NULL" not in (a, b) and not comparable(a, b):
                    raise SqlError(f"UNION column types differ: {a} and {b}")
            df = left.df.union(right.df)
            return Built(df if q.all else df.distinct(), left.headers, [b if a == "NULL" else a for a, b in zip(left.types, right.types, strict=True)])
        if isinstance(q, A.Select):
            return self.select(q)
        raise SqlError("expected a query")

    def relation(self, name: str, alias: str | None = None) -> Relation:
        rel = self.ctes.get(name) or self.tables.relation(name)
        if rel is None:
            raise SqlError(f"table '{name}' does not exist")
        quals = (alias, name) if alias else (name,)
        return Relation(rel.df, [Field(quals, f.name, f.type, f.at) for f in rel.fields], ranges=rel.ranges)

    def scope(self, rel: Relation) -> Scope:
        return Scope(rel.resolve, self.tables.call)

    def select(self, q: A.Select) -> Built:
        if q.table is None:
            rel = Relation(self.tables.one_row(), [])
        else:
            rel = self.relation(q.table, q.alias)
            if q.join:
                rel = self.join(rel, q)
        if q.where is not None:
            rel = self.where(rel, q.where)
        parts = (q.items, q.having, tuple(e for e, _ in q.order))
        if any(isinstance(n, A.Agg) for n in A.walk(parts)):
            return self.aggregate(rel, q)
        if q.group:
            raise SqlError("GROUP BY requires aggregate expressions in SELECT")
        if q.having is not None:
            raise SqlError("HAVING requires GROUP BY or aggregates")
        rel, known = self.windows(rel, q.items)
        return self.project(rel, q, known)

    def join(self, left: Relation, q: A.Select) -> Relation:
        j = q.join
        right = self.relation(j.table, j.alias)
        n = next(_numbers)
        sides = []
        for k, (rel, tag) in enumerate(((left, q.alias or q.table), (right, j.alias or j.table))):
            names = [f"j{n}_{k}_{i}" for i in range(len(rel.fields))]
            df = rel.df.select(*[F.col(f"`{f.at}`").alias(c) for f, c in zip(rel.fields, names, strict=True)])
            sides.append((df, [Field(f.quals if tag != (q.table if k else j.table) or q.alias or j.alias else (tag,), f.name, f.type, c) for f, c in zip(rel.fields, names, strict=True)]))
        (ldf, lf), (rdf, rf) = sides
        a, b = Relation(ldf, lf, True), Relation(rdf, rf, True)

        def on(rel: Relation, name: str) -> Typed | None:
            try:
                return rel.resolve(name)
            except SqlError:
                return None

        x, y = on(a, j.left_on), on(b, j.right_on)
        if x is None or y is None:
            x, y = on(a, j.right_on), on(b, j.left_on)
        if x is None or y is None:
            raise SqlError(f"unknown join column in '{j.left_on} = {j.right_on}'")
        return Relation(ldf.join(rdf, equal(x, y), "left" if j.outer else "inner"), lf + rf, True)

    # ---- filters

    def where(self, rel: Relation, p: A.Node) -> Relation:
        """Rows for which the predicate holds: IN-subqueries are null-safe semi- and anti-joins, or flags."""
        if rel.ranges:
            names = surviving(p, *rel.ranges)
            if names is not None:
                rel = Relation(rel.df.where(F.col(PART).isin(names)), rel.fields, rel.joined)
        plain = []
        for c in conjuncts(p):
            if isinstance(c, A.In):
                rel = self.semi(rel, c, "left_semi")
            elif isinstance(c, A.Not) and isinstance(c.part, A.In):
                rel = self.semi(rel, c.part, "left_anti")
            else:
                plain.append(c)
        keep = rel.df.columns
        df, scope = self.flags(rel, plain)
        if plain:
            df = df.where(reduce(lambda a, b: a & b, (predicate(c, scope, True) for c in plain)))
        if df.columns != keep:
            df = df.select(*[F.col(f"`{c}`") for c in keep])
        return Relation(df, rel.fields, rel.joined)

    def flags(self, rel: Relation, parts: list[A.Node]) -> tuple[DataFrame, Scope]:
        """The relation with a flag for each IN-subquery in ``parts``: a left join with its distinct values."""
        scope, df = self.scope(rel), rel.df
        for n in (x for c in parts for x in A.walk(c) if isinstance(x, A.In)):
            if n not in scope.flags:
                sub, name = self.members(n), f"in{next(_numbers)}"
                df = df.join(sub.df.withColumn(name, F.lit(True)), equal(value(n.value, scope), sub.resolve(sub.fields[0].name)), "left")
                scope.flags[n] = F.col(name)
        return df, scope

    def flag(self, rel: Relation, p: A.Node, name: str) -> DataFrame:
        """All rows, each with whether the predicate holds: one pass, without a join of the relation with itself."""
        df, scope = self.flags(rel, [p])
        return df.withColumn(name, F.coalesce(predicate(p, scope, True), F.lit(False))).select(*[F.col(f"`{c}`") for c in rel.df.columns], name)

    def members(self, n: A.In) -> Relation:
        """The distinct values of an IN-subquery's first column.  NULL is one of them."""
        built = self.build(n.query)
        name = f"m{next(_numbers)}"
        first = built.df.toDF(*[name, *[f"{name}_{i}" for i in range(1, len(built.headers))]]).select(name)
        return Relation(first.distinct(), [Field((), name, built.types[0], name)])

    def semi(self, rel: Relation, n: A.In, how: str) -> Relation:
        v, sub = value(n.value, self.scope(rel)), self.members(n)
        return Relation(rel.df.join(sub.df, equal(v, sub.resolve(sub.fields[0].name)), how), rel.fields, rel.joined)

    # ---- projections

    def expand(self, rel: Relation, items: tuple[A.Node, ...]) -> list[tuple[str, A.Node]]:
        """(header, expression) of each output column."""
        out: list[tuple[str, A.Node]] = []
        for i in items:
            if isinstance(i, A.Star):
                for f in rel.fields:
                    name = f"{f.quals[0]}.{f.name}" if rel.joined else f.name
                    out.append((name, A.Col(name)))
            else:
                out.append((i.alias or A.render(i.expr), i.expr))
        return out

    def windows(self, rel: Relation, items: tuple[A.Node, ...]) -> tuple[Relation, dict[str, Typed]]:
        """The relation with what window functions need, and the functions by their text.  COUNT and SUM always see the whole partition.

        Without PARTITION BY no task gets all rows: COUNT and SUM are an aggregate of one row beside each
        row, and ROW_NUMBER and RANK number the rows of each task of a range sort, on top of the sums of the tasks before."""
        out: dict[str, Typed] = {}
        for w in A.walk(items):
            if not isinstance(w, A.Win) or A.render(w) in out:
                continue
            text, name = A.render(w), f"w{next(_numbers)}"
            part = [rel.resolve(w.partition).column] if w.partition else []
            over = (lambda c, part=part: c.over(Window.partitionBy(*part))) if part else (lambda c: c)
            if w.func in ("ROW_NUMBER", "RANK"):
                if w.func == "RANK" and not w.order:
                    out[text] = Typed(F.lit(1).cast("bigint"), "INT")
                    continue
                key = rel.resolve(w.order).column if w.order else rel.resolve(rel.fields[0].name if not rel.joined else f"{rel.fields[0].quals[0]}.{rel.fields[0].name}").column
                by, f = null_order(key, w.asc), F.rank() if w.func == "RANK" else F.row_number()
                if part:
                    out[text] = Typed(f.over(Window.partitionBy(*part).orderBy(by)).cast("bigint"), "INT")
                else:
                    rel = Relation(self.numbered(rel.df, key, w.asc, name, w.func == "RANK"), rel.fields, rel.joined, rel.ranges)
                    out[text] = Typed(F.col(name), "INT")
                continue
            if w.func == "COUNT":
                made = Typed(over(F.count(rel.resolve(w.column).column if w.column else F.lit(1))), "INT")
            else:
                t = rel.resolve(w.column)
                if t.type not in ("INT", "DOUBLE"):
                    out[text] = Typed(F.lit(None).cast("bigint"), "INT")
                    continue
                made = Typed(F.coalesce(over(F.sum(t.column)), F.lit(0)).cast("bigint" if t.type == "INT" else "double"), t.type)
            if not part:
                rel = Relation(rel.df.crossJoin(F.broadcast(rel.df.agg(made.column.alias(name)))), rel.fields, rel.joined, rel.ranges)
                made = Typed(F.col(name), made.type)
            out[text] = made
        return rel, out

    def numbered(self, df: DataFrame, key: Column, asc: bool, name: str, rank: bool) -> DataFrame:
        """``df`` with the place of each row in the order of ``key``; with ``rank`` that of the first row of its value.

        A rank belongs to a value, so that a value of any number of rows is counted before it is sorted."""
        rows = df.withColumn(f"{name}k", key)
        sort = null_order(F.col(f"{name}k"), asc)
        if rank:
            rows = rows.groupBy(f"{name}k").agg(F.count(F.lit(1)).alias(f"{name}n"))
        else:  # rows of one value are dealt over tasks by a hash of all their columns
            rows = rows.withColumn(f"{name}n", F.lit(1).cast("bigint")).withColumn(f"{name}h", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
        order = [sort] if rank else [sort, F.col(f"{name}h")]
        run = self.tables.keep(rows.repartitionByRange(*order).withColumn(f"{name}p", F.spark_partition_id()))
        inner = Window.partitionBy(f"{name}p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        run = run.withColumn(f"{name}b", F.coalesce(F.sum(f"{name}n").over(inner), F.lit(0)))
        sums, at, total = [], 0, dict(run.groupBy(f"{name}p").agg(F.sum(f"{name}n")).collect())  # a row a task
        for p in sorted(total):
            sums.append((p, at))
            at += total[p]
        before = self.tables.spark.createDataFrame(sums, f"`{name}p` int, `{name}s` bigint")
        placed = run.join(F.broadcast(before), f"{name}p").withColumn(name, (F.col(f"{name}b") + F.col(f"{name}s") + 1).cast("bigint"))
        if rank:
            return df.join(placed.select(F.col(f"{name}k"), name), key.eqNullSafe(F.col(f"{name}k"))).drop(f"{name}k")
        return placed.select(*[F.col(f"`{c}`") for c in df.columns], name)

    def project(self, rel: Relation, q: A.Select, known: dict[str, Typed], scope: Scope | None = None) -> Built:
        """SELECT list, DISTINCT, ORDER BY and LIMIT, in this order."""

        def resolve(name: str) -> Typed:
            return known[name] if name in known else rel.resolve(name)

        s = scope or Scope(resolve, self.tables.call)
        listed = self.expand(rel, q.items)
        typed = [value(e, s) for _, e in listed]
        headers = [h for h, _ in listed]
        names = [f"o{i}" for i in range(len(listed))]
        cols = [t.column.alias(n) for t, n in zip(typed, names, strict=True)]
        by, extra = [], []
        for e, asc in q.order:
            name = e.name if isinstance(e, A.Col) else A.render(e)
            at = [i for i, h in enumerate(headers) if h == name] or [i for i, (_, x) in enumerate(listed) if A.render(x) == name]
            if at:
                key = F.col(names[at[0]])
            elif isinstance(e, A.Case) or rel.joined or isinstance(e, A.Agg):
                if q.distinct:
                    raise SqlError("ORDER BY of a DISTINCT query must be an output column")
                extra.append(value(e, s).column.alias(f"x{len(extra)}"))
                key = F.col(f"x{len(extra) - 1}")
            else:
                raise SqlError(f"unknown column '{name}' in ORDER BY")
            by.append(null_order(key, asc))
        df = rel.df.select(*cols, *extra)
        if q.distinct:
            df = df.distinct()
        if by:
            df = df.orderBy(*by)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Built(df.select(*names).toDF(*headers), headers, [t.type for t in typed])

    # ---- aggregation

    def aggregate(self, rel: Relation, q: A.Select) -> Built:
        if any(isinstance(n, A.Win) for n in A.walk(q.items)):
            raise SqlError("window functions are not supported in aggregate queries")
        keys = [rel.find(g) for g in q.group]
        wanted: dict[str, A.Agg] = {}
        for n in A.walk((q.items, q.having, tuple(e for e, _ in q.order))):
            if isinstance(n, A.Agg):
                wanted[A.render(n)] = n
        made, known = [], {}
        for i, (text, a) in enumerate(wanted.items()):
            t = rel.resolve(a.column) if a.column else None
            if a.func == "COUNT":
                c, kind = F.count(t.column if t else F.lit(1)), "INT"
            elif a.func == "SUM":
                if t.type not in ("INT", "DOUBLE", "NULL"):
                    raise SqlError("SUM only supports INT column")
                kind = "DOUBLE" if t.type == "DOUBLE" else "INT"
                c = F.coalesce(F.sum(t.column.cast("double" if kind == "DOUBLE" else "bigint")), F.lit(0)).cast("double" if kind == "DOUBLE" else "bigint")
            else:
                c, kind = (F.min if a.func == "MIN" else F.max)(t.column), t.type
            made.append(c.alias(f"a{i}"))
            known[text] = Typed(F.col(f"a{i}"), kind)
        groups = [F.col(f"`{f.at}`").alias(f"g{i}") for i, f in enumerate(keys)]
        df = rel.df.groupBy(*groups).agg(*made) if keys else rel.df.agg(*made)
        out = Relation(df, [Field(f.quals, f.name, f.type, f"g{i}") for i, f in enumerate(keys)], rel.joined)
        headers = {h: e for h, e in self.expand(out, q.items)}

        def resolve(name: str) -> Typed:
            if name in known:
                return known[name]
            try:
                return out.resolve(name)
            except SqlError:
                if name in headers and headers[name] != A.Col(name):
                    return value(headers[name], s)
                rel.find(name)  # a column that there isn't has its own message
                raise SqlError(f"column '{name}' must appear in GROUP BY when aggregate functions are used") from None

        s = Scope(resolve, self.tables.call)
        if q.having is not None:
            out = Relation(df.where(predicate(q.having, s, True)), out.fields, out.joined)
        return self.project(out, q, known, s)


def conjuncts(p: A.Node) -> list[A.Node]:
    return conjuncts(p.left) + conjuncts(p.right) if isinstance(p, A.And) else [p]


def surviving(p: A.Node, column: str, parts: tuple[A.PartitionDef, ...]) -> list[str] | None:
    """Names of the range partitions that may hold rows for which ``p`` holds; None: all."""

    def keep(q: A.Node) -> set[str] | None:
        if isinstance(q, A.And):
            a, b = keep(q.left), keep(q.right)
            return b if a is None else a if b is None else a & b
        if isinstance(q, A.Or):
            a, b = keep(q.left), keep(q.right)
            return None if a is None or b is None else a | b
        lo, hi = None, None
        if isinstance(q, A.Cmp) and isinstance(q.left, A.Col) and q.left.name.rpartition(".")[2] == column and isinstance(q.right, A.Lit) and isinstance(q.right.value, int):
            v = q.right.value
            match q.op:
                case "=":
                    lo = hi = v
                case "<":
                    hi = v - 1
                case "<=":
                    hi = v
                case ">":
                    lo = v + 1
                case ">=":
                    lo = v
                case _:
                    return None
        elif isinstance(q, A.Between) and isinstance(q.value, A.Col) and q.value.name.rpartition(".")[2] == column and all(isinstance(x, A.Lit) and isinstance(x.value, int) for x in (q.low, q.high)):
            lo, hi = q.low.value, q.high.value
        else:
            return None
        out, start = set(), None
        for d in parts:
            if (hi is None or start is None or hi >= start) and (lo is None or d.below is None or lo < d.below):
                out.add(d.name)
            start = d.below
        return out

    names = keep(p)
    return None if names is None else [d.name for d in parts if d.name in names]
