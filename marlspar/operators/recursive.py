"""WITH RECURSIVE by semi-naive iteration.

The step sees only the rows that the last round added; rows seen before are dropped, also under UNION ALL, so
that cycles end.  Each round writes its new rows and reads them back, which cuts the lineage."""

from __future__ import annotations

import uuid
from functools import reduce

from ..plans import ast as A
from ..plans.parser import SqlError

DEPTH = 100


def _new(df, seen):
    names = [f"c{i}" for i in range(len(df.columns))]
    left, right = df.toDF(*names), seen.toDF(*[f"s{i}" for i in range(len(names))])
    same = reduce(lambda a, b: a & b, (left[n].eqNullSafe(right[f"s{i}"]) for i, n in enumerate(names)))
    return left.join(right, same, "left_anti").toDF(*df.columns)


def run(builder, cte: A.Cte):
    from ..plans.builder import Built, Builder, Relation, fields_of

    if not isinstance(cte.query, A.Union):
        raise SqlError(f"recursive CTE '{cte.name}' must be a base query UNION ALL a recursive query")
    base = builder.build(cte.query.left)
    spark = base.df.sparkSession
    where = builder.tables.scratch()

    paths: list[str] = []

    def cut(df):
        paths.append(f"{where}/recursive-{uuid.uuid4().hex}")
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    frontier = seen = cut(base.df.distinct())
    for depth in range(DEPTH + 1):
        if frontier.isEmpty():
            return Built(seen, base.headers, base.types)
        if depth == DEPTH:
            break
        inner = Builder(builder.tables, builder.ctes)
        inner.ctes[cte.name] = Relation(frontier, fields_of(frontier, base.types, cte.name))
        step = inner.build(cte.query.right)
        if len(step.headers) != len(base.headers):
            raise SqlError(f"UNION expected {len(base.headers)} columns on right side, got {len(step.headers)}")
        rows = step.df.toDF(*base.df.columns)
        rows = rows.select(*[rows[f"`{n}`"].cast(t) for n, t in base.df.dtypes]).toDF(*base.df.columns)
        frontier = cut(_new(rows.distinct(), seen))
        seen = spark.read.schema(base.df.schema).parquet(*paths)  # one scan, however many rounds
    raise SqlError(f"recursive CTE '{cte.name}' exceeded max recursion depth {DEPTH}")
