"""Mixing sources to target weights.

Documents get a hash-random key.  They are range-sorted by (source, key), so that a source of any
size spreads over as many tasks as it needs; each task sums sizes as it goes, and the sums of whole
tasks, a few rows a task, give what lies before each.  A source whose target is t times its size is
read t times: whole epochs, then the documents whose running sum stays within the rest, the last
one cut where the budget ends.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; an
empty table gives an empty result; repeated rows are separate documents that sort side by side;
columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .scratch import cut, free, member_of

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = "mix-1"
#: Up to so many sources their targets, some 60 bytes each, are broadcast; beyond, they are joined.
BROADCAST_SOURCES = 50_000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, most: int = MOST_EPOCHS) -> list[tuple]:
    """(source, size, target, whole epochs, words of the last epoch) of each source.

    Shares follow the weights; a source never gets more than ``most`` times its size, and what it
    can't take is shared among the others by weight until none is above its limit."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weigh = [weights[i % len(weights)] for i in range(len(order))]
    rest, open_ = sum(s for _, s in order), set(range(len(order)))
    while open_:
        w = sum(weigh[i] for i in open_)
        above = [i for i in open_ if weigh[i] * rest > most * order[i][1] * w]
        if not above:
            break
        open_ -= set(above)
        rest -= sum(most * order[i][1] for i in above)
    w, out = sum(weigh[i] for i in open_), []
    for i, (source, size) in enumerate(order):
        target = float(weigh[i] * rest) / float(w) if i in open_ else float(most * size)
        words = min(int(target), most * size)
        epochs = words // size if size else 0
        out.append((source, size, target, epochs, words - epochs * size))
    return out


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and, within the task, the sum of the source's sizes before each row."""
    from pyspark import TaskContext

    pid, last, total = TaskContext.get().partitionId(), object(), 0
    for b in batches:
        source = b.column(1).to_pylist()
        size = b.column(2).to_numpy(zero_copy_only=False)
        before, lo = np.empty(len(size), np.int64), 0
        while lo < len(size):
            if source[lo] != last:
                last, total = source[lo], 0
            hi = lo + 1
            while hi < len(size) and source[hi] == last:
                hi += 1
            sums = np.cumsum(size[lo:hi])
            before[lo:hi] = total + sums - size[lo:hi]
            total, lo = total + int(sums[-1]), hi
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(before), pa.array(np.full(len(size), pid, np.int64))], ["doc_id", "source", "size", "row_key", "before", "pid"])


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, and ``row_key`` that tells rows of one doc_id apart."""
    spark = docs.sparkSession
    sized = cut(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))).alias("mix_key"),
            F.xxhash64("doc_id", "source", "text").alias("row_key"),
        ),
        "op4",
    )
    totals = [(r[0], int(r[1])) for r in sized.groupBy("source").agg(F.sum("size")).collect()]  # a row a source
    plan = spark.createDataFrame(
        targets(totals, weights, most),
        T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("epochs", T.LongType()), T.StructField("rest", T.LongType())]),
    )
    keys = [F.col("source").asc_nulls_last(), F.col("mix_key"), F.col("doc_id"), F.col("size"), F.col("row_key")]
    if len(totals) <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    run = cut(
        sized.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "source", "size", "row_key")
        .mapInArrow(_running, "doc_id long, source string, size long, row_key long, before long, pid long"),
        "op4",
    )
    parts = run.groupBy("source", "pid").agg(F.max(F.col("before") + F.col("size")).alias("whole"))
    lower = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    earlier = parts.select("source", "pid", F.coalesce(F.sum("whole").over(lower), F.lit(0)).alias("earlier"))
    placed = run.alias("r").join(earlier.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.pid") == F.col("e.pid"))).select("r.*", (F.col("r.before") + F.col("e.earlier")).alias("at"))
    return placed.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select(
        "r.doc_id", "r.size", "p.source_size", "p.target",
        (F.col("epochs") * F.col("size") + F.least(F.greatest(F.col("rest") - F.col("at"), F.lit(0)), F.col("size"))).cast("long").alias("taken"),
        "r.row_key",
    )


def _copies(size_name: str, taken_name: str):
    """Repeats whole texts and cuts the last repeat to its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            text, size, taken = (b.column(at[n]).to_pylist() for n in ("text", size_name, taken_name))
            rows, texts = [], []
            for i, (t, s, k) in enumerate(zip(text, size, taken, strict=True)):
                whole, part = divmod(k, s) if s else (0, 0)
                rows += [i] * (whole + bool(part))
                texts += [t] * whole
                if part:
                    raw = t.encode()
                    data = np.frombuffer(raw, np.uint8)
                    _, end, _ = K.word_bounds(data, np.array([0, len(data)]))
                    texts.append(raw[: end[part - 1]].decode())
            out = b.take(pa.array(rows, pa.int64()))
            names = [n for n in b.schema.names if n not in (size_name, taken_name)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field("text").type) if n == "text" else out.column(at[n]) for n in names], names)

    return K.tidy(run)


def materialise(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, its last repeat cut to the budget; all columns of ``docs``, whatever their names."""
    own, key, ident, size, taken, n, some = free(docs.columns, "own_key", "key", "ident", "size", "taken", "n", "some")
    keyed = docs.withColumn(own, F.xxhash64("doc_id", "source", "text"))
    once = mixed.groupBy("doc_id", "row_key", "size").agg(F.sum("taken").alias("t"), F.count(F.lit(1)).alias("k"))  # equal rows share what they take
    once = once.where("t > 0").select(F.col("doc_id").alias(ident), F.col("row_key").alias(key), F.col("size").alias(size), F.col("t").alias(taken), F.col("k").alias(n))
    once = cut(once, "op4")
    same = F.col("doc_id").eqNullSafe(F.col(ident)) & (F.col(own) == F.col(key))
    out = keyed.join(once.where(F.col(n) == 1), same).select(*docs.columns, size, taken)
    equal = once.where(F.col(n) > 1)
    if not equal.isEmpty():  # what is left over of an even share goes to the first rows
        twin = Window.partitionBy(ident, key).orderBy(F.lit(0))
        more = F.when(F.row_number().over(twin) <= F.col(taken) % F.col(n), 1).otherwise(0)
        rows = member_of(equal.select(F.col(ident).alias("doc_id")), "doc_id")(keyed, some).where(F.col(some) | F.col("doc_id").isNull()).drop(some)
        shared = rows.join(equal, same).withColumn(taken, F.floor(F.col(taken) / F.col(n)) + more)
        out = out.unionByName(shared.where(F.col(taken) > 0).select(*docs.columns, size, taken))
    return out.mapInArrow(_copies(size, taken), docs.schema)


def op4_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('{SEED}:' || CAST(doc_id AS VARCHAR)) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
c AS (
  SELECT *, coalesce(sum(3 * source_size) OVER o, 0) AS capped_before, coalesce(sum(w) OVER o, 0) AS w_before,
         sum(source_size) OVER () AS total, sum(w) OVER () AS total_w
  FROM w WINDOW o AS (ORDER BY 3.0 * source_size / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, w * (total - capped_before) > 3 * source_size * (total_w - w_before) AS full_up FROM c),
t AS (
  SELECT source, source_size,
         CASE WHEN full_up THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST(w * (total - coalesce(sum(CASE WHEN full_up THEN 3 * source_size END) OVER (), 0)) AS DOUBLE)
                   / CAST(total_w - coalesce(sum(CASE WHEN full_up THEN w END) OVER (), 0) AS DOUBLE) END AS target
  FROM f),
b AS (SELECT *, CAST(least(floor(target), 3 * source_size) AS BIGINT) AS words FROM t),
r AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM d)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
                 ELSE (words // source_size) * size + least(greatest(words % source_size - prior, 0), size) END AS BIGINT) AS taken
FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source
"""
