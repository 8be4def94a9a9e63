"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import itertools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: After so many tables the driver frees what plans of tables already written held: its heap, and the shuffles and broadcasts in the cluster.
FREE_EVERY = 16
_count = itertools.count(1)
#: Tables that ``cut`` wrote, by the scope they belong to.
_written: dict[str, list[tuple[SparkSession, str]]] = {}
_scope: ContextVar[str] = ContextVar("scope", default="session")


@contextmanager
def scope() -> Iterator[str]:
    """What is cut inside belongs to a scope of its own, which ``release`` can delete by name; the tables of others stay."""
    name = uuid.uuid4().hex
    before = _scope.set(name)
    try:
        yield name
    finally:
        _scope.reset(before)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where it is unset, a temporary folder in local mode, else one beside the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.startswith("local"):
            where = tempfile.mkdtemp(prefix="marlspar-")
        else:
            where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-scratch"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def free(taken: list[str], *names: str) -> list[str]:
    """Column names like these that a caller's table doesn't have."""
    low, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in low:
            n += "_"
        low.add(n.lower())
        out.append(n)
    return out


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of a bounded number of bytes, so that workers' memory doesn't follow the length of texts.

    A session that sets its own limits keeps them."""
    for key, least, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "268435456", "4194304")):
        if spark.conf.get(key, least) in (least, "9223372036854775807", "-1"):
            spark.conf.set(key, most)


#: For scratch tables on a local file system, which without Hadoop's native library starts a ``chmod`` for each folder and file:
#: no _SUCCESS, and no .crc beside the checksums that Parquet keeps for its pages.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def cut(df: DataFrame, owner: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: what follows does not
    depend on executors that ran what came before.

    Where that folder is on a local file system, the driver starts no process for a table: its folders are made by the JVM."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/marlspar-{owner}-{uuid.uuid4().hex}"
    write = df.write.option("compression", "zstd")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(conf).getScheme() == "file":
        jvm.java.io.File(f"{where.toUri().getPath()}/_temporary/0").mkdirs()
        write = write.options(**_PLAIN).mode("append")  # the folder is new and empty
    write.parquet(path)
    _written.setdefault(_scope.get(), []).append((spark, path))
    if next(_count) % FREE_EVERY == 0:
        gc.collect()
        jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def release(*scopes: str) -> None:
    """Deletes what ``cut`` wrote in these scopes (in all, if none is named)."""
    for name in scopes or tuple(_written):
        for spark, path in _written.pop(name, []):
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; nothing reads these files any more
        return


atexit.register(release)

#: A key with more rows than this, and than ``1 / PARTS`` of all, is spread over several tasks.
HOT = 256
PARTS = 8192


def spread(left: DataFrame, right: DataFrame, on: list[str], by: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has few rows a key, however many rows of ``left`` share a key.

    Hot keys are those of many rows in ``counts`` (``on`` and ``n``, written; counted here if not given).  Their rows of ``left``
    are dealt by a hash of ``by`` over as many tasks as they need, and their rows of ``right`` are repeated once for each.
    There are ``PARTS`` hot keys at most, since each has more than that part of all rows: a table of so many keys and
    numbers is all that is broadcast."""
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    most, total = counts.agg(F.max("n"), F.sum("n")).first()
    unit = max(HOT, -(-(total or 0) // PARTS))
    if (most or 0) <= unit:
        return left.join(right, on, how)
    known = " AND ".join(f"`{c}` IS NOT NULL" for c in on)
    hot = counts.where(F.col("n") > unit).where(known).select(*on, F.ceil(F.col("n") / unit).cast("int")).collect()  # PARTS rows at most
    copies, salt, *keys = free([*left.columns, *right.columns], "copies", "salt", *[f"k{i}" for i in range(len(on))])
    fields = ", ".join(f"`{k}` {dict(left.dtypes)[c]}" for k, c in zip(keys, on, strict=True))
    table = left.sparkSession.createDataFrame([tuple(r) for r in hot], f"{fields}, `{copies}` int")

    def marked(df: DataFrame) -> DataFrame:
        same = [F.col(c) == F.col(k) for c, k in zip(on, keys, strict=True)]
        return df.join(F.broadcast(table), same, "left").drop(*keys)

    dealt = marked(left).withColumn(salt, F.coalesce(F.pmod(F.xxhash64(F.lit("salt"), *by), F.col(copies).cast("long")), F.lit(0).cast("long"))).drop(copies)
    repeated = marked(right).withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(copies), F.lit(1)).cast("long") - 1))).drop(copies)
    return dealt.join(repeated, [*on, salt], how).drop(salt)


#: Bits of a bitmap of row ids: 1 MiB, whatever the input.
BITMAP_BITS = 1 << 23


def member_of(ids: DataFrame, column: str):
    """A function that adds a column to a table: whether its ``column`` may be among ``ids``.

    The ids go into a bitmap of fixed size (no id is missed; others may pass), which spares rows that
    surely have no partner a shuffle of their text.  With many ids all rows pass, and all are shuffled.
    The bitmap is broadcast, in 256 pieces of 4 KiB at most, and tested inside the JVM."""
    slot = F.pmod(F.xxhash64(F.col(column)), F.lit(BITMAP_BITS)) + 1  # bit positions count from 1
    maps = ids.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("__bits"))
    at = F.bitmap_bit_position(slot)

    def add(df: DataFrame, name: str) -> DataFrame:
        bucket, bits = free(df.columns, "bucket", "bits")
        named = maps.select(F.col("__bucket").alias(bucket), F.col("__bits").alias(bits))
        byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        found = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
        joined = df.join(F.broadcast(named), F.bitmap_bucket_number(slot) == F.col(bucket), "left")
        return joined.withColumn(name, found).drop(bucket, bits)

    return add
