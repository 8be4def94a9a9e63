"""N-gram Jaccard join with set-relation skipping.

Equal sets are one class, found by one aggregate over fingerprints of 128 bits.  Shingles are ordered
from rare to frequent (counts over all documents, in a table of counters of fixed size; the order
need not be exact, only the same everywhere), and each class indexes its rarest shingles: two sets that link must
share one of them.

Relations between sets save most comparisons.  In each list the set at the earliest position leads; all others are
compared with it only, and those that link take over its component: a group of any number of near copies costs its size, not its square.

What is left are lists whose sets lie in several components.  They are cut into blocks by the size of their sets, and
a set skips blocks by its position: with ``i`` shingles before the shared one unmatched, its partner can be so
large at most, and none is looked up beyond.  A block that more than ``LIST`` sets look up, a shingle that is frequent
among unlike sets, is not compared at all.  Its sets are known by their parts instead: the shingles of a set are dealt
by hash into one part more than two sets of such sizes can differ in if they link, so that two that link have a
part in common, whole; sets are compared where a part is equal, and unlike sets hardly ever have one.  No list,
however long, is compared pair by pair, and no link between two components is lost.

Defined cases: null and empty texts have an empty set, n_shingles 0, and link with nothing; a text
under three words is one shingle; rows of equal text always share a component, and so do rows of one doc_id; a
row without doc_id has component null unless an equal text has one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .graph import components
from .scratch import cut, member_of, spread

SHINGLE = 3
PERCENT = 90
#: Counters of shingle frequencies, 4 bytes each, whatever the input.
COUNTERS = 1 << 24
_CHUNK = 1 << 16
#: Sets that look up one block of a list; a block that more look up is compared by equal parts of sets.
LIST = 64
ODD = [f"odd{i}" for i in range(4)]
#: Blocks that a list has for sets of which the largest could link with the smallest.
BLOCKS = 4
_SHIFT = np.uint64(40)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of the distinct shingles of each text, by row and fingerprint."""
    ws, we, first = K.word_bounds(data, off)
    if not len(ws):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = K.word_hashes(data, ws, we, lower=True)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    g = K.ngrams(h, k, 1)
    ok = row[: len(g)] == row[k - 1 :] if len(g) else np.zeros(0, bool)
    r, x = row[: len(g)][ok], g[ok]
    few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < k))
    if len(few):
        r, x = np.concatenate([r, few]), np.concatenate([x, K.ranges(h, first[few], first[few + 1], 1)])
    order = np.lexsort((x, r))
    r, x = r[order], x[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    return r[new], x[new]


def _fingerprints(r: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each row's set and two fingerprints that don't depend on order."""
    size = np.bincount(r, minlength=n)
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(K.mix(x ^ np.uint64(salt)), out=total[1:])
        end = np.cumsum(size)
        out.append(K.mix(total[end] - total[end - size] + size.astype(np.uint64)))
    return size, *out


def _summaries(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = ["doc_id", "n", "s1", "s2", "chunk", "task", "counts"]
        counts, any_ = np.zeros(COUNTERS, np.int32), False
        for b in batches:
            ids = b.column(0)
            for lo, hi, data, off in K.slices(K.column(b, "text")):
                r, x = shingle_sets(data, off, k)
                any_ = True
                np.add.at(counts, (x >> _SHIFT).astype(np.int64), np.int32(1))  # a number of the same type is added many times faster
                size, s1, s2 = _fingerprints(r, x, hi - lo)
                none = [pa.nulls(hi - lo, t) for t in (pa.int32(), pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(size, pa.int64()), K.signed(s1), K.signed(s2), *none], names)
        if any_:
            blobs = [_packed(counts[i : i + _CHUNK]) for i in range(0, COUNTERS, _CHUNK)]
            n = len(blobs)
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(n, pa.int64()) for _ in range(4)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)), pa.array(blobs, pa.binary())], names
            )

    return K.tidy(run)


def _packed(counts: np.ndarray) -> bytes:
    """A chunk's counters that aren't 0: a bit for each counter (or, where those are few, their number and places), a byte
    for each such count, and four bytes more for each that fills its byte."""
    at = np.flatnonzero(counts)
    few = 2 * len(at) < _CHUNK // 8
    where = np.uint16(len(at)).tobytes() + at.astype(np.uint16).tobytes() if few else np.packbits(counts != 0).tobytes()
    c = counts[at]
    return bytes([few]) + where + np.minimum(c, 255).astype(np.uint8).tobytes() + c[c >= 255].astype(np.uint32).tobytes()


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts that ``_packed`` wrote."""
    if raw[0]:
        n = int(np.frombuffer(raw, np.uint16, 1, 1)[0])
        at, end = np.frombuffer(raw, np.uint16, n, 3).astype(np.int64), 3 + 2 * n
    else:
        at, end = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, _CHUNK // 8, 1))), 1 + _CHUNK // 8
    c = np.frombuffer(raw, np.uint8, len(at), end).astype(np.int64)
    c[c == 255] = np.frombuffer(raw, np.uint32, -1, end + len(at))
    return at, c


def _sum(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """A chunk's counters, added one after the other."""
    total = np.zeros(_CHUNK, np.int64)
    for b in batches:
        for x in b.column(b.schema.names.index("counts")):
            at, c = _unpacked(x.as_py())
            total[at] += c
    return np.minimum(total, 2**32 - 1)


def _logarithms(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blob = np.log2(_sum(batches) + 1.0).astype(np.uint8).tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([blob], pa.binary())], ["chunk", "counts"])


def frequency_classes(partial: DataFrame) -> np.ndarray:
    """The binary logarithm of the count of each counter: COUNTERS bytes.  A chunk's partial counts stream through one task."""
    out = np.zeros(COUNTERS, np.uint8)
    for chunk, raw in partial.groupBy("chunk").applyInArrow(_logarithms, "chunk int, counts binary").collect():
        out[chunk * _CHUNK : (chunk + 1) * _CHUNK] = np.frombuffer(raw, np.uint8)
    return out


def _prefixes(k: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        for b in batches:
            ids = b.column(0)
            for lo, hi, data, off in K.slices(K.column(b, "text")):
                r, x = shingle_sets(data, off, k)
                size, s1, s2 = _fingerprints(r, x, hi - lo)
                key = (classes[(x >> _SHIFT).astype(np.int64)].astype(np.uint64) << np.uint64(57)) | (x >> np.uint64(7))  # below 2**63: classes stay under 64
                order = np.lexsort((key, r))
                key = key[order]
                start = np.cumsum(size) - size
                place = np.arange(len(key)) - start[r]
                # the longest prefix that a partner of equal or greater size needs
                keep = place < (size - (percent * size + 99) // 100 + 1)[r]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(r[keep], minlength=hi - lo))]).astype(np.int32)), K.signed(key[keep]))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(size, pa.int64()), K.signed(s1), K.signed(s2), lists], ["doc_id", "n", "s1", "s2", "prefix"])

    return K.tidy(run)


def _whole(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for lo, hi, data, off in K.slices(K.column(b, "text")):
                r, x = shingle_sets(data, off, k)
                size, s1, _ = _fingerprints(r, x, hi - lo)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), K.signed(x))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), K.signed(s1), lists], ["doc_id", "s1", "items"])

    return K.tidy(run)


def size_class(n: np.ndarray, percent: int) -> np.ndarray:
    """Sets that link have classes that differ by 1 at most."""
    return np.floor(np.log(np.maximum(n, 1)) / math.log(100 / percent) + 1e-9).astype(np.int64)


def part_count(c: np.ndarray, percent: int) -> np.ndarray:
    """For a set of class ``c`` and one of its own or the next class: one more than the shingles in which they can differ if they link."""
    r = 100 / percent
    least = np.ceil(r**c * (1 - 1e-9))  # sizes in these classes are whole numbers below these bounds
    one, two = np.maximum(np.ceil(r ** (c + 1) * (1 + 1e-9)), least), np.ceil(r ** (c + 2) * (1 + 1e-9))
    return np.floor((100 - percent) * (one + two) / (100 + percent) + 1e-9).astype(np.int64) + 1


def _parts(k: int, percent: int):
    """The fingerprint of each part of each set, for its own size class and the one below, and parities of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for lo, hi, data, off in K.slices(K.column(b, "text")):
                r, x = shingle_sets(data, off, k)
                size, s1, _ = _fingerprints(r, x, hi - lo)
                own, deal, mark = size_class(size, percent), K.mix(x ^ np.uint64(0x5851F42D4C957F2D)), K.mix(x ^ np.uint64(0x14057B7EF767814F))
                rows, keys = [], []
                for c in (own, own - 1):
                    g = np.where((size > 0) & (c >= 0), part_count(np.maximum(c, 0), percent), 0)
                    first = np.cumsum(g) - g
                    total = np.zeros(int(g.sum()), np.uint64)
                    ok = g[r] > 0
                    at = first[r[ok]] + (deal[ok] % np.maximum(g, 1)[r[ok]].astype(np.uint64)).astype(np.int64)
                    np.add.at(total, at, mark[ok])
                    row = np.repeat(np.arange(len(g)), g)
                    place = np.arange(len(row)) - first[row]
                    rows.append(row)
                    keys.append(K.mix(total ^ K.mix((c[row].astype(np.uint64) << np.uint64(40)) ^ place.astype(np.uint64))))
                # bits that tell whether an even or odd number of shingles fall into each of 256 cells: they differ in no more places than the sets
                odd = np.zeros((hi - lo, 4), np.uint64)
                np.bitwise_xor.at(odd, (r, (mark >> np.uint64(62)).astype(np.int64)), np.uint64(1) << ((mark >> np.uint64(56)) & np.uint64(63)))
                row = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(pa.array(row)), K.signed(s1[row]), pa.array(size[row], pa.int64()), K.signed(np.concatenate(keys)), *(K.signed(odd[row, i]) for i in range(4))], ["doc_id", "s1", "n", "token", *ODD])

    return K.tidy(run)


class Join:
    """One run of the join over ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT):
        self.docs, self.k, self.percent = docs.select("doc_id", "text"), k, percent

    def _needed(self, a: str, b: str) -> str:
        """The least overlap of two sets of sizes a and b that link: t / (1 + t) of the sum, rounded up."""
        p = self.percent
        return f"(({p} * ({a} + {b}) + {100 + p - 1}) div {100 + p})"

    def _pairs(self, found: DataFrame) -> DataFrame:
        """From pairs at a shared shingle (xd, xs, xn, xp, yd, ys, yn, yp): those that size and position allow, once each."""
        p = self.percent
        ok = f"100 * least(xn, yn) >= {p} * greatest(xn, yn) AND least(xn - xp, yn - yp) >= {self._needed('xn', 'yn')}"
        return found.where("xd <> yd").where(ok).select("xd", "xs", "yd", "ys").distinct()

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of doc_ids whose sets link."""
        p, pairs = self.percent, cut(pairs, "op9")
        asked = pairs.select(F.col("xd").alias("doc_id")).unionByName(pairs.select(F.col("yd").alias("doc_id")))
        side = member_of(asked, "doc_id")(self.prefixes, "some").where("some").select("doc_id", "s1", "n", "prefix")
        x = side.select(F.col("doc_id").alias("xd"), F.col("s1").alias("xs"), F.col("n").alias("xn"), F.col("prefix").alias("px"))
        y = side.select(F.col("doc_id").alias("yd"), F.col("s1").alias("ys"), F.col("n").alias("yn"), F.col("prefix").alias("py"))
        both = spread(pairs, y, ["yd", "ys"], ["xd"]).join(x, ["xd", "xs"])
        both = both.withColumn("shared", F.size(F.array_intersect("px", "py"))).withColumn("last", F.expr("least(element_at(px, -1), element_at(py, -1))"))
        # prefixes are sorted: the one that ends first lies within the other's range whole
        ended = f"shared + IF(element_at(px, -1) = last, xn - size(px), yn - size(py)) >= {self._needed('xn', 'yn')}"
        inside = lambda c: f"size(filter({c}, v -> v <= last))"
        bound = f"shared + least(xn - {inside('px')}, yn - {inside('py')}) >= {self._needed('xn', 'yn')}"
        likely = cut(both.where(f"CASE WHEN {ended} THEN {bound} ELSE FALSE END").select("xd", "xs", "xn", "yd", "ys", "yn"), "op9")
        wanted = likely.select(F.col("xd").alias("doc_id"), F.col("xs").alias("s1")).unionByName(likely.select(F.col("yd").alias("doc_id"), F.col("ys").alias("s1"))).distinct()
        few = member_of(wanted, "doc_id")(self.docs, "some").where("some").select("doc_id", "text")
        sets = few.mapInArrow(_whole(self.k), "doc_id long, s1 long, items array<long>").join(wanted, ["doc_id", "s1"], "left_semi").dropDuplicates(["doc_id", "s1"])
        # not written: both sides read one shuffle of the sets, which has them by (doc_id, s1) already
        a = sets.select(F.col("doc_id").alias("xd"), F.col("s1").alias("xs"), F.col("items").alias("ix"))
        b = sets.select(F.col("doc_id").alias("yd"), F.col("s1").alias("ys"), F.col("items").alias("iy"))
        exact = spread(likely, b, ["yd", "ys"], ["xd"]).join(a, ["xd", "xs"]).withColumn("common", F.size(F.array_intersect("ix", "iy")))
        return exact.where(f"100 * common >= {p} * (xn + yn - common)").select(F.col("xd").alias("a"), F.col("yd").alias("b"))

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id: a row for each row of ``docs``."""
        spark = self.docs.sparkSession
        first = cut(self.docs.mapInArrow(_summaries(self.k), "doc_id long, n long, s1 long, s2 long, chunk int, task int, counts binary"), "op9")
        rows = first.where("chunk IS NULL").select("doc_id", "n", "s1", "s2")
        classes = frequency_classes(first.where("chunk IS NOT NULL").select("chunk", "task", "counts"))
        shared = spark.sparkContext.broadcast(classes)
        reps = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
        sizes = cut(reps, "op9")
        reps = sizes.drop("n")
        indexed = self.docs.where("doc_id IS NOT NULL").mapInArrow(_prefixes(self.k, self.percent, shared), "doc_id long, n long, s1 long, s2 long, prefix array<long>").where("n > 0")
        self.prefixes = cut(indexed.join(reps, ["s1", "s2", "doc_id"], "left_semi").dropDuplicates(["s1", "s2", "doc_id"]), "op9")
        entries = self.prefixes.select("doc_id", "s1", "n", F.posexplode("prefix").alias("pos", "token"))

        # a set is in a list once; two sets alone, of sizes too unlike to link, need no list
        lists = entries.groupBy("token").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("n"))
        lists = cut(lists.where(f"n > 2 OR (n = 2 AND 100 * least >= {self.percent} * most)").select("token", "n"), "op9")
        listed = cut(spread(entries, lists.select("token", F.col("n").alias("held")), ["token"], ["doc_id", "s1"], counts=lists), "op9")
        order = F.expr("pos * 8796093022208L + (s1 & 8796093022207L)")  # earliest position first, ties by fingerprint
        lead = listed.withColumn("o", order).groupBy("token").agg(*[F.min_by(c, "o").alias(n) for c, n in (("doc_id", "yd"), ("s1", "ys"), ("n", "yn"), ("pos", "yp"))])
        x = [F.col("doc_id").alias("xd"), F.col("s1").alias("xs"), F.col("n").alias("xn"), F.col("pos").alias("xp")]
        led = spread(listed, cut(lead, "op9"), ["token"], ["doc_id", "s1"], counts=lists)
        near = cut(self._verified(self._pairs(led.select(*x, "yd", "ys", "yn", "yp"))), "op9")
        twice = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo < hi").select("doc_id")
        same = rows.join(twice, "doc_id", "left_semi").join(reps.select("s1", "s2", F.col("doc_id").alias("b")), ["s1", "s2"]).select(F.col("doc_id").alias("a"), "b")
        near = cut(near.unionByName(same), "op9")
        label = components(near, "op9")

        self.met = self._across(listed.where("held > 2").drop("held"), label)  # of two sets one has led the other
        more = cut(self._verified(self.met), "op9")
        if not more.isEmpty():
            label = components(near.unionByName(more), "op9")
        named = reps.join(label.select(F.col("u").alias("doc_id"), "v"), "doc_id", "left").select("s1", "s2", F.coalesce("v", "doc_id").alias("component_id"))
        full = spread(rows.where("n > 0"), named, ["s1", "s2"], ["doc_id"], "left", sizes).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        return full.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))

    def _mixed(self, lists: DataFrame, label: DataFrame) -> DataFrame:
        """Entries (with their component ``c``) of the lists that hold sets of several components."""
        named = lists.join(label.select(F.col("u").alias("doc_id"), F.col("v").alias("c")), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
        named = cut(named, "op9")
        kinds = named.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("token", "n")
        kinds = cut(kinds, "op9")
        return cut(spread(named, kinds.select("token"), ["token"], ["doc_id", "s1"], counts=kinds), "op9")

    def _across(self, listed: DataFrame, label: DataFrame) -> DataFrame:
        """Pairs (xd, xs, yd, ys) that may link although they lie in different components."""
        p, step = self.percent, math.log(100 / self.percent) / BLOCKS
        odd = self._mixed(listed, label)
        block = lambda n: F.floor(F.log(n) / step + 1e-9)
        # with pos shingles unmatched, a partner has 100 * (n - pos) / p - pos shingles at most: a set late in a list looks up nothing
        most = 100 * (F.col("n") - F.col("pos")) / p - F.col("pos") + 1e-6
        listed = odd.withColumn("own", block(F.col("n").cast("double")))
        asks = listed.where(most >= F.col("n")).withColumn("block", F.explode(F.sequence(F.col("own"), block(most))))
        asks = cut(asks, "op9")
        asked = cut(asks.groupBy("token", "block").agg(F.count(F.lit(1)).alias("n")), "op9")
        flags = asked.select("token", "block", (F.col("n") > LIST).alias("frequent"))
        asks = cut(spread(asks, flags, ["token", "block"], ["doc_id", "s1"], counts=asked), "op9")
        # sets that could be answers meet the few that ask for their block
        answers = listed.withColumnRenamed("own", "block")
        held = cut(answers.groupBy("token", "block").agg(F.count(F.lit(1)).alias("n")), "op9")
        answers = cut(spread(answers, flags, ["token", "block"], ["doc_id", "s1"], counts=held), "op9")
        x = asks.where("NOT frequent").select("token", "block", F.col("doc_id").alias("xd"), F.col("s1").alias("xs"), F.col("n").alias("xn"), F.col("pos").alias("xp"), F.col("c").alias("xc"))
        y = answers.where("NOT frequent").select("token", "block", F.col("doc_id").alias("yd"), F.col("s1").alias("ys"), F.col("n").alias("yn"), F.col("pos").alias("yp"), F.col("c").alias("yc"))
        larger = "xc <> yc AND (xn < yn OR (xn = yn AND xs < ys) OR (xn = yn AND xs = ys AND xd < yd))"
        found = self._pairs(spread(y, x, ["token", "block"], ["yd", "ys"], counts=held).where(larger))

        # a pair that only frequent blocks know has nothing in common before the first of them in either set
        sets = asks.where("frequent").select("doc_id", "s1", "pos").unionByName(answers.where("frequent").select("doc_id", "s1", "pos"))
        sets = cut(sets.groupBy("doc_id", "s1").agg(F.min("pos").alias("pos")), "op9")
        texts = member_of(sets, "doc_id")(self.docs, "some").where("some").select("doc_id", "text")
        schema = "doc_id long, s1 long, n long, token long, " + ", ".join(f"{c} long" for c in ODD)
        parts = texts.mapInArrow(_parts(self.k, p), schema).join(sets, ["doc_id", "s1"]).dropDuplicates(["token", "doc_id", "s1"])
        alike = self._mixed(parts, label)
        sides = []
        for t in "xy":
            names = {"doc_id": "d", "s1": "s", "n": "n", "pos": "p", "c": "c"} | {c: c for c in ODD}
            sides.append(alike.select("token", *[F.col(c).alias(t + n) for c, n in names.items()]))
        apart = " + ".join(f"bit_count(x{c} ^ y{c})" for c in ODD) + f" <= xn + yn - 2 * {self._needed('xn', 'yn')}"
        same = sides[0].join(sides[1], "token").where(larger).where(apart)
        return cut(found.unionByName(self._pairs(same)).distinct(), "op9")


def join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    return Join(docs, k, percent).run()


def op9_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
l AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT x, x AS y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(min(r.y), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.x = w.doc_id GROUP BY w.doc_id, n.n
"""
