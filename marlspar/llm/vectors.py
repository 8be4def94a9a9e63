"""Near-duplicate and nearest-neighbour search over embeddings.

Both operators leave out vectors that are null or zero or hold null or non-finite components.  Vectors of
different lengths are never compared.  Embeddings travel as raw doubles.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .scratch import cut

#: Vectors in one block of a comparison.
BLOCK = 8192
TILE = 1024
#: Leading dimensions of a box, leaves of the tree of boxes, and vectors (about) that its cuts are taken from.
DIMS, LEAVES, SAMPLE = 8, 4096, 1 << 16


def _valid(df: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where("vec_id IS NOT NULL").select("vec_id", v.alias("v")).where(F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0))


def _pack_column(col: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """Raw doubles of each list."""
    off = np.asarray(col.offsets)
    flat = np.ascontiguousarray(col.values.to_numpy(zero_copy_only=False), float)
    return [flat[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = _pack_column(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array([len(x) // 8 for x in raw], pa.int32())], ["vec_id", "x", "d"])


def _matrix(col) -> np.ndarray:
    raw = col.combine_chunks().to_pylist() if isinstance(col, pa.ChunkedArray) else col.to_pylist()
    return np.frombuffer(b"".join(raw)).reshape(len(raw), -1) if raw else np.zeros((0, 0))


# ---------------------------------------------------------------- near-duplicates


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        if b.num_rows:
            u = _matrix(b.column(0))
            u = u / np.linalg.norm(u, axis=1, keepdims=True)
            total = u.T @ u if total is None else total + u.T @ u
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])


def rotation(reps: DataFrame) -> np.ndarray:
    """Directions of falling second moment: d x d numbers, whatever the number of vectors."""
    parts = reps.select("x").mapInArrow(_moments, "m binary")
    total = sum(np.frombuffer(r[0]) for r in parts.toLocalIterator())
    d = math.isqrt(len(total))
    return np.linalg.eigh(total.reshape(d, d))[1][:, ::-1].copy()


def grow(sample: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Direction and cut of each node of a whole binary tree of at least ``blocks`` leaves (LEAVES at most): the widest direction, at its median."""
    depth = max(0, math.ceil(math.log2(max(1, min(blocks, LEAVES)))))
    dims, cuts, parts = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), [sample]
    for node in range(len(dims)):
        some = parts[node]
        if len(some) > 1:
            dims[node] = int(some.var(0).argmax())
            cuts[node] = np.median(some[:, dims[node]])
        low = some[:, dims[node]] < cuts[node]
        parts += [some[low], some[~low]]
    return dims, cuts


def _leaves(y: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    node = np.zeros(len(y), np.int64)
    for _ in range((len(dims) + 1).bit_length() - 1):
        node = 2 * node + 1 + (y[np.arange(len(y)), dims[node]] >= cuts[node])
    return node - len(dims)


def _leading(shared):
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ shared.value[:, :DIMS]
                yield pa.RecordBatch.from_arrays([pa.array(list(y), pa.list_(pa.float64()))], ["lead"])

    return run


def _place(shared):
    """Each vector with its leading dimensions and its leaf."""

    def run(batches):
        turn, tree = shared.value
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ turn[:, :DIMS]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_leaves(y, *tree)), pa.array(list(y), pa.list_(pa.float64()))], ["vec_id", "x", "copies", "leaf", "lead"])

    return run


def _deal(shared, threshold: float):
    """Each vector once for every block whose box it can reach, paired with its own block."""

    def run(batches):
        _, at, count, low, high = shared.value  # of each leaf: its first block, how many it has, its box
        most = 2 - 2 * threshold + 1e-9
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                ids, leaf = b.column(0).to_numpy(), b.column(3).to_numpy()
                y = np.array(b.column(4).to_pylist(), float)
                gap = np.zeros((len(ids), len(at)))
                for k in range(y.shape[1]):
                    gap += np.maximum(0, np.maximum(low[:, k] - y[:, k, None], y[:, k, None] - high[:, k])) ** 2
                row, near = np.nonzero((gap <= most) & (count > 0))
                salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                own = at[leaf] + (salt % count[leaf].astype(np.uint64)).astype(np.int64)
                times = count[near]
                other = np.repeat(at[near] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                row = np.repeat(row, times)
                t = b.select([0, 1, 2]).take(pa.array(row, pa.int64()))
                sides = (own[row], np.minimum(own[row], other), np.maximum(own[row], other))
                yield pa.RecordBatch.from_arrays([*t.columns, *(pa.array(c) for c in sides)], ["vec_id", "x", "copies", "own", "left", "right"])

    return run


def _compare(shared, threshold: float):
    """Links within a pair of blocks: a count for each vector, and enough of them to join what is linked."""

    def run(key, table):
        turn = shared.value[0]
        own, ids, copies = (table.column(c).to_numpy() for c in ("own", "vec_id", "copies"))
        x = _matrix(table.column("x"))
        norm = np.sqrt((x * x).sum(1))
        y = (x / norm[:, None]) @ turn
        order = np.lexsort((y[:, 0], own != key[0].as_py()))
        own, ids, copies, x, norm, y = (a[order] for a in (own, ids, copies, x, norm, y))
        same = key[0].as_py() == key[1].as_py()
        half = int((own == key[0].as_py()).sum())
        lead = min(max(4, y.shape[1] // 4), y.shape[1])
        tail = np.sqrt((y[:, lead:] ** 2).sum(1))
        ends = sorted({e for e in (lead, y.shape[1] // 2, y.shape[1] * 3 // 4) if e >= lead})
        steps, rest = list(itertools.pairwise(ends)), {e: np.sqrt((y[:, e:] ** 2).sum(1)) for e in ends[1:]}
        part = np.concatenate([y[:, :lead], tail[:, None]], 1).astype(np.float32)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        tiles = lambda lo, hi: [(a, min(a + TILE, hi)) for a in range(lo, hi, TILE)]
        boxes = {}
        for t in tiles(0, half) + tiles(half, len(ids)):
            boxes[t] = (y[t[0] : t[1], :8].min(0), y[t[0] : t[1], :8].max(0))
        most = 2 - 2 * threshold + 1e-9
        for a, b in tiles(0, half):
            for c, d in tiles(0, half) if same else tiles(half, len(ids)):
                if same and c < a:
                    continue
                (l1, h1), (l2, h2) = boxes[a, b], boxes[c, d]
                if (np.maximum(0, np.maximum(l1 - h2, l2 - h1)) ** 2).sum() > most:
                    continue
                # leading dimensions, and the norms of what is left: no cosine can be higher
                i, j = np.nonzero(part[a:b] @ part[c:d].T >= threshold - 1e-5)
                i, j = i + a, j + c
                if same and a == c:
                    i, j = i[i < j], j[i < j]
                hit, left = [], []
                for lo in range(0, len(i), 1 << 16):
                    p, q = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                    so_far = (y[p, :lead] * y[q, :lead]).sum(1)
                    for begin, end in steps:  # a pair stops where what is left can't lift it to the threshold
                        so_far += (y[p, begin:end] * y[q, begin:end]).sum(1)
                        on = so_far + rest[end][p] * rest[end][q] >= threshold - 1e-9
                        p, q, so_far = p[on], q[on], so_far[on]
                    left.append((p, q))
                    hit.append((x[p] * x[q]).sum(1) / (norm[p] * norm[q]) >= threshold)
                if not hit:
                    continue
                hit = np.concatenate(hit)
                i, j = (np.concatenate(side)[hit] for side in zip(*left, strict=True))
                links += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
                while True:  # the least place that is linked, until nothing changes
                    low = label.copy()
                    np.minimum.at(low, i, label[j])
                    np.minimum.at(low, j, label[i])
                    low = low[low]
                    if (low == label).all():
                        break
                    label = low
        moved = np.flatnonzero(label != np.arange(len(ids)))
        edges = ids[label[moved]]
        some = np.flatnonzero(links)
        return pa.table({
            "vec_id": pa.array(np.concatenate([ids[some], ids[moved]])), "links": pa.array(np.concatenate([links[some], np.zeros(len(moved), np.int64)])),
            "other": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(edges, pa.int64())]),
        })

    return run


def near_duplicates(df: DataFrame, threshold: float = 0.95, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of ``df`` (vec_id, embedding).

    Equal vectors are one class.  Vectors are turned so that their leading dimensions hold most of the
    second moment, and split at medians of those into leaves of bounded size.  A leaf has a box that holds all its
    vectors; a vector is dealt to its own leaf and to those whose box it can reach with a link, and each pair of leaves is a
    group of its own (a leaf that is too large even so is cut by hash).  Within it, tiles are skipped by the boxes of
    their leading dimensions, and products accumulate over a quarter, half and three quarters of the dimensions: each time
    the rest is bounded by suffix norms, and pairs that can't reach the threshold stop.  Those left get an exact cosine.

    Defined cases: a vector that takes no part has 0 links and is its own component (a null vec_id: null);
    rows of equal id and vector count as one; an empty table gives an empty result; other columns are ignored."""
    spark = df.sparkSession
    both = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    valid = cut(_valid(df).select("vec_id", "v", *both), "op5")
    classes = valid.select("vec_id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = valid.join(classes.select("h1", "h2", F.col("rep").alias("vec_id"), "copies"), ["h1", "h2", "vec_id"]).dropDuplicates(["h1", "h2"]).select("vec_id", "v", "copies")
    raw = cut(reps.select("vec_id", "v").mapInArrow(_as_bytes, "vec_id long, x binary, d int").join(reps.select("vec_id", "copies"), "vec_id"), "op5")
    found = None
    for (d,) in raw.select("d").distinct().collect():  # a row a length
        some = raw.where(F.col("d") == d)
        turn = rotation(some)
        blocks = -(-(n := some.count()) // block)
        every = -(-n // SAMPLE)  # the cuts only decide how vectors are dealt, not which are linked
        taken = some.where(F.pmod(F.xxhash64("x"), F.lit(every)) == 0) if every > 1 else some
        lead = taken.select("x").mapInArrow(_leading(spark.sparkContext.broadcast(turn)), "lead array<double>").collect() if blocks > 1 else []
        tree = grow(np.array([r[0] for r in lead]).reshape(-1, min(d, DIMS)), blocks)
        placed = some.select("vec_id", "x", "copies").mapInArrow(_place(spark.sparkContext.broadcast((turn, tree))), "vec_id long, x binary, copies long, leaf long, lead array<double>")
        placed = cut(placed, "op5")
        sides = [f(F.col("lead")[k]) for f in (F.min, F.max) for k in range(min(d, DIMS))]
        at, count, low, high = np.zeros(m := len(tree[0]) + 1, np.int64), np.zeros(m, np.int64), np.zeros((m, min(d, DIMS))), np.zeros((m, min(d, DIMS)))
        for leaf, size, *box in placed.groupBy("leaf").agg(F.count(F.lit(1)), *sides).collect():  # LEAVES rows at most
            # a quarter over is still one block: cuts come from a sample
            count[leaf], low[leaf], high[leaf] = -(-size // (block + block // 4)), box[: min(d, DIMS)], box[min(d, DIMS) :]
        at[1:] = np.cumsum(count)[:-1]
        shared = spark.sparkContext.broadcast((turn, at, count, low, high))
        dealt = placed.mapInArrow(_deal(shared, threshold), "vec_id long, x binary, copies long, own long, left long, right long")
        part = dealt.groupBy("left", "right").applyInArrow(_compare(shared, threshold), "vec_id long, links long, other long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "vec_id long, links long, other long")
    found = cut(found, "op5")
    links = found.where("other IS NULL").groupBy("vec_id").agg(F.sum("links").alias("links")).withColumnRenamed("vec_id", "rep")
    label = components(found.where("other IS NOT NULL").select(F.col("vec_id").alias("a"), F.col("other").alias("b")), "op5")
    named = classes.join(links, "rep", "left").join(label.select(F.col("u").alias("rep"), "v"), "rep", "left")
    named = named.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("v", "rep").alias("c"))
    known = valid.select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("c").alias("c"))
    out = df.select("vec_id").join(known, "vec_id", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op5_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


SQL5 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE e IS NOT NULL),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
      WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r AS (SELECT x, x AS y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x, count(*) AS k FROM l GROUP BY x), m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, coalesce(m.y, vec_id) AS component_id, coalesce(m.y, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.x = vec_id LEFT JOIN m ON m.x = vec_id
"""


# ---------------------------------------------------------------- nearest neighbours

TABLES, HASHES, WIDTH, PROBES, TOP, EVERY = 2, 4, 1.6, 80, 20, 20
#: Query rows in one group.
QUERIES = 4096
_OFFSETS = np.array(list(itertools.product((-2, -1, 0, 1, 2), repeat=HASHES)))


def _functions(d: int, tables: int, width: float) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(20)
    return [(rng.normal(size=(d + 1, HASHES)), rng.uniform(0, width, HASHES)) for _ in range(tables)]


def _lift(x: np.ndarray, largest: float) -> np.ndarray:
    """Vectors of one length whose distances order as inner products do (the last number is 0 for queries)."""
    y = x / largest
    return np.concatenate([y, np.sqrt(np.maximum(1 - (y * y).sum(1, keepdims=True), 0))], 1)


def _codes(c: np.ndarray) -> np.ndarray:
    """One number for each tuple of hash values; the cell is that of the first two."""
    return ((c + 512) @ np.array([1 << 30, 1 << 20, 1 << 10, 1])).astype(np.int64)


def _probes(q: np.ndarray, f, width: float, probes: int) -> np.ndarray:
    """Codes of the buckets to visit, by falling estimated success: the sum of squared distances to the walls passed."""
    v = (q @ f[0] + f[1]) / width
    base = np.floor(v)
    frac = v - base
    off = _OFFSETS[None]
    wall = np.where(off == 0, 0, np.where(off > 0, off - frac[:, None, :], frac[:, None, :] - off - 1))
    cost = (wall**2).sum(2)
    best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    return _codes((base[:, None, :] + _OFFSETS[best]).astype(np.int64))


def _index(shared, every: int, probes: int, sizes=None):
    """Rows (t, cell, ds, qs, kind, id, code(s), x); without ``sizes`` only (t, cell, kind), to be counted."""

    def run(batches):
        d, largest, tables, width = shared.value
        known = sizes.value if sizes is not None else None
        functions = _functions(d, tables, width)
        for b in batches:
            if not b.num_rows:
                continue
            ids, raw = b.column(0).to_numpy(), b.column(1).to_pylist()
            x = np.frombuffer(b"".join(raw)).reshape(len(raw), -1)
            lifted = _lift(x, largest)
            ask = np.flatnonzero(ids % every == 0)
            unit = np.concatenate([x[ask] / np.linalg.norm(x[ask], axis=1, keepdims=True), np.zeros((len(ask), 1))], 1)
            out = []
            for t, f in enumerate(functions):
                codes = _codes(np.floor((lifted @ f[0] + f[1]) / width).astype(np.int64))
                out += [(t, int(c) >> 20, 0, i, [int(c)]) for i, c in enumerate(codes)]
                for start in range(0, len(ask), 512):
                    part = ask[start : start + 512]
                    for i, p in zip(part.tolist(), _probes(unit[start : start + 512], f, width, probes), strict=True):
                        cells = p >> 20
                        for c in np.unique(cells):
                            out.append((t, int(c), 1, i, p[cells == c].tolist()))
            if known is None:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int32())], ["t", "cell", "kind"])
                continue
            rows = []
            salt = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).tolist()
            for t, cell, kind, i, codes in out:
                n_data, n_ask = known.get((t, cell), (0, 0))
                if not n_data or not n_ask:
                    continue
                nd, nq = -(-n_data // BLOCK), -(-n_ask // QUERIES)
                own = salt[i] % (nq if kind else nd)
                rows += [(t, cell, j if kind else own, own if kind else j, kind, int(ids[i]), codes, raw[i]) for j in range(nd if kind else nq)]
            for lo in range(0, len(rows), 20_000):
                cols = list(zip(*rows[lo : lo + 20_000], strict=True))
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["t", "cell", "ds", "qs", "kind", "id", "codes", "x"])

    return run


def _best(top: int):
    def run(key, table):
        kind, ids = table.column("kind").to_numpy(), table.column("id").to_numpy()
        x, codes = _matrix(table.column("x")), table.column("codes").to_pylist()
        data = np.flatnonzero(kind == 0)
        data = data[np.argsort(ids[data], kind="stable")]
        ask = np.flatnonzero(kind == 1)
        out: list[list] = [[], [], []]
        if len(data) and len(ask):
            own, place = np.unique([codes[i][0] for i in data], return_inverse=True)
            at = {c: i for i, c in enumerate(own.tolist())}
            y, name = x[data], ids[data]
            for lo in range(0, len(ask), 128):
                part = ask[lo : lo + 128]
                open_ = np.zeros((len(part), len(own)), bool)
                for r, i in enumerate(part):
                    open_[r, [at[c] for c in codes[i] if c in at]] = True
                s = x[part] @ y.T
                s[~open_[:, place] | (name[None] == ids[part][:, None])] = -np.inf
                k = min(top, s.shape[1])
                least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                for r, i in enumerate(part):
                    near = np.flatnonzero((s[r] >= least[r] - 1e-9 * max(1.0, abs(least[r]))) & (s[r] > -np.inf)) if np.isfinite(least[r]) else np.flatnonzero(s[r] > -np.inf)
                    score = (y[near] * x[i]).sum(1)
                    best = np.lexsort((name[near], -score))[:top]
                    out[0] += [ids[i]] * len(best)
                    out[1] += name[near[best]].tolist()
                    out[2] += score[best].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def neighbours(df: DataFrame, top: int = TOP, every: int = EVERY, probes: int = PROBES, tables: int = TABLES, width: float = WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of each row whose id is divisible by ``every``.

    Vectors are lifted onto a sphere, where the nearest is that of largest inner product, and hashed by
    p-stable projections.  A query visits the buckets of least estimated distance in each of the
    tables; those of one cell (the first two hash values) are visited together, in groups of at
    most ``BLOCK`` vectors and ``QUERIES`` queries, each of which returns its nearest by exact products.
    Every row is indexed, no bucket is capped, and a query that finds fewer than ``top`` although there
    are more is compared with all rows, in blocks.

    Defined cases: vectors that take no part are neither queries nor candidates; rows of equal id and vector count
    as one; with fewer candidates than ``top`` all are returned; an empty table gives an empty result."""
    spark, found = df.sparkSession, None
    rows = cut(_valid(df).distinct().mapInArrow(_as_bytes, "vec_id long, x binary, d int"), "op8")
    schema = "t int, cell long, ds int, qs int, kind int, id long, codes array<long>, x binary"
    result = "query_id long, vec_id long, score double"

    def norms(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((x * x).sum(1)).max())]), pa.array([b.num_rows], pa.int64())], ["norm", "n"])

    for (d,) in rows.select("d").distinct().collect():  # a row a length
        some = rows.where(F.col("d") == d).select("vec_id", "x")
        largest, n = some.select("x").mapInArrow(norms, "norm double, n long").agg(F.max("norm"), F.sum("n")).first()
        shared = spark.sparkContext.broadcast((d, largest, tables, width))
        # hash values of vectors on a sphere are bounded, and with them the cells counted here
        counts: dict = {}
        for t, cell, kind, k in some.mapInArrow(_index(shared, every, probes), "t int, cell long, kind int").groupBy("t", "cell", "kind").count().collect():
            pair = counts.get((t, cell), (0, 0))
            counts[t, cell] = (k, pair[1]) if kind == 0 else (pair[0], k)
        sizes = spark.sparkContext.broadcast(counts)
        near = some.mapInArrow(_index(shared, every, probes, sizes), schema).groupBy("t", "cell", "ds", "qs").applyInArrow(_best(top), result)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = cut(near.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top), "op8")
        enough = min(top, n - 1)
        have = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("k"))
        short = some.where(F.col("vec_id") % every == 0).join(have, F.col("vec_id") == F.col("query_id"), "left").where(F.coalesce("k", F.lit(0)) < enough).select("vec_id", "x")
        short = cut(short, "op8")
        blocks, asks = -(-n // BLOCK), -(-short.count() // QUERIES)
        if asks:
            same = F.lit(0).cast("int")
            one = F.array(F.lit(0).cast("long"))
            of = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
            each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
            side = [same.alias("t"), F.lit(0).cast("long").alias("cell")]
            tail = [F.col("vec_id").alias("id"), one.alias("codes"), "x"]
            all_rows = some.select(*side, of(blocks).alias("ds"), each(asks).alias("qs"), F.lit(0).alias("kind"), *tail)
            all_asks = short.select(*side, each(blocks).alias("ds"), of(asks).alias("qs"), F.lit(1).alias("kind"), *tail)
            exact = all_rows.unionByName(all_asks).groupBy("t", "cell", "ds", "qs").applyInArrow(_best(top), result)
            exact = exact.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            best = best.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(exact)
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], result + ", rank int")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_ann_search(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
