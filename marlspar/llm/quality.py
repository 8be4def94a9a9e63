"""Quality classifier: a factorisation machine over hashed words and structure statistics.

A text's features are the relative frequencies of its words, hashed into ``BUCKETS`` buckets, and a few
standardised statistics of its structure and metadata.  Besides a weight, each feature has a vector
of ``RANK`` numbers; all pairs of features interact through the products of their vectors.  The sum
over pairs is taken in linear time: half of the square of the sum less the sum of the squares.

It is fitted on at most ``SAMPLE`` labelled rows, those of least hash of the id (``draw``), in an order that is
that of their features, so that reruns agree; all rows are scored over their whole texts.

Defined cases: a null or empty text has no words and all statistics 0, and is scored like any other;
a null n_chars counts as the text's length; without labelled rows every score is 0.5; a row without a label is
scored, never learned from; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

BUCKETS = 1 << 16
RANK = 6
SAMPLE = 6000
LIMIT = 0.3
STATS = 15
_CLASS = np.zeros((256, 5), bool)
_CLASS[48:58, 0] = True  # digits
_CLASS[65:91, 1] = True  # capitals
_CLASS[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63], 2] = True  # common marks
_CLASS[[*range(35, 39), 42, 43, 47, 60, 61, 62, 64, *range(91, 97), *range(123, 127)], 3] = True  # symbols
_CLASS[128:, 4] = True


def features(data: np.ndarray, off: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, bucket, relative frequency) of the words of each text, and the texts' statistics."""
    n = len(off) - 1
    ws, we, first = K.word_bounds(data, off)
    stats = np.zeros((n, STATS))
    size, words = np.diff(off), np.diff(first)
    total = np.zeros((len(data) + 1, 6), np.int64)
    np.cumsum(_CLASS[data], axis=0, out=total[1:, :5])
    np.cumsum(data == 10, out=total[1:, 5])
    part = total[off[1:]] - total[off[:-1]]
    stats[:, :5] = part[:, :5] / np.maximum(size, 1)[:, None]
    stats[:, 5] = np.log1p(size)
    stats[:, 6] = np.log1p(words)
    stats[:, 7] = np.log1p(part[:, 5]) - np.log1p(words)
    stats[:, 8] = np.log1p(np.maximum(meta, 0))
    if not len(ws):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.float32), stats
    row = np.repeat(np.arange(n), words)
    length = np.zeros(len(ws) + 1)
    np.cumsum(we - ws, out=length[1:])
    stats[:, 9] = (length[first[1:]] - length[first[:-1]]) / np.maximum(words, 1)
    h = K.word_hashes(data, ws, we, lower=True)
    key = (row.astype(np.uint64) << np.uint64(16)) | (h >> np.uint64(48))
    key, count = np.unique(key, return_counts=True)
    r, bucket = (key >> np.uint64(16)).astype(np.int64), (key & np.uint64(0xFFFF)).astype(np.int64)
    x = (count / np.maximum(words, 1)[r]).astype(np.float32)
    stats[:, 10] = np.bincount(r, minlength=n) / np.maximum(words, 1)
    np.maximum.at(stats[:, 11], r, x)
    stats[:, 12] = np.log1p(np.maximum.reduceat(np.append(we - ws, 0), np.minimum(first[:-1], len(ws))) * (words > 0))
    again = (h[1:] == h[:-1]) & (row[1:] == row[:-1])  # a word that repeats the one before
    stats[:, 14] = np.bincount(row[1:][again], minlength=n) / np.maximum(words - 1, 1)
    pairs = K.ngrams(h, 2, 1)  # a word pair that repeats within the text
    same = row[:-1] == row[1:]
    pk = (row[:-1][same].astype(np.uint64) << np.uint64(40)) | (pairs[same] >> np.uint64(24))
    distinct = np.bincount((np.unique(pk) >> np.uint64(40)).astype(np.int64), minlength=n)
    stats[:, 13] = 1 - distinct / np.maximum(words - 1, 1)
    stats[words < 2, 13] = 0
    return r, bucket, x, stats


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        y, meta, ix, xs, st = b.column(0), _meta(b), [], [], []
        for lo, hi, data, off in K.slices(K.column(b, "text")):
            r, bucket, x, stats = features(data, off, np.where(meta[lo:hi] < 0, np.diff(off), meta[lo:hi]))
            cut = np.searchsorted(r, np.arange(hi - lo + 1))
            for i in range(hi - lo):
                ix.append(bucket[cut[i] : cut[i + 1]].astype(np.uint16).tobytes())
                xs.append(x[cut[i] : cut[i + 1]].tobytes())
                st.append(stats[i].tobytes())
        yield pa.RecordBatch.from_arrays([y, pa.array(ix, pa.binary()), pa.array(xs, pa.binary()), pa.array(st, pa.binary())], ["y", "ix", "xs", "st"])


def _meta(b: pa.RecordBatch) -> np.ndarray:
    return b.column(b.schema.names.index("n_chars")).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)


def margins(model: dict, r, bucket, x, stats: np.ndarray) -> np.ndarray:
    """The machine's output for each text."""
    n = len(stats)
    z = np.clip((stats - model["mean"]) / model["std"], -6, 6)
    out = model["b"] + z @ model["ws"]
    out += np.bincount(r, x * model["w"][bucket], n) * model["gain"]
    v = model["v"][bucket] * (x * model["gain"])[:, None]
    for k in range(v.shape[1]):
        s = np.bincount(r, v[:, k], n) + z @ model["vs"][:, k]
        q = np.bincount(r, v[:, k] ** 2, n) + z**2 @ model["vs"][:, k] ** 2
        out += 0.5 * (s**2 - q)
    return out


def draw(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, y) of at most ``sample`` labelled ids: a table of bounded size."""
    least = labels.groupBy("doc_id").agg(F.max("quality").cast("int").alias("y")).orderBy(F.xxhash64(F.lit("quality-sample"), "doc_id"), "doc_id").limit(sample)
    return labels.sparkSession.createDataFrame([(r[0], r[1]) for r in least.collect()], "doc_id long, y int")


def fit(labelled: DataFrame, rank: int = RANK) -> dict | None:
    """A model from the rows (y, text, n_chars) of a sample of bounded size; None without rows."""
    rows = labelled.mapInArrow(_emit, "y int, ix binary, xs binary, st binary").collect()
    if not rows:
        return None
    rows.sort()
    y = np.array([r[0] for r in rows], float)
    ix = [np.frombuffer(r[1], np.uint16).astype(np.int64) for r in rows]
    xs = [np.frombuffer(r[2], np.float32) for r in rows]
    st = np.stack([np.frombuffer(r[3]) for r in rows])
    rng = np.random.default_rng(11)
    model = {"mean": st.mean(0), "std": np.maximum(st.std(0), 1e-6), "b": float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), "gain": 10.0,
             "w": np.zeros(BUCKETS), "v": rng.normal(0, 0.01, (BUCKETS, rank)), "ws": np.zeros(STATS), "vs": rng.normal(0, 0.01, (STATS, rank))}
    z = np.clip((st - model["mean"]) / model["std"], -6, 6)
    sums = {k: np.full_like(model[k], 1e-6) for k in ("w", "v", "ws", "vs")}
    bias = 1e-6
    for epoch in range(12):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 64):
            part = order[lo : lo + 64]
            n = len(part)
            r = np.repeat(np.arange(n), [len(ix[i]) for i in part])
            k = np.concatenate([ix[i] for i in part])
            x = np.concatenate([xs[i] for i in part]) * model["gain"]
            zb = z[part]
            vx = model["v"][k] * x[:, None]
            s = np.stack([np.bincount(r, vx[:, f], n) for f in range(rank)], 1) + zb @ model["vs"]
            q = np.stack([np.bincount(r, vx[:, f] ** 2, n) for f in range(rank)], 1) + zb**2 @ model["vs"] ** 2
            m = model["b"] + zb @ model["ws"] + np.bincount(r, x * model["w"][k], n) + 0.5 * (s**2 - q).sum(1)
            g = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[part]) / n
            seen, back = np.unique(k, return_inverse=True)
            gw = np.bincount(back, g[r] * x, len(seen)) + 1e-5 * model["w"][seen]
            each = g[r][:, None] * x[:, None] * (s[r] - vx)
            gv = np.stack([np.bincount(back, each[:, f], len(seen)) for f in range(rank)], 1) + 1e-5 * model["v"][seen]
            gs = zb.T @ g + 1e-4 * model["ws"]
            gvs = zb.T @ (g[:, None] * s) - (zb**2 * g[:, None]).sum(0)[:, None] * model["vs"] + 1e-4 * model["vs"]
            for name, at, grad, rate in (("w", seen, gw, 0.1), ("v", seen, gv, 0.02), ("ws", slice(None), gs, 0.05), ("vs", slice(None), gvs, 0.02)):
                sums[name][at] += grad**2
                model[name][at] -= rate * grad / np.sqrt(sums[name][at])
            bias += g.sum() ** 2
            model["b"] -= 0.05 * g.sum() / np.sqrt(bias)
    model["w"], model["v"] = model["w"].astype(np.float32), model["v"].astype(np.float32)
    return model


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            meta, out = _meta(b), np.zeros(b.num_rows)
            if model is not None:
                for lo, hi, data, off in K.slices(K.column(b, "text")):
                    out[lo:hi] = margins(model, *features(data, off, np.where(meta[lo:hi] < 0, np.diff(off), meta[lo:hi])))
            p = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= LIMIT).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    return K.tidy(run)


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` (text, n_chars and any others) with score and predicted, in place of columns of these names."""
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_score(shared), f"{fields}, score double, predicted int")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
    few = draw(labels)
    model = None if few.isEmpty() else fit(docs.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min(F.struct("y", "text", "n_chars")).alias("r")).select("r.*"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
