"""Language identification with error-correcting output codes.

Each language has a codeword of ``BITS`` bits.  For each bit a linear classifier over the relative
frequencies of byte trigrams predicts the bit; a text's language is the one whose codeword has the
least loss-weighted distance, with each bit's loss weighted by the bit's accuracy in training.  A text whose two nearest
codewords are close to each other is flagged ambiguous.

The classifiers are fitted on a sample of labelled rows, drawn by a hash of the id: about
``SAMPLE_PER_LANG`` rows a language at most.  Everything else reads whole texts of all rows.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and not ambiguous; without any
labelled row every text is ``und``; a row without a language is predicted, never learned from; repeated rows
get equal predictions; other columns are carried through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

BITS = 12
BUCKETS = 1 << 13
SAMPLE_PER_LANG = 500
#: Probability of the best language under which a text is ambiguous.
SURE = 0.6
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def grams(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that starts at each byte (case of A-Z dropped); zeros follow the end of each row."""
    x = K._LOWER[data].astype(np.uint32)
    y = np.zeros(len(x) + 2, np.uint32)
    y[: len(x)] = x
    second, third = y[1:-1].copy(), y[2:].copy()
    second[off[off > 0] - 1] = third[off[off > 0] - 1] = third[off[off > 1] - 2] = 0
    return ((x + (second << 8) + (third << 16)) * np.uint32(2654435761)) >> np.uint32(19)


def codewords(n: int, bits: int = BITS) -> np.ndarray:
    """n rows of +1 and -1, far from each other: the best of many drawn with a fixed seed."""
    rng, best, far = np.random.default_rng(7), None, (-1, 0)
    bits = max(bits, int(np.ceil(3 * np.log2(max(n, 2)))))
    for _ in range(300):
        c = np.where(rng.random((n, bits)) < 0.5, -1.0, 1.0)
        d = (c[:, None] != c[None]).sum(2) + np.eye(n, dtype=int) * bits
        same = int((np.abs(c.sum(0)) == n).sum())  # bits that all languages share say nothing
        if (d.min(), -same) > far:
            best, far = c, (d.min(), -same)
    return best


def _features(buckets: int):
    """The buckets of each text's trigrams and their relative frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, ix, xs = b.column(0).to_pylist(), [], []
            for _, _, data, off in K.slices(K.column(b, "text")):
                g = grams(data, off)
                for i in range(len(off) - 1):
                    n = np.bincount(g[off[i] : off[i + 1]], minlength=buckets)
                    at = np.flatnonzero(n)
                    ix.append(at.astype(np.uint16).tobytes())
                    xs.append((n[at] / max(1, off[i + 1] - off[i])).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(ix, pa.binary()), pa.array(xs, pa.binary())], ["lang", "ix", "xs"])

    return run


def fit(train: DataFrame, per_lang: int = SAMPLE_PER_LANG, bits: int = BITS) -> dict | None:
    """A model from rows (doc_id, text, lang); None without labelled rows."""
    counts = dict(train.where("lang IS NOT NULL").groupBy("lang").count().collect())  # a row a language
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_lang / n))])
    drawn = F.pmod(F.xxhash64(F.lit("language-sample"), "doc_id"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003
    sample = train.where("lang IS NOT NULL AND text IS NOT NULL").where(drawn).select("lang", "text")
    sample = sample.limit(2 * per_lang * len(counts))
    rows = [r for r in sample.mapInArrow(_features(BUCKETS), "lang string, ix binary, xs binary").collect() if r[1]]
    if not rows:
        return None
    rows.sort()  # reruns agree
    langs = sorted(counts)
    code = codewords(len(langs), bits)
    t = code[[langs.index(r[0]) for r in rows]].astype(np.float32)
    size = np.array([len(r[1]) // 2 for r in rows])
    bucket = np.frombuffer(b"".join(r[1] for r in rows), np.uint16).astype(np.int64)
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float32)
    row, start = np.repeat(np.arange(len(rows)), size), np.cumsum(size) - size
    n = len(rows)
    del rows
    # Scores are linear in relative frequencies, so that one pass over a text's bytes gives them; each
    # bucket is scaled by the root of its mean frequency.
    scale = (1 / np.sqrt(np.maximum(np.bincount(bucket, x, BUCKETS) / n, 1e-5))).astype(np.float32)
    z = x * scale[bucket]
    turn = np.argsort(bucket, kind="stable")  # the same numbers by bucket, for the gradient
    used, first = np.unique(bucket[turn], return_index=True)
    zt, rt = z[turn], row[turn]
    w, c, v = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32), np.zeros((BUCKETS, code.shape[1]), np.float32)

    def margins(k: int) -> np.ndarray:
        return np.add.reduceat(z * w[bucket, k], start) + c[k]

    for k in range(code.shape[1]):
        for _ in range(80):
            g = (-t[:, k] / (1 + np.exp(np.clip(t[:, k] * margins(k), -30, 30))) / n).astype(np.float32)
            v[:, k] = np.float32(0.9) * v[:, k] + np.float32(1e-5) * w[:, k]
            v[used, k] += np.add.reduceat(zt * g[rt], first)
            w[:, k] -= np.float32(30.0) * v[:, k]
            c[k] -= np.float32(3.0) * g.sum()
    m = np.stack([margins(k) for k in range(code.shape[1])], 1)
    right = np.clip((t * m > 0).mean(0), 0.55, 0.999)
    weight = np.log(right / (1 - right))
    return {"langs": langs, "code": code, "w": (w * scale[:, None]).astype(np.float32), "c": c, "weight": weight / weight.mean()}


def decode(f: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each language from the bits' margins."""
    loss = np.logaddexp(0, -np.clip(f, -8, 8)[:, None, :] * model["code"][None]) @ model["weight"]
    p = np.exp(-(loss - loss.min(1, keepdims=True)))
    p /= p.sum(1, keepdims=True)
    return p.argmax(1), p.max(1)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            lang, score, unsure = [], [], []
            texts = K.column(b, "text")
            for lo, hi, data, off in K.slices(texts, 1 << 19):
                n = hi - lo
                if model is None or not len(data):
                    lang += ["und"] * n
                    score += [0.0] * n
                    unsure += [False] * n
                    continue
                g, at = grams(data, off), np.minimum(off[:-1], len(data) - 1)
                size = np.diff(off)
                f = np.zeros((n, model["w"].shape[1]))
                for a in range(0, n):  # one text at a time keeps the working set in the cache
                    x = g[off[a] : off[a + 1]]
                    for k in range(0, len(x), 1 << 15):
                        f[a] += model["w"][x[k : k + (1 << 15)]].sum(0)
                f = f / np.maximum(size, 1)[:, None] + model["c"]
                best, p = decode(f, model)
                has = np.logical_or.reduceat(_LETTER[data], at) & (size > 0)
                for i in np.flatnonzero(~has & (size > 0)):
                    has[i] = any(map(str.isalpha, texts[lo + int(i)].as_py()))
                lang += [model["langs"][k] if h else "und" for k, h in zip(best.tolist(), has.tolist(), strict=True)]
                score += np.where(has, p, 0.0).tolist()
                unsure += (has & (p < SURE)).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], [*b.schema.names, "lang_pred", "score", "ambiguous"])

    return K.tidy(run)


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous, in place of columns of these names."""
    docs = docs.drop("lang_pred", "score", "ambiguous")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_predict(shared), f"{fields}, lang_pred string, score double, ambiguous boolean")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
