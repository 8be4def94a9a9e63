"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of every window of 50 words the 8-gram of least fingerprint (the last of
equals), so that two equal windows choose the same anchor.  An anchor's context are all words of the
windows that chose it.  One aggregate with map-side combining turns occurrences into classes of equal contexts, and
documents meet on anchors as classes; anchors that only one document has are done.
Extension goes both ways at once: occurrences whose contexts are equal match over the whole context,
and the class tells its first document, however large it is, without pairing its members; an anchor, class or window that
very many rows share is dealt over tasks.  Only the first occurrence of a class whose anchor also has other contexts is
extended word by word: its windows are compared, by fingerprints of 128 bits, with those of the other
classes.  A window that an earlier document has is a repeat of at least the threshold's length, and
neighbouring windows join into maximal repeats, whose words go.

Defined cases: null and empty texts and texts under 50 words lose nothing; rows of one doc_id do not
lose words to each other; a null doc_id neither loses nor takes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import cut, free, member_of, spread

LENGTH = 50
SEED_WORDS = 8


def last_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of the least, the last among equals."""
    at, have = np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[:-step], at[step:]
        at = np.where(x[b] <= x[a], b, a)
        have += step
    return at


def _anchors(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for lo, _, data, off in K.slices(K.column(b, "text")):
                ws, we, first = K.word_bounds(data, off)
                if len(ws) < length:
                    continue
                h = K.word_hashes(data, ws, we)
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                grams = K.ngrams(h, seed, 1)
                chosen = last_minimum(grams, length - seed + 1)
                win = np.flatnonzero(row[: len(chosen)] == row[length - 1 :])
                if not len(win):
                    continue
                c = chosen[win]
                new = np.ones(len(win), bool)
                new[1:] = (c[1:] != c[:-1]) | (win[1:] != win[:-1] + 1)
                i = np.flatnonzero(new)
                s, e = win[i], win[np.append(i[1:], len(win)) - 1]
                r = row[s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo + r]), pa.array(keys[lo + r]), pa.array((s - first[r]).astype(np.int32)), pa.array((e - first[r]).astype(np.int32)), K.signed(grams[c[i]]), K.signed(K.ranges(h, s, e + length, 2))],
                    ["doc_id", "row_key", "s", "e", "anchor", "context"],
                )

    return K.tidy(run)


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            spans = b.column(3).to_pylist()
            for lo, hi, data, off in K.slices(K.column(b, "text")):
                ws, we, first = K.word_bounds(data, off)
                h = K.word_hashes(data, ws, we)
                at, row = [], []
                for r in range(lo, hi):
                    mark = np.zeros(first[r - lo + 1] - first[r - lo], bool)
                    for x in spans[r]:
                        mark[x["s"] : x["e"] + 1] = True
                    p = np.flatnonzero(mark)
                    at.append(p + first[r - lo])
                    row.append(np.full(len(p), r))
                at, row = np.concatenate(at), np.concatenate(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row]), pa.array(keys[row]), pa.array((at - first[row - lo]).astype(np.int32)), K.signed(K.ranges(h, at, at + length, 1)), K.signed(K.ranges(h, at, at + length, 2))],
                    ["doc_id", "row_key", "s", "w1", "w2"],
                )

    return K.tidy(run)


def _strip(name: str):
    """Adds n_words, n_removed and the kept words joined by single spaces; takes the spans, in column ``name``, away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.names.index(name)
            spans, texts = b.column(at).to_pylist(), K.column(b, "text").to_pylist()
            n, gone, kept = [], [], []
            for t, sp in zip(texts, spans, strict=True):
                w = t.encode().split()  # splits at the six ASCII white-space bytes, no others
                n.append(len(w))
                if sp:
                    mark = np.zeros(len(w), bool)
                    for x in sp:
                        mark[x["s"] : x["e"]] = True
                    w = [x for x, m in zip(w, mark.tolist(), strict=True) if not m]
                gone.append(n[-1] - len(w))
                kept.append(b" ".join(w))
            rest = [i for i in range(b.num_columns) if i != at]
            names = [b.schema.names[i] for i in rest] + ["n_words", "n_removed", "kept_sha256", "kept_text"]
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in rest] + [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array([k.decode() for k in kept], pa.string())],
                names,
            )

    return K.tidy(run)


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED_WORDS) -> DataFrame:
    """doc_id, row_key, s, e: words s to e (e excluded) of a row that an earlier document has."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text").where("doc_id IS NOT NULL")
    anchors = cut(keyed.mapInArrow(_anchors(length, seed), "doc_id long, row_key long, s int, e int, anchor long, context long"), "op2")
    classes = cut(anchors.groupBy("anchor", "context").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("n")), "op2")
    shared = classes.groupBy("anchor").agg(F.min("first_id").alias("lo"), F.max("last_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    shared = cut(shared.select("anchor", "n", (F.col("n") > 1).alias("varied")), "op2")
    classes = cut(spread(classes, shared.select("anchor", "varied"), ["anchor"], ["context"], counts=shared), "op2")
    placed = spread(anchors, classes.select("anchor", "context", "first_id", "varied"), ["anchor", "context"], ["doc_id", "s"], counts=classes)
    placed = cut(placed.where("varied OR doc_id > first_id"), "op2")
    whole = placed.where("doc_id > first_id").select("doc_id", "row_key", "s", (F.col("e") + length).alias("e"))
    edges = cut(placed.where("doc_id = first_id AND varied").select("doc_id", "row_key", "s", "e"), "op2")
    some = member_of(edges, "doc_id")(keyed, "some").where("some").drop("some")
    spans = edges.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    again = some.join(spans.hint("shuffle_hash"), ["doc_id", "row_key"]).select("doc_id", "row_key", "text", "spans")
    windows = cut(again.mapInArrow(_windows(length), "doc_id long, row_key long, s int, w1 long, w2 long"), "op2")
    earliest = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    earliest = cut(earliest.select("w1", "w2", "lo", "n"), "op2")
    part = spread(windows, earliest.drop("n"), ["w1", "w2"], ["doc_id", "s"], counts=earliest).where("doc_id > lo").select("doc_id", "row_key", "s", (F.col("s") + length).alias("e"))
    return whole.unionByName(part)


def dedup(docs: DataFrame, length: int = LENGTH, seed: int = SEED_WORDS) -> DataFrame:
    """``docs`` (doc_id, text and any others) with n_words, n_removed, kept_sha256 and kept_text, in place of columns of these names."""
    docs = docs.drop("n_words", "n_removed", "kept_sha256", "kept_text")
    ident, key, covered, touched = free(docs.columns, "ident", "key", "covered", "touched")
    gone = cut(repeats(docs, length, seed), "op2")
    spans = gone.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("s", "e")).alias("l"))
    spans = spans.select(F.col("doc_id").alias(ident), F.col("row_key").alias(key), F.col("l").alias(covered))
    split = member_of(gone, "doc_id")(docs, touched)
    hit = split.where(F.col(touched)).drop(touched)
    hit = hit.join(spans.hint("shuffle_hash"), (F.col("doc_id") == F.col(ident)) & (F.xxhash64("text") == F.col(key)), "left").select(*docs.columns, covered)
    rest = split.where(~F.col(touched)).select(*docs.columns, F.lit(None).cast("array<struct<s:int,e:int>>").alias(covered))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return rest.unionByName(hit).mapInArrow(_strip(covered), f"{fields}, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY sha256(array_to_string(w[i:i + 49], ' '))) AS first_id FROM p),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM g WHERE first_id < doc_id),
k AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id),
f AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN k USING (doc_id)),
q AS (SELECT doc_id, len(w) AS n, len(gone) AS n_gone, gone, w FROM f),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
v AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY u.i) AS kept FROM u ANTI JOIN r ON u.doc_id = r.doc_id AND u.i = r.i GROUP BY u.doc_id)
SELECT q.doc_id, CAST(n AS BIGINT) AS n_words, CAST(n_gone AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM q LEFT JOIN v USING (doc_id)
"""
