"""Operators over texts against brute force, and their defined cases."""

import collections
import hashlib
import os
import random
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspar.llm import graph, jaccard, kernels, language, mixing, packing, quality, scratch, substring

DOC = "doc_id long, text string, lang string, source string, n_chars long, spans string, s1 string"


def table(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None, "spans", "s1") for i, t, lang, s in rows], DOC).repartition(3)


def words(rng, n, size=40):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def split(text):
    return [w for w in (text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    base = [words(rng, 150, 500) for _ in range(12)]
    passage = words(rng, 70, 500)
    rows = []
    for i in range(60):
        w = list(rng.choice(base)) if i % 3 else words(rng, rng.randrange(0, 130), 500)
        for _ in range(rng.randrange(4)):
            if w:
                w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
        if i % 5 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(15) :]
        rows.append((i * 3 + 1, rng.choice([" ", "\n", " \t"]).join(w), "en", f"s{i % 3}"))
    rows += [(500, None, None, None), (501, "", "en", None), (502, " \n ", "en", "s0"), (503, "one two", "en", "s0"), (504, "ONE\ttwo", "de", "s1"), (505, "x", None, "s1"), (506, "café non break", "fr", "s1")]
    rows += [(7, rows[2][1], "en", "s2"), (7, rows[2][1], "en", "s2")]  # repeated rows, of an id that other rows have too
    rows += [(None, rows[3][1], "en", "s1"), (900, " ".join(words(rng, 30_000, 5000)), "en", "s1")]
    return rows


def test_words_are_split_at_six_bytes_only():
    text = "a b\tc\nd\x0be\x0cf\rg h\x85i j".encode()
    data = np.frombuffer(text, np.uint8)
    s, e, first = kernels.word_bounds(data, np.array([0, len(data)]))
    assert [text[a:b] for a, b in zip(s, e, strict=True)] == text.split()
    assert first.tolist() == [0, 7]


def test_word_hashes_do_not_depend_on_place():
    a, b = b"xx same yy", b"same"
    h = [kernels.word_hashes(d := np.frombuffer(t, np.uint8), *kernels.word_bounds(d, np.array([0, len(d)]))[:2]) for t in (a, b)]
    assert h[0][1] == h[1][0] and len(set(h[0].tolist())) == 3


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    root = list(range(200))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.u: r.v for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert all(got.get(x, x) == find(x) for e in edges for x in e)
    assert graph.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def brute_repeats(rows, n=50):
    first, out = {}, []
    for i, t, *_ in rows:
        w = split(t)
        for k in range(len(w) - n + 1):
            if i is not None:
                key = tuple(w[k : k + n])
                first[key] = min(first.get(key, i), i)
    for i, t, *_ in rows:
        w = split(t)
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return collections.Counter(out)


def test_substring_dedup(spark, corpus):
    got = substring.dedup(table(spark, corpus))
    assert {"spans", "s1", "kept_text"} <= set(got.columns)
    clash = table(spark, corpus[:9]).withColumn("covered", F.lit("c")).withColumn("ident", F.lit(1)).withColumn("__touched", F.lit("t"))
    assert set(clash.columns) < set(substring.dedup(clash).columns) and substring.dedup(clash).where("covered <> 'c' OR ident <> 1 OR __touched <> 't'").count() == 0
    rows = collections.Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert rows == brute_repeats(corpus)
    assert sum(r[2] for r in rows) > 1000
    assert substring.dedup(table(spark, corpus).where("false")).count() == 0


def test_last_minimum():
    x = np.random.default_rng(0).integers(0, 5, 200).astype(np.uint64)
    for width in (1, 2, 7, 43):
        got = substring.last_minimum(x, width)
        assert got.tolist() == [max(k for k in range(i, i + width) if x[k] == x[i : i + width].min()) for i in range(len(x) - width + 1)]


def shingles(t):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in split(t)]
    return frozenset([tuple(w)] if 0 < len(w) < 3 else zip(w, w[1:], w[2:], strict=False))


def brute_jaccard(rows, percent):
    sets = [shingles(t) for _, t, *_ in rows]
    label = [r[0] for r in rows]
    live = [k for k, (r, s) in enumerate(zip(rows, sets, strict=True)) if s and r[0] is not None]
    changed = True
    while changed:
        changed = False
        for a in live:
            for b in live:
                if (rows[a][0] == rows[b][0] or 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])) and label[a] > label[b]:
                    label[a] = label[b]
                    changed = True
    by_set = {s: label[k] for k, s in enumerate(sets) if k in live}
    return collections.Counter((r[0], len(s), by_set.get(s) if s and r[0] is None else label[k]) for k, (r, s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(seed, n):
    rng = random.Random(seed)
    out, i = [], 0
    for _ in range(6):
        base = words(rng, rng.randrange(20, 120), 60)
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = [f"e{rng.randrange(5)}"] * rng.randrange(2)
            out.append((i * 7 % 1009, " ".join(w).upper() if i % 4 == 0 else " ".join(w), "en", "s"))
            i += 1
    return out


@pytest.mark.parametrize("percent", [90, 80])
def test_jaccard_join(spark, corpus, percent):
    rows = corpus[:-1] + near_copies(percent, 12)
    got = jaccard.join(table(spark, rows), percent=percent)
    assert collections.Counter(tuple(r) for r in got.collect()) == brute_jaccard(rows, percent)
    assert jaccard.join(table(spark, rows).where("false"), percent=percent).count() == 0


def test_jaccard_of_frequent_shingles_does_not_compare_all_pairs(spark, monkeypatch):
    """Unlinked sets of frequent shingles only: candidate pairs don't grow with the square of the rows; links among them are found."""
    rng, met = random.Random(8), []
    for n in (600, 1200):
        rows = [(i, " ".join(rng.choice("abcdef") for _ in range(30)), "en", "s") for i in range(n)]
        rows += [(5000 + i, t.replace(t[-1], "e", 1) if i % 2 else t + " a", "en", "s") for i, t, *_ in rows[:40]]
        job = jaccard.Join(table(spark, rows))
        got = collections.Counter(tuple(r) for r in job.run().collect())
        if n == 600:
            assert got == brute_jaccard(rows, 90)
        met.append(job.met.count())
    assert met[1] < 2.5 * met[0] + 100, met


@pytest.mark.parametrize("percent", [90, 80])
def test_equal_parts_miss_no_link(percent):
    """Two sets that link have an equal part, whatever their sizes."""
    rng = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 2**62, n).astype(np.uint64)
        drop, add = int(rng.integers(0, n // 5 + 2)), int(rng.integers(0, n // 5 + 2))
        b = np.concatenate([a[drop:], rng.integers(0, 2**62, add).astype(np.uint64)])
        common = n - min(drop, n)
        if not len(b) or 100 * common < percent * (n + len(b) - common):
            continue
        small, large = sorted((a, b), key=len)
        c = jaccard.size_class(np.array([len(small), len(large)]), percent)
        assert c[1] - c[0] in (0, 1)
        assert jaccard.part_count(c[:1], percent)[0] > n + len(b) - 2 * common


def test_spread_is_a_join(spark):
    rng = random.Random(4)
    left = [(rng.choice([1, 1, 1, 2, None, rng.randrange(900)]), i) for i in range(3000)]
    right = [(k, -k) for k in range(700)] + [(None, 5)]
    a, b = spark.createDataFrame(left, "k long, i long"), spark.createDataFrame(right, "k long, salt long")
    for how in ("inner", "left"):
        got = collections.Counter(tuple(r) for r in scratch.spread(a, b, ["k"], ["i"], how).collect())
        want = collections.Counter((k, i, -k) if k is not None and k < 700 else (k, i, None) for k, i in left if how == "left" or (k is not None and k < 700))
        assert got == want


def test_scratch_tables_have_no_files_beside_their_parts(spark):
    rows = scratch.cut(spark.range(0, 1000, 1, 8), "t")
    names = os.listdir(os.path.dirname(urllib.parse.urlsplit(rows.inputFiles()[0]).path))
    assert rows.count() == 1000 and len(names) == 8 and all(n.endswith(".parquet") for n in names)
    assert scratch.cut(spark.range(10).where("id < 0"), "t").count() == 0


def test_driver_frees_what_written_tables_held(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = whole()
    for _ in range(scratch.FREE_EVERY):
        scratch.cut(spark.range(1), "t")
    assert whole() > before


def test_scopes_keep_what_others_wrote(spark):
    kept = scratch.cut(spark.range(3), "t")
    with scratch.scope() as name:
        gone = scratch.cut(spark.range(4), "t")
        assert gone.count() == 4
    scratch.release(name)
    assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)not.exist|FILE_NOT"):
        gone.count()


def brute_targets(sizes):
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in order if x not in fixed) for s in order if s not in fixed}
        over = {s: 3.0 * sizes[s] for s in share if share[s] > 3 * sizes[s]}
        if not over:
            return fixed | share
        fixed |= over


def test_mixing(spark, corpus):
    rows = [r for r in corpus if r[0] is not None]
    docs = table(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(split(t))
    want = brute_targets(dict(sizes))
    taken = collections.Counter()
    source = {r[0]: r[3] for r in rows}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)
    assert collections.Counter((r.doc_id, r.taken) for r in got) == collections.Counter((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7)).collect())
    made = mixing.materialise(docs, mixing.mix(docs))
    assert made.columns == docs.columns
    assert made.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == sum(taken.values())
    assert mixing.mix(docs.where("false")).count() == 0
    clash = docs.withColumn("taken", F.lit(1)).withColumn("n", F.lit(2)).withColumn("size", F.lit("x")).withColumn("__taken", F.lit(3)).withColumn("own_key", F.lit(4))
    again = mixing.materialise(clash, mixing.mix(clash))
    assert again.columns == clash.columns and again.count() == made.count() and again.where("size <> 'x'").count() == 0
    assert {r.taken for r in mixing.mix(docs.where("doc_id in (500, 501)")).collect()} == {0}


def test_targets_reshare_until_none_is_above():
    got = {s: t for s, _, t, _, _ in mixing.targets([("a", 1), ("b", 100), ("c", 100), (None, 50)])}
    assert got == pytest.approx(brute_targets({"a": 1, "b": 100, "c": 100, None: 50}))
    assert got["a"] == 3


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    odd = [(912, "<|endoftext|>", "en", "s"), (913, "x<|endoftext|>y z", "en", "s"), (910, "a  b\n\n c d <|endoftext|> x", "en", "s"), (911, "don't\nstop 12,5 été.\nOk", "en", "s")]
    rows = corpus + odd
    got = packing.pack(table(spark, rows)).collect()
    tok = Tokenizer.from_file(packing.tokenizer_path())
    assert tok.encode("<|endoftext|>", add_special_tokens=False).ids == [50256]
    want = collections.defaultdict(list)
    for i, t, *_ in rows:
        want[i].append([*tok.encode(t or "", add_special_tokens=False).ids, 0])
    import zlib

    pieces, sequences = collections.Counter(), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        fits = [x for x in want[r.doc_id] if len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert fits, r
    assert pieces == {(i, n): n * k for i, xs in want.items() for n, k in collections.Counter(map(len, xs)).items()}
    for p in sequences.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(len(x) for xs in want.values() for x in xs)
    assert len(sequences) == -(-total // 1024)  # one sequence at most is not full
    assert packing.pack(table(spark, rows).where("false")).count() == 0


def test_packing_merges_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "MERGE", 2)
    docs = spark.createDataFrame([(i, "word " * (i % 50 + 1)) for i in range(400)], "doc_id long, text string").repartition(9)
    got = packing.pack(docs)
    full = got.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n < 1024 for r in full) <= 1
    assert got.count() == got.select("sequence_id", "offset").distinct().count()


def texts_of(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_language(spark):
    rng = random.Random(5)
    kinds = {"aa": "abcde", "bb": "efghi", "cc": "éèçmno"}
    rows = [(i, texts_of(rng, kinds[k], rng.randrange(5, 60)), k, k) for i, k in enumerate(rng.choices(list(kinds), k=300))]
    rows += [(1000, None, "aa", None), (1001, "", "aa", None), (1002, "123 !?", "aa", None), (1003, "éèç", None, None), (1004, "x" * 3_000_000, None, None)]
    docs = table(spark, rows)
    model = language.fit(docs.where(~language.held_out()).select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[i].lang_pred == k for i, _, k, _ in rows[:300]) >= 297
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "cc"]
    assert {r.lang_pred for r in language.predict(docs, language.fit(docs.where("false"))).collect()} == {"und"}
    assert language.predict(docs.where("false"), model).count() == 0


def test_language_does_not_depend_on_the_rows_beside(spark):
    rng = random.Random(11)
    kinds = {"aa": "abcde", "bb": "efghi"}
    docs = table(spark, [(i, texts_of(rng, kinds[k], 20), k, k) for i, k in enumerate(rng.choices(list(kinds), k=80))])
    model = language.fit(docs.select("doc_id", "text", "lang"))
    few = ["ef", "abc", "e", "", "ef", "ghi", "abc", "e", "e", "abcde", "ef"]
    got = language.predict(spark.createDataFrame(list(enumerate(few)), "doc_id long, text string").coalesce(1), model).collect()
    alone = [language.predict(spark.createDataFrame([(0, t)], "doc_id long, text string"), model).first() for t in sorted(set(few))]
    want = {r.text: (r.lang_pred, r.score, r.ambiguous) for r in alone}
    assert [(r.lang_pred, r.score, r.ambiguous) for r in sorted(got)] == [want[t] for t in few]
    data, off = np.frombuffer(b"abcdeabc", np.uint8), np.array([0, 0, 3, 4, 4, 5, 8])
    g = language.grams(data, off)
    assert g[:3].tolist() == g[5:].tolist() and language.grams(data[3:4], np.array([0, 0, 1])).tolist() == g[3:4].tolist()


def test_codewords_are_far_apart():
    for n in (1, 2, 4, 20):
        c = language.codewords(n)
        d = (c[:, None] != c[None]).sum(2) + np.eye(n, dtype=int) * 99
        assert n == 1 or d.min() >= 3


def test_decoding_chooses_the_nearest_codeword():
    code = language.codewords(4)
    model = {"code": code, "weight": np.ones(code.shape[1])}
    f = code * 3
    f[:, 0] *= -1  # one bit wrong in each
    assert language.decode(f, model)[0].tolist() == [0, 1, 2, 3]


def test_quality(spark):
    rng = random.Random(6)
    rows, y = [], {}
    for i in range(400):
        good = rng.random() < 0.7
        t = texts_of(rng, "abcdefgh", 40) if good else " ".join(["$$ | buy"] * rng.randrange(5, 30))
        rows.append((i, t, "en", "s"))
        y[i] = int(good)
    rows += [(1000, None, None, None), (1001, "", None, None), (1002, " \n", None, None)]
    docs = table(spark, rows)
    labelled = docs.where("doc_id < 300").select("doc_id", "text", "n_chars").join(spark.createDataFrame(list(y.items()), "doc_id long, y int"), "doc_id").select("y", "text", "n_chars")
    model = quality.fit(labelled)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert sum(got[i].predicted == y[i] for i in range(300, 400)) >= 97
    assert {r.score for r in quality.score(docs, quality.fit(labelled.where("false"))).collect()} == {0.5}


def test_quality_identity_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    data = np.frombuffer(b"a b c a d e", np.uint8)
    r, bucket, x, stats = quality.features(data, np.array([0, len(data)]), np.array([11]))
    model = {"mean": np.zeros(quality.STATS), "std": np.ones(quality.STATS), "b": 0.3, "gain": 2.0, "w": rng.normal(size=quality.BUCKETS), "v": rng.normal(size=(quality.BUCKETS, 3)), "ws": rng.normal(size=quality.STATS), "vs": rng.normal(size=(quality.STATS, 3))}
    values = np.concatenate([x * 2.0, np.clip(stats[0], -6, 6)])
    vectors = np.concatenate([model["v"][bucket], model["vs"]])
    want = 0.3 + values @ np.concatenate([model["w"][bucket], model["ws"]]) + sum(values[i] * values[j] * (vectors[i] @ vectors[j]) for i in range(len(values)) for j in range(i))
    assert quality.margins(model, r, bucket, x, stats)[0] == pytest.approx(want, rel=1e-5)


@pytest.mark.parametrize("n", [0, 3, 4095, 4096, 15000, 65536])
def test_counters_come_back_as_they_were_packed(n):
    rng = np.random.default_rng(n)
    counts = np.zeros(jaccard._CHUNK, np.int32)
    at = rng.choice(jaccard._CHUNK, n, replace=False)
    counts[at] = rng.integers(1, 4, n)
    counts[at[:5]] = [254, 255, 256, 70000, 2**31 - 1][: min(5, n)]
    back = np.zeros_like(counts)
    where, c = jaccard._unpacked(jaccard._packed(counts))
    back[where] = c
    assert (back == counts).all()
