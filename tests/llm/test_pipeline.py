"""The pipeline's stages, each on its own input, against brute force."""

import corpus_pipeline as P

import __spark_entry__ as entry
from marlspar.llm import packing

from .test_text import split


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([(9001, None, None, None, None), (9002, "12 34", "en", None, 5)], "doc_id long, text string, lang string, source string, n_chars long"))
    tables = []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        tables.append((before.collect(), docs.collect()))
        assert k == 4 or docs.columns == P.COLUMNS
    (a, b), (c, d), (e, f), (g, h), (i, j) = tables
    assert {r.doc_id for r in a} - {r.doc_id for r in b} == {9001, 9002}
    kept = {r.doc_id for r in d}
    sets = {r.doc_id: five(r.text) for r in c}
    for x in sets:  # what went has a link to something smaller; what stayed has none
        smaller = any(y < x and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]) for y in sets)
        assert not (x in kept and smaller)
        assert x in kept or any(y != x and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]) for y in sets)
    first = {}
    for r in sorted(e, key=lambda r: r.doc_id):
        w = split(r.text)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), r.doc_id)
    want = {}
    for r in e:
        w, gone = split(r.text), set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < r.doc_id:
                gone.update(range(k, k + 50))
        if len(gone) < len(w):
            want[r.doc_id] = [x for k, x in enumerate(w) if k not in gone]
    assert {r.doc_id: split(r.text) for r in f} == want
    total = sum(len(split(r.text)) for r in g)
    assert total - 40 <= sum(len(split(r.text)) for r in h) <= total
    coder = packing.Encoder(packing.tokenizer_path())
    assert sum(r.length for r in j) == sum(len(coder.whole(r.text)) // 4 + 1 for r in h)
    assert len({(r.sequence_id, r.offset) for r in j}) == len(j)


def test_run_is_registered(spark):
    assert entry.queries()["pipeline"] is P.run
    assert P.run(spark, "/root/testdata/sf0.001").count() > 0
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages_of_nothing_and_of_odd_tables(spark):
    """Empty tables, repeated rows, a very long text, nulls in every column and extra columns with names that stages use."""
    long = " ".join(f"word{i % 997}x{i}" for i in range(40_000))
    good = "these are plain words of a language that has letters and goes on for a while"
    rows = [(1, long, "en", "s", 5), (2, good, None, None, None), (2, good, None, None, None), (3, None, None, None, None), (None, good + " more", "en", "s", 1), (4, good + " again", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS taken", "'k' AS row_key", "2 AS n_words", "'c' AS covered", "3 AS score").repartition(3)
    for start in (docs, docs.where("false")):
        at = start
        for k, (name, stage) in enumerate(P.STAGES):
            out = stage(spark, at, "/root/testdata/sf0.001")
            assert k == 4 or out.columns == P.COLUMNS, name
            at = spark.createDataFrame(out.collect(), out.schema)
            at = at.selectExpr("*", "1 AS taken", "'k' AS row_key", "2 AS n_words", "'c' AS covered", "3 AS score") if k < 4 else at
        assert at.isEmpty() == start.isEmpty()


def five(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in split(text)]
    return frozenset([tuple(w)] if 0 < len(w) < 5 else zip(*(w[k:] for k in range(5)), strict=False))


def test_near_copies_share_five_words_at_four_fifths(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    sets, least = {r.doc_id: five(r.text) for r in rows}, {r.doc_id: r.doc_id for r in rows}
    links = [(x, y) for x in sets for y in sets if y < x and sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    while any(least[x] != least[y] for x, y in links):
        for x, y in links:
            least[x] = least[y] = min(least[x], least[y])
    assert {r.doc_id for r in P.near_copies(spark, docs, sf).collect()} == {x for x in sets if least[x] == x}


def test_near_copies_of_rows_without_an_id_of_their_own(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    rows = [(None, text["a"]), (None, text["a"]), (None, text["b"] + " x"), (5, text["b"]), (7, text["c"]), (7, text["d"]), (8, text["c"] + " y"), (9, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = P.near_copies(spark, docs, "")
    assert got.columns == P.COLUMNS
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == sorted([(None, text["a"]), (5, text["b"]), (7, text["c"]), (7, text["d"]), (9, None), (None, "")], key=str)
