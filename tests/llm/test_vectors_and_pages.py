"""Operators over embeddings and web pages against brute force, and their defined cases."""

import json
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from marlspar.llm import html, vectors, warc


def embedded(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", 1) for i, v in rows], "vec_id long, embedding array<float>, label string, rep string, links int").repartition(3)


@pytest.fixture(scope="module")
def vecs():
    rng = np.random.default_rng(4)
    rows = []
    for c in range(20):
        center = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            rows.append((center + rng.normal(scale=0.12, size=16)).tolist())
    rows += [rows[5]] * 30 + [(np.array(rows[6]) * 3).tolist()]
    rows = [(i * 5 % 997, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [float("inf")] + [1.0] * 15), (2005, [None] + [1.0] * 15), (2006, [1.0, 2.0]), (2008, [2.0, 4.0])]
    return rows, odd


def brute_links(rows, threshold):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows])
    g = x @ x.T / np.outer(n := np.linalg.norm(x, axis=1), n) >= threshold
    np.fill_diagonal(g, False)
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(g), strict=True):
            if label[a] > label[b]:
                label[a], changed = label[b], True
    return {i: (int(k), c) for i, k, c in zip(ids, g.sum(1), label, strict=True)}


@pytest.mark.parametrize("block", [8192, 16])
def test_near_duplicates(spark, vecs, block):
    rows, odd = vecs
    got = vectors.near_duplicates(embedded(spark, rows + odd), block=block).collect()
    want = brute_links(rows, 0.95) | {i: (0, i) for i, _ in odd} | {2006: (1, 2006), 2008: (1, 2006)}
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got) and len(got) == len(rows + odd)


def dealt_copies(n, block):
    """Copies that ``n`` vectors in tight, far clusters of 50 are dealt as, for each vector."""
    rng = np.random.default_rng(n)
    centers = rng.normal(size=(n // 50, 16))
    x = np.repeat(centers, 50, axis=0) + rng.normal(scale=0.01, size=(n, 16))
    y = (x / np.linalg.norm(x, axis=1, keepdims=True))[:, : vectors.DIMS]
    tree = vectors.grow(y, -(-n // block))
    leaf = vectors._leaves(y, *tree)
    count = -(-np.bincount(leaf, minlength=len(tree[0]) + 1) // block)
    low, high = (np.array([f(y[leaf == i], 0) if (leaf == i).any() else np.zeros(y.shape[1]) for i in range(len(count))]) for f in (np.min, np.max))
    shared = SimpleNamespace(value=(None, np.cumsum(count) - count, count, low, high))
    arrays = [pa.array(range(n)), pa.array([b""] * n), pa.array([1] * n), pa.array(leaf), pa.array(list(y))]
    batch = pa.RecordBatch.from_arrays(arrays, ["vec_id", "x", "copies", "leaf", "lead"])
    return sum(b.num_rows for b in vectors._deal(shared, 0.95)([batch])) / n


def test_near_duplicates_reach_a_smaller_share_of_blocks_the_more_there_are():
    assert dealt_copies(32000, 500) / 64 < dealt_copies(4000, 500) / 8 < 1


def test_near_duplicates_of_repeated_rows_and_nothing(spark, vecs):
    rows, _ = vecs
    twice = vectors.near_duplicates(embedded(spark, rows[:3] * 2 + [(None, rows[0][1])])).collect()
    assert len(twice) == 7 and {r.n_links for r in twice if r.vec_id == rows[0][0]} == {brute_links(rows[:3], 0.95)[rows[0][0]][0]}
    assert vectors.near_duplicates(embedded(spark, rows).where("false")).count() == 0
    assert vectors.near_duplicates(embedded(spark, [(1, None)])).collect()[0].component_id == 1


def brute_near(rows, every, top):
    out = {}
    for q, v in rows:
        if q % every == 0:
            s = sorted((-float(np.dot(np.array(v), np.array(u))), i) for i, u in rows if i != q)
            out[q] = [(i, -d) for d, i in s[:top]]
    return out


def test_neighbours_reach_their_recall(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(x)) for x in v / np.linalg.norm(v)]) for i, v in enumerate(rng.normal(size=(1500, 64)))]
    got = vectors.neighbours(embedded(spark, rows)).collect()
    want, hit = brute_near(rows, 20, 20), 0
    for q in want:
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(a[2] >= b[2] for a, b in zip(mine, mine[1:], strict=False))
        hit += len({m[1] for m in mine} & {i for i, _ in want[q]})
    assert hit / (20 * len(want)) >= 0.9


def test_neighbours_with_few_rows_are_exact(spark, vecs):
    rows, odd = vecs
    some = rows[:12] + odd
    got = vectors.neighbours(embedded(spark, some + some), every=5).collect()
    want = brute_near(rows[:12], 5, 20)
    assert {(r.query_id, r.vec_id): pytest.approx(r.score) for r in got if r.query_id < 2000} == {(q, i): d for q, xs in want.items() for i, d in xs}
    assert vectors.neighbours(embedded(spark, some).where("false")).count() == 0


def test_neighbours_order_ties_by_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 60)]
    got = vectors.neighbours(embedded(spark, rows)).where("query_id = 20").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20))


# ---- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div><header>Site</header>
<{main}><h1>Head  line</h1><p><b>One &amp; two<br>three<br><p>caf&eacute; &#8212; x</p><aside>side</aside><form>f<input></form>
<div id="comments"><article class="comment">no</article></div><ul><li>i</li><li>j</li></ul></{main}>
<div class="sidebar">s</div><div class="cookie-notice">c</div><footer>&copy; f</footer></body></html>"""
TEXT = "Head line\n\nOne & two three\n\ncafé — x\n\ni\n\nj"


@pytest.mark.parametrize("main", ["article", "main"])
def test_structure(main):
    assert html.blocks(PAGE.format(main=main)) == (TEXT.split("\n\n"), [], True)
    assert html.blocks(PAGE.format(main=main)[:-30])[0] == TEXT.split("\n\n")


def test_names_of_elements():
    keep = '<body class="has-sidebar menu-open"><div class="with-nav"><article class="post comments-open"><p>a</p><div class="related-posts">no</div></article></div></body>'
    assert html.blocks(keep) == (["a"], [], True)
    assert html.blocks('<div role="navigation">x</div><p hidden>y</p><div style="display: none">z</div><div id="siteFooter">f</div>k < 3') == ([], ["k < 3"], False)
    assert html.blocks("<nav>menu<main>text</main>")[0] == ["text"]


@pytest.mark.parametrize("tag", ["<p title=it's>", '<img alt="5" tall">', "<p title=\"it's>", '<p title="hidden>', "<p 'x>", "</>", "</ p>", '<p class="a>b" id=\'c>d\'>'])
def test_odd_quotes_lose_no_text(tag):
    main, _, _ = html.blocks(f"<article><p>one</p>{tag}two</p><p>three's</article>")
    assert main == ["one", "two", "three's"]
    assert html.blocks(f"<article><p>one</p>{tag}two <b>'x'</b> it's</p></article>")[0] == ["one", "two 'x' it's"]


def test_a_less_than_before_other_letters_is_text():
    assert html.blocks("<article>a <é b</article>")[0] == ["a <é b"]
    assert html.blocks("<article>a <b never ends")[0] == ["a"]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, text string, host string").repartition(3)


def test_extraction(spark):
    rng = random.Random(2)
    menu = " ".join(f"<div>entry {k} of the long menu</div>" for k in range(6))
    body = lambda i: " ".join(f"b{rng.randrange(10**6)}" for _ in range(30))
    own = {i: body(i) for i in range(12)}
    rows = [(i, f"http://h{i % 2}.org/{i}", f"<body>{menu}<div>{own[i]}</div></body>") for i in range(12)]
    rows += [(50, None, None), (51, "http://h0.org/e", ""), (52, "http://h0.org/s", PAGE.format(main="article")), (53, "http://h0.org/s2", PAGE.format(main="article"))]
    rows += [(0, rows[0][1], rows[0][2]), (60, "http://alone.org/", f"<p>{menu}</p>"), (60, "http://alone.org/", f"<p>{menu}</p>"), (70, "u", "<p>" + "very long " * 300_000 + "</p>"), (None, None, "<p>x")]
    got = html.extract(pages(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert all(by[i] == own[i] for i in range(12))  # the menu repeats on the host; what is left is unique
    assert (by[50], by[51], by[52], by[53], by[None]) == ("", "", TEXT, TEXT, "x")
    assert by[60].startswith("entry 0")  # equal pages don't make each other boilerplate
    assert html.extract(pages(spark, rows).where("false")).count() == 0


def test_copies_of_an_article_do_not_erase_one_another(spark):
    rng = random.Random(8)
    body = lambda n: " ".join(f"b{rng.randrange(10**6)}" for _ in range(n))
    a, b, c, d, e = body(60), body(60), body(60), body(60), body(200)
    m1, m2 = (f"<div>one menu {x} of a section</div><div>its other entries are {x} too</div>" for x in ("first", "second"))
    rows = [(1, "http://n.org/1", f"<p nonce=1>{a}</p>"), (2, "http://n.org/2", f"<p nonce=2>{a}</p>")]  # html differs, text doesn't
    rows += [(3, "http://d.org/3", f"<p>{a}</p><p>on 3 May</p>"), (4, "http://d.org/4", f"<p>{a}</p><p>on 4 June</p>")]
    rows += [(k, f"http://m.org/{k}", m + f"<p>{t}</p>") for k, (m, t) in enumerate([(m1, b), (m2, b), (m1, c), (m1, d), (m2, a)], 5)]  # one article, two menus
    rows += [(10, "http://l.org/10", f"<p>{e}</p><p>seen by one reader out of all ten today</p>"), (11, "http://l.org/11", f"<p>{e}</p><p>nobody else has written a word about this</p>")]
    got = {r.page_id: r.text for r in html.extract(pages(spark, rows)).collect()}
    assert got[1] == got[2] == a
    assert got[3] == a + "\n\non 3 May" and got[4] == a + "\n\non 4 June"
    assert [got[k] for k in range(5, 10)] == [b, b, c, d, a]
    assert got[10].startswith(e) and got[11].startswith(e)


def test_pages_that_mark_their_text_tell_what_is_furniture(spark):
    rng = random.Random(9)
    body = lambda n: " ".join(f"b{rng.randrange(10**6)}" for _ in range(n))
    menu, note, shared = (body(9) for _ in range(3))
    own = {i: body(40) for i in range(8)}
    full = lambda text: f"<nav><p>{menu}</p></nav><article><p>{text}</p><p>{shared}</p></article><span class=ad>{note}</span>"
    rows = [(i, f"http://a.org/{i}", full(own[i])) for i in range(3)]
    rows += [(3, "http://a.org/3", f"<p>{menu}</p><p>{own[3]}</p><p>{shared}</p><p>{note}</p>")]  # the only page of its kind
    rows += [(4, "http://a.org/4", f"<p>{own[0]}</p>")]  # a copy of an article whose page marks it
    rows += [(5, "http://b.org/5", f"<p>{menu}</p><p>{own[5]}</p>")]  # another host
    rows += [(6, "http://c.org/6", f"<nav><p>{menu}</p></nav><p>{own[6]}</p>"), (7, "http://c.org/7", f"<p>{menu}</p><p>{own[7]}</p><footer>{own[7]}</footer>")]
    got = {r.page_id: r.text for r in html.extract(pages(spark, rows)).collect()}
    assert [got[i] for i in range(3)] == [f"{own[i]}\n\n{shared}" for i in range(3)]
    assert got[3] == f"{own[3]}\n\n{shared}"
    assert got[4] == own[0] and got[5] == f"{menu}\n\n{own[5]}"
    assert got[6] == own[6] and got[7] == own[7]  # what goes of a page says nothing about itself


def test_blocks_of_elements_that_go():
    gone = []
    assert html.blocks(PAGE.format(main="article"), gone) == html.blocks(PAGE.format(main="article"))
    assert gone == ["Menu", "Buy", "Site", "side", "f", "no", "s", "c", "© f"]


def test_derivatives(spark):
    rows = [(1, "http://a.org/x", PAGE.format(main="article")), (1, "http://a.org/x", PAGE.format(main="article")), (2, None, None), (3, "http://b.org", "<p>hé")]
    made = warc.responses(pages(spark, rows))
    got = {}
    for r in warc.derive(made).collect():
        got.setdefault(r.refers_to, {})[r.warc_type] = r
    for r in made.collect():
        m, c = got[r.record_id]["metadata"], got[r.record_id]["conversion"]
        info = json.loads(bytes(m.block))
        assert m.target_uri == c.target_uri == r.target_uri and m.warc_date == r.warc_date
        assert info["payload"]["digest"] == r.payload_digest and info["source"]["WARC-Record-ID"] == r.record_id and info["http"]["status"] == 200
        assert warc.digest(bytes(c.block)) == c.block_digest
        for x in (r, m, c):  # a round trip through a file's bytes
            data = warc.serialise(x.headers, bytes(x.block)) * 2
            back = list(warc.parse(data))
            assert len(back) == 2 and back[0][1] == bytes(x.block) and back[0][0].get("WARC-Refers-To") == x.refers_to
    page = next(r for r in made.collect() if r.page_id == 1)
    assert json.loads(bytes(got[page.record_id]["metadata"].block))["html"] == {"title": "T", "links": ["/a"]}
    assert bytes(got[page.record_id]["conversion"].block).decode().split("\n") == TEXT.split("\n\n")
    assert warc.derive(made.where("false")).count() == 0


def test_read(spark, tmp_path):
    r = warc.record("response", "<urn:uuid:1>", "http://a", warc.DATE, "application/http", b"HTTP/1.1 404 Not Found\r\nA: b\r\n\r\nbody")
    bare = warc.record("response", "<urn:uuid:2>", "http://b", warc.DATE, "text/html", b"<p>bare")
    (tmp_path / "x.warc").write_bytes(b"".join(warc.serialise(x[9], x[10]) for x in (r, bare)))
    got = warc.read(spark, str(tmp_path)).collect()
    assert [(x.record_id, bytes(x.block)) for x in got] == [(r[0], r[10]), (bare[0], bare[10])]
    infos = {x.refers_to: json.loads(bytes(x.block)) for x in warc.derive(warc.read(spark, str(tmp_path))).where("warc_type = 'metadata'").collect()}
    assert infos["<urn:uuid:1>"]["http"] == {"status": 404, "headers": {"A": "b"}} and infos["<urn:uuid:2>"]["http"]["status"] is None


def test_repeated_and_tight_headers_are_kept(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nLink:<x>\r\nSet-Cookie:b=2\r\nX-Long: one\r\n two\r\nEmpty:\r\n\r\n<p>body"
    head = f"WARC/1.0\r\nWARC-Type:response\r\nWARC-Record-ID:<urn:uuid:3>\r\nWARC-Date: {warc.DATE}\r\nWARC-Concurrent-To: <urn:uuid:4>\r\nWARC-Concurrent-To: <urn:uuid:5>\r\nContent-Length:{len(http)}\r\n\r\n"
    (tmp_path / "y.warc").write_bytes(warc.serialise(head, http))
    made = warc.derive(warc.read(spark, str(tmp_path))).where("warc_type = 'metadata'").collect()
    info = json.loads(bytes(made[0].block))
    assert info["http"]["headers"] == {"Set-Cookie": ["a=1", "b=2"], "Link": "<x>", "X-Long": "one two", "Empty": ""}
    assert info["source"]["WARC-Concurrent-To"] == ["<urn:uuid:4>", "<urn:uuid:5>"] and info["source"]["WARC-Record-ID"] == "<urn:uuid:3>"
