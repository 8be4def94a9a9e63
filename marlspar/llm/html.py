"""Main text of web pages: structure first, then a suffix array over what structure leaves open.

A page is read once into blocks of text.  Menus, headers, footers, sidebars, notices, adverts, forms,
comments, scripts and styles go by element, role, class or id.  Where the page says which element is
its main text (``article``, ``main``), the blocks in it are the text, whole, for a sentence that several articles
share is text all the same.  Elsewhere the open blocks form the page's token stream.  The streams
of a host's distinct pages are sorted as a suffix array cut at ``RUN`` tokens: a suffix is keyed by
host and the fingerprint of its first ``RUN`` tokens, and equal neighbours from different pages are
a repeat.  All pages of a host have streams there, those that mark their text too, and structure tells what a
repeat is: what another page has in an element that goes is a repeat, and what a page has in its marked text is none.  Pages whose open blocks are nearly equal count as one page there, and so do pages that repeats
leave nothing of, so that copies of an article don't erase one another.  Overlapping repeats are one long
substring; blocks that repeats cover wholly are boilerplate, and the unique runs of blocks are kept.

The sort is an aggregate with map-side combining on (host, fingerprint), so a host or a menu of any
size is spread over tasks and never meets in one.

Defined cases: null html has an empty text; a null url is a host of its own; pages without any text give an empty string; rows of
equal open blocks are equal and don't make each other boilerplate; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from . import kernels as K
from .scratch import cut, member_of

#: Tokens that a repeat has at least.
RUN = 6
#: Similarity in percent from which pages are copies of one another.
NEAR = 80

#: A tag: its slash, name and attributes; only a quote after = begins a quoted value.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*'|(?=[^\"'])[^\s>]*))*+)>")
#: A tag with a quote that nothing closes: it ends at the next >.
_ODD_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
#: Elements whose content is not read.
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template svg math iframe object textarea select title canvas audio video".split()}
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*(?:=\s*(\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|[^\s\"'>][^\s>]*))?")
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("nav footer aside form menu dialog button label fieldset head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comments comment commentlist disqus respond replies pagination pager toolbar widget widgets copyright legal skip skiplink".split()
)
#: First parts of class names that tell what an element has, not what it is.
_ABOUT = frozenset("has no with without is not show hide".split())
_MAIN = frozenset(["article", "main"])
_WORDS = re.compile(r"[\s_]+|-+|(?<=[a-z])(?=[A-Z])")


def _drops(tag: str, raw: str, inside: bool) -> bool:
    """Whether an element and all in it are left out."""
    if tag in _DROP or (tag == "header" and not inside):
        return True
    if "=" not in raw and "hidden" not in raw:
        return False
    names: set[str] = set()
    for name, value in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if name in ("class", "id"):
            for word in value.split():
                parts = [w.lower() for w in _WORDS.split(word) if w]
                if parts and parts[0] not in _ABOUT:  # has-sidebar is no sidebar
                    names.update([word.lower()] if tag == "article" else parts)
    if tag in ("html", "body", "main"):
        return False
    return not names.isdisjoint(_NAMES) or (not inside and tag in ("div", "section") and "header" in names)


def blocks(page: str, gone: list[str] | None = None) -> tuple[list[str], list[str], bool]:
    """(main blocks, open blocks, whether the page marks its main text).  ``gone`` takes the blocks of elements that go."""
    main: list[str] = []
    open_: list[str] = []
    text: list[str] = []
    lost: list[str] = []
    stack: list[str] = []  # open elements that decide something
    drop = inside = 0
    marked = False
    close_at: list[tuple[int, str]] = []  # (depth of the stack, kind) of what ends when the stack gets shorter

    def flush() -> None:
        if text:
            if not drop:
                block = "".join(text)
                block = " ".join((entities.unescape(block) if "&" in block else block).split())
                if block:
                    (main if inside else open_).append(block)
            text.clear()
        if lost:
            block = " ".join(entities.unescape("".join(lost)).split())
            if block:
                gone.append(block)
            lost.clear()

    def shorten(depth: int) -> None:
        nonlocal drop, inside
        del stack[depth:]
        while close_at and close_at[-1][0] >= depth:
            if close_at.pop()[1] == "drop":
                drop -= 1
            else:
                inside -= 1

    last, size = 0, len(page)
    while last < size:
        at = page.find("<", last)
        if at < 0:
            break
        if at > last:
            if not drop:
                text.append(page[last:at])
            elif gone is not None:
                lost.append(page[last:at])
        m = _TAG.match(page, at) or _ODD_TAG.match(page, at)
        if m is None:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                last = size if end < 0 else end + 3
            elif page.startswith(("<!", "<?", "</"), at):
                end = page.find(">", at)
                last = size if end < 0 else end + 1
            elif page[at + 1 : at + 2].isalpha() and page[at + 1].isascii():  # a tag that never ends
                last = size
            else:  # a character like any other
                if not drop:
                    text.append("<")
                last = at + 1
            continue
        last = m.end()
        tag = m.group(2).lower()
        if tag in _RAW and not m.group(1):
            if not m.group(3).endswith("/"):
                end = _RAW[tag].search(page, last)
                last = size if end is None else end.end()
            if not drop:
                text.append(" ")
            continue
        if tag == "br":
            text.append(" ")
            if lost:
                lost.append(" ")
            continue
        if tag == "hr":
            flush()
            continue
        if tag in _VOID:
            continue
        if m.group(1):
            if tag in _BLOCKS:
                flush()
            if tag in stack:
                shorten(len(stack) - 1 - stack[::-1].index(tag))
            continue
        if tag in _BLOCKS:
            flush()
        raw = m.group(3)
        if tag in _MAIN and drop and not inside:  # an unclosed menu or header doesn't swallow the text
            if not any(k == "drop" and stack[d] not in ("nav", "header", "menu", "form") for d, k in close_at) and not _drops(tag, raw, False):
                shorten(min(d for d, k in close_at if k == "drop"))
        if raw.endswith("/"):
            continue
        depth = len(stack)
        if _drops(tag, raw, bool(inside)):
            stack.append(tag)
            close_at.append((depth, "drop"))
            drop += 1
        elif tag in _MAIN and not drop:
            stack.append(tag)
            close_at.append((depth, "main"))
            inside += 1
            marked = True
        elif tag in ("div", "section", "ul", "ol", "table", "p", "span", "td", "li", "header", "body", "details") and (stack or tag == "body"):
            if tag in ("p", "li", "td") and stack and stack[-1] == tag:
                stack.pop()  # these end where the next of their kind begins
            stack.append(tag)
    if last < size and not drop:
        text.append(page[last:])
    flush()
    return main, open_, marked


def _host(url: str | None) -> str:
    return re.sub(r"^[a-zA-Z][\w+.-]*://", "", url or "").split("/", 1)[0].split("?", 1)[0].split("#", 1)[0].lower()


def _starts(tokens: list[list[str]], run: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of each suffix's first ``run`` tokens, and the block of each token."""
    flat = "\n".join(t for b in tokens for t in b).encode()
    data = np.frombuffer(flat, np.uint8)
    ws, we, _ = K.word_bounds(data, np.array([0, len(data)]))
    h = K.word_hashes(data, ws, we)
    return K.ngrams(h, run, 1), np.repeat(np.arange(len(tokens)), [len(b) for b in tokens])


def _suffixes(texts: list[str], run: int) -> np.ndarray:
    """Fingerprints of the suffixes of a stream, each once."""
    return np.unique(_starts([x.split() for x in texts], run)[0]).view(np.int64)


def _read(run: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts, waits, suffixes, dropped = [], [], [], []
                for page in part.column(2).to_pylist():
                    gone: list[str] = []
                    main, open_, marked = blocks(page or "")
                    if not marked:
                        blocks(page or "", gone)
                    texts.append("\n\n".join(main) if marked else None)
                    waits.append(None if marked else open_)
                    suffixes.append(None if marked else _suffixes(open_, run).tolist())
                    dropped.append(None if marked else _suffixes(gone, run).tolist())
                hosts = [_host(u) for u in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(hosts, pa.string()), pa.array(texts, pa.string()), pa.array(waits, pa.list_(pa.string())), pa.array(suffixes, pa.list_(pa.int64())), pa.array(dropped, pa.list_(pa.int64()))],
                    ["page_id", "url", "host", "text", "open", "suffixes", "gone"],
                )

    return go


def _streams(run: int):
    """The streams of pages that mark their main text: (host, suffix, whether it is main text)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                hosts, found, texts = [], [np.zeros(0, np.int64)], []
                for url, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    gone: list[str] = []
                    main, _, marked = blocks(page or "", gone)
                    for stream, is_text in ((main, True), (gone, False)) if marked else ():
                        found.append(_suffixes(stream, run))
                        hosts += [_host(url)] * len(found[-1])
                        texts += [is_text] * len(found[-1])
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(np.concatenate(found)), pa.array(texts, pa.bool_())], ["host", "suffix", "is_text"])

    return go


def _left(open_: list[str], shared: list[int] | None, run: int) -> np.ndarray:
    """Tokens of each block that repeats don't cover."""
    s, block = _starts([x.split() for x in open_], run)
    covered = np.zeros(len(block), bool)
    for i in np.flatnonzero(np.isin(s.view(np.int64), np.array(shared or [], np.int64))):
        covered[i : i + run] = True
    return np.bincount(block[~covered], minlength=len(open_))


def _unique(run: int):
    """Keeps the blocks that repeats don't cover wholly."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for open_, shared in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                left = _left(open_, shared, run) > 0
                texts.append("\n\n".join(x for x, k in zip(open_, left.tolist(), strict=True) if k))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return go


def _bare(run: int):
    """Whether the blocks that repeats don't cover wholly have fewer than ``run`` tokens."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bare = []
            for open_, shared in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                left = _left(open_, shared, run) > 0
                bare.append(sum(len(x.split()) for x, k in zip(open_, left.tolist(), strict=True) if k) < run)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bare, pa.bool_())], ["host", "page_key", "bare"])

    return go


def _boilerplate(waiting: DataFrame, marked: DataFrame, run: int) -> DataFrame:
    """(host, page_key, shared): the repeats of each page that lie on pages which differ in what remains of them, or in what goes of another.

    Near-equal pages count as one, and so do pages that repeats leave nothing of: copies of an article.  What ``marked``
    pages (url, html) have as main text is no repeat."""
    pages = waiting.where("size(suffixes) > 0").dropDuplicates(["host", "page_key"]).select("host", "page_key", "open", "suffixes")
    alike = jaccard.join(pages.select(F.col("page_key").alias("doc_id"), F.concat_ws(" ", "open").alias("text")), run, NEAR)
    alike = cut(alike.groupBy(F.col("doc_id").alias("page_key")).agg(F.min("component_id").alias("kind")), "op1")
    streams = cut(pages.join(alike, "page_key").select("host", "page_key", "kind", F.explode("suffixes").alias("suffix")), "op1")
    gone = waiting.join(alike, "page_key", "left").select("host", F.coalesce("kind", "page_key").alias("kind"), F.explode("gone").alias("suffix"))
    gone = gone.groupBy("host", "suffix").agg(F.min("kind").alias("from"), F.max("kind").alias("to"))
    # of the other pages' streams only what these pages may have is shuffled
    asked = streams.select(F.xxhash64("host", "suffix").alias("key"))
    others = marked.mapInArrow(_streams(run), "host string, suffix long, is_text boolean").withColumn("key", F.xxhash64("host", "suffix"))
    others = member_of(asked, "key")(others, "some").where("some").groupBy("host", "suffix").agg(F.bool_or("is_text").alias("is_text"))
    kinds = streams.groupBy("host", "suffix").agg(F.min("kind").alias("lo"), F.max("kind").alias("hi"))
    kinds = kinds.join(gone, ["host", "suffix"], "left").join(others, ["host", "suffix"], "left").where("is_text IS NULL OR NOT is_text")
    repeats = cut(kinds.where("lo < hi OR is_text IS NOT NULL OR from IS NOT NULL").withColumn("elsewhere", F.expr("is_text IS NOT NULL")), "op1")
    found = streams.join(repeats, ["host", "suffix"]).withColumn("elsewhere", F.expr("elsewhere OR coalesce(from <> kind OR to <> kind, FALSE)"))
    found = cut(found.where("lo < hi OR elsewhere").select("host", "page_key", "kind", "suffix", "elsewhere"), "op1")
    covers = found.groupBy("host", "page_key").agg(F.collect_set("suffix").alias("shared"))
    bare = pages.select("host", "page_key", "open").join(covers, ["host", "page_key"]).mapInArrow(_bare(run), "host string, page_key long, bare boolean").where("bare")
    found = found.join(bare, ["host", "page_key"], "left").withColumn("kind", F.expr("IF(bare, NULL, kind)"))
    kinds = found.groupBy("host", "suffix").agg(F.min("kind").alias("lo"), F.max("kind").alias("hi"), F.count_if(F.col("kind").isNull()).alias("bare"), F.bool_or("elsewhere").alias("some"))
    kinds = kinds.where("some OR lo < hi OR (lo IS NOT NULL AND bare > 0)").select("host", "suffix", F.expr("lo < hi OR (lo IS NOT NULL AND bare > 0)").alias("shared"))
    found = found.select("host", "page_key", "suffix", "elsewhere").join(kinds, ["host", "suffix"]).where("elsewhere OR shared")
    return found.groupBy("host", "page_key").agg(F.collect_set("suffix").alias("shared"))


def extract(pages: DataFrame, run: int = RUN) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html)."""
    read = cut(pages.select("page_id", "url", "html").mapInArrow(_read(run), "page_id long, url string, host string, text string, open array<string>, suffixes array<long>, gone array<long>"), "op1")
    done = read.where("open IS NULL").select("page_id", "url", "text")
    waiting = read.where("open IS NOT NULL").withColumn("page_key", F.xxhash64("open"))
    if not waiting.isEmpty():
        rest = waiting.select("page_id", "url", "host", "page_key", "open").join(_boilerplate(waiting, pages.select("url", "html"), run), ["host", "page_key"], "left")
        done = done.unionByName(rest.select("page_id", "url", "open", "shared").mapInArrow(_unique(run), "page_id long, url string, text string"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
