"""Packing token sequences: bounded-space online best fit with cutting.

Each task keeps a fixed number of open windows of 1024 ids.  Whole windows' worth of a document go
out at once.  What is left goes to the open window that it fits best; when it fits none, the fullest
is filled to its end with the head of the piece (pieces may be cut freely) and emitted.  At its end a
task empties its least full windows into its fullest, so that one window at most is not full; these
leftovers, one a task, are merged the same way in rounds of up to ``MERGE`` until one is left.

Defined cases: a null or empty text is the single id 0; repeated rows are packed separately; an
empty table packs to nothing; other columns are ignored.  A string that the vocabulary adds as a token
of its own is that token, as the tokenizer reads it.
"""

from __future__ import annotations

import base64
import os
import sys
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import cut

LENGTH = 1024
OPEN = 16
#: Leftover windows that one merging task takes at most, each of up to 1024 ids.
MERGE = 256
TOKENIZER = "byte_bpe_50k.json"
#: Words whose ids a Python worker remembers.
REMEMBER = 60_000
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

assert sys.byteorder == "little", "ids are little-endian"

_tokenizers: dict = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Words(dict):
    """Ids of words, remembered in two generations: a word in use survives when the older goes."""

    def __init__(self, ids_of, ids_of_letters):
        super().__init__()
        self.ids_of, self.ids_of_letters, self.older = ids_of, ids_of_letters, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if word.isalpha():
                ids = self.ids_of_letters(" " + word)
            elif word[-1] in ".," and word[:-1].isalpha():  # letters and one mark are two pre-tokens
                ids = self[word[:-1]] + self["\0" + word[-1]]
            else:  # the first word of a text comes marked by NUL; others follow a space or their own line feed
                ids = self.ids_of(word[1:] if word[:1] == "\0" else word if word[:1] == "\n" else " " + word)
        if len(self) >= REMEMBER:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian uint32 bytes.

    The byte-level pre-tokenizer never joins what lies before a single space with what follows it, nor
    what lies on either side of a single line feed between two characters that aren't white space, so
    a text's ids are those of its words, which repeat and are remembered.  A word's ids come from
    the same vocabulary as ranks, which merges the same pairs in the same order, several times faster."""

    #: White space other than single spaces and line feeds between words: such texts are encoded whole.
    ODD_ASCII = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\0")
    ODD_OTHER = tuple(chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())
        ids_of = letters = self.whole
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            ids_of = lambda text: array("I", fast.encode_ordinary(text)).tobytes()
            letters = lambda text: array("I", fast._encode_single_piece(text)).tobytes()
        self.words = Words(ids_of, letters)

    def odd(self, text: str) -> bool:
        if text[0] in " \n" or text[-1] in " \n" or any(map(text.__contains__, self.added)):
            return True
        return any(map(text.__contains__, self.ODD_ASCII)) or not text.isascii() and any(map(text.__contains__, self.ODD_OTHER))

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        of, odd, out = self.words.__getitem__, self.odd, []
        for t in texts:
            if not t:
                out.append(b"")
            elif odd(t):
                out.append(self.whole(t))
            else:
                out.append(b"".join(map(of, ("\0" + t).replace("\n", " \n").split(" "))))
        return out


def encoder(path: str) -> Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


class Packer:
    """Open windows, each a list of (doc_id, start, ids, doc_tokens)."""

    def __init__(self, number: int, length: int, most: int):
        self.length, self.most, self.next = length, most, number
        self.windows: list[list] = []
        self.free: list[int] = []
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple], keep: bool = False) -> None:
        at, sid = 0, self.next
        self.next += 1
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, sid, at, ids if keep else None))
            at += n

    def _close(self, i: int) -> None:
        self.emit(self.windows.pop(i))
        self.free.pop(i)

    def add(self, doc: int, start: int, ids: bytes, total: int) -> None:
        while ids:
            n = len(ids) // 4
            if n >= self.length:
                self.emit([(doc, start, ids[: 4 * self.length], total)])
                ids, start = ids[4 * self.length :], start + self.length
                continue
            best = min((i for i, f in enumerate(self.free) if f >= n), key=self.free.__getitem__, default=-1)
            if best < 0 and len(self.windows) < self.most:
                self.windows.append([])
                self.free.append(self.length)
                best = len(self.free) - 1
            if best < 0:
                best = min(range(len(self.free)), key=self.free.__getitem__)
            n = min(n, self.free[best])
            self.windows[best].append((doc, start, ids[: 4 * n], total))
            self.free[best] -= n
            if not self.free[best]:
                self._close(best)
            ids, start = ids[4 * n :], start + n

    def finish(self) -> None:
        """Empties the least full windows into the others; what is left in one goes out with its ids."""
        while len(self.windows) > 1:
            least = max(range(len(self.free)), key=self.free.__getitem__)
            pieces = self.windows.pop(least)
            self.free.pop(least)
            most, self.most = self.most, len(self.windows)
            for i, p in enumerate(pieces):
                if not self.windows:  # all others are full and gone
                    self.windows.append([])
                    self.free.append(self.length)
                    self.most = 1
                self.add(*p)
                self.most = max(1, len(self.windows))
            self.most = most
        for w in self.windows:
            self.emit(w, keep=True)
        self.windows, self.free = [], []

    def batch(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in NAMES]
        kinds = [pa.int64()] * 7 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], NAMES)


def _pack(path: str, length: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path)
        packer = Packer(TaskContext.get().partitionId() << 36, length, most)
        for b in batches:
            ids, text = b.column(0).to_pylist(), K.column(b, "text")
            for lo, hi, _, _ in K.slices(text, 1 << 19):
                for doc, x in zip(ids[lo:hi], enc.encode(text.slice(lo, hi - lo).to_pylist()), strict=True):
                    x += b"\0\0\0\0"
                    packer.add(doc, 0, x, len(x) // 4)
                yield packer.batch()
        packer.finish()
        yield packer.batch()

    return K.tidy(run)


def _merge(length: int, most: int, base: int):
    def run(key, table):
        packer = Packer(base + (key[0].as_py() << 20), length, most)
        rows = table.select(["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]).sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        for r in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
            packer.add(*r)
        packer.finish()
        return pa.Table.from_batches([packer.batch()])

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, most: int = OPEN) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or tokenizer_path()
    packed = cut(docs.select("doc_id", "text").mapInArrow(_pack(path, length, most), COLUMNS), "op10")
    done = [packed.where("ids IS NULL")]
    left = packed.where("ids IS NOT NULL")
    count, base = left.select("sequence_id").distinct().count(), 1 << 62
    while count > 1:
        # A task's leftover has the task's number; MERGE of them, at most 1024 ids each, meet in one group.
        by = F.expr(f"shiftright(sequence_id, 36) div {MERGE}") if base == 1 << 62 else F.expr(f"shiftright(sequence_id - {base - (1 << 58)}, 20) div {MERGE}")
        merged = cut(left.withColumn("g", by).groupBy("g").applyInArrow(_merge(length, most, base), COLUMNS), "op10")
        done.append(merged.where("ids IS NULL"))
        left = merged.where("ids IS NOT NULL")
        base += 1 << 58
        fewer = left.select("sequence_id").distinct().count()
        if fewer == count:
            break
        count = fewer
    out = done[0]
    for d in [*done[1:], left]:
        out = out.unionByName(d)
    return out.drop("ids")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
