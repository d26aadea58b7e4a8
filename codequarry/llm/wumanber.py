"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are brought to one form: A-Z lowered, every run of other bytes than
0-9, a-z and those from 0x80 on made one blank, a blank at both ends. A window
of item words is then a pattern with its blanks, and an occurrence of the
pattern is an occurrence of the window.

Patterns of similar length share a searcher. With m the length of its shortest
pattern, a table over hashed blocks of bytes says how far a cursor may move when
the block before it ends no pattern's first m bytes; where it may be such an
end, the hash of the last 8 of the m bytes picks a bucket of patterns, and
comparing hashes of the full length and then the bytes confirms an occurrence.
Many cursors, one for each stretch of the text, move at the same time.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import bounded_batches, scratch, stored

WINDOW = 10
_BLANK, _BETWEEN = 0x20, 0xFF  # 0xFF occurs in no UTF-8 text
_ENDING = b" \x00 "


def _table() -> np.ndarray:
    table = np.full(256, _BLANK, np.uint8)
    for low, high in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
        table[low:high] = np.arange(low, high)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


_FORM = _table()


def normal(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, marks): a slice of texts, each followed by _ENDING, in one form. A byte _BETWEEN stands after each text; marks are their places."""
    form = np.empty(len(data) + 1, np.uint8)
    form[0] = _BLANK
    np.take(_FORM, data, out=form[1:])
    form[bounds[1:] - 1] = _BETWEEN  # one before the ending's last byte; the form begins with a blank more
    keep = np.ones(len(form), bool)
    keep[1:] = (form[1:] != _BLANK) | (form[:-1] != _BLANK)
    text = form[keep]
    return text, np.flatnonzero(text == _BETWEEN)


def windows_of(items: list[tuple[str, str]], width: int = WINDOW) -> dict[bytes, set[str]]:
    """Patterns of the items' windows, each with the ids of the items that hold it."""
    found: dict[bytes, set[str]] = {}
    for item, text in items:
        words = np.frombuffer((text or "").encode(), np.uint8)
        words = _FORM[words].tobytes().split()
        for k in range(max(1, len(words) - width + 1) if words else 0):
            found.setdefault(b" " + b" ".join(words[k : k + width]) + b" ", set()).add(item)
    return found


class Searcher:
    """Wu-Manber tables over patterns of at least ``m`` bytes."""

    BITS = 20

    def __init__(self, patterns: list[bytes]) -> None:
        self.m = min(map(len, patterns))
        # Words share syllables: a block must be long enough to be rare by chance, and short against m, as m - block is the greatest move.
        self.block = next(b for b, least in ((12, 24), (8, 14), (4, 4), (self.m, 0)) if self.m >= least)
        self.patterns = patterns
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(len(patterns), self.m)
        self.shift = np.full(1 << self.BITS, self.m - self.block + 1, np.int32)
        for end in range(self.block, self.m + 1):  # later ends move less
            self.shift[self._slot(lambda back, end=end: _word(heads, end - back))] = self.m - end
        tail = self._tail(heads, np.full(len(patterns), self.m))
        lengths = np.array([len(p) for p in patterns])
        order = np.argsort(tail, kind="stable")
        self.tails, self.rows, self.lengths = tail[order], order, lengths[order]
        flat = np.frombuffer(b"".join(patterns), np.uint8)
        ends = np.cumsum(lengths)
        self.hashes = K.span_hashes(K._BYTE_CODE[flat], ends - lengths, ends)[order]

    def _slot(self, word_at) -> np.ndarray:
        """Table slots of the blocks, given a function that has the 4 bytes from so many bytes before each block's end."""
        x = word_at(self.block)
        if self.block < 4:
            x = x >> np.uint32(8 * (4 - self.block))
        x = x * np.uint32(0x9E3779B1)
        for back in range(self.block - 4, 0, -4):
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77) + word_at(back) * np.uint32(0xC2B2AE3D)
        return (x ^ (x >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - self.BITS)

    def _tail(self, heads: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = np.zeros(len(ends), np.uint64)
        for j in range(min(8, self.m)):
            x = (x << np.uint64(8)) | heads[np.arange(len(ends)), ends - 1 - j].astype(np.uint64)
        return x

    def find(self, text: np.ndarray, blocks: np.ndarray, stretch: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(starts, pattern numbers) of all occurrences; ``blocks`` has the text's 4-byte block that begins at each place."""
        if len(text) < self.m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cursor = np.arange(self.m, len(text) + 1, stretch)
        limit = np.minimum(cursor + stretch, len(text) + 1)
        stops = []
        while len(cursor):
            move = self.shift[self._slot(lambda back, cursor=cursor: blocks[cursor - back])]
            stop = move == 0
            if stop.any():
                stops.append(cursor[stop])
                move = np.where(stop, 1, move)
            cursor = cursor + move
            go = cursor < limit
            if not go.all():
                cursor, limit = cursor[go], limit[go]
        if not stops:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(stops)
        tail = np.zeros(len(at), np.uint64)
        for j in range(min(8, self.m)):
            tail = (tail << np.uint64(8)) | text[at - 1 - j].astype(np.uint64)
        low, high = np.searchsorted(self.tails, tail, "left"), np.searchsorted(self.tails, tail, "right")
        some = high > low
        at, low, high = at[some], low[some], high[some]
        n = high - low
        which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(at - self.m, n)
        end = start + self.lengths[which]
        fits = end <= len(text)
        return self._confirm(text, start[fits], end[fits], which[fits])

    def _confirm(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = text.data
        rows = self.rows[which]
        ok = np.fromiter((raw[a:b] == self.patterns[r] for a, b, r in zip(start.tolist(), end.tolist(), rows.tolist(), strict=True)), bool, len(start))
        return start[ok], rows[ok]


def _word(heads: np.ndarray, at: int) -> np.ndarray:
    """Bytes at .. at + 3 of each row as a big-endian number; beyond a row's end they are 0."""
    x = np.zeros(len(heads), np.uint32)
    for j in range(at, at + 4):
        x = (x << np.uint32(8)) | (heads[:, j] if j < heads.shape[1] else np.uint32(0))
    return x


def _classes(patterns: list[bytes]) -> list[list[int]]:
    """Pattern numbers by length: each class's longest is under twice its shortest, so that few short ones don't slow the others."""
    order = sorted(range(len(patterns)), key=lambda k: len(patterns[k]))
    out: list[list[int]] = []
    for k in order:
        if out and len(patterns[k]) < 2 * len(patterns[out[-1][0]]):
            out[-1].append(k)
        else:
            out.append([k])
    return out


class Matcher:
    """All searchers of one block of patterns. A worker keeps those of the block that it last searched for."""

    _kept: dict[str, "Matcher"] = {}

    @classmethod
    def of(cls, name: str, block) -> "Matcher":
        """The searchers of a broadcast block, whose name is its own."""
        if name not in cls._kept:
            cls._kept.clear()
            cls._kept[name] = cls(block.value)
        return cls._kept[name]

    def __init__(self, found: dict[bytes, set[str]]) -> None:
        self.patterns = sorted(found)
        self.items = [sorted(found[p]) for p in self.patterns]
        self.words = np.array([p.count(b" ") - 1 for p in self.patterns], np.int64)
        self.parts = [(np.array(rows), Searcher([self.patterns[k] for k in rows])) for rows in _classes(self.patterns)]

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        padded = np.concatenate([text, np.zeros(3, np.uint8)]).astype(np.uint32)
        blocks = padded[:-3] << np.uint32(24)
        for j, drop in ((1, 16), (2, 8), (3, 0)):
            blocks |= padded[j : len(padded) - 3 + j] << np.uint32(drop)
        got = [(start, rows[which]) for rows, s in self.parts for start, which in [s.find(text, blocks)]]
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


K.KEPT["benchmark"] = lambda: K.forget(Matcher._kept)


def _searching(broadcast, name: str | None, extra: int, schema: pa.Schema):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            K.enter("benchmark")
            matcher = Matcher.of(name, broadcast) if name else None
            for batch in batches:
                text_at, spans_at, items_at = extra, extra + 2, extra + 3
                for first, end, data, bounds in K.text_slices(batch.column(text_at), _ENDING):
                    text, marks = normal(data, bounds)
                    word = np.flatnonzero((text[:-1] == _BLANK) & (text[1:] != _BETWEEN))  # the blank before each word
                    edges = np.concatenate([[0], np.searchsorted(word, marks)])
                    start, which = matcher.find(text) if matcher else (np.zeros(0, np.int64),) * 2
                    row = np.searchsorted(marks, start)
                    begin = np.searchsorted(word, start)
                    order = np.lexsort((which, begin, row))
                    row, begin, which = row[order], begin[order], which[order]
                    stop = begin + (matcher.words[which] if matcher else 0)
                    part = batch.slice(first, end - first)
                    spans, items = part.column(spans_at).to_pylist(), part.column(items_at).to_pylist()
                    cut = np.searchsorted(row, np.arange(end - first + 1))
                    for k in np.unique(row).tolist():
                        x, y = cut[k], cut[k + 1]
                        a, b = begin[x:y] - edges[k], stop[x:y] - edges[k]
                        spans[k] = _merged([*spans[k], *zip(a.tolist(), b.tolist(), strict=True)] if spans[k] else list(zip(a.tolist(), b.tolist(), strict=True)))
                        items[k] = sorted({*(items[k] or ()), *(i for w in set(which[x:y].tolist()) for i in matcher.items[w])})
                    columns = [*part.columns[: extra + 1], pa.array(np.diff(edges), pa.int64()), pa.array([[list(s) for s in v] if v else [] for v in spans], schema.field(spans_at).type), pa.array([v or [] for v in items], schema.field(items_at).type)]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return search


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(tuple(s) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def _blocks(items: DataFrame, most_bytes: int) -> Iterator[dict[bytes, set[str]]]:
    """The items' windows in blocks of at most about ``most_bytes`` of pattern text."""
    block: dict[bytes, set[str]] = {}
    size = 0
    for item, text in items.toLocalIterator():
        for pattern, ids in windows_of([(item, text)]).items():
            size += len(pattern) * (pattern not in block)
            block.setdefault(pattern, set()).update(ids)
        if size >= most_bytes:
            yield block
            block, size = {}, 0
    yield block


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_bytes: int = 32 << 20, carry: list[str] | None = None) -> DataFrame:
    """docs with n_words, hit_spans (disjoint ranges of word numbers inside occurring windows, in order) and hit_items (ids, as strings, sorted).

    The result has the columns of ``carry`` (by default the id), the text, and
    these three. A null or empty text has no words. Benchmark rows without an
    id or with a null text take no part; rows that repeat an id are one item.
    An empty benchmark hits nothing. The benchmark goes to the workers in
    blocks of at most ``most_bytes`` of patterns; after each but the last the
    documents and what was found so far are stored.
    """
    carry = [id_col] if carry is None else [c for c in carry if c != text_col]
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t")).filter("i is not null and t is not null").distinct()
    state = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<array<long>>").alias("hit_spans"), F.array().cast("array<string>").alias("hit_items"))
    schema = pa.schema([*((f"c{k}", pa.null()) for k in range(len(carry))), ("text", pa.string()), ("n_words", pa.int64()), ("hit_spans", pa.list_(pa.list_(pa.int64()))), ("hit_items", pa.list_(pa.string()))])
    kind = state.schema
    blocks = _blocks(items, most_bytes)
    block = next(blocks)
    folder, n = None, 0
    while block is not None:
        following = next(blocks, None)
        state = state.mapInArrow(_searching(spark.sparkContext.broadcast(block), uuid.uuid4().hex if block else None, len(carry), schema), kind)
        if following is not None:
            folder = folder or scratch(spark)
            state = stored(state, f"{folder}/{(n := n + 1)}")
        block = following
    return state.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(carry)), F.col("text").alias(text_col), "n_words", "hit_spans", "hit_items")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; see find_benchmark for the cases."""
    found = find_benchmark(docs, benchmark, **options)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    out = found.select(F.col(options.get("id_col", "doc_id")).alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def item_digest(items: list[str]) -> str:
    """The digest of a document's items, as in ``contamination``."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
