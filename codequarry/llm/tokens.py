"""Exact byte-level BPE token ids at column speed, and the exact length histogram.

The library's pre-tokenizer cuts a text into pieces that it then encodes one by
one, without regard to their neighbours. The pieces are found here with NumPy
over a whole slice of texts, hashed, and looked up in a table that each Python
worker keeps; only pieces not seen before go to the library. A text holding a
character outside the verified range, or what may be a special token, is
encoded whole by the library itself. Ids equal those of the library either way
(tests hold the two against each other).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .common import bounded_batches, scratch, stored

_LETTER, _NUMBER, _SPACE, _OTHER, _END, _RARE = range(6)
_KNOWN = 0x3000
_SLOTS = 1 << 21
_FLAT = 1 << 22
_LONG_TEXT = 4 << 20


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizers' file of that name lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    import unicodedata

    import regex

    kinds = np.full(_KNOWN + 1, _OTHER, np.uint8)
    for c in range(_KNOWN):
        x = chr(c)
        if 0xD800 <= c < 0xE000 or unicodedata.category(x) == "Cn":
            kinds[c] = _RARE
        elif regex.match(r"\p{L}", x):
            kinds[c] = _LETTER
        elif regex.match(r"\p{N}", x):
            kinds[c] = _NUMBER
        elif regex.match(r"\p{White_Space}", x):
            kinds[c] = _SPACE
    kinds[_KNOWN] = _RARE
    return kinds


def _alphabet() -> str:
    """The characters by which byte-level tokenizers write the 256 bytes: printable ones of Latin-1 as they are, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


def piece_starts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where pieces start, given code points and their kinds; every text ends with one code point of kind _END.

    A piece is a contraction, a run of one kind with one blank before it, or
    white space up to but not including the last character before other text.
    """
    start = np.empty(len(points), bool)
    start[:1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=start[1:])
    last = np.flatnonzero((kinds[:-1] == _SPACE) & (kinds[1:] != _SPACE) & (kinds[1:] != _END))
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    at = np.flatnonzero((points[:-2] == 0x27) & start[:-2] & (kinds[1:-1] == _LETTER))
    if len(at):
        one, two = points[at + 1], points[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for found, size in ((at[short], 2), (at[long], 3)):
            start[found + 1] = False
            start[found + size] = True
    return start


class Encoder:
    """Encodes columns of texts; holds the piece table. One for each worker and tokenizer file."""

    _all: dict[str, "Encoder"] = {}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._all:
            cls._all[path] = cls(path)
        return cls._all[path]

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        before = self.library.pre_tokenizer
        self.by_piece = type(before).__name__ == "ByteLevel" and not before.add_prefix_space and before.use_regex and self.library.normalizer is None
        self.model, self.alphabet = self.library.model, _alphabet()
        self.kinds = _classes()
        self.codes = K.random64(_KNOWN + 1, 31)
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(_SLOTS, np.uint64)
        self.place = np.zeros(_SLOTS, np.int32)
        self.size = np.zeros(_SLOTS, np.int32)
        self.flat = np.zeros(_FLAT + (1 << 20), np.int32)
        self.used = 0

    @staticmethod
    def _second(names: np.ndarray) -> np.ndarray:
        return (names >> np.uint64(40) & np.uint64(_SLOTS - 1)).astype(np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places and sizes in ``flat`` of the ids of new pieces."""
        tokenize, alphabet = self.model.tokenize, self.alphabet
        ids = [[t.id for t in tokenize(p.encode().decode("latin-1").translate(alphabet))] for p in pieces]
        sizes = np.array([len(x) for x in ids], np.int32)
        total = int(sizes.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(self.flat), total), np.int32)])
        self.flat[self.used : self.used + total] = np.fromiter((t for x in ids for t in x), np.int32, total)
        places = self.used + np.concatenate([[0], np.cumsum(sizes[:-1])])
        self.used += total
        return places, sizes

    def encode(self, data: np.ndarray, bounds: np.ndarray, count_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text); ids are empty with count_only."""
        raw = data.tobytes()
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            parts = [self._whole(raw[a : b - 1].decode(errors="replace")) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        edges = heads[bounds]
        capped = np.minimum(points, _KNOWN)
        kinds = self.kinds[capped]
        kinds[edges[1:] - 1] = _END
        odd = kinds == _RARE if self.by_piece else np.ones(len(kinds), bool)
        lt = np.flatnonzero(points == 0x3C)
        odd[lt[points[lt + 1] == 0x7C]] = True
        strange = np.unique(np.searchsorted(edges, np.flatnonzero(odd), "right") - 1)
        start = piece_starts(points, kinds)
        a = np.flatnonzero(start)
        b = np.append(a[1:], len(points))
        real = kinds[a] != _END
        a, b = a[real], b[real]
        names = K.span_hashes(self.codes[capped], a, b)
        slot = (names & np.uint64(_SLOTS - 1)).astype(np.int64)
        missed = np.flatnonzero(self.key[slot] != names)
        slot[missed] = self._second(names[missed])
        place, size = self.place[slot], self.size[slot]
        new = missed[self.key[slot[missed]] != names[missed]]
        if len(new):
            if self.used > _FLAT:
                self._clear()
                return self.encode(data, bounds, count_only)
            distinct, first, again = np.unique(names[new], return_index=True, return_inverse=True)
            which = new[first]
            places, sizes = self._learn([text[x:y] for x, y in zip(a[which].tolist(), b[which].tolist(), strict=True)])
            place[new], size[new] = places[again], sizes[again]
            at = (distinct & np.uint64(_SLOTS - 1)).astype(np.int64)  # the first place if it is free, else the second
            at = np.where(self.key[at] == 0, at, self._second(distinct))
            self.key[at], self.place[at], self.size[at] = distinct, places, sizes
        ends = np.concatenate([[0], np.cumsum(size)])
        of_text = ends[np.searchsorted(a, edges)]
        counts = np.diff(of_text)
        if count_only and not len(strange):
            return np.zeros(0, np.int32), counts
        ids = np.zeros(0, np.int32)
        if not count_only:
            ids = self.flat[np.repeat(place - ends[:-1], size) + np.arange(ends[-1])]
        if len(strange):
            parts = np.split(ids, of_text[1:-1])
            for k in strange.tolist():
                whole = self._whole(text[edges[k] : edges[k + 1] - 1])
                counts[k] = len(whole)
                if not count_only:
                    parts[k] = whole
            ids = np.concatenate(parts) if not count_only else ids
        return ids, counts

    def column(self, column: pa.Array, count_only: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Yield (first row, end row, ids, counts) over a column of texts; null is empty."""
        for first, end, data, bounds in K.text_slices(column):
            if len(data) <= _LONG_TEXT or end - first > 1:
                yield first, end, *self.encode(data, bounds, count_only)
                continue
            parts = [self.encode(np.append(data[x:y], np.uint8(10)), np.array([0, y - x + 1]), count_only) for x, y in _cuts(data[:-1])]
            yield first, end, np.concatenate([p[0] for p in parts]), np.array([sum(int(p[1][0]) for p in parts)])


K.KEPT["tokens"] = lambda: K.forget(Encoder._all)


def _cuts(data: np.ndarray, every: int = K.SLICE_BYTES) -> list[tuple[int, int]]:
    """Cut one very long text before blanks that stand between ASCII letters, where a piece starts whatever else the text holds."""
    found, at = [0], every
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123)]] = True
    while at < len(data):
        part = data[at : at + every]
        ok = np.flatnonzero((part[1:-1] == 0x20) & letter[part[:-2]] & letter[part[2:]])
        if len(ok):
            found.append(at + int(ok[0]) + 1)
        at += every
    return list(zip(found, [*found[1:], len(data)], strict=True))


def token_counts(docs: DataFrame, path: str | None = None, text_col: str = "text", out: str = "n_tokens", keep_text: bool = False) -> DataFrame:
    """docs without the text (or with it, after the other columns) and with the exact number of tokens of each whole text (null: 0) as a further long column; a column of that name is replaced."""
    path = path or tokenizer_path()
    bounded_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text_col, out)]
    held = [*keep, text_col] if keep_text else keep

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.enter("tokens")
        encoder = Encoder.of(path)
        with np.errstate(over="ignore"):
            for batch in batches:
                counts = [c for _, _, _, c in encoder.column(batch.column(len(keep)), count_only=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(held)], pa.array(np.concatenate(counts) if counts else [], pa.int64())], names=[*held, out])

    docs = docs.select(*keep, F.col(text_col).cast("string"))
    return docs.mapInArrow(count, docs.select(*held).schema.add(out, "long"))


def length_histogram(docs: DataFrame, path: str | None = None, text_col: str = "text", block: int = 1024) -> DataFrame:
    """The exact histogram of encoded lengths and its suffix sums; see ``histogram_of``. A null text has length 0, an empty table gives no rows."""
    return histogram_of(token_counts(docs.select(F.col(text_col).alias("text")), path), block=block)


def histogram_of(counts: DataFrame, length_col: str = "n_tokens", block: int = 1024) -> DataFrame:
    """One row for each length that occurs: n_tokens, n_docs, docs_from and tokens_from (documents at least so long, and their tokens), docs_total, tokens_total, truncated_total.

    ``truncated_total`` is the number of tokens left when every document is cut
    at n_tokens; ``truncated_totals`` and ``quantiles`` answer any limit or
    share from these rows. Sums over blocks of lengths come first, so no task
    gets more rows than there are blocks or lengths in a block.
    """
    by_length = counts.groupBy(F.col(length_col).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))
    spark = counts.sparkSession
    by_length = stored(by_length.withColumn("block", F.floor(F.col("n_tokens") / block)), f"{scratch(spark)}/lengths")
    blocks = by_length.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    above = Window.orderBy(F.desc("block"))
    after = above.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t"), F.sum("d").over(every).alias("docs_total"), F.sum("t").over(every).alias("tokens_total"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = by_length.withColumns({"x": F.sum("n_docs").over(within), "y": F.sum(F.col("n_docs") * F.col("n_tokens")).over(within)}).join(blocks, "block")
    out = out.select("n_tokens", "n_docs", (F.col("x") + F.col("d")).alias("docs_from"), (F.col("y") + F.col("t")).alias("tokens_from"), "docs_total", "tokens_total")
    return out.withColumn("truncated_total", F.col("tokens_total") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from"))


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_cut, truncated_total for each limit of 0 or more: the documents longer than it, and the tokens left when each is cut at it. Exact, from the rows of ``histogram_of``; an empty histogram gives no rows."""
    asked = histogram.withColumn("context_limit", F.explode(F.array(*(F.lit(x).cast("long") for x in limits))))
    longer = F.col("n_tokens") > F.col("context_limit")
    beyond = lambda c: F.coalesce(F.min_by(c, F.when(longer, F.col("n_tokens"))), F.lit(0))
    out = asked.groupBy("context_limit").agg(beyond(F.when(longer, F.col("docs_from"))).alias("docs_cut"), beyond(F.when(longer, F.col("tokens_from"))).alias("t"), F.max("tokens_total").alias("all"))
    return out.select("context_limit", "docs_cut", (F.col("all") - F.col("t") + F.col("context_limit") * F.col("docs_cut")).alias("truncated_total"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens for each share from 0 to 1: the least length that at least so many of the documents don't exceed. Exact, from the rows of ``histogram_of``; an empty histogram gives no rows."""
    asked = histogram.withColumn("share", F.explode(F.array(*(F.lit(float(x)) for x in shares))))
    upto = F.col("docs_total") - F.col("docs_from") + F.col("n_docs")
    return asked.filter(upto >= F.col("share") * F.col("docs_total")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
