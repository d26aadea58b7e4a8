"""Exact byte-level BPE token counts of whole texts in DataFrame operations, without Python on the executors.

Texts are cut into chunks where the tokenizer's own cut falls in any case: before
the last blank of a run of white space. Chunks repeat, so most are found in a
dictionary that is broadcast; the others are gathered over all documents, and
the distinct pieces that they consist of are merged, each once, by a fold over
the tokenizer's table of merges. What the dictionary holds decides how much is
gathered, never a count. The work for a piece grows with the square of its length.
"""

from __future__ import annotations

import json
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_size, dropped, scratch, stored
from .tokens import _alphabet, tokenizer_path

#: Chunks in the dictionary at most, and about how many documents they are counted in.
KNOWN, KNOWN_DOCS = 1 << 17, 1 << 14
#: Bytes of a table that is broadcast at most.
_SMALL = 48 << 20
#: About how many pieces are merged in one row, beside which the table of merges is copied.
_TOGETHER = 2048
#: More pieces than these are cut in two, if they have that many bytes, so that fewer and shorter ones are merged.
_MANY, _LONG = 1 << 17, 5
_NONE = 1 << 40


@lru_cache(maxsize=4)
def merge_table(path: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Added tokens, two arrays that hold the merges, and the bytes of each symbol: pair (a, b) makes symbol s if ``slots[places[a] + b] == a << 16 | s``. Bytes are symbols 0 to 255; earlier merges make smaller symbols."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, before = told["model"], told["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    added = told["added_tokens"]
    if not plain or told["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]] for t in added):
        raise ValueError(f"not a plain byte-level BPE tokenizer: {path}")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    number = {c: k for k, c in enumerate(_alphabet())}
    number |= {a + b: 256 + k for k, (a, b) in enumerate(merges)}
    if len(number) != 256 + len(merges) or len(number) > 1 << 16 or not set(number) <= set(model["vocab"]):
        raise ValueError(f"tokens that several merges make, or too many: {path}")
    rows: dict[int, list[tuple[int, int]]] = {}
    for k, (a, b) in enumerate(merges):
        rows.setdefault(number[a], []).append((number[b], 256 + k))
    # Rows of pairs with the same left symbol are laid over each other so that no two use one slot, the longest first.
    free = np.ones(4 * len(number) + len(number), bool)
    slots, places = np.full(len(free), _NONE), np.zeros(len(number), np.int64)
    at, lone = 0, []
    for a, row in sorted(rows.items(), key=lambda kv: (-len(kv[1]), kv[0])):
        if len(row) == 1:
            lone.append((a, *row[0]))
            continue
        right = np.array([b for b, _ in row])
        right, low = right - right.min(), int(right.min())
        first = at
        while not (good := free[(tried := np.flatnonzero(free[first : first + 1024]) + first)[:, None] + right].all(1)).any():
            first += 1024
        place = int(tried[good.argmax()])
        places[a] = place - low
        free[place + right] = False
        slots[place + right] = [a << 16 | s for _, s in row]
        while not free[at : at + 256].sum() > 64:  # hardly any are left there
            at += 256
    if lone:
        left, right, made = np.array(lone).T
        place = np.flatnonzero(free)[: len(left)]
        places[left], slots[place], free[place] = place - right, left << 16 | made, False
    return [t["content"] for t in added], places, slots[: int(np.flatnonzero(~free).max(initial=0)) + 1], np.array([len(x) for x in number])


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def chunks(docs: DataFrame, carry: list[str], added: list[str], text_col: str = "text") -> DataFrame:
    """carry, first (whether it is the text's first), chunk: all chunks of every text that is not empty, in no order."""
    held = "|".join(map(_quoted, added)) or r"(?!)"
    # At single blanks, which is fast, unless a run of white space has a blank that is neither its first nor its last character, or stands before an added token.
    odd = F.col("_text").rlike(r"(?U)\s (?:\s|\z)")
    if added:
        odd |= reduce(Column.__or__, (F.contains("_text", F.lit(t)) for t in added)) & F.col("_text").rlike(rf"(?U)\s(?={held})")
    slow = rf"(?U)\s+(?={held})| ?\S+|\s+(?!\S)|\s+"
    text = F.col(text_col)
    rows = docs.select(*carry, text.cast("string").alias("_text")).filter(F.length("_text") > 0).withColumn("_odd", odd)
    parts = F.when(F.col("_odd"), F.regexp_extract_all("_text", F.lit(slow), F.lit(0))).otherwise(F.split("_text", " "))
    cut = rows.select(*carry, "_odd", F.posexplode(parts).alias("_at", "_part"))
    first = F.col("_at") == 0
    return cut.select(*carry, first.alias("first"), F.when(F.col("_odd") | first, F.col("_part")).otherwise(F.concat(F.lit(" "), "_part")).alias("chunk"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once for a row."""
    return F.transform(F.array(value), body)[0]


def _latin(piece: Column) -> Column:
    """A string with a character for each byte."""
    return F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1")


def _symbols(bytes_: Column) -> Column:
    return F.transform(F.split(bytes_, ""), lambda c: F.ascii(c).cast("long"))


def _merged(symbols: Column, places: Column, slots: Column) -> Column:
    """The symbols left when the earliest merge of any pair, the leftmost first, has been done until there is none."""

    def made(a: Column, b: Column) -> Column:
        """The symbol that the pair makes, or 2^16 or more."""
        return F.coalesce(F.get(slots, (F.get(places, a.cast("int")) + b).cast("int")), F.lit(_NONE)).bitwiseXOR(F.shiftleft(a, 16))

    none = F.array().cast("array<long>")
    first = F.zip_with(F.slice(symbols, F.lit(1), F.size(symbols) - 1), F.slice(symbols, F.lit(2), F.size(symbols) - 1), made)
    start = let(first, lambda p: F.struct(symbols.alias("s"), p.alias("p"), F.array_min(p).alias("least")))

    def step(held: Column, _: Column) -> Column:
        def done(at: Column) -> Column:
            s, p, new = held["s"], held["p"], held["least"]
            after = F.concat(F.slice(s, F.lit(1), at - 1), F.array(new), F.slice(s, at + 2, F.size(s)))
            left = F.when(at > 1, F.concat(F.slice(p, F.lit(1), F.greatest(at - 2, F.lit(0))), F.array(made(F.get(s, at - 2), new)))).otherwise(none)
            right = F.when(at < F.size(p), F.concat(F.array(made(new, F.get(s, at + 1))), F.slice(p, at + 2, F.size(p)))).otherwise(none)
            return let(F.concat(left, right), lambda q: F.struct(after.alias("s"), q.alias("p"), F.array_min(q).alias("least")))

        return F.when(held["least"] < 1 << 16, let(F.array_position(held["p"], held["least"]).cast("int"), done)).otherwise(held)

    return F.when(F.size(symbols) < 2, symbols).otherwise(F.aggregate(F.sequence(F.lit(2), F.size(symbols)), start, step, lambda held: held["s"]))


class Counter:
    """Counts tokens by one tokenizer file; its table of merges is stored once."""

    def __init__(self, spark: SparkSession, path: str | None = None, many: int = _MANY) -> None:
        self.spark, self.folder, self.many = spark, scratch(spark), many
        self.added, places, slots, sizes = merge_table(path or tokenizer_path())
        one, two = np.divmod(np.arange(1 << 16), 256)
        at = places[one] + two
        held = np.where((at >= 0) & (at < len(slots)), slots[np.clip(at, 0, len(slots) - 1)], _NONE) ^ (one << 16)
        columns = {"places": places, "slots": slots, "sizes": sizes, "ranks": np.minimum(held, 1 << 16)}
        self.table = stored(spark.createDataFrame(pa.table({k: pa.array([v], pa.list_(pa.int64())) for k, v in columns.items()})), f"{self.folder}/merges")
        self.steps = 0

    def _kept(self, df: DataFrame) -> DataFrame:
        self.steps += 1
        return stored(df, f"{self.folder}/{self.steps}")

    def _drop(self, since: int = 0) -> None:
        """Delete the steps after ``since``, but for the last one."""
        dropped(self.spark, *(f"{self.folder}/{k}" for k in range(since + 1, self.steps)))

    def _beside(self, rows: DataFrame, n: int, value) -> DataFrame:
        """The fields of ``value`` of each of n strings, worked out beside the table of merges."""
        held = rows.groupBy(F.pmod(F.xxhash64("bytes"), F.lit(-(-n // _TOGETHER) or 1)).alias("_at")).agg(F.collect_list("bytes").alias("_all"))
        return held.crossJoin(F.broadcast(self.table)).select(F.explode(F.transform("_all", value)).alias("r")).select("r.*")

    def _folded(self, strings: DataFrame, n: int) -> DataFrame:
        """bytes, n, head, tail: of each distinct string (a character for each byte) the number of tokens, and the bytes of the first and the last."""
        size = lambda s: F.get(F.col("sizes"), s.cast("int")).cast("int")
        told = lambda b: let(_merged(_symbols(b), F.col("places"), F.col("slots")), lambda s: F.struct(b.alias("bytes"), F.size(s).cast("long").alias("n"), size(F.get(s, F.lit(0))).alias("head"), size(F.get(s, F.size(s) - 1)).alias("tail")))
        return self._beside(strings, n, told)

    def _halved(self, pieces: DataFrame, n: int) -> DataFrame:
        """bytes, one, two: pieces cut between the two bytes that would be merged last, if ever; short ones are left whole, with an empty second half."""

        def cut(b: Column) -> Column:
            ranks = lambda s: F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda x, y: F.get(F.col("ranks"), (x * 256 + y).cast("int")))
            last = let(_symbols(b), lambda s: let(ranks(s), lambda r: F.array_position(r, F.array_max(r)).cast("int")))
            return let(F.when(F.length(b) < _LONG, F.length(b)).otherwise(last), lambda at: F.struct(b.alias("bytes"), b.substr(F.lit(1), at).alias("one"), b.substr(at + 1, F.length(b)).alias("two")))

        return self._beside(pieces, n, cut)

    def _counted(self, strings: DataFrame, n: int) -> DataFrame:
        """As ``_folded``. Many strings are cut in two first, as their halves are fewer and shorter, and so on with these.

        The tokens of a string are those of its halves if the last token of the
        first and the first of the second stay as they are where only these two
        are merged: until a merge goes across the cut, each half is merged as if
        it were alone, and the first merge to go across joins parts of these two
        tokens, so it would be done there as well. Others are merged whole.
        """
        if n <= self.many:
            return self._folded(strings, n)
        cut = self._kept(self._halved(strings, n))
        halves = self._kept(cut.select(F.explode(F.array("one", "two")).alias("bytes")).filter("bytes != ''").distinct())
        m = halves.count()
        halves = self._kept(self._counted(halves, m) if m < 0.8 * n else self._folded(halves, m))
        one = self._sized(halves.select(F.col("bytes").alias("one"), F.col("n").alias("n_one"), "head", "tail"))
        two = self._sized(halves.select(F.col("bytes").alias("two"), F.col("n").alias("n_two"), F.col("head").alias("then"), F.col("tail").alias("end")))
        both = F.when(F.col("two") != "", F.concat(F.right("one", "tail"), F.left("two", "then")))
        told = ((F.col("n_one") + F.coalesce("n_two", F.lit(0))).alias("n"), "head", F.coalesce("end", "tail").alias("tail"))
        met = self._kept(cut.join(one, "one").join(two, "two", "left").select("bytes", *told, both.alias("both"), F.col("tail").alias("at")))
        pairs = self._kept(met.filter("both is not null").select(F.col("both").alias("bytes")).distinct())
        pairs = self._kept(self._folded(pairs, pairs.count()).filter("n = 2").select(F.col("bytes").alias("both"), F.col("head").alias("at"), F.lit(True).alias("apart")))
        met = self._kept(met.join(self._sized(pairs), ["both", "at"], "left").withColumn("good", F.col("both").isNull() | F.coalesce("apart", F.lit(False))).select("bytes", "n", "head", "tail", "good"))
        whole = met.filter("not good").select("bytes")
        return met.filter("good").drop("good").unionByName(self._folded(whole, whole.count()))

    def pieces(self, pieces: DataFrame) -> DataFrame:
        """bytes, n: the tokens of each distinct piece (a character for each byte); an added token is one."""
        added = F.col("bytes").isin([t.encode().decode("latin-1") for t in self.added])
        plain = pieces.filter(~added)
        return self._counted(plain, plain.count()).select("bytes", "n").unionByName(pieces.filter(added).select("bytes", F.lit(1).cast("long").alias("n")))

    def _sized(self, rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if byte_size(rows) <= _SMALL // 2 else rows.hint("shuffle_hash")

    def of_chunks(self, distinct: DataFrame) -> DataFrame:
        """chunk, n for distinct chunks."""
        held = "|".join(map(_quoted, self.added)) or r"(?!)"
        cut = rf"(?U){held}|'(?:[stmd]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?(?:(?!{held})[^\s\p{{L}}\p{{N}}])+|\s+(?={held})|\s+(?!\S)|\s+"
        began = self.steps
        # A piece of one byte is one token, so a chunk's other pieces are enough to look up, or one piece where there are no others.
        parts = distinct.select("chunk", F.regexp_extract_all("chunk", F.lit(cut), F.lit(0)).alias("_all"))
        parts = parts.select("chunk", "_all", F.filter("_all", lambda x: F.octet_length(x) > 1).alias("_long"))
        parts = parts.select("chunk", F.size("_all").alias("_n"), F.when(F.size("_long") > 0, F.col("_long")).otherwise(F.slice("_all", 1, 1)).alias("_sought"))
        parts = parts.select("chunk", (F.col("_n") - F.size("_sought")).alias("_more"), F.posexplode_outer("_sought").alias("_at", "_piece")).filter("_piece is not null")  # without outer, the optimizer cuts all chunks before they are made distinct
        parts = self._kept(parts.select("chunk", F.when(F.col("_at") == 0, F.col("_more")).otherwise(0).alias("more"), _latin(F.col("_piece")).alias("bytes")))
        counted = self._kept(self.pieces(self._kept(parts.select("bytes").distinct())))
        out = self._kept(parts.join(counted.hint("shuffle_hash"), "bytes").groupBy("chunk").agg(F.sum(F.col("n") + F.col("more")).alias("n")))
        self._drop(began)
        return out

    def known(self, docs: DataFrame, key: str, text_col: str) -> DataFrame:
        """chunk, n: a dictionary of chunks that repeat in some of the documents."""
        n = docs.count()
        some = docs.filter(F.pmod(F.xxhash64(F.col(key), F.lit(43)), F.lit(1 << 30)) < int(min(1.0, KNOWN_DOCS / max(n, 1)) * (1 << 30)))
        seen = self._kept(chunks(some, [], self.added, text_col).groupBy("chunk").agg(F.count("*").alias("times")).filter("times > 2"))
        least, total = 3, 0
        for r in seen.groupBy(F.least("times", F.lit(1 << 12)).alias("times")).count().orderBy(F.desc("times")).collect():
            total += r["count"]
            if total > KNOWN:
                least = r["times"] + 1
                break
        return self.of_chunks(seen.filter(F.col("times") >= least).select("chunk"))

    def counts(self, docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
        """key, n: the tokens of the whole text of each key, under which all rows have one text; keys without a text, or with an empty one, are left out."""
        began = self.steps
        # Joined by a hash, which is faster than by strings; of known chunks with one hash one is left, and a chunk is found only if it is the same.
        known = self.known(docs, key, text_col).groupBy(F.xxhash64("chunk").alias("_hash")).agg(F.min_by(F.struct(F.col("chunk").alias("same"), "n"), "chunk").alias("r")).select("_hash", "r.*")
        found = chunks(docs, [key], self.added, text_col).withColumn("_hash", F.xxhash64("chunk")).join(F.broadcast(known), "_hash", "left")
        told = F.when(F.col("same") == F.col("chunk"), F.col("n"))
        found = found.groupBy(key, F.when(told.isNull(), F.col("chunk")).alias("chunk")).agg(F.coalesce(F.sum(told), F.lit(0)).alias("told"), F.count("*").alias("times"), F.sum(F.col("first").cast("int")).alias("rows"))
        found = self._kept(found)
        self._drop(began)
        rare = self.of_chunks(found.filter("chunk is not null").select("chunk").distinct())
        rare = self._sized(rare)
        lone = found.filter("chunk is not null").join(rare, "chunk", "left").select(key, (F.col("times") * F.coalesce("n", F.lit(0))).alias("told"), "rows")  # an empty chunk, before a blank that begins a text, has no pieces
        all_ = found.filter("chunk is null").select(key, "told", "rows").unionByName(lone)
        out = self._kept(all_.groupBy(key).agg(F.expr("sum(told) div sum(rows)").alias("n")))
        self._drop(began)
        return out
