"""Token ids on disk, compressed by Re-Pair grammars.

Format: a Parquet table with one row for each shard. A shard holds whole
documents in ascending order of doc_id; its ids are the start symbols of a
straight-line grammar. Columns:

part, shard      order of the shards: by part, then by shard
start_in_part    ids in the part before this shard
n_tokens         ids in this shard
vocabulary       symbols below are token ids, symbols from there are rules
width            bytes of a symbol (2, 3 or 4), little-endian
symbols          the compressed ids of all documents of the shard, ``width`` bytes each
rules            pairs of symbols, ``width`` bytes each; rule k is symbol vocabulary + k
expansions       number of ids that each rule stands for, 4 bytes each
doc_ids, doc_tokens, doc_symbols   for each document its id, ids and symbols

A rule refers to earlier ones only, and no rule crosses a document's end, so
any document or range of ids is found by the expansion lengths and decoded from
its own symbols and the rules they refer to.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .common import bounded_batches, dropped, partitions, scratch, stored
from .tokens import Encoder, tokenizer_path

SHARD_TOKENS = 1 << 20
#: A pair gets a rule while it occurs so often. Rarer ones cost more bytes (two symbols and a length) than they save; see the README for sizes at 2 to 16.
LEAST = 8
#: Bits of a table's slots in which a round looks up its pairs.
SLOTS = 18

SHARD_SCHEMA = "part int, shard int, start_in_part long, n_tokens long, vocabulary int, width int, symbols binary, rules binary, expansions binary, doc_ids array<long>, doc_tokens array<int>, doc_symbols array<int>"
_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("vocabulary", pa.int32()), ("width", pa.int32()), ("symbols", pa.binary()), ("rules", pa.binary()), ("expansions", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())), ("doc_symbols", pa.list_(pa.int32()))])


def _overlapping(symbols: np.ndarray) -> np.ndarray:
    """The pairs of a run of one symbol that overlap the counted ones before them: every second of the run."""
    same = np.flatnonzero(symbols[1:] == symbols[:-1])
    if not len(same):
        return same
    begins = np.concatenate([[True], same[1:] != same[:-1] + 1])
    place = np.arange(len(same))
    return same[(place - place[begins][np.cumsum(begins) - 1]) % 2 == 1]


def compress(ids: np.ndarray, ends: np.ndarray, vocabulary: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbols of each document, rule pairs). ``ends`` are the documents' ends in ids.

    Goes on until no pair occurs ``least`` times in a document. A round counts
    all pairs (exactly, runs of one symbol without overlaps) and ranks those
    that occur ``least`` times by their counts; a pair is replaced wherever it
    outranks the two pairs that it overlaps. The commonest pair is thus always
    replaced everywhere, and with it all pairs whose occurrences it leaves
    alone, if there are still ``least`` of them. Ties are ranked by a hash, so
    that a long repeated passage halves from round to round.
    """
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(ids), bool)
    last[ends[ends > 0] - 1] = True
    made: list[np.ndarray] = []
    following = vocabulary
    while len(symbols) > 1:
        # Where all symbols fit into 16 bits, half as wide numbers name the pairs. The greatest number is no pair.
        kind, half, factor = (np.uint32, 16, 0x9E3779B1) if following < 1 << 16 else (np.uint64, 32, 0x9E3779B97F4A7C15)
        none, shift = kind(~kind(0)), kind(2 * half - SLOTS)
        code = symbols[:-1].astype(kind) << kind(half) | symbols[1:].astype(kind)
        code[last[:-1]] = none
        code[_overlapping(symbols)] = none
        ordered = np.sort(code)
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        times = np.diff(first, append=len(ordered))
        often = (times >= least) & (ordered[first] != none)
        if not often.any():
            break
        pairs, times = ordered[first[often]], times[often]
        pairs = pairs[np.lexsort((K.mix64(pairs.astype(np.uint64)), times))]
        # Each slot's best pair; what shares its slot with a better one waits for the next round.
        best = np.full(1 << SLOTS, -1, np.int32)
        best[pairs * kind(factor) >> shift] = np.arange(len(pairs))
        found = best[code * kind(factor) >> shift]
        at = np.flatnonzero(found >= 0)
        found = found[at]
        same = pairs[found] == code[at]
        at, found = at[same], found[same]
        rank = np.full(len(symbols) + 1, -1, np.int32)
        rank[at + 1] = found
        take = np.flatnonzero((rank[1:-1] > rank[:-2]) & (rank[1:-1] > rank[2:]))
        uses = rank[take + 1]
        kept = np.bincount(uses, minlength=len(pairs)) >= least
        take = take[kept[uses]]
        symbols[take] = following + (np.cumsum(kept) - 1)[rank[take + 1]]
        last[take] = last[take + 1]
        stay = np.ones(len(symbols), bool)
        stay[take + 1] = False
        symbols, last = symbols[stay], last[stay]
        made.append(np.stack([pairs[kept] >> kind(half), pairs[kept] & kind((1 << half) - 1)], 1).astype(np.uint32))
        following += len(made[-1])
    rules = np.concatenate(made) if made else np.zeros((0, 2), np.uint32)
    cuts = np.flatnonzero(last) + 1
    sizes = np.zeros(len(ends), np.int64)
    sizes[np.diff(ends, prepend=0) > 0] = np.diff(cuts, prepend=0)
    return symbols, sizes, rules


def _packed(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u4").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()


def _unpacked(raw, width: int) -> np.ndarray:
    if width != 3:
        return np.frombuffer(raw, f"<u{width}").astype(np.uint32)
    wide = np.zeros((len(raw) // 3, 4), np.uint8)
    wide[:, :3] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    return wide.view("<u4").ravel()


class Grammar:
    """Decodes the symbols of one shard; ``lengths`` are the rules' expansion lengths as stored, or null to work them out."""

    def __init__(self, rules: np.ndarray, vocabulary: int, lengths: np.ndarray | None = None) -> None:
        self.rules, self.vocabulary, self.flat = rules, vocabulary, None
        self.sizes = np.ones(vocabulary + len(rules), np.int64)
        if lengths is not None:
            self.sizes[vocabulary:] = lengths
            return
        at = 0
        while at < len(rules):
            end = self._level(at)
            self.sizes[vocabulary + at : vocabulary + end] = self.sizes[rules[at:end]].sum(axis=1)
            at = end

    def _level(self, at: int) -> int:
        """The end of the rules from ``at`` on that refer to rules before ``at`` only."""
        deep = np.flatnonzero(self.rules[at : at + (1 << 15)].max(axis=1) >= self.vocabulary + at)
        return at + int(deep[0]) if len(deep) else min(len(self.rules), at + (1 << 15))

    def decode(self, symbols: np.ndarray) -> np.ndarray:
        """All ids that the symbols of a shard stand for. The rules are expanded first, level by level, then looked up."""
        if self.flat is None:
            at, used = 0, self.vocabulary
            self.places = np.concatenate([np.arange(self.vocabulary), np.zeros(len(self.rules), np.int64)])
            self.flat = np.arange(self.vocabulary, dtype=np.uint32)
            while at < len(self.rules):
                end = self._level(at)
                ids = self._looked_up(self.rules[at:end].ravel())
                sizes = self.sizes[self.vocabulary + at : self.vocabulary + end]
                self.places[self.vocabulary + at : self.vocabulary + end] = used + np.cumsum(sizes) - sizes
                self.flat = np.concatenate([self.flat, ids])
                used, at = used + len(ids), end
        return self._looked_up(np.asarray(symbols, np.uint32))

    def _looked_up(self, symbols: np.ndarray) -> np.ndarray:
        sizes = self.sizes[symbols]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.places[symbols] - ends + sizes, sizes) + np.arange(total)]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of a few symbols. Only the rules that they refer to are looked at: every pass writes a rule's two symbols in its place."""
        symbols = np.asarray(symbols, np.uint32)
        deep = np.flatnonzero(symbols >= self.vocabulary)
        while len(deep):
            pairs = self.rules[symbols[deep] - self.vocabulary]
            grown = np.ones(len(symbols), np.int64)
            grown[deep] = 2
            symbols = np.repeat(symbols, grown)
            left = deep + np.arange(len(deep))
            symbols[left], symbols[left + 1] = pairs[:, 0], pairs[:, 1]
            both = np.stack([left, left + 1], 1).ravel()
            deep = both[symbols[both] >= self.vocabulary]
        return symbols

    def ids_between(self, symbols: np.ndarray, start: int, end: int) -> np.ndarray:
        """The ids from number start up to end that the symbols stand for, decoding only the symbols that hold them, as found by the expansion lengths."""
        ends = np.cumsum(self.sizes[symbols])
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, end, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a:b])[start - before : end - before]


def _shard_row(part: int, shard: int, start: int, ids: np.ndarray, doc_ids: list, tokens: np.ndarray, vocabulary: int) -> dict:
    symbols, sizes, rules = compress(ids, np.cumsum(tokens), vocabulary)
    width = next(w for w in (2, 3, 4) if vocabulary + len(rules) <= 1 << (8 * w))
    lengths = Grammar(rules, vocabulary).sizes[vocabulary:].astype("<u4")
    return {"part": part, "shard": shard, "start_in_part": start, "n_tokens": len(ids), "vocabulary": vocabulary, "width": width, "symbols": _packed(symbols, width), "rules": _packed(rules, width), "expansions": lengths.tobytes(), "doc_ids": doc_ids, "doc_tokens": tokens.tolist(), "doc_symbols": sizes.tolist()}


_ENCODED = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("vocabulary", pa.int32()), ("times", pa.int32()), ("ids", pa.binary())])
#: Documents that are looked at together at most when rows are repeated again.
_REPEATED = 1 << 16


def _encoder(path: str, end_id: int):
    """(doc_id, mark, text) to (doc_id, mark, vocabulary, times, ids with the end, of 2 bytes each where the vocabulary allows it, else 4). Texts that repeat in a batch are encoded once, and rows alike in id and text, as readings of a mixture are, become one with their number."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.enter("tokens")
        encoder = Encoder.of(path)
        kind = "<u2" if encoder.vocabulary <= 1 << 16 and end_id < 1 << 16 else "<u4"
        size = int(kind[-1])
        with np.errstate(over="ignore"):
            for batch in batches:
                texts = batch.column(2).dictionary_encode()
                places, no_id, doc_ids = texts.indices.to_numpy(), batch.column(0).is_null().to_numpy(False), batch.column(0).fill_null(0).to_numpy()
                order = np.lexsort((doc_ids, no_id, places))
                changes = [np.diff(x[order]) != 0 for x in (places, no_id.astype(np.int8), doc_ids)]
                begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), changes[0] | changes[1] | changes[2]]))
                at, rows, times = 0, order[begins], np.diff(begins, append=len(order)).astype(np.int32)
                for first, end, ids, counts in encoder.column(texts.dictionary):
                    ends = np.cumsum(counts)
                    whole = np.insert(ids, ends, end_id).astype(kind)
                    bounds = np.concatenate([[0], np.cumsum(counts + 1)]) * size
                    slices = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(whole)])
                    upto = int(np.searchsorted(places[rows], end, "left"))
                    some, number = rows[at:upto], times[at:upto]
                    at = upto
                    out = slices.take(pa.array(places[some] - first)).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), batch.column(1).take(pa.array(some)), pa.array(np.full(len(some), encoder.vocabulary), pa.int32()), pa.array(number), out], schema=_ENCODED)

    return encode


def _again(times: np.ndarray) -> Iterator[np.ndarray]:
    """The numbers of rows, each as often as it is to be repeated; ``times`` are running totals. In parts of ``_REPEATED`` at most, or of one row."""
    at, before = 0, 0
    while at < len(times):
        end = max(at + 1, int(np.searchsorted(times, before + _REPEATED, "right")))
        yield np.repeat(np.arange(at, end), np.diff(times[at:end], prepend=before))
        at, before = end, int(times[end - 1])


def _compressor(shard_tokens: int):
    """Rows of ``_ENCODED`` in order to shards, each document as many times as it was there."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, start = TaskContext.get().partitionId(), 0, 0
        K.enter("repair")
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        waiting, vocabulary = 0, 0

        def row() -> pa.RecordBatch:
            ids, doc_ids, tokens = np.concatenate([h[1] for h in held]), [x for h in held for x in h[0]], np.concatenate([h[2] for h in held])
            held.clear()
            return pa.RecordBatch.from_pylist([_shard_row(part, shard, start, ids, doc_ids, tokens, vocabulary)], schema=_ARROW)

        with np.errstate(over="ignore"):
            for batch in batches:
                if not batch.num_rows:
                    continue
                vocabulary = batch.column(2)[0].as_py()
                size = 2 if vocabulary <= 1 << 16 else 4
                column, times = batch.column(4).cast(pa.large_binary()), np.cumsum(batch.column(3).to_numpy())
                bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
                ids, bounds, doc_ids = np.frombuffer(column.buffers()[2], f"<u{size}"), bounds // size, batch.column(0).to_pylist()
                for which in _again(times):
                    ends = np.concatenate([[0], np.cumsum(np.diff(bounds)[which])])
                    at = 0
                    while at < len(which):  # documents up to the one that fills the shard
                        end = min(len(which), int(np.searchsorted(ends, ends[at] + shard_tokens - waiting, "left")))
                        held.append(([doc_ids[k] for k in which[at:end]], np.concatenate([ids[bounds[k] : bounds[k + 1]] for k in which[at:end]]), np.diff(ends[at : end + 1])))
                        waiting += int(ends[end] - ends[at])
                        at = end
                        if waiting >= shard_tokens:
                            yield row()
                            shard, start, waiting = shard + 1, start + waiting, 0
            if held:
                yield row()

    return write


def write_tokens(docs: DataFrame, target: str, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the ids of every whole text, ``end_id`` after each, in ascending order of id.

    A null text is empty (its only id is ``end_id``). Rows without an id come
    first; rows that repeat an id are ordered by a hash of their text. Other columns are
    ignored. An empty table gives an empty table of shards. Texts are encoded
    where they lie; only the ids are dealt to tasks, by ranges of (id, hash of
    the text), so that neither a hot id nor the lack of ids puts many into one
    task. Until they are in shards, the ids of rows alike in id and text that
    lie together are kept once.
    """
    path = path or tokenizer_path()
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    held = f"{scratch(spark)}/encoded"
    encoded = stored(rows.mapInArrow(_encoder(path, end_id), "doc_id long, mark long, vocabulary int, times int, ids binary"), held, "zstd")
    ordered = encoded.repartitionByRange(partitions(spark), "doc_id", "mark").sortWithinPartitions("doc_id", "mark")
    ordered.mapInArrow(_compressor(shard_tokens), SHARD_SCHEMA).write.mode("overwrite").option("compression", "zstd").parquet(target)
    dropped(spark, held)


def _shards(spark, target: str) -> DataFrame:
    """The shards with ``begin``, the number of ids in all shards before."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(target)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))  # a row for each partition of the writer
    return shards.join(F.broadcast(starts), "part").withColumn("begin", F.col("part_start") + F.col("start_in_part")).drop("part_start")


def _grammar(row: dict) -> tuple[np.ndarray, Grammar]:
    width = row["width"].as_py()
    rules = _unpacked(row["rules"].as_buffer(), width).reshape(-1, 2)
    return _unpacked(row["symbols"].as_buffer(), width), Grammar(rules, row["vocabulary"].as_py(), np.frombuffer(row["expansions"].as_buffer(), "<u4"))


def read_tokens(spark, target: str, keep_ids: bool = False) -> DataFrame:
    """Decode the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), and with keep_ids the ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] * keep_ids)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                symbols, grammar = _grammar(row)
                ids = grammar.decode(symbols).astype("<u4")
                counts = row["doc_tokens"].values.to_numpy().astype(np.int64)
                ends = np.cumsum(counts)
                raw = memoryview(ids).cast("B")
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                rows = {"doc_id": row["doc_ids"].values, "start": row["begin"].as_py() + ends - counts, "n_tokens": counts, "ids_crc32": sums}
                if keep_ids:
                    rows["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield K.batches_of(rows, arrow)

    bounded_batches(spark)
    wanted = _shards(spark, target).select("begin", "vocabulary", "width", "symbols", "rules", "expansions", "doc_ids", "doc_tokens")
    return wanted.mapInArrow(read, schema)


def ids_at(spark, target: str, wanted: DataFrame, block: int = SHARD_TOKENS) -> DataFrame:
    """Random access: request, ids for each row of wanted (request, start, end), numbers of ids counted over the whole table.

    A request meets the shards that overlap it by an equal join on blocks of
    ids; in each only the symbols that hold its ids are decoded. A part of a
    range beyond the last id is empty; a range that holds no id, or a null
    start or end, gives no row.
    """
    shards = _shards(spark, target).withColumn("finish", F.col("begin") + F.col("n_tokens"))
    blocks = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / block), F.floor((F.col(b) - 1) / block))).alias("block")
    asked = wanted.filter("start is not null").select("request", F.greatest(F.col("start"), F.lit(0)).cast("long").alias("from"), F.col("end").cast("long").alias("upto")).filter("from < upto")
    places = shards.filter("n_tokens > 0").select("part", "shard", "begin", "finish", blocks("begin", "finish"))
    last = shards.agg(F.max("finish").alias("all"))
    asked = asked.crossJoin(F.broadcast(last)).withColumn("upto", F.least("upto", "all")).filter("from < upto").select("request", "from", "upto", blocks("from", "upto"))
    met = asked.join(places, "block").filter("from < finish and begin < upto").select("part", "shard", "request", "from", "upto").distinct()
    rows = met.join(shards.select("part", "shard", "begin", "n_tokens", "vocabulary", "width", "symbols", "rules", "expansions"), ["part", "shard"]).drop("part", "shard")
    kind = dict(wanted.dtypes)["request"]
    arrow = pa.schema([("begin", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, ids = [], []
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                symbols, grammar = _grammar(row)
                begin = row["begin"].as_py()
                ids.append(grammar.ids_between(symbols, max(0, row["from"].as_py() - begin), min(row["n_tokens"].as_py(), row["upto"].as_py() - begin)).astype(np.int32))
                begins.append(begin)
            yield pa.RecordBatch.from_arrays([batch.column("request"), *K.batches_of({"begin": begins, "ids": ids}, arrow).columns], names=["request", "begin", "ids"])

    pieces = rows.mapInArrow(cut, f"request {kind}, begin long, ids array<int>")
    return pieces.groupBy("request").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("begin", "ids"))), lambda x: x["ids"])).alias("ids"))


def token_files(docs: DataFrame, path: str | None = None, target: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the token files of docs (by default into a new scratch folder) and describe each document from what is read back; see write_tokens and read_tokens."""
    target = target or f"{scratch(docs.sparkSession)}/tokens"
    write_tokens(docs, target, path, end_id)
    return read_tokens(docs.sparkSession, target)
