"""Language identification by compression.

Each learned language has a zstandard raw-content dictionary made of a bounded
sample of its labelled texts. A text is cut into blocks, every block is
compressed with every dictionary, and the language whose dictionary gives the
smallest total wins; a narrow margin to the second is a rejection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import kernels as K
from .common import bounded_batches

UNKNOWN = "und"
#: Bytes of a language's dictionary, and characters of the piece that a drawn text gives to it.
DICTIONARY_BYTES = 64 << 10
PIECE_CHARS = 512
BLOCK_BYTES = 8 << 10
#: Least lead over the second language, as a share of its size. The smallest tried with which no gibberish or made-up Finnish text of 3 kB or more is kept; see the README for what it costs on labelled rows.
MIN_MARGIN = 0.015


def labelled_sample(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", dictionary_bytes: int = DICTIONARY_BYTES, piece_chars: int = PIECE_CHARS) -> dict[str, tuple[int, bytes]]:
    """The number of labelled texts and raw dictionary content of each language with any.

    Of each language about ``4 * dictionary_bytes / piece_chars`` texts are
    drawn by a hash of id and text, of all together twice as many at most. A
    language that this leaves without any gets those with the least hashes. A
    drawn text gives the piece of ``piece_chars`` characters at a hashed place
    of it (a shorter text all of it), equal texts of one id once. Pieces fill
    the dictionary in the order of the hash. This bounds what reaches the
    driver by the number of languages.
    """
    bounded_batches(docs.sparkSession)
    draws = 1 << 30
    per = max(1, 4 * dictionary_bytes // piece_chars)
    rows = docs.filter(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("id"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return {}
    spare = F.greatest(F.length("text") - piece_chars, F.lit(0))
    piece = F.substring("text", (F.pmod(F.xxhash64("draw"), spare + 1) + 1).cast("int"), F.lit(piece_chars)).alias("piece")
    rows = rows.withColumn("draw", F.xxhash64("id", "text", F.lit(7)))
    share = rows.sparkSession.createDataFrame([(lang, int(min(1.0, per / n) * draws)) for lang, n in counts.items()], "lang string, upto long")
    few = rows.join(F.broadcast(share), "lang").filter(F.pmod("draw", F.lit(draws)) < F.col("upto")).select("lang", "draw", piece).distinct()
    drawn = few.orderBy("draw", "lang").limit(2 * per * len(counts)).collect()
    for lang in set(counts) - {r["lang"] for r in drawn}:
        drawn += rows.filter(F.col("lang") == lang).select("lang", "draw", piece).orderBy("draw").limit(per).collect()
    pieces: dict[str, dict[str, None]] = {lang: {} for lang in counts}
    for r in drawn:
        pieces[r["lang"]].setdefault(r["piece"])
    found = {}
    for lang, n in sorted(counts.items()):
        content, held = b"", (p.encode(errors="replace") + b"\n" for p in pieces[lang])
        while len(content) < dictionary_bytes and (more := next(held, None)):
            content += more
        found[lang] = (n, content[:dictionary_bytes])
    return found


class Classifier:
    """A compressor for each language, those with most labelled texts first, which wins ties."""

    def __init__(self, content: dict[str, tuple[int, bytes]]) -> None:
        import zstandard as z

        self.langs = sorted(content, key=lambda k: (-content[k][0], k))
        p = z.ZstdCompressionParameters(window_log=18, chain_log=16, hash_log=16, search_log=4, min_match=3, strategy=z.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.codecs = []
        for lang in self.langs:
            d = z.ZstdCompressionDict(content[lang][1], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            self.codecs.append(z.ZstdCompressor(dict_data=d, compression_params=p))

    def sizes(self, text: bytes, block: int = BLOCK_BYTES) -> list[int]:
        """Compressed bytes of the whole text, block by block, for each language."""
        parts = [text[i : i + block] for i in range(0, len(text), block)] if len(text) > block else [text]
        return [sum(len(c.compress(p)) for p in parts) for c in self.codecs]


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text[64:]))


def classify(docs: DataFrame, content: dict[str, tuple[int, bytes]], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs with lang_pred, score, lang_margin and lang_rejected; columns of these names are replaced.

    lang_pred is the language of the smallest compressed size, ties going to
    the language with most labelled texts, or ``und`` where the text is null or has no
    letter, or nothing was learned. score is 1 / (1 + 2 ** -bits), bits being
    8 times the margin in bytes capped at 64: 0.5 at a tie, near 1 beyond a few
    bytes, 0 for ``und``. lang_margin is the margin over the second size.
    Rejected is ``und``, or a tie with the second or a lang_margin under
    ``min_margin``; with one language learned nothing else is rejected.
    """
    fields = ("lang_pred", "score", "lang_margin", "lang_rejected")
    docs = docs.drop(*fields)
    bounded_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.enter("language")
        classifier = Classifier(shared.value)
        n = len(classifier.langs)
        for batch in batches:
            langs, scores, margins, rejected = [], [], [], []
            for text in batch.column(at):
                text = text.as_py()
                if text is None or not n or not _has_letter(text):
                    langs.append(UNKNOWN), scores.append(0.0), margins.append(0.0), rejected.append(True)
                    continue
                sizes = classifier.sizes(text.encode(errors="replace"))
                order = sorted(range(n), key=sizes.__getitem__)
                lead = sizes[order[1]] - sizes[order[0]] if n > 1 else 8
                margin = lead / sizes[order[1]] if n > 1 else 1.0
                langs.append(classifier.langs[order[0]])
                scores.append(1 / (1 + 2.0 ** -min(64, 8 * lead)))
                margins.append(margin)
                rejected.append(lead <= 0 or margin < min_margin)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(rejected, pa.bool_())], names=[*names, *fields])

    schema = StructType(list(docs.schema.fields))
    for name, kind in zip(fields, ("string", "double", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return docs.mapInArrow(predict, schema)


def fold_of(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, lang_rejected for every row of docs; learned from the rows that are not held out.

    Held out are the documents whose crc32(doc_id as text) modulo 5 is 0. A row
    without an id is held out.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    held = F.coalesce(fold_of() == 0, F.lit(True))
    content = labelled_sample(docs.filter(~held))
    return classify(docs.select("doc_id", held.alias("held_out"), "text"), content).select("doc_id", "held_out", "lang_pred", "score", "lang_rejected")
