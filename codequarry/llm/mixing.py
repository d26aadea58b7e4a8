"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent, normalised.
The exponent is bisected until the mixture meets a target entropy or until no
source repeats more often than a limit. The weights are then realised: each
source is permuted in blocks of about equal size and read, block after block
and as often as needed, until its token budget is used up. Everything is
DataFrame expressions; the only per-document state is a hash.

Where no counts are given, the tokenizer's tokens of each whole text are counted by
``bpe.Counter``, exactly. ``token_estimate`` with a model of ``fit_tokens`` is a cheaper
stand-in for callers that want one; ``mix`` doesn't use it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .bpe import Counter
from .common import bounded_batches, byte_size, free_name, scratch, sized_join, stored
from .tokens import tokenizer_path

BLOCK_TOKENS = 1 << 20
#: Exponents tried in one pass: five levels of bisection at once.
_LEVELS = 5


#: Passages that the model is fitted to, and their characters.
PASSAGES, PASSAGE_CHARS = 2048, 1024
#: By how many passages the common model counts against a source's own.
SHRINK = 4
#: What is counted in a text, in the order of a model's coefficients: pieces as byte-level tokenizers cut them, characters, bytes, digits, and capital letters.
_PIECE = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: The model without a fit: a quarter of the bytes.
QUARTER = (0.0, 0.0, 0.25, 0.0, 0.0)


def _counted(text: Column) -> list[Column]:
    return [F.regexp_count(text, F.lit(_PIECE)), F.length(text), F.octet_length(text), F.regexp_count(text, F.lit(r"\p{N}")), F.regexp_count(text, F.lit(r"\p{Lu}"))]


def token_estimate(text: Column, weights: tuple[float, ...] = QUARTER, factor: Column | float = 1.0) -> Column:
    """The tokens of a whole text by a model of ``fit_tokens``, 1 at least; 0 for an empty or null text."""
    total = sum((F.lit(w) * c for w, c in zip(weights, _counted(text), strict=True) if w), F.lit(0.0)) * (factor if isinstance(factor, Column) else F.lit(factor))
    return F.when(F.length(text) > 0, F.greatest(F.lit(1), F.round(total))).otherwise(0).cast("long")


def fit_tokens(docs: DataFrame, text_col: str = "text", source_col: str = "source", path: str | None = None, passages: int = PASSAGES, chars: int = PASSAGE_CHARS) -> tuple[tuple[float, ...], list[tuple[str | None, float]]]:
    """A model for ``token_estimate``: the weights of what ``_counted`` counts that come closest to the tokenizer's counts, none below 0, and a factor for each source that was met.

    Fitted by least squares, relative to each passage's length, on the driver,
    to about ``passages`` texts drawn by a hash of the text (twice as many at
    most), each with the ``chars`` characters at a hashed place. Texts alike are
    one. A source's factor is what its passages hold against their estimates,
    drawn towards 1 where they are few. Without any text the weights are a
    quarter of the bytes.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("t"), F.col(source_col).cast("string").alias("s")).filter(F.length("t") > 0).withColumn("mark", F.xxhash64("t", F.lit(41)))
    n = texts.count()
    if not n:
        return QUARTER, []
    spare = F.greatest(F.length("t") - chars, F.lit(0))
    drawn = texts.filter(F.pmod("mark", F.lit(1 << 30)) < max(1, int(min(1.0, passages / n) * (1 << 30))))
    piece = F.struct("s", F.substring("t", (F.pmod(F.xxhash64("mark"), spare + 1) + 1).cast("int"), F.lit(chars)).alias("p"))
    drawn = drawn.select("mark", piece.alias("r")).groupBy("mark").agg(F.min("r").alias("r")).orderBy("mark").limit(2 * passages).select("r.*")
    rows = drawn.select("s", "p", *(c.cast("double").alias(f"c{k}") for k, c in enumerate(_counted(F.col("p"))))).collect()
    if not rows:
        return QUARTER, []
    library = Tokenizer.from_file(path or tokenizer_path())
    library.no_truncation()
    true = np.array([len(library.encode(r["p"], add_special_tokens=False).ids) for r in rows], float)
    x = np.array([tuple(r)[2:] for r in rows])
    weights, used = np.array(QUARTER), list(range(x.shape[1]))
    while used:  # drop what would weigh less than nothing, the worst first
        scale = 1 / np.sqrt(np.maximum(x[:, 2], 1))
        w = np.linalg.lstsq(x[:, used] * scale[:, None], true * scale, rcond=None)[0]
        if (w >= 0).all() and w.any():
            weights = np.zeros(x.shape[1])
            weights[used] = w
            break
        used.pop(int(w.argmin()))
    told = x @ weights
    common = SHRINK * true.mean()
    sums: dict[str | None, list[float]] = {}
    for r, a, b in zip(rows, true, told, strict=True):
        held = sums.setdefault(r["s"], [common, common])
        held[0] += a
        held[1] += b
    return tuple(map(float, weights)), [(s, float(a / b)) for s, (a, b) in sorted(sums.items(), key=lambda kv: (kv[0] is not None, kv[0]))]


def _with_total(rows: DataFrame, name: str, total: Column) -> DataFrame:
    """rows with an aggregate of all of them as a column, by way of a table of one row."""
    return rows.crossJoin(F.broadcast(rows.agg(total.alias(name))))


def source_shares(docs: DataFrame, tokens: Column, source_col: str = "source") -> DataFrame:
    """mix_source (null is a source of its own), tokens, share."""
    totals = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("docs")).filter("tokens > 0")
    totals = stored(totals, f"{scratch(docs.sparkSession)}/totals")
    return _with_total(totals, "all", F.sum("tokens")).withColumn("share", F.col("tokens") / F.col("all")).drop("all")


def _measured(shares: DataFrame, exponents: list[float]) -> DataFrame:
    """exponent, entropy (nats), repeats: what mixtures at these exponents give; repeats is the most epochs of any source when the least repeated one is read once."""
    grid = shares.withColumn("exponent", F.explode(F.array(*map(F.lit, exponents))))
    grid = grid.withColumns({"p": F.exp(F.col("exponent") * F.log("share")), "logp": F.col("exponent") * F.log("share")})
    sums = grid.groupBy("exponent").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.col("logp")).alias("pl"), F.max(F.col("logp") - F.log("share")).alias("hi"), F.min(F.col("logp") - F.log("share")).alias("lo"))
    return sums.select("exponent", (F.log("z") - F.col("pl") / F.col("z")).alias("entropy"), F.exp(F.col("hi") - F.col("lo")).alias("repeats"))


def fit_exponent(shares: DataFrame, entropy: float | None = None, max_repeats: float | None = None, passes: int = 6) -> float:
    """The greatest exponent in 0..1 with at least ``entropy`` (a share of the greatest possible), raised where needed until no source repeats more than ``max_repeats`` times.

    Both measures fall as the exponent rises, so each is bisected: a pass
    measures 2**5 - 1 exponents in one aggregation and keeps the interval of
    the crossing. With neither target the exponent is 1.
    """

    def bisect(good) -> float:
        """The greatest exponent of a range that begins good, or the least of one that ends so."""
        low, high = 0.0, 1.0
        for _ in range(passes):
            steps = 1 << _LEVELS
            tried = [low + (high - low) * k / steps for k in range(1, steps)]
            seen = {r["exponent"]: good(r) for r in _measured(shares, tried).collect()}
            inside = [x for x in tried if seen.get(x)]
            outside = [x for x in tried if not seen.get(x)]
            low, high = max(inside, default=low), min(outside, default=high)
        return low

    n = shares.count()
    if n < 2:
        return 1.0
    exponent = 1.0
    if entropy is not None:
        target = entropy * math.log(n)
        at_one = _measured(shares, [1.0]).first()
        exponent = 1.0 if at_one["entropy"] >= target else bisect(lambda r: r["entropy"] >= target)
    if max_repeats is not None and _measured(shares, [exponent]).first()["repeats"] > max_repeats:
        low, high = exponent, 1.0
        for _ in range(passes):
            steps = 1 << _LEVELS
            tried = [low + (high - low) * k / steps for k in range(1, steps)]
            seen = {r["exponent"]: r["repeats"] <= max_repeats for r in _measured(shares, tried).collect()}
            low, high = max((x for x in tried if not seen.get(x)), default=low), min((x for x in tried if seen.get(x)), default=high)
        exponent = high
    return exponent


def plan(docs: DataFrame, tokens: Column, source_col: str = "source", entropy: float | None = 0.95, max_repeats: float | None = 2.0, token_budget: int | None = None) -> DataFrame:
    """mix_source, tokens, docs, share, weight, budget (tokens to read), exponent.

    Without a budget the mixture is the smallest that reads every source once
    in full, so that no document is lost.
    """
    shares = stored(source_shares(docs, tokens, source_col), f"{scratch(docs.sparkSession)}/shares")
    exponent = fit_exponent(shares, entropy, max_repeats)
    raw = _with_total(shares.withColumn("raw", F.exp(F.lit(exponent) * F.log("share"))), "sum", F.sum("raw"))
    weights = stored(raw.withColumn("weight", F.col("raw") / F.col("sum")), f"{scratch(docs.sparkSession)}/weights")
    weights = _with_total(weights, "least", F.max(F.col("tokens") / F.col("weight")))
    total = F.lit(token_budget).cast("double") if token_budget is not None else F.col("least")
    return weights.select("mix_source", "tokens", "docs", "share", "weight", F.round(F.col("weight") * total).cast("long").alias("budget"), F.lit(exponent).alias("exponent"))


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None, entropy: float | None = 0.95, max_repeats: float | None = 2.0, token_budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 17, with_tokens: bool = True) -> DataFrame:
    """docs, a row for each reading, with mix_source, mix_tokens, mix_weight, mix_epoch (from 0), mix_block and mix_key; columns of these names are replaced.

    Tokens are those of ``tokens_col``, or else the exact counts of all whole
    texts; without ``with_tokens`` these decide as well, but mix_tokens isn't
    returned, which saves a join of the texts.

    Sorting by (mix_block, mix_key) gives the mixture: blocks of all sources in
    random order, each with its documents in random order. A source's whole
    epochs are complete; the rest of its budget goes to its first blocks in the
    permutation and, in the block where it ends, to documents in key order
    until it is used up. A document is not cut, so a source may exceed its
    budget by less than the last document. Rows alike in id and text share a
    key and are read equally often. Documents without tokens (null or empty
    text) are read once. An empty table stays empty.
    """
    names = ("mix_source", "mix_tokens", "mix_weight", "mix_epoch", "mix_block", "mix_key")
    docs = docs.drop(*names)
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = scratch(spark)
    # Names of its own, whatever columns docs has: source, tokens and key of a document; block, rank and slice of its block.
    pre = free_name(docs.columns, "_mix_")
    src, tok, key, block, rank, part = (f"{pre}{x}" for x in ("source", "tokens", "key", "block", "rank", "slice"))
    col = lambda name: F.col(f"{pre}{name}")
    # Null has a name of its own here, as keys that are null don't join.
    name = lambda c: F.concat_ws("", F.when(c.isNull(), F.lit("n")).otherwise(F.lit("s")), c.cast("string"))
    dealt = docs.withColumns({src: name(F.col(source_col)), key: F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))})
    if tokens_col:
        dealt = dealt.withColumn(tok, F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)))
    else:
        told = Counter(spark).counts(dealt.select(key, F.col(text_col)), key, text_col).withColumnRenamed("n", tok)
        told = F.broadcast(told) if byte_size(told) <= 48 << 20 else told
    count = lambda rows: rows if tokens_col else rows.join(told, key, "left").withColumn(tok, F.coalesce(F.col(tok), F.lit(0)))
    counted = stored(count(dealt.select(F.col(source_col).alias("source"), src, key, *([tok] if tokens_col else []))), f"{folder}/counted")  # without texts
    sources = plan(counted, F.col(tok), "source", entropy, max_repeats, token_budget)
    sources = sources.select(name(F.col("mix_source")).alias(src), F.col("tokens").alias(f"{pre}all"), F.col("weight").alias(f"{pre}weight"), F.col("budget").alias(f"{pre}budget"), F.floor(F.col("budget") / F.col("tokens")).alias(f"{pre}full"), F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long").alias(f"{pre}blocks"))
    sources = stored(sources.withColumn(f"{pre}rest", col("budget") - col("full") * col("all")), f"{folder}/sources")

    block_of = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), col("blocks"))
    narrow = sized_join(counted.select(src, tok, key), sources.select(src, f"{pre}blocks", f"{pre}rest"), [src], "inner", salt=F.col(key)).withColumn(block, block_of)
    ranked = F.xxhash64(F.lit(seed + 2), F.col(src), F.col(block))
    blocks = narrow.groupBy(src, block).agg(F.sum(tok).alias(f"{pre}t"), F.max(f"{pre}rest").alias(f"{pre}rest")).withColumn(rank, ranked)
    # Tokens of a source's blocks before each one, in the order of rank: by slices of ranks first, so that no task gets all blocks of a source.
    blocks = stored(blocks.withColumn(part, F.shiftright(rank, 54)), f"{folder}/blocks")
    upto = lambda *keys: Window.partitionBy(*keys)
    slices = blocks.groupBy(src, part).agg(F.sum(f"{pre}t").alias(f"{pre}s"))
    slices = slices.select(src, part, (F.sum(f"{pre}s").over(upto(src).orderBy(part).rowsBetween(Window.unboundedPreceding, 0)) - col("s")).alias(f"{pre}earlier"))
    inside = upto(src, part).orderBy(rank, block).rowsBetween(Window.unboundedPreceding, 0)
    before = blocks.withColumn(f"{pre}inside", F.sum(f"{pre}t").over(inside) - col("t")).join(slices, [src, part])
    before = before.withColumn(f"{pre}before", col("inside") + col("earlier"))
    last = before.filter((col("before") < col("rest")) & (col("before") + col("t") >= col("rest")))
    last = stored(last.select(src, F.col(block).alias(f"{pre}cut_block"), F.col(rank).alias(f"{pre}cut_rank"), (col("rest") - col("before")).alias(f"{pre}left")), f"{folder}/last")
    # Within the block where a source's budget ends: the key up to which documents fit.
    ended = sized_join(narrow.select(src, block, key, tok), last.select(src, col("cut_block").alias(block), f"{pre}left"), [src, block], "inner", salt=F.col(key))
    by_key = ended.groupBy(src, key).agg(F.sum(tok).alias(f"{pre}t"), F.max(f"{pre}left").alias(f"{pre}left"))
    through = upto(src).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    fits = by_key.withColumn(f"{pre}before", F.sum(f"{pre}t").over(through) - col("t")).filter(col("before") < col("left"))
    cut = fits.groupBy(src).agg(F.max(key).alias(f"{pre}cut_key"))
    rules = stored(sources.select(src, f"{pre}weight", f"{pre}full", f"{pre}blocks").join(last.drop(f"{pre}left"), src, "left").join(cut, src, "left"), f"{folder}/rules")

    ready = sized_join(dealt, rules, [src], "left", salt=F.col(key)).withColumn(block, F.coalesce(block_of, F.lit(0)))
    once_more = (ranked < col("cut_rank")) | ((F.col(block) == col("cut_block")) & (F.col(key) <= col("cut_key")))
    empty = F.col(tok) == 0 if tokens_col else F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)) == 0
    reads = F.when(col("full").isNull() | empty, F.lit(1)).otherwise(col("full") + F.when(once_more, 1).otherwise(0)).cast("int")
    ready = count(ready) if with_tokens else ready
    out = ready.withColumn(f"{pre}reads", reads).filter(col("reads") > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), col("reads") - 1)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(source_col).cast("string").alias("mix_source"), *([F.col(tok).alias("mix_tokens")] if with_tokens else []), col("weight").alias("mix_weight"), "mix_epoch", F.xxhash64(F.lit(seed + 3), F.col("mix_epoch"), F.col(src), F.col(block)).alias("mix_block"), F.xxhash64(F.lit(seed + 4), F.col("mix_epoch"), F.col(key)).alias("mix_key"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixture's order: doc_id, source, tokens (exact, or those of ``tokens_col``), weight, epoch, block, key, sorted by (block, key); see ``mix``."""
    mixed = mix(docs, **options)
    out = mixed.select(F.col(options.get("id_col", "doc_id")).alias("doc_id"), F.col("mix_source").alias("source"), F.col("mix_tokens").alias("tokens"), F.col("mix_weight").alias("weight"), F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_key").alias("key"))
    return out.orderBy("block", "key", "doc_id")
