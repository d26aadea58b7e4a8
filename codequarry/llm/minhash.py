"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles gives ``CHUNKS * PER_CHUNK`` min-hashes of
which 16 bits are kept. Two signatures that differ in at most
``2 * CHUNKS - 1`` symbols have, by the pigeonhole principle, a chunk with at
most one differing symbol. Each signature is therefore indexed under every
chunk with each one of its symbols left out (the allowed chunk errors), and all
pairs under the distance threshold meet under some key. So do most pairs beyond
it: what counts is one chunk with at most one difference, and at a similarity
of 0.8 a pair of sets has none with a probability of 1.2e-9, at 0.85 of 3e-12.

Documents with equal sets are one class from the start. Keys under which many
classes meet never emit all their pairs: first every class is compared with the
key's most central class (that which meets most others); what this leaves in
several components is compared in tiles of bounded size, by exact set
intersections, of which only spanning links leave the task. Tiles hold sets of
like sizes; those whose sizes rule a link out, or that lie in one component,
are not compared. All links are confirmed on the full sets.

Classes have numbers, not hashes, so that no two share one. Keys under which a
large share of all classes meet are joined by broadcast, there being few of
them by their definition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import bounded_batches, scratch, sized_join, stored

CHUNKS, PER_CHUNK = 12, 4
#: Pairs that met and differ in more symbols aren't compared on their sets: at a similarity of 0.8 that is one pair in 3e12.
HOPELESS = 32
#: Classes of a tile at most, and shingles in its sets; a tile holds ``LEAST_TILE`` sets at least.
TILE, TILE_SHINGLES, LEAST_TILE = 1024, 1 << 20, 16
#: A key is hot with so many rows, or more in very large tables: never more than a million keys are.
HOT, MOST_HOT = 512, 1_000_000
_LANES = [0xFFFF << (16 * v) for v in range(PER_CHUNK)]
_SIGNATURE = [f"s{c}" for c in range(CHUNKS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _set_parts(data: np.ndarray, bounds: np.ndarray, width: int):
    """For each text of a slice its sorted distinct shingle hashes; also all shingle hashes and where each text's begin."""
    words, first = K.spaced_words(data, bounds)
    hashes, begin = K.shingle_hashes(words, first, width)
    sets = []
    for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        part = np.sort(hashes[x:y])
        sets.append(part[np.concatenate([[True], part[1:] != part[:-1]])] if y - x > 1 else part)
    return sets, hashes, begin


def _set_names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the sets and two 64-bit sums that name a set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([*sets, np.zeros(1, np.uint64)])
    at = np.concatenate([[0], np.cumsum(sizes)])
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat)])
    mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix64(flat + np.uint64(77)))])
    return sizes, (run[at[1:]] - run[at[:-1]]).view(np.int64), (mixed[at[1:]] - mixed[at[:-1]]).view(np.int64)


def _sketcher(width: int, schema: pa.Schema):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.enter("minhash")
        n = CHUNKS * PER_CHUNK
        factor = (K.random64(n, 5) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        shift = (K.random64(n, 6) >> np.uint64(32)).astype(np.uint32)
        with np.errstate(over="ignore"):
            for batch in batches:
                for start, end, data, bounds in K.text_slices(batch.column(1)):
                    sets, hashes, begin = _set_parts(data, bounds, width)
                    sizes, high, low = _set_names(sets)
                    some = np.flatnonzero(sizes)
                    top = (hashes >> np.uint64(32)).astype(np.uint32)
                    chunks = np.zeros((CHUNKS, end - start), np.uint64)
                    for j in range(n):
                        least = np.minimum.reduceat((top + shift[j]) * factor[j], begin[some]) if len(some) else np.zeros(0, np.uint32)
                        symbol = ((least ^ (least >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(16)
                        chunks[j // PER_CHUNK, some] |= symbol.astype(np.uint64) << np.uint64(16 * (j % PER_CHUNK))
                    rows = {"doc_id": batch.column(0).slice(start, end - start), "n_shingles": sizes, "high": high, "low": low}
                    rows |= {name: batch.column(k).slice(start, end - start) for k, name in enumerate(batch.schema.names[2:], 2)}
                    yield K.batches_of(rows | {f"s{c}": chunks[c].view(np.int64) for c in range(CHUNKS)}, schema)

    return sketch


def _setter(width: int, schema: pa.Schema):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.enter("minhash")
        with np.errstate(over="ignore"):
            for batch in batches:
                for start, end, data, bounds in K.text_slices(batch.column(1)):
                    sets, _, _ = _set_parts(data, bounds, width)
                    sizes, high, low = _set_names(sets)
                    rows = {"rep": batch.column(0).slice(start, end - start), "n": sizes, "high": high, "low": low}
                    yield K.batches_of(rows | {"members": pa.array([s.tobytes() for s in sets], pa.binary())}, schema)

    return build


def _as_set(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint64)


def _linked(shared, union, percent: int):
    return 100 * shared >= percent * union


def _checker(percent: int, schema: pa.Schema):
    """Of pairs with both sets, those that are linked."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                a, b = _as_set(x.as_buffer()), _as_set(y.as_buffer())
                shared = 0
                if _linked(min(len(a), len(b)), max(len(a), len(b)), percent):
                    both = np.concatenate([a, b])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared > 0 and _linked(shared, len(a) + len(b) - shared, percent))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("u"), kept.column("v")], schema=schema)

    return check


def _tile_links(percent: int, schema: pa.Schema):
    """Links between components among the classes of one or two tiles: a spanning set of them, no more than there are classes."""

    def links(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        reps, comps = table["rep"].to_numpy(), table["comp"].to_numpy()
        sets = [_as_set(x.as_buffer()) for x in table["members"]]
        n = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), n)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]])
        number = np.cumsum(new) - 1
        common = np.bincount(number)[number] > 1
        column = np.cumsum(new & common)[common] - 1
        owner = owner[common]
        shared = np.zeros((len(sets), len(sets)), np.float32)
        width = max(1024, (1 << 22) // max(1, len(sets)))
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            x, y = np.searchsorted(column, [at, at + width])
            dense = np.zeros((len(sets), width), np.float32)
            dense[owner[x:y], column[x:y] - at] = 1
            shared += dense @ dense.T
        shared = shared.astype(np.int64)
        ok = _linked(shared, n[:, None] + n[None, :] - shared, percent) & (shared > 0) & (comps[:, None] != comps[None, :])
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while (p := parent.get(v, v)) != v:
                parent[v] = parent.get(p, p)
                v = p
            return v

        found = []
        for i, j in zip(*(v.tolist() for v in np.nonzero(np.triu(ok, 1))), strict=True):
            a, b = root(int(comps[i])), root(int(comps[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((int(reps[i]), int(reps[j])))
        return pa.table({"u": pa.array([f[0] for f in found], pa.int64()), "v": pa.array([f[1] for f in found], pa.int64())}, schema=schema)

    return links


def _hot(counts: DataFrame, n: str = "n") -> DataFrame:
    """The keys of ``counts`` (key, n) that are hot, MOST_HOT at most."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    return counts.filter(F.col(n) > max(HOT, total // MOST_HOT)).select("key")


def _joined(left: DataFrame, right: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Join on key; ``right`` is unique in it. Rows of hot keys meet theirs by broadcast, so that none of them lands in one task."""
    if hot is None:
        return left.join(right, "key")
    cold = left.join(F.broadcast(hot), "key", "left_anti").join(right, "key")
    return cold.unionByName(left.join(F.broadcast(right.join(F.broadcast(hot), "key", "left_semi")), "key"))


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, comp): for every node of the undirected edges (u, v) the smallest node it is connected with.

    Each round points every node at its smallest neighbour, follows the
    pointers to their ends by doubling, and contracts the edges; nothing is
    collected to the driver but counts.
    """
    edges = stored(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{folder}/edges")
    labels, turn = None, 0
    while not edges.isEmpty():
        turn += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        point = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")).select(F.col("u").alias("node"), "p"), f"{folder}/point{turn}")
        step = 0
        while True:
            ends = point.select(F.col("node").alias("p"), F.col("p").alias("q"))
            longer = point.join(ends, "p", "left").select("node", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved"))
            step += 1
            longer = stored(longer, f"{folder}/point{turn}_{step}")
            moved = longer.filter("moved").limit(1).count()
            point = longer.select("node", "p")
            if not moved:
                break
        to = lambda c: point.select(F.col("node").alias(c), F.col("p").alias(f"p{c}"))
        edges = stored(edges.join(to("u"), "u").join(to("v"), "v").filter("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), f"{folder}/edges{turn}")
        if labels is None:
            labels = point
        else:
            later = point.select(F.col("node").alias("p"), F.col("p").alias("q"))
            labels = labels.join(later, "p", "left").select("node", F.coalesce("q", "p").alias("p"))
        labels = stored(labels, f"{folder}/labels{turn}")
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return labels.select("node", F.col("p").alias("comp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, by_row: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Documents are linked whose sets of ``width``-word shingles have
    100 * intersection >= percent * union. Words are runs of bytes other than
    ASCII white space, with A-Z lowered; a text with fewer words, but not none,
    has one shingle. A null or empty text, or one without words, has an empty
    set and is linked with nothing. Rows that repeat a doc_id are documents of
    their own with the same id. A row without an id takes no part: its
    component is null and it is kept. Other columns are ignored.

    With ``by_row`` also text_hash (xxhash64 of the text) and component, a
    number that tells groups apart where a repeated id is the smallest of
    several; an empty set's is its text_hash.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = scratch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    more = ["text_hash"] if by_row else []
    fields = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), *((m, pa.int64()) for m in more), *((s, pa.int64()) for s in _SIGNATURE)]
    sketches = docs.select("*", *(F.xxhash64("text").alias(m) for m in more)).mapInArrow(_sketcher(width, pa.schema(fields)), ", ".join(f"{n} long" for n, _ in fields))
    sketches = stored(sketches, f"{folder}/sketches")

    # Equal sets are one class, whose smallest document stands for it. One document may hold several where its id is repeated.
    named = ["high", "low", "n_shingles"]
    classes = sketches.filter("doc_id is not null and n_shingles > 0").groupBy(*named).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *(F.min(s).alias(s) for s in _SIGNATURE))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), f"{folder}/classes")

    keys = classes.select("cls", F.explode(F.array(*(F.xxhash64(F.lit(PER_CHUNK * c + v), F.col(f"s{c}").bitwiseAND(F.lit(_signed(~_LANES[v] & (1 << 64) - 1)))) for c in range(CHUNKS) for v in range(PER_CHUNK)))).alias("key"))
    met = stored(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), f"{folder}/met")
    hot = _hot(met)
    hot = None if hot.isEmpty() else stored(hot, f"{folder}/hot")
    members = stored(_joined(keys, met, hot).select("key", "cls", "n"), f"{folder}/members")
    central = members.groupBy("cls").agg(F.sum(F.col("n") - 1).alias("met"))
    ranked = members.join(central, "cls")
    leader = ranked.groupBy("key").agg(F.max(F.struct("met", "cls"))["cls"].alias("lead"))
    leader = stored(leader, f"{folder}/leaders") if hot is not None else leader
    star = stored(_joined(members, leader, hot).select("key", "cls", "lead", "n"), f"{folder}/star")

    # The full sets of all classes that meet others.
    wanted = members.select("cls").distinct().join(classes.select("cls", "rep", *named), "cls")
    wanted = stored(wanted, f"{folder}/wanted")
    some = wanted.count()
    set_fields = [("rep", pa.int64()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("members", pa.binary())]
    ids = wanted.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.join(F.broadcast(ids) if some <= 1_000_000 else ids, "doc_id", "left_semi")
    sets = texts.mapInArrow(_setter(width, pa.schema(set_fields)), "rep long, n long, high long, low long, members binary")
    sets = sets.join(F.broadcast(wanted.drop("rep")) if some <= 500_000 else wanted.drop("rep"), [sets.high == wanted.high, sets.low == wanted.low, sets.n == wanted.n_shingles]).select("cls", "members")
    sets = stored(sets.dropDuplicates(["cls"]), f"{folder}/sets")

    pairs = star.filter("cls <> lead").select("cls", "lead").distinct()
    one = classes.select("cls", *(F.col(s).alias(f"a{s}") for s in _SIGNATURE))
    two = classes.select(F.col("cls").alias("lead"), *(F.col(s).alias(f"b{s}") for s in _SIGNATURE))
    lanes = [F.when(F.col(f"a{s}").bitwiseXOR(F.col(f"b{s}")).bitwiseAND(F.lit(_signed(m))) != 0, 1).otherwise(0) for s in _SIGNATURE for m in _LANES]
    near = pairs.join(one, "cls").join(two, "lead").filter(sum(lanes[1:], lanes[0]) <= HOPELESS).select(F.col("cls").alias("u"), F.col("lead").alias("v"))
    link_schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    with_sets = near.join(sets.select(F.col("cls").alias("u"), F.col("members").alias("x")), "u").join(sets.select(F.col("cls").alias("v"), F.col("members").alias("y")), "v")
    links = stored(with_sets.mapInArrow(_checker(percent, link_schema), "u long, v long"), f"{folder}/links")
    reached = components(links, f"{folder}/cc1")

    # What a key holds beyond its star: classes of several components, compared in tiles.
    comp_of = lambda df: df.join(reached.select(F.col("node").alias("cls"), "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    open_star = comp_of(star.filter("n > 2"))
    open_star = open_star.filter("cls <> lead")
    several = stored(open_star.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("key"), f"{folder}/several")
    group = _joined(open_star, several, hot).select("lead", "cls", "comp").distinct()
    # Linked sets differ in size by no more than 100 / percent, so they are in one band or in neighbouring ones.
    step = 1.001 * float(np.log(100 / percent)) if percent < 100 else 0.001
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / step)
    group = stored(group.join(wanted.select("cls", "n_shingles"), "cls").withColumn("band", band), f"{folder}/groups")
    room = F.greatest(F.lit(min(TILE, LEAST_TILE)), F.least(F.lit(TILE), F.floor(TILE_SHINGLES / F.exp((F.col("band") + 1) * step)))).cast("long")
    by_comp = stored(group.groupBy("lead", "comp", "band").agg(F.count("*").alias("size")).withColumn("room", room), f"{folder}/sizes")
    small = by_comp.filter("size < room").groupBy("lead", "band").agg(F.ceil(F.sum("size") / F.max("room")).alias("tiles"))
    placed = by_comp.join(small, ["lead", "band"], "left")
    tiled = sized_join(group, stored(placed, f"{folder}/placed"), ["lead", "comp", "band"], "inner", salt=F.col("cls"))
    none = F.lit(None).cast("long")
    own = F.when(F.col("size") >= F.col("room"), F.struct("band", F.col("comp").alias("of"), F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / F.col("room"))).alias("part"))).otherwise(F.struct("band", none.alias("of"), F.pmod(F.xxhash64("comp"), F.col("tiles")).alias("part")))
    tiled = stored(tiled.select("lead", "cls", "comp", own.alias("tile")), f"{folder}/tiles")
    tiles = tiled.select("lead", "tile").distinct()
    other = tiles.select("lead", F.col("tile").alias("other"))
    meet = tiles.join(other, "lead").filter("tile <= other and other.band - tile.band <= 1 and (tile.of is null or other.of is null or tile.of <> other.of)").withColumn("of_pair", F.struct("lead", "tile", "other"))
    sides = meet.select("lead", "tile", "of_pair").unionByName(meet.filter("tile <> other").select("lead", F.col("other").alias("tile"), "of_pair"))
    pair = [F.col("of_pair.lead").alias("lead"), *(F.col(f"of_pair.{side}.{field}").alias(f"{side}_{field}") for side in ("tile", "other") for field in ("band", "of", "part"))]
    tasks = tiled.join(sides, ["lead", "tile"]).join(sets, "cls").select(*pair, F.col("cls").alias("rep"), "comp", "members")
    late = stored(tasks.groupBy("lead", *(f"{side}_{field}" for side in ("tile", "other") for field in ("band", "of", "part"))).applyInArrow(_tile_links(percent, link_schema), "u long, v long"), f"{folder}/late")
    if not late.isEmpty():
        reached = components(links.unionByName(late), f"{folder}/cc2")

    # The smallest document of each component, for the classes that are not one lone document.
    whole = classes.select("cls", "rep", "copies", *named).join(reached.select(F.col("node").alias("cls"), "comp"), "cls", "left").filter("comp is not null or copies > 1").withColumn("comp", F.coalesce("comp", "cls"))
    whole = stored(whole, f"{folder}/whole")
    least = whole.groupBy("comp").agg(F.min("rep").alias("component_id"))
    found = stored(whole.join(least, "comp").select(*named, "component_id", *(["comp"] if by_row else [])), f"{folder}/found")
    out = sized_join(sketches.select("doc_id", *named, *more), found, named, salt=F.col("doc_id"))
    if by_row:
        more += [F.when(F.col("n_shingles") == 0, F.col("text_hash")).otherwise(F.coalesce("comp", F.xxhash64(*named))).alias("component")]
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), *more)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
