"""Links inside regions of a metric space, by pivots.

``members`` lists which items lie in which cell; every pair of items that may be within ``theta`` shares a
cell.  ``link_cells`` returns links (pairs within ``theta``) that have the same connected components as
all links together, without comparing all pairs of a cell:

* cells that overlap, in chains, form a cluster.  A cluster of at most ``block`` items is compared
  directly, but for items already linked by a chain;
* in a larger cluster every item is first measured against one pivot of its cells, a few times over, which
  joins the dense parts.  Then its cells are taken one by one.  Small ones are compared directly.  In a
  larger one up to ``pivots`` items become pivots, and every item is measured against them.  Items within
  theta of their nearest pivot form its region; they are linked through it.  By the triangle inequality an
  item's partner lies within 2 theta of that pivot, so the region's next cell is the region and its window
  (theta, 2 theta]; everything in no region stays in the remaining cell.  Pivots are done: they have met
  everything.  The cells that arise are handled in the next round in the same way;
* where sketches bound distances from below, there are no clusters, and cells are worked on by bounds alone: those of
  up to ``DIRECT * WIDE`` blocks in one round, chunk by chunk.  Larger ones are measured against one pivot first and
  take a share of their items as pivots then, so that rounds grow
  with the logarithm of a cell; a window is what the bounds leave
  within 2 theta, and a region, which hangs together, meets its window once and is then done.  Pairs that the
  bounds leave within theta are collected over all cells and measured; where a block has over ``DENSE`` of them an
  item, those that hang together are collected as one part (a row an item, not a row a pair), and the items
  of a part, or of parts that overlap, meet each other;
* items of one component need no comparison among themselves: a cell of one component is closed, and
  pivots are picked outside a cell's largest component, so that region needs none.

Items meet in blocks of bounded size: a small cluster, the pivots of a cell and about ``block`` of its
other items, or two chunks of a group of possible links.  An item's payload (its set, its line) is shipped
once per block.  Every aggregate has a fixed
number of values per cell and combines before its shuffle; rounds are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import map_rows
from pairlab.llm.components import components, merged, stars
from pairlab.session import discard, materialize

SMALL, PIVOTS, BLOCK, BLOCK_WEIGHT, STARS = 16, 24, 256, 1 << 22, 3
MEMBER, PIVOT, REGION = 1, 2, 4
#: Where only sketches meet, a block holds WIDE times as many items; cells of up to DIRECT such blocks are compared
#: directly; of larger ones one item in SHARE is a pivot.
WIDE, DIRECT, SHARE = 4, 4, 16
#: Possible links an item, in a block, beyond which the block lists items and not pairs.
DENSE = 4
#: What sketches leave: a possible link, a member of a pivot's window, an item of a part.
LINK, WINDOW, PART = 0, 1, 2
#: What a cell holds: items to be compared with each other, or a region and its window.
ALL, INSIDE, AROUND = 0, 1, 2
#: Bits of the fixed-size filter of wanted items.
FILTER_BITS = 1 << 26


def one_cell_each(members: DataFrame) -> DataFrame:
    """Keeps one of the cells with the same items (the count and a 64-bit hash of the set tell them apart)."""
    marks = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("x")).alias("s"))
    first = marks.groupBy("n", "s").agg(F.min("cell").alias("cell")).filter("n > 1").select("cell")
    return members.join(first, "cell", "left_semi")


def wanted_filter(items: DataFrame) -> np.ndarray:
    """A bitmap of ``FILTER_BITS`` bits (8 MB, however many items) with the bit of every ``x`` set: tasks
    skip most items that are not wanted before anything is shuffled; an exact join follows."""
    bit = F.pmod("x", F.lit(FILTER_BITS)) + 1  # the bitmap functions count from 1
    rows = items.select(bit.alias("bit")).groupBy(F.call_function("bitmap_bucket_number", F.col("bit")).alias("bucket")) \
        .agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("bit"))).alias("map"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows.collect():  # at most FILTER_BITS / 32768 rows of 4 kB
        at = (r["bucket"] - 1) * 4096
        out[at:at + 4096] |= np.frombuffer(bytes(r["map"]), np.uint8)
    return out


def maybe_wanted(bitmap: np.ndarray, x: int) -> bool:
    bit = x % FILTER_BITS
    return bool(bitmap[bit >> 3] >> (bit & 7) & 1)


def link_cells(members: DataFrame, payloads: DataFrame, distance: Callable[[bytes, bytes], float], theta: float,
               small: int = SMALL, pivots: int = PIVOTS, block: int = BLOCK,
               near_sizes: Callable[[Column, Column], Column] | None = None,
               bounds: Callable[[list[bytes], list[bytes]], np.ndarray] | None = None) -> DataFrame:
    """Links (a, b).  ``members``: cell, x, w (long; w about the payload's size); ``payloads``: x, p
    (binary), one row per item; ``distance(p, q)``: a metric, or anything over 2 * theta beyond that;
    ``near_sizes(w, v)``: whether items of those sizes can be within theta (before any payload moves);
    ``bounds(s, t)``: lower bounds of all distances between items by their sketches, a column ``s`` of
    ``payloads`` many times smaller than ``p``: payloads move only to blocks where they may have a partner.
    No members give no links."""
    members = materialize(members.select("cell", "x", "w"), "cells")
    if bounds is not None:
        return _cells_by_bounds(members, payloads, distance, theta, pivots, block, near_sizes, bounds)
    clusters = _clusters(members, block)
    rows = clusters.filter("m <= most").select(
        F.xxhash64(F.lit("cluster"), "cell").alias("block"), "cell", F.lit(True).alias("star"),
        F.lit(MEMBER | PIVOT).alias("role"), "x", F.col("x").alias("c"))
    near = materialize(_meet(rows.join(payloads, "x"), distance, theta), "near")
    links = near.filter(F.col("d") <= theta).select("a", "b")
    open_ = materialize(members.join(clusters.filter("m > most").select("x"), "x", "left_semi"), "cells")
    if not open_.limit(1).count():
        return links

    discard(members)
    groups = materialize(open_.select("x", F.col("x").alias("c")).distinct(), "groups")
    for turn in range(STARS):
        live = _live(open_, groups, block, turn)
        if not live.limit(1).count():
            return links
        near = materialize(_meet(_stars(live, block, near_sizes).join(payloads, "x"), distance, theta).filter(
            F.col("d") <= theta).select("a", "b"), "near")
        discard(live)
        links, groups = links.union(near), merged(groups, near)
    return _cell_by_cell(open_, links, groups, payloads, distance, theta, small, pivots, block)


def _live(open_: DataFrame, groups: DataFrame | None, block: int, turn: int = 0) -> DataFrame:
    """(cell, x, w, c, n, chunks, p: the cell's foremost pivot of this turn): the cells that hold more than one component.
    An item that is not in ``groups`` (x, c) is its own component."""
    if groups is None:
        tagged = open_.withColumn("c", F.col("x"))
    else:
        tagged = open_.join(groups, "x", "left").withColumn("c", F.coalesce("c", "x"))
    pivot = F.struct(F.xxhash64(F.lit(turn), "x").alias("h"), F.col("x").alias("q"), F.col("c").alias("qc"), F.col("w").alias("qw"))
    alive = tagged.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("sw"),
                                       F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(pivot).alias("p")) \
        .filter("lo < hi").select("cell", "n", _chunks(F.col("n"), F.col("sw"), block).alias("chunks"), "p")
    return materialize(tagged.join(alive, "cell"), "cells")


def _measure(pairs: DataFrame, block: int) -> DataFrame:
    """Blocks for (x, w, q): every x meets its q; the items of a q are dealt into chunks."""
    pairs = materialize(pairs, "pairs")
    chunks = pairs.groupBy("q").agg(_chunks(F.count(F.lit(1)), F.sum("w"), block).alias("chunks"))
    items = pairs.join(chunks, "q").select(
        F.xxhash64("q", F.pmod(F.xxhash64("x"), "chunks")).alias("block"), F.col("q").alias("cell"),
        F.lit(False).alias("star"), F.lit(MEMBER).alias("role"), "x", F.col("x").alias("c"))
    each = chunks.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return items.union(each.select(F.xxhash64("q", "chunk").alias("block"), F.col("q").alias("cell"),
                                   F.lit(False).alias("star"), F.lit(PIVOT).alias("role"), F.col("q").alias("x"),
                                   F.col("q").alias("c")))


def _stars(live: DataFrame, block: int, near_sizes: Callable | None) -> DataFrame:
    """Every item and the foremost pivot of its cells, where their sizes can be near: one distance an item."""
    pairs = live.filter(F.col("c") != F.col("p.qc"))
    if near_sizes is not None:
        pairs = pairs.filter(near_sizes(F.col("w"), F.col("p.qw")))
    return _measure(pairs.groupBy("x").agg(F.max("w").alias("w"), F.min(F.struct("p.h", "p.q")).alias("p")).select(
        "x", "w", F.col("p.q").alias("q")), block)


def _cell_by_cell(open_: DataFrame, links: DataFrame, groups: DataFrame, payloads: DataFrame, distance: Callable,
                  theta: float, small: int, pivots: int, block: int) -> DataFrame:
    while True:
        live = _live(open_, groups, block)
        sizes = live.agg(F.count(F.lit(1)), F.max("n")).first()
        if not sizes[0]:
            return links
        rows = live.filter(F.col("n") <= small).select(
            F.col("cell").alias("block"), "cell", F.lit(True).alias("star"), F.lit(MEMBER | PIVOT).alias("role"), "x", "c")
        if sizes[1] > small:
            large = live.filter(F.col("n") > small)
            chosen = materialize(_pivots(large, pivots), "pivots")
            rows = rows.union(_large_blocks(large, chosen))
        near = materialize(_meet(rows.join(payloads, "x"), distance, theta), "near")
        found = near.filter(F.col("d") <= theta).select("a", "b")
        links = links.union(found)
        if sizes[1] <= small:
            return links
        groups, last = merged(groups, found), open_
        open_ = materialize(_next_cells(large, chosen, near.filter("not star"), theta), "cells")
        discard(last, live, chosen)


def _cells_by_bounds(members: DataFrame, payloads: DataFrame, distance: Callable, theta: float, pivots: int, block: int,
                     near_sizes: Callable | None, bounds: Callable) -> DataFrame:
    """Cells of at most ``WIDE * DIRECT`` blocks are compared by their sketches; larger ones give regions with windows
    and the cell of all others, a round each, after two rounds of one pivot."""
    cells = members.withColumn("side", F.lit(ALL))
    wide, most = block * WIDE, block * WIDE * DIRECT
    links = groups = None
    turn = 0
    while True:
        live = _live(cells, groups, block, turn)
        sizes = live.agg(F.count(F.lit(1)), F.max(F.when(F.col("side") == ALL, F.col("n")))).first()
        if not sizes[0]:
            return live.select(F.col("x").alias("a"), F.col("x").alias("b")) if links is None else links
        crowded = (sizes[1] or 0) > most
        if crowded and turn < min(STARS, 2):  # bounds leave few pairs to compare without a third
            rows = _promising(_stars(live, block, near_sizes), payloads, bounds, theta)
            found = materialize(_meet(rows.join(payloads, "x"), distance, theta).filter(
                F.col("d") <= theta).select("a", "b"), "near")
            discard(live, rows)
            links = found if links is None else links.union(found)
            groups, turn = _named(links), turn + 1
            continue
        rows = _chunk_pairs(live.filter((F.col("side") == ALL) & (F.col("n") <= most)), wide)
        rows = rows.union(_halves(live.filter(F.col("side") != ALL)))
        if crowded:
            large = live.filter((F.col("side") == ALL) & (F.col("n") > most))
            chosen = materialize(_share_of_pivots(large, pivots), "pivots")
            rows = rows.union(_large_blocks(large, chosen))
        near = _near(rows, payloads, bounds, theta)
        found = _verified(near, live, payloads, distance, theta, block, bounds)
        links = found.select("a", "b") if links is None else links.union(found.select("a", "b"))
        if not crowded:
            discard(near, live)
            return links
        groups = _named(links)
        cells = materialize(_regions(large, chosen, near.filter(F.col("kind") == WINDOW).drop("kind"), found), "cells")
        discard(live, chosen, near)


def _named(links: DataFrame) -> DataFrame:
    """(x, c: its component) of the items that have links."""
    return components(links).select(F.col("node").alias("x"), F.col("component").alias("c"))


def _chunk_pairs(cells: DataFrame, size: int) -> DataFrame:
    """Every two chunks of a cell in a block: a member's chunk and a later one, or a chunk by itself."""
    own = F.pmod(F.xxhash64("x"), "parts")
    rows = cells.withColumn("parts", F.ceil(F.col("n") / size)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return rows.select(
        F.xxhash64("cell", F.least(own, "other"), F.greatest(own, "other")).alias("block"), "cell",
        (own == F.col("other")).alias("star"),
        F.when(own == F.col("other"), MEMBER | PIVOT).when(own < F.col("other"), MEMBER).otherwise(REGION).alias("role"), "x", "c")


def _halves(live: DataFrame) -> DataFrame:
    """Every chunk of a region and every chunk of its window in a block."""
    own = F.pmod(F.xxhash64("x"), "chunks")
    rows = live.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    inside = F.col("side") == INSIDE
    return rows.select(
        F.when(inside, F.xxhash64("cell", own, "other")).otherwise(F.xxhash64("cell", "other", own)).alias("block"), "cell",
        F.lit(False).alias("star"), F.when(inside, F.lit(REGION)).otherwise(F.lit(MEMBER)).alias("role"), "x", "c")


def _chunks(n, weight, block: int):
    return F.greatest(F.ceil(n / block), F.ceil(weight / BLOCK_WEIGHT))


def _clusters(members: DataFrame, block: int) -> DataFrame:
    """(cell = cluster, x, w, m, most, chunks): the items of cells that overlap in chains; a cluster of
    m <= most items is one block."""
    least = members.groupBy("cell").agg(F.min("x").alias("b"))
    groups = components(members.join(least, "cell").select(F.col("x").alias("a"), "b"))
    items = members.select("x", "w").distinct().join(groups.select(F.col("node").alias("x"), "component"), "x")
    sizes = items.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("w").alias("sw"))
    most = F.when(F.col("sw") <= 4 * BLOCK_WEIGHT, block).otherwise(2)  # few but huge items meet in chunks
    return materialize(items.join(sizes, "component").select(
        F.col("component").alias("cell"), "x", "w", "m", most.alias("most"),
        _chunks(F.col("m"), F.col("sw"), block).alias("chunks")), "clusters")


def _large_blocks(large: DataFrame, chosen: DataFrame) -> DataFrame:
    """Each cell's items dealt into chunks, and its pivots in every chunk."""
    items = large.select(
        F.xxhash64("cell", F.pmod(F.xxhash64("x"), "chunks")).alias("block"), "cell", F.lit(False).alias("star"),
        F.lit(MEMBER).alias("role"), "x", "c")
    each = chosen.join(large.select("cell", "chunks").distinct(), "cell") \
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return items.union(each.select(F.xxhash64("cell", "chunk").alias("block"), "cell", F.lit(False).alias("star"),
                                   F.lit(PIVOT).alias("role"), F.col("q").alias("x"), F.col("qc").alias("c")))


def _pivots(large: DataFrame, k: int) -> DataFrame:
    """(cell, q, qc: its component): up to ``k`` items per cell outside its largest component: the smallest hash of each of
    ``k`` classes."""
    per = large.groupBy("cell", "c").agg(F.count(F.lit(1)).alias("n"))
    most = per.groupBy("cell").agg(F.max(F.struct("n", "c")).alias("most")).select("cell", F.col("most.c").alias("most"))
    rest = large.join(most, "cell").filter(F.col("c") != F.col("most")).withColumn("h", F.xxhash64(F.lit("pivot"), "x"))
    picks = [F.min(F.when(F.pmod("h", F.lit(k)) == j, F.struct("h", F.col("x").alias("q"), F.col("c").alias("qc")))).alias(f"p{j}")
             for j in range(k)]
    rows = rest.groupBy("cell").agg(*picks)
    return rows.select("cell", F.explode(F.array_compact(F.array(*[F.col(f"p{j}") for j in range(k)]))).alias("p")) \
        .select("cell", "p.q", "p.qc")


def _share_of_pivots(large: DataFrame, k: int) -> DataFrame:
    """(cell, q, qc: its component): of each cell's items outside its largest component about ``k``, or one in
    ``SHARE`` of the cell where that is more, by hash; one at least."""
    per = large.groupBy("cell", "c").agg(F.count(F.lit(1)).alias("of"))
    most = per.groupBy("cell").agg(F.max(F.struct("of", "c")).alias("most"), F.sum("of").alias("all"))
    rest = large.join(most, "cell").filter(F.col("c") != F.col("most.c")).select(
        "cell", F.xxhash64(F.lit("pivot"), "cell", "x").alias("h"), F.col("x").alias("q"), F.col("c").alias("qc"),  # anew each round
        F.greatest(F.lit(1), F.floor((F.col("all") - F.col("most.of")) / F.greatest(F.lit(k), F.col("all") / SHARE))).alias("step"))
    first = rest.groupBy("cell").agg(F.min(F.struct("h", "q", "qc")).alias("p")).select("cell", "p.q", "p.qc")
    return first.union(rest.filter(F.pmod("h", "step") == 0).select("cell", "q", "qc")).distinct()


def _each_block(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((block, cell, star), its rows of ``columns``) of batches sorted by block."""
    head, items = None, []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("block", "cell", "star", *columns))):
            if head is None or row[0] != head[0]:
                if head is not None:
                    yield head, items
                head, items = row[:3], []
            items.append(row[3:])
    if head is not None:
        yield head, items


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("block", "cell", "star", *columns).repartition("block").sortWithinPartitions("block")


def near_pairs(items: list[tuple[int, int, bytes, int]], star: bool, bounds, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of different components among the (x, role, sketch, component) of one block: those that may
    be within theta (in a star block any two, else a member and a pivot or an item of a region), and the members
    that may be within 2 theta of a pivot."""
    role, own = (np.array([i[k] for i in items], np.int64) for k in (1, 3))
    one = np.flatnonzero(role & MEMBER)
    two = one if star else np.flatnonzero(role & (PIVOT | REGION))
    if not len(one) or not len(two):
        return np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)
    low = bounds([items[k][2] for k in one], [items[k][2] for k in two])
    low[own[one][:, None] == own[two]] = np.inf
    if star:
        low[np.tril_indices(len(one))] = np.inf
    a, b = np.nonzero(low <= theta)
    c, d = np.nonzero((low <= 2 * theta) & ((role[two] & PIVOT) > 0) & (not star))
    return np.stack([one[a], two[b]], 1), np.stack([one[c], two[d]], 1)


def dense_parts(pairs: np.ndarray, items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the pairs to list; item and part (an item of it) of the others): where ``items`` items have over ``DENSE`` times as
    many pairs, items that hang together by over ``DENSE`` times as many pairs are a part."""
    none = np.zeros(0, np.int64)
    if len(pairs) <= DENSE * items:
        return pairs, none, none
    own = np.arange(items)
    node, low = stars(pairs[:, 0], pairs[:, 1])
    own[node] = low
    size, held = np.bincount(own, minlength=items), np.bincount(own[pairs[:, 0]], minlength=items)
    dense = held > DENSE * size
    at = np.flatnonzero(dense[own])
    return pairs[~dense[own[pairs[:, 0]]]], at, own[at]


def _near(rows: DataFrame, payloads: DataFrame, bounds: Callable, theta: float) -> DataFrame:
    """``near_pairs`` of every block: (cell, a, b, kind): a and b may be within theta, a may be within 2 theta of the
    pivot b, or the item b is in the part a.  At most a few rows an item and window: the possible links of a part are not listed.
    Exact: what is within reach has a lower bound within reach."""

    def run(batches: Iterator[pa.RecordBatch]):
        for head, items in _each_block(batches, ("x", "role", "s", "c")):
            links, windows = near_pairs(items, head[2], bounds, theta + 1e-9)
            links, at, part = dense_parts(links, len(items))
            x = np.array([i[0] for i in items], np.int64)
            names = x[part] ^ np.int64(head[0])  # parts whose names are equal by chance meet as one
            yield {"cell": np.full(len(links) + len(windows) + len(at), head[1], np.int64),
                   "a": np.concatenate([x[links[:, 0]], x[windows[:, 0]], names]),
                   "b": np.concatenate([x[links[:, 1]], x[windows[:, 1]], x[at]]),
                   "kind": np.repeat(np.array([LINK, WINDOW, PART], np.int8), [len(links), len(windows), len(at)])}

    dealt = _dealt(rows.join(payloads.select("x", "s"), "x"), "x", "role", "s", "c")
    return materialize(map_rows(dealt, run, "cell long, a long, b long, kind byte", {
        "cell": pa.int64(), "a": pa.int64(), "b": pa.int64(), "kind": pa.int8()}), "near")


def _promising(rows: DataFrame, payloads: DataFrame, bounds: Callable, theta: float) -> DataFrame:
    """The rows of ``rows`` (block, cell, star, role, x, c) that may have a link in their block."""

    def run(batches: Iterator[pa.RecordBatch]):
        for head, items in _each_block(batches, ("x", "role", "s", "c")):
            links, _ = near_pairs(items, head[2], bounds, theta + 1e-9)
            kept = [items[k] for k in np.unique(links).tolist()]
            n = len(kept)
            yield {"block": [head[0]] * n, "cell": [head[1]] * n, "star": [head[2]] * n,
                   "role": [i[1] for i in kept], "x": [i[0] for i in kept], "c": [i[3] for i in kept]}

    dealt = _dealt(rows.join(payloads.select("x", "s"), "x"), "x", "role", "s", "c")
    return materialize(map_rows(dealt, run, "block long, cell long, star boolean, role int, x long, c long",
                                {"block": pa.int64(), "cell": pa.int64(), "star": pa.bool_(), "role": pa.int32(),
                                 "x": pa.int64(), "c": pa.int64()}), "promising")


def _verified(near: DataFrame, live: DataFrame, payloads: DataFrame, distance: Callable, theta: float, block: int,
              bounds: Callable) -> DataFrame:
    """(a, b, d): links that join what all links among the possible pairs and in the parts of ``near`` join."""
    items = live.groupBy("x").agg(F.max("w").alias("w"), F.max("c").alias("c"))  # an item has one component
    possible = materialize(near.filter(F.col("kind") == LINK).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "possible")
    parts = materialize(near.filter(F.col("kind") == PART).select(F.col("a").alias("part"), F.col("b").alias("x")).distinct(), "parts")
    rows = _pair_blocks(possible, items, block).union(_part_blocks(parts, items, block))
    found = materialize(_meet(rows.join(payloads, "x"), distance, theta, bounds).select("a", "b", "d"), "found")
    discard(possible, parts)
    return found


def _side(own: Column, other: Column) -> Column:
    """The role of an item of chunk ``own`` in the star block of two chunks: two different ones meet only each other."""
    return F.when(own == other, MEMBER | PIVOT).when(own < other, MEMBER).otherwise(REGION)


def _pair_blocks(possible: DataFrame, items: DataFrame, block: int) -> DataFrame:
    """Pairs hang together in groups; a group's items are dealt into chunks, and chunks that hold a pair meet."""
    nodes = components(possible).select(F.col("node").alias("x"), F.col("component").alias("g"))
    items = nodes.join(items, "x")
    sizes = items.groupBy("g").agg(_chunks(F.count(F.lit(1)), F.sum("w"), block).alias("chunks"))
    items = materialize(items.join(sizes, "g").select("x", "g", "c", F.pmod(F.xxhash64("x"), "chunks").alias("k")), "dealt")
    one = items.select(F.col("x").alias("a"), "g", F.col("c").alias("ca"), F.col("k").alias("ka"))
    two = items.select(F.col("x").alias("b"), F.col("c").alias("cb"), F.col("k").alias("kb"))
    ka, kb = F.col("ka"), F.col("kb")
    ends = F.array(F.struct(F.col("a").alias("x"), F.col("ca").alias("c"), _side(ka, kb).alias("role")),
                   F.struct(F.col("b").alias("x"), F.col("cb").alias("c"), _side(kb, ka).alias("role")))
    return possible.join(one, "a").join(two, "b").select(
        F.xxhash64("g", F.least("ka", "kb"), F.greatest("ka", "kb")).alias("block"), F.col("g").alias("cell"),
        F.explode(ends).alias("end")).select("block", "cell", F.lit(True).alias("star"), "end.role", "end.x", "end.c").distinct()


def _part_blocks(parts: DataFrame, items: DataFrame, block: int) -> DataFrame:
    """Every two chunks of a part in a block.  Parts that overlap, in chains, are one where that takes no more rows."""
    united = components(parts.select(F.col("part").alias("a"), F.col("x").alias("b"))).select(
        F.col("node").alias("part"), F.col("component").alias("g"))
    tagged = parts.join(united, "part")
    cost = lambda n: n * F.ceil(n / block)  # noqa: E731  rows of the chunk pairs of n items
    apart = tagged.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(F.sum(cost(F.col("n"))).alias("apart"))
    whole = tagged.select("g", "x").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    choice = apart.join(whole, "g").select("g", (cost(F.col("m")) <= F.col("apart")).alias("one"))
    units = tagged.join(choice, "g").select(F.when(F.col("one"), F.col("g")).otherwise(F.col("part")).alias("g"), "x").distinct() \
        .join(items, "x")
    sizes = units.groupBy("g").agg(_chunks(F.count(F.lit(1)), F.sum("w"), block).alias("chunks"))
    own, other = F.pmod(F.xxhash64("x"), "chunks"), F.col("other")
    rows = units.join(sizes, "g").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return rows.select(
        F.xxhash64(F.lit("part"), "g", F.least(own, other), F.greatest(own, other)).alias("block"), F.col("g").alias("cell"),
        F.lit(True).alias("star"), _side(own, other).alias("role"), "x", "c")


def _regions(large: DataFrame, chosen: DataFrame, windows: DataFrame, found: DataFrame) -> DataFrame:
    """The cells (cell, x, w, side) that remain of large ones: per pivot its region (what is linked to it and to no
    nearer pivot) and its window, and what is in no region.  ``windows``: (cell, a, b); pivots have met everything."""
    both = found.select("a", "b", "d").union(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    homes = windows.join(both, ["a", "b"]).groupBy("cell", F.col("a").alias("x")).agg(F.min(F.struct("d", "b")).alias("home")) \
        .select("cell", "x", F.col("home.b").alias("q"))
    done = chosen.select("cell", F.col("q").alias("x"))
    items = large.select("cell", "x", "w")
    inside = homes.join(done, ["cell", "x"], "left_anti")
    around = windows.join(both, ["a", "b"], "left_anti").select("cell", F.col("a").alias("x"), F.col("b").alias("q")) \
        .join(done, ["cell", "x"], "left_anti").join(inside.select("cell", "q"), ["cell", "q"], "left_semi")
    halves = inside.select("cell", "x", "q", F.lit(INSIDE).alias("side")).union(
        around.select("cell", "x", "q", F.lit(AROUND).alias("side")))
    rest = items.join(homes.select("cell", "x").union(done).distinct(), ["cell", "x"], "left_anti")
    return halves.join(items, ["cell", "x"]).select(F.xxhash64("cell", "q").alias("cell"), "x", "w", "side").union(
        rest.select(F.xxhash64("cell", F.lit("rest")).alias("cell"), "x", "w", F.lit(ALL).alias("side")))


def meet(items: list[tuple], star: bool, distance, theta: float, bounds=None) -> list[tuple[int, int, float]]:
    """(a, b, d) among the (x, role, payload, component and, with bounds, sketch) of one block: in a star block links until its items hang
    together as they do by all links (of two chunks: by all links between them), else members against pivots of other components within 2 theta.  (Where a
    member has its pivot's component, whatever lies within theta of the pivot joins that component too.)"""
    out = []
    if not star:
        for x, role, p, c in items:
            if role & MEMBER:
                for q, other, r, qc in items:
                    if other & PIVOT and qc != c and (d := distance(p, r)) <= 2 * theta:
                        out.append((x, q, d))
        return out
    first: dict[int, int] = {}
    root = [first.setdefault(i[3], k) for k, i in enumerate(items)]
    sketches = [i[4] for i in items] if bounds else []
    may = bounds(sketches, sketches) <= theta + 1e-9 if bounds else np.ones((len(items), len(items)), bool)
    side = np.array([i[1] for i in items], np.int64)
    may &= (side[:, None] != side) | (side == MEMBER | PIVOT)  # items of one of two chunks meet elsewhere

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k in range(len(items)):
        for j in np.flatnonzero(may[k, :k]).tolist():
            if top(k) != top(j) and (d := distance(items[k][2], items[j][2])) <= theta:
                root[top(k)] = top(j)
                out.append((items[k][0], items[j][0], d))
    return out


def _meet(rows: DataFrame, distance: Callable, theta: float, bounds: Callable | None = None) -> DataFrame:
    """Runs ``meet`` on every block; blocks are sorted within hash partitions and streamed."""
    columns = ("x", "role", "p", "c", "s") if bounds else ("x", "role", "p", "c")

    def run(batches: Iterator[pa.RecordBatch]):
        for head, items in _each_block(batches, columns):
            found = meet(sorted(items), head[2], distance, theta, bounds)
            yield {"cell": [head[1]] * len(found), "star": [head[2]] * len(found), "a": [f[0] for f in found],
                   "b": [f[1] for f in found], "d": [f[2] for f in found]}

    return map_rows(_dealt(rows, *columns), run, "cell long, star boolean, a long, b long, d double", {
        "cell": pa.int64(), "star": pa.bool_(), "a": pa.int64(), "b": pa.int64(), "d": pa.float64()})


def _next_cells(large: DataFrame, chosen: DataFrame, met: DataFrame, theta: float) -> DataFrame:
    """The cells that remain of large ones: per pivot its region and window, and what is in no region."""
    met = met.select("cell", F.col("a").alias("x"), F.col("b").alias("q"), "d")
    homes = met.filter(F.col("d") <= theta).groupBy("cell", "x").agg(F.min(F.struct("d", "q")).alias("home")) \
        .select("cell", "x", F.col("home.q").alias("home"))
    done = chosen.select("cell", F.col("q").alias("x"))
    settled = homes.select("cell", "x").union(done).distinct()
    items = large.select("cell", "x", "w")
    around = met.join(homes, ["cell", "x"], "left").join(done, ["cell", "x"], "left_anti") \
        .filter((F.col("d") > theta) | (F.col("home") == F.col("q"))).join(items, ["cell", "x"]) \
        .select(F.xxhash64("cell", "q").alias("cell"), "x", "w")
    rest = items.join(settled, ["cell", "x"], "left_anti") \
        .select(F.xxhash64("cell", F.lit("rest")).alias("cell"), "x", "w")
    return around.union(rest).distinct()
