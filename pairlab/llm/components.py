"""Connected components by contraction within tasks and alternating large-star and small-star steps.

Each task replaces its share of the edges (about ``SHARE``) by stars that hang together as they did; edges
of one share are done with that, so few edges take one job and not a chain of them.  More edges go on
with star steps between the contractions.  A star step is a grouped minimum joined back on its key, so a node
with very many neighbours is combined before the shuffle and its join partition can be split.  Each step
is written to the shared folder; only a count and a truth value a step (whether the edges are stars yet) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import map_rows
from pairlab.session import discard, materialize

#: Edges that a task contracts at once.
SHARE = 1 << 17


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node to the smallest node of its component, the smallest left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    low = np.arange(len(nodes))
    while len(a):
        x, y = low[a], low[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low != low[low]).any():
            low = low[low]
    own = low != np.arange(len(nodes))
    return nodes[own], nodes[low[own]]


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """The stars of each task's share."""

    def run(batches: Iterator[pa.RecordBatch]):
        held, total, most = [], 0, 4 * SHARE
        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in ("a", "b")])
            total += len(batch)
            if total > most:
                held = [list(stars(*(np.concatenate(x) for x in zip(*held))))]
                total, most = len(held[0][0]), 4 * SHARE + 2 * len(held[0][0])
        if held:
            yield dict(zip("ab", stars(*(np.concatenate(x) for x in zip(*held)))))

    return map_rows(edges.coalesce(tasks), run, "a long, b long", {"a": pa.int64(), "b": pa.int64()})


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger to the smaller node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.union(least.select("a", F.col("m").alias("b")))


def _unsettled(edges: DataFrame) -> bool:
    """Whether a node has two smaller neighbours, or one that has a smaller one itself; if none has, every edge
    points from a node to the smallest of its component.  Edges point from the larger to the smaller node, each once."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(False).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(True)))
    per = ends.groupBy("x").agg(F.sum("up").alias("up"), F.bool_or("down").alias("down"))
    return bool(per.agg(F.bool_or((F.col("up") > 1) | ((F.col("up") > 0) & F.col("down")))).first()[0])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (two long columns a, b; loops and repeats are fine);
    the component is its smallest node.  No edges give an empty result."""
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .distinct(), "star")
    while n := now.count():
        last, tasks = now, -(-n // SHARE)
        now = _contracted(last, tasks)
        now = materialize(now.distinct() if tasks > 1 else now, "star")
        discard(last)
        if tasks == 1 or not _unsettled(now):
            break
        last = now
        now = materialize(_small_star(_large_star(last)).distinct(), "star")
        discard(last)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select("b", "b").distinct())


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` (x, c: its component so far, a table of ``materialize``) after new ``links`` (a, b) between its
    items: only the links between different components are worked on.  The old table is deleted."""
    a, b = groups.select(F.col("x").alias("a"), F.col("c").alias("ca")), groups.select(F.col("x").alias("b"), F.col("c").alias("cb"))
    edges = links.join(a, "a").join(b, "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    steps = components(edges)
    if not steps.limit(1).count():
        return groups
    steps = steps.withColumnRenamed("node", "c")
    out = materialize(groups.join(steps, "c", "left").select("x", F.coalesce("component", "c").alias("c")), "groups")
    discard(groups)
    return out
