"""Exact n-gram Jaccard join in a metric space.

Jaccard distance is a metric.  Documents are first collapsed to their distinct shingle sets.  The first
pivots are single shingles: a set's region is its first shingle in one global order, and a set is
replicated to the regions of its first ``n - ceil(t n) + l`` shingles - the window within which a set of
similarity t or more must meet it l times (by the triangle inequality with what both sets lack; l is a
twentieth of n, or of the smallest set that can be similar).  Sets that meet others less often are done.  Common shingles
are put last in the order (``common_shingles``: an aid for speed; any order is exact), so that passages
which many documents share make no crowded regions.  Regions then join recursively by document pivots
(``regions.link_cells``): Voronoi cells, 2-theta windows, until every link is found or implied by a chain
of links.  Links are verified on the whole shingle sets; sets move only to blocks where their parity
sketches, which bound distances from below, leave them a possible partner.

Shingles are 64-bit hashes of the words' bytes.  Defined cases: a null or empty text has an empty set and
is linked with nothing; fewer words than ``size`` make one shingle; equal sets are one node, so copies are
never paired with each other; a null doc_id is carried and never names a component that has another id; an
empty table gives an empty result; extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import id_text, map_rows, slices
from pairlab.llm.components import components
from pairlab.llm.regions import link_cells, maybe_wanted, one_cell_each, wanted_filter
from pairlab.session import discard, materialize

SIZE, SIMILARITY = 5, 0.8
#: Common shingles: counted where a task sees them in LOCAL sets or more, common from TOTAL on; at most MOST are kept.
LOCAL, TOTAL, MOST = 3, 24, 500_000
#: A set of n shingles meets a similar one of n or more at least ``n // EXTRA`` times (once at least).
EXTRA = 20
CHUNK = 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random byte values, and powers of an odd base and of its inverse modulo 2^64."""
    values = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    base = 0x9E3779B97F4A7C15
    powers, inverse = np.ones(2 * CHUNK, _U), np.ones(2 * CHUNK, _U)
    np.multiply.accumulate(np.full(2 * CHUNK - 1, base, _U), out=powers[1:])
    np.multiply.accumulate(np.full(2 * CHUNK - 1, pow(base, -1, 1 << 64), _U), out=inverse[1:])
    return values, powers, inverse


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


class Shingler:
    """64-bit hashes of the word shingles of texts."""

    def __init__(self, size: int = SIZE):
        self.size = size
        self.values, self.powers, self.inverse = _tables()
        self.weights = np.random.default_rng(7).integers(1, 1 << 63, size, dtype=np.uint64) * _U(2) + _U(1)

    def words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and starts of the words of lower-cased bytes."""
        hashes, starts = [], []
        at = 0
        while at < len(raw):
            end = min(at + CHUNK, len(raw))
            if end < len(raw):  # cut at white space; a longer word stays whole
                while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
                    end += 1
            part = np.frombuffer(raw, np.uint8, end - at, at)
            space = _SPACE[part]
            edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
            a, b = edge[::2], edge[1::2]
            if len(a):
                if len(part) > len(self.powers):  # holds a very long word: one by one
                    h = np.array([self._word(part[x:y]) for x, y in zip(a, b)], _U)
                else:
                    sums = np.concatenate([[_U(0)], np.cumsum(self.values[part] * self.powers[:len(part)], dtype=_U)])
                    h = (sums[b] - sums[a]) * self.inverse[a]
                hashes.append(_mix(h + (b - a).astype(_U)))
                starts.append(a + at)
            at = end
        if not hashes:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        return np.concatenate(hashes), np.concatenate(starts)

    def _word(self, part: np.ndarray) -> np.uint64:
        if len(part) > len(self.powers):
            return np.frombuffer(hashlib.blake2b(part.tobytes(), digest_size=8).digest(), _U)[0]
        return (self.values[part] * self.powers[:len(part)]).sum(dtype=_U)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """The sorted distinct shingles of every text."""
        raws = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
        h, starts = self.words(b" ".join(raws))
        ends = np.cumsum([len(r) + 1 for r in raws]) if raws else np.zeros(0, np.int64)
        last = np.searchsorted(starts, ends)
        out, at = [], 0
        n = self.size
        sums = np.zeros(max(len(h) - n + 1, 0), _U)
        for k in range(n if len(sums) else 0):
            sums += h[k:k + len(sums)] * self.weights[k]
        sums = _mix(sums)
        for to in last.tolist():
            if to - at >= n:
                out.append(np.unique(sums[at:to - n + 1]))
            elif to > at:
                out.append(_mix((h[at:to] * self.weights[:to - at]).sum(dtype=_U, keepdims=True) + _U(to - at)))
            else:
                out.append(np.zeros(0, _U))
            at = to
        return out


def node_of(s: np.ndarray) -> int:
    """The name of a shingle set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True)


def window(s: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles whose regions a set must be in."""
    n = len(s)
    take = n - math.ceil(similarity * n - 1e-9) + max(1, n // EXTRA)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        rare = common[at] != s
        s = np.concatenate([s[rare], s[~rare]])
    return s[:take]


def _first_pass(texts: DataFrame, size: int) -> DataFrame:
    """kind 0: a document's id, node, set size and hash of its text; kind 1: a shingle and in how many sets a task saw it."""

    def run(batches: Iterator[pa.RecordBatch]):
        shingler, seen = Shingler(size), set()
        held: list[np.ndarray] = []
        total = 0

        def counted():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= LOCAL
            return {"kind": np.ones(int(often.sum()), np.int8), "k": h[often].view(np.int64),
                    "v": n[often].astype(np.int64), "n": np.zeros(int(often.sum()), np.int64), "row": np.zeros(int(often.sum()), np.int64)}

        for batch in batches:
            for part in slices(batch):
                sets = shingler.sets(part.column("text").to_pylist())
                names = [node_of(s) for s in sets]
                yield {"kind": np.zeros(len(sets), np.int8), "k": part.column("doc_id"), "v": names,
                       "n": [len(s) for s in sets], "row": part.column("row")}
                for name, s in zip(names, sets):
                    if name not in seen:  # copies within a task count once
                        seen.add(name)
                        held.append(s)
                        total += len(s)
            if total > 4_000_000:
                yield counted()
                held, total, seen = [], 0, set()
        if held:
            yield counted()

    return map_rows(texts.withColumn("row", F.xxhash64("text")), run, "kind byte, k long, v long, n long, row long",
                    {"kind": pa.int8(), "k": pa.int64(), "v": pa.int64(), "n": pa.int64(), "row": pa.int64()})


def common_shingles(first: DataFrame) -> np.ndarray:
    """The shingles of at least ``TOTAL`` sets, or of more where those are over ``MOST`` (sorted)."""
    counts = materialize(first.filter("kind = 1").groupBy("k").agg(F.sum("v").alias("n")).filter(F.col("n") >= TOTAL),
                         "ngram-common")
    steps = counts.groupBy(F.floor(8 * F.log2("n")).alias("step")).count().orderBy(F.desc("step")).collect()
    limit, kept = None, 0
    for r in steps:  # a few hundred steps of frequency, from the top
        if kept + r["count"] > MOST:
            break
        limit, kept = r["step"], kept + r["count"]
    if limit is None:
        return np.zeros(0, _U)
    rows = counts.filter(F.floor(8 * F.log2("n")) >= limit).select("k").toPandas()  # at most MOST
    return np.sort(rows["k"].to_numpy(np.int64).view(_U))


def keep_shared(rows: DataFrame) -> DataFrame:
    """Of (cell, x, w), the rows whose cell has two different items or more.  The rows are sorted by cell
    within hash partitions and streamed, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]):
        carry = None  # last row so far, and whether it shares the cell of the row before it
        for batch in batches:
            cell, x, w = (batch.column(k).to_numpy() for k in ("cell", "x", "w"))
            joined = False
            if carry is not None:
                cell, x, w = (np.concatenate([[v], a]) for v, a in zip(carry[:3], (cell, x, w)))
                joined = carry[3]
            if not len(cell):
                continue
            new = np.ones(len(cell), bool)
            new[1:] = (cell[1:] != cell[:-1]) | (x[1:] != x[:-1])
            cell, x, w = cell[new], x[new], w[new]
            same = np.concatenate([[joined], cell[1:] == cell[:-1]])
            keep = same[:-1] | same[1:]
            carry = (cell[-1], x[-1], w[-1], bool(same[-1]))
            yield {"cell": cell[:-1][keep], "x": x[:-1][keep], "w": w[:-1][keep]}
        if carry is not None and carry[3]:
            yield {"cell": [carry[0]], "x": [carry[1]], "w": [carry[2]]}

    dealt = rows.repartition("cell").sortWithinPartitions("cell", "x")
    return map_rows(dealt, run, "cell long, x long, w long", {"cell": pa.int64(), "x": pa.int64(), "w": pa.int64()})


def _often_met(cells: DataFrame, similarity: float) -> DataFrame:
    """The rows of sets that meet others as often as a similar one would make them (an exact condition)."""
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.lit(similarity) * F.col("w") - 1e-9) / EXTRA))
    kept = cells.groupBy("x").agg(F.count(F.lit(1)).alias("met"), F.max("w").alias("w")).filter(F.col("met") >= least)
    return cells.join(kept.select("x"), "x", "left_semi")


def set_distance(similarity: float):
    """Jaccard distance of packed sorted sets; 1 where the sizes alone put it beyond 2 theta."""
    least = 1 - 2 * (1 - similarity) - 1e-9

    def distance(p: bytes, q: bytes) -> float:
        n, m = len(p) >> 3, len(q) >> 3
        if min(n, m) < least * max(n, m):
            return 1.0
        both = len(np.intersect1d(np.frombuffer(p, _U), np.frombuffer(q, _U), assume_unique=True))
        return 1 - both / (n + m - both)

    return distance


def sketch(s: np.ndarray) -> bytes:
    """Size of a set and the parities of its shingles in 2 n buckets or more (a power of two): a thirtieth of the
    set.  Each bucket whose parity differs between two sets holds a shingle that only one of them has."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return len(s).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def distance_bounds(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Lower bounds of the Jaccard distances of sets by their sketches: with D shingles that only one set has,
    the distance is 2 D / (n + m + D), and D is at least the number of buckets of different parity."""
    out = np.empty((len(a), len(b)))
    n, m = (np.array([int.from_bytes(s[:8], "little") for s in x], np.int64) for x in (a, b))
    by_size: dict[int, list[int]] = {}
    for k, s in enumerate(a):
        by_size.setdefault(len(s) - 8, []).append(k)
    for size, rows in by_size.items():
        own = np.frombuffer(b"".join([a[k][8:] for k in rows]), _U).reshape(len(rows), size // 8)
        for j, s in enumerate(b):
            words = min(size, len(s) - 8) // 8
            other = _folded(np.frombuffer(s, _U, offset=8), words)
            differ = np.bitwise_count(_folded(own, words) ^ other).sum(1, dtype=np.int64)
            only = np.maximum(differ, np.abs(n[rows] - m[j]))
            out[rows, j] = 2 * only / (n[rows] + m[j] + only)
    return out


def _rooted(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """One row per document: doc_id, row (hash of its text), n (shingles), root (its component; null without words)."""
    texts = id_text(docs)
    first = materialize(_first_pass(texts, size), "ngram-first")
    path = first.filter("kind = 0").select(F.col("k").alias("doc_id"), F.col("v").alias("node"), "n", "row")
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(first))  # at most MOST numbers

    def windows(batches: Iterator[pa.RecordBatch]):
        shingler, seen = Shingler(size), set()
        for batch in batches:
            for part in slices(batch):
                new = []
                for s in shingler.sets(part.column("text").to_pylist()):
                    if len(s) and (name := node_of(s)) not in seen:  # a task names a node once
                        seen.add(name)
                        new.append((name, len(s), window(s, common.value, similarity)))
                if len(seen) > 500_000:
                    seen = set()
                lengths = [len(v) for _, _, v in new]
                yield {"cell": np.concatenate([v for _, _, v in new] or [np.zeros(0, _U)]).view(np.int64),
                       "x": np.repeat(np.array([x for x, _, _ in new], np.int64), lengths),
                       "w": np.repeat(np.array([n for _, n, _ in new], np.int64), lengths)}

    rows = map_rows(texts.select("text"), windows, "cell long, x long, w long",
                    {"cell": pa.int64(), "x": pa.int64(), "w": pa.int64()})
    shared = materialize(keep_shared(rows), "ngram-cells")
    cells = materialize(one_cell_each(_often_met(shared, similarity)), "ngram-cells")
    discard(shared)
    bits = docs.sparkSession.sparkContext.broadcast(wanted_filter(cells.select("x")))  # 8 MB at any size
    names = cells.select("x").distinct()
    sets = materialize(_sets(texts, size, bits).join(names, "x", "left_semi").dropDuplicates(["x"]), "ngram-sets")
    links = link_cells(cells, sets, set_distance(similarity), 1 - similarity + 1e-12,
                       near_sizes=lambda w, v: F.least(w, v) >= F.lit(similarity - 1e-9) * F.greatest(w, v),
                       bounds=distance_bounds)
    comps = components(links).withColumnRenamed("component", "root")
    discard(cells, sets)
    return path.join(comps, "node", "left").select(
        "doc_id", "row", "n", F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("root"))


def ngram_components(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    rooted = _rooted(docs, size, similarity).drop("row")
    named = rooted.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(named, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _sets(texts: DataFrame, size: int, bits) -> DataFrame:
    """(x, its shingles, their sketch) of the nodes that the filter lets through, each once a task."""

    def run(batches: Iterator[pa.RecordBatch]):
        shingler, seen = Shingler(size), set()
        for batch in batches:
            for part in slices(batch):
                found = []
                for s in shingler.sets(part.column("text").to_pylist()):
                    if len(s) and (x := node_of(s)) not in seen and maybe_wanted(bits.value, x):
                        seen.add(x)
                        found.append((x, s.tobytes(), sketch(s)))
                yield {"x": [x for x, _, _ in found], "p": [p for _, p, _ in found], "s": [s for _, _, s in found]}

    return map_rows(texts.select("text"), run, "x long, p binary, s binary",
                    {"x": pa.int64(), "p": pa.binary(), "s": pa.binary()})


def one_of_each(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest doc_id (a null
    doc_id comes last), then the smallest hash of its text; of repeated rows, one.  Documents without words
    are no group and stay."""
    alone = F.col("n") == 0
    best = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("d"), F.col("row").alias("r"))
    keep = _rooted(docs, size, similarity).groupBy("root", F.when(alone, best)).agg(F.min(best).alias("best")).select(
        F.coalesce("best.d", F.lit(0)).alias("i"), F.col("best.d").isNull().alias("no_i"), F.col("best.r").alias("r"))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(doc_id, F.lit(0)).alias("i"), doc_id.isNull().alias("no_i"),
                       F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("r"),
                       F.col("text").isNull().alias("no_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(keep, ["i", "no_i", "r"], "left_semi")
    # only repeated rows of one id meet here; they hold equal texts (the texts are dealt once, for both steps)
    return kept.groupBy("i", "no_i", "r", "no_text").agg(F.first("row").alias("row")).select("row.*")
