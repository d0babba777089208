"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer when the smallest hash among its inner s-mers is the first or
the last one.  That depends on the k-mer alone, so an edit elsewhere moves no anchor.  A fingerprint keeps
the hash and place of every closed syncmer of the whole text, in order of place: packed as all 32-bit
hashes, then one byte a gap between places (k - s consecutive k-mers hold an anchor, so gaps are below
that), as base64 text.  Two fingerprints are matched by position: the longest chain of equal hashes that rises in both.
With J the chain over the anchors of both (repeats counted), likeness is Dice's 2 J / (1 + J): about the
share of text they have in common.

Defined cases: a null text is empty; a text shorter than k, or too short to hold a closed syncmer, is one
anchor (the hash of the whole text); an empty text alone has no anchors, and two empty fingerprints have
likeness 1; equal texts have equal fingerprints; rows with equal doc_id are ordered by text, a null doc_id
comes first; a single document is its own next one; an empty table gives an empty result; extra columns
are ignored; long texts are worked on whole, one at a time.
"""

from __future__ import annotations

import base64
import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import id_text, map_rows, shuffle_partitions

#: K-mer and s-mer lengths in code points, most anchors kept (all are), multipliers of the rolling hash.
K, S, ANCHORS = 20, 8, math.inf
_M1, _M2, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)


def _power(m: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(m), n, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _whole(h1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A whole text as its one anchor."""
    whole = np.uint64(0)
    for x in h1:
        whole = np.uint64((int(whole) * int(_M1) + int(x)) & 0xFFFFFFFFFFFFFFFF)
    return (_mix(np.array([whole])) >> np.uint64(32)).astype(np.uint32), np.zeros(1, np.int64)


def closed_syncmers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes and places of the closed syncmers of a text."""
    n = len(text)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h1 = _mix((c + np.uint64(1)) * _M2)
    if n < K:
        return _whole(h1)
    h2 = h1[:-1] * _M1 + h1[1:]
    h4 = h2[:-2] * _power(_M1, 2) + h2[2:]
    h8 = h4[:-4] * _power(_M1, 4) + h4[4:]
    order = _mix(h8)
    span = K - S + 1  # 13 inner s-mers
    low = np.minimum(order[:-1], order[1:])
    low = np.minimum(low[:-2], low[2:])
    low = np.minimum(low[:-4], low[4:])
    low = np.minimum(low[:-(span - 8)], low[span - 8:])
    m = n - K + 1
    at = np.flatnonzero((order[:m] == low[:m]) | (order[span - 1:span - 1 + m] == low[:m]))
    if not len(at):
        return _whole(h1)
    h = h8[at] * _power(_M1, 12) + h8[at + 8] * _power(_M1, 4) + h4[at + 16]
    return (_mix(h) >> np.uint64(32)).astype(np.uint32), at


def anchors_of(text: str) -> np.ndarray:
    """Rows (hash, place) of all closed syncmers, in order of place."""
    hashes, places = closed_syncmers(text)
    return np.column_stack([hashes.astype(np.int64), places])


def packed(found: np.ndarray) -> str:
    gaps = np.diff(found[:, 1], prepend=0).astype(np.uint8)
    return base64.b64encode(found[:, 0].astype("<u4").tobytes() + gaps.tobytes()).decode()


def unpacked(text: str) -> np.ndarray:
    data = base64.b64decode(text)
    n = len(data) // 5
    places = np.cumsum(np.frombuffer(data, np.uint8, n, 4 * n), dtype=np.int64)
    return np.column_stack([np.frombuffer(data, "<u4", n).astype(np.int64), places])


def fingerprint(text: str) -> str:
    return packed(anchors_of(text))


def _same_start(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def longest_chain(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    done = 0
    for _ in range(2):  # what only one holds, and equal starts and ends, need no search
        a = a[np.isin(a, b)]
        b = b[np.isin(b, a)]
        k = _same_start(a, b)
        a, b = a[k:], b[k:]
        e = _same_start(a[::-1], b[::-1])
        a, b, done = a[:len(a) - e], b[:len(b) - e], done + k + e
    if not len(a) or not len(b):
        return done
    codes = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    a, b = codes[:len(a)], codes[len(a):]
    n = int(codes.max()) + 1
    pairs = int((np.bincount(a, minlength=n) * np.bincount(b, minlength=n)).sum())
    return done + (_chain_by_pairs if pairs <= 16 * len(codes) else _chain_by_bits)(a.tolist(), b.tolist())


def _chain_by_pairs(a: list[int], b: list[int]) -> int:
    """Longest rising chain of the places of equal anchors: time by their number."""
    where: dict[int, list[int]] = {}
    for p in range(len(b) - 1, -1, -1):
        where.setdefault(b[p], []).append(p)
    tails: list[int] = []
    for x in a:
        for p in where.get(x, ()):
            k = bisect_left(tails, p)
            tails[k:k + 1] = [p]
    return len(tails)


def _chain_by_bits(a: list[int], b: list[int], block: int = 1 << 13) -> int:
    """The same for texts of many repeats: bit-parallel over blocks of ``a``, one carry per element of ``b``."""
    carry, found = bytearray(len(b)), 0
    for lo in range(0, len(a), block):
        masks: dict[int, int] = {}
        for k, x in enumerate(a[lo:lo + block]):
            masks[x] = masks.get(x, 0) | 1 << k
        n = min(block, len(a) - lo)
        full = v = (1 << n) - 1
        for k, x in enumerate(b):
            m = masks.get(x, 0)
            if m or carry[k]:
                u = v & m
                total = v + u + carry[k]
                carry[k] = total >> n
                v = (total & full) | (v ^ u)
        found += n - v.bit_count()
    return found


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = (np.asarray(x, np.int64).reshape(-1, 2)[:, 0] for x in (a, b))
    if np.array_equal(a, b):
        return 1.0
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, k = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    j = longest_chain(a, b) / (len(a) + len(b) - int(np.minimum(n[i], m[k]).sum()))
    return 2 * j / (1 + j)


def _bucket(key: Column, cuts: list[int], base: int = 0) -> Column:
    """Index of the range that holds ``key``: a balanced tree of comparisons."""
    if not cuts:
        return F.lit(base)
    mid = len(cuts) // 2
    return F.when(key < cuts[mid], _bucket(key, cuts[:mid], base)).otherwise(
        _bucket(key, cuts[mid + 1:], base + mid + 1))


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows (bucket, guest, key, doc_id, text), sorted within partitions so that each bucket's documents
    follow one another by doc_id and end with a guest: the first document of the next bucket.  The text
    is shuffled once; the driver sees one cut and one first id per bucket."""
    spark = docs.sparkSession
    buckets = buckets or shuffle_partitions(spark)
    keyed = id_text(docs).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    probs = [i / buckets for i in range(1, buckets)] or [0.5]
    cuts = keyed.select(F.percentile_approx("key", probs, 10_000).alias("c")).first()["c"] or []
    keyed = keyed.withColumn("bucket", _bucket(F.col("key"), sorted(set(cuts))))
    firsts = [(r["bucket"], r["key"]) for r in
              keyed.groupBy("bucket").agg(F.min("key").alias("key")).orderBy("bucket").collect()]
    before = [(key, firsts[i - 1][0]) for i, (_, key) in enumerate(firsts)]
    guests = spark.createDataFrame(before or [(0, -1)], "key long, host int")  # at most one row per bucket
    both = keyed.join(F.broadcast(guests), "key", "left").withColumn("to", F.explode(F.when(
        F.col("host").isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guest")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guest")),
                F.struct(F.col("host").alias("b"), F.lit(1).alias("guest"))))))
    return both.select(F.col("to.b").alias("bucket"), F.col("to.guest").alias("guest"), "key", "doc_id", "text") \
        .repartition(buckets, "bucket").sortWithinPartitions("bucket", "guest", "key", "text")


DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")
_TYPES = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
          "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text (the last half replaced by the start of the
    next document), and how alike they are."""

    def run(batches: Iterator[pa.RecordBatch]):
        held = None  # bucket, doc_id, text, anchors of the row that waits for its next one
        for batch in batches:
            out: dict[str, list] = {k: [] for k in _TYPES}
            for bucket, doc_id, guest, text in zip(*(batch.column(c).to_pylist()
                                                     for c in ("bucket", "doc_id", "guest", "text"))):
                if held is None and guest:
                    continue
                own = anchors_of(text)
                if held is not None:
                    _, prev_id, prev, prev_own = held
                    half = len(prev) // 2
                    edited = prev[:len(prev) - half] + text[:half]
                    changed = anchors_of(edited)
                    for k, v in zip(_TYPES, (prev_id, len(prev),
                                             hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                                             packed(prev_own), packed(changed), likeness(prev_own, changed),
                                             likeness(prev_own, own))):
                        out[k].append(v)
                held = None if guest else (bucket, doc_id, text, own)
            yield out

    return map_rows(with_next(docs), run, DDL, _TYPES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every document, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield {"doc_id": batch.column("doc_id"), "n_chars": [len(t) for t in texts],
                   "fingerprint": [fingerprint(t) for t in texts]}

    return map_rows(id_text(docs), run, "doc_id long, n_chars long, fingerprint string", _TYPES)
