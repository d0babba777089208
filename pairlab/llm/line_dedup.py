"""Near-duplicate lines by a segment-partition edit join.

Lines (split at \\n, holding a word) are collapsed to distinct ones.  If two lines of at least
``min_chars`` are within edit distance ``threshold`` of each other, one of the shorter line's
``threshold + 1`` segments occurs in the longer line near its own place.  Each line is listed under the
hashes of its own segments (by length and number) and of the substrings at the places where a segment of
an equally long or shorter line could be (the multi-match-aware choice: 12 keys in all for threshold 2).
Lines under a common key are candidates; crowded keys are narrowed by pivots (``regions.link_cells``), as
edit distance is a metric, and by sketches that bound it from below.  Candidates that the sketches leave are
verified on the whole lines by the edit distance itself.  Linked lines form a class; its first
occurrence by (doc_id, line number, hash of the text) stays.

Defined cases: a null text has no lines; lines shorter than ``min_chars`` are equal or different; a row is
known by its doc_id and the hash of its whole text, so rows without an id or with equal ids keep lines of
their own, and only rows equal in both are the same occurrence (both stay or both go); a null doc_id comes
last; an empty table gives an empty result; extra columns are carried by ``drop_duplicate_lines``; the
length of lines and texts is not limited.  Lines are named by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import WS, id_text, map_rows, slices
from pairlab.llm.components import components
from pairlab.llm.ngram_join import keep_shared
from pairlab.llm.regions import link_cells, maybe_wanted, one_cell_each, wanted_filter
from pairlab.session import discard, materialize

THRESHOLD, MIN_CHARS = 2, 30
#: Buckets of a line's sketch (a power of two).
BITS = 512
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def lines_of(text: str) -> list[tuple[int, str]]:
    """(number, line) of the lines that hold a word."""
    return [(k, line) for k, line in enumerate(text.split("\n")) if line.strip(WS)]


def name_of(line: str) -> int:
    digest = hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest, "big", signed=True)


def segment(length, number: int, parts: int):
    """Start and length of a segment (number from 0) of a line; the last ``length % parts`` are longer."""
    short, extra = length // parts, length % parts
    longer = np.maximum(0, number - (parts - extra))
    return number * short + longer, short + (number >= parts - extra)


def places(threshold: int) -> list[tuple[int, int, int]]:
    """(by how much the other line is shorter, segment, offset from its place there) to look at."""
    out = []
    for less in range(threshold + 1):
        for i in range(1, threshold + 2):
            lo = max(-(i - 1), less - (threshold + 1 - i))
            hi = min(i - 1, less + (threshold + 1 - i))
            out += [(less, i - 1, o) for o in range(lo, hi + 1)]
    return out


class Segments:
    """Hashes of substrings of many lines at once, by prefix sums of a polynomial modulo 2^64."""

    def __init__(self, threshold: int, min_chars: int):
        self.threshold, self.min_chars = threshold, min_chars
        self.places = places(threshold)
        self._grow(1 << 20)

    def _grow(self, n: int) -> None:
        self.powers, self.inverse = np.ones(n, _U), np.ones(n, _U)
        np.multiply.accumulate(np.full(n - 1, _BASE, _U), out=self.powers[1:])
        np.multiply.accumulate(np.full(n - 1, pow(_BASE, -1, 1 << 64), _U), out=self.inverse[1:])

    def keys(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(keys, which line each is of)."""
        sizes = np.array([len(x) for x in lines], np.int64)
        if not len(lines):
            return np.zeros(0, _U), sizes
        chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
        if len(chars) >= len(self.powers):
            self._grow(2 * len(chars))
        mixed = (chars + _U(1)) * _U(0xD6E8FEB86659FD93)
        mixed ^= mixed >> _U(32)
        sums = np.concatenate([[_U(0)], np.cumsum(mixed * self.powers[:len(chars)], dtype=_U)])
        starts = np.cumsum(sizes) - sizes
        at = np.arange(len(lines))
        keys, owner = [], []
        for less, number, offset in self.places:
            other = sizes - less
            p, q = segment(other, number, self.threshold + 1)
            a = p + offset
            good = (other >= self.min_chars) & (a >= 0) & (a + q <= sizes)
            a, q = (starts + a)[good], q[good]
            h = (sums[a + q] - sums[a]) * self.inverse[a]
            h = h + other[good].astype(_U) * _U(0xA24BAED4963EE407) + _U(number + 1) * _U(0x9FB21C651E98DF25)
            h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
            keys.append(h ^ (h >> _U(27)))
            owner.append(at[good])
        return np.concatenate(keys), np.concatenate(owner)


def _alike(a: str, b: str, i: int, j: int) -> int:
    """Where in ``a`` the stretch ends that ``a`` from i and ``b`` from j have in common: by slices of doubled, then halved, length."""
    n = 16
    while i + n <= len(a) and a[i:i + n] == b[j:j + n]:
        i, j, n = i + n, j + n, 2 * n
    while n:
        if i + n <= len(a) and a[i:i + n] == b[j:j + n]:
            i, j = i + n, j + n
        n >>= 1
    return i


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance if at most ``most``, else ``most + 1``: how far each diagonal gets with no edit, one, two
    and so on, so that the steps do not grow with the lines."""
    if len(a) < len(b):
        a, b = b, a
    lean = len(a) - len(b)
    if lean > most:
        return most + 1
    far = {0: _alike(a, b, 0, 0)}
    for edits in range(most + 1):
        if edits:
            last, far = far, {}
            for d in range(max(-edits, lean - most + edits), min(edits, lean + most - edits) + 1):  # place in a less that in b
                i = max(last.get(d, -2) + 1, last.get(d - 1, -2) + 1, last.get(d + 1, -1))
                i = min(i, len(a), len(b) + d)
                if i >= max(0, d):
                    far[d] = _alike(a, b, i, i - d)
        if far.get(lean, -1) == len(a):
            return edits
    return most + 1


def sketch(line: str) -> bytes:
    """Length of a line and the parities of its pairs of neighbouring characters in ``BITS`` buckets.  An edit takes
    or adds four pairs at most."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    at = ((c[:-1] * _U(0xA24BAED4963EE407) + c[1:] + _U(1)) * _U(_BASE)) >> _U(64 - BITS.bit_length() + 1)
    odd = np.bincount(at.astype(np.int64), minlength=BITS) & 1
    return len(c).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8)).tobytes()


def edit_bounds(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Lower bounds of the edit distances of lines by their sketches."""
    x, y = (np.frombuffer(b"".join(s), _U).reshape(len(s), -1) for s in (a, b))
    differ = np.zeros((len(a), len(b)), np.uint16)
    for k in range(1, x.shape[1]):
        differ += np.bitwise_count(x[:, k, None] ^ y[:, k])
    n, m = (z[:, 0].astype(np.int64) for z in (x, y))
    return np.maximum(differ / 4, np.abs(n[:, None] - m))


def _row() -> Column:
    """Names a row beside its doc_id."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _every_line(texts: DataFrame) -> DataFrame:
    names = ("doc_id", "row", "line_no", "x", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch):
                rows = [(i, row, k, name_of(line), len(line)) for i, row, t in
                        zip(*(part.column(c).to_pylist() for c in ("doc_id", "row", "text"))) for k, line in lines_of(t)]
                yield dict(zip(names, zip(*rows))) if rows else dict.fromkeys(names, [])

    return map_rows(texts.withColumn("row", _row()), run, "doc_id long, row long, line_no long, x long, n_chars long",
                    dict.fromkeys(names, pa.int64()))


def _new_lines(batches: Iterator[pa.RecordBatch], min_chars: int, wanted=lambda x: True) -> Iterator[list[tuple[int, str]]]:
    """Long enough lines, each once a task (its memory of names is bounded)."""
    seen: set[int] = set()
    for batch in batches:
        for part in slices(batch, 500_000):
            new = []
            for t in part.column("text").to_pylist():
                for _, line in lines_of(t):
                    if len(line) >= min_chars and (x := name_of(line)) not in seen and wanted(x):
                        seen.add(x)
                        new.append((x, line))
            if len(seen) > 200_000:
                seen = set()
            yield new


def line_links(texts: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """Links (a, b) between names of distinct lines; their components are those of all links."""

    def keyed(batches: Iterator[pa.RecordBatch]):
        parts = Segments(threshold, min_chars)
        for new in _new_lines(batches, min_chars):
            keys, owner = parts.keys([line for _, line in new])
            yield {"cell": keys.view(np.int64), "x": np.array([x for x, _ in new], np.int64)[owner],
                   "w": np.array([len(line) for _, line in new], np.int64)[owner]}

    long_types = {"cell": pa.int64(), "x": pa.int64(), "w": pa.int64()}
    rows = map_rows(texts.select("text"), keyed, "cell long, x long, w long", long_types)
    shared = materialize(keep_shared(rows), "line-cells")
    cells = materialize(one_cell_each(shared), "line-cells")
    discard(shared)
    bits = texts.sparkSession.sparkContext.broadcast(wanted_filter(cells.select("x")))  # 8 MB at any size

    def texts_of(batches: Iterator[pa.RecordBatch]):
        for new in _new_lines(batches, min_chars, lambda x: maybe_wanted(bits.value, x)):
            yield {"x": [x for x, _ in new], "p": [line.encode("utf-8", "surrogatepass") for _, line in new],
                   "s": [sketch(line) for _, line in new]}

    lines = map_rows(texts.select("text"), texts_of, "x long, p binary, s binary",
                     {"x": pa.int64(), "p": pa.binary(), "s": pa.binary()})
    lines = materialize(lines.join(cells.select("x").distinct(), "x", "left_semi").dropDuplicates(["x"]), "line-texts")

    def distance(p: bytes, q: bytes) -> float:
        return float(edit_distance(p.decode("utf-8", "surrogatepass"), q.decode("utf-8", "surrogatepass"), 2 * threshold))

    return link_cells(cells, lines, distance, float(threshold), near_sizes=lambda w, v: F.abs(w - v) <= threshold,
                      bounds=edit_bounds)


def _classes(docs: DataFrame, threshold: int, min_chars: int) -> DataFrame:
    """One row per line that holds a word, with its row, and the first occurrence of its class."""
    texts = id_text(docs)
    every = materialize(_every_line(texts), "lines")
    comps = components(line_links(texts, threshold, min_chars))
    named = every.join(comps.withColumnRenamed("node", "x"), "x", "left") \
        .select("doc_id", "row", "line_no", "n_chars", F.coalesce("component", "x").alias("root"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("d"), F.col("line_no").alias("l"),
                     F.col("row").alias("r"))
    firsts = named.groupBy("root").agg(F.min(place).alias("first"))
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.d")) & (F.col("line_no") == F.col("first.l"))
              & (F.col("row") == F.col("first.r")))
    return named.join(firsts, "root").select(
        "doc_id", "row", "line_no", "n_chars", F.col("first.d").alias("first_doc_id"),
        F.col("first.l").alias("first_line_no"), other.alias("duplicate"))


def line_classes(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line that holds a word: doc_id, line_no, n_chars, first_doc_id and first_line_no (the
    first occurrence of its class), duplicate (it is another occurrence than the first)."""
    return _classes(docs, threshold, min_chars).drop("row")


def drop_duplicate_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without duplicate lines; documents of which no line stays go, all others keep their
    columns, and documents without a duplicate line keep their text as it is."""
    drops = _classes(docs, threshold, min_chars).filter("duplicate").groupBy("doc_id", "row").agg(
        F.collect_set("line_no").alias("gone"))  # bounded by the lines of one text
    drops = drops.select(F.col("doc_id").alias("i"), F.col("row").alias("r"), "gone")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), _row().alias("h"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"))
    both = rows.join(drops, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("r")), "left").select("kept", "gone")
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            columns = batch.column(0).flatten()
            out, keep = [], []
            for text, drop in zip(columns[at].to_pylist(), batch.column(1).to_pylist()):
                if drop is None:
                    out.append(text)
                    keep.append(True)
                    continue
                gone = set(drop)
                left = [line for k, line in enumerate(text.split("\n")) if k not in gone]
                out.append("\n".join(left))
                keep.append(any(line.strip(WS) for line in left))
            columns[at] = pa.array(out, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, docs.schema)
