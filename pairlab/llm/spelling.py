"""Spelling variants by a bit-sliced position index.

Words are runs of Latin letters, counted over the whole corpus.  Two words are near if one code point is
inserted, deleted or replaced.  In a block of words the index holds, for each (position, letter), the set
of the words with that letter there as one bit a word.  A query word is run through the index letter by
letter; word-parallel recurrences keep the words that agree so far (no error) and, each shifted by its
own offset, those that agree but for one replaced, one additional or one missing letter:

    same'     = same & at[j][c]
    replaced' = replaced & at[j][c]  |  same & longer[j] & ~at[j][c]
    added'    = added & at[j + 1][c]  with  added |= same & longer[j]
    missing'  = missing & at[j - 1][c]  |  same

Blocks make the vocabulary fit into tasks without losing a pair.  A near pair whose shorter word has m
letters and whose common prefix has e letters shares that prefix and all letters after the error.  A block
stands for m and a range [lo, hi) of e: its words share their first lo letters and their last m - hi.
Ranges start as two halves of 0..m; blocks of over ``block`` words are halved again until the range is one
place, where no more words exist than there are letters to put in.  Each pair lies in exactly one block,
so counts add up and pairs are never written out.

Defined cases: a null or empty text has no words; repeated rows count again; a row without a doc_id is
hashed with an empty id; ties of the largest count go to the smallest word in code-point order; an empty
table gives an empty result; extra columns are ignored; texts are read whole, of any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import id_text, map_rows
from pairlab.session import discard, materialize

#: Fixed values of the contract.
LEAST_LENGTH, LEAST_COUNT, LOSS, TIMES = 7, 2, 31, 10
RUN = re.compile(r"[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words in a block (larger ones are halved), and distinct words a task holds before it passes counts on.
BLOCK, HELD = 4096, 400_000


def words_of(doc_id, text: str) -> Iterator[tuple[str, int]]:
    """The distinct long runs of a text, as its document spells them, with their counts."""
    low = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
    head = "" if doc_id is None else str(doc_id)
    for run, n in Counter(RUN.findall(low)).items():
        h = zlib.crc32(f"{head}:{run}".encode())
        if h % LOSS == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= LEAST_LENGTH:
            yield run, n


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for word, n in words_of(doc_id, text):
                    held[word] += n
                if len(held) >= HELD:
                    yield {"word": list(held), "n": list(held.values())}
                    held = Counter()
        yield {"word": list(held), "n": list(held.values())}

    counts = map_rows(id_text(docs), run, "word string, n long", {"word": pa.string(), "n": pa.int64()})
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _block() -> Column:
    """The block's name: what its words have in common."""
    size = F.char_length("word")
    tail = F.greatest(F.col("m") - F.col("hi"), F.lit(0))
    return F.concat_ws("\u0001", F.col("m"), F.col("lo"), F.col("hi"), F.substring("word", F.lit(1), F.col("lo")),
                       F.substring("word", size - tail + 1, tail))


def _ranges(*edges: Column) -> Column:
    return F.explode(F.array(*[F.struct(a.cast("int").alias("lo"), b.cast("int").alias("hi"))
                               for a, b in zip(edges, edges[1:])]))


def blocks(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block, m, lo, hi, word, n): every word in the blocks where it may meet its near words."""
    size = F.char_length("word")
    sized = words.withColumn("m", F.explode(F.array(size, size - 1))).filter(F.col("m") >= LEAST_LENGTH)
    rows = sized.withColumn("r", _ranges(F.lit(0), F.floor(F.col("m") / 2), F.col("m") + 1)).select(
        "m", "r.lo", "r.hi", "word", "n").withColumn("block", _block())
    done = []
    while True:
        rows = materialize(rows.select("block", "m", "lo", "hi", "word", "n"), "spelling-blocks")
        large = rows.groupBy("block").agg(F.count(F.lit(1)).alias("words"), F.max(F.col("hi") - F.col("lo")).alias("wide")) \
            .filter((F.col("words") > block) & (F.col("wide") > 1)).select("block")
        large = materialize(large, "spelling-large")
        if not large.limit(1).count():
            done.append(rows)
            break
        done.append(rows.join(large, "block", "left_anti"))
        mid = F.floor((F.col("lo") + F.col("hi")) / 2)
        rows = rows.join(large, "block", "left_semi").withColumn("r", _ranges(F.col("lo"), mid, F.col("hi"))).select(
            "m", "r.lo", "r.hi", "word", "n").withColumn("block", _block())
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every


class Index:
    """One block's words as bitsets by (position, letter); bit 0 is the word of the largest count."""

    def __init__(self, words: list[str], m: int, hi: int):
        self.m, self.hi = m, hi
        self.at: list[dict[str, int]] = [{} for _ in range(m + 2)]
        self.size = [0] * (m + 2)  # words of this length
        self.longer = [0] * (m + 2)  # words with a letter at this position
        for k, word in enumerate(words):
            bit = 1 << k
            self.size[len(word)] |= bit
            for j, c in enumerate(word):
                self.at[j][c] = self.at[j].get(c, 0) | bit
                self.longer[j] |= bit
        self.every = (1 << len(words)) - 1

    def near(self, word: str) -> int:
        """The words with one error whose common prefix with ``word`` is shorter than ``hi``."""
        same, replaced, added, missing, beyond = self.every, 0, 0, 0, 0
        at, longer = self.at, self.longer
        for j, c in enumerate(word):
            if j == self.hi:
                beyond = same
            here = at[j].get(c, 0)
            added |= same & longer[j]
            missing = missing & at[j - 1].get(c, 0) | same if j else same
            added &= at[j + 1].get(c, 0) if j + 1 < len(at) else 0
            replaced = replaced & here | same & longer[j] & ~here
            same &= here
        n = len(word)
        if n == self.hi:
            beyond = same
        found = 0
        if n == self.m:
            found = replaced & self.size[n]
            if n + 1 < len(self.size):
                found |= (added | same & longer[n]) & self.size[n + 1]
        elif n == self.m + 1:
            found = missing & self.size[n - 1]
        return found & ~beyond


def near_words(block_rows: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words with near words, a row for each block that holds some."""
    names = ("word", "n_near", "best", "best_n")

    def run(batches: Iterator[pa.RecordBatch]):
        head, rows = None, []

        def settled():
            rows.sort(key=lambda r: (-r[1], r[0]))
            words = [w for w, _ in rows]
            index, out = Index(words, head[1], head[2]), []
            for w in words:
                if found := index.near(w):
                    best = rows[(found & -found).bit_length() - 1]
                    out.append((w, found.bit_count(), *best))
            yield dict(zip(names, zip(*out))) if out else dict.fromkeys(names, [])

        for batch in batches:
            for block, m, hi, word, n in zip(*(batch.column(k).to_pylist() for k in ("block", "m", "hi", "word", "n"))):
                if head is None or block != head[0]:
                    if len(rows) > 1:
                        yield from settled()
                    head, rows = (block, m, hi), []
                rows.append((word, n))
        if len(rows) > 1:
            yield from settled()

    dealt = block_rows.select("block", "m", "hi", "word", "n").repartition("block").sortWithinPartitions("block")
    return map_rows(dealt, run, "word string, n_near long, best string, best_n long",
                    {"word": pa.string(), "n_near": pa.int64(), "best": pa.string(), "best_n": pa.int64()})


def spelling_forms(docs: DataFrame, times: int = TIMES, least: int = LEAST_COUNT, block: int = BLOCK) -> DataFrame:
    """One row per word: word, n, n_near (near words), form (the near word of largest count, if that is
    ``times`` the word's own), form_n, root (the last word when forms are followed)."""
    words = materialize(vocabulary(docs, least), "spelling-words")
    near = near_words(blocks(words, block)).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("b"))
    fits = -F.col("b.n") >= times * F.col("n")
    table = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("b.w")).alias("form"), F.when(fits, -F.col("b.n")).alias("form_n")), "spelling-near")
    # counts grow `times` fold along a chain, so a few doublings follow it to its end
    roots = materialize(table.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        steps = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(roots.join(steps, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(roots)
        roots = after.select("word", "root")
        if not after.filter("moved").limit(1).count():
            break
    return table.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
