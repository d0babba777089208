"""Importance resampling towards a target text by hashed n-grams.

Features are the runs of one to three words; a feature's bucket is the CRC-32 of its bytes modulo
``BUCKETS``.  A worker keeps a dictionary of distinct words, each bounded by delimiters on both sides, in an
Aho-Corasick automaton; a word's payload is its CRC and its length.  One scan of a text emits the payloads
of its words in order, and the CRC of a run comes from its words' payloads alone: appending a word of
length k to a text shifts the text's CRC by k zero bytes (a linear map, four table look-ups) and adds the
word's.  Words that the dictionary does not hold (new ones, very long ones, all beyond its bound) get their
payload directly, so every word is counted, and new words enter the dictionary as it is rebuilt.

The corpus is counted by bucket (a row for each task and bucket), the target likewise; each bucket's gain
compares the two.  A document's weight is the sum of its features' gains; Gumbel noise from its id makes the
highest scores a weighted draw without replacement, ranked by ordered ranges of the scores.

Defined cases: a null text has no words; a row without a doc_id takes its noise from an empty id and comes
last among ties; rows equal in score and id are ranked by features and weight, then in any order; an empty
corpus or target counts zero; extra columns are ignored; long texts are scanned whole, piece by piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import id_text, map_rows, slices, worker_state
from pairlab.operators.ranking import numeric_cut_bucket, with_global_rank
from pairlab.session import materialize

#: Fixed values of the contract.
BUCKETS, LONGEST_RUN, LEAST_WORDS, DRAWN_PERCENT, SEED = 10_000, 3, 20, 5, 42
#: The dictionary's bounds (words of a worker, characters of a word) and the piece of a text that is scanned at once.
MOST_WORDS, LONGEST_WORD, PIECE = 100_000, 48, 1 << 20
_POLY = 0xEDB88320
#: ASCII to lower case; what is no letter, digit or part of a longer character becomes a blank.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_U32 = np.uint32


def _byte_table() -> np.ndarray:
    """What one zero byte makes of each low byte of a CRC register."""
    t = np.arange(256, dtype=_U32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ _U32(_POLY), t >> 1)
    return t


class Shift:
    """CRCs after k more zero bytes, for many CRCs and their ks at once."""

    def __init__(self, longest: int):
        byte = _byte_table()
        powers = np.zeros((longest + 1, 4, 256), _U32)
        for part in range(4):
            powers[0, part] = np.arange(256, dtype=_U32) << _U32(8 * part)
        for k in range(longest):
            powers[k + 1] = byte[powers[k] & 0xFF] ^ (powers[k] >> _U32(8))
        self.longest, self.tables = longest, powers.reshape(-1)

    def __call__(self, crc: np.ndarray, k: np.ndarray) -> np.ndarray:
        left = k
        while len(left) and left.max() > self.longest:  # long words: step by step
            step = np.minimum(left, self.longest)
            crc, left = self._once(crc, step), left - step
        return self._once(crc, left)

    def _once(self, crc: np.ndarray, k: np.ndarray) -> np.ndarray:
        base = k * 1024
        t = self.tables
        return (t[base + (crc & 0xFF)] ^ t[base + 256 + ((crc >> 8) & 0xFF)]
                ^ t[base + 512 + ((crc >> 16) & 0xFF)] ^ t[base + 768 + (crc >> 24)])


class Dictionary:
    """Delimiter-bounded words with (length << 32 | crc) payloads in an automaton that grows with the texts."""

    def __init__(self, most: int = MOST_WORDS):
        self.most, self.words, self.new, self.automaton = most, {}, 0, None
        self.shift = Shift(2 * LONGEST_WORD)

    def payload(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            raw = word.encode("utf-8", "surrogatepass")
            found = len(raw) << 32 | zlib.crc32(raw)
            if len(word) <= LONGEST_WORD and len(self.words) < self.most:
                self.words[word] = found
                self.new += 1
        return found

    def _rebuilt(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, word in enumerate(self.words):
            self.automaton.add_word(f" {word} ", k)
        self.automaton.make_automaton()
        self.table = np.fromiter(self.words.values(), np.int64)  # the automaton holds 32 bits a word: its place here
        self.new = 0

    def scan(self, plain: str) -> tuple[np.ndarray, np.ndarray]:
        """Payloads and end places of the words of a text that starts and ends with a blank."""
        blank = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32) == 32
        ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
        out = np.zeros(len(ends), np.int64)
        if self.automaton is not None and len(self.table) and len(ends):
            hits = np.fromiter(chain.from_iterable(self.automaton.iter(plain)), np.int64).reshape(-1, 2)
            out[np.searchsorted(ends, hits[:, 0])] = self.table[hits[:, 1]]
        if len(unknown := np.flatnonzero(out == 0)):
            starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
            for k, a, b in zip(unknown.tolist(), starts[unknown].tolist(), ends[unknown].tolist()):
                out[k] = self.payload(plain[a:b])
            if self.new > max(2000, len(self.words) // 4) or (self.new and len(self.words) == self.most):
                self._rebuilt()
        return out, ends

    def payloads(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Payloads of the words of all texts, and how many words each text has."""
        raws = [t.encode("utf-8", "surrogatepass").translate(_PLAIN) for t in texts]
        sizes = [len(r) for r in raws]
        joined = b" " + b" ".join(raws) + b" "
        found, counts = [], np.zeros(len(texts), np.int64)
        starts = np.cumsum([1, *[n + 1 for n in sizes]])  # bytes where texts start
        at = 0
        while at < len(joined) - 1:
            end = joined.find(b" ", min(at + PIECE, len(joined) - 1))  # a piece ends with a blank, the next starts with it
            piece = joined[at:end + 1].decode("utf-8", "surrogatepass")
            words, ends = self.scan(piece)
            found.append(words)
            if len(piece) != end + 1 - at:  # places in bytes, to tell whose word it is
                wide = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
                ends = np.cumsum(1 + (wide > 0x7F) + (wide > 0x7FF).astype(np.int64) + (wide > 0xFFFF))[ends - 1]
            counts += np.bincount(np.searchsorted(starts, at + ends - 1, side="right") - 1, minlength=len(texts))[:len(texts)]
            at = end
        return np.concatenate(found or [np.zeros(0, np.int64)]), counts

    def buckets(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all features, and which text each is of."""
        owner = np.repeat(np.arange(len(counts)), counts)
        crc, size = (words & 0xFFFFFFFF).astype(_U32), words >> 32
        tail = self.shift(np.full(len(crc), zlib.crc32(b" "), _U32), size) ^ crc  # a blank and the word
        run, out, whose = crc, [crc % BUCKETS], [owner]
        for n in range(2, LONGEST_RUN + 1):
            if len(words) < n:
                break
            run = self.shift(run[:-1], size[n - 1:] + 1) ^ tail[n - 1:]
            own = owner[n - 1:] == owner[:len(run)]
            out.append((run % BUCKETS)[own])
            whose.append(owner[n - 1:][own])
        return np.concatenate(out).astype(np.int64), np.concatenate(whose)


def _dictionary() -> Dictionary:
    return worker_state("importance_words", Dictionary)


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n) of the features of all texts."""

    def run(batches: Iterator[pa.RecordBatch]):
        words, total = _dictionary(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, 2_000_000):
                total += np.bincount(words.buckets(*words.payloads(part.column("text").to_pylist()))[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield {"bucket": some, "n": total[some]}

    return map_rows(texts.select("text"), run, "bucket long, n long", {"bucket": pa.int64(), "n": pa.int64()}) \
        .groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of every bucket from (bucket, n) of both sides; the table has ``BUCKETS`` rows at any size."""
    both = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full_outer")
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in both.collect():
        s[r["bucket"]], t[r["bucket"]] = r["s"] or 0, r["t"] or 0
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weights(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""

    def run(batches: Iterator[pa.RecordBatch]):
        words = _dictionary()
        for batch in batches:
            for part in slices(batch, 2_000_000):
                found, counts = words.payloads(part.column("text").to_pylist())
                bucket, owner = words.buckets(found, counts)
                total = np.zeros(len(counts), np.int64)
                np.add.at(total, owner, gains[bucket])
                yield {"doc_id": part.column("doc_id"), "n_words": counts,
                       "n_features": np.bincount(owner, minlength=len(counts)), "weight": total}

    return map_rows(id_text(docs), run, "doc_id long, n_words long, n_features long, weight long",
                    dict.fromkeys(("doc_id", "n_words", "n_features", "weight"), pa.int64()))


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS,
             seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, and its rank if it is drawn."""
    gains = bucket_gains(materialize(bucket_counts(id_text(docs)), "importance-corpus"),
                         bucket_counts(target.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))))
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    noise = F.floor(-1000 * F.log(-F.log((F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0)))
    scored = materialize(weights(docs, gains).withColumn("score", (F.col("weight") + noise).cast("long")), "importance-scores")
    able = scored.filter(F.col("n_words") >= least_words).withColumn("low", -F.col("score"))
    order = [F.col("low"), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranked = with_global_rank(able, order, "rank", bucket=numeric_cut_bucket(able, "low"), total_col="able")
    drawn = F.when(F.col("rank") <= F.floor(F.lit(percent) * F.col("able") / 100), F.col("rank"))
    return ranked.withColumn("rank", drawn).select("doc_id", "n_features", "weight", "score", "rank").unionByName(
        scored.filter(F.col("n_words") < least_words).select(
            "doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
