"""Spelling variants, repeated byte strings and importance resampling against plain versions."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from messy_table import rows_of

from pairlab.llm import repeats
from pairlab.llm.importance import Dictionary, Shift, resample
from pairlab.llm.repeats import Parser, hot_words, without_repeats
from pairlab.llm.spelling import Index, blocks, spelling_forms, vocabulary


def _forms(df):
    return Counter((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def _kept(df):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def _drawn(df):
    return Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect())


def _table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# ---- spelling ------------------------------------------------------------------------

def _spelt():
    rng = random.Random(4)
    stems = ["kitchen", "holiday", "mountain", "überall", "yesterday", "interna", "aaaaaaa", "aaaaaaaa"]
    rows = []
    for i in range(60):
        words = []
        for s in stems:
            words += [s] * 12
            for _ in range(3):  # one edit, sometimes two
                v = s
                for _ in range(rng.choice((1, 1, 2))):
                    k, c = rng.randrange(len(v) + 1), rng.choice("aeiéx")
                    v = rng.choice((v[:k] + c + v[k:], v[:k] + v[k + 1:], v[:k] + c + v[k + 1:]))
                words += [v] * rng.choice((1, 1, 2))
        rng.shuffle(words)
        rows.append((i, ", ".join(words).title() if i % 2 else " ".join(words)))
    return rows


def test_near_words_of_a_block_are_those_one_error_away():
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.choice((7, 8)))) for _ in range(300)})
    index = Index(words, 7, 8)

    def one(a, b):
        a, b = sorted((a, b), key=len)
        return len(a) == len(b) == 7 and sum(x != y for x, y in zip(a, b)) == 1 or (
            len(b) == 8 == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(8)))

    for w in words:
        assert {v for k, v in enumerate(words) if index.near(w) >> k & 1} == {v for v in words if one(v, w)}
    half = Index(words, 7, 3)  # only pairs that differ before place 3
    for w in words:
        assert all(v[:3] != w[:3] for k, v in enumerate(words) if half.near(w) >> k & 1)


@pytest.mark.parametrize("block", [4096, 3])
def test_spelling_forms(spark, block):
    rows = _spelt()
    assert _forms(spelling_forms(_table(spark, rows).repartition(5), block=block)) == brute.spelling(rows)


def test_blocks_are_halved_until_they_fit(spark):
    words = vocabulary(_table(spark, _spelt()))
    sizes = blocks(words, 6).groupBy("block", "lo", "hi").count().collect()
    assert all(r["count"] <= 6 or r["hi"] - r["lo"] == 1 for r in sizes) and any(r["hi"] - r["lo"] > 1 for r in sizes)


def test_spelling_of_messy_and_small_tables(spark, messy, empty, small_docs, small_rows):
    assert _forms(spelling_forms(messy)) == brute.spelling(rows_of())
    assert spelling_forms(empty).count() == 0
    assert _forms(spelling_forms(small_docs)) == brute.spelling([(i, t or "") for i, t in small_rows])


# ---- repeats -------------------------------------------------------------------------

def _copied():
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choice("abcdefgh éß,.\n") for _ in range(n))
    shared, line = prose(400), "a line that very many of the documents hold, word for word, 0123"
    rows = [(k, prose(rng.choice((0, 30, 49, 50, 120, 900)))) for k in range(30)]
    rows += [(100 + k, prose(rng.randrange(80)) + shared[rng.randrange(200):][:rng.randrange(40, 400)] + prose(60)) for k in range(25)]
    rows += [(200 + k, prose(70) + line + prose(rng.randrange(90))) for k in range(40)]
    rows += [(300, rows[40][1]), (301, rows[40][1] + "!"), (302, rows[40][1][:500]), (None, rows[41][1]), (None, shared), (7, shared)]
    rows += [(400, "x" * 3000), (401, "x" * 120), (402, "xy" * 400), (403, "yx" * 60), (404, shared[:60] + shared[:60])]
    return rows


@pytest.mark.parametrize("hot", [64, 1])
def test_repeated_strings_go(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "TOTAL", hot)
    monkeypatch.setattr(repeats, "LOCAL", 1 if hot == 1 else 4)
    rows = _copied()
    docs = _table(spark, rows).repartition(6)
    if hot == 1:
        assert len(hot_words(repeats._texts(docs)))
    assert _kept(without_repeats(docs)) == brute.repeats(rows)


def test_repeats_do_not_depend_on_pieces_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 700)
    monkeypatch.setattr(repeats, "HELD", 40)
    rows = _copied()
    assert _kept(without_repeats(_table(spark, rows).repartition(3))) == brute.repeats(rows)


def test_repeats_of_messy_and_small_tables(spark, messy, empty, small_docs, small_rows):
    assert _kept(without_repeats(messy)) == brute.repeats(rows_of())
    assert without_repeats(empty).count() == 0
    assert _kept(without_repeats(small_docs)) == brute.repeats([(i, t or "") for i, t in small_rows])


def test_every_span_lies_in_one_phrase():
    rng = random.Random(2)
    raws = [bytes(rng.choices(b"abc ", k=n)) for n in (0, 49, 50, 51, 700)]
    found = [[] for _ in raws]
    for p in Parser().phrases(raws):
        for d, lo, hi in zip(p["doc"], p["lo"], p["hi"]):
            found[d] += range(lo, hi + 1)
    assert [sorted(f) for f in found] == [list(range(max(0, len(r) - 49))) for r in raws]


# ---- importance ----------------------------------------------------------------------

def test_crcs_are_shifted_and_composed():
    import zlib

    crc = np.array([zlib.crc32(b"ab"), 0, 5, 0xFFFFFFFF], np.uint32)
    k = np.array([0, 1, 7, 500])
    want = [zlib.crc32(b"\0" * int(n), int(c)) ^ zlib.crc32(b"\0" * int(n)) for c, n in zip(crc, k)]
    assert Shift(96)(crc, k).tolist() == want


@pytest.mark.parametrize("most", [100_000, 3, 0])
def test_buckets_of_texts_with_any_dictionary(most):
    texts = [t for _, t in rows_of()] + ["Äpfel über  x9y.z\x7f\u0080w", "q" * 300 + " b " + "é" * 200, "one", " a b a b a "]
    words = Dictionary(most)
    for _ in range(3):  # the dictionary grows from round to round
        found, counts = words.payloads(texts)
        bucket, owner = words.buckets(found, counts)
        for k, t in enumerate(texts):
            n, want = brute.importance_features(t)
            assert counts[k] == n and sorted(bucket[owner == k].tolist()) == sorted(want)
        words._rebuilt()


def test_resampled_tables(spark, messy, empty, small_docs, small_rows):
    target = ["the quick brown fox", None, "seven wise owls watch from old trees", ""]
    given = spark.createDataFrame([(t,) for t in target], "text string")
    plain = [t or "" for t in target]
    assert _drawn(resample(messy, given)) == brute.importance(rows_of(), plain)
    assert resample(empty, given).count() == 0
    rows = [(i, t or "") for i, t in small_rows]
    assert _drawn(resample(small_docs, given)) == brute.importance(rows, plain)
    assert _drawn(resample(small_docs, given.limit(0))) == brute.importance(rows, [])
