"""Quality rules as a short-circuit cascade.

Every rule is a predicate on one text.  Before the run, each rule's cost (seconds a document) and
rejection rate are measured on a hash sample of about ``sample_rows`` documents; the rules then run in
the order of rejections per second, and a document stops at the first rule that rejects it.  The sample
decides the order alone: a document is kept when every rule passes, whatever the order.

Defined cases: a null text is empty; an empty text has no words and fails ``few_words``; repeated rows
are judged row by row; an empty table gives an empty result; extra columns are carried (operator) or
dropped (query); lines and windows are counted over the whole text, however long.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import WS, id_text, map_rows

#: Limits of the rules.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MAX_SYMBOLS_PER_100_WORDS = 20
MIN_MEAN_WORD, MAX_MEAN_WORD = 2.0, 20.0
MAX_DUP_LINE_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
_WS_BYTES = WS.encode()


class Text:
    """Measures of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self._has: dict = {}

    def _get(self, key, make):
        if key not in self._has:
            self._has[key] = make()
        return self._has[key]

    @property
    def raw(self) -> bytes:
        return self._get("raw", self.text.encode)

    @property
    def words(self) -> list[bytes]:
        return self._get("words", self.raw.split)  # bytes.split() cuts at ASCII white space only

    @property
    def n_words(self) -> int:
        return len(self.words)

    @property
    def word_chars(self) -> int:
        return self._get("chars", lambda: len(self.text) - len(self.raw) + len(self.raw.translate(None, _WS_BYTES)))

    @property
    def n_symbols(self) -> int:
        return self._get("symbols", lambda: len(self.raw) - len(self.raw.translate(None, SYMBOLS)))

    def _lines(self) -> tuple[int, int]:
        lines = [x for x in self.text.split("\n") if x.strip(WS)]
        return len(lines), len(lines) - len(set(lines))

    @property
    def n_lines(self) -> int:
        return self._get("lines", self._lines)[0]

    @property
    def n_dup_lines(self) -> int:
        return self._get("lines", self._lines)[1]

    @property
    def n_repeat_words(self) -> int:
        return self._get("repeat", lambda: repeated_words(self.words))


def repeated_words(words: Sequence[bytes], size: int = WINDOW) -> int:
    """Words inside a window of ``size`` words that the text holds twice or more.  Windows with equal
    hashes are compared word by word, so the count is exact."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))
    sums = np.zeros(n, np.uint64)
    for k in range(size):
        sums = sums * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + n]
    order = np.argsort(sums, kind="stable")
    ranked = sums[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    found: dict[bytes, int] = {}
    windows = np.lib.stride_tricks.sliding_window_view(ids, size)[at]
    keys = [w.tobytes() for w in windows]
    for key in keys:
        found[key] = found.get(key, 0) + 1
    edges = np.zeros(len(words) + 1, np.int64)
    for p, key in zip(at.tolist(), keys):
        if found[key] > 1:
            edges[p] += 1
            edges[p + size] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


#: name -> True when the text passes.
RULES = {
    "few_words": lambda t: t.n_words >= MIN_WORDS,
    "repeats": lambda t: 100 * t.n_repeat_words <= MAX_REPEAT_PERCENT * t.n_words,
    "symbols": lambda t: 100 * t.n_symbols <= MAX_SYMBOLS_PER_100_WORDS * t.n_words,
    "word_length": lambda t: MIN_MEAN_WORD * t.n_words <= t.word_chars <= MAX_MEAN_WORD * t.n_words,
    "dup_lines": lambda t: 100 * t.n_dup_lines <= MAX_DUP_LINE_PERCENT * t.n_lines,
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_order(docs: DataFrame, rules: dict = RULES, sample_rows: int = 2000) -> list[str]:
    """The rules by measured rejections per second, on about ``sample_rows`` documents."""
    texts = id_text(docs)
    total = texts.select("doc_id").count()
    share = min(1.0, sample_rows / max(total, 1))
    picked = texts.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    def measure(batches: Iterator[pa.RecordBatch]):
        spent = dict.fromkeys(rules, 0.0)
        out = dict.fromkeys(rules, 0)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for name, passes in rules.items():
                    began = time.perf_counter()
                    out[name] += not passes(Text(text))
                    spent[name] += time.perf_counter() - began
        yield {"rule": list(rules), "seconds": list(spent.values()), "rejected": list(out.values())}

    seen = map_rows(picked, measure, "rule string, seconds double, rejected long",
                    {"rule": pa.string(), "seconds": pa.float64(), "rejected": pa.int64()})
    gain = {r["rule"]: r["g"] for r in seen.groupBy("rule").agg(
        (F.sum("rejected") / F.greatest(F.sum("seconds"), F.lit(1e-9))).alias("g")).collect()}
    return sorted(rules, key=lambda name: (-gain.get(name, 0.0), name))


def quality_measures(docs: DataFrame, rules: dict = RULES, sample_rows: int = 2000) -> DataFrame:
    """Per row: doc_id, the five measures, and ``kept`` (the verdict of the cascade)."""
    order = [rules[name] for name in rule_order(docs, rules, sample_rows)]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                t = Text(text)
                rows.append((all(passes(t) for passes in order), *(getattr(t, m) for m in MEASURES)))
            kept, *values = zip(*rows) if rows else [()] * 6
            yield {"doc_id": batch.column("doc_id"), "kept": kept} | dict(zip(MEASURES, values))

    ddl = "doc_id long, kept boolean, " + ", ".join(f"{m} long" for m in MEASURES)
    return map_rows(id_text(docs), run, ddl,
                    {"doc_id": pa.int64(), "kept": pa.bool_()} | dict.fromkeys(MEASURES, pa.int64()))


def quality_filter(docs: DataFrame, rules: dict = RULES, sample_rows: int = 2000) -> DataFrame:
    """The rows of ``docs`` that every rule passes, all columns as they were."""
    order = [rules[name] for name in rule_order(docs, rules, sample_rows)]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keep = [all(passes(t) for passes in order) for t in map(Text, batch.column(at).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
