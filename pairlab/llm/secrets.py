"""Secrets by a linear-chain conditional random field.

Three base kinds (assign, access, hex) are found by pattern; their spans always stay.  The field tags the
words of each line as begin, inside or outside of a secret.  A word's features are its shape, the shapes of
the words before and after it and what the file is like; weights and tag transitions are trained on a
bounded hash sample of lines (``sample_lines``) whose labels are the base spans, by stochastic gradient on
the exact log-likelihood (forward-backward).  Viterbi decodes every line of every text.  Words the field
tags that overlap no base span become spans of kind ``crf``.

A word without a digit, shorter than ``LONG`` bytes and not a keyword is plain; plain words differ only in
their neighbours.  While the largest gain of any tag on a plain line over all-outside is not positive
(checked against the trained weights), lines of plain words alone need no decoding.

Defined cases: a null text is empty and has no spans; repeated rows give repeated results; without any
base span in the sample the field stays untrained and adds nothing; an empty table gives an empty result;
extra columns are ignored; long texts and long lines are worked on whole.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import id_text, map_rows
from pairlab.session import materialize

#: Base patterns (ASCII case folding) and least lengths.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS, MIN_ADDED = 12, 18, 8
BASE = ("assign", "access", "hex")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KEY_RE = re.compile("password|passwd|secret|token|api_?key", re.I | re.A)
LONG = 20
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = re.compile(r"[0-9]|[^\x20\x09-\x0D]{%d}|(?:password|passwd|secret|token|api_?key)" % LONG, re.I | re.A)
EDGE = "\"'`,;:.!?()[]{}<>"
OUT, BEGIN, INSIDE = 0, 1, 2


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    found = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], BASE.index(s[0])))


def shape(word: str) -> tuple[str, ...]:
    """Features of one word."""
    core = word.strip(EDGE)
    digits = sum(c.isdigit() for c in core)
    if not digits and len(word.encode()) < LONG and not KEY_RE.search(word):
        return ("plain",)
    n = max(len(core), 1)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:]))
    upper, lower = sum(c.isupper() for c in core), sum(c.islower() for c in core)
    return (f"len{min(n // 6, 6)}", f"digits{4 * digits // n}", f"turns{min(turns, 6)}",
            f"case{int(upper > 0)}{int(lower > 0)}", f"distinct{min(len(set(core)) // 4, 5)}",
            f"inner{int(any(c in '@/.:()+' for c in core))}{int('=' in core)}",
            f"alnum{int(core.isalnum())}", f"ascii{int(core.isascii())}", f"hex{int(all(c in '0123456789abcdef' for c in core))}",
            f"key{int(bool(KEY_RE.search(core)))}", f"mark{int(word[-1:] in ':=')}",
            f"mix{min(n // 6, 6)}_{4 * digits // n}_{min(turns // 2, 3)}")


def plain_line(line: str) -> bool:
    """All words are plain by ``shape``; for ASCII lines the pattern says the same."""
    return not ODD.search(line) and (line.isascii() or all(shape(w) == ("plain",) for w in WORD.findall(line)))


def file_features(text: str) -> tuple[str, ...]:
    n = max(len(text), 1)
    marks = sum(text.count(c) for c in "={};")
    return (f"file_size{min(int(np.log10(n)), 6)}", f"file_marks{min(200 * marks // n, 3)}")


def features(words: list[str], file: tuple[str, ...]) -> list[list[str]]:
    """For every word: its own shape, its neighbours' and the file's."""
    shapes = [shape(w) for w in words]
    edge = ("edge",)
    out = []
    for k, own in enumerate(shapes):
        before = shapes[k - 1] if k else edge
        after = shapes[k + 1] if k + 1 < len(shapes) else edge
        out.append([*own, *("<" + f for f in before), *(">" + f for f in after), *file, "bias"])
    return out


class Field:
    """Weights by feature and tag, and by pair of tags (start from outside)."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        return np.array([self.weights[[self.index[f] for f in row if f in self.index]].sum(0) for row in rows])

    def plain_lines_are_out(self) -> bool:
        """No path over plain words gains on all-outside: each step's gain has an upper bound below zero."""
        if not len(self.weights):
            return True
        w = lambda f: self.weights[self.index[f]] if f in self.index else np.zeros(3)
        sides = [max((w(s + "plain")[t] - w(s + "plain")[OUT], w(s + "edge")[t] - w(s + "edge")[OUT]))
                 for t in (BEGIN, INSIDE) for s in "<>"]
        file = [max([0.0] + [v[t] - v[OUT] for f, i in self.index.items() if f.startswith("file_") and f.startswith(g)
                             for v in [self.weights[i]]]) for t in (BEGIN, INSIDE) for g in ("file_size", "file_marks")]
        own = w("plain") + w("bias")
        m = self.moves
        step = {BEGIN: max(m[OUT, BEGIN], m[BEGIN, BEGIN], m[INSIDE, BEGIN]), INSIDE: max(m[BEGIN, INSIDE], m[INSIDE, INSIDE])}
        leave = max(0.0, m[BEGIN, OUT] - m[OUT, OUT], m[INSIDE, OUT] - m[OUT, OUT])
        gain = [own[t] - own[OUT] + sides[2 * k] + sides[2 * k + 1] + file[2 * k] + file[2 * k + 1] + step[t] - m[OUT, OUT]
                for k, t in enumerate((BEGIN, INSIDE))]
        return gain[0] + leave <= 0 and gain[1] <= 0

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The best tag path (Viterbi)."""
        s = self.scores(rows)
        n = len(s)
        best, back = s[0] + self.moves[OUT], np.zeros((n, 3), np.int64)
        for k in range(1, n):
            paths = best[:, None] + self.moves
            back[k] = paths.argmax(0)
            best = paths.max(0) + s[k]
        tags = [int(best.argmax())]
        for k in range(n - 1, 0, -1):
            tags.append(int(back[k, tags[-1]]))
        return tags[::-1]


_NEVER = -1e4  # inside cannot follow outside


def fit(lines: list[tuple[list[list[str]], list[int]]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Maximum likelihood by Adagrad over (feature rows, tags)."""
    index: dict[str, int] = {}
    for rows, _ in lines:
        for row in rows:
            for f in row:
                index.setdefault(f, len(index))
    weights, moves = np.zeros((len(index), 3)), np.zeros((3, 3))
    moves[OUT, INSIDE] = _NEVER
    if not any(any(tags) for _, tags in lines):
        return Field({}, np.zeros((0, 3)), moves)
    coded = [([[index[f] for f in row] for row in rows], tags) for rows, tags in lines]
    sq_w, sq_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for at in order.permutation(len(coded)):
            rows, tags = coded[at]
            s = np.array([weights[row].sum(0) for row in rows])
            n = len(s)
            ahead, behind = np.zeros((n, 3)), np.zeros((n, 3))
            ahead[0] = s[0] + moves[OUT]
            for k in range(1, n):
                ahead[k] = np.logaddexp.reduce(ahead[k - 1][:, None] + moves, axis=0) + s[k]
            for k in range(n - 2, -1, -1):
                behind[k] = np.logaddexp.reduce(moves + s[k + 1] + behind[k + 1], axis=1)
            z = np.logaddexp.reduce(ahead[-1])
            post = np.exp(ahead + behind - z)
            post[np.arange(n), tags] -= 1
            g_m = np.zeros((3, 3))
            g_m[OUT] += np.exp(ahead[0] + behind[0] - z)
            g_m[OUT, tags[0]] -= 1
            for k in range(1, n):
                g_m += np.exp(ahead[k - 1][:, None] + moves + s[k] + behind[k] - z)
                g_m[tags[k - 1], tags[k]] -= 1
            g_m[OUT, INSIDE] = 0
            sq_m += g_m ** 2
            moves -= rate * g_m / np.sqrt(sq_m)
            for k, row in enumerate(rows):
                g = post[k] + decay * weights[row]
                sq_w[row] += g ** 2
                weights[row] -= rate * g / np.sqrt(sq_w[row])
    return Field(index, weights, moves)


def _lines(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    for line in text.split("\n"):
        yield at, line
        at += len(line) + 1


def _tags(words: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[int]:
    """Tags of words (start, end), in order, from base spans: words that a span covers for the most part.
    Each span looks only at the words it meets."""
    tags, ends = [OUT] * len(words), [e for _, e in words]
    for _, a, b in spans:
        first = True
        for k in range(bisect_right(ends, a), len(words)):
            s, e = words[k]
            if s >= b:
                break
            if min(b, e) - max(a, s) > (e - s) / 2:
                tags[k] = BEGIN if first else INSIDE
                first = False
    return tags


def clear_of(spans: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans that overlap none of ``base`` (which is sorted by start)."""
    starts = [b[1] for b in base]
    reach = list(accumulate((b[2] for b in base), max))  # how far the spans up to each one go
    return [s for s in spans if not (k := bisect_left(starts, s[2])) or reach[k - 1] <= s[1]]


def train(docs: DataFrame, sample_lines: int = 4000, window: int = 12) -> Field:
    """Fits the field on at most about ``sample_lines`` stretches of ``window`` words on either side of an
    odd word, picked by hash; half of them hold a base span."""

    def pick(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rank, rows = [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                starts = [s[1] for s in spans]
                for at, line in _lines(text):
                    if not ODD.search(line):
                        continue
                    words = [(at + m.start(), at + m.end()) for m in WORD.finditer(line)]
                    inside = spans[bisect_left(starts, at):bisect_right(starts, at + len(line))]
                    tags = _tags(words, inside)
                    centre = next((k for k, t in enumerate(tags) if t), None)
                    centre = centre if centre is not None else next(
                        k for k, (a, b) in enumerate(words) if ODD.search(text[a:b]))
                    lo, hi = max(0, centre - window), centre + window + 1
                    stretch = "\n".join([text[a:b] for a, b in words[lo:hi]])
                    head = hashlib.blake2b(stretch.encode("utf-8", "surrogatepass"), digest_size=7).digest()
                    rank.append(int.from_bytes(head, "big"))
                    rows.append((any(tags[lo:hi]), stretch, " ".join(file_features(text)),
                                 "".join(map(str, tags[lo:hi]))))
            positive, stretch, file, tags = zip(*rows) if rows else [()] * 4
            yield {"rank": rank, "positive": positive, "words": stretch, "file": file, "tags": tags}

    found = materialize(map_rows(
        id_text(docs), pick, "rank long, positive boolean, words string, file string, tags string",
        {"rank": pa.int64(), "positive": pa.bool_(), "words": pa.string(), "file": pa.string(), "tags": pa.string()}),
        "secret-lines")
    rows = []
    counts = {r["positive"]: r["n"] for r in found.groupBy("positive").agg(
        F.approx_count_distinct("rank").alias("n")).collect()}
    for side, n in counts.items():  # a rank is a 56-bit hash: a threshold keeps a bounded share of distinct lines
        limit = int(min(1.0, sample_lines / 2 / max(n, 1)) * (1 << 56))
        rows += found.filter((F.col("positive") == side) & (F.col("rank") <= limit)) \
            .dropDuplicates(["rank"]).orderBy("rank").limit(sample_lines // 2).collect()
    rows.sort(key=lambda r: (r["rank"], r["positive"]))
    return fit([(features(r["words"].split("\n"), tuple(r["file"].split(" "))), [int(c) for c in r["tags"]])
                for r in rows])


def field_spans(text: str, field: Field, plain_is_out: bool) -> list[tuple[str, int, int]]:
    """Spans of the words that the field tags, without edge marks."""
    found: list[tuple[str, int, int]] = []
    file: tuple[str, ...] | None = None
    for at, line in _lines(text):
        if plain_is_out and plain_line(line):
            continue
        words = list(WORD.finditer(line))
        if not words:
            continue
        file = file or file_features(text)
        tags = field.decode(features([m.group() for m in words], file))
        for m, tag in zip(words, tags):
            core = m.group().strip(EDGE)
            if tag == OUT or len(core) < MIN_ADDED:
                continue
            a = at + m.start() + m.group().index(core)
            if tag == INSIDE and found:
                found[-1] = ("crf", found[-1][1], a + len(core))
            else:
                found.append(("crf", a, a + len(core)))
    return found


def find_secrets(docs: DataFrame, sample_lines: int = 4000) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans (base and added), n_added."""
    field = train(docs, sample_lines)
    plain_is_out, trained = field.plain_lines_are_out(), len(field.index) > 0

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in
                                    ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added")}
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                extra = clear_of(field_spans(text, field, plain_is_out), base) if trained else []
                for kind in BASE:
                    out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
                joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
                out["base_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                every = sorted(base + extra, key=lambda s: (s[1], (*BASE, "crf").index(s[0])))
                out["spans"].append(",".join(f"{k}:{a}:{b}" for k, a, b in every))
                out["n_added"].append(len(extra))
            yield {"doc_id": batch.column("doc_id")} | out

    return map_rows(
        id_text(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
        "n_added long", {"doc_id": pa.int64(), "n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(),
                         "base_sha256": pa.string(), "spans": pa.string(), "n_added": pa.int64()})
