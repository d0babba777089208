"""Order-preserving packing of tokenised documents into fixed windows.

The documents of a partition, in doc_id order, form one token stream.  Windows cut the stream at
document ends (free), sentence ends (cheap) or, where a sentence is longer than a window, anywhere
(dear).  Dynamic programming chooses the cuts with the least padding plus penalties:

    best[j] = penalty[j] + min over cuts i, at most ``size`` tokens before j, of best[i] + padding(j - i)

The minimum over a sliding range comes from a monotone queue on best[i] + position[i]; windows whose
length is a power of two need no padding and are tried beside it.  A stream is solved in blocks of about
``block_tokens``; the last window of a block is carried into the next one, so memory stays bounded.

Defined cases: a null or empty text is the closing id alone; repeated rows are packed one by one; ties in
doc_id are ordered by text; an empty table gives no pieces; the string of an added token of the tokenizer
file inside a text is that token's id; extra columns are ignored; texts and runs of white space may be of any
length.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pairlab.llm.common import id_text, map_rows, worker_state

#: Fixed values.
SIZE = 1024
CLOSING_ID = 0
SENTENCE_PENALTY, INNER_PENALTY = 1, 48
SEQUENCE_BITS = 40
#: Runs of white space from this length on are left to the .json tokenizer (the ranks' matcher recurses).
LONGEST_BLANK = 50_000

DDL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
_TYPES = {f.split(" ")[0]: pa.int64() for f in DDL.split(", ")}


class Encoder:
    """Token ids of a text, and which ids end a sentence.  Reads a ``tokenizers`` file (.json) or the same
    vocabulary as byte ranks (.tiktoken, several times faster, same ids), with the added tokens of the .json
    file beside it.  Texts with a run of white space of ``LONGEST_BLANK`` or more go through the .json file."""

    def __init__(self, path: str):
        self._file = None
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            self.encode = lambda text: tok.encode(text, add_special_tokens=False).ids
            pieces = {i: p.replace("Ċ", "\n").encode() for p, i in tok.get_vocab().items()}
        else:
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as f:
                added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
            tok = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                    special_tokens=added)
            blanks = re.compile(r"\s{%d}" % LONGEST_BLANK)

            def encode(text: str) -> list[int]:
                if len(text) >= LONGEST_BLANK and blanks.search(text):  # the ranks' matcher would run out of stack
                    return self._by_file(path.removesuffix(".tiktoken") + ".json").encode(
                        text, add_special_tokens=False).ids
                return (tok.encode(text, allowed_special="all") if any(t in text for t in added)
                        else tok.encode_ordinary(text))

            self.encode = encode
            pieces = {i: p for p, i in ranks.items()} | {i: t.encode() for t, i in added.items()}
        self.ends = np.zeros(max(pieces) + 1, bool)
        for i, p in pieces.items():
            self.ends[i] = p[-1:] in (b".", b"!", b"?") or b"\n" in p

    def _by_file(self, path: str):
        """The .json tokenizer, read when the first text needs it."""
        if self._file is None:
            from tokenizers import Tokenizer

            self._file = Tokenizer.from_file(path)
        return self._file


def best_cuts(places: np.ndarray, penalties: np.ndarray, size: int = SIZE) -> list[int]:
    """Indexes into ``places`` (ascending, first 0; gaps of at most ``size``) of the cheapest cuts."""
    at, pen = places.tolist(), penalties.tolist()
    n = len(at)
    index = {p: k for k, p in enumerate(at)}
    powers = [1 << b for b in range(size.bit_length()) if 1 << b <= size]
    best, back = [0] * n, [0] * n
    queue = deque([0])
    value = [0] * n  # best[i] + at[i]
    for j in range(1, n):
        here = at[j]
        while at[queue[0]] < here - size:
            queue.popleft()
        i = queue[0]
        cost = value[i] + size - here
        for p in powers:
            k = index.get(here - p)
            if k is not None and best[k] < cost:
                cost, i = best[k], k
        best[j], back[j] = cost + pen[j], i
        v = value[j] = best[j] + here
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def _with_inner(ends: np.ndarray, total: int, size: int) -> np.ndarray:
    """Extra cuts inside sentences longer than a window, so that every gap is at most ``size``."""
    marks = np.unique(np.concatenate([[0], ends, [total]]))
    wide = np.flatnonzero(np.diff(marks) > size)
    return np.concatenate([np.arange(marks[k] + size, marks[k + 1], size) for k in wide] or [np.zeros(0, np.int64)])


class Stream:
    """Packs documents as they come; ``flush`` yields the pieces of all settled windows."""

    def __init__(self, ends: np.ndarray, base: int, size: int):
        self.ends, self.base, self.size, self.sequence = ends, base, size, 0
        self.docs: list[tuple] = []  # doc_id, ids of which the first `done` are packed, done
        self.tokens = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0))
        self.tokens += len(ids)

    def flush(self, last: bool) -> dict:
        if not self.docs:
            return {k: [] for k in _TYPES}
        stream = np.concatenate([ids[done:] for _, ids, done in self.docs])
        doc_ends = np.cumsum([len(ids) - done for _, ids, done in self.docs])
        sentence = np.flatnonzero(self.ends[stream]) + 1
        inner = _with_inner(np.union1d(sentence, doc_ends), len(stream), self.size)
        places = np.unique(np.concatenate([[0], doc_ends, sentence, inner]))
        pen = np.full(len(places), SENTENCE_PENALTY)
        pen[np.isin(places, inner)] = INNER_PENALTY
        pen[np.isin(places, doc_ends)] = 0
        stops = places[best_cuts(places, pen, self.size)]
        if not last:
            stops = stops[:-1]
        limit = int(stops[-1]) if len(stops) else 0
        out: dict[str, list] = {k: [] for k in _TYPES}
        starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
        doc_starts = doc_ends - [len(ids) - done for _, ids, done in self.docs]
        edges = np.union1d(np.union1d(starts, stops), doc_ends[doc_ends <= limit])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            d = int(np.searchsorted(doc_ends, a, side="right"))
            w = int(np.searchsorted(stops, a, side="right"))
            doc_id, ids, done = self.docs[d]
            out["doc_id"].append(doc_id)
            out["start"].append(done + a - int(doc_starts[d]))
            out["length"].append(b - a)
            out["ids_crc32"].append(zlib.crc32(stream[a:b].astype("<u4").tobytes()))
            out["doc_tokens"].append(len(ids))
            out["sequence_id"].append(self.base + self.sequence + w)
            out["offset"].append(a - int(starts[w]))
        self.sequence += len(stops)
        first = int(np.searchsorted(doc_ends, limit, side="right"))
        rest = self.docs[first:]
        if rest:
            doc_id, ids, done = rest[0]
            rest[0] = (doc_id, ids, done + limit - int(doc_starts[first]))
        self.docs, self.tokens = rest, len(stream) - limit
        return out


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, block_tokens: int = 1 << 18) -> DataFrame:
    """One row per piece of a document: where it starts in the document's ids, its length, the checksum
    of its ids, the document's number of ids, the sequence it lies in, and its offset there."""

    def run(batches: Iterator[pa.RecordBatch]):
        enc = worker_state(f"encoder_{zlib.crc32(tokenizer_path.encode())}", lambda: Encoder(tokenizer_path))
        stream = Stream(enc.ends, TaskContext.get().partitionId() << SEQUENCE_BITS, size)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                stream.add(doc_id, np.array([*enc.encode(text), CLOSING_ID], np.uint32))
                if stream.tokens >= block_tokens:
                    yield stream.flush(last=False)
        yield stream.flush(last=True)

    return map_rows(id_text(docs).sortWithinPartitions("doc_id", "text"), run, DDL, _TYPES)
