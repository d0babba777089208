"""Helpers shared by the corpus operators: input columns, batches, worker state."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word contract: blank, tab to carriage return.
WS = " \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only (doc_id, text): extra columns cannot clash and are never read; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fields(ddl: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in ddl.split(",")]


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], ddl: str,
             types_: dict[str, pa.DataType]) -> DataFrame:
    """``mapInArrow`` for generators of column dicts (one dict per output batch)."""
    schema = pa.schema([(k, types_[k]) for k in fields(ddl)])

    def run(batches):
        for cols in fn(batches):
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in
                 ((cols[f.name], f.type) for f in schema)], schema=schema)

    return df.mapInArrow(run, ddl)


def slices(batch: pa.RecordBatch, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that its texts hold about ``chars`` bytes; a longer single text stays whole."""
    import numpy as np

    sizes = np.frombuffer(_lengths(batch), dtype=np.int64)
    cuts = np.cumsum(sizes) // chars
    at = 0
    for k in range(1, len(cuts) + 1):
        if k == len(cuts) or cuts[k] != cuts[at]:
            yield batch.slice(at, k - at)
            at = k


def _lengths(batch: pa.RecordBatch) -> bytes:
    import pyarrow.compute as pc

    return pc.binary_length(batch.column("text")).cast(pa.int64()).to_numpy(zero_copy_only=False).tobytes()


def worker_state(name: str, make: Callable):
    """A value kept for the life of a Python worker (tokenizers, caches).  Functions of this package
    are pickled by value, so their own module globals do not outlive a task."""
    state = sys.modules.setdefault("_corpus_worker_state", types.ModuleType("_corpus_worker_state"))
    if not hasattr(state, name):
        setattr(state, name, make())
    return getattr(state, name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
