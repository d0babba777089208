"""Apply a user callable to inputs in fixed-size batches.

The callable receives a pandas DataFrame of at most ``batch_size`` input rows
(plus ``run_id``) and returns one output row per input row.  Spark ships rows
to Python as Arrow batches (``mapInPandas``); the wrapper re-cuts each Arrow
batch into ``batch_size`` chunks, so the callable sees the batch size the user
asked for whatever the session's Arrow batch setting is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fan_out(df: DataFrame, num_runs: int, name: str = "run_id") -> DataFrame:
    """Each input row repeated ``num_runs`` times, tagged 0..num_runs-1."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(max(num_runs, 1) - 1))))


def batch_apply(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], out_schema: T.StructType | str,
                key: list[str], batch_size: int = 8, num_runs: int = 1, sort_by: str | None = None,
                fold: bool = True) -> DataFrame:
    """B1: run ``fn`` over the rows of ``df`` (``num_runs`` times each).

    ``out_schema`` describes what ``fn`` returns (without key / run_id).
    ``fold=True`` (G7) gives one row per key with ``runs`` = array of output
    structs, ordered by ``sort_by`` descending (W2; ties keep run order) or by
    run.  ``fold=False`` returns one row per (key, run)."""
    if isinstance(out_schema, str):
        out_schema = T._parse_datatype_string(out_schema)
    inp = fan_out(df, num_runs)
    key_fields = [f for f in inp.schema.fields if f.name in key or f.name == "run_id"]
    schema = T.StructType(key_fields + list(out_schema.fields))
    keep = [f.name for f in key_fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[start:start + batch_size].reset_index(drop=True)
                res = fn(chunk).reset_index(drop=True)
                yield pd.concat([chunk[keep], res[[f.name for f in out_schema.fields]]], axis=1)

    outs = inp.mapInPandas(run, schema)
    if not fold:
        return outs
    fields = [f.name for f in out_schema.fields]
    rank = -F.col(sort_by) if sort_by else F.lit(0)
    # runs per key are bounded by num_runs, so the collected list is bounded
    entry = F.struct(rank.alias("_o"), F.col("run_id"), *[F.col(c) for c in fields])
    folded = outs.groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("_runs"))
    return folded.select(*key, F.transform("_runs", lambda e: e.dropFields("_o")).alias("runs"))
