"""Distributed global ranks and seeded hash keys.

A global ``row_number`` over a whole table normally needs one task
(``Window.orderBy`` without ``partitionBy``).  Here rows are first cut into
ordered buckets by a value that is monotone in the sort order; every bucket is
ranked on its own (one window partition per bucket, spread over all tasks) and
shifted by the number of rows in earlier buckets.  The offsets table has one
row per bucket, so its size is bounded by the bucket count, not by the data,
and it is broadcast.  The bucket value is a pure expression of the row, so a
recomputed partition always gets the same rank (no lineage cut needed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.operators.scored import ordered_prefix

HASH_BUCKET_HEX_DIGITS = 4  # 16^4 = 65,536 ordered buckets for hash keys


def hash_key(seed, *cols) -> Column:
    """Seeded md5 hex of the key columns (``seed:c1:c2...``).  md5 hex compares
    the same in every engine, which keeps splits and matches reproducible."""
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def hex_bucket(hex_col, digits: int = HASH_BUCKET_HEX_DIGITS) -> Column:
    c = F.col(hex_col) if isinstance(hex_col, str) else hex_col
    return F.conv(F.substring(c, 1, digits), 16, 10).cast("int")


def numeric_cut_bucket(df: DataFrame, col: str, n_buckets: int = 256, accuracy: int = 10000) -> Column:
    """Ordered bucket for a numeric sort column: index among approximate quantile
    cut points (one small aggregate; the cut points are a bounded literal)."""
    probs = [i / n_buckets for i in range(1, n_buckets)]
    row = df.select(F.percentile_approx(F.col(col).cast("double"), probs, accuracy).alias("c")).first()
    cuts = sorted(set(row["c"] or []))
    if not cuts:
        return F.lit(0)
    arr = F.array(*[F.lit(float(c)) for c in cuts])
    v = F.col(col).cast("double")
    return F.when(v.isNull(), F.lit(-1)).otherwise(F.size(F.filter(arr, lambda c: c < v)))


def with_global_rank(df: DataFrame, order: list, name: str = "rank", bucket: Column | None = None,
                     total_col: str | None = None, limit: int | None = None) -> DataFrame:
    """Add a 1-based global row number in ``order`` (ascending columns/expressions).

    ``bucket`` must be non-decreasing in the sort order.  Default: hex prefix of
    the first order column (for md5 keys).  ``total_col`` also adds the row count.
    ``limit``: only rows ranked <= limit are needed - buckets starting beyond it
    are dropped before any sorting (the rest of the table is never ranked).
    """
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    if bucket is None:
        bucket = hex_bucket(order_cols[0])
    b = df.withColumn("_rk_bucket", bucket)
    counts = b.groupBy("_rk_bucket").agg(F.count(F.lit(1)).alias("_rk_n"))
    # bounded by the bucket count -> a single small window and a broadcast
    prior = Window.orderBy("_rk_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_rk_bucket",
        F.coalesce(F.sum("_rk_n").over(prior), F.lit(0)).alias("_rk_off"),
        *([F.sum("_rk_n").over(Window.partitionBy()).alias(total_col)] if total_col else []),
    )
    w = Window.partitionBy("_rk_bucket").orderBy(*order_cols)
    out = b.join(F.broadcast(offsets), "_rk_bucket")
    if limit is not None:
        out = out.filter(F.col("_rk_off") < F.lit(int(limit)))
    out = out.withColumn(name, (F.row_number().over(w) + F.col("_rk_off")).cast("bigint"))
    if limit is not None:
        out = out.filter(F.col(name) <= F.lit(int(limit)))
    return out.drop("_rk_bucket", "_rk_off")


def with_range_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Add a 1-based global row number in the order of any columns (NULL first).

    Ranges come from a sample of the rows themselves, on all order columns and
    then on the rest, so equal values of the first column spread over as many
    ranges as they need as long as the rows differ.  The input is evaluated once:
    ranges are written, then numbered with the counts of the ranges before."""
    rest = [c for c in df.columns if c not in order]
    rows = df.withColumn("_every", F.lit(True))
    ranked = ordered_prefix(rows, "_every", [F.col(f"`{c}`").asc() for c in [*order, *rest]], {"_before": F.lit(1)})
    return ranked.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + 1).cast("bigint").alias(name))
