"""Cross-source duplicate removal and distinct rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _key_pairs(keys):
    return [(k, k) if isinstance(k, str) else tuple(k) for k in keys]


def _dup_join(b: DataFrame, a: DataFrame, keys, only_when, prekey: bool, how: str) -> DataFrame:
    pairs = _key_pairs(keys)
    cols_b = b.columns
    bb = b.withColumn("_dup_only", only_when if only_when is not None else F.lit(True)).alias("_dup_b")
    aa = a.select(*[F.col(f"`{ka}`").alias(f"_dup_a{i}") for i, (_, ka) in enumerate(pairs)])
    kb = [F.col(f"_dup_b.`{k}`") for k, _ in pairs]
    ka = [F.col(f"_dup_a{i}") for i in range(len(pairs))]
    cond = [F.col("_dup_b._dup_only")]
    if prekey:
        # A 64-bit pre-key leads the equi-join keys so that shuffle sorts compare
        # longs before any long text; full equality still decides.
        aa = aa.withColumn("_dup_h", F.xxhash64(*ka))
        cond.insert(0, F.xxhash64(*kb) == F.col("_dup_h"))
    cond += [x == y for x, y in zip(kb, ka)]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    return bb.join(aa, on, how).select(*[F.col(f"_dup_b.`{c}`").alias(c) for c in cols_b])


def remove_cross_source_duplicates(b: DataFrame, a: DataFrame, keys, only_when: Column | None = None,
                                   prekey: bool = True) -> DataFrame:
    """Rows of ``b`` with no row of ``a`` equal on all keys.

    ``keys`` are column names or (b_col, a_col) pairs.  ``only_when`` is a
    condition over ``b``'s own columns that is part of the match (it sits in the
    ON clause, so b-rows failing it are never removed).  NULL keys never match."""
    return _dup_join(b, a, keys, only_when, prekey, "left_anti")


def cross_source_duplicates(b: DataFrame, a: DataFrame, keys, only_when: Column | None = None,
                            prekey: bool = True) -> DataFrame:
    """The rows of ``b`` that J1 removes."""
    return _dup_join(b, a, keys, only_when, prekey, "left_semi")


def duplicate_counts(matched: DataFrame, by: str) -> DataFrame:
    """Per-group count of matched duplicates (e.g. per aspect)."""
    return matched.groupBy(by).agg(F.count(F.lit(1)).alias("n_duplicates"))


def distinct_rows(df: DataFrame, keys: list[str], keep: str = "any", order: str | None = None) -> DataFrame:
    """One row per key.

    ``keep='any'`` -> ``dropDuplicates`` (only keys are observable).
    ``keep='first'|'last'`` -> the other columns come from the row with the
    smallest / largest ``order`` value (the row index of the source)."""
    if keep == "any":
        return df.dropDuplicates(keys)
    if order is None:
        raise ValueError("keep='first'/'last' needs an order column")
    others = [c for c in df.columns if c not in keys]
    payload = F.struct(*[F.col(f"`{c}`") for c in others])
    pick = F.max_by if keep == "last" else F.min_by
    agg = df.groupBy(*keys).agg(pick(payload, F.col(order)).alias("_row"))
    return agg.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in others])
