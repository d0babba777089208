"""Per-key mean rating, rating description, positional zip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.operators.ranking import with_range_rank
from pairlab.operators.scored import ordered_prefix, with_stats

QUANTILES = [0.25, 0.5, 0.75]


def mean_rating(df: DataFrame, keys: list[str], rating: str = "rating", out: str = "rating",
                with_count: bool = True) -> DataFrame:
    """A1: mean rating per key (rows with a NULL key are dropped, as pandas
    groupby does).  Partial aggregation runs map-side, so a hot key costs
    one partial row per task."""
    cond = None
    for k in keys:
        c = F.col(f"`{k}`").isNotNull()
        cond = c if cond is None else cond & c
    aggs = [F.avg(F.col(f"`{rating}`")).alias(out)]
    if with_count:
        aggs.append(F.count(F.col(f"`{rating}`")).alias("n_ratings"))
    return df.filter(cond).groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*aggs)


def exact_quantiles(df: DataFrame, value: str, group: str, quantiles=QUANTILES) -> DataFrame:
    """(group, _q array): linearly interpolated quantiles per group by rank selection.

    Values are counted, the counts are summed up in order (``ordered_prefix``:
    ranges of values, no group in one task), and each quantile's two neighbours
    are the values whose ranks hold its position.  Nothing is buffered, however
    many distinct values there are.  NULL values are left out."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = ordered_prefix(counts, group, [F.col(value).asc()], {"_before": F.col("_c")})
    sizes = counts.groupBy(group).agg(F.sum("_c").alias("_total"), F.count(F.lit(1)).alias("_n"))
    rows = with_stats(ranked, sizes, group)
    at = lambda i: F.when((F.col("_before") <= i) & (i < F.col("_before") + F.col("_c")), F.col(value))
    places = [(F.col("_total") - 1) * F.lit(float(q)) for q in quantiles]
    near = rows.groupBy(group).agg(
        F.first("_total").alias("_total"), *[F.max(at(F.floor(h))).alias(f"_lo{k}") for k, h in enumerate(places)],
        *[F.max(at(F.ceil(h))).alias(f"_hi{k}") for k, h in enumerate(places)])
    mid = [F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * (h - F.floor(h)) for k, h in enumerate(places)]
    return near.select(group, F.array(*mid).alias("_q"))


def describe_ratings(df: DataFrame, col: str, by: str | None = None, overall: bool = True,
                     exact: bool = True, all_label: str = "all") -> DataFrame:
    """A4: count, mean, sample std, min, 25/50/75 % (linear interpolation), max
    per group and (``overall``) over all rows.

    ``exact=True`` selects the quartiles by rank (``exact_quantiles``).
    ``exact=False`` takes ``percentile_approx`` in the same pass as the rest.  A
    NULL group is a group of its own."""
    x = F.col(f"`{col}`").cast("double")
    base = df.select((F.col(f"`{by}`").cast("string") if by else F.lit(all_label)).alias("group"), x.alias("_x"))
    rows = base.select(F.struct(F.lit(by is None).alias("all"), F.col("group").alias("name")).alias("_g"), "_x")
    if by is not None and overall:
        every = F.struct(F.lit(True).alias("all"), F.lit(all_label).alias("name"))
        rows = base.select(F.explode(F.array(F.struct(F.lit(False).alias("all"), F.col("group").alias("name")), every)).alias("_g"),
                           "_x")
    v = F.col("_x")
    aggs = [F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
            F.max(v).alias("max")]
    if not exact:
        g = rows.groupBy("_g").agg(*aggs, F.percentile_approx(v, QUANTILES, 100000).alias("_q"))
    else:
        q = exact_quantiles(rows, "_x", "_g").withColumnRenamed("_g", "_of")
        plain = rows.groupBy("_g").agg(*aggs)
        g = plain.join(q, F.col("_g") == F.col("_of"), "left")
    return g.select(F.col("_g.name").alias("group"), "count", "mean", "std", "min",
                    F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"), "max")


def rating_table(df: DataFrame, col: str, by: str, groups: list[str], all_label: str = "all") -> DataFrame:
    """The seven rating statistics (count left out) as rows, one column per
    group of ``groups`` (a fixed list of names) and one over all rows."""
    names = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    long = describe_ratings(df, col, by=by, all_label=all_label).unpivot(["group"], names, "statistic", "value")
    rank = F.create_map(*[x for i, m in enumerate(names) for x in (F.lit(m), F.lit(i))])
    wide = long.groupBy("statistic").pivot("group", [*groups, all_label]).agg(F.first("value"))
    return wide.withColumn("row_order", rank[F.col("statistic")])


def zip_by_position(x: DataFrame, x_order: str, y: DataFrame, y_order: str, y_cols: list[str]) -> DataFrame:
    """J2 (compat): the k-th row of ``x`` (in ``x_order``) gets the k-th row's
    ``y_cols`` of ``y`` (in ``y_order``); rows of equal order follow their other
    columns.  Both ranks are distributed (W1)."""
    xr = with_range_rank(x, [x_order], "_zip_rank")
    yr = with_range_rank(y.select(y_order, *y_cols), [y_order], "_zip_rank")
    yr = yr.select("_zip_rank", *[F.col(c).alias(c) for c in y_cols])
    return xr.join(yr, "_zip_rank", "left").drop("_zip_rank")
