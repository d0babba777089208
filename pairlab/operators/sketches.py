"""A4, A7, A8 by sketches that merge: an opt-in approximate corpus report.

Each group's texts become one row of sketches: distinct tokens and distinct
lexical words as HyperLogLog sketches, tokens per text as a quantile (KLL)
sketch, and exact counts.  Stored once per source, the rows merge to any
coarser grouping without reading a text again; the exact report has to.

Errors: a distinct count is within about 1.04 / sqrt(2^lg_k) of the exact one
(one standard deviation; 1.6 % for the default 12), a quantile's rank within
about 2.3 / k^0.9 of the asked one (1.3 to 2 % for the default 200).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.functions.text import default_stop_words
from pairlab.operators.textstats import doc_stats

QUARTILES = [0.25, 0.5, 0.75]


def corpus_sketches(df: DataFrame, text: str, by: list[str], lg_k: int = 12, k: int = 200, stop_words=None) -> DataFrame:
    """One row per group of ``by``: n_texts, n_lexical, and the sketches ``tokens``, ``lexical`` and ``lengths``
    (tokens per text).  One pass, combined in every task before the shuffle, so what moves is sketches.  A NULL
    text has no tokens and no length, and counts in n_texts; a NULL group is a group of its own."""
    stop = default_stop_words() if stop_words is None else tuple(stop_words)
    stats = doc_stats(df.select(*by, text), text, stop, keep_arrays=True)
    each = stats.select(*by, "n_lexical", F.when(F.col(text).isNotNull(), F.col("n_tokens")).cast("double").alias("_length"),
                        F.posexplode_outer(F.array_distinct("tokens")).alias("_pos", "_token"))
    first = F.coalesce(F.col("_pos"), F.lit(0)) == 0  # figures of a text ride on its first row
    word = F.when(~F.col("_token").isin(*stop), F.col("_token")) if stop else F.col("_token")
    return each.groupBy(*by).agg(
        F.count_if(first).alias("n_texts"),
        F.coalesce(F.sum(F.when(first & F.col("_length").isNotNull(), F.col("n_lexical"))), F.lit(0)).alias("n_lexical"),
        F.hll_sketch_agg("_token", lg_k).alias("tokens"), F.hll_sketch_agg(word, lg_k).alias("lexical"),
        F.kll_sketch_agg_double(F.when(first, F.col("_length")), k).alias("lengths"))


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of coarser groups (``by`` may be empty: of everything) from those of finer ones."""
    return sketches.groupBy(*by).agg(
        F.sum("n_texts").alias("n_texts"), F.sum("n_lexical").alias("n_lexical"), F.hll_union_agg("tokens").alias("tokens"),
        F.hll_union_agg("lexical").alias("lexical"), F.kll_merge_agg_double("lengths").alias("lengths"))


def read_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """n_texts (exact), vocab_size, lexical_vocab_size, lexical_richness and the quartiles of tokens per text, all
    estimated from the sketches (quartiles are NULL where no text is)."""
    some = F.kll_sketch_get_n_double("lengths") > 0
    quartiles = [F.when(some, F.kll_sketch_get_quantile_double("lengths", F.lit(q))).alias(f"p{int(100 * q)}") for q in QUARTILES]
    lexical = F.hll_sketch_estimate("lexical")
    return sketches.select(*by, "n_texts", F.hll_sketch_estimate("tokens").alias("vocab_size"), lexical.alias("lexical_vocab_size"),
                           F.try_divide(lexical.cast("double"), F.col("n_lexical")).alias("lexical_richness"), *quartiles)
