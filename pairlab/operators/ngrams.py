"""N-gram copy detection and the copy penalty.

N1: does the last n-gram of a generated sequence occur in a source sequence,
and which token follows it there?  Both sides become n-gram rows (a source
n-gram only counts when a token follows it); the match is an equi-join on the
n-gram (plus the pair key when sequences are paired), so nothing is compared
pairwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.functions.metrics import ngrams


def last_ngram(tokens, n: int):
    a = F.col(tokens) if isinstance(tokens, str) else tokens
    if n <= 0:
        return F.lit(None).cast("string")  # no n-gram, so nothing is a copy
    return F.when(F.size(a) >= n, F.array_join(F.slice(a, F.size(a) - n + 1, n), " "))


def shingles_with_next(df: DataFrame, id_cols: list[str], tokens: str, n: int) -> DataFrame:
    """(id..., pos, gram, next_token) for every n-gram that has a follower."""
    a, n = F.col(tokens), max(n, 1)  # an n of 0 or less matches nothing: last_ngram is NULL
    grams = F.slice(ngrams(a, n), 1, F.greatest(F.size(a) - n, F.lit(0)))
    ex = df.select(*id_cols, tokens, F.posexplode(grams).alias("_p0", "gram"))
    return ex.select(*id_cols, (F.col("_p0") + 1).alias("pos"), "gram",
                     F.element_at(a, F.col("_p0") + 1 + n).alias("next_token"))


def copied_ngrams(gen: DataFrame, gen_id: list[str], gen_tokens: str, src: DataFrame, src_id: list[str],
                  src_tokens: str, n: int = 3, pair_on: list[str] | None = None) -> DataFrame:
    """Hits (gen ids, src ids, pos, next_token).  ``pair_on`` = key columns
    present on both sides that pair a generated sequence with its own source
    (the reference's row-aligned case); without it every source is searched."""
    pair_on = list(pair_on or [])
    g_cols = list(dict.fromkeys(gen_id + pair_on))
    s_cols = list(dict.fromkeys(src_id + pair_on))
    g = gen.select(*g_cols, last_ngram(gen_tokens, n).alias("gram")).filter(F.col("gram").isNotNull())
    s = shingles_with_next(src, s_cols, src_tokens, n)
    return g.join(s, ["gram"] + pair_on).drop("gram")


def copied_followers(gen: DataFrame, gen_id: list[str], gen_tokens: str, src: DataFrame, src_tokens: str,
                     n: int = 3) -> DataFrame:
    """N1 by follower: (gen ids, next_token, n_places: how often the last n-gram stands before it in all sources).
    Only n-grams that some sequence ends with are counted (a semi join, broadcast where they are few), per
    (n-gram, follower) and before the join, so a common n-gram is as many rows as it has followers, however often
    it occurs."""
    g = gen.select(*gen_id, last_ngram(gen_tokens, n).alias("gram")).filter(F.col("gram").isNotNull())
    s = shingles_with_next(src, [], src_tokens, n).join(g.select("gram"), "gram", "left_semi")
    s = s.groupBy("gram", "next_token").agg(F.count(F.lit(1)).alias("n_places"))
    return g.join(s, "gram").drop("gram")


def self_copies(df: DataFrame, id_cols: list[str], tokens: str, n: int = 3) -> DataFrame:
    """The last n-gram of a sequence seen earlier in the same sequence, and
    the token that followed it there (the final n-gram itself has no follower)."""
    g = df.select(*id_cols, last_ngram(tokens, n).alias("gram")).filter(F.col("gram").isNotNull())
    s = shingles_with_next(df, id_cols, tokens, n)
    return g.join(s, id_cols + ["gram"]).drop("gram")


def repeated_ngram_share(df: DataFrame, id_cols: list[str], tokens: str, n: int = 3) -> DataFrame:
    """Share of n-gram occurrences whose n-gram occurs more than once in the
    same sequence (per sequence)."""
    ex = df.select(*id_cols, F.explode(ngrams(F.col(tokens), max(n, 1))).alias("gram")).filter(F.lit(n > 0))
    per = ex.groupBy(*id_cols, "gram").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy(*id_cols).agg(
        F.sum("c").alias("n_ngrams"),
        F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(F.lit(0))).alias("n_repeated"))


def penalise(scores: DataFrame, hits: DataFrame, keys: list[str], score: str = "score",
             by: float = 1000.0) -> DataFrame:
    """Subtract ``by`` once from every scored (group, item) that has at
    least one hit, however many hits it has."""
    h = hits.select(*keys).distinct().withColumn("_hit", F.lit(True))
    t = scores.join(h, keys, "left")
    return t.withColumn(score, F.when(F.col("_hit"), F.col(score) - F.lit(by)).otherwise(F.col(score))).drop("_hit")
