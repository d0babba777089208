"""Per-text and per-corpus text statistics.

Per text: kept tokens, lexical words, sentences and tokens per sentence are
array columns computed once (JVM expressions, no Python).  Corpus figures are
grouped aggregates over exploded tokens, with map-side partial aggregation, so
a corpus that holds most of the rows still spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlab.functions.text import (
    array_mean,
    default_stop_words,
    keep_tokens,
    lexical_tokens,
    sentences_of,
    word_tokens,
)

REPORT_METRICS = ["vocab_size", "lexical_vocab_size", "avg_sentence_len", "avg_sentence_len_lexical",
                  "lexical_richness"]


def doc_stats(df: DataFrame, text: str = "text", stop_words=None, keep_arrays: bool = False) -> DataFrame:
    """A5, A6, T7, T8, per-text A9/A10 inputs.  Adds n_tokens, n_lexical,
    n_sentences, avg_sentence_len, avg_sentence_len_lexical (NULL for a text
    without sentences); ``keep_arrays`` also keeps ``tokens`` and ``lexical``.

    Each sentence is tokenised once; the text's tokens are the concatenation
    of its sentences' tokens (tokens never contain whitespace, and sentence
    cuts only remove whitespace, so this equals tokenising the whole text)."""
    stop = default_stop_words() if stop_words is None else tuple(stop_words)
    low = F.lower(F.col(text))
    out = df.withColumn("_st", F.transform(sentences_of(low), lambda s: keep_tokens(word_tokens(s))))
    out = out.withColumn("_sl", F.transform("_st", lambda t: lexical_tokens(t, stop)))
    out = out.select(
        "*",
        F.size("_st").alias("n_sentences"),
        array_mean(F.transform("_st", lambda t: F.size(t))).alias("avg_sentence_len"),
        array_mean(F.transform("_sl", lambda t: F.size(t))).alias("avg_sentence_len_lexical"),
        F.flatten("_st").alias("tokens"),
        F.flatten("_sl").alias("lexical"),
    ).drop("_st", "_sl")
    out = out.withColumn("n_tokens", F.size("tokens")).withColumn("n_lexical", F.size("lexical"))
    return out if keep_arrays else out.drop("tokens", "lexical")


def vocabulary(stats: DataFrame, by: list[str], approx: bool = False, stop_words=None) -> DataFrame:
    """Distinct kept tokens and distinct lexical words per group.
    ``stats`` must come from ``doc_stats(..., keep_arrays=True)``."""
    stop = default_stop_words() if stop_words is None else tuple(stop_words)
    tok = stats.select(*by, F.explode(F.array_distinct("tokens")).alias("token"))
    is_lex = ~F.col("token").isin(*stop) if stop else F.lit(True)
    if approx:
        return tok.groupBy(*by).agg(F.approx_count_distinct("token").alias("vocab_size"),
                                    F.approx_count_distinct(F.when(is_lex, F.col("token"))).alias(
                                        "lexical_vocab_size"))
    per_token = tok.groupBy(*by, "token").agg(F.lit(1).alias("_one"))
    return per_token.groupBy(*by).agg(F.count(F.lit(1)).alias("vocab_size"),
                                      F.count_if(is_lex).alias("lexical_vocab_size"))


def describe_corpus(df: DataFrame, text: str, by: list[str], stop_words=None) -> DataFrame:
    """Per group n_texts, vocabulary sizes, macro-averaged sentence lengths
    (A9, A10: mean over texts of each text's mean) and lexical richness (A11).

    One pass over the text statistics: every text explodes to its distinct
    tokens; the text-level figures ride on the text's first exploded row.
    Aggregation is two-level - (group, token), then group - both with map-side
    partial aggregation, so a group holding most texts still spreads out."""
    stop = default_stop_words() if stop_words is None else tuple(stop_words)
    stats = doc_stats(df.select(*by, text), text, stop, keep_arrays=True)
    ex = stats.select(*by, "n_lexical", "avg_sentence_len", "avg_sentence_len_lexical",
                      F.posexplode_outer(F.array_distinct("tokens")).alias("_pos", "token"))
    first = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    on_first = lambda c: F.when(first, F.col(c))
    per_token = ex.groupBy(*by, "token").agg(
        F.count_if(first).alias("_texts"),
        F.sum(on_first("n_lexical")).alias("_lex"),
        F.sum(on_first("avg_sentence_len")).alias("_asl_sum"),
        F.count(on_first("avg_sentence_len")).alias("_asl_n"),
        F.sum(on_first("avg_sentence_len_lexical")).alias("_asll_sum"),
        F.count(on_first("avg_sentence_len_lexical")).alias("_asll_n"))
    is_tok = F.col("token").isNotNull()
    is_lex = is_tok & ~F.col("token").isin(*stop) if stop else is_tok
    g = per_token.groupBy(*by).agg(
        F.sum("_texts").alias("n_texts"),
        F.count_if(is_tok).alias("vocab_size"),
        F.count_if(is_lex).alias("lexical_vocab_size"),
        F.sum("_lex").alias("_n_lex"),
        F.try_divide(F.sum("_asl_sum"), F.sum("_asl_n")).alias("avg_sentence_len"),
        F.try_divide(F.sum("_asll_sum"), F.sum("_asll_n")).alias("avg_sentence_len_lexical"))
    return g.select(*by, "n_texts", "vocab_size", "lexical_vocab_size", "avg_sentence_len",
                    "avg_sentence_len_lexical",
                    F.try_divide(F.col("lexical_vocab_size").cast("double"), F.col("_n_lex")).alias(
                        "lexical_richness"))


def top_words(df: DataFrame, text: str = "text", n: int = 50, stop_words=None) -> DataFrame:
    """A12 + L1: the n most frequent lexical words (ties: token order).
    Counts are a partial-aggregated groupBy; the top-n is a bounded TakeOrdered."""
    lex = lexical_tokens(keep_tokens(word_tokens(F.col(text))), stop_words)
    counts = df.select(F.explode(lex).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    return counts.orderBy(F.col("freq").desc(), F.col("token")).limit(n)


def top_words_by(df: DataFrame, text: str, by: list[str], n: int = 50, stop_words=None) -> DataFrame:
    """A12 per group: rank, token and freq of each group's ``n`` most frequent
    lexical words (ties: token order).  Each (group, salt) keeps its first ``n``
    words, so a group's last ranking sees at most n words of each salt however
    large its vocabulary is."""
    lex = lexical_tokens(keep_tokens(word_tokens(F.col(text))), stop_words)
    counts = df.select(*by, F.explode(lex).alias("token")).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("freq"))
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("freq").desc(), F.col("token")]
    part = counts.withColumn("_salt", F.pmod(F.xxhash64("token"), F.lit(salts)))
    part = part.withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))).filter(F.col("_at") <= n)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n) \
        .select(*by, "rank", "token", "freq")


def corpus_report(df: DataFrame, text: str, by: list[str], n_top: int = 50, stop_words=None) -> DataFrame:
    """One row per group: the five corpus figures and ``top_words``, the list
    of its most frequent lexical words with their counts, in order."""
    tops = top_words_by(df, text, by, n_top, stop_words).groupBy(*by).agg(  # n_top words a group
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "token", "freq"))),
                    lambda w: F.struct(w["token"].alias("token"), w["freq"].alias("freq"))).alias("top_words"))
    report = describe_corpus(df, text, by, stop_words)
    for i, k in enumerate(by):
        tops = tops.withColumnRenamed(k, f"_by{i}")
    same = F.expr(" AND ".join(f"`{k}` <=> _by{i}" for i, k in enumerate(by)))
    return report.join(tops, same, "left").drop(*[f"_by{i}" for i in range(len(by))])


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S6 sink: the report as JSON lines, one per group."""
    report.write.mode(mode).json(path)


def wide_report(long: DataFrame, row_key: str, column_key: str, value: str, columns: list[str],
                row_order: list[str]) -> DataFrame:
    """Metric rows x group columns with a fixed column list and row order."""
    rank = F.create_map(*[x for i, m in enumerate(row_order) for x in (F.lit(m), F.lit(i))])
    wide = long.groupBy(row_key).pivot(column_key, columns).agg(F.first(value))
    return wide.withColumn("row_order", rank[F.col(row_key)])


def metrics_long(report: DataFrame, by: list[str], metrics: list[str] = REPORT_METRICS) -> DataFrame:
    """Unpivot a corpus report into (by..., metric, value) rows (S6 long form)."""
    return report.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        by, metrics, "metric", "value")
