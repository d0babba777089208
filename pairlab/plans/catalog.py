"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Computed columns carry the same names as in ``pairlab.plans.oracle``.
Floating statistics are rounded to 6 decimals for reporting (the library
functions themselves return full precision).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.operators.dedupe import cross_source_duplicates, distinct_rows, duplicate_counts, remove_cross_source_duplicates
from pairlab.operators.augment import augment, holdout
from pairlab.operators.batch import batch_apply
from pairlab.operators.ngrams import copied_followers, copied_ngrams, penalise, repeated_ngram_share, self_copies
from pairlab.operators.scored import best_by, cut_at, pick_by, prefix_score, softmax_by, top_k, top_k_top_p
from pairlab.functions.text import keep_tokens, word_tokens
from pairlab.sources.io import read_delimited, read_split, split_folders, write_delimited
from pairlab.session import materialize, scratch_path
from pairlab.operators.harmonize import harmonize, identical_pairs, inverse_pairs, recode
from pairlab.operators.matching import match_unrelated
from pairlab.operators.ratings import describe_ratings, mean_rating, rating_table, zip_by_position
from pairlab.operators.ranking import hash_key, with_global_rank
from pairlab.operators.scoring import flag_unrelated, score_pairs
from pairlab.operators.sketches import QUARTILES, corpus_sketches, merge_sketches, read_sketches
from pairlab.operators.split import split3, split_sizes
from pairlab.operators.textstats import (corpus_report, describe_corpus, doc_stats, metrics_long, top_words,
                                         top_words_by, wide_report, write_report)
from pairlab.plans import standins as S
from pairlab.plans.build import RatedSource, clean_ratings, combine_sources
from pairlab.sources.io import union_all

SEED = 42


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- ratings -----------------------------------------------------------------

def _click_facts(spark, sf_dir):
    return S.table(spark, sf_dir, "events").filter(F.col("event_type") == "click")


def q01_mean_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 + A1: mean rating per item for one aspect."""
    m = mean_rating(_click_facts(spark, sf_dir), ["user_id"], rating="value")
    return m.select("user_id", r6("rating").alias("rating"), "n_ratings")


def q02_mean_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 + W1: k-th first-seen item gets the k-th key-sorted group mean."""
    facts = _click_facts(spark, sf_dir).filter(F.col("user_id").isNotNull())
    x = distinct_rows(facts.select("user_id", "event_id"), ["user_id"], keep="first", order="event_id") \
        .withColumnRenamed("event_id", "first_event_id")
    y = mean_rating(facts, ["user_id"], rating="value", with_count=False)
    z = zip_by_position(x, "first_event_id", y, "user_id", ["rating"])
    return z.select("user_id", "first_event_id", r6("rating").alias("rating_positional"))


# --- cross-source duplicates ----------------------------------------------------

def _rated_and_unrated_docs(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents")
    labels = S.table(spark, sf_dir, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_semi"), docs.join(labels, "doc_id", "left_anti")


def q03_cross_source_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unrated documents that do not repeat a rated one (English rows only
    are candidates for removal)."""
    a, b = _rated_and_unrated_docs(spark, sf_dir)
    kept = remove_cross_source_duplicates(b, a, ["text", "lang", "n_chars"], only_when=(F.col("lang") == "en"))
    return kept.select("doc_id", "source", "lang", "n_chars")


def q04_cross_source_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows J1 removes."""
    a, b = _rated_and_unrated_docs(spark, sf_dir)
    hit = cross_source_duplicates(b, a, ["text", "lang", "n_chars"], only_when=(F.col("lang") == "en"))
    return hit.select("doc_id", "source", "lang", "n_chars")


def q05_distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: distinct (text, lang) rows."""
    return distinct_rows(S.table(spark, sf_dir, "documents").select("text", "lang"), ["text", "lang"])


def q06_distinct_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 + J3: one row per text, attributes of its last occurrence."""
    docs = S.table(spark, sf_dir, "documents").select("text", "doc_id", "source")
    return distinct_rows(docs, ["text"], keep="last", order="doc_id")


# --- harmonise + union -----------------------------------------------------------

CANONICAL = ["id", "original", "simplification", "rating", "aspect", "corpus"]


def q07_harmonize_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1-P6 + U1: five differently shaped tables to one pair schema."""
    t = lambda n: S.table(spark, sf_dir, n)
    ignore = {"Answer.adequacy": "rating"}  # absent everywhere: silently ignored
    docs = harmonize(t("documents"), {"doc_id": "id", "text": "original", **ignore}, CANONICAL,
                     constants={"corpus": "documents"}, drop=["n_chars"])
    bench = harmonize(t("benchmark"), {"item_id": "id", "text": "simplification", **ignore}, CANONICAL,
                      constants={"corpus": "benchmark"})
    conv = harmonize(t("conversations"), {"conv_id": "id", "text": "original", "role": "aspect", **ignore},
                     CANONICAL, constants={"corpus": "conversations"})
    pages = harmonize(t("pages"), {"page_id": "id", "url": "original", **ignore}, CANONICAL,
                      constants={"corpus": "pages"}, drop=["html"])
    labels = t("labels").select(
        F.col("doc_id").alias("id"), recode("quality", {0: "low", 1: "high"}).alias("aspect"),
        F.col("toxic").cast("double").alias("rating"), F.lit("labels").alias("corpus"))
    return union_all(docs, bench, conv, pages, labels).select(*CANONICAL)


# --- description ------------------------------------------------------------------

def q08_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: eight-number description per aspect and overall."""
    d = describe_ratings(S.table(spark, sf_dir, "events"), "value", by="event_type")
    return d.select("group", "count", *[r6(c).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def q08t_rating_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven rating statistics x (event types + all)."""
    t = rating_table(S.table(spark, sf_dir, "events"), "value", "event_type", EVENT_TYPES)
    return t.select("statistic", "row_order", *[r6(c).alias(c) for c in [*EVENT_TYPES, "all"]])


# --- split -------------------------------------------------------------------------

def q09_split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP1: exact-size seeded split of the documents."""
    return split3(S.table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], seed=SEED)


def q09g_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP1 with group_key: the turns of a conversation stay in one split."""
    conv = S.table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return split3(conv, ["conv_id", "turn"], seed=SEED, group_key=["conv_id"])


def mean_labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = S.rated_pairs(spark, sf_dir)
    return mean_rating(rated, ["original", "simplification"], rating="label", out="label", with_count=False)


def q10_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents + labels -> pairs -> mean label per pair -> split -> sizes."""
    pairs = mean_labelled_pairs(spark, sf_dir)
    return split_sizes(split3(pairs, ["original", "simplification"], seed=SEED))


# --- text statistics ------------------------------------------------------------------

def q11_doc_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept tokens and lexical words per document."""
    st = doc_stats(S.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return st.select("doc_id", "n_tokens", "n_lexical")


def q12_sentence_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7, T8, per-text A9/A10: sentences and mean tokens per sentence."""
    st = doc_stats(S.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return st.select("doc_id", "n_sentences", r6("avg_sentence_len").alias("avg_sentence_len"),
                     r6("avg_sentence_len_lexical").alias("avg_sentence_len_lexical"))


def _corpus_report(df, by):
    rep = describe_corpus(df, "text", by)
    return rep.select(*by, "n_texts", "vocab_size", "lexical_vocab_size",
                      *[r6(c).alias(c) for c in ("avg_sentence_len", "avg_sentence_len_lexical", "lexical_richness")])


def q13_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, A8, A11 (+A9, A10): corpus figures per language."""
    return _corpus_report(S.table(spark, sf_dir, "documents").select("lang", "text"), ["lang"])


def q13a_vocabulary_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, A8, A4 by sketches: stored per language, merged to one row for all, and held against exact figures.
    ``*_close``: a vocabulary within 5 %, quartiles of tokens per text within 4 % of all ranks."""
    docs = S.table(spark, sf_dir, "documents").select("lang", "text")
    stored = materialize(corpus_sketches(docs, "text", ["lang"]), "sketches")
    keys = ["lang", "is_all"]
    every = merge_sketches(stored, []).select(F.lit(None).cast("string").alias("lang"), F.lit(True).alias("is_all"), "*")
    got = read_sketches(stored.withColumn("is_all", F.lit(False)).unionByName(every), keys)
    got = got.select(F.col("lang").alias("_l"), F.col("is_all").alias("_a"), F.col("vocab_size").alias("_v"),
                     F.col("lexical_vocab_size").alias("_x"), "p25", "p50", "p75")
    same = F.expr("lang <=> _l AND is_all = _a")
    twice = F.explode(F.array(F.struct("lang", F.lit(False).alias("is_all")),
                              F.struct(F.lit(None).cast("string").alias("lang"), F.lit(True).alias("is_all"))))
    texts = docs.select(twice.alias("_g"), "text").select("_g.*", "text")
    exact = describe_corpus(texts, "text", keys)
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.lit(0.05) * F.col(b)
    lengths = doc_stats(texts.filter(F.col("text").isNotNull()), "text").select(*keys, "n_tokens")
    off = [(F.avg((F.col("n_tokens") < F.col(f"p{int(100 * q)}")).cast("int")) <= q + 0.04)
           & (F.avg((F.col("n_tokens") <= F.col(f"p{int(100 * q)}")).cast("int")) >= q - 0.04) for q in QUARTILES]
    ranks = lengths.join(got, same).groupBy("_l", "_a").agg((off[0] & off[1] & off[2]).alias("quartiles_close"))
    out = exact.join(got.drop("p25", "p50", "p75"), same).drop("_l", "_a").join(ranks, same)
    return out.select(*keys, "n_texts", "vocab_size", "lexical_vocab_size", near("_v", "vocab_size").alias("vocab_close"),
                      near("_x", "lexical_vocab_size").alias("lexical_close"), "quartiles_close")


def q14_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 + L1: 50 most frequent lexical words."""
    return top_words(S.table(spark, sf_dir, "documents"), "text", 50)


def _pair_texts(spark, sf_dir):
    rated = S.rated_pairs(spark, sf_dir)
    return rated.select("source", "original", "simplification").unpivot(
        ["source"], ["original", "simplification"], "side", "text")


def q15_corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13 + S6: five corpus figures per (source, side) of the rated pairs."""
    return _corpus_report(_pair_texts(spark, sf_dir), ["source", "side"])


def q14g_top_words_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 per (source, side): 50 most frequent lexical words of the rated pairs."""
    return top_words_by(_pair_texts(spark, sf_dir), "text", ["source", "side"], 50)


def q15s_written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report per (source, side) with its top 50 words, written as JSON lines and read back."""
    path = scratch_path(spark, "report")
    report = corpus_report(_pair_texts(spark, sf_dir), "text", ["source", "side"], 50)
    write_report(report, path)
    back = spark.read.schema(report.schema).json(path)
    words = F.array_join(F.transform("top_words", lambda w: F.concat_ws(":", w["token"], w["freq"].cast("string"))), " ")
    return back.select("source", "side", "n_texts", "vocab_size", "lexical_vocab_size", *[
        r6(c).alias(c) for c in ("avg_sentence_len", "avg_sentence_len_lexical", "lexical_richness")], words.alias("top_words"))


def q15w_wide_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows x language columns."""
    docs = S.table(spark, sf_dir, "documents").select("lang", "text")
    langs = sorted(r["lang"] for r in docs.select("lang").distinct().collect() if r["lang"] is not None)  # the columns
    rep = _corpus_report(docs, ["lang"])
    long = metrics_long(rep, ["lang"])
    return wide_report(long, "metric", "lang", "value", langs,
                       ["vocab_size", "lexical_vocab_size", "avg_sentence_len", "avg_sentence_len_lexical",
                        "lexical_richness"])


# --- pair metrics ------------------------------------------------------------------------

def _metric_query(metric):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored = score_pairs(S.rated_pairs(spark, sf_dir), metrics=(metric,))
        return scored.select("pair_id", r6(metric).alias(metric))
    q.__doc__ = f"M0-M4: {metric} of each rated pair (original vs simplification)."
    return q


q16_rouge1 = _metric_query("rouge1")
q17_rouge2 = _metric_query("rouge2")
q18_rougel = _metric_query("rougeL")
q19_bleu = _metric_query("bleu")


def first_round_pairs(rows: DataFrame, pool: DataFrame, seed: int = SEED) -> DataFrame:
    """k-th row (md5 order of its id) meets the k-th candidate (md5 order)."""
    r = with_global_rank(rows.withColumn("_h", hash_key(seed, "pair_id")), [F.col("_h"), F.col("pair_id")], "k")
    c = with_global_rank(pool.withColumn("_h", hash_key(seed, "cand_id")), [F.col("_h"), F.col("cand_id")], "k")
    return r.drop("_h").join(c.drop("_h"), "k")


def q20_unrelated_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rated originals against rank-aligned candidates, thresholds 0.20/20."""
    pairs = first_round_pairs(S.rated_pairs(spark, sf_dir).select("pair_id", "original"),
                              S.candidate_pool(spark, sf_dir))
    flagged = flag_unrelated(pairs, "original", "cand_text")
    return flagged.select("pair_id", "cand_id", r6("rouge1").alias("rouge1"), r6("rouge2").alias("rouge2"),
                          r6("bleu").alias("bleu"), "unrelated")


# --- matching and augmentation -------------------------------------------------------------

def _rated_rows(spark, sf_dir):
    return S.rated_pairs(spark, sf_dir).select("pair_id", "original", "simplification", "label")


def q21_unrelated_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 + A14: one unrelated candidate per rated original (rounds until done)."""
    rows = _rated_rows(spark, sf_dir).select(F.col("pair_id").alias("row_id"), "original")
    m = match_unrelated(rows, S.candidate_pool(spark, sf_dir), seed=SEED)
    return m.pairs.select(F.col("row_id").alias("pair_id"), "cand_id", "round", r6("rouge1").alias("rouge1"),
                          r6("rouge2").alias("rouge2"), r6("bleu").alias("bleu"))


def q21s_match_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per round of q21 its window, open rows, scored pairs, accepted and thrown-away candidates."""
    rows = _rated_rows(spark, sf_dir).select(F.col("pair_id").alias("row_id"), "original")
    return match_unrelated(rows, S.candidate_pool(spark, sf_dir), seed=SEED).stats


def q22_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8 + G1: one self-pair (label 100) per rated row."""
    return identical_pairs(_rated_rows(spark, sf_dir).select("pair_id", "original"))


def q23_commutative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 + G3: inverse pairs, label kept, already-identical pairs skipped."""
    return inverse_pairs(_rated_rows(spark, sf_dir))


def q24_augmented_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2 + G4 + SP1: rows per (kind, split) of the augmented, re-split set."""
    aug = augment(_rated_rows(spark, sf_dir), S.candidate_pool(spark, sf_dir), seed=SEED)
    return split3(aug.pairs, ["kind", "pair_id"], seed=SEED).groupBy("kind", "split").agg(
        F.count(F.lit(1)).alias("n_rows"))


def _holdout_rows(spark, sf_dir):
    return S.holdout_source(spark, sf_dir).select(F.col("row_id").alias("pair_id"), "original")


def q25_holdout_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5 (identical part): label-100 self-pairs of the holdout source."""
    return identical_pairs(_holdout_rows(spark, sf_dir))


def q25u_holdout_unrelated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5 (unrelated part): threshold 0.25, candidates from the other end of the
    pool, none the augmentation looked at.  Rows-only check."""
    pool = materialize(S.candidate_pool(spark, sf_dir), "holdout-pool")  # used by augmentation and holdout
    aug = augment(_rated_rows(spark, sf_dir), pool, seed=SEED)
    _, m = holdout(_holdout_rows(spark, sf_dir), pool, aug.match.used, seed=SEED)
    return m.pairs.select(F.col("row_id").alias("pair_id"), "cand_id", "round", r6("rouge1").alias("rouge1"),
                          r6("rouge2").alias("rouge2"), r6("bleu").alias("bleu"))


# --- score tables ------------------------------------------------------------------------------

def _scores(spark, sf_dir):
    """events as a long score table: group = user_id, item = event_id."""
    return S.table(spark, sf_dir, "events").select(
        "user_id", "event_id", (F.col("value") / F.lit(100.0)).alias("score"))


def q26_topk_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-3 per group, ties at the 3rd place kept."""
    ev = S.table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return top_k(ev, "user_id", "event_id", "value", 3)


def q27_top_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k 10, then top-p 0.9 on the survivors' softmax, min_keep 2."""
    return top_k_top_p(_scores(spark, sf_dir), "user_id", "event_id", "score", top_k=10, top_p=0.9, min_keep=2)


def q28_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-group softmax."""
    p = softmax_by(_scores(spark, sf_dir), "user_id", "score")
    return p.select("user_id", "event_id", r6("prob").alias("prob"))


def q29_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arg-max item per group (ties: smallest item)."""
    return best_by(_scores(spark, sf_dir), "user_id", "event_id", "score")


def q30_weighted_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded draw per group from softmax(score)."""
    return pick_by(_scores(spark, sf_dir), "user_id", "event_id", "score", seed=SEED)


def q31_prefix_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, summed value of the events before the first error."""
    ev = S.table(spark, sf_dir, "events")
    ps = prefix_score(ev, "user_id", ["ts", "event_id"], "value", F.col("event_type") == "error")
    return ps.select("user_id", r6("seq_score").alias("seq_score"), "n_steps", "ended")


def _turn_tokens(spark, sf_dir):
    conv = S.table(spark, sf_dir, "conversations")
    return conv.select("conv_id", "turn", keep_tokens(word_tokens(F.col("text"))).alias("tokens"))


def q32_cut_at_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10 + W11: tokens before the first end marker ("the"), at most 100."""
    cut = _turn_tokens(spark, sf_dir).select("conv_id", "turn", cut_at(F.col("tokens"), "the", 100).alias("c"))
    return cut.select("conv_id", "turn", F.size("c").alias("n_kept"), F.array_join("c", " ").alias("kept_text"))


def _toy_generator(pdf):
    """Deterministic stand-in for a generation callable (one output per input)."""
    import pandas as pd

    return pd.DataFrame({
        "output_text": pdf["lang"].astype(str) + "#" + pdf["run_id"].astype(str),
        "score": ((pdf["n_chars"] * (pdf["run_id"] + 1)) % 7).astype("float64"),
    })


def q33_fanout_refold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 + G6 + G7 + W2: 3 runs per document in batches of 8, refolded per
    document and ordered by score (ties: run order)."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    out = batch_apply(docs, _toy_generator, "output_text string, score double", ["doc_id"], batch_size=8,
                      num_runs=3, sort_by="score")
    best = F.col("runs")[0]
    return out.select("doc_id", best["run_id"].cast("bigint").alias("best_run"),
                      F.array_join(F.transform("runs", lambda r: r["run_id"].cast("string")), ",").alias("run_order"),
                      best["score"].alias("best_score"), best["output_text"].alias("best_text"))


def q34_ngram_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts (as generated sequences) whose last 3-gram occurs in
    a document, with the document token that follows it there."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id", keep_tokens(word_tokens(F.col("text"))).alias("t"))
    bench = S.table(spark, sf_dir, "benchmark").select("item_id", keep_tokens(word_tokens(F.col("text"))).alias("t"))
    return copied_ngrams(bench, ["item_id"], "t", docs, ["doc_id"], "t", 3)


def q34f_copied_followers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1 by follower: the same hits, counted per following token before they are joined."""
    docs = S.table(spark, sf_dir, "documents").select(keep_tokens(word_tokens(F.col("text"))).alias("t"))
    bench = S.table(spark, sf_dir, "benchmark").select("item_id", keep_tokens(word_tokens(F.col("text"))).alias("t"))
    return copied_followers(bench, ["item_id"], "t", docs, "t", 3)


def q35_ngram_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose last 3-gram occurred earlier in the same turn."""
    return self_copies(_turn_tokens(spark, sf_dir), ["conv_id", "turn"], "tokens", 3)


def q35r_repeat_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N2 summary: 3-gram occurrences and repeated ones per turn."""
    return repeated_ngram_share(_turn_tokens(spark, sf_dir), ["conv_id", "turn"], "tokens", 3)


def q36_copy_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token scores (count in the turn) minus 1000 once for every token that
    would repeat a 3-gram of the turn."""
    toks = _turn_tokens(spark, sf_dir)
    scores = toks.select("conv_id", "turn", F.explode("tokens").alias("token")).groupBy(
        "conv_id", "turn", "token").agg(F.count(F.lit(1)).cast("double").alias("score"))
    hits = self_copies(toks, ["conv_id", "turn"], "tokens", 3).withColumnRenamed("next_token", "token")
    return penalise(scores, hits, ["conv_id", "turn", "token"])


def q37_tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write conversations as TSV, one folder per role (split), and
    read all splits back through the split catalogue."""
    conv = S.table(spark, sf_dir, "conversations")
    path = scratch_path(spark, "tsv-roundtrip")
    write_delimited(conv, path, sep="\t", partition_by="role")
    catalog = {"conversations": split_folders(conv, "role", path)}
    schema = "conv_id bigint, turn bigint, text string"
    back = read_split(spark, catalog, "conversations", "full", schema=schema)
    return back.select("conv_id", "turn", F.col("split").alias("role"), "text")


# --- end to end ----------------------------------------------------------------------------------

def q38_build_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average ratings per pair -> exact split -> augmented set re-split ->
    holdout identical/unrelated; rows per (config, split)."""
    from pairlab.plans.build import build_dataset

    b = build_dataset(_rated_rows(spark, sf_dir), S.candidate_pool(spark, sf_dir), _holdout_rows(spark, sf_dir),
                      seed=SEED)
    parts = [
        b.meaning.select(F.lit("meaning").alias("config"), "split"),
        b.augmented.select(F.lit("meaning_with_data_augmentation").alias("config"), "split"),
        b.holdout_identical.select(F.lit("meaning_holdout_identical").alias("config"), F.lit("holdout").alias("split")),
        b.holdout_unrelated.select(F.lit("meaning_holdout_unrelated").alias("config"), F.lit("holdout").alias("split")),
    ]
    return union_all(*parts).groupBy("config", "split").agg(F.count(F.lit(1)).alias("n_rows"))


def q39_four_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rating tables of different shapes, each filtered, averaged per its own key and renamed, as one."""
    coded, named = S.coded_ratings(spark, sf_dir), S.named_ratings(spark, sf_dir)
    direct = S.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("sent_id"), F.col("text").alias("orig_sent"), F.col("text").alias("simp_sent"),
        F.lit(100.0).alias("meaning"))
    rated = S.rated_pairs(spark, sf_dir).select(
        F.col("original").alias("Input.original"), F.col("simplification").alias("Input.simplified"),
        F.col("pair_id").alias("Input.id"), F.col("label").alias("Answer.adequacy"))
    kept, _ = clean_ratings(named, coded.filter("rating = 100"))
    return combine_sources([
        RatedSource("coded", coded, key=("original_sentence_id",), only=F.col("aspect") == 0),
        RatedSource("input", rated, {"Input.original": "original", "Input.simplified": "simplification",
                                     "Input.id": "original_sentence_id", "Answer.adequacy": "rating"},
                    key=("simplification",)),
        RatedSource("direct", direct, {"orig_sent": "original", "simp_sent": "simplification", "meaning": "rating",
                                       "sent_id": "original_sentence_id"}),
        RatedSource("named", kept, {"source": "original", "sentence_id": "original_sentence_id"},
                    key=("original", "simplification"), only=F.col("aspect") == "meaning"),
    ]).withColumn("label", r6("label"))


def q40_clean_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 + J1 + P6 + S5: named ratings without the system rows that the coded table holds, as CSV and read back."""
    kept, _ = clean_ratings(S.named_ratings(spark, sf_dir), S.coded_ratings(spark, sf_dir).filter("rating = 100"))
    path = scratch_path(spark, "clean-ratings")
    write_delimited(kept, path, sep=",")
    return read_delimited(spark, path, schema=kept.schema)


def q40c_duplicates_by_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows q40 removes, per aspect."""
    _, gone = clean_ratings(S.named_ratings(spark, sf_dir), S.coded_ratings(spark, sf_dir).filter("rating = 100"))
    return duplicate_counts(gone, "aspect")


QUERIES = {
    "q01_mean_rating": q01_mean_rating,
    "q02_mean_positional": q02_mean_positional,
    "q03_cross_source_antijoin": q03_cross_source_antijoin,
    "q04_cross_source_matches": q04_cross_source_matches,
    "q05_distinct_first": q05_distinct_first,
    "q06_distinct_last": q06_distinct_last,
    "q07_harmonize_union": q07_harmonize_union,
    "q08_describe": q08_describe,
    "q08t_rating_table": q08t_rating_table,
    "q09_split_assign": q09_split_assign,
    "q09g_group_split": q09g_group_split,
    "q10_split_counts": q10_split_counts,
    "q11_doc_token_stats": q11_doc_token_stats,
    "q12_sentence_length": q12_sentence_length,
    "q13_vocabulary": q13_vocabulary,
    "q13a_vocabulary_sketches": q13a_vocabulary_sketches,
    "q14_top_words": q14_top_words,
    "q14g_top_words_by_side": q14g_top_words_by_side,
    "q15_corpus_report": q15_corpus_report,
    "q15s_written_report": q15s_written_report,
    "q15w_wide_report": q15w_wide_report,
    "q16_rouge1": q16_rouge1,
    "q17_rouge2": q17_rouge2,
    "q18_rougel": q18_rougel,
    "q19_bleu": q19_bleu,
    "q20_unrelated_filter": q20_unrelated_filter,
    "q21_unrelated_match": q21_unrelated_match,
    "q21s_match_counters": q21s_match_counters,
    "q22_identical": q22_identical,
    "q23_commutative": q23_commutative,
    "q24_augmented_dataset": q24_augmented_dataset,
    "q25_holdout_identical": q25_holdout_identical,
    "q25u_holdout_unrelated": q25u_holdout_unrelated,
    "q26_topk_ties": q26_topk_ties,
    "q27_top_p": q27_top_p,
    "q28_softmax": q28_softmax,
    "q29_argmax": q29_argmax,
    "q30_weighted_pick": q30_weighted_pick,
    "q31_prefix_score": q31_prefix_score,
    "q32_cut_at_marker": q32_cut_at_marker,
    "q33_fanout_refold": q33_fanout_refold,
    "q34_ngram_copy": q34_ngram_copy,
    "q34f_copied_followers": q34f_copied_followers,
    "q35_ngram_repeat": q35_ngram_repeat,
    "q35r_repeat_share": q35r_repeat_share,
    "q36_copy_penalty": q36_copy_penalty,
    "q37_tsv_roundtrip": q37_tsv_roundtrip,
    "q38_build_dataset": q38_build_dataset,
    "q39_four_sources": q39_four_sources,
    "q40_clean_ratings": q40_clean_ratings,
    "q40c_duplicates_by_aspect": q40c_duplicates_by_aspect,
}
