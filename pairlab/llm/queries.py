"""The registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from pairlab.llm.common import documents
from pairlab.llm.fingerprints import edited_fingerprints
from pairlab.llm.importance import resample
from pairlab.llm.licences import licence_scan
from pairlab.llm.line_dedup import line_classes
from pairlab.llm.mixing import mix
from pairlab.llm.ngram_join import ngram_components
from pairlab.llm.packing import pack
from pairlab.llm.pii import find_personal_data
from pairlab.llm.quality_model import score_quality
from pairlab.llm.quality_rules import MAX_REPEAT_PERCENT, MIN_WORDS, quality_measures
from pairlab.llm.repeats import without_repeats
from pairlab.llm.secrets import find_secrets
from pairlab.llm.spelling import spelling_forms

#: The byte-level BPE vocabulary as ranks: same ids as byte_bpe_50k.json (tested), several times faster.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_ngram_join(spark, sf_dir):
    return ngram_components(documents(spark, sf_dir))


def op2_fingerprints(spark, sf_dir):
    return edited_fingerprints(documents(spark, sf_dir))


def op3_license_scan(spark, sf_dir):
    return licence_scan(documents(spark, sf_dir))


def op4_quality_classifier(spark, sf_dir):
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def op5_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir), TOKENIZER)


def op6_pii(spark, sf_dir):
    return find_personal_data(documents(spark, sf_dir))


def op7_mixing(spark, sf_dir):
    return mix(documents(spark, sf_dir), cut_last=True).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_secrets(spark, sf_dir):
    return find_secrets(documents(spark, sf_dir))


def op9_line_dedup(spark, sf_dir):
    return line_classes(documents(spark, sf_dir))


def op10_quality_rules(spark, sf_dir):
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return quality_measures(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "kept")


def op11_spelling_variants(spark, sf_dir):
    return spelling_forms(documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


def op12_suffix_dedup(spark, sf_dir):
    return without_repeats(documents(spark, sf_dir))


def op13_importance_resampling(spark, sf_dir):
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_ngram_join, op2_fingerprints, op3_license_scan, op4_quality_classifier, op5_packing, op6_pii, op7_mixing,
    op8_secrets, op9_line_dedup, op10_quality_rules, op11_spelling_variants, op12_suffix_dedup,
    op13_importance_resampling)}
QUERIES["pipeline"] = corpus_pipeline.run


def oracle_sql() -> dict[str, str]:
    from pairlab.llm.oracle import SQL

    return SQL
