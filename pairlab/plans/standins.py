"""Pair-curation inputs derived (by Spark) from the driver's tables.

* rated pairs      - every two consecutive sentences of a labelled document, label = 100 * quality
* rating facts     - ``events`` (item = user_id, aspect = event_type, rating = value)
* coded ratings    - rated pairs, aspect code = position modulo 3
* named ratings    - the same with aspect names; English rows are of type "system", others "human"
* candidate pool   - every sentence of every document plus every benchmark text
* holdout source   - every sentence of every user turn of ``conversations``
* scores           - ``events`` (group = user_id, item = event_id, score = value)

Ids are strings of the key columns joined by ":", so they cannot collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.functions.text import sentences_of
from pairlab.sources.io import read_table


TEXT_TABLES = {"documents", "conversations", "pages", "benchmark"}


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A driver table.  A session may ask (``spark.pairlab.textTasks``) for text tables to be dealt to that
    many tasks, for local runs on one small file; by default nothing is moved."""
    df = read_table(spark, sf_dir, name, columns)
    tasks = spark.conf.get("spark.pairlab.textTasks", None)
    return df.repartition(int(tasks)) if tasks and name in TEXT_TABLES else df


def _each_sentence(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per sentence with its number from 1."""
    return df.select(*keys, F.posexplode(sentences_of(text)).alias("_at", "sentence")).withColumn(
        "position", F.col("_at") + 1).drop("_at")


def _id(*parts) -> Column:
    return F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])


def rated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, source, lang, original, simplification, label); pair_id = doc_id:position of the original."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", sentences_of("text").alias("_s"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    n = F.greatest(F.size("_s") - 1, F.lit(0))
    two = F.arrays_zip(F.slice("_s", F.lit(1), n).alias("a"), F.slice("_s", F.lit(2), n).alias("b"))
    pairs = docs.join(labels, "doc_id").select("doc_id", "source", "lang", "quality", F.posexplode(two).alias("_at", "_p"))
    return pairs.select(
        _id("doc_id", (F.col("_at") + 1).cast("string")).alias("pair_id"), "source", "lang",
        F.col("_p.a").alias("original"), F.col("_p.b").alias("simplification"),
        (F.lit(100.0) * F.col("quality")).alias("label"))


def coded_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(original, simplification, original_sentence_id, rating, aspect: 0, 1, 2)."""
    code = F.pmod(F.substring_index("pair_id", ":", -1).cast("long"), F.lit(3)).cast("int")
    return rated_pairs(spark, sf_dir).select("original", "simplification", F.col("pair_id").alias("original_sentence_id"),
                                             F.col("label").alias("rating"), code.alias("aspect"))


def named_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, simplification, rating, sentence_id, simplification_type, aspect: a name)."""
    code = F.pmod(F.substring_index("pair_id", ":", -1).cast("long"), F.lit(3))
    return rated_pairs(spark, sf_dir).select(
        F.col("original").alias("source"), "simplification", F.col("label").alias("rating"),
        F.col("pair_id").alias("sentence_id"),
        F.when(F.col("lang") == "en", "system").otherwise("human").alias("simplification_type"),
        F.when(code == 0, "meaning").when(code == 1, "fluency").otherwise("simplicity").alias("aspect"))


def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cand_id, cand_text): documents' sentences (id = doc_id:position) and benchmark texts (id = item:item_id)."""
    docs = _each_sentence(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        _id("doc_id", "position").alias("cand_id"), F.col("sentence").alias("cand_text"))
    bench = table(spark, sf_dir, "benchmark").select(_id(F.lit("item"), "item_id").alias("cand_id"),
                                                     F.col("text").alias("cand_text"))
    return docs.unionByName(bench)


def holdout_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, original): sentences of user turns; row_id = conv_id:turn:position."""
    conv = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return _each_sentence(conv, ["conv_id", "turn"]).select(
        _id("conv_id", "turn", "position").alias("row_id"), F.col("sentence").alias("original"))
