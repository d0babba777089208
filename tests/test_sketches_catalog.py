"""Sketches that merge, ranks by ranges, folders of a split table, the catalogue of a written data set."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairlab.operators.ranking import with_range_rank
from pairlab.operators.ratings import zip_by_position
from pairlab.operators.sketches import corpus_sketches, merge_sketches, read_sketches
from pairlab.operators.textstats import describe_corpus
from pairlab.plans.build import BuiltDataset, dataset_catalog, write_dataset
from pairlab.sources.io import read_split, split_folders, write_delimited


@pytest.fixture(scope="module")
def texts(spark):
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), (F.col("id") % 40 + 1).cast("int")),
                                         lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64(F.col("id"), k), F.lit(9000)))))
    source = F.when(F.col("id") % 10 < 8, "big").when(F.col("id") % 10 == 8, "small")
    return spark.range(4000).select("id", source.alias("source"), words.alias("text"))


def test_merged_sketches_are_near_the_exact_report(texts):
    stored = corpus_sketches(texts, "text", ["source"])
    exact = describe_corpus(texts.withColumn("all", F.lit(1)), "text", ["all"]).first()
    got = read_sketches(merge_sketches(stored, []), []).first()
    assert got["n_texts"] == exact["n_texts"] == 4000
    assert abs(got["vocab_size"] - exact["vocab_size"]) < 0.05 * exact["vocab_size"]
    assert abs(got["lexical_richness"] - exact["lexical_richness"]) < 0.05 * exact["lexical_richness"]
    assert abs(got["p25"] - 10) <= 2 and abs(got["p50"] - 20) <= 2 and abs(got["p75"] - 30) <= 2


def test_merging_in_steps_counts_the_same_words(texts):
    by_two = corpus_sketches(texts.withColumn("part", F.col("id") % 7), "text", ["source", "part"])
    once = read_sketches(merge_sketches(by_two, []), []).first()
    steps = read_sketches(merge_sketches(merge_sketches(by_two, ["source"]), []), []).first()
    whole = read_sketches(corpus_sketches(texts.withColumn("g", F.lit(1)), "text", ["g"]), []).first()
    for c in ("n_texts", "vocab_size", "lexical_vocab_size"):  # a union of HLL sketches is the sketch of the union
        assert abs(once[c] - whole[c]) <= 0.02 * whole[c] and abs(steps[c] - whole[c]) <= 0.02 * whole[c]


def test_sketches_of_null_empty_and_no_texts(spark):
    rows = spark.createDataFrame([("a", None), ("a", ""), (None, "one two two")], "source string, text string")
    got = {r["source"]: r for r in read_sketches(corpus_sketches(rows, "text", ["source"]), ["source"]).collect()}
    assert (got["a"]["n_texts"], got["a"]["vocab_size"], got["a"]["p50"], got["a"]["lexical_richness"]) == (2, 0, 0.0, None)
    assert (got[None]["n_texts"], got[None]["vocab_size"], got[None]["p50"]) == (1, 2, 3.0)
    only_null = read_sketches(corpus_sketches(rows.filter("text IS NULL"), "text", ["source"]), ["source"]).first()
    assert only_null["n_texts"] == 1 and only_null["p50"] is None
    none = corpus_sketches(rows.limit(0), "text", ["source"])
    assert none.count() == 0 and read_sketches(none, ["source"]).count() == 0


def test_rank_of_a_million_equal_keys_spreads(spark):
    rows = spark.range(1_000_000).select(F.lit(7).alias("k"), F.col("id").alias("other"))
    ranked = with_range_rank(rows, ["k"], "r")
    assert ranked.agg(F.count_distinct("r"), F.min("r"), F.max("r")).first() == (1_000_000, 1, 1_000_000)
    assert ranked.filter("r <> other + 1").count() == 0
    sizes = [r["count"] for r in ranked.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) < 400_000


def test_rank_orders_nulls_first_and_zips(spark):
    x = spark.createDataFrame([(3, "c"), (None, "n"), (1, "a"), (1, "b")], "k int, v string")
    assert [(r["r"], r["v"]) for r in with_range_rank(x, ["k"], "r").orderBy("r").collect()] == [
        (1, "n"), (2, "a"), (3, "b"), (4, "c")]
    assert with_range_rank(x.limit(0), ["k"], "r").count() == 0
    y = spark.createDataFrame([(10, 0.5), (5, 0.25)], "o int, rating double")
    got = {r["v"]: r["rating"] for r in zip_by_position(x, "k", y, "o", ["rating"]).collect()}
    assert got == {"n": 0.25, "a": 0.5, "b": None, "c": None}


def test_folders_of_null_and_odd_split_names(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1), (None, 2), ("a/b=c", 3), ("x", 4)], "part string, n int")
    path = str(tmp_path / "t")
    write_delimited(rows, path, partition_by="part")
    folders = split_folders(rows, "part", path)
    back = read_split(spark, {"c": folders}, "c", schema="n int")
    assert Counter((r["split"], r["n"]) for r in back.collect()) == Counter([("x", 1), (None, 2), ("a/b=c", 3), ("x", 4)])


def test_catalogue_reads_what_was_written(spark, tmp_path):
    split = spark.createDataFrame([("o1", 's "q"', 1.5, "train"), ("o2", "", 0.0, "dev"), ("o3", None, 100.0, "test")],
                                  "original string, simplification string, label double, split string")
    held = split.drop("split").limit(2)
    out = str(tmp_path / "pairs")
    write_dataset(BuiltDataset(split, split, held, held, None, None), out)
    catalog = dataset_catalog(out)
    assert list(catalog) == ["meaning", "meaning_with_data_augmentation", "meaning_holdout_identical", "meaning_holdout_unrelated"]
    for config in ("meaning", "meaning_with_data_augmentation"):
        assert Counter(map(tuple, read_split(spark, catalog, config).collect())) == Counter(map(tuple, split.collect()))
    for config in ("meaning_holdout_identical", "meaning_holdout_unrelated"):
        assert Counter(map(tuple, read_split(spark, catalog, config, "test").drop("split").collect())) == Counter(
            map(tuple, held.collect()))
