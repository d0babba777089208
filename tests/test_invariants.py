"""Invariants of the core operators on the driver's tables."""

import math

import pyref
import pytest
from paths import SF_MID, SF_SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlab.operators.augment import augment
from pairlab.operators.harmonize import inverse_pairs
from pairlab.operators.matching import PoolExhausted, match_unrelated
from pairlab.operators.ranking import hash_key, numeric_cut_bucket, with_global_rank
from pairlab.operators.scoring import score_pairs
from pairlab.operators.split import split3
from pairlab.plans import standins as S


def test_global_rank_equals_single_window(spark):
    ev = S.table(spark, SF_MID, "events").select("event_id", "value")
    ranked = with_global_rank(ev, [F.col("value"), F.col("event_id")], "r",
                              bucket=numeric_cut_bucket(ev, "value", 32))
    ref = ev.withColumn("r2", F.row_number().over(Window.orderBy("value", "event_id")))
    got = {r["event_id"]: r["r"] for r in ranked.collect()}
    want = {r["event_id"]: r["r2"] for r in ref.collect()}
    assert got == want


def test_hash_rank_is_dense_and_total(spark):
    docs = S.table(spark, SF_MID, "documents").select("doc_id").withColumn("h", hash_key(7, "doc_id"))
    r = sorted(x["k"] for x in with_global_rank(docs, ["h", "doc_id"], "k").collect())
    assert r == list(range(1, docs.count() + 1))


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_split_exact_disjoint_and_partition_independent(spark, parts):
    docs = S.table(spark, SF_MID, "documents").select("doc_id").repartition(parts)
    out = split3(docs, ["doc_id"], seed=42)
    rows = out.collect()
    counts = {}
    for r in rows:
        counts[r["split"]] = counts.get(r["split"], 0) + 1
    n = len(rows)
    assert n == 1000 and len({r["doc_id"] for r in rows}) == n
    assert counts == {"test": 300, "dev": 70, "train": 630}
    base = {r["doc_id"]: r["split"] for r in split3(S.table(spark, SF_MID, "documents").select("doc_id"),
                                                    ["doc_id"], seed=42).collect()}
    assert {r["doc_id"]: r["split"] for r in rows} == base


def test_split_sizes_follow_ceil_rule(spark):
    # 1,355 rows -> 407 test, 95 dev, 853 train (the published sizes)
    df = spark.range(1355).withColumnRenamed("id", "k")
    c = {r["split"]: r["n"] for r in split3(df, ["k"]).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert c == {"test": 407, "dev": 95, "train": 853}


def test_matching_rules(spark):
    rows = S.rated_pairs(spark, SF_SMALL).select(F.col("pair_id").alias("row_id"), "original")
    pool = S.candidate_pool(spark, SF_SMALL)
    m = match_unrelated(rows, pool, threshold=0.2, seed=3)
    pairs = m.pairs.collect()
    assert len(pairs) == rows.count()                       # one match per row
    assert len({p["row_id"] for p in pairs}) == len(pairs)
    assert len({p["cand_id"] for p in pairs}) == len(pairs)  # each candidate once
    for p in pairs:                                           # strictly below threshold (brute force)
        assert pyref.rouge_n(p["simplification"], p["original"], 1) < 0.2
        assert pyref.rouge_n(p["simplification"], p["original"], 2) < 0.2
        assert pyref.rouge_l(p["simplification"], p["original"]) < 0.2
        assert pyref.bleu(p["original"], p["simplification"]) < 20
    used = {r["cand_id"] for r in m.used.collect()}
    assert {p["cand_id"] for p in pairs} <= used
    assert m.unmatched.count() == 0
    stats = m.stats.orderBy("round").collect()            # A14 counters
    assert sum(r["accepted"] for r in stats) == len(pairs)
    assert sum(r["accepted"] + r["rejected"] for r in stats) == len(used)
    assert stats[0]["window"] == 1 and stats[0]["rows_open"] == len(pairs)


def test_matching_pool_exhaustion(spark):
    rows = S.rated_pairs(spark, SF_SMALL).select(F.col("pair_id").alias("row_id"), "original")
    pool = S.candidate_pool(spark, SF_SMALL).orderBy("cand_id").limit(10)
    m = match_unrelated(rows, pool, strict=False)
    assert m.pairs.count() + m.unmatched.count() == rows.count()
    assert m.pairs.count() <= 10
    with pytest.raises(PoolExhausted):
        match_unrelated(rows, pool, strict=True)


def test_augmented_size_is_five_n(spark):
    rated = S.rated_pairs(spark, SF_SMALL).select("pair_id", "original", "simplification", "label")
    n = rated.count()
    n_ident = rated.filter(F.col("original") == F.col("simplification")).count()
    aug = augment(rated, S.candidate_pool(spark, SF_SMALL))
    kinds = {r["kind"]: r["n"] for r in aug.pairs.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds["rated"] == kinds["unrelated"] == kinds["identical"] == n
    assert kinds["inverse-rated"] == n - n_ident
    assert sum(kinds.values()) == 5 * n - n_ident


def test_inverse_is_an_involution(spark):
    rated = S.rated_pairs(spark, SF_SMALL).select("pair_id", "original", "simplification", "label")
    twice = inverse_pairs(inverse_pairs(rated))
    assert sorted(twice.collect()) == sorted(rated.filter(F.col("original") != F.col("simplification")).collect())


def test_metric_laws(spark):
    rated = S.rated_pairs(spark, SF_MID)
    fw = score_pairs(rated).collect()
    bw = {r["pair_id"]: r for r in score_pairs(rated, "simplification", "original").collect()}
    asym = 0
    for r in fw:
        assert r["rougeL"] <= r["rouge1"] + 1e-12
        assert abs(r["rouge1"] - bw[r["pair_id"]]["rouge1"]) < 1e-12
        assert abs(r["rouge2"] - bw[r["pair_id"]]["rouge2"]) < 1e-12
        asym += abs(r["bleu"] - bw[r["pair_id"]]["bleu"]) > 1e-9
    assert asym > 0  # BLEU is not symmetric
    same = score_pairs(rated.select("pair_id", F.col("original"), F.col("original").alias("simplification")))
    for r in same.collect():
        if pyref.rouge_tokens(r["original"]):
            assert r["rouge1"] == pytest.approx(1.0) and r["rougeL"] == pytest.approx(1.0)


def test_metrics_equal_plain_python(spark):
    rated = S.rated_pairs(spark, SF_SMALL)
    for r in score_pairs(rated).collect():
        a, b = r["original"], r["simplification"]
        assert r["rouge1"] == pytest.approx(pyref.rouge_n(a, b, 1), abs=1e-12)
        assert r["rouge2"] == pytest.approx(pyref.rouge_n(a, b, 2), abs=1e-12)
        assert r["rougeL"] == pytest.approx(pyref.rouge_l(a, b), abs=1e-12)
        assert r["bleu"] == pytest.approx(pyref.bleu(a, b), abs=1e-9)


def test_limited_rank_is_head_of_full_rank(spark):
    docs = S.table(spark, SF_MID, "documents").select("doc_id").withColumn("h", hash_key(5, "doc_id"))
    full = {r["doc_id"]: r["k"] for r in with_global_rank(docs, ["h", "doc_id"], "k").collect()}
    head = {r["doc_id"]: r["k"] for r in with_global_rank(docs, ["h", "doc_id"], "k", limit=37).collect()}
    assert head == {d: k for d, k in full.items() if k <= 37}


def test_build_write_and_read_back(spark):
    from pairlab.plans.build import build_dataset, write_dataset
    from pairlab.session import scratch_path
    from pairlab.sources.io import PAIR_SCHEMA, read_split

    facts = S.rated_pairs(spark, SF_SMALL).select("pair_id", "original", "simplification", "label")
    holdout = S.holdout_source(spark, SF_SMALL).select(F.col("row_id").alias("pair_id"), "original")
    built = build_dataset(facts, S.candidate_pool(spark, SF_SMALL), holdout)
    out = scratch_path(spark, "built")
    write_dataset(built, out)
    catalog = {"meaning": {s: f"{out}/meaning/split={s}" for s in ("train", "dev", "test")}}
    back = read_split(spark, catalog, "meaning", "full", schema=PAIR_SCHEMA)
    want = built.meaning.select("original", "simplification", "label", "split")
    assert sorted(back.collect()) == sorted(want.collect())
    sizes = {r["split"]: r["n"] for r in back.groupBy("split").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    assert sizes["test"] == math.ceil(0.3 * n)
    assert spark.read.option("header", "true").option("sep", "\t").csv(
        f"{out}/meaning_holdout_identical").count() == holdout.count()
