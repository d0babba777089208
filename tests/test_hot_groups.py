"""Groups that hold most of the rows, hard rows, long texts: results and how the work is dealt."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlab.functions.metrics import clipped_overlap
from pairlab.operators import matching, scored
from pairlab.operators.ngrams import copied_followers
from pairlab.operators.ratings import describe_ratings, rating_table
from pairlab.operators.scored import ordered_prefix, prefix_score, softmax_by, top_k, top_k_top_p, with_stats
from pairlab.operators.split import split3
from pairlab.operators.textstats import corpus_report, top_words_by, write_report
from pairlab.sources.io import read_delimited, write_delimited


def _hot(spark, n=20_000):
    """Nine of ten rows in one group, a NULL group, many small ones."""
    g = F.when(F.col("id") % 10 < 9, "hot").when(F.col("id") % 200 == 9, F.lit(None)).otherwise(
        F.concat(F.lit("g"), F.col("id") % 37))
    return spark.range(n).select(g.alias("g"), F.col("id").alias("item"), F.pmod(F.xxhash64("id"), F.lit(997)).cast("double").alias("score"))


def _largest_task(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes), sum(sizes)


def test_statistics_of_a_hot_group_meet_its_rows_in_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(scored, "LEAST_HEAVY", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = _hot(spark)
        stats = df.groupBy("g").agg(F.max("score").alias("top"), F.count(F.lit(1)).alias("_n"))
        out = with_stats(df, stats, "g")
        most, every = _largest_task(out)
        assert every == 20_000 and most < 0.3 * every  # 0.9 of all if the group were one task
        want = {(r["g"]): r["top"] for r in stats.collect()}
        assert all(r["top"] == want[r["g"]] for r in out.collect())
        assert out.columns == [*df.columns, "top"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_prefix_sums_of_a_hot_group_run_in_ranges(spark):
    df = _hot(spark, 8000)
    order = [F.col("score").desc(), F.col("item").asc()]
    got = ordered_prefix(df, "g", order, {"before": F.lit(1), "mass": F.col("score")})
    w = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("item", F.coalesce(F.sum(F.lit(1)).over(w), F.lit(0)).alias("b"), F.coalesce(F.sum("score").over(w), F.lit(0.0)).alias("m"))
    assert {(r["item"], r["before"], r["mass"]) for r in got.collect()} == {(r["item"], r["b"], r["m"]) for r in want.collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        most, every = _largest_task(ordered_prefix(df, "g", order, {"before": F.lit(1)}))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert every == 8000 and most < 0.4 * every  # (range, group) pairs dealt to eight tasks


@pytest.mark.parametrize("least", [100, 10_000])
def test_filters_do_not_depend_on_salting(spark, monkeypatch, least):
    monkeypatch.setattr(scored, "LEAST_HEAVY", least)
    df = _hot(spark, 4000).withColumn("score", F.col("score") / 100)
    groups = {}
    for r in df.collect():
        groups.setdefault(r["g"], []).append((r["score"], r["item"]))
    kth = {g: sorted((s for s, _ in v), reverse=True)[min(5, len(v)) - 1] for g, v in groups.items()}
    top = {(g, i) for g, v in groups.items() for s, i in v if s >= kth[g]}
    assert {(r["g"], r["item"]) for r in top_k(df, "g", "item", "score", 5).collect()} == top
    soft = {(r["g"], r["item"]): r["prob"] for r in softmax_by(df, "g", "score").collect()}
    for g, v in groups.items():
        total = sum(np.exp(s - max(v)[0]) for s, _ in v)
        assert all(abs(soft[g, i] - np.exp(s - max(v)[0]) / total) < 1e-12 for s, i in v)
    kept = {(r["g"], r["item"]) for r in top_k_top_p(df, "g", "item", "score", top_p=0.4).collect()}
    for g, v in groups.items():
        mass, want = 0.0, set()
        for k, (s, i) in enumerate(sorted(v, key=lambda x: (-x[0], x[1]))):
            if k == 0 or mass <= 0.4:
                want.add((g, i))
            mass += soft[g, i]
        assert len({x for x in kept if x[0] == g} ^ want) <= 1  # the sum's last bit may move the edge
    ends = prefix_score(df, "g", ["item"], "score", F.col("item") % 1000 == 999)
    first = {g: min([i for _, i in v if i % 1000 == 999], default=None) for g, v in groups.items()}
    for r in ends.collect():
        want = [s for s, i in groups[r["g"]] if first[r["g"]] is None or i < first[r["g"]]]
        assert r["n_steps"] == len(want) and abs(r["seq_score"] - sum(want)) < 1e-6 and r["ended"] == (first[r["g"]] is not None)


def test_quartiles_of_very_many_values(spark):
    df = spark.range(300_000).select(F.when(F.col("id") % 10 == 0, "x").otherwise("y").alias("g"),
                                     (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 1024.0).alias("v"))
    rows = df.toPandas()
    got = {r["group"]: r for r in describe_ratings(df, "v", by="g").collect()}
    assert set(got) == {"x", "y", "all"}
    for g, v in (("x", rows[rows.g == "x"].v), ("y", rows[rows.g == "y"].v), ("all", rows.v)):
        assert np.allclose([got[g][k] for k in ("p25", "p50", "p75")], np.quantile(v, [0.25, 0.5, 0.75]), rtol=1e-12)
        assert got[g]["count"] == len(v)


def test_quartiles_of_small_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0), ("c", None), (None, 4.0)], "g string, v double")
    got = {r["group"]: (r["count"], r["p25"], r["p50"], r["max"]) for r in describe_ratings(df, "v", by="g").collect()}
    assert got == {"a": (1, 1.0, 1.0, 1.0), "b": (2, 1.25, 1.5, 2.0), "c": (0, None, None, None), None: (1, 4.0, 4.0, 4.0),
                   "all": (4, 1.0, 1.5, 4.0)}
    assert [r["count"] for r in describe_ratings(df, "v").collect()] == [4]
    table = {r["statistic"]: (r["b"], r["all"]) for r in rating_table(df, "v", "g", ["a", "b", "none"]).collect()}
    assert len(table) == 7 and table["p50"] == (1.5, 1.5) and table["max"] == (2.0, 4.0)


def test_a_row_that_only_the_last_candidate_suits(spark, monkeypatch):
    own, far = "the cat sat on the mat today", "colourless green ideas sleep furiously tonight"
    n = 1500
    pool = spark.range(n).select(F.col("id").alias("cand_id"))
    last = max(range(n), key=lambda i: (__import__("hashlib").md5(f"42:{i}".encode()).hexdigest()))
    pool = pool.select("cand_id", F.when(F.col("cand_id") == last, far).otherwise(own).alias("cand_text"))
    sizes, score = [], matching.flag_unrelated

    def spy(pairs, *args):
        sizes.append(pairs.groupBy("_k", "_sub").count().agg(F.max("count"), F.sum("count")).first())
        return score(pairs, *args)

    monkeypatch.setattr(matching, "flag_unrelated", spy)
    monkeypatch.setattr(matching, "SUB_WINDOW", 64)
    m = matching.match_unrelated(spark.createDataFrame([(1, own)], "row_id long, original string"), pool)
    assert [(r["row_id"], r["cand_id"]) for r in m.pairs.collect()] == [(1, last)]
    assert m.used.count() == n and max(s[0] for s in sizes) <= 64 and max(s[1] for s in sizes) > 400
    assert sum(r["rejected"] for r in m.stats.collect()) == n - 1


def test_overlap_counts_every_copy(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("abcdef")
    rows = [([word() for _ in range(rng.randrange(9))], [word() for _ in range(rng.randrange(9))]) for _ in range(200)]
    rows += [([], []), (["a"] * 5, ["a"] * 3), (["a"], ["b"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").coalesce(1)
    assert [r[0] for r in df.select(clipped_overlap("a", "b")).collect()] == [sum((Counter(a) & Counter(b)).values()) for a, b in rows]


def test_groups_stay_in_one_split(spark):
    rng = random.Random(3)
    rows = [(g, k) for g in [*range(60), None] for k in range(rng.randrange(1, 30))] + [(99, k) for k in range(200)]
    df = spark.createDataFrame(rows, "g long, k long").repartition(5)
    out = split3(df, ["g", "k"], group_key=["g"])
    assert out.columns == ["g", "k", "split"]
    found = {}
    for r in out.collect():
        found.setdefault(r["g"], Counter())[r["split"]] += 1
    assert all(len(c) == 1 for c in found.values()) and sum(sum(c.values()) for c in found.values()) == len(rows)
    sizes = sum(found.values(), Counter())
    n_test = -(-len(rows) * 3 // 10)
    assert abs(sizes["test"] - n_test) <= 100  # half of the largest group
    again = split3(df.repartition(2), ["g", "k"], group_key=["g"])
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, out.collect()))
    assert split3(df.limit(0), ["g", "k"], group_key=["g"]).count() == 0


def test_report_with_top_words_is_written(spark, tmp_path):
    rows = [("s", "x", "Rivers flow. Rivers run!"), ("s", "x", "rivers bend, boats float"), ("s", "y", "boats"), (None, "x", "the"), ("t", "x", None)]
    df = spark.createDataFrame(rows, "source string, side string, text string")
    tops = [(r["source"], r["side"], r["rank"], r["token"], r["freq"]) for r in top_words_by(df, "text", ["source", "side"], 2).collect()]
    assert sorted(tops, key=str) == sorted([("s", "x", 1, "rivers", 3), ("s", "x", 2, "bend", 1), ("s", "y", 1, "boats", 1)], key=str)
    report = corpus_report(df, "text", ["source", "side"], 2)
    write_report(report, f"{tmp_path}/report")
    back = {(r["source"], r["side"]): r for r in spark.read.schema(report.schema).json(f"{tmp_path}/report").collect()}
    assert len(back) == 4 and [tuple(w) for w in back["s", "x"]["top_words"]] == [("rivers", 3), ("bend", 1)]
    assert back[None, "x"]["top_words"] is None and back["s", "x"]["n_texts"] == 2


def test_empty_strings_and_nulls_are_told_apart(spark, tmp_path):
    rows = [(1, "", "x"), (2, None, ""), (3, " a\t", '"q"\nline'), (4, '""', None)]
    write_delimited(spark.createDataFrame(rows, "k long, a string, b string"), f"{tmp_path}/t")
    back = read_delimited(spark, f"{tmp_path}/t", schema="k long, a string, b string", sep="\t")
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_only_wanted_ngrams_are_counted(spark):
    gen = spark.createDataFrame([(1, "a b c".split()), (2, "x b c".split()), (3, "q a b c".split())], "item_id long, t array<string>")
    src = spark.createDataFrame([("a b c d a b c e a b c d".split(),), ("b c d e f g".split(),), (None,)], "t array<string>")
    out = copied_followers(gen, ["item_id"], "t", src, "t", 3)
    assert sorted(map(tuple, out.collect())) == [(1, "d", 2), (1, "e", 1), (3, "d", 2), (3, "e", 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("Aggregate"):]  # below the count


def test_later_rounds_rank_only_what_is_open(spark, monkeypatch):
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(4))
    rows = spark.createDataFrame([(i, text()) for i in range(300)], "row_id long, original string").repartition(3)
    pool = spark.createDataFrame([(i, text()) for i in range(3000)], "cand_id long, cand_text string").repartition(3)
    ranked, rank = [], matching.with_global_rank

    def spy(df, *args, **kwargs):
        ranked.append(df.count())
        return rank(df, *args, **kwargs)

    monkeypatch.setattr(matching, "with_global_rank", spy)
    m = matching.match_unrelated(rows, pool)
    stats = m.stats.orderBy("round").collect()
    assert len(stats) > 2 and all(r["window"] == min(2 ** (r["round"] - 1), r["window"]) for r in stats)
    assert sum(r["accepted"] for r in stats) == m.pairs.select("cand_id").distinct().count() == 300
    assert sum(r["accepted"] + r["rejected"] for r in stats) == m.used.count() == m.used.distinct().count()
    assert max(ranked, default=0) < 300  # neither all rows nor the pool


def test_ids_that_repeat_are_done_once(spark):
    own, far = "the cat sat on the mat today", "colourless green ideas sleep furiously tonight"
    rows = spark.createDataFrame([(i // 2, own) for i in range(40)], "row_id long, original string")
    pool = spark.createDataFrame([(i // 2, far if rng % 3 else own) for i, rng in enumerate(range(400))], "cand_id long, cand_text string")
    m = matching.match_unrelated(rows, pool)  # ended never while a copy of a matched row was still counted as open
    assert {r["row_id"] for r in m.pairs.collect()} == set(range(20)) and m.unmatched.count() == 0


def test_excluded_candidates_are_not_met(spark):
    rows = spark.createDataFrame([(i, "one two three four") for i in range(30)], "row_id long, original string")
    pool = spark.createDataFrame([(i, f"five six seven {i}") for i in range(100)], "cand_id long, cand_text string")
    used = spark.createDataFrame([(i,) for i in range(0, 100, 2)], "cand_id long")
    for down in (False, True):
        got = {r["row_id"]: r["cand_id"] for r in matching.match_unrelated(rows, pool, descending=down, exclude=used).pairs.collect()}
        want = {r["row_id"]: r["cand_id"] for r in matching.match_unrelated(
            rows, pool.join(used, "cand_id", "left_anti"), descending=down).pairs.collect()}
        assert got == want and len(got) == 30 and not {c for c in got.values() if c % 2 == 0}
