"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Targets: the mix has ``budget`` times all words; sources, by code point with null last, weigh ``weights``
in turn; a target stops at ``cap`` times its source's words and the excess is shared again by weight.
A document of a source is due target / source words copies: the whole part is given, the fraction is
rounded so that the source's words stay as they are.  Two fractions are paired: words move from one to the
other, in a random direction that keeps each expectation, until one of them is 0 or 1; the other one is
paired with the next.  Buckets of about ``fan`` documents each leave one fraction; those meet in buckets
again, a reduction tree whose levels are written to the shared folder.  The fraction left at the root of a
source is rounded at random, or (``cut_last``) taken as that part of one document's words, which makes the
source's words exact.  Randomness is a hash of seed and rows, so reruns agree.

Rows with equal (doc_id, source, size) are one unit with a count: all but one are settled at once.
Defined cases: a null text has size 0; a null source is a source of its own; a null doc_id is a key like
any other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.common import WORD_RE
from pairlab.operators.ranking import with_global_rank
from pairlab.session import materialize

#: Fixed values.
WEIGHTS, BUDGET, CAP, SEED, FAN = (5, 2, 1), 1.5, 2.0, 42, 64
_UNIT = "struct<h:bigint,doc_id:bigint,size:bigint,m:bigint,full:bigint,p:double>"


def _words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        _words("text").alias("size"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """(source, source_size, source_docs, target); one row per source."""
    per = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size"),
                                                  F.count(F.lit(1)).alias("source_docs")), "mix-sources")
    first = F.when(F.col("source").isNull(), "~").otherwise(F.hex(F.substring(F.encode("source", "UTF-8"), 1, 2)))
    order = [F.col("source").isNull(), F.col("source")]
    ranked = with_global_rank(per.withColumn("_first", first), order, "_rank", bucket=F.col("_first"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = materialize(ranked.select("source", "source_size", "source_docs", weight.alias("weight"),
                                      (F.col("source_size") * float(cap)).alias("most")), "mix-weights")
    total = table.agg((F.sum("source_size") * float(budget)).alias("t"), F.sum("weight").alias("w")).first()
    share, before = (total["t"] / total["w"] if total["w"] else 0.0), -1
    while True:  # each turn caps at least one more source
        over = F.col("weight") * F.lit(share) > F.col("most")
        now = table.agg(F.coalesce(F.sum(over.cast("long")), F.lit(0)).alias("n"),
                        F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)).alias("capped"),
                        F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("w")).first()
        if now["n"] == before or not now["w"]:
            break
        before, share = now["n"], (total["t"] - now["capped"]) / now["w"]
    return table.select("source", "source_size", "source_docs",
                        F.least(F.col("weight") * F.lit(share), F.col("most")).alias("target"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _uniform(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _pair(acc: Column, x: Column, seed: int, level: int) -> Column:
    """Moves words between the waiting unit and the next one until one of them is settled."""

    def moved(v: Column) -> Column:
        i, j, a, b = v["i"], v["j"], v["a"], v["b"]
        one = F.greatest(F.lit(1), i["size"]).cast("double")
        two = F.greatest(F.lit(1), j["size"]).cast("double")
        up = _uniform(i["h"], j["h"], F.lit(seed), F.lit(level)) * (a + b) < b
        room_i, room_j = i["size"] * (1 - i["p"]), j["size"] * (1 - j["p"])
        mass_i, mass_j = i["size"] * i["p"], j["size"] * j["p"]
        clamp = lambda p: F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))
        p_i = F.when(up, F.when(room_i <= mass_j, 1.0).otherwise(clamp(i["p"] + a / one))).otherwise(
            F.when(mass_i <= room_j, 0.0).otherwise(clamp(i["p"] - b / one)))
        p_j = F.when(up, F.when(room_i <= mass_j, clamp(j["p"] - a / two)).otherwise(0.0)).otherwise(
            F.when(mass_i <= room_j, clamp(j["p"] + b / two)).otherwise(1.0))
        first = F.when(up, room_i <= mass_j).otherwise(mass_i <= room_j)
        return F.struct(i.withField("p", p_i).alias("i"), j.withField("p", p_j).alias("j"), first.alias("first"))

    def kept(v: Column) -> Column:
        return F.struct(F.when(v["first"], v["j"]).otherwise(v["i"]).cast(_UNIT).alias("wait"),
                        F.concat(acc["done"], F.array(F.when(v["first"], v["i"]).otherwise(v["j"]).cast(_UNIT)))
                        .alias("done"))

    i, j = acc["wait"], x
    gain = F.least(i["size"] * (1 - i["p"]), j["size"] * j["p"])
    loss = F.least(i["size"] * i["p"], j["size"] * (1 - j["p"]))
    return _let(_let(F.struct(i.alias("i"), j.alias("j"), gain.alias("a"), loss.alias("b")), moved), kept)


def _level(units: DataFrame, seed: int, level: int) -> DataFrame:
    """One row per (source, bucket): the units settled there and the one that waits."""
    found = units.groupBy("source", "source_size", "target", "bucket", "buckets").agg(
        F.array_sort(F.collect_list(F.col("unit").cast(_UNIT))).alias("all"))
    start = F.struct(F.element_at("all", 1).alias("wait"), F.expr(f"cast(array() as array<{_UNIT}>)").alias("done"))
    rest = F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0)))
    return found.select("source", "source_size", "target", "bucket", "buckets",
                        F.aggregate(rest, start, lambda acc, x: _pair(acc, x, seed, level)).alias("r"))


def _units(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: int = SEED,
        fan: int = FAN, cut_last: bool = False) -> DataFrame:
    """One row per (doc_id, source, size), with the m rows that share them: each is taken ``base`` times, the first
    ``full`` once more, and the one after them ``last`` times more."""
    sizes = materialize(sized(docs), "mix-sizes")
    targets = source_targets(sizes, weights, budget, cap)
    units = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m"))
    t = targets.withColumnRenamed("source", "_s")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = units.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s") \
        .withColumn("part", due - F.floor(due)).withColumn("mass", F.col("m") * F.col("part")) \
        .withColumn("buckets", F.ceil(F.col("source_docs") / fan)) \
        .withColumn("h", F.xxhash64("doc_id", "size", F.lit(seed)))
    open_ = rows.select(
        "source", "source_size", "target", "buckets", F.pmod("h", "buckets").alias("bucket"),
        F.struct("h", "doc_id", "size", "m", F.floor("mass").alias("full"),
                 (F.col("mass") - F.floor("mass")).alias("p")).cast(_UNIT).alias("unit"))
    keys = ["source", "source_size", "target"]
    settled, level = [], 0
    while True:
        done = materialize(_level(open_, seed, level), f"mix-level{level}")
        settled.append(done.select(*keys, F.explode("r.done").alias("u")))
        more = done.filter("buckets > 1").limit(1).count()
        settled.append(done.filter("buckets = 1").select(*keys, F.col("r.wait").alias("u")))
        if not more:
            break
        open_ = done.filter("buckets > 1").select(
            *keys, F.ceil(F.col("buckets") / fan).alias("buckets"),
            F.floor(F.col("bucket") / fan).alias("bucket"), F.col("r.wait").alias("unit"))
        level += 1
    every = settled[0]
    for more in settled[1:]:
        every = every.unionByName(more)
    base = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    last = F.col("u.p") if cut_last else (_uniform(F.col("u.h"), F.lit(seed), F.lit(-1)) < F.col("u.p")).cast("double")
    return every.select(F.col("u.doc_id").alias("doc_id"), "source", F.col("u.size").alias("size"), "source_size", "target",
                        F.col("u.m").alias("m"), F.col("u.full").alias("full"), base.alias("base"), last.alias("last"))


def _copies() -> Column:
    """How often the mix takes the k-th of the m rows of a unit."""
    return F.col("base") + F.when(F.col("k") <= F.col("full"), 1.0).when(F.col("k") == F.col("full") + 1, F.col("last")).otherwise(0.0)


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: int = SEED,
        fan: int = FAN, cut_last: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (a fraction only for the
    last document of a source under ``cut_last``) and taken = the words the mix takes of it."""
    rows = _units(docs, weights, budget, cap, seed, fan, cut_last).withColumn(
        "k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return rows.select("doc_id", "source", "size", "source_size", "target", _copies().alias("copies")).withColumn(
        "taken", F.least(F.round(F.col("copies") * F.col("size")), F.col("size") * 2.0).cast("long"))


def mixed_documents(docs: DataFrame, **choices) -> DataFrame:
    """The documents of the mix, each as often as it is taken (whole copies), all columns as they were.
    The caller's row travels as one struct and is shuffled once, by (doc_id, source, size); of the rows that share
    these, and only of them, the texts are compared to number them."""
    picks = materialize(_units(docs, **choices).select(
        F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("no_i"),
        F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("no_s"),
        F.col("size").alias("z"), "m", "full", "base", "last").filter(
        (F.col("base") >= 1) | (F.col("full") >= 1) | (F.col("base") + F.col("last") >= 1)), "mix-picks")
    key = ["i", "no_i", "s", "no_s", "z"]
    doc_id, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    rows = docs.select(
        F.coalesce(doc_id, F.lit(0)).alias("i"), doc_id.isNull().alias("no_i"), F.coalesce(source, F.lit("")).alias("s"),
        source.isNull().alias("no_s"), _words("text").alias("z"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = Window.partitionBy(*key).orderBy(F.when(F.col("m") > 1, F.col("row.text")))
    taken = rows.join(picks, key).withColumn("k", F.row_number().over(same).cast("long")) \
        .select("row", _copies().cast("int").alias("copies")).filter("copies >= 1")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
