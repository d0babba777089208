"""Personal data by weak supervision (DataFrame functions only on the main path).

Four base kinds (email, ip, card, phone) are found by pattern and test; their spans always stay.  Further
candidates come from looser patterns.  Labelers - pattern, test, gazetteer, context before, context after -
vote for (1), against (-1) or abstain (0) on every candidate.  One aggregate over all documents counts the
votes together with the candidates' features; from that table (its size is bounded by the few values of
each column) expectation-maximisation estimates how reliable each labeler is, and its posteriors train the
final span classifier, naive Bayes on the features.  Loose candidates that it takes become spans of their own kind, after
the base kinds, unless they overlap a base span; matches that failed a base kind's test only train it.

Places are code points, end exclusive: a text is split at the matches of a pattern and the lengths of the
pieces add up.  Patterns are possessive and start at the first character of a run, so they neither
backtrack nor recurse on long texts, and they match what the plain patterns of the contract match.

Defined cases: a null text is empty and has no spans (the hash of an empty string); repeated rows give
repeated results; an empty table gives an empty result (and an untrained model that takes nothing); extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import id_text
from pairlab.session import materialize

#: Base kinds in order.  `(?<!X)|\G` starts a match at the head of a run or where the last one ended.
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": r"(?:(?<!" + _LOCAL + r")|\G)" + _LOCAL + r"++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?=(?:[0-9][\x20-]?){12}[0-9])[0-9]++(?:[\x20-][0-9]++)*+",  # runs of under 13 digits never pass
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a match to be possible.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
#: Looser kinds that the method may add, in order after the base kinds.
LOOSE = {
    "email_written": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]++"
                     r"(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[A-Za-z0-9-]++)++",
    "phone_local": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
LOOSE_NEEDS = {"email_written": r"(?i)[(\[]at[)\]]", "phone_local": r"[0-9]{3}[ .-][0-9]{4}",
               "national_id": r"[0-9]-[0-9]{2}-[0-9]", "iban": r"[A-Z]{2}[0-9]{2}"}
KINDS = [*BASE, *LOOSE]
#: Gazetteers, in alphabetical order.
TOP_DOMAINS = "at br ca ch cn co com de edu es eu fr gov info io it jp net nl org pl pt ru se uk us".split()
CONTEXT = {
    "email": "contact email e-mail mail write", "ip": "address addr client host ip server",
    "card": "account card credit debit mastercard payment visa",
    "phone": "call cell contact fax mobile phone tel telephone", "email_written": "contact email e-mail mail write",
    "phone_local": "call cell contact fax mobile phone tel telephone",
    "national_id": "id number security social ssn", "iban": "account bank iban transfer",
}
AGAINST = "article chapter isbn issn order page release section total version"
IBAN_COUNTRIES = "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MT NL NO PL PT RO SE SI SK".split()
CONTEXT_CHARS = 32
RUN = 128
LABELERS = ("pattern", "test", "gazetteer", "before", "after")
FEATURES = ("kind", "length", "digits", "left", "right", "near")
ROUNDS, SMOOTH, THRESHOLD = 30, 1.0, 0.5
_FOUND = "array<struct<kind:string,s:bigint,e:bigint,m:string,l:string,r:string>>"


def _matches(kind: str, pattern: str, need: str) -> Column:
    """array<(kind, start, end, match, text before, text after)> of all matches of a pattern."""
    text = F.col("text")
    none = F.expr(f"cast(array() as {_FOUND})")
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["all"], F.array(F.struct(
            F.lit(kind).alias("kind"), start.alias("s"), end.alias("e"), x["m"].alias("m"),
            F.right(x["p"], F.lit(CONTEXT_CHARS)).alias("l"), F.left(x["n"], F.lit(CONTEXT_CHARS)).alias("r")))
            .cast(_FOUND)).alias("all"))

    def shifted(part: Column, by: Column) -> Column:
        return F.transform(part["all"], lambda c: c.withField("s", c["s"] + by).withField("e", c["e"] + by))

    def placed(v: Column) -> Column:
        """Running sums within runs of RUN matches, then over the runs: linear for any number of matches."""
        start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("all"))
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v["hits"]) - 1) / RUN).cast("int")), lambda k: F.aggregate(
            F.slice(v["each"], k * RUN + 1, F.lit(RUN)), start, add))
        return runs

    def located(v: Column) -> Column:
        first = F.array(F.lit(0).cast("long"))
        offsets = F.aggregate(v, first, lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + r["at"])))
        return F.flatten(F.zip_with(v, F.slice(offsets, F.lit(1), F.size(v)), shifted))

    joined = lambda v: F.struct(v["hits"].alias("hits"), F.transform(v["hits"], lambda m, i: F.struct(
        m.alias("m"), F.get(v["pieces"], i).alias("p"), F.get(v["pieces"], i + 1).alias("n"))).alias("each"))
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    both = F.struct(pieces.alias("pieces"), hits.alias("hits"))
    found = let(let(both, joined), lambda v: F.when(F.size(v["hits"]) > 0, let(placed(v), located)).otherwise(none))
    return F.when(text.rlike(need), found).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, F.lit("[^0-9]"), F.lit(""))


def _valid(kind: str, m: Column) -> Column:
    """The test of a base kind."""
    n = F.length(_digits(m))
    if kind == "ip":
        part = r"0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return m.rlike(rf"\A{part}\.{part}\.{part}\.{part}\z")
    if kind == "card":
        return n.between(13, 19) & F.call_function("luhn_check", F.when(n.between(13, 19), _digits(m)).otherwise(F.lit("1")))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _tests(c: Column) -> dict[str, Column]:
    """The labelers' votes on a candidate."""
    kind, m = c["kind"], c["m"]
    n = F.length(_digits(m))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    top = F.lower(F.regexp_extract(m, r"([A-Za-z]+)[^A-Za-z]*\z", 1))
    mail = kind.isin("email", "email_written")
    left, right = F.lower(c["l"]), F.lower(c["r"])
    near = F.lit(False)
    for k in KINDS:
        near = near | ((kind == k) & left.rlike(r"\b(?:" + "|".join(CONTEXT[k].split()) + r")\b"))
    runs_on = c["l"].rlike(r"[A-Za-z0-9]\z") | c["r"].rlike(r"\A[A-Za-z0-9]")
    valid = F.lit(True)
    for k in BASE:
        valid = valid & ((kind != k) | _valid(k, m))
    return {
        "pattern": vote(F.when(mail, m.rlike(r"[@(\[]")).otherwise(n >= 7) & ~runs_on, runs_on),
        "test": vote(kind.isin(*BASE) & valid, kind.isin(*BASE) & ~valid),
        "gazetteer": vote(F.when(mail, top.isin(TOP_DOMAINS)).when(kind == "iban", F.substring(m, 1, 2).isin(IBAN_COUNTRIES))
                          .otherwise(F.lit(False)), F.when(mail, ~top.isin(TOP_DOMAINS)).when(
                              kind == "iban", ~F.substring(m, 1, 2).isin(IBAN_COUNTRIES)).otherwise(F.lit(False))),
        "before": vote(near, left.rlike(r"\b(?:" + "|".join(AGAINST.split()) + r")\b")),
        "after": vote(right.rlike(r"\A(?:[\s,;:)>.\"']|\z)"), right.rlike(r"\A[A-Za-z0-9@%=/_]")),
    }


def _features(c: Column) -> dict[str, Column]:
    """The classifier's features: few values each."""
    side = lambda t, at: F.when(t.rlike(at.format("[0-9]")), "d").when(t.rlike(at.format("[A-Za-z]")), "a").when(
        t.rlike(at.format(r"\s")), "s").when(t == "", "-").otherwise("p")
    n = F.greatest(F.length(c["m"]), F.lit(1))
    return {
        "kind": c["kind"], "length": F.least(F.floor(F.log2(n.cast("double"))), F.lit(6)).cast("string"),
        "digits": F.floor(4 * F.length(_digits(c["m"])) / n).cast("string"),
        "left": side(c["l"], r"{}\z"), "right": side(c["r"], r"\A{}"),
        "near": F.when(F.lower(c["l"]).rlike(r"[:=]\s*\z"), "mark").otherwise("none"),
    }


def candidates(docs: DataFrame) -> DataFrame:
    """One row per document: its base spans and its other candidates with votes and features."""
    rows = id_text(docs)
    for kind in KINDS:
        pattern, need = (BASE[kind], NEEDS[kind]) if kind in BASE else (LOOSE[kind], LOOSE_NEEDS[kind])
        rows = rows.withColumn(f"_{kind}", _matches(kind, pattern, need))
    passes = lambda k: lambda c: _valid(k, c["m"])
    fails = lambda k: lambda c: ~_valid(k, c["m"]) & (F.length(_digits(c["m"])) >= 7)
    good = [F.filter(f"_{k}", passes(k)) for k in BASE]
    failed = [F.filter(f"_{k}", fails(k)) for k in ("ip", "card", "phone")]
    rows = rows.select("doc_id", F.concat(*good).alias("base"), F.concat(*failed).alias("_failed"),
                       *[f"_{k}" for k in LOOSE])
    clear = lambda c: ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
    described = lambda c: F.struct(
        c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"),
        F.struct(*[v.cast("int").alias(k) for k, v in _tests(c).items()]).alias("votes"),
        F.struct(*[v.alias(k) for k, v in _features(c).items()]).alias("features"))
    loose = F.filter(F.concat(*[f"_{k}" for k in LOOSE], "_failed"), clear)
    return rows.select("doc_id", F.transform("base", described).alias("base"),
                       F.transform(loose, described).alias("loose"))


def estimate(counts: list[tuple[tuple[int, ...], tuple[str, ...], int]]) -> dict:
    """EM over (votes, features, rows), then naive Bayes on its posteriors.  Returns log-odds:
    ("", prior) and (feature, value) -> weight; and the labelers' reliabilities."""
    patterns: dict[tuple[int, ...], int] = defaultdict(int)
    for votes, _, n in counts:
        patterns[votes] += n
    accuracy, prior = [0.8] * len(LABELERS), 0.5

    def posterior(votes: tuple[int, ...]) -> float:
        odds = math.log(prior / (1 - prior))
        for a, v in zip(accuracy, votes):
            odds += v * math.log(a / (1 - a))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))

    total = sum(patterns.values())
    for _ in range(ROUNDS if total else 0):
        post = {v: posterior(v) for v in patterns}
        prior = min(0.95, max(0.05, sum(post[v] * n for v, n in patterns.items()) / total))
        for k in range(len(LABELERS)):
            right = sum(n * (post[v] if v[k] > 0 else 1 - post[v]) for v, n in patterns.items() if v[k])
            cast = sum(n for v, n in patterns.items() if v[k])
            accuracy[k] = min(0.99, max(0.55, (right + 4 * SMOOTH) / (cast + 5 * SMOOTH)))  # labelers beat chance
    yes: dict = defaultdict(float)
    no: dict = defaultdict(float)
    values: dict[str, set] = defaultdict(set)
    all_yes = all_no = SMOOTH
    for votes, features, n in counts:
        p = posterior(votes)
        all_yes, all_no = all_yes + p * n, all_no + (1 - p) * n
        for f, v in zip(FEATURES, features):
            yes[f, v] += p * n
            no[f, v] += (1 - p) * n
            values[f].add(v)
    weights = {("", "prior"): math.log(all_yes / all_no) if total else -30.0}
    for f, vs in values.items():
        for v in vs:
            weights[f, v] = math.log((yes[f, v] + SMOOTH) / (all_yes + SMOOTH * len(vs))) - math.log(
                (no[f, v] + SMOOTH) / (all_no + SMOOTH * len(vs)))
    return {"weights": weights, "accuracy": dict(zip(LABELERS, accuracy)), "prior": prior}


def train(found: DataFrame) -> dict:
    """The model from the candidates of all documents (one aggregate of bounded size)."""
    each = found.select(F.explode(F.concat("base", "loose")).alias("c"))
    keys = [F.col(f"c.votes.{k}").alias(f"v_{k}") for k in LABELERS] + [
        F.col(f"c.features.{k}").alias(f"f_{k}") for k in FEATURES]
    rows = each.groupBy(*keys).count().collect()
    counts = [(tuple(r[f"v_{k}"] for k in LABELERS), tuple(r[f"f_{k}"] for k in FEATURES), r["count"]) for r in rows]
    return estimate(sorted(counts, key=str))


def _odds(c: Column, weights: dict) -> Column:
    score = F.lit(weights["", "prior"])
    for f in FEATURES:
        value = F.lit(0.0)
        for (name, v), w in sorted(weights.items(), key=str):
            if name == f:
                value = F.when(c["features"][f] == v, F.lit(w)).otherwise(value)
        score = score + value
    return score


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["s"], c["e"])), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base and added),
    n_added."""
    found = materialize(candidates(docs), "pii-candidates")
    weights = train(found)["weights"]
    limit = math.log(THRESHOLD / (1 - THRESHOLD))
    of = lambda k: lambda c: c["kind"] == k
    base = [F.filter("base", of(k)) for k in BASE]  # in order of place already
    added = F.filter("loose", lambda c: c["kind"].isin(*LOOSE) & (_odds(c, weights) > limit))
    order = F.create_map(*[F.lit(x) for k, v in enumerate(KINDS) for x in (v, k)])
    added = F.array_sort(added, lambda a, b: F.when(
        order[a["kind"]] != order[b["kind"]], order[a["kind"]] - order[b["kind"]]).otherwise(
        (a["s"] - b["s"]).cast("int")))
    rows = found.select("doc_id", *[c.alias(f"_{k}") for k, c in zip(BASE, base)], added.alias("_added"))
    rows = rows.withColumn("_base", F.concat(*[f"_{k}" for k in BASE])).withColumn("_text", _joined(F.col("_base")))
    every = F.concat("_base", "_added")
    return rows.select("doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE],
                       F.sha2("_text", 256).alias("base_sha256"), _joined(every).alias("spans"),
                       F.size("_added").cast("long").alias("n_added"))
