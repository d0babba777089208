"""Quality rules, the classifier, fingerprints, packing, mixing and the pipeline."""

import hashlib
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pytest
from llm_paths import SF
from messy_table import messy_rows, rows_of

import corpus_pipeline
from pairlab.llm import queries
from pairlab.llm.fingerprints import (ANCHORS, K, S, _chain_by_bits, _chain_by_pairs, anchors_of, closed_syncmers,
                                      edited_fingerprints, fingerprint, fingerprints, likeness, longest_chain, unpacked)
from pairlab.llm.mixing import mix, mixed_documents, sized, source_targets
from pairlab.llm.packing import Encoder, best_cuts, pack
from pairlab.llm.quality_model import NAMES, fit, score_quality, statistics
from pairlab.llm.quality_rules import RULES, Text, quality_filter, quality_measures, rule_order

TOKENIZER = corpus_pipeline.TOKENIZER


# ---- quality rules -----------------------------------------------------------------

def test_measures_of_messy_texts(spark, messy, empty):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
                  for r in quality_measures(messy).collect())
    assert got == Counter((i, *brute.quality(t)) for i, t in rows_of())
    assert quality_measures(empty).count() == 0 and quality_filter(empty).count() == 0


def test_the_cascade_is_the_conjunction_of_its_rules_in_any_order(spark, messy, small_docs):
    keep = Counter(i for i, t in rows_of() if all(passes(Text(t)) for passes in RULES.values()))
    kept = quality_filter(messy)
    assert kept.columns == messy.columns and Counter(r["doc_id"] for r in kept.collect()) == keep
    slow = {"cheap": lambda t: len(t.text) > 400, "dear": lambda t: sum(range(40_000)) > 0 and len(t.text) > 400,
            "never": lambda t: True}
    assert rule_order(small_docs, slow)[0] == "cheap" and rule_order(small_docs, slow)[-1] == "never"


def test_quality_oracle_sql(spark):
    got = queries.QUERIES["op10_quality_rules"](spark, SF)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = db.execute(queries.oracle_sql()["op10_quality_rules"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())


# ---- classifier --------------------------------------------------------------------

def test_the_classifier_separates_held_out_documents(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = score_quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.9 * len(held)
    assert all(r["predicted"] for r in held if r["quality"] == 1)


def test_scores_of_messy_texts_and_without_labels(spark, messy, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (14, None), (None, 1)], "doc_id long, quality int")
    rows = score_quality(messy, labels).collect()
    assert len(rows) == len(rows_of()) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1  # equal texts, equal scores
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert len({r["score"] for r in score_quality(messy, none).collect()}) == 1
    assert score_quality(empty, none).count() == 0


def test_the_risk_learns_from_positives_and_a_mixture():
    rng = np.random.default_rng(0)
    good = lambda n: rng.normal(1, 1, (n, len(NAMES)))
    bad = lambda n: rng.normal(-1, 1, (n, len(NAMES)))
    model = fit(good(600), np.concatenate([good(700), bad(300)]), 0.7)
    assert (model.scores(good(300)) >= 0.5).mean() > 0.95 and (model.scores(bad(300)) < 0.5).mean() > 0.95
    assert statistics("") == [0.0] * len(NAMES)


# ---- fingerprints ------------------------------------------------------------------

def test_syncmers_are_those_of_the_definition_and_of_the_context():
    rng = np.random.default_rng(8)
    text = "".join(rng.choice(list("abcdef é\U0001F600"), 600))
    _, at = closed_syncmers(text)
    left, right = "".join(rng.choice(list("xyz"), 57)), "".join(rng.choice(list("xyz"), 33))
    hashes, moved = closed_syncmers(left + text + right)
    inner = moved[(moved >= 57) & (moved <= 57 + 600 - K)] - 57
    assert (inner == at).all() and 0 < len(at) < 600
    own, _ = closed_syncmers(text[int(at[3]):int(at[3]) + K])
    assert len(own) == 1 and own[0] in hashes and K > S


def test_fingerprints_of_edited_texts(spark, messy, empty):
    rows = sorted(((r[0] if r[0] is not None else -(1 << 63), r[1] or "", r[0]) for r in messy_rows()), key=lambda r: r[:2])
    want = Counter()
    for k, (_, text, doc_id) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        want[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(),
             round(likeness(anchors_of(text), anchors_of(edited)), 9), round(likeness(anchors_of(text), anchors_of(after)), 9)] += 1
    got = edited_fingerprints(messy).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9))
                   for r in got) == want
    by_text = {r["fingerprint"] for r in got if r["doc_id"] in (1, 2)}
    assert len(by_text) == 1 and edited_fingerprints(empty).count() == 0
    assert fingerprints(messy).count() == len(rows)


def test_likeness_follows_the_share_in_common():
    rng = np.random.default_rng(9)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    a, b = words(800), words(800)
    half = a[:2800] + b[2800:]
    assert likeness(anchors_of(a), anchors_of(a)) == 1 and likeness(anchors_of(a), anchors_of(b)) < 0.05
    assert abs(likeness(anchors_of(a), anchors_of(half)) - 0.5) < 0.15 and len(anchors_of(a)) <= ANCHORS
    assert likeness([], []) == 1 and likeness([], anchors_of(a)) == 0


def test_a_short_passage_shared_by_long_texts_is_found():
    rng = np.random.default_rng(10)
    text = lambda n: "".join(rng.choice(list("abcdefghij klmnop"), n))
    passage = text(300)
    a, b = text(90_000) + passage + text(60_000), text(30_000) + passage + text(120_000)
    assert likeness(anchors_of(a), anchors_of(b)) > 0 and len(anchors_of(a)) > 0.14 * len(a)
    assert (unpacked(fingerprint(a)) == anchors_of(a)).all() and fingerprint("") == ""
    for k in range(0, len(a) - K, 997):
        assert set(closed_syncmers(a[k:k + 400])[0]) <= set(anchors_of(a)[:, 0])


def test_short_texts_have_an_anchor():
    rng = np.random.default_rng(13)
    for n in range(1, 40):
        texts = {"".join(rng.choice(list("abcdefghij klmnop"), n)) for _ in range(30)}
        found = [anchors_of(t) for t in texts]
        assert all(len(f) for f in found) and all(likeness(f, anchors_of("")) == 0 for f in found)
        if n >= 20:
            assert all(likeness(f, g) < 1 for k, f in enumerate(found) for g in found[:k])


def test_chains_are_the_longest_common_subsequences():
    rng = np.random.default_rng(12)

    def brute_chain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for k, y in enumerate(b, 1):
                before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
        return row[-1]

    for n in range(120):
        a, b = (rng.integers(0, int(rng.integers(1, 12)), int(rng.integers(0, 40))) for _ in range(2))
        want = brute_chain(a.tolist(), b.tolist())
        assert longest_chain(a, b) == want == _chain_by_pairs(a.tolist(), b.tolist())
        assert _chain_by_bits(a.tolist(), b.tolist(), 7) == want
    assert likeness(anchors_of(" " * 3000 + "x" + "-" * 3000), anchors_of(" " * 4000 + "-" * 2000)) > 0.7


# ---- packing -----------------------------------------------------------------------

def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(6)
    for _ in range(40):
        places = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, 7, 9))]))
        pen = rng.integers(0, 4, len(places))
        cost = lambda cuts: sum(pen[j] + (0 if n & (n - 1) == 0 else 8 - n) for i, j in zip([0, *cuts], cuts)
                                for n in [int(places[j] - places[i])])
        ways = [[]]
        done = []
        while ways:
            w = ways.pop()
            i = w[-1] if w else 0
            if i == len(places) - 1:
                done.append(w)
            ways += [[*w, j] for j in range(i + 1, len(places)) if places[j] - places[i] <= 8]
        assert cost(best_cuts(places, pen, 8)) == min(map(cost, done))


@pytest.mark.parametrize("block", [1 << 18, 600])
def test_pieces_hold_every_id_once(spark, messy, small_docs, empty, block):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER.replace(".tiktoken", ".json"))
    tok.encode_special_tokens = True
    docs = messy.select("doc_id", "text").union(small_docs.selectExpr("doc_id + 1000 AS doc_id", "text"))
    rows = pack(docs, TOKENIZER, block_tokens=block).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d in docs.collect():
        if d["doc_id"] in (2, 16):  # repeated ids: counted below
            continue
        ids = np.array([*tok.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for start, length, crc in sorted(pieces[d["doc_id"], len(ids)]):
            assert start == at and crc == zlib.crc32(ids[start:start + length].tobytes())
            at += length
        assert at == len(ids)
    assert len({k for k in pieces if k[0] == 16}) == 2 and sum(s == 0 for s, _, _ in pieces[2, pieces_tokens(pieces, 2)]) == 2
    padding = tokens = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        padding, tokens = padding + (0 if at & (at - 1) == 0 else 1024 - at), tokens + at
    assert padding < 0.05 * tokens or block == 600
    assert pack(empty, TOKENIZER).count() == 0


def pieces_tokens(pieces, doc_id):
    return next(n for i, n in pieces if i == doc_id)


def test_both_tokenizer_files_give_the_same_ids(small_rows):
    a, b = Encoder(TOKENIZER), Encoder(TOKENIZER.replace(".tiktoken", ".json"))
    texts = [t or "" for _, t in small_rows] + [t for _, t in rows_of() if len(t) < 5000] + ["<|endoftext|> x  \n\n y z"]
    assert all(list(a.encode(t)) == list(b.encode(t)) for t in texts)
    n = min(len(a.ends), len(b.ends))
    assert (a.ends[:n] == b.ends[:n]).all()


def test_added_tokens_inside_a_text_have_their_own_ids(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER.replace(".tiktoken", ".json"))  # as it is, no setting changed
    mark = "<|endoftext|>"
    texts = [mark, f"x {mark} y", f"{mark}{mark}\n\n {mark}. A b", f"<|endof{mark}text|>", f"a  {mark}  b", "<|endoftext|", f"é{mark}\n"]
    a, b = Encoder(TOKENIZER), Encoder(TOKENIZER.replace(".tiktoken", ".json"))
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(a.encode(t)) for t in texts] == want == [list(b.encode(t)) for t in texts] and 50256 in want[1]
    rows = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), TOKENIZER).collect()
    for r in rows:
        ids = np.array([*want[r["doc_id"]], 0], "<u4")
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())


# ---- mixing ------------------------------------------------------------------------

def _mixed(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_mix_meets_its_targets(spark, messy, empty):
    n = [(k, " ".join(["w"] * (k % 37 + 1)), f"s{k % 7}" if k % 50 else None) for k in range(900)]
    n += [(5000, "a b c", "hot")] * 300 + [(6000 + k, " ".join(["w"] * 5), "hot") for k in range(2000)]
    df = spark.createDataFrame(n, "doc_id long, text string, source string").repartition(5)
    rows = mix(df, cut_last=True, fan=16).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in n:
        sizes[s] += len(t.split())
    want = brute.targets(sizes)
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert len(rows) == len(n) and all(abs(taken[s] - t) <= 1 for s, t in want.items())
    again = mix(df.repartition(3), cut_last=True, fan=16).collect()
    assert _mixed(rows) == _mixed(again)
    whole = mix(df, fan=16).collect()
    assert all(r["copies"] == int(r["copies"]) and r["taken"] == r["copies"] * r["size"] for r in whole)
    for s, t in want.items():
        assert abs(sum(r["taken"] for r in whole if r["source"] == s) - t) <= 38
    assert mix(empty).count() == 0 and len(mix(messy).collect()) == len(rows_of())


def test_rounding_keeps_expectations(spark):
    n = [(k, " ".join(["w"] * (1 + k % 3)), s) for k in range(60) for s in ("a", "b")]
    df = spark.createDataFrame(n, "doc_id long, text string, source string")
    total = sum(np.array([r["copies"] for r in sorted(mix(df, budget=1.2, seed=seed).collect(), key=lambda r: (r["source"], r["doc_id"]))])
                for seed in range(4)) / 4
    assert abs(total[:60].mean() - 12 / 7) < 0.1 and abs(total[60:].mean() - 4.8 / 7) < 0.1 and total[60:].std() > 0.1


def test_mixed_documents_come_as_often_as_taken(spark, messy, empty):
    want = Counter()
    for r in mix(messy).collect():
        want[r["doc_id"], r["source"]] += int(r["copies"])
    rows = mixed_documents(messy)
    assert rows.columns == messy.columns
    assert Counter((r["doc_id"], r["source"]) for r in rows.collect()) == +want
    assert mixed_documents(empty).count() == 0 and source_targets(sized(empty)).count() == 0


def test_mixed_documents_shuffle_every_text_once(spark):
    rows = [(k, f"{'w ' * (k % 7 + 1)}{k}", "en", "ab"[k % 2], 9) for k in range(60)]
    rows += [(7, f"{c} w w", "en", "a", 9) for c in "edcba"]  # equal ids, sources and sizes: numbered by text
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mixed = mixed_documents(docs)
        plan = mixed._jdf.queryExecution().executedPlan().toString()
        got = Counter(r["text"] for r in mixed.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2  # the documents and what is taken; the documents went twice before
    assert got == Counter(r["text"] for r in mixed_documents(docs).collect())
    same = sorted((int(r["copies"]) for r in mix(docs).filter("doc_id = 7 AND size = 3").collect()), reverse=True)
    assert [got[f"{c} w w"] for c in "abcde"] == same


# ---- pipeline ----------------------------------------------------------------------

def test_pipeline_stages(spark, messy, empty, tmp_path):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and queries.QUERIES["pipeline"] is corpus_pipeline.run
    docs, last = messy, None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == messy.columns
        out.write.parquet(f"{tmp_path}/{k}")
        last, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
    assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in last.collect()}
    nothing = empty
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, SF)
    assert nothing.count() == 0


# ---- columns of the caller, long runs ------------------------------------------------

@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_the_callers_columns(spark, messy, name):
    """Helper names of the stages (_id, _k, row, gone ...) are ordinary columns of the caller."""
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, messy.filter("text IS NOT NULL"), "")
    assert out.columns == messy.columns
    given = [c for c in messy.columns if c.startswith("_") or c in ("row", "i", "key", "picks", "gone")]
    rows = out.collect()
    assert rows and all(r[c] == f"keep-{k}-{r['doc_id']}" for r in rows for k, c in enumerate(given))


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\u00a0"])
def test_long_runs_of_white_space_are_encoded_as_by_the_file(blank):
    from tokenizers import Tokenizer

    file = Tokenizer.from_file(TOKENIZER.removesuffix(".tiktoken") + ".json")
    enc = Encoder(TOKENIZER)
    for text in (blank * 1_000_000, "a " + blank * 1_000_000 + "word", blank * 49_999 + "x"):
        assert enc.encode(text) == file.encode(text, add_special_tokens=False).ids


def test_a_page_of_blanks_is_packed(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "one two")], "doc_id long, text string").coalesce(1)
    rows = pack(docs, TOKENIZER).collect()
    file = Encoder(TOKENIZER.removesuffix(".tiktoken") + ".json")
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == len(file.encode(" " * 1_000_000)) + 1
    assert all(0 <= r["offset"] and r["offset"] + r["length"] <= 1024 for r in rows)
