"""The joins of near duplicates (documents, lines) against brute force."""

from collections import Counter

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from messy_table import rows_of
from pyspark.sql import functions as F

from pairlab.llm import components as steps
from pairlab.llm import line_dedup, regions
from pairlab.llm.components import components, stars
from pairlab.llm.line_dedup import drop_duplicate_lines, edit_bounds, edit_distance, line_classes, places, segment
from pairlab.llm.ngram_join import Shingler, distance_bounds, ngram_components, one_of_each, set_distance, sketch
from pairlab.llm.regions import FILTER_BITS, _cell_by_cell, dense_parts, link_cells, maybe_wanted, meet, near_pairs, wanted_filter


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(k, k + 1) for k in range(9)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (500, 501), (501, 500)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(10), 0), **dict.fromkeys(range(100, 140), 100), 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_crowded_cells_are_linked_by_pivots(spark):
    rng = np.random.default_rng(5)  # points on a line; distance is their gap; one crowded cell
    points = np.unique(np.concatenate([rng.integers(0, 40, 24), rng.integers(5000, 5200, 10)]))
    members = spark.createDataFrame([(1, int(p), 1) for p in points], "cell long, x long, w long")
    payloads = members.select("x", F.col("x").cast("string").cast("binary").alias("p"))
    none = spark.createDataFrame([], "a long, b long")
    alone = members.select("x", F.col("x").alias("c"))
    links = _cell_by_cell(members, none, alone, payloads, lambda p, q: float(abs(int(p) - int(q))), 3.0, 4, 12, 8)
    got = {r["node"]: r["component"] for r in components(links).collect()}
    group = points[0]
    for prev, p in zip(points[:-1], points[1:]):
        group = group if p - prev <= 3 else p
        if p - prev <= 3:
            assert got[int(p)] == group


def test_a_star_block_links_as_all_links_do():
    items = [(k, 3, str(v).encode(), k) for k, v in enumerate([1, 9, 3, 5, 20, 22, 40])]
    far = lambda p, q: float(abs(int(p) - int(q)))
    assert {frozenset(x[:2]) for x in meet(items, True, far, 2.0)} == {frozenset(x) for x in ((0, 2), (2, 3), (4, 5))}
    near = meet([(1, 1, b"1", 1), (2, 2, b"4", 2), (3, 1, b"9", 3), (4, 1, b"4", 2)], False, far, 2.0)
    assert near == [(1, 2, 3.0)]


def test_the_filter_lets_every_wanted_item_through(spark):
    xs = [0, 1, -1, 32767, 32768, FILTER_BITS - 1, -(1 << 63), (1 << 63) - 1]
    bits = wanted_filter(spark.createDataFrame([(x,) for x in xs], "x long"))
    assert all(maybe_wanted(bits, x) for x in xs) and not maybe_wanted(bits, 12345)


def test_shingles_are_those_of_the_words():
    texts = ["a b c d e f", "A B c d e\tf", "a b c d", "", " ", "x" * 3_000_000 + " y", "a b c d e"]
    sets = Shingler().sets(texts)
    assert [len(s) for s in sets] == [len(brute.shingles(t)) for t in texts]
    assert (sets[0] == sets[1]).all() and sets[6][0] in sets[0] and sets[2][0] not in sets[0]


def _documents(rows):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)


def test_documents_of_a_messy_table(spark, messy, empty):
    assert _documents(ngram_components(messy).collect()) == brute.jaccard_rows(rows_of())
    assert ngram_components(empty).count() == 0


def test_documents_with_shared_passages_and_many_near_copies(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    passage = " ".join(word() for _ in range(60))
    base = [word() for _ in range(200)]
    rows = [(k, passage + " " + " ".join(word() for _ in range(40))) for k in range(60)]
    for k in range(60, 140):
        copy = list(base)
        for _ in range(int(rng.integers(0, 7))):
            copy[int(rng.integers(0, len(copy)))] = word()
        rows.append((k, " ".join(copy)))
    rows += [(200 + k, " ".join(base[:40 + k])) for k in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert _documents(ngram_components(df).collect()) == brute.jaccard_rows(rows)


def test_one_document_of_each_group_stays(spark, messy, empty):
    kept = one_of_each(messy)
    assert kept.columns == messy.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert [i for i in ids if i in (1, 2, 3)] == [1] and [i for i in ids if i in (7, 8)] == [7]
    assert ids.count(4) == 1 and ids.count(5) == 1 and ids.count(16) == 2
    assert one_of_each(empty).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=18), st.text("abcd", max_size=18), st.integers(0, 5))
def test_banded_edit_distance(a, b, most):
    assert edit_distance(a, b, most) == min(brute.edit(a, b), most + 1)


def test_segments_cover_a_line_and_keys_are_twelve():
    for n in (30, 31, 32, 100):
        at = 0
        for k in range(3):
            p, q = segment(n, k, 3)
            assert p == at
            at = p + q
        assert at == n
    assert len(places(2)) == 12


def _lines(df):
    return Counter((r["doc_id"], r["line_no"], (r["first_doc_id"], r["first_line_no"]), r["duplicate"]) for r in df.collect())


def test_lines_of_messy_and_edited_tables(spark, messy, empty):
    rows = rows_of()
    first = brute.line_firsts(rows, 2, 30)
    want = Counter()
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            if brute.WORD.search(line):
                want[i, k, first[i, k], first[i, k] != (i, k)] += 1
    assert _lines(line_classes(messy)) == want
    assert line_classes(empty).count() == 0


def test_edited_lines_against_brute_force(spark):
    rng = np.random.default_rng(11)
    stem = ["".join(rng.choice(list("abcd "), 60)).strip().ljust(58, "x") for _ in range(6)]
    rows = []
    for d in range(70):
        lines = []
        for _ in range(3):
            line = list(stem[int(rng.integers(0, 6))])
            for _ in range(int(rng.integers(0, 4))):
                at = int(rng.integers(0, len(line)))
                kind = int(rng.integers(0, 3))
                line[at:at + (kind != 0)] = ["z"] if kind != 1 else []
            lines.append("".join(line))
        rows.append((d, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = brute.line_firsts(rows, 2, 30)
    got = {(r["doc_id"], r["line_no"]): (r["first_doc_id"], r["first_line_no"]) for r in line_classes(df).collect()}
    assert got == first


def test_dropping_lines_keeps_clean_documents_and_columns(spark, messy, empty):
    kept = drop_duplicate_lines(messy)
    assert kept.schema.names == messy.schema.names
    by = {}
    for r in kept.collect():
        by.setdefault(r["doc_id"], []).append(r["text"])
    assert len(by[1]) == 1 and 2 not in by and by[4] == [None] and by[5] == [""]  # 2 repeats 1
    assert by[11] == ["short"]  # the other lines are those of 1, or one edit away
    assert by[12][0].startswith("w0x0 ") and drop_duplicate_lines(empty).count() == 0


def test_rows_without_an_id_or_with_equal_ids_lose_their_own_lines_only(spark):
    common = "a line that stands in several of the documents of this table"
    own = [f"line number {k} of its own, with words {'abcdefgh'[k] * 12} that no other document holds" for k in range(8)]
    rows = [(1, common), (None, own[0]), (None, f"{common}\n{own[1]}"), (None, own[2]), (None, common),
            (7, own[3]), (7, f"{common}\n{own[4]}"), (7, f"{own[5]}\n{common}"), (9, own[6]), (9, own[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in drop_duplicate_lines(df).collect())
    assert got == Counter([(1, common), *((None, own[k]) for k in range(3)), *((7, own[k]) for k in (3, 4, 5)),
                           (9, own[6]), (9, own[7])])
    same = spark.createDataFrame([(None, f"{common}\n{own[0]}"), (None, f"{common}\n{own[1]}")], "doc_id long, text string")
    assert Counter(len(r["text"].split("\n")) for r in drop_duplicate_lines(same).collect()) == {1: 1, 2: 1}


def test_near_copies_without_an_id_or_under_a_kept_id_go(spark):
    words = [f"w{k}" for k in range(120)]
    copy = lambda k: " ".join([*words[:60], f"x{k}", *words[61:]])
    other = lambda k: " ".join(f"v{k}x{j}" for j in range(40))
    rows = [(3, copy(0)), (3, copy(1)), (None, copy(2)), (None, copy(3)), (None, other(1)), (None, other(1) + " more"),
            (None, other(2)), (4, other(3)), (4, other(4)), (None, ""), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], (r["text"] or "")[:3]) for r in one_of_each(df).collect())
    assert got == Counter([(3, "w0 "), (None, "v1x"), (None, "v2x"), (4, "v3x"), (4, "v4x"), (None, ""), (5, "")])


def test_sketches_bound_distances_from_below():
    rng = np.random.default_rng(11)
    pool = rng.integers(0, 1 << 63, 6000, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(rng.choice(pool, n)) for n in (1, 1, 3, 40, 300, 310, 2500, 5000)]
    near = [np.unique(np.concatenate([s[: len(s) - len(s) // 12], pool[:len(s) // 50]])) for s in sets]
    every = sets + near + sets[:3]
    real = np.array([[1 - len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for b in every] for a in every])
    low = distance_bounds([sketch(s) for s in every], [sketch(s) for s in every])
    assert (low <= real + 1e-12).all()
    big = [k for k, s in enumerate(every) if 250 < len(s) < 400]
    assert all(low[a, b] > 0.2 for a in big for b in big if real[a, b] > 0.75)  # what is far apart is told apart
    items = [(k, 3, sketch(s), k) for k, s in enumerate(every)]
    near = set(map(tuple, near_pairs(items, True, distance_bounds, 0.2)[0].tolist()))
    assert all((a, b) in near for b in range(len(every)) for a in range(b) if real[a, b] <= 0.2)
    roles = [(k, 2 if k % 3 == 0 else 1, sketch(s), k) for k, s in enumerate(every)]
    links, windows = (set(map(tuple, x.tolist())) for x in near_pairs(roles, False, distance_bounds, 0.2))
    for a in range(len(every)):
        for b in range(0, len(every), 3):
            if a % 3 and real[a, b] <= 0.4:
                assert (a, b) in windows and (real[a, b] > 0.2 or (a, b) in links)
    regions = [(k, 4 if k % 3 == 0 else 1, sketch(s), k) for k, s in enumerate(every)]
    assert {tuple(x) for x in near_pairs(regions, False, distance_bounds, 0.2)[0].tolist()} == links
    assert not len(near_pairs(regions, False, distance_bounds, 0.2)[1])


def test_windows_by_bounds_link_as_all_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(regions, "STARS", 0)  # leaves all links to the cells
    rng = np.random.default_rng(23)
    pool = np.unique(rng.integers(0, 1 << 63, 9000, dtype=np.uint64))
    sets = []
    for _ in range(2):  # families whose members lie within one to three thresholds of each other
        base = rng.choice(pool, 120, replace=False)
        for _ in range(26):
            s = base.copy()
            s[rng.choice(120, int(rng.integers(2, 16)), replace=False)] = rng.choice(pool, 1)
            sets.append(np.unique(np.concatenate([s, rng.choice(pool, int(rng.integers(0, 8)))])))
            base = s if rng.random() < 0.3 else base
    rows = [(k, s.tobytes(), sketch(s)) for k, s in enumerate(sets)]
    payloads = spark.createDataFrame(rows, "x long, p binary, s binary").repartition(4)
    members = payloads.select(F.explode(F.array(F.lit(1), F.pmod("x", F.lit(3)) + 2)).alias("cell"), "x",
                              (F.length("p") / 8).cast("long").alias("w"))
    linked = lambda a, b: 5 * (both := len(np.intersect1d(sets[a], sets[b]))) >= 4 * (
        len(sets[a]) + len(sets[b]) - both)
    root = brute.groups(range(len(sets)), linked)
    every = {}
    for k in range(len(sets)):
        every.setdefault(root[k], []).append(k)
    want = {k: min(group) for group in every.values() if len(group) > 1 for k in group}
    assert len(every) > 3 and max(map(len, every.values())) > 5
    links = link_cells(members.select(F.col("cell").cast("long"), "x", "w"), payloads, set_distance(0.8), 0.2 + 1e-12,
                       pivots=16, block=24, bounds=distance_bounds)
    assert {r["node"]: r["component"] for r in components(links).collect()} == want


def _writes(monkeypatch, module):
    done = []
    real = module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, name="stage": done.append(name) or real(df, name))
    return done


def test_few_edges_are_settled_by_one_task_whatever_their_shape(spark, monkeypatch):
    done = _writes(monkeypatch, steps)
    path = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long")
    assert {r["component"] for r in components(path).collect()} == {0}
    assert len(done) == 2  # the edges and their stars; a path took a chain of steps before


def test_more_edges_than_a_share_hang_together_as_well(spark, monkeypatch):
    monkeypatch.setattr(steps, "SHARE", 16)
    rng = np.random.default_rng(4)
    edges = [(k, k + 1) for k in range(60)] + [(int(a) + 1000, int(b) + 1000) for a, b in rng.integers(0, 90, (70, 2))]
    want = brute.groups({x for e in edges for x in e}, lambda a, b: (a, b) in set(edges) or (b, a) in set(edges))
    least = {}
    for x, g in want.items() if isinstance(want, dict) else enumerate(want):
        least[g] = min(x, least.get(g, x))
    loose = {x for a, b in edges if a == b for x in (a,)} - {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: least[g] for x, g in want.items() if x not in loose}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_stars_of_a_share(edges):
    root = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    a, b = stars(*(np.array([e[k] for e in edges], np.int64) for k in (0, 1)))
    assert dict(zip(a.tolist(), b.tolist())) == {x: r for x, r in root.items() if x != r}


def _far_apart(spark, n):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, 20, dtype=np.uint64)) for _ in range(n)]
    sets += [np.unique(np.append(s[1:], np.uint64(k))) for k, s in enumerate(sets[:5])]  # each near one other
    payloads = spark.createDataFrame([(k, s.tobytes(), sketch(s)) for k, s in enumerate(sets)], "x long, p binary, s binary")
    return payloads, payloads.select(F.lit(1).cast("long").alias("cell"), "x", F.lit(20).cast("long").alias("w")), \
        {k: k % n for k in [*range(5), *range(n, n + 5)]}


def test_a_crowded_cell_of_strangers_takes_one_round(spark, monkeypatch):
    monkeypatch.setattr(regions, "STARS", 0)
    payloads, members, want = _far_apart(spark, 120)
    done = _writes(monkeypatch, regions)
    links = link_cells(members, payloads, set_distance(0.8), 0.2 + 1e-12, pivots=4, block=8, bounds=distance_bounds)
    assert {r["node"]: r["component"] for r in components(links).collect()} == want
    assert done.count("found") == 1  # pivots took 4 items a round, 29 rounds, before


def test_larger_cells_give_a_share_of_pivots_a_round(spark, monkeypatch):
    for name, value in (("STARS", 0), ("WIDE", 1), ("DIRECT", 2), ("SHARE", 3)):
        monkeypatch.setattr(regions, name, value)
    payloads, members, want = _far_apart(spark, 60)
    done = _writes(monkeypatch, regions)
    links = link_cells(members, payloads, set_distance(0.8), 0.2 + 1e-12, pivots=4, block=8, bounds=distance_bounds)
    assert {r["node"]: r["component"] for r in components(links).collect()} == want
    assert done.count("found") <= 7


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab \u00e9\U0001f600", max_size=14), min_size=1, max_size=6))
def test_line_sketches_bound_edits_from_below(lines):
    marks = [line_dedup.sketch(x) for x in lines]
    low = edit_bounds(marks, marks)
    assert all(low[i, j] <= brute.edit(a, b) for i, a in enumerate(lines) for j, b in enumerate(lines))


def test_a_large_group_of_near_lines_measures_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    stem = "".join(rng.choice(list("abcdefghijklmnop "), 90))
    lines = []
    for _ in range(150):  # three edits each: far from one another, though under common keys
        line = list(stem)
        for at in rng.choice(90, 3, replace=False):
            line[at] = "xyz"[int(rng.integers(0, 3))]
        lines.append("".join(line))
    lines += [lines[0][:-1], lines[1] + "q"]
    a = [line_dedup.sketch(x) for x in lines]
    low = edit_bounds(a, a)
    real = np.array([[edit_distance(x, y, 4) for y in lines] for x in lines])
    assert (low <= 2).sum() < 2 * (real <= 2).sum() < (real <= 4).sum() + 2 * len(lines) ** 2
    rows = [(k, x) for k, x in enumerate(lines)]
    got = {(r["doc_id"], r["line_no"]): (r["first_doc_id"], r["first_line_no"])
           for r in line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.line_firsts(rows, 2, 30)


def _near_copies(spark, n, cells):
    """``n`` sets of which every two are near, in each of ``cells`` cells all but one, and two strangers."""
    rng = np.random.default_rng(9)
    stem = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.append(np.delete(stem, k % 60), np.uint64(k))) for k in range(n)]
    sets += [np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64)) for _ in range(2)]
    payloads = spark.createDataFrame([(k, s.tobytes(), sketch(s)) for k, s in enumerate(sets)], "x long, p binary, s binary")
    rows = [(c, k, 60) for c in range(cells) for k in range(n + 2) if k != c]
    return payloads, spark.createDataFrame(rows, "cell long, x long, w long")


def test_a_cell_of_near_copies_lists_items_and_not_pairs(spark, monkeypatch):
    counts, real = {}, regions.materialize

    def counted(df, name="stage"):
        out = real(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(regions, "materialize", counted)
    payloads, members = _near_copies(spark, 120, 6)
    for block in (256, 16):  # one part in one block, or chunk by chunk
        counts.clear()
        links = link_cells(members, payloads, set_distance(0.8), 0.2 + 1e-12, block=block, bounds=distance_bounds)
        assert {r["node"]: r["component"] for r in components(links).collect()} == dict.fromkeys(range(120), 0)
        assert counts["near"] <= 8 * 122 * 6  # 6 * 119 * 118 / 2 pairs before
    assert "pairs" not in counts and "clusters" not in counts  # cells that are not crowded take no rounds of one pivot


def test_dense_parts_hold_all_pairs_that_are_not_listed():
    ring = [(k, k + 1) for k in range(30, 40)]
    full = [(a, b) for a in range(0, 20, 1) for b in range(a + 1, 20)]
    listed, at, part = dense_parts(np.array(ring + full, np.int64), 41)
    assert list(map(tuple, listed.tolist())) == ring
    assert at.tolist() == list(range(20)) and set(part.tolist()) == {0}
    listed, at, part = dense_parts(np.array(ring, np.int64), 41)
    assert len(listed) == 10 and not len(at) and not len(part)


def test_two_chunks_in_a_star_block_meet_only_each_other():
    seen = []

    def far(p, q):
        seen.append({p, q})
        return float(abs(int(p) - int(q)))

    items = [(k, 1 if k < 3 else 4, str(v).encode(), k) for k, v in enumerate([0, 1, 50, 2, 51, 52])]
    assert {frozenset(x[:2]) for x in meet(items, True, far, 2.0)} == {frozenset(x) for x in ((0, 3), (1, 3), (2, 4), (2, 5))}
    assert {b"0", b"1"} not in seen and {b"51", b"52"} not in seen


def test_the_steps_of_an_edit_distance_do_not_grow_with_the_lines(monkeypatch):
    steps_, real = [], line_dedup._alike
    monkeypatch.setattr(line_dedup, "_alike", lambda *a: steps_.append(1) or real(*a))
    stem = "ab c" * 50_000
    assert edit_distance(stem, stem[:70_000] + "x" + stem[70_001:150_000] + stem[150_001:], 4) == 2
    assert edit_distance(stem, "".join(reversed(stem)), 4) == 5
    assert len(steps_) <= 50
