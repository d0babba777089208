"""Oracle SQL (DuckDB dialect) for the registered queries.

The text rules are rendered from the same constants the Spark expressions use,
so both sides apply one definition.  Tables are the pre-registered views
``documents labels events benchmark conversations pages ...``.
"""

from __future__ import annotations

import re

from pairlab.functions import metrics as M
from pairlab.functions import text as T


def lit(s: str) -> str:
    """SQL string literal (standard quoting; backslashes are literal)."""
    return "'" + s.replace("'", "''") + "'"


def _dollar_to_backslash(repl: str) -> str:
    return repl.replace("$1", "\\1").replace("$2", "\\2")


# ---- text rules ------------------------------------------------------------------

def _chars(s: str) -> str:
    return "(" + " || ".join(f"chr({ord(c)})" for c in s) + ")"


def sentences(expr: str) -> str:
    marked = f"regexp_replace({expr}, {lit(T.SENTENCE_END_RE)}, '\\1' || chr(10), 'g')"
    trimmed = f"list_transform(string_split({marked}, chr(10)), lambda s: trim(s, {_chars(T.WS_CHARS)}))"
    return f"list_filter({trimmed}, lambda s: s <> '')"


def word_tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {lit(T.TOKEN_RE)})"


def keep_tokens(arr: str) -> str:
    return (f"list_filter({arr}, lambda t: NOT regexp_matches(t, {lit(T.PUNCT_ONLY_RE)}) "
            f"AND NOT regexp_matches(t, {lit(T.DIGITS_ONLY_RE)}) AND NOT regexp_matches(t, {lit(T.BANNED_CHARS_RE)}))")


def stop_list() -> str:
    return "[" + ", ".join(lit(w) for w in T.default_stop_words()) + "]"


def lexical_tokens(arr: str) -> str:
    return f"list_filter({arr}, lambda t: NOT list_contains({stop_list()}, t))"


def rated_pairs_cte() -> str:
    return f"""
    d_s AS (SELECT doc_id, source, lang, {sentences('text')} AS s FROM documents),
    rated AS (
      SELECT p.doc_id || ':' || i AS pair_id, p.source, p.lang, s[i] AS original, s[i + 1] AS simplification,
             CAST(100.0 AS DOUBLE) * l.quality AS label
      FROM (SELECT *, unnest(range(1, len(s))) AS i FROM d_s) p JOIN labels l ON l.doc_id = p.doc_id)"""


def md5_key(seed, *exprs) -> str:
    parts = ", ".join([lit(str(seed))] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return f"md5(concat_ws(':', {parts}))"


def split_case(rank: str, n: str, test: float = 0.3, dev: float = 0.1) -> str:
    n_test = f"ceil(CAST({test!r} AS DOUBLE) * {n})"
    n_dev = f"ceil(CAST({dev!r} AS DOUBLE) * ({n} - {n_test}))"
    return (f"CASE WHEN {rank} <= {n_test} THEN 'test' WHEN {rank} <= {n_test} + {n_dev} THEN 'dev' "
            f"ELSE 'train' END")


SQL: dict[str, str] = {}

SQL["q01_mean_rating"] = """
SELECT user_id, round(avg(value), 6) AS rating, count(value) AS n_ratings
FROM events WHERE event_type = 'click' AND user_id IS NOT NULL GROUP BY user_id
"""

SQL["q02_mean_positional"] = """
WITH c AS (SELECT * FROM events WHERE event_type = 'click' AND user_id IS NOT NULL),
x AS (SELECT user_id, min(event_id) AS first_event_id FROM c GROUP BY user_id),
y AS (SELECT user_id, avg(value) AS rating FROM c GROUP BY user_id),
xr AS (SELECT *, row_number() OVER (ORDER BY first_event_id) AS k FROM x),
yr AS (SELECT rating, row_number() OVER (ORDER BY user_id) AS k FROM y)
SELECT xr.user_id, xr.first_event_id, round(yr.rating, 6) AS rating_positional
FROM xr LEFT JOIN yr ON xr.k = yr.k
"""

_AB = """
WITH a AS (SELECT d.* FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)),
b AS (SELECT d.* FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))
"""
_DUP = ("(SELECT 1 FROM a WHERE a.text = b.text AND a.lang = b.lang AND a.n_chars = b.n_chars "
        "AND b.lang = 'en')")
SQL["q03_cross_source_antijoin"] = _AB + f"SELECT doc_id, source, lang, n_chars FROM b WHERE NOT EXISTS {_DUP}"
SQL["q04_cross_source_matches"] = _AB + f"SELECT doc_id, source, lang, n_chars FROM b WHERE EXISTS {_DUP}"

SQL["q05_distinct_first"] = "SELECT DISTINCT text, lang FROM documents"

SQL["q06_distinct_last"] = """
SELECT text, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM documents GROUP BY text
"""

SQL["q07_harmonize_union"] = """
SELECT id, original, simplification, rating, aspect, corpus FROM (
  SELECT doc_id AS id, text AS original, 'documents' AS corpus FROM documents
  UNION ALL BY NAME
  SELECT item_id AS id, text AS simplification, 'benchmark' AS corpus FROM benchmark
  UNION ALL BY NAME
  SELECT conv_id AS id, text AS original, role AS aspect, 'conversations' AS corpus FROM conversations
  UNION ALL BY NAME
  SELECT page_id AS id, url AS original, 'pages' AS corpus FROM pages
  UNION ALL BY NAME
  SELECT doc_id AS id, CASE WHEN quality = 0 THEN 'low' WHEN quality = 1 THEN 'high' ELSE CAST(quality AS VARCHAR) END
         AS aspect, CAST(toxic AS DOUBLE) AS rating, 'labels' AS corpus FROM labels)
"""

SQL["q08_describe"] = """
SELECT CASE WHEN GROUPING(event_type) = 1 THEN 'all' ELSE event_type END AS "group",
       count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS p25,
       round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,
       round(max(value), 6) AS max
FROM events GROUP BY GROUPING SETS ((event_type), ())
"""

_EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
_STATISTICS = ["mean", "std", "min", "p25", "p50", "p75", "max"]
SQL["q08t_rating_table"] = "WITH d AS (" + SQL["q08_describe"] + "),\nlong AS (" + "\n  UNION ALL ".join(
    f"SELECT \"group\" AS g, {lit(m)} AS statistic, {m} AS value, {i} AS row_order FROM d"
    for i, m in enumerate(_STATISTICS)) + """)
SELECT statistic, CAST(min(row_order) AS INTEGER) AS row_order, """ + ", ".join(
    f"max(value) FILTER (WHERE g = {lit(g)}) AS \"{g}\"" for g in [*_EVENT_TYPES, "all"]) + " FROM long GROUP BY statistic"

SQL["q09_split_assign"] = f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {md5_key(42, 'doc_id')}, doc_id) AS k,
                  count(*) OVER () AS n FROM documents)
SELECT doc_id, {split_case('k', 'n')} AS split FROM r
"""

SQL["q09g_group_split"] = f"""
WITH g AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, coalesce(sum(n) OVER (ORDER BY {md5_key(42, 'conv_id')}, conv_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2 AS middle,
             (SELECT count(*) FROM conversations) AS total FROM g)
SELECT c.conv_id, c.turn, {split_case('p.middle', 'p.total')} AS split FROM conversations c JOIN p ON p.conv_id = c.conv_id"""

MEAN_PAIRS_CTE = f"""WITH {rated_pairs_cte()},
mp AS (SELECT original, simplification, avg(label) AS label FROM rated
       WHERE original IS NOT NULL AND simplification IS NOT NULL GROUP BY original, simplification)"""

SQL["q10_split_counts"] = MEAN_PAIRS_CTE + f""",
r AS (SELECT *, row_number() OVER (ORDER BY {md5_key(42, 'original', 'simplification')}, original, simplification)
             AS k, count(*) OVER () AS n FROM mp)
SELECT {split_case('k', 'n')} AS split, count(*) AS n_rows FROM r GROUP BY 1
"""


# ---- text statistics -----------------------------------------------------------------

def _tok(expr: str) -> str:
    return keep_tokens(word_tokens(expr))


def _mean_list(expr: str) -> str:
    return f"CASE WHEN len({expr}) > 0 THEN list_sum({expr}) / len({expr}) END"


def doc_stats_cte(src: str, cols: str) -> str:
    st = f"list_transform({sentences('lower(text)')}, lambda x: {_tok('x')})"
    return f"""ds AS (
      SELECT {cols}, tok, {lexical_tokens('tok')} AS lex, st FROM (
        SELECT {cols}, {_tok('text')} AS tok, {st} AS st FROM {src}))"""


def _sent_cols() -> str:
    lens = "list_transform(st, lambda y: len(y))"
    lex_lens = f"list_transform(st, lambda y: len({lexical_tokens('y')}))"
    return f"{_mean_list(lens)} AS avg_sentence_len, {_mean_list(lex_lens)} AS avg_sentence_len_lexical"


SQL["q11_doc_token_stats"] = f"""WITH {doc_stats_cte('documents', 'doc_id')}
SELECT doc_id, CAST(len(tok) AS INTEGER) AS n_tokens, CAST(len(lex) AS INTEGER) AS n_lexical FROM ds"""

SQL["q12_sentence_length"] = f"""WITH {doc_stats_cte('documents', 'doc_id')},
z AS (SELECT doc_id, CAST(len(st) AS INTEGER) AS n_sentences, {_sent_cols()} FROM ds)
SELECT doc_id, n_sentences, round(avg_sentence_len, 6) AS avg_sentence_len,
       round(avg_sentence_len_lexical, 6) AS avg_sentence_len_lexical FROM z"""


def corpus_report_sql(src: str, by: list[str]) -> str:
    keys = ", ".join(by)
    join = " AND ".join(f"g.{k} IS NOT DISTINCT FROM v.{k}" for k in by)
    return f"""WITH {doc_stats_cte(src, keys)},
per_doc AS (SELECT {keys}, len(lex) AS n_lex, {_sent_cols()} FROM ds),
g AS (SELECT {keys}, count(*) AS n_texts, sum(n_lex) AS n_lex, avg(avg_sentence_len) AS asl,
             avg(avg_sentence_len_lexical) AS asll FROM per_doc GROUP BY {keys}),
u AS (SELECT DISTINCT {keys}, unnest(tok) AS token FROM ds),
v AS (SELECT {keys}, count(*) AS vocab_size,
             count(*) FILTER (WHERE NOT list_contains({stop_list()}, token)) AS lexical_vocab_size
      FROM u GROUP BY {keys})
SELECT {", ".join("g." + k for k in by)}, g.n_texts, coalesce(v.vocab_size, 0) AS vocab_size,
       coalesce(v.lexical_vocab_size, 0) AS lexical_vocab_size,
       round(g.asl, 6) AS avg_sentence_len, round(g.asll, 6) AS avg_sentence_len_lexical,
       round(CASE WHEN g.n_lex > 0 THEN coalesce(v.lexical_vocab_size, 0) / g.n_lex END, 6) AS lexical_richness
FROM g LEFT JOIN v ON {join}"""


SQL["q13_vocabulary"] = corpus_report_sql("documents", ["lang"])

_LANG_AND_ALL = """(SELECT lang, false AS is_all, text FROM documents
  UNION ALL SELECT CAST(NULL AS VARCHAR) AS lang, true AS is_all, text FROM documents)"""
SQL["q13a_vocabulary_sketches"] = f"""SELECT lang, is_all, n_texts, vocab_size, lexical_vocab_size, true AS vocab_close,
       true AS lexical_close, true AS quartiles_close FROM ({corpus_report_sql(_LANG_AND_ALL, ["lang", "is_all"])})"""

SQL["q14_top_words"] = f"""
WITH t AS (SELECT unnest({lexical_tokens(_tok('text'))}) AS token FROM documents)
SELECT token, count(*) AS freq FROM t GROUP BY token ORDER BY freq DESC, token LIMIT 50"""

PAIR_TEXTS = f"""(WITH {rated_pairs_cte()}
  SELECT source, 'original' AS side, original AS text FROM rated
  UNION ALL SELECT source, 'simplification' AS side, simplification AS text FROM rated)"""

SQL["q15_corpus_report"] = corpus_report_sql(PAIR_TEXTS, ["source", "side"])

_TOP_BY_SIDE = f"""
t AS (SELECT source, side, unnest({lexical_tokens(_tok('text'))}) AS token FROM {PAIR_TEXTS}),
f AS (SELECT source, side, token, count(*) AS freq FROM t GROUP BY source, side, token),
top AS (SELECT source, side, CAST(row_number() OVER (PARTITION BY source, side ORDER BY freq DESC, token) AS INTEGER) AS rank,
               token, freq FROM f QUALIFY rank <= 50)"""
SQL["q14g_top_words_by_side"] = f"WITH {_TOP_BY_SIDE} SELECT source, side, rank, token, freq FROM top"
SQL["q15s_written_report"] = f"""WITH rep AS ({SQL["q15_corpus_report"]}), {_TOP_BY_SIDE},
w AS (SELECT source, side, string_agg(token || ':' || freq, ' ' ORDER BY rank) AS top_words FROM top GROUP BY source, side)
SELECT rep.*, w.top_words FROM rep LEFT JOIN w
ON w.source IS NOT DISTINCT FROM rep.source AND w.side IS NOT DISTINCT FROM rep.side"""

_WIDE_ORDER = ["vocab_size", "lexical_vocab_size", "avg_sentence_len", "avg_sentence_len_lexical", "lexical_richness"]
SQL["q15w_wide_report"] = f"""WITH rep AS ({corpus_report_sql("documents", ["lang"])}),
long AS (
""" + "\n  UNION ALL ".join(
    f"SELECT lang, {lit(m)} AS metric, CAST({m} AS DOUBLE) AS value, {i} AS row_order FROM rep"
    for i, m in enumerate(_WIDE_ORDER)) + """)
SELECT metric, """ + ", ".join(f"max(value) FILTER (WHERE lang = {lit(g)}) AS {g}" for g in ["de", "en", "es", "fr"]) + """,
       CAST(min(row_order) AS INTEGER) AS row_order
FROM long GROUP BY metric"""


# ---- pair metrics --------------------------------------------------------------------------

def rouge_tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit(M.ROUGE_TOKEN_RE)})"


def ngr(arr: str, n: int) -> str:
    return (f"CASE WHEN len({arr}) >= {n} THEN list_transform(range(1, len({arr}) - {n} + 2), "
            f"lambda i: array_to_string({arr}[i:i + {n - 1}], ' ')) ELSE CAST([] AS VARCHAR[]) END")


def overlap(a: str, b: str) -> str:
    return (f"coalesce(list_sum(list_transform(list_intersect({a}, {b}), lambda g: "
            f"least(len(list_filter({a}, lambda x: x = g)), len(list_filter({b}, lambda x: x = g))))), 0)")


def fmeasure(i: str, na: str, nb: str) -> str:
    p = f"({i} / greatest({na}, 1))"
    r = f"({i} / greatest({nb}, 1))"
    return f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE CAST(0.0 AS DOUBLE) END"


def bleu_tok(x: str) -> str:
    s = f"replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for ent, ch in M.BLEU_ENTITIES:
        s = f"replace({s}, {lit(ent)}, {lit(ch)})"
    s = f"(' ' || {s} || ' ')"
    for pattern, repl in M.BLEU_RULES:
        s = f"regexp_replace({s}, {lit(pattern)}, {lit(_dollar_to_backslash(repl))}, 'g')"
    return f"list_filter(regexp_split_to_array({s}, {lit(T.WS_CLASS + '+')}), lambda t: t <> '')"


def rouge_n_sql(a: str, b: str, n: int) -> str:
    ga, gb = ngr(a, n), ngr(b, n)
    return fmeasure(overlap(ga, gb), f"len({ga})", f"len({gb})")


def bleu_sql_ctes(src: str, id_cols: str, hyp: str, ref: str) -> str:
    """CTEs bl1..bl3 over ``src``; bl3 has id columns + bleu."""
    cs = ", ".join(f"{overlap(ngr('h', n), ngr('r', n))} AS c{n}" for n in range(1, 5))
    ts = ", ".join(f"greatest(len(h) - {n - 1}, 0) AS t{n}" for n in range(1, 5))
    zs = []
    acc = []
    for n in range(1, 5):
        acc.append(f"CAST(c{n} = 0 AS INTEGER)")
        zs.append(f"({' + '.join(acc)}) AS z{n}")
    ps = ", ".join(
        f"CASE WHEN c{n} > 0 THEN CAST(100.0 AS DOUBLE) * c{n} / t{n} "
        f"ELSE CAST(100.0 AS DOUBLE) / (pow(CAST(2.0 AS DOUBLE), z{n}) * t{n}) END AS p{n}" for n in range(1, 5))
    return f"""bl1 AS (SELECT {id_cols}, {bleu_tok(hyp)} AS h, {bleu_tok(ref)} AS r FROM {src}),
bl2 AS (SELECT {id_cols}, len(h) AS sys_len, len(r) AS ref_len, {cs}, {ts} FROM bl1),
bl2b AS (SELECT *, {", ".join(zs)} FROM bl2),
bl2c AS (SELECT *, {ps} FROM bl2b),
bl3 AS (SELECT {id_cols}, CASE WHEN c1 + c2 + c3 + c4 = 0 OR t4 = 0 THEN CAST(0.0 AS DOUBLE)
   ELSE (CASE WHEN sys_len < ref_len THEN (CASE WHEN sys_len > 0 THEN exp(1 - ref_len / sys_len) ELSE 0.0 END)
              ELSE 1.0 END) * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) END AS bleu FROM bl2c)"""


_RATED = f"WITH {rated_pairs_cte()}"

SQL["q16_rouge1"] = _RATED + f""",
rt AS (SELECT pair_id, {rouge_tok('original')} AS a, {rouge_tok('simplification')} AS b FROM rated)
SELECT pair_id, round({rouge_n_sql('a', 'b', 1)}, 6) AS rouge1 FROM rt"""

SQL["q17_rouge2"] = _RATED + f""",
rt AS (SELECT pair_id, {rouge_tok('original')} AS a, {rouge_tok('simplification')} AS b FROM rated)
SELECT pair_id, round({rouge_n_sql('a', 'b', 2)}, 6) AS rouge2 FROM rt"""

# q18 (longest common subsequence) is too slow in SQL on all sentence pairs: tested against brute force.

SQL["q19_bleu"] = _RATED + f""",
{bleu_sql_ctes('rated', 'pair_id', 'original', 'simplification')}
SELECT pair_id, round(bleu, 6) AS bleu FROM bl3"""


def pool_cte() -> str:
    return f"""dp_s AS (SELECT doc_id, {sentences('text')} AS s FROM documents),
    pool AS (SELECT doc_id || ':' || i AS cand_id, s[i] AS cand_text
             FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM dp_s)
             UNION ALL SELECT 'item:' || item_id AS cand_id, text AS cand_text FROM benchmark)"""


def first_round_cte(rows: str, id_col: str, seed: int = 42) -> str:
    return f"""rr AS (SELECT *, row_number() OVER (ORDER BY {md5_key(seed, id_col)}, {id_col}) AS k FROM {rows}),
    cr AS (SELECT *, row_number() OVER (ORDER BY {md5_key(seed, 'cand_id')}, cand_id) AS k FROM pool),
    fr AS (SELECT rr.{id_col}, rr.original, cr.cand_id, cr.cand_text FROM rr JOIN cr ON rr.k = cr.k)"""


def unrelated_sql(src: str, id_cols: str, threshold: float) -> str:
    """CTEs us1 (rouge) + bl* (bleu) + us2 with rouge1, rouge2, bleu, unrelated."""
    t = repr(threshold)
    return f"""us0 AS (SELECT {id_cols}, {rouge_tok('original')} AS a, {rouge_tok('cand_text')} AS b FROM {src}),
us1 AS (SELECT {id_cols}, {rouge_n_sql('a', 'b', 1)} AS rouge1, {rouge_n_sql('a', 'b', 2)} AS rouge2 FROM us0),
{bleu_sql_ctes(src, id_cols, 'original', 'cand_text')},
us2 AS (SELECT us1.*, bl3.bleu, (us1.rouge1 < {t} AND us1.rouge2 < {t} AND bl3.bleu < 100 * {t}) AS unrelated
        FROM us1 JOIN bl3 USING ({id_cols}))"""


SQL["q20_unrelated_filter"] = _RATED + f""",
{pool_cte()},
{first_round_cte('rated', 'pair_id')},
{unrelated_sql('fr', 'pair_id, cand_id', 0.2)}
SELECT pair_id, cand_id, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2, round(bleu, 6) AS bleu, unrelated
FROM us2"""


# ---- augmentation --------------------------------------------------------------------------

SQL["q22_identical"] = _RATED + """
SELECT pair_id, original, original AS simplification, CAST(100.0 AS DOUBLE) AS label FROM rated"""

SQL["q23_commutative"] = _RATED + """
SELECT pair_id, simplification AS original, original AS simplification, label FROM rated
WHERE original IS DISTINCT FROM simplification"""

ROUNDS = 8  # written out one by one; a round without open rows yields nothing


def matching_ctes(prefix: str, rows: str, pool: str, threshold: float, seed: int = 42, descending: bool = False) -> str:
    """The rounds of the unrelated matching: ``{prefix}acc`` (pair_id, original, cand_id, cand_text, round, scores)
    and ``{prefix}used`` (cand_id).  ``rows`` has pair_id, original; ``pool`` has cand_id, cand_text."""
    order = md5_key(seed, "cand_id")
    order = f"translate({order}, '0123456789abcdef', 'fedcba9876543210')" if descending else order
    out = [f"{prefix}rows AS MATERIALIZED (SELECT pair_id, original, {md5_key(seed, 'pair_id')} AS rh FROM {rows} "
           "WHERE original IS NOT NULL)",
           f"{prefix}pool AS MATERIALIZED (SELECT cand_id, cand_text, {order} AS ch FROM {pool} WHERE cand_text IS NOT NULL)"]
    open_, free = f"{prefix}rows", f"{prefix}pool"
    for r in range(1, ROUNDS + 1):
        x = f"{prefix}{r}"
        scores = unrelated_sql(f"{x}p", "pair_id, cand_id", threshold)
        for name in ("us0", "us1", "us2", "bl1", "bl2", "bl2b", "bl2c", "bl3"):
            scores = re.sub(rf"\b{name}\b", f"{x}{name}", scores)
        out += [
            f"{x}n AS MATERIALIZED (SELECT *, greatest(1, least(free // greatest(rows, 1), {2 ** (r - 1)})) AS w FROM "
            f"(SELECT (SELECT count(*) FROM {open_}) AS rows, (SELECT count(*) FROM {free}) AS free))",
            f"{x}r AS (SELECT pair_id, original, row_number() OVER (ORDER BY rh, pair_id) AS k FROM {open_})",
            f"{x}c AS (SELECT cand_id, cand_text, row_number() OVER (ORDER BY ch, cand_id) AS ck FROM {free})",
            f"{x}p AS MATERIALIZED (SELECT r.pair_id, r.original, c.cand_id, c.cand_text, c.ck FROM {x}r r "
            f"JOIN (SELECT *, (ck - 1) // (SELECT w FROM {x}n) + 1 AS k FROM {x}c "
            f"WHERE ck <= (SELECT rows * w FROM {x}n)) c ON r.k = c.k)",
            scores.replace(f"{x}us2 AS (", f"{x}us2 AS MATERIALIZED ("),
            f"{x}d AS MATERIALIZED (SELECT p.*, rouge1, rouge2, bleu, "
            f"min(CASE WHEN unrelated THEN ck END) OVER (PARTITION BY p.pair_id) AS first_ok "
            f"FROM {x}p p JOIN {x}us2 u ON u.pair_id = p.pair_id AND u.cand_id = p.cand_id)",
            f"{x}rows AS MATERIALIZED (SELECT * FROM {open_} o WHERE NOT EXISTS "
            f"(SELECT 1 FROM {x}d d WHERE d.pair_id = o.pair_id AND d.ck = d.first_ok))",
            f"{x}pool AS MATERIALIZED (SELECT * FROM {free} f WHERE NOT EXISTS "
            f"(SELECT 1 FROM {x}d d WHERE d.cand_id = f.cand_id AND (d.first_ok IS NULL OR d.ck <= d.first_ok)))"]
        open_, free = f"{x}rows", f"{x}pool"
    every = " UNION ALL ".join(f"SELECT pair_id, original, cand_id, cand_text, CAST({r} AS INTEGER) AS round, rouge1, rouge2, "
                               f"bleu FROM {prefix}{r}d WHERE ck = first_ok" for r in range(1, ROUNDS + 1))
    return ",\n".join([*out, f"{prefix}acc AS MATERIALIZED ({every})",
                       f"{prefix}free AS MATERIALIZED (SELECT * FROM {free})"])


_MATCHED = _RATED + f",\n{pool_cte()},\n{matching_ctes('a', 'rated', 'pool', 0.2)}"
_SCORED = "round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2, round(bleu, 6) AS bleu"
SQL["q21_unrelated_match"] = _MATCHED + f"\nSELECT pair_id, cand_id, round, {_SCORED} FROM aacc"

_COUNTERS = " UNION ALL ".join(f"""
SELECT CAST({r} AS INTEGER) AS round, CAST(w AS BIGINT) AS "window", rows AS rows_open,
       (SELECT count(*) FROM a{r}p) AS pairs_scored, (SELECT count(*) FROM a{r}d WHERE ck = first_ok) AS accepted,
       (SELECT count(*) FROM a{r}d WHERE first_ok IS NULL OR ck < first_ok) AS rejected
FROM a{r}n WHERE rows > 0 AND free > 0""" for r in range(1, ROUNDS + 1))
SQL["q21s_match_counters"] = _MATCHED + _COUNTERS

SQL["q24_augmented_dataset"] = _MATCHED + f""",
keys AS (
  SELECT 'rated' AS kind, pair_id FROM rated
  UNION ALL SELECT 'unrelated', pair_id FROM aacc
  UNION ALL SELECT 'identical', pair_id FROM rated
  UNION ALL SELECT 'inverse-rated', pair_id FROM rated WHERE original IS DISTINCT FROM simplification
  UNION ALL SELECT 'inverse-unrelated', pair_id FROM aacc WHERE original IS DISTINCT FROM cand_text),
r AS (SELECT *, row_number() OVER (ORDER BY {md5_key(42, 'kind', 'pair_id')}, kind, pair_id) AS k,
             count(*) OVER () AS n FROM keys)
SELECT kind, {split_case('k', 'n')} AS split, count(*) AS n_rows FROM r GROUP BY ALL"""

_HOLDOUT = f"""
hold_s AS (SELECT conv_id, turn, {sentences('text')} AS s FROM conversations WHERE role = 'user'),
hold AS (SELECT conv_id || ':' || turn || ':' || i AS pair_id, s[i] AS original
         FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM hold_s))"""
SQL["q25u_holdout_unrelated"] = _MATCHED + f""",{_HOLDOUT},
{matching_ctes('h', 'hold', 'afree', 0.25, descending=True)}
SELECT pair_id, cand_id, round, {_SCORED} FROM hacc"""

SQL["q25_holdout_identical"] = f"""
WITH c AS (SELECT conv_id, turn, {sentences('text')} AS s FROM conversations WHERE role = 'user'),
e AS (SELECT conv_id || ':' || turn || ':' || i AS pair_id, s[i] AS original
      FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM c))
SELECT pair_id, original, original AS simplification, CAST(100.0 AS DOUBLE) AS label FROM e"""


# ---- score tables ------------------------------------------------------------------------------

_SC = "sc AS (SELECT user_id, event_id, value / CAST(100.0 AS DOUBLE) AS score FROM events)"

SQL["q26_topk_ties"] = """
WITH r AS (SELECT user_id, event_id, value, rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS rk FROM events)
SELECT user_id, event_id, value FROM r WHERE rk <= 3"""

SQL["q27_top_p"] = f"""WITH {_SC},
k AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY score DESC) AS rk FROM sc),
m AS (SELECT *, max(score) OVER (PARTITION BY user_id) AS mx FROM k WHERE rk <= 10),
e AS (SELECT *, exp(score - mx) AS ex FROM m),
pr AS (SELECT *, ex / sum(ex) OVER (PARTITION BY user_id) AS p FROM e),
c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY user_id ORDER BY score DESC, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) - 1 AS r0 FROM pr)
SELECT user_id, event_id, score FROM c WHERE r0 = 0 OR before <= 0.9 OR r0 <= 2"""

SQL["q28_softmax"] = f"""WITH {_SC},
m AS (SELECT *, score - max(score) OVER (PARTITION BY user_id) AS z FROM sc)
SELECT user_id, event_id, round(exp(z) / sum(exp(z)) OVER (PARTITION BY user_id), 6) AS prob FROM m"""

SQL["q29_argmax"] = f"""WITH {_SC}
SELECT user_id, first(event_id ORDER BY score DESC, event_id) AS best FROM sc GROUP BY user_id"""

_U = ("((('0x' || substr(md5(concat_ws(':', '42', CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR))), 1, 13))"
      "::BIGINT)::DOUBLE + 0.5) / CAST(4503599627370496.0 AS DOUBLE)")
SQL["q30_weighted_pick"] = f"""WITH {_SC},
g AS (SELECT *, score / CAST(1.0 AS DOUBLE) + (-ln(-ln({_U}))) AS key FROM sc)
SELECT user_id, first(event_id ORDER BY key DESC, event_id) AS pick FROM g GROUP BY user_id"""

SQL["q31_prefix_score"] = """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events),
f AS (SELECT user_id, min(step) FILTER (WHERE event_type = 'error') AS fe FROM s GROUP BY user_id)
SELECT s.user_id, round(sum(CASE WHEN f.fe IS NULL OR s.step < f.fe THEN value ELSE 0.0 END), 6) AS seq_score,
       count(*) FILTER (WHERE f.fe IS NULL OR s.step < f.fe) AS n_steps, bool_or(f.fe IS NOT NULL) AS ended
FROM s JOIN f ON s.user_id = f.user_id GROUP BY s.user_id"""

_TT = f"tt AS (SELECT conv_id, turn, {_tok('text')} AS tokens FROM conversations)"

SQL["q32_cut_at_marker"] = f"""WITH {_TT},
c AS (SELECT conv_id, turn, (CASE WHEN list_position(tokens, 'the') IS NOT NULL
                                 THEN tokens[1:list_position(tokens, 'the') - 1] ELSE tokens END)[1:100] AS c FROM tt)
SELECT conv_id, turn, CAST(len(c) AS INTEGER) AS n_kept, array_to_string(c, ' ') AS kept_text FROM c"""

SQL["q33_fanout_refold"] = """
WITH r AS (SELECT doc_id, lang, n_chars, unnest(range(0, 3)) AS run_id FROM documents),
o AS (SELECT doc_id, run_id, CAST((n_chars * (run_id + 1)) % 7 AS DOUBLE) AS score,
             lang || '#' || CAST(run_id AS VARCHAR) AS output_text FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, run_id) AS rn FROM o)
SELECT doc_id, CAST(max(run_id) FILTER (WHERE rn = 1) AS BIGINT) AS best_run,
       string_agg(CAST(run_id AS VARCHAR), ',' ORDER BY rn) AS run_order,
       max(score) FILTER (WHERE rn = 1) AS best_score, max(output_text) FILTER (WHERE rn = 1) AS best_text
FROM k GROUP BY doc_id"""


def shingles_sql(src: str, id_cols: str, tokens: str, n: int) -> str:
    return f"""(SELECT {id_cols}, CAST(p AS INTEGER) AS pos, array_to_string({tokens}[p:p + {n - 1}], ' ') AS gram,
          {tokens}[p + {n}] AS next_token
   FROM (SELECT {id_cols}, {tokens}, unnest(range(1, greatest(len({tokens}) - {n - 1}, 1))) AS p FROM {src}))"""


def last_gram_sql(tokens: str, n: int) -> str:
    return f"CASE WHEN len({tokens}) >= {n} THEN array_to_string({tokens}[len({tokens}) - {n - 1}:], ' ') END"


SQL["q34_ngram_copy"] = f"""WITH d AS (SELECT doc_id, {_tok('text')} AS t FROM documents),
b AS (SELECT item_id, {_tok('text')} AS t FROM benchmark),
g AS (SELECT item_id, {last_gram_sql('t', 3)} AS gram FROM b),
s AS {shingles_sql('d', 'doc_id', 't', 3)}
SELECT g.item_id, s.doc_id, s.pos, s.next_token FROM g JOIN s ON g.gram = s.gram"""

SELF_COPIES = f"""{_TT},
g AS (SELECT conv_id, turn, {last_gram_sql('tokens', 3)} AS gram FROM tt),
s AS {shingles_sql('tt', 'conv_id, turn', 'tokens', 3)},
hits AS (SELECT g.conv_id, g.turn, s.pos, s.next_token FROM g JOIN s
         ON g.conv_id = s.conv_id AND g.turn = s.turn AND g.gram = s.gram)"""

SQL["q35_ngram_repeat"] = f"WITH {SELF_COPIES} SELECT conv_id, turn, pos, next_token FROM hits"

SQL["q35r_repeat_share"] = f"""WITH {_TT},
e AS (SELECT conv_id, turn, unnest({ngr('tokens', 3)}) AS gram FROM tt),
c AS (SELECT conv_id, turn, gram, count(*) AS c FROM e GROUP BY ALL)
SELECT conv_id, turn, CAST(sum(c) AS BIGINT) AS n_ngrams,
       CAST(sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS BIGINT) AS n_repeated
FROM c GROUP BY conv_id, turn"""

SQL["q36_copy_penalty"] = f"""WITH {SELF_COPIES},
sc AS (SELECT conv_id, turn, token, CAST(count(*) AS DOUBLE) AS score
       FROM (SELECT conv_id, turn, unnest(tokens) AS token FROM tt) GROUP BY ALL),
h AS (SELECT DISTINCT conv_id, turn, next_token AS token FROM hits)
SELECT sc.conv_id, sc.turn, sc.token,
       CASE WHEN h.token IS NOT NULL THEN sc.score - 1000.0 ELSE sc.score END AS score
FROM sc LEFT JOIN h ON sc.conv_id = h.conv_id AND sc.turn = h.turn AND sc.token = h.token"""

SQL["q37_tsv_roundtrip"] = "SELECT conv_id, turn, role, text FROM conversations"

# Every averaged pair and every holdout row finds an unrelated partner at this
# scale (the pool is about 2.5 times the rows), so all counts follow from keys.
SQL["q38_build_dataset"] = _RATED + f""",
{pool_cte()},
mp AS MATERIALIZED (SELECT original, simplification, min(pair_id) AS pair_id FROM rated
       WHERE original IS NOT NULL AND simplification IS NOT NULL GROUP BY original, simplification),
{matching_ctes('a', 'mp', 'pool', 0.2)},{_HOLDOUT},
{matching_ctes('h', 'hold', 'afree', 0.25, descending=True)},
m AS (SELECT pair_id, row_number() OVER (ORDER BY {md5_key(42, 'pair_id')}, pair_id) AS k, count(*) OVER () AS n
      FROM mp),
keys AS (
  SELECT 'rated' AS kind, pair_id FROM mp
  UNION ALL SELECT 'unrelated', pair_id FROM aacc
  UNION ALL SELECT 'identical', pair_id FROM mp
  UNION ALL SELECT 'inverse-rated', pair_id FROM mp WHERE original IS DISTINCT FROM simplification
  UNION ALL SELECT 'inverse-unrelated', pair_id FROM aacc WHERE original IS DISTINCT FROM cand_text),
a AS (SELECT row_number() OVER (ORDER BY {md5_key(42, 'kind', 'pair_id')}, kind, pair_id) AS k,
             count(*) OVER () AS n FROM keys)
SELECT 'meaning' AS config, {split_case('k', 'n')} AS split, count(*) AS n_rows FROM m GROUP BY ALL
UNION ALL
SELECT 'meaning_with_data_augmentation', {split_case('k', 'n')}, count(*) FROM a GROUP BY ALL
UNION ALL
SELECT 'meaning_holdout_identical', 'holdout', count(*) FROM hold
UNION ALL
SELECT 'meaning_holdout_unrelated', 'holdout', count(*) FROM hacc"""

SQL["q34f_copied_followers"] = f"""
SELECT item_id, next_token, count(*) AS n_places FROM ({SQL["q34_ngram_copy"]}) GROUP BY item_id, next_token
"""


def named_cte() -> str:
    """coded and named ratings; ``dup`` marks named system rows that the coded table holds with rating 100."""
    return f"""{rated_pairs_cte()},
    coded AS (SELECT original, simplification, pair_id AS sid, label AS rating,
                     CAST(split_part(pair_id, ':', 2) AS BIGINT) % 3 AS code FROM rated),
    named AS (SELECT original AS source, simplification, label AS rating, pair_id AS sentence_id,
                     CASE WHEN lang = 'en' THEN 'system' ELSE 'human' END AS simplification_type,
                     CASE CAST(split_part(pair_id, ':', 2) AS BIGINT) % 3 WHEN 0 THEN 'meaning' WHEN 1 THEN 'fluency'
                       ELSE 'simplicity' END AS aspect FROM rated),
    marked AS (SELECT n.*, n.simplification_type = 'system' AND EXISTS (
                 SELECT 1 FROM coded c WHERE c.rating = 100 AND c.original = n.source
                   AND c.simplification = n.simplification AND c.rating = n.rating AND c.sid = n.sentence_id
                   AND n.aspect = CASE c.code WHEN 0 THEN 'meaning' WHEN 1 THEN 'fluency' ELSE 'simplicity' END) AS dup
               FROM named n)"""


SQL["q39_four_sources"] = f"""
WITH {named_cte()},
one AS (SELECT DISTINCT original, simplification, sid FROM coded WHERE code = 0),
one_mean AS (SELECT sid, avg(rating) AS m FROM coded WHERE code = 0 GROUP BY sid),
two AS (SELECT DISTINCT original, simplification FROM rated),
two_mean AS (SELECT simplification, avg(label) AS m FROM rated GROUP BY simplification)
SELECT 'coded' AS corpus, original, simplification, round(m, 6) AS label FROM one JOIN one_mean USING (sid)
UNION ALL SELECT 'input', original, simplification, round(m, 6) FROM two JOIN two_mean USING (simplification)
UNION ALL SELECT 'direct', text, text, CAST(100 AS DOUBLE) FROM benchmark
UNION ALL SELECT 'named', source, simplification, round(avg(rating), 6) FROM marked
          WHERE NOT dup AND aspect = 'meaning' GROUP BY source, simplification
"""

SQL["q40_clean_ratings"] = f"""
WITH {named_cte()}
SELECT source, simplification, rating, sentence_id, simplification_type, aspect FROM marked WHERE NOT dup
"""

SQL["q40c_duplicates_by_aspect"] = f"""
WITH {named_cte()}
SELECT aspect, count(*) AS n_duplicates FROM marked WHERE dup GROUP BY aspect
"""
