"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from pairlab.llm import licences as L
from pairlab.llm import quality_rules as Q

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP10_QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - {Q.WINDOW - 2})) AS i FROM d WHERE len(w) >= {Q.WINDOW}),
named AS (SELECT win.doc_id, i, array_to_string(w[i:i + {Q.WINDOW - 1}], ' ') AS x FROM win JOIN d USING (doc_id)),
twice AS (SELECT doc_id, i FROM named QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM
          (SELECT doc_id, unnest(range(i, i + {Q.WINDOW})) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(dup.n_lines, 0)::BIGINT AS n_lines, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_symbols <= {Q.MAX_SYMBOLS_PER_100_WORDS} * n_words
       AND word_chars BETWEEN {Q.MIN_MEAN_WORD} * n_words AND {Q.MAX_MEAN_WORD} * n_words
       AND 100 * n_dup_lines <= {Q.MAX_DUP_LINE_PERCENT} * n_lines AS kept
FROM b"""



def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def licence_sql() -> str:
    known = L.known_sentences(L.SENTENCES)
    keys = "[" + ", ".join(map(_lit, known)) + "]"
    ids = "[" + ", ".join(map(_lit, known.values())) + "]"
    norm = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    steps, hits = [], []
    for k, (name, sequence) in enumerate(L.RULES):
        pattern = _lit("," + ",,".join(sequence) + ",")
        steps.append(f"r{k} AS (SELECT * REPLACE (replace(rest, {pattern}, '-') AS rest), contains(rest, {pattern}) AS h{k} "
                     f"FROM {f'r{k - 1}' if k else 'ids'})")
        before = "".join(f" AND NOT h{j}" for j in range(k) if L.RULES[j][0] == name)
        hits.append(f"CASE WHEN h{k}{before} THEN {_lit(name)} END")
    hits.append("CASE WHEN regexp_matches(rest, '[a-z]') THEN 'unknown' END")
    return f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), {_lit(L.SENTENCE_RE)}),
                                      lambda s: regexp_matches(s, '[A-Za-z0-9]')) AS parts FROM documents),
tried AS (SELECT doc_id, parts, flatten(list_transform(
            list_filter(parts, lambda s: length(s) >= {min(map(len, known))}),
            lambda s: CASE WHEN contains(s, chr(10)) AND NOT list_contains({keys}, {norm.format('s')})
                           THEN string_split(s, chr(10)) ELSE [s] END)) AS t FROM d),
found AS (SELECT doc_id, parts, list_transform(
            list_filter(list_transform(t, lambda s: {norm.format('s')}), lambda s: list_contains({keys}, s)),
            lambda s: list_extract({ids}, list_position({keys}, s))) AS f FROM tried),
ids AS (SELECT doc_id, len(parts)::BIGINT AS n_sentences, len(f)::BIGINT AS n_known,
               array_to_string(f, ',') AS sentence_ids, ',' || array_to_string(f, ',,') || ',' AS rest FROM found),
{", ".join(steps)}
SELECT doc_id, n_sentences, n_known, sentence_ids,
       array_to_string(list_filter([{", ".join(hits)}], lambda x: x IS NOT NULL), ',') AS licences
FROM r{len(L.RULES) - 1}"""


SQL = {"op3_license_scan": licence_sql(), "op10_quality_rules": OP10_QUALITY_RULES}
