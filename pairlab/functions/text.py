"""Text Column expressions: word tokens, token filters, sentences.

All rules are plain regular expressions written so that Java's regex engine
(Spark) and RE2 (used by the SQL oracle) read them identically.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (our own documented text rules; both engines must agree on them)
# ---------------------------------------------------------------------------
# Word token: a number with optional decimal/thousand groups, or a letter run
# with marks/digits and an optional apostrophe suffix ("don't", "l’homme").
TOKEN_RE = r"\p{N}+(?:[.,]\p{N}+)*|\p{L}[\p{L}\p{M}\p{N}]*(?:['’]\p{L}+)?"
# Token keep rule: drop punctuation-only and digit-only tokens and tokens holding
# newline, pipe, dollar, less-than, greater-than, blank, back-tick or NBSP.
PUNCT_ONLY_RE = r"^\p{P}+$"
DIGITS_ONLY_RE = r"^\p{Nd}+$"
BANNED_CHARS_RE = r"[\n|$<> `\x{A0}]"
# Whitespace = the characters Python's str.split() splits on.
WS_CLASS = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# The same whitespace as a plain character list (for trimming without regex).
WS_CHARS = "".join(chr(c) for c in [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680]
                   + list(range(0x2000, 0x200B)) + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
# Sentence boundary: . ! or ? followed by whitespace, or a newline.  Sentences
# are trimmed of whitespace; empty ones are dropped.
SENTENCE_END_RE = r"([.!?])" + WS_CLASS + "+"


# English function words (fixed values, our own short list in alphabetical order).
STOP_WORDS = tuple("""
a about above after again against all also am an and any are as at be because been before being below
between both but by can could did do does doing down during each few for from further had has have having
he her here hers herself him himself his how i if in into is it its itself just me more most my myself no
nor not now of off on once only or other our ours ourselves out over own same she should so some such than
that the their theirs them themselves then there these they this those through to too under until up very
was we were what when where which while who whom why will with would you your yours yourself yourselves
""".split())


def default_stop_words() -> tuple[str, ...]:
    """The default stop-word list (plain data: needs neither a JVM nor a session)."""
    return STOP_WORDS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_tokens(text) -> Column:
    """T1+T2: lower-case, then rule-based word tokens (array<string>)."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN_RE), F.lit(0))


def _keep(t: Column) -> Column:
    return ~t.rlike(PUNCT_ONLY_RE) & ~t.rlike(DIGITS_ONLY_RE) & ~t.rlike(BANNED_CHARS_RE)


def keep_tokens(tokens) -> Column:
    """token keep predicate applied to an array of tokens."""
    return F.filter(_col(tokens), _keep)


def lexical_tokens(tokens, stop_words=None) -> Column:
    """kept tokens that are not stop words (tokens must already be F4-kept).
    ``isin`` over the literal list is planned as a hash-set lookup (InSet)."""
    stop = default_stop_words() if stop_words is None else tuple(stop_words)
    if not stop:
        return _col(tokens)
    return F.filter(_col(tokens), lambda t: ~t.isin(*stop))


def sentences_of(text) -> Column:
    """Split a text into sentences (boundary rule above), trimmed, no empties."""
    marked = F.regexp_replace(_col(text), F.lit(SENTENCE_END_RE), F.lit("$1\n"))
    trimmed = F.transform(F.split(marked, "\n"), lambda s: F.btrim(s, F.lit(WS_CHARS)))
    return F.filter(trimmed, lambda s: s != "")


def tokens_per_sentence(sentences, stop_words=None, lexical: bool = False) -> Column:
    """Number of kept (or lexical) tokens in each sentence."""
    def count(s):
        kept = keep_tokens(word_tokens(s))
        return F.size(lexical_tokens(kept, stop_words) if lexical else kept)

    return F.transform(_col(sentences), count)


def array_mean(arr) -> Column:
    """Mean of a numeric array; NULL for an empty array."""
    a = _col(arr)
    total = F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return F.when(F.size(a) > 0, total / F.size(a))
