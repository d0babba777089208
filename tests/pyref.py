"""Plain-Python statements of the rules, used as brute force in tests.

Written from the published definitions (ROUGE: Lin 2004; BLEU: Papineni et al.
2002 with mteval-13a tokens and exp smoothing as in Post 2018) and from the
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np


def rouge_tokens(text):
    return re.findall(r"[a-z0-9]+", text.lower())


def _grams(tokens, n):
    return Counter(tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1))


def _f(match, na, nb):
    p = match / max(na, 1)
    r = match / max(nb, 1)
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def rouge_n(a, b, n):
    ga, gb = _grams(rouge_tokens(a), n), _grams(rouge_tokens(b), n)
    match = sum(min(c, gb[g]) for g, c in ga.items())
    return _f(match, sum(ga.values()), sum(gb.values()))


def lcs(x, y):
    dp = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            dp[i][j] = dp[i - 1][j - 1] + 1 if x[i - 1] == y[j - 1] else max(dp[i - 1][j], dp[i][j - 1])
    return dp[-1][-1]


def rouge_l(a, b):
    ta, tb = rouge_tokens(a), rouge_tokens(b)
    return _f(lcs(ta, tb), len(ta), len(tb))


_13A = [
    (re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "),
    (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "),
    (re.compile(r"([\.,])([^0-9])"), r" \1 \2"),
    (re.compile(r"([0-9])(-)"), r"\1 \2 "),
]


def bleu_tokens(line):
    line = line.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for ent, ch in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        line = line.replace(ent, ch)
    line = f" {line} "
    for pat, rep in _13A:
        line = pat.sub(rep, line)
    return line.split()


def bleu(hyp, ref):
    h, r = bleu_tokens(hyp), bleu_tokens(ref)
    correct, total = [], []
    for n in range(1, 5):
        gh, gr = _grams(h, n), _grams(r, n)
        correct.append(sum(min(c, gr[g]) for g, c in gh.items()))
        total.append(max(len(h) - n + 1, 0))
    if not any(correct):
        return 0.0
    bp = 1.0 if len(h) >= len(r) else (math.exp(1 - len(r) / len(h)) if len(h) > 0 else 0.0)
    precisions, smooth = [0.0] * 4, 1.0
    for n in range(4):
        if total[n] == 0:
            break
        if correct[n] == 0:
            smooth *= 2
            precisions[n] = 100.0 / (smooth * total[n])
        else:
            precisions[n] = 100.0 * correct[n] / total[n]
    logs = [math.log(p) if p > 0 else -9999999999 for p in precisions]
    return bp * math.exp(sum(logs) / 4)


def top_k_top_p(scores, top_k=0, top_p=1.0, min_keep=1):
    """Which scores of one group stay.  Rank 0 is the best (ties: smaller index first).  Top-k: at least
    the k-th best value.  Top-p, over what top-k left: the best one, those with at most p of the mass
    strictly before them, and with ``min_keep`` m > 1 the ranks up to m."""
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], i))
    limit = scores[order[min(max(top_k, min_keep), len(order)) - 1]] if top_k > 0 else -math.inf
    left = [i for i in order if scores[i] >= limit]
    mass = [math.exp(scores[i] - scores[left[0]]) for i in left]
    stay, before = set(), 0.0
    for rank, i in enumerate(left):
        if top_p >= 1.0 or rank == 0 or before / sum(mass) <= top_p or (min_keep > 1 and rank <= min_keep):
            stay.add(i)
        before += mass[rank]
    return np.array([i in stay for i in range(len(scores))])


def copy_followers(generated, source, n):
    """What follows the closing n-gram of ``generated`` at its places in ``source``."""
    followers = {}
    for gram_and_next in zip(*(source[k:] for k in range(max(n, 0) + 1))):
        followers.setdefault(gram_and_next[:-1], []).append(gram_and_next[-1])
    return followers.get(tuple(generated[len(generated) - n:]), []) if 0 < n <= len(generated) else []
