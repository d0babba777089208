"""Plain versions of the contracts, written from their wording."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    w = WORD.findall(ascii_lower(text))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(items, linked):
    parent = {x: x for x in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = list(items)
    for k, x in enumerate(items):
        for y in items[:k]:
            if linked(x, y):
                parent[root(x)] = root(y)
    return {x: root(x) for x in items}


def jaccard_rows(rows):
    """(doc_id, n_shingles, component_id) of every row."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = groups({s for _, s in sets if s}, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    least = defaultdict(list)
    for i, s in sets:
        if s and i is not None:
            least[root[s]].append(i)
    return Counter((i, len(s), min(least[root[s]], default=None) if s else i) for i, s in sets)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def line_firsts(rows, threshold, min_chars):
    """(doc_id, line number) -> first occurrence of its class."""
    seen = defaultdict(set)
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            if WORD.search(line):
                seen[line].add((i, k))
    near = lambda a, b: (min(len(a), len(b)) >= min_chars and abs(len(a) - len(b)) <= threshold
                         and edit(a, b) <= threshold)
    root = groups(seen, near)
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    first = {}
    for line, places in seen.items():
        first[root[line]] = min([*places, *([first[root[line]]] if root[line] in first else [])], key=order)
    return {p: first[root[line]] for line, places in seen.items() for p in places}


PII = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
       "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
       "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def pii_ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        doubled = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))]
        return 13 <= len(d) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def pii(text):
    return [(k, m.start(), m.end()) for k, r in PII.items() for m in r.finditer(text) if pii_ok(k, m.group())]


SECRETS = {"assign": re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                                re.I | re.A), "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+")}


def secrets(text):
    least = {"assign": 12, "access": 18, "hex": 16}
    found = [(k, m.start(), m.end()) for k, r in SECRETS.items() for m in r.finditer(text)
             if len(m.group(2) if k == "assign" else m.group()) >= least[k]]
    return sorted(found, key=lambda s: (s[1], list(SECRETS).index(s[0])))


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    inside = {p for k in range(len(w) - 7) if seen[tuple(w[k:k + 8])] > 1 for p in range(k, k + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def targets(sizes):
    """source -> target, by repeated resharing."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 2 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / w for s in free}
        fixed |= {s: 2.0 * sizes[s] for s in over}


# ---- spelling, repeats, importance --------------------------------------------------

def spelling(rows):
    """(word, form, root, n, n_near, form_n) of every word."""
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t):
            run = ascii_lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    letters = {c for w in counts for c in w}

    def near(w):
        one = {w[:k] + w[k + 1:] for k in range(len(w))}
        one |= {w[:k] + c + w[k + d:] for k in range(len(w) + 1) for c in letters for d in (0, 1)}
        return [v for v in one if v != w and v in counts]

    forms, out = {}, []
    for w, n in counts.items():
        others = sorted(near(w), key=lambda v: (-counts[v], v))
        good = bool(others) and counts[others[0]] >= 10 * n
        forms[w] = others[0] if good else None
        out.append((w, n, len(others)))

    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w

    return Counter((w, forms[w], root(w), n, k, counts[forms[w]] if forms[w] else None) for w, n, k in out)


def repeats(rows, span=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    order = lambda i: float("inf") if i is None else i
    raws = [(i, t.encode("utf-8", "surrogatepass")) for i, t in rows]
    first = {}
    for i, raw in raws:
        for k in range(len(raw) - span + 1):
            s = raw[k:k + span]
            first[s] = min(first.get(s, float("inf")), order(i))
    out = Counter()
    for i, raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - span + 1):
            if first[raw[k:k + span]] < order(i):
                gone[k:k + span] = b"\x01" * span
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[(i, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


IMPORTANCE_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def importance_features(text):
    w = IMPORTANCE_WORD.findall(ascii_lower(text))
    runs = [" ".join(w[k:k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]
    return len(w), [zlib.crc32(r.encode("utf-8", "surrogatepass")) % 10000 for r in runs]


def importance(rows, target):
    """(doc_id, n_features, weight, score, rank) of every row."""
    found = [(i, *importance_features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in importance_features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], float("inf") if r[0] is None else r[0]))
    for k, r in enumerate(able[:5 * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)
