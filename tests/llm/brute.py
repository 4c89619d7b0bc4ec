"""Plain versions of what the operators compute, over lists of rows."""

import re
from collections import Counter

SPACES = re.compile("[^\\x20\\x09-\\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return SPACES.findall(text or "")


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if SPACES.search(x)]
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {k for k, n in Counter(windows).items() if n > 1}
    covered = {j for i, k in enumerate(windows) if k in often for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def shingles(text, size=5):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)])


def near_duplicates(rows, percent=85):
    """{doc_id: (n_shingles, component_id)} of rows with different ids; every pair that shares a shingle is compared."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for pair in {(a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}:
        x, y = sets[pair[0]], sets[pair[1]]
        both = len(x & y)
        if 100 * both >= percent * (len(x) + len(y) - both):
            p, q = root(pair[0]), root(pair[1])
            up[max(p, q)] = min(p, q)
    return {i: (len(s), root(i)) for i, s in sets.items()}


ASSIGN = re.compile("((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def base_secrets(text):
    """Spans (start, kind, end) of the fixed patterns."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 16])


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0
