"""Plain restatements of the corpus queries, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def substring(docs, width=13):
    """docs: list of (id, text)."""
    first = {}
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = []
    for i, t in docs:
        w = WORD.findall(t or "")
        gone = [0] * len(w)
        for k in range(len(w) - width + 1):
            f = first[tuple(w[k : k + width])]
            if f is not None and (i is None or f < i):
                gone[k : k + width] = [1] * width
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return out


def suffixes(docs, depth=400):
    raw = [(i, (t or "").encode()) for i, t in docs]
    count = Counter(r[k : k + depth] for _, r in raw for k in range(len(r) - depth + 1))
    out = []
    for i, r in raw:
        gone = bytearray(len(r))
        for k in range(len(r) - depth + 1):
            if count[r[k : k + depth]] > 1:
                gone[k : k + depth] = b"\1" * depth
        spans = sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(r), sum(gone), spans, sha(bytes(x for x, g in zip(r, gone) if not g))))
    return out


def quality(docs):
    out = []
    for i, t in docs:
        t = t or ""
        w = WORD.findall(t)
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = [0] * len(w)
        for k in range(len(w) - 7):
            if c[tuple(w[k : k + 8])] > 1:
                hit[k : k + 8] = [1] * 8
        lines = [x for x in t.split("\n") if WORD.search(x)]
        out.append((i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), sum(hit), len(w) < 20 or 100 * sum(hit) > 30 * len(w)))
    return out


def secrets(text):
    assign = re.compile(r"""((?:(?a:(?i:password|passwd|secret|token|api_?key))))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def lines(docs):
    """(id, lines, gone, sha of what stays) by one edit in words."""
    rows = sorted(((i is None, i or 0, p, tuple(WORD.findall(x))) for i, t in docs for p, x in enumerate((t or "").split("\n"))), key=lambda r: r[:3])
    rows = [r for r in rows if r[3]]
    gone = set()
    for k, (_, i, p, w) in enumerate(rows):
        for _, _, _, u in rows[:k]:
            if w == u or (min(len(w), len(u)) >= 8 and abs(len(w) - len(u)) <= 1 and one_edit(w, u)):
                gone.add((i, p))
                break
    out = []
    for i, t in docs:
        ls = (t or "").split("\n")
        kept = [x for p, x in enumerate(ls) if (i or 0, p) not in gone]
        out.append((i, len(ls), len(ls) - len(kept), sha("\n".join(kept).encode())))
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard(docs, least=75):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if i is not None and j is not None and s and u and 100 * len(s & u) >= least * len(s | u):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i)) for i, s in sets]


def leaks(docs, items, width=10):
    """(id, words, hit, items, sha, contaminated) and the text without its hits."""
    windows = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(FOLD))
        if i is not None:
            for k in range(max(1, len(w) - width + 1) if w else 0):
                windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out, cleaned = [], []
    for i, t in docs:
        found = list(ALNUM.finditer((t or "").translate(FOLD)))
        w = [m[0] for m in found]
        hit, of = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    of |= own
                    hit[k : k + n] = [1] * n
        out.append((i, len(w), sum(hit), len(of), sha(",".join(sorted(of)).encode()), any(hit)))
        text, at = "", 0
        for k, m in enumerate(found):
            if hit[k] and (k == 0 or not hit[k - 1]):
                text += t[at : m.start()]
            if hit[k]:
                at = m.end()
        cleaned.append((i, None if t is None else text + t[at:]))
    return out, cleaned
