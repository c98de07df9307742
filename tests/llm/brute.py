"""Plain Python versions of the operators, quadratic and obvious."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOWN = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring(rows, window=13):
    """[(doc_id, text)] -> [(doc_id, n_words, n_removed, kept)]."""
    least = {}
    top = float("inf")
    for i, text in rows:
        w = WORD.findall(text or "")
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            least[key] = min(least.get(key, top), top if i is None else i)
    out = []
    for i, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < (top if i is None else i):
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def decontaminate(docs, items, size=10):
    out = []
    for i, text in docs:
        w = BENCH.findall((text or "").translate(DOWN))
        hit, ids = set(), set()
        for item, body in items:
            b = BENCH.findall((body or "").translate(DOWN))
            m = min(size, len(b))
            for s in range(len(b) - m + 1 if m else 0):
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == b[s : s + m]:
                        hit.update(range(p, p + m))
                        ids.add("null" if item is None else str(item))
        out.append((i, len(w), len(hit), len(ids), ",".join(sorted(ids)), bool(hit)))
    return out


def shingles(text, k):
    w = WORD.findall((text or "").translate(DOWN))
    if not w:
        return frozenset()
    return frozenset(tuple(w[p : p + k]) for p in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near(rows, k, percent):
    """{doc_id: (n_shingles, component)} for unique ids."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def lines(rows, percent=80):
    """[(doc_id, n_lines, n_removed, kept)]; ids unique, null first."""
    order = lambda i: -1 if i is None else i
    every = sorted((order(i), n, frozenset(WORD.findall(x))) for i, t in rows for n, x in enumerate((t or "").split("\n")))
    every = [e for e in every if e[2]]
    gone = {(i, n) for k, (i, n, s) in enumerate(every) if any(100 * len(s & o) >= percent * len(s | o) for _, _, o in every[:k])}
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for n, x in enumerate(own) if (order(i), n) not in gone]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = [], 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.append(line)
    grams = Counter(tuple(w[p : p + 3]) for p in range(len(w) - 2))
    rep = {p + o for p in range(len(w) - 2) if grams[tuple(w[p : p + 3])] > 1 for o in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(rep)


def judge(url, rules, listed):
    at = (url or "").find("://")
    host = path = ""
    if at >= 0:
        rest = url[at + 3 :]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(DOWN)
    best = max(((len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    if best:
        return host, path, best[2], best[3]
    bad = any((host == h or host.endswith("." + h)) and path.startswith("/" + p) for h, _, p in (x.partition("/") for x in listed))
    return host, path, None, "block" if bad else "allow"
