"""Plain re-statements of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    return ascii_lower(host), re.split(r"[?#]", rest, maxsplit=1)[0]


def rule_of(host, path, rules):
    best = None
    for text, says in rules:
        name, prefix = text.split("/", 1)[0], "/" + text.split("/", 1)[1]
        if (host == name or host.endswith("." + name)) and path.startswith(prefix) and (best is None or len(text) > len(best[0])):
            best = (text, says)
    return best or (None, None)


def licenses(text):
    words, places, labels = ALNUM.findall(ascii_lower(text)), [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def shingle_set(text):
    w = WORD.findall(ascii_lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def near(docs, percent):
    """doc_id -> component by all pairs."""
    sets = {d: shingle_set(t) for d, t in docs}
    ids, up = sorted(sets), {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = sorted((root(a), root(b)))
                    up[q] = p
    return {d: root(d) for d in ids}, {d: len(s) for d, s in sets.items()}


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


PATTERNS = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def secrets(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p, g, n) in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m[g]) >= n]
    found.sort()
    counts = Counter(k for *_, k in found)
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)
    return counts["assign"], counts["access"], counts["hex"], hashlib.sha256(joined.encode()).hexdigest(), [f"{k}:{a}:{b}" for a, _, b, k in found]


def targets(sizes, weights=(5, 2, 1), cap=3):
    """source -> size to source -> target, by sharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > cap * sizes[s]}
        if not above:
            return {s: float(cap * sizes[s]) if s in capped else share[s] for s in order}
        capped |= above
