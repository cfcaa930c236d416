"""Plain versions of the operators' fixed contracts, for small tables."""

from __future__ import annotations

import re
from collections import Counter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = SPACE.findall((text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def near_duplicates(rows):
    """{id: (n_shingles, component)} by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            both = len(a & b) if a and b else 0
            if both and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    places = [(i, label) for phrase, label in PHRASES.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def lines(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = SPACE.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(runs)
    again = {i + k for i, r in enumerate(runs) if counts[r] > 1 for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), n < 10 or 100 * len(again) > 20 * n


def lines_kept(text, bad_line):
    """kept and cleaned, given which lines fail: all lines without words stay, of equal ones the first."""
    each = (text or "").split("\n")
    left = [x for k, x in enumerate(each) if not SPACE.search(x) or x not in each[:k] and not bad_line(x)]
    size = lambda x: sum(map(len, SPACE.findall(x)))
    return not lines(text)[-1] and 2 * sum(map(size, left)) >= size(text or ""), "\n".join(left)


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    """(start, rank, kind, end) of the base kinds."""
    text = text or ""
    digits = lambda x: re.sub("[^0-9]", "", x)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    ]
    return sorted((m.start(), r, k, m.end()) for r, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m.group()))


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def ranks(edges, seeds, damping=0.85):
    """Personalised PageRank that loses what reaches hosts without edges: {host: rank}; edges {(src, dst): n}."""
    out = Counter()
    for (a, _), n in edges.items():
        out[a] += n
    rank = {}
    for _ in range(400):
        now = Counter({h: (1 - damping) * s for h, s in seeds.items()})
        for (a, b), n in edges.items():
            now[b] += damping * rank.get(a, 0.0) * n / out[a]
        rank = now
    return rank


def url(text):
    """host, path, rule, verdict (None where no rule fits)."""
    if text is None or "://" not in text:
        return "", "", None, None
    rest = text.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = host.translate(UPPER)
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]
