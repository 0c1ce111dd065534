"""Plain Python versions of what the operators compute, for small tables."""

import re
from collections import defaultdict

_LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
_SPACED = re.compile(r"[^\x20\x09-\x0D]+")
_ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spaced(text):
    return _SPACED.findall((text or "").translate(_LOW))


def alnum(text):
    return _ALNUM.findall((text or "").translate(_LOW))


def shingles(text):
    w = spaced(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def smallest_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_components(texts, percent=85):
    """{id: (n_shingles, component)} of {id: text}."""
    sets = {k: shingles(t) for k, t in texts.items()}
    where, common = defaultdict(list), defaultdict(int)
    for k, s in sorted(sets.items()):
        for x in s:
            for other in where[x]:
                common[other, k] += 1
            where[x].append(k)
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    found = smallest_reachable(sets, links)
    return {k: (len(sets[k]), found[k]) for k in sets}


def contamination(texts, items, n=10):
    """{id: (n_words, n_hit, items)} of {id: text} and [(item_id, text)]."""
    windows = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[i : i + size])].add(str(item))
    found = {}
    for k, text in texts.items():
        w, hit, names = alnum(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    names |= windows[tuple(w[i : i + size])]
                    hit |= set(range(i, i + size))
        found[k] = (len(w), len(hit), sorted(names))
    return found


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def deduped_lines(texts, short=16):
    """{id: text without repeated lines} of {id: text}."""
    seen, found = [], {}
    for k, text in sorted(texts.items()):
        kept = []
        for line in text.split("\n"):
            blank = not line.strip(" \t\n\r\f\v")
            near = [s for s in seen if abs(len(s) - len(line)) <= 1]
            again = any(s == line or min(len(s), len(line)) >= short and edit_distance(s, line) <= 1 for s in near)
            if blank or not again:
                kept.append(line)
            if not blank:
                seen.append(line)
        found[k] = "\n".join(kept)
    return found
