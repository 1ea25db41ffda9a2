"""Plain-Python forms of the operators, for small tables."""

import hashlib
from collections import defaultdict


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def near_duplicates(docs, size, percent=80):
    """id to (number of shingles, component)."""
    sets = {i: shingle_set(t, size) for i, t in docs}
    ids = sorted(i for i in sets if sets[i])
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(sets, links)
    return {i: (len(sets[i]), comp[i]) for i in sets}


def levenshtein(a, b):
    """Edit distance by columns of bits (Myers), in whole numbers of any length."""
    if not a or not b:
        return len(a) + len(b)
    at = defaultdict(int)
    for i, c in enumerate(a):
        at[c] |= 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, d = full, 0, len(a)
    for c in b:
        eq = at[c]
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = (down | ~(diagonal | up)) & full, up & diagonal
        d += bool(right & top) - bool(left & top)
        right, left = ((right << 1) | 1) & full, (left << 1) & full
        up, down = (left | ~(diagonal | right)) & full, right & diagonal
    return d


def similar(a, b, percent=80):
    most = (100 - percent) * max(len(a), len(b)) // 100
    return abs(len(a) - len(b)) <= most and levenshtein(a, b) <= most


def line_places(docs):
    places = defaultdict(list)
    for i, t in docs:
        for pos, line in enumerate((t or "").split("\n")):
            if t is not None and (words := line.lower().split()):
                places[" ".join(words)].append((i, pos))
    return places


def line_links(norms, percent=80, rare=None):
    """Pairs of an edit similarity; with ``rare``, of lines that are short or share a word that at most so many lines have."""
    if rare is None:
        pairs = {(x, y) for x in range(len(norms)) for y in range(x + 1, len(norms))}
    else:
        having = defaultdict(list)
        for k, n in enumerate(norms):
            for w in set(n.split(" ")):
                having[w].append(k)
        short = [k for k, n in enumerate(norms) if len(n) < 40]
        pairs = {(x, y) for ks in [*(v for v in having.values() if len(v) <= rare), short] for x in ks for y in ks if x < y}
    return [(x, y) for x, y in pairs if similar(norms[x], norms[y], percent)]


def dedup_lines(docs, percent=80, rare=None):
    """[(id, text without repeats, removed)] by edit similarity alone; ids are distinct and not null."""
    places = line_places(docs)
    norms = sorted(places)
    group = components(range(len(norms)), line_links(norms, percent, rare))
    keep = {}
    for k, n in enumerate(norms):
        keep[group[k]] = min([keep[group[k]], *places[n]] if group[k] in keep else places[n])
    gone = defaultdict(set)
    for k, n in enumerate(norms):
        for i, pos in places[n]:
            if (i, pos) != keep[group[k]]:
                gone[i].add(pos)
    return [(i, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]), len(gone[i])) for i, t in docs]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
