"""Plain versions of what the operators compute, and small tables with every odd case."""

import re

WORDS = "the of and to in is was for on with that by this from ing er on re st tion and nt ea ou wh th ha he ti".split()


def text(rng, n):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingle_set(t, n):
    w = re.findall("[^\x20\x09-\x0d]+", lower(t or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def jaccard_components(sets, num, den):
    links = []
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            c = len(x & y)
            if c and den * c >= num * (len(x) + len(y) - c):
                links.append((i, j))
    return components(len(sets), links)


def edited(rng, t, k):
    w = t.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = "zz" + rng.choice(WORDS)
    return " ".join(w)
