"""Plain versions of the corpus operators, for small tables."""

import re
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    data = (text or "").encode()
    if lower:
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    return WORD.findall(data)


def shingles(text, k):
    w = words(text, True)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def smallest_reachable(nodes, links):
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        if n in out:
            continue
        todo, out[n] = [n], n
        while todo:
            for m in near[todo.pop()]:
                if m not in out:
                    out[m] = n
                    todo.append(m)
    return out


def jaccard_components(docs, k, num, den):
    sets = {i: shingles(t, k) for i, t in docs}
    where, links = defaultdict(list), []
    for i, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for j in where[x]:
                shared[j] += 1
            where[x].append(i)
        links += [(j, i) for j, c in shared.items() if den * c >= num * (len(s) + len(sets[j]) - c)]
    root = smallest_reachable(sets, links)
    return {i: (len(s), root[i]) for i, s in sets.items()}


def removed_words(docs, width):
    """{id: (kept words, n_words)} with every word of a repeated window removed."""
    seen, listed = defaultdict(int), {i: words(t) for i, t in docs}
    for w in listed.values():
        for p in range(len(w) - width + 1):
            seen[tuple(w[p:p + width])] += 1
    out = {}
    for i, w in listed.items():
        gone = set()
        for p in range(len(w) - width + 1):
            if seen[tuple(w[p:p + width])] > 1:
                gone.update(range(p, p + width))
        out[i] = ([x for n, x in enumerate(w) if n not in gone], len(w))
    return out
