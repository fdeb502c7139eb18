"""Brute-force versions that the tests compare with."""

import re


def word_shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def groups(nodes, links):
    """Smallest node reachable, by node."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near_groups(docs, n, percent=80):
    """Component of each (doc_id, text) by all pairs."""
    sets = {d: word_shingles(t, n) for d, t in docs}
    by_word = {}
    for d, s in sets.items():
        for x in s:
            by_word.setdefault(x, []).append(d)
    pairs = {(a, b) for own in by_word.values() if len(own) > 1 for i, a in enumerate(own) for b in own[i + 1 :]}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return groups(sets, links), sets, links
