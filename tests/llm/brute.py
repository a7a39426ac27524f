"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def repeats(docs, window=20):
    """doc_id -> (n_words, n_removed, sha256 of what is kept)."""
    seen, out = {}, {}
    for i, t in sorted(docs):
        x = words(t)
        gone = [False] * len(x)
        for p in range(len(x) - window + 1):
            k = tuple(x[p : p + window])
            if k in seen:
                gone[p : p + window] = [True] * window
            else:
                seen[k] = (i, p)
        out[i] = (len(x), sum(gone), hashlib.sha256(b" ".join(a for a, g in zip(x, gone) if not g)).hexdigest())
    return out


def repeats_of_rows(docs, window=20):
    """(doc_id, n_words, n_removed, sha256 of what is kept) of each row; a null id is the largest, rows of one id are apart."""
    first, out = {}, []
    number = lambda i: float("inf") if i is None else i
    for i, t in docs:
        x = words(t)
        for p in range(len(x) - window + 1):
            k = tuple(x[p : p + window])
            first[k] = min(first.get(k, number(i)), number(i))
    for i, t in docs:
        x, seen = words(t), set()
        gone = [False] * len(x)
        for p in range(len(x) - window + 1):
            k = tuple(x[p : p + window])
            if first[k] < number(i) or k in seen:
                gone[p : p + window] = [True] * window
            seen.add(k)
        out.append((i, len(x), sum(gone), hashlib.sha256(b" ".join(a for a, g in zip(x, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def joined(docs):
    """doc_id -> (class_id, copy_of, n_links, n_copies) at a similarity of 0.8."""
    sets = {i: shingles(t) for i, t in docs}
    node = defaultdict(list)
    for i in sorted(sets):
        if sets[i]:
            node[sets[i]].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def unite(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    links, every = defaultdict(int), list(node)
    for ids in node.values():
        for i in ids:
            unite(ids[0], i)
    for a in range(len(every)):
        for b in range(a):
            x, y = every[a], every[b]
            both = len(x & y)
            if both and 9 * both >= 4 * (len(x) + len(y)):
                links[a] += 1
                links[b] += 1
                unite(node[x][0], node[y][0])
    out = {i: (i, i, 0, 0) for i in sets}
    for k, x in enumerate(every):
        for i in node[x]:
            out[i] = (find(i), node[x][0], links[k], len(node[x]) - 1)
    return out


def greedy_pieces(word, starting, continuing):
    """Tokens of a word by longest match, 0 if it can't be cut."""
    n, at, entries = 0, 0, starting
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in entries:
                break
        else:
            return 0
        n, at, entries = n + 1, end, continuing
    return n


def joined_rows(docs):
    """One (doc_id, text) of each group of near duplicates of rows unlike each other: all of them."""
    sets = [shingles(t) for _, t in docs]
    for a in range(len(docs)):
        for b in range(a):
            assert 9 * len(sets[a] & sets[b]) < 4 * (len(sets[a]) + len(sets[b]))
    return docs
